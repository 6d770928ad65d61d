from pyspark.sql import functions as F

from lineweave.functions import lyrics
from lineweave.operators import fixes
from lineweave.operators.choices import fused, signed_ranks
from lineweave.sources import payloads as P


def test_languages(spark):
    rows = [("かなと漢字", "ja"), ("한국어 노래", "ko"), ("只有汉字", "zh"), ("plain words", "ja"), ("", "en"), (None, "ja")]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = df.select(lyrics.body_language(F.col("text")).alias("b"), lyrics.script_absent(F.col("lang"), F.col("text")).alias("a")).collect()
    assert [r.b for r in got] == ["ja", "ko", "zh", None, None, None]
    assert [r.a for r in got][:5] == [False, False, False, True, False]
    some = spark.createDataFrame([("Ab1漢字カナ 한글", "[music] la ♪ (x) la", "zh_Hant-TW", "abcDEF_-012")], "t string, c string, l string, i string")
    r = some.select(lyrics.tokens(F.col("t")).alias("t"), lyrics.clean_caption(F.col("c")).alias("c"), lyrics.base_language(F.col("l")).alias("l"), lyrics.valid_id(F.col("i")).alias("i")).first()
    assert (r.t, r.c, r.l, r.i) == (["ab1", "漢", "字", "カナ", "한글"], "la la", "zh", True)


def test_table_lines(spark):
    row = lambda *x: "".join(f"<tr><td>{c}</td></tr>" for c in x)
    pages = [row("a", "p<br>q", "t &amp; u", "b", "c", "d"), row("a", "b"), row("a", "b", "c", "d", "e"), "no table"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, html string")
    got = {r.i: [tuple(x) for x in r.l] for r in df.select("i", P.table_lines(F.col("html")).alias("l")).collect()}
    assert got == {0: [("a", "p q", "t & u"), ("b", "c", "d")], 1: [("a", None, "b")], 2: [(c, None, None) for c in "abcde"], 3: []}


def test_notes_with_tempo_changes_and_rests(spark):
    text = "[#SETTING]\nTempo=60\n[#0000]\nLength=480\nLyric=a\nNoteNum=60\nTempo=60\n[#0001]\nLength=240\nLyric=R\nNoteNum=60\n[#0002]\nLength=480\nLyric=b\nNoteNum=62\nTempo=120\n[#TRACKEND]"
    got = [(r.s, r.e, r.midi) for r in P.parse_notes(spark.createDataFrame([(1, text)], "song long, file string")).orderBy("k").collect()]
    assert got == [(0, 1_000_000, 60), (1_500_000, 2_000_000, 62)]


def test_small_formats(spark):
    ctm = spark.createDataFrame([("f 1 0.50 0.25 la",), ("",)], "value string")
    assert [tuple(r) for r in P.parse_ctm(ctm).collect()] == [("f", 0.5, 0.75, "la")]
    words = spark.createDataFrame([(";;; note",), ("READ  R EH1 D",), ("READ(2)  R IY1 D",), ("A  AH0",)], "value string")
    assert {r.word: r.entries for r in P.parse_pronunciations(words).collect()} == {"read": ["R EH D", "R IY D"], "a": ["AH"]}
    broken = spark.createDataFrame([('```json\n[{"a": 1}, {"a": 2}, {"a": ',), ("none",)], "x string")
    assert [r[0] for r in broken.select(P.json_objects(F.col("x"))).collect()] == [['{"a": 1}', '{"a": 2}'], []]
    stamps = spark.createDataFrame([(1, "<00:01.00>one <00:01.50>two")], "song long, file string")
    assert [(r.s, r.e, r.word) for r in P.parse_word_stamps(stamps).orderBy("k").collect()] == [(1_000_000, 1_500_000, "one"), (1_500_000, 2_500_000, "two")]


def test_octave_snap(spark):
    x = [10, 14, 62, 15, -40, 200]
    last, want = None, []
    for v in x:
        if last is not None and abs(v - last) > 40:
            by = (v - last) / 12
            v -= 12 * int(abs(by) + 0.5) * (1 if by > 0 else -1)
        last = v
        want.append(v)
    df = spark.createDataFrame([(x,)], "x array<long>")
    assert df.select(fixes.snap_octaves(F.col("x"))).first()[0] == want


def test_fusion_and_ranks(spark):
    a, b = (spark.createDataFrame(x, "k long, id long") for x in ([(1, 5)], [(1, 5), (1, 2), (1, 9), (2, 7)]))
    assert sorted((r.k, r.place, r.id, r.source) for r in fused([a, b], "k", "id", 2).collect()) == [(1, 1, 5, 0), (1, 2, 2, 1), (2, 1, 7, 1)]
    d = spark.createDataFrame([("g", v) for v in (3, -3, 0, 1, 5)], "g string, v long")
    # sizes 1, 3, 3, 5: ranks 1, 2.5, 2.5, 4; positive ones 1 + 2.5 + 4
    assert [tuple(r) for r in signed_ranks(d, "v", "g").collect()] == [("g", 15, 4)]


def test_sung_lines(spark):
    cases = [
        ("[music] - la  la ♪", "la la"), ("Lyrics: somebody", ""), ("Guitar/Bass・Mix： x", ""), ("music: ", "music:"), ("3:00 in the morning", "3:00 in the morning"), ("Ann: hello", "hello"),
        ("a much longer head than roles have here: x", "a much longer head than roles have here: x"), ("(Music)", ""), ("(ooh)", "(ooh)"), ("https://a.b/c", ""), ("see www.a.b", "see www.a.b"), (">>> hey", "hey"), (None, ""), ("  ", ""),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    assert [r.x for r in df.select("i", lyrics.clean_line(F.col("t")).alias("x")).orderBy("i").collect()] == [b for _, b in cases]


def test_confidences(spark):
    from lineweave.operators.repairs import confidence_stats

    lines = spark.createDataFrame([(s, i) for s in range(4) for i in range(4)], "song long, line long")
    words = spark.createDataFrame([(0, 0, 0.5), (0, 0, -0.1), (0, 1, None), (1, 0, -2.0), (1, 2, -7.0), (1, 3, -4.9), (2, 0, None)], "song long, line long, confidence double")
    got = {r.song: tuple(r)[1:] for r in confidence_stats(lines, words).collect()}
    assert got == {0: (4, 2, 0.5, 0.2), 1: (4, 3, round(2 / 3, 9), round(-13.9 / 3, 6)), 2: (4, 0, 0.0, 0.0), 3: (4, 0, 0.0, 0.0)}
