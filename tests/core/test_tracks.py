"""Caption tracks on small rows: order, what is read, and every reason for none."""

from lineweave.operators import tracks as T

TRACKS, LINES, HINTS = "song long, track string, manual boolean", "song long, track string, k int, text string", "song long, hint string, own string"
JA, KO, ZH, EN = "かなの歌です", "한국어 노래", "漢字漢字", "plain words"


def lines(song, track, text, n=3):
    return [(song, track, k, f"{text} {k}") for k in range(n)]


def run(spark, tracks, payloads, hints):
    got = T.lyric_tracks(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(payloads, LINES), spark.createDataFrame(hints, HINTS))
    return {r.song: (r.track, r.language, r.probes, r.error) for r in got.collect()}


def test_each_reason(spark):
    tracks = [
        (1, "ja", True), (1, "en", True), (1, "ja", True), (2, "en", True), (2, "ko", True), (3, "de", True), (3, "en", True), (4, "ja", False), (5, "ko", True), (6, "ko", True), (7, "ja", True),
        (8, "en", True), (9, "zh", True), (10, "zh", True), (11, "en", True), (12, None, True), (13, "aa", True), (13, "bb", True), (13, "cc", True), (13, "dd", True), (13, "ee", True),
    ]
    payloads = (
        lines(1, "ja", JA) + lines(1, "en", EN) + lines(2, "en", EN) + lines(2, "ko", KO) + lines(3, "de", JA) + lines(4, "ja", JA) + lines(5, "ko", JA) + lines(6, "ko", KO) + lines(8, "en", EN, 2)
        + lines(9, "zh", ZH) + lines(10, "zh", JA) + lines(11, "en", EN) + lines(13, "ee", JA) + lines(13, "dd", EN) + [(7, "ja", 0, "[music]"), (7, "ja", 1, None)] + [(8, "en", 9, f"{EN} 1")]
    )
    hints = [(1, "ja", None), (2, None, None), (3, "ja", None), (5, "ja", None), (6, "ja", None), (9, "ja", None), (10, "zh", None)]
    got = run(spark, tracks, payloads, hints)
    assert got == {
        1: ("ja", "ja", 1, None),
        2: ("ko", "ko", 2, None),
        3: (None, None, 0, "no_original_track"),  # no track in the title's language
        4: (None, None, 0, "no_manual_captions"),
        5: ("ko", "ja", 1, None),  # a single track, whose body is what the title says
        6: (None, None, 1, "no_original_track"),
        7: (None, None, 1, "empty_caption"),
        8: (None, None, 1, "too_short"),  # the repeated line counts once
        9: ("zh", "ja", 1, None),
        10: (None, None, 1, "no_original_track"),
        11: (None, None, 1, "non_cjk_caption"),
        12: (None, None, 0, "no_manual_captions"),
        13: (None, None, 4, "non_cjk_caption"),  # the fifth isn't looked into
    }
    assert run(spark, [], [], []) == {}


def test_order_of_ranks(spark):
    tracks = spark.createDataFrame([(1, c, True) for c in ("en", "ja-JP", "ko", "ja", "de")] + [(1, "zh", False)], TRACKS)
    by = lambda *h: [r.track for r in T.ranked_tracks(tracks, spark.createDataFrame([h], HINTS)).orderBy("rank").collect()]
    assert by(1, "ja", None) == ["ja", "ja-JP", "de", "en"]
    assert by(1, "ja", "ko-KR") == ["ko", "ja", "ja-JP", "de"]
    assert by(2, "ja", None) == ["de", "en", "ja", "ja-JP"]


def test_payloads_are_read_only_where_their_rank_is_reached(spark, monkeypatch):
    tracks = [(s, c, True) for s in range(6) for c in ("ja", "ko")]
    payloads = [x for s in range(6) for x in lines(s, "ja", JA if s else EN) + lines(s, "ko", KO)]
    seen, plain = [], T.looked_into
    monkeypatch.setattr(T, "looked_into", lambda now, *rest: (seen.append(sorted((r.song, r.track) for r in now.collect())), plain(now, *rest))[1])
    got = run(spark, tracks, payloads, [])
    assert seen == [[(s, "ja") for s in range(6)], [(0, "ko")], [], []]
    assert got[0] == ("ko", "ko", 2, None) and got[5] == ("ja", "ja", 1, None)


def test_translations(spark):
    tracks = spark.createDataFrame([(1, "ko-KR", True), (1, "ko", True), (2, "ko", True), (3, "ko", False)], TRACKS)
    taken = spark.createDataFrame([(1, "ja", None), (2, "ko", None), (3, "ja", None), (4, "ja", "x")], "song long, language string, error string")
    assert [tuple(r) for r in T.translation_tracks(tracks, taken).collect()] == [(1, "ko")]
    timed = "song long, line long, text string, s long, e long"
    own = spark.createDataFrame([(1, 0, "a", 0, 10), (1, 1, "b", 10, 20), (1, 2, "c", 20, 120), (1, 3, "d", None, 9), (1, 4, "e", 300, 301)], timed)
    other = spark.createDataFrame([(1, 0, "x", 0, 14), (1, 1, "y", 14, 20), (1, 2, None, 90, 130), (1, 3, "z", 300, 300)], timed)
    got = {r.line: r.translation for r in T.translated_lines(own, other, 50, 0.3).collect()}
    assert got == {0: "x", 1: "y", 2: None}
    assert T.translated_lines(own.limit(0), other, 50, 0.3).collect() == []
