"""Objects and lines out of answers, against a JSON decoder and by hand."""

import json
import random

from pyspark.sql import functions as F

from lineweave.sources import answers as A


def decoded(text):
    """Item by item, up to the first that is broken."""
    at, out = text.find("[") + 1, []
    if not at:
        return []
    while at < len(text):
        if text[at] in " \t\r\n,":
            at += 1
            continue
        if text[at] == "]":
            break
        try:
            item, at = json.JSONDecoder().raw_decode(text, at)
        except json.JSONDecodeError:
            break
        if isinstance(item, dict):
            out.append(item)
    return out


def some(rng, deep=0):
    kind = rng.randint(0, 5 if deep < 3 else 3)
    if kind == 0:
        return rng.choice(["", "a}b", 'q"[', "\\", "한글 {", "x\n]"])
    if kind == 1:
        return rng.choice([1, -2.5, 1e9, True, None])
    if kind == 4:
        return [some(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abc{"): some(rng, deep + 1) for _ in range(rng.randint(0, 3))} if deep < 3 else "z"


def test_objects_like_a_decoder(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        text = json.dumps([some(rng) for _ in range(rng.randint(0, 5))], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        texts.append(text[: rng.randint(0, len(text))] if rng.random() < 0.6 else text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [json.loads(x) for x in r.x] for r in df.select("i", A.answer_objects(F.col("t")).alias("x")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == decoded(text), text


def test_odd_answers(spark):
    cases = [None, "", "  ", "no list", "[", "[]", '[{"a": 1} oops {"b": 2}]', '[{"a": 1}}, {"b": 2}]', '[{"a": }, {"b": 2}]', '```\n[{"a": [1, {"b": "]"}]}]\n```', '```json [{"a": 1}, {"b"', '<think>[{"x": 1}]</think>[{"y": 2}]', '[1, "two", [{"n": 3}], {"m": 4}] [{"later": 5}]']
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.x for r in df.select("i", A.answer_objects(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got[:6] == [[]] * 6 and got[6:9] == [['{"a": 1}'], ['{"a": 1}'], []]
    assert got[9:] == [['{"a": [1, {"b": "]"}]}'], ['{"a": 1}'], ['{"y": 2}'], ['{"m": 4}']]


def test_lines(spark):
    rows = [
        (1, 'Sure: [{"text": "a", "start": 1.5, "end": 2}, 7, {"text": "B", "start_time": "3", "line": 2}] done'),
        (2, "[00:01.50] one\nnoise\n[01:02] two\n3 - 6: three\n[02:00.00]last"),
        (3, "1.5 – 4.5: x\n 5 - 6 y \n"),
        (4, '[{"text": "cut'),
        (5, None),
    ]
    found = A.answer_lines(spark.createDataFrame(rows, "song long, answer string"))
    s = 1_000_000
    got = sorted(map(tuple, found.select("song", "k", "line", "text", "s", "e").collect()), key=repr)
    assert [r for r in got if r[0] == 1] == [(1, 0, None, "a", 3 * s // 2, 2 * s), (1, 1, 2, "B", 3 * s, 0)]
    assert [r for r in got if r[0] == 2] == [(2, 0, None, "one", 3 * s // 2, 62 * s - 100_000), (2, 1, None, "two", 62 * s, 3 * s - 100_000), (2, 2, None, "three", 3 * s, 120 * s - 100_000), (2, 3, None, "last", 120 * s, 123 * s)]
    assert [r for r in got if r[0] == 3] == [(3, 0, None, "x", 3 * s // 2, 5 * s - 100_000), (3, 1, None, "y", 5 * s, 6 * s)]
    assert not [r for r in got if r[0] in (4, 5)]
    lyrics = spark.createDataFrame([(1, 2, "own text"), (1, 5, "A"), (1, 7, "A"), (2, 1, None)], "song long, line long, text string")
    named = {(r.song, r.k): (r.line, r.text) for r in A.numbered_lines(found, lyrics).collect()}
    assert named[1, 0] == (7, "a") and named[1, 1] == (2, "own text") and named[2, 0] == (None, "one")
    assert A.answer_lines(spark.createDataFrame([], "song long, answer string")).collect() == []


def test_lines_take_one_pass(spark, capsys):
    A.answer_lines(spark.createDataFrame([(1, "1 - 2: a")], "song long, answer string")).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Union", "Window", "Exchange")), "an answer was read once for each notation and its lines sorted twice"
