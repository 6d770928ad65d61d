import random

from lineweave.functions import text as T


def test_containment_meets_everywhere_and_both_ways(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "d\u00e9f", "ghij", "kl", "\u6f22\u5b57\u4eee\u540d", "ab(zz)", "x" * 9]
    line = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    lines = [(i % 7, i, line(9)) for i in range(150)] + [(8, 0, "starts abcdefgh inside"), (8, 1, "bcde"), (8, 2, None), (8, 3, "cde")]
    items = [(i % 5, i, line(5)) for i in range(60)] + [(9, 1, "nothing"), (9, 2, "abcd efgh"), (9, 3, "abcdefghijklmno"), (9, 4, "efgh"), (9, 5, "")]
    schema = "song long, line long, text string"

    def key(x):
        import re

        return re.sub(r"[\W_]", "", re.sub(r"\([^)]*\)", "", x or "")).lower()

    want = set()
    for s, i, x in lines:
        for b, j, y in items:
            x_, y_ = key(x), key(y)
            if min(len(x_), len(y_)) >= 4 and (y_ in x_ or x_ in y_ and 10 * len(x_) >= 3 * len(y_)):
                want.add((s, i, b, j))
    got = [tuple(r) for r in T.contained_lines(spark.createDataFrame(lines, schema), spark.createDataFrame(items, schema)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a later item line, found inside a word; a short item; and no part of under 30 %
    assert {(8, 0, 9, 2), (8, 0, 9, 4)} <= want and (8, 1, 9, 3) not in want
    none = spark.createDataFrame([], schema)
    assert T.contained_lines(none, none).collect() == []


def test_equal_and_near_items_find_each_other(spark):
    import duckdb

    base = "it is the same long line of words again and again"
    rows = [(i, base) for i in range(1, 7)] + [(10 + i, base[:-3] + c) for i, c in enumerate("qwxyz")] + [(20, base + " more"), (21, "abc"), (22, "Abc!"), (23, "abcd"), (24, ""), (25, None), (26, "alone in here")]
    got = sorted(tuple(r) for r in T.best_others(spark.createDataFrame(rows, "item_id long, text string")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", rows)
    assert got == sorted(con.execute(T.QUERIES["fuzzy_rank_all"][1]).fetchall())
    # the old rule gives the six equal ones, which share no fragment of four items or fewer, no partner
    assert [r[1] for r in got if r[0] == 6] == [1, 2, 3]
    assert [(r[1], r[2]) for r in got if r[0] == 21] == [(22, 1.0), (23, 0.75)]
    assert {r[0] for r in got} == {r[0] for r in rows} - {24, 25, 26}
