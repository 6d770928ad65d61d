import hashlib
import re
import zlib
from collections import defaultdict

import duckdb

from lineweave.llm import prefix_trie as P

CHATS = "conv_id long, turn long, role string, text string, Depth string, node string, words string, OWN string"


def plain(rows, family=20, longest=3):
    """All nodes by definition."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (longest + 1)
        source = c - (abs(c) % family) * (1 if c >= 0 else -1)
        rebuilt[c] = [*own.get(source, [])[:h], *turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        leaves, saved = (1, 0) if not children[k] else (0, 0)
        saved += (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        for x in children[k]:
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    for k, who in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), len(children[k]), *below(k), digest))
    return sorted(out, key=repr)


def run(spark, rows, parts=3):
    chats = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CHATS).repartition(parts)
    turns = P.Scratch(spark).write(P.turn_rows(chats), "turns")
    head = P.F.crc32(P.F.col("conv_id").cast("string").cast("binary")) % 4
    return sorted(map(tuple, P.prefix_trie(*P.share_heads(turns, head, P.F.col("conv_id") - P.F.col("conv_id") % 20, 3)).collect()), key=repr)


def test_query_by_definition_and_by_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = P.op11_prefix_trie(spark, folder)
    assert dict(df.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in df.columns}
    found = sorted(map(tuple, df.collect()), key=repr)
    assert found == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    got = con.execute(P.OP11_SQL)
    names = [x[0] for x in got.description]
    assert sorted((tuple(r[names.index(c)] for c in df.columns) for r in got.fetchall()), key=repr) == found


def test_odd_rows(spark):
    long = "w " * 200_000
    rows = [
        (None, 0, "user", "no conversation"), (0, None, "user", "first"), (0, 0, None, None), (0, 0, None, None), (0, 1, "a", "x\x1cy z\x0bq"), (0, 1, "a", "b"),
        (1, 0, "user", "first"), (2, 5, "user", ""), (3, 0, "u", "ser"), (4, 0, "us", "er"), (5, 1, "user", long), (6, 1, "user", long + "!"), (-3, 0, "a", "b"), (-20, 0, "a", "b"),
        (47, 0, "user", "no source"), (61, 0, "a", "q"), (61, 1, "a", "q"), (61, 2, "a", "q"), (61, 3, "a", "q"), (61, 4, "a", "q"),
    ]
    assert run(spark, rows) == plain(rows) == run(spark, rows[::-1], 1)


def test_hot_paths(spark, monkeypatch):
    """Many equal conversations, and a first turn that all share; ids of an end in several runs."""
    monkeypatch.setattr(P, "RUN", 16)
    rows = [(c, t, "user", f"turn {t}" if t == 0 or c % 3 else f"turn {t} of {c % 7}") for c in range(0, 700) for t in range(c % 5)]
    assert run(spark, rows, 5) == plain(rows)


def test_no_conversations(spark):
    assert run(spark, []) == [] == run(spark, [(None, 1, "a", "b")])
