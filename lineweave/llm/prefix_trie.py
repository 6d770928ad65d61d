"""The trie of conversation prefixes, without building it: smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it.  A
node belongs to its smallest member.  Whoever owns a node owns all that follows it on its own path, so a
conversation owns a suffix of its path, and each node has one owner.  Hence everything about a node's
subtree is a sum over the rows of its members:

* tokens that copies repeat: those of rows from here on, less those of owned ones;
* leaves: members that own the node they end in, if nobody goes on from there;
* children: members that own their next node.

One aggregation by node finds owners, windows inside each conversation sum what follows a row, and one
aggregation by node adds that up.  Aggregations combine in the tasks first, so the root, which has all
conversations, costs a row for each task.  Nodes are told apart by depth and two sums of 64-bit hashes of
(128-bit hash of the turn, place).  A conversation's rows go through windows of one task, which spill.

``ends_sha256`` covers the ids of a node's own ends: these are joined in runs of RUN ids first, and the
digest goes through the runs in order, as a stream.

Cases: rows with a null conv_id are no conversation and are left out.  Null turns come first, equal ones go
by role and text; null roles and texts are empty; repeated rows are turns.  An empty table has no nodes
(not even a root, as it would have no members).  Texts are whole, of any length.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import Scratch

#: Neighbouring ids that are joined to one text.
RUN = 4096
#: A word, as Spark and DuckDB both read it.
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_rows(chats: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn (hash of role and text), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    whole = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    return chats.where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).cast("long").alias("pos"), whole.alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def share_heads(rows: DataFrame, head: Column, source: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` (at most ``longest``) turns are replaced by those of conversation
    ``source``, as (conv_id, depth, turn, words), and (conv_id, length) of all, turnless ones too.  Both
    columns are expressions of conv_id.  ``rows`` should be a written table."""
    size = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    of = size.select(F.col("conv_id").alias("source"), F.least("own", F.lit(longest)).alias("there"))
    convs = size.select("conv_id", "own", head.alias("head"), source.alias("source")).join(of, "source", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    first = rows.where(F.col("pos") <= longest).select(F.col("conv_id").alias("source"), "pos", "turn", "words")
    heads = convs.where("taken > 0").select("conv_id", "source", "taken").join(first, "source").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "turn", "words")
    tails = rows.join(convs.select("conv_id", "head", "taken"), "conv_id").where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "turn", "words")
    return heads.unionByName(tails), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))


def paths(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth (from 0), node, parent, words, ends: a row for each conversation and prefix.
    turns: conv_id, depth (from 1), turn, words; members: conv_id, length."""
    root = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    w = Window.partitionBy("conv_id").orderBy("depth")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    hashed = lambda k: F.when(F.col("depth") > 0, F.xxhash64("turn", "depth", F.lit(k)).cast("decimal(20,0)")).otherwise(0)
    rows = root.unionByName(turns).withColumns({f"h{k}": F.sum(hashed(k)).over(so_far) for k in (1, 2)})
    rows = rows.withColumn("node", F.unhex(F.md5(F.concat_ws(" ", "depth", "h1", "h2"))))
    return rows.select("conv_id", "depth", "node", F.lag("node").over(w).alias("parent"), "words", F.lead("depth").over(w).isNull().alias("ends"))


def end_digests(rows: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes where paths end."""
    runs = rows.where("ends").groupBy("node", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            nodes, digests = [], []
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]})

    dealt = runs.repartition(F.col("node")).sortWithinPartitions("node", "run").select("node", "ids")
    return dealt.mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree, (n_convs - 1) * words of the last turn), ends_sha256."""
    scratch = Scratch(turns.sparkSession)
    rows = scratch.write(paths(turns, members), "paths")
    nodes = scratch.write(rows.groupBy("node", "depth").agg(F.min("conv_id").alias("owner"), F.first("parent").alias("parent"), (F.count_if("ends") == F.count(F.lit(1))).alias("childless")), "nodes")
    owners = nodes.groupBy("owner").agg(F.min("depth").alias("own_from"), F.min_by("parent", "depth").alias("node"), F.bool_or("childless").alias("leaf"))
    owners = owners.join(nodes.select("node", F.col("owner").alias("above")), "node", "left").select(F.col("owner").alias("conv_id"), "own_from", "above", "leaf")
    w = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    marked = rows.join(owners, "conv_id", "left").withColumn("owned", F.coalesce(F.col("depth") >= F.col("own_from"), F.lit(False)))
    marked = marked.withColumns({"repeated": F.sum(F.when(F.col("owned"), 0).otherwise(F.col("words"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lag("owned").over(w)})
    each = marked.groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        # the one member that owns no node above this one, if there is one, is the owner
        F.bool_or(F.col("own_from") == F.col("depth")).alias("top"),
        F.min(F.when(F.col("own_from") == F.col("depth"), F.col("above"))).alias("above"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if("next").alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum("repeated").alias("saved_tokens"),
    )
    parent = F.when(F.col("depth") > 0, F.when(F.coalesce("top", F.lit(False)), F.col("above")).otherwise(F.col("conv_id")))
    found = each.withColumn("parent_conv_id", parent).join(end_digests(rows), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


#: Conversations of twenty neighbouring ids share up to three first turns.
FAMILY, LONGEST = 20, 3


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = Scratch(spark).write(turn_rows(chats), "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST + 1)
    return prefix_trie(*share_heads(rows, head, F.col("conv_id") - F.col("conv_id") % FAMILY, LONGEST))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
OP11_SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 't': t}} ORDER BY pos) AS x FROM t GROUP BY c),
h AS (SELECT c, x, {_CRC} % {LONGEST + 1} AS h, c - c % {FAMILY} AS b FROM o),
p AS (SELECT h.c, list_concat(coalesce(list_slice(o.x, 1, h), []), list_slice(h.x, h + 1, len(h.x))) AS x FROM h LEFT JOIN o ON o.c = h.b),
n AS (SELECT c, d, list_slice(x, 1, d) AS k, len(x) = d AS ends FROM (SELECT c, x, unnest(range(len(x) + 1)) AS d FROM p)),
g AS (SELECT k, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM n GROUP BY k, d),
u AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN u ON u.k = g.k),
s AS (SELECT list_slice(k, 1, j) AS k, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS j FROM f) GROUP BY 1)
SELECT f.c AS conv_id, f.d AS depth, a.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, f.e AS ends_sha256
FROM f JOIN s ON s.k = f.k LEFT JOIN g a ON f.d > 0 AND a.k = list_slice(f.k, 1, f.d - 1)"""
