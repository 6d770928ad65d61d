"""N-gram Jaccard join: groups of documents whose shingle sets overlap by a threshold.

1. Every text becomes a set of 64-bit shingle hashes.  Equal sets are one node from here on.
2. Of each node, the first n - ceil(t * n) + 1 shingles in a common order (rare classes first, from
   a fixed-size count of all shingles) are its prefix: two sets that link share one of them.
3. Nodes that share a prefix shingle meet in its tile, in order of size.  Only sizes within the
   threshold are compared, and these by bitmaps of hashed parity bits: the count of bits in which two
   differ is at most the size of the symmetric difference, so it bounds the overlap from above.
4. Round 1 takes, for each row of a tile, the closest of the NEAR rows before it that the bound lets
   pass, and settles these few pairs by intersection of the whole sorted sets.  Round 2 takes every
   pair that the bound lets pass and whose nodes are still in different components, so no link
   between components is lost.  Of a tile, only rows outside its largest component are held against
   the rest: a group of k near copies costs about k intersections and NEAR * k bitmaps, not k * k.

A tile of over TILE_ROWS rows is dealt out as pairs of blocks, each pair a tile of its own.  Exact
copies are one node from the first aggregation on; their rows meet it in SALTS groups.

Cases: a null text, or one without words, has an empty set and links with nothing.  A null doc_id
counts only if the same set has another: then it takes part, else its component is null.  Rows are
never merged; texts whose first document is the same doc_id count as linked.  An empty table gives
no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import kernels as K
from lineweave.llm.common import Scratch, slices, split_by, utf8
from lineweave.llm.components import connected

TILE_ROWS = 20_000
#: Cells of the table that counts shingles: one byte each is all that is sent to every task.
CELLS = 1 << 20
#: Rows of a tile, in order of size, that round 1 looks back at.
NEAR = 64
#: Groups that the rows of one set meet its node in.
SALTS = 32
#: Rows that a task holds while it compares tiles.
BUFFER = 60_000
FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Join:
    """Link at 100 * intersection >= percent * union of sets of k-word shingles."""

    k: int = 5
    percent: int = 80

    def least(self, n):
        """The smallest intersection with a set of n that can link, which is also the smallest size."""
        return -(-self.percent * n // 100)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets, each ascending, and their offsets."""
    a, b, first = K.words(raw, off)
    h = K.segment_hash(K.LOWER[raw], a, b)
    w = K.window_hash(h, k)
    parts, size = [], np.zeros(len(off), np.int64)
    for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if y > x:
            own = w[x : y - k + 1] if y - x >= k else K.window_hash(h[x:y], y - x) ^ K.U64(y - x)
            own = np.sort(own)
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            parts.append(own)
            size[i + 1] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, K.U64), np.cumsum(size)


def bitmap_bits(n: int) -> int:
    """A power of two, so that wider bitmaps fold onto narrower ones."""
    return max(512, 1 << max(0, int(n) - 1).bit_length() >> 1)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles by hashed bit, as 64-bit words."""
    bits = bitmap_bits(len(own))
    odd = np.bincount((own >> K.U64(20) & K.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(K.U64)


def common_cells(docs: DataFrame, join: Join) -> np.ndarray:
    """A class for each cell of hashed shingles: 0 for most, higher for those that hold shingles of very
    many documents.  Any classes give a right join; these keep tiles small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for a, b in slices(batch, "text"):
                own, _ = shingle_sets(*utf8(batch.slice(a, b - a).column("text")), join.k)
                total += np.bincount((own & K.U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(total > 16 + 8 * total.mean())
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.uint8)
    found = rows.toArrow()  # CELLS rows at most
    out[found.column("cell").to_numpy()] = np.log2(found.column("n").to_numpy()).astype(np.uint8) + 1
    return out


def profiles(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, text_hash, n (set size), digest of the set, prefix (array of shingles), bits (bitmap)."""
    classes = docs.sparkSession.sparkContext.broadcast(common_cells(docs, join).tobytes())  # CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                flat, off = shingle_sets(*utf8(part.column("text")), join.k)
                prefix, size, digest, bits = [], [0], [], []
                for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
                    own = flat[x:y]
                    n = y - x
                    p = n - int(join.least(n)) + 1 if n else 0
                    order = np.argsort(rank[(own & K.U64(CELLS - 1)).astype(np.int64)], kind="stable")[:p]
                    prefix.append(own[order])
                    size.append(size[-1] + p)
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                    bits.append(bitmap(own).tobytes() if n else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(off)), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([np.zeros(0, K.U64), *prefix]).view(np.int64))), pa.array(bits, pa.binary())],
                    names=["doc_id", "text_hash", "n", "digest", "prefix", "bits"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, prefix array<long>, bits binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys, in tables of whole groups of about BUFFER rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER:
            table = pa.Table.from_batches(held).combine_chunks()
            last = {k: table.column(k)[-1] for k in keys}
            same = np.logical_and.reduce([table.column(k).to_numpy() == last[k].as_py() for k in keys])
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shared_prefixes(nodes: DataFrame, join: Join) -> DataFrame:
    """h, node, n of the prefix shingles that another node of a fitting size has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is told by its neighbours in order of size: one row waits for the next batch
        held, close = None, False  # the last row, and whether it has a partner before it
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches(([held] if held is not None else []) + [batch])
            h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
            fits = (h[1:] == h[:-1]) & (100 * n[:-1] >= join.percent * n[1:])
            keep = np.zeros(len(h), bool)
            keep[0] = close
            keep[1:] |= fits
            keep[:-1] |= fits
            held, close = batch.slice(batch.num_rows - 1), bool(keep[-1])
            yield from table.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).to_batches()
        if held is not None and close:
            yield held

    rows = nodes.select(F.explode("prefix").alias("h"), "node", "n").repartition("h").sortWithinPartitions("h", "n", "node")
    return rows.mapInArrow(run, "h long, node long, n long")


def undecided(shared: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of shared, with label, whose tile holds more than one component.  Other tiles have no
    pair left to compare, so their bitmaps needn't travel again."""
    rows = shared.join(label, "node", "left").select("h", "node", "n", F.coalesce("component", "node").alias("label"))
    mixed = rows.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    return rows.join(mixed, "h", "left_semi")


def tiles(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tile rows with bitmaps: h, low, high (blocks; 0, 0 in a whole tile), block, node, n, bits, and
    label if shared has it."""
    large = shared.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > TILE_ROWS).select("h", F.ceil(F.col("m") / TILE_ROWS).cast("int").alias("blocks"))
    # bitmaps come last: they are exchanged once, to their tiles
    rows = shared.join(large, "h", "left").join(nodes.select("node", "bits"), "node").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("h", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "bits", *(["label"] if "label" in shared.columns else []))


def _apart(bits: pa.ChunkedArray, n: np.ndarray):
    """A function that counts, for rows i and j, the bits in which they differ at the narrower width."""
    width = np.array([bitmap_bits(x) for x in np.unique(n)])[np.searchsorted(np.unique(n), n)]
    raw, off = utf8(bits.combine_chunks() if isinstance(bits, pa.ChunkedArray) else bits)
    flat = np.frombuffer(raw.tobytes(), K.U64)
    off = off // 8

    def count(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for w in np.unique(np.minimum(width[i], width[j])).tolist():
            at = np.flatnonzero(np.minimum(width[i], width[j]) == w)
            for part in np.array_split(at, max(1, len(at) * w // (1 << 26))):
                x, y = (_narrow(flat, off, width, r[part], w) for r in (i, j))
                out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out

    return count


def _narrow(flat: np.ndarray, off: np.ndarray, width: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((len(rows), w // 64), K.U64)
    step = np.arange(w // 64)
    for times in np.unique(width[rows] // w).tolist():
        at = np.flatnonzero(width[rows] // w == times)
        for t in range(times):
            out[at] ^= flat[(off[rows[at]] + t * (w // 64))[:, None] + step]
    return out


def _near(h, low, high, block, n, label, join: Join) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a tile, at most NEAR places apart in order of size, whose sizes fit."""
    rows = np.arange(1, len(h))
    for shift in range(1, NEAR + 1):
        rows = rows[rows >= shift]
        near = rows - shift
        rows = rows[(h[near] == h[rows]) & (low[near] == low[rows]) & (high[near] == high[rows]) & (100 * n[near] >= join.percent * n[rows])]
        if not len(rows):
            return
        now = rows[(label[rows] != label[rows - shift]) & ((low[rows] == high[rows]) | (block[rows] != block[rows - shift]))]
        yield now, now - shift


def _pairs(h, low, high, block, n, label, join: Join) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a tile whose labels differ and whose sizes fit.  Where nearly all rows of a
    large tile are of one component, the few others are held against the rest, one by one; all other
    tiles are gone through together, place by place."""
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    cut = np.append(np.flatnonzero(fresh), len(h))
    tile, m = np.cumsum(fresh) - 1, np.diff(cut)
    order = np.lexsort((label, tile))
    group = np.flatnonzero(np.concatenate(([True], (label[order][1:] != label[order][:-1]) | fresh[1:])))
    most = np.zeros(len(m), np.int64)
    np.maximum.at(most, tile[order[group]], np.diff(np.append(group, len(h))))
    few = (m > 2 * NEAR) & (8 * (m - most) < m) & (most < m)
    rows = np.flatnonzero((most < m)[tile] & ~few[tile])
    for shift in range(1, int(m.max())):
        rows = rows[rows - shift >= cut[tile[rows]]]
        rows = rows[100 * n[rows - shift] >= join.percent * n[rows]]
        if not len(rows):
            break
        now = rows[(label[rows] != label[rows - shift]) & ((low[rows] == high[rows]) | (block[rows] != block[rows - shift]))]
        if len(now):
            yield now, now - shift
    for t in np.flatnonzero(few).tolist():
        a, b = int(cut[t]), int(cut[t + 1])
        names, code, many = np.unique(label[a:b], return_inverse=True, return_counts=True)
        largest, size = int(many.argmax()), n[a:b]
        for i in np.flatnonzero(code != largest).tolist():
            x = int(np.searchsorted(100 * size, join.percent * size[i]))
            y = int(np.searchsorted(join.percent * size, 100 * size[i], side="right"))
            # of two such rows, the later one is held against the earlier
            to = a + x + np.flatnonzero((code[x:y] != code[i]) & ((code[x:y] == largest) | (np.arange(x, y) < i)))
            if low[a] != high[a]:
                to = to[block[to] != block[a + i]]
            if len(to):
                yield np.full(len(to), a + i), to


def compare(tiled: DataFrame, join: Join, across: bool) -> DataFrame:
    """Pairs a, b (and apart, the differing bits) that the bound lets pass: of each row the closest
    earlier and the closest later one of those near it, or, across, all whose labels differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["h", "low", "high"]):
            h, low, high, block, node, n = (table.column(c).to_numpy() for c in ("h", "low", "high", "block", "node", "n"))
            label = table.column("label").to_numpy() if across else node
            apart = _apart(table.column("bits"), n)
            best, which = np.full((2, len(h)), FAR), np.zeros((2, len(h)), np.int64)
            pairs = []
            for now, other in _pairs(h, low, high, block, n, label, join) if across else _near(h, low, high, block, n, label, join):
                x = apart(now, other)
                # intersection >= percent / 100 * union bounds the symmetric difference
                fits = (100 + join.percent) * x <= (100 - join.percent) * (n[now] + n[other])
                now, other, x = now[fits], other[fits], x[fits]
                if across:
                    pairs.append(np.stack([np.minimum(node[now], node[other]), np.maximum(node[now], node[other]), x], axis=1))
                    if sum(map(len, pairs)) > 100_000:
                        pairs = [np.unique(np.concatenate(pairs), axis=0)]
                else:
                    for side, own, to in ((0, now, other), (1, other, now)):
                        better = x < best[side, own]
                        best[side, own[better]], which[side, own[better]] = x[better], to[better]
            if not across:
                for side in (0, 1):
                    now = np.flatnonzero(best[side] < FAR)
                    other = node[which[side, now]]
                    pairs.append(np.stack([np.minimum(node[now], other), np.maximum(node[now], other), best[side, now]], axis=1))
            if pairs:
                found = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["a", "b", "apart"])

    dealt = tiled.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high", "n", "node")
    return dealt.mapInArrow(run, "a long, b long, apart long").distinct()


def whole_sets(ends: DataFrame, nodes: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """node and shingles (its sorted set) of the nodes in ends.  Texts are dealt by doc_id at every
    size: the nodes that take part grow with the documents, and aren't for broadcasting.  Texts that a
    table of bits shows not to take part stay where they are.  A node can come twice where Spark splits a skewed join, which gives the same link twice."""
    needed = nodes.select("node", "digest").join(ends, "node").withColumnRenamed("node", "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # repeated rows of a document follow each other
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                flat, off = shingle_sets(*utf8(part.column("text")), join.k)
                nodes_, own, at = part.column("node").to_pylist(), [], []
                for i, (x, y, d) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), part.column("digest").to_pylist())):
                    raw = flat[x:y].tobytes()
                    if (nodes_[i], d) != last and hashlib.blake2b(raw, digest_size=16).digest() == d:
                        last = nodes_[i], d
                        own.append(raw)
                        at.append(nodes_[i])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own, pa.binary())], names=["node", "shingles"])

    texts, _ = split_by(docs.select("doc_id", "text"), F.xxhash64(F.col("doc_id").cast("long")), ends, F.xxhash64("node"))
    texts = texts.join(needed.hint("merge"), "doc_id").select(F.col("doc_id").alias("node"), "digest", "text")
    return texts.mapInArrow(sets, "node long, shingles binary")


def linked(pairs: DataFrame, whole: DataFrame, join: Join) -> DataFrame:
    """The pairs that link, by intersection of their whole sorted sets."""
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), K.U64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= join.percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(meet, "a long, b long")


def meet_first(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows with the columns of first, whose digest many rows may have: in SALTS groups."""
    salted = first.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted.hint("merge"), ["digest", "salt"], "left").drop("salt")  # it grows with the documents


def group_documents(docs: DataFrame, join: Join = Join(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text).  The result reads the tables ``profiles``,
    ``copies`` and ``components`` of scratch; the others are gone when it is returned."""
    scratch = scratch or Scratch(docs.sparkSession)
    others = list(scratch.names)
    # row is fixed where the table is written
    profile = scratch.write(profiles(docs, join).withColumn("row", F.monotonically_increasing_id()), "profiles")
    # a set that many documents have is one row after a partial aggregation
    known = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id"), F.col("row")))
    copies = profile.where("digest IS NOT NULL").groupBy("digest").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    copies = scratch.write(copies.select("digest", F.col("first.doc_id").alias("node"), F.col("first.row").alias("first_row")), "copies")
    # the wide rows of sets that only one document has aren't exchanged
    copied, alone = split_by(profile.where("digest IS NOT NULL AND doc_id IS NOT NULL"), F.xxhash64("digest"), copies, F.xxhash64("digest"))
    node = [F.col("doc_id").alias("node"), "n", "digest", "prefix", "bits"]
    unique = meet_first(copied, copies).where("first_row IS NULL OR first_row = row")
    nodes = scratch.write(unique.select(*node).unionByName(alone.select(*node)), "nodes")
    shared = scratch.write(shared_prefixes(nodes, join), "shared")
    closest = scratch.write(compare(tiles(shared, nodes), join, across=False), "closest")
    ends = closest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = scratch.write(whole_sets(ends, nodes, docs, join), "sets")
    one = closest.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    links = scratch.write(linked(one, whole, join), "links")
    label = connected(links, "a", "b", scratch)
    left = scratch.write(undecided(shared, label), "undecided")
    scratch.keep(*others, "profiles", "copies", "nodes", "links", "undecided", "sets")
    more = scratch.write(compare(tiles(left, nodes), join, across=True).select("a", "b"), "more")
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = whole.unionByName(whole_sets(ends.join(whole, "node", "left_anti"), nodes, docs, join))
    links = links.unionByName(linked(more, whole, join))
    label = scratch.write(connected(links, "a", "b", scratch), "components")
    scratch.keep(*others, "profiles", "copies", "components")
    # rows of a set that several have go by it, the others are nodes themselves
    several = copies.join(label, "node", "left").select("digest", F.coalesce("component", "node").alias("of_set"), F.lit(True).alias("is_copy"))
    rows = meet_first(profile.select("doc_id", "text_hash", "n", "digest", "row"), several).join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).when(F.col("is_copy"), F.col("of_set")).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash")


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return group_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Join(k=4, percent=85)).drop("text_hash")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d WHERE r.c < e.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY ALL
"""
