"""Substring dedup by a sparse suffix array: bytes inside a string of ``size`` bytes that also starts
in a document with a smaller doc_id go.

Anchors stand in for suffixes: of each window of ``size`` bytes, the K-byte strings with the least
hash.  Two equal windows have the same anchors at the same places, so suffixes at anchors, with the
bytes before them, are enough; there is one for about 18 bytes.

1. A document of which a smaller one has the whole text is settled at once (by its md5).  Of the others,
   anchors whose hash just one of them has are dropped.  Tasks send each hash once, and hear back.
2. The other anchors become contexts: the suffix from the anchor and the prefix that ends there,
   both as far as a window can reach.  Of equal contexts in a task, all but the smallest document's
   are settled on the spot, so a passage that very many documents share travels once for each task.
3. Sampled splitters of the leading bytes part contexts into ranges, and each range, where it is
   large, into buckets by the anchor's hash.  All suffixes with the same anchor are in one bucket, so
   what has to be compared never lies across a boundary.  A task holds one bucket at a time, and the
   number of buckets follows from the bytes of all texts.  An anchor that would fill a bucket by
   itself goes window by window instead, dealt by two 64-bit hashes of the window.
4. A bucket sorts suffixes and reversed prefixes by multikey quicksort on 8-byte keys.  Runs in the
   two arrays of longest common prefixes say which contexts share a whole window, for each place of
   the anchor in it; the smallest doc_id of each such group is what its documents are held against.
5. Marked windows come together by document, and the bytes they cover are removed.

Equal contexts in a task are told by a 64-bit hash of their 86 bytes; all else is compared by bytes,
but for the windows of hot anchors.

Cases: a null text is empty.  A document with a null doc_id keeps all and marks nothing.  Rows with
equal doc_ids never mark each other.  Texts under ``size`` bytes keep all.  An empty table gives no
rows.  Extra columns are ignored, or kept by ``remove_repeats``.
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
from lineweave.llm.common import slices, utf8

K_BYTES = 16
ZSTD = pa.Codec("zstd", compression_level=3)
#: Groups that the rows of one text meet its first document in.
SALTS = 32
#: Documents whose anchors the splitters are taken from.
SAMPLE_DOCS = 2000
#: Bytes of text in one slice, of those that are hashed at once, and of those asked about together.
STEP, CACHED, ASKED = 1 << 20, 1 << 16, 3 << 20
#: Contexts that a task holds at once, and those of hot anchors of which it has all windows at once.
HELD, HOT_STEP = 150_000, 4000
#: Bytes of text for each bucket, sampled anchors for each range, and the times that a hot anchor is sampled at least.
BUCKET_BYTES, SAMPLED, HOT_LEAST = 2 << 20, 64, 64


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte string, by doubling: log k passes over the bytes."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, K.U64)
    power, h, done = K.TABLE[raw], None, 0
    length, bit = 1, 1
    while True:
        if k & bit:
            h = power.copy() if h is None else h[: len(power) - done] * K.U64(pow(int(K.BASE), length, 1 << 64)) + power[done : done + len(h)][: len(power) - done]
            done += length
        if done == k:
            break
        power = power[: len(power) - length] * K.U64(pow(int(K.BASE), length, 1 << 64)) + power[length:]
        length, bit = 2 * length, bit * 2
    h = h[:n] ^ (h[:n] >> K.U64(29))
    h *= K.U64(0x94D049BB133111EB)
    h ^= h >> K.U64(32)
    return h


def _slide(x: np.ndarray, span: int, op: np.ufunc) -> np.ndarray:
    """op over each run of span values, by doubling."""
    width = 1
    while 2 * width <= span:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - span + width], x[span - width :]) if width < span else x


def anchors(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in raw, text and hash of the anchors: of each window of size bytes in a text, all K-byte
    strings with the least hash.  Texts are looked at a few at a time, which stay in the cache."""
    span = size - K_BYTES + 1  # strings in a window
    found, first, n = [], 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + CACHED, side="right")) - 1)
        base, end = int(off[first]), int(off[last])
        h = rolling(raw[base:end], K_BYTES)
        if len(h) >= span:
            least = _slide(h, span, np.minimum)
            for e in (off[first + 1 : last] - base).tolist():  # windows across the end of a text don't count
                least[max(0, e - size + 1) : e] = 0
            most = np.zeros(len(least) + 2 * (span - 1), K.U64)
            most[span - 1 : span - 1 + len(least)] = least
            at = np.flatnonzero(_slide(most, span, np.maximum) == h)
            at = at[h[at] != 0]
            found.append((at + base, h[at]))
        first = last
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, K.U64)
    at, h = (np.concatenate(x) for x in zip(*found))
    return at, np.searchsorted(off, at, side="right") - 1, h


def multikey_sort(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each row with the one before it in
    that order.  Rows are parted by their first 8-byte key, then only equal ones by the next."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    keys = padded.view(">u8").astype(K.U64)
    order = np.argsort(keys[:, 0], kind="stable") if n else np.zeros(0, np.int64)
    for level in range(1, keys.shape[1]):
        prev = keys[order][:, :level]
        fresh = np.concatenate(([True], (prev[1:] != prev[:-1]).any(axis=1))) if n else np.zeros(0, bool)
        part = np.cumsum(fresh) - 1
        tied = np.flatnonzero(np.bincount(part)[part] > 1) if n else part
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((keys[rows, level], part[tied]))]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = strings[order[1:]] != strings[order[:-1]]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def repeated_windows(left: np.ndarray, suffix: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For contexts (reversed bytes before the anchor, bytes from it, how many of both are real,
    doc_id): bit i is set if the window with the anchor at place i is in a smaller document's context."""
    by_left, common_left = multikey_sort(left)
    by_suffix, common_suffix = multikey_sort(suffix)
    n = len(doc)
    place_left = np.empty(n, np.int64)
    place_left[by_left] = np.arange(n)
    place_left = place_left[by_suffix]  # from here on, in the order of suffixes: groups by suffix are runs
    doc, n_left, n_right = doc[by_suffix], n_left[by_suffix], n_right[by_suffix]
    mask = np.zeros(n, np.int64)
    for o in range(size - K_BYTES + 1):
        at = np.flatnonzero((n_left >= o) & (n_right >= size - o))
        if not len(at):
            continue
        key = np.cumsum(common_suffix < size - o)[at] * (n + 1)
        if o:
            key += np.cumsum(common_left < o)[place_left[at]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        own = doc[at[order]]
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(order))))
        mask[at[order]] |= (least < own).astype(np.int64) << o
    out = np.empty(n, np.int64)
    out[by_suffix] = mask
    return out


def real_windows(n_left: np.ndarray, n_right: np.ndarray, size: int) -> np.ndarray:
    """Bit i is set if the window with the anchor at place i lies in the text."""
    o = np.arange(size - K_BYTES + 1)
    return (((n_left[:, None] >= o) & (n_right[:, None] >= size - o)).astype(np.int64) << o).sum(axis=1)


def _steps(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    for a, b in slices(batch, "text", limit):
        yield batch.slice(a, b - a)


def _contexts(raw: np.ndarray, off: np.ndarray, at: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Of each anchor: suffix, reversed prefix, and how many bytes of both are real, as one row."""
    reach = size - K_BYTES
    n_left = np.minimum(at - off[text], reach)
    n_right = np.minimum(off[text + 1] - at, size)
    j = np.arange(size)
    out = np.zeros((len(at), size + reach + 2), np.uint8)
    out[:, :size] = np.where(j < n_right[:, None], raw[np.minimum(at[:, None] + j, len(raw) - 1)], 0)
    j = np.arange(1, reach + 1)
    out[:, size : size + reach] = np.where(j <= n_left[:, None], raw[np.maximum(at[:, None] - j, 0)], 0)
    out[:, -2], out[:, -1] = n_left, n_right
    return out


def _squeeze(*columns: np.ndarray) -> bytes:
    return ZSTD.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), asbytes=True)


def _expand(raw: bytes, n: int, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Columns of n rows, each of (type, values in a row)."""
    total = sum(np.dtype(t).itemsize * k for t, k in kinds) * n
    data, at, out = pa.decompress(raw, total, codec="zstd", asbytes=True), 0, []
    for t, k in kinds:
        out.append(np.frombuffer(data, t, n * k, at).reshape(n, k) if k > 1 else np.frombuffer(data, t, n, at))
        at += np.dtype(t).itemsize * k * n
    return out


def _hashed(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each row of a byte matrix, by 8-byte columns."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    out = np.full(n, K.U64(seed) + K.BASE)
    for column in padded.view("<u8").T:
        out = K.mix(out * K.BASE + column)
    return out


def _six_bytes(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8")[:, 0]


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns that are sorted together."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.zeros(n, bool)
    fresh[0] = True
    for k in sorted_keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def _dealt(bucket: np.ndarray, kind: int, base: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns cut up by bucket: a row of SENT for each bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = _starts(bucket[order])
    ends = np.append(cut[1:], len(order))
    blobs = [_squeeze(*(c[order[x:y]] for c in columns)) for x, y in zip(cut.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[cut]].astype(np.int64)), pa.array([kind] * len(cut), pa.int32()), pa.array([base] * len(cut), pa.int64()), pa.array((ends - cut).astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "base", "n", "rows"])


#: What tasks send each other: of a bucket, n rows of the given kind, compressed.
SENT = "bucket long, kind int, base long, n int, rows binary"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of SENT of one bucket after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _gather(sent: DataFrame, parts: int) -> DataFrame:
    """Buckets whole in a task, one after the other, so that a task holds one at a time."""
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _told(*columns: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for x in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[x : x + (1 << 16)]) for c in columns], names=names)


def _shared_anchors(texts: DataFrame, size: int, parts: int, buckets: int) -> DataFrame:
    """key (a doc_id), hashes (array): the anchors of a document that another document has too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch, ASKED):
                part = part.filter(part.column("doc_id").is_valid())
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                _, text, h = anchors(*utf8(part.column("text")), size)
                h, doc = h >> K.U64(16), ids[text]
                order = np.lexsort((doc, h))
                fresh = _starts(h[order], doc[order])
                h, doc = h[order][fresh], doc[order][fresh]
                if not len(h):
                    continue
                first = np.zeros(len(h), bool)
                first[_starts(h)] = True
                many = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1
                # one for each hash is asked about; what two documents here share needs no answer
                bucket = np.where(first, h % K.U64(buckets), K.mix(doc.astype(K.U64)) % K.U64(buckets)).astype(np.int64)
                kind = np.where(first, np.where(many, 1, 0), 2).astype(np.uint8)
                base = int(doc.min())
                wide = int(doc.max()) - base >= 1 << 32
                yield _dealt(bucket, int(wide), 0 if wide else base, _six_bytes(h), doc if wide else (doc - base).astype("<u4"), kind)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            asked = []
            for row in rows:
                six, doc, kind = _expand(row["rows"], row["n"], ("u1", 6), ("i8" if row["kind"] else "u4", 1), ("u1", 1))
                asked.append((_from_six(six), doc.astype(np.int64) + row["base"], kind))
            h, doc, kind = (np.concatenate(x) for x in zip(*asked))
            ask = kind < 2
            order = np.flatnonzero(ask)[np.argsort(h[ask], kind="stable")]
            first = _starts(h[order])
            tell = kind > 0
            if len(first):
                group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
                own = doc[order]
                shared = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | (np.maximum.reduceat(kind[order], first) > 0)
                tell[order] |= shared[group]
            # 32 bits of it tell it from the other anchors of a document; a wrong one makes a context too many
            yield from _told(doc[tell], (h[tell] >> K.U64(16)).astype(np.uint32).view(np.int32), names=["doc_id", "h"])

    sent = texts.where("NOT copied").mapInArrow(send, SENT)
    told = _gather(sent, parts).mapInArrow(answer, "doc_id long, h int")
    return told.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("h").alias("hashes"))


def _places(shared: DataFrame, size: int, deal: Deal, parts: int) -> DataFrame:
    """Marked windows by (doc_id, tag, place of the anchor, mask of its places in the window)."""
    reach = size - K_BYTES
    width = size + reach + 2
    names = ["doc_id", "tag", "place", "mask"]

    def mine(doc: np.ndarray) -> np.ndarray:
        return K.mix(doc.astype(K.U64)) % K.U64(deal.buckets)

    def windows(rows, doc, tag, place) -> Iterator[pa.RecordBatch]:
        """Contexts of hot anchors, as hashes of each window: dealt by these, no anchor is in one task."""
        at, offset = np.nonzero((rows[:, -2, None] >= np.arange(reach + 1)) & (rows[:, -1, None] >= size - np.arange(reach + 1)))
        whole = np.concatenate((rows[:, size : size + reach][:, ::-1], rows[:, :size]), axis=1)  # bytes in their order
        own = np.lib.stride_tricks.sliding_window_view(whole, size, axis=1)[at, reach - offset]
        one, two = _hashed(own), _hashed(own, 1)
        order = np.lexsort((doc[at], two, one))
        at, offset, one, two = at[order], offset[order], one[order], two[order]
        first = _starts(one, two)
        least = np.repeat(doc[at[first]], np.diff(np.append(first, len(at))))
        settled = doc[at] > least
        yield from marks(doc[at[settled]], tag[at[settled]], place[at[settled]], np.int64(1) << offset[settled])
        ask = ~settled
        at = at[ask]
        yield _dealt((one[ask] % K.U64(deal.buckets)).astype(np.int64), 2, 0, one[ask], two[ask], doc[at], tag[at], place[at], offset[ask].astype(np.uint8))

    def marks(doc, tag, place, mask) -> Iterator[pa.RecordBatch]:
        if len(doc):
            yield _dealt(mine(doc).astype(np.int64), 1, 0, doc, tag, place, mask)

    def settle(rows, h, doc, tag, place) -> Iterator[pa.RecordBatch]:
        same = _hashed(rows)
        order = np.lexsort((doc, same))
        first = _starts(same[order])
        least = np.empty(len(doc), np.int64)
        least[order] = np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
        here = np.flatnonzero(doc > least)  # a smaller document of this task has the whole context
        yield from marks(doc[here], tag[here], place[here], real_windows(rows[here, -2].astype(np.int64), rows[here, -1].astype(np.int64), size))
        ask = np.flatnonzero(doc == least)
        hot = np.isin(h[ask], deal.hot)
        for x in np.array_split(ask[hot], -(-int(hot.sum()) // HOT_STEP)) if hot.any() else []:
            yield from windows(rows[x], doc[x], tag[x], place[x])
        ask = ask[~hot]
        lead = np.ascontiguousarray(rows[ask, :K_BYTES]).view(f"S{K_BYTES}")[:, 0]
        order = np.argsort(lead, kind="stable")  # alike suffixes side by side, which compresses
        ask, lead = ask[order], lead[order]
        bucket = np.searchsorted(deal.splitters, lead, side="right") * deal.fine + (h[ask] % K.U64(deal.fine)).astype(np.int64)
        if len(ask):
            yield _dealt(bucket, 0, 0, rows[ask], doc[ask], tag[ask], place[ask])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in _steps(batch, STEP):
                part = part.filter(part.column("doc_id").is_valid())
                raw, off = utf8(part.column("text"))
                at, text, h = anchors(raw, off, size)
                h >>= K.U64(16)
                wanted, many = part.column("hashes").flatten().to_numpy().view(np.uint32).astype(K.U64), part.column("hashes").value_lengths().to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(len(part)), many)
                keep = np.isin(h >> K.U64(16) ^ K.mix(text.astype(K.U64) + K.U64(1)), wanted ^ K.mix(own.astype(K.U64) + K.U64(1)))
                at, text, h = at[keep], text[keep], h[keep]
                if len(at):
                    held.append((_contexts(raw, off, at, text, size), h, part.column("doc_id").to_numpy(zero_copy_only=False)[text], part.column("tag").to_numpy()[text], at - off[text]))
                    n += len(at)
                if n >= HELD:
                    yield from settle(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield from settle(*(np.concatenate(x) for x in zip(*held)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sent_rows in _by_bucket(batches):
            asked, hot = [], []
            for row in sent_rows:
                if row["kind"] == 1:
                    yield from _told(*_expand(row["rows"], row["n"], ("i8", 1), ("i8", 1), ("i8", 1), ("i8", 1)), names=names)
                elif row["kind"] == 2:
                    hot.append(_expand(row["rows"], row["n"], ("u8", 1), ("u8", 1), ("i8", 1), ("i8", 1), ("i8", 1), ("u1", 1)))
                else:
                    asked.append(_expand(row["rows"], row["n"], ("u1", width), ("i8", 1), ("i8", 1), ("i8", 1)))
            if hot:
                one, two, doc, tag, place, offset = (np.concatenate(x) for x in zip(*hot))
                order = np.lexsort((doc, two, one))
                first = _starts(one[order], two[order])
                hit = order[doc[order] > np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))]
                yield from _told(doc[hit], tag[hit], place[hit], np.int64(1) << offset[hit].astype(np.int64), names=names)
            if asked:
                rows, doc, tag, place = (np.concatenate(x) for x in zip(*asked))
                del asked
                mask = repeated_windows(rows[:, size : size + reach], rows[:, :size], rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64), doc, size)
                hit = np.flatnonzero(mask)
                yield from _told(doc[hit], tag[hit], place[hit], mask[hit], names=names)

    return _gather(shared.mapInArrow(send, SENT), parts).mapInArrow(compare, "doc_id long, tag long, place long, mask long")


@dataclass(frozen=True)
class Deal:
    """How contexts are dealt.  splitters: leading bytes that part suffixes into ranges; each range is
    dealt on to fine buckets by its anchors' hashes.  hot: hashes of anchors that would fill a bucket."""

    splitters: np.ndarray
    fine: int
    hot: np.ndarray

    @property
    def buckets(self) -> int:
        return (len(self.splitters) + 1) * self.fine


def choose_deal(docs: DataFrame, size: int, bucket_bytes: int, hot_least: int) -> Deal:
    """A bucket for about bucket_bytes of text, from the anchors of about SAMPLE_DOCS documents.  They
    decide where a suffix is sorted, never what is found."""
    total, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // SAMPLE_DOCS))) == 0).select(F.substring(F.coalesce("text", F.lit("")), 1, 4000).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch, STEP):
                raw, off = utf8(part.column("text"))
                at, _, h = anchors(raw, off, size)
                if len(at):
                    yield pa.RecordBatch.from_pydict({"lead": [np.ascontiguousarray(raw[at[:, None] + np.arange(K_BYTES)]).tobytes()], "h": [(h >> K.U64(16)).tobytes()]})

    found = some.mapInArrow(run, "lead binary, h binary").collect()  # SAMPLE_DOCS texts of at most 4000 characters
    wanted = max(1, n_bytes // bucket_bytes)
    if not found:
        return Deal(np.zeros(0, f"S{K_BYTES}"), wanted, np.zeros(0, K.U64))
    lead = np.sort(np.concatenate([np.frombuffer(r.lead, f"S{K_BYTES}") for r in found]))
    each, many = np.unique(np.concatenate([np.frombuffer(r.h, K.U64) for r in found]), return_counts=True)
    ranges = max(1, min(wanted, len(lead) // SAMPLED))
    splitters = np.unique(lead[np.linspace(0, len(lead) - 1, ranges + 1).astype(np.int64)[1:-1]])
    return Deal(splitters, max(1, -(-wanted // (len(splitters) + 1))), each[(many >= hot_least) & (many * wanted > 2 * many.sum())])


def exact_copies(docs: DataFrame) -> DataFrame:
    """key (doc_id) of the documents whose whole text a smaller doc_id has too.  A text is one row after
    the first aggregation, and its documents meet it in SALTS groups."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = first.select("digest", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(first, ["digest", "salt"]).where("doc_id > first").select(F.col("doc_id").alias("key"))


def repeats(docs: DataFrame, size: int = 50, bucket_bytes: int = BUCKET_BYTES, hot_least: int = HOT_LEAST) -> DataFrame:
    """The rows of docs with places (array of struct(place, mask)): the window of size bytes that starts
    at byte place - i repeats a smaller document's, for each bit i of mask.  And copied: a smaller
    document has the whole text, so all its windows repeat, and none are listed."""
    if not 2 * K_BYTES <= size <= K_BYTES + 62:
        raise ValueError(f"size is {size}; anchors of {K_BYTES} bytes serve {2 * K_BYTES} to {K_BYTES + 62}")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = choose_deal(docs, size, bucket_bytes, hot_least)
    # one exchange of the texts, with all columns, which every step below reads again; its key is never
    # null, so that no filter on it makes the exchanges differ.  Rows without a doc_id go by their text
    key = F.coalesce("doc_id", F.xxhash64("text"))
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), F.lit(1).alias("n"), F.lit(False).alias("copied"))
    marks = known.unionByName(exact_copies(docs).withColumn("n", F.lit(0)).withColumn("copied", F.lit(True)))
    odd = marks.groupBy("key").agg(F.sum("n").alias("n"), F.max("copied").alias("copied")).where("n > 1 OR copied")
    texts = docs.withColumn("key", key).repartition(parts, "key").join(odd, "key", "left")
    tag = F.when(F.col("n") > 1, F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    copied = F.coalesce(F.col("copied") & (F.col("n") == 1) & F.col("doc_id").isNotNull(), F.lit(False))
    texts = texts.withColumns({"tag": tag, "copied": copied}).drop("n")
    shared = texts.where("NOT copied").join(_shared_anchors(texts, size, parts, deal.buckets), "key")
    places = _places(shared, size, deal, parts).groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("tag", "place", "mask")).alias("places"))
    own = F.when(F.col("doc_id").isNotNull(), F.transform(F.filter("places", lambda p: p["tag"] == F.col("tag")), lambda p: F.struct(p["place"].alias("place"), p["mask"].alias("mask"))))
    return texts.join(places, "key", "left").withColumn("places", own).drop("tag", "key")


def covered(n: int, place: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """Which of n bytes lie in a marked window."""
    i = np.arange(size - K_BYTES + 1)
    at = (place[:, None] - i)[(mask[:, None] >> i) & 1 == 1]
    return np.cumsum(np.bincount(at, minlength=n + 1)[:n] - np.bincount(at + size, minlength=n + 1)[:n]) > 0


def _cut(text: pa.Array, places: pa.Array, copied: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The bytes of each text, and which of them go (None: none)."""
    inner = places.flatten()
    place, mask = (np.asarray(inner.field(i)).astype(np.int64) for i in (0, 1))
    n = np.asarray(places.value_lengths().fill_null(0))
    end = np.cumsum(n)
    raw, off = utf8(text)
    whole = copied.to_numpy(zero_copy_only=False)
    for i in range(len(text)):
        own = raw[off[i] : off[i + 1]]
        if whole[i]:
            yield own, np.ones(len(own), bool) if len(own) >= size else None
            continue
        yield own, covered(len(own), place[end[i] - n[i] : end[i]], mask[end[i] - n[i] : end[i]], size) if n[i] else None


def measure_repeats(docs: DataFrame, size: int = 50, **dealing: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch, STEP):
                out = []
                for own, gone in _cut(part.column("text"), part.column("places"), part.column("copied"), size):
                    kept = own if gone is None else own[~gone]
                    spans = 0 if gone is None else int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
                    out.append((len(own), len(own) - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(docs.select("doc_id", "text"), size, **dealing).select("doc_id", "text", "places", "copied").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """The documents with the bytes that are left; a character that is cut in two goes.  n_chars, if
    there is one, is counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(len(names))] + ["places", "copied"])
            for a, b in slices(batch, f"c{names.index('text')}", STEP):
                part = batch.slice(a, b - a)
                texts = part.column(names.index("text"))
                old = texts.to_pylist()
                text = [old[i] if gone is None else own[~gone].tobytes().decode("utf-8", "ignore") for i, (own, gone) in enumerate(_cut(texts, part.column(len(names)), part.column(len(names) + 1), size))]
                new = {"text": pa.array(text, pa.string())}
                if "n_chars" in names:
                    new["n_chars"] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(part.column(names.index("n_chars")).type)
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for i, c in enumerate(names)], names=names)

    # the operator's own columns get out of the way of the caller's
    renamed = docs.toDF(*(n if n in ("doc_id", "text") else f"of_caller_{i}" for i, n in enumerate(names)))
    return repeats(renamed, size).select(*renamed.columns, "places", "copied").toDF(*(f"c{i}" for i in range(len(names))), "places", "copied").mapInArrow(run, docs.schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return measure_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
