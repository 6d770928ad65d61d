"""Two curves shifted against each other: the best offset, how sure it is, and what follows for a link.

A pair is a row with two arrays of any lengths.  Nulls in a curve count as 0; a null, empty or constant curve
fits at offset 0 with score 0; of equal scores the smallest offset wins; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.operators.arrays import frames
from lineweave.operators.verdicts import link_verdict

#: Values of padded curves that a task transforms at a time, but for one pair's own.
CELLS = 1 << 20


def padded(curves: list[np.ndarray], size: int) -> np.ndarray:
    """Curves less their means, of length one each, with zeros up to size; constant ones are all zeros."""
    out = np.zeros((len(curves), size))
    for row, x in zip(out, curves):
        if len(x):
            y = x - x.mean()
            norm = np.linalg.norm(y)
            if norm > 1e-9:
                row[: len(x)] = y / norm
    return out


def best_lags(a: list[np.ndarray], b: list[np.ndarray], most: int, near: int) -> list[tuple[int, float, float]]:
    """For each pair the offset of at most ``most`` at which a, moved back by it, is most like b, its score
    (correlation, 0 at least), and the best score at offsets further than ``near`` from it."""
    size = 1 << int(max(max(map(len, a)) + max(map(len, b)), 2 * most + 1) - 1).bit_length()
    score = np.fft.irfft(np.fft.rfft(padded(a, size)) * np.conj(np.fft.rfft(padded(b, size))), size)
    lags = np.arange(-most, most + 1)
    score = np.round(score[:, lags % size], 12)  # equal but for rounding is equal
    for k, (x, y) in enumerate(zip(a, b)):
        score[k, (lags >= len(x)) | (lags <= -len(y))] = -np.inf  # nothing lies on anything
    at = score.argmax(axis=1)
    peak = score[np.arange(len(a)), at]
    rest = np.where(np.abs(lags[None, :] - lags[at][:, None]) <= near, -np.inf, score).max(axis=1)
    flat = ~(peak > 0)
    return list(zip(np.where(flat & ~np.isfinite(peak), 0, lags[at]).tolist(), np.where(flat, 0.0, peak).tolist(), np.where(flat, 0.0, np.maximum(rest, 0.0)).tolist()))


def best_offsets(pairs: DataFrame, a: str, b: str, most: int, near: int = 1) -> DataFrame:
    """The other columns of the pairs with offset, score, second."""
    names = [c for c in pairs.columns if c not in (a, b)]

    def curves(column: pa.Array) -> list[np.ndarray]:
        return [np.array([0.0 if v is None else v for v in x or ()]) for x in column.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = curves(batch.column(a)), curves(batch.column(b))
            order = sorted(range(len(x)), key=lambda k: len(x[k]) + len(y[k]))
            found: list = [(0, 0.0, 0.0)] * len(x)
            while order:
                some = [order.pop()]
                size = len(x[some[0]]) + len(y[some[0]]) + 2 * most + 1
                while order and size * (len(some) + 1) <= CELLS:
                    some.append(order.pop())
                good = [k for k in some if len(x[k]) and len(y[k])]
                if good:
                    for k, r in zip(good, best_lags([x[k] for k in good], [y[k] for k in good], most, near)):
                        found[k] = r if r[1] > 0 or x[k].std() > 1e-9 and y[k].std() > 1e-9 else (0, 0.0, 0.0)
            out = batch.select(names)
            for name, at, kind in (("offset", 0, pa.int64()), ("score", 1, pa.float64()), ("second", 2, pa.float64())):
                out = out.append_column(name, pa.array([r[at] for r in found], kind))
            yield out

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*names).dtypes)
    return pairs.mapInArrow(run, f"{schema}, offset long, score double, second double")


def validated_links(pairs: DataFrame, a: str, b: str, most: int, near: int, least: float = 0.55, margin: float = 0.08) -> DataFrame:
    """The pairs with offset, score, margin and verdict: linked if the score is high and stands out."""
    found = best_offsets(pairs, a, b, most, near).withColumn("verdict", link_verdict(F.col("score"), F.col("second"), least, margin))
    return found.withColumn("margin", F.col("score") - F.col("second")).drop("second")


MOST, NEAR = 12, 2


def _pairs(spark, d) -> DataFrame:
    """Each curve against the next one: of a third as it is, of a third shifted and noisy, of a third laid over
    itself; both cut to different lengths."""
    f = frames(spark, d).select("vec_id", F.transform("x", lambda v: v.cast("double")).alias("x"))
    both = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    k, shift = F.col("vec_id") % 3, (F.col("vec_id") % 7).cast("int")
    noisy = F.zip_with(F.slice("x", shift + 1, 64 - shift), "y", lambda a, b: F.when(a.isNotNull(), a + F.coalesce(b, F.lit(0.0)) / 4))
    twice = F.transform("x", lambda v, i: v + F.coalesce(F.get("x", i + shift + 3), F.lit(0.0)))
    other = F.when(k == 0, F.col("y")).when(k == 1, F.filter(noisy, lambda v: v.isNotNull())).otherwise(twice)
    return both.select("vec_id", F.slice("x", F.lit(1), (40 + F.col("vec_id") % 25).cast("int")).alias("a"), F.slice(other, F.lit(1), (64 - F.col("vec_id") % 11).cast("int")).alias("b"))


def q_offsets(spark, d):
    return best_offsets(_pairs(spark, d), "a", "b", MOST, NEAR).select("vec_id", "offset", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"))


def q_links(spark, d):
    return validated_links(_pairs(spark, d), "a", "b", MOST, NEAR).select("vec_id", "offset", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "verdict")


_X = "(SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)) AS x FROM embeddings)"
#: n: curves less their means, of length one; c: scores by offset; w: the best of each pair; r: with the second.
OFFSETS_SQL = f"""p AS (SELECT a.vec_id, a.x, b.x AS y, a.vec_id % 7 AS h FROM {_X} a JOIN {_X} b ON b.vec_id = a.vec_id + 1),
q AS (SELECT vec_id, x[1:40 + vec_id % 25] AS a, (CASE vec_id % 3 WHEN 0 THEN y WHEN 1 THEN list_transform(range(1, 65 - h), lambda i: x[i + h] + y[i] / 4) ELSE list_transform(range(1, 65), lambda i: x[i] + coalesce(x[i + h + 3], 0)) END)[1:64 - vec_id % 11] AS b FROM p),
m AS (SELECT vec_id, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM q),
n AS (SELECT vec_id, list_transform(a, lambda v: v / sqrt(list_sum(list_transform(a, lambda z: z * z)))) AS a, list_transform(b, lambda v: v / sqrt(list_sum(list_transform(b, lambda z: z * z)))) AS b FROM m),
c AS (SELECT vec_id, k, round(coalesce(list_sum(list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i + k BETWEEN 1 AND len(a) THEN a[i + k] * b[i] ELSE 0 END)), 0), 12) AS score FROM n, range({-MOST}, {MOST + 1}) r(k)),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) = 1),
r AS (SELECT w.vec_id, w.k AS "offset", greatest(w.score, 0) AS score, CASE WHEN w.score > 0 THEN greatest((SELECT max(c.score) FROM c WHERE c.vec_id = w.vec_id AND abs(c.k - w.k) > {NEAR}), 0) ELSE 0 END AS second FROM w)"""
QUERIES = {
    "best_offsets": (q_offsets, f'WITH {OFFSETS_SQL} SELECT vec_id, "offset", round(score, 6) AS score, round(second, 6) AS second FROM r'),
    "validated_links": (q_links, f"WITH {OFFSETS_SQL} SELECT vec_id, \"offset\", round(score, 6) AS score, round(score - second, 6) AS margin, CASE WHEN score < 0.55::DOUBLE THEN 'low' WHEN score - second < 0.08::DOUBLE THEN 'unclear' ELSE 'linked' END AS verdict FROM r"),
}
