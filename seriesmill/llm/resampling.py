"""Documents drawn by how much they look like a target text: array-scored weights, distributed quickselect."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordering import positions

#: Pivot keys a round of the selection counts at once.
PIVOTS = 16
#: Words a worker remembers the bucket of, and the most bytes of such a word.
REMEMBERED, SHORT = 200_000, 64

# A to Z in lower case; every other ASCII byte that is no letter or digit parts words
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_WORDS = bytes(
    b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Buckets(dict):
    """The bucket of a feature; short ones are computed once per worker."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.size
        if len(self) < REMEMBERED and len(feature) <= SHORT:
            self[feature] = bucket
        return bucket

    def of(self, text: bytes | None, runs: int) -> tuple[int, np.ndarray]:
        """The number of words of a text and the bucket of each of its features."""
        words = text.translate(_WORDS).split() if text else []
        features = words
        if runs > 1:
            features = words + [
                b" ".join(words[i:i + n]) for n in range(2, runs + 1) for i in range(len(words) - n + 1)]
        return len(words), np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(df: DataFrame, text: str = "text", runs: int = 1, size: int = 10000) -> np.ndarray:
    """How many features of all texts fall into each bucket.  Every task sends one sum per bucket it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(size), np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(buckets.of(data.as_py(), runs)[1], minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    met = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    counts = np.zeros(size, np.int64)
    for row in met.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + size) / ((s + 1)(T + size))))`` of every bucket."""
    s, t, size = source.astype(float), target.astype(float), len(source)
    ratio = ((t + 1) * float(source.sum() + size)) / ((s + 1) * float(target.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(
    docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", runs: int = 1,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` per row: the sum of its features' gains, read from the array."""
    size = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(size)
        for batch in batches:
            rows = []
            for data in batch.column(1):
                words, found = buckets.of(data.as_py(), runs)
                rows.append((words, len(found), int(gain[found].sum())))
            table = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(table[:, i]) for i in range(3)]],
                ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int) -> Column:
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``, h the first 8 hex digits of sha256(``seed:doc_id``)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


KEY = ("less", "nameless", "doc_id", "row")


def _key() -> Column:
    return F.struct(*KEY)


def kth_key(keyed: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 0) -> list:
    """The k-th smallest (from 1) of the unique composite keys ``KEY`` of a table.

    Every round draws random rows as pivots, counts exactly how many keys of
    each partition lie below and at each of them, and goes on with the keys
    between the two pivots around the k-th, written anew, until a pivot is the
    k-th itself.  A round with 16 pivots leaves about an eighth of the keys.
    """
    kinds = {f.name: f.dataType for f in keyed.schema.fields}
    active, left = keyed, k
    for attempt in range(10_000):
        drawn = active.select(*KEY, F.rand(seed + attempt).alias("__luck")).orderBy("__luck").limit(pivots).collect()
        points = [[r[c] for c in KEY] for r in drawn]
        structs = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(KEY, point)]) for point in points]
        counts = active.agg(*[
            F.coalesce(F.sum(test.cast("long")), F.lit(0)) for s in structs for test in (_key() < s, _key() == s)
        ]).first()
        if not counts:
            raise ValueError(f"there is no {k}-th key")
        around = [(counts[2 * i], counts[2 * i + 1], i) for i in range(len(points))]
        for less, equal, i in around:
            if less < left <= less + equal:
                return points[i]
        below = max((x for x in around if x[0] + x[1] < left), default=None)
        above = min((x for x in around if x[0] >= left), default=None)
        if below:
            active, left = active.where(_key() > structs[below[2]]), left - below[0] - below[1]
        if above:
            active = active.where(_key() < structs[above[2]])
        active = stored(active.select(*KEY))
    raise RuntimeError("the selection did not settle")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, runs: int = 1,
    size: int = 10000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` per row; ``rank`` is NULL where a row is not drawn.

    Of the N rows with ``least_words`` words, the ``percent * N // 100`` highest
    scores are drawn, ties to the smaller id: weights by importance plus one
    draw of noise per id, which is sampling without replacement.  The border is
    found by ``kth_key``; only rows within it are sorted and ranked.

    A NULL or empty text has no words and weight 0 and is never drawn unless
    ``least_words`` is 0.  A NULL id has the noise of the empty id and sorts
    last.  Repeated rows are rows of their own; where the border parts equal
    ones, any of them are drawn.  An empty table gives an empty result, an empty
    target counts no features.  Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, runs, size), bucket_counts(target, text, runs, size))
    scored = stored(
        weighed(docs, gain, doc_id, text, runs)
        .withColumn("score", F.col("weight") + noise("doc_id", seed))
        .withColumns({"less": -F.col("score"), "nameless": F.col("doc_id").isNull(),
                      "row": F.monotonically_increasing_id()}))
    long_enough = F.col("n_words") >= least_words
    k = scored.where(long_enough).count() * percent // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long")
    if not k:
        return scored.select(*shown, none.alias("rank"))
    kinds = {f.name: f.dataType for f in scored.schema.fields}
    border = kth_key(scored.where(long_enough).select(*KEY), k, seed=seed)
    last = F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(KEY, border)])
    drawn = long_enough & (_key() <= last)
    ranked = positions(scored.where(drawn), *[F.col(c) for c in KEY], name="place")
    return scored.where(~drawn).select(*shown, none.alias("rank")).unionByName(
        ranked.select(*shown, (F.col("place") + 1).alias("rank")))
