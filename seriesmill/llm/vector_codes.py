"""Vectors as short codes: a codebook per part, the nearest entry found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import per_group, stored
from .vectors import matrix, whole

#: Entries of a neighbour list looked at in one step, entries tried for a start.
STEP, PROBES = 8, 16
#: Components stay below this, so that squared distances of 512 components fit 64 bits.
MOST = 1 << 26


class Orchard:
    """Exact nearest entry of a codebook, ties to the lower index.

    Every entry has a list of all entries by their distance from it.  A search
    walks the list of the best entry so far and jumps to the list of a better
    one when it meets it.  It stops where the list goes beyond twice the current
    distance: what lies there is further from the vector than the entry in hand.
    Entries met once are marked and not measured again.
    """

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.start = np.unique(np.linspace(0, len(book) - 1, min(PROBES, len(book))).astype(np.int64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry and the squared distance to it, per row."""
        count, entries = len(x), len(self.book)
        seen = np.zeros((count, entries), bool)
        seen[:, self.start] = True
        tried = ((x[:, None, :] - self.book[None, self.start, :]) ** 2).sum(2)
        first = tried.argmin(1)
        at, best = self.start[first], tried[np.arange(count), first]
        place = np.zeros(count, np.int64)
        live = np.arange(count)
        while len(live):
            steps = place[live][:, None] + np.arange(STEP)
            inside = steps < entries
            steps = np.minimum(steps, entries - 1)
            near = inside & (self.apart[at[live][:, None], steps] <= 4 * best[live][:, None])
            met = self.order[at[live][:, None], steps]
            new = near & ~seen[live[:, None], met]
            i, j = np.nonzero(new)
            row, entry = live[i], met[i, j]
            seen[row, entry] = True
            place[live] += STEP
            done = ~near[:, -1]
            if len(row):
                far = ((x[row] - self.book[entry]) ** 2).sum(1)
                # the best of the step: least distance, then lowest index
                by = np.lexsort((entry, far, row))
                heads = by[np.r_[True, row[by][1:] != row[by][:-1]]]
                row, entry, far = row[heads], entry[heads], far[heads]
                better = (far < best[row]) | ((far == best[row]) & (entry < at[row]))
                row = row[better]
                at[row], best[row], place[row] = entry[better], far[better], 0
                moved = np.zeros(count, bool)
                moved[row] = True
                done &= ~moved[live]
            live = live[~done]
        return at, best


def _assigned(books: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width = books[0].shape[1]
    for part, book in enumerate(books):
        x = rows[:, part * width:(part + 1) * width]
        yield part, x, *Orchard(book).nearest(x)


def _moved(prepared: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """Every entry at the floor of the mean of the parts it is nearest to; entries without parts stay."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for part, x, at, _ in _assigned(books, matrix(batch.column("v"), dims)):
                np.add.at(total[part], at, x)
                count[part] += np.bincount(at, minlength=len(count[part]))
        for part, n in enumerate(count):
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(met), part, np.int32)), pa.array(met.astype(np.int32)), pa.array(n[met]),
                 pa.array(list(total[part][met]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "total"])

    found = prepared.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    found = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    out = [b.copy() for b in books]
    for row in found.collect():  # at most one row per entry
        out[row["part"]][row["entry"]] = [s // row["n"] for s in row["total"]]
    return out


def compress(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id",
    vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` per vector that takes part, and the codebook of every part.

    ``code`` is an array of indexes, ``error`` the sum of squared distances.  Each
    codebook starts as that part of the vectors with the ``entries`` smallest ids
    and moves for ``rounds`` rounds to the floor of the mean of its parts.  All
    vectors take part in every round: each task adds up its own and sends one sum
    per entry.  Codebooks travel with the tasks; their size is entries x
    components, whatever the table.

    Vectors that are NULL, empty, or hold a NULL or non-finite component take no
    part.  Vectors of different lengths, or of a length that ``parts`` does not
    divide, stop the job, as do components of 2^26 or more after scaling.  NULL
    ids are the largest ids; repeated rows are rows of their own, also as
    entries.  With fewer vectors than entries there are fewer entries.  An empty
    table gives an empty result and no codebooks.  Other columns are not read.
    """
    kept = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("raw"))
    prepared = stored(whole(kept, "raw", scale, MOST).select("vec_id", "label", "v"))
    seeds = prepared.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    kinds = {f.name: f.dataType.simpleString() for f in prepared.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long"
    if not seeds:
        return df.sparkSession.createDataFrame([], schema), []
    dims = len(seeds[0]["v"])
    if dims % parts or any(len(r["v"]) != dims for r in seeds):
        raise ValueError(f"vectors of {sorted({len(r['v']) for r in seeds})} components cannot be cut into {parts} parts")
    books = np.split(np.array([r["v"] for r in seeds], np.int64), parts, axis=1)
    for _ in range(rounds):
        books = _moved(prepared, books, dims)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, best) for _, _, at, best in _assigned(books, matrix(batch.column("v"), dims))]
            codes = np.stack([at for at, _ in found], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(list(codes), pa.list_(pa.int32())),
                 pa.array(sum(best for _, best in found))],
                ["vec_id", "label", "code", "error"])

    return prepared.mapInArrow(encode, schema), books


def books_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over the rows of its label; NULL labels are one label."""
    coded = stored(coded)
    sums = per_group(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, coded["label"].eqNullSafe(F.col("__label")), "left").drop("__label")
