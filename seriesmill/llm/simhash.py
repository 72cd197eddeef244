"""Near duplicates by SimHash, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import per_group, stored
from .components import connected_components

#: Fingerprints in a tile, about: two of them are what one comparison task holds.
TILE = 16384
#: Pairs compared by one numpy call.
CELLS = 1 << 20


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64 values.

    Words are runs of bytes other than U+0020 and U+0009 to U+000D, with A-Z
    lowered; shingles keep their repeats and are joined by one space.  With too
    few words the whole sequence is the one shingle; without words the
    fingerprint is zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a:b - 1], seed) for a, b in zip(starts, ends[shingle - 1:], strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``id, copy, fp`` per row: ``copy`` is a hash of the text, ``fp`` the fingerprint as a signed
    long.  NULL text: no words."""
    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [fingerprint(t or "", shingle) for t in frame["text"]]
            frame["fp"] = np.array(values, dtype=np.uint64).view(np.int64)
            yield frame[["id", "copy", "fp"]]

    rows = docs.select(
        F.col(doc_id).cast("string").alias("id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(compute, "id string, copy long, fp long").select(
        F.col("id").cast(kind).alias("id"), "copy", "fp")


def _tree(a: np.ndarray, b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or inside one): values and their roots.

    Both tiles are sorted by the population count of their top 16 bits, so the
    part of the second tile that a run of the first can reach is one slice.
    """
    def arranged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.view(np.uint64)
        top = np.bitwise_count(x >> np.uint64(48)).astype(np.int64)
        order = np.argsort(top, kind="stable")
        return x[order], top[order]

    a, top_a = arranged(a)
    inside = b is None
    b, top_b = (a, top_a) if inside else arranged(b)
    values = a if inside else np.concatenate([a, b])
    shift = 0 if inside else len(a)
    root = np.arange(len(values))
    # All upper halves of a tile have one count, so the count of the top 16 bits gives that of the
    # next 16: both differences together are a lower bound of the bits that differ.
    half = int(np.bitwise_count(a[0] >> np.uint64(32))) - int(np.bitwise_count(b[0] >> np.uint64(32)))
    for count in np.unique(top_a):
        lo, hi = np.searchsorted(top_a, [count, count + 1])
        near = [k for k in range(17) if abs(count - k) + abs(half - (count - k)) <= distance]
        if not near:
            continue
        start, end = np.searchsorted(top_b, [near[0], near[-1] + 1])
        if start == end:
            continue
        step = max(1, CELLS // (end - start))
        for at in range(lo, hi, step):
            rows = a[at:min(hi, at + step)]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ b[None, start:end]) <= distance)
            i, j = i + at, j + start + shift
            while True:  # hook the larger root to the smaller until every link lies in one tree
                x, y = root[i], root[j]
                apart = x != y
                if not apart.any():
                    break
                x, y = x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(up := root[root], root):
                    root = up
    hooked = root != np.arange(len(values))
    return values[hooked].view(np.int64), values[root[hooked]].view(np.int64)


def fingerprint_links(classes: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` that connect distinct fingerprints ``fp`` exactly as all pairs within ``distance`` do.

    Fingerprints are dealt to tiles by the population counts of their two halves
    (and a hash, so that no tile grows beyond about ``tile``).  Two fingerprints
    differ in at least as many bits as their counts do, summed over the halves;
    tile pairs beyond ``distance`` are never formed.  Every remaining tile pair
    meets in one task and is compared whole by exclusive-or and bit counts.  A
    pair answers with a spanning forest instead of all its links, so a large
    group of near copies stays linear.
    """
    counted = classes.select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))
    # at most 33 x 33 rows, whatever the input: the one thing that is broadcast
    sizes = stored(counted.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("chunks")))
    own = counted.join(F.broadcast(sizes), ["hi", "lo"]).withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    tiles = stored(own.groupBy("hi", "lo", "chunk").agg(F.collect_list("fp").alias("fps")))
    offsets = [(h, lo) for h in range(-distance, distance + 1) for lo in range(-distance, distance + 1)
               if abs(h) + abs(lo) <= distance]
    around = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(lo).alias("l")) for h, lo in offsets]))
    other = sizes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "chunks")
    met = (
        tiles.select("*", around.alias("o"))
        .select("hi", "lo", "chunk", "fps", (F.col("hi") + F.col("o.h")).alias("hi2"),
                (F.col("lo") + F.col("o.l")).alias("lo2"))
        .join(F.broadcast(other), ["hi2", "lo2"])
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk2")))
    this, that = F.struct("hi", "lo", "chunk"), F.struct(
        F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("chunk2").alias("chunk"))
    met = met.select(F.least(this, that).alias("x"), F.greatest(this, that).alias("y"), "fps")

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        tiles_ = [np.asarray(x, dtype=np.int64) for x in pair["fps"]]
        a, b = _tree(tiles_[0], tiles_[1] if len(tiles_) == 2 else None, distance)
        return pd.DataFrame({"a": a, "b": b})

    return met.groupBy("x", "y").applyInPandas(compare, "a long, b long")


def _placed(
    docs: DataFrame, doc_id: str, text: str, shingle: int, distance: int, tile: int, first: Column,
) -> DataFrame:
    """``id, copy, fp, component`` per row; ``component`` is the least ``first``, an aggregate, of all linked rows."""
    rows = stored(fingerprints(docs, doc_id, text, shingle))
    classes = stored(rows.groupBy("fp").agg(first.alias("first")))
    roots = connected_components(fingerprint_links(classes, distance, tile))
    roots = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    # written, so that the join back does not inherit the exchange by root and Spark can split a large component
    roots = stored(roots)
    named = per_group(roots.groupBy("root").agg(F.min("first").alias("component")))
    return rows.join(roots.select("fp", "root").join(named, "root").select("fp", "component"), "fp")


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4,
    tile: int = TILE,
) -> DataFrame:
    """One row per row: ``doc_id, fingerprint, component_id``, the smallest id reachable by links.

    Documents whose fingerprints differ in at most ``distance`` bits are linked.
    Equal fingerprints are one class, so copies never meet in pairs.  Texts
    without words (empty, NULL, only white space) have fingerprint zero and
    link like any other.  NULL ids are not the smallest id; a component of
    nothing else has a NULL id.  Other columns are not read; an empty table
    gives an empty result.  Repeated rows each get a row.
    """
    return _placed(docs, doc_id, text, shingle, distance, tile, F.min("id")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the smallest id, NULL last.

    Rows are judged by id and text, so rows that share an id, or have none, stay
    or go by themselves.  Of a component's rows with its smallest id the one
    with the smallest hash of its text stays, and of equal rows one.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "copy"))
    found = _placed(docs, doc_id, text, shingle, distance, TILE, first)
    stays = F.col("id").eqNullSafe(F.col("component.id")) & (F.col("copy") == F.col("component.copy"))
    # rows that agree in id and text agree in the rest
    judged = stored(found.groupBy(F.col("id").alias("__id"), F.col("copy").alias("__copy")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(stays).alias("stays")))

    def same(rows: DataFrame) -> Column:
        return rows[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(rows[text]) == F.col("__copy"))

    left = docs.join(judged.where("NOT stays").select("__id", "__copy"), same(docs), "left_anti")
    several = stored(judged.where("stays AND rows > 1").select("__id", "__copy"))
    if several.isEmpty():
        return left
    many = left.join(several, same(left), "left_semi").dropDuplicates([doc_id, text])
    return left.join(several, same(left), "left_anti").unionByName(many)
