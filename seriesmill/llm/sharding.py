"""Shards of near-equal size by histogram sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: A document's size: the UTF-8 bytes of its text plus this many.
OVERHEAD = 8
LOW, HIGH = -(1 << 63), 1 << 63


@dataclass
class Search:
    """One border's state: bytes below it should be ``target``; it lies in [lo, hi]."""

    target: int
    lo: int = LOW
    hi: int = HIGH
    below: int = 0  # exact bytes of keys under lo
    inside: int = 0  # exact bytes of keys in [lo, hi)
    key: int | None = None  # the one key in [lo, hi), where there is only one
    done: bool = False

    def miss(self) -> int:
        return min(self.target - self.below, self.below + self.inside - self.target)

    def border(self) -> int:
        """The end of [lo, hi) whose exact bytes below come nearer to the target."""
        return self.lo if self.target - self.below <= self.below + self.inside - self.target else self.hi


def _refine(keys: DataFrame, key: str, searches: list[Search], tolerance: int, bits: int) -> None:
    """Histogram rounds until every border is within ``tolerance`` or beside a single key.

    A round cuts each open range into 2**bits equal parts, whose lower ends are
    the candidates.  Its aggregate is combined before the exchange and has at
    most 2**bits rows per open range, whatever the input.
    """
    shift = 64
    while open_ := [s for s in searches if not s.done]:
        wider, shift = shift, shift - bits
        part = F.shiftright(F.col(key), shift)
        rows = keys
        if wider < 64:
            rows = keys.where(F.shiftright(F.col(key), wider).isin(sorted({s.lo >> wider for s in open_})))
        counted = sorted(
            (row["part"] << shift, row["bytes"], row["n"], row["least"], row["most"])
            for row in rows.groupBy(part.alias("part")).agg(
                F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                F.min(key).alias("least"), F.max(key).alias("most")).collect())
        for s in open_:
            below, lo, hi = s.below, s.lo, s.hi
            for start, size, n, least, most in counted:
                if lo <= start < hi:
                    s.lo, s.hi, s.below, s.inside = start, start + (1 << shift), below, size
                    s.key = least if least == most else None
                    below += size
                    if below > s.target:
                        break
            s.done = s.miss() <= tolerance or s.key is not None
            if s.key is not None:
                s.lo, s.hi = s.key, s.key + 1


def histogram_shards(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text",
    tolerance: float = 1e-4, bits: int = 8,
) -> DataFrame:
    """One row per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards hold near-equal bytes, within ``tolerance`` of
    a mean shard or one document, whichever is larger.

    Keys are sorted: a hash of the text, then a hash of the id.  Equal texts are
    therefore neighbours, and a group of copies is cut only where a shard
    border falls into it, which a group larger than a shard makes necessary.
    Borders are found by histogram rounds: 2**``bits`` candidates per border,
    exact bytes below each over all partitions, and the next candidates inside
    the part that holds the border.  A border inside one group goes on over the
    second key.  A round brings at most shards x 2**``bits`` sums to the driver.  The
    rounds read a narrow stored table of keys and sizes, never the texts; then
    the rows are exchanged once and numbered.

    NULL texts have size 8 and the checksum of no bytes; they and empty texts
    are one group.  Rows that agree in text and id (repeated rows, or NULL ids
    of one text) have one key and stay together.  Other columns are not read.
    Empty input gives no rows.
    """
    narrow = docs.select(
        F.col(doc_id).alias("id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("first"),
        F.xxhash64(F.lit("id"), F.col(doc_id)).alias("second"))
    keys = stored(narrow)
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = int(tolerance * total / shards)
    searches = [Search(total * k // shards, inside=total) for k in range(1, shards)]
    if total:
        _refine(keys, "first", searches, slack, bits)
    # a border inside one group of equal first keys goes on over the second key
    within: dict[int, list[Search]] = {}
    for s in searches:
        if s.key is not None and s.miss() > slack:
            within.setdefault(s.key, []).append(Search(s.target - s.below, inside=s.inside))
    for group, inner in within.items():
        _refine(keys.where(F.col("first") == F.lit(group)), "second", inner, slack, bits)
    borders = [(s.border(), LOW) for s in searches if s.key is None or s.miss() <= slack]
    for group, inner in within.items():
        borders += [(group, s.border()) for s in inner]

    def reached(border: tuple[int, int]) -> Column:
        at, inner = border
        if at >= HIGH:
            return F.lit(0)
        over = F.col("first") > F.lit(at)
        if inner < HIGH:
            over = over | ((F.col("first") == F.lit(at)) & (F.col("second") >= F.lit(inner)))
        return over.cast("int")

    shard = F.lit(0)
    for border in borders:
        shard = shard + reached(border)
    placed = keys.withColumn("shard", shard)
    # the one exchange of rows: dealt and sorted by shard and key, however large a shard is
    dealt = placed.repartitionByRange("shard", "first", "second", "id").sortWithinPartitions(
        "shard", "first", "second", "id", "size")
    place = F.monotonically_increasing_id()
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("piece"), place.alias("place")))
    starts = dealt.groupBy("shard", "piece").agg(F.min("place").alias("from"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "piece", "from", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return dealt.join(starts, ["shard", "piece"]).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("ahead") + F.col("place") - F.col("from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
