"""Exact duplicates, found with skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import per_group, stored

#: White space that does not count: U+0020 and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]"
#: Copies of one text that go back to their rows in one task at most; beyond, the winner goes to the rows.
HOT = 100_000


def normalised(text: str | Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITE, "")


def _best(length: str | Column, doc: str | Column) -> Column:
    """Sorts first what stays: most code points, then smallest id, ids before NULL."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    length = F.col(length) if isinstance(length, str) else length
    return F.struct((-length).alias("less"), doc.isNull().alias("no_id"), doc.alias("id"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space.  Combining goes in three
    stages, and each groups by the digest *and* the whole normalised text, so
    two texts that merely share a digest never meet:

    1. each task combines its own rows (the partial side of the aggregation);
    2. digests are dealt with a salt, so copies of one text, a third of all rows
       say, spread over ``salts`` tasks;
    3. the winners of the salts, at most ``salts`` rows per text, are combined.

    The salt is dealt by the row's place in its task, so copies spread whatever
    their ids, NULL or repeated, and lengths are.

    What goes back to the rows is the digest with a second hash and the length;
    should even those be equal for different texts, the job stops.  Winners of
    texts with more than ``HOT`` copies, of which there are few, go to the rows
    wherever those are; the rows of other texts meet their winner by the digest.
    Where several rows have the winner's id and length, the one that is kept is
    the first by its place in a written table: a minimum, combined before it is
    exchanged.  No text's rows are ever gathered or sorted in one task.

    NULL texts count as empty, so all empty texts are one group.  Of rows with
    equal text and one id (repeated rows) only one, of the longest, is kept.  A
    NULL id is an id that sorts last.  Columns of ``docs`` other than the two
    named are not read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("raw")).select(
        "id", F.char_length("raw").alias("length"), normalised("raw").alias("content"))
    rows = rows.select(
        "id", "length", "content",
        F.sha2("content", 256).alias("digest"),
        F.xxhash64("content").alias("second"),
        F.char_length("content").alias("bare"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"))
    per_salt = rows.groupBy("digest", "second", "bare", "salt", "content").agg(
        F.min(_best("length", "id")).alias("best"), F.count(F.lit(1)).alias("n"))
    winners = per_salt.groupBy("digest", "second", "bare", "content").agg(
        F.min("best").alias("best"), F.sum("n").alias("n")).select("digest", "second", "bare", "best", "n")
    winners = stored(winners)
    clash = winners.groupBy("digest", "second", "bare").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if not clash.isEmpty():
        raise ValueError("different texts share a digest, a second hash and their length")
    # Only texts with copies have to travel back to their rows; a row whose text
    # occurs once is its own winner.
    text_key = ["digest", "second", "bare"]
    light = stored(rows.select("id", "length", *text_key, F.monotonically_increasing_id().alias("row")))
    hot = per_group(winners.where(F.col("n") > HOT))
    cold = winners.where((F.col("n") > 1) & (F.col("n") <= HOT))
    spread = light.join(hot.withColumnsRenamed({"n": "hot_n", "best": "hot_best"}), text_key, "left")
    near = spread.where("hot_n IS NULL").drop("hot_n", "hot_best").join(cold, text_key, "left")
    met = near.unionByName(spread.where("hot_n IS NOT NULL").withColumnsRenamed({"hot_n": "n", "hot_best": "best"}))
    wins = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("length") == -F.col("best.less"))
    decided = met.select(
        "id", "n", "best", *text_key, "row", (F.col("n").isNull() | wins).alias("wins"))
    # several rows that agree in text, id and length: one of them
    several = stored(decided.where("n IS NOT NULL AND wins").groupBy(*text_key).agg(
        F.count(F.lit(1)).alias("__alike"), F.min("row").alias("__first")).where("__alike > 1"))
    if not several.isEmpty():
        decided = decided.join(per_group(several), text_key, "left").withColumn(
            "wins", F.col("wins") & (F.col("__first").isNull() | (F.col("row") == F.col("__first"))))
    return decided.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.col("wins").alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that are dropped are the smaller side and are taken away by id.  An id
    that is on several rows needs more: of such rows one per text stays, the
    longest, and of equal ones any, as they are the same row.
    """
    decided = stored(exact_groups(docs, doc_id, text, salts))
    per_id = decided.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows_"), F.sum(F.col("kept").cast("int")).alias("stay"))
    gone = per_id.where("stay = 0").select(F.col("doc_id").alias("__gone_id"))
    left = docs.join(gone, docs[doc_id].eqNullSafe(F.col("__gone_id")), "left_anti")
    several = stored(per_id.where("rows_ > 1 and stay > 0").select(F.col("doc_id").alias("__several_id")))
    if several.isEmpty():
        return left
    same = left[doc_id].eqNullSafe(F.col("__several_id"))
    single = left.join(several, same, "left_anti")
    many = left.join(several, same, "left_semi")
    keys = decided.where("kept").select(F.col("doc_id").alias("__several_id"), F.col("text_sha256").alias("__kept_digest"))
    many = many.withColumn("__digest", F.sha2(normalised(F.col(text)), 256))
    many = many.join(
        keys, many[doc_id].eqNullSafe(F.col("__several_id")) & (F.col("__digest") == F.col("__kept_digest")), "left_semi")
    # an aggregate, so tasks combine their rows before any is exchanged
    longest = F.max_by(F.struct(*docs.columns), F.char_length(F.coalesce(F.col(text), F.lit(""))))
    many = many.groupBy(F.col(doc_id).alias("__id"), "__digest").agg(longest.alias("__row")).select("__row.*")
    return single.unionByName(many)
