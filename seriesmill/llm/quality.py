"""Quality by co-training: what a text says of itself, and what is known about it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add, eq

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Features of the text itself: shares per word, and how often at all (long texts may be bad in parts).
CONTENT = (
    "upper", "upper_n", "again", "again_n", "shout", "shout_n", "bars", "bars_n", "signs", "signs_n", "digits",
    "distinct", "word_size", "words_n", "lines", "lines_again",
)
SIGNS = "*#$%&"
LANGS, SOURCES = 8, 32
META = ("size", "no_size", *(f"lang_{k}" for k in range(LANGS)), *(f"source_{k}" for k in range(SOURCES)))


def _content(text: str | None) -> tuple[float, ...]:
    """The features of one whole text; NULL counts as empty."""
    text = text or ""
    words = text.split()
    n = len(words) or 1
    upper = sum(map(str.isupper, words))
    again = sum(map(eq, words, words[1:]))
    shout, bars, signs = text.count("!!"), text.count(" |"), sum(map(text.count, SIGNS))
    lines = [x for x in text.split("\n") if x]
    return (
        upper / n, math.log1p(upper), again / n, math.log1p(again), shout / n, math.log1p(shout),
        bars / n, math.log1p(bars), signs / n, math.log1p(signs), sum(map(text.count, "0123456789")) / (len(text) or 1),
        len(set(words)) / n, len(text) / n if words else 0.0, math.log1p(len(words)), len(lines) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0)


def content_features(text: Column) -> Column:
    """A struct of the text features, computed batch by batch."""
    @F.pandas_udf(", ".join(f"{c} double" for c in CONTENT))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_content(t) for t in batch], columns=list(CONTENT), dtype=float)

    return run(text)


def meta_features(docs: DataFrame, lang: str, source: str, size: str) -> list[Column]:
    """Metadata as numbers: log size, and a place among a few for language and source.

    A column that the table lacks, or a NULL, gives zeros (and the missing-size flag).
    """
    def value(name: str) -> Column:
        return F.col(name) if name in docs.columns else F.lit(None)

    def places(name: str, n: int) -> Iterator[Column]:
        place = F.pmod(F.xxhash64(value(name).cast("string")), F.lit(n))
        for k in range(n):
            yield F.coalesce((value(name).isNotNull() & (place == k)).cast("double"), F.lit(0.0))

    known = F.greatest(value(size).cast("double"), F.lit(0.0))
    columns = [F.coalesce(F.log1p(known), F.lit(0.0)), value(size).isNull().cast("double"),
               *places(lang, LANGS), *places(source, SOURCES)]
    return [c.alias(name) for c, name in zip(columns, META, strict=True)]


@dataclass
class View:
    """A fitted logistic view: log-odds are ``intercept`` plus the weighted features."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def odds(self, prefix: str = "") -> Column:
        terms = [F.col(prefix + c) * F.lit(float(w)) for c, w in self.weights.items() if w]
        return reduce(add, terms, F.lit(float(self.intercept)))


def sigmoid(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _fit(rows: DataFrame, label: str, features: tuple[str, ...]) -> View:
    """Regularised logistic regression over all rows with a label.  One class, or none: its (smoothed) share."""
    rows = rows.where(F.col(label).isNotNull())
    n, good = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    if not n or good in (0.0, float(n)):
        share = ((good or 0.0) + 1) / (n + 1) if n else 1 - 1e-6
        return View({}, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    vector = VectorAssembler(inputCols=list(features), outputCol="features__")
    model = LogisticRegression(featuresCol="features__", labelCol=label, regParam=0.002, maxIter=25).fit(
        vector.transform(rows.select(*features, F.col(label).cast("double").alias(label))))
    return View(dict(zip(features, map(float, model.coefficients), strict=True)), float(model.intercept))


@dataclass
class Quality:
    """Both views and how their log-odds combine."""

    content: View
    meta: View
    combined: View

    def score(self) -> Column:
        both = self.combined.weights
        odds = (self.content.odds() * both.get("content__", 0.0) + self.meta.odds() * both.get("meta__", 0.0)
                + self.combined.intercept)
        return sigmoid(odds)


def feature_table(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    size: str = "n_chars",
) -> DataFrame:
    """``id`` and the features of both views for every row, stored; the texts are read once."""
    found = docs.select(
        F.col(doc_id).alias("id"), content_features(F.col(text)).alias("c"), *meta_features(docs, lang, source, size))
    return stored(found.select("id", "c.*", *META))


def co_train(
    features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", rounds: int = 2,
    sure: float = 0.98,
) -> Quality:
    """Fit both views with each other's confident guesses, then calibrate them together.

    A fifth of the labelled ids, by a hash, is set aside for the calibration.
    Each view starts from the other labelled rows.  A round then gives every
    unlabelled row a label for the one view where the *other* view is surer than
    ``sure`` (either way), and fits both again, over all rows there are.  At last
    one regression of the set-aside labels on the two views' log-odds calibrates
    and weighs them; a view that knows nothing gets next to no weight.

    Labels of one id are averaged, NULL labels and ids left out.  Without labels
    every document is taken for good; with one class alone nearly so or nearly not.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y")))
    rows = features.join(known, "id", "left").withColumn(
        "aside", F.col("y").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(5)) == 0))
    rows = stored(rows)
    own = F.when(~F.col("aside"), F.col("y"))
    content = _fit(rows.withColumn("label__", own), "label__", CONTENT)
    meta = _fit(rows.withColumn("label__", own), "label__", META)
    for _ in range(rounds):
        def guess(other: View) -> Column:
            p = sigmoid(other.odds())
            return F.when(F.col("y").isNull(), F.when(p >= sure, 1.0).when(p <= 1 - sure, 0.0)).otherwise(own)

        content, meta = (
            _fit(rows.withColumn("label__", guess(meta)), "label__", CONTENT),
            _fit(rows.withColumn("label__", guess(content)), "label__", META))
    both = rows.where("aside").select("y", content.odds().alias("content__"), meta.odds().alias("meta__"))
    n, good = both.agg(F.count(F.lit(1)), F.sum("y")).first()
    if n and 0 < good < n:
        combined = _fit(both, "y", ("content__", "meta__"))
    else:
        combined = View({"content__": 1.0})
    return Quality(content, meta, combined)


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", **settings,
) -> DataFrame:
    """``doc_id, score, keep`` per row: the calibrated probability of good quality, and whether it reaches
    ``threshold``.

    NULL and empty texts have features of no words and score like other short
    texts; NULL or repeated ids pass through.  Extra columns are not read.  An
    empty table gives an empty result.
    """
    features = feature_table(docs, doc_id)
    quality = co_train(features, labels, doc_id, **settings)
    return features.select(F.col("id").alias("doc_id"), quality.score().alias("score")).withColumn(
        "keep", F.col("score") >= threshold)


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text",
    lang: str = "lang", source: str = "source", size: str = "n_chars", **settings,
) -> DataFrame:
    """The rows of ``docs`` that reach ``threshold``, with all their columns.

    Each row is scored where it is read, so nothing is exchanged to filter.
    """
    quality = co_train(feature_table(docs, doc_id, text, lang, source, size), labels, doc_id, **settings)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    scored = docs.select(whole, content_features(F.col(text)).alias("__content"),
                         *meta_features(docs, lang, source, size)).select("__row", "__content.*", *META)
    return scored.where(quality.score() >= threshold).select("__row.*")
