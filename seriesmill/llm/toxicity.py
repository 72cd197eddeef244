"""Toxicity by a weighted lexicon, matched after undoing disguises."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .simhash import drop_near_copies

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʀ": "r",
}
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
_SIGNS = set("!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~2689\t\n\r\x0b\x0c «»“”„‘’–—…¡¿·•°§") - set(DIGITS)
_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS, **dict.fromkeys(_SIGNS, " "), **dict.fromkeys(INVISIBLE)})

# Insults to start from, where labels do not speak against them.
SEED = ("asshole", "bastard", "bitch", "clown", "cunt", "disgusting", "dumbass", "fuck", "idiot", "imbecile", "loser",
        "moron", "pathetic", "retard", "scum", "slut", "stupid", "trash", "whore", "worthless")
SEED_WEIGHT = 4.0

STEM_LEAST, STEM_MOST = 4, 12
# Log-odds and log-likelihood ratio that a learnt stem needs.
LEAST_WEIGHT, LEAST_EVIDENCE = 3.0, 27.0


def folded(text: str | None) -> list[str]:
    """The words with disguises undone: compatibility forms, case, look-alikes, digits for letters,
    invisible characters.  NULL: none."""
    if not text:
        return []
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_TABLE).split()


@dataclass
class Lexicon:
    """Word beginnings with weights, phrases in which they do not count, and the score's middle."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    half: float = SEED_WEIGHT / 100  # weight per word that scores 0.5


class Matcher:
    """One automaton over lexicon and exceptions."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, tuple[float, bool]] = {}
        for stem, weight in lexicon.weights.items():
            # a 1 for an l arrives as an i
            for form in {stem, stem.replace("l", "i")}:
                patterns[f" {form}"] = (weight, False)
        for phrase in lexicon.exceptions:
            patterns[f" {phrase} "] = (0.0, True)
        for pattern, (weight, excepted) in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), weight, excepted))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def hits(self, line: str) -> list[tuple[int, float]]:
        """Place and weight of every entry that no exception covers; of entries at one place the longest."""
        if self.empty:
            return []
        found: dict[int, tuple[int, float]] = {}
        excepted = []
        for end, (size, weight, exception) in self.automaton.iter(line):
            start = end - size + 1
            if exception:
                excepted.append((start, end))
            elif start not in found or found[start][0] < size:
                found[start] = (size, weight)
        return [(at, w) for at, (_, w) in sorted(found.items()) if not any(a <= at < b for a, b in excepted)]

    def density(self, words: list[str]) -> tuple[float, int]:
        """Weight per word, and the number of hits."""
        if not words:
            return 0.0, 0
        hits = self.hits(f" {' '.join(words)} ")
        return sum(w for _, w in hits) / len(words), len(hits)


def _evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log-likelihood ratio that a stem's share of toxic documents is not the common one."""
    n, share = toxic + clean, all_toxic / (all_toxic + all_clean)
    out = 0.0
    for seen, expected in ((toxic, n * share), (clean, n * (1 - share))):
        if seen:
            out += 2 * seen * math.log(seen / expected)
    return out


def _chosen(counts: dict[str, tuple[int, int]], all_toxic: int, all_clean: int) -> dict[str, float]:
    """Stems to match, with log-odds weights, and seeds that few clean documents hold.

    A stem counts if it is significant and far more frequent in toxic documents.
    One that a longer stem replaces with hardly a loss of toxic documents gives
    way to it, and one that starts with a chosen stem must weigh clearly more.
    """
    good = {}
    for s, (t, c) in counts.items():
        weight = math.log((t + 0.5) / (all_toxic + 1)) - math.log((c + 0.5) / (all_clean + 1))
        if weight >= LEAST_WEIGHT and _evidence(t, c, all_toxic, all_clean) > LEAST_EVIDENCE:
            good[s] = (t, weight)
    longer = Counter()
    for s, (t, _) in good.items():
        longer[s[:-1]] = max(longer[s[:-1]], t)
    out: dict[str, float] = {}
    for s in sorted(good, key=len):
        t, weight = good[s]
        shorter = max((out[s[:k]] for k in range(STEM_LEAST, len(s)) if s[:k] in out), default=-math.inf)
        if longer[s] < 0.95 * t and weight > shorter + 0.5:
            out[s] = weight
    for s in SEED:
        t, c = counts.get(s, (0, 0))
        if 10 * c <= t and not any(s[:k] in out for k in range(STEM_LEAST, len(s) + 1)):
            out[s] = SEED_WEIGHT
    return out


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = 20000,
) -> Lexicon:
    """Learn word beginnings, their weights, exceptions and the score's scale.

    ``sample`` bounds the labelled rows that are used: those whose ids have the
    smallest hashes.  Everything else is counted over all of them.  Labels of
    one id are averaged; NULL labels are left out.  Without toxic or without
    clean rows there are the seeds alone.
    """
    wanted = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id")).agg((F.avg(F.col(label).cast("double")) > 0.5).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(sample))
    # at most ``sample`` ids and flags
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted), "id")
    # Copies and near copies are no new evidence for a word: of rows with equal or close fingerprints the
    # smallest id teaches.
    rows = stored(drop_near_copies(stored(rows.select("id", "text", "toxic")), doc_id="id").select("text", "toxic"))

    def stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {True: Counter(), False: Counter()}
        for frame in frames:
            for t, toxic in zip(frame["text"], frame["toxic"], strict=True):
                found = {""}
                for w in set(folded(t)):
                    found.update(w[:k] for k in range(STEM_LEAST, min(len(w), STEM_MOST) + 1))
                seen[bool(toxic)].update(found)
        names = list(seen[True].keys() | seen[False].keys())
        for at in range(0, len(names), 1 << 16):
            some = names[at:at + (1 << 16)]
            yield pd.DataFrame({"stem": some, "toxic": [seen[True][s] for s in some],
                                "clean": [seen[False][s] for s in some]})

    counted = rows.select("text", "toxic").mapInPandas(stems, "stem string, toxic long, clean long")
    counted = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # nearly only in toxic documents, a seed, or the count of all: few rows
    kept = counted.where(
        (F.col("stem") == "") | F.col("stem").isin(*SEED)
        | ((F.col("toxic") > F.col("clean")) & (F.col("toxic") >= 5))).collect()
    counts = {r["stem"]: (r["toxic"], r["clean"]) for r in kept}
    all_toxic, all_clean = counts.pop("", (0, 0))
    if not all_toxic or not all_clean:
        return Lexicon(dict.fromkeys(SEED, SEED_WEIGHT), half=SEED_WEIGHT / 100)
    lexicon = Lexicon(_chosen(counts, all_toxic, all_clean))

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for frame in frames:
            out = []
            for t, toxic in zip(frame["text"], frame["toxic"], strict=True):
                words = folded(t)
                line = f" {' '.join(words)} "
                phrases = {"": 1}
                for at, _ in matcher.hits(line):
                    k = line.count(" ", 0, at)
                    phrases |= dict.fromkeys((words[k], " ".join(words[max(0, k - 1):k + 1]), " ".join(words[k:k + 2])))
                out += [(p, bool(toxic), matcher.density(words)[0] if not p else 0.0) for p in phrases]
            yield pd.DataFrame(out, columns=["phrase", "toxic", "density"])

    places = rows.select("text", "toxic").mapInPandas(contexts, "phrase string, toxic boolean, density double")
    places = places.persist()
    spared = places.where("phrase != ''").groupBy("phrase").agg(
        F.sum(F.col("toxic").cast("int")).alias("t"), F.count(F.lit(1)).alias("n")).where("t = 0 AND n >= 3")
    lexicon.exceptions = sorted(r["phrase"] for r in spared.collect() if r["phrase"] not in lexicon.weights)
    density = [(r["density"], r["toxic"]) for r in places.where("phrase = '' AND density > 0").collect()]
    places.unpersist()
    lexicon.half = _middle(density)
    return lexicon


def _middle(density: list[tuple[float, bool]]) -> float:
    """The density that scores one half, such that 0.3 parts the documents with the fewest mistakes."""
    if not density:
        return SEED_WEIGHT / 100
    values = np.array(sorted(density), dtype=[("d", float), ("toxic", bool)])
    # mistakes of a border before each value: toxic ones below, clean ones from there on
    below = np.concatenate([[0], np.cumsum(values["toxic"])])
    above = np.concatenate([np.cumsum(~values["toxic"][::-1])[::-1], [0]])
    at = int(np.argmin((below + above)[:-1]))
    lower = values["d"][at - 1] if at else values["d"][0] / 10
    return float(math.sqrt(lower * values["d"][at])) * 0.7 / 0.3


def toxicity(
    docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, score, predicted, hits`` per row.

    The score grows with the weight of matched entries per word, from 0 without
    a hit (also for NULL and empty texts) towards 1.  Ids, NULL or repeated,
    pass through; other columns are not read.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for frame in frames:
            found = [matcher.density(folded(t)) for t in frame["text"]]
            density = np.array([d for d, _ in found], float)
            frame["score"] = density / (density + lexicon.half)
            frame["hits"] = [n for _, n in found]
            yield frame[["key", "score", "hits"]]

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, score double, hits long").select(
        F.col("key").cast(kind).alias("doc_id"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
