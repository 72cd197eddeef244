"""Resampling, vector codes and largest inner products against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm.ordering import positions
from seriesmill.llm.resampling import KEY, kth_key, resample
from seriesmill.llm.top_products import search, top_products
from seriesmill.llm.vector_codes import Orchard, books_digest, compress, with_label_error

# ---- resampling ---------------------------------------------------------------

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text, runs):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent, least, seed, runs, size):
    def bucket(f):
        return zlib.crc32(f.encode()) % size

    s, t = (Counter(bucket(f) for x in texts for f in features(x, runs)[1]) for texts in ([d for _, d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (S + size)) / ((s[b] + 1) * (T + size)))) for b in range(size)]
    rows = []
    for i, (doc, text) in enumerate(docs):
        words, found = features(text, runs)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((-score, doc is None, doc, i, len(found), weight, len(words)))
    long_enough = sorted((r for r in rows if r[6] >= least), key=lambda r: (r[0], r[1], r[2] or 0))
    k = len(long_enough) * percent // 100
    rank = {r[3]: n for n, r in enumerate(long_enough[:k], 1)}
    return Counter((r[2], r[4], r[5], -r[0], rank.get(r[3])) for r in rows)


@pytest.mark.parametrize("runs, least, percent, size", [(1, 20, 10, 10000), (2, 1, 50, 97), (1, 0, 100, 10000), (3, 2, 0, 5)])
def test_resampling_is_brute_force(odd_docs, runs, least, percent, size, spark):
    texts = ["Same TEXT here, here!", None, "", "other gęślą 日本語"]
    target = spark.createDataFrame([(x,) for x in texts], "text string")
    found = resample(odd_docs, target, percent, least, 7, runs, size).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(tuple(r) for r in found) == brute_resample(docs, texts, percent, least, 7, runs, size)


def test_resampling_of_nothing(no_docs, odd_docs, spark):
    empty = spark.createDataFrame([], "text string")
    assert resample(no_docs, empty).collect() == []
    assert resample(odd_docs, empty, least_words=1).where("rank IS NOT NULL").count() == 1
    assert resample(odd_docs, empty).schema.simpleString() == (
        "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>")


@pytest.mark.parametrize("k", [1, 2, 333, 999, 1000])
def test_selection_of_any_place(spark, k):
    # a third of the keys share a score and an id, some ids are missing
    rows = [(5 if i % 3 == 0 else i % 17, i % 5 == 0, None if i % 5 == 0 else i % 7, i) for i in range(1000)]
    keyed = spark.createDataFrame(rows, "less long, nameless boolean, doc_id long, row long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0, r[3]))[k - 1]
    assert kth_key(keyed, k, pivots=4) == list(want)
    assert list(KEY) == keyed.columns


def test_positions(spark):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(1000)], "a long, b long").repartition(7)
    found = positions(df, F.desc("a"), F.col("b")).orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(1000))
    assert [(r["a"], r["b"]) for r in found] == sorted(((r["a"], r["b"]) for r in found), key=lambda x: (-x[0], x[1]))
    assert positions(df.limit(0), F.col("a")).collect() == []


# ---- vector codes --------------------------------------------------------------

@pytest.mark.parametrize("dims, entries, spread", [(1, 3, 2), (2, 40, 4), (16, 256, 300), (3, 1, 5), (4, 100, 1)])
def test_orchard_is_brute_force(dims, entries, spread):
    draw = np.random.default_rng(dims * entries)
    book = draw.integers(-spread, spread + 1, (entries, dims))
    x = np.concatenate([draw.integers(-2 * spread, 2 * spread + 1, (300, dims)), book])
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    at, best = Orchard(book).nearest(x)
    assert (best == far.min(1)).all()
    assert (at == far.argmin(1)).all()  # argmin takes the lowest of equals


def brute_codes(rows, parts, entries, rounds, scale):
    rows = sorted(((i is None, i or 0, [math.floor(scale * c) for c in v], label) for i, v, label in rows))
    v = np.array([r[2] for r in rows])
    cut = np.split(v, parts, axis=1)
    books = [c[:entries].copy() for c in cut]

    def assign():
        far = [((c[:, None] - b[None]) ** 2).sum(2) for c, b in zip(cut, books)]
        return [f.argmin(1) for f in far], sum(f.min(1) for f in far)

    for _ in range(rounds):
        for c, b, at in zip(cut, books, assign()[0]):
            for e in range(len(b)):
                if (at == e).any():
                    b[e] = c[at == e].sum(0) // (at == e).sum()
    codes, error = assign()
    per = Counter()
    for r, e in zip(rows, error.tolist()):
        per[r[3]] += e
    return books, Counter((None if r[0] else r[1], r[3], tuple(int(c[i]) for c in codes), int(e), per[r[3]])
                          for i, (r, e) in enumerate(zip(rows, error)))


VECTORS = "vec_id long, embedding array<float>, label int, v int, raw int, code int, error int, size int, id int"


def vector_rows(count, dims, seed=0):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(size=dims).round(2)], int(draw.integers(4)) or None)
            for i in range(count)]
    rows += [(3, rows[3][1], 2), (3, rows[5][1], 2), (None, rows[6][1], None), (50, rows[0][1], 1), (50, rows[0][1], 1)]
    return rows


def vector_table(spark, rows, dims):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 1), (901, [nan] * dims, 1), (902, [1.0] * (dims - 1) + [inf], None), (903, [], 1),
           (904, [None] + [1.0] * (dims - 1), 1)]
    return spark.createDataFrame([(*r, *[7] * 6) for r in rows + odd], VECTORS).repartition(3)


@pytest.mark.parametrize("entries, parts, rounds", [(256, 4, 4), (8, 2, 3), (5, 1, 0)])
def test_codes_are_brute_force(spark, entries, parts, rounds):
    rows = vector_rows(120, 8)
    coded, books = compress(vector_table(spark, rows, 8), parts, entries, rounds, 64)
    want_books, want = brute_codes(rows, parts, entries, rounds, 64)
    assert books_digest(books) == books_digest(want_books)
    found = with_label_error(coded).collect()
    assert Counter((r["vec_id"], r["label"], tuple(r["code"]), r["error"], r["label_error"]) for r in found) == want


def test_codes_of_odd_tables(spark):
    empty = vector_table(spark, [], 4)
    coded, books = compress(empty)
    assert with_label_error(coded).collect() == [] and books == []
    with pytest.raises(ValueError, match="cut into 4 parts"):
        compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(Exception, match="or more after scaling"):
        compress(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<float>, label int"))


# ---- largest inner products --------------------------------------------------------

def brute_products(rows, every, k, scale):
    whole = [(i, np.array([math.floor(scale * c) for c in v])) for i, v, _ in rows]
    out = Counter()
    for i, q in whole:
        if i is not None and i % every == 0:
            best = sorted((-int(q @ c), j is None, j or 0) for j, c in whole if j != i)[:k]
            out.update((i, n, None if none else j, -s) for n, (s, none, j) in enumerate(best, 1))
    return out


@pytest.mark.parametrize("tile, block, k", [(7, 3, 5), (4096, 1024, 5), (50, 2, 200), (1, 1, 1)])
def test_products_are_brute_force(spark, tile, block, k):
    count = 30 if tile == 1 else 130
    rows = vector_rows(count, 6, seed=1) + [(200 + i, [0.0] * 6, 1) for i in range(6)]
    found = top_products(vector_table(spark, rows, 6), 10, k, 64, tile=tile, block=block).collect()
    assert Counter(tuple(r) for r in found) == brute_products(rows, 10, k, 64)


def test_products_of_many_lengths(spark):
    # lengths over five orders of magnitude: most tiles are never met
    draw = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(size=16) * 10 ** draw.uniform(-2, 3)], 0) for i in range(600)]
    found = top_products(vector_table(spark, rows, 16), 50, 5, 256, tile=64, block=4).collect()
    assert Counter(tuple(r) for r in found) == brute_products(rows, 50, 5, 256)


def test_bounds_drop_nothing():
    draw = np.random.default_rng(2)
    found = draw.integers(-99, 99, (2000, 24))
    found = found[np.argsort(-(found ** 2).sum(1), kind="stable")]
    queries, turn = draw.integers(-99, 99, (40, 24)), np.linalg.qr(draw.normal(size=(24, 24)))[0]
    best = search(queries, np.full(40, -1), np.full(40, -(1 << 62)), found, np.arange(2000), turn, 9)
    for q in range(40):
        want = sorted((-s, i) for i, s in enumerate((found @ queries[q]).tolist()))[:9]
        assert [(-s, i) for s, i in zip(best.score[best.query == q].tolist(), best.id[best.query == q].tolist())] == want


def test_products_of_nothing(spark):
    assert top_products(vector_table(spark, [], 4)).collect() == []
    alone = spark.createDataFrame([(50, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert top_products(alone).collect() == []
    unasked = spark.createDataFrame([(1, [1.0], 1), (None, [2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert top_products(unasked).collect() == []
    with pytest.raises(Exception, match="components in one table"):
        top_products(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)],
                                           "vec_id long, embedding array<float>, label int")).collect()
