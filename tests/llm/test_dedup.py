"""Exact copies, SimHash and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from seriesmill.llm.components import connected_components
from seriesmill.llm.exact_dedup import drop_exact_copies, exact_groups
from seriesmill.llm.simhash import drop_near_copies, fingerprint, fingerprint_links, simhash_components

WHITE = re.compile(r"[\x20\x09-\x0D]")


def smallest(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        x, y = smallest(parent, a), smallest(parent, b)
        parent[max(x, y)] = min(x, y)
    return {n: smallest(parent, n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    links += [(500, k) for k in range(501, 600)] + [(7, 7), (3, None), (None, None)] + [(1, 2)] * 3
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == brute_components({n for e in real for n in e}, real)


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((i, t or ""))
    out = []
    for text, members in groups.items():
        order = sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        keep, taken = order[0], False
        for m in order:
            kept = (m[0], len(m[1])) == (keep[0], len(keep[1])) and not taken
            taken |= kept
            out.append((m[0], keep[0], len(members), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(odd_docs, no_docs, tables):
    for docs in (odd_docs, tables("documents"), no_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = sorted((tuple(r) for r in exact_groups(docs, salts=3).collect()), key=str)
        assert got == brute_exact(rows)


def test_exact_copies_are_dropped(odd_docs, no_docs, tables):
    for docs in (odd_docs, tables("documents"), no_docs):
        left = drop_exact_copies(docs)
        assert left.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept = sorted([(i, d) for i, _, _, k, d in brute_exact(rows) if k], key=str)
        got = sorted([(r["doc_id"], hashlib.sha256(WHITE.sub("", r["text"] or "").encode()).hexdigest())
                      for r in left.collect()], key=str)
        assert got == kept


def brute_fingerprint(text, shingle):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [words[k:k + shingle] for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(odd_docs, tables):
    texts = [r["text"] for r in odd_docs.collect()][:9] + [r["text"] for r in tables("documents").limit(30).collect()]
    for text in [*texts, "A b", "a B c d", "a b c d e É", "x\x1cy z w"]:
        assert fingerprint(text or "", 4) == brute_fingerprint(text, 4)


def test_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    values = {0, 1, 3, (1 << 64) - 1}
    for s in seeds.tolist():
        for _ in range(6):
            values.add(s)
            for _ in range(rng.integers(1, 5)):
                s ^= 1 << int(rng.integers(64))
    values = sorted(values)
    brute = brute_components(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1:]
                                      if (a ^ b).bit_count() <= 4])
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    # tiny tiles, so that most tiles have several chunks
    links = fingerprint_links(spark.createDataFrame(signed, "fp long"), 4, tile=3).collect()
    got = brute_components(values, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links])
    assert got == brute


def brute_simhash(rows):
    prints = {f: None for f in (brute_fingerprint(t, 4) for _, t in rows)}
    links = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    root = brute_components(prints, links)
    least = {}
    for i, t in rows:
        r = root[brute_fingerprint(t, 4)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in ((i, brute_fingerprint(t, 4)) for i, t in rows)),
                  key=str)


def test_simhash(odd_docs, no_docs, tables):
    for docs in (odd_docs.where("length(text) < 1000 OR text IS NULL"), tables("documents").where("n_chars < 1500"), no_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = sorted((tuple(r) for r in simhash_components(docs).collect()), key=str)
        assert got == brute_simhash(rows)


def test_near_copies_are_dropped(odd_docs, no_docs):
    docs = odd_docs.where("length(text) < 1000 OR text IS NULL")
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    winners = {c for _, _, c in brute_simhash([(r["doc_id"], r["text"]) for r in docs.collect()])}
    got = [r["doc_id"] for r in left.collect()]
    assert set(got) == winners
    assert got.count(1) == 1
    assert drop_near_copies(no_docs).count() == 0
    again = drop_near_copies(docs.where("doc_id = 7"))
    assert again.count() == 1


def test_near_copies_are_judged_by_row(spark):
    """Rows that share an id, or have none, stay or go by themselves."""
    words = [f"word{k}" for k in range(200)]
    first, near, other = " ".join(words), " ".join([*words, "end"]), " ".join(words[::-1])
    assert (brute_fingerprint(first, 4) ^ brute_fingerprint(near, 4)).bit_count() <= 4
    rows = [(1, first), (None, near), (None, other), (2, near), (2, "something else"), (3, other + " x"), (4, "z"),
            (None, "of no id at all"), (None, "of no id at all")]
    assert (brute_fingerprint(other, 4) ^ brute_fingerprint(other + " x", 4)).bit_count() <= 4
    left = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted(
        [(1, first), (2, "something else"), (3, other + " x"), (4, "z"), (None, "of no id at all")], key=str)


@pytest.mark.parametrize("hot", [10, 100_000])
def test_copies_without_ids_or_with_one(spark, hot, monkeypatch):
    """A third of all rows is one text without ids, some ids are on many rows: one row per text and id at most."""
    from seriesmill.llm import exact_dedup
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    rows = [(None, "hot text", 1)] * 400 + [(7, "other  text", 2)] * 100 + [(7, "other text", 3)] * 100
    rows += [(i, f"text {i}", 4) for i in range(100, 700)] + [(None, "hot  text", 5)] * 2 + [(i, "copied", 6) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(7)
    found = exact_dedup.exact_groups(docs).collect()
    assert len(found) == len(rows)
    kept = sorted(((r["doc_id"], r["group_size"]) for r in found if r["kept"]), key=str)
    assert kept == sorted([(None, 402), (7, 200), (0, 50), *[(i, 1) for i in range(100, 700)]], key=str)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(
        [(None, "hot  text"), (7, "other  text"), (0, "copied"), *[(i, f"text {i}") for i in range(100, 700)]], key=str)


def test_hot_copies_spread_over_salts(spark):
    """Rows that agree in id and text are dealt to all salts alike."""
    from pyspark.sql import functions as F
    rows = spark.range(32000).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).alias("salt"))
    sizes = [r["count"] for r in rows.groupBy("salt").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.2 * 2000
