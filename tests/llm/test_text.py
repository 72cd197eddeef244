"""Toxicity, quality, decontamination, page text and URL rules."""

import html as references
import itertools
import random
import re

import numpy as np
import pytest

from seriesmill.llm import decontaminate as D
from seriesmill.llm import queries
from seriesmill.llm.decontaminate import Templates, contaminated, drop_contaminated
from seriesmill.llm.html_text import Weights, extract_main_text, learn_weights, main_text, region, runs
from seriesmill.llm.quality import co_train, drop_low_quality, feature_table, quality_scores
from seriesmill.llm.toxicity import Lexicon, Matcher, folded, learn_lexicon, toxicity
from seriesmill.llm.url_filter import judge_urls

BIG = "/root/testdata/sf0.01"


# ---- toxicity -------------------------------------------------------------------------

def test_disguises():
    assert folded("You 1d10t, yоu ＩＤＩＯＴ! id­iot 5cum") == ["you", "idiot", "you", "idiot", "idiot", "scum"]
    assert folded(None) == folded("") == []


def test_matching_is_brute_force_matching():
    rng = random.Random(3)
    lexicon = Lexicon({"idiot": 2.0, "los": 1.0, "loser": 3.0, "clow": 1.5}, ["clown fish", "loses"], half=0.1)
    matcher = Matcher(lexicon)
    words = ["idiot", "idiotic", "loser", "ioser", "lost", "loses", "clown", "fish", "a", "the", "xidiot"]
    forms = {**lexicon.weights, "ios": 1.0, "ioser": 3.0, "ciow": 1.5}
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        expected = 0.0
        for k, w in enumerate(text):
            spared = w == "loses" or [*text, ""][k:k + 2] == ["clown", "fish"]
            if not spared:
                expected += max((v for s, v in sorted(forms.items(), key=lambda x: len(x[0])) if w.startswith(s)),
                                default=0.0, key=lambda v: v)
        assert matcher.density(text)[0] == pytest.approx(expected / len(text) if text else 0.0)


def test_exceptions_are_learnt(spark):
    rows, labels = [], []
    for k in range(120):
        toxic = k % 4 == 0
        text = f"filler{k} more words " + ("grumpf you" if toxic else "plain") + (" zzgrum" if toxic else " ok")
        if not toxic and k % 3 == 0:
            text += " grumpf island is nice"
        rows.append((k, text))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = learn_lexicon(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zzgrum" in lexicon.weights
    assert not any("plain".startswith(s) for s in lexicon.weights)


def test_documents_that_share_a_word_all_teach(spark):
    """Only copies are no new evidence; one common long word makes no copies."""
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(60):
        # the same least and largest word of eight letters or more in every text
        words = ["everywhere", "something", *(f"w{rng.randrange(5000)}" for _ in range(30))]
        rows.append((k, " ".join([*words, "blargh" if k % 3 == 0 else "fine"])))
        labels.append((k, int(k % 3 == 0)))
    schema = "doc_id long, text string"
    lexicon = learn_lexicon(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("blargh".startswith(s) for s in lexicon.weights)
    # twenty copies of one toxic text are one text, which is too little evidence
    copies = [(k, rows[0][1]) if k % 3 == 0 else rows[k] for k in range(60)]
    lexicon = learn_lexicon(spark.createDataFrame(copies, schema), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not any("blargh".startswith(s) for s in lexicon.weights)


def test_held_out_toxicity(spark):
    docs, labels = queries.table(spark, BIG, "documents"), queries.table(spark, BIG, "labels")
    found = queries.op1_toxicity(spark, BIG).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["toxic"]).mean() >= 0.93
    assert ((found["predicted"] == 1) & (found["toxic"] == 0)).sum() == 0
    assert docs.count() == queries.op1_toxicity(spark, BIG).count()


def test_odd_toxicity(odd_docs, no_docs, odd_labels):
    lexicon = learn_lexicon(odd_docs, odd_labels)
    assert lexicon.weights
    found = toxicity(odd_docs, lexicon).collect()
    assert len(found) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert toxicity(no_docs, learn_lexicon(no_docs, odd_labels.limit(0))).count() == 0


# ---- quality --------------------------------------------------------------------------

def test_quality_on_rows_never_learnt(spark):
    docs, labels = queries.table(spark, BIG, "documents"), queries.table(spark, BIG, "labels")
    learnt = labels.where("crc32(cast(doc_id as string)) % 4 != 2")
    found = quality_scores(docs, learnt).join(
        labels.where("crc32(cast(doc_id as string)) % 4 = 2"), "doc_id").toPandas()
    assert ((found["score"] >= 0.5) == (found["quality"] == 1)).mean() >= 0.95
    assert ((found["score"] < 0.5) & (found["quality"] == 1)).mean() <= 0.02


def test_views_agree_with_the_filter(tables):
    docs, labels = tables("documents"), tables("labels")
    scores = {r["doc_id"]: r["keep"] for r in quality_scores(docs, labels).collect()}
    left = drop_low_quality(docs, labels)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, k in scores.items() if k}


def test_odd_quality(odd_docs, no_docs, odd_labels):
    found = quality_scores(odd_docs, odd_labels).collect()
    assert len(found) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 for r in found)
    assert drop_low_quality(odd_docs, odd_labels).columns == odd_docs.columns
    # nothing known: everything stays
    assert drop_low_quality(odd_docs, odd_labels.limit(0)).count() == odd_docs.count()
    assert quality_scores(no_docs, odd_labels).count() == 0
    assert co_train(feature_table(odd_docs.select("doc_id", "text")), odd_labels).content is not None


# ---- decontamination ------------------------------------------------------------------

def test_leaks_are_those_of_brute_force(spark):
    docs = queries.table(spark, BIG, "documents").collect()
    items = queries.table(spark, BIG, "benchmark").collect()

    def flat(text):
        return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "

    texts = {i["item_id"]: flat(i["text"]) for i in items}
    expected = {(d["doc_id"], i) for d in docs for i, t in texts.items() if t in flat(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontaminate(spark, BIG).collect()}
    assert got == expected
    assert expected


ITEM = "Then Alice buys 12 apples and 30 pears for 7 dollars while Bob sells 12 melons to her friend Alice today."


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_changed_slots(spark, sent):
    other = "Then Carol buys 15 apples and 40 pears for 9 euros while Dan sells {} melons to her friend {} today."
    docs = spark.createDataFrame([
        (1, "Intro words here. " + ITEM + " bye"), (2, other.format(15, "Carol")), (3, other.format(99, "Erin")),
        (4, ITEM.lower()), (5, ITEM.upper()), (6, " ".join(ITEM.split()[:9])), (7, None), (8, ""), (None, ITEM),
        (9, ITEM), (9, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "go on"), (4, "quite short text")],
                                  "item_id long, text string")
    found = contaminated(docs, items, sent=sent).collect()
    got = {r["doc_id"]: (r["item_id"], r["changed"]) for r in found}
    assert got == {1: (1, False), 2: (1, True), 4: (1, False), 5: (1, False), None: (1, False), 9: (1, False)}
    assert len(found) == 6
    left = drop_contaminated(docs, items, sent=sent).collect()
    assert sorted(r["doc_id"] for r in left) == [3, 6, 7, 8]


def test_odd_decontamination(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "same text here for all"), (None, "other words that are nowhere")],
                                  "item_id long, text string")
    found = {r["doc_id"] for r in contaminated(odd_docs, items).collect()}
    assert found == {1, 2, 3, 7, None}
    assert drop_contaminated(odd_docs, items).columns == odd_docs.columns
    assert contaminated(no_docs, items).count() == 0
    assert contaminated(odd_docs, items.limit(0)).count() == 0
    assert drop_contaminated(odd_docs, items.limit(0)).count() == odd_docs.count()


ATTACHED_FORMS = [
    ("$12", "$15"), ("20%", "35%"), ("12€", "9€"), ("£1,200.50", "£7"), ("5km", "12miles"), ("10th", "21st"),
    ("three", "eleven"), ("twenty-one", "7"), ("$ 12", "€ 15"), ("5-year", "12-year"), ("10-15kg", "20-25lbs"),
    ("30°C", "4°F"), ("$12.", "€9.")]


def test_attached_signs_and_units(spark):
    """A change at two places that stand apart, in every form a number can have."""
    text = ("the price was about {0} when all of them came back and then it rose over time until they had to pay {0} "
            "for the very same thing on the next market day near here")
    docs, items = [], []
    for k, (ours, theirs) in enumerate(ATTACHED_FORMS):
        items.append((k, text.format(ours)))
        docs += [(3 * k, text.format(theirs)), (3 * k + 1, text.format(ours)), (3 * k + 2, text.format("what"))]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["changed"]) for r in found}
    for k, form in enumerate(ATTACHED_FORMS):
        assert got.get((3 * k, k)) == (1.0, True), form
        assert got.get((3 * k + 1, k)) == (1.0, False), form
    assert not any(d % 3 == 2 for d, _ in got)


def test_words_with_numbers():
    templates = Templates(5)

    def shown(text):
        places, types = templates.read(text)
        return " ".join(templates.window_at(places, types, 0, len(places), 0)[0].split())

    assert shown("pay ($12), 20%. then 5km or 10th and three days") == (
        "pay <unit> <num> <num> <unit> then <num> <unit> or <num> and <num> <unit>")
    assert shown("in 2020-2021 the 12-year-old mp3 for us$5m") == (
        "in <num> <num> the <num> year-old mp3 for <unit> <num> <unit>")
    assert shown("") == shown("- $ -").replace("$", "")


NAME_FORMS = [
    ("Tom has some apples left. Tom buys many more apples than before. Tom then gives them to his mother at home.",
     "Anna has some apples left. Anna buys many more apples than before. Anna then gives them to his mother at home."),
    ("we saw a Toyota on the road and then a Toyota was seen near the old bridge over there again today",
     "we saw a Honda on the road and then a Honda was seen near the old bridge over there again today"),
    ("he came back on 5 May to see what was left of it and then left on 7 May without any of it again",
     "he came back on 12 May to see what was left of it and then left on 31 May without any of it again"),
    ("the sum of 3 4 5 6 7 8 9 10 11 12 is what they were all asked to find before noon",
     "the sum of 5 6 7 8 9 10 11 12 13 14 is what they were all asked to find before noon"),
    ("She ran home. Tom was there first of all. Then it rained and nobody else was seen around here",
     "as told she ran home. Bob was there first of all. Then it rained and nobody else was seen around here"),
]


def test_names_that_open_sentences(spark):
    schema = "doc_id long, text string"
    docs = [(k, theirs) for k, (_, theirs) in enumerate(NAME_FORMS)]
    docs += [(10 + k, ours) for k, (ours, _) in enumerate(NAME_FORMS)]
    docs += [(20, NAME_FORMS[0][1].replace("Anna then", "Berta then").replace("Anna buys", "Carl buys"))]
    items = spark.createDataFrame([(k, ours) for k, (ours, _) in enumerate(NAME_FORMS)], "item_id long, text string")
    found = contaminated(spark.createDataFrame(docs, schema), items).collect()
    got = {r["doc_id"]: (r["item_id"], r["covered"], r["changed"]) for r in found}
    # the places of names must agree, so the last one is no copy
    assert got == {k: (k, 1.0, True) for k in range(5)} | {10 + k: (k, 1.0, False) for k in range(5)}


SPARSE = [
    ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 is the sum", "3 4 5 is the sum",
     "4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 is the sum"),
    ("then Ann Bob Carl Dan Eve Fay Gus Hal Ida Jon Kim Leo Max Otto Tom are the friends", "so Max Otto Tom are the friends",
     "then Abe Ben Cid Don Eli Fox Gil Hue Ian Jim Kay Lou Moe Ned Pam are the friends"),
    ("Table 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 and the rest", "14 15 16 and the rest",
     "Table 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 and the rest"),
]


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_items_of_little_but_numbers_and_names(spark, sent):
    """A short common phrase is no leak of a long list; the whole list with other numbers is one."""
    items = spark.createDataFrame([(k, item) for k, (item, _, _) in enumerate(SPARSE)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(10 * k + j, f"what follows here is new: {text}. nothing of it was ever seen before")
         for k, (item, clean, changed) in enumerate(SPARSE) for j, text in enumerate((item, clean, changed))],
        "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["changed"] for r in contaminated(docs, items, sent=sent).collect()}
    assert found == {(10 * k + j, k): j == 2 for k in range(3) for j in (0, 2)}


def test_a_phrase_that_all_share(spark):
    """Windows that every document and item has lead to no pairs; leaks are found all the same."""
    phrase = "please read all of the following words before the answer is given"
    rng = random.Random(3)
    tails = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    items = spark.createDataFrame([(k, f"{phrase} {tail}") for k, tail in enumerate(tails)], "item_id long, text string")
    docs = [(k, f"{phrase} and nothing else {k}") for k in range(300)]
    docs += [(1000 + k, f"intro {phrase} {tail} outro") for k, tail in enumerate(tails)]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1000 + k, k) for k in range(40)}


def test_readings_are_all_readings():
    rng = random.Random(8)
    templates = Templates(5)
    for _ in range(100):
        words = [rng.choice(["Tom", "Ann.", "it", "was.", "3", "km", "so"]) for _ in range(rng.randint(5, 12))]
        places, types = templates.read(" ".join(words))
        if len(places) < 5:
            continue
        seen, hashes = [], {}
        for reading, at, values in templates.hashed(places, types, 5):
            for a, h in zip(at.tolist(), values.tolist(), strict=True):
                shown, _ = templates.window_at(places, types, a, 5, reading)
                seen.append((a, reading >= 0, shown))
                assert hashes.setdefault(shown, h) == h
        expected = []
        for a in range(len(places) - 4):
            plain = [templates.words[p] for p in places[a:a + 5]]
            expected.append((a, False, " ".join(plain)))
            choices = [[w, "<name>"] if t == 4 else [w if t == 0 else ("", "<num>", "<name>", "<unit>")[t]]
                       for w, t in zip(plain, types[a:a + 5].tolist(), strict=True)]
            for shown in itertools.product(*choices):
                if 1 <= sum(w[0] == "<" for w in shown) <= 3:
                    expected.append((a, True, " ".join(shown)))
        assert sorted(seen) == sorted(expected)


def _read_slowly(templates, text):
    """Places and types word by word."""
    places = []
    for raw in (text or "").replace("\n", " . ").split():
        places += templates.parts.get(templates.places[raw], [templates.places[raw]])
    flags = [int(templates.flags[p]) for p in places]
    start, kept = True, []
    for place, f in zip(places, flags, strict=True):
        if not f & D.EMPTY:
            kept.append((place, f, start))
        start = bool(f & D.ENDS) or start and bool(f & D.EMPTY)
    types = []
    for k, (_, f, start) in enumerate(kept):
        after = k > 0 and kept[k - 1][1] & D.DIGITS
        before = k + 1 < len(kept) and kept[k + 1][1] & D.DIGITS
        if f & D.DIGITS:
            types.append(D.NUM)
        elif f & D.SIGN and (before or after) or f & D.MEASURE and after:
            types.append(D.UNIT)
        else:
            types.append((D.MAYBE if start else D.NAME) if f & D.CAPITAL else 0)
    return [p for p, _, _ in kept], types


def test_texts_read_at_once_are_read_alone():
    """Types of all words, and every window that an item has, whatever texts stand beside and whichever words share a place."""
    rng = random.Random(5)
    words = ["Tom", "Ann.", "it", "was.", "3", "km", "so", "—", "...", "$5", "10-15kg,", "É.", "Éva", "İstanbul", "ΟΔΟΣ",
             "ы", "Яна!", "A", "A.", "ß", "x..", "ª", "÷", "中文。", "STRASSE", "Ǆabc", "Žena", "žena", "McTom", "$", "€", "It", "Was"]
    spaces = [" ", " ", " ", "\n", "  ", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000"]
    texts = ["".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", " ", "\n", " It was", "Tom"]
    items = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(20)]
    texts += [f"{rng.choice(texts)} {item} {rng.choice(texts)}" for item in items] + items
    rng.shuffle(texts)

    def windows(templates, places, types):
        out = {}
        for reading, at, hashes in templates.hashed(places, types, 5):
            for a, h in zip(at.tolist(), hashes.tolist(), strict=True):
                out[a, reading] = (*templates.window_at(places, types, a, 5, reading), h)
        return out

    alone = Templates(5)
    known, shown = set(), set()
    for item in items:
        for (_, reading), (window, _, _) in windows(alone, *alone.read(item)).items():
            shown.add(window)
            known |= set(window.split(" ")) if reading < 0 else set()
    pairs = {pair for window in shown for pair in itertools.pairwise(window.split(" "))}
    known.discard("tom")  # so that a name shares its place
    together = Templates(5, frozenset(known), sorted(pairs))
    places, types, written = together.read_all(texts)
    ends = [-1, *(k for k, p in enumerate(places.tolist()) if p == D.BREAK)]
    assert len(ends) == len(texts) + 1
    assert (places < D.BREAK).any()
    for a in np.flatnonzero(places != D.BREAK).tolist():
        together.tell(places, a, 1, written)
    got = windows(together, places, types)
    met = 0
    for text, before, end in zip(texts, ends, ends[1:], strict=False):
        expected, kinds = _read_slowly(alone, text)
        assert types[before + 1:end].tolist() == kinds, text
        for place, other, kind in zip(places[before + 1:end].tolist(), expected, kinds, strict=True):
            if kind or together.words[place]:
                assert together.words[place] == alone.words[other]
        for (a, reading), window in windows(alone, *alone.read(text)).items():
            if window[0] in shown and "tom" not in window[0].split(" "):
                assert got[before + 1 + a, reading] == window
                met += 1
    assert met > 300


def test_words_that_no_item_has_take_no_place():
    """Neither in small letters nor as names: a task keeps and looks up each of the others once per AT_ONCE characters."""
    templates = Templates(5, frozenset({"the", "of"}), [("the", "of")])
    before = len(templates.words)
    names = ["".join(letters) for letters in itertools.product("Bcd", "efg", "hij", "klm")]
    templates.read(" ".join(w + mark for w in names for mark in ("", ",", ".", "!")))
    assert len(templates.words) == before
    templates.read("the old house of Tom")
    assert {w for w in templates.words if w} == {"the", "of"}


def test_texts_go_by_size_not_by_number():
    texts = ["a" * 1_500_000] * 3 + [None, "", "b" * 9_000_000, "c"]
    cut = list(D._at_once(texts))
    assert [t for some in cut for t in texts[some]] == texts
    assert [sum(len(t or "") for t in texts[some]) for some in cut] == [3_000_000, 1_500_000, 9_000_000, 1]
    assert list(D._at_once([])) == []


def test_clean_rows_stay_whatever_their_id(odd_docs, spark):
    items = spark.createDataFrame([(1, "same text here for all")], "item_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in drop_contaminated(odd_docs, items).collect()), key=str)
    expected = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert (None, None) in left
    assert left == sorted(((i, t) for i, t in expected if not (t or "").split()[:2] == ["same", "text"]), key=str)
    docs = spark.createDataFrame([(1, "same text here for all"), (1, "clean"), (None, "same text here for all"),
                                  (None, "clean too")], "doc_id long, text string")
    assert {r["text"] for r in drop_contaminated(docs, items).collect()} == {"clean", "clean too"}


# ---- pages ----------------------------------------------------------------------------

def marked(page):
    """The words of the pages' own article element, by their markup."""
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not found:
        return ""
    inner = re.sub(r"<br>", " ", re.sub(r"<[^>]*$", "", found[1]))
    blocks = (references.unescape(re.sub(r"</?b>", "", b)).split() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(" ".join(b) for b in blocks if b)


def test_text_of_the_pages(spark, tables):
    for sf in (BIG, "/root/testdata/sf0.001"):
        pages = {r["page_id"]: r["html"] for r in queries.table(spark, sf, "pages").collect()}
        for r in queries.op3_html_text(spark, sf).collect():
            assert r["text"] == marked(pages[r["page_id"]])
            assert r["n_chars"] == len(r["text"])


ARTICLE = "<article><h1>Head line</h1><p>one two three</p><p>four five six</p></article>"
BODY = "Head line\none two three\nfour five six"
FORMS = {
    f"<body class='has-sidebar'>{ARTICLE}</body>": BODY,
    f"<body class='has-sidebar'><nav>menu here</nav><main class='with-sidebar'>{ARTICLE}</main></body>": BODY,
    f"<div id='page' class='no-header'>{ARTICLE}</div>": BODY,
    f"<div class='widget'>{ARTICLE}<div class='comments'>what a page</div></div>": BODY,
    f"<form action='x'>{ARTICLE}<input name='q'></form>": BODY,
    f"{ARTICLE}<div class='comments'><article>first comment here</article></div>": BODY,
    "<article><p>a b c<ins>new</ins> and <label>this</label> <math>x y</math> d</article>": "a b cnew and this x y d",
    "<article><p>a b c<p class='ad'>buy this now<p>d e f</article>": "a b c\nd e f",
    "<article><p>a b c</p><div class='social-history'><p>d e f</p></div><div class='ad-slot x y z'>g h</div></article>":
        "a b c\nd e f",
    "<article><ul><li>a b<li>c d<ul><li>e f</ul><li>g h</ul></article>": "a b\nc d\ne f\ng h",
    "<article><p class='one two three four sponsored'>a b c</p><p>d e f</p></article>": "d e f",
    "<article><table><tr><td>a b<td>c d<tr><td>e f</table></article>": "a b\nc d\ne f",
}


@pytest.mark.parametrize("page", sorted(FORMS))
def test_forms_of_pages(page):
    """Names of the page's state, elements around the article, and end tags that are left out."""
    assert main_text(page, Weights({"nav": -9.0, "/nav": -9.0}, {})) == FORMS[page]


def test_names_are_learnt_from_labelled_pages(spark):
    page = "<div class='menu'>home {0} there</div><article><p>{0} b c</p><div class='header'><p>d e f</p></div></article>"
    more = "<div class='header'>not read</div>"
    pages = [(i, page.format(f"w{i}") + (more if i < 2 else "")) for i in range(9)]
    pages += [(9, None), (10, "<article>cut"), (11, "<article><p class='ad'>buy</p><p>x y z</p></article>")]
    weights = learn_weights(spark.createDataFrame(pages, "page_id long, html string"))
    assert weights.names == {"header": False}
    assert main_text(page.format("w"), weights) == "w b c\nd e f"


def test_best_region_is_the_best_of_all():
    rng = random.Random(4)
    weights = Weights({"p": -0.01, "div": -3.0, "a": -1.0}, {"p": 1.0, "a": 0.2, "div": 0.5}, -0.25, 1.0)
    for _ in range(200):
        page = "".join(f"<{rng.choice(['p', 'div', 'a', 'b'])}>" + "w " * rng.randint(0, 4) for _ in range(rng.randint(0, 12)))
        found = list(runs(page))

        def score(a, b, found=found):
            words = sum(len(r.text.split()) * weights.words.get(r.tag, 1.0) for r in found[a:b])
            return words + sum(weights.tags.get(r.tag, -0.25) for r in found[a + 1:b])

        best = max((score(a, b) for a in range(len(found)) for b in range(a + 1, len(found) + 1)), default=0.0)
        a, b = region(found, weights)
        assert (score(a, b) if b > a else 0.0) == pytest.approx(max(best, 0.0))


def test_parts_of_a_page(tables):
    weights = learn_weights(tables("pages"))
    page = (
        "<html><head><title>T x y</title></head><body><nav><a href='/a'>One two</a></nav><main><article>"
        "<h1>Title &amp; more</h1><p>Hello <b>bold</b>, text&nbsp;here is\n long.<br>next</p><aside>Side note</aside>"
        "<div class='comments'><p>bad comment one two</p></div><!-- <p>no</p> --><p>Second &lt;p&gt; &#233;para.</p>"
        "<form><label>Name</label><input></form><script>if (a < b) {'</p>'}</script><p>Third and last one</p></article></main>"
        "<div class='sidebar'>Side bar words here many</div><footer>foot words</footer>")
    assert main_text(page, weights) == "Title & more\nHello bold, text here is long. next\nSecond <p> épara.\nThird and last one"
    for odd, text in ((None, ""), ("", ""), ("only text", "only text"), ("<p>", ""), ("<p>a</p", "a"), ("a &am", "a &am"),
                      ("<script>x", ""), ("<p>one</p></b></p>", "one"), ("a < b > c", "a < b > c")):
        assert main_text(odd, weights) == text, odd


def test_odd_pages(spark, tables):
    rows = [(1, "u", None, 1), (None, None, "", 2), (1, "u", "<p>a b</p>", 3), (2, "u", "<p>" + "long " * 200_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = extract_main_text(pages, learn_weights(pages), keep=("url",)).collect()
    assert sorted(len(r["text"]) for r in found) == [0, 0, 3, 999_999]
    assert extract_main_text(pages.limit(0), Weights()).count() == 0


def test_tasks_without_a_labelled_page(tables):
    pages = tables("pages").limit(3)
    assert learn_weights(pages.repartition(9)) == learn_weights(pages)


# ---- URLs -----------------------------------------------------------------------------

def test_aliases(spark):
    def head(link):
        return f'<html><head><link href="{link}" rel="canonical"></head><body>x</body></html>'

    rows = [
        (1, "http://a.bad.net/x", None), (2, "http://other.com/y", head("http://a.bad.net/x")),
        (3, "http://third.com/", '<meta http-equiv="refresh" content="0; url=http://other.com/y">'),
        (4, "http://third.com/#top", None), (5, "http://free.com/", None),
        (6, "http://m.example.net/en/1", head("http://a.bad.net/x2")), (7, "http://a.bad.net/x2?utm_source=f", None),
        (8, "http://follows.com/", head("http://m.example.net/en/1")), (9, None, None), (10, "nothing", head("http://a.bad.net/x")),
        (11, "HTTP://BAD.Net?q", None), (12, "http://bad.net.com/", None), (13, "http://example.com/de", None),
        (14, "http://example.com/de/a", head("/fr/b")), (15, "http://example.com/fr/b", None), (1, "http://a.bad.net/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, queries.RULES).collect()}
    assert found[1] == ("a.bad.net", "/x", "net/", "block")
    assert [found[k][3] for k in (2, 3, 4, 5)] == ["block", "block", "block", "allow"]
    assert found[6][2:] == ("example.net/en/", "allow")
    assert found[7][2:] == ("net/", "block")
    # the component has an allowed and a blocked URL: the allow comes first where no rule speaks
    assert found[8][2:] == (None, "allow")
    assert found[9] == ("", "", None, "allow") and found[10] == ("", "", None, "allow")
    # a rule's path is a prefix of the URL's, which is empty here
    assert found[11] == ("bad.net", "", None, "allow")
    assert found[12][3] == "allow" and found[13][2:] == (None, "allow")
    assert found[14][2:] == ("example.com/de/", "block") and found[15][2:] == (None, "block")
    assert judge_urls(pages, queries.RULES).count() == len(rows)
    assert judge_urls(pages.limit(0), queries.RULES).count() == 0
    more = spark.createDataFrame([("http://free.com/", "http://a.bad.net/x"), (None, "x")], "from string, to string")
    verdicts = {r["page_id"]: r["verdict"] for r in judge_urls(pages, queries.RULES, redirects=more).collect()}
    assert verdicts[5] == "block"
