"""Main text of web pages: the contiguous region with the best score."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the language by what they mean for reading.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")
ASIDE = frozenset((
    "nav", "header", "footer", "aside", "form", "select", "option", "button", "fieldset", "dialog", "menu",
    "video", "audio", "canvas", "map", "head", "script", "style", "textarea", "title", "noscript",
    "template", "iframe", "svg", "xmp"))
# Elements that hold the page or its main part, whatever their attributes say.
FRAME = frozenset(("html", "body", "main", "article"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *RAW))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
# Elements whose end tag may be left out, by what else ends them, and where that stops.
ENDED_BY = {
    "p": (BLOCKS, frozenset(("button", "td", "th", "caption", "object"))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("table",))),
    "tr": (frozenset(("tr", "tbody", "tfoot")), frozenset(("table",)))}
STOPS = frozenset().union(*(stops for _, stops in ENDED_BY.values()))
# Words in class, id and role attributes that name what is not the article, as long as no
# labelled page shows otherwise; those that do so also in front of another word ("ad-slot"); and words
# that only tell of a state of the page ("has-sidebar").
LEADING_NAMES = frozenset((
    "ad", "ads", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie",
    "cookies", "disqus", "gdpr", "nav", "navbar", "newsletter", "popup", "promo", "sidebar", "sponsored"))
STATES = frozenset(("has", "with", "without", "no", "not", "is"))
SIDE_NAMES = frozenset((
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "header", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted", "related", "replies",
    "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget"))

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for name in RAW}
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CUT_TAG = re.compile(r"<(?:/?[a-zA-Z]|[!?])[^<>]*\Z")
WORD_PART = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Run:
    """Text between two tags and the tag before it."""

    # name and naming attributes, after / for an end and ~ inside something that is not the article
    tag: str
    text: str
    block: bool  # whether the tag starts a new block
    side: bool  # whether the text is inside something that is not the article
    names: tuple[str, ...] = ()  # names of the element that the tag opens


def _names(attributes: str) -> list[list[str]]:
    """The words of each name in class, id and role."""
    if "=" not in attributes:
        return []
    found = (WORD_PART.findall(name) for m in NAMED.finditer(attributes)
             for name in (m[1] or m[2] or m[3] or "").lower().split())
    return [parts for parts in found if parts]


def _aside(parts: list[str], names: dict[str, bool]) -> bool:
    """Whether a name says that its element is not the article.  ``names`` is what labelled pages say."""
    whole = "-".join(parts)
    if whole in names:
        return names[whole]
    if parts[0] in STATES:
        return False
    return names.get(parts[-1], parts[-1] in SIDE_NAMES) or names.get(parts[0], parts[0] in LEADING_NAMES)


def runs(page: str | None, names: dict[str, bool] | None = None) -> Iterator[Run]:
    """The page as tags with the text behind each.  NULL counts as empty.

    Scripts, styles and the like count as one tag; comments are no text.  A tag
    cut off by the end of the page is dropped; end tags that HTML lets one leave
    out are supplied.  What a name says does not count for elements around the
    page's first ``article`` or ``main``, nor does a form around it.
    """
    found = list(_runs(page, names or {}))
    around = {e for _, sides, _ in found for e in sides if e.holds}
    for run, sides, inside in found:
        run.side = any(e not in around for e in sides)
        if any(e not in around for e in inside) and run.tag[:1] != "~":
            run.tag = f"/~{run.tag[1:]}" if run.tag[:1] == "/" else f"~{run.tag}"
        yield run


class _Element:
    """An open element: its name and label, whether its names set it aside, and whether the main part is in it."""

    def __init__(self, name: str, label: str, by_name: bool):
        self.name, self.label, self.by_name, self.holds = name, label, by_name, False


def _runs(page: str | None, names: dict[str, bool]) -> Iterator[tuple[Run, tuple, tuple]]:
    """Runs, with the elements around their text and around their tag that are not the article."""
    page = page or ""
    cut = CUT_TAG.search(page)
    if cut:
        page = page[:cut.start()]
    at, tag, block, text, own, met = 0, "", True, [], (), False
    open_: list[_Element] = []
    sides: tuple[_Element, ...] = ()  # of those open
    inside: tuple[_Element, ...] = ()

    def closed() -> tuple[Run, tuple, tuple]:
        return Run(tag, "".join(text), block, False, own), sides, inside

    def close(element: _Element) -> None:
        nonlocal sides
        while open_:
            last = open_.pop()
            if sides and sides[-1] is last:
                sides = sides[:-1]
            if last is element:
                return

    while True:
        found = PIECE.search(page, at)
        text.append(page[at:found.start() if found else len(page)])
        if not found:
            yield closed()
            return
        at = found.end()
        end, name, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not name:
            continue  # comments join what they part
        yield closed()
        block, text, own, inside = name in BLOCKS, [], (), sides
        if end:
            tag = f"/{name}"
            opened = next((e for e in reversed(open_) if e.name == name), None)
            if opened:
                tag = "/" + opened.label
                close(opened)
            # the end of an element that is not the article lies outside of it
            inside = sides
        else:
            for e in list(reversed(open_)):
                if e.name in ENDED_BY and name in ENDED_BY[e.name][0]:
                    close(e)
                elif e.name in STOPS:
                    break
            inside = sides
            parts = _names(attributes)
            own = tuple("-".join(p) for p in parts)
            tag = name + "".join(f".{n}" for n in own)
            if name in ("article", "main") and not met and all(e.by_name or e.name == "form" for e in sides):
                met = True
                for e in sides:
                    e.holds = True
            if name not in VOID and not attributes.rstrip().endswith("/"):
                by_name = name not in ASIDE and name not in FRAME and any(_aside(p, names) for p in parts)
                open_.append(_Element(name, tag, by_name))
                if by_name or name in ASIDE:
                    sides = (*sides, open_[-1])
            if name in RAW_END:
                stop = RAW_END[name].search(page, at)
                at = stop.end() if stop else len(page)
                if open_ and open_[-1].name == name:
                    close(open_[-1])


@dataclass
class Weights:
    """Scores: a tag's cost, and what a word is worth behind a tag."""

    tags: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    unknown_tag: float = -0.25
    unknown_word: float = 1.0
    #: What labelled pages say of names: whether elements so named are not the article.
    names: dict[str, bool] = field(default_factory=dict)


#: A tag inside articles costs so little that even a paragraph of one word is worth its tags.
LEAST_COST = 0.01


def region(page: list[Run], weights: Weights) -> tuple[int, int]:
    """The runs [start, end) with the best sum of scores, found in one scan; of equals the first and shortest.

    A run is its tag, negative, and then its words, positive or, behind a tag
    that never stands before an article's words, nothing.
    """
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, run in enumerate(page):
        cost = weights.tags.get(run.tag, weights.unknown_tag)
        gain = 0.0 if run.side else len(run.text.split()) * weights.words.get(run.tag, weights.unknown_word)
        # a region starts at words, so the tag before them is not part of it
        if total + cost > 0:
            total += cost + gain
        else:
            total, start = gain, k
        if total > best:
            best, span = total, (start, k + 1)
    return span


def _text(page: list[Run], span: tuple[int, int]) -> str:
    blocks: list[list[str]] = [[]]
    for run in page[slice(*span)]:
        if run.block:
            blocks.append([])
        if run.tag in ("br", "/br"):
            blocks[-1].append(" ")
        if not run.side:
            blocks[-1].append(run.text)
    lines = (" ".join(references.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(page: str | None, weights: Weights) -> str:
    found = list(runs(page, weights.names))
    return _text(found, region(found, weights))


def learn_weights(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", element: str = "article", sample: int = 2000,
) -> Weights:
    """Weights from labelled pages: those with exactly one ``element``, whose words are the label.

    ``sample`` bounds them: the pages whose ids have the smallest hashes.  Per
    tag, its cost is the share of its uses outside the label, times the words
    of the longest labelled page: no stretch of words pays for a tag that only
    stands outside.  Tags within something that is not the article cost nothing
    much, as the tags around it do.  A word is worth the share of its tag's words
    that are inside.  Tags never seen cost a quarter of a word, and words behind
    them count.  Names that stand inside the label more often than not do not
    set an element aside, whatever they mean elsewhere; adverts and comments
    stay what they are.
    NULL pages and pages without the element teach nothing.
    """
    open_, close = f"<{element}", f"</{element}"
    labelled = (
        pages.select(F.col(page_id).alias("id"), F.col(html).alias("html"))
        .where((F.size(F.split(F.lower("html"), open_)) == 2) & F.lower(F.col("html")).contains(close))
        .withColumn("rank", F.xxhash64("id", "html")))
    border = labelled.select("rank").orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]
    if border is None:
        return Weights()
    labelled = labelled.where(F.col("rank") <= F.lit(border))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tags, inside_tags, words, inside_words = Counter(), Counter(), Counter(), Counter()
        names, inside_names = Counter(), Counter()
        longest = 0
        for frame in frames:
            for page in frame["html"]:
                inside, all_words = False, 0
                for run in runs(page):
                    name = run.tag.lstrip("/~").split(".")[0]
                    border = name == element
                    if border:
                        inside = not run.tag.startswith("/")
                    elif run.names:
                        names.update(set(run.names))
                        inside_names.update(set(run.names) if inside else ())
                    n = len(run.text.split())
                    all_words += n
                    tags[run.tag] += 1
                    inside_tags[run.tag] += inside and not border
                    if not run.side:
                        words[run.tag] += n
                        inside_words[run.tag] += n if inside else 0
                longest = max(longest, all_words)
        if tags:  # a task without a labelled page has nothing to say
            yield pd.DataFrame({
                "tag": list(tags), "n": list(tags.values()), "inside": [inside_tags[t] for t in tags],
                "words": [words[t] for t in tags], "inside_words": [inside_words[t] for t in tags],
                "longest": np.full(len(tags), longest), "name": False})
            yield pd.DataFrame({
                "tag": list(names), "n": list(names.values()), "inside": [inside_names[t] for t in names],
                "words": 0, "inside_words": 0, "longest": 0, "name": True})

    counted = labelled.select("html").mapInPandas(
        count, "tag string, n long, inside long, words long, inside_words long, longest long, name boolean")
    # distinct tags and names of a bounded sample
    found = counted.groupBy("tag", "name").agg(
        F.sum("n").alias("n"), F.sum("inside").alias("inside"), F.sum("words").alias("words"),
        F.sum("inside_words").alias("inside_words"), F.max("longest").alias("longest")).collect()
    longest = max((r["longest"] for r in found), default=0) + 1
    within = {r["tag"]: False for r in found if r["name"] and 2 * r["inside"] > r["n"]
              and r["tag"].split("-")[0] not in LEADING_NAMES and r["tag"].split("-")[-1] not in LEADING_NAMES}
    found = [r for r in found if not r["name"]]
    return Weights(
        {r["tag"]: -LEAST_COST - ("~" not in r["tag"]) * longest * (1 - r["inside"] / r["n"]) for r in found},
        {r["tag"]: r["inside_words"] / r["words"] for r in found if r["words"]}, names=within)


def extract_main_text(
    pages: DataFrame, weights: Weights, page_id: str = "page_id", html: str = "html", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``page_id``, the columns in ``keep``, and ``text``: blocks of the best region, joined by new lines.

    Character references are decoded, white space within a block becomes one
    space, empty blocks go.  NULL, empty or wordless pages give an empty text.
    Ids, NULL or repeated, pass through; other columns are not read.
    """
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, weights) for p in batch], dtype=object)

    return pages.select(F.col(page_id).alias("page_id"), *keep, run(F.col(html)).alias("text"))
