"""Allow and block rules for URLs, carried over to aliases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import connected_components

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct ``rule, verdict`` of the longest rule that fits, else NULL.

    A rule fits its host and all its subdomains, where the path starts with the
    rule's.  Of equally long rules an allow comes first.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    cases: list[Column] = []
    for verdict, rule_host, rule_path in order:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        cases.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule string, verdict string>")


def resolved(base: Column, link: Column) -> Column:
    """An absolute form of a link on a page: absolute, ``//host``, ``/path`` or relative to the page's folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    folder = F.when(F.regexp_replace(folder, r"(?s)^.*?://", "") == "", F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.isNull() | (link == ""), F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, link)))


def resource_of(url: Column) -> Column:
    """The URL a request is for: its host lowered and without what servers do not see or that only tracks
    (fragment and ``utm_`` parameters)."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, r"(?<=[?&])utm_[^=&]*=[^&]*&?", "")
    bare = F.regexp_replace(bare, r"[?&]$", "")
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    scheme = F.lower(F.regexp_extract(bare, r"(?s)^(.*?)://", 1))
    return F.when(bare.contains("://"), F.concat(scheme, F.lit("://"), host_of(bare), rest)).otherwise(bare)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``from, to`` of canonical links and immediate client redirects in the pages' heads."""
    page = F.col(html)
    link = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""
    targets = F.concat(F.regexp_extract_all(page, F.lit(link), 1), F.regexp_extract_all(page, F.lit(refresh), 1))
    return pages.select(F.col(url).alias("from"), F.explode(targets).alias("link")).select(
        "from", resolved(F.col("from"), F.regexp_replace("link", "&amp;", "&")).alias("to"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row.

    A URL with a rule has the rule's verdict.  For the others, URLs that are one
    resource, or are joined by canonical links, client redirects or rows
    ``from, to`` of ``redirects``, form components; within one, a blocked URL
    blocks those without a rule unless some URL of it is allowed by a rule.
    What no component decides is allowed.  URLs that are link targets only also
    bring their rules into a component.

    A NULL URL, or one without ``://``, has empty host and path, no rule, and is
    joined to nothing.  Ids, NULL or repeated, pass through; other columns are
    not read.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"), resource_of(F.col(url)).alias("node"))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    edges = [df.select(F.col("from").cast("string"), F.col("to").cast("string")) for df in (
        [page_links(pages, url, html)] if html else []) + ([redirects] if redirects is not None else [])]
    if edges:
        linked = stored(reduce(DataFrame.unionByName, edges).select(
            "from", "to", resource_of(F.col("from")).alias("a"), resource_of(F.col("to")).alias("b"))
            .where(F.col("a").contains("://") & F.col("b").contains("://")))
        roots = stored(connected_components(linked))
        ends = linked.select(F.explode(F.array(F.struct(F.col("from").alias("url"), F.col("a").alias("node")),
                                               F.struct(F.col("to").alias("url"), F.col("b").alias("node")))).alias("e"))
        ends = ends.select("e.url", "e.node").distinct()
        ruled = ends.select("node", rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("said"))
    else:
        roots, ruled = None, None
    of_rows = rows.where(F.col("url").contains("://")).select("node", F.col("own.verdict").alias("said"))
    said = (of_rows if ruled is None else of_rows.unionByName(ruled)).where("said IS NOT NULL")
    # one row per resource with a rule, then one per component
    said = said.groupBy("node").agg(F.max(F.col("said") == "allow").alias("allowed"))
    if roots is not None:
        rows = rows.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
        said = said.join(roots, "node", "left").select(F.coalesce("root", "node").alias("node"), "allowed")
        said = said.groupBy("node").agg(F.max("allowed").alias("allowed"))
    carried = said.select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("carried"))
    return rows.join(carried, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), "carried", F.lit("allow")).alias("verdict"))
