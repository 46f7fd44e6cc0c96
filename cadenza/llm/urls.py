"""URL filtering with redirect equivalence. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, connected_components


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls: all canonical links and refresh redirects that the pages' html declares, relative ones resolved."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.col("url")
    attr = r"""\s*+=\s*+["']?+\s*+([^"'>\s]+)"""
    # what stands before each `>`, and of it what a tag opens: every pattern reads a piece once, also where no tag is closed
    pieces = F.split(html, ">")
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def tags(name: str, mark: str) -> Column:
        opened = F.transform(closed, lambda p: F.regexp_extract(p, rf"(?is)<{name}\b.*+", 0))
        return F.filter(opened, lambda t: t.rlike(mark))

    links = tags("link", r"""(?i)\brel\s*+=\s*+["']?+canonical\b""")
    metas = tags("meta", r"""(?i)\bhttp-equiv\s*+=\s*+["']?+refresh\b""")
    targets = F.concat(
        F.transform(links, lambda x: F.regexp_extract(x, rf"(?i)\bhref{attr}", 1)),
        F.transform(metas, lambda x: F.regexp_extract(x, rf"(?i)\burl{attr}", 1)),
    )
    found = pages.where(url.isNotNull()).select(url.alias("src"), F.explode(F.filter(targets, lambda t: t != "")).alias("to"))
    src, to = F.col("src"), F.regexp_replace("to", "&amp;", "&")
    site = F.regexp_extract(src, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(src, r"^[^:/?#]+://[^?#]*/", 0)
    absolute = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(src, r"^[^:/?#]+:", 0), to))
        .when(to.startswith("/"), F.concat(site, to))
        .otherwise(F.concat(F.when(folder.rlike("://[^/]"), folder).otherwise(F.concat(site, F.lit("/"))), to))
    )
    return found.select(without_fragment(src).alias("src"), without_fragment(absolute).alias("dst"))


def rule_for(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds host, path and the fitting rule with its verdict (null where none fits) to a frame with a url column.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's;
    the longest (host and path together, then the host) wins. The rule list is a configuration, not data: it
    becomes one CASE in that order, so no join is needed.
    """
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        at = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = at & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return urls.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, via) for every row of pages.

    A page's own rule decides. Without one, the page takes the decision of its aliases: the connected component
    over canonical links, refresh redirects and the optional redirects (src, dst) table, each url without its
    fragment, rules also judged for aliases that are no page. If any alias is explicitly allowed the component
    is allowed, else if any is blocked it is blocked, else `default` holds. via: rule, alias or default.

    Null or broken urls have empty host and path, no rule and no alias; null html has no links; repeated pages
    are judged alike, a row each; a page that links to itself adds nothing; empty tables give no rows. Extra
    columns are ignored. Components are found by star contraction over the edges only, never on the driver.
    """
    edges = link_edges(pages)
    if redirects is not None:
        pairs = redirects.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        edges = edges.union(pairs.select(without_fragment(F.col("src")), without_fragment(F.col("dst"))))
    members = connected_components(edges)
    judged = rule_for(members.withColumnRenamed("node", "url"), rules)
    by_component = judged.groupBy("component").agg(
        F.max(F.when(F.col("rule_verdict") == "allow", 1)).alias("allowed"),
        F.max(F.when(F.col("rule_verdict") == "block", 1)).alias("blocked"),
    )
    of_alias = F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block")
    decided = by_component.select("component", of_alias.alias("alias_verdict")).where(F.col("alias_verdict").isNotNull())
    alias = members.join(decided, "component").select(F.col("node").alias("alias_url"), "alias_verdict")
    own = rule_for(pages.select("page_id", "url"), rules).withColumn("alias_url", without_fragment(F.col("url")))
    out = own.join(alias, "alias_url", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "alias_verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("via"),
    )
