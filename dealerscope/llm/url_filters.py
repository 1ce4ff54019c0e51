"""URL rules whose block decisions spread over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import materialise
from dealerscope.llm.components import connected_components

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address that links compare: lower-cased scheme and host, path and query, no fragment."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    address = F.concat(scheme, F.lit("://"), host_of(url), path_of(url), query)
    return F.when(url.contains("://"), address)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does.

    A rule is (verdict, host, path). It fits its host and all subdomains if the path starts with
    the rule's. Rules are settings, held on the driver; of two rules of one length the one with
    the longer host wins. ``rules`` may be empty.
    """
    longest_first = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r), reverse=True)
    if not longest_first:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    listed = F.array(
        *[
            F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
            for v, h, p in longest_first
        ]
    )

    def fits(rule: Column) -> Column:
        return ((host == rule["host"]) | F.endswith(host, F.concat(F.lit("."), rule["host"]))) & F.startswith(path, rule["path"])

    best = F.get(F.filter(listed, fits), F.lit(0))
    return F.when(best.isNotNull(), F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["verdict"].alias("verdict")))


def _once(value: Column) -> Column:
    """The value as the one row of a list. A filter on it is not pushed below, where the optimiser would
    write its whole expression out once for each mention, more than the generated code can hold."""
    return F.explode(F.array(value))


def page_links(pages: DataFrame) -> DataFrame:
    """Canonical links and immediate redirects named in the pages' HTML: (a, b), both as nodes.

    ``<link rel="canonical" href=...>`` and ``<meta http-equiv="refresh" content="0; url=...">``.
    An address without scheme or host is taken relative to the page's. Null pages, broken
    addresses and links of a page to itself give no row.
    """
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1)))
    tags = pages.filter(F.col("html").rlike(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)")).select("url", tag.alias("tag"))
    canonical = F.when(
        F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""),
        F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    redirect = F.when(
        F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""),
        F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    found = tags.select("url", _once(F.replace(F.coalesce(canonical, redirect), F.lit("&amp;"), F.lit("&"))).alias("to")).filter("to <> ''")
    url, to = F.col("url"), F.col("to")
    parts = found.select(
        "to", node_of(url).alias("a"), F.regexp_extract(url, r"(?s)^(.*?)://", 1).alias("scheme"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    folder = F.regexp_extract("path", r"(?s)^(.*/)", 1)
    root = F.concat(F.col("scheme"), F.lit("://"), F.col("host"))
    rooted = parts.select("to", "a", "scheme", root.alias("root"), F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")).alias("folder"))
    target = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.col("scheme"), F.lit(":"), to))
        .when(to.startswith("/"), F.concat(F.col("root"), to))
        .otherwise(F.concat(F.col("root"), F.col("folder"), to))
    )
    pairs = rooted.select("a", _once(target).alias("target")).select("a", _once(node_of(F.col("target"))).alias("b"))
    return pairs.filter("a <> b").distinct()


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], links: DataFrame | None = None, default: str = "allow"
) -> DataFrame:
    """Every page row with (page_id, host, path, rule, verdict, inherited).

    A page that a rule fits gets the rule's verdict; that holds also for an allowed page among
    blocked aliases. Otherwise the page is an alias of all addresses in its connected component
    of redirects and canonical links (``links``: two columns of nodes; found in the HTML if not
    given), and is blocked if a rule blocks one of them, page or not; ``inherited`` says so. All
    other pages get ``default``. A null or broken URL has an empty host and path, no aliases and
    no rule. Repeated pages keep a row each; other columns are not read.
    """
    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("match", matched_rule(F.col("host"), F.col("path"), rules))
    edges = page_links(pages) if links is None else links
    members = connected_components(edges, *edges.columns[:2])
    explicit = matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    known = members.withColumn("verdict", explicit["verdict"])
    bad = known.filter("verdict = 'block'").select("component").distinct()
    blocked = materialise(known.filter("verdict IS NULL").join(bad, "component", "left_semi").select("node"))
    blocked = blocked.withColumn("inherited", F.lit(True))
    inherited = F.coalesce(F.col("inherited") & F.col("match").isNull(), F.lit(False))
    verdict = F.coalesce("match.verdict", F.when(inherited, "block").otherwise(default))
    return judged.join(blocked, "node", "left").select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), inherited.alias("inherited")
    )
