"""URL block and allow rules, carried to aliases over redirect and canonical-link edges. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What of a page's source declares nothing: comments, and elements whose content is no markup.
SILENT = r"(?is)<!--.*?-->|<(script|style|template|textarea|noscript|title)\b.*?</\1\s*>"
CANONICAL = r"""(?is)<link\s(?:[^>]*\s)?rel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\s(?:[^>]*\s)?http-equiv\s*=\s*["']?refresh\b[^>]*>"""
BASE = r"(?is)<base\s[^>]*>"
HREF = r"""(?is)[\s"']href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.substring_index(url, "://", 1)
    tail = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(rest) + F.lit(4)))
    return F.coalesce(F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    rest = F.substring_index(url, "://", 1)
    tail = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(rest) + F.lit(4)))
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, rule, rule_verdict) for each distinct host and path of ``urls`` that a rule fits.

    A rule (verdict, host, path) fits its host and its subdomains if the path starts with the rule's. The longest that fits
    wins (by host and path together); of equally long ones an allow, then the smallest. Hosts meet the rules by an equality
    join over their suffixes, of as many labels as rules have at most, and the best rule is a partial-aggregated maximum;
    so it is one way for any number of rules.
    """
    table = urls.sparkSession.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "h string, p string, r string, v string")
    parts, labels = F.split("host", r"\."), max((h.count(".") + 1 for _, h, _ in rules), default=1)
    ends = F.filter(F.array(*[F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n))) for n in range(1, labels + 1)]), lambda h: h.isNotNull())
    hits = urls.select("host", "path", F.explode(ends).alias("h")).join(table, "h").where(F.startswith(F.col("path"), F.col("p")))
    rank = F.struct((-F.length("r")).alias("n"), (F.col("v") != "allow").alias("b"), "r", "v")
    return hits.groupBy("host", "path").agg(F.min(rank).alias("m")).select("host", "path", F.col("m.r").alias("rule"), F.col("m.v").alias("rule_verdict"))


def without_dots(path: Column) -> Column:
    """The path without its ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    whole = F.concat_ws("/", F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(F.lit("/"), whole))).otherwise(path)


def resolve(link: Column, host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path of a link on a page of the given host and path; empty for links of other kinds (mailto and the like)."""
    link = F.regexp_replace(F.trim(link), "&(?:amp|#38|#x26);", "&")
    scheme, absolute = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    full = F.concat(F.lit("x"), F.regexp_replace(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "://"))
    bare = F.regexp_extract(link, r"^[^?#]*", 0)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    own = F.when(bare == "", path).when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare))
    to_host = F.when(absolute, host_of(full)).when(scheme, F.lit("")).otherwise(host)
    return to_host, F.when(absolute, without_dots(path_of(full))).when(scheme, F.lit("")).otherwise(without_dots(own))


def declared_links(pages: DataFrame) -> DataFrame:
    """Edges (src_host, src_path, dst_host, dst_path) of the canonical links and meta refreshes that the pages' HTML declares.

    The first of either counts. Those in comments, scripts and the like declare nothing; relative ones go by the page's
    base, if it has one. A base and a link cost one pass over the HTML of the pages that hold such words at all.
    """
    has = F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv\s*=\s*[\"']?refresh")
    seen = pages.where(has).select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.regexp_replace("html", SILENT, " ").alias("s")).where("h != ''")
    href = lambda tag: F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)])
    links = F.array(href(F.regexp_extract("s", CANONICAL, 0)), F.regexp_extract(F.regexp_extract("s", REFRESH, 0), TARGET, 1))
    found = seen.select("h", "p", href(F.regexp_extract("s", BASE, 0)).alias("base"), F.explode(links).alias("link")).where("link != ''")
    base_host, base_path = resolve(F.col("base"), F.col("h"), F.col("p"))
    found = cut(found.select("h", "p", "link", base_host.alias("bh"), base_path.alias("bp")), "links")
    to_host, to_path = resolve(F.col("link"), F.col("bh"), F.col("bp"))
    return found.select(F.col("h").alias("src_host"), F.col("p").alias("src_path"), to_host.alias("dst_host"), to_path.alias("dst_path")).where("dst_host != ''")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, variants: bool = False) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html) with host, path, rule and verdict.

    Nodes are host + path (scheme, query and fragment do not tell resources apart). Edges are the given ``redirects``
    (src, dst URLs), and canonical links and meta refreshes in the HTML; with ``variants`` also a host with and without
    ``www.``, and a path with and without a slash at its end. In a connected component an explicit allow precedes any
    block; a URL whose own rule fits keeps that rule's verdict, others take their component's, and those without either are
    allowed. Null or relative URLs have empty host and path, no rule and no edges; so have ends of redirects. Very long
    URLs are nodes by their MD5. Repeated rows each get their row; an empty table gives an empty result; other columns of
    ``pages`` are not looked at.
    """
    node = lambda h, p: F.md5(F.concat(F.col(h), F.lit(" "), F.col(p)))
    base = cut(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    links = declared_links(pages)
    if redirects is not None:
        ends = [x for end in ("src", "dst") for x in (host_of(F.col(end)).alias(f"{end}_host"), path_of(F.col(end)).alias(f"{end}_path"))]
        links = links.union(redirects.select(*ends).where("src_host != '' and dst_host != ''"))
    links = cut(links.distinct(), "edges")
    urls = base.where("host != ''").select("host", "path")
    for end in ("src", "dst"):
        urls = urls.union(links.select(f"{end}_host", f"{end}_path"))
    nodes = cut(urls.distinct(), "nodes")
    edges = links.select(node("src_host", "src_path").alias("a"), node("dst_host", "dst_path").alias("b"))
    if variants:
        bare = nodes.select("host", "path", F.regexp_replace("host", r"^www\.", "").alias("vh"), F.regexp_replace("path", "/$", "").alias("vp")).where("host != vh or path != vp")
        edges = edges.union(bare.select(node("host", "path"), node("vh", "vp")))
        # A variant that is no page is still a node, as a rule may fit it alone.
        nodes = nodes.union(bare.select("vh", "vp")).distinct()
    ruled = cut(match_rules(nodes, rules), "ruled")
    components = cut(connected_components(edges), "components")
    judged = components.join(ruled.select(node("host", "path").alias("node"), "rule_verdict"), "node")
    decided = judged.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("any_allow"))
    inherited = cut(components.join(decided, "component").select("node", F.when(F.col("any_allow"), "allow").otherwise("block").alias("inherited")), "inherited")
    own = base.join(ruled, ["host", "path"], "left")
    # Only URLs without a rule of their own need their component.
    alone = own.where("rule is not null or host = ''").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    asked = own.where("rule is null and host != ''").withColumn("node", node("host", "path")).join(inherited, "node", "left")
    return alone.union(asked.select("page_id", "host", "path", "rule", F.coalesce("inherited", F.lit("allow"))))
