"""URL filters: host and path rules, and block decisions passed on over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafuse.llm.common import HOT, cut, hot_join, let, table
from terrafuse.operators.graph import connected_components

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Up to so many rules are one expression; more, or a table of any size, are joined on domains and path prefixes.
EXPRESSED = 1000
#: Query parameters that do not change what a url shows.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|msclkid|ref|ref_src|mc_cid|mc_eid)(=.*)?$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _single(rules) -> list[tuple[str, str, str]]:
    """Each (host, path) once; an allow beats a block for the same one."""
    kinds: dict[tuple[str, str], str] = {}
    for kind, domain, prefix in rules:
        kinds[domain, prefix] = min(kind, kinds.get((domain, prefix), kind))
    return [(kind, *k) for k, kind in kinds.items()]


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host (or a parent domain) and path; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(_single(rules), key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is tested first
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def with_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows (host, path, ..) with the name and verdict (rule, own) of the longest rule that fits; of equal lengths the name that sorts last.

    rules are (verdict, host, path) as a sequence or as a table of any size. A table is joined: each different host and
    path gives one key for every parent domain that has rules and every length of their paths.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= EXPRESSED:
        name, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return rows.withColumn("rule", name).withColumn("own", verdict)
    if not isinstance(rules, DataFrame):
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    given = rules.groupBy(F.col("host").alias("domain"), F.col("path").alias("prefix")).agg(F.min("verdict").alias("verdict"))
    sizes = given.groupBy("domain").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = rows.select("host", "path").distinct().withColumn("domain", F.explode(domains)).join(sizes, "domain")
    keyed = keyed.withColumn("size", F.explode("sizes")).where(F.col("size") <= F.length("path")).withColumn("prefix", F.substring("path", 1, F.col("size")))
    name = F.concat("domain", "prefix")
    best = keyed.join(given, ["domain", "prefix"]).groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("verdict").alias("own"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, "best.rule", "best.own")


def same_page(url: Column) -> Column:
    """A url's key: no scheme, `www.`, default port, fragment, tracking parameters or final slashes; null if it has no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.rtrim(path_of(url), F.lit("/"))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolved(base: Column, target: Column) -> Column:
    """The absolute url that a target means on a page of url `base`; null without either. Dot segments of paths are resolved."""
    site, path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0), path_of(base)
    own = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.substring(target, F.length(own) + 1, F.length(target))

    def step(a: Column, s: Column) -> Column:
        shorter = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
        return F.when(s == ".", a).when(s == "..", F.when(F.size(a) > 1, shorter).otherwise(a)).otherwise(F.concat(a, F.array(s)))

    flat = lambda p: F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    folder = F.concat(F.when(F.startswith(path, F.lit("/")), F.regexp_replace(path, r"[^/]*$", "")).otherwise("/"), own)
    return (
        F.when((target == "") | (site == ""), F.lit(None).cast("string")).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?)//", 1), target))
        .when(own == "", F.concat(site, path, rest)).otherwise(F.concat(site, flat(F.when(F.startswith(own, F.lit("/")), own).otherwise(folder)), rest))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) urls of redirects (meta refresh) and canonical links (link rel=canonical, og:url) in the pages' heads.

    What stands in comments, scripts and bodies does not count. Attributes may be quoted or not and in any order and case; entities
    are decoded, and targets are resolved against the page's base or its url. A page without url gives none.
    """
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    sure = F.coalesce(F.col(html_col).cast("string").rlike(r"(?i)canonical|og:url|refresh"), F.lit(False))
    found = pages.where(sure & F.col(url_col).isNotNull()).select(F.col(url_col).cast("string").alias("source"), F.col(html_col).cast("string").alias("html"))
    head = F.split(F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", " "), r"(?i)</head\b|<body\b", 2)[0]

    def attribute(h: Column, tag: str, test: str, name: str) -> Column:
        got = F.regexp_extract(h, rf"(?is)<{tag}\b{test}[^>]*?(?<![\w-]){name}\s*=\s*{value}", 1)
        out = F.regexp_replace(got, r"""^["']|["']$""", "")
        for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(sign))
        return F.btrim(out, F.lit(" \t\r\n"))

    def targets(h: Column) -> Column:
        canonical = attribute(h, "link", r"""(?=[^>]*(?<![\w-])rel\s*=\s*(?:["'][^"'>]*\bcanonical\b|canonical[\s/>]))""", "href")
        graph = attribute(h, "meta", r"""(?=[^>]*(?<![\w-])property\s*=\s*["']?og:url["'\s/>])""", "content")
        refresh = attribute(h, "meta", r"""(?=[^>]*(?<![\w-])http-equiv\s*=\s*["']?refresh["'\s/>])""", "content")
        refresh = F.btrim(F.regexp_extract(refresh, r"(?is)\burl\s*=\s*(.*)$", 1), F.lit(" \"'"))
        base = attribute(h, "base", "", "href")
        page = F.coalesce(F.when(base != "", resolved(F.col("source"), base)), F.col("source"))
        return let(page, lambda p: F.filter(F.transform(F.array(canonical, graph, refresh), lambda t: resolved(p, t)), lambda t: t.isNotNull()))

    return found.select("source", F.explode(let(head, targets)).alias("target"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A url that a rule fits has the rule's verdict. Else the decisions of its aliases count: urls
    with one same_page() key, and those that redirects (columns source, target) or canonical links
    connect at any distance. One explicit allow among them allows; else one block blocks; else it is allowed.
    Urls that are null or have no host have no aliases and are allowed. Repeated rows, and page ids
    that repeat, are judged row by row. An empty table of pages or redirects is fine; other columns are not read.
    rules are (verdict, host, path) triples or a table of these columns. One url, or one group of aliases, may hold any part of the pages.
    """
    url = pages[url_col].cast("string")
    key = lambda u: F.unhex(F.md5(same_page(u)))  # noqa: E731  a fixed-size node instead of the string
    flag = lambda c, v: F.bool_or(F.coalesce(F.col(c) == v, F.lit(False)))
    rows = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), key(url).alias("node"))
    rows = cut(with_rules(rows, rules).select("page_id", "host", "path", "node", "rule", "own"))
    links = None
    if html_col:
        links = page_links(pages, url_col, html_col)
    if redirects is not None:
        given = redirects.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
        links = given if links is None else links.union(given)
    decided = rows.where("node is not null").groupBy("node").agg(flag("own", "allow").alias("allow"), flag("own", "block").alias("block"), F.count("*").alias("n"))
    if links is not None:
        # A link's ends may be urls without a page; the rules decide on them as well.
        ends = cut(links.select(F.array("source", "target").alias("urls")))
        edges = ends.select(key(F.col("urls")[0]).alias("u"), key(F.col("urls")[1]).alias("v")).where("u is not null and v is not null")
        linked = ends.select(F.explode("urls").alias("url")).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key(F.col("url")).alias("node"))
        linked = with_rules(linked.where("node is not null"), rules).groupBy("node").agg(flag("own", "allow").alias("allow"), flag("own", "block").alias("block"))
        both = decided.union(linked.withColumn("n", F.lit(0).cast("long"))).groupBy("node").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block"), F.sum("n").alias("n"))
        parts = connected_components(edges).withColumnRenamed("node", "part_node")
        named = both.join(parts, F.col("node") == F.col("part_node"), "left").select("node", "allow", "block", "n", F.coalesce("component", "node").alias("part"))
        named = cut(named)
        verdicts = cut(named.groupBy("part").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block"), F.count("*").alias("nodes")))
        decided = hot_join(named.select("node", "n", "part"), verdicts, "part", "nodes").select("node", "n", "allow", "block")
    decided = cut(decided)
    # pages whose verdict hangs on others: the urls of very many pages (at most HOT of them) by broadcast, the rest by the few that have a decision
    total = decided.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(decided.where(F.col("n") * HOT > total).drop("n"))
    cold = decided.where((F.col("n") * HOT <= total) & F.expr("allow or block")).drop("n")
    open_ = rows.where("own is null and node is not null")
    told = open_.join(hot, "node").unionByName(open_.join(hot.select("node"), "node", "left_anti").join(cold, "node", "left"))
    method = F.when(F.coalesce("allow", F.lit(False)), "allow").when(F.coalesce("block", F.lit(False)), "block").otherwise("allow")
    sure = rows.where("own is not null or node is null")
    out = lambda df, verdict: df.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    return out(sure, F.coalesce("own", F.lit("allow"))).unionByName(out(told, method))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_KEY_HOST = "regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '')"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (_, h, p) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1] + x[1][2]))
)
#: The driver's pages hold no canonical link, og:url or refresh, so this SQL has the shared keys alone.
ORACLE_SQL = f"""
WITH a AS (SELECT page_id, url,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT *, CASE {_FITS.format(*(h + p for _, h, p in RULES))} END AS rule, CASE {_FITS.format(*(k for k, _, _ in RULES))} END AS own,
  list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), ''), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS kept FROM a),
c AS (SELECT *, CASE WHEN {_KEY_HOST} <> '' THEN {_KEY_HOST} || rtrim(path, '/') ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS node FROM b),
d AS (SELECT node, bool_or(own = 'allow') AS allow, bool_or(own = 'block') AS block FROM c WHERE node IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN allow THEN 'allow' WHEN block THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN d ON c.node = d.node
"""
