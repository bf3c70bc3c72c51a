"""Operator 4: URL rules with redirect equivalence.

A url's own rule decides first. A url without one takes the decision of its aliases: redirect and canonical-link edges are
closed to connected components (distributed, see graph.py); an explicit allow anywhere in the component outranks a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)((?:\?[^#]*)?)"
CANONICAL = (r"""(?is)<link[^>]*\srel\s*=\s*["']?canonical["']?[^>]*\shref\s*=\s*["']?([^"'\s>]+)""", r"""(?is)<link[^>]*\shref\s*=\s*["']?([^"'\s>]+)["']?[^>]*\srel\s*=\s*["']?canonical""")
REFRESH = r"""(?is)<meta[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*url\s*=\s*([^"'\s>]+)"""
#: The rules of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _node(url: Column) -> Column:
    """The resource a url names: host, path and query; scheme and fragment don't tell resources apart. Null without ://."""
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("u://"), host(url), path(url), F.regexp_extract(url, PARTS, 3)))


def matched(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Equally long: allow first. rules is a list that the caller bounds (they become one expression)."""
    rule = verdict = F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        rule, verdict = F.when(fits, rh + rp).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def html_links(pages: DataFrame) -> DataFrame:
    """(source, target): canonical links and refresh redirects of each page, targets made absolute."""
    low = F.lower("html")
    targets = F.array_distinct(F.concat(*(F.when(F.contains(low, F.lit(word)), F.regexp_extract_all("html", F.lit(x), 1)).otherwise(F.array().cast("array<string>")) for word, x in ((("canonical"), CANONICAL[0]), ("canonical", CANONICAL[1]), ("refresh", REFRESH)))))
    found = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", F.explode(targets).alias("t"))
    base = F.concat(F.lit("u://"), host(F.col("url")))
    t = F.col("t")
    full = F.when(F.contains(t, F.lit("://")), t).when(F.startswith(t, F.lit("//")), F.concat(F.lit("u:"), t)).when(F.startswith(t, F.lit("/")), F.concat(base, t)).otherwise(F.concat(base, F.regexp_replace(F.when(path(F.col("url")) == "", "/").otherwise(path(F.col("url"))), "[^/]*$", ""), t))
    return found.select(F.col("url").alias("source"), full.alias("target"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, one row a row of pages; redirects may add (source, target) urls.

    verdict: the rule's; else allow or block as the url's component says; else the default. A null url, or one without ://, has an empty host
    and path and no aliases. Rows that repeat stay; a null page_id stays null; no html, no edges of its own. Only the ends of edges are joined.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = html_links(own)
    if redirects is not None:
        links = links.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    edges = links.select(_node(F.col("source")).alias("a"), _node(F.col("target")).alias("b")).where("a is not null and b is not null")
    found = written(components(edges), "aliases")
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = found.select("root", matched(host(F.col("node")), path(F.col("node")), rules)[1].alias("v"))
    said = ruled.groupBy("root").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
    said = found.join(said.where("allow or block").select("root", F.when(F.col("allow"), "allow").otherwise("block").alias("alias_verdict")), "root").select("node", "alias_verdict")
    out = own.select("page_id", "url", h.alias("host"), p.alias("path"), _node(F.col("url")).alias("node")).withColumns({"rule": rule, "own": verdict})
    return out.join(said, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit(default)).alias("verdict"))


def judge_sql(default: str = "allow") -> str:
    """The same rows in DuckDB, with the rules of the contract."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = q(PARTS)
    hosted = lambda u: f"coalesce(translate(regexp_extract({u}, {parts}, 1), '{UPPER}', '{LOWER}'), '')"
    pathed = lambda u: f"coalesce(regexp_extract({u}, {parts}, 2), '')"
    node = lambda u: f"case when contains({u}, '://') then 'u://' || {hosted(u)} || {pathed(u)} || regexp_extract({u}, {parts}, 3) end"

    def case(what: int) -> str:
        rows = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
        return "case " + " ".join(f"when (host = '{rh}' or ends_with(host, '.{rh}')) and starts_with(path, '{rp}') then '{(rh + rp, v)[what]}'" for v, rh, rp in rows) + " end"

    return f"""
WITH RECURSIVE own AS (SELECT page_id, url, html, {hosted('url')} AS host, {pathed('url')} AS path FROM pages),
links AS (SELECT url AS source, host, path, unnest(list_distinct(list_concat(regexp_extract_all(html, {q(CANONICAL[0])}, 1), list_concat(regexp_extract_all(html, {q(CANONICAL[1])}, 1), regexp_extract_all(html, {q(REFRESH)}, 1))))) AS t FROM own WHERE url IS NOT NULL AND html IS NOT NULL),
ends AS (SELECT source, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'u:' || t WHEN starts_with(t, '/') THEN 'u://' || host || t
 ELSE 'u://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || t END AS target FROM links),
e AS (SELECT {node('source')} AS a, {node('target')} AS b FROM ends),
pairs AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a AS n, a AS m FROM pairs UNION SELECT r.n, pairs.b FROM reach r JOIN pairs ON r.m = pairs.a),
hosts AS (SELECT n, {hosted('m')} AS host, {pathed('m')} AS path FROM reach),
votes AS (SELECT n, {case(1)} AS v FROM hosts),
said AS (SELECT n, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM votes WHERE v IS NOT NULL GROUP BY n),
judged AS (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS own, {node('url')} AS node FROM own)
SELECT page_id, host, path, rule, coalesce(own, said.v, '{default}') AS verdict FROM judged LEFT JOIN said ON judged.node = said.n"""
