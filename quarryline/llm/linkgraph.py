"""URL filter by rules and link-graph propagation (operator 2). DataFrame functions only.

Rules (host, path) fit their host and all subdomains where the url's path starts with theirs; the
longest wins. Urls without a rule are judged by their host. Host edges are the absolute links of
the pages to other hosts, as many as there are, and one from each host to the domain it is part of (not to a public suffix). Hosts are seeds
of trust by the share of their pages that rules allow, and of distrust by the share that rules block. Personalised
PageRank carries trust along the edges and distrust against them (who links to blocked hosts is suspect) with DAMPING, until no further host is reached and
three rounds add to no host more than TOLERANCE of what it has;
what reaches a host without edges stops there. A host is blocked where its distrust is over RATIO times its trust and MARGIN of that, as sums differ in their last digits from run to run.
Both rules compare a host's values with each other, so neither depends on how many hosts share the ranks.

Null urls and urls without :// have empty host and path, no rule, and are allowed. Each row of pages is judged, repeated ones
alike. Very long pages are searched for links whole; an empty table gives an empty result; columns besides page_id, url and html are not read. Without any rule that fits all is allowed. The graph has one row for each pair of hosts; counts are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import discard, lookup, stored, table
from quarryline.llm.sqltext import LOWER, UPPER

#: (verdict, host, path), fixed values of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: ROUNDS are those of OP2_SQL; propagate() has no fixed number.
ROUNDS, DAMPING, RATIO, TOLERANCE, MARGIN = 10, 0.85, 1.0, 1e-9, 1e-7
LINK = r"""(?i)href\s*=\s*["']?\s*[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


#: Hosts that are not part of another one: addresses, and names right under a public suffix of two parts (fixed values: what such suffixes begin with).
NO_PARENT = "^[0-9.]+$|^[^.]+[.](?:ac|co|com|edu|go|gov|ne|net|or|org)[.][a-z][a-z]$"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(at: Column, way: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((at == h) | at.endswith(f".{h}")) & way.startswith(p) for _, h, p in longest]
    return F.coalesce(*[F.when(f, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for f, (v, h, p) in zip(fits, longest)]) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, from pages (host, html), and each host's link to its parent domain."""
    linked = pages.where("host <> '' AND html IS NOT NULL").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    linked = linked.withColumn("dst", F.regexp_replace(F.translate("dst", UPPER, LOWER), "^[^@]*@", ""))
    parents = pages.where(f"host RLIKE '^[^.]+[.][^.]+[.]' AND NOT host RLIKE '{NO_PARENT}'").select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).distinct()
    return linked.unionByName(parents).where("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust and distrust from edges (src, dst, n) and seeds (host, trust, distrust: shares that add up to 1 each, or 0)."""
    both = edges.selectExpr("'trust' AS kind", "src", "dst", "n").unionByName(edges.selectExpr("'distrust' AS kind", "dst AS src", "src AS dst", "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    steps = stored(both.join(out, ["kind", "src"]).select(F.col("kind").alias("way"), "src", "dst", (F.lit(damping) * F.col("n") / F.col("all")).alias("p")), "steps")
    start = seeds.selectExpr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, value)", "host").where("value > 0")
    start = stored(start.select("kind", "host", ((1 - damping) * F.col("value")).alias("value")), "seeds")
    # values only grow from round to round; a host that is reached first has grown by all it has
    growth = lambda ranks, old: ranks.join(old.select("kind", "host", F.col("value").alias("old")), ["kind", "host"], "left").agg(F.max(1 - F.coalesce("old", F.lit(0.0)) / F.col("value"))).first()[0] or 0.0
    now, grown = start, 1.0
    while grown > tolerance:
        last = now
        for _ in range(3):  # a lost executor costs three rounds at most
            sent = now.join(steps, F.expr("kind = way AND host = src")).select("kind", F.col("dst").alias("host"), (F.col("value") * F.col("p")).alias("value"))
            now = sent.unionByName(start).groupBy("kind", "host").agg(F.sum("value").alias("value"))
        now = stored(now, "ranks")
        grown = growth(now, last)
        if last is not start:
            discard(last)
    value = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value")).otherwise(0.0))
    return now.groupBy("host").agg(value("trust").alias("trust"), value("distrust").alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for pages (page_id, url, html)."""
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    ruled = parsed.withColumn("hit", rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("hit.verdict") == v, 1.0).otherwise(0.0))
    hosts = stored(ruled.groupBy("host").agg(share("allow").alias("t"), share("block").alias("d"), F.count("*").alias("n")), "hosts")
    shares = hosts.where("host <> ''")
    t, d = (x or 0.0 for x in shares.agg(F.sum("t"), F.sum("d")).first())
    seeds = shares.select("host", (F.col("t") / (t or 1.0)).alias("trust"), (F.col("d") / (d or 1.0)).alias("distrust"))
    # far fewer than the pages
    ranks = propagate(stored(host_edges(parsed), "edges"), seeds)
    level = lambda c: F.coalesce(c, F.lit(0.0))
    judged = stored(hosts.select("host", "n").join(ranks, "host", "left").select("host", "n", (level("distrust") > RATIO * (1 + MARGIN) * level("trust")).alias("blocked")), "judged")
    found = lookup(ruled.drop("html"), judged, ["host"], "n")
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op2_url_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _op2_sql() -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}:{v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    link = r"""href\s*=\s*["'']?\s*[a-z][a-z0-9+.-]*://([^/?#"''\s>]+)"""
    head = f"""
WITH p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {fits} END AS hit FROM p),
s AS (SELECT host, avg(CASE WHEN hit LIKE '%:allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN hit LIKE '%:block' THEN 1.0 ELSE 0.0 END) AS d FROM r WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, regexp_replace(translate(unnest(regexp_extract_all(html, '{link}', 1, 'i')), '{UPPER}', '{LOWER}'), '^[^@]*@', '') AS dst FROM p WHERE host <> ''
  UNION ALL SELECT DISTINCT host, substr(host, instr(host, '.') + 1) FROM p WHERE regexp_matches(host, '^[^.]+[.][^.]+[.]') AND NOT regexp_matches(host, '{NO_PARENT}')),
e AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND dst <> '' GROUP BY ALL),
b AS (SELECT 't' AS kind, src, dst, n FROM e UNION ALL SELECT 'd', dst, src, n FROM e),
w AS (SELECT kind, src, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY kind, src) AS p FROM b),
r0 AS (SELECT 't' AS kind, host, {1 - DAMPING} * t / (SELECT sum(t) FROM s) AS v FROM s WHERE t > 0 UNION ALL SELECT 'd', host, {1 - DAMPING} * d / (SELECT sum(d) FROM s) FROM s WHERE d > 0)"""
    rounds = "".join(f",\nr{k} AS MATERIALIZED (SELECT kind, host, sum(v) AS v FROM (SELECT w.kind, w.dst AS host, r{k - 1}.v * w.p AS v FROM r{k - 1} JOIN w ON w.kind = r{k - 1}.kind AND w.src = r{k - 1}.host UNION ALL SELECT * FROM r0) GROUP BY ALL)" for k in range(1, ROUNDS + 1))
    return f"""{head}{rounds},
h AS (SELECT host, sum(CASE WHEN kind = 't' THEN v ELSE 0 END) AS t, sum(CASE WHEN kind = 'd' THEN v ELSE 0 END) AS d FROM r{ROUNDS} GROUP BY host)
SELECT page_id, r.host, path, split_part(hit, ':', 1) AS rule, coalesce(split_part(hit, ':', 2), CASE WHEN coalesce(h.d, 0) > {RATIO * (1 + MARGIN)} * coalesce(h.t, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN h USING (host)"""


OP2_SQL = _op2_sql()
