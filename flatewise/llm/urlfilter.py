"""Operator 9: URL filtering by rules and by link-graph propagation, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest rule that
fits decides.  Urls that no rule fits are judged by their host: personalised PageRank runs from trusted hosts along the
links between hosts, and distrust runs from blocked hosts against the links, as a site that links to bad sites is
itself suspect.  A host's seeds are shares of its pages: trust the share that a rule allows, distrust the share that
a rule for all of the host blocks (no path included); a host known from links only is one page.  A rule for some paths of a host says
nothing of its other pages; links to those paths lead to a node of their own, which is a source of distrust.  A host
is blocked when its distrust reaches `THRESHOLD` of a full seed's and exceeds its trust.

Links are absolute urls and urls without a scheme (`//host/path`).  Links by path alone stay within their host, and a
host's links to itself say nothing, so they are no edges.

Links are counted per pair of hosts before anything else is shuffled, so a hot host is one row a task.  The state
table has one row per host; a round is one join with the edges and one sum.  Rounds end when all that is still to be moved, over all hosts, is below a
thousandth of the threshold.

Defined cases: a null url or one without "://" has empty host and path, fits no rule, and is judged as the host "";
null html has no links; repeated rows each give a row (their links count once more); other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatewise.llm.common import checkpoint

# fixed values: the rules of the contract, (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
ROUNDS = 6  # of the SQL, which cannot iterate until a bound holds
THRESHOLD = 0.02
TOLERANCE = THRESHOLD * (1 - DAMPING) / 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^?#"'\s>]*)"""


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path and html."""
    host = F.translate(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")


def rule_column(rules=RULES, host: F.Column | None = None, path: F.Column | None = None) -> F.Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    found, at, below = None, F.col("host") if host is None else host, F.col("path") if path is None else path
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((at == host) | at.endswith(f".{host}")) & below.startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def host_links(pages: DataFrame, rules=RULES) -> DataFrame:
    """(src, dst, node, n, a): n pages of host src link to a node of host dst, a = 1 if a rule allows one of the urls.

    The node of a url is its host, but urls that a rule for some paths blocks are a node of their own.
    """

    def target(link):
        host, path = F.translate(F.substring_index(link, "/", 1), UPPER, LOWER), F.regexp_extract(link, r"(?s)^[^/]*(.*)$", 1)
        found, whole = rule_column(rules, host, path), F.coalesce(rule_column(rules, host, F.lit("/"))["verdict"] == "block", F.lit(False))
        part = F.coalesce(found["verdict"] == "block", F.lit(False)) & ~whole
        return F.struct(host.alias("dst"), F.when(part, F.concat(host, F.lit("|"), found["rule"])).otherwise(host).alias("node"), F.coalesce((found["verdict"] == "allow").cast("int"), F.lit(0)).alias("a"))

    targets = F.transform(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))), target)
    as_edges = F.array_distinct(F.transform("targets", lambda t: F.struct(t["dst"].alias("dst"), t["node"].alias("node"), F.lit(1.0).alias("n"), F.lit(0).alias("a"))))
    as_allowed = F.array_distinct(F.transform(F.filter("targets", lambda t: t["a"] == 1), lambda t: F.struct(t["dst"].alias("dst"), t["node"].alias("node"), F.lit(0.0).alias("n"), F.lit(1).alias("a"))))
    links = pages.select(F.col("host").alias("src"), targets.alias("targets")).select("src", F.explode(F.concat(as_edges, as_allowed)).alias("l"))
    return links.where("l.dst <> ''").groupBy("src", "l.dst", "l.node").agg(F.sum("l.n").alias("n"), F.max("l.a").alias("a"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from (host, good, bad) seeds of 0 to 1, iterated until what is still to come is below `tolerance`.

    A round keeps or loses mass, so after a round that moved `step` in all, no later sum differs by more than step * damping / (1 - damping).
    """
    out, into = edges.groupBy("src").agg(F.sum("n").alias("out")), edges.groupBy("dst").agg(F.sum("n").alias("into"))
    weighted = edges.join(out, "src").join(into, "dst")
    both = weighted.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("t"), F.lit(0.0).alias("d")).union(
        weighted.select(F.col("dst"), F.col("src"), F.lit(0.0), F.col("n") / F.col("into"))
    )
    both = checkpoint(both)
    start = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    if not both.take(1):
        return start
    state = start.withColumns({"trust_step": F.col("trust"), "distrust_step": F.col("distrust")})
    k = 0
    while True:
        moved = both.join(state, "host").select(F.col("to").alias("host"), (damping * F.col("trust_step") * F.col("t")).alias("trust_step"), (damping * F.col("distrust_step") * F.col("d")).alias("distrust_step"))
        before = state.select("host", "trust", "distrust", F.lit(0.0).alias("trust_step"), F.lit(0.0).alias("distrust_step"))
        after = moved.select("host", F.col("trust_step").alias("trust"), F.col("distrust_step").alias("distrust"), "trust_step", "distrust_step")
        state = before.union(after).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "trust_step", "distrust_step")])
        k += 1
        if k % 3 == 0:
            state = checkpoint(state)
            if (state.agg(F.sum(F.col("trust_step") + F.col("distrust_step"))).first()[0] or 0.0) * damping / (1 - damping) <= tolerance:
                return state.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    urls = split_urls(pages).withColumn("found", rule_column(rules))
    links = checkpoint(host_links(urls, rules))
    root = F.coalesce(rule_column(rules, path=F.lit("/"))["verdict"] == "block", F.lit(False))
    allowed = F.coalesce(F.col("found.verdict") == "allow", F.lit(False)).cast("double")
    barred = root.cast("double") * (1 - allowed)
    shares = urls.select("host", allowed.alias("good"), barred.alias("bad")).groupBy("host").agg(F.avg("good").alias("good"), F.avg("bad").alias("bad"))
    part = F.col("node") != F.col("host")
    linked = links.select(F.col("dst").alias("host"), "node", "a").groupBy("host", "node").agg(F.max("a").alias("a"))
    linked = linked.select(F.col("node").alias("host"), F.when(part, 0.0).otherwise(F.col("a").cast("double")).alias("good"), F.when(part | (root & (F.col("a") == 0)), 1.0).otherwise(0.0).alias("bad"))
    seeds = checkpoint(shares.union(linked.join(shares.select("host"), "host", "left_anti")))
    ranks = propagate(links.where("n > 0 and dst <> src").select("src", F.col("node").alias("dst"), "n"), seeds)
    bad = ranks.where((F.col("distrust") >= THRESHOLD * (1 - DAMPING)) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("by_links"))
    rows = urls.select("page_id", "host", "path", "found").join(bad, "host", "left")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "by_links", F.lit("allow")).alias("verdict"))


def judge_sql(rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The same judgement as DuckDB SQL, for tables whose links lead to hosts of pages and not into blocked paths, and whose
    distrust settles within the rounds."""
    cases = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in cases]
    rule = "CASE " + " ".join(f"{f}'{h}{p}'" for f, (h, p, _) in zip(fits, cases)) + " END"
    verdict = "CASE " + " ".join(f"{f}'{v}'" for f, (_, _, v) in zip(fits, cases)) + " END"
    link = r"""(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]*)"""
    text = rf"""
WITH split AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
urls AS (SELECT page_id, html, host, path, {rule} AS rule, {verdict} AS found FROM split),
roots AS (SELECT host, coalesce(({verdict} = 'block'), false) AS root FROM (SELECT DISTINCT host, '/' AS path FROM urls)),
seeds AS (SELECT u.host AS host, avg(coalesce(found = 'allow', false)::INT)::DOUBLE AS good, avg((root AND NOT coalesce(found = 'allow', false))::INT)::DOUBLE AS bad FROM urls u JOIN roots r ON r.host = u.host GROUP BY u.host),
links AS (
  SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '{link}', 1))), '{UPPER}', '{LOWER}') AS dst, page_id FROM urls),
edges AS (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT DISTINCT src, dst, page_id FROM links) WHERE dst <> '' AND dst <> src GROUP BY src, dst),
weighted AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS t, n / sum(n) OVER (PARTITION BY dst) AS d FROM edges),
both_ways AS (SELECT src AS host, dst AS target, t, 0.0 AS d FROM weighted UNION ALL SELECT dst, src, 0.0, d FROM weighted),
start AS (SELECT host, good * {1 - damping!r} AS trust, bad * {1 - damping!r} AS distrust FROM seeds),
state0 AS (SELECT * FROM start),"""
    for k in range(rounds):
        text += f"""
state{k + 1} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
  SELECT * FROM start UNION ALL
  SELECT e.target, {damping} * s.trust * e.t, {damping} * s.distrust * e.d FROM both_ways e JOIN state{k} s ON e.host = s.host) GROUP BY host),"""
    return text + f"""
bad AS (SELECT host FROM state{rounds} WHERE distrust >= {THRESHOLD * (1 - damping)!r} AND distrust > trust)
SELECT page_id, u.host AS host, path, rule, coalesce(found, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM urls u LEFT JOIN bad b ON u.host = b.host"""
