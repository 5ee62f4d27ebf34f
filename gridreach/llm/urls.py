"""URL filters: a rule list, and for urls that no rule fits the verdict of a link-graph propagation over hosts.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and follows
links backwards, to those who link there.  Both are personalised PageRank vectors in units of pages.  A host is blocked
when distrust exceeds trust by `threshold` for each of its pages.  DataFrame functions only.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.session import cut, settled

#: (rule, allowed); a rule is a host and a path prefix.
RULES = (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False))
DAMPING, THRESHOLD = 0.85, 0.5
#: Mass, in pages, that may still be on its way when a propagation ends; rounds beyond which it fails; rounds that the SQL writes out.
TOLERANCE, ROUNDS, SQL_ROUNDS = 1e-6, 1000, 10
#: Host of an absolute or protocol-relative link.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_url_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _url_part(url, 2)


def rule(h: Column, p: Column, rules: Sequence[tuple[str, bool]] = RULES) -> tuple[Column, Column]:
    """(rule, allowed) of the longest rule whose host is h or above it and whose path p starts with; nulls without one."""
    name, allowed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r, ok in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        at = r.index("/")
        fits = ((h == r[:at]) | h.endswith("." + r[:at])) & p.startswith(r[at:])
        name, allowed = F.when(fits, F.lit(r)).otherwise(name), F.when(fits, F.lit(ok)).otherwise(allowed)
    return name, allowed


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links from one host to another, weights summing to 1 for each source."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))).alias("to"))
    counted = links.select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, mass): the fixpoint of seeds + damping * mass handed along edges (src, dst, n) in proportion to n.

    Each round hands on what the round before brought.  All later rounds together bring damping / (1 - damping) times the last
    one at most; the loop ends when that is TOLERANCE pages or less, and fails after `rounds` rounds.
    """
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    weighted = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w")))
    if weighted.isEmpty():
        return seeds

    def fixpoint() -> DataFrame:
        mass, moved, waiting = seeds, seeds, []
        for _ in range(rounds):
            moved = cut(weighted.join(moved, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("w") * F.col("mass"))).alias("mass")))
            waiting.append(moved)
            left = (moved.agg(F.sum("mass")).first()[0] or 0.0) * damping / (1 - damping)
            if left <= TOLERANCE or len(waiting) == 16:
                mass = functools.reduce(DataFrame.unionByName, [mass, *waiting]).groupBy("host").agg(F.sum("mass").alias("mass"))
                if left <= TOLERANCE:
                    return mass
                mass, waiting = cut(mass), []
        raise RuntimeError(f"mass of {left} pages still moves after {rounds} rounds")

    return settled(spark, fixpoint)


def judge(pages: DataFrame, rules: Sequence[tuple[str, bool]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A null url or one without :// has an empty host and path, no rule and is allowed.  Null pages have no link.  Repeated rows
    weigh and return as often as they come; null ids are carried along; extra columns are ignored; an empty table gives an empty result.
    """
    p = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    name, allowed = rule(F.col("host"), F.col("path"), rules)
    judged = p.select("page_id", "host", "path", name.alias("rule"), allowed.alias("allowed"))
    hosts = cut(judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if("allowed").alias("good"), F.count_if(~F.col("allowed")).alias("bad")))
    edges = cut(host_edges(p))
    seed = lambda c: hosts.where(F.col(c) > 0).select("host", F.col(c).cast("double").alias("mass"))
    trust = propagate(edges, seed("good"))
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seed("bad"))
    net = distrust.unionByName(trust.select("host", (-F.col("mass")).alias("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
    blocked = hosts.join(net, "host").where(F.col("mass") >= threshold * F.col("pages")).select(F.col("host").alias("_host"))
    out = judged.join(cut(blocked), F.col("host") == F.col("_host"), "left")
    ok = F.coalesce(F.col("allowed"), F.col("_host").isNull())
    return out.select("page_id", "host", "path", "rule", F.when(ok, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))


def judge_sql() -> str:
    """The same verdicts as SQL, with SQL_ROUNDS rounds written out: equal where no path of host links is longer and no cycle feeds a host near the threshold."""
    fits = [(r, ok, f"(host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}')") for r, ok in sorted(RULES, key=lambda x: (-len(x[0]), x[0]))]
    case = lambda f: "CASE " + " ".join(f"WHEN {c} THEN {f(r, ok)}" for r, ok, c in fits) + " END"
    link = LINK.replace("'", "''")
    parts = rf"""
WITH p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
j AS (SELECT page_id, host, path, html, {case(lambda r, ok: f"'{r}'")} AS rule, {case(lambda r, ok: str(ok).lower())} AS allowed FROM p),
h AS (SELECT host, count(*) AS pages, count(*) FILTER (allowed) AS good, count(*) FILTER (NOT allowed) AS bad FROM j WHERE host <> '' GROUP BY host),
k AS (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{link}', 1))), '{_UPPER}', '{_LOWER}') AS dst FROM j),
e AS (SELECT src, dst, count(*) AS n FROM k WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
ef AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e),
eb AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS w FROM e),
f0 AS (SELECT host, good::DOUBLE AS mass FROM h WHERE good > 0),
b0 AS (SELECT host, bad::DOUBLE AS mass FROM h WHERE bad > 0)"""
    for side in "fb":
        for i in range(1, SQL_ROUNDS + 1):
            parts += f""",
{side}{i} AS (SELECT host, sum(mass) AS mass FROM (SELECT * FROM {side}0 UNION ALL
  SELECT dst, {DAMPING} * w * mass FROM e{side} JOIN {side}{i - 1} ON src = host) GROUP BY host)"""
    return parts + f"""
SELECT page_id, j.host, path, rule,
  CASE WHEN coalesce(allowed, NOT coalesce(b.mass, 0) - coalesce(f.mass, 0) >= {THRESHOLD} * h.pages OR b.mass IS NULL AND f.mass IS NULL, true) THEN 'allow' ELSE 'block' END AS verdict
FROM j LEFT JOIN h USING (host) LEFT JOIN b{SQL_ROUNDS} b USING (host) LEFT JOIN f{SQL_ROUNDS} f USING (host)"""
