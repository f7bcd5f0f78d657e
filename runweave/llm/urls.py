"""URL filter: per host a tree of path templates, judged by smoothed labelled purity.

Distinct (host, path) pairs carry counts of their rows and labels; the tree is built level by
level over the path's segments, by aggregates and joins only. At a node, a segment becomes the
wildcard ``*`` if it holds a digit, or if the node has many different children of which this one is not
a frequent one. The other labelled children are ordered by their share of blocked labels, and neighbours
whose shares do not differ (a two-sample test at 5 %) are merged into one branch ``~1``, ``~2``, ...; the
rest keep their names. From ``DEPTH`` segments on, the rest of the path is one segment.

A template's purity is its share of blocked labels, drawn by pseudo-counts towards the same template
on all hosts, and that towards the share in all labels. Above one half it is rejected.
Labels are the verdicts of explicit rules, which also stand: the longest rule that fits decides its
url, and the templates decide the others.

Results by case: a null url, or one without ``://``, has empty host and path; repeated urls are
judged alike; between equally long rules the longer host wins, then the rule named first; without labels
every url is allowed; an empty table gives an empty result; input columns named like a
result are replaced. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEPTH = 5
#: Children from which on a node's rare segments are wildcards, and how often the mean child a frequent one is seen.
MANY, FREQUENT = 8, 4
#: Square of the normal deviate at 5 %, and pseudo-counts of each level of smoothing.
DEVIATE, PSEUDO = 3.841458820694124, 2.0
PARTS = r"://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path columns."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def _ranked(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))


def rule_columns(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The rule that decides and its verdict, null where none fits. One expression: made for rule lists of a few hundred."""
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in _ranked(rules)]

    def chain(values: list[str]) -> Column:
        return F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))

    return chain([h + p for h, p, _ in _ranked(rules)]), chain([v for _, _, v in _ranked(rules)])


def _purity(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + PSEUDO * prior) / (labelled + PSEUDO)


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``urls`` (host, path, n, labelled, blocked; distinct) with ``template``."""
    cuts = F.split(F.regexp_replace("path", "^/", ""), "/")
    rest = F.concat(F.slice(cuts, 1, depth - 1), F.array(F.array_join(F.slice(cuts, depth, F.greatest(F.size(cuts) - depth + 1, F.lit(1))), "/")))
    now = urls.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).when(F.size(cuts) > depth, rest).otherwise(cuts)).withColumn("template", F.lit(""))
    now = cut(now, "urls")
    deepest = now.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        here = now.where(F.size("segments") > level).withColumn("segment", F.get("segments", F.lit(level)))
        children = cut(here.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]), "children")
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("k"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
        c = children.join(cut(nodes, "nodes"), ["host", "template"])
        wild = F.col("segment").rlike("[0-9]") | ((F.col("k") >= MANY) & (2 * F.col("k") >= F.col("all_n")) & (F.col("n") * F.col("k") <= FREQUENT * F.col("all_n")))
        c = cut(c.select("host", "template", "segment", "labelled", "blocked", wild.alias("wild")), "tested")
        row = Window.partitionBy("host", "template").orderBy(F.col("blocked") / F.col("labelled"), "segment")
        told = c.where((F.col("labelled") > 0) & ~F.col("wild")).withColumns({f"last_{x}": F.lag(x).over(row) for x in ("labelled", "blocked")})
        share = (F.col("blocked") + F.col("last_blocked")) / (F.col("labelled") + F.col("last_labelled"))
        apart = F.pow(F.col("blocked") / F.col("labelled") - F.col("last_blocked") / F.col("last_labelled"), F.lit(2.0))
        spread = share * (1.0 - share) * (1.0 / F.col("labelled") + 1.0 / F.col("last_labelled"))
        told = told.withColumn("branch", F.sum(F.when(F.col("last_labelled").isNull() | (apart > DEVIATE * spread), 1).otherwise(0)).over(row.rowsBetween(Window.unboundedPreceding, 0)))
        told = told.withColumn("size", F.count("*").over(Window.partitionBy("host", "template", "branch"))).where("size > 1")
        c = c.join(cut(told.select("host", "template", "segment", "branch"), "merged"), ["host", "template", "segment"], "left")
        name = F.when(F.col("wild"), "*").when(F.col("branch").isNotNull(), F.concat(F.lit("~"), F.col("branch").cast("string"))).otherwise(F.col("segment"))
        names = cut(c.select("host", "template", "segment", F.concat("template", F.lit("/"), name).alias("next")), "names")
        deeper = here.join(names, ["host", "template", "segment"]).select("host", "path", "n", "labelled", "blocked", "segments", F.col("next").alias("template"))
        now = cut(deeper.unionByName(now.where(F.size("segments") <= level)), "urls")
    return now.drop("segments")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, depth: int = DEPTH, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, template``."""
    host, path = parts(F.col(url))
    gone = {"host", "path", "rule", "verdict", "template"}
    own = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in gone], host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    urls = pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("n"))
    urls = urls.withColumn("labelled", F.when(verdict.isNotNull(), F.col("n")).otherwise(0)).withColumn("blocked", F.when(verdict == "block", F.col("n")).otherwise(0))
    made = templates(urls, depth)
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    by_host = cut(made.groupBy("host", "template").agg(*sums), "by_host")
    by_name = cut(by_host.groupBy("template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")]), "by_name")
    total = by_name.agg(*[F.sum(f"all_{c}") for c in ("labelled", "blocked")]).first()
    prior = F.lit(((total[1] or 0) + 0.5) / ((total[0] or 0) + 1.0)) if total[0] else F.lit(0.0)
    purity = _purity(F.col("blocked"), F.col("labelled"), _purity(F.col("all_blocked"), F.col("all_labelled"), prior))
    judged = by_host.join(by_name, "template").select("host", "template", F.when(purity > 0.5, "block").otherwise("allow").alias("judged"))
    known = cut(made.select("host", "path", "template").join(cut(judged, "judged"), ["host", "template"]), "known")
    return own.join(known, ["host", "path"]).withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, "judged")).drop("judged")


def oracle(rules: tuple[Rule, ...] = RULES, depth: int = DEPTH) -> str:
    """The same judgement as DuckDB SQL over ``pages``."""
    ranked = _ranked(rules)
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ranked]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r[0] + r[1]}'" for f, r in zip(fits, ranked, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r[2]}'" for f, r in zip(fits, ranked, strict=True)) + " END"
    steps = []
    for i in range(depth):
        steps.append(f"""
c{i} AS (SELECT host, template, segments[{i + 1}] AS segment, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked FROM u{i} WHERE len(segments) > {i} GROUP BY ALL),
p{i} AS (SELECT host, template, count(*)::DOUBLE AS k, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(blocked) AS all_blocked FROM c{i} GROUP BY ALL),
w{i} AS (SELECT c.*, regexp_matches(c.segment, '[0-9]') OR (k >= {MANY} AND 2 * k >= all_n AND n * k <= {FREQUENT} * all_n) AS wild FROM c{i} c JOIN p{i} p ON c.host = p.host AND c.template = p.template),
l{i} AS (SELECT *, lag(labelled) OVER o AS ll, lag(blocked) OVER o AS lb FROM w{i} WHERE labelled > 0 AND NOT wild WINDOW o AS (PARTITION BY host, template ORDER BY blocked / labelled, segment)),
m{i} AS (SELECT *, sum(CASE WHEN ll IS NULL OR pow(blocked / labelled - lb / ll, 2.0) > {DEVIATE!r}::DOUBLE * ((blocked + lb) / (labelled + ll) * (1.0::DOUBLE - (blocked + lb) / (labelled + ll)) * (1.0::DOUBLE / labelled + 1.0::DOUBLE / ll)) THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY blocked / labelled, segment ROWS UNBOUNDED PRECEDING)::BIGINT AS branch FROM l{i}),
s{i} AS (SELECT *, count(*) OVER (PARTITION BY host, template, branch) AS size FROM m{i}),
n{i} AS (SELECT w.host, w.template, w.segment, w.template || '/' || CASE WHEN w.wild THEN '*' WHEN s.branch IS NOT NULL THEN '~' || s.branch::VARCHAR ELSE w.segment END AS next
    FROM w{i} w LEFT JOIN s{i} s ON s.size > 1 AND w.host = s.host AND w.template = s.template AND w.segment = s.segment),
u{i + 1} AS (SELECT u.host, u.path, u.n, u.labelled, u.blocked, u.segments, coalesce(x.next, u.template) AS template FROM u{i} u LEFT JOIN n{i} x ON len(u.segments) > {i} AND u.host = x.host AND u.template = x.template AND u.segments[{i + 1}] = x.segment),""")
    return f"""
WITH base AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS decided FROM base),
d AS (SELECT host, path, count(*) AS n, count(decided) AS labelled, count(*) FILTER (decided = 'block') AS blocked, string_split(regexp_replace(path, '^/', ''), '/') AS cuts FROM ruled GROUP BY host, path),
u0 AS (SELECT host, path, n, labelled, blocked, '' AS template, CASE WHEN path = '' THEN [] WHEN len(cuts) > {depth} THEN list_concat(cuts[1:{depth - 1}], [array_to_string(cuts[{depth}:], '/')]) ELSE cuts END AS segments FROM d),{"".join(steps)}
h AS (SELECT host, template, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked FROM u{depth} GROUP BY ALL),
g AS (SELECT template, sum(labelled) AS all_labelled, sum(blocked) AS all_blocked FROM h GROUP BY ALL),
t AS (SELECT CASE WHEN sum(all_labelled) > 0 THEN (sum(all_blocked) + 0.5::DOUBLE) / (sum(all_labelled) + 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS prior FROM g),
j AS (SELECT h.host, h.template, CASE WHEN (h.blocked + {PSEUDO}::DOUBLE * ((g.all_blocked + {PSEUDO}::DOUBLE * t.prior) / (g.all_labelled + {PSEUDO}::DOUBLE))) / (h.labelled + {PSEUDO}::DOUBLE) > 0.5::DOUBLE THEN 'block' ELSE 'allow' END AS judged FROM h JOIN g ON h.template = g.template, t)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.decided, j.judged) AS verdict, u.template
FROM ruled r JOIN u{depth} u ON r.host = u.host AND r.path = u.path JOIN j ON u.host = j.host AND u.template = j.template"""


