"""One query for each operator over the test tables, and its DuckDB counterpart.

The SQL is put together from the same few forms: intervals, coverage, sweep and coalescing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.frame import SegmentFrame
from .sources.tables import event_cells, line_intervals, order_intervals, read_runs_csv, write_runs_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EXACT = {"mode": "exact"}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return put


# ---- SQL forms ---------------------------------------------------------------------------------------------------------

DAYS = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE))"
LI = f"(SELECT l_returnflag AS chromosome, CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand, {DAYS.format('l_shipdate')} AS s, {DAYS.format('l_shipdate')} + CAST(l_quantity AS BIGINT) AS e, l_quantity AS score, l_suppkey FROM lineitem)"
SUP = LI.replace("l_returnflag AS chromosome", "'chr' || l_suppkey AS chromosome")
QI = f"(SELECT ['A', 'N', 'R'][o_orderkey % 3 + 1] AS chromosome, {DAYS.format('o_orderdate')} AS s, {DAYS.format('o_orderdate')} + o_orderkey % 30 AS e, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS id FROM orders)"
C, CS = "chromosome", "chromosome, strand"


def s_coalesce(seg: str, k: str = C) -> str:
    return f"""(SELECT {k}, min(seg_start)::BIGINT AS seg_start, max(seg_end)::BIGINT AS seg_end, first(value) AS value FROM (SELECT *, sum(b) OVER (PARTITION BY {k} ORDER BY seg_start) AS island FROM
(SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER (PARTITION BY {k} ORDER BY seg_start) THEN 0 ELSE 1 END AS b FROM {seg})) GROUP BY {k}, island)"""


def s_coverage(intervals: str = LI, k: str = C, w: str = "1", where: str = "TRUE") -> str:
    seg = f"""(SELECT * FROM (SELECT {k}, coalesce(lag(p) OVER (PARTITION BY {k} ORDER BY p), 0) AS seg_start, p AS seg_end, coalesce(sum(d) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS value FROM
(SELECT {k}, p, sum(d) AS d FROM (SELECT {k}, s AS p, {w} AS d FROM {intervals} WHERE {where} UNION ALL SELECT {k}, e, -({w}) FROM {intervals} WHERE {where}) GROUP BY {k}, p)) WHERE seg_end > seg_start)"""
    return s_coalesce(seg, k)


def s_sweep(x: str, y: str, expr: str, k: str = C, pad: str = "0::DOUBLE", coalesce: bool = True) -> str:
    seg = f"""(SELECT {k}, seg_start, seg_end, ({expr})::DOUBLE AS value FROM (SELECT {k}, p AS seg_start, lead(p) OVER w AS seg_end, coalesce(last_value(xv IGNORE NULLS) OVER r, {pad}) AS xv, coalesce(last_value(yv IGNORE NULLS) OVER r, {pad}) AS yv FROM
(SELECT {k}, p, max(xv) AS xv, max(yv) AS yv FROM (SELECT {k}, seg_start AS p, value AS xv, NULL::DOUBLE AS yv FROM {x} UNION ALL SELECT {k}, seg_start, NULL, value FROM {y}
UNION ALL SELECT {k}, max(seg_end), {pad}, NULL FROM {x} GROUP BY {k} UNION ALL SELECT {k}, max(seg_end), NULL, {pad} FROM {y} GROUP BY {k}) GROUP BY {k}, p)
WINDOW w AS (PARTITION BY {k} ORDER BY p), r AS (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE seg_end IS NOT NULL)"""
    return s_coalesce(seg, k) if coalesce else seg


def s_value(seg: str, expr: str, k: str = C, coalesce: bool = True) -> str:
    out = f"(SELECT {k}, seg_start, seg_end, ({expr})::DOUBLE AS value FROM {seg})"
    return s_coalesce(out, k) if coalesce else out


def s_all(seg: str) -> str:
    return f"SELECT * FROM {seg}"


DIV = "CASE WHEN isnan(xv) OR isnan(yv) THEN 'NaN'::DOUBLE WHEN yv != 0 THEN xv / yv WHEN xv > 0 THEN 'Infinity'::DOUBLE WHEN xv < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END"
BINARY = {"add": "xv + yv", "sub": "xv - yv", "mul": "xv * yv", "div": DIV}
SIGNS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
COV, COVS, PLUS, MINUS, WEIGHTED = s_coverage(), s_coverage(k=CS), s_coverage(where="strand = '+'"), s_coverage(where="strand = '-'"), s_coverage(w="score")
LENGTHS = f"(SELECT {C}, max(seg_end) AS length FROM {COV} GROUP BY {C})"


# ---- Spark inputs ------------------------------------------------------------------------------------------------------


def cov(spark: SparkSession, d: str, strand: str | None = None, **how) -> SegmentFrame:
    li = line_intervals(spark, d)
    return SegmentFrame.coverage(li if strand is None else li.where(F.col("strand") == strand), **(EXACT | how))


def covs(spark: SparkSession, d: str) -> SegmentFrame:
    return SegmentFrame.coverage(line_intervals(spark, d), stranded=True, **EXACT)


def suppliers(spark: SparkSession, d: str, where: str = "TRUE") -> SegmentFrame:
    return SegmentFrame.coverage(line_intervals(spark, d, by_supplier=True).where(where), repeats=False, **EXACT)


# ---- sources -------------------------------------------------------------------------------------------------------------


@query(s_all(COV))
def coverage(spark, d):
    return cov(spark, d).df


@query(s_all(COV))
def coverage_tiled(spark, d):
    return cov(spark, d, tile=256).df


@query(s_all(COVS))
def coverage_stranded(spark, d):
    return covs(spark, d).df


@query(s_all(WEIGHTED))
def coverage_weighted(spark, d):
    return SegmentFrame.coverage(line_intervals(spark, d), value_col="score", **EXACT).df


@query(s_all(s_coverage(SUP)))
def coverage_many_keys(spark, d):
    return suppliers(spark, d).df


@query(s_all(COV))
def coverage_near(spark, d):
    return SegmentFrame.coverage(line_intervals(spark, d)).df


CELLS = "(SELECT event_type AS chromosome, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, floor(value / 100) AS value FROM events)"
ENCODED = s_coalesce(f"(SELECT chromosome, pos AS seg_start, pos + 1 AS seg_end, value FROM {CELLS})")


@query(s_all(ENCODED))
def run_encode(spark, d):
    return SegmentFrame.from_dense(event_cells(spark, d), **EXACT).df


@query(s_all(COV))
def from_runs(spark, d):
    frame = cov(spark, d)
    runs = frame.df.select("chromosome", (F.col("seg_end") - F.col("seg_start")).alias("Runs"), F.col("value").alias("Values"), "seg_start")
    return SegmentFrame.from_runs(runs, "seg_start", **EXACT).df


@query("SELECT 'x' AS chromosome, 0::BIGINT AS seg_start, 0::BIGINT AS seg_end, 0::DOUBLE AS value WHERE FALSE")
def empty_vector(spark, d):
    return SegmentFrame.empty(spark, stranded=False).df


@query(f"SELECT 'plus' AS chromosome, seg_start, seg_end, value FROM {PLUS} WHERE chromosome = 'A' UNION ALL SELECT 'minus', seg_start, seg_end, value FROM {MINUS} WHERE chromosome = 'A'")
def from_dict(spark, d):
    return SegmentFrame.from_dict({"plus": cov(spark, d, "+")["A"], "minus": cov(spark, d, "-")["A"]}, **EXACT).df


@query(f"SELECT * FROM {COV} WHERE chromosome != 'A' UNION ALL SELECT * FROM {PLUS} WHERE chromosome = 'A'")
def key_assignment(spark, d):
    return cov(spark, d).with_key(cov(spark, d, "+")["A"]).df


@query(s_all(COVS))
def csv_roundtrip(spark, d):
    import uuid

    from .plans.shared import shared_dir

    path = f"{shared_dir(spark)}/runweave/csv-{uuid.uuid4().hex}"
    write_runs_csv(covs(spark, d), path)
    return read_runs_csv(spark, path, **EXACT).df


# ---- arithmetic and comparison -------------------------------------------------------------------------------------------

for _name, _sql in BINARY.items():
    query(s_all(s_sweep(PLUS, MINUS, _sql)), _name)(lambda spark, d, n=_name: getattr(cov(spark, d, "+"), n)(cov(spark, d, "-")).df)
    _scalar = {"add": "value + 5", "sub": "value - 5", "mul": "value * 5", "div": "value / 4"}[_name]
    query(s_all(s_value(COV, _scalar)), f"scalar_{_name}")(lambda spark, d, n=_name: getattr(cov(spark, d), n)(4 if n == "div" else 5).df)
    _flipped = {"add": "5 + value", "sub": "5 - value", "mul": "5 * value", "div": "CASE WHEN value = 0 THEN 'Infinity'::DOUBLE ELSE 5 / value END"}[_name]
    query(s_all(s_value(COV, _flipped)), f"reflected_{_name}")(lambda spark, d, n=_name: {"add": lambda f: 5 + f, "sub": lambda f: 5 - f, "mul": lambda f: 5 * f, "div": lambda f: 5 / f}[n](cov(spark, d)).df)

query(s_all(s_sweep(COVS, s_value(COVS, "value * 5", CS, False), "xv - yv", CS)), "stranded_difference")(lambda spark, d: (covs(spark, d) - covs(spark, d) * 5).df)
query(s_all(s_value(COV, "CASE WHEN value = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END")), "scalar_div_zero")(lambda spark, d: (cov(spark, d) / 0).df)
query(s_all(s_sweep(s_coverage(SUP, where="l_suppkey < 60"), s_coverage(SUP, where="l_suppkey >= 40"), "xv + yv")), "add_disjoint_keys")(lambda spark, d: (suppliers(spark, d, "l_suppkey < 60") + suppliers(spark, d, "l_suppkey >= 40")).df)
query(s_all(s_sweep(s_coverage(SUP, where="l_suppkey < 60"), s_coverage(SUP, where="l_suppkey >= 40"), DIV)), "div_disjoint_keys")(lambda spark, d: (suppliers(spark, d, "l_suppkey < 60") / suppliers(spark, d, "l_suppkey >= 40")).df)
query(s_all(s_sweep(COV, COV, "xv + yv")), "strand_merge_add")(lambda spark, d: (covs(spark, d) + cov(spark, d)).df)
query(s_all(COV), "merge_strands")(lambda spark, d: covs(spark, d).merge_strands(("+", "-")).df)
query(s_all(s_value(COV, "-value", coalesce=False)), "negate")(lambda spark, d: (-cov(spark, d)).df)
query(s_all(s_value(COV, "sqrt(value)", coalesce=False)), "map_sqrt")(lambda spark, d: cov(spark, d).map_value("sqrt").df)
query(s_all(s_value(COV, "CASE WHEN value = 0 THEN '-Infinity'::DOUBLE ELSE round(log10(CASE WHEN value > 0 THEN value ELSE 1 END), 9) END", coalesce=False)), "map_log10")(lambda spark, d: cov(spark, d).map_value("log10").map_value(lambda v: F.when(v > 0, F.round(v, 9)).otherwise(v)).df)

for _name, _sign in SIGNS.items():
    _pad = "'NaN'::DOUBLE" if _name in ("eq", "ne") else "0::DOUBLE"
    _odd = "OR isnan(xv - yv)" if _name == "ne" else "AND NOT isnan(xv - yv)"
    query(s_all(s_sweep(PLUS, MINUS, f"CASE WHEN (xv - yv) {_sign} 0 {_odd} THEN 1 ELSE 0 END", pad=_pad)), f"cmp_{_name}")(lambda spark, d, n=_name: cov(spark, d, "+").compare(n, cov(spark, d, "-")).df)
    query(s_all(s_value(COV, f"CASE WHEN value {_sign} 9 THEN 1 ELSE 0 END")), f"cmp_scalar_{_name}")(lambda spark, d, n=_name: cov(spark, d).compare(n, 9).df)


@query("SELECT TRUE AS same, FALSE AS other")
def collection_equal(spark, d):
    one, two = cov(spark, d), cov(spark, d, "+")
    answers = one.equal(cov(spark, d)).select(F.lit("same").alias("of"), "equal").unionByName(one.equal(two).select(F.lit("other").alias("of"), "equal"))
    return answers.agg(*[F.bool_or(F.when(F.col("of") == n, F.col("equal"))).alias(n) for n in ("same", "other")])


# ---- lookup --------------------------------------------------------------------------------------------------------------

query(f"SELECT chromosome, coalesce(max(value) FILTER (seg_start <= 777 AND seg_end > 777), 0) AS value FROM {COV} GROUP BY chromosome", "point_lookup")(lambda spark, d: cov(spark, d).at(777))
query(f"SELECT q.chromosome, q.s AS pos, coalesce(c.value, 0) AS value FROM {QI} q LEFT JOIN {COV} c ON q.chromosome = c.chromosome AND c.seg_start <= q.s AND q.s < c.seg_end", "multi_point")(lambda spark, d: cov(spark, d).at_many(order_intervals(spark, d).withColumnRenamed("start", "pos")))
query(s_all(f"(SELECT chromosome, greatest(seg_start, 100) - 100 AS seg_start, least(seg_end, 900) - 100 AS seg_end, value FROM {COV} WHERE seg_start < 900 AND seg_end > 100)"), "slice")(lambda spark, d: cov(spark, d)[100:900].df)

_MET = "((q.s < q.e AND c.seg_start < q.e AND q.s < c.seg_end) OR (q.s = q.e AND c.seg_start <= q.s AND q.s < c.seg_end))"
_FOUND = f"SELECT q.chromosome, q.s AS \"Start\", q.e AS \"End\", q.id AS \"ID\", least(q.e, c.seg_end) - greatest(q.s, c.seg_start) AS \"Run\", c.value AS \"Value\" FROM {{q}} q JOIN {COV} c ON q.chromosome = c.chromosome AND {_MET}"
query(_FOUND.format(q=QI), "keyed_interval_lookup")(lambda spark, d: cov(spark, d).lookup(order_intervals(spark, d)))
query(_FOUND.format(q=QI), "keyed_interval_lookup_binned")(lambda spark, d: cov(spark, d).lookup(order_intervals(spark, d), bin_width=64))
query(_FOUND.format(q=f"(SELECT * FROM {QI} WHERE chromosome = 'A')"), "interval_lookup")(lambda spark, d: cov(spark, d)["A"][order_intervals(spark, d)])
query(f"SELECT * FROM {COV} WHERE chromosome = 'R'", "key_lookup")(lambda spark, d: cov(spark, d)["R"].df)
query(f"SELECT * FROM {COVS} WHERE chromosome = 'R'", "key_lookup_stranded")(lambda spark, d: covs(spark, d)["R"].df)
query(f"SELECT * FROM {COVS} WHERE strand = '+'", "strand_lookup")(lambda spark, d: covs(spark, d)["+"].df)
query(f"SELECT * FROM {COVS} WHERE chromosome = 'N' AND strand = '-'", "pair_lookup")(lambda spark, d: covs(spark, d)["N", "-"].df)
query(f"SELECT * FROM {COV} WHERE chromosome = 'no such key'", "missing_key_lookup")(lambda spark, d: cov(spark, d)["no such key"].df)

# ---- transformations -----------------------------------------------------------------------------------------------------

_SIGNED = s_value(s_sweep(PLUS, MINUS, DIV), "value", coalesce=False)
query(s_all(s_value(COV, "floor(value / 4)")), "defragment")(lambda spark, d: cov(spark, d).map_value(lambda v: F.floor(v / 4).cast("double")).defragment().df)
query(s_all(s_value(_SIGNED, "CASE WHEN isnan(value) THEN 0 WHEN value = 'Infinity' THEN 2147483647 WHEN value = '-Infinity' THEN -2147483648 ELSE value END")), "numbers_only")(lambda spark, d: (cov(spark, d, "+") / cov(spark, d, "-")).numbers_only().df)


def s_shift(n: int, keep: bool = True, fill: str = "0") -> str:
    end = "least(seg_end, length)" if keep else "seg_end"
    moved = f"(SELECT chromosome, greatest(seg_start, 0) AS seg_start, {end} AS seg_end, value FROM (SELECT c.chromosome, seg_start + ({n}) AS seg_start, seg_end + ({n}) AS seg_end, value, length FROM {COV} c JOIN {LENGTHS} l ON c.chromosome = l.chromosome) WHERE {end} > greatest(seg_start, 0))"
    opened = f"SELECT chromosome, 0, {'least(' + str(n) + ', length)' if keep else n}, {fill}::DOUBLE FROM {LENGTHS}" if n > 0 else f"SELECT chromosome, greatest(length + ({n}), 0), length, {fill}::DOUBLE FROM {LENGTHS}"
    return s_coalesce(moved if n < 0 and not keep else f"(SELECT * FROM {moved} UNION ALL {opened})")


query(s_all(s_shift(40)), "shift_right")(lambda spark, d: cov(spark, d).shift(40).df)
query(s_all(s_shift(-40, fill="7")), "shift_left")(lambda spark, d: cov(spark, d).shift(-40, fill=7).df)
query(s_all(s_shift(40, keep=False)), "shift_right_longer")(lambda spark, d: cov(spark, d).shift(40, preserve_length=False).df)
query(s_all(s_shift(-40, keep=False)), "shift_left_shorter")(lambda spark, d: cov(spark, d).shift(-40, preserve_length=False).df)
query(s_all(s_shift(-10**6)), "shift_left_out")(lambda spark, d: cov(spark, d).shift(-(10**6)).df)
_STRANDS = f"(SELECT chromosome, strand, max(seg_end) AS length FROM {COVS} GROUP BY ALL)"
query(s_all(s_coalesce(f"(SELECT * FROM {COVS} UNION ALL SELECT chromosome, strand, length, longest, 0 FROM (SELECT *, max(length) OVER (PARTITION BY chromosome) AS longest FROM {_STRANDS}) WHERE length < longest)", CS)), "equal_strands")(lambda spark, d: covs(spark, d).make_strands_same_length().df)
query(s_all(s_value(PLUS, "CASE WHEN value = 0 THEN 0.25 ELSE value END")), "pseudocounts")(lambda spark, d: cov(spark, d, "+").add_pseudocounts(0.25).df)
query(s_all(COV), "copy")(lambda spark, d: cov(spark, d).copy().df)

# ---- functions of the caller's, summaries, keys, output --------------------------------------------------------------------

query(s_all(s_value(COV, "value * value + 1")), "apply_values")(lambda spark, d: cov(spark, d).apply_values(lambda v, more: v * v + more, more=1).df)
query(s_all(f"(SELECT chromosome, 2 * seg_start AS seg_start, 2 * seg_end AS seg_end, value FROM {COV})"), "apply_runs")(lambda spark, d: cov(spark, d).apply_runs(lambda r: r * 2).df)
query(s_all(f"(SELECT chromosome, max(seg_end) OVER (PARTITION BY chromosome) - seg_end AS seg_start, max(seg_end) OVER (PARTITION BY chromosome) - seg_start AS seg_end, value FROM {COV})"), "apply_vector")(lambda spark, d: cov(spark, d).apply(lambda r, v: (r[::-1], v[::-1])).df)
query(f"SELECT chromosome, count(*) AS runs FROM {COV} GROUP BY chromosome", "run_count")(lambda spark, d: cov(spark, d).run_count())
query(f"SELECT chromosome, max(seg_end) AS length FROM {COV} GROUP BY chromosome", "length")(lambda spark, d: cov(spark, d).length())
query(f"SELECT chromosome, sum(value) / max(seg_end) AS mean, sum(value * (seg_end - seg_start)) / max(seg_end) AS weighted_mean FROM {COV} GROUP BY chromosome", "mean")(lambda spark, d: cov(spark, d).mean())
query(f"SELECT chromosome, round(abs(t - r * (t / n)) / sqrt(n - 1), 9) AS std, round(sqrt((q - w * w / n) / (n - 1)), 9) AS weighted_std FROM (SELECT chromosome, count(*)::DOUBLE AS r, sum(value) AS t, max(seg_end)::DOUBLE AS n, sum(value * (seg_end - seg_start)) AS w, sum(value * value * (seg_end - seg_start)) AS q FROM {COV} GROUP BY chromosome)", "std")(lambda spark, d: cov(spark, d).std().select("chromosome", F.round("std", 9).alias("std"), F.round("weighted_std", 9).alias("weighted_std")))
query(f"SELECT chromosome, round(max(seg_end) / count(*), 3) AS average_run FROM {COV} GROUP BY chromosome", "average_run")(lambda spark, d: cov(spark, d).average_run())
query(f"SELECT count(*) AS keys FROM (SELECT DISTINCT chromosome, strand FROM {COVS})", "key_count")(lambda spark, d: covs(spark, d).key_count())
query(f"SELECT coalesce(x.chromosome, y.chromosome) AS chromosome, CASE WHEN y.chromosome IS NULL THEN 'left' WHEN x.chromosome IS NULL THEN 'right' ELSE 'both' END AS place FROM (SELECT DISTINCT chromosome FROM {SUP} WHERE l_suppkey < 60) x FULL JOIN (SELECT DISTINCT chromosome FROM {SUP} WHERE l_suppkey >= 40) y ON x.chromosome = y.chromosome", "key_sets")(lambda spark, d: suppliers(spark, d, "l_suppkey < 60").key_sets(suppliers(spark, d, "l_suppkey >= 40")))


def _ranked(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    from .functions.values import natural_key

    return df.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col("chromosome")))).cast("long"))  # one row for each key


query(f"SELECT chromosome, row_number() OVER (ORDER BY CAST(substr(chromosome, 4) AS BIGINT)) AS place FROM (SELECT DISTINCT chromosome FROM {SUP})", "natural_order")(lambda spark, d: _ranked(suppliers(spark, d).chromosomes()))
query(f"SELECT seg_end - seg_start AS \"Runs\", value AS \"Values\" FROM {COV} WHERE chromosome = 'N'", "to_frame")(lambda spark, d: cov(spark, d)["N"].to_frame())
query(f"SELECT chromosome AS \"Chromosome\", strand AS \"Strand\", seg_end - seg_start AS \"Runs\", value AS \"Values\" FROM {COVS}", "to_table")(lambda spark, d: covs(spark, d).to_table())
query(f"SELECT chromosome AS \"Chromosome\", seg_start AS \"Start\", seg_end AS \"End\", value AS \"Score\", strand AS \"Strand\" FROM {COVS} WHERE value != 0", "to_ranges")(lambda spark, d: covs(spark, d).to_ranges())
query(f"SELECT chromosome, list(seg_end - seg_start ORDER BY seg_start)::VARCHAR AS runs FROM {ENCODED} GROUP BY chromosome", "packed")(lambda spark, d: SegmentFrame.from_dense(event_cells(spark, d), **EXACT).packed().select("chromosome", F.concat(F.lit("["), F.array_join(F.transform("runs", lambda r: r.cast("string")), ", "), F.lit("]")).alias("runs")))
