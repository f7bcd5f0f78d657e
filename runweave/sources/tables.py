"""Views of the test tables as intervals and dense vectors, and the CSV exchange format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import SegmentFrame

DAY_ZERO = "1995-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit(DAY_ZERO).cast("date")).cast("long")


def line_intervals(spark: SparkSession, sf_dir: str, by_supplier: bool = False) -> DataFrame:
    """Line items as intervals of as many days as their quantity, by return flag (or supplier) and line status."""
    name = F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")) if by_supplier else F.col("l_returnflag")
    start = _days("l_shipdate")
    strand = F.when(F.col("l_linestatus") == "F", "+").otherwise("-")
    return read(spark, sf_dir, "lineitem").select(name.alias("chromosome"), strand.alias("strand"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_quantity").alias("score"), "l_suppkey")


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as query intervals of 0 to 29 days, dealt to the return flags; ``ordinal`` is the order's key."""
    start = _days("o_orderdate")
    flag = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(flag.alias("chromosome"), start.alias("start"), (start + F.col("o_orderkey") % 30).alias("end"), F.col("o_orderkey").alias("ordinal"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dense vectors by type: hundreds of their value, in order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("chromosome"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.floor(F.col("value") / 100).cast("double").alias("value"))


def write_runs_csv(frame: SegmentFrame, path: str, sep: str = "\t") -> None:
    """``Chromosome[, Strand], Runs, Values`` and ``Index``, the run's place in its vector, as a folder of CSV files."""
    names = {"chromosome": "Chromosome", "strand": "Strand"}
    out = frame.df.select(*[F.col(k).alias(names[k]) for k in frame.keys], (F.col("seg_end") - F.col("seg_start")).alias("Runs"), F.col("value").alias("Values"), F.col("seg_start").alias("Index"))
    out.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def read_runs_csv(spark: SparkSession, path: str, sep: str = "\t", **how) -> SegmentFrame:
    """Vectors from CSV with a header. Without a column ``Index`` the order of the lines counts; that is only sure for one file."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    ordinal = F.col("Index").cast("long") if "Index" in raw.columns else F.monotonically_increasing_id()
    keys = [F.col(n).alias(n.lower()) for n in ("Chromosome", "Strand") if n in raw.columns]
    return SegmentFrame.from_runs(raw.select(*(keys or [F.lit("").alias("chromosome")]), F.col("Runs").cast("long").alias("Runs"), F.col("Values").cast("double").alias("Values"), ordinal.alias("o")), "o", **how)
