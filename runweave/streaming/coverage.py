"""Coverage of a stream of intervals: the state is one delta for each key and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frame import SegmentFrame
from ..plans.scan import scan


def deltas(intervals: DataFrame, keys: list[str], value_col: str | None = None) -> DataFrame:
    """``keys, pos, d``; over a stream, write it in update or complete mode."""
    w = (F.col(value_col) if value_col else F.lit(1.0)).cast("double")
    events = F.array(F.struct(F.col("start").cast("long").alias("pos"), w.alias("d")), F.struct(F.col("end").cast("long").alias("pos"), (-w).alias("d")))
    return intervals.select(*keys, F.explode(events).alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))


def from_deltas(state: DataFrame, **how) -> SegmentFrame:
    """The vectors that a (batch read of a) table of deltas stands for."""
    keys = [k for k in ("chromosome", "strand") if k in state.columns]
    steps = scan(state, keys, "pos", sums=("d",), lags=("pos",)).select(*keys, F.coalesce("pos_lag", F.lit(0)).alias("seg_start"), F.col("pos").alias("seg_end"), F.col("d_sum").alias("value"))
    return SegmentFrame(steps.where("seg_end > seg_start"), **how).coalesce("seg_end")
