"""The three plans that everything else is made of: coverage, the two-sided sweep, and coalescing.

A segment table has key columns and ``seg_start, seg_end, value``; the segments of a key tile
``[0, length)`` without gap or overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import INF
from .scan import scan

#: Neighbouring runs closer than this to the first value of their group belong to the group.
TOLERANCE = 1e-5
SEGMENT = ["seg_start", "seg_end", "value"]


def _named(intervals: DataFrame, keys: list[str]) -> DataFrame:
    return intervals.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "start", "end"]))


def _start() -> Column:
    bad = (F.col("start") < 0) | (F.col("end") < F.col("start"))
    return F.when(bad, F.raise_error(F.lit("intervals need 0 <= start <= end")).cast("long")).otherwise(F.col("start").cast("long"))


def covered_keys(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that ``coverage`` has segments of, with repeats: those with an end past 0."""
    return _named(intervals, keys).where((_start() >= 0) & (F.col("end").cast("long") > 0)).select(*keys)


def coverage(intervals: DataFrame, keys: list[str], weight: Column | None = None, tile: int | None = None, repeats: bool = True) -> DataFrame:
    """Segments of the summed weights of ``intervals`` (keys, start, end): one pass of +w and -w events, in the order of ``seg_end``, uncoalesced.

    ``repeats``: sum up the events of a position before they are shuffled. False, for many short keys whose intervals seldom share
    positions: intervals go to their key's task as they are, where the steps between events of one position are empty.
    """
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    if repeats or tile:
        events = F.array(F.struct(_start().alias("pos"), w.alias("d")), F.struct(F.col("end").cast("long").alias("pos"), (-w).alias("d")))
        deltas = _named(intervals, keys).select(*keys, F.explode(events).alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    else:
        parts = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small ones aren't merged: what is sorted there is twice as much
        dealt = _named(intervals, keys).select(*keys, _start().alias("start"), F.col("end").cast("long").alias("end"), w.alias("w")).repartition(parts, *keys)
        events = F.array(F.struct(F.col("start").alias("pos"), F.col("w").alias("d")), F.struct(F.col("end").alias("pos"), (-F.col("w")).alias("d")))
        deltas = dealt.select(*keys, F.explode(events).alias("e")).select(*keys, "e.pos", "e.d")
    steps = scan(deltas, keys, "pos", sums=("d",), lags=("pos",), tile=tile)
    steps = steps.select(*keys, F.coalesce("pos_lag", F.lit(0)).alias("seg_start"), F.col("pos").alias("seg_end"), F.col("d_sum").alias("value"))
    return steps.where("seg_end > seg_start")


def _starts(side: DataFrame, keys: list[str], name: str, pad: float) -> DataFrame:
    """What holds from each position on, in column ``name`` (``x`` or ``y``): the runs' starts, and each key's end, where ``pad`` begins."""
    seen = scan(side, keys, "seg_end", leads=("seg_end",))
    start = F.struct(F.col("seg_start").alias("pos"), F.lit(True).alias("starts"), F.coalesce("value", F.lit(float(pad))).alias("v"))
    end = F.struct(F.col("seg_end").alias("pos"), F.lit(False).alias("starts"), F.lit(float(pad)).alias("v"))
    each = F.explode(F.array_compact(F.array(start, F.when(F.col("seg_end_lead").isNull(), end)))).alias("e")
    values = [(F.col("e.v") if n == name else F.lit(None).cast("double")).alias(n) for n in ("x", "y")]
    return seen.select(*keys, each).select(*keys, "e.pos", "e.starts", *values)


def sweep(x: DataFrame, y: DataFrame, keys: list[str], expr: Callable[[Column, Column], Column], pad: float = 0.0, tile: int | None = None) -> DataFrame:
    """Segments of ``expr(x, y)`` over both sides' breakpoints, full outer on keys; a side is ``pad`` where it has ended. Uncoalesced."""

    if not tile:
        filled = scan(_starts(x, keys, "x", pad).unionByName(_starts(y, keys, "y", pad)), keys, ["pos", "starts"], fills=("x", "y"), leads=("pos",)).where("pos_lead > pos")
        values = expr(F.coalesce("x_fill", F.lit(float(pad))), F.coalesce("y_fill", F.lit(float(pad))))
        return filled.select(*keys, F.col("pos").alias("seg_start"), F.col("pos_lead").alias("seg_end"), values.alias("value"))

    def events(side: DataFrame, name: str) -> DataFrame:
        each = F.array(*[F.struct(F.col(p).alias("pos"), v.alias("v"), F.lit(s).alias("starts")) for p, v, s in (("seg_start", F.col("value"), True), ("seg_end", F.lit(float(pad)), False))])
        return side.select(*keys, F.lit(name).alias("side"), F.explode(each).alias("e")).select(*keys, "side", "e.*")

    both = events(x, "x").unionByName(events(y, "y"))

    def own(name: str) -> Column:
        mine = F.col("side") == name
        return F.coalesce(F.max(F.when(mine & F.col("starts"), F.col("v"))), F.max(F.when(mine, F.lit(float(pad))))).alias(name)

    points = both.groupBy(*keys, "pos").agg(own("x"), own("y"))
    filled = scan(points, keys, "pos", fills=("x", "y"), leads=("pos",), tile=tile).where("pos_lead IS NOT NULL")
    values = expr(F.coalesce("x_fill", F.lit(float(pad))), F.coalesce("y_fill", F.lit(float(pad))))
    return filled.select(*keys, F.col("pos").alias("seg_start"), F.col("pos_lead").alias("seg_end"), values.alias("value"))


def coalesce_exact(segments: DataFrame, keys: list[str], tile: int | None = None, order: str = "seg_start") -> DataFrame:
    """Neighbouring runs of equal value (NaN equals NaN) as one, with the first one's value.

    ``order``: ``seg_start`` or ``seg_end``, whichever the rows are sorted by already; both scans then need no sort of their own.
    """
    seen = scan(segments, keys, order, lags=("value", "seg_end"), leads=("value", "seg_end"), tile=tile)
    first = F.col("seg_end_lag").isNull() | ~F.col("value").eqNullSafe(F.col("value_lag"))
    last = F.col("seg_end_lead").isNull() | ~F.col("value").eqNullSafe(F.col("value_lead"))
    edges = seen.select(*keys, *SEGMENT, first.alias("first"), last.alias("last")).where("first OR last")
    ends = scan(edges, keys, order, lags=("seg_start", "value"), tile=tile).where("last")
    own = lambda c: F.when(F.col("first"), F.col(c)).otherwise(F.col(f"{c}_lag")).alias(c)
    return ends.select(*keys, own("seg_start"), "seg_end", own("value"))


def coalesce_near(segments: DataFrame, keys: list[str], tile: int | None = None, order: str = "seg_start", tolerance: float = TOLERANCE) -> DataFrame:
    """As ``coalesce_exact``, and runs within ``tolerance`` of the *first* value of their group join it.

    Members of a group are each within the tolerance of its anchor, so neighbours within twice that form islands
    that groups cannot leave; only islands of several values are folded.
    """
    exact = coalesce_exact(segments, keys, tile, order)
    seen = scan(exact, keys, "seg_start", lags=("value",), leads=("value",), tile=tile)

    def near(other: str) -> Column:
        return F.coalesce((F.abs(F.col("value")) < INF) & (F.abs(F.col(other)) < INF) & (F.abs(F.col("value") - F.col(other)) < 2 * tolerance), F.lit(False))

    seen = seen.withColumns({"joins": near("value_lag"), "joined": near("value_lead")})
    alone = seen.where(~F.col("joins") & ~F.col("joined")).select(*keys, *SEGMENT)
    seen = seen.where("joins OR joined").withColumn("island", F.when(~F.col("joins"), F.col("seg_start")))
    islands = scan(seen, keys, "seg_start", fills=("island",), tile=tile).groupBy(*keys, "island_fill").agg(F.sort_array(F.collect_list(F.struct(*SEGMENT))).alias("runs"))
    kind = "array<struct<seg_start:bigint,seg_end:bigint,value:double>>"

    def fold(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["seg_start"].alias("seg_start"), run["seg_end"].alias("seg_end"), last["value"].alias("value"))))
        return F.when((F.size(done) > 0) & (F.abs(run["value"] - F.get(done, F.size(done) - 1)["value"]) < tolerance), longer).otherwise(F.concat(done, F.array(run)))

    groups = islands.select(*keys, F.explode(F.aggregate("runs", F.array().cast(kind), fold)).alias("g")).select(*keys, "g.*")
    return alone.unionByName(groups)
