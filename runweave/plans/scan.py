"""Ordered scans over the rows of each key: running sums, fill-forward, neighbours.

Plain form: one window per key, one shuffle. Tiled form, for keys too long for one task: positions are cut
into tiles, windows run per (key, tile), and what crosses a tile's border comes from one summary row for each tile. A
tile holds at most ``tile`` distinct positions, so no task's share grows with its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: ``number`` cuts the ordinals into 2 ** so many tiles.
NUMBER_BITS = 10


def scan(df: DataFrame, keys: list[str], pos: str | list[str], sums: tuple[str, ...] = (), fills: tuple[str, ...] = (), lags: tuple[str, ...] = (), leads: tuple[str, ...] = (), tile: int | None = None) -> DataFrame:
    """``df`` with ``{c}_sum`` (of earlier rows), ``{c}_fill`` (last value so far that isn't null), ``{c}_lag``, ``{c}_lead``.

    ``pos``: a column, or (without ``tile``) several.
    """
    by = list(keys)
    if tile:
        df = df.withColumn("_tile", F.floor(F.col(pos) / tile))
        by = [*keys, "_tile"]
    rows = Window.partitionBy(*by).orderBy(pos)
    earlier, so_far = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(Window.unboundedPreceding, 0)
    made = {f"{c}_sum": F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in sums}
    made |= {f"{c}_fill": F.last(c, ignorenulls=True).over(so_far) for c in fills}
    made |= {f"{c}_lag": F.lag(c).over(rows) for c in lags} | {f"{c}_lead": F.lead(c).over(rows) for c in leads}
    if not tile:
        return df.withColumns(made)
    first, last = [F.min_by(c, pos).alias(f"_first_{c}") for c in leads], [F.max_by(c, pos).alias(f"_last_{c}") for c in lags]
    facts = [F.sum(c).alias(f"_sum_{c}") for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_fill_{c}") for c in fills]
    tiles = df.groupBy(*by).agg(F.count("*").alias("_rows"), *facts, *first, *last)
    across = Window.partitionBy(*keys).orderBy("_tile")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0.0)).alias(f"_sum_{c}") for c in sums] + [F.last(f"_fill_{c}", ignorenulls=True).over(before).alias(f"_fill_{c}") for c in fills]
    carried += [F.lag(f"_last_{c}").over(across).alias(f"_last_{c}") for c in lags] + [F.lead(f"_first_{c}").over(across).alias(f"_first_{c}") for c in leads]
    tiles = tiles.select(*by, *carried)
    out = df.withColumns(made | {"_top": F.row_number().over(rows) == 1, "_end": F.lead(pos).over(rows).isNull()}).join(tiles, by)
    joined = {f"{c}_sum": F.col(f"{c}_sum") + F.col(f"_sum_{c}") for c in sums} | {f"{c}_fill": F.coalesce(f"{c}_fill", f"_fill_{c}") for c in fills}
    joined |= {f"{c}_lag": F.when(F.col("_top"), F.col(f"_last_{c}")).otherwise(F.col(f"{c}_lag")) for c in lags}
    joined |= {f"{c}_lead": F.when(F.col("_end"), F.col(f"_first_{c}")).otherwise(F.col(f"{c}_lead")) for c in leads}
    return out.withColumns(joined).drop("_tile", "_top", "_end", *[c for c in tiles.columns if c.startswith(("_sum_", "_fill_", "_last_", "_first_"))])


def number(df: DataFrame, keys: list[str], ordinal: str, name: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 0, among its key's rows in the order of ``ordinal``, a column of whole numbers.

    All rows are numbered within (key, tile), and the rows of a key's earlier tiles are added. The tiles' borders are the ordinals of
    least hash, so they lie where the ordinals do, however unevenly, and are the same each time that they are made: a tile holds more than
    about a hundredth of all rows only if their ordinals are equal.
    """
    o = F.col(ordinal)
    drawn = df.select(o.alias("_cut"), F.xxhash64(o).alias("_hash")).where("_cut IS NOT NULL").orderBy("_hash", "_cut").limit(2**NUMBER_BITS - 1)
    dealt = df.crossJoin(F.broadcast(drawn.agg(F.sort_array(F.collect_list("_cut")).alias("_cuts")))).withColumn("_tile", F.lit(0))
    for bit in reversed(range(NUMBER_BITS)):  # how many borders are at or below the ordinal, by halving
        dealt = dealt.withColumn("_tile", F.col("_tile") + F.when(F.get("_cuts", F.col("_tile") + (2**bit - 1)) <= o, 2**bit).otherwise(0))
    dealt = dealt.drop("_cuts")
    earlier = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = dealt.groupBy(*keys, "_tile").agg(F.count("*").alias("_n")).select(*keys, "_tile", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_tile").orderBy(ordinal)))
    return placed.join(tiles, [*keys, "_tile"]).withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_tile", "_before", "_place")
