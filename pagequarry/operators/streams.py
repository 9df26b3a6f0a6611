"""Comparison of two readings of a page: how each groups its lines into blocks, orders them and routes them to stores.

Pairs of lines are never formed: they are counted from the sizes of groups, and pairs in another order by merging.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagequarry.functions.geometry import Box, cover, touches

KEYS = ["sys", "page_id"]
#: Thresholds of the verdict, and the moves between stores that count (fixed values).
TIER1 = {"orphan_rate": 0.12, "cross_merge_rate": 0.25, "excess_band_transitions": 2, "bucket_move_rate": 0.35}
MOVES = ["TABLE->TEXT", "TEXT->TABLE", "TEXT->DISCARD", "TEXT->MEDIA"]


def structural_keys(lines: DataFrame, bands: DataFrame, areas: DataFrame, least: float = 0.6) -> DataFrame:
    """(page_id, line_id, band, grid, graphic): the only band that takes more than half of a line, and the first grid and
    graphic that hold ``least`` of it; null where there is none."""
    l, a = lines.alias("l"), areas.alias("a")
    on = (F.col("l.page_id") == F.col("a.page_id")) & touches(Box("l."), Box("a.")) & (cover(Box("l."), Box("a.")) >= least)
    of = lambda kind: F.min(F.when(F.col("a.kind") == kind, F.col("a.area_id")))
    held = l.join(a, on).groupBy("l.page_id", "l.line_id").agg(of("grid").alias("grid"), of("graphic").alias("graphic"))
    taken = F.filter("bands", lambda b: F.least(F.col("x2"), b["x9"]) - F.greatest(F.col("x1"), b["x0"]) > 0.5 * (F.col("x2") - F.col("x1")))
    banded = lines.join(bands.select("page_id", "bands"), "page_id", "left").select("page_id", "line_id", F.when(F.size(taken) == 1, taken[0]["band_id"]).alias("band"))
    return banded.join(held, ["page_id", "line_id"], "left")


def inversions(order: np.ndarray) -> int:
    """Pairs that stand in falling order, by merging."""
    n, width, count, v = len(order), 1, 0, np.asarray(order)
    while width < n:
        parts = []
        for at in range(0, n, 2 * width):
            a, b = v[at : at + width], v[at + width : at + 2 * width]
            count += int((len(a) - np.searchsorted(a, b, side="right")).sum())
            parts.append(np.sort(np.concatenate([a, b])))
        v, width = np.concatenate(parts), 2 * width
    return count


@F.pandas_udf(T.LongType())
def out_of_order(order: pd.Series) -> pd.Series:
    return pd.Series([inversions(np.asarray(v)) for v in order], dtype="int64")


def pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def compared(lines: DataFrame, stream: DataFrame, reference: DataFrame) -> DataFrame:
    """One row a line of ``lines`` (page_id, line_id, band, grid, graphic) and system of ``stream``: its block, place and
    bucket there and in ``reference`` (page_id, line_id, block, place, bucket, evidenced), null where it is in none."""
    ref = reference.select("page_id", "line_id", F.col("block").alias("ref_block"), F.col("place").alias("ref_place"), F.col("bucket").alias("ref_bucket"), "evidenced")
    both = lines.join(ref, ["page_id", "line_id"], "left")
    systems = F.broadcast(stream.select("sys").distinct())  # registered detectors
    return both.join(systems).join(stream.select("sys", "page_id", "line_id", "block", "place", "bucket"), ["sys", "page_id", "line_id"], "left")


def compare(x: DataFrame) -> DataFrame:
    """(sys, page_id, n_lines, n_compared, orphan_rate, ref_orphan_rate, grouping_precision, grouping_recall, cross_merge_rate,
    cross_merge_regions, order_tau, order_inversion_rate, band_transitions, excess_band_transitions, bucket_confusion,
    bucket_scored, bucket_move_rate) over rows of ``compared``; what lies behind the orphan rates is null, and the confusion
    empty, where fewer than two lines are in both. Places are distinct within a stream.
    """
    common = F.col("block").isNotNull() & F.col("ref_block").isNotNull()
    same = x.where(common)
    # lines of a block that share grid and graphic conflict only by band, and a line without a band with none
    unit = same.groupBy(*KEYS, "block", "grid", "graphic", "band").agg(F.count(F.lit(1)).alias("n"))
    unit = unit.groupBy(*KEYS, "block", "grid", "graphic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("band").isNotNull(), F.col("n")).otherwise(0)).alias("banded"), F.sum(F.when(F.col("band").isNotNull(), F.col("n") * F.col("n")).otherwise(0)).alias("squares"))
    block = unit.groupBy(*KEYS, "block").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n")) - (F.col("banded") * F.col("banded") - F.col("squares")) / 2).alias("fine"))
    block = block.withColumn("off", pairs(F.col("n")) - F.col("fine"))
    mine = block.groupBy(*KEYS).agg(F.sum(pairs(F.col("n"))).alias("grouped"), F.sum("off").alias("off"), F.array_sort(F.collect_list(F.when(F.col("off") > 0, F.col("block")))).alias("cross_merge_regions"))
    theirs = same.groupBy(*KEYS, "ref_block").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEYS).agg(F.sum(pairs(F.col("n"))).alias("ref_grouped"))
    both = same.groupBy(*KEYS, "block", "ref_block").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEYS).agg(F.sum(pairs(F.col("n"))).alias("together"))
    moved = same.where("evidenced AND bucket <> ref_bucket").groupBy(*KEYS, F.concat("ref_bucket", F.lit("->"), "bucket").alias("move")).agg(F.count(F.lit(1)).alias("n"))
    moves = moved.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("move", "n")))).alias("bucket_confusion"), F.sum("n").alias("n_moved"))
    before = F.lag("band").over(Window.partitionBy(*KEYS).orderBy("place"))
    turns = x.where("place IS NOT NULL AND band IS NOT NULL").withColumn("before", before).groupBy(*KEYS).agg(F.count_if(F.col("band") != F.col("before")).alias("turns"))
    page = x.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(common).alias("n_compared"), F.count_if(F.col("block").isNull()).alias("lost"), F.count_if(F.col("ref_block").isNull()).alias("ref_lost"), F.countDistinct("band").alias("n_bands"),
        F.count_if(common & F.coalesce("evidenced", F.lit(False))).alias("scored"), F.array_sort(F.collect_list(F.when(common, F.struct("place", "ref_place")))).alias("order"),
    ).withColumn("falling", out_of_order(F.col("order")["ref_place"]))
    for more in (mine, theirs, both, moves, turns):
        page = page.join(more, KEYS, "left")
    n, all_pairs = F.col("n_compared"), pairs(F.col("n_compared"))
    enough = n >= 2
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    turned = F.coalesce("turns", F.lit(0)).cast("long")
    return page.select(
        *KEYS, "n_lines", "n_compared", F.round(F.col("lost") / F.col("n_lines"), 4).alias("orphan_rate"), F.round(F.col("ref_lost") / F.col("n_lines"), 4).alias("ref_orphan_rate"), F.when(enough, share("together", "grouped")).alias("grouping_precision"),
        F.when(enough, share("together", "ref_grouped")).alias("grouping_recall"), F.when(enough, F.coalesce(share("off", "grouped"), F.lit(0.0))).alias("cross_merge_rate"), F.when(enough, F.col("cross_merge_regions")).alias("cross_merge_regions"),
        F.when(enough, F.round((all_pairs - 2 * F.col("falling")) / all_pairs, 4)).alias("order_tau"), F.when(enough, F.round(F.col("falling") / all_pairs, 4)).alias("order_inversion_rate"), F.when(enough, turned).alias("band_transitions"),
        F.when(enough, F.greatest(turned - F.greatest(F.col("n_bands") - 1, F.lit(0)), F.lit(0))).alias("excess_band_transitions"), F.coalesce("bucket_confusion", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("bucket_confusion"), F.when(enough, F.col("scored")).alias("bucket_scored"),
        F.when(enough, F.coalesce(F.round(F.coalesce("n_moved", F.lit(0)) / F.nullif(F.col("scored"), F.lit(0)), 4), F.lit(0.0))).alias("bucket_move_rate"),
    )


def verdict(compared_pages: DataFrame) -> DataFrame:
    """The pages with ``tier1`` and ``reasons``: what costs content, columns or a store, and nothing else."""
    moved = F.aggregate(F.map_values(F.map_filter("bucket_confusion", lambda k, v: k.isin(MOVES))), F.lit(0).cast("long"), lambda a, v: a + v)
    over = {
        "content lost": F.col("orphan_rate") > TIER1["orphan_rate"], "merged across a boundary": F.col("cross_merge_rate") > TIER1["cross_merge_rate"],
        "columns in ping-pong": F.col("excess_band_transitions") > TIER1["excess_band_transitions"], "wrong store": moved / F.nullif(F.col("bucket_scored"), F.lit(0)) > TIER1["bucket_move_rate"],
    }
    reasons = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in over.items()]))
    return compared_pages.withColumn("reasons", reasons).withColumn("tier1", F.size("reasons") > 0)
