"""Spatial joins of lines, regions and areas, page by page.

Every join has the page as its equal key and the boxes' ranges as residual conditions, so a page's candidates stay few
and the planner chooses how pages meet. Ties go by stored indices, never by row order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.geometry import Box, area, bucket, cover, intersection, iou, overlap_1d, touches

SIDES = ["x1", "y1", "x2", "y2"]


def assign_lines(lines: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """(sys, page_id, line_id, blk, cov): for each line and system the region that covers most of it, ``least`` at the
    least; of equal covers the region of least index."""
    l, r = lines.alias("l"), regions.alias("r")
    met = l.join(r, (F.col("l.page_id") == F.col("r.page_id")) & touches(Box("l."), Box("r."))).select("r.sys", "l.page_id", "l.line_id", "r.blk", cover(Box("l."), Box("r.")).alias("cov"))
    best = Window.partitionBy("sys", "page_id", "line_id").orderBy(F.desc("cov"), "blk")
    return met.where(F.col("cov") >= least).withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def orphans(lines: DataFrame, systems: DataFrame, owned: DataFrame) -> DataFrame:
    """(sys, page_id, line_id) of lines that no region of a system owns."""
    every = lines.select("page_id", "line_id").join(F.broadcast(systems))  # systems: a few registered detectors
    return every.join(owned, ["sys", "page_id", "line_id"], "left_anti").select("sys", "page_id", "line_id")


def covered_by_class(lines: DataFrame, regions: DataFrame, buckets: list[str], least: float = 0.5, missing: bool = False) -> DataFrame:
    """Per system, lines that some region of the buckets covers (semi-join), or none does (``missing``: anti-join)."""
    r = regions.where(bucket(F.col("cls")).isin(buckets)).alias("r")
    l = regions.select("sys", "page_id").distinct().join(lines, "page_id").alias("l")
    on = (F.col("l.page_id") == F.col("r.page_id")) & (F.col("l.sys") == F.col("r.sys")) & touches(Box("l."), Box("r.")) & (cover(Box("l."), Box("r.")) >= least)
    return l.join(r, on, "left_anti" if missing else "left_semi").select("sys", "page_id", "line_id")


def repeats(regions: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(sys, page_id, blk): regions within ``tolerance`` on all sides of an earlier one of their bucket."""
    b = regions.withColumn("bucket", bucket(F.col("cls")))
    l, r = b.alias("l"), b.alias("r")
    on = (F.col("l.page_id") == F.col("r.page_id")) & (F.col("l.sys") == F.col("r.sys")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("r.blk") < F.col("l.blk"))
    for c in ("x1", "y1", "x2", "y2"):
        on = on & (F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tolerance)
    return l.join(r, on, "left_semi").select("sys", "page_id", "blk")


def best_match(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(page_id, blk, other, iou): for each region of ``left`` the region of ``right`` of greatest overlap."""
    l, r = left.alias("l"), right.alias("r")
    met = l.join(r, (F.col("l.page_id") == F.col("r.page_id")) & touches(Box("l."), Box("r."))).select("l.page_id", "l.blk", F.col("r.blk").alias("other"), iou(Box("l."), Box("r.")).alias("iou"))
    return met.where(F.col("iou") >= least).withColumn("k", F.row_number().over(Window.partitionBy("page_id", "blk").orderBy(F.desc("iou"), "other"))).where("k = 1").drop("k")


def band_of(boxes: DataFrame, bands: DataFrame, page_width: float, full: float = 0.62, least: float = 0.5) -> DataFrame:
    """``boxes`` with ``band``: the only band of the page that takes more than ``least`` of the width; none for wide boxes.

    ``bands`` (page_id, bands) has a page's bands in one row, so a box stays one row.
    """
    width = F.col("x2") - F.col("x1")
    taken = F.filter("bands", lambda b: F.least(F.col("x2"), b["x9"]) - F.greatest(F.col("x1"), b["x0"]) > least * width)
    one = F.when((width <= full * page_width) & (F.size(taken) == 1), taken[0]["band_id"])
    return boxes.join(bands.select("page_id", "bands"), "page_id", "left").withColumn("band", one).drop("bands")


def in_rows_of(left: Column, right: Column) -> Column:
    """The boxes of ``left`` that share their row with one of ``right``, by more than half of their height."""
    height = lambda q: F.greatest(q["y2"] - q["y1"], F.lit(1e-6))
    return F.filter(left, lambda q: F.exists(right, lambda r: F.least(q["y2"], r["y2"]) - F.greatest(q["y1"], r["y1"]) > 0.5 * height(q)))


def merged_bands(bands: Column, lines: Column, most: float = 0.5) -> Column:
    """Bands of running text. Neighbours become one where more than ``most`` of the left one's lines share their row with a
    line of the right one, as a table's columns do; a band grows as it takes in the next."""
    within = lambda b: F.filter(lines, lambda q: (q["x1"] >= b["x0"] - 2) & (q["x2"] <= b["x9"] + 2))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        left, right = within(last), within(b)
        same = (F.size(left) > 0) & (F.size(right) > 0) & (F.size(in_rows_of(left, right)) > most * F.size(left))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["band_id"].alias("band_id"), last["x0"].alias("x0"), b["x9"].alias("x9"))))
        return F.when(same, grown).otherwise(F.concat(done, F.array(b)))

    folded = F.aggregate(F.slice(bands, F.lit(2), F.greatest(F.size(bands) - 1, F.lit(0))), F.slice(bands, 1, 1), step)
    return F.when(F.size(bands) > 1, folded).otherwise(bands)


def page_columns(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """(page_id, bands): the bands of running text of each page."""
    held = bands.join(lines.groupBy("page_id").agg(F.collect_list(F.struct(*SIDES)).alias("ls")), "page_id", "left")
    return held.select("page_id", F.when(F.col("ls").isNull(), F.col("bands")).otherwise(merged_bands(F.col("bands"), F.col("ls"))).alias("bands"))


def covered_cells(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, stride: int) -> tuple[int, int]:
    """Cells of the grid that boxes cover, and those that two boxes or more cover; counted between the boxes' edges."""
    a, b, c, d = np.floor(x1 / stride), np.floor(y1 / stride), np.ceil(x2 / stride), np.ceil(y2 / stride)
    some = (c > a) & (d > b)
    if not some.any():
        return 0, 0
    a, b, c, d = a[some], b[some], c[some], d[some]
    xs, ys = np.unique(np.concatenate([a, c])), np.unique(np.concatenate([b, d]))
    depth = np.zeros((len(ys), len(xs)), dtype=np.int32)
    i, j, k, m = np.searchsorted(xs, a), np.searchsorted(ys, b), np.searchsorted(xs, c), np.searchsorted(ys, d)
    for at_y, at_x, n in ((j, i, 1), (j, k, -1), (m, i, -1), (m, k, 1)):
        np.add.at(depth, (at_y, at_x), n)
    depth = depth.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
    cells = np.outer(np.diff(ys), np.diff(xs))
    return int(cells[depth > 0].sum()), int(cells[depth > 1].sum())


def union_area(boxes: DataFrame, keys: list[str], stride: int = 4) -> DataFrame:
    """Area of the union of boxes per key, on a grid of ``stride`` pixels, and the area of cells that several boxes share.

    A key's boxes are one row of arrays; the grid is looked at only where boxes begin or end, so work follows the number
    of boxes, not their size.
    """

    @F.pandas_udf("struct<area: long, shared: long>")
    def areas(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        found = [covered_cells(*(np.asarray(v, dtype=float) for v in page), stride) for page in zip(x1, y1, x2, y2)]
        return pd.DataFrame(found, columns=["area", "shared"], dtype="int64") * stride * stride

    page = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("b"))
    return page.select(*keys, areas(*[F.col("b")[c] for c in ("x1", "y1", "x2", "y2")]).alias("a")).select(*keys, "a.*")
