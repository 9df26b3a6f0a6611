"""Metrics of a page's predicted regions against its lines, areas and bands, and what reports draw from them.

A page's lines and areas, and its regions of all systems, are one row of arrays each, joined by the page: the only shuffle.
Areas are counted between the edges of boxes on a grid, so a page's work is bounded by its boxes and by the grid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagequarry.functions.geometry import score_band
from pagequarry.operators.checks import covers, shared
from pagequarry.operators.spatial import SIDES

#: Grid in pixels and classes of each kind (fixed values).
GRID = 4
TEXT_CLASSES = ["text", "title", "heading", "list", "caption", "footnote", "header", "footer", "sidebar", "page_number", "formula"]
FIGURE_CLASSES, TABLE_CLASSES = ["figure"], ["table"]
TEXT, FIGURE, TABLE, OTHER = range(4)
BODY, GRAPHIC, GRIDDED = range(3)

COUNTED = "ref_text pred_text text_hit text_table_hit spill ref_graphic graphic_hit graphic_all ref_grid table_hit table_all covered overlapped".split()
LINED = "n_body captured partly split n_all all_captured n_graphic graphic_captured n_gridded gridded_captured".split()
MEASURED = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTED + LINED], T.StructField("cover_mean", T.DoubleType())])


def depth(boxes: np.ndarray, xs: np.ndarray, ys: np.ndarray, page: tuple[int, int]) -> np.ndarray:
    """How many boxes (rows x1, y1, x2, y2) cover each cell between the edges ``xs`` and ``ys``."""
    out = np.zeros((len(ys), len(xs)), dtype=np.int32)
    a, b, c, d = cells(boxes, page)
    for y, x, n in ((b, a, 1), (b, c, -1), (d, a, -1), (d, c, 1)):
        np.add.at(out, (np.searchsorted(ys, y), np.searchsorted(xs, x)), n)
    return out.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]


def cells(boxes: np.ndarray, page: tuple[int, int]) -> np.ndarray:
    """First and last grid lines of boxes, within the page; boxes without a cell go."""
    a, b = (np.clip(np.floor(boxes[k] / GRID), 0, page[k]) for k in (0, 1))
    c, d = (np.clip(np.ceil(boxes[k] / GRID), 0, page[k - 2]) for k in (2, 3))
    found = np.stack([a, b, c, d])
    return found[:, (c > a) & (d > b)]


def overlaid(line: np.ndarray, line_kind: np.ndarray, graphics: np.ndarray, grids: np.ndarray, box: np.ndarray, kind: np.ndarray, page: tuple[int, int]) -> list[int]:
    """The areas of COUNTED, in cells."""
    edges = [cells(b, page) for b in (line, graphics, grids, box)]
    xs, ys = (np.unique(np.concatenate([[0], *[e[k] for e in edges], *[e[k + 2] for e in edges]])) for k in (0, 1))
    size = np.outer(np.diff(ys), np.diff(xs))
    on = lambda b: depth(b, xs, ys, page)
    n = lambda mask: int(size[mask].sum())
    ref, graphic, grid = on(line[:, line_kind == BODY]) > 0, on(graphics) > 0, on(grids) > 0
    text, figure, table, every = on(box[:, kind == TEXT]) > 0, on(box[:, kind == FIGURE]) > 0, on(box[:, kind == TABLE]) > 0, on(box)
    return [n(ref), n(text), n(ref & text), n(ref & (text | table)), n(text & ~(ref | graphic)), n(graphic), n(graphic & figure), n(graphic | figure), n(grid), n(grid & table), n(grid | table), n(every > 0), n(every > 1)]


def union_cover(line: np.ndarray, box: np.ndarray, most: int = 400_000) -> np.ndarray:
    """Share of each line that boxes cover together: exact for one box, on pixels from the line's corner for more; for lines
    of more than ``most`` pixels the boxes' shares are added, up to 1."""
    met = shared(line, box)
    out = covers(line, box).sum(axis=1)
    for i in np.flatnonzero((met > 0).sum(axis=1) > 1):
        x, y = line[0, i], line[1, i]
        w, h = max(1, math.ceil(line[2, i] - x)), max(1, math.ceil(line[3, i] - y))
        if w * h > most:
            out[i] = min(1.0, out[i])
            continue
        mask = np.zeros((h, w), dtype=bool)
        for a, b, c, d in box[:, met[i] > 0].T:
            mask[int(max(b, y) - y) : math.ceil(min(d, line[3, i]) - y), int(max(a, x) - x) : math.ceil(min(c, line[2, i]) - x)] = True
        out[i] = mask.mean()
    return out


def captured(line: np.ndarray, line_kind: np.ndarray, box: np.ndarray, kind: np.ndarray) -> list[float]:
    """The counts of LINED, then the mean cover of body lines."""
    body, text = line[:, line_kind == BODY], box[:, kind == TEXT]
    c = union_cover(body, text)
    part = covers(body, text)
    cut = ((part > 0.12) & (part < 0.88)).any(axis=1).sum() if text.shape[1] else 0
    full = lambda l, b: int((union_cover(l, b) >= 0.9).sum())
    graphic, gridded = line[:, line_kind == GRAPHIC], line[:, line_kind == GRIDDED]
    return [
        body.shape[1], int((c >= 0.9).sum()), int(((c > 0.05) & (c < 0.9)).sum()), int(cut), line.shape[1], full(line, box), graphic.shape[1], full(graphic, box[:, kind == FIGURE]),
        gridded.shape[1], full(gridded, box[:, kind == TABLE]), float(c.mean()) if c.size else 0.0,
    ]


def boxes_of(v: object) -> np.ndarray:
    return np.asarray([list(x) for x in v], dtype=float) if len(v) and len(v[0]) else np.zeros((4, 0))


def held_by(line: np.ndarray, holders: np.ndarray, least: float = 0.6) -> np.ndarray:
    return (covers(line, holders) >= least).any(axis=1) if holders.shape[1] else np.zeros(line.shape[1], dtype=bool)


@F.pandas_udf(MEASURED)
def measured(line: pd.Series, graphics: pd.Series, grids: pd.Series, box: pd.Series, kind: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    out = []
    for ls, gs, ts, bs, k, w, h in zip(line, graphics, grids, box, kind, width, height):
        ls, gs, ts, bs, k = boxes_of(ls), boxes_of(gs), boxes_of(ts), boxes_of(bs), np.asarray(k, dtype=int)
        graphic, gridded = held_by(ls, gs), held_by(ls, ts)
        line_kind = np.where(graphic, GRAPHIC, np.where(gridded, GRIDDED, BODY))
        out.append([*overlaid(ls, line_kind, gs, ts, bs, k, (math.ceil(w / GRID), math.ceil(h / GRID))), *captured(ls, line_kind, bs, k)])
    return pd.DataFrame(out, columns=[*COUNTED, *LINED, "cover_mean"])


def corners(boxes: Column) -> Column:
    """Four arrays, one a side."""
    return F.array(*[boxes[c].cast("array<double>") for c in SIDES])


def not_a_box(r: Column, slack: float = 1.0) -> Column:
    """An outline of more than four points, or of four that are not the corners of the region's box."""
    at = F.transform(r["polygon"], lambda p: F.struct(F.rint(p["x"]).alias("x"), F.rint(p["y"]).alias("y")))
    xs, ys = F.transform(at, lambda p: p["x"]), F.transform(at, lambda p: p["y"])
    away = lambda p: F.least(p["x"] - F.array_min(xs), F.array_max(xs) - p["x"]) + F.least(p["y"] - F.array_min(ys), F.array_max(ys) - p["y"])
    odd = (F.size(at) > 4) | (F.size(F.array_distinct(at)) != 4) | F.exists(at, lambda p: away(p) > slack)
    return F.coalesce(F.size(r["polygon"]) >= 3, F.lit(False)) & odd


def page_metrics(pages: DataFrame, lines: DataFrame, areas: DataFrame, bands: DataFrame, regions: DataFrame, systems: list[int], width: float, height: float) -> DataFrame:
    """One row for each of ``systems`` and each row of ``pages`` (page_id, and optionally inference_s, total_s), with the
    metrics of its regions (sys, page_id, x1 .. y2, cls, and optionally polygon, reading_order).

    A share without a denominator is null, but ``overlap_ratio`` is 0 then; a page without lines or regions keeps its row.
    ``n_ref_grids`` and ``n_ref_graphics`` say what a page has to be found.
    """
    for name, kind in (("polygon", "array<struct<x: double, y: double>>"), ("reading_order", "long")):
        regions = regions if name in regions.columns else regions.withColumn(name, F.lit(None).cast(kind))
    for name in ("inference_s", "total_s"):
        pages = pages if name in pages.columns else pages.withColumn(name, F.lit(None).cast("double"))
    box = F.struct(*SIDES)
    sort = F.when(F.col("cls").isin(TEXT_CLASSES), TEXT).when(F.col("cls").isin(FIGURE_CLASSES), FIGURE).when(F.col("cls").isin(TABLE_CLASSES), TABLE).otherwise(OTHER)
    found = regions.groupBy("page_id").agg(F.collect_list(F.struct("sys", *SIDES, "cls", sort.alias("kind"), "polygon", "reading_order")).alias("rs"))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, box))
    held = areas.groupBy("page_id").agg(of("graphic").alias("graphics"), of("grid").alias("grids"))
    x = pages.select("page_id", "inference_s", "total_s").join(lines.groupBy("page_id").agg(F.collect_list(box).alias("ls")), "page_id", "left").join(held, "page_id", "left").join(bands.select("page_id", "bands"), "page_id", "left").join(found, "page_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.slice(F.col(c), 1, 0), F.from_json(F.lit("[]"), x.schema[c].dataType)).alias(c)
    x = x.select("page_id", "inference_s", "total_s", *[empty(c) for c in ("ls", "graphics", "grids", "bands", "rs")])
    x = x.withColumn("sys", F.explode(F.array(*[F.lit(s).cast("long") for s in systems]))).withColumn("rs", F.filter("rs", lambda r: r["sys"] == F.col("sys")))
    x = x.withColumn("m", measured(corners(F.col("ls")), corners(F.col("graphics")), corners(F.col("grids")), corners(F.col("rs")), F.col("rs")["kind"], F.lit(float(width)), F.lit(float(height))))
    x = x.withColumn("texts", F.filter("rs", lambda r: r["kind"] == TEXT)).withColumn("n_texts", F.size("texts"))
    b, several = F.col("bands"), F.size("bands") >= 2
    taken = lambda r, lo, hi: F.least(r["x2"], hi) - F.greatest(r["x1"], lo)
    bleeds = F.size(F.filter("texts", lambda r: F.size(F.filter(b, lambda d: taken(r, d["x0"], d["x9"]) > (d["x9"] - d["x0"]) * 0.2)) >= 2))
    gaps = F.filter(F.zip_with(F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0))), F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), lambda l, r: F.struct(l["x9"].alias("x0"), r["x0"].alias("x9"))), lambda g: g["x9"] > g["x0"])
    x = x.withColumn("gaps", F.when(several, gaps)).withColumn("column_bleed", F.when(several, bleeds).otherwise(0).cast("long"))
    x = x.withColumn("gutter_cross", F.when(several, F.size(F.filter("texts", lambda r: F.exists("gaps", lambda g: taken(r, g["x0"], g["x9"]) > (g["x9"] - g["x0"]) * 0.6)))).otherwise(0).cast("long"))
    share = lambda a, n: F.round(F.col(a) / F.nullif(F.col(n), F.lit(0)), 4)
    page_cells = math.ceil(width / GRID) * math.ceil(height / GRID)
    x = x.select("*", "m.*")
    return x.select(
        "sys", "page_id", F.size("rs").cast("long").alias("n_regions"), share("text_hit", "ref_text").alias("text_recall"), share("text_table_hit", "ref_text").alias("text_or_table_recall"), share("text_hit", "pred_text").alias("text_precision"),
        share("spill", "pred_text").alias("text_spill"), share("captured", "n_body").alias("line_capture"), share("partly", "n_body").alias("line_partial_rate"), F.when(F.col("n_body") > 0, F.round("cover_mean", 6)).alias("line_cover_mean"),
        share("all_captured", "n_all").alias("any_region_capture"), share("graphic_captured", "n_graphic").alias("graphic_text_capture"), share("gridded_captured", "n_gridded").alias("table_text_capture"), share("split", "n_body").alias("line_split_rate"),
        share("n_texts", "n_body").alias("regions_per_line"), share("graphic_hit", "ref_graphic").alias("graphic_recall"), share("graphic_hit", "graphic_all").alias("graphic_iou"), share("table_hit", "ref_grid").alias("table_recall"),
        share("table_hit", "table_all").alias("table_iou"), F.size("bands").cast("long").alias("n_ref_columns"), "column_bleed", "gutter_cross", share("gutter_cross", "n_texts").alias("gutter_cross_rate"), share("column_bleed", "n_texts").alias("column_bleed_rate"),
        F.round(F.col("covered") / page_cells, 4).alias("page_coverage"), F.coalesce(share("overlapped", "covered"), F.lit(0.0)).alias("overlap_ratio"), F.size(F.array_distinct(F.col("rs")["cls"])).cast("long").alias("class_diversity"),
        F.exists("rs", lambda r: not_a_box(r)).alias("has_polygons"), F.exists("rs", lambda r: F.coalesce(F.size(r["polygon"]) > 0, F.lit(False))).alias("has_polygon_field"), F.exists("rs", lambda r: r["reading_order"].isNotNull()).alias("has_reading_order"),
        "inference_s", "total_s", F.size("grids").cast("long").alias("n_ref_grids"), F.size("graphics").cast("long").alias("n_ref_graphics"),
    )


#: Metrics that are numbers, in the order of the page's row.
NUMERIC = """n_regions text_recall text_or_table_recall text_precision text_spill line_capture line_partial_rate line_cover_mean any_region_capture graphic_text_capture table_text_capture line_split_rate regions_per_line
graphic_recall graphic_iou table_recall table_iou n_ref_columns column_bleed gutter_cross gutter_cross_rate column_bleed_rate page_coverage overlap_ratio class_diversity inference_s total_s""".split()


def quantiles(values: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """(keys, mean, q): exact interpolated percentiles. Equal values are counted before they meet under their key, so what a
    task holds is the number of different values, not of rows; nulls are left out."""
    n = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg((F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"), F.percentile(value, F.array(*[F.lit(p) for p in points]), F.col("__n")).alias("q"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """(sys, metric, mean, median, p10, p90) over pages, to six places; a metric without a value has no row."""
    long = metrics.select("sys", *[F.col(c).cast("double").alias(c) for c in NUMERIC]).unpivot(["sys"], NUMERIC, "metric", "v")
    q = quantiles(long, ["sys", "metric"], "v", [0.5, 0.1, 0.9])
    return q.select("sys", "metric", F.round("mean", 6).alias("mean"), *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("median", "p10", "p90"))])


def class_presence(metrics: DataFrame, regions: DataFrame) -> DataFrame:
    """(sys, cls, total, presence): regions of a class, and the share of the system's pages that have one."""
    pages = metrics.groupBy("sys").agg(F.count(F.lit(1)).alias("n_pages"))
    per_page = regions.groupBy("sys", "cls", "page_id").agg(F.count(F.lit(1)).alias("n"))
    seen = per_page.groupBy("sys", "cls").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return seen.join(F.broadcast(pages), "sys").select("sys", "cls", "total", F.round(F.col("k") / F.col("n_pages"), 3).alias("presence"))  # pages: one row a system


def class_evidence(metrics: DataFrame, regions: DataFrame) -> DataFrame:
    """One row a system: medians on pages that have something to find, hit rates on pages with tables, and shares of pages
    with running matter and with captions.

    All come from one pass over ``metrics``, which may be a long plan. The medians' metrics are shares to four places, so a
    task holds some ten thousand different values at most.
    """
    of = lambda names: F.max(F.col("cls").isin(names).cast("int"))
    kinds = regions.groupBy("sys", "page_id").agg(of(["header", "footer", "page_number"]).alias("running"), of(["caption"]).alias("caption"))
    x = metrics.join(kinds, ["sys", "page_id"], "left")
    table, figure, columns = F.col("n_ref_grids") > 0, F.col("n_ref_graphics") > 0, F.col("n_ref_columns") >= 2
    subsets = {"table_iou_on_table_pages": (table, "table_iou"), "table_recall_on_table_pages": (table, "table_recall"), "figure_iou_on_figure_pages": (figure, "graphic_iou"), "text_recall_multicol": (columns, "text_recall"), "bleed_multicol": (columns, "column_bleed_rate")}
    medians = [F.round(F.percentile(F.when(on, F.col(c)), F.lit(0.5)), 6).alias(n) for n, (on, c) in subsets.items()]
    hit = lambda least: F.round(F.count_if(table & (F.coalesce("table_iou", F.lit(0.0)) >= least)) / F.greatest(F.count_if(table), F.lit(1)), 3)
    return x.groupBy("sys").agg(
        F.count_if(table).alias("n_table_pages"), hit(0.5).alias("table_hit_rate"), hit(0.2).alias("table_partial_rate"), F.round(F.avg(F.coalesce("running", F.lit(0))), 3).alias("headerfooter_pages"),
        F.round(F.avg(F.coalesce("caption", F.lit(0))), 3).alias("caption_pages"), (F.avg(F.col("has_reading_order").cast("int")) >= 0.5).alias("reading_order"), (F.avg(F.col("has_polygons").cast("int")) >= 0.5).alias("polygons"),
        *medians,
    )


#: Rated dimensions: weight, cuts, whether low is good, classes it depends on, whether it needs text to be found (fixed values).
DIMENSIONS = {
    "text": (3.0, (0.35, 0.60, 0.75, 0.85), False, ["text"], False),
    "headings": (1.5, (0.05, 0.20, 0.40, 0.60), False, ["heading", "title"], True),
    "tables": (2.0, (0.05, 0.20, 0.40, 0.60), False, ["table"], False),
    "figures": (2.0, (0.12, 0.25, 0.38, 0.47), False, ["figure"], False),
    "captions": (1.0, (0.05, 0.20, 0.40, 0.60), False, ["caption"], False),
    "lists": (0.5, (0.02, 0.10, 0.25, 0.45), False, ["list"], False),
    "formulas": (0.5, (0.02, 0.10, 0.25, 0.45), False, ["formula"], False),
    "running": (1.5, (0.10, 0.35, 0.60, 0.80), False, ["header", "footer", "page_number"], False),
    "columns": (2.0, (0.005, 0.010, 0.020, 0.040), True, ["text"], True),
    "boundaries": (2.0, (0.20, 0.35, 0.48, 0.58), False, ["text"], True),
}
BLIND = 0.20


def ratings(summary: DataFrame, presence: DataFrame, evidence: DataFrame, consensus: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(sys, one band of 1 to 5 a dimension, overall): null where the system's vocabulary (sys, cls) has none of the classes,
    or where so little text is found that the dimension cannot be seen. All inputs have a few rows a system."""
    medians = summary.where(F.col("metric").isin("text_or_table_recall", "graphic_iou", "gutter_cross_rate", "text_precision", "text_recall", "text_spill")).groupBy("sys").agg(F.map_from_entries(F.collect_list(F.struct("metric", "median"))).alias("m"))
    share = presence.groupBy("sys").agg(F.map_from_entries(F.collect_list(F.struct("cls", "presence"))).alias("p"))
    words = vocabulary.groupBy("sys").agg(F.collect_set("cls").alias("words"))
    x = medians.join(evidence, "sys").join(share, "sys", "left").join(words, "sys", "left").join(consensus.select("sys", "class_agreement"), "sys", "left")
    m, p = (lambda k: F.element_at("m", k)), (lambda k: F.coalesce(F.element_at("p", k), F.lit(0.0)))
    precision, recall = F.nullif(m("text_precision"), F.lit(0.0)), F.nullif(m("text_recall"), F.lit(0.0))
    value = {
        "text": m("text_or_table_recall"), "headings": (p("heading") + p("title")) * F.coalesce("class_agreement", F.lit(0.0)), "tables": F.col("table_hit_rate"), "figures": m("graphic_iou"), "captions": F.col("caption_pages"), "lists": p("list"), "formulas": p("formula"),
        "running": F.col("headerfooter_pages"), "columns": m("gutter_cross_rate"), "boundaries": 2 * precision * recall / (precision + recall) - F.coalesce(m("text_spill"), F.lit(0.0)),
    }
    blind = F.coalesce(m("text_or_table_recall"), F.lit(0.0)) < BLIND
    shown = lambda needs, sees: F.coalesce(F.arrays_overlap("words", F.array(*[F.lit(c) for c in needs])), F.lit(False)) & (~blind if sees else F.lit(True))
    x = x.select("sys", *[F.when(shown(needs, sees), score_band(value[n], cuts, low)).cast("long").alias(n) for n, (_, cuts, low, needs, sees) in DIMENSIONS.items()])
    total = sum((F.coalesce(w * F.col(n), F.lit(0.0)) for n, (w, *_) in DIMENSIONS.items()), F.lit(0.0))
    weight = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, (w, *_) in DIMENSIONS.items()), F.lit(0.0))
    return x.withColumn("overall", F.round(total / F.nullif(weight, F.lit(0.0)), 2))


def sign_p(k: int, n: int) -> float:
    """Two-sided sign test: twice the tail of a fair coin up to ``k`` of ``n``, 1 at most; terms are added until they vanish."""
    if n == 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total, i = term, k
    while i > 0 and term > total * 1e-17:
        term *= i / (n - i + 1)
        total, i = total + term, i - 1
    return min(2 * total, 1.0)


@F.pandas_udf(T.DoubleType())
def sign_test(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([sign_p(int(a), int(b)) for a, b in zip(k, n)], dtype=float)


def separability(metrics: DataFrame, metric: str, apart: float = 1e-9) -> DataFrame:
    """(sys, place, mean, leader, p_vs_leader): systems by their mean of a metric, and whether each can be told from the first
    that shows more than one class on a page. Equal means go by system; null values are left out.

    A page's values meet in one row, where each system is compared with every other, so one pass over ``metrics``, which may
    be a long plan, gives all that is needed once the leader is known; what remains is one row for each two systems.
    """
    x = metrics.select("sys", "page_id", F.col(metric).alias("v"), "class_diversity")
    page = x.groupBy("page_id").agg(F.collect_list(F.struct("sys", "v", "class_diversity")).alias("a"))
    pairs = page.select(F.explode("a").alias("a"), F.col("a").alias("others")).select("a", F.explode("others").alias("b"))
    d = F.col("a.v") - F.col("b.v")
    met = pairs.groupBy(F.col("a.sys").alias("sys"), F.col("b.sys").alias("other")).agg(
        F.avg(F.when(F.col("a.sys") == F.col("b.sys"), F.col("a.v"))).alias("mean"), F.max("a.class_diversity").alias("most"), F.count(d).alias("n"), F.count_if(d > apart).alias("up"), F.count_if(d < -apart).alias("down")
    )
    sides = F.map_from_entries(F.collect_list(F.struct("other", F.struct("n", "up", "down"))))
    s = met.groupBy("sys").agg(F.max("mean").alias("mean"), (F.max("most") <= 1).alias("single"), sides.alias("sides")).where("mean IS NOT NULL")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a system
    placed = s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "sys"))).withColumn("leader", F.min_by("sys", F.struct("single", "place")).over(every))
    found = placed.withColumn("t", F.element_at("sides", F.col("leader"))).where("t.n > 0")
    return found.select("sys", "place", F.round("mean", 4).alias("mean"), "leader", F.round(sign_test(F.least("t.up", "t.down"), F.col("t.up") + F.col("t.down")), 4).alias("p_vs_leader"))
