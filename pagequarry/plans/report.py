"""Registered queries of page metrics and what reports draw from them, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import metrics
from pagequarry.plans import layout
from pagequarry.plans import queries as base

#: Stand-in outlines of regions, times of pages, and the classes that each system can tell.
KNOWN = {0: ["text", "table", "figure", "header", "heading", "list"], 1: ["text", "table", "figure", "header"], 2: ["text", "table", "figure"], 3: ["text", "header"]}
POINT = "struct(cast({0} as double) AS x, cast({1} as double) AS y)"
_CORNERS = [POINT.format(*p) for p in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]
_DIAMOND = [POINT.format(*p) for p in (("(x1 + x2) / 2", "y1"), ("x2", "(y1 + y2) / 2"), ("(x1 + x2) / 2", "y2"), ("x1", "(y1 + y2) / 2"))]


def outlined(spark: SparkSession, d: str) -> DataFrame:
    """Stretched regions; some pages of some systems have outlines, systems 0 to 2 an order."""
    at = "(page_id + sys) % 7"
    polygon = f"CASE WHEN {at} = 0 THEN array({', '.join([*_CORNERS, _CORNERS[0]])}) WHEN {at} = 1 THEN array({', '.join(_CORNERS)}) WHEN {at} = 2 THEN array({', '.join(_DIAMOND)}) END"
    return base.shifted(spark, d).selectExpr("*", f"{polygon} AS polygon", "CASE WHEN sys < 3 THEN blk END AS reading_order")


def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of all systems on all pages."""
    pages = layout.page_facts(spark, d).selectExpr("page_id", "cast(page_id % 7 as double) AS inference_s", "cast(page_id % 11 as double) AS total_s")
    return metrics.page_metrics(pages, layout.lines(spark, d), layout.areas(spark, d), layout.bands(spark, d), outlined(spark, d), list(range(4)), layout.PAGE_WIDTH, layout.PAGE_HEIGHT)


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_summary(page_metrics(spark, d))


def class_presence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_presence(page_metrics(spark, d), base.shifted(spark, d))


def class_evidence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_evidence(page_metrics(spark, d), base.shifted(spark, d))


def system_ratings(spark: SparkSession, d: str) -> DataFrame:
    # measured once for the three reports that draw from it
    m, r = page_metrics(spark, d).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY), base.shifted(spark, d)
    words = spark.createDataFrame([(s, c) for s, known in KNOWN.items() for c in known], "sys long, cls string")
    return metrics.ratings(metrics.metric_summary(m), metrics.class_presence(m, r), metrics.class_evidence(m, r), base.system_consensus(spark, d), words)


def separability(spark: SparkSession, d: str) -> DataFrame:
    return metrics.separability(page_metrics(spark, d), "text_or_table_recall")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (page_metrics, metric_summary, class_presence, class_evidence, system_ratings, separability)}

_INK = "((l.x2 - l.x1) * (l.y2 - l.y1))::DOUBLE"
_W, _H = -(-layout.PAGE_WIDTH // 4), -(-layout.PAGE_HEIGHT // 4)
_LAYERS = "ref text texttable graphic grid figure tables every".split()
_DEPTH = ", ".join(f"sum({c}) OVER w AS {c}" for c in _LAYERS)
_SHARE = "round({0}::DOUBLE / nullif({1}, 0), 4) AS {2}"
_AREA = {
    "ref": "ref > 0", "text": "text > 0", "hit": "ref > 0 AND text > 0", "both": "ref > 0 AND texttable > 0", "spill": "text > 0 AND ref = 0 AND graphic = 0", "graphic": "graphic > 0", "graphic_hit": "graphic > 0 AND figure > 0",
    "graphic_all": "graphic > 0 OR figure > 0", "grid": "grid > 0", "grid_hit": "grid > 0 AND tables > 0", "grid_all": "grid > 0 OR tables > 0", "covered": "every > 0", "twice": "every > 1",
}
_METRICS = f"""{base.WITH}, {base._SHIFTED}, {layout.AREAS_SQL}, systems AS (SELECT unnest(range(0, 4)) AS sys), pp AS (SELECT sys, page_id FROM pgs CROSS JOIN systems),
held AS (SELECT l.page_id, l.line_id, max(CASE r.kind WHEN 'graphic' THEN 2 ELSE 1 END) AS own FROM lines l JOIN areas r ON l.page_id = r.page_id AND {base.TOUCH} AND ({base.COVER}) / {_INK} >= 0.6 GROUP BY ALL),
ln AS (SELECT lines.*, coalesce(own, 0) AS own FROM lines LEFT JOIN held USING (page_id, line_id)),
rg AS (SELECT *, cls IN ('text', 'header') AS is_text FROM more),
bx AS (
  SELECT sys, page_id, x1, y1, x2, y2, 1 AS ref, 0 AS text, 0 AS texttable, 0 AS graphic, 0 AS grid, 0 AS figure, 0 AS tables, 0 AS every FROM ln JOIN pp USING (page_id) WHERE own = 0
  UNION ALL SELECT sys, page_id, x1, y1, x2, y2, 0, 0, 0, (kind = 'graphic')::INT, (kind = 'grid')::INT, 0, 0, 0 FROM areas JOIN pp USING (page_id)
  UNION ALL SELECT sys, page_id, x1, y1, x2, y2, 0, is_text::INT, (is_text OR cls = 'table')::INT, 0, 0, (cls = 'figure')::INT, (cls = 'table')::INT, 1 FROM rg),
gx AS (SELECT *, greatest(x1 // 4, 0) AS a, least((x2 + 3) // 4, {_W}) AS b, unnest(range(greatest(y1 // 4, 0), least((y2 + 3) // 4, {_H}))) AS row FROM bx),
st AS (SELECT sys, page_id, row, x, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _LAYERS)} FROM (
  SELECT sys, page_id, row, a AS x, {', '.join(_LAYERS)} FROM gx WHERE b > a UNION ALL SELECT sys, page_id, row, b, {', '.join(f'-{c}' for c in _LAYERS)} FROM gx WHERE b > a) GROUP BY ALL),
dp AS (SELECT sys, page_id, lead(x) OVER w - x AS len, {_DEPTH} FROM st WINDOW w AS (PARTITION BY sys, page_id, row ORDER BY x)),
ar AS (SELECT sys, page_id, {', '.join(f'coalesce(sum(len) FILTER ({v}), 0)::BIGINT AS {k}' for k, v in _AREA.items())} FROM dp GROUP BY ALL),
mt AS (SELECT r.sys, l.page_id, l.line_id, l.own, r.cls, r.is_text, greatest(l.x1, r.x1) AS x1, greatest(l.y1, r.y1) AS y1, least(l.x2, r.x2) AS x2, least(l.y2, r.y2) AS y2, {_INK} AS ink FROM ln l JOIN rg r ON l.page_id = r.page_id AND {base.TOUCH}),
ht AS (SELECT *, 'body' AS what FROM mt WHERE own = 0 AND is_text UNION ALL SELECT *, 'any' FROM mt UNION ALL SELECT *, 'graphic' FROM mt WHERE own = 2 AND cls = 'figure' UNION ALL SELECT *, 'grid' FROM mt WHERE own = 1 AND cls = 'table'),
rw AS (SELECT what, sys, page_id, line_id, ink, x1, x2, unnest(range(y1, y2)) AS row FROM ht),
re AS (SELECT what, sys, page_id, line_id, ink, row, x, sum(d)::BIGINT AS d FROM (SELECT *, x1 AS x, 1 AS d FROM rw UNION ALL SELECT *, x2, -1 FROM rw) GROUP BY ALL),
rl AS (SELECT what, sys, page_id, line_id, ink, lead(x) OVER w - x AS len, sum(d) OVER w AS deep FROM re WINDOW w AS (PARTITION BY what, sys, page_id, line_id, row ORDER BY x)),
cv AS (SELECT what, sys, page_id, line_id, sum(len) FILTER (deep > 0) / ink AS c FROM rl GROUP BY what, sys, page_id, line_id, ink),
cc AS (SELECT sys, page_id, count(*) FILTER (what = 'body' AND c >= 0.9) AS captured, count(*) FILTER (what = 'body' AND c > 0.05 AND c < 0.9) AS partly, sum(c) FILTER (what = 'body') AS cover, count(*) FILTER (what = 'any' AND c >= 0.9) AS anyway,
  count(*) FILTER (what = 'graphic' AND c >= 0.9) AS in_graphic, count(*) FILTER (what = 'grid' AND c >= 0.9) AS in_grid FROM cv GROUP BY ALL),
sp AS (SELECT sys, page_id, count(DISTINCT line_id) AS cut FROM ht WHERE what = 'body' AND (x2 - x1) * (y2 - y1) / ink > 0.12 AND (x2 - x1) * (y2 - y1) / ink < 0.88 GROUP BY ALL),
lc AS (SELECT page_id, count(*) AS n_all, count(*) FILTER (own = 0) AS n_body, count(*) FILTER (own = 2) AS n_graphic, count(*) FILTER (own = 1) AS n_grid FROM ln GROUP BY ALL),
bn AS (SELECT page_id, count(*) AS n_bands FROM raw_bands GROUP BY ALL),
rc AS (SELECT sys, page_id, count(*) AS n_regions, count(*) FILTER (is_text) AS n_text, count(DISTINCT cls) AS kinds,
  count(*) FILTER (is_text AND n_bands = 2 AND least(x2, 1100) - greatest(x1, 200) > 180 AND least(x2, 2200) - greatest(x1, 1300) > 180) AS bleed, count(*) FILTER (is_text AND n_bands = 2 AND least(x2, 1300) - greatest(x1, 1100) > 120) AS crossing
  FROM rg LEFT JOIN bn USING (page_id) GROUP BY ALL),
ac AS (SELECT page_id, count(*) FILTER (kind = 'grid') AS n_ref_grids, count(*) FILTER (kind = 'graphic') AS n_ref_graphics FROM areas GROUP BY ALL),
pm AS (SELECT sys, page_id, coalesce(n_regions, 0) AS n_regions, {_SHARE.format('hit', 'ref', 'text_recall')}, {_SHARE.format('"both"', 'ref', 'text_or_table_recall')}, {_SHARE.format('hit', 'text', 'text_precision')}, {_SHARE.format('spill', 'text', 'text_spill')},
  {_SHARE.format('coalesce(captured, 0)', 'n_body', 'line_capture')}, {_SHARE.format('coalesce(partly, 0)', 'n_body', 'line_partial_rate')}, round(coalesce(cover, 0) / nullif(n_body, 0), 6) AS line_cover_mean, {_SHARE.format('coalesce(anyway, 0)', 'n_all', 'any_region_capture')},
  {_SHARE.format('coalesce(in_graphic, 0)', 'n_graphic', 'graphic_text_capture')}, {_SHARE.format('coalesce(in_grid, 0)', 'n_grid', 'table_text_capture')}, {_SHARE.format('coalesce(cut, 0)', 'n_body', 'line_split_rate')}, {_SHARE.format('coalesce(n_text, 0)', 'n_body', 'regions_per_line')},
  {_SHARE.format('graphic_hit', 'graphic', 'graphic_recall')}, {_SHARE.format('graphic_hit', 'graphic_all', 'graphic_iou')}, {_SHARE.format('grid_hit', 'grid', 'table_recall')}, {_SHARE.format('grid_hit', 'grid_all', 'table_iou')}, coalesce(n_bands, 0) AS n_ref_columns,
  coalesce(bleed, 0) AS column_bleed, coalesce(crossing, 0) AS gutter_cross, {_SHARE.format('crossing', 'n_text', 'gutter_cross_rate')}, {_SHARE.format('bleed', 'n_text', 'column_bleed_rate')}, round(covered / {_W * _H}::DOUBLE, 4) AS page_coverage,
  coalesce(round(twice::DOUBLE / nullif(covered, 0), 4), 0) AS overlap_ratio, coalesce(kinds, 0) AS class_diversity, n_regions > 0 AND (page_id + sys) % 7 IN (0, 2) IS TRUE AS has_polygons, n_regions > 0 AND (page_id + sys) % 7 IN (0, 1, 2) IS TRUE AS has_polygon_field,
  coalesce(n_regions > 0 AND sys < 3, false) AS has_reading_order, (page_id % 7)::DOUBLE AS inference_s, (page_id % 11)::DOUBLE AS total_s, coalesce(n_ref_grids, 0) AS n_ref_grids, coalesce(n_ref_graphics, 0) AS n_ref_graphics
  FROM pp JOIN ar USING (sys, page_id) JOIN lc USING (page_id) LEFT JOIN bn USING (page_id) LEFT JOIN rc USING (sys, page_id) LEFT JOIN cc USING (sys, page_id) LEFT JOIN sp USING (sys, page_id) LEFT JOIN ac USING (page_id)),
mm AS MATERIALIZED (SELECT * REPLACE (coalesce(has_polygons, false) AS has_polygons, coalesce(has_polygon_field, false) AS has_polygon_field) FROM pm)"""
_LONG = ", ".join(f"{c}::DOUBLE AS {c}" for c in metrics.NUMERIC)
_SUMMARY = f"""sm AS (SELECT sys, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90
  FROM (UNPIVOT (SELECT sys, {_LONG} FROM mm) ON {', '.join(metrics.NUMERIC)} INTO NAME metric VALUE v) GROUP BY ALL)"""
_MEDIAN = "round(quantile_cont({0}, 0.5) FILTER ({1} AND {0} IS NOT NULL), 6) AS {2}"
_EVIDENCE = f"""pr AS (SELECT sys, cls, count(*) AS total, round(count(DISTINCT page_id) / any_value(n)::DOUBLE, 3) AS presence FROM more JOIN (SELECT sys, count(*) AS n FROM mm GROUP BY sys) USING (sys) GROUP BY ALL),
ev AS (SELECT sys, count(*) FILTER (n_ref_grids > 0) AS n_table_pages, round(count(*) FILTER (n_ref_grids > 0 AND table_iou >= 0.5) / greatest(count(*) FILTER (n_ref_grids > 0), 1)::DOUBLE, 3) AS table_hit_rate,
  round(count(*) FILTER (n_ref_grids > 0 AND table_iou >= 0.2) / greatest(count(*) FILTER (n_ref_grids > 0), 1)::DOUBLE, 3) AS table_partial_rate,
  round(avg((EXISTS (SELECT 1 FROM more m WHERE m.sys = mm.sys AND m.page_id = mm.page_id AND cls = 'header'))::INT), 3) AS headerfooter_pages, 0.0::DOUBLE AS caption_pages, quantile_cont(has_reading_order::INT, 0.5) > 0 AS reading_order, quantile_cont(has_polygons::INT, 0.5) > 0 AS polygons,
  {_MEDIAN.format('table_iou', 'n_ref_grids > 0', 'table_iou_on_table_pages')}, {_MEDIAN.format('table_recall', 'n_ref_grids > 0', 'table_recall_on_table_pages')}, {_MEDIAN.format('graphic_iou', 'n_ref_graphics > 0', 'figure_iou_on_figure_pages')},
  {_MEDIAN.format('text_recall', 'n_ref_columns >= 2', 'text_recall_multicol')}, {_MEDIAN.format('column_bleed_rate', 'n_ref_columns >= 2', 'bleed_multicol')} FROM mm GROUP BY sys)"""


def _band(name: str, value: str, system: str = "true") -> str:
    _, cuts, low, _, sees = metrics.DIMENSIONS[name]
    score = " + ".join(["1", *[f"({value} >= {c})::INT" for c in cuts]])
    seen = " AND NOT blind" if sees else ""
    return f"CASE WHEN {system}{seen} THEN {f'6 - ({score})' if low else score} END::BIGINT AS {name}"


_OVER = " + ".join(f"coalesce({w} * {n}, 0)" for n, (w, *_) in metrics.DIMENSIONS.items()), " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {w} END" for n, (w, *_) in metrics.DIMENSIONS.items())
_RATED = f"""wide AS (SELECT sys, {', '.join(f"max(median) FILTER (metric = '{c}') AS {c}" for c in ('text_or_table_recall', 'graphic_iou', 'gutter_cross_rate', 'text_precision', 'text_recall', 'text_spill'))} FROM sm GROUP BY sys),
facts AS (SELECT *, coalesce(text_or_table_recall, 0) < 0.2 AS blind FROM wide JOIN ev USING (sys)),
bands AS (SELECT sys, {_band('text', 'text_or_table_recall')}, {_band('headings', '0.0', 'sys = 0')}, {_band('tables', 'table_hit_rate', 'sys < 3')}, {_band('figures', 'graphic_iou', 'sys < 3')}, {_band('captions', '0.0', 'false')}, {_band('lists', '0.0', 'sys = 0')},
  {_band('formulas', '0.0', 'false')}, {_band('running', 'headerfooter_pages', 'sys <> 2')}, {_band('columns', 'gutter_cross_rate')}, {_band('boundaries', '(2 * text_precision * text_recall / (text_precision + text_recall) - coalesce(text_spill, 0))')} FROM facts)"""
_SIGN = "least(2 * list_sum(list_transform(range(0, least(up, down)::BIGINT + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))), 1)"

SQL: dict[str, str] = {
    "page_metrics": f"{_METRICS} SELECT * FROM mm",
    "metric_summary": f"{_METRICS}, {_SUMMARY} SELECT * FROM sm",
    "class_presence": f"{_METRICS}, {_EVIDENCE} SELECT * FROM pr",
    "class_evidence": f"{_METRICS}, {_EVIDENCE} SELECT * FROM ev",
    "system_ratings": f"{_METRICS}, {_SUMMARY}, {_EVIDENCE}, {_RATED} SELECT *, round(({_OVER[0]}) / nullif({_OVER[1]}, 0), 2) AS overall FROM bands",
    "separability": f"""{_METRICS}, ms AS (SELECT sys, avg(text_or_table_recall) AS mean, max(class_diversity) <= 1 AS single FROM mm WHERE text_or_table_recall IS NOT NULL GROUP BY sys),
pl AS (SELECT *, row_number() OVER (ORDER BY mean DESC, sys) AS place FROM ms), ld AS (SELECT sys AS leader FROM pl ORDER BY single, place LIMIT 1),
sg AS (SELECT a.sys, leader, count(*) FILTER (a.text_or_table_recall - b.text_or_table_recall > 1e-9) AS up, count(*) FILTER (a.text_or_table_recall - b.text_or_table_recall < -1e-9) AS down
  FROM mm a JOIN mm b USING (page_id) JOIN ld ON b.sys = leader WHERE a.text_or_table_recall IS NOT NULL AND b.text_or_table_recall IS NOT NULL GROUP BY ALL)
SELECT sys, place, round(mean, 4) AS mean, leader, CASE WHEN up + down = 0 THEN 1.0 ELSE round({_SIGN}, 4) END::DOUBLE AS p_vs_leader FROM pl JOIN sg USING (sys)""",
}
