"""Stand-in layout tables derived from the driver's tables: a text is laid out over pages of up to 80 lines in two columns;
its source is the document that the pages belong to.

All coordinates are integers, so every engine agrees on them exactly. ``LAYOUT_SQL`` states the same tables as common
table expressions for an SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 2480, 3508

#: Pages of a text at most, and where the two columns lie.
PAGES, COLUMNS = 4096, ((200, 1100), (1300, 2200))

LAYOUT_SQL = f"""
doc_lines AS (SELECT doc_id, source, (length(text) - length(replace(text, ' ', ''))) // 10 + 1 AS n FROM documents WHERE text IS NOT NULL),
pgs AS (SELECT doc_id * {PAGES} + c AS page_id, source AS doc, least(80, n - 80 * c) AS n FROM (SELECT *, unnest(range(0, (n + 79) // 80)) AS c FROM doc_lines)),
lines AS (
  SELECT page_id, doc, line_id, 200 + 1100 * (k // 40) AS x1, 1100 + 1100 * (k // 40) - ((page_id * 13 + k * 7) % 300) AS x2,
    200 + 75 * (k % 40) + CASE WHEN k >= 40 AND page_id % 3 <> 0 THEN 37 ELSE 0 END AS y1, 250 + 75 * (k % 40) + CASE WHEN k >= 40 AND page_id % 3 <> 0 THEN 37 ELSE 0 END AS y2
  FROM (SELECT page_id, doc, unnest(range(0, n)) AS k, unnest(range(0, n)) AS line_id FROM pgs)),
raw_bands AS (SELECT page_id, unnest([0, 1]) AS band_id, unnest([200, 1300]) AS x0, unnest([1100, 2200]) AS x9 FROM pgs WHERE n > 40 AND page_id % 11 <> 0 UNION ALL SELECT page_id, 0, 200, 1100 FROM pgs WHERE n <= 40),
regions AS (
  SELECT sys, page_id, doc, blk, min(x1) - 10 + sys * 3 AS x1, min(y1) - 5 + sys * 2 AS y1, max(x2) + 10 - sys * 4 AS x2, max(y2) + 5 + sys AS y2,
    CASE WHEN (page_id + blk) % 17 = 0 THEN 'table' WHEN (page_id * 3 + blk) % 23 = 0 THEN 'figure' WHEN (blk * 5 + page_id + sys) % 29 = 0 THEN 'header' ELSE 'text' END AS cls
  FROM (SELECT s.sys, l.*, line_id // 5 AS blk FROM lines l CROSS JOIN (SELECT unnest(range(0, 4)) AS sys) s)
  WHERE (page_id * 7 + blk * 3 + sys) % 11 <> 0
  GROUP BY sys, page_id, doc, blk)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, doc, n): pages of a text with their number of lines. A null text has none."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.expr("(length(text) - length(replace(text, ' ', ''))) div 10 + 1").alias("n"))
    each = docs.select("*", F.explode(F.expr("sequence(0L, (n + 79) div 80 - 1)")).alias("c"))
    return each.select((F.col("doc_id") * PAGES + F.col("c")).alias("page_id"), F.col("source").alias("doc"), F.least(F.lit(80), F.col("n") - 80 * F.col("c")).alias("n"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, doc, line_id, x1, y1, x2, y2): two columns of up to 40 lines; on most pages their rows do not meet."""
    k = pages(spark, sf_dir).select("page_id", "doc", F.explode(F.expr("sequence(0L, n - 1)")).alias("line_id"))
    column, row = F.expr("line_id div 40"), 200 + 75 * (F.col("line_id") % 40) + F.expr("CASE WHEN line_id >= 40 AND page_id % 3 <> 0 THEN 37 ELSE 0 END")
    return k.select(
        "page_id", "doc", "line_id", (200 + 1100 * column).alias("x1"), row.cast("long").alias("y1"), (1100 + 1100 * column - (F.col("page_id") * 13 + F.col("line_id") * 7) % 300).alias("x2"), (row + 50).cast("long").alias("y2")
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bands): raw column bands; some pages with two columns have none that could be read."""
    band = lambda k: f"struct({k} AS band_id, {COLUMNS[k][0]}L AS x0, {COLUMNS[k][1]}L AS x9)"
    found = F.expr(f"CASE WHEN n <= 40 THEN array({band(0)}) WHEN page_id % 11 = 0 THEN slice(array({band(0)}), 1, 0) ELSE array({band(0)}, {band(1)}) END")
    return pages(spark, sf_dir).select("page_id", found.alias("bands"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sys, page_id, doc, blk, x1, y1, x2, y2, cls): blocks of five lines as four systems see them."""
    seen = lines(spark, sf_dir).withColumn("sys", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)]))).withColumn("blk", F.expr("(line_id - line_id % 5) div 5"))
    kept = seen.where("(page_id * 7 + blk * 3 + sys) % 11 <> 0")
    boxes = kept.groupBy("sys", "page_id", "doc", "blk").agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"))
    return boxes.select(
        "sys", "page_id", "doc", "blk", F.expr("a - 10 + sys * 3").alias("x1"), F.expr("b - 5 + sys * 2").alias("y1"), F.expr("c + 10 - sys * 4").alias("x2"), F.expr("d + 5 + sys").alias("y2"),
        F.expr("CASE WHEN (page_id + blk) % 17 = 0 THEN 'table' WHEN (page_id * 3 + blk) % 23 = 0 THEN 'figure' WHEN (blk * 5 + page_id + sys) % 29 = 0 THEN 'header' ELSE 'text' END").alias("cls"),
    )


#: Stand-in facts of a page, its areas and corridors: SQL alike in both engines.
PAGE_FACTS = {
    "font": "CASE WHEN page_id % 50 = 0 THEN 50 ELSE 30 END", "direction": "CASE WHEN doc LIKE '%7' THEN 'rtl' ELSE 'ltr' END", "psr_trust": "CASE WHEN page_id % 37 = 0 THEN 'unusable' ELSE 'full' END", "est_columns": "CASE WHEN n > 40 THEN 2 ELSE 1 END",
}
AREAS = (("graphic", 0, 4, (200, 2000, 1100, 2400)), ("graphic", 1, 8, (1300, 2000, 2200, 2400)), ("grid", 2, 9, (200, 200, 1100, 1300)))
PAGES_SQL = "facts AS (SELECT page_id, doc, n, " + ", ".join(f"{v} AS {k}" for k, v in PAGE_FACTS.items()) + " FROM pgs)"
AREAS_SQL = "areas AS (" + " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind, {k} AS area_id, {a} AS x1, {b} AS y1, {c} AS x2, {d} AS y2 FROM pgs WHERE page_id % {m} = 0" for kind, k, m, (a, b, c, d) in AREAS) + ")"


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr("page_id", "doc", *[f"{v} AS {k}" for k, v in PAGE_FACTS.items()])


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, kind, area_id, x1, y1, x2, y2): graphics and grids of some pages."""
    each = ", ".join(f"CASE WHEN page_id % {m} = 0 THEN struct('{kind}' AS kind, {k} AS area_id, {a}L AS x1, {b}L AS y1, {c}L AS x2, {d}L AS y2) END" for kind, k, m, (a, b, c, d) in AREAS)
    return pages(spark, sf_dir).select("page_id", F.explode(F.expr(f"array_compact(array({each}))")).alias("a")).select("page_id", "a.*")


def gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, x0, x9): the corridor of pages with two columns."""
    return pages(spark, sf_dir).where("n > 40").select("page_id", F.lit(COLUMNS[0][1]).cast("long").alias("x0"), F.lit(COLUMNS[1][0]).cast("long").alias("x9"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, frame, outcome) from ``labels``."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when(F.col("toxic") == 0, "audit").otherwise("escalation").alias("frame"), F.when(F.col("quality") == 1, "confirm").otherwise("correct").alias("outcome")
    )


#: Stand-in page signals: name and SQL expression over documents, alike in both engines.
SIGNALS = {
    "page_id": "doc_id", "doc": "source", "n_chars": "CASE WHEN doc_id % 29 = 0 THEN 0 ELSE length(text) END", "n_lines": "(doc_id * 7) % 60", "n_spans": "(doc_id * 11) % 400", "rotation": "CASE WHEN doc_id % 31 = 0 THEN 45 ELSE 90 END",
    "glyph_area_frac": "((doc_id * 13) % 40) / 100.0", "vector_area_frac": "((doc_id * 17) % 30) / 100.0", "image_area_frac": "((doc_id * 19) % 50) / 100.0", "big_image_area_frac": "((doc_id * 23) % 100) / 100.0",
    "lines_in_big_image_frac": "((doc_id * 29) % 100) / 100.0", "median_chars_per_span": "(doc_id * 3) % 7", "invisible_frac": "((doc_id * 5) % 60) / 100.0", "white_frac": "((doc_id * 37) % 50) / 100.0", "pua_cp_frac": "((doc_id * 41) % 30) / 100.0",
    "undecoded_cp_frac": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ((doc_id * 43) % 20) / 100.0 END", "rtl_cp_frac": "CASE WHEN source LIKE '%7' THEN 0.25 ELSE 0.0 END", "lines_outside_crop_frac": "((doc_id * 47) % 12) / 100.0",
}
FRACTIONS = [k for k in SIGNALS if k.endswith("_frac")]
SIGNALS_SQL = "signals AS (SELECT " + ", ".join(f"({v})::DOUBLE AS {k}" if k in FRACTIONS else f"{v} AS {k}" for k, v in SIGNALS.items()) + " FROM documents)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page with the signals that routing reads."""
    return table(spark, sf_dir, "documents").selectExpr(*[f"cast({v} as double) AS {k}" if k in FRACTIONS else f"{v} AS {k}" for k, v in SIGNALS.items()])
