"""Registered queries that compare readings, choose pages, name classes and put in defects, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.operators import checks, gate, mutations, sampling, spatial, streams, variants
from pagequarry.plans import layout
from pagequarry.plans import queries as base


def read_streams(spark: SparkSession, d: str) -> DataFrame:
    """Lines of stretched regions in the order of their regions, which is mixed on every fifth page."""
    r = base.shifted(spark, d)
    own = spatial.assign_lines(layout.lines(spark, d), r).select("sys", "page_id", "line_id", "blk")
    rank = F.expr("CASE WHEN page_id % 5 = 0 THEN blk * 7 % 11 ELSE blk END")
    x = own.join(r.select("sys", "page_id", "blk", "cls"), ["sys", "page_id", "blk"]).withColumn("place", F.row_number().over(Window.partitionBy("sys", "page_id").orderBy(rank, "blk", "line_id")))
    return x.select("sys", "page_id", "line_id", F.col("blk").alias("block"), "place", checks.bucket(F.col("cls")).alias("bucket"))


def reference_stream(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of seven lines, some lines in none; every fourth page is read across its columns."""
    return layout.lines(spark, d).where("(page_id + line_id) % 13 <> 0").selectExpr(
        "page_id", "line_id", "line_id div 7 AS block", "CASE WHEN page_id % 4 = 0 THEN line_id % 40 * 2 + line_id div 40 ELSE line_id END AS place",
        "CASE (page_id + line_id div 7) % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'MEDIA' ELSE 'TEXT' END AS bucket", "(page_id + line_id div 7) % 3 <> 2 AS evidenced",
    )


def structural_keys(spark: SparkSession, d: str) -> DataFrame:
    """Band, grid and graphic of every line."""
    return streams.structural_keys(layout.lines(spark, d), layout.bands(spark, d), layout.areas(spark, d))


def compared(spark: SparkSession, d: str) -> DataFrame:
    return streams.verdict(streams.compare(streams.compared(structural_keys(spark, d), read_streams(spark, d), reference_stream(spark, d))))


def stream_comparison(spark: SparkSession, d: str) -> DataFrame:
    """What two readings of every page agree on, and the verdict; lists as text."""
    moves = F.array_join(F.transform(F.map_entries("bucket_confusion"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    x = compared(spark, d).withColumn("bucket_confusion", moves).withColumn("reasons", F.array_join("reasons", "; "))
    return x.withColumn("cross_merge_regions", F.array_join(F.col("cross_merge_regions").cast("array<string>"), " "))


def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return compared(spark, d).groupBy("sys", "tier1").agg(F.count(F.lit(1)).alias("n"))


#: Stand-in facts that a page is chosen by: SQL alike in both engines.
FACTS = {
    "page_id": "doc_id", "doc": "source", "char_count": "coalesce(length(text), 0)", "text_blocks": "doc_id % 23", "width_pt": "CASE WHEN doc_id % 4 = 0 THEN 842 ELSE 595 END", "height_pt": "700", "table_likely": "doc_id % 5 = 0", "vlines": "doc_id % 17",
    "est_columns": "1 + doc_id % 3", "n_images": "doc_id % 5", "image_area_frac": "(doc_id % 10) / 125.0", "n_drawings": "doc_id % 97",
}


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return layout.table(spark, d, "documents").selectExpr(*[f"{v} AS {k}" for k, v in FACTS.items()]).withColumn("stratum", sampling.stratum())


def page_strata(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("n_docs"))


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pick_stratified(candidates(spark, d))


#: Stand-in class names of two vocabularies: (vocabulary, name, class, how sure, place).
NAMES = [
    ("a", "Page-Header", "header", "exact", 0), ("a", "page header", "header", "approximate", 1), ("a", "Table", "table", "exact", 2), ("a", "List-item", "list", "exact", 3),
    ("b", "Table", "table", "exact", 4), ("b", "picture", "figure", "exact", 5), ("b", "PICTURE", "other", "approximate", 6),
]
SEEN = ["Page-Header", "page_header", "PAGE HEADER", "Table", "table", "Picture", "PICTURE", "list item", "caption"]
_SEEN_SQL = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(SEEN))
FOUND = {"page_id": "doc_id", "taxonomy": "CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END", "source_class": f"CASE doc_id % {2 * len(SEEN)} % {len(SEEN)} {_SEEN_SQL} END"}


def mapped_classes(spark: SparkSession, d: str) -> DataFrame:
    """Canonical class of detectors' class names: as written, by a tidied name, or unmapped."""
    found = layout.table(spark, d, "documents").selectExpr(*[f"{v} AS {k}" for k, v in FOUND.items()])
    return sampling.map_classes(found, spark.createDataFrame(NAMES, "taxonomy string, source_class string, cls string, confidence string, at int"))


def slot_order(spark: SparkSession, d: str) -> DataFrame:
    """Regions have the first places; nations that are no regions follow by key."""
    slots = layout.table(spark, d, "region").selectExpr("r_name AS name", "cast(r_regionkey as int) AS slot")
    names = layout.table(spark, d, "nation").selectExpr("n_name AS name", "cast(n_nationkey as int) AS at")
    return sampling.kept_slots(slots, names.unionByName(slots.select("name", F.col("slot").alias("at"))))


def thinned_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Number of points, and a sum by place, of outlines thinned to 60."""
    x = layout.table(spark, d, "documents").select("doc_id", F.expr("transform(sequence(0L, doc_id % 211), i -> i * 3 + 1)").alias("p")).withColumn("p", sampling.thinned(F.col("p")))
    at = F.aggregate(F.transform("p", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return x.select("doc_id", F.size("p").cast("long").alias("n"), at.alias("weighted"))


#: Defects that the SQL states, with a strength each; merged stacks are tested against a plain version.
SHOWN = {"drop_region": 0.25, "drop_largest": 2, "split_region": 0.5, "shrink": 0.25, "grow": 0.35, "duplicate": 0.3, "class_to_table": 0.3, "shuffle_order": 1.0, "shift": 0.02}
COLUMNS = ["sys", "page_id", "blk", "x1", "y1", "x2", "y2", "cls", "rank"]


def whole(spark: SparkSession, d: str) -> DataFrame:
    return layout.regions(spark, d).withColumn("rank", F.col("blk")).select(*COLUMNS)


def as_floats(r: DataFrame) -> DataFrame:
    return r.select("sys", "page_id", "blk", *[F.col(c).cast("double").alias(c) for c in spatial.SIDES], "cls", F.col("rank").cast("long").alias("rank"))


def mutated_regions(spark: SparkSession, d: str) -> DataFrame:
    """System 0's regions under each of nine defects."""
    r = as_floats(whole(spark, d).where("sys = 0"))
    each = [as_floats(mutations.mutated(r, name, strength)).withColumn("mutation", F.lit(name)) for name, strength in SHOWN.items()]
    return reduce(DataFrame.unionByName, each).withColumn("rank", F.col("rank").cast("long"))


def defect_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """How many pages the gate stops more than before, under every defect and strength, over the pages that it changes.

    The variants of a page are made and counted in the page's own row, and only what blocks a page is counted: no other
    check has a say in whether the gate escalates.
    """
    of = layout
    facts = variants.facts(of.page_facts(spark, d), of.lines(spark, d), whole(spark, d).where("sys = 0"), of.bands(spark, d), of.areas(spark, d), of.gutters(spark, d), of.PAGE_WIDTH, of.PAGE_HEIGHT)
    named = F.broadcast(spark.createDataFrame([(k, *v) for k, v in enumerate(variants.EVERY)], "variant int, mutation string, strength double"))  # one row a variant
    caught = gate.escalated(checks.firing(strongest=True), {k: F.expr(checks.availability(k)[1]) for k in checks.gate_checks()})
    looked = facts.withColumn("page_side", F.lit(float(base.SIDE))).groupBy("variant").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(caught).alias("n_caught"))
    return mutations.sensitivity(looked.join(named, "variant").localCheckpoint())  # one row a variant; the rates and their baseline draw on it


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (structural_keys, stream_comparison, stream_verdicts, page_strata, quota_sample, mapped_classes, slot_order, thinned_outlines, mutated_regions, defect_sensitivity)
}

_KEYS = f"""held AS (SELECT l.page_id, l.line_id, min(r.area_id) FILTER (r.kind = 'grid') AS grid, min(r.area_id) FILTER (r.kind = 'graphic') AS graphic
  FROM lines l JOIN areas r ON l.page_id = r.page_id AND {base.TOUCH} AND ({base.COVER}) / ((l.x2 - l.x1) * (l.y2 - l.y1))::DOUBLE >= 0.6 GROUP BY ALL),
inband AS (SELECT l.page_id, l.line_id, CASE WHEN count(*) = 1 THEN min(band_id) END AS band FROM lines l JOIN raw_bands b ON b.page_id = l.page_id AND least(l.x2, x9) - greatest(l.x1, x0) > 0.5 * (l.x2 - l.x1) GROUP BY ALL),
keys AS (SELECT page_id, line_id, band, grid, graphic FROM lines LEFT JOIN inband USING (page_id, line_id) LEFT JOIN held USING (page_id, line_id))"""
_STREAMS = f"""{base.WITH}, {base._SHIFTED}, {layout.AREAS_SQL}, {_KEYS}, systems AS (SELECT unnest(range(0, 4)) AS sys),
owned AS (SELECT * FROM (SELECT r.sys, l.page_id, l.line_id, r.blk, r.cls, ({base.COVER}) / ((l.x2 - l.x1) * (l.y2 - l.y1))::DOUBLE AS cov, row_number() OVER (PARTITION BY r.sys, l.page_id, l.line_id ORDER BY ({base.COVER}) DESC, r.blk) AS k
  FROM lines l JOIN more r ON l.page_id = r.page_id AND {base.TOUCH}) WHERE k = 1 AND cov >= 0.5),
ps AS (SELECT sys, page_id, line_id, blk, {base.BUCKET.format('cls')} AS bucket, row_number() OVER (PARTITION BY sys, page_id ORDER BY CASE WHEN page_id % 5 = 0 THEN blk * 7 % 11 ELSE blk END, blk, line_id) AS place FROM owned),
rs AS (SELECT page_id, line_id, line_id // 7 AS rb, CASE WHEN page_id % 4 = 0 THEN line_id % 40 * 2 + line_id // 40 ELSE line_id END AS rplace, CASE (page_id + line_id // 7) % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'MEDIA' ELSE 'TEXT' END AS rbucket FROM lines WHERE (page_id + line_id) % 13 <> 0),
al AS (SELECT s.sys, k.*, ps.blk, ps.place, ps.bucket, rb, rplace, rbucket FROM keys k CROSS JOIN systems s LEFT JOIN ps ON ps.sys = s.sys AND ps.page_id = k.page_id AND ps.line_id = k.line_id LEFT JOIN rs ON rs.page_id = k.page_id AND rs.line_id = k.line_id),
cm AS (SELECT * FROM al WHERE blk IS NOT NULL AND rb IS NOT NULL),
pr AS (SELECT a.sys, a.page_id, a.blk, a.blk = b.blk AS p, a.rb = b.rb AS r, (a.band IS NOT NULL AND b.band IS NOT NULL AND a.band <> b.band) OR a.grid IS DISTINCT FROM b.grid OR a.graphic IS DISTINCT FROM b.graphic AS apart, sign(a.place - b.place) * sign(a.rplace - b.rplace) AS d
  FROM cm a JOIN cm b ON a.sys = b.sys AND a.page_id = b.page_id AND a.line_id < b.line_id),
pg AS (SELECT sys, page_id, round(count(*) FILTER (p AND r)::DOUBLE / nullif(count(*) FILTER (p), 0), 4) AS grouping_precision, round(count(*) FILTER (p AND r)::DOUBLE / nullif(count(*) FILTER (r), 0), 4) AS grouping_recall,
  coalesce(round(count(*) FILTER (p AND apart)::DOUBLE / nullif(count(*) FILTER (p), 0), 4), 0) AS cross_merge_rate, coalesce(array_to_string(list_sort(list(DISTINCT blk) FILTER (p AND apart)), ' '), '') AS cross_merge_regions,
  round(avg(d::DOUBLE), 4) AS order_tau, round(avg((d < 0)::INT), 4) AS order_inversion_rate FROM pr GROUP BY ALL),
tr AS (SELECT sys, page_id, count(*) FILTER (band <> before) AS turns FROM (SELECT sys, page_id, band, lag(band) OVER (PARTITION BY sys, page_id ORDER BY place) AS before FROM al WHERE place IS NOT NULL AND band IS NOT NULL) GROUP BY ALL),
mv AS (SELECT sys, page_id, string_agg(move || '=' || n, ' ' ORDER BY move) AS moves, sum(n) AS n_moved, coalesce(sum(n) FILTER (move IN ({', '.join(f"'{m}'" for m in streams.MOVES)})), 0) AS n_bad
  FROM (SELECT sys, page_id, rbucket || '->' || bucket AS move, count(*) AS n FROM cm WHERE rbucket <> 'TEXT' AND bucket <> rbucket GROUP BY ALL) GROUP BY ALL),
tl AS (SELECT sys, page_id, count(*) AS n_lines, count(*) FILTER (blk IS NOT NULL AND rb IS NOT NULL) AS n_compared, round(count(*) FILTER (blk IS NULL)::DOUBLE / count(*), 4) AS orphan_rate, round(count(*) FILTER (rb IS NULL)::DOUBLE / count(*), 4) AS ref_orphan_rate,
  count(DISTINCT band) AS n_bands, count(*) FILTER (blk IS NOT NULL AND rbucket <> 'TEXT') AS scored FROM al GROUP BY ALL),
cp AS (SELECT sys, page_id, n_lines, n_compared, orphan_rate, ref_orphan_rate, grouping_precision, grouping_recall, cross_merge_rate, cross_merge_regions, order_tau, order_inversion_rate, CASE WHEN n_compared >= 2 THEN coalesce(turns, 0) END AS band_transitions,
  CASE WHEN n_compared >= 2 THEN greatest(coalesce(turns, 0) - greatest(n_bands - 1, 0), 0) END AS excess_band_transitions, coalesce(moves, '') AS bucket_confusion, CASE WHEN n_compared >= 2 THEN scored END AS bucket_scored,
  CASE WHEN n_compared >= 2 THEN coalesce(round(coalesce(n_moved, 0)::DOUBLE / nullif(scored, 0), 4), 0) END AS bucket_move_rate, n_compared >= 2 AND coalesce(coalesce(n_bad, 0)::DOUBLE / nullif(scored, 0) > 0.35, false) AS wrong
  FROM tl LEFT JOIN pg USING (sys, page_id) LEFT JOIN tr USING (sys, page_id) LEFT JOIN mv USING (sys, page_id)),
vd AS (SELECT * EXCLUDE (wrong), array_to_string(list_filter([CASE WHEN orphan_rate > 0.12 THEN 'content lost' END, CASE WHEN cross_merge_rate > 0.25 THEN 'merged across a boundary' END, CASE WHEN excess_band_transitions > 2 THEN 'columns in ping-pong' END, CASE WHEN wrong THEN 'wrong store' END], lambda r: r IS NOT NULL), '; ') AS reasons FROM cp)"""
_TURNED = "CASE WHEN width_pt > height_pt THEN '_landscape' ELSE '_portrait' END"
_STRATA = f"""f AS (SELECT {', '.join(f'{v} AS {k}' for k, v in FACTS.items())} FROM documents),
p AS (SELECT *, CASE WHEN table_likely AND vlines >= 8 THEN 'dense_table' || {_TURNED} WHEN est_columns >= 3 THEN 'three_column' WHEN est_columns = 2 THEN 'two_column' || {_TURNED} WHEN n_images >= 3 OR image_area_frac > 0.05 THEN 'figure_heavy'
  WHEN char_count < 700 THEN 'sparse_title_page' WHEN n_drawings > 60 THEN 'graphics_dense' ELSE 'single_column' || {_TURNED} END AS stratum FROM f)"""
_Q = "CASE stratum " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sampling.QUOTAS.items()) + " END"
_ORDER = "text_blocks DESC, char_count DESC, page_id"
_TABLE = "names(taxonomy, source_class, cls, confidence, place) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{e}', {n})" for a, b, c, e, n in NAMES) + ")"
_TIDY = "replace(replace(lower({0}), '-', '_'), ' ', '_')"


def _chance(name: str, strength: float) -> str:
    return f"('0x' || substr(md5('0/{name}/{strength:g}|' || sys || '|' || page_id || '|' || blk), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _hit(name: str) -> str:
    return f"{_chance(name, SHOWN[name])} < {SHOWN[name]}"


_MUTATED = f"""{base.WITH}, r AS (SELECT sys, page_id, blk, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, cls, blk AS rank FROM regions WHERE sys = 0)
SELECT *, 'drop_region' AS mutation FROM r WHERE NOT ({_hit('drop_region')})
UNION ALL SELECT * EXCLUDE (n), 'drop_largest' FROM (SELECT *, row_number() OVER (PARTITION BY sys, page_id ORDER BY (x2 - x1) * (y2 - y1) DESC, blk) AS n FROM r) WHERE n > 2
UNION ALL SELECT *, 'split_region' FROM r WHERE NOT ({_hit('split_region')} AND y2 - y1 > 40)
UNION ALL SELECT * REPLACE ((y1 + y2) / 2 AS y2), 'split_region' FROM r WHERE {_hit('split_region')} AND y2 - y1 > 40
UNION ALL SELECT * REPLACE ((y1 + y2) / 2 AS y1), 'split_region' FROM r WHERE {_hit('split_region')} AND y2 - y1 > 40
UNION ALL SELECT * REPLACE (x1 + (x2 - x1) * 0.125 AS x1, y1 + (y2 - y1) * 0.125 AS y1, x2 - (x2 - x1) * 0.125 AS x2, y2 - (y2 - y1) * 0.125 AS y2), 'shrink' FROM r
UNION ALL SELECT * REPLACE (x1 - (x2 - x1) * 0.175 AS x1, y1 - (y2 - y1) * 0.175 AS y1, x2 + (x2 - x1) * 0.175 AS x2, y2 + (y2 - y1) * 0.175 AS y2), 'grow' FROM r
UNION ALL SELECT *, 'duplicate' FROM r UNION ALL SELECT *, 'duplicate' FROM r WHERE {_hit('duplicate')}
UNION ALL SELECT * REPLACE (CASE WHEN {_hit('class_to_table')} THEN 'table' ELSE cls END AS cls), 'class_to_table' FROM r
UNION ALL SELECT * REPLACE (row_number() OVER (PARTITION BY sys, page_id ORDER BY {_chance('shuffle_order', 1.0)}, blk) AS rank), 'shuffle_order' FROM r
UNION ALL SELECT * REPLACE (x1 + 40 AS x1, y1 + 40 AS y1, x2 + 40 AS x2, y2 + 40 AS y2), 'shift' FROM r"""

SQL: dict[str, str] = {
    "structural_keys": f"{base.WITH}, {layout.AREAS_SQL}, {_KEYS} SELECT * FROM keys",
    "stream_comparison": f"{_STREAMS} SELECT *, reasons <> '' AS tier1 FROM vd",
    "stream_verdicts": f"{_STREAMS} SELECT sys, reasons <> '' AS tier1, count(*) AS n FROM vd GROUP BY ALL",
    "page_strata": f"WITH {_STRATA} SELECT stratum, count(*) AS n, count(DISTINCT doc) AS n_docs FROM p GROUP BY ALL",
    "quota_sample": f"""WITH {_STRATA}, q AS (SELECT *, {_Q} AS q, row_number() OVER (PARTITION BY stratum, doc ORDER BY {_ORDER}) AS k FROM p),
a AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k > greatest(1, q // 2), {_ORDER}) AS n FROM q QUALIFY n <= q),
b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {_ORDER}) AS n FROM p WHERE page_id NOT IN (SELECT page_id FROM a))
SELECT page_id, doc, stratum, 0 AS phase, n FROM a UNION ALL SELECT page_id, doc, stratum, 1, n FROM b WHERE n <= 2 - (SELECT count(*) FROM a WHERE a.doc = b.doc)""",
    "mapped_classes": f"""WITH {_TABLE}, found AS (SELECT {', '.join(f'{v} AS {k}' for k, v in FOUND.items())} FROM documents)
SELECT f.*, coalesce(e.cls, l.cls, 'other') AS cls, coalesce(e.confidence, l.confidence, 'unmapped') AS confidence FROM found f LEFT JOIN names e USING (taxonomy, source_class)
LEFT JOIN (SELECT taxonomy, {_TIDY.format('source_class')} AS tidy, arg_max(cls, place) AS cls, arg_max(confidence, place) AS confidence FROM names GROUP BY ALL) l ON l.taxonomy = f.taxonomy AND l.tidy = {_TIDY.format('f.source_class')}""",
    "slot_order": "SELECT r_name AS name, r_regionkey::INT AS slot FROM region UNION ALL SELECT n_name, ((SELECT max(r_regionkey) + 1 FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1)::INT FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)",
    "thinned_outlines": """WITH p AS (SELECT doc_id, doc_id % 211 + 1 AS n FROM documents), q AS (SELECT doc_id, n, unnest(range(0, least(n, 60))) AS i FROM p)
SELECT doc_id, least(n, 60) AS n, sum((CASE WHEN n > 60 THEN i * (n - 1) // 59 ELSE i END * 3 + 1) * (i + 1))::BIGINT AS weighted FROM q GROUP BY doc_id, n""",
    "mutated_regions": _MUTATED,
}
