"""Registered layout queries, each with the SQL that an independent engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.operators import checks, consensus, gate, reading, routing, spatial
from pagequarry.plans import layout

WITH = f"WITH {layout.LAYOUT_SQL.strip()}"
COVER = "(least(l.x2, r.x2) - greatest(l.x1, r.x1)) * (least(l.y2, r.y2) - greatest(l.y1, r.y1))"
TOUCH = "l.x1 < r.x2 AND r.x1 < l.x2 AND l.y1 < r.y2 AND r.y1 < l.y2"
BUCKET = "CASE {0} WHEN 'table' THEN 'TABLE' WHEN 'figure' THEN 'MEDIA' WHEN 'header' THEN 'DISCARD' ELSE 'TEXT' END"
OWNED = f"""owned AS (
  SELECT sys, page_id, line_id, blk, cov FROM (
    SELECT r.sys, l.page_id, l.line_id, r.blk, ({COVER}) / ((l.x2 - l.x1) * (l.y2 - l.y1))::DOUBLE AS cov,
      row_number() OVER (PARTITION BY r.sys, l.page_id, l.line_id ORDER BY ({COVER}) DESC, r.blk) AS k
    FROM lines l JOIN regions r ON l.page_id = r.page_id AND {TOUCH}) WHERE k = 1 AND cov >= 0.5),
systems AS (SELECT unnest(range(0, 4)) AS sys),
orphan AS (SELECT s.sys, l.page_id, l.line_id FROM lines l CROSS JOIN systems s WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.sys = s.sys AND o.page_id = l.page_id AND o.line_id = l.line_id))"""


def systems(spark: SparkSession) -> DataFrame:
    return spark.range(4).withColumnRenamed("id", "sys")


def owned(spark: SparkSession, d: str) -> DataFrame:
    return spatial.assign_lines(layout.lines(spark, d), layout.regions(spark, d))


def line_assignment(spark: SparkSession, d: str) -> DataFrame:
    return owned(spark, d).withColumn("cov", F.round("cov", 6))


def orphan_lines(spark: SparkSession, d: str) -> DataFrame:
    return spatial.orphans(layout.lines(spark, d), systems(spark), owned(spark, d))


def text_cover_semi(spark: SparkSession, d: str) -> DataFrame:
    return spatial.covered_by_class(layout.lines(spark, d), layout.regions(spark, d), ["TEXT", "TABLE"])


def text_cover_anti(spark: SparkSession, d: str) -> DataFrame:
    return spatial.covered_by_class(layout.lines(spark, d), layout.regions(spark, d), ["TEXT", "TABLE"], missing=True)


def with_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Regions with some of system 3's repeated one pixel off."""
    r = layout.regions(spark, d)
    more = r.where("sys = 3 AND (page_id + blk) % 5 = 0").select("sys", "page_id", "doc", (F.col("blk") + 100).alias("blk"), *[(F.col(c) + 1).alias(c) for c in ("x1", "y1", "x2", "y2")], "cls")
    return r.unionByName(more)


def repeated_regions(spark: SparkSession, d: str) -> DataFrame:
    return spatial.repeats(with_repeats(spark, d))


def system_agreement(spark: SparkSession, d: str) -> DataFrame:
    r = layout.regions(spark, d)
    m = spatial.best_match(r.where("sys = 0").drop("sys"), r.where("sys = 1").drop("sys"))
    return m.groupBy("page_id").agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg("iou"), 6).alias("mean_iou"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return layout.regions(spark, d).groupBy("sys", "cls").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


def region_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per system and document: pages, mean and population deviation of regions a page, share with running matter."""
    per_page = layout.regions(spark, d).groupBy("sys", "doc", "page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cls").alias("classes"), F.max(F.when(F.col("cls") == "header", 1).otherwise(0)).alias("running"))
    return per_page.groupBy("sys", "doc").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("n"), 6).alias("mean_regions"), F.round(F.stddev_pop("n"), 6).alias("sd_regions"), F.expr("percentile(classes, 0.5)").alias("median_classes"), F.round(F.avg("running"), 6).alias("running_rate"))


def region_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose number of regions is far from their document's."""
    per_page = layout.regions(spark, d).groupBy("sys", "doc", "page_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sys", "doc")
    x = per_page.withColumn("mean", F.avg("n").over(w)).withColumn("sd", F.stddev_pop("n").over(w)).withColumn("pages", F.count(F.lit(1)).over(w))
    return x.where("pages >= 5 AND sd >= 1 AND abs(n - mean) / sd > 1.5").select("sys", "page_id", "n")


def metric_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and tails over pages of each system's orphan share."""
    lines = layout.lines(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    kept = owned(spark, d).groupBy("sys", "page_id").agg(F.count(F.lit(1)).alias("k"))
    rate = lines.join(systems(spark)).join(kept, ["sys", "page_id"], "left").select("sys", ((F.col("n") - F.coalesce("k", F.lit(0))) / F.col("n")).alias("v"))
    q = F.expr("percentile(v, array(0.1, 0.5, 0.9))")
    return rate.groupBy("sys").agg(F.round(F.avg("v"), 6).alias("mean"), q.alias("q")).select("sys", "mean", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p10", "median", "p90"))])


def longest_orphan_run(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of lost reading lines, gaps and islands, of each page that has one."""
    return page_features(spark, d, with_repeats(spark, d)).where("orphan_run > 0").select("sys", "page_id", F.col("orphan_run").cast("long").alias("longest"))


def union_areas(spark: SparkSession, d: str) -> DataFrame:
    return spatial.union_area(layout.regions(spark, d), ["sys", "page_id"], stride=4).select("sys", "page_id", "area", "shared")


def shifted(spark: SparkSession, d: str) -> DataFrame:
    """Regions with repeats, some of them stretched over the next column or the next block."""
    r = with_repeats(spark, d)
    k = F.col("page_id") + F.col("blk")
    return r.withColumn("x2", F.col("x2") + F.when(k % 13 == 0, 1100).otherwise(0)).withColumn("y2", F.col("y2") + F.when(k % 3 == 0, 270).otherwise(0))


def gate_findings(spark: SparkSession, d: str) -> DataFrame:
    return found_on(page_features(spark, d, with_repeats(spark, d)))


def shifted_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on stretched regions: these overlap each other, span bands and leave the page."""
    return found_on(page_features(spark, d, shifted(spark, d)))


def shared_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas of stretched regions: of their union, and of what several cover."""
    return spatial.union_area(shifted(spark, d), ["sys", "page_id"], stride=4).select("sys", "page_id", "area", "shared")


def disturbed(spark: SparkSession, d: str) -> DataFrame:
    """Stretched regions, empty thin ones, and a mixed order of blocks on every fifth page."""
    r = shifted(spark, d)
    at = {"blk": 200, "x1": 2300, "y1": 100, "x2": 2304, "y2": 500}
    thin = layout.regions(spark, d).where("sys = 2 AND page_id % 6 = 0").select("sys", "page_id", "doc").distinct().select("*", *[F.lit(v).cast("long").alias(k) for k, v in at.items()], F.lit("text").alias("cls"))
    return r.unionByName(thin).withColumn("rank", F.when(F.col("page_id") % 5 == 0, F.col("blk") * 7 % 11).otherwise(F.col("blk")))


def families(spark: SparkSession) -> DataFrame:
    """Systems 2 and 3 are two configurations of one family."""
    return systems(spark).withColumnRenamed("id", "sys").withColumn("family", F.least("sys", F.lit(2)))


def page_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.page_consensus(layout.regions(spark, d), families(spark))


def system_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.system_consensus(page_consensus(spark, d))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    return consensus.class_scores(layout.regions(spark, d), families(spark))


def class_routes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.class_routes(class_scores(spark, d))


def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Systems 0 and 1 as two runs of one detector, on the pages that both have."""
    a, b = (layout.regions(spark, d).where(F.col("sys") == k) for k in (0, 1))
    both = a.select("page_id").distinct().join(b, "page_id", "left_semi")
    return consensus.one_to_one(both, a, b)


def run_verdict(spark: SparkSession, d: str) -> DataFrame:
    return consensus.run_verdict(run_agreement(spark, d))


def page_features(spark: SparkSession, d: str, regions: DataFrame) -> DataFrame:
    """One row of features for each system and page; without ``rank`` the blocks' numbers are their order."""
    regions = regions if "rank" in regions.columns else regions.withColumn("rank", F.col("blk"))
    return checks.features(layout.page_facts(spark, d), layout.lines(spark, d), regions, layout.bands(spark, d), layout.areas(spark, d), layout.gutters(spark, d), layout.PAGE_WIDTH, layout.PAGE_HEIGHT, list(range(4)))


SIDE = max(layout.PAGE_WIDTH, layout.PAGE_HEIGHT)


def found_on(facts: DataFrame) -> DataFrame:
    return checks.findings(facts, SIDE)


def feature_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on regions of mixed order, stretched, with thin ones."""
    return found_on(page_features(spark, d, disturbed(spark, d)))


def unverifiable_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many pages each check could not run on although they may need it."""
    facts = page_features(spark, d, with_repeats(spark, d))
    return facts.select("sys", F.explode(checks.skipped()).alias("check_id")).groupBy("sys", "check_id").agg(F.count(F.lit(1)).alias("n"))


def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Bands of running text: a table's columns are one."""
    c = spatial.page_columns(layout.lines(spark, d), layout.bands(spark, d))
    return c.select("page_id", F.explode("bands").alias("b")).select("page_id", "b.band_id", "b.x0", "b.x9")


def column_gutters(spark: SparkSession, d: str) -> DataFrame:
    g = checks.column_gutters(layout.lines(spark, d), layout.gutters(spark, d))
    return g.select("page_id", F.explode("gutters").alias("g")).select("page_id", "g.x0", "g.x9")


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """Lines in three boxes each, ten pixels apart and not quite level."""
    cut = F.explode(F.expr("sequence(0L, 2L)"))
    x = layout.lines(spark, d).withColumn("p", cut).withColumn("w", F.expr("(x2 - x1 - 20) div 3"))
    left, right = F.expr("x1 + p * (w + 10)"), F.expr("CASE WHEN p = 2 THEN x2 ELSE x1 + p * (w + 10) + w END")
    return x.select("page_id", (F.col("line_id") * 3 + F.col("p")).alias("line_id"), left.alias("x1"), (F.col("y1") + F.col("p")).alias("y1"), right.alias("x2"), (F.col("y2") + F.col("p")).alias("y2"))


def reading_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines put together again from their pieces, and how many pieces each has."""
    read = reading.reading_lines(pieces(spark, d)).groupBy("page_id", "read")
    return read.agg(F.count(F.lit(1)).alias("n_boxes"), *[f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])


def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    return reading.fragmentation(reading.reading_lines(pieces(spark, d)))


def finding_rates(spark: SparkSession, d: str) -> DataFrame:
    """Pages, and mean value, of each check's findings by system."""
    return feature_findings(spark, d).groupBy("sys", "check_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean_value"))


def page_gate(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: all checks of all systems on all pages over one row of features, and one decision a page.

    What fires and what could not run are arrays in a page's row, so the decision joins nothing.
    """
    return gate.decide(checks.judged(page_features(spark, d, with_repeats(spark, d)), SIDE))


def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    return page_gate(spark, d).groupBy("sys", "decision").agg(F.count(F.lit(1)).alias("n"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return gate.review_queue(page_gate(spark, d), 0.05, 20260904)


def verdict_estimate(spark: SparkSession, d: str) -> DataFrame:
    return gate.estimate(layout.verdicts(spark, d))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each region in the order of columns, top down, within a page."""
    w = Window.partitionBy("sys", "page_id").orderBy((F.col("x1") >= 1200).cast("int"), "y1", "x1", "blk")
    return layout.regions(spark, d).select("sys", "page_id", "blk", F.row_number().over(w).alias("place"))


def band_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often the order of blocks changes column."""
    w = Window.partitionBy("sys", "page_id").orderBy("blk")
    x = layout.regions(spark, d).withColumn("band", (F.col("x1") >= 1200).cast("int")).withColumn("before", F.lag("band").over(w))
    return x.groupBy("sys", "page_id").agg(F.count_if(F.col("band") != F.col("before")).alias("transitions"), F.countDistinct("band").alias("bands"))


def majority_class(spark: SparkSession, d: str) -> DataFrame:
    """Consensus class of each block over systems; of equal votes the one of the first system."""
    r = layout.regions(spark, d).groupBy("page_id", "blk", "cls").agg(F.count(F.lit(1)).alias("votes"), F.min("sys").alias("first"))
    w = Window.partitionBy("page_id", "blk").orderBy(F.desc("votes"), "first")
    return r.withColumn("k", F.row_number().over(w)).where("k = 1").select("page_id", "blk", "cls", "votes")


def class_confusion(spark: SparkSession, d: str) -> DataFrame:
    consensus = majority_class(spark, d).select("page_id", "blk", F.col("cls").alias("consensus"))
    return layout.regions(spark, d).join(consensus, ["page_id", "blk"]).groupBy("sys", "consensus", "cls").agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 5 pages a language and 2 a document in it, longest first."""
    docs = layout.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    per = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    all_ = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return docs.withColumn("a", F.row_number().over(per)).where("a <= 2").withColumn("b", F.row_number().over(all_)).where("b <= 5").select("doc_id", "lang", "source")


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Character 5-grams of benchmark texts that occur twice or more."""
    t = F.concat(F.lit(" "), "text", F.lit(" "))
    grams = layout.table(spark, d, "benchmark").select(t.alias("t")).select(F.explode(F.expr("transform(sequence(1, length(t) - 4), i -> substring(t, i, 5))")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = layout.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = layout.table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def script_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = layout.table(spark, d, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]")).cast("long").alias("latin"), F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("digits"))


def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """Kind, trust, direction and routing findings of every page; the lists as text."""
    r = routing.route(layout.signals(spark, d))
    return r.withColumn("available", F.array_join("available", " ")).withColumn("findings", F.array_join("findings", " "))


def routing_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each routing rule fires, by kind of page."""
    r = routing.route(layout.signals(spark, d)).select("page_kind", F.explode("findings").alias("check_id"))
    return r.groupBy("page_kind", "check_id").agg(F.count(F.lit(1)).alias("n"))


def signal_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Seven percentiles of each signal over all pages, in one pass over a long form."""
    points = ("0.01", "0.05", "0.25", "0.5", "0.75", "0.95", "0.99")
    long = layout.signals(spark, d).select(*layout.FRACTIONS).unpivot([], layout.FRACTIONS, "signal", "v")
    q = long.groupBy("signal").agg(F.expr(f"percentile(v, array({', '.join(points)}))").alias("q"))
    return q.select("signal", *[F.round(F.col("q")[k], 6).alias(f"p{float(x) * 100:g}") for k, x in enumerate(points)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        page_gate, line_assignment, orphan_lines, text_cover_semi, text_cover_anti, repeated_regions, system_agreement, class_counts, region_profile, region_outliers, metric_quantiles, longest_orphan_run, union_areas, gate_findings, gate_summary,
        review_queue, verdict_estimate, reading_order, band_transitions, majority_class, class_confusion, stratified_sample, char_ngrams, event_windows, order_rollup, script_profile,
        page_routes, routing_rates, signal_percentiles, shifted_findings, unverifiable_checks, page_columns, column_gutters, reading_lines, fragmentation, shared_areas, feature_findings, finding_rates,
        page_consensus, system_consensus, class_scores, class_routes, run_agreement, run_verdict,
    )
}

_SEMI = f"""SELECT k.sys, l.page_id, l.line_id FROM lines l JOIN (SELECT DISTINCT sys, page_id FROM regions) k USING (page_id)
WHERE {{0}} EXISTS (SELECT 1 FROM regions r WHERE r.sys = k.sys AND r.page_id = l.page_id AND r.cls IN ('text', 'table') AND {TOUCH} AND ({COVER}) / ((l.x2 - l.x1) * (l.y2 - l.y1))::DOUBLE >= 0.5)"""
_IOU = f"({COVER}) / (((l.x2 - l.x1) * (l.y2 - l.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)) - ({COVER}))::DOUBLE"
_MAJOR = "majority AS (SELECT page_id, blk, cls, votes FROM (SELECT page_id, blk, cls, count(*) AS votes, row_number() OVER (PARTITION BY page_id, blk ORDER BY count(*) DESC, min(sys)) AS k FROM regions GROUP BY page_id, blk, cls) WHERE k = 1)"

_MORE = f"""more AS (SELECT * FROM regions UNION ALL SELECT sys, page_id, doc, blk + 100, x1 + 1, y1 + 1, x2 + 1, y2 + 1, cls FROM regions WHERE sys = 3 AND (page_id + blk) % 5 = 0),
b AS (SELECT *, {BUCKET.format('cls')} AS bucket FROM more)"""
_SHIFTED = _MORE.replace("more AS", "plain AS", 1).replace("b AS (SELECT *", "more AS (SELECT sys, page_id, doc, blk, x1, y1, x2 + CASE WHEN (page_id + blk) % 13 = 0 THEN 1100 ELSE 0 END AS x2, y2 + CASE WHEN (page_id + blk) % 3 = 0 THEN 270 ELSE 0 END AS y2, cls FROM plain),\nb AS (SELECT *", 1)
_AREAS = """u AS (SELECT sys, page_id, x1 // 4 AS a, (x2 + 3) // 4 AS b, unnest(range(y1 // 4, (y2 + 3) // 4)) AS row FROM {0}),
s AS (SELECT sys, page_id, row, x, sum(d) AS d FROM (SELECT sys, page_id, row, a AS x, 1 AS d FROM u UNION ALL SELECT sys, page_id, row, b, -1 FROM u) GROUP BY ALL),
r AS (SELECT sys, page_id, sum(d) OVER w AS depth, lead(x) OVER w - x AS len FROM s WINDOW w AS (PARTITION BY sys, page_id, row ORDER BY x))
SELECT sys, page_id, sum(CASE WHEN depth > 0 THEN len ELSE 0 END)::BIGINT * 16 AS area, sum(CASE WHEN depth > 1 THEN len ELSE 0 END)::BIGINT * 16 AS shared FROM r GROUP BY ALL"""
_REPEATED = "SELECT l.sys, l.page_id, l.blk FROM b l WHERE EXISTS (SELECT 1 FROM b r WHERE r.sys = l.sys AND r.page_id = l.page_id AND r.bucket = l.bucket AND r.blk < l.blk AND abs(l.x1 - r.x1) <= 4 AND abs(l.y1 - r.y1) <= 4 AND abs(l.x2 - r.x2) <= 4 AND abs(l.y2 - r.y2) <= 4)"
_NEEDS = {"psr": ("psr_trust <> 'unusable'", "false"), "body_lines": ("n_lines > 0", "false"), "bands": ("n_bands >= 1", "est_columns <= 1"), "gutters": ("n_gutters > 0", "(n_bands <= 1 OR n > 40)"), "grids": ("n_grids > 0", "true"), "graphics": ("n_graphics > 0", "true"), "stream": ("true", "false"), "doc": ("doc_n IS NOT NULL", "true")}


def _runs(check: str) -> str:
    return " AND ".join(_NEEDS[n][0] for n in checks.NEEDS.get(check, "psr").split()) or "true"


def _skips(check: str) -> str:
    needs = [_NEEDS[n] for n in checks.NEEDS.get(check, "psr").split()]
    return f"(NOT ({' AND '.join(h for h, _ in needs)}) AND NOT ({' AND '.join(f'({h} OR {no})' for h, no in needs)}))" if needs else "false"


_COLS = f"""sides AS (SELECT page_id, count(*) AS nl, count(*) FILTER (pair) AS np, max(nr) AS nr FROM (
    SELECT l.page_id, (SELECT count(*) FROM lines r WHERE r.page_id = l.page_id AND r.x1 >= {layout.COLUMNS[1][0] - 2}) AS nr,
      EXISTS (SELECT 1 FROM lines r WHERE r.page_id = l.page_id AND r.x1 >= {layout.COLUMNS[1][0] - 2} AND least(l.y2, r.y2) - greatest(l.y1, r.y1) > 0.5 * (l.y2 - l.y1)) AS pair
    FROM lines l WHERE l.x2 <= {layout.COLUMNS[0][1] + 2}) GROUP BY page_id),
two AS (SELECT page_id, count(*) = 2 AND max(np) > 0.5 * max(nl) AND max(nr) > 0 AS one FROM raw_bands JOIN sides USING (page_id) GROUP BY page_id),
cols AS (SELECT page_id, band_id, x0, CASE WHEN band_id = 0 AND one THEN {layout.COLUMNS[1][1]} ELSE x9 END AS x9 FROM raw_bands JOIN two USING (page_id) WHERE NOT (band_id = 1 AND one)),
corr AS (SELECT s.page_id FROM sides s JOIN pgs USING (page_id) WHERE n > 40 AND nr > 0 AND np <= 0.5 * nl)"""


def _band(t: str) -> str:
    return f"CASE WHEN {t}.x2 - {t}.x1 <= 0.62 * {layout.PAGE_WIDTH} THEN (SELECT CASE WHEN count(*) = 1 THEN min(c.band_id) END FROM cols c WHERE c.page_id = {t}.page_id AND least({t}.x2, c.x9) - greatest({t}.x1, c.x0) > 0.5 * ({t}.x2 - {t}.x1)) END AS band"


_REV = "(least(l.x2, r.x2) - greatest(l.x1, r.x1)) * (least(l.y2, r.y2) - greatest(l.y1, r.y1)) / ((r.x2 - r.x1) * (r.y2 - r.y1))::DOUBLE"
_HELD = f"({COVER}) / ((l.x2 - l.x1) * (l.y2 - l.y1))::DOUBLE"
_WIDE = "((least(l.x2, r.x2) - greatest(l.x1, r.x1)) / (l.x2 - l.x1)::DOUBLE)"
_IN = f"(y1 + y2) / 2.0 BETWEEN 0.08 * {layout.PAGE_HEIGHT} AND 0.92 * {layout.PAGE_HEIGHT}"
_CASES = {
    "C1-01": ("n_orphans >= 4 AND n_orphans / n_lines::DOUBLE > 0.12", "n_orphans / n_lines::DOUBLE"), "C1-02": ("n_orphans >= 4 AND lost / ink::DOUBLE > 0.12", "lost / ink::DOUBLE"), "C1-03": ("longest >= 3", "longest"),
    "C1-04": ("in_band >= 10 AND lost_band / in_band::DOUBLE > 0.12", "lost_band / in_band::DOUBLE"), "C1-05": ("n_text = 0 AND n_bare >= 10", "n_bare"), "C1-06": ("foot >= 4", "foot"), "C1-07": ("n_missed >= 2", "n_missed"),
    "C2-01": ("n_cut / n_lines::DOUBLE > 0.15", "n_cut / n_lines::DOUBLE"), "C2-06": ("n_empty > 0", "n_empty"), "C3-01": ("n_through > 0", "n_through"), "C3-02": ("n_bands >= 2 AND n_spanning > 0", "n_spanning"),
    "C3-05": ("n_bands >= 2 AND n_columns >= 2 AND least_band >= 5 AND (n_banded = 0 OR share > 0.85)", "CASE WHEN n_banded = 0 THEN 1.0 ELSE share END"), "C4-02": ("inversions >= 2", "inversions"),
    "C4-03": ("n_bands >= 2 AND transitions - (n_bands - 1) > 2", "transitions - (n_bands - 1)"), "C4-08": ("intruders > 0", "intruders"), "C4-09": ("jumps >= 3", "jumps"),
    "C4-10": ("direction = 'rtl' AND row_pairs >= 3 AND row_wrong / row_pairs::DOUBLE > 0.5", "row_wrong / row_pairs::DOUBLE"), "C5-01": ("n_partly >= 4 AND n_partly / n_regions::DOUBLE > 0.30", "n_partly / n_regions::DOUBLE"),
    "C5-03": ("n_twice / n_lines::DOUBLE > 0.02", "n_twice / n_lines::DOUBLE"), "C5-04": ("n_regions >= 4 AND n_again / n_regions::DOUBLE > 0.20", "n_again / n_regions::DOUBLE"), "C6-01": ("n_ungrid > 0", "n_ungrid"), "C6-03": ("n_unseen > 0", "n_unseen"),
    "C6-05": ("n_inside > 0", "n_inside"), "C6-06": ("n_thrown / n_lines::DOUBLE > 0.15", "n_thrown / n_lines::DOUBLE"), "C7-01": (f"beyond > 0.02 * {SIDE}", "beyond"), "C7-03": ("n_thin > 0", "n_thin"),
    "C7-04": ("n_bands >= 3 AND n_huge > 0", "n_huge"), "C7-05": ("n_regions > 0 AND total / body::DOUBLE < 0.40", "total / body::DOUBLE"), "C8-01": ("doc_n >= 5 AND doc_running >= 0.8 AND n_lines >= 20 AND running = 0", "doc_running"),
    "C8-02": ("doc_n >= 5 AND n_columns <> doc_columns", "n_columns"), "C8-03": ("doc_n >= 5 AND doc_sd >= 1 AND abs(n_regions - doc_mean) / doc_sd > 4", "abs(n_regions - doc_mean) / doc_sd"),
    "C8-05": ("doc_n >= 5 AND doc_classes >= 4 AND n_classes <= 1 AND n_regions > 3", "n_classes"), "C8-06": ("doc_n >= 5 AND n_lines >= 20 AND abs(font - doc_font) / doc_font > 0.4", "abs(font - doc_font) / doc_font"),
}


def _facts(regions: str) -> str:
    """Features and findings of the region table ``dis`` that ``regions`` states."""
    return f"""{WITH}, {regions}, {layout.PAGES_SQL}, {layout.AREAS_SQL}, {_COLS},
{OWNED.replace("JOIN regions r", "JOIN dis r")},
bl AS (SELECT l.*, {_band("l")} FROM lines l),
pg AS (SELECT page_id, count(*) AS n_lines, sum((x2 - x1) * (y2 - y1)) AS ink, count(band) AS in_band, median(y2 - y1) AS line_h, count(DISTINCT band) AS n_columns, (max(x2) - min(x1)) * (max(y2) - min(y1)) AS body,
  least(nullif(count(*) FILTER (band = 0), 0), nullif(count(*) FILTER (band = 1), 0)) AS least_band FROM bl GROUP BY page_id),
orp AS (SELECT sys, bl.*, {_IN} AS content FROM orphan JOIN bl USING (page_id, line_id)),
oa AS (SELECT sys, page_id, count(*) FILTER (content) AS n_orphans, sum((x2 - x1) * (y2 - y1)) FILTER (content) AS lost, count(band) FILTER (content) AS lost_band, count(*) FILTER (y1 >= {layout.PAGE_HEIGHT} * 0.88) AS foot FROM orp GROUP BY ALL),
orw AS (SELECT *, CASE WHEN y1 - lag(y2) OVER (PARTITION BY sys, page_id ORDER BY y1, x1) <= 1.8 * 50 THEN 0 ELSE 1 END AS new FROM orp WHERE content),
orr AS (SELECT sys, page_id, max(n) AS longest FROM (SELECT sys, page_id, run, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY sys, page_id ORDER BY y1, x1) AS run FROM orw) GROUP BY ALL) GROUP BY ALL),
own AS (SELECT sys, page_id, blk, count(*) AS k FROM owned GROUP BY ALL),
hd AS (SELECT d.*, coalesce(own.k, 0) AS k, {BUCKET.format('cls')} AS bucket, {_band("d")} FROM dis d LEFT JOIN own ON own.sys = d.sys AND own.page_id = d.page_id AND own.blk = d.blk),
ra AS (SELECT sys, page_id, count(*) AS n_regions, count(DISTINCT cls) AS n_classes, max((bucket = 'DISCARD')::INT) AS running, count(*) FILTER (bucket = 'TEXT') AS n_text, sum((x2 - x1) * (y2 - y1)) AS total,
  max(greatest(-x1, -y1, x2 - {layout.PAGE_WIDTH}, y2 - {layout.PAGE_HEIGHT})) AS beyond, count(*) FILTER ((x2 - x1) * (y2 - y1) > 0 AND k = 0 AND greatest(x2 - x1, y2 - y1) > 60 * least(x2 - x1, y2 - y1)) AS n_thin,
  count(*) FILTER ((x2 - x1) * (y2 - y1) > 0.85 * {layout.PAGE_WIDTH * layout.PAGE_HEIGHT}) AS n_huge, count(*) FILTER (bucket = 'DISCARD' AND k > 3 AND band IS NOT NULL AND {_IN}) AS n_inside, coalesce(sum(k) FILTER (bucket = 'DISCARD'), 0) AS n_thrown,
  greatest(coalesce(sum(k) FILTER (band = 0), 0), coalesce(sum(k) FILTER (band = 1), 0)) / greatest(sum(k) FILTER (band IS NOT NULL), 1)::DOUBLE AS share, count(band) AS n_banded FROM hd GROUP BY ALL),
sp AS (SELECT sys, page_id, count(*) AS n_spanning FROM (SELECT h.sys, h.page_id, h.blk FROM hd h JOIN cols c ON c.page_id = h.page_id AND least(h.x2, c.x9) - greatest(h.x1, c.x0) > 0.2 * (c.x9 - c.x0) WHERE bucket = 'TEXT' GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
th AS (SELECT sys, page_id, count(*) AS n_through FROM hd JOIN corr USING (page_id) WHERE bucket = 'TEXT' AND least(x2, {layout.COLUMNS[1][0]}) - greatest(x1, {layout.COLUMNS[0][1]}) > 0.6 * {layout.COLUMNS[1][0] - layout.COLUMNS[0][1]} GROUP BY ALL),
us AS (SELECT l.sys, l.page_id, count(*) AS n_unseen FROM hd l WHERE bucket = 'MEDIA' AND k > 5 AND NOT EXISTS (SELECT 1 FROM areas r WHERE r.kind = 'graphic' AND r.page_id = l.page_id AND {TOUCH} AND {_HELD} >= 0.15) GROUP BY ALL),
cl AS (SELECT r.sys, l.page_id, count(DISTINCT line_id) AS n_cut FROM lines l JOIN dis r ON l.page_id = r.page_id AND {TOUCH} WHERE {_WIDE} > 0.15 AND {_WIDE} < 0.85 AND {_HELD} > 0.05 GROUP BY ALL),
hl AS (SELECT r.sys, l.page_id, line_id, blk, r.x1, r.y1, r.x2, r.y2 FROM lines l JOIN hd r ON l.page_id = r.page_id AND {TOUCH} AND bucket = 'TEXT' AND {_HELD} >= 0.5),
tw AS (SELECT l.sys, l.page_id, count(DISTINCT l.line_id) AS n_twice FROM hl l JOIN hl r ON l.sys = r.sys AND l.page_id = r.page_id AND l.line_id = r.line_id AND l.blk < r.blk AND {_HELD} < 0.9 AND {_REV} < 0.9 GROUP BY ALL),
em AS (SELECT sys, page_id, count(*) AS n_empty FROM hd r WHERE bucket = 'TEXT' AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.page_id = r.page_id AND {TOUCH} AND ({_HELD} >= 0.5 OR {_REV} >= 0.5)) GROUP BY ALL),
br AS (SELECT s.sys, l.page_id, count(*) AS n_bare FROM lines l CROSS JOIN systems s WHERE NOT EXISTS (SELECT 1 FROM hd r WHERE r.sys = s.sys AND r.page_id = l.page_id AND bucket = 'TABLE' AND {TOUCH} AND {_HELD} >= 0.6) GROUP BY ALL),
prt AS (SELECT l.sys, l.page_id, l.blk AS a, r.blk AS c, ({COVER}) / least((l.x2 - l.x1) * (l.y2 - l.y1), (r.x2 - r.x1) * (r.y2 - r.y1))::DOUBLE AS share FROM hd l JOIN hd r ON l.sys = r.sys AND l.page_id = r.page_id AND l.bucket = r.bucket AND l.blk < r.blk AND {TOUCH}),
pt AS (SELECT sys, page_id, count(DISTINCT blk) AS n_partly FROM (SELECT sys, page_id, unnest([a, c]) AS blk FROM prt WHERE share > 0.5 AND share <= 0.9) GROUP BY ALL),
ag AS (SELECT l.sys, l.page_id, count(*) AS n_again FROM hd l WHERE EXISTS (SELECT 1 FROM hd r WHERE r.sys = l.sys AND r.page_id = l.page_id AND r.bucket = l.bucket AND r.blk < l.blk AND abs(l.x1 - r.x1) <= 25 AND abs(l.y1 - r.y1) <= 25 AND abs(l.x2 - r.x2) <= 25 AND abs(l.y2 - r.y2) <= 25) GROUP BY ALL),
mg AS (SELECT s.sys, l.page_id, count(*) AS n_missed FROM areas l CROSS JOIN systems s WHERE kind = 'graphic' AND (x2 - x1) * (y2 - y1) > 0.02 * {layout.PAGE_WIDTH * layout.PAGE_HEIGHT} AND NOT EXISTS (SELECT 1 FROM hd r WHERE r.sys = s.sys AND r.page_id = l.page_id AND bucket = 'MEDIA' AND {TOUCH} AND {_HELD} > 0.5) GROUP BY ALL),
mt AS (SELECT s.sys, l.page_id, count(*) AS n_ungrid FROM areas l CROSS JOIN systems s WHERE kind = 'grid' AND NOT EXISTS (SELECT 1 FROM hd r WHERE r.sys = s.sys AND r.page_id = l.page_id AND bucket = 'TABLE' AND {TOUCH} AND {_HELD} > 0.5) GROUP BY ALL),
ow AS (SELECT o.sys, o.page_id, l.line_id, l.band, l.x1, l.y1, l.x2, l.y2, row_number() OVER (PARTITION BY o.sys, o.page_id ORDER BY rank, o.blk, l.y1, l.x1, l.line_id) AS at_ FROM owned o JOIN dis d USING (sys, page_id, blk) JOIN bl l ON l.page_id = o.page_id AND l.line_id = o.line_id),
mv AS (SELECT sys, page_id, count(*) FILTER (band <> before) AS transitions FROM (SELECT *, lag(band) OVER (PARTITION BY sys, page_id ORDER BY at_) AS before FROM ow WHERE band IS NOT NULL) GROUP BY ALL),
un AS (SELECT sys, page_id, max(between_) AS intruders FROM (SELECT l.sys, l.page_id, r.area_id, count(*) AS n, max(at_) - min(at_) + 1 - count(*) AS between_ FROM ow l JOIN areas r ON l.page_id = r.page_id AND {TOUCH} AND {_HELD} >= 0.6 GROUP BY ALL) WHERE n >= 6 AND between_ > 0.25 * n GROUP BY ALL),
jm AS (SELECT sys, page_id, count(*) FILTER (y1 < b2 - greatest(3 * line_h, 40) AND NOT coalesce(band <> bb, false)) AS jumps, count(*) FILTER (row) AS row_pairs, count(*) FILTER (row AND x1 > bx) AS row_wrong FROM (
  SELECT *, least(y2, b2) - greatest(y1, b1) >= 0.5 * least(y2 - y1, b2 - b1) AS row FROM (
    SELECT *, lag(y1) OVER w AS b1, lag(y2) OVER w AS b2, lag(x1) OVER w AS bx, lag(band) OVER w AS bb FROM hd WHERE k > 0 WINDOW w AS (PARTITION BY sys, page_id ORDER BY rank, blk))) JOIN pg USING (page_id) GROUP BY ALL),
iv AS (SELECT sys, page_id, count(*) FILTER (y1 < b1 - greatest(3 * line_h, 40)) AS inversions FROM (SELECT *, lag(y1) OVER (PARTITION BY sys, page_id, band ORDER BY rank, y1, blk) AS b1 FROM hd WHERE k > 0 AND band IS NOT NULL) JOIN pg USING (page_id) GROUP BY ALL),
ft AS (SELECT s.sys, d.*, coalesce(n_lines, 0) AS n_lines, ink, body, coalesce(in_band, 0) AS in_band, least_band, coalesce(n_columns, 0) AS n_columns, n_orphans, lost, lost_band, foot, longest, coalesce(n_regions, 0) AS n_regions, coalesce(n_classes, 0) AS n_classes, coalesce(n_text, 0) AS n_text,
  coalesce(running, 0) AS running, n_thin, n_huge, n_inside, n_thrown, share, coalesce(n_banded, 0) AS n_banded, n_spanning, n_through, n_unseen, total, beyond, n_cut, n_twice, n_empty, n_bare, n_partly, n_again, n_missed, n_ungrid, transitions, jumps, row_pairs, row_wrong, inversions, intruders,
  (SELECT count(*) FROM cols c WHERE c.page_id = d.page_id) AS n_bands, (SELECT count(*) FROM corr c WHERE c.page_id = d.page_id) AS n_gutters, (SELECT count(*) FROM areas a WHERE a.page_id = d.page_id AND kind = 'grid') AS n_grids, (SELECT count(*) FROM areas a WHERE a.page_id = d.page_id AND kind = 'graphic') AS n_graphics
  FROM facts d CROSS JOIN systems s LEFT JOIN pg ON pg.page_id = d.page_id {' '.join(f'LEFT JOIN {x} ON {x}.sys = s.sys AND {x}.page_id = d.page_id' for x in 'oa orr ra sp th us cl tw em br pt ag mg mt mv un jm iv'.split())}),
dp AS (SELECT sys, doc, count(*) AS doc_n, avg(running) AS doc_running, avg(n_regions) AS doc_mean, stddev_pop(n_regions) AS doc_sd, median(n_classes) AS doc_classes, median(font) AS doc_font FROM ft GROUP BY ALL),
dm AS (SELECT sys, doc, n_columns AS doc_columns FROM (SELECT sys, doc, n_columns, row_number() OVER (PARTITION BY sys, doc ORDER BY count(*) DESC, min(page_id)) AS k FROM ft GROUP BY sys, doc, n_columns) WHERE k = 1),
all_ AS (SELECT * FROM ft JOIN dp USING (sys, doc) JOIN dm USING (sys, doc)),
hits AS ({" UNION ALL ".join(f"SELECT sys, page_id, '{k}' AS check_id, ({v})::DOUBLE AS value FROM all_ WHERE ({cond}) AND {_runs(k)}" for k, (cond, v) in _CASES.items())}),
miss AS ({" UNION ALL ".join(f"SELECT sys, page_id, '{k}' AS check_id FROM all_ WHERE {_skips(k)}" for k in _CASES)})"""


_FINDINGS = _facts(f"{_MORE}, dis AS (SELECT *, blk AS rank FROM more)")
_STRETCHED = _facts(f"{_SHIFTED}, dis AS (SELECT *, blk AS rank FROM more)")
_FEATURES = _facts(f"""{_SHIFTED}, dis AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN blk * 7 % 11 ELSE blk END AS rank FROM (
  SELECT sys, page_id, doc, blk, x1, y1, x2, y2, cls FROM more UNION ALL SELECT DISTINCT sys, page_id, doc, 200, 2300, 100, 2304, 500, 'text' FROM regions WHERE sys = 2 AND page_id % 6 = 0))""")
_LEVEL = "CASE " + " ".join(f"WHEN check_id = '{k}' THEN '{v}'" for k, v in (gate.SEVERITY | gate.POLICY["override"]["archive"]).items()) + " END"
_GATE = f"""{_FINDINGS},
judged AS (SELECT *, {_LEVEL} AS severity, CASE substr(check_id, 1, 2) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in gate.POLICY['tasks'].items())} END AS task FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.sys = h.sys AND o.page_id = h.page_id AND ((h.check_id IN ('C1-01', 'C1-02', 'C1-03') AND o.check_id IN ('C1-02', 'C1-03', 'C1-04') AND o.check_id > h.check_id) OR (h.check_id = 'C3-01' AND o.check_id = 'C3-02')))),
counted AS (SELECT sys, page_id, count(*) FILTER (severity = 'BLOCK') AS n_block, count(*) FILTER (severity = 'MAJOR') AS n_major, count(*) FILTER (severity = 'ADV') AS n_adv, min(task) FILTER (severity = 'BLOCK') AS first FROM judged GROUP BY ALL),
vetoed AS (SELECT sys, page_id, count(*) FILTER (severity = 'BLOCK') AS n_veto, count(*) FILTER (severity <> 'BLOCK') AS n_unverifiable FROM (SELECT *, {_LEVEL} AS severity FROM miss) GROUP BY ALL),
gated AS (SELECT s.sys, d.page_id, CASE WHEN psr_trust = 'unusable' THEN 'defer' WHEN n_block > 0 OR n_veto > 0 THEN 'escalate' ELSE 'accept' END AS decision,
  CASE WHEN psr_trust = 'unusable' THEN NULL WHEN n_block > 0 THEN first WHEN n_veto > 0 THEN 'E6' END AS task, coalesce(n_block, 0) AS n_block, coalesce(n_major, 0) AS n_major, coalesce(n_adv, 0) AS n_adv, coalesce(n_unverifiable, 0) AS n_unverifiable,
  round(least(1, 0.25 * coalesce(n_major, 0) + 0.05 * coalesce(n_adv, 0) + 0.15 * coalesce(n_unverifiable, 0)), 4)::DOUBLE AS risk
  FROM facts d CROSS JOIN systems s LEFT JOIN counted c ON c.sys = s.sys AND c.page_id = d.page_id LEFT JOIN vetoed v ON v.sys = s.sys AND v.page_id = d.page_id)"""

# On the stand-in pages a block is a cluster: its regions nearly coincide and others do not meet it.
_CONSENSUS = f"""{WITH}, m AS (SELECT *, least(sys, 2) AS family FROM regions),
votes AS (SELECT page_id, blk, cls, row_number() OVER (PARTITION BY page_id, blk ORDER BY count(*) DESC, min(sys)) AS k FROM m GROUP BY page_id, blk, cls),
seen AS (SELECT page_id, blk, count(DISTINCT family) AS n_fam FROM m GROUP BY ALL),
total AS (SELECT page_id, count(*) FILTER (n_fam >= 2) AS total FROM seen GROUP BY ALL),
per_page AS (SELECT m.sys, m.page_id, count(*) FILTER (n_fam >= 2) AS found, any_value(total) AS total, count(*) FILTER (n_fam >= 2 AND m.cls = v.cls) AS agree, count(*) FILTER (n_fam >= 3) AS backed, count(*) FILTER (n_fam = 1) AS solo, count(*) AS n
  FROM m JOIN seen USING (page_id, blk) JOIN votes v ON v.page_id = m.page_id AND v.blk = m.blk AND v.k = 1 JOIN total t ON t.page_id = m.page_id GROUP BY ALL)"""
_SCORES = f"""{WITH}, m AS (SELECT *, least(sys, 2) AS family FROM regions),
seen AS (SELECT page_id, cls, blk, count(DISTINCT family) AS n_fam FROM m GROUP BY ALL),
total AS (SELECT page_id, cls, count(*) AS total FROM seen WHERE n_fam >= 3 GROUP BY ALL),
page AS (SELECT m.page_id, m.cls, m.sys, count(*) FILTER (n_fam >= 3) AS found, count(*) AS mine, any_value(total) AS total FROM m JOIN seen USING (page_id, cls, blk) JOIN total USING (page_id, cls) GROUP BY ALL),
won AS (SELECT *, 2.0 * found / (mine + total) AS f, max(2.0 * found / (mine + total)) OVER (PARTITION BY page_id, cls) AS top FROM page),
sums AS (SELECT cls, sys, sum(found) AS found, sum(mine - found) AS unbacked, count(*) FILTER (top > 0 AND f >= top - 0.01) AS wins FROM won GROUP BY ALL),
classes AS (SELECT cls, sum(total) AS regions, count(*) AS pages FROM total GROUP BY ALL),
scores AS (SELECT c.cls, s.sys, regions::BIGINT AS regions, pages, coalesce(found, 0)::BIGINT AS found, coalesce(unbacked, 0)::BIGINT AS unbacked, coalesce(wins, 0) AS wins, round(coalesce(found, 0) / regions::DOUBLE, 4) AS recall,
  coalesce(round(found / nullif(found + unbacked, 0)::DOUBLE, 4), 0) AS precision, coalesce(round(2 * found / nullif(found + unbacked + regions, 0)::DOUBLE, 4), 0) AS f1
  FROM classes c CROSS JOIN (SELECT unnest(range(0, 4)) AS sys) s LEFT JOIN sums u ON u.cls = c.cls AND u.sys = s.sys)"""
# Of one system no two blocks overlap another's by 0.7, so the greedy match is the best match.
_AGREE = f"""{WITH}, n AS (SELECT page_id, count(*) FILTER (sys = 0)::INT AS n_left, count(*) FILTER (sys = 1)::INT AS n_right FROM regions GROUP BY page_id HAVING n_left > 0 AND n_right > 0),
m AS (SELECT l.page_id, count(*)::INT AS matched, count(*) FILTER (l.cls = r.cls)::INT AS same_class FROM regions l JOIN regions r ON l.page_id = r.page_id AND l.sys = 0 AND r.sys = 1 AND {TOUCH}
  WHERE ({COVER}) / ((l.x2 - l.x1) * (l.y2 - l.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - ({COVER}))::DOUBLE >= 0.7 GROUP BY ALL),
agree AS (SELECT page_id, n_left, n_right, coalesce(matched, 0) AS matched, coalesce(same_class, 0) AS same_class, round(coalesce(matched, 0) / greatest(n_left, n_right)::DOUBLE, 4) AS box_agreement, round(coalesce(same_class, 0) / greatest(n_left, n_right)::DOUBLE, 4) AS class_agreement
  FROM n LEFT JOIN m USING (page_id))"""
_NULL0 = "coalesce({0}, 0) + coalesce({1}, 0)".format
_T = routing.THRESHOLDS
_RULES = {
    "C0-01": f"n_chars < {_T['min_chars']}", "C0-02": f"n_chars >= {_T['min_chars']} AND n_lines < {_T['sparse_max_lines']} AND greatest(image_area_frac, glyph_area_frac) > {_T['sparse_min_ink']}",
    "C0-03": f"{_NULL0('invisible_frac', 'white_frac')} > {_T['invisible_frac']}", "C0-04": f"lines_in_big_image_frac > {_T['ocr_lines_in_image']} AND big_image_area_frac > {_T['ocr_image_area']}", "C0-05": "rotation % 90 <> 0",
    "C0-06": f"{_NULL0('pua_cp_frac', 'undecoded_cp_frac')} > {_T['undecodable_frac']}", "C0-07": f"median_chars_per_span <= {_T['frag_max_chars_per_span']} AND n_spans > {_T['frag_min_spans']}", "C0-08": "direction = 'unknown'",
    "C0-09": f"lines_outside_crop_frac > {_T['clipped_frac']}", "C0-10": f"vector_area_frac > {_T['outline_vector_ink']} AND glyph_area_frac < {_T['outline_max_glyph']}",
}
_ROUTES = f"""WITH {layout.SIGNALS_SQL},
directions AS (SELECT doc, CASE WHEN sum(n_chars) < {_T['doc_min_chars']} THEN 'unknown' WHEN sum(n_chars * rtl_cp_frac) / greatest(sum(n_chars), 1) > {_T['doc_rtl_aggregate']} OR max(rtl_cp_frac) > {_T['doc_rtl_max_page']} THEN 'rtl' ELSE 'ltr' END AS direction FROM signals GROUP BY doc),
rules AS (SELECT *, {', '.join(f"({v}) AS {k.replace('-', '_')}" for k, v in _RULES.items())} FROM signals JOIN directions USING (doc)),
kinds AS (SELECT *, CASE WHEN C0_01 THEN 'scanned' WHEN C0_02 OR C0_04 OR C0_10 THEN 'hybrid' ELSE 'born_digital' END AS page_kind FROM rules),
routes AS (SELECT page_id, doc, page_kind, CASE WHEN page_kind = 'scanned' OR coalesce(invisible_frac, 0) + coalesce(white_frac, 0) > 0.90 OR C0_10 THEN 'unusable' WHEN page_kind = 'hybrid' OR C0_07 OR C0_06 OR C0_09 THEN 'degraded' ELSE 'full' END AS psr_trust, direction,
  CASE page_kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in routing.AVAILABLE.items())} END AS available, concat_ws(' ', {', '.join(f"CASE WHEN {k.replace('-', '_')} THEN '{k}' END" for k in _RULES)}) AS findings FROM kinds)"""

SQL: dict[str, str] = {
    "page_routes": f"{_ROUTES} SELECT * FROM routes",
    "routing_rates": f"{_ROUTES} SELECT page_kind, check_id, count(*) AS n FROM (SELECT page_kind, unnest(string_split(findings, ' ')) AS check_id FROM routes WHERE findings <> '') GROUP BY ALL",
    "signal_percentiles": f"WITH {layout.SIGNALS_SQL}, q AS (SELECT signal, quantile_cont(v, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM (UNPIVOT (SELECT {', '.join(layout.FRACTIONS)} FROM signals) ON COLUMNS(*) INTO NAME signal VALUE v) GROUP BY signal) SELECT signal, " + ", ".join(f"round(q[{k + 1}], 6) AS p{x}" for k, x in enumerate((1, 5, 25, 50, 75, 95, 99))) + " FROM q",
    "line_assignment": f"{WITH}, {OWNED} SELECT sys, page_id, line_id, blk, round(cov, 6) AS cov FROM owned",
    "orphan_lines": f"{WITH}, {OWNED} SELECT * FROM orphan",
    "text_cover_semi": f"{WITH} " + _SEMI.format(""),
    "text_cover_anti": f"{WITH} " + _SEMI.format("NOT"),
    "repeated_regions": f"""{WITH}, more AS (SELECT * FROM regions UNION ALL SELECT sys, page_id, doc, blk + 100, x1 + 1, y1 + 1, x2 + 1, y2 + 1, cls FROM regions WHERE sys = 3 AND (page_id + blk) % 5 = 0),
b AS (SELECT *, {BUCKET.format('cls')} AS bucket FROM more)
SELECT l.sys, l.page_id, l.blk FROM b l WHERE EXISTS (SELECT 1 FROM b r WHERE r.sys = l.sys AND r.page_id = l.page_id AND r.bucket = l.bucket AND r.blk < l.blk AND abs(l.x1 - r.x1) <= 4 AND abs(l.y1 - r.y1) <= 4 AND abs(l.x2 - r.x2) <= 4 AND abs(l.y2 - r.y2) <= 4)""",
    "system_agreement": f"""{WITH}, m AS (SELECT l.page_id, l.blk, r.blk AS other, {_IOU} AS iou FROM regions l JOIN regions r ON l.page_id = r.page_id AND l.sys = 0 AND r.sys = 1 AND {TOUCH}),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id, blk ORDER BY iou DESC, other) AS k FROM m WHERE iou >= 0.5)
SELECT page_id, count(*) AS matched, round(avg(iou), 6) AS mean_iou FROM best WHERE k = 1 GROUP BY page_id""",
    "class_counts": f"{WITH} SELECT sys, cls, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM regions GROUP BY sys, cls",
    "region_profile": f"""{WITH}, p AS (SELECT sys, doc, page_id, count(*) AS n, count(DISTINCT cls) AS classes, max(CASE WHEN cls = 'header' THEN 1 ELSE 0 END) AS running FROM regions GROUP BY ALL)
SELECT sys, doc, count(*) AS n_pages, round(avg(n), 6) AS mean_regions, round(stddev_pop(n), 6) AS sd_regions, quantile_cont(classes, 0.5)::DOUBLE AS median_classes, round(avg(running), 6) AS running_rate FROM p GROUP BY sys, doc""",
    "region_outliers": f"""{WITH}, p AS (SELECT sys, doc, page_id, count(*) AS n FROM regions GROUP BY ALL), x AS (SELECT *, avg(n) OVER w AS mean, stddev_pop(n) OVER w AS sd, count(*) OVER w AS pages FROM p WINDOW w AS (PARTITION BY sys, doc))
SELECT sys, page_id, n FROM x WHERE pages >= 5 AND sd >= 1 AND abs(n - mean) / sd > 1.5""",
    "metric_quantiles": f"""{WITH}, {OWNED}, v AS (SELECT s.sys, (n - coalesce(k, 0)) / n::DOUBLE AS v FROM (SELECT page_id, count(*) AS n FROM lines GROUP BY 1) l CROSS JOIN systems s LEFT JOIN (SELECT sys, page_id, count(*) AS k FROM owned GROUP BY ALL) o ON o.sys = s.sys AND o.page_id = l.page_id)
SELECT sys, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM v GROUP BY sys""",
    "longest_orphan_run": f"{_FINDINGS} SELECT sys, page_id, longest FROM orr",
    "shifted_findings": f"{_STRETCHED} SELECT sys, page_id, check_id, round(value, 6) AS value FROM hits",
    "feature_findings": f"{_FEATURES} SELECT sys, page_id, check_id, round(value, 6) AS value FROM hits",
    "unverifiable_checks": f"{_FINDINGS} SELECT sys, check_id, count(*) AS n FROM miss GROUP BY ALL",
    "page_columns": f"{WITH}, {_COLS} SELECT page_id, band_id, x0, x9 FROM cols",
    "column_gutters": f"{WITH}, {_COLS} SELECT page_id, {layout.COLUMNS[0][1]}::BIGINT AS x0, {layout.COLUMNS[1][0]}::BIGINT AS x9 FROM corr",
    "reading_lines": f"{WITH} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY y1, x1) - 1)::INT AS read, 3::BIGINT AS n_boxes, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, (y2 + 2)::DOUBLE AS y2 FROM lines",
    "fragmentation": f"{WITH} SELECT page_id, count(*) * 3 AS n_boxes, count(*) AS n_lines, 3.0::DOUBLE AS fragmentation FROM lines GROUP BY page_id",
    "finding_rates": f"{_FEATURES} SELECT sys, check_id, count(*) AS n, round(avg(round(value, 6)), 5) AS mean_value FROM hits GROUP BY ALL",
    "page_consensus": f"{_CONSENSUS} SELECT * FROM per_page",
    "system_consensus": f"""{_CONSENSUS} SELECT sys, round(sum(found) / sum(total)::DOUBLE, 4) AS recall, round(sum(agree) / sum(found)::DOUBLE, 4) AS class_agreement, round(sum(backed) / sum(n)::DOUBLE, 4) AS precision, round(sum(solo) / sum(n)::DOUBLE, 4) AS solo_rate, sum(n)::BIGINT AS n FROM per_page GROUP BY sys""",
    "class_scores": f"{_SCORES} SELECT * FROM scores",
    "class_routes": f"""{_SCORES}, x AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, sys) AS k, max(f1) OVER (PARTITION BY cls) AS top FROM scores),
y AS (SELECT cls, max(sys) FILTER (k = 1) AS leader, max(top) AS f1, round(max(top) - max(f1) FILTER (k = 2), 4) AS margin, round(max(wins) FILTER (k = 1) / max(pages)::DOUBLE, 3) AS win_rate, count(*) FILTER (f1 >= round(top - 0.02, 6)) AS n_equal, max(regions) AS regions FROM x GROUP BY cls)
SELECT cls, CASE WHEN regions < 8 THEN 'insufficient evidence' WHEN n_equal > 1 AND f1 >= 0.97 THEN 'tied at ceiling' WHEN n_equal > 1 THEN 'no separable leader' WHEN win_rate < 0.5 THEN 'unstable leader' ELSE 'route' END AS decision, leader, f1, margin, win_rate, n_equal FROM y""",
    "run_agreement": f"{_AGREE} SELECT * FROM agree",
    "run_verdict": f"{_AGREE} SELECT count(*) AS n_pages, round(avg(box_agreement), 4) AS mean_agreement, CASE WHEN count(*) = 0 THEN 'no_result' WHEN avg(box_agreement) >= 0.85 THEN 'ok' ELSE 'MISMATCH' END AS verdict FROM agree",
    "shared_areas": f"{WITH}, {_SHIFTED}, {_AREAS.format('more')}",
    "gate_findings": f"{_FINDINGS} SELECT sys, page_id, check_id, round(value, 6) AS value FROM hits",
    "page_gate": f"{_GATE} SELECT * FROM gated",
    "gate_summary": f"{_GATE} SELECT sys, decision, count(*) AS n FROM gated GROUP BY ALL",
    "review_queue": f"{_GATE} SELECT task, sys, page_id, risk FROM gated WHERE decision = 'escalate' UNION ALL SELECT 'E7', sys, page_id, risk FROM gated WHERE decision = 'accept' AND substr(sha256('20260904|' || sys || '|' || page_id), 1, 8) < '0ccccccc'",
    "union_areas": f"{WITH}, {_AREAS.format('regions')}",
    "verdict_estimate": """WITH s AS (SELECT count(*) FILTER (toxic = 0) AS audit_n, count(*) FILTER (toxic = 0 AND quality <> 1) AS audit_wrong, count(*) FILTER (toxic <> 0) AS escalation_n, count(*) FILTER (toxic <> 0 AND quality <> 1) AS escalation_right FROM labels),
p AS (SELECT *, audit_wrong / audit_n::DOUBLE AS q, 3.8416 AS zz FROM s)
SELECT audit_n, audit_wrong, escalation_n, escalation_right, round(q, 6) AS false_accept,
  round(greatest(0, ((q + zz / (2 * audit_n)) - 1.96 * sqrt(q * (1 - q) / audit_n + zz / (4.0 * audit_n * audit_n))) / (1 + zz / audit_n)), 6)::DOUBLE AS lo,
  round(least(1, ((q + zz / (2 * audit_n)) + 1.96 * sqrt(q * (1 - q) / audit_n + zz / (4.0 * audit_n * audit_n))) / (1 + zz / audit_n)), 6)::DOUBLE AS hi FROM p""",
    "reading_order": f"{WITH} SELECT sys, page_id, blk, row_number() OVER (PARTITION BY sys, page_id ORDER BY (x1 >= 1200)::INT, y1, x1, blk) AS place FROM regions",
    "band_transitions": f"""{WITH}, x AS (SELECT sys, page_id, (x1 >= 1200)::INT AS band, lag((x1 >= 1200)::INT) OVER (PARTITION BY sys, page_id ORDER BY blk) AS before FROM regions)
SELECT sys, page_id, count(*) FILTER (band <> before) AS transitions, count(DISTINCT band) AS bands FROM x GROUP BY ALL""",
    "majority_class": f"{WITH}, {_MAJOR} SELECT page_id, blk, cls, votes FROM majority",
    "class_confusion": f"{WITH}, {_MAJOR} SELECT r.sys, m.cls AS consensus, r.cls, count(*) AS n FROM regions r JOIN majority m USING (page_id, blk) GROUP BY ALL",
    "stratified_sample": """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS b FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS a FROM documents) WHERE a <= 2) WHERE b <= 5""",
    "char_ngrams": "SELECT gram, count(*) AS n FROM (SELECT substr(t, i, 5) AS gram FROM (SELECT t, unnest(range(1, length(t) - 3)) AS i FROM (SELECT ' ' || text || ' ' AS t FROM benchmark))) GROUP BY gram HAVING count(*) >= 2",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "order_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "script_profile": "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents",
}
