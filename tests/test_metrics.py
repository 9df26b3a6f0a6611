"""Page metrics, sign tests and outlines against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import metrics


def plain_cover(line, boxes):
    seen = set()
    for a, b, c, d in boxes:
        seen |= {(x, y) for x in range(max(a, line[0]), min(c, line[2])) for y in range(max(b, line[1]), min(d, line[3]))}
    return len(seen) / ((line[2] - line[0]) * (line[3] - line[1]))


def random_box(r, most=60):
    x, y = r.randrange(most), r.randrange(most)
    return [x, y, x + r.randrange(1, 30), y + r.randrange(1, 30)]


def test_union_cover():
    r = random.Random(3)
    for _ in range(60):
        lines, boxes = [random_box(r) for _ in range(4)], [random_box(r) for _ in range(r.randrange(6))]
        got = metrics.union_cover(np.array(lines, dtype=float).T, np.array(boxes, dtype=float).reshape(-1, 4).T)
        assert got == pytest.approx([plain_cover(line, boxes) for line in lines])


def test_depth_stays_within_the_page():
    r = random.Random(4)
    for _ in range(40):
        boxes = [random_box(r, 90) for _ in range(r.randrange(1, 6))]
        b, page = np.array(boxes, dtype=float).T, (20, 18)
        edge = metrics.cells(b, page)
        xs, ys = (np.unique(np.concatenate([[0], edge[k], edge[k + 2]])) for k in (0, 1))
        found = metrics.depth(b, xs, ys, page)
        plain = np.zeros((18, 20), dtype=int)
        for x1, y1, x2, y2 in boxes:
            plain[y1 // 4 : -(-y2 // 4), x1 // 4 : -(-x2 // 4)] += 1
        size = np.outer(np.diff(ys), np.diff(xs))
        for k in (1, 2):
            assert size[found >= k].sum() == (plain >= k).sum()


def test_sign_p():
    for n in range(0, 40):
        for k in range(0, n // 2 + 1):
            want = 1.0 if n == 0 else min(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n, 1.0)
            assert metrics.sign_p(k, n) == pytest.approx(want)
    assert metrics.sign_p(49_000_000, 100_000_000) == pytest.approx(0.0)


def test_page_without_anything(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    none = lambda cols: spark.createDataFrame([], cols)
    box = "page_id long, x1 long, y1 long, x2 long, y2 long"
    lines = spark.createDataFrame([(2, 0, 0, 40, 8)], box)
    got = metrics.page_metrics(pages, lines, none(box + ", kind string"), none("page_id long, bands array<struct<band_id: int, x0: long, x9: long>>"), none("sys long, cls string, " + box), [0], 400, 400)
    rows = {r["page_id"]: r for r in got.collect()}
    assert rows[1]["n_regions"] == 0 and rows[1]["text_recall"] is None and rows[1]["overlap_ratio"] == 0 and rows[1]["has_polygons"] is False
    assert rows[2]["text_recall"] == 0 and rows[2]["line_capture"] == 0 and rows[2]["text_precision"] is None and rows[2]["total_s"] is None


def test_outlines(spark):
    shapes = {
        "box": [(0, 0), (10, 0), (10, 10), (0, 10)], "near": [(0, 0), (10.4, 0), (10, 10), (0, 10)], "diamond": [(5, 0), (10, 5), (5, 10), (0, 5)], "five": [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)],
        "two": [(0, 0), (1, 1)], "triangle": [(0, 0), (10, 0), (0, 10)], "none": None,
    }
    df = spark.createDataFrame([(k, v and [(float(x), float(y)) for x, y in v]) for k, v in shapes.items()], "name string, polygon array<struct<x: double, y: double>>")
    got = {r["name"] for r in df.where(metrics.not_a_box(F.struct("polygon"))).collect()}
    assert got == {"diamond", "five", "triangle"}


def test_quantiles(spark):
    r = random.Random(5)
    rows = [(k, None if r.random() < 0.1 else r.randrange(12) / 4) for k in "ab" for _ in range(200)]
    got = {x["k"]: x for x in metrics.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    for k in "ab":
        v = [x for n, x in rows if n == k and x is not None]
        assert got[k]["mean"] == pytest.approx(np.mean(v)) and got[k]["q"] == pytest.approx([np.percentile(v, p) for p in (10, 50, 90)])


def metric_rows(spark):
    r = random.Random(6)
    rows = [(s, p, None if r.random() < 0.2 else r.randrange(9) / 8, r.randrange(1, 2 + s % 2), r.randrange(2), r.randrange(2), r.randrange(4), r.random() < 0.5) for s in range(4) for p in range(80) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "sys long, page_id long, v double, class_diversity long, n_ref_grids long, n_ref_graphics long, n_ref_columns long, has_polygons boolean")
    return rows, df.withColumn("has_reading_order", F.col("has_polygons"))


def scans(df):
    """How often a plan reads the table that it is made of."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_separability_in_one_pass(spark):
    rows, df = metric_rows(spark)
    out = metrics.separability(df, "v")
    assert scans(out) == 1
    got = {x["sys"]: x for x in out.collect()}
    mean = {s: np.mean([x[2] for x in rows if x[0] == s and x[2] is not None]) for s in range(4)}
    single = {s: max(x[3] for x in rows if x[0] == s) <= 1 for s in range(4)}
    order = sorted(mean, key=lambda s: (-mean[s], s))
    leader = min(order, key=lambda s: (single[s], order.index(s)))
    at = {(x[0], x[1]): x[2] for x in rows if x[2] is not None}
    for s in range(4):
        d = [at[s, p] - at[leader, p] for p in range(80) if (s, p) in at and (leader, p) in at]
        up, down = sum(v > 0 for v in d), sum(v < 0 for v in d)
        assert (got[s]["place"], got[s]["leader"], got[s]["mean"]) == (order.index(s) + 1, leader, round(mean[s], 4))
        assert got[s]["p_vs_leader"] == pytest.approx(round(metrics.sign_p(min(up, down), up + down), 4))


def test_class_evidence_in_one_pass(spark):
    rows, df = metric_rows(spark)
    df = df.withColumns({c: F.col("v") for c in ("table_iou", "table_recall", "graphic_iou", "text_recall", "column_bleed_rate")})
    regions = spark.createDataFrame([(0, 1, "header"), (1, 2, "caption")], "sys long, page_id long, cls string")
    out = metrics.class_evidence(df, regions)
    assert scans(out) == 2  # metrics and regions, once each
    for x in out.collect():
        mine = [r for r in rows if r[0] == x["sys"]]
        for name, on in (("table_iou_on_table_pages", 4), ("figure_iou_on_figure_pages", 5)):
            assert x[name] == pytest.approx(np.median([r[2] for r in mine if r[on] > 0 and r[2] is not None]))
        assert x["n_table_pages"] == sum(r[4] > 0 for r in mine) and x["headerfooter_pages"] == round(any(r[:2] == (0, 1) for r in mine) / len(mine), 3)


def test_shared_inputs_are_made_once(spark):
    """Plans that draw several times from one input do not hold its plan several times."""
    from pagequarry.plans import choices, report

    plan = lambda f: f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "measured(" not in plan(report.system_ratings)
    assert "Relation" not in plan(choices.defect_sensitivity)
