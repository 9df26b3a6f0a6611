"""Variants of a page's regions in its own row, against the plans and the single pages that they stand for."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagequarry.functions.geometry import BUCKETS
from pagequarry.operators import checks, gate, mutations, spatial, variants
from pagequarry.plans import choices, layout, queries

KIND = {c: checks.BUCKET_NUMBERS[b] for c, b in BUCKETS.items()}


def boxes(r, n, span=300):
    out = np.array([(x := r.randrange(span), y := r.randrange(span), x + r.randrange(1, 150), y + r.randrange(1, 80)) for _ in range(n)], dtype=float)
    return out.reshape(n, 4).T


def test_variants_are_those_of_the_plans(spark):
    r = random.Random(7)
    rows = [(0, p, b, *map(int, box), r.choice(["text", "table", "figure", "header"]), b) for p in range(12) for b, box in enumerate(boxes(r, r.randrange(1, 9)).T)]
    df = spark.createDataFrame(rows, "sys long, page_id long, blk long, x1 long, y1 long, x2 long, y2 long, cls string, rank long")
    every = [choices.as_floats(mutations.mutated(df, n, s)).withColumn("v", F.lit(k)) for k, (n, s) in enumerate(variants.EVERY) if k]
    union = every[0]
    for x in every[1:]:
        union = union.unionByName(x)
    want = {}
    for x in union.collect():
        want.setdefault((x["v"], x["page_id"]), []).append((x["blk"], *(x[c] for c in spatial.SIDES), KIND.get(x["cls"], checks.TEXT), x["rank"]))
    drawn = df.select("page_id", "blk", *[mutations.chance(mutations.seed_of(n, s), *mutations.PAGE, "blk").alias(f"d{k}") for k, (n, s) in enumerate(variants.DRAWN)])
    draw = {(x["page_id"], x["blk"]): x for x in drawn.collect()}
    of = [[a for a in rows if a[1] == p] for p in range(12)]
    names = list(variants.NAMED)
    v, valid = variants.padded([np.array([(a[2], a[8], *a[3:7], KIND.get(a[7], checks.TEXT), names.index(a[7]) if a[7] in names else -1, *draw[a[1], a[2]][2:]) for a in page], dtype=float).T for page in of])
    base = variants.Regions(v[:, 2:6], valid, v[:, 6], v[:, 7], v[:, 1], v[:, 0])
    for k, (name, strength) in enumerate(variants.EVERY[1:], 1):
        got, changed = variants.variant(base, name, strength, v[:, 8 + variants.DRAWN.index((name, strength))] if (name, strength) in variants.DRAWN else None)
        for p in range(12):
            mine = [(got.blk[p, i], *got.box[p, :, i], got.kind[p, i], got.rank[p, i]) for i in np.flatnonzero(got.valid[p])]
            assert sorted(mine) == sorted(want.get((k, p), [])), (name, strength, p)
            plain = [(a[2], *a[3:7], KIND.get(a[7], checks.TEXT), a[8]) for a in of[p]]
            assert changed[p] == (sorted(mine) != sorted(plain)), (name, strength, p)


def test_counts_are_those_of_single_pages():
    r = random.Random(8)
    index = [checks.OF_SYSTEM.index(c) for c in variants.COUNTED]
    for case in range(40):
        pages, own = [], []
        for _ in range(r.randrange(1, 7)):
            n, m = r.choice([0, 1, 6, 30]), r.choice([0, 1, 4, 12])
            bands = np.array(r.choice([[], [(0, 200)], [(0, 140), (150, 400)], [(0, 120), (130, 250), (260, 450)]]), dtype=float).reshape(-1, 2).T
            pages.append(checks.Page(boxes(r, n), bands, np.empty((2, 0)), boxes(r, r.randrange(3)), boxes(r, r.randrange(3)), 450, 380, checks.THRESHOLDS | {"unit_lines": 2}))
            box = boxes(r, m)
            if m > 4:
                box[:, 3] = box[:, 1] + r.choice([0, 2])
            own.append((box, np.sort(np.array([float(r.randrange(20)) for _ in range(m)])), np.array([float(r.randrange(4)) for _ in range(m)]), np.array([r.randrange(2 if case % 2 else 4) for _ in range(m)]) if case % 5 else np.ones(m, dtype=int)))
        v, valid = variants.padded([np.vstack([o[0], *o[1:]]) for o in own])
        got = variants.Pages(pages).counts(variants.Regions(v[:, :4], valid, v[:, 6], v[:, 6], v[:, 5], v[:, 4]))
        for i, (page, (box, blk, rank, kind)) in enumerate(zip(pages, own)):
            want = page.counts(box, blk, rank, kind, np.array(["c"] * len(blk), dtype=object))
            assert [float(got[c][i]) for c in variants.COUNTED] == [float(want[k]) for k in index], (case, i)


def test_bands_and_corridors_of_a_row(spark):
    r = random.Random(9)
    rows = []
    for p in range(60):
        line = [(k, x := r.choice([0, 5, 105, 205]), y := 20 * r.randrange(9), x + r.randrange(40, 95), y + r.randrange(0, 22)) for k in range(r.randrange(14))]
        rows.append((p, r.sample([(0, 100), (100, 200), (200, 300)], r.randrange(4)), [(95, 105), (195, 205)][: r.randrange(3)], [tuple(map(int, a)) for a in line]))
    df = spark.createDataFrame(rows, "p int, bands array<struct<x0: long, x9: long>>, gs array<struct<x0: long, x9: long>>, ls array<struct<line_id: long, x1: long, y1: long, x2: long, y2: long>>")
    df = df.withColumn("bands", F.transform("bands", lambda b: F.struct(F.lit(0).alias("band_id"), b["x0"].alias("x0"), b["x9"].alias("x9"))))
    for x in df.select("p", spatial.merged_bands(F.col("bands"), F.col("ls")).alias("b"), checks.open_corridors(F.col("gs"), F.col("ls")).alias("g")).collect():
        _, bands, gs, line = rows[x["p"]]
        flat = lambda v, n: np.array(v, dtype=float).reshape(-1, n).T
        at = flat([a[1:] for a in line], 4)
        meet = checks.rows_meet(at)
        assert checks.running_bands(flat(bands, 2), at, meet).T.tolist() == [[b["x0"], b["x9"]] for b in x["b"]]
        assert checks.apart(flat(gs, 2), at, meet).T.tolist() == [[g["x0"], g["x9"]] for g in x["g"]]


def test_escalated_is_what_the_gate_decides(spark):
    d = "/root/testdata/sf0.001"
    facts = queries.page_features(spark, d, queries.disturbed(spark, d)).withColumn("page_side", F.lit(float(queries.SIDE))).localCheckpoint()
    caught = gate.escalated(checks.firing(strongest=True), {k: F.expr(checks.availability(k)[1]) for k in checks.gate_checks()})
    ours = {(x["sys"], x["page_id"]): x["caught"] for x in facts.select("sys", "page_id", caught.alias("caught")).collect()}
    theirs = {(x["sys"], x["page_id"]): x["decision"] == "escalate" for x in gate.decide(checks.judged(facts, queries.SIDE)).collect()}
    assert ours == theirs and 0 < sum(ours.values()) < len(ours)


def test_variants_are_never_rows(spark):
    """However many defects, the pages are shuffled once: their regions are not put together again for each."""
    d = "/root/testdata/sf0.001"
    facts = variants.facts(layout.page_facts(spark, d), layout.lines(spark, d), choices.whole(spark, d).where("sys = 0"), layout.bands(spark, d), layout.areas(spark, d), layout.gutters(spark, d), layout.PAGE_WIDTH, layout.PAGE_HEIGHT)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Window" not in plan and plan.count("MapInPandas") == 1
    got = facts.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {x["variant"] for x in got} == set(range(len(variants.EVERY)))
