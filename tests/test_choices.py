"""Stream comparison, quotas and defects against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import mutations, sampling, streams


def test_inversions():
    r = random.Random(1)
    for _ in range(80):
        v = [r.randrange(30) for _ in range(r.randrange(40))]
        assert streams.inversions(np.array(v)) == sum(v[i] > v[j] for i in range(len(v)) for j in range(i + 1, len(v)))


def test_compare_counts_pairs(spark):
    r = random.Random(2)
    lines, pred, ref = [], [], []
    for page in range(12):
        n = r.randrange(0, 14)
        one, two = r.sample(range(n), n), r.sample(range(n), n)
        for k in range(n):
            lines.append((page, k, r.choice([None, 0, 1]), r.choice([None, 3]), r.choice([None, 5])))
            if r.random() < 0.9:
                pred.append((0, page, k, r.randrange(3), one[k], "TEXT"))
            if r.random() < 0.9:
                ref.append((page, k, r.randrange(3), two[k], r.choice(["TEXT", "TABLE"]), True))
    df = lambda rows, cols: spark.createDataFrame(rows, cols)
    x = streams.compared(df(lines, "page_id int, line_id int, band int, grid int, graphic int"), df(pred, "sys int, page_id int, line_id int, block int, place int, bucket string"), df(ref, "page_id int, line_id int, block int, place int, bucket string, evidenced boolean"))
    got = {y["page_id"]: y for y in streams.compare(x).collect()}
    p, q = {(a[1], a[2]): a for a in pred}, {(a[0], a[1]): a for a in ref}
    assert set(got) == {a[0] for a in lines}
    for page, y in got.items():
        here = [a for a in lines if a[0] == page and (page, a[1]) in p and (page, a[1]) in q]
        assert y["n_compared"] == len(here)
        if len(here) < 2:
            assert y["order_tau"] is None and y["bucket_confusion"] == {}
            continue
        grouped = both = off = sign = 0
        regions = set()
        for i, a in enumerate(here):
            for b in here[i + 1 :]:
                u, v, s, t = p[page, a[1]], p[page, b[1]], q[page, a[1]], q[page, b[1]]
                same = u[3] == v[3]
                grouped, both = grouped + same, both + (same and s[2] == t[2])
                sign += 1 if (u[4] - v[4]) * (s[3] - t[3]) > 0 else -1
                if same and ((a[2] is not None and b[2] is not None and a[2] != b[2]) or a[3] != b[3] or a[4] != b[4]):
                    off += 1
                    regions.add(u[3])
        pairs = len(here) * (len(here) - 1) / 2
        assert y["order_tau"] == pytest.approx(sign / pairs, abs=1e-4)
        assert y["cross_merge_rate"] == pytest.approx(off / grouped if grouped else 0, abs=1e-4) and y["cross_merge_regions"] == sorted(regions)
        assert y["grouping_precision"] == (None if not grouped else pytest.approx(both / grouped, abs=1e-4))


def test_quotas(spark):
    r = random.Random(3)
    pages = [(k, f"d{r.randrange(9)}", r.choice(["three_column", "figure_heavy", "other"]), r.randrange(5), r.randrange(4)) for k in range(150)]
    quotas = {"figure_heavy": 5, "three_column": 2, "graphics_dense": 3}
    key = lambda p: (-p[3], -p[4], p[0])
    chosen = []
    for name, q in quotas.items():
        of = sorted((p for p in pages if p[2] == name), key=key)
        had, picked = {}, []
        for p in of:
            if had.get(p[1], 0) < max(1, q // 2) and len(picked) < q:
                picked.append(p)
                had[p[1]] = had.get(p[1], 0) + 1
        picked += [p for p in of if p not in picked][: q - len(picked)]
        chosen += picked
    for doc in sorted({p[1] for p in pages}):
        need = 2 - sum(p[1] == doc for p in chosen)
        if need > 0:
            chosen += sorted((p for p in pages if p[1] == doc and p not in chosen), key=key)[:need]
    df = spark.createDataFrame(pages, "page_id long, doc string, stratum string, text_blocks int, char_count int")
    assert {x["page_id"] for x in sampling.pick_stratified(df, quotas).collect()} == {p[0] for p in chosen}
    assert {x["page_id"] for x in sampling.pick_stratified(df, quotas, cap=9).collect()} == {p[0] for p in chosen[:9]}


def test_merged_stacks(spark):
    r = random.Random(4)
    rows = []
    for page in range(15):
        for blk in range(r.randrange(9)):
            x, y = r.randrange(200), r.randrange(300)
            rows.append((0, page, blk, x, y, x + r.randrange(1, 120), y + r.randrange(1, 60), r.choice(["text", "table"]), blk))
    df = spark.createDataFrame(rows, "sys long, page_id long, blk long, x1 long, y1 long, x2 long, y2 long, cls string, rank long")
    got = sorted(tuple(x) for x in mutations.mutated(df, "merge_vertical", 0.5).collect())
    hit = lambda a: int(hashlib.md5(f"0/merge_vertical/0.5|{a[0]}|{a[1]}|{a[2]}".encode()).hexdigest()[:8], 16) / 2**32 < 0.5
    want = []
    for page in range(15):
        order = sorted((a for a in rows if a[1] == page), key=lambda a: (a[4], a[2]))
        used = set()
        for a, b in zip(order, order[1:]):
            if a[2] in used or not hit(a) or min(a[5], b[5]) - max(a[3], b[3]) < 0.5 * min(a[5] - a[3], b[5] - b[3]):
                continue
            want.append((*a[:3], min(a[3], b[3]), min(a[4], b[4]), max(a[5], b[5]), max(a[6], b[6]), a[7], a[8]))
            used |= {a[2], b[2]}
        want += [a for a in order if a[2] not in used]
    assert got == sorted(want) and len(got) < len(rows)


def test_slots_are_kept(spark):
    slots = spark.createDataFrame([("b", 0), ("gone", 1)], "name string, slot int")
    names = spark.createDataFrame([("c", 0), ("b", 1), ("a", 2), ("c", 3)], "name string, at int")
    assert {x["name"]: x["slot"] for x in sampling.kept_slots(slots, names).collect()} == {"b": 0, "gone": 1, "c": 2, "a": 3}


def test_thinned(spark):
    for n in (0, 1, 59, 60, 61, 200):
        got = spark.range(1).select(sampling.thinned(F.array(*[F.lit(k) for k in range(n)]) if n else F.array().cast("array<int>")).alias("p")).first()["p"]
        assert got == (list(range(n)) if n <= 60 else [int(np.floor(v)) for v in np.linspace(0, n - 1, 60)])
