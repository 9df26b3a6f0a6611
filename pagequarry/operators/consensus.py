"""Consensus of detectors: clusters of regions on a page, and what they say of each system and class.

A page's regions become one row of arrays, so the ordered clustering sees whole pages, many in one Arrow batch. All that
follows is keyed by the page, whose partitioning is kept: one shuffle serves clustering and the counts over it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COORDINATES = ["x1", "y1", "x2", "y2"]
#: Least overlap with a member of a cluster; least families behind a region that counts as backed (fixed values).
NEAR, BACKING = 0.55, 3
#: Verdicts on a class (fixed values): least consensus regions, ceiling, room below the leader, least share of pages won, room within a page.
ROUTES = {"regions": 8, "ceiling": 0.97, "room": 0.02, "won": 0.5, "page_room": 0.01}


def overlap(i: int, others: np.ndarray, box: np.ndarray) -> np.ndarray:
    """IoU of box ``i`` with the boxes ``others``; ``box`` has rows x1, y1, x2, y2."""
    w = np.minimum(box[2, others], box[2, i]) - np.maximum(box[0, others], box[0, i])
    h = np.minimum(box[3, others], box[3, i]) - np.maximum(box[1, others], box[1, i])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    size = (box[2] - box[0]) * (box[3] - box[1])
    union = size[others] + size[i] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0)


def first_fit(box: np.ndarray, near: float) -> list[int]:
    """Cluster of each box in order: the first cluster with a member near enough, else a new one."""
    of = np.zeros(box.shape[1], dtype=np.int64)
    made = 0
    for i in range(box.shape[1]):
        met = of[:i][overlap(i, np.arange(i), box) >= near]
        of[i] = met.min() if met.size else made
        made += not met.size
    return of.tolist()


def merged(box: np.ndarray, gap: float) -> list[list[float]]:
    """Boxes united while any two come within ``gap``, until none do; the set does not depend on the order."""
    todo, done = [tuple(b) for b in box.T.tolist()], []
    while todo:
        a = todo.pop()
        grown = True
        while grown:
            near = [b for b in todo + done if a[0] - gap < b[2] and b[0] - gap < a[2] and a[1] - gap < b[3] and b[1] - gap < a[3]]
            grown = bool(near)
            if grown:
                a = (*(min(v) for v in zip(*[b[:2] for b in [a, *near]])), *(max(v) for v in zip(*[b[2:] for b in [a, *near]])))
                for b in near:
                    (todo if b in todo else done).remove(b)
        done.append(a)
    return sorted(list(b) for b in done)


def page_udf(work, kind: str):
    """A Column function over four arrays of coordinates: ``work`` sees one page at a time."""

    @F.pandas_udf(kind)
    def over_pages(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        return pd.Series([work(np.array([np.asarray(v, dtype=float) for v in page])) for page in zip(x1, y1, x2, y2)])

    return over_pages


def arrays(rows: Column) -> list[Column]:
    return [rows[c].cast("array<double>") for c in COORDINATES]


def clusters(regions: DataFrame, keys: list[str], near: float = NEAR) -> DataFrame:
    """``regions`` (keys, sys, blk, box, cls) with ``pos``, the place in the order of systems and regions, and ``cluster``."""
    entry = F.struct("sys", "blk", *COORDINATES, *[c for c in ("cls", "family") if c in regions.columns and c not in keys])
    page = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("r"))
    page = page.withColumn("of", page_udf(lambda box: first_fit(box, near), "array<long>")(*arrays(F.col("r"))))
    return page.select(*keys, F.posexplode(F.arrays_zip("r", "of")).alias("pos", "e")).select(*keys, "pos", "e.r.*", F.col("e.of").alias("cluster"))


def merge_boxes(boxes: DataFrame, keys: list[str], gap: float = 6.0) -> DataFrame:
    """(keys, box, x1, y1, x2, y2): boxes of a key united to a fixpoint; ``box`` numbers them by coordinates."""
    page = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*COORDINATES)).alias("r"))
    page = page.withColumn("m", page_udf(lambda box: merged(box, gap), "array<array<double>>")(*arrays(F.col("r"))))
    return page.select(*keys, F.posexplode("m").alias("box", "b")).select(*keys, "box", *[F.col("b")[k].alias(c) for k, c in enumerate(COORDINATES)])


def page_consensus(regions: DataFrame, families: DataFrame, backing: int = BACKING) -> DataFrame:
    """(sys, page_id, found, total, agree, backed, solo, n) for each system with regions on a page.

    A cluster is consensus where half the families, two at the least, see it. Its class is the one most of its regions
    have; of equal counts, the first in order. ``families`` (sys, family) is one row a registered detector.
    """
    needed = max(2, families.select("family").distinct().count() // 2)
    m = clusters(regions.join(F.broadcast(families), "sys"), ["page_id"])
    mine = m.groupBy("page_id", "cluster", "sys", "family").agg(F.count(F.lit(1)).alias("k"), F.min_by("cls", "pos").alias("own"))
    votes = m.groupBy("page_id", "cluster", "cls").agg(F.count(F.lit(1)).alias("n"), (-F.min("pos")).alias("first"))
    chosen = votes.groupBy("page_id", "cluster").agg(F.max_by("cls", F.struct("n", "first")).alias("chosen"))
    seen = mine.groupBy("page_id", "cluster").agg(F.countDistinct("family").alias("n_fam"))
    facts = chosen.join(seen, ["page_id", "cluster"])
    total = facts.groupBy("page_id").agg(F.count_if(F.col("n_fam") >= needed).alias("total"))
    x = mine.join(facts, ["page_id", "cluster"])
    is_ = F.col("n_fam") >= needed
    counted = x.groupBy("page_id", "sys").agg(
        F.count_if(is_).alias("found"), F.count_if(is_ & (F.col("own") == F.col("chosen"))).alias("agree"), F.sum(F.when(F.col("n_fam") >= backing, F.col("k")).otherwise(0)).alias("backed"),
        F.sum(F.when(F.col("n_fam") == 1, F.col("k")).otherwise(0)).alias("solo"), F.sum("k").alias("n"),
    )
    return counted.join(total, "page_id").select("sys", "page_id", "found", "total", "agree", "backed", "solo", "n")


def ratio(a: str, b: str, places: int = 4) -> Column:
    return F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), places)


def system_consensus(per_page: DataFrame) -> DataFrame:
    """(sys, recall, class_agreement, precision, solo_rate, n): shares of sums over all pages."""
    s = per_page.groupBy("sys").agg(*[F.sum(c).alias(c) for c in ("found", "total", "agree", "backed", "solo", "n")])
    return s.select("sys", ratio("found", "total").alias("recall"), ratio("agree", "found").alias("class_agreement"), ratio("backed", "n").alias("precision"), ratio("solo", "n").alias("solo_rate"), "n")


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def class_scores(regions: DataFrame, families: DataFrame, backing: int = BACKING) -> DataFrame:
    """(cls, sys, regions, pages, found, unbacked, wins, recall, precision, f1) for each class that has consensus regions.

    Regions of one class are clustered by themselves. A system that shows no region of the class on a page wins nothing
    there.
    """
    m = clusters(regions.join(F.broadcast(families), "sys"), ["page_id", "cls"])
    each = m.groupBy("page_id", "cls", "cluster").agg(F.countDistinct("family").alias("n_fam"))
    mine = m.groupBy("page_id", "cls", "cluster", "sys").agg(F.count(F.lit(1)).alias("k")).join(each, ["page_id", "cls", "cluster"])
    total = each.groupBy("page_id", "cls").agg(F.count_if(F.col("n_fam") >= backing).alias("total")).where("total > 0")
    page = mine.groupBy("page_id", "cls", "sys").agg(F.count_if(F.col("n_fam") >= backing).alias("found"), F.sum("k").alias("mine")).join(total, ["page_id", "cls"])
    page = page.withColumn("f1", harmonic(F.col("found") / F.col("mine"), F.col("found") / F.col("total")))
    top = F.max("f1").over(Window.partitionBy("page_id", "cls"))
    page = page.withColumn("won", (top > 0) & (F.col("f1") >= top - ROUTES["page_room"]))
    sums = page.groupBy("cls", "sys").agg(F.sum("found").alias("found"), F.sum(F.greatest(F.col("mine") - F.col("found"), F.lit(0))).alias("unbacked"), F.count_if("won").alias("wins"))
    classes = total.groupBy("cls").agg(F.sum("total").alias("regions"), F.count(F.lit(1)).alias("pages"))
    x = classes.join(F.broadcast(families.select("sys"))).join(sums, ["cls", "sys"], "left").fillna(0, ["found", "unbacked", "wins"])
    r, p = F.col("found") / F.col("regions"), F.coalesce(F.col("found") / F.nullif(F.col("found") + F.col("unbacked"), F.lit(0)), F.lit(0.0))
    return x.select("cls", "sys", "regions", "pages", "found", "unbacked", "wins", F.round(r, 4).alias("recall"), F.round(p, 4).alias("precision"), F.round(harmonic(p, r), 4).alias("f1"))


def class_routes(scores: DataFrame) -> DataFrame:
    """(cls, decision, leader, f1, margin, win_rate, n_equal): which system to send a class to, and whether one can be told."""
    w = Window.partitionBy("cls").orderBy(F.desc("f1"), "sys")
    x = scores.withColumn("place", F.row_number().over(w)).withColumn("top", F.max("f1").over(Window.partitionBy("cls")))
    pick = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    x = x.groupBy("cls").agg(
        pick("sys", 1).alias("leader"), pick("f1", 1).alias("f1"), F.round(pick("f1", 1) - pick("f1", 2), 4).alias("margin"), F.round(pick("wins", 1) / F.max("pages"), 3).alias("win_rate"),
        F.count_if(F.col("f1") >= F.round(F.col("top") - ROUTES["room"], 6)).alias("n_equal"), F.max("regions").alias("regions"),
    )
    one = F.col("n_equal") > 1
    decision = F.when(F.col("regions") < ROUTES["regions"], "insufficient evidence").when(one & (F.col("f1") >= ROUTES["ceiling"]), "tied at ceiling").when(one, "no separable leader").when(F.col("win_rate") < ROUTES["won"], "unstable leader").otherwise("route")
    return x.select("cls", decision.alias("decision"), "leader", "f1", "margin", "win_rate", "n_equal")


def greedy_pairs(a: np.ndarray, b: np.ndarray, near: float) -> list[int]:
    """For each box of ``a`` in order, the place of the free box of ``b`` of greatest overlap, or -1 if none is near enough."""
    both = np.concatenate([a, b], axis=1)
    at, free, out = a.shape[1], np.ones(b.shape[1], dtype=bool), []
    for i in range(at):
        met = np.where(free, overlap(i, np.arange(at, both.shape[1]), both), -1) if free.any() else np.array([-1.0])
        best = int(met.argmax())
        hit = met[best] >= near
        if hit:
            free[best] = False
        out.append(best if hit else -1)
    return out


def one_to_one(pages: DataFrame, left: DataFrame, right: DataFrame, near: float = 0.7) -> DataFrame:
    """(page_id, n_left, n_right, matched, same_class, box_agreement, class_agreement) for each row of ``pages`` (page_id):
    regions of two runs matched one to one, in the order of ``left``. A page without regions in both agrees by 0."""

    @F.pandas_udf("array<int>")
    def pairs(a1: pd.Series, b1: pd.Series, a2: pd.Series, b2: pd.Series, c1: pd.Series, d1: pd.Series, c2: pd.Series, d2: pd.Series) -> pd.Series:
        stack = lambda v: np.array([np.asarray(x, dtype=float) for x in v])
        return pd.Series([greedy_pairs(stack(v[:4]), stack(v[4:]), near) for v in zip(a1, b1, a2, b2, c1, d1, c2, d2)])

    entry = F.struct("blk", *COORDINATES, "cls")
    side = lambda df, name: df.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias(name))
    x = pages.select("page_id").join(side(left, "l"), "page_id", "left").join(side(right, "r"), "page_id", "left")
    kind = side(left, "l").schema["l"].dataType.simpleString()
    x = x.select("page_id", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c in ("l", "r")])
    x = x.withColumn("m", pairs(*arrays(F.col("l")), *arrays(F.col("r"))))
    met = F.zip_with(F.col("l")["cls"], F.col("m"), lambda c, m: F.when(m >= 0, F.when(c == F.get(F.col("r")["cls"], m), 2).otherwise(1)).otherwise(0))
    x = x.select("page_id", F.size("l").alias("n_left"), F.size("r").alias("n_right"), met.alias("met"))
    x = x.select("page_id", "n_left", "n_right", F.size(F.filter("met", lambda v: v > 0)).alias("matched"), F.size(F.filter("met", lambda v: v == 2)).alias("same_class"))
    n = F.greatest("n_left", "n_right", F.lit(1))
    return x.select("*", F.round(F.col("matched") / n, 4).alias("box_agreement"), F.round(F.col("same_class") / n, 4).alias("class_agreement"))


def run_verdict(agreement: DataFrame, least: float = 0.85) -> DataFrame:
    """One row (n_pages, mean_agreement, verdict) over pages that two runs share."""
    s = agreement.agg(F.count(F.lit(1)).alias("n_pages"), F.avg("box_agreement").alias("m"))
    return s.select("n_pages", F.round("m", 4).alias("mean_agreement"), F.when(F.col("n_pages") == 0, "no_result").when(F.col("m") >= least, "ok").otherwise("MISMATCH").alias("verdict"))
