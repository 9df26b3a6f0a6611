"""Defects put into regions on purpose, to see which checks notice them.

A defect is a plan over regions (sys, page_id, blk, x1 .. y2, cls, rank); what it strikes is decided by a digest of the
region's own key and a seed, so a run repeats exactly wherever its rows lie. Only defects that need a page's regions beside
each other shuffle, by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.geometry import Box, area

PAGE = ["sys", "page_id"]


def chance(seed: str, *key: str) -> Column:
    """A share from 0 to 1 that depends on the key alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32


def struck(seed: str, share: float) -> Column:
    return chance(seed, *PAGE, "blk") < share


def drop_region(r: DataFrame, share: float, seed: str) -> DataFrame:
    """A detector misses blocks."""
    return r.where(~struck(seed, share))


def drop_largest(r: DataFrame, n: float, seed: str) -> DataFrame:
    """The ``n`` largest of a page are missed; ties by number."""
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc(area(Box())), "blk"))
    return r.withColumn("__n", place).where(F.col("__n") > n).drop("__n")


def split_region(r: DataFrame, share: float, seed: str) -> DataFrame:
    """A block of more than 40 pixels comes as an upper and a lower half."""
    middle = (F.col("y1") + F.col("y2")) / 2
    part = F.when(struck(seed, share) & (F.col("y2") - F.col("y1") > 40), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    x = r.withColumn("__p", F.explode(part)).withColumn("__m", middle)
    return x.withColumn("y1", F.when(F.col("__p") == 2, F.col("__m")).otherwise(F.col("y1"))).withColumn("y2", F.when(F.col("__p") == 1, F.col("__m")).otherwise(F.col("y2"))).drop("__p", "__m")


def resized(r: DataFrame, share: float) -> DataFrame:
    dx, dy = (F.col("x2") - F.col("x1")) * share / 2, (F.col("y2") - F.col("y1")) * share / 2
    return r.select(*[c for c in r.columns if c not in ("x1", "y1", "x2", "y2")], (F.col("x1") - dx).alias("x1"), (F.col("y1") - dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))


def shrink(r: DataFrame, share: float, seed: str) -> DataFrame:
    return resized(r, -share)


def grow(r: DataFrame, share: float, seed: str) -> DataFrame:
    return resized(r, share)


def duplicate(r: DataFrame, share: float, seed: str) -> DataFrame:
    """The same block twice."""
    return r.withColumn("__p", F.explode(F.when(struck(seed, share), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__p")


def to_class(name: str) -> Callable[[DataFrame, float, str], DataFrame]:
    return lambda r, share, seed: r.withColumn("cls", F.when(struck(seed, share), F.lit(name)).otherwise(F.col("cls")))


def shuffle_order(r: DataFrame, share: float, seed: str) -> DataFrame:
    """A page's order of blocks is another one."""
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(chance(seed, *PAGE, "blk"), "blk")).cast("long"))


def shift(r: DataFrame, share: float, seed: str) -> DataFrame:
    """Every box is off by a share of 2000 pixels: a mistake of coordinates."""
    for c in ("x1", "y1", "x2", "y2"):
        r = r.withColumn(c, F.col(c) + share * 2000)
    return r


def united(r: DataFrame, into: Column) -> DataFrame:
    """Regions whose ``into`` is the same number become one box, with what else the first of them has."""
    rest = [c for c in r.columns if c not in (*PAGE, "x1", "y1", "x2", "y2")]
    x = r.withColumn("__into", into).groupBy(*PAGE, "__into").agg(*[f(c).alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))], F.min_by(F.struct(*rest), F.struct((F.col("blk") != F.col("__into")).cast("int"), F.col("blk"))).alias("__r"))
    return x.select(*PAGE, "x1", "y1", "x2", "y2", "__r.*").select(*r.columns)


def merge_vertical(r: DataFrame, share: float, seed: str) -> DataFrame:
    """Stacked regions become one: down a page, a region takes in the next if they share half of the narrower's width, and
    neither is taken yet."""
    page = Window.partitionBy(*PAGE).orderBy("y1", "blk")
    entry = F.struct("blk", "x1", "x2", struck(seed, share).alias("hit"))
    order = F.array_sort(F.collect_list(F.struct("y1", "blk", entry.alias("r"))))
    kind = "struct<used: boolean, last: bigint, x1: double, x2: double, hit: boolean, into: map<bigint, bigint>>"
    start = F.struct(F.lit(True).alias("used"), F.lit(None).cast("bigint").alias("last"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("x2"), F.lit(False).alias("hit"), F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>")).alias("into")).cast(kind)

    def step(done: Column, e: Column) -> Column:
        q = e["r"]
        shared = F.least(done["x2"], q["x2"]) - F.greatest(done["x1"], q["x1"])
        take = ~done["used"] & done["hit"] & (shared >= 0.5 * F.least(done["x2"] - done["x1"], q["x2"] - q["x1"]))
        into = F.when(take, F.map_concat(done["into"], F.map_from_arrays(F.array(q["blk"]), F.array(done["last"])))).otherwise(done["into"])
        return F.struct(take.alias("used"), q["blk"].alias("last"), q["x1"].cast("double").alias("x1"), q["x2"].cast("double").alias("x2"), q["hit"].alias("hit"), into.alias("into")).cast(kind)

    page = r.groupBy(*PAGE).agg(F.aggregate(order, start, step)["into"].alias("__m"))
    x = r.join(page, PAGE)
    return united(x.withColumn("__to", F.coalesce(F.element_at("__m", F.col("blk").cast("long")), F.col("blk").cast("long"))).drop("__m"), F.col("__to")).drop("__to")


#: Defects by name, with how strongly each is tried (fixed values).
MUTATIONS: dict[str, tuple[Callable[[DataFrame, float, str], DataFrame], tuple[float, ...]]] = {
    "drop_region": (drop_region, (0.10, 0.25, 0.50, 1.00)),
    "drop_largest": (drop_largest, (1, 2, 3)),
    "merge_vertical": (merge_vertical, (0.50, 1.00)),
    "split_region": (split_region, (0.50, 1.00)),
    "shrink": (shrink, (0.10, 0.25, 0.40)),
    "grow": (grow, (0.15, 0.35)),
    "duplicate": (duplicate, (0.30, 1.00)),
    "class_to_figure": (to_class("figure"), (0.30, 1.00)),
    "class_to_header": (to_class("header"), (0.30, 1.00)),
    "class_to_table": (to_class("table"), (0.30, 1.00)),
    "shuffle_order": (shuffle_order, (1.00,)),
    "shift": (shift, (0.02, 0.05)),
}


def seed_of(name: str, strength: float, seed: str = "0") -> str:
    return f"{seed}/{name}/{strength:g}"


def mutated(regions: DataFrame, name: str, strength: float, seed: str = "0") -> DataFrame:
    """Regions with one defect. Two regions of a page may share their number after it."""
    return MUTATIONS[name][0](regions, strength, seed_of(name, strength, seed))


def sensitivity(looked: DataFrame, blind: float = 0.05) -> DataFrame:
    """(mutation, strength, n_pages, rate, baseline, lift, blind) from ``looked`` (mutation, strength, n_pages, n_caught), a
    row for each defect and strength; that of ``mutation`` 'none' is the baseline. A defect that lifts the rate by less than
    ``blind`` goes unseen."""
    rate = looked.withColumn("rate", F.col("n_caught") / F.col("n_pages"))
    base = F.broadcast(rate.where("mutation = 'none'").select(F.col("rate").alias("baseline")))  # one row
    x = rate.where("mutation <> 'none'").join(base)
    lift = F.round(F.col("rate") - F.col("baseline"), 4)
    return x.select("mutation", "strength", "n_pages", F.round("rate", 4).alias("rate"), F.round("baseline", 4).alias("baseline"), lift.alias("lift"), (lift < blind).alias("blind"))
