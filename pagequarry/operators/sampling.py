"""Choice of pages for a benchmark: strata from page facts, quotas with spread over documents; names of classes by table;
positions that never change once given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pages wanted of each stratum, in the order they are listed (fixed values).
QUOTAS = {
    "dense_table_portrait": 4, "dense_table_landscape": 3, "three_column": 2, "two_column_portrait": 4, "two_column_landscape": 3, "figure_heavy": 3, "sparse_title_page": 2, "graphics_dense": 2, "single_column_portrait": 3, "single_column_landscape": 2,
}


def stratum() -> Column:
    """Kind of a page from width_pt, height_pt, table_likely, vlines, est_columns, n_images, image_area_frac, char_count and
    n_drawings; the first that holds."""
    turned = F.when(F.col("width_pt") > F.col("height_pt"), "_landscape").otherwise("_portrait")
    return (
        F.when(F.col("table_likely") & (F.col("vlines") >= 8), F.concat(F.lit("dense_table"), turned)).when(F.col("est_columns") >= 3, "three_column").when(F.col("est_columns") == 2, F.concat(F.lit("two_column"), turned))
        .when((F.col("n_images") >= 3) | (F.col("image_area_frac") > 0.05), "figure_heavy").when(F.col("char_count") < 700, "sparse_title_page").when(F.col("n_drawings") > 60, "graphics_dense").otherwise(F.concat(F.lit("single_column"), turned))
    )


def pick_stratified(pages: DataFrame, quotas: dict[str, int] = QUOTAS, per_doc: int = 2, cap: int | None = None) -> DataFrame:
    """(page_id, doc, stratum, phase, n) of ``pages`` (page_id, doc, stratum, text_blocks, char_count): each stratum's quota, at
    most half of it from one document while others have pages, then pages of documents seen fewer than ``per_doc`` times,
    then no more than ``cap``. Longest first; ties by page_id.

    The rank limits are literals, so each task passes on a handful of rows a key; what is chosen by quota has a bound, the
    sum of the quotas, and is broadcast.
    """
    order = [F.desc("text_blocks"), F.desc("char_count"), "page_id"]
    quota = F.create_map(*[F.lit(v) for pair in quotas.items() for v in pair])
    rank = F.create_map(*[F.lit(v) for k, name in enumerate(quotas) for v in (name, k)])
    most = max(quotas.values(), default=0)
    x = pages.where(F.col("stratum").isin(list(quotas))).withColumn("q", F.element_at(quota, F.col("stratum")))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("stratum", "doc").orderBy(*order))).where(F.col("k") <= most).withColumn("late", F.col("k") > F.greatest(F.lit(1), F.floor(F.col("q") / 2)))
    first = x.withColumn("n", F.row_number().over(Window.partitionBy("stratum").orderBy("late", *order))).where((F.col("n") <= most) & (F.col("n") <= F.col("q")))
    first = first.select("page_id", "doc", "stratum", F.lit(0).alias("phase"), F.element_at(rank, F.col("stratum")).alias("part"), "n")
    chosen = F.broadcast(first.select("page_id"))
    seen = F.broadcast(first.groupBy("doc").agg(F.count(F.lit(1)).alias("had")))
    rest = pages.join(chosen, "page_id", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).where(F.col("n") <= per_doc)
    rest = rest.join(seen, "doc", "left").where(F.col("n") <= per_doc - F.coalesce("had", F.lit(0))).select("page_id", "doc", "stratum", F.lit(1).alias("phase"), F.lit(0).alias("part"), "n")
    every = first.unionByName(rest)
    every = every.orderBy("phase", "part", F.when(F.col("phase") == 1, F.col("doc")), "n").limit(cap) if cap else every
    return every.select("page_id", "doc", "stratum", "phase", "n")


def name_key(name: Column) -> Column:
    return F.translate(F.lower(name), "- ", "__")


def map_classes(found: DataFrame, table: DataFrame) -> DataFrame:
    """``found`` (taxonomy, source_class, ...) with (cls, confidence): by ``table`` (taxonomy, source_class, cls, confidence, at),
    else by the name in lower case with blanks and hyphens as underscores, of equal ones the last by ``at``, else unmapped.

    ``table`` has one row a known class name and is broadcast.
    """
    exact = table.select("taxonomy", "source_class", F.struct("cls", "confidence").alias("__e"))
    loose = table.groupBy("taxonomy", name_key(F.col("source_class")).alias("__k")).agg(F.max_by(F.struct("cls", "confidence"), "at").alias("__l"))
    x = found.join(F.broadcast(exact), ["taxonomy", "source_class"], "left").withColumn("__k", name_key(F.col("source_class"))).join(F.broadcast(loose), ["taxonomy", "__k"], "left")
    hit = F.coalesce("__e", "__l", F.struct(F.lit("other").alias("cls"), F.lit("unmapped").alias("confidence")))
    return x.withColumn("__h", hit).select(*found.columns, F.col("__h.cls").alias("cls"), F.col("__h.confidence").alias("confidence"))


def kept_slots(slots: DataFrame, names: DataFrame) -> DataFrame:
    """``slots`` (name, slot) with new ``names`` (name, at) behind, in their order; no slot is ever given up. A few registered
    systems."""
    last = slots.agg(F.coalesce(F.max("slot") + 1, F.lit(0)).alias("next"))
    new = names.join(slots, "name", "left_anti").groupBy("name").agg(F.min("at").alias("at")).join(F.broadcast(last))
    return slots.select("name", "slot").unionByName(new.select("name", (F.col("next") + F.row_number().over(Window.orderBy("at", "name")) - 1).cast("int").alias("slot")))


def thinned(polygon: Column, most: int = 60) -> Column:
    """At most ``most`` points of an outline, evenly spread, the first and the last among them."""
    n = F.size(polygon)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(polygon, F.floor(i * (n - 1) / (most - 1)).cast("int")))
    return F.when(n > most, picked).otherwise(polygon)
