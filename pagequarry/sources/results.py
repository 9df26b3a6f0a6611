"""Detector results: one JSON object a page, in one folder a system, and the regions in them.

Schemas are stated, never inferred, so a scan reads each file once and a missing field is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.geometry import normalised

REGION = "id int, class string, source_class string, mapping_confidence string, confidence double, bbox array<double>, polygon array<array<double>>, reading_order int"
PAGE_RESULT = f"schema_version string, run_id string, system string, document string, page_id string, page int, width int, height int, n_regions int, generated_utc timestamp, regions array<struct<{REGION.replace(' ', ':').replace(',:', ',')}>>, timing map<string, double>"


def page_results(spark: SparkSession, folder: str, runs: DataFrame | None = None) -> DataFrame:
    """Page results under ``folder``/<system>/; files whose name begins with ``_`` are no pages.

    ``runs`` (system, status) keeps systems whose run ended ``ok``. Text that is no JSON gives a row of nulls, which goes.
    """
    read = spark.read.schema(PAGE_RESULT).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_]*.json").json(folder)
    read = read.where(F.col("page_id").isNotNull() & F.col("system").isNotNull())
    return read if runs is None else read.join(runs.where("status = 'ok'").select("system").distinct(), "system", "left_semi")


def regions(results: DataFrame) -> DataFrame:
    """One row a region with its stored index; boxes made regular and rounded to two places, confidence to five.

    Regions without four coordinates go.
    """
    r = results.select("system", "page_id", F.posexplode("regions").alias("region_idx", "r")).where(F.size("r.bbox") == 4)
    box = [F.get("r.bbox", F.lit(k)) for k in range(4)]
    return r.select("system", "page_id", "region_idx", F.col("r.class").alias("cls"), "r.source_class", "r.mapping_confidence", *normalised(*box), F.round("r.confidence", 5).alias("confidence"), "r.reading_order", "r.polygon")


def write_partitioned(df: DataFrame, folder: str, by: str = "system") -> None:
    """One folder for each value of ``by``; those that ``df`` has are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def or_empty(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The Parquet table at ``folder``, or an empty one of the schema where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
