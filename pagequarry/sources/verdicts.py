"""Reviewers' verdicts: an append-only log of one JSON object a line, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT = "page_id string, system string, frame string, outcome string, regions array<struct<bbox:array<double>,class:string,reading_order:int>>, reviewer string, seconds double, at timestamp"
#: What a verdict may say (fixed values).
FRAMES, OUTCOMES = ("escalation", "audit"), ("confirm", "correct", "unusable")


def problem() -> Column:
    """Why a verdict is refused; null where it is valid."""
    missing = [F.when(F.col(c).isNull(), f"missing {c}") for c in ("page_id", "system", "frame", "outcome")]
    return F.coalesce(
        F.when(F.col("corrupt").isNotNull(), "not JSON"), *missing, F.when(~F.col("frame").isin(*FRAMES), "unknown frame"), F.when(~F.col("outcome").isin(*OUTCOMES), "unknown outcome"),
        F.when((F.col("outcome") == "correct") & F.col("regions").isNull(), "correct without regions"),
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Verdicts of text ``value``, each with ``problem`` and its raw ``line``; blank lines go. Works on streams."""
    v = F.from_json("value", f"{VERDICT}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.where(F.trim("value") != "").select(v.alias("v"), F.col("value").alias("line")).select("v.*", "line").withColumn("problem", problem()).drop("corrupt")


def read_verdicts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(valid, refused) verdicts of a log."""
    every = parsed(spark.read.text(folder))
    return every.where("problem IS NULL").drop("problem", "line"), every.where("problem IS NOT NULL").select("line", "problem")


def append_verdicts(verdicts: DataFrame, folder: str) -> None:
    """Adds lines to the log; writers need no lock, since each adds files of its own."""
    verdicts.write.mode("append").json(folder)
