"""Corpus preparation in five stages; each reads what the one before kept.

1. Quality rules: documents that the rules reject go.
2. N-gram Jaccard join: of each group of near duplicates (five-word shingles, similarity 0.8 and more, followed through
   links) the document of least doc_id stays.
3. Benchmark decontamination: documents that hold a window of a benchmark item go.
4. Secret scans: credentials in the texts that remain are replaced by a mark; no document goes.
5. BPE: each text is encoded and decoded; counts and digests are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, decontaminate, jaccard, quality, secrets
from pagequarry.llm.common import drop_path, new_path, scratch, stage_table, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys up to this number are sent to every task (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A row's key: it tells rows apart that share a doc_id but not a text, and rows without a doc_id.
KEY = "__key"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), F.col("text")).alias(KEY))


def few(keys: DataFrame) -> DataFrame:
    """Keys written once, with a hint to send them to every task where their number is within the bound."""
    keys = stage_table(keys, "keys", keep=True)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the weakly supervised rules keep.

    Null, empty and blank texts go. Each row is judged for itself, so repeated rows stay or go together, whatever their
    doc_id; an empty table stays empty. Columns but those of documents are not read.
    """
    return quality.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each component of near duplicates; of those that share it, the one of least key.

    Rows are told apart by doc_id and text: rows that share a doc_id but not a text go only if they are near copies, and
    rows without a doc_id come after all others. Rows that repeat doc_id and text are one. Texts without words are near
    nothing and stay, repeated or not. Only keys are shuffled, and the texts of rows that are repeated, of which one stays.
    """
    rows = keyed(docs)
    grouped = jaccard.jaccard_groups(rows, size=5, percent=80, doc=KEY, order="doc_id").where("n_shingles > 0")
    keys = grouped.groupBy(KEY).agg(F.max("first").alias("__first"), F.count(F.lit(1)).alias("__n"))
    marked = rows.join(few(keys.where("NOT __first OR __n > 1")), KEY, "left")
    again = marked.where("__first AND __n > 1").groupBy(KEY).agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return marked.where("__n IS NULL").select(*COLUMNS).unionByName(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark window, each judged by its own text, whether its doc_id is null or shared.

    Null and empty texts hold none and stay; so do all rows if the benchmark is empty.
    """
    rows = keyed(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), doc=KEY)
    return rows.join(few(found.where("contaminated").select(KEY).distinct()), KEY, "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in the text replaced and n_chars counted anew where it changed; null texts stay null."""
    before = docs.select(*COLUMNS)
    after = secrets.redacted(before.withColumn("length", F.length("text")))
    changed = F.length("text") != F.col("length")
    return after.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source with n_tokens, ids_sha256 and decoded_sha256; null texts count as empty, no row goes."""
    return bpe.encode(docs, bpe.tokenizer_path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("bpe encoding and decoding", bpe_stage),
]

#: SQL can state neither the estimated quality model nor the inferred formats nor BPE. Tests hold each stage against a plain
#: version of it, on the small tables and on odd rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote for itself goes when its rows are written, and these when the next
    stage's are; what the last stage reads stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = stage_table(stage(spark, docs, sf_dir), name, path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
