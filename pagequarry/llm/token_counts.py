"""Token counts through a digest cache.

Each text has the SHA-256 of its content, each tokenizer the SHA-256 of its file. Counts are stored under both; texts
whose pair is in the cache are never encoded again, and of the others each distinct text is encoded once and its count
appended. The content is normalised before the digest: a null is the empty string and a text is its UTF-8 bytes. A
stronger normalisation (case, white space, Unicode forms) would change counts, so none is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks, tokenizer_path, vocabulary
from pagequarry.llm.common import column_bytes, new_path, table

#: Texts of more tokens than this are over the limit.
TOKEN_LIMIT = 512
#: Words of a worker whose counts are at hand, before it starts anew.
KNOWN_WORDS = 400_000
CACHE = "tokenizer string, digest binary, n_tokens long"


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to counts. A .json file is read by tokenizers, a .model file by sentencepiece.

    For a plain byte-level BPE, a new text's count is the sum over its words, each encoded once while it is known."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    try:
        vocab, known = vocabulary(path), {}
    except ValueError:
        vocab = None
    if vocab is not None:

        def count(texts: list[str]) -> list[int]:
            split = [vocab.split(t) if t else [] for t in texts]
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = list({w for ws in split for w in ws if w not in known})
            known.update(zip(new, vocab.count_words(new), strict=True))
            return [sum([known[w] for w in ws]) for ws in split]

        return count
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str, text: str = "text", keep: list[str] | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Counts the tokens of every text whole, through the cache folder ``cache``, and appends what it had to encode.

    Returns the columns ``keep`` (default: doc_id) with n_bytes, n_tokens and over_limit. Null and empty texts have the
    count of the empty string, 0. Repeated rows share one encoding. An empty table gives an empty one and appends
    nothing of use. A text that fills a third of the table leaves each task once, since distinct texts are formed
    before the shuffle; the join back is split by Spark where a digest is hot.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    version = tokenizer_digest(path)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    distinct = docs.select(digest.alias("digest"), content.alias("content")).dropDuplicates(["digest"])
    misses = distinct.join(known.select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in batches:
            for part in blocks(batch, "content"):
                yield pd.DataFrame({"tokenizer": version, "digest": part["digest"], "n_tokens": count(part["content"].tolist())})

    misses.mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    # two runs at once may both append a digest, with the same count
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(*keep, digest.alias("__digest"), column_bytes(F.col(text)).cast("long").alias("n_bytes"))
    counts = counts.withColumnRenamed("digest", "__digest")
    return rows.join(counts, "__digest").select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An own, empty cache for each call, so that all texts are counted here and now."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
