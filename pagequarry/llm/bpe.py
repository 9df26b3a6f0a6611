"""BPE encoding and decoding through a distinct-word table.

A byte-level BPE never merges across the words of its splitting pattern, and that pattern never joins what a single
space parts, so a text's ids are the ids of its space-parted words in order. The words that recur are counted over all documents, each is encoded once for the
whole corpus, and the table of (word, ids) goes to every task, which joins ids back by position. The table is bounded
(``table_words``): Zipf's law gives its words nearly all positions. Words below the bound go into the worker's own
distinct-word table, which starts anew when it is full; no row is dropped for being rare. Decoding is
the join the other way, from id to piece; that table is as large as the vocabulary, at most.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import stage_table, table

#: Most words in the table that every task holds: about 40 MB in a Python worker.
TABLE_WORDS = 200_000
#: A task names a word for the table when it met it so often.
LEAST_IN_TASK = 4
#: Words of a task's counter before its rare words are let go; the choice of table words never changes a result.
COUNTER_WORDS = 1_000_000
#: Characters of texts that are split at a time, and words of a worker's own table before it starts anew.
BLOCK_CHARS, OWN_WORDS = 2_000_000, 150_000

#: The splitting pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Vocabulary:
    """A tokenizers file of byte-level BPE: splitting, encoding of single words, id-to-piece table."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.special = {x["content"]: x["id"] for x in added}
        self.odd, self.single = regex.compile(r" \s|\s |^ | $").search, regex.compile(r"(?<=\S) (?=\S)").split
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        # byte-level vocabularies write each byte as a printable character
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = np.empty(max(ids.values()) + 1, dtype=object)
        self.pieces[:] = b""
        self.names = [str(i) for i in range(len(self.pieces))]
        for piece, i in ids.items():
            whole = piece not in self.special and all(c in byte_of for c in piece)
            self.pieces[i] = bytes(byte_of[c] for c in piece) if whole else piece.encode()
        self.one = self.single_word(spec["model"], byte_of)

    def single_word(self, model: dict, byte_of: dict[str, int]):
        """A function from a word to its ids.

        Where ids are ranks of merges, as in vocabularies grown merge by merge, the merge of least rank is the piece of
        least id, and a rank encoder gives the same ids at less cost a call; else the tokenizer itself is asked.
        """
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        if made == sorted(set(made)) and len(vocab) == len(made) + 256 + sum(s in vocab for s in self.special) and not model.get("ignore_merges"):
            try:
                import tiktoken
            except ImportError:
                pass
            else:
                ranks = {bytes(byte_of[c] for c in p): i for p, i in vocab.items() if p not in self.special}
                return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        return lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids

    def split(self, text: str) -> list[str]:
        """Words in order: the splitting pattern never joins what a single space between two non-spaces parts.

        A word is named without the space before it; one that has none (a text's or part's first) is named with a
        space in front, which no other name has. A special string is a part of its own.
        """
        if self.cut is None or not any(s in text for s in self.special):
            return self.chunks(text)
        return [w for part in self.cut(text) if part for w in ([" " + part] if part in self.special else self.chunks(part))]

    def chunks(self, text: str) -> list[str]:
        out = text.split(" ") if self.odd(text) is None else self.single(text)
        out[0] = " " + out[0]
        return out

    def ids(self, word: str) -> list[int]:
        """Ids of one word by name."""
        text = word[1:] if word[0] == " " else " " + word
        return [self.special[text]] if text in self.special else self.one(text)

    def encode_words(self, words: list[str]) -> list[tuple[int, str, bytes]]:
        """For each name of a word: number of ids, ids in decimal, ids as uint32."""
        return [(len(e), ",".join([names[i] for i in e]), array("I", e).tobytes()) for names in (self.names,) for e in map(self.ids, words)]

    def count_words(self, words: list[str]) -> list[int]:
        return [len(e) for e in map(self.ids, words)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.pieces[ids].tolist()).decode("utf-8", errors="replace")


def blocks(batch: pd.DataFrame, column: str, chars: int = BLOCK_CHARS) -> Iterator[pd.DataFrame]:
    """A batch in runs of rows with about ``chars`` characters each; one long text is a run of its own."""
    size = np.cumsum([len(t) if isinstance(t, str) else 0 for t in batch[column]]) // chars
    for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(size)) + 1):
        if len(at):
            yield batch.iloc[at]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_table(docs: DataFrame, path: str, text: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """(word, n, ids, packed): the most frequent words of all texts, at most ``table_words``, each encoded once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, counts = vocabulary(path), Counter()

        def named() -> pd.DataFrame:
            kept = [(w, n) for w, n in counts.items() if n >= LEAST_IN_TASK]
            return pd.DataFrame(kept, columns=["word", "n"])

        for batch in batches:
            for t in batch[text]:
                if t:
                    counts.update(vocab.split(t))
                if len(counts) > COUNTER_WORDS:
                    yield named()
                    counts.clear()
        yield named()

    counted = stage_table(docs.select(F.col(text)).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    # the lowest count that keeps the table within its bound, from the histogram of counts in powers of 2**(1/4)
    level = F.floor(F.log2("n") * 4).cast("int")
    histogram = sorted(((r["level"], r["k"]) for r in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, held = None, 0
    for at, k in histogram:
        if held + k > table_words:
            break
        least, held = at, held + k

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            words = batch["word"].tolist()
            coded = vocab.encode_words(words)
            yield pd.DataFrame({"word": words, "n": [c[0] for c in coded], "ids": [c[1] for c in coded], "packed": [c[2] for c in coded]})

    chosen = counted.where(level >= least) if least is not None else counted.limit(0)
    return chosen.select("word").mapInPandas(encode, "word string, n long, ids string, packed binary")


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, table_words: int = TABLE_WORDS, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encodes every text whole and decodes it again.

    Returns the columns ``keep`` (default: doc_id) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids
    (array of int) and decoded. A null or empty text has no ids; its digests are those of the empty string. Repeated
    rows are encoded each for itself; an empty table gives an empty one. Columns of ``docs`` that are not kept are not
    read, so clashing names do no harm unless they are kept.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    held = {r["word"]: (r["n"], r["ids"], bytes(r["packed"])) for r in stage_table(word_table(docs, path, text, table_words), "bpe-table").collect()}
    common = spark.sparkContext.broadcast(held)
    extra = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids + ["decoded string"] * with_text
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, known, own = vocabulary(path), common.value, {}
        for block in (b for batch in batches for b in blocks(batch, "__text")):
            split = [vocab.split(t) if t else [] for t in block["__text"]]
            rare = list({w for ws in split for w in ws if w not in known and w not in own})
            if len(own) > OWN_WORDS:
                own.clear()
                rare = list({w for ws in split for w in ws if w not in known})
            own.update(zip(rare, vocab.encode_words(rare), strict=True))
            counts, digests, decoded, ids_out, text_out = [], [], [], [], []
            for ws in split:
                coded = [known.get(w) or own[w] for w in ws]
                ids = np.frombuffer(b"".join([c[2] for c in coded]), dtype="<u4")
                back = vocab.decode(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join([c[1] for c in coded]).encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids_out.append(ids.astype("int32"))
                if with_text:
                    text_out.append(back)
            out = block.drop(columns="__text").assign(n_tokens=counts, ids_sha256=digests, decoded_sha256=decoded)
            if with_ids:
                out["ids"] = ids_out
            if with_text:
                out["decoded"] = text_out
            yield out

    return kept.mapInPandas(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
