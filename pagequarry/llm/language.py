"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to 4 characters, within words padded by a blank on each side) by
rank. A text's own profile is compared with each language's: every n-gram of the text adds the distance between its two
ranks, or the greatest distance if the language's profile lacks it. The nearest profile names the language.

Profiles are learned from a sample of labelled texts, bounded for each language; the sample's members are drawn by a hash
of the id, so they do not depend on how the table is stored. Every text is scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import table, text_crc

#: N-grams in a profile.
PROFILE = 400
LENGTHS = (1, 2, 3, 4)
#: Most labelled texts a language's profile is learned from, and characters read of each task's sample at a time.
SAMPLE_PER_LANGUAGE = 1500
#: Words whose n-grams a worker remembers before it starts anew.
KNOWN_WORDS = 200_000

#: A word is a run of letters; all else parts words. The pattern leaves signs of numbers such as fractions in words, which
#: are parted again.
SPLIT = re.compile(r"[\W\d_]+")


def words_of(text: str) -> Counter:
    """Lower-case words of a text, by number."""
    words = Counter(SPLIT.split(text.lower()))
    words.pop("", None)
    for w in [w for w in words if not w.isalpha()]:
        n = words.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            words[part] += n
    return words


def word_grams(word: str) -> list[str]:
    padded = f" {word} "
    out = [*word]
    for n in LENGTHS[1:]:
        out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def count_grams(words: Counter) -> Counter:
    grams: Counter = Counter()
    for w, n in words.items():
        for g in word_grams(w):
            grams[g] += n
    return grams


def ranked(grams: dict[str, int], size: int = PROFILE) -> list[str]:
    """The most frequent n-grams; ties by the n-gram, so that a profile is one and the same everywhere."""
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:size]]


class Numbers(dict):
    """N-grams by number; a new one takes the next."""

    def __init__(self):
        super().__init__()
        self.grams: list[str] = []

    def __missing__(self, gram: str) -> int:
        i = self[gram] = len(self.grams)
        self.grams.append(gram)
        return i


class Scorer:
    """Out-of-place distances of texts to all profiles, in numpy.

    Only n-grams that some profile has are told apart; the others all have the greatest distance to every profile, but
    they take ranks in the text's own profile, so they are counted.
    """

    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.ids = Numbers()
        self.known: dict[str, np.ndarray] = {}
        for lang in self.langs:
            for g in profiles[lang]:
                self.ids[g]
        self.n_profile = len(self.ids)
        self.ranks = np.full((len(self.langs), self.n_profile), -1, dtype=np.int32)
        for k, lang in enumerate(self.langs):
            for r, g in enumerate(profiles[lang]):
                self.ranks[k, self.ids[g]] = r

    def word(self, word: str) -> np.ndarray:
        grams = word_grams(word)
        found = self.known[word] = np.fromiter(map(self.ids.__getitem__, grams), dtype=np.int32, count=len(grams))
        return found

    def forget(self) -> None:
        """Lets go of what texts added, so that memory stays bounded."""
        for g in self.ids.grams[self.n_profile :]:
            del self.ids[g]
        del self.ids.grams[self.n_profile :]
        self.known.clear()

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, confidence): 0 where the two nearest profiles are equally far, 1 where only one is near."""
        words = words_of(text) if text and self.langs else None
        if not words:
            return "und", 0.0
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known = self.known.get
        parts = [p if (p := known(w)) is not None else self.word(w) for w in words]
        weights = np.repeat(np.fromiter(words.values(), dtype=np.float64, count=len(words)), [len(p) for p in parts])
        every = np.bincount(np.concatenate(parts), weights=weights, minlength=self.n_profile)
        at = np.flatnonzero(every)
        counts = every[at].astype(np.int64)
        if len(at) > self.size:
            # ties by the n-gram itself, as in the learned profiles: only those at the border need their names
            border = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            keep = counts >= border
            at, counts = at[keep], counts[keep]
        names = self.ids.grams
        order = np.lexsort((np.array([names[i] for i in at]), -counts))[: self.size]
        at, own = at[order], np.arange(min(len(order), self.size))
        inside = at < self.n_profile
        theirs = np.where(inside, self.ranks[:, np.where(inside, at, 0)], -1)
        far = np.where(theirs < 0, self.size, np.abs(theirs - own)).sum(axis=1) / (self.size * len(own))
        best = int(np.argmin(far))
        rest = np.delete(far, best)
        second = float(rest.min()) if len(rest) else 1.0
        return self.langs[best], 0.0 if second <= 0 else float(min(1.0, max(0.0, (second - far[best]) / second)))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[str]]:
    """Profiles of the languages of ``labelled`` rows, each from at most ``per_language`` texts with letters.

    The draw is by hash of ``key``: a first cut by the language's own share keeps the ranking's input near the bound.
    """
    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), F.abs(F.hash(F.col(key).cast("string"), F.lit(7)).cast("long")).alias("h")).where("t IS NOT NULL AND l IS NOT NULL")
    share = {r["l"]: min(1.0, 2 * per_language / r["n"]) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return {}
    cut = F.coalesce(*[F.when(F.col("l") == k, F.lit(int(v * 2**31))) for k, v in share.items()])
    drawn = rows.where(F.col("h") <= cut).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("r") <= per_language)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("l"):
                words: Counter = Counter()
                for t in part["t"]:
                    words.update(words_of(t))
                found = count_grams(words)
                yield pd.DataFrame({"l": name, "g": list(found), "n": list(found.values())})

    spread = drawn.select("l", "t").repartition(labelled.sparkSession.sparkContext.defaultParallelism)
    counted = spread.mapInPandas(grams, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("r") <= size)
    profiles: dict[str, dict[int, str]] = {}
    for r in top.collect():  # at most size rows a language
        profiles.setdefault(r["l"], {})[r["r"]] = r["g"]
    return {k: [v[i] for i in sorted(v)] for k, v in profiles.items()}


def identify(docs: DataFrame, profiles: dict[str, list[str]], text: str = "text", keep: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """The columns ``keep`` (default: doc_id) with lang_pred and score of every whole text.

    A null text and one without letters are ``und`` with score 0, and so is every text where no profile was learned.
    Equal distances go to the language that is first by name. Repeated rows are scored alike.
    """
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(profiles, size)
        for batch in batches:
            scored = [scorer.score(t) for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(lang_pred=[s[0] for s in scored], score=[s[1] for s in scored])

    return kept.mapInPandas(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(text_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    profiles = learn(docs.where(~held))
    return identify(docs.withColumn("held_out", held), profiles, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
