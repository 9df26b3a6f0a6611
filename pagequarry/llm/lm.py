"""Language-model scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts a unit from the vectors of the ``CONTEXT`` units before it: the predicted vector is a sum of linear
maps of the context's vectors, and a unit's score is its product with the unit's own vector plus a bias. Frequent words
are units of their own, the more of them the more words there are; the others share units by their last byte, and within
such a unit a word has its smoothed share of the unit's training tokens. So the model is normalised over all words, known
or not, while a softmax has a term a unit: batched matrix products give exact log-probabilities.

Training is data-parallel. In each round every task starts from the same parameters, trains on its share of the round's
texts and returns its parameters, which are averaged by tokens, first in groups and then on the driver; all training
texts are read once over the rounds. Word counts are exact and distributed: words above a count go to every task as a
bounded table, and only the rarer ones, none of which can be hot, meet their counts in a join.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks
from pagequarry.llm.common import stage_table, table, text_crc

#: Units of the softmax at least, and those of them that rarer words share.
UNITS, SHARED = 512, 32
DIM, CONTEXT = 24, 2
#: Noise units drawn for each batch of positions, positions in a batch, step of the gradient, rounds of training.
NOISE, BATCH, STEP, ROUNDS = 64, 2048, 0.15, 3
#: Words in the table that every task holds; more only where more have units of their own.
TABLE_WORDS = 150_000
#: Words of a task's counter before it is emptied into the shuffle.
COUNTER_WORDS = 800_000
#: Scores that are worked on at a time.
SCORES = 2**18
#: Contexts whose norms a worker remembers.
KNOWN_NORMS = 2**24
#: The end of a text as a token; no word holds a blank.
END = b" "


def text_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then the end."""
    return [*(text or "").encode().lower().split(), END]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n): exact counts of all tokens, each text's end included."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        frame = lambda: pd.DataFrame({"word": list(counts), "n": list(counts.values())})
        for batch in batches:
            for t in batch[text]:
                counts.update(text_words(t))
                if len(counts) > COUNTER_WORDS:
                    yield frame()
                    counts.clear()
        yield frame()

    return stage_table(docs.select(F.col(text).cast("string").alias(text)).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


class Words:
    """The bounded table of frequent words: counts, units, and the tokens and distinct words of each shared unit."""

    def __init__(self, frequent: list[tuple[bytes, int]], tokens: int, distinct: int, shared: dict[int, tuple[int, int]]):
        self.tokens, self.distinct, self.shared = tokens, distinct, shared
        # the end is always a unit of its own, also when nothing was learned
        ordered = sorted(frequent, key=lambda x: (x[0] != END, -x[1], x[0]))
        if not ordered or ordered[0][0] != END:
            ordered.insert(0, (END, 0))
        # a unit without a word would hold probability that no word gets
        self.own = own = min(own_units(distinct), len(ordered))
        self.n_units = own + SHARED
        self.at = {w: i for i, (w, _) in enumerate(ordered)}
        self.counts = np.array([n for _, n in ordered], dtype=np.float64)
        self.units = np.array([i if i < own else shared_unit(w, own) for i, (w, _) in enumerate(ordered)], dtype=np.int32)
        self.own_words = {w for w, _ in ordered[:own]}

    def unigram(self) -> np.ndarray:
        """Smoothed training counts of the units."""
        out = np.full(self.n_units, 0.5)
        own = self.units < self.own
        out[self.units[own]] += self.counts[own]
        for u, (n, _) in self.shared.items():
            out[u] += n
        return out / out.sum()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Places in the table, -1 outside."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), dtype=np.int32, count=len(words))

    def units_of(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        units = self.units[at]
        for i in np.flatnonzero(at < 0):
            units[i] = shared_unit(words[i], self.own)
        return units


def own_units(distinct: int) -> int:
    """Words with units of their own, if there are so many: the root of the vocabulary, which the table grows to hold."""
    return max(UNITS - SHARED, math.isqrt(distinct))


def shared_unit(word: bytes, own: int) -> int:
    return own + word[-1] % SHARED


def contexts(units: np.ndarray, starts: np.ndarray, n_units: int) -> np.ndarray:
    """The CONTEXT units before each position, nearest first; ``n_units`` stands for what lies before a text."""
    out = np.full((CONTEXT, len(units)), n_units, dtype=np.int32)
    place = np.arange(len(units)) - np.repeat(starts, np.diff(np.append(starts, len(units))))
    for k in range(CONTEXT):
        out[k, k + 1 :] = units[: -(k + 1)]
        out[k, place <= k] = n_units
    return out


class LogBilinear:
    """Parameters: context vectors, unit vectors, biases, and a matrix for each context place."""

    def __init__(self, unigram: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.params = [f(len(unigram) + 1, DIM), f(len(unigram), DIM), np.log(unigram).astype(np.float32), np.stack([np.eye(DIM, dtype=np.float32) / CONTEXT] * CONTEXT)]
        self.noise, self.norms = unigram, None

    def pack(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.params)

    def load(self, packed: bytes) -> LogBilinear:
        flat, at = np.frombuffer(packed, dtype="<f4"), 0
        for k, p in enumerate(self.params):
            self.params[k] = flat[at : at + p.size].reshape(p.shape).copy()
            at += p.size
        self.norms = None
        return self

    def train(self, units: np.ndarray, before: np.ndarray, squares: list[np.ndarray], rng: np.random.Generator) -> None:
        """Noise-contrastive steps over all positions, in shuffled batches; ``squares`` are the steps' running scales."""
        order, n_units, self.norms = rng.permutation(len(units)), len(self.noise), None
        ln_noise = np.log(NOISE * self.noise).astype(np.float32)
        drawn = self.noise.cumsum()
        drawn /= drawn[-1]
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            w, ctx = units[at], before[:, at]
            vin, vout, bias, maps = self.params
            r = [vin[c] for c in ctx]
            q = sum(r[k] @ maps[k] for k in range(CONTEXT))
            noise = drawn.searchsorted(rng.random(NOISE), side="right")
            target, other = vout[w], vout[noise]
            d_true = sigmoid(ln_noise[w] - bias[w] - np.einsum("ij,ij->i", q, target))
            d_noise = q @ other.T
            d_noise += bias[noise] - ln_noise[noise]
            np.negative(sigmoid(d_noise), out=d_noise)
            gq = d_noise @ other
            gq += d_true[:, None] * target
            g_out = scatter(w, d_true[:, None] * q, n_units)
            np.add.at(g_out, noise, d_noise.T @ q)
            g_bias = np.bincount(w, d_true, n_units)
            np.add.at(g_bias, noise, d_noise.sum(0))
            g_in = sum(scatter(ctx[k], gq @ maps[k].T, n_units + 1) for k in range(CONTEXT))
            g_maps = np.stack([r[k].T @ gq for k in range(CONTEXT)])
            for k, g in enumerate((g_in, g_out, g_bias, g_maps)):
                g = np.multiply(g, 1 / len(at), dtype=np.float32, casting="same_kind")
                squares[k] += g * g
                scale = np.sqrt(squares[k] + np.float32(1e-8))
                g *= np.float32(STEP)
                g /= scale
                self.params[k] += g

    def log10(self, units: np.ndarray, before: np.ndarray, rows: int = 8192) -> np.ndarray:
        """log10 P(unit | context) of each position; each distinct context goes through the softmax once."""
        vin, vout, bias, maps = self.params
        size = len(bias) + 1
        codes = before[0].astype(np.int64)
        for k in range(1, CONTEXT):
            codes = codes * size + before[k]
        parts = [vin @ m for m in maps]
        asum = lambda at: sum(parts[k][at[k]] for k in range(CONTEXT))

        def norms(distinct: np.ndarray) -> np.ndarray:
            out = np.empty(len(distinct))
            # as many scores at a time as stay in a core's cache
            step = max(1, SCORES // size)
            for lo in range(0, len(distinct), step):
                code = distinct[lo : lo + step]
                s = asum([code // size ** (CONTEXT - 1 - k) % size for k in range(CONTEXT)]) @ vout.T + bias
                top = s.max(1, keepdims=True)
                np.exp(np.subtract(s, top, out=s), out=s)
                out[lo : lo + step] = top[:, 0] + np.log(s.sum(1))
            return out

        if size**CONTEXT <= KNOWN_NORMS:
            if self.norms is None:
                self.norms = np.full(size**CONTEXT, np.nan)
            missing = np.unique(codes[np.isnan(self.norms[codes])])
            self.norms[missing] = norms(missing)
            norm = self.norms[codes]
        else:
            distinct, inverse = np.unique(codes, return_inverse=True)
            norm = norms(distinct)[inverse]
        out = np.empty(len(units))
        for lo in range(0, len(units), 8 * rows):
            part = slice(lo, lo + 8 * rows)
            out[part] = np.einsum("ij,ij->i", asum(before[:, part]), vout[units[part]]) + bias[units[part]] - norm[part]
        return out / math.log(10)


#: The last model that a worker scored with, whose norms serve its later tasks.
_last: dict[str, LogBilinear] = {}


def remembered(name: str, words: Words, packed: bytes) -> LogBilinear:
    if name not in _last:
        _last.clear()
        _last[name] = LogBilinear(words.unigram()).load(packed)
    return _last[name]


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of ``x`` in place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by ``at``."""
    d = rows.shape[1]
    return np.bincount((at[:, None] * np.int64(d) + np.arange(d)).ravel(), rows.ravel(), n * d).reshape(n, d)


def positions(texts: Iterator[str | None], words: Words) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of several texts: words, places in the table, units, and where each text starts."""
    flat: list[bytes] = []
    starts = []
    for t in texts:
        starts.append(len(flat))
        flat += text_words(t)
    at = words.numbers(flat)
    return flat, at, words.units_of(flat, at), np.array(starts, dtype=np.int64)


def learn_words(counted: DataFrame) -> Words:
    """The frequent-word table from exact counts; what reaches the driver is bounded by TABLE_WORDS, or by the words that have
    units of their own. Words go by levels of counts; where whole levels hold too few, the first words of the next follow."""
    level = F.floor(F.log2("n") * 4).cast("int")
    histogram = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()
    distinct = sum(r["k"] for r in histogram)
    own = own_units(distinct)
    least, held, following = 10**6, 0, None
    for at, k in sorted(((r["level"], r["k"]) for r in histogram), reverse=True):
        if held + k > max(TABLE_WORDS, own):
            following = at
            break
        least, held = at, held + k
    end = F.col("word") == F.lit(bytearray(END))
    rows = counted.where((level >= least) | end).collect()
    if following is not None and held < own:
        rows += counted.where((level == following) & ~end).orderBy(F.desc("n"), "word").limit(own - held).collect()
    frequent = [(bytes(r["word"]), r["n"]) for r in rows]
    words = Words(frequent, sum(r["n"] for r in histogram), distinct, {})
    unit = F.lit(words.own) + F.pmod(F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int"), F.lit(SHARED))
    sums = {r["u"]: [r["n"], r["k"]] for r in counted.groupBy(unit.alias("u")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    for w in words.own_words:  # these are units of their own
        i = words.at[w]
        if words.counts[i] and (u := shared_unit(w, words.own)) in sums:
            sums[u] = [sums[u][0] - int(words.counts[i]), sums[u][1] - 1]
    words.shared = {u: (n, k) for u, (n, k) in sums.items()}
    return words


def fit(docs: DataFrame, words: Words, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> LogBilinear:
    """Trains on all texts of ``docs``, a share of them in each round."""
    spark = docs.sparkSession
    model = LogBilinear(words.unigram())
    common = spark.sparkContext.broadcast(words)
    rows = docs.select(F.col(text).cast("string").alias("t"), F.pmod(F.hash(F.col(key).cast("string"), F.lit(3)), F.lit(rounds)).alias("round"))
    groups = 32

    for k in range(rounds):
        start = model.pack()

        def run(batches: Iterator[pd.DataFrame], start=start, k=k) -> Iterator[pd.DataFrame]:
            known = common.value
            own = LogBilinear(known.unigram()).load(start)
            squares, rng, seen = [np.full_like(p, 1e-4) for p in own.params], np.random.default_rng(k), 0
            for block in (b for batch in batches for b in blocks(batch, "t")):
                _, _, units, starts = positions(block["t"], known)
                own.train(units, contexts(units, starts, known.n_units), squares, rng)
                seen += len(units)
            if seen:
                yield pd.DataFrame({"g": [uuid.uuid4().int % groups], "seen": [seen], "params": [own.pack()]})

        def average(key_, part: pd.DataFrame) -> pd.DataFrame:
            weight = part["seen"].to_numpy(dtype=np.float64)
            mean = sum(np.frombuffer(p, dtype="<f4") * w for p, w in zip(part["params"], weight / weight.sum(), strict=True))
            return pd.DataFrame({"seen": [int(weight.sum())], "params": [mean.astype("<f4").tobytes()]})

        trained = rows.where(F.col("round") == k).select("t").mapInPandas(run, "g int, seen long, params binary")
        done = trained.groupBy("g").applyInPandas(average, "seen long, params binary").collect()  # a row a group
        if done:
            total = sum(r["seen"] for r in done)
            model.load(sum(np.frombuffer(r["params"], dtype="<f4").astype(np.float64) * (r["seen"] / total) for r in done).astype("<f4").tobytes())
    return model


def score(docs: DataFrame, counted: DataFrame, words: Words, model: LogBilinear, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id) with n_tokens, n_known, train_tokens, base_score and score of every whole text.

    A null or empty text is its end alone. Repeated rows are scored each for itself. Where nothing was learned every
    count is 0. Only ``text`` and ``keep`` are read, so other columns do not clash.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    both, model_id = spark.sparkContext.broadcast((words, model.pack())), uuid.uuid4().hex
    extra = "n_tokens long, n_known long, base_score double, score double, __row string, __rare array<struct<w: binary, n: int>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [extra])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, packed = both.value
        net = remembered(model_id, known, packed)
        base_ln = math.log10(known.tokens + 0.5 * (known.distinct + 1))
        # what a unit's shared probability is divided by; own units have it all
        share = np.zeros(known.n_units)
        for u in range(known.own, known.n_units):
            n, k = known.shared.get(u, (0, 0))
            share[u] = math.log10(n + 0.5 * (k + 1))
        ln_counts = np.log10(known.counts + 0.5)
        own = uuid.uuid4().hex[:16]
        done = 0
        for block in (b for batch in batches for b in blocks(batch, "__text")):
            flat, at, units, starts = positions(block["__text"], known)
            lm = net.log10(units, contexts(units, starts, known.n_units)) - share[units]
            inside = at >= 0
            ln_c = np.where(inside, ln_counts[at], 0.0)
            lm += np.where(units >= known.own, ln_c, 0.0)
            sums = lambda x: np.add.reduceat(x, starts)
            n = np.diff(np.append(starts, len(flat)))
            rare: list[Counter] = [Counter() for _ in range(len(block))]
            for i, d in zip((out := np.flatnonzero(~inside)), np.searchsorted(starts, out, side="right") - 1, strict=True):
                rare[d][flat[i]] += 1
            yield block.drop(columns="__text").assign(
                n_tokens=n, n_known=sums((inside & (known.counts[at] > 0)).astype(np.int64)), base_score=sums(ln_c - base_ln), score=sums(lm),
                __row=[f"{own}{done + i}" for i in range(len(block))], __rare=[[{"w": w, "n": c} for w, c in r.items()] for r in rare],
            )
            done += len(block)

    scored = stage_table(kept.mapInPandas(run, schema), "lm-scored")
    asked = scored.select("__row", F.explode("__rare").alias("r")).select("__row", F.col("r.w").alias("word"), F.col("r.n").alias("k"))
    met = asked.join(counted, "word", "left").groupBy("__row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_ln"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    ln, more = F.coalesce("rare_ln", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return scored.drop("__rare").join(met, "__row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + ln).alias("base_score"), (F.col("score") + ln).alias("score")
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(text_crc(F.col("doc_id")) % 5 == 1, F.lit(False))
    counted = word_counts(docs.where(~held))
    words = learn_words(counted)
    model = fit(docs.where(~held), words)
    return score(docs.withColumn("held_out", held), counted, words, model, keep=["doc_id", "held_out"])
