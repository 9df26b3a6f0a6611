"""Quality rules under weak supervision.

Each rule reads a few counts of a text and votes good, votes bad or abstains. No rule is trusted outright: expectation
maximisation over all documents' votes estimates, for each rule, how often it votes bad on bad documents and good on
good ones, and the share of good documents; a document is kept when the posterior probability that it is good reaches
one half. Only DataFrame and SQL functions run: votes form at most 3**rules patterns, so one aggregate reduces the
corpus to a small table, on which each iteration is one more aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import let, stage_table, table, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
ITERATIONS = 12
#: The first guess of the estimation: share of good documents.
FIRST_GOOD = 0.9
#: What makes a vote mean what its name says: bounds on how often a rule votes bad or good on good and on bad documents.
#: Without them the two classes could be any two clusters of the votes.
BOUNDS = {("bad", "good"): (0.0005, 0.01), ("bad", "bad"): (0.10, 0.95), ("good", "good"): (0.50, 0.99), ("good", "bad"): (0.01, 0.20)}
FIRST = {("bad", "good"): 0.01, ("bad", "bad"): 0.30, ("good", "good"): 0.90, ("good", "bad"): 0.10}
KEEP_AT = 0.5

#: Votes by name: (bad if, good if) as SQL over the counts, None for a vote that the rule never gives; else it abstains.
RULES = {
    "length": ("n_words < 20", None),
    "word_length": ("word_chars < 2.5 * n_words OR word_chars > 12 * n_words", None),
    "symbols": ("n_symbols > 0.10 * n_words", None),
    "letters": ("n_letters < 0.75 * word_chars", None),
    "dup_lines": ("n_dup_lines >= 3 AND n_dup_lines > 0.30 * n_lines", None),
    "repeats": ("n_repeat_words > 0.25 * n_words", None),
    "sentences": ("n_words >= 80 AND n_stops * 120 < n_words", None),
    "prose": (None, "n_words >= 20 AND n_letters >= 0.85 * word_chars AND n_symbols <= 0.02 * n_words AND n_repeat_words <= 0.30 * n_words AND (n_dup_lines < 3 OR n_dup_lines <= 0.20 * n_lines)"),
}


def repeat_words(word_hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more; linear but for the sort of repeating texts."""

    def covered(hashes: Column) -> Column:
        def positions(by_hash: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(by_hash, b)["h"] == a["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(by_hash, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

        def union(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)

        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(by_hash, positions), union)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    def counted(hashes: Column) -> Column:
        several = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(several, covered(hashes)).otherwise(F.lit(0))

    enough = lambda h: F.when(F.size(h) > window, let(windows(h), counted)).otherwise(F.lit(0))
    return let(word_hashes, enough)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts of every whole text beside the columns ``keep`` (default: doc_id); a null text counts as empty."""
    keep = ["doc_id"] if keep is None else keep
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def counts(ws: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n_chars = F.length(F.translate(t, " \t\n\x0b\f\r", ""))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            n_chars.cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
            repeat_words(F.transform(ws, lambda w: F.xxhash64(w))).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            (F.length(t) - F.length(F.translate(t, ".!?", ""))).cast("long").alias("n_stops"),
        )

    m = docs.select(*keep, let(words(t), counts).alias("__m"))
    names = ["n_words", "word_chars", "n_symbols", "n_repeat_words", "n_letters", "n_stops"]
    return m.select(*keep, *[F.col(f"__m.{n}").alias(n) for n in names], F.col("__m.lines.n_lines").alias("n_lines"), F.col("__m.lines.n_dup_lines").alias("n_dup_lines"))


def column(rule: str) -> str:
    """A rule's votes stand in a column of this name, beside whatever the caller keeps."""
    return f"__vote_{rule}"


def vote(bad: str | None, good: str | None) -> Column:
    return F.when(F.expr(bad or "false"), F.lit(-1)).when(F.expr(good or "false"), F.lit(1)).otherwise(F.lit(0)).cast("byte")


def posterior(model: dict, rules: dict) -> Column:
    """P(good | votes); a rule that abstains counts as it abstains on good and on bad documents."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for n, (bad, good) in rules.items():
        p = {(v, y): model[n][v, y] if has else 0.0 for v, has in (("bad", bad), ("good", good)) for y in ("good", "bad")}
        ln = lambda x, y: F.lit(math.log(x / y) if x and y else 0.0)
        silent = ln(1 - p["bad", "good"] - p["good", "good"], 1 - p["bad", "bad"] - p["good", "bad"])
        odds = odds + F.when(F.col(column(n)) == -1, ln(p["bad", "good"], p["bad", "bad"])).when(F.col(column(n)) == 1, ln(p["good", "good"], p["good", "bad"])).otherwise(silent)
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, rules: dict, iterations: int = ITERATIONS) -> dict:
    """Share of good documents and, for each rule, how often it votes bad or good on either class.

    Expectation maximisation over at most 3**len(rules) vote patterns, to which the votes are reduced first; estimates
    stay within BOUNDS. With no rows the first guess is returned.
    """
    patterns = stage_table(votes.groupBy(*map(column, rules)).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")
    model: dict = {"good": FIRST_GOOD} | {n: dict(FIRST) for n in rules}
    for _ in range(iterations):
        p = patterns.withColumn("p", posterior(model, rules))
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * F.col("p")).alias("good")]
        for n in rules:
            for v, at in (("bad", -1), ("good", 1)):
                here = F.when(F.col(column(n)) == at, F.col("n")).otherwise(0)
                sums += [F.sum(here * F.col("p")).alias(f"{n}_{v}_good"), F.sum(here * (1 - F.col("p"))).alias(f"{n}_{v}_bad")]
        s = p.agg(*sums).first()
        if not s["all"]:
            break
        of = {"good": s["good"], "bad": s["all"] - s["good"]}
        model = {"good": min(0.995, max(0.05, s["good"] / s["all"]))}
        for n in rules:
            model[n] = {(v, y): min(hi, max(lo, (s[f"{n}_{v}_{y}"] + FIRST[v, y]) / (of[y] + 1))) for (v, y), (lo, hi) in BOUNDS.items()}
    return model


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: dict | None = None) -> DataFrame:
    """Counts, base verdict, posterior ``quality`` and ``kept`` of every whole text.

    Null, empty and blank texts have no words, so they fail the base. Repeated rows are judged each for itself and
    weigh as often as they occur. An empty table gives an empty one. Of ``docs`` only ``text`` and ``keep`` are read.
    """
    rules = RULES if rules is None else rules
    keep = ["doc_id"] if keep is None else keep
    measured = measure(docs, text, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    voted = stage_table(measured.select("*", failed.alias("base_failed"), *[vote(*rules[n]).alias(column(n)) for n in rules]), "quality-votes")
    model = estimate(voted, rules)
    out = voted.withColumn("quality", posterior(model, rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).drop(*map(column, rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(table(spark, sf_dir, "documents")).select(*columns)
