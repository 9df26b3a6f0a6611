"""Secret scans by grammar inference.

Three patterns find credentials that say what they are. Their values are labelled examples of credential formats; from a
bounded sample of each kind a probabilistic automaton is inferred: the examples' prefix tree, in which states whose
outcomes differ no more than the Hoeffding bound allows are merged. A further automaton is inferred in the same way from
ordinary words outside all matches; ordinary runs are such words and numbers, joined. Every token-like run of ``LEAST``
characters or more that is not outright words and numbers, also one that reaches beyond a match or whose value a pattern
dropped as too short, is then scored by its likelihood under the credential formats, one of them the format of any key
(characters at random), against the ordinary one; what reads clearly like a credential becomes a span of kind ``format``.

Texts are scanned twice, once to learn and once to judge; nothing that was found is written between the two, so no table
in the shared folder holds a credential.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.bpe import blocks
from pagequarry.llm.common import table

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same matches as HEX has of 16 or more characters, found without stopping at shorter runs.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "api")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Characters of a run that the automata judge, at least.
LEAST = 8
#: Token-like runs: characters of keys and paths, in words of their own; the domain of a mail address is none.
RUN = re.compile(r"(?<![\w@])[A-Za-z0-9][A-Za-z0-9+/_.=-]{2,}(?![^\W\d_])")
#: A word that teaches what is ordinary: 2 to 11 letters in one case or capitalised, by itself. No run that is judged is one.
WORD = re.compile(r"(?<!\w)(?:[A-Z]?[a-z]{1,11}|[A-Z]{2,11})(?!\w)")
#: Such words and numbers of up to 8 digits, and paths of these.
PLAIN = re.compile(r"(?:[A-Z]?[a-z]{1,11}|[A-Z]{1,11}|[0-9]{1,8})(?:[-_/.]+(?:[A-Z]?[a-z]{1,11}|[A-Z]{1,11}|[0-9]{1,8}))*")
#: Pieces of a run: a word in one case or capitalised, a number, a separator.
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+|[^A-Za-z0-9]")

#: Labelled examples a kind's automaton is inferred from, at most; ordinary ones; and the longest of either.
EXAMPLES, ORDINARY, EXAMPLE_CHARS = 2048, 6144, 200
#: Confidence of the Hoeffding test, and natural log of the likelihood ratio that makes a run a secret.
ALPHA, RATIO = 0.05, 12.0
#: Share of the background in a state's outcomes.
GROUND = 0.1
#: ln P that an ordinary run ends, goes on after a separator or joins its next piece outright; that a word has one of its
#: three cases; and of a digit.
ENDS, PARTED, JOINED, CASED, DIGIT = math.log(0.6), math.log(0.35 / 6), math.log(0.05), -math.log(3), -math.log(10)
#: Runs a worker remembers the verdict of before it starts anew.
KNOWN_RUNS = 200_000
#: Parts by hash in which the examples of a kind are drawn, an equal number from each.
DRAWS = 256

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
END = ""


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the patterns' matches, by start, then kind. A span is a whole match."""
    return patterns(text)[0]


def patterns(text: str) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str]]]:
    """The patterns' matches as of ``base_spans``, and (start, end, value) of assigned values that are too short for one."""
    out, short = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                out.append((m.start(), m.end(), "assign", m[2]))
            elif len(m[2]) >= LEAST:
                short.append((m.start(2), m.end(2), m[2]))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))), short


def plain(run: str) -> bool:
    """Whether a run is words, numbers or a path of them outright."""
    return PLAIN.fullmatch(run) is not None


def candidates(text: str, spans: list[tuple[int, int, str, str]], short: Iterable[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """(start, end, run) of what the automata judge: runs that are not plain, and short assigned values, outside ``spans``
    or reaching beyond them. A run's closing stops and dashes are not its own."""
    out = {(s, e): v for s, e, v in short}
    for m in RUN.finditer(text):
        run = m[0].rstrip("-_/.+")
        if len(run) >= LEAST and not plain(run):
            out[m.start(), m.start() + len(run)] = run
    within = lambda s, e: any(a <= s and e <= b for a, b, *_ in spans)
    return [(s, e, v) for (s, e), v in sorted(out.items()) if not (spans and within(s, e))]


class Automaton:
    """A probabilistic finite automaton over ALPHABET: counts of what leaves each state, and of words that end in it."""

    def __init__(self, words: Iterable[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.total = [0]
        self.access = [""]
        for w in words:
            at = 0
            for c in (*w, END):
                self.total[at] += 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c == END:
                    break
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.access.append(self.access[at] + c)
                    self.next.append({})
                    self.count.append({})
                    self.total.append(0)
                at = self.next[at][c]
        self.merge_states(math.sqrt(0.5 * math.log(2 / alpha)))

    def differ(self, a: int, b: int, bound: float) -> bool:
        """Whether some outcome of two states, or of states that they lead to alike, differs beyond the bound."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            n, m = self.total[p], self.total[q]
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most >= 1:  # too few examples to tell, here and further on
                continue
            cp, cq = self.count[p], self.count[q]
            for c in cp.keys() | cq.keys():
                if abs(cp.get(c, 0) / n - cq.get(c, 0) / m) > most:
                    return True
            np_, nq = self.next[p], self.next[q]
            stack += [(np_[c], nq[c]) for c in np_.keys() & nq.keys()]
        return False

    def apart(self, a: int, b: int) -> float:
        """How much the outcomes of two states differ in sum."""
        ca, cb, n, m = self.count[a], self.count[b], self.total[a], self.total[b]
        return sum(abs(ca.get(c, 0) / n - cb.get(c, 0) / m) for c in ca.keys() | cb.keys())

    def fold(self, into: int, tree: int) -> list[int]:
        """Adds the counts of a subtree to the states that read the same; the states that got a new way out."""
        stack, grown = [(into, tree)], []
        while stack:
            p, q = stack.pop()
            self.total[p] += self.total[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    stack.append((self.next[p][c], t))
                else:
                    self.next[p][c] = t
                    grown.append(p)
        return grown

    def merge_states(self, bound: float) -> None:
        """Walks from the start, shorter ways first: a state next to the settled ones merges with the one it is least apart
        from of those it agrees with, or is settled."""
        settled, place = [0], {0}
        todo: list[tuple[int, str, int, str]] = []

        def open_ways(p: int) -> None:
            for c, t in self.next[p].items():
                if t not in place:
                    heapq.heappush(todo, (len(self.access[t]), self.access[t], p, c))

        open_ways(0)
        while todo:
            _, _, p, c = heapq.heappop(todo)
            q = self.next[p][c]
            if q in place:
                continue
            agreeing = [r for r in settled if not self.differ(r, q, bound)]
            if not agreeing:
                settled.append(q)
                place.add(q)
                open_ways(q)
                continue
            r = min(agreeing, key=lambda r: (self.apart(r, q), r))
            self.next[p][c] = r
            for g in set(self.fold(r, q)) & place:
                open_ways(g)
        number = {q: i for i, q in enumerate(settled)}
        self.next = [{c: number[t] for c, t in self.next[q].items()} for q in settled]
        self.count, self.total = [self.count[q] for q in settled], [self.total[q] for q in settled]
        del self.access
        self.smooth()

    def smooth(self) -> None:
        """``step``: for each state and character (ln P, state after). A state's outcomes are mixed with all states' and with
        characters at random; where no way leaves, a run goes on as after that character at the start."""
        every = {c: sum(k.get(c, 0) for k in self.count) for c in (*ALPHABET, END)}
        n = sum(every.values())
        ground = {c: GROUND * (k / max(n, 1) + 1 / len(every)) / 2 for c, k in every.items()}
        self.step = []
        for k, t, ways in zip(self.count, self.total, self.next, strict=True):
            p = {c: (1 - GROUND) * k.get(c, 0) / max(t, 1) + ground[c] for c in ground}
            self.step.append({c: (math.log(p[c]), ways.get(c, self.next[0].get(c, 0))) for c in ground})

    def ln_likelihood(self, word: str) -> float:
        at, total = 0, 0.0
        for c in word:
            ln, at = self.step[at][c]
            total += ln
        return total + self.step[at][END][0]


class Ordinary:
    """Words by an automaton, without their case, and numbers, joined by separators or outright."""

    def __init__(self, words: Iterable[str]):
        self.words = Automaton(sorted({w.lower() for w in words}))

    def ln_likelihood(self, run: str) -> float:
        total, joined = ENDS, False
        for piece in PIECE.findall(run):
            c = piece[0]
            if not c.isalnum():
                total, joined = total + PARTED, False
                continue
            total += JOINED if joined else 0.0
            total += DIGIT * len(piece) if c.isdigit() else CASED + self.words.ln_likelihood(piece.lower())
            joined = True
        return total


class Formats:
    """Automata of credential kinds, and the grammar of ordinary runs."""

    def __init__(self, examples: dict[str, list[str]], ratio: float = RATIO):
        known = {kind: sorted(set(words)) for kind, words in sorted(examples.items()) if words}
        self.kinds = [Automaton(words) for kind, words in known.items() if kind != "other"]
        self.other = Ordinary(known.get("other", []))
        self.ratio, self.verdicts = ratio, {}

    def gain(self, run: str) -> float:
        """ln of the likelihood ratio of the nearest credential format to what is ordinary."""
        at_random = -(len(run) + 1) * math.log(len(ALPHABET) + 1)
        return max([at_random, *(a.ln_likelihood(run) for a in self.kinds)]) - self.other.ln_likelihood(run)

    def is_secret(self, run: str) -> bool:
        found = self.verdicts.get(run)
        if found is None:
            if len(self.verdicts) > KNOWN_RUNS:
                self.verdicts.clear()
            found = self.verdicts[run] = bool(self.kinds) and self.gain(run) >= self.ratio
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of a text's secrets, by start, then kind."""
        base, short = patterns(text or "")
        more = [(s, e, "format") for s, e, v in candidates(text or "", base, short) if self.is_secret(v)]
        return sorted([(s, e, k) for s, e, k, _ in base] + more, key=lambda x: (x[0], KINDS.index(x[2])))


def examples(docs: DataFrame, text: str = "text", labelled: int = EXAMPLES, ordinary: int = ORDINARY) -> DataFrame:
    """(kind, value): distinct examples of each kind, as many as asked for, drawn by hash over all texts.

    The draw takes the values of least hash of each of DRAWS parts, so no kind meets in one task. A task names the values
    of least hash it met, at most as many as are asked for in all, so what is shuffled is bounded by tasks, not by texts.
    """
    most = {k: labelled for k in KINDS[:3]} | {"other": ordinary}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[str, int]] = {k: {} for k in most}

        def least(kind: str) -> None:
            parts: dict[int, int] = {}
            named = {}
            for v, h in sorted(held[kind].items(), key=lambda x: (x[1], x[0])):
                n = parts[h % DRAWS] = parts.get(h % DRAWS, 0) + 1
                if n <= -(-most[kind] // DRAWS):
                    named[v] = h
            held[kind] = named

        for t in (t for batch in batches for block in blocks(batch, "t") for t in block["t"] if t):
            base, _ = patterns(t)
            met = [(k, v) for _, _, k, v in base if len(v) <= EXAMPLE_CHARS and set(v) <= LETTERS]
            taken, free = [(s, e) for s, e, *_ in base], []
            if taken:  # words inside a match are no ordinary ones
                free = [m[0] for m in WORD.finditer(t) if not any(s < m.end() and m.start() < e for s, e in taken)]
            met += [("other", w) for w in {w.lower() for w in free or WORD.findall(t)} if w not in held["other"]]
            for kind, v in met:
                held[kind][v] = xxhash.xxh3_64_intdigest(v.encode()) >> 1
            for kind in held:
                if len(held[kind]) > 20 * most[kind]:
                    least(kind)
        for kind in held:
            least(kind)
            if held[kind]:
                yield pd.DataFrame({"kind": kind, "value": list(held[kind]), "h": list(held[kind].values())})

    found = docs.select(F.col(text).cast("string").alias("t")).mapInPandas(run, "kind string, value string, h long").distinct()
    each = F.coalesce(*[F.when(F.col("kind") == k, -(-n // DRAWS)) for k, n in most.items()])
    within = Window.partitionBy("kind", F.pmod(F.col("h"), F.lit(DRAWS))).orderBy("h", "value")
    return found.withColumn("r", F.row_number().over(within)).where(F.col("r") <= each).select("kind", "value")


LETTERS = frozenset(ALPHABET)


def learn(docs: DataFrame, text: str = "text", labelled: int = EXAMPLES, ordinary: int = ORDINARY) -> Formats:
    """Infers the automata; what reaches the driver is bounded by the numbers of examples and EXAMPLE_CHARS."""
    out: dict[str, list[str]] = {}
    for r in examples(docs, text, labelled, ordinary).collect():
        out.setdefault(r["kind"], []).append(r["value"])
    return Formats(out)


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, formats: Formats | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id) with n_assign, n_access, n_hex, base_sha256, spans and at of every whole text.

    Spans count code points, end exclusive; that of an assignment is its whole match. Null and empty texts have none.
    Without labelled examples no automaton is inferred and only base spans remain. Repeated rows are scanned each for
    itself; an empty table gives an empty one. Only ``text`` and ``keep`` are read. ``formats`` (default: learned from
    ``docs``) may come from another table.
    """
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    known = docs.sparkSession.sparkContext.broadcast(formats or learn(docs, text))
    extra = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, at array<struct<s: int, e: int, kind: string>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [extra])
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = known.value
        named = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        for block in (b for batch in batches for b in blocks(batch, "__text")):
            rows = []
            for every in map(model.spans, block["__text"]):
                own = [x for x in every if x[2] != "format"]
                rows.append((*(sum(k == kind for _, _, k in own) for kind in KINDS[:3]), hashlib.sha256(named(own).encode()).hexdigest(), named(every), [dict(zip(("s", "e", "kind"), x, strict=True)) for x in every]))
            yield pd.concat([block.drop(columns="__text").reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return kept.mapInPandas(run, schema)


def redact(text: str | None, spans, mark: str = "[secret]") -> str | None:
    """The text with spans (start, end, ...), which may overlap, replaced by a mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, *_ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all its columns, with the secrets of ``text`` replaced by a mark; other texts stay as they are.

    One scan infers the formats, a second finds and replaces; neither shuffles texts. Null and empty texts stay, repeated
    rows are treated alike, and an empty table stays empty.
    """
    known = docs.sparkSession.sparkContext.broadcast(learn(docs, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = known.value
        for batch in batches:
            yield batch.assign(**{text: [redact(t, model.spans(t)) for t in batch[text]]})

    return docs.mapInPandas(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("at")
