"""Corpus operators against brute-force versions, and on odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from pagequarry.llm import bpe, decontaminate, html_text, jaccard, language, lm, quality, secrets, token_counts, warc
from pagequarry.llm.common import new_path

SMALL = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 30000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, sig string"
ODD = [
    (1, None, "en", "a", 0, "x", "y"),
    (2, "", None, "a", 0, None, None),
    (3, " \n\t ", "en", None, 4, "x", "y"),
    (4, LONG, "en", "a", len(LONG), "x", "y"),
    (5, 'the token = "0123456789abcdef0123" and password: hunter2hunter2 here\nthe same line\nthe same line', "en", "a", 1, "x", "y"),
    (5, 'the token = "0123456789abcdef0123" and password: hunter2hunter2 here\nthe same line\nthe same line', "en", "a", 1, "x", "y"),
    (None, "a row that has no id but has words enough to be a small text of its own, so it stays", "fr", "b", 1, "x", "y"),
    (7, "one <|endoftext|> two  three\n\n four été \U0001f600", "en", "b", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").limit(120).cache()


def reference_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    return tok, [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_bpe_round_trip(spark, odd, none, docs):
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    for df in (odd, docs):
        rows = bpe.encode(df, path, keep=["doc_id", "text"]).collect()
        tok, ids = reference_ids([r["text"] for r in rows])
        for r, e in zip(rows, ids, strict=True):
            assert r["n_tokens"] == len(e)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(none, path).count() == 0


def test_token_counts_and_cache(spark, odd, none):
    path, cache = bpe.tokenizer_path("byte_bpe_50k.json"), new_path(spark, "test-cache")
    first = token_counts.count_tokens(odd, path, cache, keep=["doc_id", "text"]).collect()
    stored = token_counts.read_cache(spark, cache).count()
    _, ids = reference_ids([r["text"] for r in first])
    assert [r["n_tokens"] for r in first] == [len(e) for e in ids] and len(first) == len(ODD)
    token_counts.count_tokens(odd, path, cache).collect()
    assert token_counts.read_cache(spark, cache).count() == stored == len({t[1] or "" for t in ODD})
    assert token_counts.count_tokens(none, path, cache).count() == 0


def test_piece_model_counts(spark, docs):
    path = bpe.tokenizer_path("piece_bpe_32k.model")
    assert min(r["n_tokens"] for r in token_counts.count_tokens(docs, path, new_path(spark, "test-cache")).collect()) > 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x"), (2, "http://b/\n", "<p>x"), (3, None, None), (4, "u", ""), (None, "v", "é" * 70000), (2, "http://b/", "<p>x")], "page_id long, url string, html string")
    folder = new_path(spark, "test-warc")
    got = warc.read_indexed(warc.archive(pages, folder, roll_bytes=1000), f"{folder}/records").collect()
    by = sorted((r["payload_bytes"], -1 if r["page_id"] is None else r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert [b[:2] for b in by] == [(0, 3), (0, 4), (4, 1), (4, 2), (4, 2), (140000, -1)]
    assert [b[2:] for b in by if b[1] in (1, 3, 4)] == [("revisit", 4), ("response", None), ("revisit", 2)]
    assert sorted(b[2] for b in by if b[1] == 2) == ["response", "revisit"]
    empty = new_path(spark, "test-warc")
    assert warc.read_indexed(warc.archive(pages.limit(0), empty), f"{empty}/records").count() == 0


def test_warc_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    done = con.execute(warc.OP1_SQL)
    got = warc.op1_warc(spark, SMALL)
    assert got.columns == [c[0] for c in done.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(done.fetchall(), key=str)


def test_warc_rolls_by_records(spark):
    pages = spark.createDataFrame([(k, None, None, k, "x") for k in range(25)], "page_id long, url string, html string, file long, digest string").coalesce(1)
    folder = new_path(spark, "test-warc")
    manifest = warc.archive(pages, folder)
    assert manifest.count() == 1
    rows = warc.write_monolithic(pages, f"{folder}/many", roll_records=10)
    assert sorted(r["count"] for r in rows.groupBy("file").count().collect()) == [5, 10, 10]


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_against_all_pairs(spark, size, percent):
    import random

    rng = random.Random(size)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 12, 60, 150)))] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(9):
            w = list(b)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    sets, root = [sets_of(t, size) for _, t in rows], list(range(len(rows)))
    for _ in rows:  # labels spread until none changes
        before = list(root)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))}


def test_jaccard_odd_rows(odd, none):
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_groups(odd, 3, 90).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (None, None), (7, 7)], key=str)
    assert jaccard.jaccard_groups(none, 3, 90).count() == 0


def test_quality_counts(odd, none, docs):
    for df in (odd, docs):
        for r in quality.judge(df, keep=["doc_id", "text"]).collect():
            t = r["text"] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            n, covered = Counter(wins), set()
            for k, x in enumerate(wins):
                if n[x] > 1:
                    covered.update(range(k, k + 8))
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t))
            assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
            assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0


def test_decontamination_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    done = con.execute(decontaminate.OP9_SQL)
    names = [c[0] for c in done.description]
    assert sorted(map(tuple, decontaminate.op9_decontamination(spark, SMALL).select(*names).collect())) == sorted(done.fetchall())


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Same LINE"), (4, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (5, "same line")], "item_id long, text string")
    got = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(odd, items).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 119999, 1), (5, 4, 2), (None, 0, 0), (7, 0, 0)}
    # terms that go to the texts in several parts find the same
    assert got == {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(odd, items, most=2).collect()}
    assert decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(none, items).count() == 0


def test_proximity(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a x x x x x x b")], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("b",), ("d",)], "term string")
    index = decontaminate.build_index(decontaminate.split_texts(texts, "doc_id", "text"), terms)
    pairs = spark.createDataFrame([("a", "b"), ("a", "d")], "a string, b string")
    assert sorted((r["ref"]["id"], r["b"], r["b_pos"]) for r in decontaminate.proximity(index, pairs, 2, 3).collect()) == [(1, "b", 1), (1, "d", 3)]


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in language.op6_language_id(spark, SMALL).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    got = [(r["lang_pred"], r["score"]) for r in language.identify(odd, language.learn(docs)).collect()]
    assert got[0] == got[1] == got[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got)
    assert language.learn(none) == {} and language.identify(none, {}).count() == 0


def test_language_by_brute_force(docs):
    """Distances by the definition: each n-gram of the text's own profile adds how far its rank is from the language's."""
    rows = [(r["text"], r["lang"]) for r in docs.collect() if r["text"] and r["lang"]]
    grams = {}
    for t, name in rows[::2]:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            padded = f" {w} "
            grams.setdefault(name, Counter()).update(g for n in (1, 2, 3, 4) for g in (padded[k : k + n] for k in range(len(padded) - n + 1)) if g != " ")
    rank = lambda c: sorted(c, key=lambda g: (-c[g], g))[: language.PROFILE]
    profiles = {name: rank(c) for name, c in grams.items()}
    scorer = language.Scorer(profiles)
    for t in [t for t, _ in rows] + ["a", "\u00bd", "x\u00bdy", "\u00e9\u00e9 ab"]:
        own = Counter()
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            padded = f" {w} "
            own.update(g for n in (1, 2, 3, 4) for g in (padded[k : k + n] for k in range(len(padded) - n + 1)) if g != " ")
        if not own:
            assert scorer.score(t) == ("und", 0.0)
            continue
        mine = rank(own)
        far = {name: sum(abs(p.index(g) - k) if g in p else language.PROFILE for k, g in enumerate(mine)) / (language.PROFILE * len(mine)) for name, p in profiles.items()}
        first, second = sorted(far.values())[:2]
        got = scorer.score(t)
        assert got[0] == min(far, key=lambda n: (far[n], n)) and got[1] == pytest.approx(0 if second <= 0 else min(1, max(0, (second - first) / second)))


def test_language_ties_and_signs_of_numbers():
    same = {"b": ["a", "x"], "a": ["a", "x"]}
    assert language.Scorer(same).score("a x") == ("a", 0.0)
    assert language.Scorer(same).score("\u00bd \u00b2 12 _") == ("und", 0.0) and language.words_of("ab\u00bdCd 1 ef") == Counter({"ab": 1, "cd": 1, "ef": 1})


def test_quality_beside_clashing_columns(spark):
    rows = [(1, "some words here and there", 5, "x", "y"), (2, None, 6, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long, symbols string, prose string")
    got = quality.judge(df, keep=["doc_id", "length", "symbols", "prose"]).collect()
    assert sorted((r["doc_id"], r["length"], r["symbols"], r["prose"]) for r in got) == [(1, 5, "x", "y"), (2, 6, "x", "y")]


def test_quality_estimate_by_brute_force(docs):
    """The same expectation maximisation, vote by vote, in plain Python."""
    rows = quality.measure(docs).collect()
    names = list(quality.RULES)
    votes = []
    for r in rows:
        env = {k: r[k] for k in r.__fields__ if k != "doc_id"}
        test = lambda rule: bool(rule) and eval(rule.replace("AND", "and").replace("OR", "or"), {}, env)  # noqa: B023, E731, S307
        votes.append([-1 if test(quality.RULES[n][0]) else 1 if test(quality.RULES[n][1]) else 0 for n in names])
    model = {"good": quality.FIRST_GOOD} | {n: dict(quality.FIRST) for n in names}

    def good(v):
        odds = math.log(model["good"] / (1 - model["good"]))
        for n, x in zip(names, v, strict=True):
            has = {"bad": quality.RULES[n][0], "good": quality.RULES[n][1]}
            p = {(k, y): model[n][k, y] if has[k] else 0.0 for k in has for y in ("good", "bad")}
            a, b = {-1: (p["bad", "good"], p["bad", "bad"]), 1: (p["good", "good"], p["good", "bad"])}.get(x, (1 - p["bad", "good"] - p["good", "good"], 1 - p["bad", "bad"] - p["good", "bad"]))
            odds += math.log(a / b) if a and b else 0.0
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ITERATIONS):
        ps = [good(v) for v in votes]
        of = {"good": sum(ps), "bad": len(ps) - sum(ps)}
        new = {"good": min(0.995, max(0.05, of["good"] / len(ps)))}
        for i, n in enumerate(names):
            new[n] = {}
            for (k, y), (lo, hi) in quality.BOUNDS.items():
                at = {"bad": -1, "good": 1}[k]
                s = sum((p if y == "good" else 1 - p) for p, v in zip(ps, votes, strict=True) if v[i] == at)
                new[n][k, y] = min(hi, max(lo, (s + quality.FIRST[k, y]) / (of[y] + 1)))
        model = new
    got = {r["doc_id"]: (r["quality"], r["kept"]) for r in quality.judge(docs).collect()}
    for r, v in zip(rows, votes, strict=True):
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert got[r["doc_id"]][0] == pytest.approx(good(v), abs=1e-6)
        assert got[r["doc_id"]][1] == (not failed and good(v) >= quality.KEEP_AT)


def test_jaccard_regions_above_a_cell():
    """The cut by pivots with windows, on blocks with more sets than a cell, against all pairs."""
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(6):
        sets = []
        for _ in range(20):
            base = rng.sample(range(2000), rng.choice((10, 40)))
            for _ in range(rng.choice((3, 12))):
                s = set(base)
                for _ in range(rng.randrange(0, 3)):
                    s.discard(rng.choice(base))
                    s.add(rng.randrange(2000))
                sets.append(np.array(sorted(s), dtype=np.int64))
        assert len(sets) > 2 * jaccard.CELL
        found = jaccard.Region(sets, list(range(len(sets))), 80).join()
        root = list(range(len(sets)))

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        def united(pairs, root=root):
            root[:] = range(len(root))
            for a, b in pairs:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
            return [top(i) for i in range(len(root))]

        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert all(p in pairs or (p[1], p[0]) in pairs for p in found) and united(found) == united(pairs)


def test_language_four_grams():
    assert sorted(language.word_grams("abc")) == sorted([*"abc", " a", "ab", "bc", "c ", " ab", "abc", "bc ", " abc", "abc "])


def test_secret_spans(odd, none):
    rows = secrets.find_secrets(odd, keep=["doc_id", "text"]).collect()
    pattern = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in rows:
        t = r["text"] or ""
        want = [(m.start(), 0, m.end(), "assign") for m in pattern.finditer(t) if len(m[2]) >= 12] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(want)).encode()).hexdigest()
    assert secrets.find_secrets(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(odd).collect()}
    assert clean[5].startswith("the [secret]\" and [secret] here") and clean[4] == LONG and clean[1] is None


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def key(rng, length, of=LETTERS + LETTERS.upper() + DIGITS):
    return "".join(rng.choice(of) for _ in range(length))


@pytest.fixture(scope="module")
def formats(spark):
    return secrets.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_unseen_credentials_are_caught(formats):
    import random

    rng = random.Random(5)
    shapes = {
        "hex": lambda: key(rng, 40, "0123456789abcdef"), "prefixed": lambda: "ghp_" + key(rng, 36), "live": lambda: "sk_live_" + key(rng, 24), "web": lambda: "eyJhbGciOiJIUzI1NiJ9." + key(rng, 40) + "." + key(rng, 43),
        "short": lambda: key(rng, 12), "lower": lambda: key(rng, 16, LETTERS + DIGITS), "letters": lambda: key(rng, 24, LETTERS), "upper": lambda: key(rng, 32, "0123456789ABCDEF"),
    }
    for name, shape in shapes.items():
        found = [formats.spans(f"we put {k} here") == [(7, 7 + len(k), "hex" if name == "hex" else "format")] for k in (shape() for _ in range(200))]
        assert sum(found) >= 0.9 * len(found)


def test_ordinary_runs_are_left_alone(spark, formats):
    ordinary = ["characteristically", "INTERNATIONALISATION", "release-candidate-notes-2024", "v1.2.3-beta4", "97.51.17.173", "build-20240101-rc12", "2024-01-01T00", "getElementById", "1234567890", "20240101120000", "one_two_three", "someone@mail7.example.com"]
    assert [w for w in ordinary if formats.spans(w)] == []
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(k == "format" for t in texts for _, _, k in formats.spans(t)) <= 2


def test_spans_of_method(spark, formats):
    import random

    rng = random.Random(7)
    long, short = key(rng, 20), "xK9" + key(rng, 7)
    joined = "0123456789abcdef0" + key(rng, 20, LETTERS.upper() + "ghijk")
    docs = spark.createDataFrame([(1, f"see {long}. and password: {short}, id {joined};"), (2, None), (3, "no secret in these ordinary words")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs, formats=formats).collect()}
    text = docs.first()["text"]
    at = {v: text.index(v) for v in (long, short, joined)}
    want = sorted([(at[long], "format", at[long] + 20), (at[joined], "hex", at[joined] + 17), (at[joined], "format", at[joined] + len(joined))] + [(at[short], "format", at[short] + 10)] * formats.is_secret(short), key=lambda x: (x[0], secrets.KINDS.index(x[1])))
    assert got == {1: ",".join(f"{k}:{s}:{e}" for s, k, e in want), 2: "", 3: ""}
    assert secrets.redact(text, formats.spans(text)).count("[secret]") == 2 + formats.is_secret(short)
    # without labelled examples nothing is inferred, and base spans alone remain
    unlabelled = spark.createDataFrame([(1, f"see {long} and more words")], "doc_id long, text string")
    assert secrets.find_secrets(unlabelled).first()["spans"] == ""


def test_examples_are_the_least_by_hash(spark):
    import random

    rng = random.Random(9)
    values = [key(rng, 20) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"token={v} and words{'' if i % 2 else ' more'}") for i, v in enumerate(values + values[:50])], "doc_id long, text string").repartition(7)
    drawn = secrets.examples(docs, labelled=40, ordinary=2).collect()
    import xxhash

    parts = {}
    for v in sorted(set(values), key=lambda v: (xxhash.xxh3_64_intdigest(v.encode()) >> 1, v)):
        parts.setdefault((xxhash.xxh3_64_intdigest(v.encode()) >> 1) % secrets.DRAWS, v)
    assert {r["value"] for r in drawn if r["kind"] == "assign"} == set(parts.values())
    assert {r["value"] for r in drawn if r["kind"] == "other"} == {"and", "words", "more"}


def test_merging_keeps_the_counts():
    a = secrets.Automaton(["ab", "aab", "ab", "b", "aaab"] * 40)
    assert sum(k.get(secrets.END, 0) for k in a.count) == 200 and all(t == sum(k.values()) for t, k in zip(a.total, a.count, strict=True))
    p = lambda w: math.exp(a.ln_likelihood(w))
    assert p("ab") > 100 * p("ba") and 0 < sum(p(x + y) for x in secrets.ALPHABET for y in secrets.ALPHABET) < 1


def test_html_blocks(spark):
    page = '<html><head><title>t</title></head><body><nav>menu</nav><div class="cookie notice">no</div><article><h1>Head</h1><p>One &amp;  two<br>three<p>Four<script>var x="</p>"</script></article><div id="comments"><p>me too</div><footer>f</footer>'
    rows = [(k, f"http://h/{k}", page.replace("Four", f"Four {k} words")) for k in range(4)] + [(9, None, None), (10, "odd", ""), (11, "http://z/", "plain text < here")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Head\n\nOne & two three\n\nFour 2 words" and got[9] == got[10] == "" and got[11] == "plain text < here"


def odd_pages(n, rare=0):
    """Pages with neutral marks: a menu and a lead of its own on all, a notice on two thirds; of these ``rare`` of another layout."""
    menu = "<div class=x1><div class=q><a>Home</a><a>All our stories</a></div>"
    notice = "<div class=x2>This site keeps your data for a year</div>"
    common = [menu + notice * (k % 3 > 0) + f"<div class=x3>Lead{k}</div><div class=x4><p>" + " ".join(f"w{k * 7 + j}" for j in range(40)) + "</p></div></div>" for k in range(n - rare)]
    other = [f"<section class=y1><div class=y2>Follow this other page at home</div><p>Story{k} of{k} its{k} kind</p></section>" for k in range(rare)]
    return [f"<html><body>{b}</body></html>" for b in common + other]


def body_of(k):
    return f"Lead{k}\n\n" + " ".join(f"w{k * 7 + j}" for j in range(40))


def test_html_classes_decide(spark):
    pages = odd_pages(16) + ["<html><body><b>an odd page</b></body></html>"]
    template = html_text.host_template(pages)
    for k in range(16):
        assert html_text.extract(pages[k], template, names=False) == body_of(k)
    assert html_text.extract(pages[16], template) == "an odd page"


def test_html_template_alone_on_neutral_pages():
    """No tag or mark says what a part is: the menu has more words than the article and varies, adverts come from a few."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    adverts = [" ".join(word() for _ in range(6)) for _ in range(4)]
    pages, want = [], []
    for k in range(24):
        menu = "".join(f"<div class=c3><a href=/{word()}>{word()} {word()} {word()}</a></div>" for _ in range(12))
        parts = [" ".join(word() for _ in range(rng.choice((3, 8)))) for _ in range(3)]
        pages.append(f"<html><body><div class=c1><div class=c2>{menu}</div><div class=c4><h2>{parts[0]}</h2><div class=c5><p>{parts[1]}</p><p>see{k} <a href=x>{word()}</a> {parts[2]}</p></div></div><div class=c6>{adverts[k % 4]}</div><div class=c7>All rights are kept {k}</div></div></body></html>")
        link = re.search(r"<a href=x>(\w+)</a>", pages[-1])[1]
        want.append(f"{parts[0]}\n\n{parts[1]}\n\nsee{k} {link} {parts[2]}")
    template = html_text.host_template(pages)
    got = [html_text.extract(p, template, names=False) for p in pages]
    assert [g.removesuffix(f"\n\n{k}") for k, g in enumerate(got)] == want
    assert sum(g != html_text.extract(p, None, names=False) for g, p in zip(got, pages, strict=True)) == len(pages)


def test_html_template_alone_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    both = [{r["page_id"]: r["text"] for r in html_text.extract_text(pages, names=n).collect()} for n in (True, False)]
    own = {r["page_id"]: html_text.extract(r["html"], None, names=False) for r in pages.collect()}
    hosts = {r["host"] for r in pages.select(html_text.host_of(pages["url"]).alias("host"), "html").distinct().groupBy("host").count().where(f"count >= {html_text.SURE_PAGES}").collect()}
    deep = [r["page_id"] for r in pages.select("page_id", html_text.host_of(pages["url"]).alias("host")).collect() if r["host"] in hosts]
    assert sum(both[0][k] == both[1][k] for k in deep) >= 0.5 * len(deep) > 0
    assert sum(both[1][k] != own[k] for k in deep) >= 0.95 * len(deep)


def test_html_main_part_beats_names():
    """A mark around everything, and one on the article itself, would set it aside by name."""
    pages = [f"<html><body><div class='layout with-sidebar'><div class=menu><a href=/{k}>Go to {k}</a></div><div class='share post'>" + "".join(f"<p>t{k} p{k} r{k * j}</p>" for j in range(9)) + f"<div class=comments>reply{k} by{k} someone{k}</div></div></div></body></html>" for k in range(12)]
    assert html_text.extract(pages[3], html_text.host_template(pages)) == "\n\n".join(f"t3 p3 r{3 * j}" for j in range(9))
    assert html_text.extract(pages[3], None) == ""


def test_html_copies_keep_their_text():
    """Pages that share one article are no template of it."""
    same = "<p>" + " ".join(f"s{j}" for j in range(50)) + "</p>"
    pages = [f"<html><body><article><i>{k}</i>{same if k < 14 else '<p>own ' + str(k) + ' ' + ' '.join(f'o{k}x{j}' for j in range(50)) + '</p>'}</article></body></html>" for k in range(20)]
    template = html_text.host_template(pages)
    assert all(" ".join(f"s{j}" for j in range(50)) in html_text.extract(p, template) for p in pages[:14])


def test_html_vectors_by_brute_force():
    pages = odd_pages(30, rare=9)
    read = html_text.page_keys(pages)
    got = html_text.vectors(read)
    words, having = {}, Counter()
    for elements, texts in read.values():
        having.update(elements.keys())
        for path, nodes in texts.items():
            for ws in nodes:
                padded = ["", *ws, ""]
                for k in range(len(ws)):
                    words.setdefault((path, tuple(padded[k : k + 3])), []).append(id(texts))
    often = {t: len(set(at)) for t, at in words.items() if having[t[0]] >= html_text.SURE_PAGES and len(set(at)) >= html_text.LEAST_SUPPORT * having[t[0]]}
    assert {t: n for t, (n, _) in got.items() if t[1]} == often
    assert all(n == having[t[0]] for t, (n, _) in got.items() if not t[1])


def test_html_templates_of_all_pages(spark):
    import json

    pages = odd_pages(240, rare=12)
    rows = [(k, f"http://h/{k}", p) for k, p in enumerate(pages + pages[:20])] + [(900 + k, f"http://small{k % 2}/", p) for k, p in enumerate(odd_pages(40))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: json.loads(r["template"]) for r in html_text.templates(df, 32).collect()}
    assert got == {h: html_text.host_template([p for _, u, p in rows if u.split("/")[2] == h]) for h in ("h", "small0", "small1")}
    texts = {r["page_id"]: r["text"] for r in html_text.extract_text(df, 32).collect()}
    assert all(texts[k] == body_of(k) for k in range(228))
    assert all(texts[228 + k] == f"Story{k} of{k} its{k} kind" for k in range(12))


def test_html_texts_that_come_again_in_another_bucket(spark):
    """A notice's text comes twice among a host's pages, mostly not in one bucket: the template is that of all pages at once."""
    import json

    pages = [f"<html><body><div class=c1><p>t{k} p{k} r{k} q{k} s{k} u{k}</p></div><div class=c2><p>see n{k // 2} m{k // 2}</p></div></body></html>" for k in range(64)]
    df = spark.createDataFrame([(k, "http://h/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    want = html_text.host_template(pages)
    assert want["beside"]
    for bucket in (4, 16, 64):
        assert [json.loads(r["template"]) for r in html_text.templates(df, bucket).collect()] == [want]


def test_html_odd_rows(spark):
    long = "<article><p>" + "many words " * 100_000 + "</p></article>"
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "http://a/", "", "y"), (3, "not an address", "<p>one", None), (None, "http://a/", "<article>two</article>", "z"), (5, "http://a/", long, "z"), (6, "http://a/", "<div><span>a<b>c</span>d</b><", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()]
    want = [(1, None, "", 0), (1, None, "", 0), (2, "http://a/", "", 0), (3, "not an address", "one", 3), (None, "http://a/", "two", 3), (5, "http://a/", long[12:-15].strip(), 1_099_999), (6, "http://a/", "acd<", 4)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_lm_base_score(spark, none):
    rows = {r["doc_id"]: r for r in lm.op10_lm_scoring(spark, SMALL).collect()}
    docs = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b" "] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    c = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n = sum(c.values())
    den = math.log10(n + 0.5 * (len(c) + 1))
    for i, ws in docs.items():
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10(c[w] + 0.5) - den for w in ws), rel=1e-9)
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert rows[i]["score"] < 0


def test_lm_is_normalised():
    import numpy as np

    net = lm.LogBilinear(np.full(lm.UNITS, 1 / lm.UNITS))
    units = np.arange(lm.UNITS, dtype=np.int32)
    before = np.full((lm.CONTEXT, lm.UNITS), 3, dtype=np.int32)
    assert np.sum(10 ** net.log10(units, before)) == pytest.approx(1, abs=1e-4)


def test_lm_grows_with_the_vocabulary():
    import numpy as np

    assert lm.UNITS >= 512 and lm.DIM >= 24 and lm.NOISE >= 64
    frequent = [(b"w%d" % i, 1000 - i) for i in range(1000)]
    few, many = (lm.Words(frequent, 10**7, distinct, {}) for distinct in (1000, 810_000))
    assert (few.n_units, many.n_units) == (lm.UNITS, 900 + lm.SHARED) and many.units[898] == 899 - 1 and few.units[898] >= few.own
    net = lm.LogBilinear(many.unigram())
    units, rng = np.arange(many.n_units, dtype=np.int32), np.random.default_rng(1)
    for last in (3, 931, 932):  # 932: before the text
        before = np.full((lm.CONTEXT, many.n_units), last, dtype=np.int32)
        assert np.sum(10 ** net.log10(units, before)) == pytest.approx(1, abs=1e-4)
    at = rng.integers(0, many.n_units, 5000).astype(np.int32)
    before = lm.contexts(at, np.array([0, 100]), many.n_units)
    got = net.log10(at, before)
    vin, vout, bias, maps = net.params
    for i in (0, 1, 100, 101, 4999):
        s = sum(vin[before[k, i]] @ maps[k] for k in range(lm.CONTEXT)) @ vout.T + bias
        assert got[i] == pytest.approx((s[at[i]] - np.log(np.exp(s).sum())) / math.log(10), abs=1e-4)


def test_lm_own_units_have_words(spark, monkeypatch):
    """The first words by count have units of their own also where the table's levels are cut short, and no unit is empty."""
    monkeypatch.setattr(lm, "TABLE_WORDS", 100)
    counts = [(b"w%03d" % k, 3 if k < 50 else 1) for k in range(700)] + [(lm.END, 9)]
    words = lm.learn_words(spark.createDataFrame(counts, "word binary, n long"))
    assert words.own == lm.UNITS - lm.SHARED and words.own_words == {w for w, _ in sorted(counts, key=lambda x: (x[0] != lm.END, -x[1], x[0]))[: words.own]}
    assert sum(n for n, _ in words.shared.values()) == 701 - words.own and lm.own_units(4 * lm.TABLE_WORDS**4) == 2 * lm.TABLE_WORDS**2
    few = lm.learn_words(spark.createDataFrame(counts[:20], "word binary, n long"))
    assert few.own == 21 and set(few.units.tolist()) == set(range(21))


def test_lm_odd_rows(odd, none):
    counted = lm.word_counts(odd)
    words = lm.learn_words(counted)
    got = lm.score(odd, counted, words, lm.fit(odd, words, rounds=1)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) for r in got)
    nothing = lm.word_counts(none)
    words = lm.learn_words(nothing)
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in lm.score(odd, nothing, words, lm.fit(none, words, rounds=1)).collect())


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_near_duplicates(rows):
    """Rows that stay, by all pairs: (doc_id, text) are vertices, of each component the least by doc_id, nulls last, stays."""
    vertices = list(dict.fromkeys((r["doc_id"], r["text"]) for r in rows))
    sets, root = [sets_of(t, 5) for _, t in vertices], list(range(len(vertices)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and root[i] != root[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    groups = {}
    for i, v in enumerate(vertices):
        if sets[i]:
            groups.setdefault(root[i], []).append(v)
    return groups, [v for i, v in enumerate(vertices) if not sets[i]]


def odd_documents(spark):
    import random

    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(6)]
    near = [t.replace(" ", "  ", 1) + " more" for t in texts]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    rows += [(3, near[0], "en", "a", 1), (3, near[0], "fr", "b", 2), (None, texts[4] + " end", "en", "a", 3), (None, near[5], None, None, None), (None, "a b c d e f", "en", "a", 4), (7, "a b c d e f", "en", "a", 4)]
    rows += [(20, None, "en", "a", None), (20, None, "en", "a", None), (21, "", "en", "a", 0), (None, " ", "en", "a", 1)]
    return spark.createDataFrame(rows, DOCUMENTS)


def test_near_duplicate_stage(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    got = corpus_pipeline.near_duplicate_stage(spark, docs.withColumn("n", docs["source"]), SMALL)
    assert got.columns == docs.columns
    groups, alone = plain_near_duplicates(docs.collect())
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    wordless = Counter((r["doc_id"], r["text"]) for r in docs.collect() if (r["doc_id"], r["text"]) in alone)
    assert {v: n for v, n in kept.items() if v in alone} == wordless
    for members in groups.values():
        stay = [v for v in members if kept[v]]
        assert len(stay) == 1 and kept[stay[0]] == 1
        assert (stay[0][0] is None, stay[0][0] or 0) == min((i is None, i or 0) for i, _ in members)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SMALL).count() == 0


def benchmark_windows(spark):
    items = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    return {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}


def holds(text, windows):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    sizes = {len(x) for x in windows}
    return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))


def test_decontamination_stage(spark):
    import corpus_pipeline

    bad = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(1, bad, "en", "a", 1), (1, "a clean text", "en", "a", 1), (None, "so they said: " + bad.upper(), "en", "a", 1), (None, "clean too", "en", "a", 1), (2, None, "en", "a", None), (3, "", "en", "a", 0), (4, bad, "en", "a", 1), (4, bad, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    windows = benchmark_windows(spark)
    got = corpus_pipeline.decontamination_stage(spark, docs.withColumn("ws", docs["source"]), SMALL)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([r for r in rows if not holds(r[1], windows)], key=str) and got.count() == 4
    assert corpus_pipeline.decontamination_stage(spark, docs.limit(0), SMALL).count() == 0


def test_secret_and_bpe_stages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(5, ODD[4][1], "en", "a", 9), (5, ODD[4][1], "en", "a", 9), (None, None, None, None, None), (6, "", "en", "a", 0), (7, LONG, "en", "a", len(LONG))], DOCUMENTS)
    got = corpus_pipeline.secret_stage(spark, docs.withColumn("length", docs["doc_id"]), SMALL)
    want = []
    for r in docs.collect():
        t = secrets.redact(r["text"], [(s, e) for s, e, *_ in secrets.base_spans(r["text"] or "")])
        want.append((r["doc_id"], t, r["lang"], r["source"], r["n_chars"] if t == r["text"] else len(t)))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    tok, ids = reference_ids([w[1] for w in want])
    coded = corpus_pipeline.bpe_stage(spark, spark.createDataFrame(want, DOCUMENTS), SMALL).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in coded) == sorted((str(w[0]), len(e), digest(",".join(map(str, e))), digest(tok.decode(e, skip_special_tokens=False))) for w, e in zip(want, ids, strict=True))
    empty = docs.limit(0)
    assert corpus_pipeline.secret_stage(spark, empty, SMALL).count() == corpus_pipeline.bpe_stage(spark, empty, SMALL).count() == corpus_pipeline.quality_stage(spark, empty, SMALL).count() == 0


def test_pipeline_stages(spark):
    """All stages over the small tables, each against a plain version of it on what it was given."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, given[-1], SMALL).cache()
        assert after.columns == docs.columns
        given.append(after)
    rows = [{r["doc_id"]: r for r in g.collect()} for g in given]
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert set(rows[1]) == {k for k, ok in judged.items() if ok}
    groups, alone = plain_near_duplicates(rows[1].values())
    assert set(rows[2]) == {min(i for i, _ in g) for g in groups.values()} | {i for i, _ in alone}
    windows = benchmark_windows(spark)
    assert set(rows[3]) == {i for i, r in rows[2].items() if not holds(r["text"], windows)}
    formats = secrets.learn(given[3])
    assert {i: r["text"] for i, r in rows[4].items()} == {i: secrets.redact(r["text"], formats.spans(r["text"])) for i, r in rows[3].items()}
    done = corpus_pipeline.run(spark, SMALL).collect()
    _, ids = reference_ids([rows[4][r["doc_id"]]["text"] for r in done])
    assert [r["n_tokens"] for r in done] == [len(e) for e in ids] and {r["doc_id"] for r in done} == set(rows[4])


def test_stage_tables_go(spark):
    import os

    from pagequarry.llm import common

    files = lambda: {d for d in os.listdir(common.new_path(spark, "x").removeprefix("file://").rpartition("/")[0]) if d.startswith("gone")}
    with common.scratch(spark):
        with common.scratch(spark):
            common.stage_table(spark.range(3), "gone-a")
            kept = common.stage_table(spark.range(3), "gone-b", keep=True)
        assert {d[:6] for d in files()} == {"gone-b"} and kept.count() == 3
    assert not files()
