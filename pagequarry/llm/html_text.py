"""Main-text extraction by equivalence-class template deduction.

Pages of a host come from templates. A token is a tag, or three words in a row of one text (its borders count as words),
together with the open elements around it; its occurrence vector says how often it stands in each page. Tokens with one
vector form a class, whether they stand once in every page, in some pages or several times; its words are constant if the
class is large enough and they stand in most pages that have the element around them. So classes nest by their elements:
a rare layout's or an optional part's words are weighed against the pages that have it. The order of words is held by the
tokens themselves, that of tags by the elements around.

What the template leaves open are its slots, and what fills a slot over all pages of the host says what it is. The words
that vary from page to page and are no links are the host's texts; the innermost part that holds most of them is the main
one, whatever it is called. Around it, a part whose words are links for the most part is a list of links, and one whose
text comes again on other pages is a notice; their slots are dropped, and so are constant words. All other slots are kept.

Names break ties only: elements whose tag or mark (class, id, role) is a menu's, an advert's and the like are set aside
where the template says nothing of them, never around the main part. A host with fewer than ``SURE_PAGES`` pages has no
template; there the names decide, and where a page has an article or main element with text, the text outside goes.

Templates are deduced from all pages of a host. Pages are dealt out by host, those of a host with more than ``BUCKET`` pages
in several buckets by content. A host in one bucket is deduced there. For the others, what fills the slots meets by a hash
of its text over all buckets, and a word frequent among all pages is frequent in some bucket, so the buckets name candidates, then count them
exactly, and the counts are added up.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks
from pagequarry.llm.common import stage_table, table

#: Pages of a host that are looked at together.
BUCKET = 64
#: A class is valid with so many tokens; its words, in so large a share of the pages that have the element around them.
LEAST_TOKENS, LEAST_SUPPORT = 3, 0.6
#: Words are dropped as constant only with so many pages as evidence, and as a whole text or in runs so long.
SURE_PAGES, CONSTANT_RUN = 8, 3
#: Share of a part's words that are links, from which it is a list of links; share of a block's own words that comes again
#: on other pages, from which it is a notice, if that is also so many times the share of the main part's words that do.
LINKED, AGAIN, CONTRAST = 0.6, 0.2, 4
#: Share of a host's varying words that the main part holds; share of a page's main part from which constant words stay.
MAIN, COPIED = 0.7, 0.5
#: Templates up to this number and size in characters go to every task; more are joined by host, with hot hosts salted.
BROADCAST_TEMPLATES, BROADCAST_CHARS = 20_000, 64_000_000
#: Pages a task remembers to have sent to the buckets.
SENT = 200_000

PIECE = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|iframe)\b[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|</?[A-Za-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^<]+|<""", re.DOTALL | re.IGNORECASE)
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: A start tag ends open elements of these names, as HTML lets their end tags be left out.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
for _name in BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "html", "body"}:
    ENDS.setdefault(_name, {"p"})
#: An element that ends only what was opened inside it.
SCOPES = frozenset("article aside blockquote body div footer form header li main nav ol section table td th ul".split())
STOPS = {name: SCOPES - ends for name, ends in ENDS.items()}
ASIDE = frozenset("nav footer aside form button select dialog head title menu label option".split())
#: Marks (class, id, role) of what is not the article.
ASIDE_MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|respond|disqus|complementary|contentinfo)(?:[\s_-]|$)", re.IGNORECASE)
TEXTS = frozenset(("article", "main"))
#: Elements that a main part can be, and those whose words are links.
PARTS = frozenset("article body div main section td center".split())
LINKS = frozenset("a button option label".split())


@lru_cache(maxsize=50_000)
def element(tag: str) -> tuple[str, str]:
    """Name of a tag, and its name with its marks."""
    name = NAME.match(tag)[1].lower()
    if "=" not in tag:
        return name, name
    marks = sorted((k.lower(), " ".join(v.strip("\"'").lower().split())) for k, v in MARKS.findall(tag))
    # longer numbers in marks tell instances apart, not kinds
    return name, name + "".join(f"[{k}={re.sub(r'[0-9]{2,}', '0', v)}]" for k, v in marks)


def parse(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """(kind, open elements, what): kinds are ``open``, ``text`` and ``break`` (a block's border)."""
    names: list[str] = []
    path: tuple[str, ...] = ()
    for m in PIECE.finditer(page):
        piece = m[0]
        if piece[0] != "<" or len(piece) == 1:
            yield "text", path, piece
        elif m[1] or piece[1] in "!?":
            continue
        elif piece[1] == "/":
            name = element(piece)[0]
            if names and names[-1] == name:
                names.pop()
                path = path[:-1]
            elif name in names:
                at = len(names) - 1 - names[::-1].index(name)
                if name not in SCOPES and any(n in SCOPES for n in names[at + 1 :]):
                    continue
                del names[at:]
                path = path[:at]
            if name in BLOCKS:
                yield "break", path, name
        else:
            name, key = element(piece)
            ends = ENDS.get(name)
            if ends:
                at = len(names)
                while at and names[at - 1] not in STOPS[name]:
                    at -= 1
                    if names[at] in ends:
                        del names[at:]
                        path = path[:at]
            if name in BLOCKS:
                yield "break", path, name
            if name == "br":
                yield "text", path, " "
            elif name in VOID:
                yield "open", path, key
            else:
                yield "open", path, key
                names.append(name)
                path = (*path, key)


def base(key: str) -> str:
    return key.partition("[")[0]


def set_aside(path: tuple[str, ...], main: tuple[str, ...] = ()) -> bool:
    """Whether some element around, below those of the main part, is of a kind, or has a mark, that is not the article's."""
    inside = any(base(key) in TEXTS for key in main)
    for key in path[len(main) :] if path[: len(main)] == main else [key for k, key in enumerate(path) if path[: k + 1] != main[: k + 1]]:
        name = base(key)
        if name in ASIDE or (name == "header" and not inside) or (name not in ("html", "body") and "[" in key and any(ASIDE_MARKS.search(v) for v in re.findall(r"=([^\]]*)\]", key))):
            return True
        inside = inside or name in TEXTS
    return False


Path = tuple[str, ...]
Token = tuple[Path, tuple[str, ...]]


def shingles(words: list[str]) -> Iterator[tuple[str, ...]]:
    """Three words in a row, each text's borders counting as words."""
    return zip(["", *words[:-1]], words, [*words[1:], ""], strict=True)


def read(page: str) -> tuple[Counter, dict[Path, list[list[str]]]]:
    """How often each element stands in a page, by path, and the texts' words at each path."""
    elements, texts = Counter({(): 1}), defaultdict(list)
    for kind, path, what in parse(page):
        if kind == "open":
            elements[(*path, what)] += 1
        elif kind == "text" and (words := (entities.unescape(what) if "&" in what else what).split()):
            texts[path].append(words)
    return elements, texts


Page = tuple[Counter, dict[Path, list[list[str]]]]


def mixed(page: int, n: int) -> int:
    """A hash of a page and a count; of all pages that have a token, their exclusive or stands for the token's vector."""
    x = (page ^ n * 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (2**64 - 1)
    return x ^ x >> 31


def candidates(pages: list[Page], least: int) -> set[Token]:
    """Words in enough of the pages that have their element, if so many have it, and the elements around them.

    Three words are frequent only if each of them is, so single words are counted first.
    """
    having: Counter = Counter()
    for elements, _ in pages:
        having.update(elements.keys())
    single: dict[Path, Counter] = defaultdict(Counter)
    for _, texts in pages:
        for path, nodes in texts.items():
            if having[path] >= least:
                single[path].update({w for ws in nodes for w in ws})
    counts: dict[Path, Counter] = defaultdict(Counter)
    for path, c in single.items():
        often = {w for w, n in c.items() if n >= LEAST_SUPPORT * having[path]}
        if often:
            often.add("")
            for _, texts in pages:
                if path in texts:
                    counts[path].update({three for ws in texts[path] if not often.isdisjoint(ws) for three in shingles(ws) if three[1] in often and three[0] in often and three[2] in often})
    return with_elements({(path, three) for path, c in counts.items() for three, n in c.items() if n >= LEAST_SUPPORT * having[path]})


def with_elements(words: set[Token]) -> set[Token]:
    return words | {(path[:k], ()) for path in {p for p, _ in words} for k in range(len(path) + 1)}


def page_keys(pages: list[str]) -> dict[int, Page]:
    """Pages by a hash of their content, read; equal pages are one."""
    return {int.from_bytes(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"): read(p) for p in set(pages)}


def vectors(pages: dict[int, Page], of: set[Token] | None = None) -> dict[Token, list[int]]:
    """Pages that have a token, and its vector's hash, for the tokens ``of`` (default: the candidates)."""
    of = candidates(list(pages.values()), SURE_PAGES) if of is None else of
    paths: dict[Path, set] = defaultdict(set)
    for path, three in of:
        paths[path].add(three)
    out: dict[Token, list[int]] = defaultdict(lambda: [0, 0])
    for key, (elements, texts) in pages.items() if of else ():
        counts = Counter({(p, ()): n for p, n in elements.items() if p in paths})
        for path, nodes in texts.items():
            asked = paths.get(path, ())
            if len(asked) > (() in asked):
                counts.update((path, three) for ws in nodes for three in shingles(ws) if three in asked)
        for token, n in counts.items():
            held = out[token]
            held[0] += 1
            held[1] ^= mixed(key, n)
    return out


def fillings(pages: dict[int, Page]) -> dict[Path, dict[int, list[int]]]:
    """What fills the slots: by path its whole texts, by a hash, each with its words and the pages that have it there."""
    out: dict[Path, dict[int, list[int]]] = defaultdict(dict)
    for _, texts in pages.values():
        for path, nodes in texts.items():
            text = signed(int.from_bytes(hashlib.blake2b("\n".join(map(" ".join, nodes)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
            out[path].setdefault(text, [sum(map(len, nodes)), 0])[1] += 1
    return out


def summed(filled: dict[Path, dict[int, list[int]]]) -> dict[Path, list[int]]:
    """By path the pages that have text there, its words, and those that come again on another of the pages as the path's
    whole text."""
    return {path: [sum(k for _, k in of.values()), sum(n * k for n, k in of.values()), sum(n * k for n, k in of.values() if k > 1)] for path, of in filled.items()}


def signed(x: int) -> int:
    """The same 64 bits as a bigint."""
    return x - 2**64 if x >= 2**63 else x


def as_token(x: list) -> Token:
    return tuple(x[0]), tuple(x[1])


def slots(filled: dict[Path, list[int]]) -> tuple[Path, list[Path]]:
    """The main part of a host's pages, () if there is none, and the parts beside it that are lists of links or notices."""
    parts: dict[Path, list[int]] = defaultdict(lambda: [0, 0, 0])  # words, links, varying text
    own: dict[Path, list[int]] = defaultdict(lambda: [0, 0])  # a block's own words, and those that come again
    for path, (_, words, again) in filled.items():
        linked = words if any(base(key) in LINKS for key in path) else 0
        head = any(base(key) in ("head", "title") for key in path)
        block: Path = ()
        for k in range(len(path) + 1):
            if k == 0 or base(path[k - 1]) in BLOCKS:
                block = path[:k]
                for at, n in enumerate((words, linked, 0 if head or linked else words - again)):
                    parts[block][at] += n
        for at, n in enumerate((words, again)):
            own[block][at] += n
    whole = parts[()][2] if parts else 0
    if not whole:
        return (), []
    inner = sorted((p for p in parts if p and base(p[-1]) in PARTS and parts[p][2] >= MAIN * whole), key=len)
    main: Path = inner[-1] if inner else ()
    within = [own[p] for p in own if p[: len(main)] == main]
    usual = CONTRAST * sum(again for _, again in within) / max(1, sum(words for words, _ in within))
    out: list[Path] = []
    for path in sorted(parts, key=len):
        words, linked, _ = parts[path]
        beside = len(path) > 2 and path != main[: len(path)] and path[: len(main)] != main
        notice = path in own and own[path][0] and own[path][0] == words and own[path][1] >= max(AGAIN, usual) * words
        if beside and words and (linked >= LINKED * words or notice) and not any(path[: len(o)] == o for o in out):
            out.append(path)
    return main, out


def deduce(found: dict[Token, list[int]], filled: dict[Path, list[int]], n_pages: int) -> dict:
    """The template of all of a host's pages: the constant words of valid classes, the main part and the parts to drop."""
    if n_pages < SURE_PAGES:
        return {}
    having = {path: n for (path, three), (n, _) in found.items() if not three}
    words = {t for t, (n, _) in found.items() if t[1] and having[t[0]] >= SURE_PAGES and n >= LEAST_SUPPORT * having[t[0]]}
    classes: dict[tuple[int, int], list[Token]] = defaultdict(list)
    for token in with_elements(words):
        classes[tuple(found[token])].append(token)
    constant = [t for ts in classes.values() if len(ts) >= LEAST_TOKENS for t in ts if t[1]]
    main, beside = slots(filled)
    return {"constant": sorted([list(path), list(three)] for path, three in constant), "main": list(main), "beside": sorted(map(list, beside))}


class Template:
    """A host's template at work. ``names``: whether tags and marks break ties."""

    def __init__(self, template: dict | None, names: bool = True):
        t = template or {}
        self.constant: dict[Path, set] = defaultdict(set)
        for path, three in t.get("constant", []):
            self.constant[tuple(path)].add(tuple(three))
        self.main, self.beside, self.names = tuple(t.get("main", ())), [tuple(p) for p in t.get("beside", [])], names
        self.known: dict[tuple[Path, Path], int] = {}

    def place(self, path: Path, main: Path) -> int:
        """0 for what goes, 1 for what stays, 2 for what stays inside an article or main element, 3 inside the main part."""
        found = self.known.get((path, main))
        if found is None:
            if len(self.known) > 10_000:
                self.known.clear()
            within = bool(main) and path[: len(main)] == main
            gone = any(path[: len(b)] == b for b in self.beside) or (set_aside(path, main) if self.names else "head" in map(base, path))
            found = self.known[path, main] = 0 if gone else 3 if within else 2 if any(base(k) in TEXTS for k in path) else 1
        return found

    def extract(self, page: str | None) -> str:
        """A page's text less the template's: blocks in page order, parted by an empty line."""
        if not page:
            return ""
        events = [(kind, path, entities.unescape(what) if kind == "text" and "&" in what else what) for kind, path, what in parse(page)]
        texts = [(path, what) for kind, path, what in events if kind == "text" and what.strip()]
        # a page without text in the main part is of another layout, where names decide
        main = self.main if any(self.place(path, self.main) == 3 for path, _ in texts) else ()
        least = 1
        if not main and self.names and any(self.place(path, ()) == 2 for path, _ in texts):
            least = 2
        left: dict[int, str] = {}
        if self.constant:
            total = kept = 0
            for k, (kind, path, what) in enumerate(events):
                if kind == "text" and path in self.constant and self.place(path, main) >= least:
                    left[k] = without(what, self.constant[path])
            for k, (kind, path, what) in enumerate(events):
                if main and kind == "text" and self.place(path, main) == 3:
                    total += len(what.split())
                    kept += len(left.get(k, what).split())
            if kept < COPIED * total:  # a copy among copies: its text is no template's
                left = {k: t for k, t in left.items() if self.place(events[k][1], main) != 3}
        out: list[str] = []
        block: list[str] = []

        def close() -> None:
            if words := " ".join("".join(block).split()):
                out.append(words)
            block.clear()

        for k, (kind, path, what) in enumerate(events):
            if kind == "break":
                close()
            elif kind == "text" and self.place(path, main) >= least:
                block.append(left.get(k, what))
        close()
        return "\n\n".join(out)


def extract(page: str | None, template: dict | None, names: bool = True) -> str:
    return Template(template, names).extract(page)


def without(text: str, constant: set | None) -> str:
    """A text less what is constant in it: all of it, or runs of words."""
    words = text.split() if constant else []
    flags = [False] * (len(words) + 2)
    for k, three in enumerate(shingles(words) if words else ()):
        if three in constant:
            flags[k : k + 3] = [True] * 3
    flags = flags[1 : len(words) + 1]
    if not any(flags):
        return text
    if all(flags):
        return " "
    out, k = [], 0
    while k < len(words):
        n = k
        while n < len(words) and flags[n] == flags[k]:
            n += 1
        if not flags[k] or n - k < CONSTANT_RUN:
            out += words[k:n]
        k = n
    return (" " if text[:1].isspace() else "") + " ".join(out) + (" " if text[-1:].isspace() else "")


def host_of(url):
    """Lower-case host of an address; null and odd addresses share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def host_template(pages: list[str]) -> dict:
    """The template of a host from all its pages at once."""
    of = page_keys(pages)
    return deduce(vectors(of), summed(fillings(of)), len(of)) if len(of) >= SURE_PAGES else {}


def templates(pages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(host, template as JSON), a row a host, from all its pages."""
    every = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).where("html IS NOT NULL AND html <> ''")
    sizes = stage_table(every.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host-sizes")
    # buckets grow with the table, so that the hosts that are split stay few
    bucket = max(bucket, (sizes.agg(F.sum("n")).first()[0] or 0) // BROADCAST_TEMPLATES)
    split = sizes.where(F.col("n") > bucket).select("host", F.ceil(F.col("n") / bucket).cast("int").alias("parts"))
    # hosts of too few pages have no template, and their pages need not meet
    enough = every.join(F.broadcast(split), "host", "left").join(sizes.where(F.col("n") >= SURE_PAGES).select("host"), "host", "left_semi")
    rows = enough.select("host", F.coalesce(F.pmod(F.xxhash64("html"), F.col("parts")).cast("int"), F.lit(-1)).alias("part"), "html")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()
        for batch in batches:
            keys = [hash((h, t)) for h, t in zip(batch["host"], batch["html"], strict=True)]
            fresh = [k not in sent and (len(sent) >= SENT or not sent.add(k)) for k in keys]
            yield batch[fresh]

    # copies are one page: those of a task are sent once, and the rest meet where they are dealt to
    dealt = rows.mapInPandas(once, rows.schema).repartition("host", "part").dropDuplicates(["host", "part", "html"])

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[1] < 0:
            return pd.DataFrame({"host": [key[0]], "template": [json.dumps(host_template(list(group["html"])))], "token": [None], "pages": [None], "path": [None], "texts": [None]}, dtype=object)
        of = page_keys(list(group["html"]))
        asked = [json.dumps(t) for t in candidates(list(of.values()), 1)]
        filled = [(json.dumps(p), [{"h": h, "n": n, "k": k} for h, (n, k) in texts.items()]) for p, texts in fillings(of).items()]
        none, n = [None] * len(asked), len(filled)
        return pd.DataFrame({"host": key[0], "template": None, "token": [*asked, *[None] * n, None], "pages": [*none, *[None] * n, len(of)], "path": [*none, *[p for p, _ in filled], None], "texts": [*none, *[t for _, t in filled], None]}, dtype=object)

    learned = stage_table(dealt.groupBy("host", "part").applyInPandas(learn, "host string, template string, token string, pages long, path string, texts array<struct<h: bigint, n: bigint, k: bigint>>"), "templates")
    whole = learned.where("template IS NOT NULL").select("host", "template")
    if not split.head(1):
        return whole
    asked = learned.where("token IS NOT NULL").select("host", "token").distinct().join(F.broadcast(split), "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "token")

    def count(key: tuple, group: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        names = {as_token(json.loads(t)): t for t in wanted["token"]}
        found = vectors(page_keys(list(group["html"])), set(names))
        return pd.DataFrame({"host": key[0], "token": [names[t] for t in found], "n": [n for n, _ in found.values()], "v": [signed(x) for _, x in found.values()]}, dtype=object)

    counted = dealt.where("part >= 0").groupBy("host", "part").cogroup(asked.groupBy("host", "part")).applyInPandas(count, "host string, token string, n long, v long")
    # what stands in fewer pages is in no constant word's class
    added = stage_table(counted.groupBy("host", "token").agg(F.sum("n").alias("n"), F.bit_xor("v").alias("v")).where(F.col("n") >= LEAST_SUPPORT * SURE_PAGES), "template-tokens")

    def join(key: tuple, group: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        found = {as_token(json.loads(t)): [n, v] for t, n, v in zip(group["token"], group["n"], group["v"], strict=True)}
        rows_ = parts[parts["path"].notna()]
        filled = {tuple(json.loads(p)): [int(a), int(b), int(c)] for p, a, b, c in zip(rows_["path"], rows_["k"], rows_["words"], rows_["again"], strict=True)}
        return pd.DataFrame({"host": [key[0]], "template": [json.dumps(deduce(found, filled, int(parts["pages"].fillna(0).sum())))]})

    # a text may come again in another bucket, so texts meet by their hash before a path is summed up
    met = learned.where("path IS NOT NULL").select("host", "path", F.explode("texts").alias("t")).groupBy("host", "path", F.col("t.h").alias("h")).agg(F.max("t.n").alias("n"), F.sum("t.k").alias("k"))
    words = F.col("n") * F.col("k")
    by_path = met.groupBy("host", "path").agg(F.sum("k").alias("k"), F.sum(words).alias("words"), F.sum(F.when(F.col("k") > 1, words).otherwise(0)).alias("again")).withColumn("pages", F.lit(None).cast("long"))
    filled = by_path.unionByName(learned.where("pages IS NOT NULL").select("host", "pages"), allowMissingColumns=True)
    return stage_table(whole.union(added.groupBy("host").cogroup(filled.groupBy("host")).applyInPandas(join, "host string, template string")), "templates")


def extract_text(pages: DataFrame, bucket: int = BUCKET, names: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page.

    A null or empty html has the text ''. Null and odd addresses share one template. Repeated rows are extracted each
    for itself; an empty table gives an empty one. Only page_id, url and html are read. With ``names`` false the template
    decides alone.
    """
    spark = pages.sparkSession
    known = templates(pages, bucket)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("template")), F.lit(0)).alias("chars")).first()
    few = size["n"] <= BROADCAST_TEMPLATES and size["chars"] <= BROADCAST_CHARS
    held = spark.sparkContext.broadcast({r["host"]: r["template"] for r in known.collect()} if few else {})
    if not few:
        salts = 32
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)).cast("int"))
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.join(spread, ["host", "salt"], "left").drop("salt")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("page_id", "url").schema.fields] + ["text string", "n_chars long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_host, ready = held.value, {}

        def of(host: str, template: str | None) -> Template:
            found = ready.get(host)
            if found is None:
                if len(ready) > 2000:
                    ready.clear()
                found = ready[host] = Template(json.loads(template) if template else None, names)
            return found

        for block in (b for batch in batches for b in blocks(batch, "html")):
            told = [by_host.get(h) for h in block["host"]] if few else block["template"]
            texts = [of(h, t).extract(page) for h, t, page in zip(block["host"], told, block["html"], strict=True)]
            yield block[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    return rows.mapInPandas(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
