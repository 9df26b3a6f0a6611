"""Exact Jaccard join of word-shingle sets as a metric-space join.

Distance is what two sets do not share. Three kinds of pivots cut the space into regions, each exact by the triangle
inequality, and regions join within themselves:

* The empty set: a set's size is its distance from it, and linked sets have sizes within the threshold's ratio. Sizes
  form rings; each set is replicated to its own ring's region and to the next, so any linked pair shares one.
* Projections: within a ring, linked sets differ in at most ``h`` shingles. The shingles are dealt into more than ``h``
  parts, so in some part two linked sets do not differ at all, that is, they are at distance 0 from one projected pivot.
  A region is a ring, a part and the projection. Unrelated texts that share a long passage seldom meet, since each part
  mixes a few shingles from all over a text.
* Documents: in a region the least document is a pivot that the others are measured against; whatever links to it is
  in its component. Regions that still hold several components are cut by further pivot documents into Voronoi cells,
  with windows of twice the threshold replicating boundary documents, recursively, until cells are small.

(Pivot documents alone can't cut the whole space: nearly all pairs of texts are at distance 1, so every window would hold
everything. Hence the first two kinds.)

Equal sets are one class throughout. A region's members are never paired with each other as rows: what is shuffled are
memberships and the pairs with pivots, and only links that join two components leave a task. Before sets are compared,
their sketches are: the parities of a set's shingles by hash, two bits a shingle, which differ in no more places than the
sets do. Only sets that a sketch can't part from another are fetched, from the texts, and compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks
from pagequarry.llm.common import scratch, shuffles_go, stage_table, table

#: Bits of the filter that tells which regions have several classes. Its size is fixed; a fuller filter lets more through.
FILTER_BITS = 1 << 26
SEGMENT = 1 << 19
#: Shingles in one task's block of a region, pivots of a cut, and members from which cells are cut at all.
BLOCK_SHINGLES, PIVOTS, CELL = 500_000, 8, 32
#: Classes to fetch up to this number are sent to every task (16 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 500_000
#: Classes whose sets a task remembers to have sent.
SEEN = 200_000

U = np.uint64
SHIFTS = tuple(U(x) for x in (30, 27, 31, 32))
MIX1, MIX2, STEP1, STEP2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern (the finaliser of a public generator)."""
    x = (x ^ (x >> SHIFTS[0])) * MIX1
    x = (x ^ (x >> SHIFTS[1])) * MIX2
    return x ^ (x >> SHIFTS[2])


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U, count=len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1 + len(words))], dtype=U)
    n = len(words) - size + 1
    total = h[:n].copy()
    for k in range(1, size):
        total = total * STEP1 + h[k : k + n]
    return np.unique(mix(total))


@lru_cache(maxsize=16)
def rings(percent: int) -> list[int]:
    """First sizes of the rings: a linked set's size is in the same ring or a neighbouring one."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


def differing(most: int, percent: int) -> int:
    """How many shingles two linked sets of at most ``most`` differ in, at most."""
    return 2 * most * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Regions of a set: for its ring and the next, a hash of each part's shingles.

    A ring has ``slack`` parts more than exactness asks for, so that parts without shingles, which would be alike in
    many sets, can be left out; a set with more empty parts than that names them too.
    """
    bounds = rings(percent)
    ring = int(np.searchsorted(bounds, len(s), side="right")) - 1
    out = []
    for r in (ring, ring + 1):
        h = differing(bounds[r + 1] - 1, percent)
        if not h:  # only equal sets link here, and they are one class
            continue
        slack = 1 + h // 12
        k = h + 1 + slack
        salt = mix(np.array([r + 1], dtype=U) * STEP2)[0]
        part = ((mix(s ^ salt) >> SHIFTS[3]) * U(k)) >> SHIFTS[3]
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums = np.add.reduceat(mix(s + salt)[order], first)
        named = part[first]
        if k - len(named) > slack:
            empty = np.setdiff1d(np.arange(k, dtype=U), named)
            named, sums = np.append(named, empty), np.append(sums, np.zeros(len(empty), dtype=U))
        out.append(mix(sums + mix(named * STEP1 + salt)))
    return np.concatenate(out) if out else np.empty(0, dtype=U)


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def regions_of(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(sig, cls) of every text; copies within a task are sent once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for block in (b for batch in batches for b in blocks(batch, "t", 1_000_000)):
            sigs, classes = [], []
            for t in block["t"]:
                s = shingles(t, size)
                if not len(s):
                    continue
                c = xxhash.xxh3_64_intdigest(s.tobytes())
                if c in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                g = signatures(s, percent)
                sigs.append(g)
                classes.append(np.full(len(g), c, dtype=U))
            if sigs:
                yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "cls": np.concatenate(classes).view(np.int64)})

    return docs.select(F.col(text).cast("string").alias("t")).mapInPandas(run, "sig long, cls long")


def shared_filter(memberships: DataFrame) -> np.ndarray:
    """A bitmap of the regions that hold more than one class, of fixed size: FILTER_BITS / 8 bytes."""
    spark = memberships.sparkSession
    several = memberships.groupBy("sig").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    bit = F.pmod("sig", F.lit(FILTER_BITS))
    bits = several.select(bit.alias("bit")).distinct().select((F.col("bit") / SEGMENT).cast("int").alias("seg"), (F.col("bit") % SEGMENT).cast("int").alias("at"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(SEGMENT, dtype=bool)
        flags[part["at"].to_numpy()] = True
        return pd.DataFrame({"seg": [key[0]], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    step = SEGMENT // 8
    with shuffles_go(spark):
        packed = bits.groupBy("seg").applyInPandas(pack, "seg int, bits binary").collect()
    for r in packed:
        out[r["seg"] * step : (r["seg"] + 1) * step] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by hash: two to four bits a shingle, 256 at least, in 64-bit words."""
    bits = max(256, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s + STEP2) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def fold(x: Column) -> Column:
    """A sketch with half as many bits."""
    half = (F.size(x) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get(x, i).bitwiseXOR(F.get(x, i + half)))


def apart(x: Column, y: Column) -> Column:
    """Places in which two sketches differ, with the longer folded; 0 where more than one folding would be needed."""
    count = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)
    return F.when(F.size(x) == F.size(y), count(x, y)).when(F.size(x) == 2 * F.size(y), count(fold(x), y)).when(2 * F.size(x) == F.size(y), count(x, fold(y))).otherwise(F.lit(0))


def signed(c: int) -> int:
    return c - (c >> 63 << 64)


def measured(docs: DataFrame, doc: str, text: str, size: int, percent: int, bitmap: np.ndarray, order: str) -> DataFrame:
    """(id, place, cls, n, sigs, sketch) of every row, written once; the arrays only where a region may be shared."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, seen = held.value, set()
        for block in (b for batch in batches for b in blocks(batch, "t", 1_000_000)):
            rows = []
            for missing, t in zip(block["id"].isna(), block["t"], strict=True):
                s = shingles(t, size)
                if not len(s) or missing:
                    rows.append((None, len(s), None, None))
                    continue
                c = xxhash.xxh3_64_intdigest(s.tobytes())
                g = np.empty(0, dtype=U)
                if c not in seen:
                    if len(seen) < SEEN:
                        seen.add(c)
                    g = signatures(s, percent)
                    at = g & U(FILTER_BITS - 1)
                    g = g[(bits[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1]
                rows.append((signed(c), len(s), g.view(np.int64) if len(g) else None, sketch(s).view(np.int64) if len(g) else None))
            yield pd.DataFrame({"id": block["id"], "place": block["place"], "cls": pd.array([r[0] for r in rows], dtype="Int64"), "n": [r[1] for r in rows], "sigs": [r[2] for r in rows], "sketch": [r[3] for r in rows]})

    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(order).cast("long").alias("place"), F.col(text).cast("string").alias("t"))
    return stage_table(rows.mapInPandas(run, "id long, place long, cls long, n long, sigs array<long>, sketch array<long>"), "jaccard-sets", keep=True)


def fetch(docs: DataFrame, doc: str, text: str, size: int, wanted: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(cls, shingles) of the wanted classes, from the text of each class's least row."""
    least = found.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("id"))
    reps = stage_table(wanted.select("cls").distinct().join(least, "cls"), f"{name}-wanted")
    few = F.broadcast(reps) if reps.count() <= BROADCAST_CLASSES else reps
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(few, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in (b for batch in batches for b in blocks(batch, "t", 1_000_000)):
            sets = [shingles(t, size) for t in block["t"]]
            same = [len(s) > 0 and signed(xxhash.xxh3_64_intdigest(s.tobytes())) == c for s, c in zip(sets, block["cls"], strict=True)]
            yield pd.DataFrame({"cls": [c for c, ok in zip(block["cls"], same, strict=True) if ok], "shingles": [s.view(np.int64) for s, ok in zip(sets, same, strict=True) if ok]})

    return stage_table(rows.select("cls", "t").mapInPandas(run, "cls long, shingles array<long>").dropDuplicates(["cls"]), f"{name}-sets")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root): each vertex of ``edges`` (a, b) with the least vertex that it reaches.

    Labels spread to neighbours and along labels (so paths halve in each round) until none changes. Each round is a
    table in the shared folder. Hubs are aggregated before they are shuffled, and their joins split by Spark.
    """
    both = stage_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stage_table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("root")), name)
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "v")
        spread = stage_table(labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root")), name)
        jump = spread.select(F.col("v").alias("root"), F.col("root").alias("over"))
        after = stage_table(spread.join(jump, "root", "left").select("v", "old", F.least("root", "over").alias("root")), name)
        labels = after.select("v", "root")
        if after.where("old <> root").isEmpty():
            return labels


class Region:
    """Sets of one region's block in one task: intersections by a flag for each distinct shingle."""

    def __init__(self, sets: list[np.ndarray], groups: list[int], percent: int):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        distinct, self.ids = np.unique(flat, return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.flags = np.zeros(len(distinct), dtype=bool)
        self.percent, self.reach = percent, 2 * (100 - percent) / 100 + 1e-9
        self.parent = list(range(len(sets)))
        first: dict[int, int] = {}
        for i, g in enumerate(groups):
            self.parent[i] = first.setdefault(g, i)
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def own(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with several."""
        self.flags[self.own(i)] = True
        lengths = self.sizes[others]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        at = np.repeat(self.ends[others] - lengths - starts, lengths) + np.arange(lengths.sum())
        out = np.add.reduceat(self.flags[self.ids[at]], starts, dtype=np.int64)
        self.flags[self.own(i)] = False
        return out

    def measure(self, i: int, others: np.ndarray) -> np.ndarray:
        """Distances of a set to several; links are noted on the way."""
        c = self.common(i, others)
        for j in others[linked(c, self.sizes[i], self.sizes[others], self.percent)]:
            a, b = self.root(i), self.root(int(j))
            if a != b:
                self.parent[b] = a
                self.found.append((i, int(j)))
        return 1 - c / (self.sizes[i] + self.sizes[others] - c)

    def apart(self, members: np.ndarray) -> bool:
        return len({self.root(int(i)) for i in members}) > 1

    def join(self) -> list[tuple[int, int]]:
        """Links that join components, with which all links of the block are known to lie within components."""
        stack = [np.arange(len(self.sizes))]
        while stack:
            members = stack.pop()
            if not self.apart(members):
                continue
            if len(members) <= CELL:
                self.all_pairs(members, members)
                continue
            pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
            d = np.stack([self.measure(int(p), members) for p in pivots])
            home = d.argmin(axis=0)
            least = d.min(axis=0)
            for k in range(PIVOTS):
                cell, around = members[home == k], members[d[k] <= least + self.reach]
                if not len(cell):
                    continue
                if len(around) > 0.8 * len(members):  # the cut did not part them: the cell meets its window outright
                    self.all_pairs(cell, around)
                else:
                    stack.append(around)
        return self.found

    def all_pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        for i in left:
            roots = np.array([self.root(int(j)) for j in right])
            rest = right[(roots != self.root(int(i)))]
            near = rest[(self.sizes[rest] * 100 >= self.percent * self.sizes[i]) & (self.sizes[i] * 100 >= self.percent * self.sizes[rest])]
            if len(near):
                self.measure(int(i), near)


def near_members(words: list[np.ndarray], roots: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a region's block have a member of another component that a sketch can't part from them."""
    least = min(map(len, words))
    for i, w in enumerate(words):
        while len(w) > least:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        words[i] = w
    t, out = np.stack(words), np.zeros(len(words), dtype=bool)
    both = side[0] != side[-1] or (side != side[0]).any()
    rows = max(1, 1_000_000 // t.size)
    for lo in range(0, len(t), rows):
        r, m = roots[lo : lo + rows, None], n[lo : lo + rows, None]
        near = (r != roots) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
        if both:
            near &= side[lo : lo + rows, None] != side
        if near.any():
            near &= np.bitwise_count(t[lo : lo + rows, None] ^ t).sum(axis=2, dtype=np.int64) <= (m + n) * (100 - percent) // (100 + percent)
            out[lo : lo + rows] = near.any(axis=1)
    return out


def in_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows as frames of whole groups with their borders; only a last group is carried over."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        new = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        borders = np.flatnonzero(new)
        if len(borders):
            rest = batch.iloc[borders[-1] :]
            yield batch.iloc[: borders[-1]], np.concatenate(([0], borders))
        else:
            rest = batch
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def links(docs: DataFrame, doc: str, text: str, size: int, found: DataFrame, percent: int, name: str = "jaccard") -> DataFrame:
    """Edges (a, b) between classes whose components are those of all links."""
    rows = found.where("sigs IS NOT NULL")
    members = stage_table(rows.select("cls", "n", F.explode("sigs").alias("sig")).distinct(), f"{name}-members")
    # regions with the same members are one; their number of members, least member and a checksum tell them
    region = members.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.min("cls").alias("pivot"), F.bit_xor(F.xxhash64("cls")).alias("check")).where("k > 1")
    region = stage_table(region.groupBy("k", "total", "pivot", "check").agg(F.min("sig").alias("sig")), f"{name}-regions")
    inside = stage_table(members.join(region, "sig"), f"{name}-inside")
    sketches = stage_table(rows.select("cls", "n", "sketch").dropDuplicates(["cls"]).join(inside.select("cls").distinct(), "cls"), f"{name}-sketches")
    # the least member of each region is a pivot that the others are measured against
    pairs = inside.where("cls <> pivot").select("pivot", "cls").distinct()
    x = sketches.select(F.col("cls").alias("pivot"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
    y = sketches.select("cls", F.col("n").alias("ny"), F.col("sketch").alias("y"))
    most = F.floor((F.col("nx") + F.col("ny")) * (100 - percent) / (100 + percent))
    near = stage_table(pairs.join(y, "cls").join(x, "pivot").where(apart(F.col("x"), F.col("y")) <= most).select("pivot", "cls", "nx", "ny"), f"{name}-pairs")
    sets = fetch(docs, doc, text, size, near.select("cls").unionByName(near.select(F.col("pivot").alias("cls"))), found, f"{name}-stars")
    met = near.join(sets.withColumnRenamed("shingles", "y"), "cls").join(sets.select(F.col("cls").alias("pivot"), F.col("shingles").alias("x")), "pivot").withColumn("common", F.size(F.array_intersect("x", "y")))
    stars = stage_table(met.where(linked(F.col("common"), F.col("nx"), F.col("ny"), percent)).select(F.col("pivot").alias("a"), F.col("cls").alias("b")), f"{name}-stars")
    labels = components(stars, f"{name}-stars")
    # regions that still hold several components, in blocks of bounded size; each pair of blocks is a task's work
    grouped = inside.where("k > 2").join(labels.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = grouped.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rest = grouped.join(mixed, "sig").select("sig", "cls", "n", "root", parts.alias("parts"), F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"))
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("sig", "cls", "n", "root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, borders in in_groups(batches, ["sig", "p", "q"]):
            words = [np.asarray(x, dtype=np.int64).view(U) for x in part["sketch"]]
            roots, n, side = (part[c].to_numpy() for c in ("root", "n", "part"))
            keep = [near_members(words[a:b], roots[a:b], n[a:b], side[a:b], percent) for a, b in zip(borders, borders[1:], strict=False)]
            part = part.assign(check=0)
            for k, a, b in zip(keep, borders, borders[1:], strict=False):
                if k.any():
                    part.iloc[a:b, -1] = signed(xxhash.xxh3_64_intdigest(np.sort(part["cls"].to_numpy()[a:b][k]).tobytes()))
            yield part.loc[np.concatenate(keep), ["sig", "p", "q", "cls", "root", "check"]]

    # a block's rows come to one task in a row; their number is bounded, so a task holds one block at a time
    placed = dealt.join(sketches.select("cls", "sketch"), "cls").repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")
    asked = stage_table(placed.mapInPandas(look, "sig long, p int, q int, cls long, root long, check long"), f"{name}-asked")
    # of blocks with the same members left, one is joined
    once = asked.groupBy("check").agg(F.min(F.struct("sig", "p", "q")).alias("o")).select("check", "o.*")
    asked = stage_table(asked.join(once, ["check", "sig", "p", "q"]).drop("check"), f"{name}-once")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, borders in in_groups(batches, ["sig", "p", "q"]):
            shingles_, roots, cls = [np.asarray(s) for s in part["shingles"]], part["root"].tolist(), part["cls"].to_numpy()
            out = [(cls[a + i], cls[a + j]) for a, b in zip(borders, borders[1:], strict=False) for i, j in Region(shingles_[a:b], roots[a:b], percent).join()]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    sets = fetch(docs, doc, text, size, asked, found, f"{name}-rest")
    more = asked.join(sets, "cls").repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "cls").mapInPandas(join, "a long, b long")
    return stars.unionByName(stage_table(more.distinct(), f"{name}-more"))


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """Per row: doc, n_shingles, component_id and, if ``order`` is given, first.

    component_id is the least doc reachable by links of similarity ``percent`` and more; ``first`` says whether the row is
    its component's least by the column ``order`` (nulls last), then by doc. Null, empty and wordless texts have no
    shingles and stand alone, also among themselves. Equal sets link with each other. A row without a doc keeps its
    n_shingles, links with nothing and has a null component. Rows that share a doc are one vertex if their sets are equal,
    else each its own. An empty table gives an empty one. Only ``doc``, ``text`` and ``order`` are read. Sets are told apart
    by 64-bit hashes of shingles and of sets.
    """
    spark = docs.sparkSession
    with scratch(spark):
        found = measured(docs, doc, text, size, percent, shared_filter(regions_of(docs, text, size, percent)), order or doc)
        labels = components(links(docs, doc, text, size, found, percent))
        place = F.struct(F.col("place").isNull().alias("none"), "place", "id")
        least = found.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("least"), F.min(place).alias("first"))
        rooted = stage_table(least.join(labels.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "jaccard-rooted")
        least_of = stage_table(rooted.groupBy("root").agg(F.min("least").alias("component"), F.min("first").alias("first")), "jaccard-least")
        of_class = stage_table(rooted.drop("first").join(least_of, "root").select("cls", "component", F.col("first.id").alias("first")), "jaccard-classes", keep=True)
    rows = found.select("id", "cls", "n")
    alone = rows.where("cls IS NULL").select("id", "n", F.col("id").alias("component"), F.lit(True).alias("first"))
    joined = rows.where("cls IS NOT NULL").join(of_class, "cls").select("id", "n", "component", (F.col("id") == F.col("first")).alias("first")).unionByName(alone)
    out = joined.select(F.col("id").alias(doc), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "first")
    return out if order else out.drop("first")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), size=3, percent=90)
