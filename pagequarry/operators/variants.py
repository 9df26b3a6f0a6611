"""Variants of a page's regions, counted for many pages at once.

A page and its regions are one row; each defect of ``mutations`` is applied to the row's arrays, and what the gate's blocking
checks go by is counted with numpy over pages laid side by side, padded to the longest. No variant's regions are ever rows,
so what is shuffled is the pages once, however many defects are tried. Counts are those of ``checks.Page``, and variants
those of ``mutations``; tests hold them against both.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.geometry import bucket
from pagequarry.operators import checks, mutations, spatial

#: Counts of a variant that are made here, of those of ``checks.OF_SYSTEM``.
COUNTED = "n_orphans lost_ink lost_in_band orphan_run n_bare n_again n_regions n_text beyond n_huge n_spanning n_missed_grids transitions inversions intruders".split()
#: Pages side by side have so many pairs of a line and a region at most, but for a single page with more (fixed value).
PAIRS = 1 << 17
#: Classes that defects turn regions into, and the bucket of each.
NAMED = {name.removeprefix("class_to_"): checks.BUCKET_NUMBERS[kind] for name, kind in (("class_to_figure", "MEDIA"), ("class_to_header", "DISCARD"), ("class_to_table", "TABLE"))}
EVERY: list[tuple[str, float]] = [("none", 0.0)] + [(name, float(s)) for name, (_, strengths) in mutations.MUTATIONS.items() for s in strengths]
#: Variants that go by a digest of each region; a share of 1 strikes all.
DRAWN = [(n, s) for n, s in EVERY if n == "shuffle_order" or (s < 1 and n in ("drop_region", "merge_vertical", "split_region", "duplicate", *(f"class_to_{c}" for c in NAMED)))]


class Regions(NamedTuple):
    """Regions of pages side by side: ``box`` (page, side, region), the others (page, region). ``held``, the cover of lines
    by boxes, is there where a variant leaves the boxes as they are."""

    box: np.ndarray
    valid: np.ndarray
    kind: np.ndarray
    named: np.ndarray
    rank: np.ndarray
    blk: np.ndarray
    held: np.ndarray | None = None


def padded(rows: list[np.ndarray], fill: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Arrays alike but for their last axis as one, and where it holds values; that axis has one place at least."""
    n = np.array([r.shape[-1] for r in rows])
    out = np.full((len(rows), *rows[0].shape[:-1], max(n.max(), 1)), fill, dtype=rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, ..., : n[i]] = r
    return out, np.arange(out.shape[-1]) < n[:, None]


def doubled(r: Regions, twice: np.ndarray) -> Regions:
    """Every region in two places, the second of which counts where ``twice`` says so."""
    two = [np.repeat(v, 2, axis=-1) for v in (r.box, r.valid, r.kind, r.named, r.rank, r.blk)]
    two[1] = two[1].copy()
    two[1][:, 1::2] &= twice
    return Regions(*two)


def merged_vertical(r: Regions, hit: np.ndarray) -> tuple[Regions, np.ndarray]:
    order = np.lexsort((r.blk, np.where(r.valid, r.box[:, 1], np.inf)), axis=-1)
    at = np.arange(len(order))
    box, valid, used, some = r.box.copy(), r.valid.copy(), np.ones(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    for j in range(1, order.shape[1]):
        p, q = order[:, j - 1], order[:, j]
        a, b = r.box[at, :, p], r.box[at, :, q]
        first = used if j > 1 else np.zeros_like(used)
        take = ~first & hit[at, p] & r.valid[at, q] & (np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]) >= 0.5 * np.minimum(a[:, 2] - a[:, 0], b[:, 2] - b[:, 0]))
        i = np.flatnonzero(take)
        box[i, :2, p[i]], box[i, 2:, p[i]] = np.minimum(a[i, :2], b[i, :2]), np.maximum(a[i, 2:], b[i, 2:])
        valid[i, q[i]] = False
        used, some = take, some | take
    return r._replace(box=box, valid=valid, held=None), some


def variant(r: Regions, name: str, strength: float, draw: np.ndarray | None) -> tuple[Regions, np.ndarray]:
    """Regions, in order of their numbers, with one defect, and the pages on which that changes any. ``draw`` has the digests
    as shares."""
    hit = r.valid & (draw < strength) if draw is not None else r.valid
    if name == "none":
        return r, np.zeros(len(hit), dtype=bool)
    if name == "drop_region":
        return r._replace(valid=r.valid & ~hit), hit.any(axis=1)
    if name == "drop_largest":
        size = np.maximum(r.box[:, 2] - r.box[:, 0], 0) * np.maximum(r.box[:, 3] - r.box[:, 1], 0)
        order = np.lexsort((r.blk, np.where(r.valid, -size, np.inf)), axis=-1)
        lost = np.zeros_like(r.valid)
        np.put_along_axis(lost, order[:, : int(strength)], True, axis=1)
        return r._replace(valid=r.valid & ~lost), (r.valid & lost).any(axis=1)
    if name == "merge_vertical":
        return merged_vertical(r, hit)
    if name == "split_region":
        cut = hit & (r.box[:, 3] - r.box[:, 1] > 40)
        two, middle = doubled(r, cut), (r.box[:, 1] + r.box[:, 3]) / 2
        two.box[:, 3, 0::2] = np.where(cut, middle, r.box[:, 3])
        two.box[:, 1, 1::2] = middle
        return two, cut.any(axis=1)
    if name in ("shrink", "grow"):
        share = -strength if name == "shrink" else strength
        d = (r.box[:, 2:] - r.box[:, :2]) * share / 2
        box = np.concatenate([r.box[:, :2] - d, r.box[:, 2:] + d], axis=1)
        return r._replace(box=box, held=None), ((box != r.box).any(axis=1) & r.valid).any(axis=1)
    if name == "duplicate":
        return doubled(r, hit), hit.any(axis=1)
    if name == "shuffle_order":
        order = np.lexsort((r.blk, np.where(r.valid, draw, np.inf)), axis=-1)
        rank = np.empty_like(r.rank)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(1.0, order.shape[1] + 1), order.shape), axis=1)
        return r._replace(rank=rank), (r.valid & (rank != r.rank)).any(axis=1)
    if name == "shift":
        return r._replace(box=r.box + strength * 2000, held=None), r.valid.any(axis=1)
    cls = name.removeprefix("class_to_")
    other = hit & (r.named != list(NAMED).index(cls))
    return r._replace(kind=np.where(hit, NAMED[cls], r.kind)), other.any(axis=1)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that boxes of ``a`` and ``b`` (page, side, box) have in common: (page, box of a, box of b)."""
    w = np.minimum(a[:, 2, :, None], b[:, 2, None]) - np.maximum(a[:, 0, :, None], b[:, 0, None])
    h = np.minimum(a[:, 3, :, None], b[:, 3, None]) - np.maximum(a[:, 1, :, None], b[:, 1, None])
    np.maximum(w, 0, out=w)
    return np.multiply(w, np.maximum(h, 0, out=h), out=w)


def areas_of(b: np.ndarray) -> np.ndarray:
    return np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)


class Pages:
    """Pages side by side, with what all variants of their regions share."""

    def __init__(self, pages: list[checks.Page]):
        self.t, self.width, self.height = pages[0].t, pages[0].width, pages[0].height
        self.line, self.is_line = padded([p.line for p in pages])
        self.read, self.is_read = padded([p.read for p in pages])
        self.content, _ = padded([p.content for p in pages], False)
        self.band, _ = padded([p.band for p in pages], -1)
        self.of, _ = padded([p.of for p in pages])
        self.read_size, _ = padded([p.read_size for p in pages], -1)
        self.read_band, _ = padded([p.read_band for p in pages], -1)
        self.bands, _ = padded([p.bands for p in pages], np.nan)
        self.grids, self.is_grid = padded([p.grids for p in pages])
        self.line_h = np.array([p.line_h for p in pages])
        self.ink, self.size = areas_of(self.line), np.maximum(areas_of(self.line), 1e-6)
        self.down = np.argsort(np.where(self.is_read, self.read[:, 1], np.inf), axis=1, kind="stable")
        order = np.lexsort((self.line[:, 0], np.where(self.is_line, self.line[:, 1], np.inf)), axis=-1)
        self.order, self.place = order, np.argsort(order, axis=1)
        self.units, is_unit = padded([p.units for p in pages])
        inside = shared(self.read, self.units) / np.maximum(areas_of(self.read), 1e-6)[:, :, None] >= 0.6
        self.inside = inside & self.is_read[:, :, None] & is_unit[:, None]

    def held(self, box: np.ndarray) -> np.ndarray:
        """Share of each line in each box: (page, box, line)."""
        x = shared(box, self.line)
        return np.divide(x, self.size[:, None], out=x)

    def counts(self, r: Regions) -> dict[str, np.ndarray]:
        """COUNTED for each page."""
        t, (n, m), lines, reads = self.t, r.valid.shape, self.line.shape[2], self.read.shape[2]
        box, valid, at = r.box, r.valid, np.arange(len(r.valid))[:, None]
        held = r.held if r.held is not None else self.held(box)
        owner, best = np.full((n, lines), -1), np.full((n, lines), np.nextafter(0.5, 0))
        for k in range(m):
            better = (held[:, k] > best) & valid[:, k, None]
            owner[better] = k
            np.copyto(best, held[:, k], where=better)
        owned = (owner >= 0) & self.is_line
        full = np.zeros((n, m), dtype=bool)
        page, line = np.nonzero(owned)
        full[page, owner[page, line]] = True
        out = {"n_regions": valid.sum(axis=1)}
        # lost reading lines, their ink and their longest run
        gone = ~owned & self.content
        lost = np.bincount((self.of + reads * at)[gone], minlength=n * reads).reshape(n, reads) == self.read_size
        out |= {"n_orphans": lost.sum(axis=1), "lost_ink": (self.ink * gone).sum(axis=1), "lost_in_band": (lost & (self.read_band >= 0)).sum(axis=1), "orphan_run": self.runs(lost)}
        # regions by themselves
        low, high = np.where(valid[:, None], box, np.inf).min(axis=2), np.where(valid[:, None], box, -np.inf).max(axis=2)
        beyond = np.maximum(np.maximum(-low[:, 0], -low[:, 1]), np.maximum(high[:, 2] - self.width, high[:, 3] - self.height))
        text, table = valid & (r.kind == checks.TEXT), valid & (r.kind == checks.TABLE)
        taken = np.minimum(box[:, 2, :, None], self.bands[:, 1, None]) - np.maximum(box[:, 0, :, None], self.bands[:, 0, None])
        wide = box[:, 2] - box[:, 0]
        spans = (taken > (t["band_span"] * (self.bands[:, 1] - self.bands[:, 0]))[:, None]).sum(axis=2) >= 2
        one = taken > 0.5 * wide[:, :, None]
        band = np.where((wide <= 0.62 * self.width) & (one.sum(axis=2) == 1), one.argmax(axis=2), -1)
        out |= {"n_text": text.sum(axis=1), "beyond": np.where(valid.any(axis=1), beyond, 0), "n_huge": (valid & (areas_of(box) > t["page_share"] * (self.width * self.height))).sum(axis=1), "n_spanning": (text & spans).sum(axis=1)}
        out |= {"n_again": self.again(box, valid, r.kind), "n_bare": self.bare(box, text, table)}
        grid = ((shared(self.grids, box) / np.maximum(areas_of(self.grids), 1e-6)[:, :, None] > t["grid_cover"]) & table[:, None]).any(axis=2)
        out["n_missed_grids"] = (self.is_grid & ~grid).sum(axis=1)
        # the reading order: blocks by rank and number, lines of a block down the page
        p, k = np.nonzero(full)
        o = np.lexsort((r.blk[p, k], r.rank[p, k], p))
        p, k = p[o], k[o]
        new = np.ones(len(p), dtype=np.int64)
        new[1:] = (p[1:] != p[:-1]) | (r.rank[p[1:], k[1:]] != r.rank[p[:-1], k[:-1]]) | (r.blk[p[1:], k[1:]] != r.blk[p[:-1], k[:-1]])
        turn = np.zeros((n, m), dtype=np.int64)
        turn[p, k] = np.cumsum(new)  # rises with the page, so one number orders all lines
        key = np.sort(turn[page, owner[page, line]] * lines + self.place[page, line])
        of_turn = np.zeros(int(new.sum()) + 1, dtype=np.int64)
        of_turn[turn[p, k]] = p
        page = of_turn[key // lines] if key.size else page
        line = self.order[page, key % lines] if key.size else line
        along = self.band[page, line]
        q, along = page[along >= 0], along[along >= 0]
        out["transitions"] = np.bincount(q[1:][(q[1:] == q[:-1]) & (along[1:] != along[:-1])], minlength=n)
        c = np.flatnonzero(band[p, k] >= 0)
        p, k = p[c], k[c]
        o = np.lexsort((r.blk[p, k], box[p, 1, k], r.rank[p, k], band[p, k], p))
        p, k = p[o], k[o]
        room = np.maximum(3 * self.line_h, 40.0)[p[1:]]
        up = (p[1:] == p[:-1]) & (band[p[1:], k[1:]] == band[p[:-1], k[:-1]]) & (box[p[1:], 1, k[1:]] < box[p[:-1], 1, k[:-1]] - room)
        out["inversions"] = np.bincount(p[1:][up], minlength=n)
        out["intruders"] = self.intruders(page, line)
        return out

    def runs(self, lost: np.ndarray) -> np.ndarray:
        """Longest run of lost reading lines down the page, in which none is far below the one before."""
        lost = np.take_along_axis(lost, self.down, axis=1)
        top, foot = (np.take_along_axis(self.read[:, k], self.down, axis=1) for k in (1, 3))
        upto = np.maximum.accumulate(np.where(lost, np.arange(lost.shape[1]), -1), axis=1)
        before = np.concatenate([np.full((len(lost), 1), -1), upto[:, :-1]], axis=1)
        gap = top - np.take_along_axis(foot, np.maximum(before, 0), axis=1)
        new = lost & ((before < 0) | (gap > (self.t["run_gap"] * self.line_h)[:, None]))
        count = np.cumsum(lost, axis=1)
        start = np.maximum.accumulate(np.where(new, count - 1, 0), axis=1)
        return ((count - start) * lost).max(axis=1)

    def again(self, box: np.ndarray, valid: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Repeats of an earlier region that is no repeat itself."""
        reach = np.maximum(0.5 * self.line_h, 4.0)[:, None, None]
        near = (kind[:, :, None] == kind[:, None]) & valid[:, :, None] & valid[:, None]
        for k in range(4):
            near &= np.abs(box[:, k, :, None] - box[:, k, None]) <= reach
        near &= np.tri(near.shape[1], k=-1, dtype=bool)
        kept = np.ones_like(valid)
        for i in np.flatnonzero(near.any(axis=(0, 2))):
            kept[:, i] = ~(near[:, i, :i] & kept[:, :i]).any(axis=1)
        return (~kept).sum(axis=1)

    def bare(self, box: np.ndarray, text: np.ndarray, table: np.ndarray) -> np.ndarray:
        """On pages without text regions, reading lines that no table region covers."""
        out, p = np.zeros(len(box), dtype=np.int64), np.flatnonzero(~text.any(axis=1))
        if p.size:
            held = shared(self.read[p], box[p]) / np.maximum(areas_of(self.read[p]), 1e-6)[:, :, None] >= self.t["text_cover"]
            out[p] = (self.is_read[p] & ~(held & table[p][:, None]).any(axis=2)).sum(axis=1)
        return out

    def intruders(self, page: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Lines between those of a unit that should be read together; ``page`` and ``line`` in reading order."""
        n, reads = self.read_size.shape
        out = np.zeros(n, dtype=np.int64)
        if not self.inside.any() or not page.size:
            return out
        at = page * reads + self.of[page, line]
        first = np.full(n * reads, -1)
        first[at[::-1]] = np.arange(len(at))[::-1]  # of equal places the last one written stays: the first line's
        place = np.cumsum(first[at] == np.arange(len(at)))
        place = np.where(first >= 0, place[first], 0).reshape(n, reads)
        seen = (first >= 0).reshape(n, reads)
        for u in range(self.inside.shape[2]):
            on = self.inside[:, :, u] & seen
            size = on.sum(axis=1)
            other = np.where(on, place, -1).max(axis=1) - np.where(on, place, len(at) + 1).min(axis=1) + 1 - size
            out = np.maximum(out, np.where((size >= self.t["unit_lines"]) & (other > self.t["unit_slack"] * size), other, 0))
        return out


def counted(batches: Iterator[pd.DataFrame], fields: list[str], same: list[str], width: float, height: float, t: dict) -> Iterator[pd.DataFrame]:
    """Pages of like size side by side, a chunk at a time."""
    for batch in batches:
        rows = batch.to_dict("records")
        size = [(max(len(r["ls_x1"]) if r["ls_x1"] is not None else 0, 1), len(r["rs_blk"])) for r in rows]
        order, i = sorted(range(len(rows)), key=lambda k: size[k]), 0
        while i < len(order):
            j, a, b = i, 0, 0
            while j < len(order) and (j == i or (j - i + 1) * max(a, size[order[j]][0]) * max(b, size[order[j]][1]) <= PAIRS):
                a, b, j = max(a, size[order[j]][0]), max(b, size[order[j]][1]), j + 1
            at, i = order[i:j], j
            yield of_chunk([rows[k] for k in at], batch[same].iloc[at].reset_index(drop=True), fields, width, height, t)


def of_chunk(rows: list[dict], about: pd.DataFrame, fields: list[str], width: float, height: float, t: dict) -> pd.DataFrame:
    single = [checks.page_of(r, width, height, t) for r in rows]
    v, valid = padded([np.stack([np.asarray(r[f"rs_{c}"], dtype=float) for c in fields]) for r in rows])
    many = Pages(single)
    base = Regions(v[:, 2:6], valid, v[:, 6], v[:, 7], v[:, 1], v[:, 0], many.held(v[:, 2:6]))
    at, numbers = [], []
    for k, (name, strength) in enumerate(EVERY):
        changed, other = variant(base, name, strength, v[:, 8 + DRAWN.index((name, strength))] if (name, strength) in DRAWN else None)
        at.append(np.arange(len(rows)) if k == 0 else np.flatnonzero(other))
        found = many.counts(changed)
        numbers.append(np.stack([found[c][at[-1]].astype(float) for c in COUNTED]))
    of, own = np.concatenate(at), np.array([p.facts() for p in single], dtype=float)
    out = {"variant": np.repeat(np.arange(len(EVERY), dtype="int32"), [len(a) for a in at])} | {c: about[c].to_numpy()[of] for c in about.columns}
    return pd.DataFrame(out | dict(zip(checks.OF_PAGE, own[of].T)) | dict(zip(COUNTED, np.concatenate(numbers, axis=1))))


def facts(pages: DataFrame, lines: DataFrame, regions: DataFrame, bands: DataFrame, areas: DataFrame, gutters: DataFrame, width: float, height: float, t: dict | None = None, seed: str = "0") -> DataFrame:
    """(variant, page_id, psr_trust, est_columns, any_gutter, OF_PAGE, COUNTED): a row for each row of ``pages`` with regions
    and each of EVERY, by place, that changes the page's regions; the first of EVERY leaves them as they are.

    ``regions`` are those of one system: sys, page_id, blk, box, cls, rank; a page's numbers differ.
    """
    t = checks.THRESHOLDS | (t or {})
    number = F.create_map(*[F.lit(v) for kv in checks.BUCKET_NUMBERS.items() for v in kv])
    named = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in NAMED]), F.col("cls")), F.lit(0)) - 1
    fields = ["blk", "rank", *spatial.SIDES, "kind", "named", *[f"d{k}" for k in range(len(DRAWN))]]
    drawn = [mutations.chance(mutations.seed_of(n, s, seed), *mutations.PAGE, "blk").alias(f"d{k}") for k, (n, s) in enumerate(DRAWN)]
    entry = F.struct("blk", "rank", *spatial.SIDES, F.element_at(number, bucket(F.col("cls"))).alias("kind"), named.alias("named"), *drawn)
    flat = checks.page_rows(pages, lines, regions, bands, areas, gutters, entry, fields).where("rs_blk IS NOT NULL")
    same = ["page_id", "psr_trust", "est_columns", "any_gutter"]
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    schema = ", ".join(["variant int"] + [f"`{c}` {kinds[c]}" for c in same] + [f"{c} double" for c in checks.OF_PAGE + COUNTED])

    return flat.mapInPandas(lambda batches: counted(batches, fields, same, width, height, t), schema)
