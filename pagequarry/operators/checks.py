"""Page checks over one row of features per (system, page).

A page's lines, regions, bands, corridors and areas are brought together once, by the page's key: one row of arrays a page,
in which every feature of every system is counted with numpy, many pages in one Arrow batch. No lines meet regions as rows,
so nothing but the page's own boxes is shuffled, and once. A check is then one expression over a row of features, and all
checks of a page are read off in one pass. Which checks can run on a page is read off the same row: a check whose inputs
the page has no use for says nothing, one whose inputs could not be read counts as unverifiable, and neither ever counts
as passed by accident.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions.geometry import bucket
from pagequarry.operators import reading, spatial

KEYS = ["sys", "page_id"]
#: Thresholds of the checks (fixed values).
THRESHOLDS = {
    "lost_lines": 4, "orphan_lines": 0.12, "orphan_area": 0.12, "orphan_run": 3, "run_gap": 1.8, "column_lines": 10, "orphan_in_column": 0.12, "text_lines": 10, "text_cover": 0.6, "foot_band": 0.12, "foot_lines": 4, "graphic_area": 0.02, "graphics": 2,
    "cut_min": 0.15, "cut_max": 0.85, "cut_cover": 0.05, "cut_rate": 0.15, "gutter_cover": 0.6, "band_span": 0.2, "band_lines": 5, "band_share": 0.85, "inversions": 2, "excess_transitions": 2, "unit_lines": 6, "unit_slack": 0.25,
    "backward_jumps": 3, "rtl_pairs": 3, "rtl_wrong": 0.5, "overlap_regions": 4, "overlap_rate": 0.30, "double_rate": 0.02, "repeat_regions": 4, "repeat_rate": 0.20, "grid_cover": 0.5, "media_lines": 5, "media_graphic": 0.15, "margin_band": 0.08,
    "discard_lines": 3, "discard_rate": 0.15, "beyond": 0.02, "aspect": 60.0, "page_share": 0.85, "body_cover": 0.40, "doc_pages": 5, "running_rate": 0.8, "body_lines": 20, "region_z": 4.0, "doc_classes": 4, "class_regions": 3, "font_shift": 0.4,
}
#: What a check needs (fixed values); those not named need the page's structure alone.
NEEDS = {
    "C1-01": "psr body_lines", "C1-02": "psr body_lines", "C1-03": "psr body_lines", "C1-04": "psr body_lines bands", "C1-05": "psr body_lines", "C1-06": "psr body_lines", "C1-07": "psr graphics", "C2-01": "psr body_lines",
    "C3-01": "psr gutters", "C3-02": "psr bands", "C3-05": "psr bands", "C4-02": "psr bands stream", "C4-03": "psr bands stream", "C4-08": "psr stream", "C4-09": "psr stream", "C4-10": "psr stream", "C5-01": "", "C6-01": "psr grids",
    "C6-05": "psr bands", "C7-01": "", "C7-04": "psr bands", "C7-05": "psr body_lines", "C8-01": "psr doc body_lines", "C8-02": "psr doc bands", "C8-03": "psr doc", "C8-05": "psr doc", "C8-06": "psr doc body_lines",
}
#: Checks that are views of one defect: only the last that fires goes to the gate (fixed values).
GROUPS = (("C1-01", "C1-02", "C1-03", "C1-04"), ("C3-01", "C3-02"))


#: Counts that a page is reduced to for each system, and facts of the page itself.
OF_SYSTEM = """n_orphans lost_ink lost_in_band lost_at_foot orphan_run n_cut n_twice n_empty n_bare n_partly n_again n_regions n_classes running n_text total beyond n_thin n_huge n_inside n_thrown n_spanning
n_through n_unseen top_band n_missed_graphics n_missed_grids transitions jumps inversions row_pairs row_wrong intruders""".split()
OF_PAGE = "n_lines ink least_band n_columns body line_h n_read in_band n_bands n_gutters n_graphics n_grids".split()
BUCKET_NUMBERS = {"TEXT": 0, "TABLE": 1, "MEDIA": 2, "DISCARD": 3}
TEXT, TABLE, MEDIA, DISCARD = range(4)


def areas_of(b: np.ndarray) -> np.ndarray:
    return np.maximum(b[2] - b[0], 0) * np.maximum(b[3] - b[1], 0)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that each box of ``a`` (rows x1, y1, x2, y2) has in common with each of ``b``."""
    w = np.minimum(a[2][:, None], b[2]) - np.maximum(a[0][:, None], b[0])
    h = np.minimum(a[3][:, None], b[3]) - np.maximum(a[1][:, None], b[1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def covers(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Share of each inner box that lies in each outer one."""
    return shared(inner, outer) / np.maximum(areas_of(inner), 1e-6)[:, None]


def band_numbers(box: np.ndarray, bands: np.ndarray, width: float, full: float = 0.62) -> np.ndarray:
    """Place of the only band (rows x0, x9) that takes more than half of a box's width; -1 for none, and for wide boxes."""
    wide = box[2] - box[0]
    taken = np.minimum(box[2][:, None], bands[1]) - np.maximum(box[0][:, None], bands[0]) > 0.5 * wide[:, None]
    return np.where((wide <= full * width) & (taken.sum(axis=1) == 1), taken.argmax(axis=1) if bands.shape[1] else -1, -1)


def rows_meet(line: np.ndarray) -> np.ndarray:
    """Whether each line shares its row with each other, by more than half of its height."""
    return np.minimum(line[3][:, None], line[3]) - np.maximum(line[1][:, None], line[1]) > 0.5 * np.maximum(line[3] - line[1], 1e-6)[:, None]


def running_bands(bands: np.ndarray, line: np.ndarray, meet: np.ndarray | None, most: float = 0.5) -> np.ndarray:
    """``spatial.merged_bands`` on a page's arrays."""
    within = lambda b: np.flatnonzero((line[0] >= b[0] - 2) & (line[2] <= b[1] + 2))
    done: list[list[float]] = []
    for b in bands.T.tolist():
        if done:
            left, right = within(done[-1]), within(b)
            if left.size and right.size and meet[np.ix_(left, right)].any(axis=1).sum() > most * left.size:
                done[-1][1] = b[1]
                continue
        done.append(b)
    return np.array(done).T if done else bands


def apart(corridors: np.ndarray, line: np.ndarray, meet: np.ndarray | None, most: float = 0.5) -> np.ndarray:
    """``open_corridors`` on a page's arrays."""
    kept = np.zeros(corridors.shape[1], dtype=bool)
    for k, (x0, x9) in enumerate(corridors.T):
        w = x9 - x0
        left, right = np.flatnonzero((line[2] <= x0 + 2) & (line[2] > x0 - 6 * w)), np.flatnonzero((line[0] >= x9 - 2) & (line[0] < x9 + 6 * w))
        kept[k] = left.size > 0 and right.size > 0 and meet[np.ix_(left, right)].any(axis=1).sum() <= most * left.size
    return corridors[:, kept]


class Page:
    """What all systems share of a page: lines, reading lines, bands, corridors, areas."""

    def __init__(self, line: np.ndarray, bands: np.ndarray, gutters: np.ndarray, graphics: np.ndarray, grids: np.ndarray, width: float, height: float, t: dict):
        self.line, self.bands, self.gutters, self.graphics, self.grids, self.width, self.height, self.t = line, bands, gutters, graphics, grids, width, height, t
        self.n = line.shape[1]
        self.read, self.of = reading.rows_of(line)
        self.read_size = np.bincount(self.of, minlength=self.read.shape[1])
        self.band, self.read_band = band_numbers(line, bands, width), band_numbers(self.read, bands, width)
        self.line_h = float(np.median(line[3] - line[1])) if self.n else reading.NO_HEIGHT
        middle = (line[1] + line[3]) / 2
        self.content = (middle >= t["margin_band"] * height) & (middle <= (1 - t["margin_band"]) * height)
        self.large = graphics[:, areas_of(graphics) > t["graphic_area"] * width * height]
        self.units = np.concatenate([graphics, grids], axis=1)

    def facts(self) -> list[float]:
        held, line = self.band[self.band >= 0], self.line
        per_band = np.unique(held, return_counts=True)[1]
        body = (line[2].max() - line[0].min()) * (line[3].max() - line[1].min()) if self.n else 0
        return [self.n, areas_of(line).sum(), per_band.min() if per_band.size else 0, per_band.size, body, self.line_h, self.read.shape[1], (self.read_band >= 0).sum(), self.bands.shape[1], self.gutters.shape[1], self.graphics.shape[1], self.grids.shape[1]]

    def counts(self, box: np.ndarray, blk: np.ndarray, rank: np.ndarray, kind: np.ndarray, cls: np.ndarray) -> list[float]:
        """The counts of OF_SYSTEM for a system's regions, given in order of ``blk``."""
        t, line, m = self.t, self.line, box.shape[1]
        held = covers(line, box)
        best = held.argmax(axis=1) if m else np.zeros(self.n, dtype=int)
        owner = np.where(held[np.arange(self.n), best] >= 0.5, best, -1) if m else np.full(self.n, -1)
        k = np.bincount(owner[owner >= 0], minlength=m)
        band, size = band_numbers(box, self.bands, self.width), areas_of(box)
        return [*self.lost(owner < 0), *self.on_lines(box, held, kind), *self.siblings(box, kind, size), *self.alone(box, kind, cls, k, band, size), *self.missed(box, kind), *self.order(box, blk, rank, k, band, owner)]

    def lost(self, orphan: np.ndarray) -> list[float]:
        """Lost reading lines, those of whose boxes none is in a region: outside the margins, or anywhere at the page's foot."""
        gone = orphan & self.content
        lost = np.bincount(self.of[gone], minlength=len(self.read_size)) == self.read_size
        anywhere = np.bincount(self.of[orphan], minlength=len(self.read_size)) == self.read_size
        at = np.flatnonzero(lost)
        at = at[np.argsort(self.read[1, at], kind="stable")]
        run = 0
        if at.size:
            broken = np.flatnonzero(self.read[1, at[1:]] - self.read[3, at[:-1]] > self.t["run_gap"] * self.line_h) + 1
            run = np.diff(np.concatenate(([0], broken, [at.size]))).max()
        return [at.size, areas_of(self.line[:, gone]).sum(), (lost & (self.read_band >= 0)).sum(), (anywhere & (self.read[1] >= self.height * (1 - self.t["foot_band"]))).sum(), run]

    def on_lines(self, box: np.ndarray, held: np.ndarray, kind: np.ndarray) -> list[float]:
        """Lines that a region ends within, lines that two text regions hold of which neither lies in the other, text regions
        without a line, and reading lines that no table region covers on a page without text regions."""
        t, line, text = self.t, self.line, kind == TEXT
        along = (np.minimum(line[2][:, None], box[2]) - np.maximum(line[0][:, None], box[0])) / np.maximum(line[2] - line[0], 1e-6)[:, None]
        cut = (along > t["cut_min"]) & (along < t["cut_max"]) & (held > t["cut_cover"])
        hold, within = held[:, text] >= 0.5, covers(box[:, text], box[:, text])
        apart = np.triu((within < 0.9) & (within.T < 0.9), 1)
        twice = ((hold.astype(np.int32) @ apart.astype(np.int32) > 0) & hold).any(axis=1)
        empty = ~(hold.any(axis=0) | (covers(box[:, text], line) >= 0.5).any(axis=1))
        bare = 0 if text.any() else (~(covers(self.read, box[:, kind == TABLE]) >= t["text_cover"]).any(axis=1)).sum()
        return [cut.any(axis=1).sum(), twice.sum(), empty.sum(), bare]

    def siblings(self, box: np.ndarray, kind: np.ndarray, size: np.ndarray) -> list[float]:
        """Regions that partly overlap one of their bucket, and repeats of an earlier one that is no repeat itself."""
        part = shared(box, box) / np.maximum(np.minimum(size[:, None], size), 1e-6)
        partly = (part > 0.5) & (part <= 0.9) & (kind[:, None] == kind) & ~np.eye(len(size), dtype=bool)
        near = (np.abs(box[:, :, None] - box[:, None, :]) <= max(0.5 * self.line_h, 4.0)).all(axis=0) & (kind[:, None] == kind)
        kept = np.ones(len(size), dtype=bool)
        for i in np.flatnonzero(np.tril(near, -1).any(axis=1)):
            kept[i] = not (near[i, :i] & kept[:i]).any()
        return [partly.any(axis=1).sum(), (~kept).sum()]

    def alone(self, box: np.ndarray, kind: np.ndarray, cls: np.ndarray, k: np.ndarray, band: np.ndarray, size: np.ndarray) -> list[float]:
        """Counts over regions by themselves, against the page, its bands, corridors and graphics."""
        t, page = self.t, self.width * self.height
        if not len(size):
            return [0] * 8 + [0] * 5 + [np.nan]
        wide, high = box[2] - box[0], box[3] - box[1]
        low, top, text, running = np.minimum(wide, high), np.maximum(wide, high), kind == TEXT, kind == DISCARD
        beyond = max(-box[0].min(), -box[1].min(), box[2].max() - self.width, box[3].max() - self.height)
        middle = (box[1] + box[3]) / 2
        inside = running & (k > t["discard_lines"]) & (middle >= t["margin_band"] * self.height) & (middle <= (1 - t["margin_band"]) * self.height) & (band >= 0)
        over = lambda at, share: np.minimum(box[2][:, None], at[1]) - np.maximum(box[0][:, None], at[0]) > share * (at[1] - at[0])
        drawn = covers(box, self.graphics).max(axis=1) if self.graphics.shape[1] else np.zeros(len(size))
        in_band = np.bincount(band[band >= 0], k[band >= 0]) if (band >= 0).any() else np.array([])
        return [
            len(size), len(set(cls)), int(running.any()), text.sum(), size.sum(), beyond, ((size > 0) & (top / np.maximum(low, 1e-6) > t["aspect"]) & (k == 0)).sum(), (size > t["page_share"] * page).sum(), inside.sum(), k[running].sum(),
            (text & (over(self.bands, t["band_span"]).sum(axis=1) >= 2)).sum(), (text & over(self.gutters, t["gutter_cover"]).any(axis=1)).sum(), ((kind == MEDIA) & (k > t["media_lines"]) & (drawn < t["media_graphic"])).sum(),
            in_band.max() / max(in_band.sum(), 1) if in_band.size else np.nan,
        ]

    def missed(self, box: np.ndarray, kind: np.ndarray) -> list[float]:
        """Large graphics without a media region on them, and grids without a table region."""
        none = lambda at, of, least: (~(covers(at, box[:, kind == of]) > least).any(axis=1)).sum()
        return [none(self.large, MEDIA, 0.5), none(self.grids, TABLE, self.t["grid_cover"])]

    def order(self, box: np.ndarray, blk: np.ndarray, rank: np.ndarray, k: np.ndarray, band: np.ndarray, owner: np.ndarray) -> list[float]:
        """What is odd about the reading order: changes of column, jumps back, blocks out of order in their column, pairs in
        one row and those that move right, and lines between those of a unit that should be read together."""
        t, line = self.t, self.line
        mine = np.flatnonzero(owner >= 0)
        mine = mine[np.lexsort((mine, line[0, mine], line[1, mine], blk[owner[mine]], rank[owner[mine]]))] if mine.size else mine
        along = self.band[mine][self.band[mine] >= 0]
        full = np.flatnonzero(k > 0)
        b = full[np.lexsort((blk[full], rank[full]))]
        room = max(3 * self.line_h, 40.0)
        x, y = b[:-1], b[1:]
        back = (box[1, y] < box[3, x] - room) & ~((band[x] >= 0) & (band[y] >= 0) & (band[x] != band[y]))
        low = np.minimum(box[3, x] - box[1, x], box[3, y] - box[1, y])
        row = (low > 0) & (np.minimum(box[3, x], box[3, y]) - np.maximum(box[1, x], box[1, y]) >= 0.5 * low)
        c = full[band[full] >= 0]
        c = c[np.lexsort((blk[c], box[1, c], rank[c], band[c]))]
        up = (band[c[1:]] == band[c[:-1]]) & (box[1, c[1:]] < box[1, c[:-1]] - room)
        between = 0
        if self.units.shape[1] and mine.size:
            reads, first = np.unique(self.of[mine], return_index=True)
            place = np.empty(len(reads), dtype=int)
            place[np.argsort(first)] = np.arange(len(reads))
            inside = covers(self.read[:, reads], self.units) >= 0.6
            for u in np.flatnonzero(inside.sum(axis=0) >= t["unit_lines"]):
                at = place[inside[:, u]]
                other = at.max() - at.min() + 1 - at.size
                between = max(between, other if other > t["unit_slack"] * at.size else 0)
        return [(along[1:] != along[:-1]).sum(), back.sum(), up.sum(), row.sum(), (row & (box[0, y] > box[0, x])).sum(), between]


def document_profile(facts: DataFrame) -> DataFrame:
    """(sys, doc, doc_n, doc_running, doc_mean, doc_sd, doc_classes, doc_columns, doc_font): each document's usual page. Of
    equally frequent numbers of columns, the one of the first page; fonts of no size count for nothing.

    Pages are counted by their few distinct kinds before a document meets in one task.
    """
    n = F.col("n_regions")
    by_kind = facts.groupBy("sys", "doc", "n_columns", "n_classes", "font").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"), F.sum("running").alias("running"), F.sum(n).alias("s"), F.sum(n * n).alias("ss"))
    w = Window.partitionBy("sys", "doc", "n_columns")
    x = by_kind.withColumn("place", F.struct((-F.sum("n").over(w)).alias("n"), F.min("first").over(w).alias("first")))
    x = x.groupBy("sys", "doc").agg(
        F.sum("n").alias("doc_n"), F.sum("running").alias("running"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.percentile("n_classes", F.lit(0.5), F.col("n")).alias("doc_classes"), F.min_by("n_columns", "place").alias("doc_columns"),
        F.percentile(F.when(F.col("font") > 0, F.col("font")), F.lit(0.5), F.col("n")).alias("doc_font"),
    )
    sd = F.sqrt(F.greatest(F.col("doc_n") * F.col("ss") - F.col("s") * F.col("s"), F.lit(0.0))) / F.col("doc_n")
    return x.select("sys", "doc", "doc_n", (F.col("running") / F.col("doc_n")).alias("doc_running"), (F.col("s") / F.col("doc_n")).alias("doc_mean"), sd.alias("doc_sd"), "doc_classes", "doc_columns", "doc_font")


def open_corridors(gutters: Column, lines: Column, most: float = 0.5) -> Column:
    """Corridors (x0, x9) whose two sides are read apart, not row by row as a table's are."""

    def apart(g: Column) -> Column:
        w = g["x9"] - g["x0"]
        left = F.filter(lines, lambda q: (q["x2"] <= g["x0"] + 2) & (q["x2"] > g["x0"] - 6 * w))
        right = F.filter(lines, lambda q: (q["x1"] >= g["x9"] - 2) & (q["x1"] < g["x9"] + 6 * w))
        return (F.size(left) > 0) & (F.size(right) > 0) & (F.size(spatial.in_rows_of(left, right)) <= most * F.size(left))

    return F.filter(gutters, apart)


def lines_of_pages(lines: DataFrame) -> DataFrame:
    """(page_id, ls): a page's lines in one row, in order of line_id."""
    return lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_id", *spatial.SIDES))).alias("ls"))


def column_gutters(lines: DataFrame, gutters: DataFrame) -> DataFrame:
    """(page_id, gutters): the corridors (page_id, x0, x9) of each page that really part two columns."""
    held = gutters.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("x0", "x9"))).alias("gutters"))
    return held.join(lines_of_pages(lines), "page_id").select("page_id", open_corridors(F.col("gutters"), F.col("ls")).alias("gutters")).where(F.size("gutters") > 0)


def page_rows(pages: DataFrame, lines: DataFrame, regions: DataFrame, bands: DataFrame, areas: DataFrame, gutters: DataFrame, region: Column, numbers: list[str], others: list[str] = ()) -> DataFrame:
    """Each row of ``pages`` with arrays of what lies on its page, as columns of numbers: lines (ls_*), regions (rs_*, those
    fields of ``region`` and ``others`` as they are), raw bands, corridors (gs_*), graphics and grids."""
    x = pages.join(lines_of_pages(lines), "page_id", "left").join(regions.groupBy("page_id").agg(F.array_sort(F.collect_list(region)).alias("rs")), "page_id", "left")
    x = x.join(bands.select("page_id", "bands"), "page_id", "left").join(gutters.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("x0", "x9"))).alias("gs")), "page_id", "left")
    x = x.join(areas.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("kind", "area_id", *spatial.SIDES))).alias("areas")), "page_id", "left")
    as_numbers = lambda a, c: F.col(a)[c].cast("array<double>").alias(f"{a}_{c}")
    of = lambda kind: F.filter("areas", lambda v: v["kind"] == kind)
    x = x.select(*pages.columns, (F.size(F.coalesce("gs", F.array())) > 0).alias("any_gutter"), "ls", "rs", "bands", "gs", of("graphic").alias("graphics"), of("grid").alias("grids"))
    each = [as_numbers(a, c) for a in ("ls", "graphics", "grids") for c in spatial.SIDES] + [as_numbers(a, c) for a in ("bands", "gs") for c in ("x0", "x9")]
    return x.select(*pages.columns, "any_gutter", *each, *[as_numbers("rs", c) for c in numbers], *[F.col("rs")[c].alias(c) for c in others])


def stack(r: dict, a: str, names: list[str]) -> np.ndarray:
    """Columns of numbers of a row of ``page_rows`` as rows of an array."""
    none = np.empty(0)
    return np.stack([none if r[f"{a}_{c}"] is None else np.asarray(r[f"{a}_{c}"], dtype=float) for c in names])


def page_of(r: dict, width: float, height: float, t: dict) -> Page:
    """The page of a row of ``page_rows``."""
    line, bands, corridors = stack(r, "ls", spatial.SIDES), stack(r, "bands", ("x0", "x9")), stack(r, "gs", ("x0", "x9"))
    meet = rows_meet(line) if bands.shape[1] > 1 or corridors.shape[1] else None
    return Page(line, running_bands(bands, line, meet), apart(corridors, line, meet), stack(r, "graphics", spatial.SIDES), stack(r, "grids", spatial.SIDES), width, height, t)


def features(pages: DataFrame, lines: DataFrame, regions: DataFrame, bands: DataFrame, areas: DataFrame, gutters: DataFrame, width: float, height: float, systems: list[int], t: dict | None = None) -> DataFrame:
    """One row for each of ``systems`` and row of ``pages`` (page_id, doc, font, direction, psr_trust, est_columns).

    ``regions`` carry ``rank``, the order of blocks; ``areas`` (page_id, kind, area_id, box) are graphics and table grids. A
    page without lines or regions counts 0 of them.
    """
    t = THRESHOLDS | (t or {})
    number = F.create_map(*[F.lit(v) for kv in BUCKET_NUMBERS.items() for v in kv])
    region = F.struct("sys", "blk", "rank", *spatial.SIDES, F.element_at(number, bucket(F.col("cls"))).alias("kind"), "cls")
    flat = page_rows(pages, lines, regions, bands, areas, gutters, region, [*spatial.SIDES, "sys", "blk", "rank", "kind"], ["cls"])
    kept = [c for c in pages.columns]
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["any_gutter boolean", "sys long"] + [f"{c} double" for c in OF_PAGE + OF_SYSTEM])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, r in enumerate(batch.to_dict("records")):
                page = page_of(r, width, height, t)
                box, of_region = stack(r, "rs", spatial.SIDES), stack(r, "rs", ("sys", "blk", "rank", "kind"))
                cls = np.asarray(r["cls"] if r["cls"] is not None else [], dtype=object)
                facts = page.facts()
                for s in systems:
                    mine = of_region[0] == s
                    out.append((i, s, *facts, *page.counts(box[:, mine], of_region[1, mine], of_region[2, mine], of_region[3, mine].astype(int), cls[mine])))
            counted = pd.DataFrame(out, columns=["i", "sys", *OF_PAGE, *OF_SYSTEM])
            rows = batch[[*kept, "any_gutter"]].iloc[counted["i"]].reset_index(drop=True)
            yield pd.concat([rows, counted.drop(columns="i").astype({c: "float64" for c in OF_PAGE + OF_SYSTEM})], axis=1)

    facts = flat.mapInPandas(count, schema)
    return facts.join(document_profile(facts), ["sys", "doc"], "left")


def rules(t: dict) -> dict[str, tuple[Column, Column]]:
    """Condition and value of each check."""
    c = F.col
    of = lambda n, m: c(n) / F.greatest(m, F.lit(1))
    many, lost = c("doc_n") >= t["doc_pages"], c("lost_ink") / F.greatest("ink", F.lit(1e-6))
    excess, cover_ = c("transitions") - (c("n_bands") - 1), c("total") / F.greatest("body", F.lit(1))
    z, columns = F.abs(c("n_regions") - c("doc_mean")) / F.greatest("doc_sd", F.lit(1e-9)), c("n_bands") >= 2
    font, enough = F.abs(c("font") - c("doc_font")) / c("doc_font"), c("n_orphans") >= t["lost_lines"]
    out = {
        "C1-01": (enough & (of("n_orphans", "n_read") > t["orphan_lines"]), of("n_orphans", "n_read")),
        "C1-02": (enough & (lost > t["orphan_area"]), lost),
        "C1-03": (c("orphan_run") >= t["orphan_run"], c("orphan_run")),
        "C1-04": ((c("in_band") >= t["column_lines"]) & (of("lost_in_band", "in_band") > t["orphan_in_column"]), of("lost_in_band", "in_band")),
        "C1-05": ((c("n_text") == 0) & (c("n_bare") >= t["text_lines"]), c("n_bare")),
        "C1-06": (c("lost_at_foot") >= t["foot_lines"], c("lost_at_foot")),
        "C1-07": (c("n_missed_graphics") >= t["graphics"], c("n_missed_graphics")),
        "C2-01": (of("n_cut", "n_lines") > t["cut_rate"], of("n_cut", "n_lines")),
        "C2-06": (c("n_empty") > 0, c("n_empty")),
        "C3-01": (c("n_through") > 0, c("n_through")),
        "C3-02": (columns & (c("n_spanning") > 0), c("n_spanning")),
        "C3-05": (columns & (c("n_columns") >= 2) & (c("least_band") >= t["band_lines"]) & (F.coalesce(F.nanvl("top_band", F.lit(1.0)), F.lit(1.0)) > t["band_share"]), F.coalesce(F.nanvl("top_band", F.lit(1.0)), F.lit(1.0))),
        "C4-02": (c("inversions") >= t["inversions"], c("inversions")),
        "C4-03": (columns & (excess > t["excess_transitions"]), excess),
        "C4-08": (c("intruders") > 0, c("intruders")),
        "C4-09": (c("jumps") >= t["backward_jumps"], c("jumps")),
        "C4-10": ((c("direction") == "rtl") & (c("row_pairs") >= t["rtl_pairs"]) & (of("row_wrong", "row_pairs") > t["rtl_wrong"]), of("row_wrong", "row_pairs")),
        "C5-01": ((c("n_partly") >= t["overlap_regions"]) & (of("n_partly", "n_regions") > t["overlap_rate"]), of("n_partly", "n_regions")),
        "C5-03": (of("n_twice", "n_lines") > t["double_rate"], of("n_twice", "n_lines")),
        "C5-04": ((c("n_regions") >= t["repeat_regions"]) & (of("n_again", "n_regions") > t["repeat_rate"]), of("n_again", "n_regions")),
        "C6-01": (c("n_missed_grids") > 0, c("n_missed_grids")),
        "C6-03": (c("n_unseen") > 0, c("n_unseen")),
        "C6-05": (c("n_inside") > 0, c("n_inside")),
        "C6-06": (of("n_thrown", "n_lines") > t["discard_rate"], of("n_thrown", "n_lines")),
        "C7-01": (c("beyond") > t["beyond"] * c("page_side"), c("beyond")),
        "C7-03": (c("n_thin") > 0, c("n_thin")),
        "C7-04": ((c("n_bands") >= 3) & (c("n_huge") > 0), c("n_huge")),
        "C7-05": ((c("n_regions") > 0) & (cover_ < t["body_cover"]), cover_),
        "C8-01": (many & (c("doc_running") >= t["running_rate"]) & (c("n_lines") >= t["body_lines"]) & (c("running") == 0), c("doc_running")),
        "C8-02": (many & (c("n_columns") != c("doc_columns")), c("n_columns")),
        "C8-03": (many & (c("doc_sd") >= 1) & (z > t["region_z"]), z),
        "C8-05": (many & (c("doc_classes") >= t["doc_classes"]) & (c("n_classes") <= 1) & (c("n_regions") > t["class_regions"]), c("n_classes")),
        "C8-06": (many & (c("font") > 0) & (c("doc_font") > 0) & (c("n_lines") >= t["body_lines"]) & (font > t["font_shift"]), font),
    }
    return {k: (F.coalesce(cond, F.lit(False)), v) for k, (cond, v) in out.items()}


#: For each input of checks, as SQL over a row of features: whether a page has it, and whether a page without it has no use
#: for it.
STATES = {
    "psr": ("psr_trust <> 'unusable'", "false"), "body_lines": ("n_lines > 0", "false"), "bands": ("n_bands >= 1", "est_columns <= 1"), "gutters": ("n_gutters > 0", "(n_bands <= 1 OR any_gutter)"),
    "grids": ("n_grids > 0", "true"), "graphics": ("n_graphics > 0", "true"), "stream": ("true", "false"), "doc": ("doc_n IS NOT NULL", "true"),
}


def availability(check: str) -> tuple[str, str]:
    """Whether a check can run on a page, and whether it could not although the page may need it (unverifiable), as SQL."""
    needs = [STATES[n] for n in NEEDS.get(check, "psr").split()]
    runs = " AND ".join(have for have, _ in needs) or "true"
    excused = " AND ".join(f"({have} OR {no_use})" for have, no_use in needs) or "true"
    return f"({runs})", f"(NOT ({runs}) AND NOT ({excused}))"


def firing(t: dict | None = None, strongest: bool = False) -> dict[str, Column]:
    """Whether each check can run on a row of ``features`` and fires; ``page_side`` is its longer side. With ``strongest``, of
    checks that are views of one defect only the last that fires is left."""
    every = rules(THRESHOLDS | (t or {}))
    fires = {k: cond & F.expr(availability(k)[0]) for k, (cond, _) in every.items()}
    shown = dict(fires)
    for group in GROUPS if strongest else ():
        for i, k in enumerate(group):
            for later in group[i + 1 :]:
                shown[k] = shown[k] & ~fires[later]
    return shown


def fired(t: dict | None = None, strongest: bool = False) -> Column:
    """Array of (check_id, value) of the checks that are ``firing``."""
    shown = firing(t, strongest)
    found = [F.when(shown[k], F.struct(F.lit(k).alias("check_id"), F.round(v.cast("double"), 6).alias("value"))) for k, (_, v) in rules(THRESHOLDS | (t or {})).items()]
    return F.array_compact(F.array(*found))


def gate_checks() -> list[str]:
    return sorted(rules(THRESHOLDS))


def skipped() -> Column:
    """Ids of the checks that could not run on a page that may need them."""
    return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {availability(k)[1]} THEN '{k}' END" for k in gate_checks()) + "))")


def findings(facts: DataFrame, side: float, t: dict | None = None) -> DataFrame:
    """(sys, page_id, check_id, value): what fires on each row of ``features``; ``side`` is the page's longer one."""
    return facts.withColumn("page_side", F.lit(float(side))).select(*KEYS, F.explode(fired(t)).alias("f")).select(*KEYS, "f.check_id", "f.value")


def judged(facts: DataFrame, side: float, t: dict | None = None) -> DataFrame:
    """(sys, page_id, psr_trust, found, skipped): what the gate decides by, a row for each row of ``features``."""
    return facts.withColumn("page_side", F.lit(float(side))).select(*KEYS, "psr_trust", fired(t, strongest=True)["check_id"].alias("found"), skipped().alias("skipped"))
