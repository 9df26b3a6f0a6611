"""Reading lines: the boxes of a page, which may be single glyphs, put together to the lines that a reader sees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the lower height that two boxes of a row overlap by, and gaps in heights of a line: along a row, and down a
#: column of upright boxes (fixed values).
ROW, ALONG, DOWN = 0.5, 0.6, 1.2
#: Height of a line on a page that has none (fixed value).
NO_HEIGHT = 10.0


def rows_of(box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines (rows x1, y1, x2, y2) and the line of each box. In order of top and left edge, a box joins the first line whose
    row it shares and that it is near enough to; lines grow as boxes join them."""
    n = box.shape[1]
    tall = (box[3] - box[1])[box[3] > box[1]]
    height = float(np.median(tall)) if tall.size else NO_HEIGHT
    line, of, made = np.empty((4, n)), np.full(n, -1), 0
    order = np.lexsort((box[0], box[1]))
    # where no two boxes share a row closely, none ever joins another
    low = np.maximum(np.minimum((box[3] - box[1])[:, None], box[3] - box[1]), 1e-6)
    close = np.minimum(box[3][:, None], box[3]) - np.maximum(box[1][:, None], box[1]) > ROW * low
    close &= box[0][:, None] <= box[2] + ALONG * height
    if (close & close.T).sum() <= n:
        of[order] = np.arange(n)
        return upright(box[:, order], of, height)
    for i in order:
        b, l = box[:, i], line[:, :made]
        shared = np.minimum(l[3], b[3]) - np.maximum(l[1], b[1])
        low = np.maximum(np.minimum(l[3] - l[1], b[3] - b[1]), 1e-6)
        near = np.flatnonzero((shared > ROW * low) & (b[0] <= l[2] + ALONG * height) & (b[2] >= l[0] - ALONG * height))
        if near.size:
            k = near[0]
            line[:2, k], line[2:, k] = np.minimum(line[:2, k], b[:2]), np.maximum(line[2:, k], b[2:])
        else:
            k, made = made, made + 1
            line[:, k] = b
        of[i] = k
    return upright(line[:, :made], of, height)


def upright(line: np.ndarray, of: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are taller than wide are runs of one upright line where they share a column and follow closely: each takes
    in the later ones it meets, again and again until none does."""
    tall = line[2] - line[0] < line[3] - line[1]
    if tall.sum() < 2:
        return line, of
    line, alive, into = line.copy(), np.ones(line.shape[1], dtype=bool), np.arange(line.shape[1])
    grown = True
    while grown:
        grown = False
        for a in range(line.shape[1]):
            if not alive[a] or line[2, a] - line[0, a] >= line[3, a] - line[1, a]:
                continue
            wide = line[2, a] - line[0, a]
            for b in range(a + 1, line.shape[1]):
                other = line[2, b] - line[0, b]
                if not alive[b] or other >= line[3, b] - line[1, b]:
                    continue
                beside = min(line[2, a], line[2, b]) - max(line[0, a], line[0, b]) > 0.5 * min(wide, other)
                if beside and max(line[1, a], line[1, b]) - min(line[3, a], line[3, b]) <= DOWN * height:
                    line[:2, a], line[2:, a] = np.minimum(line[:2, a], line[:2, b]), np.maximum(line[2:, a], line[2:, b])
                    alive[b], into[into == b], grown = False, a, True
    number = np.cumsum(alive) - 1
    return line[:, alive], number[into[of]] if of.size else of


def reading_lines(boxes: DataFrame) -> DataFrame:
    """``boxes`` (page_id, line_id, x1, y1, x2, y2) with ``read``, the reading line of each on its page.

    A page's boxes are one row of arrays, in order of line_id; ties of place go by that order.
    """

    @F.pandas_udf("array<int>")
    def owners(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        return pd.Series([rows_of(np.array([np.asarray(v, dtype=float) for v in page]))[1].astype("int32") for page in zip(x1, y1, x2, y2)])

    entry = F.struct("line_id", *[F.col(c) for c in boxes.columns if c not in ("page_id", "line_id")])
    page = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["line_id"] - b["line_id"]).cast("int")).alias("l"))
    page = page.withColumn("of", owners(*[F.col("l")[c].cast("array<double>") for c in ("x1", "y1", "x2", "y2")]))
    return page.select("page_id", F.explode(F.arrays_zip("l", "of")).alias("e")).select("page_id", "e.l.*", F.col("e.of").alias("read"))


def fragmentation(read: DataFrame) -> DataFrame:
    """(page_id, n_boxes, n_lines, fragmentation): boxes for each reading line; 1 where boxes are lines."""
    n = read.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_boxes"), F.countDistinct("read").alias("n_lines"))
    return n.withColumn("fragmentation", F.round(F.col("n_boxes") / F.greatest("n_lines", F.lit(1)), 3))
