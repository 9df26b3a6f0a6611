"""Page routing: what kind of page it is, how far its text can be trusted, and which check families apply.

One row in, one row out: all rules are expressions over a page's signals, so routing never shuffles. Only the direction
of text is decided per document, by an aggregation that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the routing rules (fixed values).
THRESHOLDS = {
    "min_chars": 1, "sparse_max_lines": 5, "sparse_min_ink": 0.15, "invisible_frac": 0.30, "ocr_lines_in_image": 0.60, "ocr_image_area": 0.50, "undecodable_frac": 0.20,
    "frag_max_chars_per_span": 1, "frag_min_spans": 200, "outline_vector_ink": 0.20, "outline_max_glyph": 0.05, "doc_rtl_aggregate": 0.05, "doc_rtl_max_page": 0.50, "doc_min_chars": 200, "clipped_frac": 0.05,
}
#: Check families that each kind of page supports (fixed values).
AVAILABLE = {"born_digital": "C1 C2 C3 C4 C5 C6 C7 C8", "hybrid": "C2 C4 C5 C7 C8", "scanned": "C5 C7 C8"}


def directions(signals: DataFrame, t: dict | None = None) -> DataFrame:
    """(doc, direction): rtl, ltr, or unknown where a document has too little text to tell."""
    t = THRESHOLDS | (t or {})
    g = signals.groupBy("doc").agg(F.sum("n_chars").alias("chars"), F.sum(F.col("n_chars") * F.col("rtl_cp_frac")).alias("rtl"), F.max("rtl_cp_frac").alias("most"))
    rtl = (F.col("rtl") / F.greatest("chars", F.lit(1)) > t["doc_rtl_aggregate"]) | (F.col("most") > t["doc_rtl_max_page"])
    return g.select("doc", F.when(F.col("chars") < t["doc_min_chars"], "unknown").when(rtl, "rtl").otherwise("ltr").alias("direction"))


def rules(t: dict) -> dict[str, Column]:
    """Condition of each finding, by its id. Optional signals that are null count as 0."""
    c = F.col
    part = lambda name: F.coalesce(c(name), F.lit(0.0))
    no_text = c("n_chars") < t["min_chars"]
    return {
        "C0-01": no_text,
        "C0-02": ~no_text & (c("n_lines") < t["sparse_max_lines"]) & (F.greatest("image_area_frac", "glyph_area_frac") > t["sparse_min_ink"]),
        "C0-03": part("invisible_frac") + part("white_frac") > t["invisible_frac"],
        "C0-04": (c("lines_in_big_image_frac") > t["ocr_lines_in_image"]) & (c("big_image_area_frac") > t["ocr_image_area"]),
        "C0-05": c("rotation") % 90 != 0,
        "C0-06": part("pua_cp_frac") + part("undecoded_cp_frac") > t["undecodable_frac"],
        "C0-07": (c("median_chars_per_span") <= t["frag_max_chars_per_span"]) & (c("n_spans") > t["frag_min_spans"]),
        "C0-08": c("direction") == "unknown",
        "C0-09": c("lines_outside_crop_frac") > t["clipped_frac"],
        "C0-10": (part("vector_area_frac") > t["outline_vector_ink"]) & (c("glyph_area_frac") < t["outline_max_glyph"]),
    }


def route(signals: DataFrame, t: dict | None = None) -> DataFrame:
    """(page_id, doc, page_kind, psr_trust, direction, available, findings): one row for each row of ``signals``."""
    t = THRESHOLDS | (t or {})
    rule = rules(t)
    hidden = F.coalesce("invisible_frac", F.lit(0.0)) + F.coalesce("white_frac", F.lit(0.0))
    x = signals.join(directions(signals, t), "doc", "left")
    x = x.withColumn("direction", F.coalesce("direction", F.lit("unknown")))
    kind = F.when(rule["C0-01"], "scanned").when(rule["C0-02"] | rule["C0-04"] | rule["C0-10"], "hybrid").otherwise("born_digital")
    x = x.withColumn("page_kind", kind)
    trust = F.when((F.col("page_kind") == "scanned") | (hidden > 0.90) | rule["C0-10"], "unusable").when((F.col("page_kind") == "hybrid") | rule["C0-07"] | rule["C0-06"] | rule["C0-09"], "degraded").otherwise("full")
    families = F.coalesce(*[F.when(F.col("page_kind") == k, F.split(F.lit(v), " ")) for k, v in AVAILABLE.items()])
    fired = F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond in sorted(rule.items())]), lambda v: v.isNotNull())
    return x.select("page_id", "doc", "page_kind", trust.alias("psr_trust"), "direction", families.alias("available"), fired.alias("findings"))
