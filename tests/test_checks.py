"""Page checks on small pages made to fire what the stand-in pages do not."""

from pyspark.sql import functions as F

from pagequarry.operators import checks

W, H = 1000, 1000
BOX = "x1 long, y1 long, x2 long, y2 long"


AREA = f"page_id long, kind string, area_id long, {BOX}"


def found(spark, pages, lines, regions, areas=(), gutters=(), bands=((0, 0, 300), (1, 350, 650), (2, 700, 1000)), trust="full", columns=1):
    at = spark.createDataFrame([(v[0], list(bands)) for v in pages], "page_id long, bands array<struct<band_id: int, x0: long, x9: long>>")
    p = spark.createDataFrame([(*v[:2], v[2] if len(v) > 2 else 10, v[3] if len(v) > 3 else "ltr", trust, columns) for v in pages], "page_id long, doc string, font int, direction string, psr_trust string, est_columns int")
    li = spark.createDataFrame(lines, f"page_id long, line_id long, {BOX}")
    r = spark.createDataFrame([(0, *v) for v in regions], f"sys long, page_id long, doc string, blk long, {BOX}, cls string").withColumn("rank", F.col("blk"))
    facts = checks.features(p, li, r, at, spark.createDataFrame(list(areas), AREA), spark.createDataFrame(list(gutters), "page_id long, x0 long, x9 long"), W, H, [0]).cache()
    assert facts.count() == len(pages)
    found.skipped = {x["page_id"]: x["skipped"] for x in checks.judged(facts, H).collect()}
    return {(x["page_id"], x["check_id"]): x["value"] for x in checks.findings(facts, H).collect()}


def test_foot_and_swallowed_page(spark):
    lines = [(1, k, 10, 890 + 12 * k, 290, 900 + 12 * k) for k in range(4)] + [(2, k, 10, 890 + 12 * k, 290, 900 + 12 * k) for k in range(3)]
    got = found(spark, [(1, "d"), (2, "d"), (3, "d")], lines, [(3, "d", 0, 0, 0, 1000, 900, "text"), (2, "d", 0, 0, 0, 1000, 800, "text")])
    assert got[(1, "C1-06")] == 4 and (2, "C1-06") not in got
    assert got[(3, "C7-04")] == 1 and (2, "C7-04") not in got


def test_against_the_document(spark):
    pages = [(k, "a") for k in range(6)] + [(100 + k, "b") for k in range(20)]
    lines = [(k, n, 10, 100 + 20 * n, 290, 112 + 20 * n) for k in range(6) for n in range(20)]
    classes = ["header", "text", "table", "figure"]
    regions = [(k, "a", n, 10, 200 * n, 290, 200 * n + 150, c) for k in range(5) for n, c in enumerate(classes)]
    regions += [(5, "a", n, 10, 200 * n, 290, 200 * n + 150, "text") for n in range(4)]
    regions += [(100 + k, "b", n, 10, 30 * n, 290, 30 * n + 20, "text") for k in range(20) for n in range(30 if k == 7 else 2)]
    got = found(spark, pages, lines, regions)
    assert round(got[(5, "C8-01")], 4) == 0.8333 and got[(5, "C8-05")] == 1
    assert {p for p, c in got if c in ("C8-01", "C8-05")} == {5}
    assert round(got[(107, "C8-03")], 4) == round(19**0.5, 4) and sum(c == "C8-03" for _, c in got) == 1


def test_no_rows(spark):
    assert found(spark, [], [], []) == {}
    assert found(spark, [(1, "d")], [], []) == {}


def test_states_of_inputs(spark):
    """A page without bands that it may need leaves checks open; a page of one column has no use for them."""
    lines = [(1, k, 10, 100 + 30 * k, 290, 112 + 30 * k) for k in range(12)]
    found(spark, [(1, "d")], lines, [], bands=())
    assert found.skipped == {1: []}
    found(spark, [(1, "d")], lines, [], bands=(), columns=2)
    assert set(found.skipped[1]) == {"C1-04", "C3-02", "C3-05", "C4-02", "C4-03", "C6-05", "C7-04", "C8-02"}
    got = found(spark, [(1, "d")], lines, [(1, "d", 0, 0, 0, 2000, 900, "text")], trust="unusable")
    assert set(c for _, c in got) == {"C7-01"} and "C1-01" in found.skipped[1] and "C5-01" not in found.skipped[1]


def test_fonts_rows_and_units(spark):
    pages = [(k, "d", 30 if k == 5 else 20, "rtl") for k in range(6)]
    lines = [(k, n, 10 + 100 * (n % 3), 100 + 20 * (n // 3), 100 + 100 * (n % 3), 112 + 20 * (n // 3)) for k in range(6) for n in range(24)]
    # page 0 reads each row's three blocks from left to right; page 1 from right to left
    regions = [(k, "d", (n if k == 0 else 3 * (n // 3) + 2 - n % 3), 10 + 100 * (n % 3), 100 + 20 * (n // 3), 100 + 100 * (n % 3), 112 + 20 * (n // 3), "text") for k in range(2) for n in range(24)]
    got = found(spark, pages, lines, regions, areas=[(0, "grid", 0, 10, 90, 105, 300), (1, "graphic", 0, 0, 100, 400, 300), (1, "graphic", 1, 500, 100, 900, 300)], bands=((0, 0, 310),))
    assert got[(0, "C4-10")] == 1 and (1, "C4-10") not in got
    assert got[(5, "C8-06")] == 0.5
    assert got[(0, "C4-08")] == 14 and (1, "C4-08") not in got  # eight cells of the first column, two others after each
    assert got[(0, "C6-01")] == 1 and got[(1, "C1-07")] == 2


def test_first_block_makes_no_pair(spark):
    """A pair takes two blocks: on page 1, five blocks of which two follow one in their row are two pairs, one too few."""
    lines = [(p, n, 10 + 150 * (n % 2), 100 + 20 * (n // 2), 100 + 150 * (n % 2), 112 + 20 * (n // 2)) for p in (1, 2) for n in range(6)]
    regions = [(p, "d", n, *lines[6 * (p - 1) + n][2:], "text") for p in (1, 2) for n in range(5 if p == 1 else 6)]
    got = found(spark, [(1, "d", 20, "rtl"), (2, "d", 20, "rtl")], lines, regions)
    assert (1, "C4-10") not in got and got[(2, "C4-10")] == 1
