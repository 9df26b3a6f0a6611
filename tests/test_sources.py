"""Routing, sources and streams on small cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import gate, routing
from pagequarry.sources import results, verdicts
from pagequarry.streaming import verdicts as streams

SMALL = "/root/testdata/sf0.001"
PLAIN = {"page_id": "p", "doc": "d", "n_chars": 3000, "n_lines": 50, "n_spans": 80, "rotation": 0, "median_chars_per_span": 20.0} | {
    k: 0.0 for k in "glyph_area_frac vector_area_frac image_area_frac big_image_area_frac lines_in_big_image_frac invisible_frac white_frac pua_cp_frac undecoded_cp_frac rtl_cp_frac lines_outside_crop_frac".split()
}


@pytest.mark.parametrize(
    ("change", "kind", "trust", "direction", "fired"),
    [
        ({}, "born_digital", "full", "ltr", []),
        ({"n_chars": 0, "n_lines": 0}, "scanned", "unusable", "unknown", ["C0-01", "C0-08"]),
        ({"n_lines": 2, "image_area_frac": 0.9}, "hybrid", "degraded", "ltr", ["C0-02"]),
        ({"invisible_frac": 0.5, "white_frac": 0.45}, "born_digital", "unusable", "ltr", ["C0-03"]),
        ({"vector_area_frac": 0.3, "glyph_area_frac": 0.01}, "hybrid", "unusable", "ltr", ["C0-10"]),
        ({"pua_cp_frac": 0.3, "rtl_cp_frac": 0.06, "undecoded_cp_frac": None}, "born_digital", "degraded", "rtl", ["C0-06"]),
    ],
)
def test_route(spark, change, kind, trust, direction, fired):
    schema = ", ".join(f"{k} {'string' if k in ('page_id', 'doc') else 'long' if isinstance(v, int) else 'double'}" for k, v in PLAIN.items())
    r = routing.route(spark.createDataFrame([tuple((PLAIN | change).values())], schema)).first()
    assert (r["page_kind"], r["psr_trust"], r["direction"], r["findings"]) == (kind, trust, direction, fired)
    assert routing.route(spark.createDataFrame([], schema)).count() == 0


def test_results(spark, tmp_path):
    for system, boxes in (("a", [[10.004, 5, 1, 2], [0, 0, 1]]), ("b", [[1, 1, 2, 2]])):
        (tmp_path / system).mkdir()
        page = {"system": system, "page_id": "p1", "regions": [{"class": "text", "bbox": [float(v) for v in b], "confidence": 0.1234567} for b in boxes]}
        (tmp_path / system / "p1.json").write_text(json.dumps(page, indent=1))
        (tmp_path / system / "_manifest.json").write_text('{"system": "a", "page_id": "no page"}')
    runs = spark.createDataFrame([("a", "ok"), ("b", "failed")], "system string, status string")
    got = results.regions(results.page_results(spark, str(tmp_path), runs)).select("system", "region_idx", "x1", "y1", "x2", "y2", "confidence").collect()
    assert [tuple(r) for r in got] == [("a", 0, 1.0, 2.0, 10.0, 5.0, 0.12346)]
    assert results.or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_verdicts_batch_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    good = [{"page_id": str(k), "system": "a", "frame": "audit", "outcome": "confirm" if k else "unusable"} for k in range(10)] + [{"page_id": "e", "system": "a", "frame": "escalation", "outcome": "correct", "regions": []}]
    bad = ['{"page_id": "x", "system": "a", "frame": "other", "outcome": "confirm"}', '{"page_id": "x", "system": "a", "frame": "audit", "outcome": "correct"}', '{"page_id": "x", "frame": "audit", "outcome": "confirm"}', "{no json"]
    (log / "one.txt").write_text("\n".join([*map(json.dumps, good), "", *bad]))
    valid, refused = verdicts.read_verdicts(spark, str(log))
    assert sorted(r["problem"] for r in refused.collect()) == ["correct without regions", "missing system", "not JSON", "unknown frame"]
    want = gate.estimate(valid).first().asDict()
    assert (want["audit_n"], want["audit_wrong"], want["escalation_n"], want["escalation_right"]) == (10, 1, 1, 1)
    verdicts.append_verdicts(valid.where("page_id = 'e'"), str(log))
    q = streams.running_estimate(streams.verdict_stream(spark, str(log))).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(90) and spark.table("running").first()["escalation_n"] == 2


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.event_counts(stream, late="1 day").writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("counts").collect()}
    batch = streams.event_counts(events).collect()
    assert got <= {(r["start"], r["event_type"], r["n"]) for r in batch} and got
    assert sum(r["n"] for r in batch) == events.select(F.countDistinct("event_id")).first()[0]
    assert streams.sessions(events).agg(F.sum("n")).first()[0] == events.count()
