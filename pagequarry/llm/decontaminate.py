"""Benchmark decontamination through a distributed positional inverted index, in DataFrame operations alone.

Test items become windows of ``WINDOW`` consecutive words. For each window the two rarest terms are chosen by their
frequency in all training texts; only these terms are indexed. The index has a posting for each of their occurrences:
term, document, position and the words around it. A search begins at the list of a window's rarest term, shifts it by
the term's offset in the window, intersects it with the shifted list of the second term, and keeps the starts at which
the whole window stands. Texts are split where they are scanned and only postings are shuffled, so what moves follows
the rare terms and not the corpus. The same lists answer proximity searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import lower_ascii, stage_table, table

WINDOW = 10
#: What parts words: ASCII without digits and lower-case letters (after A-Z are lowered).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and pairs up to this count are sent to every task; more are joined by a shuffle. Terms go to the texts in parts of
#: at most so many terms and characters, each part with a scan of its own, so that no text is ever shuffled.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32_000_000


def item_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BREAK), lambda w: w != "")


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast where the counted rows are few; else the planner's choice."""
    return F.broadcast(df) if rows <= most else df


def windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: (item, win array of words). An item shorter than ``window`` is one window; without words, none."""
    ws = items.select(F.col(item), item_words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    return ws.select(item, F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("win")).distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """(ref, ws, pos, term) of texts that are split: the array of words stays beside each of its words."""
    return docs.select("ref", "ws", F.posexplode("ws").alias("pos", "term"))


def split_texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(ref, ws). ``ref`` tells rows apart that share an id but not a text, and carries a null id."""
    return docs.select(F.struct(F.col(doc).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h")).alias("ref"), item_words(F.col(text)).alias("ws"))


def at_terms(docs: DataFrame, terms: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The tokens of texts that are among ``terms`` (term), which go to the texts in parts of a checked size."""
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // most), -(-size["chars"] // BROADCAST_CHARS))
    found = None
    for k in range(parts):
        mine = tokens(docs).join(F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) if parts > 1 else terms), "term")
        found = mine if found is None else found.unionByName(mine)
    return found


def term_frequencies(docs: DataFrame, terms: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(term, df): occurrences in all texts, 0 for terms that none has."""
    found = at_terms(docs, terms, most).select("term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(wins: DataFrame, frequencies: DataFrame) -> DataFrame:
    """For each window its rarest term and the second: (wid, win, size, a, a_off, b, b_off). One word: b is a."""
    placed = wins.select("wid", "win", F.posexplode("win").alias("off", "term")).join(frequencies, "term")
    ranked = placed.groupBy("wid", "term").agg(F.min(F.struct("n", "off")).alias("r"), F.first("win").alias("win"))
    lists = ranked.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct(F.col("r.n").alias("n"), F.col("r.off").alias("off"), "term"))).alias("t"), F.first("win").alias("win"))
    b = F.coalesce(F.get("t", F.lit(1)), F.get("t", F.lit(0)))
    return lists.select("wid", "win", F.size("win").alias("size"), F.get("t", F.lit(0))["term"].alias("a"), F.get("t", F.lit(0))["off"].alias("a_off"), b["term"].alias("b"), b["off"].alias("b_off"), F.get("t", F.lit(0))["n"].alias("n"))


def build_index(docs: DataFrame, terms: DataFrame, window: int = WINDOW, most: int = BROADCAST_ROWS) -> DataFrame:
    """Postings of ``terms`` (term, ...) over texts from ``split_texts``: (term, ref, pos, around, lead).

    ``around`` has the words from ``lead`` before the position to ``window - 1`` after it. Written to the shared folder.
    """
    hits = at_terms(docs, terms.select("term").distinct(), most)
    lead = F.least(F.col("pos"), F.lit(window - 1))
    return stage_table(hits.select("term", "ref", "pos", lead.alias("lead"), F.slice("ws", F.col("pos") - lead + 1, lead + window).alias("around")), "postings")


def phrases(index: DataFrame, wanted: DataFrame, n_windows: int) -> DataFrame:
    """Exact occurrences of windows: (ref, wid, start, size).

    The rarest list, shifted, is checked against the window's words, which the posting has around it; it is then met
    with the shifted list of the second term, which every exact occurrence is in.
    """
    few = maybe_broadcast(wanted, n_windows)
    first = index.join(few, index["term"] == few["a"]).where((F.col("a_off") <= F.col("lead")) & (F.slice("around", F.col("lead") - F.col("a_off") + 1, F.col("size")) == F.col("win")))
    return first.select("ref", "wid", (F.col("pos") - F.col("a_off")).alias("start"), "size")


def intersect(index: DataFrame, wanted: DataFrame, found: DataFrame, n_windows: int) -> DataFrame:
    """Of ``found``, the starts that the second term's shifted list has too."""
    few = maybe_broadcast(wanted.select("wid", "b", "b_off"), n_windows)
    second = index.select("term", "ref", "pos").join(few, F.col("term") == F.col("b")).select("ref", "wid", (F.col("pos") - F.col("b_off")).alias("start"))
    return found.join(second, ["ref", "wid", "start"], "left_semi")


def proximity(index: DataFrame, pairs: DataFrame, n_pairs: int, within: int = WINDOW) -> DataFrame:
    """Places where two terms stand at most ``within`` words apart: (ref, a, b, a_pos, b_pos).

    ``pairs`` (a, b) are terms of the index. Positions are dealt into bands of ``within`` words; each place of ``a`` asks
    its own band and the two beside it, so the join has equal keys and never all pairs of a document.
    """
    few = maybe_broadcast(pairs.select("a", "b").distinct(), n_pairs)
    left = index.select("term", "ref", F.col("pos").alias("a_pos")).join(few, F.col("term") == F.col("a")).select("ref", "a", "b", "a_pos", F.explode(F.array(*[F.floor(F.col("a_pos") / within) + k for k in (-1, 0, 1)])).alias("band"))
    right = index.select(F.col("term").alias("b"), "ref", F.col("pos").alias("b_pos"), F.floor(F.col("pos") / within).alias("band"))
    return left.join(right, ["ref", "b", "band"]).where(F.abs(F.col("a_pos") - F.col("b_pos")) <= within).where((F.col("a") != F.col("b")) | (F.col("a_pos") < F.col("b_pos"))).select("ref", "a", "b", "a_pos", "b_pos")


def covered(spans: Column) -> Column:
    """Words in the union of [start, stop) spans, given sorted by start."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["end"], s["stop"]).cast("int").alias("end")
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc, n_words, n_hit, n_items, items_sha256, contaminated.

    Null, empty and wordless texts have no words and no hits; such items have no windows. Equal windows of several items
    count for each item. Rows that repeat id and text have the same result each; rows that share an id with different
    texts are told apart. Empty ``docs`` give an empty table, empty ``items`` no hits. Only the named columns are read.
    """
    split = split_texts(docs, doc, text)
    own = windows(items, item, item_text, window)
    wins = stage_table(own.select("win").distinct().withColumn("wid", F.xxhash64("win")), "windows")
    owners = own.select(F.col(item).alias("item"), "win")
    terms = stage_table(wins.select(F.explode("win").alias("term")).distinct(), "terms")
    n_windows = wins.count()
    wanted = stage_table(anchors(wins, term_frequencies(split, terms, most)), "anchors")
    # a term that no text has needs no list, and a window with one cannot occur
    wanted = wanted.where("n > 0")
    chosen = stage_table(wanted.select(F.explode(F.array("a", "b")).alias("term")).distinct(), "chosen")
    index = build_index(split, chosen, window, most)
    found = intersect(index, wanted, phrases(index, wanted, n_windows), n_windows)
    hits = stage_table(found.distinct(), "hits")
    # per document: its spans in order, and the items of the windows that occur in it
    spans = hits.groupBy("ref").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans"))
    seen = hits.select("ref", "wid").distinct()
    of_window = wins.join(owners, "win").select("wid", "item")
    per_item = seen.join(maybe_broadcast(of_window, n_windows), "wid").select("ref", F.col("item").cast("string").alias("item")).distinct()
    listed = per_item.groupBy("ref").agg(F.sort_array(F.collect_list("item")).alias("items"))
    result = spans.join(listed, "ref").select(F.col("ref.id").alias("__id"), F.col("ref.h").alias("__h"), covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    every = split.select(F.col("ref.id").alias(doc), F.col("ref.h").alias("__h"), F.size("ws").cast("long").alias("n_words"))
    joined = every.join(result, F.col(doc).eqNullSafe(F.col("__id")) & (every["__h"] == result["__h"]), "left")
    return joined.select(
        doc, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_slice(ws, i, i + 9) AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM bw),
dw AS (SELECT doc_id, i, size, array_slice(ws, i, i + size - 1) AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
