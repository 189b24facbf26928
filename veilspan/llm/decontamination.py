"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings (term, document, position) of the training texts, for the terms that test items use, as a table in the
shared folder; each task writes those of its own documents. A phrase is looked up from its rarest terms: the offset-adjusted posting
lists of its two rarest places are intersected, and what they leave is compared word for word. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: Words: runs without ASCII characters other than 0-9 and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Places of a phrase whose posting lists are intersected.
RAREST = 2
#: Terms, windows or anchors of the test items are broadcast up to so many rows and bytes (as JSON); more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: The posting with this term has a document's number of words as its position.
END = ""


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows and bytes: a word may be of any length."""
    size = df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, position, term) of the given terms (term), and one END posting per document. A null text has no words."""
    wanted = _small(terms.select("term").where("term IS NOT NULL").distinct().unionByName(documents.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct())
    every = documents.select("doc_id", F.posexplode(F.concat(word_array(F.col("text")), F.array(F.lit(END)))).alias("position", "term"))
    return stored(every.join(wanted, "term", "left_semi").select("doc_id", "position", "term"), "postings")


def test_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Of items (item_id, text): the distinct windows (wid, words), and which items have them (wid, item_id)."""
    words = items.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    every = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, F.lit(window)))).alias("words"))
    every = every.withColumn("wid", F.xxhash64("words"))
    return stored(every.select("wid", "words").distinct(), "windows"), stored(every.select("wid", "item_id").distinct(), "items")


def phrase_candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, start, wid) where the RAREST rarest places of a window fit; windows with a term that the index lacks have none."""
    counts = _small(stored(index.groupBy("term").agg(F.count("*").alias("n")), "counts"))
    places = windows.select("wid", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    by_window = Window.partitionBy("wid", "length")
    ranked = places.withColumn("known", F.min(F.coalesce("n", F.lit(0))).over(by_window)).where("known > 0").withColumn("rank", F.row_number().over(by_window.orderBy("n", "offset"))).where(F.col("rank") <= RAREST)
    anchors = _small(stored(ranked.select("term", "wid", "offset", "rank", F.least("length", F.lit(RAREST)).alias("needed")), "anchors"))
    adjusted = index.join(anchors, "term").select("doc_id", (F.col("position") - F.col("offset")).alias("start"), "wid", "needed", F.expr("shiftleft(1, rank - 1)").alias("bit")).where("start >= 0")
    found = adjusted.groupBy("doc_id", "wid", "start", "needed").agg(F.bit_or("bit").alias("bits"))
    return found.where(F.expr("bits = shiftleft(1, needed) - 1")).select("doc_id", "wid", "start")


def confirmed_phrases(documents: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, hits) with hits (wid, length, starts) of the candidates whose words all agree, for documents that have any. A window's words are held once a document, however often it occurs."""
    starts = candidates.groupBy("doc_id", "wid").agg(F.collect_list("start").alias("starts"))
    per_document = starts.join(_small(windows), "wid").groupBy("doc_id").agg(F.collect_list(F.struct("wid", "words", "starts")).alias("found"))
    whole = documents.select("doc_id", "text").join(per_document, "doc_id").select("doc_id", word_array(F.col("text")).alias("w"), "found")
    fits = lambda c: F.filter(c["starts"], lambda s: F.slice(F.col("w"), s + 1, F.size(c["words"])) == c["words"])
    hits = F.filter(F.transform("found", lambda c: F.struct(c["wid"].alias("wid"), F.size(c["words"]).alias("length"), fits(c).alias("starts"))), lambda h: F.size(h["starts"]) > 0)
    return whole.select("doc_id", hits.alias("hits")).where(F.size("hits") > 0)


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a window: `window` consecutive words of an item, or all of an item of fewer. Texts are
    compared by words after lower-casing A-Z. Null texts have no words, items without words no windows; rows that repeat an item count
    once; rows that repeat a doc_id each return, with the hits of all its texts; rows with a null doc_id return without hits; an empty
    table of items finds nothing, an empty table of documents gives no rows; other columns are ignored.
    """
    windows, owners = test_windows(items, window)
    index = build_index(documents, windows.select(F.explode("words").alias("term")))
    candidates = stored(phrase_candidates(index.where(F.col("term") != END), windows), "candidates")
    hits = stored(confirmed_phrases(documents, candidates, windows), "hits")
    covered = hits.select("doc_id", F.explode(F.array_distinct(F.flatten(F.flatten(F.transform("hits", lambda h: F.transform(h["starts"], lambda s: F.sequence(s, s + h["length"] - 1))))))).alias("position"))
    n_hit = covered.distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    of_items = hits.select("doc_id", F.explode(F.array_distinct(F.transform("hits", lambda h: h["wid"]))).alias("wid")).join(_small(owners), "wid")
    of_items = of_items.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    sizes = index.where(F.col("term") == END).select("doc_id", F.col("position").cast("bigint").alias("n_words"))
    found = n_hit.join(of_items, "doc_id")
    none = F.array().cast("array<string>")
    return sizes.join(found, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query_id, doc_id, position): places of a query's rarest term that have all its terms within slop words on either side.

    index: as from build_index; queries: (query_id, terms array<string>), repeated terms count once. A query without terms, or with one
    that the index lacks, finds nothing.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).join(counts, "term", "left")
    by_query = Window.partitionBy("query_id")
    terms = terms.withColumn("known", F.min(F.coalesce("n", F.lit(0))).over(by_query)).where("known > 0").withColumn("needed", F.count("*").over(by_query)).withColumn("rank", F.row_number().over(by_query.orderBy("n", "term")))
    terms = stored(terms.select("query_id", "term", "needed", "rank"), "terms")
    postings = index.where(F.col("term") != END).join(_small(terms), "term")
    block = F.floor(F.col("position") / (slop + 1))
    rare = postings.where("rank = 1").select("query_id", "doc_id", F.col("position").alias("at"), "needed", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    others = postings.select("query_id", "doc_id", "position", "rank", block.alias("block"))
    near = rare.join(others, ["query_id", "doc_id", "block"]).where(F.abs(F.col("position") - F.col("at")) <= slop)
    return near.groupBy("query_id", "doc_id", "at", "needed").agg(F.count_distinct("rank").alias("found")).where("found = needed").select("query_id", "doc_id", F.col("at").alias("position"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM items))),
hits AS (SELECT doc_id, s, n, phrase FROM runs SEMI JOIN items USING (n, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN items USING (n, phrase)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
