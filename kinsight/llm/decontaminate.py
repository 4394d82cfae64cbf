"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Windows of benchmark words are sets that a document must contain whole, so one
token of a window, its rarest in the documents, is the necessary prefix. The
positions of a document that hold such a token are its candidates; they meet
the windows of that token in an equi-join, under the length and positional
bounds of the window, and the words around the position are compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Words of a window.
SIZE = 13
#: Word characters, before A-Z are lower-cased: all but ASCII's other ones. Java finds them about ten times faster as ranges than as the negation of those.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens that one pass over the documents looks for; more take more passes.
BLOCK = 20_000
#: Rows of windows, or of windows and items, up to this number (of at most SIZE words each) are broadcast; more are joined by a shuffle.
FEW = 100_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """Distinct (item_id string, w array of words): every window of an item, or all its words if they are fewer."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), _words(lowered).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    return own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("all"), i, size))).alias("w")).distinct()


def _blocks(tokens: DataFrame) -> Iterator[list[str]]:
    """The tokens in blocks of about BLOCK, each collected on its own."""
    n = max(1, -(-tokens.count() // BLOCK))
    for k in range(n):
        found = [r[0] for r in tokens.where(F.pmod(F.xxhash64("token"), F.lit(n)) == k).collect()]
        if found:
            yield found


def document_counts(docs: DataFrame, text: str, tokens: DataFrame) -> DataFrame:
    """(token, df): the number of documents that hold each of the tokens, over all documents."""
    counts = None
    for block in _blocks(tokens):
        held = F.array_distinct(F.filter(_words(F.lower(F.col(text))), lambda x: x.isin(block)))
        part = docs.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        counts = part if counts is None else counts.unionByName(part)
    return tokens.withColumn("df", F.lit(0).cast("bigint")) if counts is None else tokens.join(counts, "token", "left").fillna(0, ["df"])


def find_overlaps(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE
) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, n_words, n_hit (words inside any occurrence of a window), items (sorted ids).

    A null text has no words; an item without words has no windows; a null
    item id is the empty string. Rows of docs that repeat an id and a text get
    equal results; rows that share an id only are judged apart. An empty
    benchmark hits nothing. Texts are searched whole, and of ties for the
    rarest token the first in order is taken. Other columns of either table are not read.

    Candidates are found with lower-cased words, a test that A-Z folding
    implies; the comparison itself folds A-Z only.
    """
    spark = docs.sparkSession
    named = stored(windows_of(items, item_id, item_text, size), "windows")
    unique = named.select("w").distinct()
    tokens = unique.select(F.explode("w").alias("t")).select(F.lower("t").alias("token")).distinct()
    df = stored(document_counts(docs, text, stored(tokens, "tokens")), "counts")
    ranked = (
        unique.select("w", F.posexplode("w").alias("offset", "t"))
        .join(df.withColumnRenamed("token", "tk"), F.lower("t") == F.col("tk"))
        .groupBy("w")
        .agg(F.min(F.struct("df", "tk", "offset")).alias("rarest"))
    )
    windows = stored(
        ranked.select(F.array_join("w", " ").alias("window"), F.size("w").alias("len"), F.col("rarest.tk").alias("token"), F.col("rarest.offset").alias("offset")).withColumn(
            "wid", F.xxhash64("window")
        ),
        "prefixes",
    )
    n_windows, n_named = windows.count(), named.count()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), _words(F.col(text)).alias("w"))
    n = F.size("w")
    narrow, hits = None, None
    for k, block in enumerate(_passes(windows) if n_windows else [[]]):
        spots = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.get(F.col("w"), i)).isin(block)) if block else F.array().cast("array<int>")

        def context(i: Column) -> Column:
            first = F.greatest(i - (size - 1), F.lit(0))
            around = F.transform(F.slice(F.col("w"), first + 1, 2 * size - 1), lambda x: F.translate(x, UPPER, LOWER))
            return F.struct(i.alias("i"), first.alias("first"), F.lower(F.get(F.col("w"), i)).alias("token"), around.alias("near"))

        seen = stored(
            own.withColumn("spots", F.when(n > 0, spots).otherwise(F.array().cast("array<int>"))).select(
                "doc_id", "text_hash", n.cast("bigint").alias("n_words"), F.transform("spots", context).alias("spots")
            ),
            f"spots{k}",
        )
        narrow = seen.select("doc_id", "text_hash", "n_words") if narrow is None else narrow
        each = seen.where(F.size("spots") > 0).select("doc_id", "text_hash", "n_words", F.explode("spots").alias("s")).select("doc_id", "text_hash", "n_words", "s.*")
        side = F.broadcast(windows) if n_windows <= FEW else windows
        start = F.col("i") - F.col("offset")
        met = each.join(side, "token").where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        met = met.where(F.array_join(F.slice("near", start - F.col("first") + 1, F.col("len")), " ") == F.col("window"))
        met = met.select("doc_id", "text_hash", start.alias("start"), (start + F.col("len")).alias("end"), "wid").distinct()
        hits = met if hits is None else hits.unionByName(met)
    hits = stored(hits, "hits")
    reach = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
    )["n"]
    spans = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select("doc_id", "text_hash", reach.cast("bigint").alias("n_hit"))
    ids = named.select(F.xxhash64(F.array_join("w", " ")).alias("wid"), "item_id")
    ids = hits.select("doc_id", "text_hash", "wid").distinct().join(F.broadcast(ids) if n_named <= FEW else ids, "wid")
    ids = ids.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    ids = ids.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "items")
    found = ids.join(spans, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select("d", "h", "n_hit", "items")
    whole = narrow.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return whole.select(
        F.col("doc_id").alias(doc_id), "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _passes(windows: DataFrame) -> Iterator[list[str]]:
    """The prefix tokens, a block at a time."""
    return _blocks(windows.select("token").distinct())


#: A document is contaminated if it has a hit and hits are at least 1 / SHARE of its words.
SHARE = 20


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_overlaps of documents and benchmark, with the digests of what it finds; it says how odd rows are taken."""
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
