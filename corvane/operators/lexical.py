"""TF-IDF indexes as posting tables and their searches.

A posting table has doc, term, w: one row per document and term, weights of
length one per document. Searches join query terms with postings and add the
products; the smaller side is broadcast when its rows are few, else the join
shuffles by term and AQE splits frequent terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Digits to which scores are rounded before they are ranked.
DIGITS = 9


def sized(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if it has few rows by count."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def together(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all parts, by column name.

    Spark 4.1 takes a union of parts that are partitioned alike for partitioned, and groups over it do not shuffle;
    adaptive plans may still read one part differently, and then a group may come apart (counts over such a distinct
    came out doubled). The session's plans do without that.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other)
    return first


def term_counts(docs: DataFrame, doc: str, grams: Column) -> DataFrame:
    """doc, term, tf. Empty documents have no rows."""
    return docs.select(F.col(doc).alias("doc"), F.explode(grams).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, documents: Column | int, min_df: int = 2, most: int | None = None) -> DataFrame:
    """term, df, cf, idf of terms in at least min_df documents; of more than `most`, those of the highest total count, then term."""
    return known(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), documents, min_df, most)


def known(totals: DataFrame, documents: Column | int, min_df: int = 2, most: int | None = None) -> DataFrame:
    """vocabulary of the totals (term, df, cf)."""
    v = totals.where(F.col("df") >= min_df)
    if most is not None:
        v = v.orderBy(F.desc("cf"), "term").limit(most)
    n = documents if isinstance(documents, Column) else F.lit(documents)
    return v.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def postings(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc, term, w: (1 + ln tf) * idf at length one; terms outside the vocabulary vanish."""
    raw = counts.join(vocab.select("term", "idf"), "term").select("doc", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("raw") / norm).alias("w"))


def similarities(queries: DataFrame, items: DataFrame) -> DataFrame:
    """qid, item_id, score > 0 of every pair with a common term."""
    q = sized(queries.select(F.col("doc").alias("qid"), "term", F.col("w").alias("qw")))
    pairs = items.select(F.col("doc").alias("item_id"), "term", "w").join(q, "term")
    return pairs.groupBy("qid", "item_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), DIGITS).alias("score")).where("score > 0")


def top(scores: DataFrame, limit: int, per: Sequence[str] = ("qid",), score: str = "score", tie: str = "item_id") -> DataFrame:
    """With rank 1 to limit, by score, then id."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= limit)


def nearest(queries: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """qid, item_id, score, rank over all items."""
    return top(similarities(queries, items), limit)


def nearest_in_locations(queries: DataFrame, items: DataFrame, limit: int, query_locations: DataFrame, item_locations: DataFrame) -> DataFrame:
    """qid, item_id, score, rank over the items of each query's locations.

    query_locations: qid, location, several per query; item_locations: item_id, location.
    """
    placed = items.join(item_locations.select(F.col("item_id").alias("doc"), "location"), "doc")
    q = queries.withColumnRenamed("doc", "qid").join(query_locations, "qid").select("qid", "term", F.col("w").alias("qw"), "location")
    pairs = placed.select(F.col("doc").alias("item_id"), "term", "w", "location").join(sized(q), ["term", "location"])
    scored = pairs.groupBy("qid", "item_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), DIGITS).alias("score")).where("score > 0")
    return top(scored, limit)


def for_candidates(candidates: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """qid, item_id, score of given pairs only, without a rank limit; pairs without a common term have no row."""
    c = candidates.select("qid", "item_id").distinct()
    terms = c.join(queries.select(F.col("doc").alias("qid"), "term", F.col("w").alias("qw")), "qid")
    hits = terms.join(items.select(F.col("doc").alias("item_id"), "term", "w"), ["item_id", "term"])
    return hits.groupBy("qid", "item_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), DIGITS).alias("score")).where("score > 0")


def vocabulary_sizes(sizes: DataFrame, catalog: DataFrame) -> DataFrame:
    """item_id, nnz, median: terms of each item (sizes: item_id, n), 0 without any, and the catalog's median."""
    n = catalog.select("item_id").join(sizes, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("nnz"))
    return n.join(F.broadcast(n.agg(F.median("nnz").alias("median"))))  # one row


def length_norm(nnz: Column, median: Column) -> Column:
    return 1.0 / (0.25 + 0.75 * nnz / median)


def coverage(candidates: DataFrame, query_terms: DataFrame, items: DataFrame, titles: DataFrame) -> DataFrame:
    """qid, item_id, word_unigram_coverage, word_unigram_idf_coverage, title_unigram_coverage.

    query_terms: qid, term, idf. Only known single words count; a query without any covers nothing.
    """
    single = query_terms.where(~F.col("term").contains(" "))
    whole = single.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("idf_sum"))
    pairs = candidates.select("qid", "item_id").distinct().join(single, "qid")
    word = items.select(F.col("doc").alias("item_id"), "term", F.lit(1).alias("in_word"))
    title = titles.select(F.col("doc").alias("item_id"), "term", F.lit(1).alias("in_title"))
    hit = pairs.join(word, ["item_id", "term"], "left").join(title, ["item_id", "term"], "left").groupBy("qid", "item_id").agg(
        F.sum("in_word").alias("words"), F.sum(F.col("in_word") * F.col("idf")).alias("idfs"), F.sum("in_title").alias("titles")
    )
    out = candidates.select("qid", "item_id").distinct().join(hit, ["qid", "item_id"], "left").join(whole, "qid", "left")
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return out.select("qid", "item_id", share("words", "n").alias("word_unigram_coverage"), share("idfs", "idf_sum").alias("word_unigram_idf_coverage"), share("titles", "n").alias("title_unigram_coverage"))
