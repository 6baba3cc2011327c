"""Feature rows of the reranker: 30 with locality, 47 with metadata and coverage, 52 with dense features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clipped_log, log_distance_km, number
from ..functions.text import log_chars, log_tokens, normalize_text
from .lexical import sized

RAW = ["exact_word", "exact_char", "exact_filter", "title", "microcat", "location", "category", "popularity", "history"]
RELATIVE = RAW[:6]
LOCALITY = ["query_locality", "query_locality_x_location_prior", "microcat_locality_prior", "query_locality_x_microcat_locality_prior"]
PRODUCTS = [("exact_word", "location"), ("exact_char", "location"), ("microcat", "location"), ("title", "microcat")]
METADATA = ["log_price", "rating", "log_reviews", "phone_hidden", "message_forbidden", "exact_location", "category_match", "log_distance_km", "delivery_query", "global_category_query", "log_query_tokens", "log_title_tokens", "log_query_characters"]
COVERAGE = ["word_unigram_coverage", "word_unigram_idf_coverage", "title_unigram_coverage", "word_vocab_bm25_length_norm"]
DENSE = ["dense_cos", "dense_cos_minus_global_top1", "dense_log_global_rank", "dense_cos_minus_local_top1", "dense_log_local_rank"]
ROW = [*RAW, "base_score", *[f"relative_{n}" for n in RELATIVE], *[f"{a}_x_{b}" for a, b in PRODUCTS], *[f"query_max_{n}" for n in RELATIVE], *LOCALITY]
SCHEMAS = {"locality": ROW, "metadata": [*ROW, *METADATA, *COVERAGE], "dense": [*ROW, *METADATA, *COVERAGE, *DENSE]}


def row_matrix(eligible: DataFrame) -> DataFrame:
    """Relative values, products and per-query maxima beside the raw values and base_score. Rows must be eligible ones only."""
    of = Window.partitionBy("qid")
    most = {n: F.max(n).over(of) for n in RELATIVE}
    x = eligible.select("*", *[m.alias(f"query_max_{n}") for n, m in most.items()])
    x = x.select("*", *[(F.col(n) / F.greatest(F.col(f"query_max_{n}"), F.lit(1e-6))).alias(f"relative_{n}") for n in RELATIVE])
    return x.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in PRODUCTS])


def with_locality(rows: DataFrame, items: DataFrame, query_locality: DataFrame, microcat_locality: DataFrame, mean: DataFrame) -> DataFrame:
    m = microcat_locality.select("item_microcat_id", F.col("propensity").alias("__m"))
    x = rows.join(items.select("item_id", "item_microcat_id"), "item_id").join(sized(m), "item_microcat_id", "left").join(F.broadcast(mean))
    x = x.join(sized(query_locality.withColumnRenamed("locality", "query_locality")), "qid", "left")
    x = x.withColumn("microcat_locality_prior", F.coalesce("__m", "mean")).withColumn("query_locality", F.coalesce("query_locality", "mean"))
    x = x.withColumn("query_locality_x_location_prior", F.col("query_locality") * F.col("location")).withColumn("query_locality_x_microcat_locality_prior", F.col("query_locality") * F.col("microcat_locality_prior"))
    return x.drop("__m", "mean", "item_microcat_id")


def location_centers(catalog: DataFrame) -> DataFrame:
    """item_location_id, latitude, longitude: medians of the places of each location's items."""
    return catalog.where("item_location_id is not null").groupBy("item_location_id").agg(F.median(number(F.col("item_latitude"))).alias("latitude"), F.median(number(F.col("item_longitude"))).alias("longitude"))


def metadata(pairs: DataFrame, queries: DataFrame, items: DataFrame, centers: DataFrame, unicode: bool = True) -> DataFrame:
    """qid, item_id and 13 features; what is unknown stays null."""
    norm = lambda c: normalize_text(F.col(c), unicode)
    q = queries.select("qid", "search_location_id", "search_category", F.col("search_is_delivery_search").cast("int").alias("delivery"), norm("search_query").alias("q"))
    q = q.join(centers.select(F.col("item_location_id").alias("search_location_id"), "latitude", "longitude"), "search_location_id", "left")
    i = items.select("item_id", "item_location_id", "item_category_id", *[number(F.col(c)).alias(c) for c in ("item_price", "item_rating", "item_rating_reviews_count", "item_latitude", "item_longitude")], "item_is_phone_hidden", "item_is_message_forbidden", norm("item_title_raw").alias("t"))
    x = pairs.select("qid", "item_id").join(sized(q), "qid").join(i, "item_id")
    flag = lambda c: c.cast("double")
    values = [
        clipped_log(F.col("item_price"), 1e12), F.col("item_rating"), clipped_log(F.col("item_rating_reviews_count")), flag(F.col("item_is_phone_hidden")), flag(F.col("item_is_message_forbidden")),
        flag(F.col("item_location_id") == F.col("search_location_id")), flag(F.col("item_category_id") == F.col("search_category")),
        log_distance_km(F.col("item_latitude"), F.col("item_longitude"), F.col("latitude"), F.col("longitude")), flag(F.col("delivery")), flag(F.col("search_category") == 0),
        log_tokens(F.col("q")), log_tokens(F.col("t")), log_chars(F.col("q")),
    ]
    return x.select("qid", "item_id", *[v.alias(n) for v, n in zip(values, METADATA, strict=True)])


def labelled(rows: DataFrame, units: DataFrame, numerator: float = 100.0) -> DataFrame:
    """label and weight of each row: a relevant item weighs numerator over all relevant items of its query, found or not; others 1."""
    # joined pair by pair: a query's relevant items may be a large part of the catalog
    relevant = units.select("qid", F.explode(F.array_distinct("relevant_items")).alias("item_id"), F.greatest(F.lit(1), F.size("relevant_items")).alias("__n"))
    x = rows.join(relevant, ["qid", "item_id"], "left")
    label = F.col("__n").isNotNull()
    return x.select(*[F.col(c) for c in rows.columns], label.cast("int").alias("label"), F.when(label, numerator / F.col("__n")).otherwise(1.0).alias("weight"))


def sampled(rows: DataFrame, hard: int = 200, random: int = 50, seed: int = 0) -> DataFrame:
    """Training rows of each query: the best by base_score, some by seeded hash, and every positive."""
    of = Window.partitionBy("qid")
    best = F.row_number().over(of.orderBy(F.desc("base_score"), "item_id"))
    drawn = F.row_number().over(of.orderBy(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), "qid", "item_id"), 256)))
    x = rows.withColumn("__best", best).withColumn("__drawn", drawn)
    return x.where((F.col("__best") <= hard) | (F.col("__drawn") <= random) | (F.col("label") == 1)).drop("__best", "__drawn")
