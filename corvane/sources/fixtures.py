"""Search relations derived from the driver's tables: items, queries, a click log and vectors.

Documents become items, benchmark passages become queries, and events become
clicks that join the two. Identifiers, places and prices are made by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES, MICROCATS, LOCATIONS, VECTOR_LOCATIONS = 7, 40, 20, 5


def hex_id(kind: str, c: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(kind), c.cast("string"))), 1, 16)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    k = F.col("doc_id")
    return d.select(
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("item_title_raw"),
        (k % 97 - 1).cast("double").alias("item_rating_reviews_count"),
        F.when(k % 13 != 0, (k % 5).cast("double")).alias("item_rating"),
        F.when(k % 11 != 0, (k * 7919 % 100000) / F.lit(7.0)).alias("item_price"),
        (k % MICROCATS).alias("item_microcat_id"),
        (20 + (k * 17 % 3000) / F.lit(100.0)).alias("item_longitude"),
        F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("item_location_id"),
        (40 + (k * 31 % 1000) / F.lit(100.0)).alias("item_latitude"),
        (k % 2 == 0).alias("item_is_phone_hidden"),
        (k % 3 == 0).alias("item_is_message_forbidden"),
        F.concat_ws(" ", "lang", "source").alias("item_infm_params_text"),
        hex_id("i", k).alias("item_id"),
        F.col("text").alias("item_description_raw"),
        (k % CATEGORIES).alias("item_category_id"),
    )


def _search(k: Column, text: Column, variant: Column) -> list[Column]:
    return [
        F.concat(text, F.lit(" "), variant).alias("search_query"),
        ((k * 7) % LOCATIONS).alias("search_location_id"),
        (k % 2 == 0).alias("search_is_delivery_search"),
        F.concat(F.lit("en src"), ((k * 7) % LOCATIONS).cast("string")).alias("search_infm_params_text"),
        (k % CATEGORIES).alias("search_category"),
    ]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With qid. Texts of a query in the log carry an event type behind them; these do not."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(hex_id("q", F.col("item_id")).alias("qid"), *_search(F.col("item_id"), F.col("text"), F.lit("")))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("b_id"), F.col("text").alias("b_text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, b_id, item_id: events dealt over all passages and all documents."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    passages, docs = _passages(spark, sf_dir).count(), spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return e.select("event_type", (F.col("user_id") % passages).alias("b_id"), hex_id("i", (F.col("event_id") * 13 + F.col("user_id")) % docs).alias("item_id"))


def searches(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """b_id, event_type and the search columns of what was asked (b_id, event_type)."""
    return asked.join(_passages(spark, sf_dir), "b_id").select("b_id", "event_type", *_search(F.col("b_id"), F.col("b_text"), F.col("event_type")))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks: the search columns of a benchmark passage and the columns of a document."""
    # the texts come last: they are few, and clicks are many
    catalog = items(spark, sf_dir)
    log = events(spark, sf_dir).join(catalog, "item_id").join(_passages(spark, sf_dir), "b_id")
    return log.select("item_id", *_search(F.col("b_id"), F.col("b_text"), F.col("event_type")), *[c for c in catalog.columns if c != "item_id"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, location, vector of every embedding."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(hex_id("i", F.col("vec_id")).alias("item_id"), (F.col("vec_id") % VECTOR_LOCATIONS).alias("location"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings whose id is divisible by 20, which ask for all embeddings, themselves included."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = F.floor(F.col("vec_id") / 20)
    return v.where("vec_id % 20 = 0").select(hex_id("q", F.col("vec_id")).alias("qid"), (k * 7 % VECTOR_LOCATIONS).alias("location"), F.col("embedding").alias("vector"))


def _dealt_vectors(spark: SparkSession, sf_dir: str, owners: DataFrame, place: Column) -> DataFrame:
    """owners (k and more) with a vector each: the embeddings in turn."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return owners.withColumn("vec_id", place % v.count()).join(v.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id", "k")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, location, vector of every item."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("k"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("location"))
    return _dealt_vectors(spark, sf_dir, d.withColumn("item_id", hex_id("i", F.col("k"))), F.col("k")).select("item_id", "location", "vector")


def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, location, vector of every query."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("k"))
    b = b.select("k", hex_id("q", F.col("k")).alias("qid"), (F.col("k") * 7 % LOCATIONS).alias("location"))
    return _dealt_vectors(spark, sf_dir, b, F.col("k") * 3 + 1).select("qid", "location", "vector")
