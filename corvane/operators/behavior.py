"""Signals from the click log: priors, popularity, history, transfer and locality. All are small aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log_share, smoothed
from .lexical import sized, together, top


#: Distinct query texts of a log up to which they are normalised once each.
TEXTS = 50_000


def keyed(train: DataFrame, normalize) -> DataFrame:
    """The log with `key`, the normalised query text; a log that has it stays as it is. Texts repeat, so each is normalised once if a count says they are few."""
    if "key" in train.columns:
        return train
    texts = train.select(F.col("search_query").alias("__text")).distinct()
    if texts.limit(TEXTS + 1).count() > TEXTS:
        return train.withColumn("key", normalize(F.col("search_query")))
    once = F.broadcast(texts.withColumn("key", normalize(F.col("__text"))))
    return train.join(once, F.col("search_query").eqNullSafe(F.col("__text"))).drop("__text")


def pair_prior(train: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, prior: log1p of the pair's count over log1p of the largest of its left side; null sides are left out."""
    n = train.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy(left))
    return n.select(left, right, log_share(F.col("n"), most).alias("prior"))


def compatible_locations(location_prior: DataFrame, limit: int = 3) -> DataFrame:
    """search_location_id, item_location_id, prior, rank: the strongest item locations of each search location."""
    return top(location_prior, limit, ["search_location_id"], "prior", "item_location_id")


def query_locations(queries: DataFrame, compatible: DataFrame) -> DataFrame:
    """qid, location: the compatible locations, or the query's own where the log has none."""
    c = sized(compatible.select("search_location_id", "item_location_id"))
    return queries.join(c, "search_location_id", "left").select("qid", F.coalesce("item_location_id", "search_location_id").alias("location"))


def popularity(items: DataFrame, train: DataFrame) -> DataFrame:
    """item_id, popularity: clicks of each catalog item, log1p, over the largest; 0 without clicks."""
    clicks = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n = items.select("item_id").join(clicks, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))
    most = F.broadcast(n.agg(F.max("n").alias("most")))  # one row
    return n.join(most).select("item_id", log_share(F.col("n"), F.col("most")).alias("popularity"))


def fallback(popular: DataFrame, count: int = 120, top_k: int = 50) -> DataFrame:
    """The most popular items, for queries that find little."""
    return popular.orderBy(F.desc("popularity"), "item_id").limit(max(count, top_k))


def history(train: DataFrame, catalog: DataFrame, limit: int = 30) -> DataFrame:
    """key, item_id, rank, click: the most clicked catalog items of each query text, log1p over the text's largest.

    train: with key; empty keys are left out. With key_id, a number for each key, that number is shuffled and not the text.
    """
    by = "key_id" if "key_id" in train.columns else "key"
    asked = train.where("key <> ''")
    # the catalog's part of a partition is hashed: clicks are not sorted for it
    seen = asked.select(by, "item_id").join(catalog.select("item_id").hint("shuffle_hash"), "item_id", "left_semi").groupBy(by, "item_id").agg(F.count(F.lit(1)).alias("n"))
    kept = top(seen, limit, [by], "n", "item_id")
    kept = kept.select(by, "item_id", "rank", log_share(F.col("n"), F.max("n").over(Window.partitionBy(by))).alias("click"))
    if by == "key":
        return kept
    return kept.join(sized(asked.select("key", "key_id").distinct()), "key_id").select("key", "item_id", "rank", "click")


def nearest_keys(similar: DataFrame, limit: int) -> DataFrame:
    """qid, key, score, rank from similarities of queries and keys (as item_id)."""
    return top(similar, limit).select("qid", F.col("item_id").alias("key"), "score", "rank")


def history_channel(queries: DataFrame, past: DataFrame, neighbors: DataFrame) -> DataFrame:
    """qid, item_id, score: the click of the same text, or similarity times click of near texts; the largest counts.

    queries: qid, key; neighbors: qid, key, score.
    """
    same = queries.join(sized(past), "key").select("qid", "item_id", F.col("click").alias("score"))
    near = neighbors.join(sized(past), "key").select("qid", "item_id", (F.col("score") * F.col("click")).alias("score"))
    return together(same, near).groupBy("qid", "item_id").agg(F.max("score").alias("score")).where("score > 0")


def microcat_distribution(train: DataFrame) -> DataFrame:
    """key, item_microcat_id, p: shares of each text's clicks, catalog items or not."""
    n = train.where("key <> '' and item_microcat_id is not null").groupBy("key", "item_microcat_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("key", "item_microcat_id", (F.col("n") / F.sum("n").over(Window.partitionBy("key"))).alias("p"))


def transferred(neighbors: DataFrame, values: DataFrame, value: str, group: list[str]) -> DataFrame:
    """qid, group, score: the values of near keys, weighted by squared similarity over all near keys."""
    w = neighbors.withColumn("w", F.col("score") * F.col("score"))
    whole = w.groupBy("qid").agg(F.sum("w").alias("whole"))
    part = w.join(sized(values), "key").groupBy("qid", *group).agg(F.sum(F.col("w") * F.col(value)).alias("part"))
    return part.join(whole, "qid").where("whole > 0").select("qid", *group, (F.col("part") / F.col("whole")).alias("score"))


def same_location(train: DataFrame) -> DataFrame:
    return train.withColumn("same", F.coalesce(F.col("search_location_id") == F.col("item_location_id"), F.lit(False)).cast("int"))


def locality(train: DataFrame, by: str, weight: float) -> DataFrame:
    """by, n, hits, propensity: how often a group's clicks are in the searched place, smoothed towards the log's mean."""
    t = same_location(train)
    mean = F.broadcast(t.agg(F.avg("same").alias("mean")))  # one row
    g = t.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("hits")).join(mean)
    return g.select(by, "n", "hits", smoothed(F.col("hits"), F.col("n"), F.col("mean"), weight).alias("propensity"))


def mean_locality(train: DataFrame) -> DataFrame:
    return same_location(train).agg(F.avg("same").alias("mean"))


def query_locality(queries: DataFrame, neighbors: DataFrame, propensities: DataFrame, mean: DataFrame) -> DataFrame:
    """qid, locality: the propensities of near texts, or the mean without any."""
    near = transferred(neighbors, propensities.select("key", "propensity"), "propensity", [])
    return queries.select("qid").join(near, "qid", "left").join(F.broadcast(mean)).select("qid", F.coalesce("score", "mean").alias("locality"))
