"""Checks of answers and of input relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import ITEM_ID_PATTERN, QUERY_ID_PATTERN

MOST_ITEMS = 50


def answer_counts(answer: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts: rows and each kind of fault. answer: query_id, answer; queries: query_id; items: item_id."""
    a = answer.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))
    ids = F.when(F.col("answer") == "", F.array().cast("array<string>")).otherwise(F.split("answer", " ", -1))
    a = a.withColumn("ids", ids)
    separator = (F.col("answer") != "") & (F.col("answer").rlike(r"^\s|\s$|[\t\n]") | F.array_contains("ids", ""))
    n = F.size("ids")
    bad = F.size(F.filter("ids", lambda x: ~x.rlike(ITEM_ID_PATTERN)))
    rows = a.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct("query_id")).alias("duplicate_queries"), F.count_if(~F.col("query_id").rlike(QUERY_ID_PATTERN)).alias("invalid_query_ids"),
        F.count_if(separator).alias("invalid_separator"), F.count_if(n > MOST_ITEMS).alias("over_limit"), F.count_if(n != F.size(F.array_distinct("ids"))).alias("duplicate_items"),
        F.coalesce(F.sum(bad), F.lit(0)).alias("invalid_items"), F.count_if(F.col("answer") == "").alias("empty_answers"), F.coalesce(F.max(n), F.lit(0)).alias("max_items"),
    )
    known = items.select("item_id").distinct()
    unknown = a.select(F.explode("ids").alias("item_id")).join(known, "item_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_items"))
    q = queries.select("query_id").distinct()
    missing = q.join(a.select("query_id"), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_queries"))
    extra = a.select("query_id").distinct().join(q, "query_id", "left_anti").agg(F.count(F.lit(1)).alias("unexpected_queries"))
    expected = queries.agg(F.count(F.lit(1)).alias("expected_rows"))
    for one in (unknown, missing, extra, expected):  # one row each
        rows = rows.join(F.broadcast(one))
    return rows


#: The counts that make an answer invalid, in words.
FAULTS = {
    "duplicate_queries": "queries answered more than once", "missing_queries": "queries without an answer", "unexpected_queries": "answers to unknown queries", "invalid_query_ids": "malformed ids of queries",
    "invalid_separator": "answers not separated by single spaces", "over_limit": f"answers longer than {MOST_ITEMS}", "duplicate_items": "answers that name an item twice",
    "invalid_items": "malformed ids of items", "unknown_items": "items that the catalog lacks",
}


def validate_answer(answer: DataFrame, queries: DataFrame, items: DataFrame) -> dict:
    """valid, errors, rows, empty_answers and max_items of an answer table."""
    if answer.columns != ["query_id", "answer"]:
        return {"valid": False, "errors": [f"columns must be exactly ['query_id', 'answer'], got {answer.columns}"], "rows": answer.count()}
    row = answer_counts(answer, queries, items).first().asDict()
    errors = [f"{text}: {row[k]}" for k, text in FAULTS.items() if row[k]]
    if row["rows"] != row["expected_rows"]:
        errors.append(f"row count must be {row['expected_rows']}, got {row['rows']}")
    return {"valid": not errors, "errors": errors, "rows": row["rows"], "empty_answers": row["empty_answers"], "max_items": row["max_items"]}


def null_counts(frame: DataFrame) -> DataFrame:
    """column, nulls of every column that has any, in one pass."""
    counted = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in frame.columns])
    long = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in frame.columns])).alias("x"))
    return long.select("x.column", "x.nulls").where("nulls > 0")


def id_audit(train: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """One row: duplicates, invalid and distinct ids, and how many ids log and catalog share."""
    q = queries.agg((F.count(F.lit(1)) - F.countDistinct("query_id")).alias("duplicate_query_id"), F.count_if(~F.col("query_id").rlike(QUERY_ID_PATTERN)).alias("invalid_query_id"))
    i = items.agg((F.count(F.lit(1)) - F.countDistinct("item_id")).alias("duplicate_item_id"), F.count_if(~F.col("item_id").rlike(ITEM_ID_PATTERN)).alias("invalid_item_id"), F.countDistinct("item_id").alias("unique_items"))
    t = train.agg(F.count_if(~F.col("item_id").rlike(ITEM_ID_PATTERN)).alias("invalid_train_item_id"), F.countDistinct("item_id").alias("unique_train_items"))
    both = train.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_semi").agg(F.count(F.lit(1)).alias("item_overlap"))
    return q.join(F.broadcast(i)).join(F.broadcast(t)).join(F.broadcast(both))  # one row each
