"""Column contracts of the three relations and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the relations.
QUERY_FIELDS = [("search_query", "string"), ("search_location_id", "long"), ("search_is_delivery_search", "boolean"), ("search_infm_params_text", "string"), ("search_category", "long")]
ITEM_FIELDS = [
    ("item_title_raw", "string"), ("item_rating_reviews_count", "double"), ("item_rating", "double"), ("item_price", "double"), ("item_microcat_id", "long"),
    ("item_longitude", "double"), ("item_location_id", "long"), ("item_latitude", "double"), ("item_is_phone_hidden", "boolean"), ("item_is_message_forbidden", "boolean"),
    ("item_infm_params_text", "string"), ("item_id", "string"), ("item_description_raw", "string"), ("item_category_id", "long"),
]
QUERY_COLUMNS = [n for n, _ in QUERY_FIELDS]
ITEM_COLUMNS = [n for n, _ in ITEM_FIELDS]
TRAIN_COLUMNS = QUERY_COLUMNS + ITEM_COLUMNS
QUERY_ID_PATTERN = "^[0-9A-Za-z]{16}$"
ITEM_ID_PATTERN = "^[0-9a-f]{16}$"


def missing_columns(frame: DataFrame, required: list[str]) -> list[str]:
    return sorted({*required} - {*frame.columns})


def require_columns(frame: DataFrame, required: list[str], label: str) -> DataFrame:
    """frame itself; further columns are allowed."""
    if missing := missing_columns(frame, required):
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")
    return frame


def conformed(frame: DataFrame, fields: list[tuple[str, str]], label: str) -> DataFrame:
    """The contract's columns with its types; what is no number becomes null, other columns stay behind the contract's."""
    require_columns(frame, [n for n, _ in fields], label)
    names = {n for n, _ in fields}
    return frame.select(*[F.col(n).try_cast(t).alias(n) for n, t in fields], *[F.col(c) for c in frame.columns if c not in names])


def struct_of(fields: list[tuple[str, str]]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields))


def query_ids_valid(c):
    return c.rlike(QUERY_ID_PATTERN)


def item_ids_valid(c):
    return c.rlike(ITEM_ID_PATTERN)
