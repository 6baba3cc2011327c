"""The boosted reranker and the blend of its logit with the linear score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import answers
from .features import SCHEMAS

#: Stands for a missing value, beside a flag.
MISSING = -1.0


@dataclass(frozen=True)
class Boosting:
    """depth 3 stands for 7 leaves, 5 for 31."""

    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    least_rows: int = 50
    seed: int = 0


def filled(rows: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """The schema's features without nulls: a sentinel and a flag for each feature that can be unknown."""
    names = SCHEMAS[schema]
    if missing := [n for n in names if n not in rows.columns]:
        raise ValueError(f"features are missing: {missing}")
    unknown = [n for n in names if n in ("log_price", "rating", "log_reviews", "phone_hidden", "message_forbidden", "log_distance_km")]
    flags = {f"is_missing_{n}": F.col(n).isNull().cast("double") for n in unknown}
    out = rows.select("*", *[c.alias(k) for k, c in flags.items()])
    return out.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(MISSING)) for n in names}), [*names, *flags]


def train(rows: DataFrame, schema: str, boosting: Boosting = Boosting()) -> PipelineModel:
    """rows: features, label, weight."""
    table, names = filled(rows, schema)
    gbt = GBTClassifier(maxIter=boosting.rounds, maxDepth=boosting.depth, stepSize=boosting.rate, minInstancesPerNode=boosting.least_rows, seed=boosting.seed, weightCol="weight", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), gbt]).fit(table.withColumn("label", F.col("label").cast("double")))


def blended(rows: DataFrame, model: PipelineModel | None, schema: str, blend: float) -> DataFrame:
    """base_score plus blend times the logit. At blend 0 the model is not called."""
    if blend == 0 or model is None:
        return rows.withColumn("final_score", F.col("base_score"))
    table, _ = filled(rows, schema)
    logit = 2 * vector_to_array("rawPrediction")[1]
    out = model.transform(table).withColumn("final_score", F.round(F.col("base_score") + blend * logit, 9))
    return out.select(*rows.columns, "final_score")


def ranked(rows: DataFrame, queries: DataFrame, catalog: DataFrame, model: PipelineModel | None, schema: str, blend: float, top_k: int = 50) -> DataFrame:
    """Answers by the blended score. Sampled rows (with __sampled) are refused: a sample cannot be ranked."""
    if "__sampled" in rows.columns:
        raise ValueError("sampled rows cannot be ranked")
    return answers(blended(rows, model, schema, blend), queries, catalog, top_k, "final_score")
