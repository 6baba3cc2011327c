"""python -m corvane.cli COMMAND --data-dir DIR ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from .plans import commands
from .plans.retrieval import Limits
from .sources import io as sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("audit", "evaluate", "improve", "evaluate-reranker", "predict", "validate"):
        c = sub.add_parser(name)
        c.add_argument("--data-dir", default="data")
        c.add_argument("--output")
        if name in ("evaluate", "improve", "evaluate-reranker", "predict"):
            c.add_argument("--config", help="JSON file with limits of the index and the searches")
        if name in ("evaluate", "improve"):
            c.add_argument("--max-queries", type=int, default=600)
        if name in ("evaluate-reranker", "predict"):
            c.add_argument("--report", help="JSON report with selected settings or weights")
            c.add_argument("--weights-json", help="weights of the linear score as JSON text, over those of the report")
            c.add_argument("--reranker-config", help="JSON file with settings of the reranker, over those of the report")
        if name == "predict":
            c.add_argument("--rerank", action="store_true", help="use the reranker if the report's gate passed")
        if name == "validate":
            c.add_argument("--answer", required=True)
    return p


def limits_of(given: dict) -> Limits:
    """Unknown names raise."""
    return Limits(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    report = sources.load_config(a.report) if getattr(a, "report", None) else None
    limits = limits_of(sources.load_config(a.config)) if getattr(a, "config", None) else None
    limited = {"limits": limits} if limits else {}
    settings = commands.settings_of(report)
    if getattr(a, "weights_json", None):
        settings = replace(settings, weights=settings.weights | json.loads(a.weights_json))
        report = (report or {}) | {"selected_settings": asdict(settings)}
    reranker = commands.reranker_of(report)
    if getattr(a, "reranker_config", None):
        reranker = commands.reranker_config(asdict(reranker) | sources.load_config(a.reranker_config))
    if a.command == "audit":
        result = commands.audit(spark, a.data_dir)
    elif a.command == "evaluate":
        result = commands.evaluate(spark, a.data_dir, a.max_queries, **limited)
    elif a.command == "improve":
        result = commands.improve(spark, a.data_dir, a.max_queries, **limited)
    elif a.command == "evaluate-reranker":
        result = commands.evaluate_reranker(spark, a.data_dir, settings, reranker, **limited)
    elif a.command == "predict":
        return 0 if commands.predict(spark, a.data_dir, a.output or "answer", report, reranker if a.rerank else None, **limited)["valid"] else 1
    else:
        result = commands.validate(spark, a.data_dir, a.answer)
    if a.output:
        sources.write_json(a.output, result)
    else:
        print(sources.canonical_json(result, 2))
    if a.command == "evaluate-reranker" and not result["gate"]["pass"]:
        raise RuntimeError("the gate failed")
    return 0 if a.command != "validate" or result["valid"] else 1


if __name__ == "__main__":
    sys.exit(main())
