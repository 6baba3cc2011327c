"""The commands over a small folder."""

import json

import pytest

from corvane import cli
from corvane.operators.candidates import Settings
from corvane.operators.model import Boosting
from corvane.plans import commands
from corvane.plans.retrieval import Limits
from corvane.sources import fixtures, io

LIMITS = Limits(pool=20, fallback=10, top_k=10, geo=(3, 5))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    sf = "/root/testdata/sf0.001"
    fixtures.train(spark, sf).write.parquet(f"{path}/train.parquet")
    fixtures.queries(spark, sf).withColumnRenamed("qid", "query_id").write.parquet(f"{path}/queries.parquet")
    fixtures.items(spark, sf).write.parquet(f"{path}/items.parquet")
    return path


def test_audit_and_predict_and_validate(spark, folder, tmp_path):
    assert commands.audit(spark, folder)["ids"]["item_overlap"] > 0
    report = {"selected_settings": {"weights": {"word": 1.0}, "exact_rescore": True, "geo_neighbors": 3, "pool": 20}}
    assert commands.predict(spark, folder, f"{tmp_path}/answer", report, limits=LIMITS)["valid"]
    answers = io.read_answer(spark, f"{tmp_path}/answer").collect()
    assert all(len(r["answer"].split(" ")) == 10 for r in answers)
    assert cli.main(["validate", "--data-dir", folder, "--answer", f"{tmp_path}/answer", "--output", f"{tmp_path}/v.json"]) == 0
    assert json.loads((tmp_path / "v.json").read_text())["valid"]


def test_grid_search(spark, folder):
    got = commands.evaluate(spark, folder, 10, LIMITS, {"char": [0.0, 0.8], "location": [0.1]})
    assert got["selected_weights"]["location"] == 0.1 and 0 <= got["confirm_recall"] <= 1 and len(got["without"]) == 6


def test_reranker_and_its_gate(spark, folder):
    config = commands.RerankerConfig(schema="locality", training_units=8, evaluation_units=8, evaluation_folds=(3,), boosting=Boosting(2, 2, 0.1, 1))
    got = commands.evaluate_reranker(spark, folder, Settings(exact_rescore=True, pool=20), config, LIMITS)
    assert {*got["gate"]} == {"folds", "pooled", "interval", "slices", "contract", "hashes", "pass"} and got["gate"]["contract"]


def test_configurations_are_checked():
    for wrong in ({"schema": "none"}, {"training_fold": 1}, {"evaluation_folds": (1,)}, {"evaluation_excluded": {3: (4,)}}, {"blend": 2.0}, {"training_units": 0}):
        with pytest.raises(ValueError):
            commands.RerankerConfig(**wrong)
    assert not commands.reranker_enabled({"gate": {"pass": False}}) and commands.reranker_enabled({"gate": {"pass": True}})
    assert commands.settings_of({"selected_weights": {"char": 9.0}}).weights["char"] == 9.0 and commands.settings_of(None) == Settings()


def test_the_gate_fails_where_a_check_fails(spark, folder):
    """Units that are not the expected ones, and a pool that lacks the baseline's candidates."""
    config = commands.RerankerConfig(schema="locality", training_units=8, evaluation_units=8, evaluation_folds=(3,), boosting=Boosting(2, 2, 0.1, 1), unit_hashes={3: "other"}, baseline=Settings(exact_rescore=True, geo_neighbors=3, pool=20))
    got = commands.evaluate_reranker(spark, folder, Settings(exact_rescore=True, pool=2), config, LIMITS)
    assert not got["gate"]["hashes"] and not got["gate"]["contract"] and not got["gate"]["pass"]
    assert got["candidate_universes"][3]["baseline"] != got["candidate_universes"][3]["candidate"]
    again = commands.reranker_of(json.loads(json.dumps(got)))
    assert again == config


def test_command_line_takes_weights_and_configurations(spark, folder, tmp_path):
    (tmp_path / "limits.json").write_text(json.dumps({"pool": 20, "fallback": 10, "top_k": 10, "geo": [3, 5]}))
    args = ["predict", "--data-dir", folder, "--output", f"{tmp_path}/answer", "--config", f"{tmp_path}/limits.json", "--weights-json", '{"word": 2.0}']
    assert cli.main(args) == 0
    assert all(len(r["answer"].split(" ")) == 10 for r in io.read_answer(spark, f"{tmp_path}/answer").collect())
