"""The registered queries against their SQL, and what they promise of columns."""

import duckdb

import __spark_entry__ as entry
from corvane.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == {*range(1, 11)} and {*queries.QUERIES} <= {*names} and "pipeline" in names


def test_exact_dedup_matches_its_sql(spark):
    got = sorted(tuple(r) for r in queries.op1_exact_dedup(spark, SF).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(c.sql(queries.ORACLES["op1_exact_dedup"]).fetchall())


def test_columns(spark):
    columns = {n.split("_")[0]: f(spark, SF).columns for n, f in queries.QUERIES.items()}
    assert columns["op3"] == ["doc_id", "fingerprint", "component_id"]
    assert columns["op4"] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert columns["op5"] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert columns["op6"] == ["doc_id", "size", "source_size", "target", "taken"]
    assert columns["op7"] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert columns["op8"] == ["doc_id", "held_out", "score", "predicted"]
    assert columns["op9"][:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert columns["op10"] == ["page_id", "url", "text", "n_chars"]
