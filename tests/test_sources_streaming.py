import gzip
import json

import pytest

from driftmark.operators import partitioned, score
from driftmark.plans import fixtures
from driftmark.queries import BODIES, QUERIES
from driftmark.sources import readers
from driftmark.streaming import scorer

SF = "/root/testdata/sf0.001"


def test_references(spark, tmp_path):
    rows = [{"vector": [0.5] * 14, "label": "FRAUD"}, {"vector": [1] * 13, "label": "fraud"}, {"vector": None}, {"vector": [0.25] * 14, "label": None}, {"vector": [0.1] * 14, "label": "legit", "x": 1}]
    path = tmp_path / "references.json.gz"
    path.write_bytes(gzip.compress(json.dumps(rows).encode()))
    got = readers.read_references(spark, str(path)).orderBy("ref_id").collect()
    assert [(round(r["f0"], 4), r["fraud"]) for r in got] == [(0.5, 1), (0.25, 0), (0.1, 0)]


def test_entries_and_documents(spark, tmp_path):
    path = tmp_path / "entries.json"
    path.write_text(json.dumps({"entries": [json.loads(BODIES["valid"]) | {"expected_approved": True}]}))
    (row,) = readers.read_entries(spark, str(path)).collect()
    assert row["expected_approved"] and row["merchant"]["mcc"] == "5411" and row["last_transaction"] is None
    path.write_text(BODIES["valid"])
    assert readers.read_documents(spark, str(path)).first()["transaction"]["amount"] == 41.12


def test_index_round_trip(spark, tmp_path):
    table = fixtures.vector_table(spark, SF)
    queries, references = fixtures.queries_of(table), fixtures.references_of(table)
    partitioned.build(references, str(tmp_path / "index"))
    rows, stats = readers.read_index(spark, str(tmp_path / "index"))
    pick = lambda df: sorted((r["qid"], r["ref_id"], r["dist"]) for r in df.collect())
    fresh = partitioned.knn_multi(queries, partitioned.positioned(references), partitioned.partition_stats(references))
    assert pick(partitioned.knn_multi(queries, rows, stats)) == pick(fresh)


def test_bodies(spark):
    got = {r["name"]: r for r in QUERIES["score_json_bad"](spark, SF).collect()}
    assert {n: r["status"] for n, r in got.items()} == {"valid": "ok", "no_time": "open", "broken": "open", "empty": "open", "wrong_type": "error", "unknown_keys": "ok", "last_without_time": "ok", "sections_twice": "ok"}
    assert got["empty"]["body"] == '{"approved":true,"fraud_score":0.0}' and got["valid"]["body"] is None
    spec = [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]
    assert all(abs(got["valid"][f"g{i}"] - x) < 5e-4 for i, x in enumerate(spec))
    assert (got["unknown_keys"]["g2"], got["unknown_keys"]["g11"]) == (0.0, 1.0)
    assert (round(got["sections_twice"]["g0"], 4), round(got["sections_twice"]["g12"], 4)) == (0.002, 0.15)  # the last section counts
    assert (got["last_without_time"]["g5"], round(got["last_without_time"]["g6"], 4)) == (1.0, 0.005)


@pytest.mark.parametrize("files", [1, 3])
def test_a_stream_gives_what_a_batch_gives(spark, tmp_path, files):
    table = fixtures.vector_table(spark, SF)
    references = fixtures.references_of(table)
    stats = partitioned.partition_stats(references)
    bodies = scorer.documents_json(fixtures.transactions(spark.read.parquet(f"{SF}/events.parquet")).where("tx_id % 20 = 0"))
    bodies.repartition(files).write.parquet(str(tmp_path / "in"))
    answer = lambda asked: score.decide_live(partitioned.partition_only(asked, stats))
    source = spark.readStream.schema("qid long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = scorer.stream(source, answer, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "state"))
    running.processAllAvailable()
    running.stop()
    pick = lambda df: sorted((r["qid"], r["body"]) for r in df.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(answer(scorer.to_queries(scorer.parse(bodies))))
