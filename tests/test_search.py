"""Searches against a plain loop, and invariants between them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import evaluate, exact, ivf, lsh, partitioned, score
from driftmark.operators.common import outcome
from driftmark.plans import fixtures
from driftmark.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    table = fixtures.vector_table(spark, SF)
    queries, references = fixtures.queries_of(table), fixtures.references_of(table)
    return queries, partitioned.positioned(references).persist(), partitioned.partition_stats(references).persist()


def _tuples(found, *names):
    return sorted(tuple(r[n] for n in names) for r in found.collect())


def test_exact_equals_a_plain_scan(split):
    queries, references, _ = split
    q, r = queries.orderBy("qid").toPandas(), references.orderBy("ref_id").toPandas()
    wanted = []
    for i, row in q[[f"q{j}" for j in range(14)]].iterrows():
        d = ((r[[f"v{j}" for j in range(14)]].to_numpy(np.int64) - row.to_numpy(np.int64)) ** 2).sum(1)
        for rank, n in enumerate(np.lexsort((r["ref_id"], d))[:5]):
            wanted.append((q["qid"][i], r["ref_id"][n], d[n], rank + 1))
    got = _tuples(exact.knn(queries, references), "qid", "ref_id", "dist", "rank")
    assert got == sorted(wanted)
    assert got == _tuples(exact.knn(queries, references, most_queries=3), "qid", "ref_id", "dist", "rank")


def test_all_partitions_equal_the_exact_distances(split):
    queries, references, stats = split
    everywhere = partitioned.knn_multi(queries, references, stats, 5, 255)
    assert _tuples(everywhere, "qid", "rank", "dist") == _tuples(exact.knn(queries, references), "qid", "rank", "dist")


def test_all_cells_equal_the_exact_distances(split):
    queries, references, _ = split
    centroids, assigned = ivf.train(references.drop("pos"), 8, 3)
    found = ivf.search(queries, ivf.stored(assigned), centroids, 5, nprobe=8)
    assert _tuples(found, "qid", "rank", "dist") == _tuples(exact.knn(queries, references), "qid", "rank", "dist")
    lengths = {r["cell"]: (r["start"], r["length"]) for r in ivf.offsets(assigned, 8).collect()}
    assert sum(n for _, n in lengths.values()) == references.count() and lengths[0][0] == 0


def test_partition_rate_is_the_label_ratio(split):
    queries, references, stats = split
    rates = {r["pk"]: (r["f"], r["n"]) for r in references.groupBy("pk").agg(F.sum("fraud").alias("f"), F.count("*").alias("n")).collect()}
    pk = {r["qid"]: r["qpk"] for r in queries.collect()}
    for r in partitioned.partition_only(queries, stats).collect():
        assert (r["frauds"], r["total"]) == rates.get(pk[r["qid"]], (0, 0))


def test_nearest_one_is_rank_one(split):
    queries, references, stats = split
    one = _tuples(partitioned.nearest_one(queries, references), "qid", "ref_id", "dist")
    assert one == _tuples(partitioned.knn_primary(queries, references, stats).where("rank = 1"), "qid", "ref_id", "dist")


def test_queries_without_neighbours_are_answered(split):
    queries, references, stats = split
    hard = partitioned.knn_multi(queries, references, stats, 5, 2, cap=3, hard=True)
    decided = {r["qid"]: r for r in score.decide(outcome(queries, hard)).collect()}
    assert len(decided) == queries.count()
    searched = {r["qid"] for r in hard.select("qid").distinct().collect()}
    assert all((r["total"], r["fraud_score"], r["approved"]) == (0, 0.0, True) for q, r in decided.items() if q not in searched)


def test_an_empty_partition_takes_a_place(spark):
    """Empty boxes are zero and can displace a partition that has rows."""
    names = "qid long, qpk int, kth long, " + ", ".join(f"q{i} int" for i in range(14))
    q = spark.createDataFrame([(1, 255, *[0] * 14)], names.replace("kth long, ", ""))
    kth = spark.createDataFrame([(1, partitioned.FAR)], "qid long, kth long")
    references = spark.createDataFrame([(1, 0, 7, *[9000] * 14)], "ref_id long, fraud int, pk int, " + ", ".join(f"v{i} int" for i in range(14)))
    found = partitioned.candidate_partitions(q, kth, partitioned.partition_stats(references), 2).collect()
    assert sorted((r["pk"], r["bound"]) for r in found) == [(0, 0), (1, 0)]


def test_lsh_probes(split):
    queries, references, _ = split
    planes = np.array(lsh.planes(), float)
    r, q = references.toPandas(), queries.toPandas()
    side = lambda x: ((x.to_numpy(np.float64) @ planes.T >= 0) << np.arange(16)).sum(1)
    r["sig"] = side(r[[f"f{i}" for i in range(14)]])
    r = r.sort_values("ref_id")
    wanted = set()
    for n, own in zip(q["qid"], side(q[[f"g{i}" for i in range(14)]]), strict=True):
        ids, probe = list(r[r["sig"] == own]["ref_id"]), 0
        while len(ids) < 5 and probe < 8:
            ids += list(r[r["sig"] == own ^ (1 << probe)]["ref_id"])
            probe += 1
        x = q[q["qid"] == n][[f"g{i}" for i in range(14)]].to_numpy(float)[0]
        d = [((r[r["ref_id"] == i][[f"f{j}" for j in range(14)]].to_numpy(float)[0] - x) ** 2).sum() for i in ids]
        wanted |= {(n, ids[i]) for i in np.argsort(d, kind="stable")[:5]}
    got = {(x["qid"], x["ref_id"]) for x in lsh.search(queries, references.drop("pos")).collect()}
    assert got == wanted


def test_lsh_holds_no_row_against_queries_that_comes_too_late(spark, split, monkeypatch):
    """Large buckets, gathered a few rows at a time: the results of all rows, from the first candidates of each bucket alone."""
    queries, references, _ = split
    same = references.select("ref_id", "fraud", *[F.round(f"f{i}", 0).cast("float").alias(f"f{i}") for i in range(14)])
    asked = queries.select("qid", *[F.round(f"g{i}", 0).cast("float").alias(f"g{i}") for i in range(14)])
    stored = []
    search = lsh.in_groups
    monkeypatch.setattr(lsh, "in_groups", lambda probes, rows, *more: stored.append(rows) or search(probes, rows, *more))
    monkeypatch.setattr(lsh, "HELD_ROWS", 40)
    found = _tuples(lsh.search(asked, same, 6, candidates=15), "qid", "rank", "ref_id", "dist", "probe")
    r = same.withColumn("sig", lsh.signature()).orderBy("ref_id").toPandas()
    buckets = {sig: rows[:15] for sig, rows in r.groupby("sig")}
    sizes = r.groupby("sig").size()
    assert sizes.max() > 40  # else there is nothing to leave out
    wanted = []
    for q in asked.withColumn("sig", lsh.signature("g")).toPandas().itertuples():
        n, rows = 0, []
        for probe in range(lsh.PROBES + 1):
            sig = q.sig ^ (1 << probe - 1 if probe else 0)
            if n < 6 and sig in buckets:
                for place, y in enumerate(buckets[sig][: max(0, 15 - n)].itertuples()):
                    rows.append((sum((getattr(q, f"g{i}") - getattr(y, f"f{i}")) ** 2 for i in range(14)), probe, place, y.ref_id))
                n += sizes[sig]
        wanted += [(q.qid, i + 1, ref, d, probe) for i, (d, probe, _, ref) in enumerate(sorted(rows)[:6])]
    assert found == sorted(wanted)
    assert stored[0].groupBy("sig").count().agg(F.max("count")).first()[0] == 15


def test_decisions(spark):
    df = spark.createDataFrame([(0, 0, 5), (1, 3, 5), (2, 5, 5), (3, 1, 2), (4, 0, 0)], "qid long, frauds long, total long")
    assert [(round(r["fraud_score"], 4), r["approved"]) for r in score.decide(df).orderBy("qid").collect()] == [(0.0, True), (0.6, False), (1.0, False), (0.5, True), (0.0, True)]
    live = score.decide_live(df).orderBy("qid").collect()
    assert [(round(r["fraud_score"], 4), r["approved"]) for r in live] == [(0.0, True), (0.6, True), (1.0, False), (0.4, True), (0.0, True)]
    assert live[0]["body"] == '{"approved":true,"fraud_score":0.0}'


def test_scores(spark):
    rows = [(1, False)] * 5 + [(0, True)] * 90 + [(0, False)] * 2 + [(1, True)] * 1 + [(0, None)] * 2
    counts = evaluate.confusion(spark.createDataFrame(rows, "fraud int, approved boolean"))
    assert tuple(counts.first()) == (5, 90, 2, 1, 2)
    row = evaluate.detection(counts).first()
    assert (row["n"], row["weighted_errors"]) == (100, 15)
    assert abs(row["detection_score"] - (1000 * np.log10(1 / 0.15) - 300 * np.log10(16))) < 1e-9
    p = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (2001.0,)], "p double").select(evaluate.latency_score(F.col("p")).alias("s"))
    assert [round(r["s"], 6) for r in p.collect()] == [0.0, 3000.0, 2000.0, -3000.0]
    assert tuple(evaluate.detection(evaluate.confusion(spark.createDataFrame([], "fraud int, approved boolean"))).first())[5:] == (0, 0, 0.0, 0.0, 3000.0)


def test_all_transactions_are_scored_among_all_others(spark):
    rows = fixtures.vector_table(spark, SF).orderBy("tx_id").toPandas()
    v, fraud = rows[[f"v{j}" for j in range(14)]].to_numpy(np.int64), rows["fraud"].to_numpy()
    wanted, counts = {}, {"tp": 0, "tn": 0, "fp": 0, "fn": 0, "err": 0}
    for i, tx in enumerate(rows["tx_id"]):
        near = [n for n in np.argsort(((v - v[i]) ** 2).sum(1), kind="stable") if n != i][:5]
        wanted[tx] = (fraud[near].sum(), 5, fraud[near].sum() < 3)
        counts[("t" if wanted[tx][2] == (fraud[i] == 0) else "f") + ("n" if wanted[tx][2] else "p")] += 1
    assert {r["qid"]: (r["frauds"], r["total"], r["approved"]) for r in QUERIES["score_all"](spark, SF).collect()} == wanted
    assert QUERIES["confusion_all"](spark, SF).first().asDict() == counts


def test_blocks_of_probes_change_nothing(split):
    """Probes held a few at a time, and places that end a group's part early."""
    from driftmark.operators.blocks import in_groups, of_integers
    from driftmark.operators.common import Q, V, nearest

    queries, references, stats = split
    probes = partitioned.candidate_partitions(queries, partitioned.kth_distance(queries, queries.select("qid", F.lit(0).alias("rank"), F.lit(0).alias("dist")), 5), stats, 3)
    probes = probes.withColumn("upto", F.col("scan_rank").cast("long") * 4)
    order = ["dist", "scan_rank", "pos"]
    found = lambda most: _tuples(nearest(in_groups(probes, references, "pk", Q, V, np.float64, of_integers, 4, "long", most), order, 4), "qid", "rank", "ref_id", "dist")
    assert found(10_000) == found(7)
    p, r, wanted = probes.toPandas(), references.toPandas(), {}
    for x in p.itertuples():
        own = r[(r["pk"] == x.pk) & (r["pos"] < x.upto)]
        for y in own.itertuples():
            d = sum((getattr(x, f"q{i}") - getattr(y, f"v{i}")) ** 2 for i in range(14))
            wanted.setdefault(x.qid, []).append((d, x.scan_rank, y.pos, y.ref_id))
    assert found(7) == sorted((q, n + 1, ref, d) for q, rows in wanted.items() for n, (d, _, _, ref) in enumerate(sorted(rows)[:4]))


def test_arrays_of_several_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-3, 4, 2 + i % 2)] if i % 11 else None) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    queries = vectors.where("vec_id % 5 = 0").selectExpr("vec_id qid", "embedding")
    wanted = []
    for q, _, x in rows[::5]:
        near = sorted((float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), i) for i, _, y in rows if x and y and len(x) == len(y))
        wanted += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:4])]
    for most in (1000, 6):
        assert _tuples(exact.knn_arrays(queries, vectors, 4, most), "qid", "rank", "vec_id", "dist") == sorted(wanted)


def test_a_probe_of_nothing_has_no_rate(spark, split):
    from driftmark.operators import probe
    from driftmark.plans.fixtures import ASKED, transactions
    from driftmark.streaming.scorer import documents_json
    from driftmark.sources.schema import DOCUMENT

    _, references, stats = split
    body = documents_json(transactions(spark.read.parquet(f"{SF}/events.parquet")).where(ASKED)).orderBy("qid").limit(1)
    document = body.select(F.from_json("body", DOCUMENT).alias("d")).select("d.*")
    empty = references.limit(0)
    (row,) = probe.against_index(document, empty, partitioned.partition_stats(empty)).collect()
    assert np.isnan(row["fraud_score"]) and row["rank"] is None
    rows = probe.against_index(document, references, stats).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5] and rows[0]["fraud_score"] == np.float32(sum(r["fraud"] for r in rows) / 5)


@pytest.mark.parametrize("piece_rows", [60])
def test_exact_compares_few_pairs_and_loses_none(spark, monkeypatch, piece_rows):
    """Many small pieces and cells, equal vectors that no cut parts, gaps and odd numbers: the k nearest of a plain scan, from far fewer pairs inside a piece."""
    from driftmark.operators import boxes

    monkeypatch.setattr(boxes, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(boxes, "CELL_ROWS", 16)
    rng = np.random.default_rng(5)
    x = np.round(rng.random((600, 14)) * [1, 1, 0.2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 2).astype(np.float32)
    x[:, 9] = rng.integers(0, 2, 600)
    x[100:260] = x[100]
    rows = [(i, i % 2, *map(float, v)) for i, v in enumerate(x)]
    rows[7] = (7, 0, float("nan"), *rows[7][3:])
    rows[8] = (8, 0, None, *rows[8][3:])
    table = spark.createDataFrame(rows, "ref_id long, fraud int, " + ", ".join(f"f{i} float" for i in range(14))).repartition(5).cache()
    scaled = table.select("ref_id", "fraud", *[F.rint(F.col(f"f{i}") * 100).cast("int").alias(f"v{i}") for i in range(14)]).where("ref_id not in (7, 8)")
    for dtype, search, named, letters in (
        (np.float64, lambda q, r: exact.knn_float(q, r, 6, most_queries=50), table, ("f", "g")),
        (np.float32, lambda q, r: exact.knn_float(q, r, 6, single=True, most_queries=50), table, ("f", "g")),
        (np.int64, lambda q, r: exact.knn(q, r, 6, most_queries=50), scaled, ("v", "q")),
    ):
        queries = named.select(F.col("ref_id").alias("qid"), *[F.col(f"{letters[0]}{i}").alias(f"{letters[1]}{i}") for i in range(14)]).where("qid % 3 = 1 or qid = 8")
        held = np.rint(x * 100).astype(dtype) if dtype is np.int64 else x.astype(dtype)
        fine = np.array([i for i in range(600) if i not in (7, 8)])
        wanted = []
        for qid in [i for i in range(1, 600, 3) if i not in (7, 8)]:
            d = np.zeros(len(fine), dtype)
            for i in range(14):
                d += (held[qid, i] - held[fine, i]) ** 2
            wanted += [(qid, int(fine[n]), d[n], rank + 1) for rank, n in enumerate(np.lexsort((fine, d))[:6])]
        assert _tuples(search(queries, named), "qid", "ref_id", "dist", "rank") == sorted(wanted)


def test_own_partition_and_all_come_from_one_search_by_boxes(spark, split, monkeypatch):
    """Small pieces: both results are those of the two searches, and the recall compares few pairs."""
    from driftmark.operators import blocks, boxes

    queries, references, stats = split
    unplaced = references.drop("pos")
    columns = ("qid", "rank", "ref_id", "fraud", "dist")
    own, every = (_tuples(f, *columns) for f in (partitioned.knn_primary(queries, unplaced, stats, 6), exact.knn(queries, unplaced, 6)))
    monkeypatch.setattr(boxes, "PIECE_ROWS", 60)
    found = partitioned.knn_primary_and_all(queries, unplaced, 6)
    assert [_tuples(f, *columns) for f in found] == [own, every] and own != every
    monkeypatch.setattr(blocks, "scan", None)  # all rows of a partition against all its queries
    assert QUERIES["recall_at_5"](spark, SF).first()["recall"] < 1


def test_exact_works_out_once_which_pieces_are_asked_for(split):
    """What the search leaves to be done compares rows; no bounds are left in it, which were worked out for the counts."""
    queries, references, _ = split
    plan = exact.knn(queries, references.drop("pos"), 6)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan and "MapInArrow" not in plan


def test_exact_leaves_out_far_cells(monkeypatch):
    from driftmark.operators import boxes
    from driftmark.operators.blocks import of_integers

    rng = np.random.default_rng(1)
    v = rng.integers(0, 10_000, (20_000, 4)).astype(float)
    pairs = []
    best = boxes.in_piece(v, np.arange(len(v)), np.zeros(len(v), np.int64), v[:200], np.full(200, 2**63 - 1), lambda a, b: pairs.append(len(a) * len(b)) or of_integers(a, b), 6, "long")
    assert (best.told[0, :, 0] == np.arange(200)).all() and sum(pairs) < 0.2 * 200 * len(v)


def test_exact_looks_at_few_bounds(monkeypatch):
    from driftmark.operators import boxes
    from driftmark.operators.blocks import of_integers

    rng = np.random.default_rng(4)
    v = rng.integers(0, 10_000, (8, 14))[rng.integers(0, 8, 6000)] + rng.integers(0, 300, (6000, 14))
    v, looked, plain = v.astype(float), [], boxes.bounds
    monkeypatch.setattr(boxes, "bounds", lambda q, low, high: looked.append(len(q) * len(low)) or plain(q, low, high))
    boxes.in_piece(v, np.arange(6000), np.zeros(6000, np.int64), v[:3000], np.full(3000, 2**63 - 1), of_integers, 6, "long")
    assert sum(looked) < 3000 * len(boxes.Cuts(v, boxes.CELL_ROWS).leaves) / 2


@pytest.mark.parametrize("dtype, kind", [(np.float64, "double"), (np.float32, "float")])
@pytest.mark.parametrize("upto", [False, True])
@pytest.mark.parametrize("grain", [1e-3, 0.5, 0])
def test_products_leave_out_no_near_pair(monkeypatch, dtype, kind, upto, grain):
    """What is left to be summed in order is little, and gives what summing all in order gives."""
    from driftmark.operators import blocks

    rng = np.random.default_rng(6)
    x = rng.random((700, 14)) - 0.2
    x = (np.round(x / grain) * grain if grain else x * 1e-25).astype(dtype)
    q, v, at = x[:200], x, np.arange(200)
    places, limits = rng.permutation(700), rng.integers(0, 700, 200) if upto else None
    summed, found = [], []
    monkeypatch.setattr(blocks, "of_pairs", lambda q, v, plain=blocks.of_pairs: summed.append(len(q)) or plain(q, v))
    for distance in (blocks.in_order, lambda q, v: blocks.in_order(q, v)):
        best = blocks.Best(200, 6, kind)
        for a in range(0, 700, 100):
            blocks.compare(best, at, q, v[a : a + 100], places[a : a + 100], places[a : a + 100], places[a : a + 100], at * 0, limits, distance)
        found.append(best)
    assert all((getattr(found[0], n) == getattr(found[1], n)).all() for n in ("dist", "keys", "told"))
    assert summed and (grain != 1e-3 or sum(summed) < 200 * 700 / 8)


def test_centroids_by_products_are_those_of_ordered_sums(monkeypatch):
    rng = np.random.default_rng(8)
    centroids = np.concatenate([rng.integers(0, 4, (60, 14)) * 2500.0, rng.random((60, 14)) * 10_000])
    x, summed, plain = rng.integers(0, 4, (3000, 14)) * 2500.0, [], ivf._distances
    want = plain(x, centroids).argmin(1)
    monkeypatch.setattr(ivf, "_distances", lambda x, c: summed.append(len(x)) or plain(x, c))
    assert (ivf._nearest(x, centroids) == want).all()
    assert sum(summed) < 1500


def test_long_generated_methods_are_not_used(spark):
    QUERIES["decision_strict"](spark, "")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
