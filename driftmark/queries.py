"""The registered queries of the scoring engine, over transactions derived from `events`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import features, quantize
from driftmark.operators import evaluate, exact, ivf, lsh, partitioned, probe, score
from driftmark.operators.common import others, outcome
from driftmark.plans import fixtures
from driftmark.plans.cluster import shared_folder
from driftmark.sources import readers
from driftmark.sources.schema import Limits, limits_of, mcc_risk_of
from driftmark.streaming import scorer

K = 5
#: Queries are stored rows themselves: one neighbour more is asked for, and the row itself left out.
ASKED = K + 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query; times of day are those of UTC.

    Generated methods of over 8000 bytes, such as that of all features, are never compiled by the JVM: such plans run operator by operator.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transactions(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = fixtures.vector_table(spark, sf_dir)
    return fixtures.queries_of(table), fixtures.references_of(table)


def _partitioned(spark: SparkSession, sf_dir: str, placed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, references (with their positions where a cap counts them) and the partitions' totals and boxes."""
    queries, references = _split(spark, sf_dir)
    return queries, partitioned.positioned(references) if placed else references, partitioned.partition_stats(references)


def _neighbours(found: DataFrame) -> DataFrame:
    """The K nearest of ASKED that aren't the query itself."""
    return others(found, K).select("qid", "ref_id", "fraud", "dist", "rank")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def vectorize(spark, sf_dir):
    return _tx(spark, sf_dir).select("tx_id", *features.canonical())


@query
def vectorize_fast(spark, sf_dir):
    return _tx(spark, sf_dir).select("tx_id", *features.fast())


@query
def quantized(spark, sf_dir):
    return fixtures.vectors(_tx(spark, sf_dir)).select("tx_id", *quantize.QUANTIZED)


EDGES = [-1.5, -1.0, -0.5, 0.0, 0.00005, 0.00015, 0.00025, 0.5, 0.99995, 1.0, 1.5, float("nan")]


@query
def quantize_edges(spark, sf_dir):
    """The quantizer at its borders: sums of halves, the ends, and beyond them."""
    rows = spark.createDataFrame(list(enumerate(EDGES)), "id int, x double")
    return rows.select("id", quantize.quantize(F.col("x").cast("float")).alias("v"))


@query
def partition_key(spark, sf_dir):
    return fixtures.vectors(_tx(spark, sf_dir)).select("tx_id", "pk")


@query
def partition_stats(spark, sf_dir):
    _, references = _split(spark, sf_dir)
    return partitioned.partition_stats(references).select("pk", "total", "frauds")


@query
def partition_boxes(spark, sf_dir):
    _, references = _split(spark, sf_dir)
    return partitioned.partition_stats(references).drop("total", "frauds")


@query
def partition_index(spark, sf_dir):
    """The index written as Parquet and read back."""
    _, references = _split(spark, sf_dir)
    path = _folder(spark, "index")
    partitioned.build(references, path)
    rows, _ = readers.read_index(spark, path)
    return rows.select("ref_id", "fraud", F.col("pk").cast("int").alias("pk"), "pos")


@query
def lower_bound_topm(spark, sf_dir):
    """The four nearest other boxes of each query, whatever was found in its own partition."""
    queries, _, stats = _partitioned(spark, sf_dir)
    far = queries.select("qid", F.lit(partitioned.FAR).alias("kth"))
    return partitioned.candidate_partitions(queries, far, stats, 4).select("qid", "pk", "bound", "scan_rank")


def _exact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries, references = _split(spark, sf_dir)
    return queries, _neighbours(exact.knn(queries, references, ASKED))


@query
def knn_exact(spark, sf_dir):
    return _exact(spark, sf_dir)[1]


@query
def knn_exact_float(spark, sf_dir):
    queries, references = _split(spark, sf_dir)
    return _neighbours(exact.knn_float(queries, references, ASKED)).withColumn("dist", F.round("dist", 6))


@query
def knn_exact_float32(spark, sf_dir):
    """With 32-bit sums from left to right."""
    queries, references = _split(spark, sf_dir)
    return _neighbours(exact.knn_float(queries, references, ASKED, single=True))


@query
def score_exact(spark, sf_dir):
    """Every query's decision by exact search: the flagship."""
    return score.decide(outcome(*_exact(spark, sf_dir)))


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every transaction as a query, and its nearest others: all transactions but itself."""
    table = fixtures.vector_table(spark, sf_dir)
    queries = fixtures.as_queries(table)
    return queries, _neighbours(exact.knn(queries, fixtures.references_of(table), ASKED))


@query
def score_all(spark, sf_dir):
    """Every transaction's decision by exact search among all others."""
    return score.decide(outcome(*_all(spark, sf_dir)))


@query
def confusion_all(spark, sf_dir):
    """The confusion counts of the decisions on all transactions."""
    queries, found = _all(spark, sf_dir)
    decided = score.decide(outcome(queries, found))
    return evaluate.confusion(queries.select("qid", F.col("label").alias("fraud")).join(decided, "qid"))


def _partition_search(name: str, search: Callable, placed: bool = False) -> None:
    def run(spark, sf_dir):
        queries, references, stats = _partitioned(spark, sf_dir, placed)
        return _neighbours(search(queries, references, stats))

    run.__name__ = name
    query(run)


_partition_search("knn_partition_primary", lambda q, r, s: partitioned.knn_primary(q, r, s, ASKED))
_partition_search("knn_partition_m2", lambda q, r, s: partitioned.knn_multi(q, r, s, ASKED, 2))
_partition_search("knn_partition_all", lambda q, r, s: partitioned.knn_multi(q, r, s, ASKED, 255))
_partition_search("knn_partition_cap64", lambda q, r, s: partitioned.knn_multi(q, r, s, ASKED, 2, cap=64), placed=True)
_partition_search("knn_partition_hard64", lambda q, r, s: partitioned.knn_multi(q, r, s, ASKED, 2, cap=64, hard=True), placed=True)


@query
def outcome_hard64(spark, sf_dir):
    """Outcomes with the hard limit: (0, 0) for queries whose partition is too large."""
    queries, references, stats = _partitioned(spark, sf_dir, placed=True)
    return outcome(queries, _neighbours(partitioned.knn_multi(queries, references, stats, ASKED, 2, cap=64, hard=True)))


@query
def outcome_total_k(spark, sf_dir):
    """Outcomes in the variant that always reports k neighbours."""
    queries, references, stats = _partitioned(spark, sf_dir)
    return outcome(queries, _neighbours(partitioned.knn_multi(queries, references, stats, ASKED, 2)), F.lit(K))


@query
def nn1_partition(spark, sf_dir):
    queries, references, _ = _partitioned(spark, sf_dir)
    return partitioned.nearest_one(queries, references, but_itself=True)


@query
def partition_only_score(spark, sf_dir):
    queries, _, stats = _partitioned(spark, sf_dir)
    return score.decide(partitioned.partition_only(queries, stats))


@query
def ivf_centroids(spark, sf_dir):
    centroids, _ = ivf.train(_split(spark, sf_dir)[1])
    return ivf.centroid_table(spark, centroids)


@query
def ivf_cells(spark, sf_dir):
    _, assigned = ivf.train(_split(spark, sf_dir)[1])
    return ivf.stored(assigned).select("ref_id", "cell", "pos")


@query
def ivf_offsets(spark, sf_dir):
    _, assigned = ivf.train(_split(spark, sf_dir)[1])
    return ivf.offsets(assigned, ivf.CELLS)


def _ivf(spark, sf_dir, nprobe: int, cap: int) -> DataFrame:
    queries, references = _split(spark, sf_dir)
    centroids, assigned = ivf.train(references)
    return _neighbours(ivf.search(queries, ivf.stored(assigned) if cap else assigned, centroids, ASKED, nprobe, cap))


@query
def ivf_search_np1_cap64(spark, sf_dir):
    """The deployed search."""
    return _ivf(spark, sf_dir, 1, 64)


@query
def ivf_search_np4(spark, sf_dir):
    return _ivf(spark, sf_dir, 4, 0)


@query
def ivf_index_search(spark, sf_dir):
    """The deployed search on an index that was written and read back."""
    queries, references = _split(spark, sf_dir)
    path = _folder(spark, "ivf")
    ivf.build(references, path)
    cells, centroids = ivf.load(spark, path)
    return _neighbours(ivf.search(queries, cells, centroids, ASKED, 1, 64))


@query
def lsh_signatures(spark, sf_dir):
    return fixtures.vector_table(spark, sf_dir).select("tx_id", lsh.signature().alias("sig"))


@query
def lsh_buckets(spark, sf_dir):
    return lsh.buckets(_split(spark, sf_dir)[1]).select("sig", "pos", "ref_id")


@query
def lsh_search(spark, sf_dir):
    queries, references = _split(spark, sf_dir)
    return _neighbours(lsh.search(queries, references, ASKED)).withColumn("dist", F.round("dist", 6))


@query
def mcc_lookup(spark, sf_dir):
    return _tx(spark, sf_dir).select("tx_id", "mcc", features.mcc_risk(F.col("mcc")).alias("risk"))


@query
def known_merchant(spark, sf_dir):
    return _tx(spark, sf_dir).select("tx_id", features.known(F.col("merchant_id"), F.col("known_merchants")).alias("known"))


#: Timestamps in all the forms that the parsers tell apart.
STAMPS = ["2026-03-11T18:45:53Z", "2026-03-11T18:45:53.999Z", "2026-03-11T18:45:53-03:00", "2026-03-11 18:45:53", "2026-13-01T00:00:00Z", "2026-03-11T18:45:60Z", "short", None]


def _stamps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STAMPS)), "id int, text string")


@query
def parse_ts_live(spark, sf_dir):
    return _stamps(spark).select("id", features.parse_ts_live(F.col("text")).alias("parsed"))


@query
def parse_ts_dto(spark, sf_dir):
    return _stamps(spark).select("id", features.parse_ts_dto(F.col("text")).alias("parsed"))


@query
def score_json(spark, sf_dir):
    """Queries as JSON documents, parsed by the live rules and answered by their partition's rate."""
    tx = _tx(spark, sf_dir).where(fixtures.ASKED)
    _, _, stats = _partitioned(spark, sf_dir)
    asked = scorer.to_queries(scorer.parse(scorer.documents_json(tx)))
    return score.decide_live(partitioned.partition_only(asked, stats), K)


#: Bodies that the live parser answers in its own ways.
BODIES = {
    "valid": '{"id":"tx-1","transaction":{"amount":41.12,"installments":2,"requested_at":"2026-03-11T18:45:53Z"},"customer":{"avg_amount":82.24,"tx_count_24h":3,"known_merchants":["MERC-003","MERC-016"]},"merchant":{"id":"MERC-016","mcc":"5411","avg_amount":60.25},"terminal":{"is_online":false,"card_present":true,"km_from_home":29.2331036248},"last_transaction":null}',
    "no_time": '{"transaction":{"amount":41.12,"installments":2}}',
    "broken": '{"transaction":{"amount":41.12,',
    "empty": "",
    "wrong_type": '{"transaction":{"amount":"41.12","installments":2,"requested_at":"2026-03-11T18:45:53Z"}}',
    "unknown_keys": '{"x":[1,{"y":2}],"transaction":{"amount":10,"installments":1,"requested_at":"2026-03-11T18:45:53Z","z":{}},"customer":{"avg_amount":0},"merchant":{"id":"M\\u0041","avg_amount":1}}',
    "last_without_time": '{"transaction":{"amount":10,"installments":1,"requested_at":"2026-03-11T18:45:53Z"},"last_transaction":{"km_from_current":5}}',
    "sections_twice": '{"transaction":{"amount":10,"installments":1,"requested_at":"2026-03-11T18:45:53Z"},"merchant":{"id":"A","mcc":"7995"},"transaction":{"amount":20,"installments":3,"requested_at":"2026-03-12T08:00:00Z"},"merchant":{"id":"B","mcc":"5411"}}',
}


@query
def score_json_bad(spark, sf_dir):
    """Status and features of odd bodies; unreadable ones are answered with score 0."""
    rows = spark.createDataFrame([(i, name, body) for i, (name, body) in enumerate(BODIES.items())], "qid long, name string, body string")
    read = scorer.to_queries(scorer.parse(rows))
    scored = read.where("status = 'ok'").select("qid", *[f"g{i}" for i in range(14)])
    answer = F.when(F.col("status") == "open", readers.response(F.lit(True), F.lit(0.0).cast("float")))
    return rows.select("qid", "name").join(read.select("qid", "status", answer.alias("body")), "qid").join(scored, "qid", "left")


OUTCOMES = [(0, 5), (3, 5), (5, 5), (1, 2), (0, 0), (7, 20)]


def _outcomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(OUTCOMES)], "qid long, frauds long, total long")


@query
def decision_strict(spark, sf_dir):
    return score.decide(_outcomes(spark))


@query
def decision_live(spark, sf_dir):
    return score.decide_live(_outcomes(spark), K).drop("body")


@query
def decision_probe(spark, sf_dir):
    """The rate as a probe prints it: NaN where nothing was found."""
    return score.probe_rate(_outcomes(spark))


def _predictions(spark, sf_dir) -> DataFrame:
    queries, found = _exact(spark, sf_dir)
    return queries.select("qid", F.col("label").alias("fraud")).join(score.decide(outcome(queries, found)), "qid")


@query
def prediction_matches(spark, sf_dir):
    """Whether each decision is the one that the label expects."""
    return _predictions(spark, sf_dir).select("qid", "fraud", "approved", ((F.col("fraud") == 0) == F.col("approved")).alias("as_expected"))


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(_predictions(spark, sf_dir))


@query
def detection_score(spark, sf_dir):
    row = evaluate.detection(evaluate.confusion(_predictions(spark, sf_dir)))
    return row.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


def _p99(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.percentile("value", F.lit(0.99)).alias("p99"))


@query
def latency_score(spark, sf_dir):
    return _p99(spark, sf_dir).select(F.round("p99", 6).alias("p99"), F.round(evaluate.latency_score(F.col("p99")), 6).alias("score"))


@query
def evaluation_report(spark, sf_dir):
    """The JSON summary of a load test."""
    return evaluate.report(evaluate.confusion(_predictions(spark, sf_dir)), _p99(spark, sf_dir), "events")


@query
def recall_at_5(spark, sf_dir):
    """Of the own partition's search."""
    own, every = partitioned.knn_primary_and_all(*_split(spark, sf_dir), ASKED)
    return evaluate.recall(_neighbours(own), _neighbours(every))


@query
def recall_ivf(spark, sf_dir):
    """Of the deployed inverted-file search."""
    return evaluate.recall(_ivf(spark, sf_dir, 1, 64), _exact(spark, sf_dir)[1])


@query
def recall_ivf_np4(spark, sf_dir):
    return evaluate.recall(_ivf(spark, sf_dir, 4, 0), _exact(spark, sf_dir)[1])


@query
def recall_lsh(spark, sf_dir):
    queries, references = _split(spark, sf_dir)
    return evaluate.recall(_neighbours(lsh.search(queries, references, ASKED)), _exact(spark, sf_dir)[1])


@query
def label_counts(spark, sf_dir):
    return _tx(spark, sf_dir).groupBy("fraud").agg(F.count(F.lit(1)).alias("n"))


@query
def embedding_knn_64d(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = others(exact.knn_arrays(queries, vectors, ASKED), K, "vec_id")
    return found.select("qid", "vec_id", "label", F.round("dist", 6).alias("dist"), "rank")


@query
def stream_score(spark, sf_dir):
    """Documents from a stream of files, answered from the own partition in micro-batches."""
    queries, references, stats = _partitioned(spark, sf_dir)
    folder = _folder(spark, "stream")
    scorer.documents_json(_tx(spark, sf_dir).where(fixtures.ASKED)).write.parquet(f"{folder}/in")

    def search(asked: DataFrame) -> DataFrame:
        return score.decide_live(outcome(asked, _neighbours(partitioned.knn_primary(asked, references, stats, ASKED))), K)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    source = spark.readStream.schema("qid long, body string").option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
    running = scorer.stream(source, search, write, f"{folder}/state")
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{folder}/out").drop("batch")


#: Limits and risks other than the usual ones.
OTHER_LIMITS = Limits(max_amount=2500.0, max_installments=6.0, amount_vs_avg_ratio=4.0, max_minutes=600.0, max_km=300.0, max_tx_count_24h=3.0, max_merchant_avg_amount=4000.0)
OTHER_RISKS = {"5411": 0.05, "7995": 0.95, "0000": 0.6}


@query
def vectorize_limits(spark, sf_dir):
    """Features under another configuration."""
    return _tx(spark, sf_dir).select("tx_id", *features.canonical(OTHER_LIMITS, OTHER_RISKS))


#: Configuration files in the forms that loaders tell apart; None: there is no such file.
LIMIT_FILES = {"whole": '{"max_amount": 500, "MAX_KM": 20.5, "max_installments": 6, "amount_vs_avg_ratio": 4, "max_minutes": 60, "max_tx_count_24h": 3, "max_merchant_avg_amount": 70}', "part": '{"max_amount": 500}', "broken": '{"max_amount": ', "wrong": '{"max_amount": "much"}', "missing": None}
RISK_FILES = {"given": '{"5411": 0.25, "0000": 1}', "empty": "{}", "broken": "[1, 2", "missing": None}


def _configs(spark, files: dict[str, str | None]) -> dict[str, str | None]:
    """Text of each file, written to the shared folder and read back."""
    folder = _folder(spark, "config")
    for name, text in files.items():
        if text is not None:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return {name: readers.read_text(spark, f"{folder}/{name}") for name in files}


@query
def config_limits(spark, sf_dir):
    """Each limit as it is read from each file."""
    rows = [(name, k, v) for name, text in _configs(spark, LIMIT_FILES).items() for k, v in vars(limits_of(text)).items()]
    return spark.createDataFrame(rows, "file string, name string, value double")


@query
def config_risks(spark, sf_dir):
    """Each category's risk as it is read from each file."""
    rows = [(name, k, v) for name, text in _configs(spark, RISK_FILES).items() for k, v in mcc_risk_of(text).items()]
    return spark.createDataFrame(rows, "file string, mcc string, risk double")


@query
def vectorize_dto(spark, sf_dir):
    """Features of typed documents, whose timestamps carry offsets."""
    tx = _tx(spark, sf_dir)
    bodies = scorer.documents_json(tx.where("tx_id % 2 = 0")).unionByName(scorer.documents_json(tx.where("tx_id % 2 <> 0"), offset_hours=-3))
    return scorer.parse_typed(bodies).select(F.col("qid").alias("tx_id"), *features.canonical())


def _told(fraud: Column, number: Column) -> Column:
    """A label in one of the spellings that count."""
    spelt = F.element_at(F.array(*map(F.lit, ["fraud", "FRAUD", "Fraud"])), (number % 3 + 1).cast("int"))
    return F.when(fraud == 1, spelt).otherwise(F.when(number % 2 == 0, F.lit("legit")))


def _reference_files(spark, sf_dir) -> str:
    """All references as JSON files, each seventh vector a number short."""
    table = fixtures.vector_table(spark, sf_dir)
    whole = F.array(*[f"f{i}" for i in range(14)])
    vector = F.when(F.col("tx_id") % 7 == 0, F.slice(whole, 1, 13)).otherwise(whole)
    path = _folder(spark, "references")
    readers.write_references(table.select(F.col("tx_id").alias("ref_id"), vector.alias("vector"), _told(F.col("fraud"), F.col("tx_id")).alias("label")), path)
    return path


@query
def references_json(spark, sf_dir):
    """References written as JSON arrays and read back: short vectors go, labels count in any case."""
    return readers.read_references(spark, _reference_files(spark, sf_dir)).drop("ref_id")


@query
def references_stored(spark, sf_dir):
    """The same, quantized and kept as Parquet."""
    path = _folder(spark, "quantized")
    readers.store_references(readers.read_references(spark, _reference_files(spark, sf_dir)), path)
    return spark.read.parquet(path).drop("ref_id")


@query
def load_test_entries(spark, sf_dir):
    """Transactions as load-test files, with the answer that each expects, read back."""
    tx = _tx(spark, sf_dir)
    path = _folder(spark, "entries")
    readers.write_entries(scorer.documents_json(tx).join(tx.select(F.col("tx_id").alias("qid"), (F.col("fraud") == 0).alias("expected_approved")), "qid"), path)
    e = readers.read_entries(spark, path)
    return e.select("id", "expected_approved", "transaction.amount", "transaction.requested_at", "customer.tx_count_24h", "merchant.mcc", F.col("last_transaction.timestamp").alias("last_at"))


def _payload(spark, sf_dir) -> DataFrame:
    """A file that holds an array of documents: only the first of them is probed."""
    path = _folder(spark, "payload")
    some = scorer.documents_json(_tx(spark, sf_dir).where(fixtures.ASKED)).orderBy("qid").limit(3)
    some.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qid", "body"))), lambda x: x["body"]), ","), F.lit("]"))).write.text(path)
    return readers.read_first_document(spark, path)


@query
def probe_index(spark, sf_dir):
    """Neighbours and rate of a probed document in the partition index."""
    _, references, stats = _partitioned(spark, sf_dir)
    return probe.against_index(_payload(spark, sf_dir), references, stats, K)


@query
def probe_references(spark, sf_dir):
    """Distances, labels and rate of a probed document among references from JSON files."""
    return probe.against_references(_payload(spark, sf_dir), readers.read_references(spark, _reference_files(spark, sf_dir)), K)
