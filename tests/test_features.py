"""Facts of the vectorizer, the quantizer and the keys."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.functions import features, quantize
from driftmark.sources import schema

TX = (
    "amount double, installments int, requested_at timestamp_ntz, customer_avg double, tx_count_24h int, known_merchants array<string>, "
    "merchant_id string, mcc string, merchant_avg double, is_online boolean, card_present boolean, km_from_home double, last_ts timestamp_ntz, last_km double"
)
SPEC = [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]


def _spec(spark, **changes):
    import datetime as dt

    row = dict(
        amount=41.12, installments=2, requested_at=dt.datetime(2026, 3, 11, 18, 45, 53), customer_avg=82.24, tx_count_24h=3,
        known_merchants=["MERC-003", "MERC-016"], merchant_id="MERC-016", mcc="5411", merchant_avg=60.25, is_online=False,
        card_present=True, km_from_home=29.2331036248, last_ts=None, last_km=None,
    )
    return spark.createDataFrame([tuple((row | changes).values())], TX)


@pytest.mark.parametrize("variant", [features.canonical, features.fast])
def test_spec_vector(spark, variant):
    (row,) = _spec(spark).select(*variant()).collect()
    assert all(abs(a - b) < 5e-4 for a, b in zip(row, SPEC, strict=True))


def test_variants_differ_where_the_average_is_zero(spark):
    df = _spec(spark, customer_avg=0.0)
    assert df.select(*features.canonical()).first()["f2"] == 1.0
    assert df.select(*features.fast()).first()["f2"] == 0.0


def test_last_transaction_and_merchants(spark):
    import datetime as dt

    df = _spec(spark, last_ts=dt.datetime(2026, 3, 11, 18, 33, 53), last_km=2500.0, merchant_id="MERC-999", mcc="1234")
    row = df.select(*features.canonical()).first()
    assert abs(row["f5"] - 12 / 1440) < 1e-6 and row["f6"] == 1.0 and row["f11"] == 1.0 and row["f12"] == 0.5
    later = _spec(spark, last_ts=dt.datetime(2026, 3, 12), last_km=-1.0, known_merchants=None)
    row = later.select(*features.canonical()).first()
    assert (row["f5"], row["f6"], row["f11"]) == (0.0, 0.0, 1.0)


def test_quantizer_facts(spark):
    wanted = {0.0: 0, 1.0: 10000, 0.5: 5000, -1.0: -10000, -0.5: 0, 1.5: 10000, -1.5: -10000}
    df = spark.createDataFrame([(x,) for x in [*wanted, float("nan")]], "x double")
    got = [r["v"] for r in df.select(quantize.quantize(F.col("x").cast("float")).alias("v")).collect()]
    assert got == [*wanted.values(), 0]
    halves = [0.00005, 0.00015, 0.00025, 0.12345, 0.99995]
    df = spark.createDataFrame([(x,) for x in halves], "x double")
    got = [r["v"] for r in df.select(quantize.quantize(F.col("x").cast("float")).alias("v")).collect()]
    assert got == [int(np.rint(np.float64(np.float32(x) * np.float32(10000)))) for x in halves]


def _vector(spark, **values):
    row = [values.get(f"v{i}", 0) for i in range(14)]
    return spark.createDataFrame([tuple(row)], ", ".join(f"v{i} int" for i in range(14)))


@pytest.mark.parametrize(("values", "key"), [({}, 0), ({"v5": 100, "v9": 1, "v10": 1, "v11": 1}, 15), ({"v12": 2048}, 16), ({"v12": 9000}, 48), ({"v2": 4097}, 64), ({"v8": 2049}, 128), ({"v2": 4096, "v8": 2048, "v5": -1}, 0)])
def test_partition_keys(spark, values, key):
    assert _vector(spark, **values).select(quantize.partition_key().alias("k")).first()["k"] == key


def test_lower_bound(spark):
    names = ", ".join(f"q{i} int, mn{i} int, mx{i} int" for i in range(14))
    df = spark.createDataFrame([tuple([0, 5000, 10000] * 14), tuple([7000, 5000, 10000] * 14)], names)
    assert [r["b"] for r in df.select(quantize.lower_bound().alias("b")).collect()] == [14 * 5000**2, 0]


def test_configuration(tmp_path):
    assert schema.load_limits(None) == schema.Limits() == schema.load_limits(str(tmp_path / "none.json"))
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"max_amount": 5, "Max_KM": 7}))
    limits = schema.load_limits(str(path))
    assert (limits.max_amount, limits.max_km, limits.max_minutes) == (5, 7, 0)
    assert limits.inverse("max_minutes") == 0 and math.isclose(limits.inverse("max_amount"), 0.2, rel_tol=1e-6)
    path.write_text("[broken")
    assert schema.load_limits(str(path)) == schema.Limits() and schema.load_mcc_risk(str(path)) == schema.MCC_RISK
    path.write_text("{}")
    assert schema.load_mcc_risk(str(path)) == schema.MCC_RISK
    path.write_text('{"1111": 0.9}')
    assert schema.load_mcc_risk(str(path)) == {"1111": 0.9}


def test_vectors_need_no_spelt_merchants(spark):
    """Numbers of the ten merchants before give the features of their ids, also at equal and null times; no frame of a day is counted anew."""
    from driftmark.plans import fixtures

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    again = events.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 10_000)
    timeless = events.where("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + 20_000).withColumn("ts", F.lit(None).cast(dict(events.dtypes)["ts"]))
    events = events.unionByName(again).unionByName(timeless)
    rows = fixtures.transactions(events, spelt=False)
    assert "RangeFrame, -" not in rows._jdf.queryExecution().toString()
    lean, whole = fixtures.vectors(rows), fixtures.vectors(fixtures.transactions(events))
    assert lean.dtypes == whole.dtypes and sorted(lean.collect()) == sorted(whole.collect())
    seen = {(r["user_id"], r["micros"], r["event_id"]) for r in events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id").collect()}
    counts = {r["tx_id"]: r["tx_count_24h"] for r in rows.collect()}
    for user, at, event in seen:
        assert counts[event] == sum(u == user and (m is None if at is None else m is not None and at - fixtures.DAY <= m <= at) for u, m, _ in seen) - 1
