"""The 14 features of a transaction as column expressions, in two variants.

`canonical` divides in double precision and follows the documented rules. `fast` multiplies
by 32-bit inverses, as the live path does, and can differ by one quantization step.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.sources.schema import DEFAULT_RISK, DIMS, MCC_RISK, Limits

FEATURES = [f"f{i}" for i in range(DIMS)]


def clamp(x: Column) -> Column:
    """x within 0 and 1 as a 32-bit float; NaN stays, null becomes null."""
    return F.when(F.isnan(x), x).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(x).cast("float")


def parse_ts_live(text: Column) -> Column:
    """Timestamp by fixed positions: separators, fraction and offset are not looked at.

    Text that is too short or holds no such date is read as a usual timestamp, its offset
    dropped; what can't be read is null.
    """
    part = lambda start, n: F.when(F.substring(text, start, n).rlike(rf"^[0-9]{{{n}}}$"), F.substring(text, start, n).cast("int"))
    year, month, day, hour, minute, second = (part(*x) for x in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
    valid = (F.octet_length(text) >= 19) & (year > 0) & (second <= 59)
    fixed = F.when(valid, F.try_make_timestamp_ntz(year, month, day, hour, minute, second))
    return F.coalesce(fixed, F.try_to_timestamp(text).cast("timestamp_ntz"))


def parse_ts_dto(text: Column) -> Column:
    """Timestamp with its offset turned to UTC; null if it can't be read. Needs a UTC session."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def mcc_risk(mcc: Column, risks: dict[str, float] | None = None) -> Column:
    """Risk of a merchant category, DEFAULT_RISK if it is unknown or null."""
    risks = MCC_RISK if risks is None else risks
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sorted(risks.items())))
    return F.coalesce(F.try_element_at(table, mcc), F.lit(DEFAULT_RISK)).cast("float")


def known(merchant: Column, merchants: Column) -> Column:
    """Whether a merchant is among the customer's; false where either is null."""
    return F.coalesce(F.array_contains(merchants, merchant), F.lit(False))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes from earlier to later as a double, at least 0."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.greatest((micros(later) - micros(earlier)) / F.lit(60e6), F.lit(0.0))


def _shared(limits_risk: dict[str, float] | None) -> dict[int, Column]:
    c = F.col
    return {
        3: (F.hour("requested_at") / F.lit(23.0)).cast("float"),
        4: (F.weekday("requested_at") / F.lit(6.0)).cast("float"),
        9: F.coalesce(c("is_online"), F.lit(False)).cast("float"),
        10: F.coalesce(c("card_present"), F.lit(False)).cast("float"),
        11: F.when(known(c("merchant_id"), c("known_merchants")), 0.0).otherwise(1.0).cast("float"),
        12: mcc_risk(c("mcc"), limits_risk),
    }


def _ratio(value: Column, limit: float) -> Column:
    """value / limit; a limit of 0 sends positive values to 1 and others to 0."""
    return value / F.lit(limit) if limit else F.when(value > 0, 1.0).otherwise(0.0)


def canonical(limits: Limits = Limits(), risks: dict[str, float] | None = None) -> list[Column]:
    """f0..f13 of columns named as in `plans.fixtures.transactions`."""
    c = F.col
    n = limits
    has_last = c("last_ts").isNotNull()
    f = _shared(risks) | {
        0: clamp(_ratio(c("amount"), n.max_amount)),
        1: clamp(_ratio(c("installments").cast("double"), n.max_installments)),
        2: clamp(_ratio(F.when(c("customer_avg") > 0, F.try_divide(c("amount"), c("customer_avg"))).otherwise(F.lit(n.amount_vs_avg_ratio)), n.amount_vs_avg_ratio)),
        5: F.when(has_last, clamp(_ratio(minutes_between(c("requested_at"), c("last_ts")), n.max_minutes))).otherwise(F.lit(-1.0)).cast("float"),
        6: F.when(has_last, clamp(_ratio(c("last_km"), n.max_km))).otherwise(F.lit(-1.0)).cast("float"),
        7: clamp(_ratio(c("km_from_home"), n.max_km)),
        8: clamp(_ratio(c("tx_count_24h").cast("double"), n.max_tx_count_24h)),
        13: clamp(_ratio(c("merchant_avg"), n.max_merchant_avg_amount)),
    }
    return [f[i].alias(f"f{i}") for i in range(DIMS)]


def fast(limits: Limits = Limits(), risks: dict[str, float] | None = None, has_last: Column | None = None) -> list[Column]:
    """f0..f13 as the live path computes them.

    has_last: whether the document has a last transaction; without a readable time it
    counts as long ago.
    """
    c, inverse = F.col, limits.inverse
    has_last = c("last_ts").isNotNull() if has_last is None else has_last
    whole = lambda name, limit: (c(name).cast("float") * F.lit(inverse(limit)).cast("float")).cast("double")
    ratio = F.when(c("customer_avg") > 0, F.try_divide(c("amount"), c("customer_avg")) * F.lit(inverse("amount_vs_avg_ratio"))).otherwise(F.lit(0.0))
    ago = F.when(c("last_ts").isNull(), F.lit(1.0)).otherwise(minutes_between(c("requested_at"), c("last_ts")) * F.lit(inverse("max_minutes")))
    f = _shared(risks) | {
        0: clamp(c("amount") * F.lit(inverse("max_amount"))),
        1: clamp(whole("installments", "max_installments")),
        2: clamp(ratio),
        5: F.when(has_last, clamp(ago)).otherwise(F.lit(-1.0)).cast("float"),
        6: F.when(has_last, clamp(c("last_km") * F.lit(inverse("max_km")))).otherwise(F.lit(-1.0)).cast("float"),
        7: clamp(c("km_from_home") * F.lit(inverse("max_km"))),
        8: clamp(whole("tx_count_24h", "max_tx_count_24h")),
        13: clamp(c("merchant_avg") * F.lit(inverse("max_merchant_avg_amount"))),
    }
    return [f[i].alias(f"f{i}") for i in range(DIMS)]
