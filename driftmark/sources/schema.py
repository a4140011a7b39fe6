"""Schemas, configuration and their defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

import numpy as np

DIMS = 14
SCALE = 10_000
PARTITIONS = 256

#: A transaction document. Timestamps stay text: the live parser reads them by position.
DOCUMENT = (
    "id STRING, "
    "transaction STRUCT<amount DOUBLE, installments INT, requested_at STRING>, "
    "customer STRUCT<avg_amount DOUBLE, tx_count_24h INT, known_merchants ARRAY<STRING>>, "
    "merchant STRUCT<id STRING, mcc STRING, avg_amount DOUBLE>, "
    "terminal STRUCT<is_online BOOLEAN, card_present BOOLEAN, km_from_home DOUBLE>, "
    "last_transaction STRUCT<timestamp STRING, km_from_current DOUBLE>"
)
REFERENCE = "vector ARRAY<DOUBLE>, label STRING"

# The documented normalisation limits and the risk of merchant categories.
MCC_RISK = {
    "4511": 0.35, "5311": 0.25, "5411": 0.15, "5812": 0.30, "5912": 0.20,
    "5944": 0.45, "5999": 0.50, "7801": 0.80, "7802": 0.75, "7995": 0.85,
}
DEFAULT_RISK = 0.5


@dataclass(frozen=True)
class Limits:
    """The largest value of each measure; a larger one counts as this."""

    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0

    def inverse(self, name: str) -> float:
        """1 / limit as a 32-bit float; 0 for a limit of 0 or less."""
        value = getattr(self, name)
        return float(np.float32(1.0 / value)) if value > 0 else 0.0


def limits_of(text: str | None) -> Limits:
    """Limits of a JSON object; the defaults if it can't be read, 0 for a key that it lacks."""
    try:
        given = {k.lower(): v for k, v in json.loads(text or "").items()}
        return Limits(**{f.name: float(given.get(f.name, 0.0)) for f in fields(Limits)})
    except (ValueError, AttributeError, TypeError):
        return Limits()


def mcc_risk_of(text: str | None) -> dict[str, float]:
    """Risks of a JSON object; the defaults if it is missing, broken or empty."""
    try:
        given = {str(k): float(v) for k, v in json.loads(text or "").items()}
    except (ValueError, AttributeError, TypeError):
        given = {}
    return given or dict(MCC_RISK)


def _local(path: str | None) -> str | None:
    try:
        return Path(path or "").read_text()
    except OSError:
        return None


def load_limits(path: str | None) -> Limits:
    """Limits of a file on this machine, as `limits_of` reads them."""
    return limits_of(_local(path))


def load_mcc_risk(path: str | None) -> dict[str, float]:
    """Risks of a file on this machine, as `mcc_risk_of` reads them."""
    return mcc_risk_of(_local(path))
