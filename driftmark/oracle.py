"""DuckDB SQL for the scoring queries, written apart from the Spark plans.

The statements share common table expressions; each takes those that it needs.
"""

from __future__ import annotations

from driftmark.operators import ivf, lsh
from driftmark.plans.fixtures import ASKED as ASKED_IDS
from driftmark.plans.fixtures import MCCS
from driftmark.queries import ASKED, BODIES, EDGES, OTHER_LIMITS, OTHER_RISKS, OUTCOMES, STAMPS, K
from driftmark.sources.schema import DEFAULT_RISK, MCC_RISK, Limits

D = range(14)


def _number(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def _clamp(x: str) -> str:
    return f"CAST(CASE WHEN isnan({x}) THEN {x} WHEN {x} <= 0 THEN 0e0 WHEN {x} >= 1 THEN 1e0 ELSE {x} END AS FLOAT)"


def _sum(terms) -> str:
    return " + ".join(terms)


MINUTES = "greatest((epoch_us(requested_at) - epoch_us(last_ts)) / 60e6, 0e0)"


def _shared(risks: dict[str, float]) -> dict[int, str]:
    return {
        3: "CAST(hour(requested_at) / 23e0 AS FLOAT)",
        4: "CAST((isodow(requested_at) - 1) / 6e0 AS FLOAT)",
        9: "CAST(CAST(is_online AS INTEGER) AS FLOAT)",
        10: "CAST(CAST(card_present AS INTEGER) AS FLOAT)",
        11: "CAST(CASE WHEN list_contains(known_merchants, merchant_id) THEN 0 ELSE 1 END AS FLOAT)",
        12: "CAST(CASE mcc " + " ".join(f"WHEN '{k}' THEN {_number(v)}" for k, v in risks.items()) + f" ELSE {_number(DEFAULT_RISK)} END AS FLOAT)",
    }


SHARED = _shared(MCC_RISK)


def _canonical(n: Limits = Limits(), risks: dict[str, float] = MCC_RISK) -> list[str]:
    div = lambda x, m: _clamp(f"(({x}) / {_number(m)})")
    ratio = f"CASE WHEN customer_avg > 0 THEN amount / customer_avg ELSE {_number(n.amount_vs_avg_ratio)} END"
    f = _shared(risks) | {
        0: div("amount", n.max_amount), 1: div("CAST(installments AS DOUBLE)", n.max_installments), 2: div(ratio, n.amount_vs_avg_ratio),
        5: f"CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {div(MINUTES, n.max_minutes)} END",
        6: f"CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {div('last_km', n.max_km)} END",
        7: div("km_from_home", n.max_km), 8: div("CAST(tx_count_24h AS DOUBLE)", n.max_tx_count_24h), 13: div("merchant_avg", n.max_merchant_avg_amount),
    }
    return [f"{f[i]} AS f{i}" for i in D]


def _fast(has_last: str = "last_ts IS NOT NULL") -> list[str]:
    inv = lambda name: _number(Limits().inverse(name))
    mul = lambda x, name: _clamp(f"(({x}) * {inv(name)})")
    whole = lambda x, name: _clamp(f"CAST(CAST({x} AS FLOAT) * CAST({inv(name)} AS FLOAT) AS DOUBLE)")
    f = SHARED | {
        0: mul("amount", "max_amount"), 1: whole("installments", "max_installments"),
        2: _clamp(f"(CASE WHEN customer_avg > 0 THEN (amount / customer_avg) * {inv('amount_vs_avg_ratio')} ELSE 0e0 END)"),
        5: f"CASE WHEN NOT ({has_last}) THEN CAST(-1 AS FLOAT) WHEN last_ts IS NULL THEN CAST(1 AS FLOAT) ELSE {mul(MINUTES, 'max_minutes')} END",
        6: f"CASE WHEN NOT ({has_last}) THEN CAST(-1 AS FLOAT) ELSE {mul('last_km', 'max_km')} END",
        7: mul("km_from_home", "max_km"), 8: whole("tx_count_24h", "max_tx_count_24h"), 13: mul("merchant_avg", "max_merchant_avg_amount"),
    }
    return [f"{f[i]} AS f{i}" for i in D]


def _quantized(f: str) -> str:
    return f"CAST(CASE WHEN isnan({f}) THEN 0 WHEN {f} <= -1 THEN -10000 WHEN {f} <= 0 THEN 0 WHEN {f} >= 1 THEN 10000 ELSE round_even(CAST({f} * CAST(10000 AS FLOAT) AS DOUBLE), 0) END AS INTEGER)"


PK = (
    "(v5 > 0)::INT + 2 * (v9 > 0)::INT + 4 * (v10 > 0)::INT + 8 * (v11 > 0)::INT"
    " + 16 * CASE WHEN v12 <= 2047 THEN 0 WHEN v12 <= 4095 THEN 1 WHEN v12 <= 6143 THEN 2 ELSE 3 END"
    " + 64 * (v2 > 4096)::INT + 128 * (v8 > 2048)::INT"
)


def dist(a: str, b: str) -> str:
    return _sum(f"(CAST({a}{i} AS BIGINT) - {b}{i}) * (CAST({a}{i} AS BIGINT) - {b}{i})" for i in D)


def dist_float(a: str, b: str) -> str:
    return _sum(f"(CAST({a}{i} AS DOUBLE) - CAST({b}{i} AS DOUBLE)) * (CAST({a}{i} AS DOUBLE) - CAST({b}{i} AS DOUBLE))" for i in D)


def dist_single(a: str, b: str) -> str:
    return _sum(f"({a}{i} - {b}{i}) * ({a}{i} - {b}{i})" for i in D)


def _but_itself(found: str) -> str:
    """Of the nearest, ranked, the first K that aren't the query itself."""
    return f"SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM {found} WHERE ref_id <> qid) WHERE rank <= {K}"


def _top(distance: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS rank FROM (SELECT qid, ref_id, fraud, {distance} AS dist FROM q, r WHERE ref_id <> qid)) WHERE rank <= {K}"


CTE: dict[str, str] = {
    "base": """SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "tx": f"""SELECT event_id AS tx_id, value * 20 AS amount, 1 + k % 12 AS installments,
        date_trunc('second', ts) AS requested_at,
        coalesce(CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER prior AS DOUBLE) / count(*) OVER prior / 5, 0e0) AS customer_avg,
        CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS tx_count_24h,
        coalesce(list('MERC-' || (k % 20)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS known_merchants,
        'MERC-' || (k % 20) AS merchant_id,
        [{", ".join(f"'{m}'" for m in MCCS)}][k % 12 + 1] AS mcc,
        CAST(k * 37 % 100 * 60 AS DOUBLE) AS merchant_avg,
        event_type IN ('click', 'view') AS is_online, event_type = 'purchase' AS card_present,
        CAST(event_id * 7919 % 1200 AS DOUBLE) AS km_from_home,
        date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS last_ts,
        CAST(event_id * 104729 % 1100 AS DOUBLE) AS last_km,
        CAST(event_type IN ('error', 'signup') AND value > 60 AS INTEGER) AS fraud
        FROM base WINDOW prior AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "feat": f"SELECT tx_id, fraud, {', '.join(_canonical())} FROM tx",
    "quant": "SELECT *, " + ", ".join(f"{_quantized(f'f{i}')} AS v{i}" for i in D) + " FROM feat",
    "vec": f"SELECT *, CAST({PK} AS INTEGER) AS pk FROM quant",
    "q": "SELECT tx_id AS qid, fraud AS label, pk AS qpk, " + ", ".join([*(f"f{i} AS g{i}" for i in D), *(f"v{i} AS q{i}" for i in D)]) + f" FROM vec WHERE {ASKED_IDS}",
    "r": "SELECT * RENAME (tx_id AS ref_id), count(*) OVER (PARTITION BY pk ORDER BY tx_id ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM vec",
    "stats": "SELECT CAST(x.range AS INTEGER) AS pk, count(ref_id) AS total, CAST(coalesce(sum(fraud), 0) AS BIGINT) AS frauds, "
    + ", ".join(f"coalesce(min(v{i}), 0) AS mn{i}, coalesce(max(v{i}), 0) AS mx{i}" for i in D)
    + " FROM range(256) x LEFT JOIN r ON r.pk = x.range GROUP BY ALL",
    "exact": _top(dist("q", "v")),
    "bounds": "SELECT qid, qpk, pk, " + _sum(f"CAST(greatest(mn{i} - q{i}, q{i} - mx{i}, 0) AS BIGINT) * greatest(mn{i} - q{i}, q{i} - mx{i}, 0)" for i in D) + " AS bound FROM q, stats WHERE pk <> qpk",
}
NEEDS = {"tx": ["base"], "feat": ["tx"], "quant": ["feat"], "vec": ["quant"], "q": ["vec"], "r": ["vec"], "stats": ["r"], "exact": ["q", "r"], "bounds": ["q", "stats"]}


def _with(body: str, *names: str, own: dict[str, str] | None = None) -> str:
    """body behind the shared expressions that `names` and their needs list, and its own ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in order] + [f"{n} AS MATERIALIZED ({s})" for n, s in (own or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _search(most: int | None, cap: int = 0, hard: bool = False, k: int = ASKED) -> dict[str, str]:
    """Own expressions up to `found` and `near`: search in the own partition and up to `most` others (None: none)."""
    limit = f" AND pos < {cap}" if cap else ""
    asked = f"SELECT q.* FROM q JOIN stats ON qpk = pk WHERE total <= {cap}" if hard else "SELECT * FROM q"
    own = {
        "asked": asked,
        "first": f"SELECT qid, 0 AS scan, pos, ref_id, fraud, {dist('q', 'v')} AS dist FROM asked JOIN r ON r.pk = qpk{limit}",
    }
    union = "SELECT * FROM first"
    if most is not None:
        own["kth"] = f"SELECT asked.qid, coalesce(max(dist) FILTER (n = {k}), 9223372036854775807) AS kth FROM asked LEFT JOIN (SELECT qid, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, pos) AS n FROM first) w ON w.qid = asked.qid GROUP BY asked.qid"
        own["probe"] = f"SELECT * FROM (SELECT b.qid, b.pk, row_number() OVER (PARTITION BY b.qid ORDER BY bound, b.pk) AS scan FROM bounds b JOIN kth ON kth.qid = b.qid AND bound < kth) WHERE scan <= {most}"
        union += f" UNION ALL SELECT asked.qid, scan, pos, ref_id, fraud, {dist('q', 'v')} FROM probe JOIN asked ON asked.qid = probe.qid JOIN r ON r.pk = probe.pk{limit}"
    own["found"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, scan, pos) AS rank FROM ({union})) WHERE rank <= {k}"
    own["near"] = _but_itself("found")
    return own


def _knn(most: int | None, cap: int = 0, hard: bool = False) -> str:
    return _with("SELECT qid, ref_id, fraud, dist, rank FROM near", "q", "r", "stats", "bounds", own=_search(most, cap, hard))


def _outcome(source: str, total: str = "count(f.qid)") -> str:
    return f"SELECT q.qid, CAST(coalesce(sum(f.fraud), 0) AS BIGINT) AS frauds, CAST({total} AS BIGINT) AS total FROM q LEFT JOIN {source} f ON f.qid = q.qid GROUP BY q.qid"


RATE = "CAST(CASE WHEN total = 0 THEN 0e0 ELSE CAST(frauds AS DOUBLE) / total END AS FLOAT)"
STRICT = f"SELECT *, {RATE} AS fraud_score, {RATE} < CAST(0.6 AS FLOAT) AS approved"
SNAP = f"CAST(least(greatest(round_even(CAST({RATE} * CAST({K} AS FLOAT) AS DOUBLE), 0), 0e0), {K}e0) / {K}e0 AS FLOAT)"
LIVE = f"SELECT *, {SNAP} AS fraud_score, {SNAP} <= CAST(0.6 AS FLOAT) AS approved"
#: The K nearest others of every transaction, as lists of the least rows.
ALL = {
    "a": "SELECT tx_id AS qid, fraud AS label, " + ", ".join(f"v{i} AS q{i}" for i in D) + " FROM vec",
    "listed": f"SELECT qid, min({{'d': {dist('q', 'v')}, 'r': ref_id, 'f': fraud}}, {K}) AS near FROM a, r WHERE ref_id <> qid GROUP BY qid",
    "counted": "SELECT a.qid, label, CAST(coalesce(list_sum(list_transform(near, lambda x: x.f)), 0) AS BIGINT) AS frauds, CAST(coalesce(len(near), 0) AS BIGINT) AS total FROM a LEFT JOIN listed ON listed.qid = a.qid",
}
PREDICTED = {"counted": _outcome("exact"), "decided": f"{STRICT} FROM counted", "predicted": "SELECT q.qid, label AS fraud, approved FROM q JOIN decided ON decided.qid = q.qid"}
DETECTION = "CASE WHEN failure_rate > 0.15 THEN -3000e0 ELSE 1000e0 * log10(1 / greatest(error_rate, 0.001e0)) - 300e0 * log10(1 + weighted_errors) END"
LATENCY = "CASE WHEN p99 <= 0 THEN 0e0 WHEN p99 > 2000 THEN -3000e0 ELSE 1000e0 * log10(1000e0 / greatest(p99, 1e0)) END"
COUNTS = "SELECT count(*) FILTER (NOT approved AND fraud = 1) AS tp, count(*) FILTER (approved AND fraud = 0) AS tn, count(*) FILTER (NOT approved AND fraud = 0) AS fp, count(*) FILTER (approved AND fraud = 1) AS fn, count(*) FILTER (approved IS NULL) AS err FROM predicted"


def _cells() -> dict[str, str]:
    """Own expressions c0 (the start), a1, c1, ...: assignments and centroids of each iteration."""
    own = {
        "ranked": "SELECT *, row_number() OVER (ORDER BY ref_id) - 1 AS place, count(*) OVER () AS many FROM r",
        "k0": f"SELECT CAST(j.range AS INTEGER) AS cell, {', '.join(f'CAST(v{i} AS DOUBLE) AS c{i}' for i in D)} FROM range({ivf.CELLS}) j JOIN ranked ON place = (j.range * many) // {ivf.CELLS}",
    }
    for n in range(1, ivf.ITERATIONS + 1):
        d = _sum(f"(v{i} - c{i}) * (v{i} - c{i})" for i in D)
        # the lowest cell at equal distance
        own[f"m{n}"] = f"SELECT ref_id, min({{'d': {d}, 'c': cell}}).c AS cell FROM r, k{n - 1} GROUP BY ref_id"
        own[f"a{n}"] = f"SELECT r.*, cell FROM r JOIN m{n} ON m{n}.ref_id = r.ref_id"
        own[f"k{n}"] = f"SELECT o.cell, {', '.join(f'coalesce(CAST(sum(v{i}) AS DOUBLE) / count(v{i}), any_value(c{i})) AS c{i}' for i in D)} FROM k{n - 1} o LEFT JOIN a{n} ON a{n}.cell = o.cell GROUP BY o.cell"
    # counted, not numbered: this DuckDB shifts row_number() - 1 where a filter on it is pushed down
    own["cells"] = f"SELECT * EXCLUDE (pos), count(*) OVER (PARTITION BY cell ORDER BY ref_id ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM a{ivf.ITERATIONS}"
    own["centroids"] = f"SELECT * FROM k{ivf.ITERATIONS}"
    return own


def _ivf_own(nprobe: int, cap: int) -> dict[str, str]:
    d = _sum(f"(CAST(g{i} AS DOUBLE) * 10000e0 - c{i}) * (CAST(g{i} AS DOUBLE) * 10000e0 - c{i})" for i in D)
    return _cells() | {
        "probed": f"SELECT * FROM (SELECT q.*, cell, row_number() OVER (PARTITION BY qid ORDER BY {d}, cell) AS scan FROM q, centroids) WHERE scan <= {nprobe}",
        "pairs": f"SELECT qid, scan, pos, ref_id, fraud, {dist('q', 'v')} AS dist FROM probed JOIN cells ON cells.cell = probed.cell" + (f" AND pos < {cap}" if cap else ""),
        "found": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, scan, pos) AS rank FROM pairs) WHERE rank <= {ASKED}",
        "near": _but_itself("found"),
    }


def _ivf(nprobe: int, cap: int) -> str:
    return _with("SELECT qid, ref_id, fraud, dist, rank FROM near", "q", "r", own=_ivf_own(nprobe, cap))


def _signature(p: str) -> str:
    bits = [f"CASE WHEN {_sum(f'CAST({p}{j} AS DOUBLE) * {_number(x)}' for j, x in enumerate(plane))} >= 0 THEN {1 << i} ELSE 0 END" for i, plane in enumerate(lsh.planes())]
    return f"CAST({_sum(bits)} AS BIGINT)"


def _lsh_own() -> dict[str, str]:
    return {
        "stored": f"SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ref_id) - 1 AS place FROM (SELECT *, {_signature('f')} AS sig FROM r)",
        "sizes": "SELECT sig, count(*) AS size FROM stored GROUP BY sig",
        "asked": f"SELECT q.*, p.range AS probe, xor({_signature('g')}, CASE WHEN p.range = 0 THEN 0 ELSE 1 << CAST(greatest(p.range - 1, 0) AS INTEGER) END) AS sig FROM q, range({lsh.PROBES + 1}) p",
        "counted": "SELECT asked.*, coalesce(sum(size) OVER (PARTITION BY qid ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM asked LEFT JOIN sizes ON sizes.sig = asked.sig",
        "pairs": f"SELECT qid, probe, place, ref_id, fraud, {dist_float('g', 'f')} AS dist, row_number() OVER (PARTITION BY qid ORDER BY probe, place) AS n FROM counted JOIN stored ON stored.sig = counted.sig WHERE before < {ASKED}",
        "found": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, probe, place) AS rank FROM pairs WHERE n <= {lsh.CANDIDATES}) WHERE rank <= {ASKED}",
        "near": _but_itself("found"),
    }


def _recall(own: dict[str, str], *names: str) -> str:
    return _with("SELECT count(*) AS wanted, count(f.ref_id) AS found, CAST(count(f.ref_id) AS DOUBLE) / count(*) AS recall FROM exact e LEFT JOIN near f ON f.qid = e.qid AND f.ref_id = e.ref_id", "exact", *names, own=own)


def _probe() -> dict[str, str]:
    """Own expressions: the first of the queries alone, and its search in all boxes."""
    first = CTE["q"] + " QUALIFY row_number() OVER (ORDER BY tx_id) = 1"
    return {"q": first, "bounds": CTE["bounds"]} | _search(255, k=K)


#: What the live rules read of the BODIES that they accept, by hand: flat columns as in `tx`, and whether there is a last transaction.
READ = {
    "valid": "41.12e0, 2, TIMESTAMP '2026-03-11 18:45:53', 82.24e0, 3, ['MERC-003', 'MERC-016'], 'MERC-016', '5411', 60.25e0, false, true, 29.2331036248e0, false, 0e0",
    "unknown_keys": "10e0, 1, TIMESTAMP '2026-03-11 18:45:53', 0e0, 0, NULL, 'MA', NULL, 1e0, false, false, 0e0, false, 0e0",
    "last_without_time": "10e0, 1, TIMESTAMP '2026-03-11 18:45:53', 0e0, 0, NULL, NULL, NULL, 0e0, false, false, 0e0, true, 5e0",
    "sections_twice": "20e0, 3, TIMESTAMP '2026-03-12 08:00:00', 0e0, 0, NULL, 'B', '5411', 0e0, false, false, 0e0, false, 0e0",
}
STATUS = {"no_time": "open", "broken": "open", "empty": "open", "wrong_type": "error"}


def _bodies() -> str:
    names = list(BODIES)
    assert set(names) == set(READ) | set(STATUS)
    every = _values([f"(CAST({i} AS BIGINT), '{n}', '{STATUS.get(n, 'ok')}')" for i, n in enumerate(names)], "qid, name, status")
    columns = "name, amount, installments, requested_at, customer_avg, tx_count_24h, known_merchants, merchant_id, mcc, merchant_avg, is_online, card_present, km_from_home, has_last, last_km"
    read = f"SELECT *, CAST(NULL AS TIMESTAMP) AS last_ts FROM {_values([f'({n!r}, {x})' for n, x in READ.items()], columns)}"
    f = ", ".join(_fast("has_last"))
    g = ", ".join(f"f{i} AS g{i}" for i in D)
    answer = """CASE WHEN status = 'open' THEN '{"approved":true,"fraud_score":0.0}' END AS body"""
    return f"WITH read AS ({read}), feat AS (SELECT name, {f} FROM read) SELECT qid, every.name, status, {answer}, {g} FROM (SELECT * FROM {every}) every LEFT JOIN feat ON feat.name = every.name"


def _values(rows, columns: str) -> str:
    return f"(VALUES {', '.join(rows)}) AS t({columns})"


#: What the two timestamp rules make of STAMPS, by hand: the fixed positions, and the offset turned to UTC.
LIVE_STAMPS = ["2026-03-11 18:45:53"] * 4 + [None] * 4
DTO_STAMPS = ["2026-03-11 18:45:53", "2026-03-11 18:45:53.999", "2026-03-11 21:45:53", "2026-03-11 18:45:53"] + [None] * 4


def _stamped(parsed: list[str | None]) -> str:
    assert len(parsed) == len(STAMPS)
    rows = [f"({i}, {f'TIMESTAMP {x!r}' if x else 'CAST(NULL AS TIMESTAMP)'})" for i, x in enumerate(parsed)]
    return f"SELECT * FROM {_values(rows, 'id, parsed')}"


#: What the configuration files of the queries say, by hand: limits in the order of this list, and risks; None: the defaults.
LIMIT_NAMES = ["max_amount", "max_installments", "amount_vs_avg_ratio", "max_minutes", "max_km", "max_tx_count_24h", "max_merchant_avg_amount"]
USUAL = [10000, 12, 10, 1440, 1000, 20, 10000]
SAID_LIMITS = {"whole": [500, 6, 4, 60, 20.5, 3, 70], "part": [500, 0, 0, 0, 0, 0, 0], "broken": USUAL, "wrong": USUAL, "missing": USUAL}
SAID_RISKS = {"given": {"5411": 0.25, "0000": 1.0}, "empty": MCC_RISK, "broken": MCC_RISK, "missing": MCC_RISK}


def sql() -> dict[str, str]:
    """The statement for each query that SQL can express."""
    f, v = ", ".join(f"f{i}" for i in D), ", ".join(f"v{i}" for i in D)
    outcomes = _values([f"(CAST({i} AS BIGINT), CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for i, (a, b) in enumerate(OUTCOMES)], "qid, frauds, total")
    edges = _values([f"({i}, CAST({repr(x) if x == x else repr('NaN')} AS FLOAT))" for i, x in enumerate(EDGES)], "id, x")
    fast = f"SELECT tx_id, fraud, {', '.join(_fast())} FROM tx"
    fast_vec = {"fast": fast, "fast_quant": "SELECT *, " + ", ".join(f"{_quantized(f'f{i}')} AS v{i}" for i in D) + " FROM fast"}
    fast_key = fast_vec | {"asked": f"SELECT tx_id AS qid, CAST({PK} AS INTEGER) AS qpk FROM fast_quant WHERE {ASKED_IDS}"}
    fast_q = fast_vec | {"q": f"SELECT tx_id AS qid, CAST({PK} AS INTEGER) AS qpk, {', '.join(f'v{i} AS q{i}' for i in D)} FROM fast_quant WHERE {ASKED_IDS}"}
    answered = "SELECT *, '{\"approved\":' || approved || ',\"fraud_score\":' || fraud_score || '}' AS body"
    detection = "SELECT *, CASE WHEN n = 0 THEN 0e0 ELSE weighted_errors / n END AS error_rate, CASE WHEN n = 0 THEN 0e0 ELSE (fp + fn + err) / n END AS failure_rate FROM (SELECT *, tp + tn + fp + fn + err AS n, fp + 3 * fn + 5 * err AS weighted_errors FROM counts)"
    embedding = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))"
    return {
        "vectorize": _with(f"SELECT tx_id, {f} FROM feat", "feat"),
        "vectorize_fast": _with(f"SELECT tx_id, {f} FROM fast", "tx", own={"fast": fast}),
        "quantized": _with(f"SELECT tx_id, {v} FROM quant", "quant"),
        "quantize_edges": f"SELECT id, {_quantized('x')} AS v FROM {edges}",
        "partition_key": _with("SELECT tx_id, pk FROM vec", "vec"),
        "partition_stats": _with("SELECT pk, total, frauds FROM stats", "stats"),
        "partition_boxes": _with("SELECT * EXCLUDE (total, frauds) FROM stats", "stats"),
        "partition_index": _with("SELECT ref_id, fraud, pk, pos FROM r", "r"),
        "lower_bound_topm": _with("SELECT * FROM (SELECT qid, pk, bound, CAST(row_number() OVER (PARTITION BY qid ORDER BY bound, pk) AS INTEGER) AS scan_rank FROM bounds) WHERE scan_rank <= 4", "bounds"),
        "knn_exact": _with("SELECT qid, ref_id, fraud, dist, rank FROM exact", "exact"),
        "knn_exact_float": _with(f"SELECT qid, ref_id, fraud, round(dist, 6) AS dist, rank FROM ({_top(dist_float('g', 'f'))})", "q", "r"),
        "knn_exact_float32": _with(_top(dist_single("g", "f")), "q", "r"),
        "score_exact": _with(f"{STRICT} FROM counted", "exact", own={"counted": _outcome("exact")}),
        "score_all": _with(f"SELECT * EXCLUDE (label) FROM ({STRICT} FROM counted)", "r", own=ALL),
        "confusion_all": _with(COUNTS, "r", own=ALL | {"predicted": f"SELECT qid, label AS fraud, approved FROM ({STRICT} FROM counted)"}),
        "knn_partition_primary": _knn(None),
        "knn_partition_m2": _knn(2),
        "knn_partition_all": _knn(255),
        "knn_partition_cap64": _knn(2, 64),
        "knn_partition_hard64": _knn(2, 64, True),
        "outcome_hard64": _with(_outcome("near"), "q", "r", "stats", "bounds", own=_search(2, 64, True)),
        "outcome_total_k": _with(_outcome("near", str(K)), "q", "r", "stats", "bounds", own=_search(2)),
        "nn1_partition": _with(f"SELECT qid, ref_id, fraud, dist FROM (SELECT qid, ref_id, fraud, {dist('q', 'v')} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {dist('q', 'v')}, pos) AS n FROM q JOIN r ON r.pk = qpk AND ref_id <> qid) WHERE n = 1", "q", "r"),
        "partition_only_score": _with(f"{STRICT} FROM (SELECT qid, frauds, total FROM q JOIN stats ON pk = qpk)", "q", "stats"),
        "ivf_centroids": _with("SELECT * FROM centroids", "r", own=_cells()),
        "ivf_cells": _with("SELECT ref_id, cell, pos FROM cells", "r", own=_cells()),
        "ivf_offsets": _with(f"SELECT CAST(j.range AS INTEGER) AS cell, CAST(coalesce(sum(count(ref_id)) OVER (ORDER BY j.range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, count(ref_id) AS length FROM range({ivf.CELLS}) j LEFT JOIN cells ON cell = j.range GROUP BY j.range", "r", own=_cells()),
        "ivf_search_np1_cap64": _ivf(1, 64),
        "ivf_search_np4": _ivf(4, 0),
        "ivf_index_search": _ivf(1, 64),
        "lsh_signatures": _with(f"SELECT tx_id, {_signature('f')} AS sig FROM vec", "vec"),
        "lsh_buckets": _with(f"SELECT sig, row_number() OVER (PARTITION BY sig ORDER BY ref_id) - 1 AS pos, ref_id FROM (SELECT ref_id, {_signature('f')} AS sig FROM r)", "r"),
        "lsh_search": _with("SELECT qid, ref_id, fraud, round(dist, 6) AS dist, rank FROM near", "q", "r", own=_lsh_own()),
        "mcc_lookup": _with(f"SELECT tx_id, mcc, {SHARED[12]} AS risk FROM tx", "tx"),
        "known_merchant": _with("SELECT tx_id, list_contains(known_merchants, merchant_id) AS known FROM tx", "tx"),
        "parse_ts_live": _stamped(LIVE_STAMPS),
        "parse_ts_dto": _stamped(DTO_STAMPS),
        "score_json": _with(f"{answered} FROM ({LIVE} FROM (SELECT qid, frauds, total FROM asked JOIN stats ON pk = qpk))", "tx", "stats", own=fast_key),
        "decision_strict": f"{STRICT} FROM {outcomes}",
        "decision_live": f"{LIVE} FROM {outcomes}",
        "prediction_matches": _with("SELECT qid, fraud, approved, (fraud = 0) = approved AS as_expected FROM predicted", "q", "exact", own=PREDICTED),
        "confusion": _with(COUNTS, "q", "exact", own=PREDICTED),
        "detection_score": _with(
            "SELECT tp, tn, fp, fn, err, n, weighted_errors, round(error_rate, 6) AS error_rate, round(failure_rate, 6) AS failure_rate, round(" + DETECTION + ", 6) AS detection_score FROM scored",
            "q", "exact", own=PREDICTED | {"counts": COUNTS, "scored": detection},
        ),
        "latency_score": "SELECT round(p99, 6) AS p99, round(" + LATENCY + ", 6) AS score FROM (SELECT quantile_cont(value, 0.99) AS p99 FROM events)",
        "recall_at_5": _recall(_search(None), "stats"),
        "recall_ivf": _recall(_ivf_own(1, 64)),
        "recall_ivf_np4": _recall(_ivf_own(4, 0)),
        "recall_lsh": _recall(_lsh_own()),
        "decision_probe": f"SELECT *, CAST(CASE WHEN total = 0 THEN 'NaN'::DOUBLE ELSE CAST(frauds AS DOUBLE) / total END AS FLOAT) AS fraud_score FROM {outcomes}",
        "score_json_bad": _bodies(),
        "stream_score": _with(f"{answered} FROM ({LIVE} FROM ({_outcome('near')}))", "tx", "r", "stats", own=fast_q | _search(None)),
        "evaluation_report": _with(
            f"SELECT to_json({{'expected': 'events', 'p99': round(p99, 6), 'scoring': {{'tp': tp, 'tn': tn, 'fp': fp, 'fn': fn, 'err': err, 'weighted_errors': weighted_errors, 'failure_rate': round(failure_rate, 6), 'p99_score': round(p99_score, 6), 'detection_score': round(detection_score, 6), 'final_score': round(p99_score + detection_score, 6)}}}})::VARCHAR AS report FROM (SELECT *, {DETECTION} AS detection_score, {LATENCY} AS p99_score FROM scored, (SELECT quantile_cont(value, 0.99) AS p99 FROM events))",
            "q", "exact", own=PREDICTED | {"counts": COUNTS, "scored": detection},
        ),
        "vectorize_limits": _with(f"SELECT tx_id, {', '.join(_canonical(OTHER_LIMITS, OTHER_RISKS))} FROM tx", "tx"),
        "config_limits": f"SELECT * FROM {_values([f'({x!r}, {n!r}, {_number(v)})' for x, all_ in SAID_LIMITS.items() for n, v in zip(LIMIT_NAMES, all_, strict=True)], 'file, name, value')}",
        "config_risks": f"SELECT * FROM {_values([f'({x!r}, {m!r}, {_number(v)})' for x, all_ in SAID_RISKS.items() for m, v in all_.items()], 'file, mcc, risk')}",
        "vectorize_dto": _with(f"SELECT tx_id, {f} FROM feat", "feat"),
        "references_json": _with(f"SELECT {f}, fraud FROM feat WHERE tx_id % 7 <> 0", "feat"),
        "references_stored": _with(f"SELECT {v}, fraud FROM quant WHERE tx_id % 7 <> 0", "quant"),
        "load_test_entries": _with(
            "SELECT 'tx-' || tx_id AS id, fraud = 0 AS expected_approved, amount, strftime(requested_at, '%Y-%m-%dT%H:%M:%SZ') AS requested_at, tx_count_24h, mcc, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS last_at FROM tx", "tx"
        ),
        "probe_index": _with(f"SELECT CAST({RATE} AS FLOAT) AS fraud_score, rank, ref_id, fraud, dist FROM (SELECT *, sum(fraud) OVER () AS frauds, count(*) OVER () AS total FROM found)", "r", "stats", own=_probe()),
        "probe_references": _with(
            f"SELECT CAST({RATE} AS FLOAT) AS fraud_score, rank, fraud, dist FROM (SELECT *, sum(fraud) OVER () AS frauds, count(*) OVER () AS total FROM (SELECT fraud, {dist_single('g', 'f')} AS dist, row_number() OVER (ORDER BY dist, ref_id) AS rank FROM q, r WHERE ref_id % 7 <> 0) WHERE rank <= {K})",
            "r", own={"q": _probe()["q"]},
        ),
        "label_counts": _with("SELECT fraud, count(*) AS n FROM tx GROUP BY fraud", "tx"),
        "embedding_knn_64d": f"SELECT qid, vec_id, label, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id, b.label, {embedding} AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= {K}",
    }
