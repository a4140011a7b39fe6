import math
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftmark.llm import mixing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_weights(tokens, exponent):
    raw = {s: n**exponent for s, n in tokens.items() if n}
    return {s: v / sum(raw.values()) for s, v in raw.items()}


def plain_entropy(weights):
    return -sum(v * math.log(v) for v in weights.values())


def plain_exponent(tokens, limit, target=None):
    """By halving, one exponent at a time, on the definitions: reads of a source where the one read least is read once."""

    def reads(e):
        w = plain_weights(tokens, e)
        each = {s: v / tokens[s] for s, v in w.items()}
        return {s: v / min(each.values()) for s, v in each.items()}

    def least(holds):
        if holds(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(55):
            middle = (low + high) / 2
            low, high = (low, middle) if holds(middle) else (middle, high)
        return high

    found = [0.0]
    if limit is not None:
        found.append(least(lambda e: max(reads(e).values()) <= limit))
    if target is not None:
        found.append(least(lambda e: plain_entropy(plain_weights(tokens, e)) <= target))
    return max(found), reads(max(found))


def test_bisection_finds_the_border():
    for border in (0.0, 1e-9, 0.1, 0.3333, 0.5, 0.97, 1.0):
        assert abs(mixing.bisect(lambda es, x=border: [e >= x for e in es]) - border) < 1e-15


@pytest.mark.parametrize(("limit", "target"), [(1.5, None), (3.0, None), (None, 0.9), (None, 9.9), (2.0, 0.2), (1.0, None)])
def test_exponent_equals_plain_halving(spark, limit, target):
    tokens = {"a": 1000, "b": 100, "c": 10, "none": 0, "d": 333}
    rows = spark.createDataFrame([(s, n, 1000.0) for s, n in tokens.items()], "__dm_source string, __dm_total long, __dm_top double")
    entropies = mixing._entropies(rows)
    for e in (0.0, 0.3, 1.0):
        assert abs(entropies([e])[0] - plain_entropy(plain_weights(tokens, e))) < 1e-9
    got = mixing.solve(10 / 1000, limit, target, entropies)
    assert abs(got - plain_exponent(tokens, limit, target)[0]) < 1e-9


def test_limits_under_one_are_refused():
    with pytest.raises(ValueError):
        mixing.solve(0.5, 0.9, None, lambda es: [0.0] * len(es))


@pytest.mark.parametrize(("limit", "target"), [(2.0, None), (None, 1.2)])
def test_mix_equals_a_plain_mixture(spark, make_docs, limit, target):
    texts = ["wort naïve, " * (1 + i % 13) for i in range(300)] + [None, ""]
    sources = ["big" if i % 3 else "mid" if i % 2 else "small" if i % 30 else None for i in range(300)] + ["none", "none"]
    docs = make_docs(texts, sources=sources)
    library = Tokenizer.from_file(PATH)
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    tokens = defaultdict(int)
    for n, s in zip(counts, sources, strict=True):
        tokens[s] += n
    exponent, reads = plain_exponent(tokens, limit, target)
    weights = plain_weights(tokens, exponent)
    rows = mixing.mix(docs, PATH, limit, target, blocks=7).collect()
    block = {r["id"]: r["b"] for r in spark.range(302).select("id", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(7)).alias("b")).collect()}
    held = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert r["n_tokens"] == counts[r["doc_id"]] and sources[r["doc_id"]] == r["source"]
        assert math.isclose(r["weight"], weights.get(r["source"], 0.0), rel_tol=1e-6) and math.isclose(r["repetition"], reads.get(r["source"], 1.0), rel_tol=1e-6)
        held[r["source"]][r["epoch"]].append((r["position"], r["n_tokens"], r["doc_id"]))
    assert held.keys() == set(sources)
    for s, passes in held.items():
        own = {i for i, x in enumerate(sources) if x == s}
        budget = round(tokens[s] * reads.get(s, 1.0))
        if not tokens[s]:
            assert set(passes) == {0} and {d for *_, d in passes[0]} == own
            continue
        at, orders = 0, []
        assert sorted(passes) == list(range(math.ceil(budget / tokens[s])))
        for epoch in sorted(passes):
            read = sorted(passes[epoch])
            orders.append([d for *_, d in read])
            assert len(set(orders[-1])) == len(read)
            for position, n, _ in read:  # one after the other, pass after pass
                assert position == at
                at += n
            if epoch < max(passes):
                assert set(orders[-1]) == own  # a whole pass
            blocks = [block[d] for d in orders[-1]]
            assert sum(a != b for a, b in zip(blocks, blocks[1:], strict=False)) + 1 == len(set(blocks))  # block by block
        assert budget <= at < budget + max(counts)
        if len(orders) > 2 and len(own) > 20:
            assert orders[0] != orders[1]  # a permutation of its own for each pass
            assert [block[d] for d in orders[0]] != [block[d] for d in orders[1]]
    again = {tuple(r) for r in mixing.mix(docs.repartition(7), PATH, limit, target, blocks=7).collect()}
    assert again == {tuple(r) for r in rows}


def test_nothing_to_mix(spark, make_docs):
    assert mixing.mix(make_docs([]), PATH).count() == 0
    assert mixing.mix(make_docs([], sources=[]), PATH, None, 0.5).count() == 0
    rows = mixing.mix(make_docs([None, "", None], sources=["a", None, "a"], ids=[1, 2, 2]), PATH).collect()
    assert sorted((r["doc_id"], r["source"] or "", r["epoch"], r["position"], r["weight"]) for r in rows) == [(1, "a", 0, 0, 0.0), (2, "", 0, 0, 0.0), (2, "a", 0, 0, 0.0)]


def test_repeated_rows_and_long_texts(spark, make_docs):
    docs = make_docs(["x y z"] * 40 + ["word " * 30_000], sources=["s"] * 41, ids=[5] * 40 + [6])
    rows = mixing.mix(docs, PATH).collect()
    assert sorted(r["doc_id"] for r in rows) == [5] * 40 + [6] and {r["epoch"] for r in rows} == {0}
    assert max(r["n_tokens"] for r in rows) >= 30_000


def test_mixed_rows(spark, make_docs):
    texts = [f"text number {i}" for i in range(200)]
    docs = make_docs([*texts, "x"], sources=["big" if i % 4 else "small" for i in range(200)] + ["big"], ids=[*range(200), None])
    out = mixing.mixed(docs, PATH, limit=1.5)
    rows = out.collect()
    assert out.columns == docs.columns and {r["doc_id"] for r in rows} == {*range(200), None}
    counts = defaultdict(int)
    for r in rows:
        counts[r["doc_id"]] += 1
    assert all(counts[i] == 1 for i in range(200) if i % 4) and counts[None] == 1
    assert math.isclose(sum(counts[i] for i in range(0, 200, 4)), 75, abs_tol=2)
