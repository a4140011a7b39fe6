import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftmark.llm import language, quality

GOOD = "The river ran past the old mill and the children played there until the evening came ."
BAD = "BUY!!! NOW!!! $$$ CLICK!!! HERE!!! $$$ FREE!!! WIN!!!"


def _texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices((GOOD if i % 3 else BAD).split(), k=rng.randint(5, 80))) for i in range(n)]


def test_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.Trees.fit(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95


def test_flattened_walk_equals_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    trees = quality.Trees.fit(x, (x[:, 1] > 0).astype(float), trees=10, depth=3)
    for row, got in zip(x[:50], trees.score(x[:50]), strict=True):
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.cut[t, node])
            total += trees.value[t, node]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-9


def test_trees_without_rows_and_of_one_class():
    assert (quality.Trees.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))) == 0.5).all()
    assert (quality.Trees.fit(np.ones((9, 3)), np.ones(9)).score(np.ones((2, 3))) > 0.9).all()


def test_quality_in_spark(spark, make_docs, odd_texts):
    texts = _texts(300)
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    trees = quality.fit(docs, labels, F.lit(True))
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, trees, ["doc_id"]).collect()}
    assert np.mean([(rows[i] >= 0.5) == bool(i % 3) for i in range(200, 300)]) == 1
    kept = quality.accepted(docs, trees)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if rows[i] >= 0.5}
    odd = quality.score(make_docs(odd_texts), trees, ["doc_id"]).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in odd)
    nothing = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(docs, nothing, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), trees, ["doc_id"]).count() == 0


WORDS = {"aa": "lorem ipsum dolor sit amet", "bb": "kwik zwart quiz jong vex", "cc": "ñandú óleo ígneo úlcera"}


def _tongues(n, seed=1):
    rng = random.Random(seed)
    langs = [sorted(WORDS)[i % 3] for i in range(n)]
    return [" ".join(rng.choices(WORDS[x].split(), k=rng.randint(3, 40))) for x in langs], langs


def plain_grams(text):
    """The 3- and 4-grams of a text, as strings."""
    line = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text.lower()} ")
    line = " " + "".join(c for i, c in enumerate(line) if c != " " or i and line[i - 1] != " ").strip() + " "
    return [line[i : i + n] for n in (3, 4) for i in range(len(line) - n + 1)]


def plain_members(texts, langs):
    """Language -> its grams, by the rule on exact counts."""
    counts = {x: Counter() for x in langs}
    for t, x in zip(texts, langs, strict=True):
        counts[x].update(plain_grams(t))
    total = {(x, n): sum(v for g, v in c.items() if len(g) == n) for x, c in counts.items() for n in (3, 4)}
    out = {x: set() for x in counts}
    for g in set().union(*counts.values()):
        share = {x: counts[x][g] / total[x, len(g)] for x in counts if counts[x][g]}
        often = max(counts[x][g] for x in share)
        out_of = [x for x in share if share[x] >= language.LEAST_PART * max(share.values()) and counts[x][g] >= min(2, often)]
        for x in out_of:
            out[x].add(g)
    return out


def test_filters_against_exact_sets(spark, make_docs):
    """What is learnt, and what texts are given, equal exact gram sets up to the filters' false positives."""
    rng = random.Random(3)
    texts, langs = _tongues(240)
    for i in range(0, 240, 3):  # shared words, rare words, words of another language
        texts[i] += " " + rng.choice(["gemeinsam", "river", "quiz jong", "x" + str(i), "óleo vex"]) + "\u0301 it's 42,7"
    docs = make_docs(texts, langs=langs)
    wanted = plain_members(texts, langs)
    held = Counter(r["lang"] for r in language.members(docs.select("lang", "text")).collect())
    assert held == {x: len(g) for x, g in wanted.items()}
    filters = language.fit(docs, F.lit(True))
    unseen, _ = _tongues(60, seed=9)
    told = filters.shares([*texts, *unseen, "etwas ganz anderes", "x", "42", None])
    for t, row in zip([*texts, *unseen, "etwas ganz anderes", "x"], told, strict=False):
        own = plain_grams(t)
        for x, got in zip(filters.languages, row, strict=True):
            exact = sum(g in wanted[x] for g in own) / len(own)
            assert abs(got - exact) <= 0.03 + 2 / len(own) * (exact < 1 and len(own) < 40)
    assert (told[-2:] == -1).all() and (filters.false < 0.05).all()


def test_marks_and_digits_are_no_letters(spark, make_docs):
    texts, langs = _tongues(60)
    filters = language.fit(make_docs(texts, langs=langs), F.lit(True))
    none = ["\u0301", "\u0301\u0308 12", "٣٤", "!?", " ", "", None, "\u20dd", "①②", "😀"]
    some = ["é", "e\u0301", "ª", "日", "x"]
    assert [filters.predict([t])[0][0] for t in none] == ["und"] * len(none)
    assert all(name != "und" for name in filters.predict(some)[0])


def test_tables_grow_with_the_grams(spark, make_docs):
    rng = random.Random(7)
    texts = ["".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(300)) for _ in range(120)]
    few = language.fit(make_docs(texts[:4], langs=["zh"] * 4), F.lit(True))
    many = language.fit(make_docs(texts, langs=["zh"] * 120), F.lit(True))
    assert many.bits > few.bits >= language.LEAST_BITS and many.false[0] < 0.05


def test_whole_texts_are_learnt_from(spark, make_docs):
    """Words far behind a long common beginning count."""
    head = "lorem ipsum dolor " * 9_000
    docs = make_docs([head + "zwart quiz jong " * 500, head + "ñandú óleo ígneo " * 500], langs=["bb", "cc"])
    filters = language.fit(docs, F.lit(True))
    assert filters.predict(["zwart jong", "óleo ígneo"])[0] == ["bb", "cc"]


def test_repeated_ids_of_a_language(spark, make_docs):
    """Thousands of rows of one id, or of none, stand for one row, and push nothing out."""
    texts, langs = _tongues(90)
    ids = [*range(90), *[0] * 1500, *[None] * 1500]
    docs = make_docs([*texts, *[texts[0]] * 1500, *[texts[1]] * 1500], langs=[*langs, *[langs[0]] * 1500, *[langs[1]] * 1500], ids=ids)
    sample, rows = language.sampled(docs, F.lit(True), 40)
    assert rows[langs[0]] == 1530 and {r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()} <= set(range(20, 41))
    told = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs, F.lit(True), 40), ["doc_id"]).collect() if r["doc_id"] is not None}
    assert [told[i] for i in range(90)] == langs


def test_chunks_don_t_change_predictions(spark, make_docs):
    texts, langs = _tongues(60)
    filters = language.fit(make_docs(texts, langs=langs), F.lit(True))
    one = filters.predict(texts)
    before, language.CHUNK = language.CHUNK, 50
    try:
        two = filters.predict(texts)
    finally:
        language.CHUNK = before
    assert one[0] == two[0] and np.allclose(one[1], two[1])


def test_language_in_spark(spark, make_docs, odd_texts):
    texts, langs = _tongues(200)
    langs[:6] = [None] * 6
    docs = make_docs(texts, langs=langs)
    filters = language.fit(docs, F.col("doc_id") < 150, per_language=30)
    rows = {r["doc_id"]: r for r in language.predict(docs, filters, ["doc_id"]).collect()}
    assert all(rows[i]["lang_pred"] == sorted(WORDS)[i % 3] for i in range(200))
    odd = {r["doc_id"]: r for r in language.predict(make_docs(odd_texts), filters, ["doc_id"]).collect()}
    for i, t in enumerate(odd_texts):
        assert (odd[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= odd[i]["score"] <= 1
    kept = language.identified(make_docs([*texts, None, "!!!"], langs=[*langs, "aa", "aa"]), filters)
    assert kept.columns == docs.columns and kept.count() == 200
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.limit(0), filters, ["doc_id"]).count() == 0


def test_more_languages_than_bits(spark, make_docs):
    rng = random.Random(5)
    words = {f"l{i:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4)] for i in range(150)}
    langs = [x for x in words for _ in range(4)]
    docs = make_docs([" ".join(rng.choices(words[x], k=12)) for x in langs], langs=langs)
    filters = language.fit(docs, F.col("doc_id") % 4 > 0)
    assert filters.languages == sorted(words)
    told = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, filters, ["doc_id"]).collect()}
    assert [told[i] for i in range(len(langs))] == langs


def test_a_repeated_id_doesn_t_push_out_the_other_label(spark, make_docs):
    ids = [*range(60), *[0] * 400]  # document 0, of label 0, again and again
    texts = _texts(60)
    docs = make_docs([texts[i] for i in ids], ids=ids)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels, F.lit(True), most_rows=60), ["doc_id"]).collect()}
    assert all((rows[i] >= 0.5) == bool(i % 3) for i in range(60))
