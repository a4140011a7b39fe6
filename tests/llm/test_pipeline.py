import random

import pytest

import corpus_pipeline
from driftmark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = {"en": "the river mill child evening long road stone house green".split(), "fr": "le moulin rivière enfant soir très pierre maison forêt où".split()}
    rows, labels = [], []
    for i in range(400):
        lang = ("en", "fr")[i % 5 == 0]
        words = rng.choices(vocabulary[lang], k=rng.randint(40, 90)) + [f"u{i}"]
        good = i % 4 != 1
        text = " ".join(words) if good else " ".join(w.upper() + "!!! $$$" for w in words)
        rows.append([i, text, lang, f"src{i % 3 and 1}", len(text)])
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [[400 + i, rows[2][1], "en", "src0", 0] for i in range(60)]  # copies
    rows += [[460, None, "en", None, 0], [461, "", None, "src0", 0], [462, "12345 678", "en", "src0", 0]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "mixing", "packing"]
    quality, language, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, folder)
    assert kept.columns == columns
    clean = {i for i in range(400) if i % 4 != 1}
    assert clean <= set(ids(kept)) and not {i for i in range(400) if i % 4 == 1} & set(ids(kept))
    known = language(spark, docs, folder)
    assert known.columns == columns and clean <= set(ids(known)) and not {460, 461, 462} & set(ids(known))
    single = near(spark, docs, folder)
    assert single.columns == columns and {2, *(clean - {2})} <= set(ids(single)) and not set(range(400, 460)) & set(ids(single))
    mixture = mix(spark, docs, folder)
    assert mixture.columns == columns and set(ids(mixture)) == set(ids(docs)) and mixture.count() > docs.count()
    packed = pack(spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(ids(docs))


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {i for i in range(400) if i % 4 != 1}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["op1_quality", "op8_mixing", "op9_language"])
def test_queries(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(range(463))
    if name == "op1_quality":
        assert {(r["score"] >= 0.5) == bool(r["predicted"]) for r in rows} == {True} and {r["held_out"] for r in rows} == {True, False}
