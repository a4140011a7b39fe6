"""The registered queries on small tables with odd rows, against plain versions and against their SQL."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_classifiers import plain_members
from test_duplicates import brute_groups, corpus, shingle_set
from test_html_classes import Explicit, _deduced, _host
from test_mixing import plain_exponent, plain_weights
from tokenizers import Tokenizer

import corpus_pipeline
from driftmark.llm import language, quality
from driftmark.llm.oracles import ORACLES
from driftmark.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, source_id string"
WORDS = {"en": "the river mill child evening long road stone house green".split(), "fr": "le moulin rivière enfant soir très pierre maison forêt où".split(), "de": "der fluß mühle kind abend straße stein haus wald größe".split()}
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents, labels, vectors, pages): near copies, three languages, good and bad texts, odd rows."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(420):
        lang = ("en", "en", "fr", "en", "de")[i % 5]
        words = rng.choices(WORDS[lang], k=rng.randint(30, 120)) + [f"u{i}"]
        good = i % 4 != 1
        text = " ".join(words) if good else " ".join(w.upper() + "!!! $$$" for w in words)
        rows.append((i, text, lang if i % 17 else None, f"src{rng.choice([0, 0, 0, 0, 1, 1, 2])}", len(text), 0.5, "x"))
        if i % 2 or i < 60:
            labels.append((i, int(good), 0))
    rows += [(500 + i, t, "en", "src0", 0, None, None) for i, t in enumerate(corpus(bases=4, copies=8))]
    odd = [None, "", " \n\t", "word", "word", "Two words", "two  WORDS", "日本語のテキスト", "́ 12", "x" * 5000, "long words " * 9000, "<|endoftext|> it's"]
    rows += [(600 + i, t, None if i % 2 else "en", None if i % 3 else "src1", 0, 0.1, "y") for i, t in enumerate(odd)]
    labels += [(3, None, 0), (None, 1, 0), (5, 0, 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = np.random.default_rng(3).normal(size=(60, 12))
    vectors = [[float(np.float32(x)) for x in v] for v in np.concatenate([vectors, vectors[:20] + 0.02, vectors[:20] + 0.15, vectors[:9]])]
    vectors = list(enumerate([*vectors, None, [0.0] * 12, [float("nan")] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [None, 1.0]]))
    spark.createDataFrame([(i, v, i % 10) for i, v in vectors], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    hosts = {f"h{i}": _host(rng, n) for i, n in enumerate([1, 2, 5, 12])}
    pages = [(f"http://{h}.example/{i}", p) for h, all_ in hosts.items() for i, p in enumerate(all_)]
    pages = [(i, u, p) for i, (u, p) in enumerate(pages)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path, rows, labels, vectors, (hosts, pages)


@pytest.fixture(scope="module")
def run(spark, tables):
    held = {}

    def rows(name):
        if name not in held:
            held[name] = QUERIES[name](spark, tables[0]).collect()
        return held[name]

    return rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_their_sql(run, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    got = run(name)
    assert sorted(got[0].asDict()) == sorted(names)
    key = lambda row: [str(x) for x in row]
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(found.fetchall(), key=key)


def test_op5_equals_all_pairs(run, tables):
    sets = {r[0]: shingle_set(r[1], 2) for r in tables[1]}
    wanted = brute_groups(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run("op5_near_duplicates")} == {i: (len(s), wanted[i], wanted[i] == i) for i, s in sets.items()}


def plain_boosting(x, y, edges, trees, depth, rate, least, ridge):
    """Trees by the definitions: for each node every cut of every statistic, sums taken anew. Returns the margins."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        step = np.zeros(len(y))

        def grow(rows, level):
            best = (1e-6, None, None)
            if level < depth:
                for j, cuts in enumerate(edges):
                    for c in cuts:
                        left = rows[x[rows, j] <= c]
                        right = rows[x[rows, j] > c]
                        if len(left) >= least and len(right) >= least:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                            if gain > best[0] + 1e-9:
                                best = (gain, j, c)
            if best[1] is None:
                step[rows] = rate * g[rows].sum() / (h[rows].sum() + ridge)
                return
            inside = x[rows, best[1]] <= best[2]
            grow(rows[inside], level + 1)
            grow(rows[~inside], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + step
    return margin


def test_trees_equal_plain_boosting():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(160, 4)), 1)
    # soft labels: with 0 and 1 alone many cuts are equally good, and rounding would choose between them
    y = np.where(x[:, 0] + x[:, 1] > 0.3, 0.9, 0.1) + rng.uniform(-0.09, 0.09, 160)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower")) for j in range(4)]
    wanted = plain_boosting(x, y, edges, 6, 3, 0.2, 4, 1.0)
    got = quality.Trees.fit(x, y, trees=6, depth=3, rate=0.2, least=4, ridge=1.0).score(x)
    assert np.abs(got - 1 / (1 + np.exp(-wanted))).max() < 1e-6


def test_op1_scores(run, tables, spark, tmp_path):
    """Each score is the plain walk over the trees that the learnt labels give; held-out labels change nothing."""
    path, rows, labels, *_ = tables
    texts = {r[0]: r[1] for r in rows}
    known = defaultdict(list)
    for i, q, _ in labels:
        if i in texts and q is not None and fold(i, 3) != 1:
            known[i].append(q)
    order = sorted((min(q), i, [float(v) for v in quality.statistics(texts[i])]) for i, q in known.items())
    trees = quality.Trees.fit(np.array([s for *_, s in order]), np.array([q for q, *_ in order], float))
    got = {r["doc_id"]: r for r in run("op1_quality")}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        s, total = quality.statistics(t), trees.base
        for n in range(len(trees.feature)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + (s[trees.feature[n, node]] > trees.cut[n, node])
            total += trees.value[n, node]
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-total))) < 1e-6
        assert got[i]["held_out"] == (fold(i, 3) == 1) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    assert np.mean([got[i]["predicted"] == int(i % 4 != 1) for i in range(420) if fold(i, 3) == 1]) > 0.97
    spark.read.parquet(f"{path}/documents.parquet").selectExpr("doc_id", "text", "'zz' lang", "'zz' source").write.parquet(f"{tmp_path}/documents.parquet")
    changed = [(i, 1 - q if q is not None and fold(i, 3) == 1 else q, t) for i, q, t in labels]
    spark.createDataFrame(changed, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"]: r["score"] for r in QUERIES["op1_quality"](spark, str(tmp_path)).collect()} == {i: r["score"] for i, r in got.items()}


def test_op2_counts(run, tables):
    wanted = {r[0]: (len((r[1] or "").encode()), len(ids_of(r[1]))) for r in tables[1]}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run("op2_token_counts")} == {i: (b, n, n > 512) for i, (b, n) in wanted.items()}


def check_packed(rows, texts):
    """Every piece is there once, with its ids, in a place of its own; sequences are filled without gaps."""
    held = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for i, all_ in pieces.items():
        ids = np.array([*ids_of(texts[i][0]), 0], "<u4")
        per = len(all_) // texts[i][1]
        all_ = sorted(all_, key=lambda r: r["piece"])[:: texts[i][1]]
        assert [r["piece"] for r in all_] == list(range(per)) == list(range(-(-len(ids) // 2048)))
        assert [r["start"] for r in all_] == [0, *(range(len(ids) % 2048 or 2048, len(ids), 2048))][:per]
        for r in all_:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in all_) == len(ids)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(n for p in held.values() for _, n in p) // 2048)
    assert least <= len(held) <= least * 1.05 + 1


def test_op3_packing(run, tables):
    check_packed(run("op3_packing"), {r[0]: (r[1], 1) for r in tables[1]})


def test_op4_media(run, tables):
    for r in run("op4_media_tiff"):
        raw = next((t or "").encode() for i, t, *_ in tables[1] if i == r["doc_id"])
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    by = defaultdict(set)
    for r in run("op4_media_tiff"):
        by[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert {len(x) for x in by.values()} == {1}


def plain_mixture(rows, limit):
    """Source -> (tokens, budget) of documents (source, tokens)."""
    tokens = defaultdict(int)
    for s, n in rows:
        tokens[s] += n
    exponent, reads = plain_exponent(tokens, limit)
    return tokens, plain_weights(tokens, exponent), reads


def test_op8_mixing(run, tables):
    counts = {r[0]: (r[3], len(ids_of(r[1]))) for r in tables[1]}
    tokens, weights, reads = plain_mixture(counts.values(), 1.5)
    passes = defaultdict(list)
    for r in run("op8_mixing"):
        assert (r["source"], r["n_tokens"]) == counts[r["doc_id"]]
        assert math.isclose(r["weight"], weights[r["source"]], rel_tol=1e-6) and math.isclose(r["repetition"], reads[r["source"]], rel_tol=1e-6)
        passes[r["source"], r["epoch"]].append((r["position"], r["n_tokens"], r["doc_id"]))
    assert math.isclose(max(reads.values()), 1.5, rel_tol=1e-6)
    for s in tokens:
        at = 0
        for epoch in (0, 1):
            for position, n, _ in sorted(passes[s, epoch]):
                assert position == at
                at += n
            if epoch == 0:
                assert sorted(d for *_, d in passes[s, 0]) == sorted(i for i, (x, _) in counts.items() if x == s)
        budget = round(tokens[s] * reads[s])
        assert budget <= at < budget + max(n for x, n in counts.values() if x == s)


def test_op9_language(run, tables, spark, tmp_path):
    """Predictions equal those of exact gram sets wherever these are clear; held-out languages change nothing."""
    path, rows, *_ = tables
    learnt = [(r[1], r[2]) for r in rows if r[2] is not None and r[1] is not None and fold(r[0], 4) != 2]
    held = plain_members(*zip(*learnt, strict=True))
    got = {r["doc_id"]: r for r in run("op9_language")}
    assert got.keys() == {r[0] for r in rows}
    from test_classifiers import plain_grams

    clear = 0
    for i, text, *_ in rows:
        r = got[i]
        assert r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = plain_grams(text)
        share = sorted(((sum(g in held[x] for g in own) / len(own), x) for x in held), reverse=True)
        if share[0][0] > share[1][0] + 0.05:
            clear += 1
            assert r["lang_pred"] == share[0][1] and abs(r["score"] - share[0][0]) < 0.05
    assert clear > 400
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs.selectExpr("doc_id", "text", "'zz' source", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'qq' else lang end lang").write.parquet(f"{tmp_path}/documents.parquet")
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op9_language"](spark, str(tmp_path)).collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}


def test_op10_pages(run, tables):
    """No name says anything on these pages: the texts are those of the element that explicit vectors find, less the fixed ones."""
    hosts, pages = tables[4]
    fixed = {h: _deduced(all_)[1] for h, all_ in hosts.items()}
    got = {r["page_id"]: r for r in run("op10_html")}
    assert got.keys() == {i for i, *_ in pages}
    for i, url, page in pages:
        name = url.split("/")[2].split(".")[0]
        wanted = [t for p, texts in Explicit(page).text.items() if "div.y" in p for t in texts if (p, t) not in fixed[name]]
        assert sorted(got[i]["text"].split("\n")) == sorted(wanted) and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == url


def test_pipeline_stage_by_stage(spark, tables):
    """Each stage against its plain version, on what the stage before kept."""
    path, rows, labels, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    order = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    told = lambda df: Counter(json.dumps([r[c] for c in order]) for r in df.collect())
    every = {r[0]: r for r in rows}

    one = stages["quality"](spark, docs, path)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op1_quality"](spark, path).collect()}
    wanted = {i for i, s in scores.items() if s >= 0.5}
    assert one.columns == order and told(one) == Counter(json.dumps(list(every[i])) for i in wanted)

    two = stages["language"](spark, one, path)
    tongue = {r["doc_id"]: r for r in QUERIES["op9_language"](spark, path).collect()}
    wanted = {i for i in wanted if tongue[i]["lang_pred"] != language.UNKNOWN and tongue[i]["score"] >= 0.2}
    assert two.columns == order and told(two) == Counter(json.dumps(list(every[i])) for i in wanted)

    three = stages["near_duplicates"](spark, two, path)
    groups = brute_groups({i: shingle_set(every[i][1], 5) for i in wanted})
    wanted = set(groups.values())  # the least id of each group
    assert three.columns == order and told(three) == Counter(json.dumps(list(every[i])) for i in wanted)

    four = stages["mixing"](spark, three, path)
    counts = {i: (every[i][3], len(ids_of(every[i][1]))) for i in wanted}
    tokens, _, reads = plain_mixture(counts.values(), 1.5)
    copies = Counter(r["doc_id"] for r in four.collect())
    assert four.columns == order and copies.keys() == wanted and set(copies.values()) <= {1, 2}
    for s in tokens:
        read = sum(n * counts[i][1] for i, n in copies.items() if counts[i][0] == s)
        budget = round(tokens[s] * reads[s])
        assert budget <= read < budget + max(n for x, n in counts.values() if x == s)

    check_packed(stages["packing"](spark, four, path).collect(), {i: (every[i][1], n) for i, n in copies.items()})
    whole = corpus_pipeline.run(spark, path).collect()
    check_packed(whole, {i: (every[i][1], n) for i, n in copies.items()})


def test_pipeline_of_nothing(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op1_quality", "op2_token_counts", "op3_packing", "op4_media_tiff", "op5_near_duplicates", "op6_sharding", "op8_mixing", "op9_language"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
