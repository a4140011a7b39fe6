import json
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftmark.llm import bpe as module
from driftmark.llm import packing, tokens
from driftmark.llm.bpe import ByteBPE, byte_bpe, byte_letters

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_ranks(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Merging a pre-token by the plain rule: the pair of least rank, leftmost first, until no pair has one."""
    parts = [bytes((b,)) for b in piece]
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [b"".join(parts[best[1] : best[1] + 2])]


def spec_of(path):
    spec = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    letters = byte_letters()
    raw = lambda s: bytes(letters[x] for x in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
    return {raw(s): i for s, i in spec["vocab"].items() if set(s) <= set(letters) and s != "<|endoftext|>"}, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}


def test_the_proof_equals_plain_merging():
    bpe = byte_bpe(PATH)
    vocab, ranks = spec_of(PATH)
    for raw, i in random.Random(1).sample(sorted(vocab.items()), 4000):
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        parts = by_ranks(raw, ranks)
        assert (text in bpe.whole) == (parts == [raw])
        assert bpe.merge(text) == [vocab[x] for x in parts]
        assert bpe.whole.get(text, i) == i
    assert len(bpe.whole) > 45_000


def test_strings_that_no_merge_reaches_are_not_whole(tmp_path, spark, make_docs):
    """`abc` is cut into ab and c by the earlier merge; `xyz` has no merge at all; both are in the vocabulary."""
    letters = list(byte_letters())
    vocab = {s: i for i, s in enumerate([*letters, "ab", "bc", "abc", "xyz", "yz"])}
    merges = [["a", "b"], ["b", "c"], ["a", "bc"], ["y", "z"]]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": None, "model": model}))
    bpe, library = ByteBPE(str(path)), Tokenizer.from_file(str(path))
    assert {"ab", "bc", "yz"} <= set(bpe.whole) and not {"abc", "xyz"} & set(bpe.whole)
    texts = ["abc", "xyz", "ab bc yz abc", "aabbcc xyzxyz abcabc", "a" * 700 + "bc"]
    for t in texts:
        assert bpe.ids(t).tolist() == library.encode(t).ids and bpe.count(t) == len(library.encode(t).ids)
    rows = sorted(tokens.count_tokens(make_docs(texts), str(path)).collect(), key=lambda r: r["doc_id"])
    assert [r["n_tokens"] for r in rows] == [len(library.encode(t).ids) for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(module, "MEMO", 3)
    bpe = ByteBPE(PATH)
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(5, 12))) for _ in range(12)]
    for _ in range(60):
        t = " ".join(rng.choices(words, k=9))
        assert bpe.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids and bpe.count(t) == len(bpe.ids(t))
    assert len(bpe._ids) <= len(bpe.whole) + 3 and len(bpe._ids.old) >= len(bpe.whole)


def test_pieces_of_many_lengths_equal_the_library(library):
    rng = random.Random(2)
    bpe = byte_bpe(PATH)
    for n in [*range(1, 40), 63, 64, 65, 255, 256, 257, 511, 512, 513, 1025, 5000]:
        t = "".join(rng.choices("etaoinshré日", k=n))
        assert bpe.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_odd_texts_equal_the_library(library, odd_texts):
    bpe = byte_bpe(PATH)
    for t in odd_texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert bpe.ids(t).tolist() == ids
        assert bpe.count(t) == len(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdefg '\n\t!?.19éñ\x1c\x85\xa0", max_size=80))
def test_any_text_equals_the_library(text):
    assert byte_bpe(PATH).ids(text).tolist() == Tokenizer_of().encode(text, add_special_tokens=False).ids


_library = []


def Tokenizer_of():
    if not _library:
        _library.append(Tokenizer.from_file(PATH))
    return _library[0]


def test_counts_in_spark(spark, make_docs, odd_texts, library):
    docs = make_docs(odd_texts)
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, PATH).collect()}
    for i, t in enumerate(odd_texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_counts_of_other_vocabularies(spark, make_docs, odd_texts):
    import sentencepiece

    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith("model"):
            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            wanted = [len(piece.encode(t or "")) for t in odd_texts]
        else:
            wanted = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in odd_texts]
        rows = sorted(tokens.count_tokens(make_docs(odd_texts), path).collect(), key=lambda r: r["doc_id"])
        assert [r["n_tokens"] for r in rows] == wanted


@given(st.integers(1, 30_000), st.integers(1, 3000))
def test_cuts(n, capacity):
    found = packing.cuts(n, capacity)
    assert [a for a, _ in found] == list(accumulate((k for _, k in found[:-1]), initial=0))
    assert sum(k for _, k in found) == n
    assert all(k == capacity for _, k in found[1:]) and 0 < found[0][1] <= capacity
    assert len(found) == -(-n // capacity)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12), st.integers(1, 60))
def test_fullest_is_the_best_subset_sum(counts, room):
    lengths = sorted((n for n in counts if n <= room), reverse=True)
    got = dict(packing.fullest(lengths, counts, room))
    reach = {0}
    for n in lengths:
        reach = {r + k * n for r in reach for k in range(counts[n] + 1) if r + k * n <= room}
    assert sum(n * k for n, k in got.items()) == max(reach)
    assert all(k <= counts[n] for n, k in got.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_plan_places_every_piece_once(counts):
    table, sequences = packing.plan(counts, 32)
    held = defaultdict(list)
    for n, c in counts.items():
        for rank in range(c):
            row = table[np.searchsorted(table[:, 0], n << packing.RANK_BITS | rank, "right") - 1]
            assert row[0] >> packing.RANK_BITS == n
            inside = rank - (row[0] & (1 << packing.RANK_BITS) - 1)
            held[row[1] + inside // row[2]].append((row[3] + inside % row[2] * n, n))
    assert len(held) == sequences
    for items in held.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 32
    total = sum(n * c for n, c in counts.items())
    assert sequences <= 2 * -(-total // 32)


def test_pack_in_spark(spark, make_docs, odd_texts, library):
    texts = odd_texts + ["same text"] * 50
    rows = packing.pack(make_docs(texts, ids=[*range(len(odd_texts)), *[99] * 50]), PATH).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(odd_texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        found = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in found] == packing.cuts(len(ids), 2048)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in found)
    assert len(by[99]) == 50
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert Counter((r["sequence_id"], r["offset"]) for r in rows).most_common(1)[0][1] == 1


def test_pack_of_nothing(spark, make_docs):
    assert packing.pack(make_docs(["x"]).limit(0), PATH).count() == 0
