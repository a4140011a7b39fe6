import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmark.llm import media, sharding, tiff


@given(st.binary(max_size=3000))
def test_packbits_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data


@settings(deadline=None)
@given(st.binary(max_size=3000) | st.binary(min_size=1, max_size=4).map(lambda b: b * 3000))
def test_lzw_round_trip(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_of_long_data():
    data = np.random.default_rng(1).integers(0, 7, 200_000, np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.DEFLATE, tiff.PACKBITS, tiff.LZW])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_round_trip(compression, predictor):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (h, w), np.uint8) for h, w in ((1, 64), (300, 64), (7, 5))]
    back = list(tiff.pages(tiff.write(images, compression, predictor, strip_rows=50)))
    assert len(back) == 3
    for a, b in zip(images, back, strict=True):
        assert (a == b[:, :, 0]).all()


def _file(order, tags, blobs, big=False):
    """A file of one page; blobs: parts that a tag's offsets point to."""
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    out = bytearray(head)
    at = []
    for b in blobs:
        at.append(len(out))
        out += b
    tags = dict(tags)
    key = tiff.TILE_AT if tiff.TILE_WIDTH in tags else tiff.STRIP_AT
    tags[key] = (4, at)
    tags[tiff.TILE_SIZE if key == tiff.TILE_AT else tiff.STRIP_SIZE] = (4, [len(b) for b in blobs])
    entries = b""
    for tag, (kind, values) in sorted(tags.items()):
        packed = struct.pack(f"{order}{len(values)}{tiff.CODES[kind]}", *values)
        room = 8 if big else 4
        if len(packed) > room:
            where = len(out)
            out += packed
            packed = struct.pack(order + ("Q" if big else "I"), where)
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + packed.ljust(room, b"\0")
    start = len(out)
    out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + ("Q" if big else "I"), 0)
    struct.pack_into(order + ("Q" if big else "I"), out, 8 if big else 4, start)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiles_of_16_bits_with_predictor(order, big):
    image = np.random.default_rng(4).integers(0, 65536, (20, 30, 3)).astype(np.uint16)
    padded = np.zeros((32, 32, 3), np.uint16)
    padded[:20, :30] = image
    blobs = []
    for y in (0, 16):
        for x in (0, 16):
            tile = padded[y : y + 16, x : x + 16].copy()
            tile[:, 1:] = tile[:, 1:] - padded[y : y + 16, x : x + 15]
            blobs.append(zlib.compress(tile.astype(order + "u2").tobytes()))
    tags = {
        tiff.WIDTH: (3, [30]), tiff.HEIGHT: (3, [20]), tiff.BITS: (3, [16, 16, 16]), tiff.COMPRESSION: (3, [8]), tiff.SAMPLES: (3, [3]),
        tiff.TILE_WIDTH: (3, [16]), tiff.TILE_HEIGHT: (3, [16]), tiff.PREDICTOR: (3, [2]),
    }
    (page,) = tiff.pages(_file(order, tags, blobs, big))
    assert (page == image).all()


def test_planes_and_float_predictor():
    image = np.random.default_rng(5).normal(size=(4, 6, 2)).astype(np.float32)
    blobs = []
    for s in (0, 1):
        rows = image[:, :, s].astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
        stored = rows.copy()
        stored[:, 1:] = rows[:, 1:] - rows[:, :-1]
        blobs.append(stored.tobytes())
    tags = {
        tiff.WIDTH: (3, [6]), tiff.HEIGHT: (3, [4]), tiff.BITS: (3, [32, 32]), tiff.COMPRESSION: (3, [1]), tiff.SAMPLES: (3, [2]),
        tiff.PLANAR: (3, [2]), tiff.PREDICTOR: (3, [3]), tiff.SAMPLE_FORMAT: (3, [3, 3]), tiff.STRIP_ROWS: (3, [4]),
    }
    (page,) = tiff.pages(_file("<", tags, blobs))
    assert (page == image).all()


SOME = [tiff.write([np.arange(256, dtype=np.uint8).reshape(4, 64)] * 2, *way[:2], tile=way[2]) for way in [(tiff.NONE, 1, None), *media.WAYS]]


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=200), st.sampled_from(SOME), st.lists(st.tuples(st.integers(0, 10_000), st.sampled_from([0, 1, 2, 7, 127, 128, 255])), max_size=6), st.integers(0, 10_000))
def test_broken_files_are_told(data, good, changes, end):
    """Whatever the bytes, pages are read or TiffError is raised: nothing else."""
    broken = bytearray(good)
    for at, value in changes:
        broken[at % len(broken)] = value
    for x in (data, b"II*\0" + data, bytes(broken), bytes(broken[: end % len(broken)])):
        try:
            for page in tiff.pages(x):
                assert page.ndim == 3 and page.size
        except tiff.TiffError:
            pass


BASE = {tiff.WIDTH: (4, [8]), tiff.HEIGHT: (4, [8]), tiff.BITS: (3, [8]), tiff.COMPRESSION: (3, [1]), tiff.SAMPLES: (3, [1])}
STRIPS = BASE | {tiff.STRIP_ROWS: (4, [8])}
TILES = BASE | {tiff.TILE_WIDTH: (4, [8]), tiff.TILE_HEIGHT: (4, [8])}


@pytest.mark.parametrize(
    "tags",
    [
        STRIPS | {tiff.STRIP_ROWS: (4, [0])}, STRIPS | {tiff.SAMPLES: (3, [0])}, STRIPS | {tiff.WIDTH: (4, [0])}, STRIPS | {tiff.HEIGHT: (4, [2**32 - 1])},
        STRIPS | {tiff.WIDTH: (4, [2**32 - 1]), tiff.HEIGHT: (4, [2**32 - 1]), tiff.COMPRESSION: (3, [8])}, STRIPS | {tiff.WIDTH: (11, [float("inf")])},
        STRIPS | {tiff.COMPRESSION: (3, [9])}, STRIPS | {tiff.PREDICTOR: (3, [3])}, STRIPS | {tiff.PREDICTOR: (3, [9])}, STRIPS | {tiff.BITS: (3, [])},
        TILES | {tiff.TILE_WIDTH: (4, [0])}, TILES | {tiff.TILE_HEIGHT: (4, [0])}, TILES | {tiff.TILE_WIDTH: (4, [2**31])}, TILES | {tiff.WIDTH: (4, [2**31])},
    ],
)
def test_odd_fields_are_told(spark, tags):
    data = _file("<", tags, [b"x" * 64])
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(data))
    rows = media.read_pages(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["page"], r["samples"]) for r in rows] == [(1, -1, None)] and rows[0]["error"]


@pytest.mark.parametrize("tile", [(16, 16), (32, 48), (64, 64)])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.DEFLATE, tiff.PACKBITS, tiff.LZW])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiles_round_trip(tile, compression, predictor):
    images = [np.random.default_rng(h).integers(0, 9, (h, w)).astype(np.uint8) for h, w in ((1, 1), (64, 64), (100, 70), (17, 5))]
    back = list(tiff.pages(tiff.write(images, compression, predictor, tile=tile)))
    assert all((a == b[:, :, 0]).all() for a, b in zip(images, back, strict=True)) and len(back) == 4


def test_all_ways_are_dealt_out_and_read_as_pages(spark, make_docs):
    texts = [f"text {i} " * (i % 50) for i in range(120)]
    docs = make_docs(texts)
    assert {media.way_of(media.payload(t)[1]) for t in texts} == set(media.WAYS)
    rows = media.read_pages(media.encode(docs)).collect()
    assert {r["error"] for r in rows} == {None}
    assert {r["doc_id"]: bytes(r["samples"]).rstrip(b"\0").decode() for r in rows} == dict(enumerate(texts))


def test_digest(spark, make_docs, odd_texts):
    rows = {r["doc_id"]: r for r in media.digest(media.encode(make_docs(odd_texts))).collect()}
    for i, t in enumerate(odd_texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.to_tiff(padded, *media.way_of(padded))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[3]["feature"] == rows[4]["feature"]
    assert media.digest(media.encode(make_docs(["x"]).limit(0))).count() == 0


def test_read_pages(spark, make_docs):
    long = "line of text\n" * 60_000
    encoded = media.encode(make_docs([long, "short"]), (tiff.LZW, 2, None))
    bad = spark.createDataFrame([(7, None), (8, bytearray(b"no tiff"))], "doc_id long, media binary")
    rows = media.read_pages(encoded.select("doc_id", "media").unionByName(bad)).orderBy("doc_id", "page").collect()
    first = [r for r in rows if r["doc_id"] == 0]
    assert [r["page"] for r in first] == list(range(len(first))) and len(first) > 1
    assert b"".join(r["samples"] for r in first).rstrip(b"\0").decode() == long
    assert [(r["page"], r["samples"]) for r in rows if r["doc_id"] in (7, 8)] == [(-1, None)] * 2
    assert all(r["error"] for r in rows if r["doc_id"] in (7, 8))


def _jump(key, shards):
    """One key at a time, in Python's whole numbers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30), st.integers(1, 100))
def test_jump(keys, shards):
    got = sharding.jump(np.array(keys, np.int64), shards)
    assert got.tolist() == [_jump(k % 2**64, shards) for k in keys]


def test_shards(spark, make_docs, odd_texts):
    texts = odd_texts + [f"text {i % 7}" for i in range(3000)]
    rows = sharding.assign_shards(make_docs(texts, ids=[None, 0, 0, *range(3, len(texts))])).collect()
    assert len(rows) == len(texts)
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    counts = np.bincount([r["shard"] for r in rows], minlength=24)
    assert counts.min() > 60 and 0.01 < np.mean([r["grown_shard"] == 24 for r in rows]) < 0.08
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 0)}
    for i in range(3, len(texts)):
        raw = (texts[i] or "").encode()
        assert (by[i]["size"], by[i]["text_crc32"], by[i]["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
    assert sharding.assign_shards(make_docs(["x"]).limit(0)).count() == 0
