"""Media columns: texts stored as TIFF pages, and TIFF columns read as one row per page.

Texts are stored in all ways that the writer knows (strips and tiles; deflate, PackBits and LZW; with and
without the horizontal predictor), dealt out by a checksum of the text, so that reading a column back meets them all.

Defined results: null text is the empty payload (one padding unit of zero bytes); a null or
unreadable media value gives a row with page -1, null samples and the reason in `error`, behind the pages before the fault;
no value makes the job fail, and no page is read that its stored bytes couldn't give;
empty tables give no rows; columns besides those named are ignored; equal texts give equal
stored bytes and features.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftmark.llm import tiff
from driftmark.plans.cluster import ship

UNIT = 64
#: Rows of a page: a page holds at most 256 KiB, and a longer text has more pages.
PAGE_ROWS = 4096
#: Rows that a batch carries between Spark and Python.
BATCH = 256


def payload(text: str | None) -> tuple[int, bytes]:
    """Length in bytes of a text, and its bytes padded with 0 to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (UNIT if not raw else -len(raw) % UNIT)


#: The ways of storing a payload that `encode` deals out: compression, predictor, tile.
WAYS = [
    (tiff.DEFLATE, 1, None),
    (tiff.DEFLATE, 2, None),
    (tiff.DEFLATE, 1, (32, 32)),
    (tiff.DEFLATE, 2, (48, 48)),
    (tiff.PACKBITS, 1, None),
    (tiff.PACKBITS, 2, (32, 64)),
    (tiff.LZW, 1, None),
    (tiff.LZW, 2, (32, 32)),
]


def to_tiff(data: bytes, compression: int = tiff.DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None) -> bytes:
    """Bytes as 8-bit samples of pages UNIT wide."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    return tiff.write([rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)], compression, predictor, tile=tile)


def way_of(data: bytes) -> tuple[int, int, tuple[int, int] | None]:
    """The way in which a payload is stored: it follows from its bytes, so equal texts give equal files."""
    return WAYS[zlib.crc32(data) % len(WAYS)]


def encode(docs: DataFrame, way: tuple[int, int, tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_bytes and the TIFF `media` of each row's text: stored in that way, or in all ways by turns."""
    ship(docs.sparkSession)

    def stored(batches):
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, len(ids), BATCH):
                made = [payload(t) for t in texts[at : at + BATCH].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + BATCH], pa.array([n for n, _ in made], pa.int64()), pa.array([to_tiff(b, *(way or way_of(b))) for _, b in made], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(stored, f"doc_id {kind}, n_bytes long, media binary")


def read_pages(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each page of a `media` column: key, page, width, height, channels, samples, error."""
    ship(media.sparkSession)
    names = [key, "page", "width", "height", "channels", "samples", "error"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def read(batches):
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                try:
                    if not value.is_valid:
                        raise tiff.TiffError("no media")
                    for n, page in enumerate(tiff.pages(value.as_py())):
                        h, w, c = page.shape
                        row = [n, w, h, c, page.tobytes(), None]
                        yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], *(pa.array([x], k) for x, k in zip(row, kinds, strict=True))], names)
                except tiff.TiffError as e:
                    row = [-1, None, None, None, None, str(e)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], *(pa.array([x], k) for x, k in zip(row, kinds, strict=True))], names)

    kind = dict(media.dtypes)[key]
    return media.select(key, "media").mapInArrow(read, f"{key} {kind}, page int, width int, height int, channels int, samples binary, error string")


def feature(samples: np.ndarray) -> str:
    """Rows, mean, spread, entropy in bits and mean step of the samples, as text."""
    shares = np.bincount(samples, minlength=256) / len(samples)
    some = shares[shares > 0]
    step = np.abs(np.diff(samples.astype(np.int16))).mean()
    return f"rows={len(samples) // UNIT};mean={samples.mean():.4f};sd={samples.std():.4f};entropy={-(some * np.log2(some)).sum() + 0.0:.4f};step={step:.4f}"


def digest(media: DataFrame) -> DataFrame:
    """What the stored media give when read back: checksums of payload and file, and a feature."""
    ship(media.sparkSession)

    def told(batches):
        for batch in batches:
            rows = []
            for value in batch.column(2):
                stored = value.as_py()
                back = b"".join(page.tobytes() for page in tiff.pages(stored))
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(back, np.uint8))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = dict(media.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(told, out)
