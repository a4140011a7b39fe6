"""TIFF: writing bytes as pages of 8-bit samples, and reading pages back.

The reader walks the chain of image directories of classic and big files in either byte
order, decodes strips and tiles (none, LZW, deflate, PackBits), undoes the horizontal and
floating-point predictors and yields one array for each page.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the TIFF 6.0 format: field types with their sizes and codes, and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    """The bytes are no TIFF that this reader knows."""


def unpack_bits(data: bytes) -> bytes:
    """PackBits: runs and literals, each after a signed length byte."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    """PackBits of data: runs of three or more become a run, the rest literals."""
    out, literal = bytearray(), 0

    def flush(end: int) -> None:
        for a in range(literal, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in RUN.finditer(data):
        flush(run.start())
        out += bytes((257 - (run.end() - run.start()), data[run.start()]))
        literal = run.end()
    flush(len(data))
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table: list[bytes] = []
    out, held, bits, width, last, at, wider = [], 0, 0, 9, b"", 0, 511
    while True:
        if bits < width:
            part = data[at : at + 6]
            if not part:
                break
            at += len(part)
            held = (held & (1 << bits) - 1) << 8 * len(part) | int.from_bytes(part, "big")
            bits += 8 * len(part)
            if bits < width:
                break
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last, wider = first.copy(), 9, b"", 511
            continue
        if not table:
            raise TiffError("LZW data starts without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) >= wider and width < 12:
                width += 1
                wider = (wider + 1) * 2 - 1
        last = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """LZW of data, as `unpack_lzw` reads it."""
    table: dict[int, int] = {}  # code of a prefix << 8 | next byte -> code of both
    following, prefix = 258, -1
    out, held, bits, width = bytearray(), 256, 9, 9

    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        held, bits = held << width | prefix, bits + width
        table[key] = following
        following += 1
        prefix = byte
        if following & following - 1 == 0 and following >= 512:
            width = following.bit_length()
        if following == 4094:
            held, bits = held << width | 256, bits + width
            table, width, following = {}, 9, 258
        if bits > 4096:  # whole bytes leave, the rest stays
            rest = bits & 7
            out += (held >> rest).to_bytes(bits - rest >> 3, "big")
            held, bits = held & (1 << rest) - 1, rest
    if prefix >= 0:
        held, bits = held << width | prefix, bits + width
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    held, bits = held << width | 257, bits + width
    rest = -bits & 7
    return bytes(out + (held << rest).to_bytes(bits + rest >> 3, "big"))


#: Bytes that a stored byte can give at most, by the formats: a run of 128 from 2; a match of 258 from 2 bits; an entry of some 3,800 from 9 bits.
MOST_FROM_A_BYTE = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 3640}


def _decoded(data: bytes, compression: int, need: int) -> bytes:
    """The first `need` bytes that a strip or tile gives."""
    if compression == NONE:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, need)
    elif compression == PACKBITS:
        out = unpack_bits(data)
    else:
        out = unpack_lzw(data)
    if len(out) < need:
        raise TiffError("a strip or tile is too short")
    return out[:need]


def _undone(rows: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """rows: (height, width, samples) as stored; predictors hold along the width."""
    if predictor == 1:
        return rows
    if predictor == 2:
        return np.cumsum(rows, axis=1, dtype=rows.dtype)
    if predictor == 3 and rows.dtype.kind == "f":
        h, w, s = rows.shape
        size = rows.dtype.itemsize
        flat = rows.reshape(h, w * s).view(np.uint8).reshape(h, w * s * size)
        summed = np.cumsum(flat.reshape(h, w * size, s), axis=1, dtype=np.uint8).reshape(h, size, w * s)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">f{size}").reshape(h, w, s).astype(f"{order}f{size}")
    raise TiffError(f"predictor {predictor} is not known")


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """Tags of the directory at an offset, and the offset of the next."""
    count_code, entry, value_size, offset_code = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    count_size = struct.calcsize(count_code)
    (count,) = struct.unpack_from(order + count_code, data, at)
    if at + count_size + count * entry > len(data):
        raise TiffError("a directory runs beyond the end")
    tags = {}
    for i in range(count):
        here = at + count_size + i * entry
        tag, kind, n = struct.unpack_from(order + "HH" + offset_code, data, here)
        here += 4 + struct.calcsize(offset_code)
        if kind not in CODES:
            continue
        size = struct.calcsize(order + CODES[kind]) * n
        if size > value_size:
            (here,) = struct.unpack_from(order + offset_code, data, here)
        if here + size > len(data):
            raise TiffError("a field runs beyond the end")
        tags[tag] = struct.unpack_from(f"{order}{n}{CODES[kind]}", data, here)
    (following,) = struct.unpack_from(order + offset_code, data, at + count_size + count * entry)
    return tags, following


def _page(data: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    def one(tag: int, other: int | None = None) -> int:
        found = tags[tag][0] if tags.get(tag) else other
        if not isinstance(found, int) or found < 1:
            raise TiffError(f"field {tag} is missing or no positive number")
        return found

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits = set(tags.get(BITS, (1,)))
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if len(bits) != 1 or (depth := bits.pop()) not in (8, 16, 32, 64) or kind is None or kind == "f" and depth < 32:
        raise TiffError("only samples of 8, 16, 32 or 64 bits are read")
    dtype = np.dtype(f"{order}{kind}{depth // 8}")
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if compression not in MOST_FROM_A_BYTE:
        raise TiffError(f"compression {compression} is not known")
    apart = one(PLANAR, 1) == 2
    planes, deep = (samples, 1) if apart else (1, samples)
    tiled = TILE_AT in tags
    part_w, part_h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, sizes = (tags[TILE_AT], tags[TILE_SIZE]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
    if not all(isinstance(x, int) and x >= 0 for x in (*offsets, *sizes)):
        raise TiffError("places of strips or tiles are no whole numbers")
    across, down = -(-width // part_w), -(-height // part_h)
    if len(offsets) < planes * across * down or len(sizes) < planes * across * down:
        raise TiffError("parts of a page are missing")

    def need(i: int) -> int:
        rows = part_h if tiled else min(part_h, height - i % (across * down) * part_h)
        return rows * part_w * deep * dtype.itemsize

    # before memory is asked for: what is stored must be able to give that much
    for i in range(planes * across * down):
        if need(i) > max(0, min(sizes[i], len(data) - offsets[i])) * MOST_FROM_A_BYTE[compression]:
            raise TiffError("a strip or tile is too short")
    page = np.empty((height, width, samples), dtype.newbyteorder("="))
    for i in range(planes * across * down):
        plane, inside = divmod(i, across * down)
        y, x = inside // across * part_h, inside % across * part_w
        rows = part_h if tiled else min(part_h, height - y)
        raw = _decoded(data[offsets[i] : offsets[i] + sizes[i]], compression, need(i))
        part = _undone(np.frombuffer(raw, dtype).reshape(rows, part_w, deep), predictor, order)
        h, w = min(rows, height - y), min(part_w, width - x)
        page[y : y + h, x : x + w, plane : plane + deep if apart else samples] = part[:h, :w]
    return page


def pages(data: bytes) -> Iterator[np.ndarray]:
    """Each page of a TIFF as an array (height, width, samples); TiffError, and nothing else, if it can't be read."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        (version,) = struct.unpack_from(order + "H", data, 2)
        big = version == 43
        if version not in (42, 43):
            raise TiffError("no TIFF version")
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        seen = set()
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            tags, at = _directory(data, at, order, big)
            yield _page(data, tags, order)
    except TiffError:
        raise
    except (KeyError, IndexError, ValueError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        raise TiffError(f"broken TIFF: {e!r}") from e


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 128, level: int = 6, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF of 8-bit grey pages (height, width), in strips, or in tiles of a height and width."""
    pack = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: pack_bits, LZW: pack_lzw}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        rows, columns = tile or (strip_rows, width)
        offsets, sizes = [], []
        for y in range(0, height, rows):
            for x in range(0, width, columns):
                part = image[y : y + rows, x : x + columns]
                if tile and part.shape != tile:
                    part = np.pad(part, [(0, rows - part.shape[0]), (0, columns - part.shape[1])])
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                stored = pack(part.tobytes())
                offsets.append(len(out))
                sizes.append(len(stored))
                out += stored + b"\0" * (len(stored) % 2)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [columns], TILE_HEIGHT: [rows], TILE_AT: offsets, TILE_SIZE: sizes} if tile else {STRIP_AT: offsets, STRIP_ROWS: [strip_rows], STRIP_SIZE: sizes}
        entries = b""
        for tag, values in sorted(fields.items()):
            if len(values) == 1:
                entries += struct.pack("<HHII", tag, 4, 1, values[0])
            else:
                entries += struct.pack("<HHII", tag, 4, len(values), len(out))
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
