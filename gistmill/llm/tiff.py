"""TIFF media columns: write payloads as TIFF images, walk TIFF files page by page.

The reader walks the chain of image directories of little- or big-endian files, decodes
strips or tiles (uncompressed, PackBits, LZW, deflate; either fill order), undoes the horizontal (8, 16 and 32
bits) and the floating-point predictor, joins planes, and gives one row per page: its samples
in file order as little-endian bytes, row by row, pixel-interleaved.  A page that can't be
decoded, or would have more than ``max_page_bytes`` bytes by its directory, is a row with ``error`` set and null samples; a file without a readable header or
directory is one such row with page 0.  A directory that a chain reaches twice ends it.

The writer stores any bytes as 8-bit grey pages of ``width`` pixels.  ``layout`` chooses the form by the length alone: payloads of up to
2 KiB take turns, by their number of rows, in LZW strips with the horizontal predictor, PackBits tiles, deflate tiles with the
predictor and uncompressed strips; longer ones have deflate strips of 16 KiB with the predictor and a page for each 64 KiB.

Rows are worked on where they are read; nothing is shuffled.  A worker holds one
batch of bounded bytes (a longer file is a batch of its own) and decodes page by page; it hands pages on once they have 8 MiB.  Each page
row carries digests of all samples of its file so far, so nobody needs to put pages together again to check a file.

Defined cases.  A null text is read as empty; its payload is one row of zero samples.
A null media value gives no pages.  Equal texts give equal files.  Repeated rows give
repeated results.  Very long texts have many pages.  Empty tables give empty results.  Other columns are ignored by ``media`` and kept by ``pages`` inside one
struct, so their names may be any.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import documents, id_and_text, small_batches, stored

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_FORMATS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: Each byte with its bits in reverse order, for fill order 2.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


# ---------------------------------------------------------------- codecs


def unpack_bits(data: bytes, size: int) -> bytes:
    out = bytearray()
    at = 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n == 128:
            at += 1
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out = bytearray()
    literal = bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            out.append(len(literal[i : i + 128]) - 1)
            out.extend(literal[i : i + 128])
        literal.clear()

    at = 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush()
            out += bytes((257 - run, data[at]))
        else:
            literal += data[at : at + run]
        at += run
    flush()
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """TIFF LZW: codes of 9 to 12 bits, high bit first, widened one code early."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    made, width, held, bits, last = 0, 9, 0, 0, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or made >= size:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if last:
            if code > len(table):
                raise ValueError("an LZW code beyond its table")
            table.append(last + (table[code] if code < len(table) else last)[:1])
        elif code > 255:
            raise ValueError("an LZW string without a start")
        last = table[code]
        out.append(last)
        made += len(last)
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table: dict[bytes, int] = {}
    width, top, word = 9, 258, b""
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0], width)
        table[longer] = top
        top += 1
        word = data[i : i + 1]
        width = 12 if top >= 2048 else 11 if top >= 1024 else 10 if top >= 512 else 9
        if top == 4094:
            put(word[0], width)
            put(256, width)
            table.clear()
            width, top, word = 9, 258, b""
    if word:
        put(table[word] if len(word) > 1 else word[0], width)
        top += 1
        width = 12 if top >= 2048 else 11 if top >= 1024 else 10 if top >= 512 else 9
    put(257, width)
    put(0, -bits % 8)
    return bytes(out)


def compress(data: bytes, codec: int) -> bytes:
    if codec == NONE:
        return data
    return {LZW: lzw, PACKBITS: pack_bits, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress}[codec](data)


def decompress(data: bytes, codec: int, size: int) -> bytes:
    if codec == NONE:
        return data
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if codec == PACKBITS:
        return unpack_bits(data, size)
    if codec == LZW:
        return unlzw(data, size)
    raise ValueError(f"compression {codec} is not known")


# ---------------------------------------------------------------- writer


def write(
    payload: bytes, width: int = 64, codec: int = DEFLATE, predictor: int = 2, strip_bytes: int = 1 << 16,
    page_bytes: int | None = None, order: str = "<", tile: tuple[int, int] | None = None, fill: int = 1,
) -> bytes:
    """A TIFF file of ``payload``, whose length is a positive multiple of ``width``, as 8-bit grey samples; ``tile`` is (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    page_bytes = page_bytes or len(payload)
    for at in range(0, len(payload), page_bytes):
        image = np.frombuffer(payload[at : at + page_bytes], dtype=np.uint8).reshape(-1, width)
        if tile:
            th, tw = tile
            padded = np.pad(image, ((0, -len(image) % th), (0, -width % tw)))
            parts = [padded[y : y + th, x : x + tw] for y in range(0, len(padded), th) for x in range(0, padded.shape[1], tw)]
        else:
            rows = max(1, strip_bytes // width)
            parts = [image[y : y + rows] for y in range(0, len(image), rows)]
        places, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            data = compress(np.ascontiguousarray(part).tobytes(), codec)
            data = data.translate(_REVERSED) if fill == 2 else data
            places.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = [(256, 4, [width]), (257, 4, [len(image)]), (258, 3, [8]), (259, 3, [codec]), (262, 3, [1]), (266, 3, [fill]), (277, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [rows]), (279, 4, sizes)]
        fields = b""
        for tag, kind, values in sorted(tags):
            body = struct.pack(order + _FORMATS[kind] * len(values), *values)
            if len(body) > 4:
                place, body = len(out), body
                out += body
                body = struct.pack(order + "I", place)
            fields += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + fields
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def layout(size: int) -> dict:
    """The options of ``write`` for a payload of ``size`` bytes."""
    if size > 2048:
        return {"strip_bytes": 1 << 14, "page_bytes": 1 << 16}
    return (
        {"codec": LZW, "predictor": 2}, {"codec": PACKBITS, "predictor": 1, "tile": (16, 16)}, {"codec": DEFLATE, "predictor": 2, "tile": (16, 32)},
        {"codec": NONE, "predictor": 1, "strip_bytes": 512},
    )[size // 64 % 4]


# ---------------------------------------------------------------- reader


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of every image directory of a file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in _FORMATS:
                continue
            size = struct.calcsize(order + _FORMATS[kind]) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if place + size > len(data):
                raise ValueError(f"tag {tag} lies beyond the file")
            tags[tag] = struct.unpack_from(order + _FORMATS[kind] * count, data, place)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def page(data: bytes, order: str, tags: dict[int, tuple], max_page_bytes: int) -> dict:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height = one(256), one(257)
    if not width or not height:
        raise ValueError("no image size")
    bits, samples, codec, predictor, planar, fill = one(258, 1), one(277, 1), one(259, 1), one(317, 1), one(284, 1), one(266, 1)
    if bits not in (8, 16, 32, 64) or len(set(tags.get(258, (bits,)))) != 1:
        raise ValueError(f"{tags.get(258, (1,))} bits a sample are not known")
    if predictor not in (1, 2, 3) or (predictor == 3 and bits not in (16, 32, 64)):
        raise ValueError(f"predictor {predictor} is not known for {bits} bits")
    deep, lanes = bits // 8, samples if planar == 1 else 1
    kind = np.dtype(f"{order}u{deep}")
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (width, min(height, one(278, height)))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags.get(279, (len(data),)))
    if not tw or not th or fill not in (1, 2):
        raise ValueError("no tile or strip size, or an unknown fill order")
    if max(width * height * samples, tw * th * lanes) * deep > max_page_bytes:
        raise ValueError(f"{width} x {height} x {samples} samples of {bits} bits are over {max_page_bytes} bytes")
    across, down = -(-width // tw), -(-height // th)
    if len(places) < across * down * (1 if planar == 1 else samples):
        raise ValueError("strips or tiles are missing")
    image = np.zeros((height, width, samples), dtype=kind)
    for i in range(across * down * (1 if planar == 1 else samples)):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, height - y)
        need = rows * tw * lanes * deep
        raw = data[places[i] : places[i] + sizes[i]]
        raw = decompress(raw.translate(_REVERSED) if fill == 2 else raw, codec, need)
        if len(raw) < need:
            raise ValueError(f"strip or tile {i} is short")
        if predictor == 3:
            flat = np.frombuffer(raw[:need], dtype=np.uint8).reshape(rows, tw * deep, lanes)
            flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, deep, tw * lanes)
            part = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">u{deep}").reshape(rows, tw, lanes).astype(kind)
        else:
            part = np.frombuffer(raw[:need], dtype=kind).reshape(rows, tw, lanes)
            if predictor == 2:
                part = np.cumsum(part.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
        fit = part[: height - y, : width - x]
        image[y : y + fit.shape[0], x : x + fit.shape[1], (slice(None) if planar == 1 else slice(plane, plane + 1))] = fit
    return {
        "width": width, "height": height, "bits": bits, "samples_per_pixel": samples, "compression": codec, "predictor": predictor,
        "samples": image.astype(kind.newbyteorder("<")).tobytes(), "error": None,
    }


def features(counts: np.ndarray) -> str:
    """Mean, deviation and entropy of 8-bit samples by how often each occurs, and the shares of eight equal ranges, as fixed decimals."""
    share = counts / max(1, counts.sum())
    values = np.arange(256)
    mean = int(counts @ values) / max(1, int(counts.sum()))
    deviation = math.sqrt(max(0.0, float(share @ (values - mean) ** 2)))
    live = share[share > 0]
    entropy = -float(live @ np.log2(live)) if len(live) else 0.0
    return f"mean={mean:.3f};sd={deviation:.3f};entropy={abs(entropy):.4f};bands=" + "/".join(f"{v:.4f}" for v in counts.reshape(8, 32).sum(1) / max(1, counts.sum()))


#: Bytes of the largest page that is decoded.
MAX_PAGE_BYTES = 256 << 20
_BLANK = dict.fromkeys(("width", "height", "bits", "samples_per_pixel", "compression", "predictor", "samples", "feature"))


def _pages(data: bytes, max_page_bytes: int) -> Iterator[dict]:
    try:
        for order, tags in directories(data):
            try:
                got = page(data, order, tags, max_page_bytes)
            except (ValueError, KeyError, TypeError, IndexError, zlib.error, struct.error, MemoryError) as error:
                got = _BLANK | {"error": f"{type(error).__name__}: {error}"}
            yield got
    except (ValueError, struct.error) as error:
        yield _BLANK | {"error": f"{type(error).__name__}: {error}"}


def read(data: bytes, max_page_bytes: int = MAX_PAGE_BYTES) -> Iterator[dict]:
    """One dict per page of a file, decoded one after another; so_far_* are of all samples up to the page, null once a page has failed, and
    ``last`` marks the last page."""
    size, digest, tail, counts, whole, held = 0, hashlib.sha256(), b"", np.zeros(256, dtype=np.int64), True, None
    for got in _pages(data, max_page_bytes):
        if held is not None:
            yield held | {"last": False}
        whole = whole and got["error"] is None
        if got["error"] is None:
            here = np.bincount(np.frombuffer(got["samples"], dtype=np.uint8), minlength=256)
            got["feature"] = features(here)
            counts, size, tail = counts + here, size + len(got["samples"]), (tail + got["samples"][-64:])[-64:]
            digest.update(got["samples"])
        told = (size, digest.hexdigest(), tail, features(counts)) if whole else (None,) * 4
        held = got | dict(zip(("so_far_bytes", "so_far_sha256", "so_far_tail", "so_far_feature"), told))
    if held is not None:
        yield held | {"last": True}


# ---------------------------------------------------------------- DataFrames


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """gm_id, n_bytes and media: each text, padded with zero bytes to a positive multiple of 64, as a TIFF file by ``layout`` or the given options of ``write``."""
    small_batches(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    kind = rows.schema["gm_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [v.as_py() or b"" for v in batch.column(1).cast(pa.binary())]
            padded = [t + bytes(-len(t) % 64 if t else 64) for t in raw]
            files = [write(t, **(options or layout(len(t)))) for t in padded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())], names=["gm_id", "n_bytes", "media"])

    return rows.mapInArrow(work, f"gm_id {kind}, n_bytes long, media binary")


_FIELDS = {
    "width": "long", "height": "long", "bits": "long", "samples_per_pixel": "long", "compression": "long", "predictor": "long", "samples": "binary", "feature": "string", "error": "string",
    "so_far_bytes": "long", "so_far_sha256": "string", "so_far_tail": "binary", "so_far_feature": "string", "last": "boolean",
}
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def pages(df: DataFrame, media_col: str = "media", max_page_bytes: int = MAX_PAGE_BYTES, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per page of every TIFF file in ``media_col``: ``of``, a struct of the other columns of ``df``, media_bytes and media_sha256 of the
    file, page (from 0), and the fields of ``read``."""
    small_batches(df.sparkSession)
    place = df.columns.index(media_col)
    others = [f for f in df.schema if f.name != media_col]
    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others)
    schema = (f"of struct<{inner}>, " if others else "") + "media_bytes long, media_sha256 string, page int, " + ", ".join(f"{n} {t}" for n, t in _FIELDS.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for i, c in enumerate(batch.columns) if i != place]
            of = [pa.StructArray.from_arrays(kept, [f.name for f in others])] if others else []

            def pack(rows: list[tuple]) -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())]
                columns += [pa.array([r[4][n] for r in rows], _ARROW[t]) for n, t in _FIELDS.items()]
                return pa.RecordBatch.from_arrays([*[c.take(at) for c in of], *columns], names=[*["of"][: len(of)], "media_bytes", "media_sha256", "page", *_FIELDS])

            rows: list[tuple] = []
            held = 0
            for i, value in enumerate(batch.column(place)):
                data = value.as_py()
                if data is None:
                    continue
                name = hashlib.sha256(data).hexdigest()
                for number, got in enumerate(read(data, max_page_bytes)):
                    rows.append((i, len(data), name, number, got))
                    held += len(got["samples"] or b"")
                    if held >= batch_bytes:
                        yield pack(rows)
                        rows, held = [], 0
            yield pack(rows)

    return df.mapInArrow(work, schema)


def op4_tiff(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF file by ``layout`` in the shared folder, read back page by page and digested at its last page."""
    kept, _ = stored(media(documents(spark, sf_dir)), "media")
    return pages(kept).filter("last").select(
        F.col("of.gm_id").alias("doc_id"), F.col("of.n_bytes").alias("n_bytes"), F.col("so_far_bytes").alias("payload_bytes"), F.col("so_far_sha256").alias("payload_sha256"),
        F.crc32("so_far_tail").alias("tail_crc32"), "media_bytes", "media_sha256", F.col("so_far_feature").alias("feature"),
    )
