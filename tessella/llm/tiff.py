"""TIFF media columns (operator 5): write payloads as multi-page TIFF, walk and decode TIFF files page by page.

The reader follows the chain of image directories in either byte order, takes strips or tiles, chunky or planar samples of
1, 4, 8 or 16 bits in either bit order, decodes PackBits, LZW, deflate or plain data, undoes horizontal differencing and
yields one page at a time. Not read: the fax and JPEG codings, and samples of unequal or other widths. A page's samples are
never larger than what its file could hold at its coding's best ratio, and all of them come from the file: a strip or
tile that is missing is a fault. A broken file yields the pages before the fault and then a row that names it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.simhash_kernel import sliced
from tessella.llm.tables import table

# Tag numbers, compression codes and field sizes of the format.
WIDTH_TAG, LENGTH_TAG, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 266, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I"}

ROW = 576  # samples in a row of a stored payload
PAGE_ROWS = 256
PAD = 255
_BATCH = 4 << 20
#: Bytes that a stored byte can stand for: 128 in two for runs, 258 in two bits of deflate, strings of under 4096 in an LZW code of 12 bits.
_RATIO = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 2731}
_FAULTS = (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error, zlib.error, MemoryError)
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def packbits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    raw = np.frombuffer(data, np.uint8)
    # starts of runs of three equal bytes or more
    same = raw[1:] == raw[:-1]
    runs = np.flatnonzero(same[1:] & same[:-1] & np.r_[True, ~same[:-2]]).tolist() if n > 2 else []
    for start in [*runs, n]:
        while at < start:
            piece = data[at : min(start, at + 128)]
            out += bytes([len(piece) - 1]) + piece
            at += len(piece)
        while at < n and start < n and data[at] == data[start]:
            stop = at + 1
            while stop < n and stop - at < 128 and data[stop] == data[start]:
                stop += 1
            out += bytes([257 - (stop - at)]) + data[at : at + 1] if stop - at > 1 else bytes([0]) + data[at : at + 1]
            at = stop
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early; 256 clears, 257 ends."""
    codes, table, width, held = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    nxt = 258
    for i in range(len(data)):
        more = held + data[i : i + 1]
        if more in table:
            held = more
            continue
        codes.append((table[held], width))
        table[more] = nxt
        nxt += 1
        if nxt == 4094:
            codes.append((256, width))
            table, width, nxt = {bytes([k]): k for k in range(256)}, 9, 258
        elif nxt > (1 << width) - 1:
            width += 1
        held = data[i : i + 1]
    if held:
        codes.append((table[held], width))
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    codes.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def unlzw(data: bytes, size: int) -> bytes:
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, width, acc, have, done = [], None, 9, 0, 0, 0
    for byte in data:
        acc = (acc << 8) | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = acc >> have
        acc &= (1 << have) - 1
        if code == 256:
            del table[258:]
            width, before = 9, None
            continue
        if code == 257:
            break
        if before is None:
            if code >= len(table):
                raise ValueError("LZW code beyond the table")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("LZW code beyond the table")
            table.append(before + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        done += len(entry)
        before = entry
        if done >= size:
            break
    return b"".join(out)


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = block.copy()
        block[:, 1:] -= block[:, :-1].copy()
    data = block.tobytes()
    return {NONE: lambda d: d, DEFLATE: lambda d: zlib.compress(d, 6), LZW: lzw, PACKBITS: packbits}[compression](data)


def encode_tiff(payload: bytes, compression: int | None = None, predictor: int | None = None, tiled: bool | None = None) -> bytes:
    """8-bit gray pages of ``ROW`` x up to ``PAGE_ROWS``; len(payload) is a multiple of ``ROW``. Equal payloads give equal files.

    Left open, the payload's checksum picks the coding: mostly deflate strips, else deflate tiles with differencing,
    PackBits strips or (short payloads) LZW strips with differencing.
    """
    pick = zlib.crc32(payload) % 16 if compression is None else -1
    if pick >= 0:
        compression, predictor, tiled = DEFLATE, 1, False
        if pick == 1:
            predictor, tiled = 2, True
        elif pick == 2:
            compression = PACKBITS
        elif pick == 3 and len(payload) <= 16 * ROW:
            compression, predictor = LZW, 2
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    out = bytearray(b"II*\x00\x00\x00\x00\x00")
    link = 4
    for top in range(0, len(image), PAGE_ROWS):
        page = image[top : top + PAGE_ROWS]
        if tiled:
            side = 64
            padded = np.pad(page, ((0, -len(page) % side), (0, -ROW % side)), constant_values=PAD)
            blocks = [padded[y : y + side, x : x + side] for y in range(0, len(padded), side) for x in range(0, padded.shape[1], side)]
        else:
            blocks = [page[y : y + 128] for y in range(0, len(page), 128)]
        offsets, sizes = [], []
        for block in blocks:
            data = _packed(np.ascontiguousarray(block), compression, predictor or 1)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\x00" * (len(data) % 2)
        fields = [(WIDTH_TAG, 4, [ROW]), (LENGTH_TAG, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1])]
        if tiled:
            fields += [(SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor or 1]), (TILE_WIDTH, 3, [64]), (TILE_LENGTH, 3, [64]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [128]), (STRIP_COUNTS, 4, sizes), (PREDICTOR, 3, [predictor or 1])]
        entries = b""
        for tag, kind, values in fields:
            raw = struct.pack(f"<{len(values)}{FIELD_CODES[kind]}", *values)
            if len(raw) > 4:
                place, raw = len(out), b""
                out += struct.pack(f"<{len(values)}{FIELD_CODES[kind]}", *values)
                raw = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\x00")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\x00\x00\x00\x00"
    return bytes(out)


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    data: bytes


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for i in range(count):
        place = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, place)
        if kind in FIELD_CODES:
            if FIELD_BYTES[kind] * n > len(data):
                raise ValueError("a field is longer than the file")
            where = place + 8 if FIELD_BYTES[kind] * n <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
            fields[tag] = list(struct.unpack_from(f"{order}{n}{FIELD_CODES[kind]}", data, where))
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)[0]


def _block(data: bytes, compression: int, predictor: int, rows: int, cols: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Samples of a strip or tile, rows x cols x samples; rows of less than a byte a sample end with a whole byte."""
    per_row = -(-cols * samples * bits // 8)
    size = rows * per_row
    if compression == NONE:
        raw = data
    elif compression == PACKBITS:
        raw = unpackbits(data, size)
    elif compression == LZW:
        raw = unlzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(data, size) if size else b""
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(raw) < size:
        raise ValueError("a strip or tile is too short")
    if bits < 8:
        if predictor != 1:
            raise ValueError("differencing is for 8 and 16 bits")
        parts = np.frombuffer(raw[:size], np.uint8).reshape(rows, per_row)
        parts = np.unpackbits(parts, axis=1) if bits == 1 else np.stack([parts >> 4, parts & 15], axis=2).reshape(rows, -1)
        return parts[:, : cols * samples].reshape(rows, cols, samples)
    block = np.frombuffer(raw[:size], dtype=np.dtype(f"{order}u{bits // 8}")).reshape(rows, cols, samples)
    if predictor == 2:
        block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return block


def _image(data: bytes, f: dict[int, list[int]], order: str) -> tuple[np.ndarray, int]:
    """(height x width x samples, bits a sample) of one directory."""
    width, height, samples = f[WIDTH_TAG][0], f[LENGTH_TAG][0], f.get(SAMPLES, [1])[0]
    widths, compression, predictor, planar = set(f.get(BITS, [1])), f.get(COMPRESSION, [1])[0], f.get(PREDICTOR, [1])[0], f.get(PLANAR, [1])[0]
    if len(widths) != 1 or not widths <= {1, 4, 8, 16} or planar not in (1, 2):
        raise ValueError("only equal samples of 1, 4, 8 or 16 bits are supported")
    (bits,) = widths
    if compression not in _RATIO:
        raise ValueError(f"compression {compression} isn't supported")
    if not (width and height and samples):
        raise ValueError("an image without samples")
    tiled = TILE_OFFSETS in f
    wide, high = (f[TILE_WIDTH][0], f[TILE_LENGTH][0]) if tiled else (width, min(f.get(ROWS_PER_STRIP, [height])[0], height))
    if not (wide and high):
        raise ValueError("strips or tiles without samples")
    offsets, sizes = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
    across, down, planes = -(-width // wide), -(-height // high), samples if planar == 2 else 1
    if len(offsets) != len(sizes) or len(offsets) != across * down * planes:
        raise ValueError("strips or tiles are missing or too many")
    # every sample comes from stored bytes, so this bounds what is allocated before anything is
    for k, (start, n) in enumerate(zip(offsets, sizes, strict=True)):
        rows = high if tiled else min(high, height - k % (across * down) // across * high)
        stored = max(0, min(n, len(data) - start))
        if rows * -(-wide * (samples // planes) * bits // 8) > _RATIO[compression] * stored:
            raise ValueError("a strip or tile is larger than its bytes can hold")
    image = np.empty((height, width, samples), dtype=np.dtype(f"u{max(bits // 8, 1)}"))
    for k, (start, n) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(k, across * down)
        y, x = k // across * high, k % across * wide
        raw = data[start : start + n]
        if f.get(FILL_ORDER, [1])[0] == 2:
            raw = raw.translate(_TURNED)
        rows = high if tiled else min(high, height - y)
        block = _block(raw, compression, predictor, rows, wide, samples // planes, bits, order)
        image[y : y + rows, x : x + wide, plane if planes > 1 else slice(None)] = (block[..., 0] if planes > 1 else block)[: height - y, : width - x]
    return image, bits


def pages_of(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file in the order of its directories; one of ``_FAULTS`` at a fault. Samples under 8 bits take a byte each."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen, number = set(), 0
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        f, at = _directory(data, at, order)
        image, bits = _image(data, f, order)
        yield Page(number, image.shape[1], image.shape[0], image.shape[2], bits, image.tobytes())
        number += 1


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (…, media) to rows (…, item, page, width, height, samples, bits, data, error), a file's pages one after the other;
    the media itself is left out, so that a row holds one page."""
    item = 0
    for batch in batches:
        at, rows, size = [], [], 0

        others = batch.drop_columns(["media"])

        def flush(batch: pa.RecordBatch = others) -> pa.RecordBatch:
            more = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()], strict=True)]
            names = [*batch.schema.names, "item", "page", "width", "height", "samples", "bits", "data", "error"]
            return pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), *more], names)

        for i, media in enumerate(batch["media"]):
            number = 0
            try:
                for p in pages_of(media.as_py() or b""):
                    at.append(i)
                    rows.append((item, p.page, p.width, p.height, p.samples, p.bits, p.data, None))
                    number, size = number + 1, size + len(p.data)
                    if size >= _BATCH:
                        yield flush()
                        at, rows, size = [], [], 0
            except _FAULTS as e:
                at.append(i)
                rows.append((item, number, None, None, None, None, None, str(e) or type(e).__name__))
            item += 1
        if rows:
            yield flush()


PAGE_SCHEMA = "item bigint, page int, width int, height int, samples int, bits int, data binary, error string"


def tiff_pages(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per page: ``id, item, page, width, height, samples, bits, data, error``.

    item numbers the files of one partition. Null or broken media give a row with ``error`` and null samples, after
    the pages before the fault; repeated rows are decoded one by one; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(read_pages, f"id {kind}, {PAGE_SCHEMA}")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "media_bytes", "media_sha256", "media"]
    for batch in batches:
        at = 0
        for part in sliced(batch["text"]):
            media, lengths = [], []
            for text in part.cast(pa.large_binary()):
                data = text.as_py()
                lengths.append(len(data))
                media.append(encode_tiff(data + bytes([PAD]) * (-len(data) % ROW if data else ROW)))
            own = [pa.array(lengths, pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string())]
            yield pa.RecordBatch.from_arrays([batch["id"].slice(at, len(part)), *own, pa.array(media, pa.binary())], names)
            at += len(part)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media_bytes, media_sha256, media``: each text's UTF-8, padded with 255 to a positive multiple of 576, as a TIFF file; null counts as empty.

    Repeated rows and null ids are stored one by one, equal texts alike; an empty table gives an empty result; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_store, f"id {kind}, n_bytes bigint, media_bytes bigint, media_sha256 string, media binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the page rows of each file, which come one after the other, into one row."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    state, out = None, []

    def close() -> None:
        ident, n_bytes, media_bytes, media_sha256, pages, sha, size, tail, counts = state
        total = int((counts * np.arange(256)).sum())
        squares = int((counts * np.arange(256) ** 2).sum())
        feature = f"pages={pages};sum={total};squares={squares};distinct={int((counts > 0).sum())}"
        out.append((ident, n_bytes, size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha256, feature))

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    item = None
    for batch in read_pages(batches):
        for i in range(len(batch)):
            if batch["error"][i].as_py():
                raise ValueError(batch["error"][i].as_py())
            if batch["item"][i].as_py() != item:
                if state:
                    close()
                item = batch["item"][i].as_py()
                state = [*(batch[c][i].as_py() for c in ("id", "n_bytes", "media_bytes", "media_sha256")), 0, hashlib.sha256(), 0, b"", np.zeros(256, np.int64)]
            data = batch["data"][i].as_py()
            state[4] += 1
            state[5].update(data)
            state[6] += len(data)
            state[7] = (state[7] + data[-32:])[-32:]
            state[8] += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        kind = batch.schema.field("id").type
        if len(out) >= 1000:
            yield flush(kind)
            out = []
    if state:
        close()
    if out:
        yield flush(kind)


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF file and read back: digests of payload and file, and sums over the samples as feature."""
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return store_texts(docs).mapInArrow(_digest, schema)
