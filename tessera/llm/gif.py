"""Media columns: GIF. Decodes LZW code streams, applies palettes, disposal and transparency, and yields timed frames with colour histograms.

A payload is stored losslessly as 8-bit samples, 64 to a row, in frames of at most ``ROWS`` rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WIDTH, ROWS, DELAY = 64, 256, 4
FULL = 4096  # an LZW table's entries in GIF


@lru_cache(maxsize=16)
def widths(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the k-th code after a clear code, and their running sum: the table gets one entry with each code but the first."""
    k = np.arange(FULL + 1)
    n = (1 << least) + 1 + k
    w = np.minimum(np.maximum(np.floor(np.log2(n)).astype(np.int64) + 1, least + 1), 12)
    w[0] = least + 1
    return w, np.concatenate([[0], np.cumsum(w)])


def lzw_encode(samples: bytes) -> bytes:
    """LZW with clear codes, for 8-bit samples."""
    codes: list[int] = [256]
    cuts = [1]  # where the count of codes begins anew
    table: dict[int, int] = {}
    find, free, put = table.get, 258, codes.append
    rest = iter(samples)
    w = next(rest)
    for c in rest:
        key = w << 8 | c
        got = find(key)
        if got is not None:
            w = got
        else:
            put(w)
            w = c
            if free == FULL:
                put(256)
                cuts.append(len(codes))
                table.clear()
                free = 258
            else:
                table[key] = free
                free += 1
    put(w)
    put(257)
    w_of = np.empty(len(codes), np.int64)
    w_of[0] = 9
    for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True):
        w_of[a:b] = widths(8)[0][: b - a]
    code = np.array(codes, np.uint16)
    bits = np.arange(12, dtype=np.uint16)
    on = ((code[:, None] >> bits) & 1).astype(np.uint8)
    return np.packbits(on[bits < w_of[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """Samples of a code stream, at most ``most``. Codes between two clear codes have known places, so they are read all at once."""
    clear, first = 1 << least, [bytes([k]) for k in range(1 << least)] + [b"", b""]
    b = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    word = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16)
    w, at = widths(least)
    total, bit, out, n = 8 * len(stream), 0, [], 0
    table, prev, k0 = first[:], None, 0
    while n < most:
        if k0 >= FULL:  # a full table that is kept
            where = bit + 12 * np.arange(FULL)
            width = np.full(FULL, 12)
        else:
            where = bit + at[k0:-1] - at[k0]
            width = w[k0:]
        fits = int(np.searchsorted(where + width, total, "right"))
        if not fits:
            break
        where, width = where[:fits], width[:fits]
        codes = (word[where >> 3] >> (where & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        ends = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(ends[0]) if len(ends) else len(codes)
        for c in codes[:stop].tolist():
            if prev is None:
                e = table[c]
            elif c < len(table):
                e = table[c]
                if len(table) < FULL:
                    table.append(prev + e[:1])
            else:
                if c > len(table):
                    raise ValueError("code beyond the table")
                e = prev + prev[:1]
                if len(table) < FULL:
                    table.append(e)
            out.append(e)
            n += len(e)
            prev = e
        if len(ends):
            if codes[stop] == clear + 1:
                break
            bit, k0, table, prev = int(where[stop] + width[stop]), 0, first[:], None
        else:
            bit, k0 = int(where[-1] + width[-1]), k0 + len(codes)
    return b"".join(out)[:most]


def palette() -> np.ndarray:
    """256 colours as 0xRRGGBB: three bits of red, three of green and two of blue."""
    k = np.arange(256, dtype=np.uint32)
    return (k >> 5) * 36 << 16 | ((k >> 2 & 7) * 36) << 8 | (k & 3) * 85


def encode(payload: bytes) -> bytes:
    """A GIF of the payload, whose length is a positive multiple of ``WIDTH``."""
    rows = len(payload) // WIDTH
    height = min(rows, ROWS)
    colours = b"".join(struct.pack(">I", int(c))[1:] for c in palette())
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), colours]
    for top in range(0, rows, ROWS):
        n = min(ROWS, rows - top)
        data = lzw_encode(payload[top * WIDTH : (top + n) * WIDTH])
        out += [b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08"]
        for k in range(0, len(data), 255):
            out += [bytes([len(data[k : k + 255])]), data[k : k + 255]]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    """One timed picture: the frame's own samples, the whole canvas as 0xRRGGBB (at 1 << 24: nothing painted), when it begins and how long it stands, in 1/100 s."""

    samples: bytes
    canvas: np.ndarray
    start: int
    delay: int

    def histogram(self) -> np.ndarray:
        """Painted points of the canvas in 64 bins, two bits of each of red, green and blue."""
        c = self.canvas[self.canvas < 1 << 24]
        return np.bincount((c >> 22 << 4 | (c >> 14 & 3) << 2 | c >> 6 & 3).astype(np.int64), minlength=64)


def blocks(gif: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from ``at``, and what follows."""
    parts = []
    while (n := gif[at]) > 0:
        parts.append(gif[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def colour_table(gif: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    t = np.frombuffer(gif, np.uint8, 3 * n, at).astype(np.uint32).reshape(n, 3)
    return t[:, 0] << 16 | t[:, 1] << 8 | t[:, 2], at + 3 * n


def decode(gif: bytes) -> Iterator[Frame]:
    """Frames of any GIF87a or GIF89a stream."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", gif, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = colour_table(gif, at, flags)
    canvas = np.full((height, width), 1 << 24, np.uint32)
    disposal, clear_index, delay, clock = 0, None, 0, 0
    while at < len(gif) and gif[at] != 0x3B:
        kind = gif[at]
        if kind == 0x21:
            data, end = blocks(gif, at + 2)
            if gif[at + 1] == 0xF9:
                f, delay, index = struct.unpack_from("<BHB", data)
                disposal, clear_index = f >> 2 & 7, index if f & 1 else None
            at = end
        elif kind == 0x2C:
            x, y, w, h, f = struct.unpack_from("<HHHHB", gif, at + 1)
            at += 10
            colours = shared
            if f & 0x80:
                colours, at = colour_table(gif, at, f)
            data, end = blocks(gif, at + 1)
            samples = lzw_decode(data, gif[at], w * h)
            at = end
            index = np.frombuffer(samples + bytes(w * h - len(samples)), np.uint8).reshape(h, w)
            if f & 0x40:  # interlaced: rows come in four passes
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(order)]
            before = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + h, x : x + w]
            new = colours[np.minimum(index, len(colours) - 1)][: part.shape[0], : part.shape[1]]
            part[...] = new if clear_index is None else np.where(index[: part.shape[0], : part.shape[1]] == clear_index, part, new)
            yield Frame(samples, canvas.copy(), clock, delay)
            clock += delay
            if disposal == 2:
                part[...] = 1 << 24
            elif before is not None:
                canvas = before
            disposal, clear_index, delay = 0, None, 0
        else:
            raise ValueError(f"unknown block {kind:#x}")


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and media: the text's UTF-8 bytes (null: empty), padded with zeros to whole rows, as a GIF."""
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)]) + ", n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text", 1 << 21):
                media = [encode(padded(data[a:b].tobytes())) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return rows.mapInArrow(run, schema)


def frames(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each frame of each non-null medium: ``keep``, frame, start_cs, delay_cs, width, height and histogram (64 counts)."""
    rows = df.select(*keep, F.col(media).alias("__media"))
    kept = [f for f in rows.schema[: len(keep)]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", frame int, start_cs long, delay_cs int, width int, height int, histogram array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                if (gif := batch.column("__media")[row].as_py()) is None:
                    continue
                for k, f in enumerate(decode(gif)):
                    h, w = f.canvas.shape
                    values = [*(batch.column(c).slice(row, 1) for c in keep), pa.array([k], pa.int32()), pa.array([f.start], pa.int64()), pa.array([f.delay], pa.int32()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([f.histogram().tolist()], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(values, [*keep, "frame", "start_cs", "delay_cs", "width", "height", "histogram"])

    return rows.mapInArrow(run, schema)


FACTS = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_frames": "int"}


def facts(gif: bytes) -> tuple:
    """What ``FACTS`` names, from the stored bytes alone. feature: frames, 1/100 s they last, and the summed histogram in 64 bins."""
    payload, total, n, lasts = [], np.zeros(64, np.int64), 0, 0
    for f in decode(gif):
        payload.append(f.samples)
        total += f.histogram()
        n += 1
        lasts += f.delay
    raw = b"".join(payload)
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(gif), hashlib.sha256(gif).hexdigest(), f"{n}:{lasts}:" + ",".join(map(str, total.tolist())), n


def describe(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` and the facts of every stored medium; a null medium has null facts. One medium is held at a time."""
    rows = df.select(*keep, F.col(media).alias("__media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)]) + "".join(f", {k} {v}" for k, v in FACTS.items())
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [facts(m.as_py()) if m.is_valid else (None,) * len(FACTS) for m in batch.column("__media")]
            cols = list(zip(*got, strict=True)) if got else [()] * len(FACTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, kinds[t]) for c, t in zip(cols, FACTS.values(), strict=True))], [*keep, *FACTS])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every whole text of documents stored as a GIF and read back."""
    from .common import table

    return describe(store(table(spark, sf_dir, "documents")))
