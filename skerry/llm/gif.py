"""GIF as a media column: LZW both ways, palettes, disposal, transparency, timed frames with colour histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS, DELAY_CS = 64, 1024, 4


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """Code stream of samples, with a clear code at the start and whenever the table is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    acc, have, out = clear, bits + 1, bytearray()
    width, size, table = bits + 1, end + 1, {}
    if not data:
        acc |= end << have
        have += width
        return (acc).to_bytes(-(-have // 8), "little")
    code = data[0]
    get = table.get
    for c in memoryview(data)[1:]:
        key = code << 8 | c
        found = get(key)
        if found is not None:
            code = found
            continue
        acc |= code << have
        have += width
        if have >= 4096:
            out += (acc & ((1 << (have & ~7)) - 1)).to_bytes(have >> 3, "little")
            acc >>= have & ~7
            have &= 7
        table[key] = size
        if size == 1 << width:
            width += 1
        size += 1
        if size == 4096:
            acc |= clear << have
            have += width
            table = {}
            get = table.get
            width, size = bits + 1, end + 1
        code = c
    acc |= code << have
    have += width
    if size == 1 << width and width < 12:
        width += 1
    acc |= end << have
    have += width
    return bytes(out) + acc.to_bytes(-(-have // 8), "little")


@cache
def _code_widths(bits: int):
    """Of the codes after a clear code: their widths, and where in the stream they begin."""
    import numpy as np

    end = (1 << bits) + 1
    widths = np.array([max(bits + 1, min(12, (end + 1 + max(0, k - 1)).bit_length())) for k in range(4096)])
    return widths, np.concatenate([[0], np.cumsum(widths)])


def lzw_decode(stream: bytes, bits: int, limit: int | None = None) -> bytes:
    """Samples of a code stream. Codes between two clear codes have widths that only their number fixes, so numpy cuts out a table's worth at a time."""
    import numpy as np

    clear, end = 1 << bits, (1 << bits) + 1
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    widths, offsets = _code_widths(bits)
    raw = np.frombuffer(stream + bytes(8), np.uint8)
    at, total, out, last = 0, 8 * len(stream), [], None
    table, full = list(roots), False
    while at < total:
        if full:  # the encoder defers the clear code: 12 bits a code, and the table stays
            n, where, wide = (total - at) // 12, at + 12 * np.arange((total - at) // 12), 4095
        else:
            n = min(4096, int(np.searchsorted(offsets, total - at, "right")) - 1)
            where, wide = at + offsets[:n], (1 << widths[:n]) - 1
        if n <= 0:
            break
        byte = where >> 3
        codes = (raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2].astype(np.int64) << 16) >> (where & 7) & wide
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        todo = codes[:stop].tolist()
        add, emit = table.append, out.append
        if todo and last is None:
            last = table[todo[0]]
            emit(last)
            del todo[0]
        try:
            if full:
                for c in todo:
                    emit(table[c])
            else:
                for c in todo:
                    try:
                        entry = table[c]
                        add(last + entry[:1])
                    except IndexError:
                        add(last + last[:1])
                        entry = table[c]
                    emit(entry)
                    last = entry
        except IndexError:
            raise ValueError("a code that isn't in the table yet") from None
        if stop < n and codes[stop] == end or stop == n < 4096:
            break
        if stop == n:
            at, full = at + (12 * n if full else int(offsets[n])), True
            del table[4096:]
        else:
            at += 12 * (stop + 1) if full else int(offsets[stop + 1])
            table, full, last = list(roots), False, None
    data = b"".join(out)
    return data if limit is None else data[:limit]


@cache
def grey_palette() -> bytes:
    return bytes(v for k in range(256) for v in (k, k, k))


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """Samples (a positive multiple of width) as timed frames of at most `rows` rows over a grey palette, each frame left in place under the next."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, len(samples) // width), 0xF7, 0, 0), grey_palette()]
    for k in range(0, len(samples), width * rows):
        part = samples[k : k + width * rows]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _sub_blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    samples: bytes
    palette: bytes
    transparent: int | None
    disposal: int
    delay_cs: int


def parse_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Screen width, height and the frames as stored. Raises ValueError for what isn't a whole GIF."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut short") from e


def _parse(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, b""
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = data[at : at + n], at + n
    frames, control = [], (0, 0, None)

    def blocks(at: int) -> tuple[bytes, int]:
        out = []
        while data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        return b"".join(out), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                f, delay, key = struct.unpack_from("<BHB", body)
                control = (f >> 2 & 7, delay, key if f & 1 else None)
        elif data[at] == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if f & 0x80:
                n = 3 << ((f & 7) + 1)
                palette, at = data[at : at + n], at + n
            bits = data[at]
            stream, at = blocks(at + 1)
            samples = lzw_decode(stream, bits, w * h)
            if len(samples) < w * h:
                raise ValueError("a frame lacks samples")
            if f & 0x40:
                rows = [samples[k * w : (k + 1) * w] for k in range(h)]
                order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
                placed = [b""] * h
                for y, r in zip(order, rows, strict=True):
                    placed[y] = r
                samples = b"".join(placed)
            frames.append(Frame(left, top, w, h, samples, palette, control[2], control[0], control[1]))
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")
    return width, height, frames


def composite(width: int, height: int, frames: list[Frame]) -> Iterator:
    """Each frame as it is seen: an array of height x width x 4 (red, green, blue, opacity), palettes, transparency and the disposal of the frame before applied. It is overwritten by the next."""
    import numpy as np

    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        palette = np.zeros((256, 4), np.uint8)
        rgb = np.frombuffer(f.palette, np.uint8).reshape(-1, 3)
        palette[: len(rgb), :3] = rgb
        palette[:, 3] = 255
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        samples = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[:h, :w]
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        if f.transparent is None:
            area[:] = palette[samples]
        else:
            shown = samples != f.transparent
            area[shown] = palette[samples[shown]]
        yield canvas
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas[:] = before


def histogram(canvas) -> list[int]:
    """Opaque pixels in 8 equal bins each of red, green and blue."""
    import numpy as np

    seen = canvas[canvas[:, :, 3] > 0]
    return [int(x) for c in range(3) for x in np.bincount(seen[:, c] >> 5, minlength=8)]


FRAMES = "frame int, start_ms long, delay_ms long, width int, height int, histogram array<long>"


def decode_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, frame, start_ms, delay_ms, width, height, histogram) for each frame of each GIF: 8 bins each of red, green and blue. A null, empty or broken file has no frames; a GIF without frames has none either. Rows that repeat give their frames again; extra columns are left alone."""
    import pyarrow as pa

    key = media.select(F.col(id_col).alias("id")).schema[0]

    def run(batches):
        for b in batches:
            ids, cols = [], [[] for _ in range(6)]
            for i, m in zip(b.column(0), b.column(1), strict=True):
                try:
                    w, h, frames = parse_gif(m.as_py() or b"")
                except ValueError:
                    continue
                start = 0
                for k, (f, canvas) in enumerate(zip(frames, composite(w, h, frames), strict=True)):
                    for c, x in zip(cols, (k, start, 10 * f.delay_cs, w, h, histogram(canvas)), strict=True):
                        c.append(x)
                    ids.append(i)
                    start += 10 * f.delay_cs
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [key.name, "frame", "start_ms", "delay_ms", "width", "height", "histogram"])

    return media.select(F.col(id_col).alias("id"), media_col).mapInArrow(run, f"id {key.dataType.simpleString()}, {FRAMES}").withColumnRenamed("id", id_col)


def store_as_gif(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media binary, media_bytes, media_sha256, n_frames, duration_ms, feature).

    A text's UTF-8 bytes (null: none), padded with bytes 0 to a positive multiple of 64, are the samples of a GIF of 64 columns; the payload columns come from the GIF read back. feature: frames, duration in ms, then the histogram of all frames' levels in 8 bins. Rows that repeat are stored each; an empty table gives an empty table.
    """
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "media_bytes", "media_sha256", "n_frames", "duration_ms", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]

    def row(text):
        import hashlib
        import zlib

        raw = text.encode() if text else b""
        media = encode_gif(raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)))
        w, h, frames = parse_gif(media)
        payload = b"".join(f.samples for f in frames)
        levels = [0] * 8
        for canvas, f in zip(composite(w, h, frames), frames, strict=True):
            for k, x in enumerate(histogram(canvas[: f.height])[:8]):
                levels[k] += x
        ms = 10 * sum(f.delay_cs for f in frames)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), media, len(media), hashlib.sha256(media).hexdigest(), len(frames), ms, f"{len(frames)}:{ms}:" + ",".join(map(str, levels))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = list(zip(*[row(t.as_py()) for t in part.column(1)], strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(rows, types[1:], strict=True)]], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, n_frames int, duration_ms long, feature string")


def op4_gif(spark, sf_dir: str) -> DataFrame:
    return store_as_gif(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("media", "n_frames", "duration_ms")
