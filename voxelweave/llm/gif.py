"""GIF media columns: LZW, palettes, disposal, transparency, timed frames and colour histograms.

``read`` decodes any GIF87a or GIF89a stream into frames: the frame's own samples, and the canvas after composing them
under the disposal and transparency rules. ``write`` stores 8-bit samples losslessly. The writer clears the code table
before the codes would need a tenth bit, which makes packing a vector operation; the reader decodes full LZW with
growing codes, deferred clears included, and takes a vector path for code runs in which every code stands for itself.

Defined cases: null payloads count as empty and store one row of zeros; repeated rows agree; a very long text takes as many
frames as it fills; a damaged stream raises ValueError in ``read`` and gives null columns in ``media_columns``, which
raises if its own column names are taken; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import kernel, slices

WIDTH, ROWS, DELAY_CS, LITERALS = 64, 1024, 4, 254
GREY = bytes(v for k in range(256) for v in (k, k, k))


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # rows x columns of palette indexes
    palette: np.ndarray  # colours x 3
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None
    canvas: np.ndarray | None = None  # rows x columns x RGBA, after composing


# ---------------------------------------------------------------- LZW


def pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of these widths, lowest bit first."""
    if len(codes) and widths[0] == widths[-1] and (widths == widths[0]).all():
        w = int(widths[0])
        bits = (codes[:, None].astype(np.uint16) >> np.arange(w, dtype=np.uint16)) & 1
        return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    total, at = int(widths.sum()), np.cumsum(widths) - widths
    bits = np.zeros(total, np.uint8)
    for k in range(int(widths.max(initial=0))):
        has = widths > k
        bits[at[has] + k] = (codes[has] >> k) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_literal(samples: np.ndarray) -> bytes:
    """8-bit samples as 9-bit literals with a clear code before each LITERALS of them."""
    n = len(samples)
    groups = -(-n // LITERALS)
    codes = np.full((groups, LITERALS + 1), 256, np.uint16)
    flat = np.zeros(groups * LITERALS, np.uint16)
    flat[:n] = samples
    codes[:, 1:] = flat.reshape(groups, LITERALS)
    codes = np.append(codes.ravel()[: n + groups], [257]).astype(np.uint16)
    return pack(codes, np.full(len(codes), 9))


def lzw_compress(samples: bytes, low: int = 8) -> bytes:
    """The usual greedy LZW, for callers that prefer small streams to speed."""
    clear, codes, widths = 1 << low, [1 << low], [low + 1]
    table: dict[tuple[int, int], int] = {}
    nxt, width, code = clear + 2, low + 1, None
    for s in samples:
        if code is None:
            code = s
        elif (known := table.get((code, s))) is not None:
            code = known
        else:
            codes.append(code)
            widths.append(width)
            if nxt < 4096:
                table[code, s] = nxt
                width += nxt == 1 << width and width < 12
                nxt += 1
            else:
                codes.append(clear)
                widths.append(width)
                table.clear()
                nxt, width = clear + 2, low + 1
            code = s
    if code is not None:
        codes.append(code)
        widths.append(width)
        width += nxt == 1 << width and width < 12
    codes.append(clear + 1)
    widths.append(width)
    return pack(np.array(codes), np.array(widths))


def lzw_decode(data: bytes, low: int, most: int) -> bytes:
    """Up to ``most`` samples."""
    clear = 1 << low
    if low == 8 and (fast := literal_runs(data, most)) is not None:
        return fast
    out, base = [], [bytes([k]) for k in range(clear)] + [b"", b""]
    table, width, last, made = list(base), low + 1, None, 0
    acc = bits = 0
    for byte in data:
        acc |= byte << bits
        bits += 8
        while bits >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            bits -= width
            if code == clear:
                table, width, last = list(base), low + 1, None
                continue
            if code == clear + 1:
                return b"".join(out)[:most]
            if last is None:
                if code >= clear:
                    raise ValueError("a code before any sample")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table) and len(table) < 4096:
                    entry = last + last[:1]
                else:
                    raise ValueError("a code outside the table")
                if len(table) < 4096:
                    table.append(last + entry[:1])
            width += len(table) == 1 << width and width < 12
            out.append(entry)
            made += len(entry)
            last = entry
            if made >= most:
                return b"".join(out)[:most]
    return b"".join(out)[:most]


def literal_runs(data: bytes, most: int) -> bytes | None:
    """The samples, if all codes are 9-bit literals, clears, or the end code; else None."""
    whole = len(data) // 9 * 9
    groups = np.frombuffer(data, np.uint8)
    tail = np.zeros(9, np.uint8)
    tail[: len(data) - whole] = groups[whole:]
    nine = np.concatenate([groups[:whole], tail]).reshape(-1, 9).astype(np.uint16)
    k = np.arange(8)
    codes = (((nine[:, :8] >> k) | (nine[:, 1:] << (8 - k))) & 511).ravel()[: len(data) * 8 // 9]
    ends = np.flatnonzero(codes == 257)
    if not len(ends):
        return None
    codes = codes[: ends[0]]
    if not len(codes) or codes[0] != 256 or codes.max() > 256:
        return None
    clears = np.append(np.flatnonzero(codes == 256), len(codes))
    if np.diff(clears).max() > LITERALS + 1:  # the table would have grown past nine bits
        return None
    return codes[codes != 256].astype(np.uint8).tobytes()[:most]


# ---------------------------------------------------------------- container


def sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    rows = np.empty((whole // 255, 256), np.uint8)
    rows[:, 0] = 255
    rows[:, 1:] = np.frombuffer(data, np.uint8)[:whole].reshape(-1, 255)
    rest = data[whole:]
    return rows.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def write(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS, palette: bytes = GREY, small: bool = False) -> bytes:
    """A GIF89a whose frames hold the samples row by row, ``rows`` rows each but for the last."""
    lines = len(samples) // width
    if not lines or len(samples) % width:
        raise ValueError("samples must fill one or more rows")
    u16 = lambda x: x.to_bytes(2, "little")
    out = [b"GIF89a", u16(width), u16(min(rows, lines)), b"\xf7\0\0", palette]
    for at in range(0, lines, rows):
        part = samples[at * width : (at + rows) * width]
        out += [b"\x21\xf9\x04\x04", u16(delay_cs), b"\0\0", b"\x2c", u16(0), u16(0), u16(width), u16(len(part) // width), b"\0\x08"]
        out.append(sub_blocks(lzw_compress(part) if small else lzw_literal(np.frombuffer(part, np.uint8))))
    return b"".join(out) + b"\x3b"


def read(data: bytes, compose: bool = True) -> tuple[int, int, list[Frame]]:
    """width, height, frames. With compose, each frame has the RGBA canvas shown during its delay."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    flags, at = data[10], 13

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise ValueError("a palette is cut off")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("a block is cut off")
            n = data[at]
            if not n:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    shared = None
    if flags & 0x80:
        shared, at = colours(flags, at)
    frames: list[Frame] = []
    control = (0, 0, None)
    while True:
        if at >= len(data):
            raise ValueError("no trailer")
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            body, end = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                control = (int.from_bytes(body[1:3], "little") * 10, body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
            at = end
        elif kind == 0x2C:
            left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            own, at = data[at + 9], at + 10
            palette = shared
            if own & 0x80:
                palette, at = colours(own, at)
            low = data[at]
            body, at = blocks(at + 1)
            samples = np.frombuffer(lzw_decode(body, low, w * h), np.uint8)
            if len(samples) < w * h:
                raise ValueError("a frame lacks samples")
            samples = samples.reshape(h, w)
            if own & 0x40:  # interlaced: rows 0, 8, ..., then 4, 12, ..., 2, 6, ..., 1, 3, ...
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            frames.append(Frame(left, top, samples, palette if palette is not None else np.frombuffer(GREY, np.uint8).reshape(256, 3), *control))
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")
    if compose:
        composed(width, height, frames)
    return width, height, frames


def composed(width: int, height: int, frames: list[Frame]) -> None:
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.samples.shape
        ys, xs = slice(f.top, min(f.top + h, height)), slice(f.left, min(f.left + w, width))
        seen = f.samples[: max(0, ys.stop - f.top), : max(0, xs.stop - f.left)]
        colour = np.full((*seen.shape, 4), 255, np.uint8)
        colour[..., :3] = f.palette[np.minimum(seen, len(f.palette) - 1)]
        if f.transparent is None:
            canvas[ys, xs] = colour
        else:
            shown = seen != f.transparent
            canvas[ys, xs][shown] = colour[shown]
        f.canvas = canvas.copy()
        if f.disposal == 2:
            canvas[ys, xs] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(f: Frame, bins: int = 4) -> list[int]:
    """Counts of the shown colours in bins x bins x bins cells of RGB; transparent pixels are left out."""
    rgba = f.canvas.reshape(-1, 4)
    rgb = rgba[rgba[:, 3] > 0, :3].astype(np.int32) * bins // 256
    return np.bincount((rgb[:, 0] * bins + rgb[:, 1]) * bins + rgb[:, 2], minlength=bins**3).tolist()


# ---------------------------------------------------------------- DataFrames

FRAMES = "array<struct<frame: int, at_ms: long, delay_ms: int, left: int, top: int, width: int, height: int, disposal: int, transparent: int, histogram: array<long>, rgba: binary>>"


def media_columns(df: DataFrame, gif_col: str = "gif", keep_pixels: bool = False) -> DataFrame:
    """df with width, height and timed frames of its GIF column; null where the bytes are null or damaged."""
    at, names = df.columns.index(gif_col), df.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    if {"gif_width", "gif_height", "gif_frames"} & set(names):
        raise ValueError("df has a column gif_width, gif_height or gif_frames already")

    def one(data):
        try:
            width, height, frames = read(data)
        except (ValueError, TypeError, IndexError):
            return None, None, None
        out, now = [], 0
        for k, f in enumerate(frames):
            out.append({"frame": k, "at_ms": now, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.samples.shape[1], "height": f.samples.shape[0], "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(f), "rgba": f.canvas.tobytes() if keep_pixels else None})
            now += f.delay_ms
        return width, height, out

    frame_type = pa.list_(pa.struct([("frame", pa.int32()), ("at_ms", pa.int64()), ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("histogram", pa.list_(pa.int64())), ("rgba", pa.binary())]))

    def run(batches):
        for b in slices(batches, 32):
            found = [one(x) for x in b.column(at).to_pylist()]
            extra = [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], frame_type)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*names, "gif_width", "gif_height", "gif_frames"])

    return kernel(df, run, f"{fields}, gif_width int, gif_height int, gif_frames {FRAMES}")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a GIF, read back from its bytes.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with keep_media
    the GIF itself. feature: frames, total delay, and the pixels of all composed frames in each cell of the colour
    histogram that has any.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def one(text):
        raw = (text or "").encode("utf-8", "replace")
        media = write(raw + bytes(max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)))
        frames = read(media)[2]
        back = b"".join(f.samples.tobytes() for f in frames)
        colours = np.sum([histogram(f, 8) for f in frames], axis=0)
        cells = np.flatnonzero(colours)
        feature = f"frames={len(frames)};ms={sum(f.delay_ms for f in frames)};rgb=" + ",".join(f"{k:03o}:{n}" for k, n in zip(cells.tolist(), colours[cells].tolist()))
        row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*row, media) if keep_media else row

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] * keep_media)]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in slices(batches):
            found = list(zip(*map(one, b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], names=names)

    return kernel(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
