"""Dominant colours of images.

PNG (8 bits, not interlaced), GIF (the first frame), ICO (its largest picture) and plain BMP are read with the standard
library; other formats if Pillow is installed, else they give no colours, as broken images do. Nearest pixels stand for an image that is larger than ``SIDE``.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE, OPAQUE, DARK, LIGHT = 200, 200, 20, 240
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """The rows of a PNG, each told as a difference from its left and upper neighbours."""
    line = width * channels
    rows = np.frombuffer(raw[: (line + 1) * height], np.uint8).reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.int32)
    for y in range(height):
        kind, data, up = rows[y, 0], rows[y, 1:].astype(np.int32), out[y]
        if kind == 0:
            out[y + 1] = data
        elif kind == 1:
            out[y + 1] = np.cumsum(data.reshape(width, channels), axis=0).ravel() & 255
        elif kind == 2:
            out[y + 1] = (data + up) & 255
        else:
            now = out[y + 1]
            for x in range(line):
                a, c = (now[x - channels], up[x - channels]) if x >= channels else (0, 0)
                if kind == 3:
                    guess = (a + up[x]) // 2
                else:
                    near = [(abs(up[x] - c), 0, a), (abs(a - c), 1, up[x]), (abs(a + up[x] - 2 * c), 2, c)]
                    guess = min(near)[2]
                now[x] = (data[x] + guess) & 255
    return out[1:].reshape(height, width, channels).astype(np.uint8)


def _png(raw: bytes) -> np.ndarray | None:
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", raw[16:29])
    if depth != 8 or interlaced or kind not in _CHANNELS or width * height > 50_000_000:
        return None
    at, data, palette, clear = 8, b"", None, b""
    while at + 8 <= len(raw):
        (size,), name = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if name == b"IDAT":
            data += body
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        at += size + 12
    pixels = _unfilter(zlib.decompress(data), width, height, _CHANNELS[kind])
    full = np.full((height, width, 1), 255, np.uint8)
    if kind == 3:
        if palette is None:
            return None
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        index = np.minimum(pixels[..., 0], len(palette) - 1)
        return np.concatenate([palette[index], alpha[index][..., None]], axis=2)
    if kind in (0, 4):
        return np.concatenate([np.repeat(pixels[..., :1], 3, axis=2), pixels[..., 1:] if kind == 4 else full], axis=2)
    return np.concatenate([pixels, full], axis=2) if kind == 2 else pixels


def _bmp(raw: bytes) -> np.ndarray | None:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", raw[10:34])
    if bits not in (24, 32) or packed not in (0, 3) or width <= 0:
        return None
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw[start : start + line * abs(height)], np.uint8).reshape(abs(height), line)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    return np.concatenate([rows[..., 2::-1], np.full((*rows.shape[:2], 1), 255, np.uint8)], axis=2)


def _unpacked(data: bytes, bits: int, most: int) -> bytes:
    """The colour numbers of a GIF's packed picture, at most ``most``: codes of growing length stand for earlier runs and one more number."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs: list[bytes] = []
    out = bytearray()
    width, held, kept, before = bits + 1, 0, 0, None
    for byte in data:
        held |= byte << kept
        kept += 8
        while kept >= width:
            code, held, kept = held & ((1 << width) - 1), held >> width, kept - width
            if code == clear:
                runs = [bytes((k,)) for k in range(clear)] + [b"", b""]
                width, before = bits + 1, None
            elif code == end or len(out) >= most:
                return bytes(out)
            elif before is None:
                out += runs[code]
                before = runs[code]
            else:
                run = runs[code] if code < len(runs) else before + before[:1]
                out += run
                if len(runs) < 4096:
                    runs.append(before + run[:1])
                    if len(runs) == 1 << width and width < 12:
                        width += 1
                before = run
    return bytes(out)


def _gif(raw: bytes) -> np.ndarray | None:
    def colours(at: int, flags: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 3 << ((flags & 7) + 1)
        return np.frombuffer(raw[at : at + n], np.uint8).reshape(-1, 3), at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += raw[at] + 1
        return b"".join(parts), at + 1

    palette, at = colours(13, raw[10])
    clear = None
    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            body, after = blocks(at + 2)
            if raw[at + 1] == 0xF9 and body[0] & 1:
                clear = body[3]
            at = after
            continue
        width, height, flags = struct.unpack("<HHB", raw[at + 5 : at + 10])
        own, at = colours(at + 10, flags)
        palette = own if own is not None else palette
        data, _ = blocks(at + 1)
        if palette is None or width * height > 50_000_000:
            return None
        # the order of interlaced rows doesn't change how often a colour occurs
        index = np.frombuffer(_unpacked(data, raw[at], width * height)[: width * height], np.uint8).reshape(height, width)
        alpha = np.where(index == clear, 0, 255).astype(np.uint8) if clear is not None else np.full((height, width), 255, np.uint8)
        return np.concatenate([palette[np.minimum(index, len(palette) - 1)], alpha[..., None]], axis=2)
    return None


def _ico(raw: bytes) -> np.ndarray | None:
    entries = [struct.unpack("<BBBBHHII", raw[6 + 16 * k : 22 + 16 * k]) for k in range(struct.unpack("<H", raw[4:6])[0])]
    *_, size, at = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5], e[6]))
    picture = raw[at : at + size]
    if picture[:4] == b"\x89PNG":
        return _png(picture)
    start, width, double, _, bits = struct.unpack("<IiiHH", picture[:16])
    height = double // 2  # the mask below the picture counts as well
    if bits not in (24, 32) or width <= 0 or height <= 0:
        return None
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(picture[start : start + line * height], np.uint8).reshape(height, line)[:, : width * bits // 8].reshape(height, width, bits // 8)
    return np.concatenate([rows[..., 2::-1], rows[..., 3:] if bits == 32 else np.full((height, width, 1), 255, np.uint8)], axis=2)


def pixels_of(raw: bytes | None) -> np.ndarray | None:
    """Rows of red, green, blue and alpha, or None if the image can't be read."""
    try:
        if not raw:
            return None
        if raw[:8] == b"\x89PNG\r\n\x1a\n" and (found := _png(raw)) is not None:
            return found
        if raw[:2] == b"BM" and (found := _bmp(raw)) is not None:
            return found
        if raw[:4] == b"GIF8" and (found := _gif(raw)) is not None:
            return found
        if raw[:4] == b"\0\0\1\0" and (found := _ico(raw)) is not None:
            return found
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(raw)).convert("RGBA"))
    except Exception:  # noqa: BLE001 - decoders fail in many ways on broken bytes, and a broken image has no colours
        return None


def dominant(raw: bytes | None, most: int = 6) -> list[tuple[str, int]]:
    """The commonest colours of an image, to 16 steps a channel; clear, dark and light pixels don't count, ties go to the smaller."""
    found = pixels_of(raw)
    if found is None:
        return []
    height, width = found.shape[:2]
    if max(height, width) > SIDE:
        h, w = max(1, height * SIDE // max(height, width)), max(1, width * SIDE // max(height, width))
        found = found[(np.arange(h) * height // h)[:, None], np.arange(w) * width // w]
    flat = found.reshape(-1, 4).astype(np.int64)
    luma = flat[:, :3].sum(axis=1) // 3
    kept = flat[(flat[:, 3] >= OPAQUE) & (luma >= DARK) & (luma <= LIGHT)][:, :3] & 0xF0
    values, counts = np.unique(kept @ np.array([65536, 256, 1]), return_counts=True)
    order = np.lexsort((values, -counts))[:most]
    return [(f"#{v:06x}", int(k)) for v, k in zip(values[order].tolist(), counts[order].tolist(), strict=True)]


def dominant_colours(content: Column, most: int = 6) -> Column:
    """Structs of value and count for a column of image bytes."""

    @F.pandas_udf("array<struct<value:string,count:bigint>>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda raw: [{"value": v, "count": k} for v, k in dominant(raw, most)])

    return run(content)


def with_image_colours(colours: DataFrame, images: DataFrame, most: int = 12, few: int = 3) -> DataFrame:
    """Palettes (site, value, count) of fewer than ``few`` colours filled up from the site's logo or icon (site, content), after their own."""
    thin = colours.groupBy("site").agg(F.count("*").alias("n"), F.collect_set("value").alias("own"))
    extra = images.join(thin, "site", "left").where(F.coalesce("n", F.lit(0)) < few).select("site", "own", F.explode(dominant_colours(F.col("content"))).alias("c"))
    new = extra.where(~F.coalesce(F.array_contains("own", F.col("c.value")), F.lit(False))).groupBy("site", "c.value").agg(F.max("c.count").alias("count"))
    both = colours.select("site", "value", "count", F.lit(0).alias("later")).unionByName(new.withColumn("later", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("later", F.desc("count"), "value"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select("site", "value", "count")
