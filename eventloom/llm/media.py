"""Operator 9: media columns.  Text bytes are stored as 8-bit greyscale PNG images in a binary column.

Cases: a null or empty text is 64 zero bytes, an image of one row.  Texts of any length make one image each, 64 samples
wide.  Equal texts give equal values; repeated rows stay repeated.  Only the id and text columns are read, so others may
have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes, and those bytes with zeros up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale PNG; each row has the filter (none, sub or up) with the smallest sum of absolute differences."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the five PNG row filters of one-byte pixels; lines have the filter's number in column 0."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown PNG filter")
    is_sub = kinds == 1
    rows[is_sub] = np.cumsum(rows[is_sub], axis=1, dtype=np.uint8)
    above = np.zeros(rows.shape[1], np.uint8)
    for i in np.flatnonzero(kinds >= 2):
        above = rows[i - 1] if i else above * 0
        if kinds[i] == 2:
            rows[i] += above
            continue
        line, left = rows[i].tolist(), 0
        over = above.tolist()
        for j, x in enumerate(line):
            guess = (left + over[j]) // 2 if kinds[i] == 3 else paeth(left, over[j], over[j - 1] if j else 0)
            left = line[j] = (x + guess) & 255
        rows[i] = line
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a greyscale 8-bit PNG.  Every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace")
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += n + 12
    if not ended or size is None:
        raise ValueError("truncated PNG")
    width, height = size
    return unfilter(np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1))


_N = 32
_DCT = np.cos(np.pi * (2 * np.arange(_N)[None, :] + 1) * np.arange(8)[:, None] / (2 * _N))


def pool(n: int) -> np.ndarray:
    """A matrix that averages n samples into _N cells by area."""
    lo, hi = np.arange(_N)[:, None] * n / _N, (np.arange(_N)[:, None] + 1) * n / _N
    at = np.arange(n)[None, :]
    return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) * _N / n


_ACROSS = pool(WIDTH)


def dct_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 reduced image lie above their median."""
    height, width = samples.shape
    m = samples.astype(np.float64) @ (_ACROSS if width == WIDTH else pool(width)).T
    if height >= _N:  # cell sums by cumulative sums: linear in the height
        total = np.vstack([np.zeros(_N), np.cumsum(m, axis=0)])
        edge = np.arange(_N + 1) * height / _N
        low = np.minimum(edge.astype(int), height - 1)
        at = total[low] + (edge - low)[:, None] * m[low]
        m = np.diff(at, axis=0) * _N / height
    else:
        m = pool(height) @ m
    low = np.round(_DCT @ m @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", level: int = 6) -> DataFrame:
    """(doc_id, n_bytes, media): every text's bytes as a PNG in a binary column."""

    def make():
        def fn(cols):
            sized = [payload_of(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_bytes": [n for n, _ in sized], "media": [encode_png(p, level=level) for _, p in sized]}

        return fn

    return map_arrow(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), make, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored images back: payload size and digests, the image's digest, and its hash."""

    def make():
        def fn(cols):
            out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for doc_id, n, data in zip(cols["doc_id"], cols["n_bytes"], cols["media"], strict=True):
                samples = decode_png(data)
                payload = samples.tobytes()
                row = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), dct_hash(samples).hex())
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return fn

    return map_arrow(media.select("doc_id", "n_bytes", "media"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(table(spark, sf_dir, "documents")))
