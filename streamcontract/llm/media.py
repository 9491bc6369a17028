"""AVI motion-JPEG: writing, index parsing, intra-frame decoding and shot detection.

A payload is stored losslessly in the format's own unit, the quantised DCT
coefficient. A frame has 24 x 24 samples, nine blocks of 64 coefficients, so it
carries 576 bytes. Byte b becomes the coefficient of size category 8 whose eight
amplitude bits are b (b - 255 for b < 128, else b: all 256 values of that
category). The frame's own Huffman tables hold one code of one bit for that
category, so a coefficient is nine bits, a block 72 bytes, and a whole file is
coded and decoded by numpy; 0xFF bytes are stuffed as JPEG asks. Every quantiser
step is 1. The stream is baseline sequential JPEG; frames are found through the
RIFF index (idx1).

`decode_frame` also reads any baseline Huffman JPEG without restart markers (one
component, or several of equal sampling), so that clips from elsewhere can be
used; other streams raise ValueError.

Shots: each frame's luminance histogram differs from the one before by some
distance; a cut is where the distance exceeds the mean plus `sigma` standard
deviations of the `window` distances before it, and `floor`. Each shot is a timed
clip row.

Cases: a null or empty text is one frame of 255s; equal texts give equal values;
an empty table gives an empty result; repeated rows give repeated results; texts
beyond the 4 GB of a RIFF file raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.llm.common import prepare, table

SIDE, UNIT, RATE = 24, 576, 25
#: Bytes of the payload's end that op8_media gives the checksum of, by its contract.
TAIL_BYTES = 32
#: The order in which JPEG stores the 64 coefficients of a block.
ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in (((i, s - i) if s % 2 else (s - i, i)) for i in range(s + 1)) if y < 8 and x < 8])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([1] + [0] * 15) + bytes([8])
HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])) + _segment(0xC4, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
TAIL = b"\xff\xd9"
_CODED = UNIT * 9 // 8


def encode_frames(payload: bytes) -> list[bytes]:
    """A JPEG for every 576 bytes."""
    n = len(payload) // UNIT
    if n * UNIT != len(payload) or not n:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    out: list[bytes] = []
    for lo in range(0, n, 512):
        part = np.frombuffer(payload, np.uint8, min(512, n - lo) * UNIT, lo * UNIT)
        bits = np.zeros((len(part), 9), np.uint8)
        bits[:, 1:] = np.unpackbits(part).reshape(-1, 8)
        coded = np.packbits(bits.ravel())
        for k in range(len(coded) // _CODED):
            out.append(HEAD + coded[k * _CODED : (k + 1) * _CODED].tobytes().replace(b"\xff", b"\xff\0") + TAIL)
    return out


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """RIFF file with one MJPG video stream and an index."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    def group(kind: bytes, body: bytes, name: bytes = b"LIST") -> bytes:
        return chunk(name, kind + body)

    n, largest = len(frames), max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, rate, 0, n, largest, -1, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = group(b"hdrl", chunk(b"avih", main) + group(b"strl", chunk(b"strh", stream) + chunk(b"strf", form)))
    movie, index, at = [], [], 4
    for f in frames:
        movie.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    body = head + group(b"movi", b"".join(movie)) + chunk(b"idx1", b"".join(index))
    if len(body) + 4 >= 1 << 32:
        raise ValueError("beyond the size of a RIFF file")
    return group(b"AVI ", body, b"RIFF")


@dataclass
class Movie:
    width: int
    height: int
    micros: int
    frames: list[memoryview]


def read_avi(data: bytes) -> Movie:
    """Parses the header and finds the video frames through idx1 (or, without one, by walking movi)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    view = memoryview(data)
    width = height = micros = 0
    movie = index = None

    def walk(lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
        while lo + 8 <= hi:
            size = struct.unpack_from("<I", data, lo + 4)[0]
            if lo + 8 + size > len(data):
                raise ValueError("a chunk runs over the file's end")
            yield data[lo : lo + 4], lo + 8, size
            lo += 8 + size + size % 2

    top = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    for name, at, size in walk(12, top):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, a, _ in walk(at + 4, at + size):
                if inner == b"avih":
                    x = struct.unpack_from("<14I", data, a)
                    micros, width, height = x[0], x[8], x[9]
        elif name == b"LIST" and kind == b"movi":
            movie = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movie is None:
        raise ValueError("no movi list")
    frames = []
    if index is not None:
        entries = list(struct.iter_unpack("<4sIII", view[index[0] : index[0] + index[1] // 16 * 16]))
        base = movie[0] if not entries or data[movie[0] + entries[0][2] : movie[0] + entries[0][2] + 4] == entries[0][0] else 0
        for name, _, at, size in entries:
            if name[2:] in (b"dc", b"db"):
                at += base
                if data[at : at + 4] != name:
                    raise ValueError("the index does not point at a chunk")
                frames.append(view[at + 8 : at + 8 + size])
    else:
        frames = [view[a : a + s] for name, a, s in walk(movie[0] + 4, movie[0] + movie[1]) if name[2:] in (b"dc", b"db")]
    return Movie(width, height, micros, frames)


@dataclass
class Jpeg:
    width: int
    height: int
    components: int
    tables: dict[int, np.ndarray]
    quantisers: list[int]
    huffman: dict[int, tuple[list[int], bytes]]
    selectors: list[tuple[int, int]]
    scan: bytes


def parse_jpeg(data: bytes) -> Jpeg:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, huffman, frame = 2, {}, {}, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no scan")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = bytes(data[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (list(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, h, w, n = struct.unpack_from(">BHHB", body)
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            if n > 1 and any(x[1] != 0x11 for x in parts):
                raise ValueError("components of different sampling")
            frame = (w, h, n, [x[2] for x in parts])
        elif 0xC1 <= marker <= 0xCF or marker == 0xDD:
            raise ValueError("not a baseline JPEG without restarts")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            selectors = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = bytes(data).rfind(b"\xff\xd9")
            return Jpeg(frame[0], frame[1], frame[2], tables, frame[3], huffman, selectors, bytes(data[at:end]).replace(b"\xff\0", b"\xff"))


def coefficients(j: Jpeg) -> np.ndarray:
    """Quantised coefficients of all blocks in zigzag order, (components, blocks, 64)."""
    blocks = -(-j.width // 8) * -(-j.height // 8)
    one = ([1] + [0] * 15, b"\x08")
    if j.components == 1 and j.huffman.get(j.selectors[0][0]) == one and j.huffman.get(16 | j.selectors[0][1]) == one:
        amplitude = unpack(j.scan, blocks)
        out = amplitude.astype(np.int64)
        out = np.where(out < 128, out - 255, out).reshape(blocks, 64)
        out[:, 0] = np.cumsum(out[:, 0])
        return out[None]
    codes = {}
    for key, (sizes, values) in j.huffman.items():
        code, k, found = 0, 0, {}
        for length, n in enumerate(sizes, 1):
            for _ in range(n):
                found[length, code] = values[k]
                code, k = code + 1, k + 1
            code <<= 1
        codes[key] = found
    bits = np.unpackbits(np.frombuffer(j.scan, np.uint8)).tolist()
    at = 0

    def take(n: int) -> int:
        nonlocal at
        x = 0
        for b in bits[at : at + n]:
            x = x << 1 | b
        at += n
        return x

    def symbol(table: dict[tuple[int, int], int]) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            if at >= len(bits):
                raise ValueError("the scan ends early")
            code = code << 1 | bits[at]
            at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def amplitude_of(n: int) -> int:
        x = take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    out = np.zeros((j.components, blocks, 64), np.int64)
    before = [0] * j.components
    for k in range(blocks):
        for c, (dc, ac) in enumerate(j.selectors):
            before[c] += amplitude_of(symbol(codes[dc]))
            out[c, k, 0] = before[c]
            i = 1
            while i < 64:
                s = symbol(codes[16 | ac])
                if s == 0:
                    break
                i += s >> 4
                if s & 15:
                    out[c, k, i] = amplitude_of(s & 15)
                i += 1
    return out


def unpack(scan: bytes, blocks: int) -> np.ndarray:
    """The amplitude bits of one-code scans: eight of every nine bits."""
    coded = np.frombuffer(scan, np.uint8)
    if len(coded) != blocks * 72:
        raise ValueError("the scan has another length")
    bits = np.unpackbits(coded).reshape(-1, 9)
    if bits[:, 0].any():
        raise ValueError("no such code")
    return np.packbits(bits[:, 1:])


_K = np.arange(8)
_DCT = np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16) / 2
_DCT[0] /= np.sqrt(2)
_DCT = _DCT.astype(np.float32)


def luminance(blocks: np.ndarray, quantiser: np.ndarray, columns: int) -> np.ndarray:
    """Samples 0 to 255 of (..., blocks, 64) coefficients in zigzag order, as (..., rows, columns * 8)."""
    plain = np.zeros(blocks.shape, np.float32)
    plain[..., ZIGZAG] = blocks * quantiser
    x = plain.reshape(*blocks.shape[:-1], 8, 8)
    x = _DCT.T @ x @ _DCT
    x = x.reshape(*blocks.shape[:-2], -1, columns, 8, 8)
    x = np.moveaxis(x, -2, -3)
    return np.clip(np.rint(x.reshape(*x.shape[:-4], x.shape[-4] * 8, columns * 8) + 128), 0, 255).astype(np.uint8)


def decode_frame(data: bytes) -> np.ndarray:
    """The luminance (first component) of a frame."""
    j = parse_jpeg(data)
    c = coefficients(j)[0]
    return luminance(c, j.tables[j.quantisers[0]], -(-j.width // 8))[: j.height, : j.width]


def _payload_of(frames: list[memoryview]) -> np.ndarray | None:
    """All frames' payload at once if every frame has this module's own head; None otherwise."""
    scans = []
    for f in frames:
        if f[: len(HEAD)] != HEAD or f[-2:] != TAIL:
            return None
        scans.append(bytes(f[len(HEAD) : -2]).replace(b"\xff\0", b"\xff"))
    return unpack(b"".join(scans), 9 * len(frames))


def read_payload(data: bytes) -> bytes:
    """The bytes that `encode_frames` stored, from the file alone."""
    frames = read_avi(data).frames
    fast = _payload_of(frames)
    if fast is not None:
        return fast.tobytes()
    out = []
    for f in frames:
        c = coefficients(parse_jpeg(bytes(f)))[0]
        c[:, 0] = np.diff(c[:, 0], prepend=0)
        out.append(np.where(c < 0, c + 255, c).astype(np.uint8).tobytes())
    return b"".join(out)


def histograms(data: bytes, bins: int = 16) -> np.ndarray:
    """Share of the samples in each luminance bin, a row for each frame."""
    movie = read_avi(data)
    fast = _payload_of(movie.frames)
    rows = []
    if fast is not None:
        for lo in range(0, len(movie.frames), 256):
            c = fast[lo * UNIT : (lo + 256) * UNIT].reshape(-1, 9, 64).astype(np.float32)
            c = np.where(c < 128, c - 255, c)
            c[:, :, 0] = np.cumsum(c[:, :, 0], axis=1)
            y = luminance(c, np.ones(64, np.float32), 3).reshape(len(c), -1)
            at = np.arange(len(c))[:, None] * bins + (y >> 4 if bins == 16 else y.astype(np.int64) * bins >> 8)
            rows.append(np.bincount(at.ravel(), minlength=len(c) * bins).reshape(len(c), bins) / y.shape[1])
    else:
        for f in movie.frames:
            y = decode_frame(bytes(f)).ravel().astype(np.int64)
            rows.append(np.bincount(y * bins >> 8, minlength=bins)[None] / len(y))
    return np.vstack(rows) if rows else np.zeros((0, bins))


def shots(h: np.ndarray, window: int = 12, sigma: float = 3.0, floor: float = 0.15) -> np.ndarray:
    """First frames of the shots: adaptive threshold on the differences of neighbouring histograms."""
    if not len(h):
        return np.zeros(0, np.int64)
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    c1, c2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(len(d))
    lo = np.maximum(0, i - window)
    n = np.maximum(1, i - lo)
    mean = (c1[i] - c1[lo]) / n
    spread = np.sqrt(np.maximum(0, (c2[i] - c2[lo]) / n - mean * mean))
    return np.concatenate([[0], 1 + np.flatnonzero((d > mean + sigma * spread) & (d > floor))])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary: each whole text as an AVI file."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = [x.as_py() for x in part.column(1)]
                files = [write_avi(encode_frames(pad(t))) for t in texts]
                yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(write, "doc_id long, n_bytes long, media binary")


def pad(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % UNIT if text else UNIT)


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot: doc_id, shot, first_frame, n_frames, start_s, end_s, and its mean histogram."""
    prepare(media.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, m in zip(b.column(0), b.column(1), strict=True):
                data = m.as_py()
                if data is None:
                    continue
                h, step = histograms(data), read_avi(data).micros / 1e6
                first = shots(h)
                for k, (x, y) in enumerate(zip(first, [*first[1:], len(h)], strict=True)):
                    rows.append((i.as_py(), k, int(x), int(y - x), x * step, y * step, h[x:y].mean(0).tolist()))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "shot", "first_frame", "n_frames", "start_s", "end_s", "histogram"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(cut, "doc_id long, shot int, first_frame long, n_frames long, start_s double, end_s double, histogram array<double>")


def digest(docs: DataFrame, tail: int = UNIT) -> DataFrame:
    """Stores every text as a file, reads it back and tells what came: one narrow pass. tail_crc32 is of the last `tail` bytes read back."""
    if tail < 1:
        raise ValueError("a tail has at least one byte")
    prepare(docs.sparkSession)

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in b.column(2):
                data = m.as_py()
                back = read_payload(data)
                h = histograms(data)
                first = shots(h)
                feature = f"frames={len(h)};shots={len(first)};luma={','.join(f'{x:.4f}' for x in h.mean(0))}"
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-tail:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return to_media(docs).mapInArrow(tell, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), tail=TAIL_BYTES)
