"""Telephony audio in binary columns.

A recording is a RIFF/WAVE file of one channel with 8 kHz mu-law (format 7) or A-law (format 6)
bytes, or IMA ADPCM (format 17) blocks.  ``expand`` turns the stored bytes into 16-bit PCM: the two
companding laws by lookup tables of 256 entries, ADPCM by numpy with one step per nibble position over
all blocks at once.  ``resample`` gives PCM at another rate by linear interpolation.

``store_audio`` packs arbitrary bytes losslessly as such samples, ``read_audio`` parses the stored file
again and derives the payload, the resampled PCM file and a feature string.  Null text or bytes count
as empty; an empty payload is one frame of fill bytes.  Equal contents give equal rows, repeated rows
stay, and only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_slices, sliced

RATE = 8000
FRAME = 576
FILL = b"\xff"
ALAW, MULAW, ADPCM = 6, 7, 17

# The step sizes and the index changes of the IMA ADPCM recommendation.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    seg, low = (a >> 4) & 7, (a & 15) << 4
    size = np.where(seg == 0, low + 8, low + 0x108 << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (a row each) as PCM rows: the header's sample, then two per byte, low nibble first.

    A header's step index beyond the table counts as its last entry.
    """
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), dtype=np.int16)
    out[0] = value
    for k, byte in enumerate(data):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            step = STEPS[index]
            change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
            value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + CHANGES[nibble], 0, len(STEPS) - 1)
            out[1 + 2 * k + half] = value
    return out.T


def wav(fmt: int, data: bytes, rate: int = RATE, bits: int = 8, align: int = 1, extra: bytes = b"") -> bytes:
    """A one-channel RIFF/WAVE file."""
    per_s = rate * align if fmt != ADPCM else rate * align // (2 * (align - 4) + 1)
    head = struct.pack("<HHIIHH", fmt, 1, rate, per_s, align, bits)
    head += struct.pack("<H", len(extra)) + extra if fmt != 1 else b""
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(file: bytes) -> tuple[int, int, int, memoryview]:
    """Format, rate, block alignment and data of a RIFF/WAVE file."""
    view = memoryview(file)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(view):
        name, n = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            if fmt is None:
                break
            return fmt[0], fmt[2], fmt[4], view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def encode(payload: bytes, fmt: int, align: int = FRAME) -> bytes:
    """The payload's bytes, unchanged, as the samples (or blocks) of a file of that format."""
    if fmt == ADPCM:
        return wav(fmt, payload, bits=4, align=align, extra=struct.pack("<H", 2 * (align - 4) + 1))
    return wav(fmt, payload)


def expand_all(files: list[tuple[int, int, memoryview]]) -> list[np.ndarray]:
    """16-bit PCM of each (format, block alignment, data); the ADPCM blocks of all files of an alignment are decoded together."""
    out: list = [None] * len(files)
    blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, (fmt, align, data) in enumerate(files):
        raw = np.frombuffer(data, dtype=np.uint8)
        if fmt in TABLES:
            out[i] = TABLES[fmt][raw]
        elif fmt == ADPCM:
            blocks.setdefault(align, []).append((i, raw[: len(raw) // align * align].reshape(-1, align)))
        else:
            raise ValueError(f"format {fmt}")
    for own in blocks.values():
        pcm = decode_adpcm(np.concatenate([b for _, b in own]))
        for (i, _), rows in zip(own, np.split(pcm, np.cumsum([len(b) for _, b in own])[:-1])):
            out[i] = rows.ravel()
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation; the last sample holds. Integer arithmetic, so equal input gives equal output anywhere."""
    if rate == to or not len(pcm):
        return pcm
    if to % rate == 0:
        f, x = to // rate, pcm.astype(np.int32)
        y, out = np.append(x[1:], x[-1]), np.empty((len(x), f), dtype=np.int16)
        for j in range(f):
            out[:, j] = (x * (f - j) + y * j) // f
        return out.ravel()
    n = len(pcm) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    k, part = at // to, at % to
    x = pcm.astype(np.int64)
    y = x[np.minimum(k + 1, len(x) - 1)]
    return ((x[k] * (to - part) + y * part) // to).astype(np.int16)


def features(pcm: np.ndarray, fmt: int) -> str:
    """Integer features of the decoded samples."""
    x = pcm.astype(np.float64)  # sums of 16-bit products stay exact below 2**53
    crossings = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1])))
    return f"fmt={fmt};n={len(x)};energy={int(x @ x)};sum={int(x.sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def padded(raw: bytes, frame: int = FRAME) -> bytes:
    """``raw`` and fill bytes up to a positive multiple of ``frame``."""
    return raw + FILL * (-len(raw) % frame if raw else frame)


def codec_of(payload: bytes) -> int:
    """The format in which ``store_audio`` keeps a payload: one of the three, by its checksum."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, pcm binary, feature string"


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (unpadded) and ``media``, the file that holds the padded bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = [b"" if x is None else x for x in part.column(1).to_pylist()]
        media = [encode(p := padded(x), codec_of(p)) for x in raw]
        return pa.record_batch([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    only = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return only.mapInArrow(map_slices(one, "raw"), STORED)


def read_audio(stored: DataFrame, rate: int = 16_000) -> DataFrame:
    """What the stored files hold: the payload, the PCM file at ``rate``, features and digests."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("pcm", pa.binary()), ("feature", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "media", 2 << 20):
                out: list[list] = [[], [], [], [], []]
                files = part.column(2).to_pylist()
                parsed = [parse_wav(x) for x in files]
                decoded = expand_all([(fmt, align, data) for fmt, _, align, data in parsed])
                for file, (fmt, own, _, data), pcm in zip(files, parsed, decoded):
                    again = resample(pcm, own, rate)
                    feature = f"{features(pcm, fmt)};pcm{rate}={zlib.crc32(again.tobytes()):08x}"
                    sound = wav(1, again.tobytes(), rate, 16, 2)
                    for col, v in zip(out, (bytes(data), len(file), hashlib.sha256(file).hexdigest(), sound, feature)):
                        col.append(v)
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, t.type) for c, t in zip(out, list(schema)[2:]))], schema=schema)

    return stored.mapInArrow(run, READ)


def op5_telephony_audio(spark, sf_dir: str) -> DataFrame:
    read = read_audio(store_audio(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
        F.length("pcm").cast("long").alias("pcm_bytes"), F.xxhash64("pcm").alias("pcm_xxhash64"),
    )
