import hashlib
import zlib

import numpy as np
import pytest

from lodestone.llm import media


def test_store_and_read(odd):
    rows = media.read_audio(media.store_audio(odd)).collect()
    assert len(rows) == odd.count()
    texts = sorted((r.text or "").encode() for r in odd.collect())
    assert sorted(bytes(r.payload)[: r.n_bytes] for r in rows) == texts
    for r in rows:
        p = bytes(r.payload)
        assert len(p) % 576 == 0 and p and set(p[r.n_bytes :]) <= {255}
        fmt, rate, _, _ = media.parse_wav(bytes(r.pcm))
        assert (fmt, rate) == (1, 16_000) and r.media_bytes > len(p)
    same = {(r.feature, r.media_sha256) for r in rows if bytes(r.payload)[: r.n_bytes] == b"tie tie tie"}
    assert len(same) == 1
    assert media.read_audio(media.store_audio(odd.limit(0))).count() == 0


def companded(byte, law):
    """The companding laws as their recommendation words them, bit by bit."""
    if law == "mu":
        b = ~byte & 255
        v = ((b & 15) * 2 + 33) * (1 << (b >> 4 & 7)) - 33
        return (-v if b & 128 else v) * 4
    b = byte ^ 0x55
    seg, low = b >> 4 & 7, b & 15
    v = low * 2 + 1 if seg == 0 else (low * 2 + 33) << (seg - 1)
    return (v if b & 128 else -v) * 8


def test_tables():
    assert media.TABLES[media.MULAW].tolist() == [companded(b, "mu") for b in range(256)]
    assert media.TABLES[media.ALAW].tolist() == [companded(b, "a") for b in range(256)]


def adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            d = step >> 3
            d += step * (n >> 2 & 1) + (step >> 1) * (n >> 1 & 1) + (step >> 2) * (n & 1)
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + int(media.CHANGES[n])))
            out.append(value)
    return out


def test_adpcm_equals_one_sample_at_a_time():
    blocks = np.random.default_rng(3).integers(0, 256, (5, 60), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("fmt", [media.MULAW, media.ALAW, media.ADPCM])
def test_file_holds_the_bytes(fmt):
    data = media.padded(b"hello" * 300)
    got, rate, align, back = media.parse_wav(media.encode(data, fmt))
    assert (got, rate, bytes(back)) == (fmt, 8000, data)
    assert media.padded(b"") == b"\xff" * 576
    with pytest.raises(ValueError):
        media.parse_wav(b"nothing")


def test_resample():
    x = np.array([0, 100, -100], dtype=np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert len(media.resample(np.arange(1000, dtype=np.int16), 8000, 11025)) == 1378
    assert media.resample(x, 8000, 8000) is x and zlib.crc32(b"") == 0 and hashlib.sha256


def test_registered_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 400), (4, "x" * 576), (5, "long " * 5000), (5, "again"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.op5_telephony_audio(spark, str(tmp_path)).collect())
    want = []
    for doc, text in rows:
        raw = (text or "").encode()
        p = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        want.append((doc or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want)
    for r in media.read_audio(media.store_audio(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        assert media.parse_wav(bytes(r.pcm))[:2] == (1, 16_000) and hashlib.sha256(bytes(r.payload)).hexdigest() in {w[3] for w in want}
