import struct

import public_tokenizers
import pytest

from lodestone.llm import sentencepiece_backend as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_round_trip_and_parity(spark, odd):
    assert sp.parity(odd, PATH).count() == 0
    out = sp.decode(sp.encode(odd, PATH), PATH).collect()
    want = sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert sorted((r.doc_id or 0, r.text) for r in out) == want
    assert sp.round_trip(odd.limit(0), PATH).count() == 0


def test_spaces_and_line_feeds():
    c = sp.PieceIds.of(PATH)
    texts = ["a  b", " lead", "a \n b\n\nc", "\n", "x\n", "tail ", "▁ mark", "a\0b", "one two\nthree"]
    assert sp.differing(PATH, c.tok, texts) == []
    assert c.encode(texts) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in c.tok.encode_batch(texts, add_special_tokens=False)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram(tmp_path, extra):
    """A hand-made unigram model: nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]]
    pieces += [("▁", -2.0, 1), ("▁the", -1.0, 1), ("the", -3.0, 1), ("▁cat", -2.5, 1), ("c", -5.0, 1), ("a", -5.0, 1), ("t", -5.0, 1), ("s", -4.0, 1), ("▁cats", -4.6, 1), ("h", -6.0, 1), ("e", -6.0, 1)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    body += message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2))), (3, message((1, b"identity"), *extra)))
    (tmp_path / "m.model").write_bytes(body)
    return str(tmp_path / "m.model")


@pytest.mark.parametrize("extra", [[(3, 1), (4, 1), (5, 1)], [(3, 1), (4, 0), (5, 1)], [(3, 0), (4, 0), (5, 1)]])
def test_unigram_models(tmp_path, extra):
    path = unigram(tmp_path, extra)
    spec = sp.parse_model(open(path, "rb").read())
    assert spec.model_type == sp.UNIGRAM and spec.byte_fallback and len(spec.pieces) == 270
    texts = ["the cats", "the cat sat", "é", "", "thecat", "the the"]
    assert sp.differing(path, sp.build(spec), texts) == []


def test_merges_follow_scores():
    spec = sp.Spec([("<unk>", 0, 2), ("ab", -1.0, 1), ("a", -9.0, 1), ("b", -9.0, 1), ("abc", -2.0, 1), ("c", -9.0, 1), ("bc", -3.0, 1)], sp.BPE)
    assert sp.merges_of(spec) == [("a", "b"), ("ab", "c"), ("a", "bc"), ("b", "c")]
