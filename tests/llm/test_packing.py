import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_and_places(odd):
    out = packing.pack(packing.token_pieces(odd, PATH, seq_len=256, with_ids=True), seq_len=256, open_bins=8, window=16).collect()
    tok, want = Tokenizer.from_file(PATH), {}
    for r in odd.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [0])
    got: dict = {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length and r.start == 256 * r.piece
        got.setdefault(r.doc_id, []).append(r)
    for doc, texts in want.items():
        n = len(texts)
        rows = sorted(got.pop(doc), key=lambda r: r.piece)
        ids = b"".join(bytes(r.ids) for r in rows[::n])
        assert ids == struct.pack(f"<{len(texts[0])}I", *texts[0]) and len(rows) == n * -(-len(texts[0]) // 256)
    assert not got
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256


def test_empty_table(odd):
    assert packing.pack(packing.token_pieces(odd.limit(0), PATH)).count() == 0


def test_best_fit_is_near_the_bound():
    import random

    rng, bins = random.Random(1), packing.OpenBins(2048, 1000)
    sizes = [rng.randint(1, 2048) for _ in range(20_000)]
    for n in sizes:
        bins.place(n)
    assert bins.made <= 1.03 * sum(sizes) / 2048 and bins.n <= 1000


def test_tightest_bin_and_fullest_closes():
    b = packing.OpenBins(10, 2)
    assert [b.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]  # 4 and 3 free
    assert b.place(3) == (1, 7)
    assert [b.place(n) for n in (8, 5)] == [(2, 0), (3, 0)]  # a third open bin: the one with 2 free closes
    assert b.place(2) == (0, 6)


def test_cache_generations():
    c = packing.WordIds(PATH)
    c.most = 10
    texts = [" ".join(f"w{i} x{i}, ({i}) it's" for i in range(k, k + 20)) for k in range(0, 200, 7)]
    for t in [*texts, "ΑΣ Σ", "é a", "a.b ., _. _, x"]:
        assert c.encode([t]) == [c.whole(t)]


def test_runs_of_signs():
    import itertools

    c = packing.WordIds(PATH)
    texts = [f"{a}{s} b" for a in ("a", "é", "1", "") for n in (1, 2, 3) for s in map("".join, itertools.product("._'-,é1", repeat=n))]
    assert c.encode(texts) == [c.whole(t) for t in texts]


def test_other_vocabularies_are_encoded_whole():
    texts = ["Hello, World!  twice", "a\n\nb", "Größe ", ""]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        c, tok = packing.WordIds(path), Tokenizer.from_file(path)
        assert c.apart == name.startswith("word")
        assert c.encode(texts) == [struct.pack(f"<{len(i)}I", *i) for i in (tok.encode(t, add_special_tokens=False).ids for t in texts)]


def test_registered_query(spark, tmp_path, words):
    rows = [(i, " ".join(words(n, i))) for i, n in enumerate([0, 1, 5, 40, 3000, 700, 2100] * 4)] + [(99, None), (99, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op2_best_fit_packing(spark, str(tmp_path)).collect()
    tok, want, bins = Tokenizer.from_file(PATH), [], {}
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc, k, a, len(ids[a : a + 2048]), zlib.crc32(struct.pack(f"<{len(ids[a : a + 2048])}I", *ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(bins) <= sum(w[3] for w in want) / 2048 + 3
