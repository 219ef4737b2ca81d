"""SentencePiece models on the tokenizers library.

The model file is a protobuf message, read here field by field.  From it come the normaliser (compiled
character map, removal of extra spaces, prefix, escaping of spaces by the metaspace mark), the model (unigram
scores, or for a BPE model the merges that the scores imply), byte fallback and the decoder.  A set of probe
texts is encoded by the sentencepiece library too, and a rebuilt model that differs is refused.

Texts are encoded whole, in multithreaded batches.  Decoding joins the bytes of the pieces from a table that is held
against the library's decoder when the model is loaded.  ``parity`` gives the texts of a table whose ids differ from
the sentencepiece library's.

Null text counts as empty and has no ids.  Repeated rows give equal rows; null ids stay null; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from lodestone.llm.common import release, sliced, texts_of

MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

PROBES = ["", " ", "a", "Hello, world!  Two  spaces.", "tab\tand\nline\n\nfeeds", " leading and trailing ", "Größe, élève, señor; 中文 и кириллица 🙂", "x" * 70, "1234567890 3.14 1,000", "▁ mark <s> </s> <unk> <0x41>", "ﬁ Ⅳ ½ é", "\x00\x01 control"]


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                n, i = _varint(b, i)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def parse_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            spec.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            spec.model_type, spec.byte_fallback, spec.unk_id = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
        elif number == 3:
            own = dict(_fields(value))
            spec.charsmap, spec.dummy_prefix, spec.remove_extra, spec.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    return spec


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; among the cuts of one piece, earlier pieces first."""
    at = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER_DEFINED)}
    out = []
    for piece, score, kind in spec.pieces:
        if kind == NORMAL and len(piece) > 1:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in at and b in at:
                    out.append((-score, at[piece], at[a], at[b], a, b))
    return [(a, b) for *_, a, b in sorted(out)]


def _normalizer(spec: Spec):
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def build(spec: Spec) -> Tokenizer:
    """The tokenizer that the model file describes."""
    if spec.model_type == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk_id, spec.byte_fallback))
    elif spec.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        tok = Tokenizer(models.BPE(vocab, merges_of(spec), unk_token=spec.pieces[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
    else:
        raise ValueError(f"model type {spec.model_type}")
    tok.normalizer = _normalizer(spec)
    if own := [AddedToken(p, normalized=True, special=False) for p, _, kind in spec.pieces if kind == USER_DEFINED]:
        tok.add_tokens(own)
    steps = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if spec.byte_fallback else []), decoders.Fuse()]
    tok.decoder = decoders.Sequence([*steps, *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return tok


def differing(path: str, tok: Tokenizer, texts: list[str]) -> list[str]:
    """The texts whose ids or whose decoded text differ from the sentencepiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    ours = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    want = theirs.encode(texts, num_threads=1)
    return [t for t, a, b in zip(texts, ours, want) if a != b or tok.decode(a, skip_special_tokens=False) != theirs.decode(b)]


class PieceIds:
    """A model's encoder and its table for decoding, both held against the sentencepiece library when loaded."""

    _open: dict[str, PieceIds] = {}

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.spec = parse_model(f.read())
        self.tok = build(self.spec)
        if bad := differing(path, self.tok, PROBES):
            raise ValueError(f"the rebuilt model differs from {path} on {bad!r}")
        surface = {UNKNOWN: lambda p: " \u2047 ".encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surface = [surface.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in self.spec.pieces]
        want = [e.ids for e in self.tok.encode_batch(PROBES, add_special_tokens=False)]
        if self.decode([np.asarray(x, dtype="<u4").tobytes() for x in want]) != self.tok.decode_batch(want, skip_special_tokens=False):
            raise ValueError(f"decoding by table differs from the library's decoder for {path}")

    @classmethod
    def of(cls, path: str) -> PieceIds:
        """One per process and model; Spark reuses its Python processes."""
        if path not in cls._open:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of a batch, by as many threads as the library is given (RAYON_NUM_THREADS)."""
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts by a table of each piece's bytes, which the constructor holds against the library's decoder."""
        get, strip = self.surface.__getitem__, self.spec.dummy_prefix
        raw = [b"".join(map(get, np.frombuffer(x, dtype="<u4").tolist())) for x in ids]
        return [(r[1:] if strip and r[:1] == b" " else r).decode("utf-8", "replace") for r in raw]


ENCODED = "doc_id long, ids binary, n_ids long"


def encode(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit) and their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceIds.of(model)
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                ids = cache.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_ids"])
        release()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decode(df: DataFrame, model: str) -> DataFrame:
    """``df`` (columns ``doc_id``, ``ids`` and ``n_ids``) with the decoded ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceIds.of(model)
        for batch in batches:
            for part in sliced(batch, "ids", 4 << 20):
                yield pa.record_batch([*part.columns, pa.array(cache.decode(part.column(1).to_pylist()), pa.string())], names=[*part.schema.names, "text"])

    return df.select("doc_id", "ids", "n_ids").mapInArrow(run, ENCODED + ", text string")


def parity(df: DataFrame, model: str, *, text_col: str = "text") -> DataFrame:
    """The texts for which this backend's ids are not those of the sentencepiece library."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        cache, theirs = PieceIds.of(model), sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                texts = texts_of(part.column(0))
                bad = [t for t, a, b in zip(texts, cache.encode(texts), theirs.encode(texts, num_threads=1)) if a != np.asarray(b, dtype="<u4").tobytes()]
                yield pa.record_batch([pa.array(bad, pa.string())], names=["text"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "text string")


def round_trip(df: DataFrame, model: str) -> DataFrame:
    """Per document: number and checksum of the ids, and the decoded text's length and SHA-256."""
    out = decode(encode(df, model), model)
    return out.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("decoded_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
