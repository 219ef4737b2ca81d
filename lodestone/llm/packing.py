"""Best-fit packing of token sequences.

Documents become token ids (plus an end id); those longer than a sequence are cut into whole
sequences and a rest.  Pieces then go into sequences by bounded-space online best fit: a fixed
number of open bins, kept in a bitset keyed by free space, so that the tightest bin that takes a
piece is one shift and one lowest-set-bit away; when more are open than allowed, the fullest closes.
Pieces arrive in windows of bounded size, longest first, and bins stay open across windows.

Null text counts as empty: one piece that holds the end id alone.  Repeated rows are packed as often
as they come; a null id stays null.  An empty table gives an empty result.  Only the two named columns
are read, so further columns can have any name.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.units import UnitCache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


#: Texts with one of these are encoded whole.
_ODD = ("<|", "\u03a3", "\x1c", "\x1d", "\x1e", "\x1f")
#: A point or comma that belongs to a longer run of signs; where there is none, each is a pre-token of its own.
_RUN = re.compile(r"[.,](?<=[\W_][.,])(?<!\s[.,])\s")
#: Runs of these at a word's end are one pre-token of their own.
_TAIL = ".,!?;:%$&*#|()"


PROBES = ["Hello, World!  it's 3.14 (really?)", "a b\tc\n\nd", "Größe élève ¿qué? 中文 кириллица", "x.y, z. -- ... ?! 'tis", "UPPER lower MiXed 12,345.67", "e\u0301 ﬁ Ⅳ 🙂", " lead and trail ", "_under_score a_b #tag @you", "they've we'll I'm"]


class WordIds(UnitCache):
    """Ids of a vocabulary that lower-cases, drops white space and never joins across it.

    The ids of a text are those of its lower-case words in order.  A text where that may not hold is
    encoded whole: one that isn't NFC, has a special token's opening, a letter whose lower case depends
    on its place, or a control character that Python, but not the tokenizer, counts as white space.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.plain = self.tok
        self.apart = True
        try:
            split = spec["pre_tokenizer"]["pretokenizers"][-1]
            spec |= {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}
            self.plain = Tokenizer.from_str(json.dumps(spec))  # for words of lower-case letters alone
            # A file of another kind is told by probes: its texts are encoded whole.
            self.apart = all(a == self.whole(t) for a, t in zip(self.encode(PROBES), PROBES))
        except (KeyError, TypeError, IndexError):
            self.apart = False
        self.units, self.old = {}, {}

    def split(self, text: str) -> list[str] | None:
        if not self.apart or any(c in text for c in _ODD) or not is_normalized("NFC", text):
            return None
        text = text.lower()
        if not _RUN.search(text):
            text = text.replace("\n", " ").replace(", ", " , ").replace(". ", " . ")
        return text.split()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: set[str]) -> None:
        known, joined, letters, others = self.units, [], [], []
        for w in new:
            if w.isalpha() and (w.isascii() or max(w) < "\u0250"):
                letters.append(w)
                continue
            base = w.rstrip(_TAIL)
            if base and base != w and base[-1].isalnum() and base[-1] < "\u0250":
                joined.append((w, base, w[len(base) :]))
            else:
                others.append(w)
        for p in {p for _, *both in joined for p in both}:
            if p not in known and p not in new:
                (letters if p.isalpha() and max(p) < "\u0250" else others).append(p)
        self.store(self.plain, letters)
        self.store(self.tok, others)
        for w, base, tail in joined:
            known[w] = known[base] + known[tail]


def _pieces(path: str, seq_len: int, end_id: int, with_ids: bool, cache_words: int):
    end = struct.pack("<I", end_id)
    width = 4 * seq_len

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds.of(path)
        cache.most = cache_words
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                out: list[list] = [[], [], [], [], [], []]
                ids_of = cache.encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), ids_of):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), width)):
                        own = ids[at : at + width]
                        for col, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                            col.append(v)
                cols = [pa.array(c, f.type) for c, f in zip(out, PIECES_ARROW)]
                if with_ids:
                    yield pa.record_batch([*cols, pa.array(out[5], pa.binary())], names=[*PIECES_ARROW.names, "ids"])
                else:
                    yield pa.record_batch(cols, schema=PIECES_ARROW)
        cache.end()

    return run


def token_pieces(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, end_id: int = 0, with_ids: bool = False, cache_words: int = 450_000) -> DataFrame:
    """A row per piece of at most ``seq_len`` ids; ``with_ids`` adds them as little-endian unsigned 32-bit ``ids``.

    A Python worker remembers ``cache_words`` to twice as many words, about 0.2 kB each, while it runs.
    """
    only = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return only.mapInArrow(_pieces(tokenizer, seq_len, end_id, with_ids, cache_words), PIECES + (", ids binary" if with_ids else ""))


class OpenBins:
    """Open bins by free space.  ``bits`` has bit f set when some open bin has f free; ``at[f]`` lists those bins."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most, self.n, self.bits, self.made = size, most, 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.at[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes the piece, and the piece's offset in it."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            self.at[left].append(b)
            self.bits |= 1 << left
            self.n += 1
            if self.n > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return b, self.size - free


def _placed(seq_len: int, open_bins: int, window: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(seq_len, open_bins)

        def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            length = t.column("length").to_numpy()
            order = np.argsort(-length, kind="stable")
            at = [bins.place(n) for n in length[order].tolist()]
            seq, off = (np.array([x[k] for x in at], dtype=np.int64) for k in (0, 1))
            t = t.take(pa.array(order)).append_column("sequence_id", pa.array(first + seq)).append_column("offset", pa.array(off))
            return t.cast(schema).combine_chunks().to_batches()[0]

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= window:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return run


def pack(pieces: DataFrame, *, seq_len: int = 2048, open_bins: int = 16_384, window: int = 65_536) -> DataFrame:
    """``pieces`` (columns of ``token_pieces``) with the sequence and the offset of each.

    Partitions are packed apart: only the last, partly filled bins of each are lost, and Spark sizes
    the partitions of these narrow rows by bytes.  Pieces are dealt by doc_id and piece and come in a
    defined order, so a lost task packs the same pieces again.  Best fit is online over windows of
    ``window`` pieces, each taken longest first; the open bins stay open from one to the next.
    """
    order = ["doc_id", "piece", "length", "ids_crc32"]  # pieces that agree in all four have the same ids
    dealt = pieces.hint("rebalance", "doc_id", "piece").sortWithinPartitions(*order)
    extra = [("ids", pa.binary())] if "ids" in pieces.columns else []
    schema = pa.schema([*PIECES_ARROW, *extra, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    ddl = PIECES + (", ids binary" if extra else "") + ", sequence_id long, offset long"
    return dealt.mapInArrow(_placed(seq_len, open_bins, window, schema), ddl)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
