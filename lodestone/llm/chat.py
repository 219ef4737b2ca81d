"""Chat formatting into budgeted, turn-aligned windows with a loss mask.

A turn is written as ``<|im_start|>role\\n``, its text and ``<|im_end|>\\n``.  Inside texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``, so a control string can't stand in them and reading back
gives the exact text.  Prefix sums of the turns' token counts choose the windows: each takes as many new
turns as the budget allows beside the conversation's leading system turn and the last ``history`` turns
before it.  Those repeated turns are masked; each assistant text is a target in exactly one window.  A
window whose single new turn is over the budget drops the history and is marked ``over``.

Null role or text counts as empty.  Equal turn numbers keep the order of role and text; repeated rows are
turns of their own; null turn numbers come first.  Rows whose conversation is null are one conversation.  An
empty table gives an empty result, and only the four named columns are read.

A conversation's turns come sorted to one task (digests over all its turns and the order of its windows need
that) and stream through it: what is held is a window, the system turn and the last ``history`` turns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import sliced

START, END = "<|im_start|>", "<|im_end|>\n"
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"((?:[^\n\\]|\\.)*)\n(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


class Counter:
    """Token counts by a tokenizers file (.json) or by the ranks of the same kind of vocabulary (.tiktoken), which counts faster."""

    _open: dict[str, Counter] = {}

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = None
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.encode_special_tokens = True

    @classmethod
    def of(cls, path: str, pattern: str = "") -> Counter:
        if path not in cls._open:
            cls._open[path] = cls(path, pattern)
        return cls._open[path]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.ranks is not None:
            return [len(self.ranks.encode_ordinary(t)) for t in texts]
        return [len(e) for e in self.tok.encode_batch(texts, add_special_tokens=False)]


Window = tuple[int, int, int, str, list[int], list[int], bool]


class Windows:
    """The windows of one conversation, from its turns in order; ``add`` gives those that a turn completes.

    A window is (first new turn, end, repeated turns, formatted text, starts and ends of the loss mask in code
    points, over the budget).  Prefix sums over the turns held say how many of the repeated ones there is room for.
    """

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.back: deque[tuple[str, str, int]] = deque(maxlen=history)  # the last turns, but the system's
        self.repeated: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.first = self.n = self.room = 0

    def add(self, role: str, text: str, cost: int) -> list[Window]:
        turn, out = (role, text, cost), []
        if self.n == 0:
            self.room = self.budget
        elif cost > self.room:
            out += self.finish()
            self.first, self.new = self.n, []
            self.room = self.budget - (self.system[2] if self.system else 0)
            past = list(self.back)
            sums = np.concatenate([[0], np.cumsum([c for _, _, c in past[::-1]], dtype=np.int64)])
            fits = int(np.searchsorted(sums, self.room - cost, side="right")) - 1 if cost <= self.room else 0
            self.repeated = past[len(past) - fits :]
            self.room -= int(sums[fits])
        self.new.append(turn)
        self.room -= cost
        if self.n == 0 and role == "system":
            self.system = turn
        elif self.history:
            self.back.append(turn)
        self.n += 1
        return out

    def finish(self) -> list[Window]:
        """The window that is still open."""
        if not self.new:
            return []
        head = [self.system] if self.system and self.first else []
        repeated = [*head, *self.repeated]
        parts, n, starts, ends = [], 0, [], []
        for k, (role, text, _) in enumerate([*repeated, *self.new]):
            mark, body = f"{START}{escape_role(role)}\n", escape(text)
            if k >= len(repeated) and role == "assistant":
                starts.append(n + len(mark))
                ends.append(n + len(mark) + len(body))
            parts += (mark, body, END)
            n += len(mark) + len(body) + len(END)
        return [(self.first, self.first + len(self.new), len(repeated), "".join(parts), starts, ends, self.room < 0)]


WINDOWS = "conv_id long, window int, first_turn int, end_turn int, n_repeated int, text string, loss_starts array<int>, loss_ends array<int>, over boolean"
_WINDOWS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int32()), ("end_turn", pa.int32()), ("n_repeated", pa.int32()), ("text", pa.string()),
    ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("over", pa.bool_()),
])


class Rows:
    """Rows gathered into batches of about 4 MB."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.cols, self.size = schema, [[] for _ in schema], 0

    def add(self, row: tuple, size: int) -> None:
        for col, v in zip(self.cols, row):
            col.append(v)
        self.size += size

    def batches(self, least: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        if self.cols[0] and self.size >= least:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(self.cols, self.schema)], schema=self.schema)
            self.cols, self.size = [[] for _ in self.schema], 0


_NONE = object()


def format_windows(df: DataFrame, tokenizer: str, *, budget: int = 512, history: int = 2, pattern: str = "") -> DataFrame:
    """The windows of each conversation of ``df`` (conv_id, turn, role, text), each conversation's together and in order.

    The tokens of the template's marks count with the turn.  ``pattern``: how ranks (.tiktoken) split a text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, out = Counter.of(tokenizer, pattern), Rows(_WINDOWS_ARROW)
        key, made, k = _NONE, Windows(budget, history), 0

        def put(windows: list[Window]) -> None:
            nonlocal k
            for w in windows:
                out.add((key, k, *w), len(w[3]))
                k += 1

        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                convs, roles, texts = (part.column(c).to_pylist() for c in (0, 2, 3))
                costs = count([f"{START}{escape_role(r)}\n{escape(x)}{END}" for r, x in zip(roles, texts)])
                for conv, role, text, cost in zip(convs, roles, texts, costs):
                    if conv != key or key is _NONE:
                        put(made.finish())
                        key, made, k = conv, Windows(budget, history), 0
                    put(made.add(role, text, cost))
                    yield from out.batches()
        put(made.finish())
        yield from out.batches(0)

    only = df.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    # A sort spills: no conversation is gathered in the JVM.
    return only.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_DIGESTS_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(windows: DataFrame, *, together: bool = False) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the formatted windows alone.

    ``together``: each conversation's windows stand together and in order, as ``format_windows`` gives them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key = Rows(_DIGESTS_ARROW), _NONE
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = k = 0
        for batch in batches:
            for conv, repeated, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss_starts", "loss_ends"))):
                if conv != key or key is _NONE:
                    if key is not _NONE:
                        out.add((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, k), 200)
                    key, turns, loss = conv, hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = k = 0
                k += 1
                chars += len(text)
                for i, m in enumerate(_TURN.finditer(text)):
                    if i >= repeated:
                        turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                for a, b in zip(starts, ends):
                    own = unescape(text[a:b])
                    loss_chars += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
            yield from out.batches()
        if key is not _NONE:
            out.add((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, k), 200)
        yield from out.batches(0)

    only = windows.select("conv_id", "window", "n_repeated", "text", "loss_starts", "loss_ends")
    if not together:
        only = only.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return only.mapInArrow(run, DIGESTS)


def op9_budgeted_windows(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "<|im_end|><|im_start|>assistant ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    windows = format_windows(rows.unionByName(own), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return read_back(windows, together=True)
