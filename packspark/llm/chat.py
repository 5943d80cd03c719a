r"""Chat formatting in budgeted windows.

Turns of a conversation, in order, become windows of at most ``budget`` tokens: prefix sums of turn
tokens choose spans that start and end at turns.  Tokens are those of a turn as rendered, with
template and escapes.  Every window retains the leading system turn
and repeats limited history before its new turns; only new assistant turns are under the loss
mask, so a repeated target is masked and each target counts once.  A turn that with the system turn
is too long for the budget gets a window of its own (with the system turn), never a cut.

Template: a turn is ``### role: text</turn>`` and a line end.  In texts, backslash, ``#`` and ``<`` are preceded
by a backslash (in roles ``:`` too), so neither control string can occur inside a text, and
``read_turns`` inverts the template exactly.

Conversations are dealt out by id, sorted by turn and streamed: a task holds the history of one
window, never a conversation, whose length doesn't matter.  A conversation stays in one task, as its
windows depend on those before.

Defined results: a null text is empty, a null role is the empty role; rows without a conv_id form one
conversation; null turns come first; ties of turn go by role, then text; repeated rows are turns of their own; an
empty table gives no windows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.llm.tokens import count_tokens

HEAD, SEP, END = "### ", ": ", "</turn>\n"
TARGET, SYSTEM = "assistant", "system"
BUDGET = 512            # tokens of a window, with what it retains and repeats
HISTORY_TURNS = 4       # repeated turns at most ...
HISTORY_SHARE = 0.25    # ... and the share of the budget they may take

WINDOWS = ("conv_id bigint, window int, n_context int, n_new int, n_tokens bigint, formatted string, "
           "loss array<struct<start:int,end:int>>")
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str, marks: str = "#<") -> str:
    text = text.replace("\\", "\\\\")
    for m in marks:
        text = text.replace(m, "\\" + m)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out += (text[at:i], text[i + 1:i + 2])
        at = i + 2
    return "".join(out) + text[at:]


def _plain_end(text: str, mark: str, at: int) -> int:
    """Where ``mark`` next occurs with no escape before its first character."""
    while True:
        i = text.index(mark, at)
        j = i
        while j > at and text[j - 1] == "\\":
            j -= 1
        if (i - j) % 2 == 0:
            return i
        at = i + 1


def _parts(role: str, text: str) -> tuple[str, str, str]:
    return HEAD + escape(role, "#<:") + SEP, escape(text), END


def rendered(role: str, text: str) -> str:
    """One formatted turn."""
    return "".join(_parts(role, text))


def render(turns: list[tuple[str, str]], first_new: int) -> tuple[str, list[tuple[int, int]]]:
    """Formatted turns and the spans (characters) of the new assistant texts in it."""
    out, at, loss = [], 0, []
    for k, (role, text) in enumerate(turns):
        head, body, end = _parts(role, text)
        if k >= first_new and role == TARGET:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, end)
        at += len(head) + len(body) + len(end)
    return "".join(out), loss


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(formatted):
        a = at + len(HEAD)
        b = _plain_end(formatted, SEP, a)
        c = _plain_end(formatted, END, b + len(SEP))
        yield unescape(formatted[a:b]), unescape(formatted[b + len(SEP):c])
        at = c + len(END)


class Windows:
    """Turns of one conversation in, windows out; keeps a window's turns and the history at most."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.system: tuple[str, str, int] | None = None
        self.history: deque = deque()
        self.new: list = []
        self.used = 0
        self.seen = 0
        self.window = 0

    def add(self, role: str, text: str, n: int) -> Iterator[tuple]:
        """Prefix sums decide: a turn that would end beyond the budget starts the next window."""
        if self.new and self.used + n > self.budget:
            yield self._close()
        if not self.new:
            self._retain(n)
        self.new.append((role, text, n))
        self.used += n
        if self.seen == 0 and role == SYSTEM:
            self.system = (role, text, n)
        self.seen += 1

    def _retain(self, n: int) -> None:
        """The system turn, then as many last turns as their limits and the next turn leave room for."""
        self.used = self.system[2] if self.system else 0
        kept, tokens = [], 0
        for turn in reversed(self.history):
            if tokens + turn[2] > self.history_tokens or self.used + tokens + turn[2] + n > self.budget:
                break
            kept.append(turn)
            tokens += turn[2]
        self.context = ([self.system] if self.system else []) + kept[::-1]
        self.used += tokens

    def _close(self) -> tuple:
        turns = self.context + self.new
        formatted, loss = render([t[:2] for t in turns], len(self.context))
        row = (self.window, len(self.context), len(self.new), self.used, formatted, loss)
        past = self.new[1:] if self.window == 0 and self.system else self.new
        self.history.extend(past[-self.history_turns:])
        while len(self.history) > self.history_turns:
            self.history.popleft()
        self.new = []
        self.window += 1
        return row

    def end(self) -> Iterator[tuple]:
        if self.new:
            yield self._close()


def _streamed(batches: Iterator[pa.RecordBatch], start, step, finish, schema: pa.Schema,
              rows_out: int = 1000) -> Iterator[pa.RecordBatch]:
    """Runs a state machine over sorted rows: ``start()`` at a new conv_id, ``step(state, row)`` per row,
    ``finish(state)`` at its end; both yield tuples without the conv_id."""
    state, key, out = None, None, []
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        cols = [batch.column(c).to_pylist() for c in batch.schema.names if c != "conv_id"]
        for k, *row in zip(ids, *cols):
            if state is None or k != key:
                if state is not None:
                    out += [(key, *x) for x in finish(state)]
                state, key = start(), k
            out += [(key, *x) for x in step(state, row)]
            if len(out) >= rows_out:
                yield _batch(out, schema)
                out = []
    if state is not None:
        out += [(key, *x) for x in finish(state)]
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _windows_schema() -> pa.Schema:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("n_context", pa.int32()), ("n_new", pa.int32()),
                      ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])


def format_windows(turns: DataFrame, ranks: bytes, pattern: str, budget: int = BUDGET,
                   history_turns: int = HISTORY_TURNS, history_share: float = HISTORY_SHARE) -> DataFrame:
    """Windows of all conversations, rows of a conversation together and in order.

    A window's ``n_tokens`` is the sum of its turns' tokens, and that of the whole encoded window if the
    pattern splits between a line end and ``#``, as the public one does."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = count_tokens(rows, ranks, pattern, ["role", "text"], rendered, "n") \
        .select("conv_id", "turn", "role", "text", "n")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .select("conv_id", "role", "text", "n")
    limit = int(history_share * budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(w: Windows, row: list) -> Iterator[tuple]:
            return pack(w.add(*row))

        def pack(made: Iterator[tuple]) -> Iterator[tuple]:
            for *row, loss in made:
                yield (*row, [{"start": a, "end": b} for a, b in loss])

        yield from _streamed(batches, lambda: Windows(budget, history_turns, limit), step, lambda w: pack(w.end()),
                             _windows_schema(), 200)

    return ordered.mapInArrow(run, WINDOWS)


class Reader:
    """Reads windows back in order: hashes of all turns and of the text under the mask."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, n_context: int, formatted: str, loss: list[dict]) -> None:
        self.formatted_chars += len(formatted)
        for k, (role, text) in enumerate(read_turns(formatted)):
            if k >= n_context:
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"]:span["end"]])
            self.loss.update(text.encode("utf-8", "replace"))
            self.loss_chars += len(text)

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows say.  Takes windows as ``format_windows`` leaves them (together
    and in order); windows from storage are to be dealt by conv_id and sorted by window first."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(r: Reader, row: list) -> tuple:
            r.add(*row)
            return ()

        yield from _streamed(batches, Reader, step, lambda r: [r.row()], schema)

    return windows.select("conv_id", "n_context", "formatted", "loss").mapInArrow(run, READ)
