"""Chat formatting at token level: segments are encoded apart, reserved ids spliced between them.

A turn is START role \\n text END \\n. START and END are ids outside the rank file, so no text can
produce them. For the rendered form their names must not occur in contents either: there
backslashes are doubled and `<|` becomes `<\\|`, which unescape takes back.

A conversation is one string of ids with a mask beside it, stored in pieces of PIECE ids that don't
heed turns, so that a conversation of any length is many small rows; what is reported of it is read back from
these alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode, encoder
from .common import small_batches

#: Reserved ids, counted from the size of the rank file, and their names.
START, END = "<|im_start|>", "<|im_end|>"
#: Ids of a stored piece.
PIECE = 1 << 16
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, line: bool = False) -> str:
    """line: newlines too, so that a role stays on its line."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


class Template:
    """Encodes turns and reads token ids back, for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        self.rank_file, self.pattern = rank_file, pattern
        self.raw = encoder(rank_file, pattern)[1]
        self.start, self.end = len(self.raw), len(self.raw) + 1
        self.newline = encode("\n", rank_file, pattern)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn and the loss mask, which covers an assistant's text.

        The mask is the prefix sum of +1 where a segment that counts begins and -1 where it ends.
        """
        segments = [
            ([self.start], 0),
            (encode(escape(role, line=True), self.rank_file, self.pattern), 0),
            (self.newline, 0),
            (encode(escape(text), self.rank_file, self.pattern), int(role == "assistant")),
            ([self.end], 0),
            (self.newline, 0),
        ]
        places = np.cumsum([0, *(len(ids) for ids, _ in segments)])
        edges = np.zeros(places[-1] + 1, np.int64)
        for (_, counts), a, b in zip(segments, places, places[1:], strict=False):
            edges[a] += counts
            edges[b] -= counts
        return np.concatenate([np.asarray(ids, np.int32) for ids, _ in segments]), np.cumsum(edges)[:-1].astype(np.int8)

    def text_of(self, ids) -> str:
        return b"".join([self.raw[i] for i in ids]).decode()

    def render(self, ids) -> str:
        names = {self.start: START.encode(), self.end: END.encode()}
        return b"".join([names.get(i) or self.raw[i] for i in ids]).decode()

    def read_turn(self, ids: list[int]) -> tuple[str, str]:
        """(role, text) of one turn's ids."""
        if ids[0] != self.start or ids[-len(self.newline) - 1] != self.end:
            raise ValueError("not a turn")
        role, _, text = self.text_of(ids[1 : -len(self.newline) - 1]).partition("\n")
        return unescape(role), unescape(text)

    def read(self, ids: list[int]) -> list[tuple[str, str]]:
        """All turns of a conversation's ids."""
        starts = [k for k, i in enumerate(ids) if i == self.start]
        return [self.read_turn(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


TURN_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def format_turns(df: DataFrame, rank_file: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, ids (little-endian int32), mask (int8), as binary.

    The ids of a conversation are those of its rows one after the other, by turn (ties by role and
    text, so repeated rows repeat). Null texts and roles count as empty; rows with a null
    conversation form one of their own. Turns are encoded where they lie, before any shuffle.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("tie", pa.string()), ("ids", pa.binary()), ("mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(rank_file, pattern)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                made = [template.turn(r, t) for r, t in zip(roles, texts, strict=True)]
                ties = [hashlib.sha256(f"{r}\n{t}".encode()).hexdigest() for r, t in zip(roles, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ties, pa.string()), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([m.tobytes() for _, m in made], pa.binary())], schema=out)

    return rows.mapInArrow(run, "conv_id long, turn long, tie string, ids binary, mask binary")


def in_order(turns: DataFrame) -> DataFrame:
    """Each conversation's turns together and in order; sorting spills, so no conversation must fit memory."""
    return turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "tie")


def assemble(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The ids of each conversation as one string, in rows of `piece` ids: conv_id, piece (0, 1 ...), ids, mask (binary, as of turns).

    Rows of a conversation follow each other in order within a partition. An empty table gives an empty result.
    """
    out = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        for conv, rows in conversations(batches):
            ids, mask, n = bytearray(), bytearray(), 0
            for i, m in rows:
                ids += i
                mask += m
                while len(mask) >= piece:
                    ready.append((conv, n, bytes(ids[: 4 * piece]), bytes(mask[:piece])))
                    del ids[: 4 * piece], mask[:piece]
                    n, size = n + 1, size + piece
                    if size >= PIECE:
                        yield table_of(ready, out)
                        ready, size = [], 0
            if mask or not n:
                ready.append((conv, n, bytes(ids), bytes(mask)))
                size += len(mask)
            if size >= PIECE or len(ready) >= 1024:
                yield table_of(ready, out)
                ready, size = [], 0
        if ready:
            yield table_of(ready, out)

    return in_order(turns).mapInArrow(run, "conv_id long, piece long, ids binary, mask binary")


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*rows, strict=True))], schema=schema)


def turns_of(pieces: Iterator[tuple[bytes, bytes]], start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of each turn of a conversation's pieces: turns begin at the reserved id `start`, which no text can hold."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for ids, mask in pieces:
        ids, mask = np.frombuffer(ids, "<i4"), np.frombuffer(mask, np.int8)
        edges = [0, *np.flatnonzero(ids == start).tolist(), len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if k and held:  # a turn begins, so the one before is whole
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held = []
            if b > a:
                held.append((ids[a:b], mask[a:b]))
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[bytes, bytes]]]]:
    """(conv_id, its (ids, mask) rows one at a time) of sorted batches."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column("conv_id")[k].as_py(), batch.column("ids")[k].as_py(), batch.column("mask")[k].as_py()

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        yield conv, ((i, m) for _, i, m in own)


def conversation_digest(df: DataFrame, rank_file: str, pattern: str, piece: int = PIECE) -> DataFrame:
    """Formats all conversations into strings of ids and reports what is read back from these and their masks.

    Null texts and roles count as empty, rows with a null conversation form one of their own, repeated rows
    repeat, an empty table gives an empty result, and other columns, whatever their names, take no part.
    Result: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.
    Digests are fed turn by turn, so a conversation of any length takes the memory of its longest turn.
    """
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, ready = Template(rank_file, pattern), []
        for conv, pieces in conversations(batches):
            turns, loss, n, chars, shown, tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for ids, mask in turns_of(pieces, template.start):
                role, text = template.read_turn(ids.tolist())
                turns.update(f"{role}\n{text}\n".encode())
                counted = unescape(template.text_of(ids[mask == 1].tolist()))
                loss.update(counted.encode())
                n, chars, shown, tokens = n + 1, chars + len(counted), shown + len(template.render(ids.tolist())), tokens + len(ids)
            ready.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), shown, tokens))
            if len(ready) >= 512:
                yield table_of(ready, out)
                ready = []
        if ready:
            yield table_of(ready, out)

    pieces = assemble(format_turns(df, rank_file, pattern), piece)
    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
