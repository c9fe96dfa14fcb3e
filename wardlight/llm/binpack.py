"""Packing of documents into sequences of bounded length by linear grouping.

What decides a packing is how many pieces have each length, at most `capacity` numbers; so the
driver plans with these, and the plan is a list of intervals of the pieces' places in descending
order of length. Pieces find their own sequence from their place. Large pieces: lengths are rounded up
within groups of equal cardinality, a linear program finds the configurations of these few sizes,
and the actual pieces take their slots. What room they really leave is counted again, and the
pieces that are left, the longest first, go where they fit best.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize, scratch, small_batches
from .running import running

CAPACITY = 2048
#: Groups of large lengths; lengths over capacity // LARGE are large.
GROUPS, LARGE = 256, 3
#: Share of the sequences by which the fractions may exceed the least number.
NEAR = 1e-4
#: Words whose ids a worker keeps, in about 200 MB; characters of a text that are split at once; words encoded in one call.
KEPT_WORDS, SLICE, AT_ONCE = 800_000, 1 << 20, 2000
END = np.zeros(1, "<u4").tobytes()
#: Stands between words that are encoded together; words that hold it are encoded alone.
BETWEEN = "\x01"
#: Signs behind a word; behind a letter or digit the tokenizer always parts them from it.
BEHIND = ",.;:!?)"
GAPS = (" ", "\n", "\t", "\r")
#: What str.split takes for white space, other than the tokenizer.
ODD = re.compile("[\x1c-\x1f]")


class Words:
    """Ids of texts by the tokenizers library, which is asked once for each word kept.

    The tokenizer drops white space and never joins what stands on either side of it, so a text's ids
    are its words' ids one after another. Words are lowered first where that changes nothing: the
    tokenizer lowers them too, after bringing them to the composed form.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.encoder, self.known = Tokenizer.from_file(file), {}
        self.mark = self.encode(BETWEEN)

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode(text, add_special_tokens=False).ids

    def slices(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            cut = len(text) if len(text) - at <= SLICE else max(text.rfind(g, at, at + SLICE) for g in GAPS)
            if cut <= at:  # no gap in the slice: the next one
                cut = min((i for i in (text.find(g, at + SLICE) for g in GAPS) if i > 0), default=len(text))
            part = text[at:cut]
            if "Σ" not in part and (part.isascii() or is_normalized("NFC", part)):
                low = part.lower()
                part = low if part.isascii() or is_normalized("NFC", low) else part
            if ODD.search(part):
                yield [w for gap in part.split("\n") for w in gap.replace("\t", " ").replace("\r", " ").split(" ") if w]
            else:
                yield part.split()
            at = cut

    def learn(self, missing: list[str]) -> None:
        for k in range(0, len(missing), AT_ONCE):
            part = missing[k : k + AT_ONCE]
            alone = [w for w in part if BETWEEN in w]
            self.known.update((w, np.array(self.encode(w), "<u4").tobytes()) for w in alone)
            part = [w for w in part if BETWEEN not in w] if alone else part
            if not part:
                continue
            ids = np.array(self.encode(f" {BETWEEN} ".join(part)), "<u4")
            cuts, raw, n = np.flatnonzero(ids == self.mark[0]).tolist(), ids.tobytes(), len(self.mark)
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, [0, *(c + n for c in cuts)], [*cuts, len(ids)], strict=True))

    def ids(self, words: list[str]) -> bytes:
        """Little-endian ids of four bytes."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = list(map(self.known.get, words))  # one look at a large table for each word
        if None not in found:
            return b"".join(found)
        missing = {w for w, ids in zip(words, found, strict=True) if ids is None}
        parted = {}
        for word in missing:
            bare = word.rstrip(BEHIND)
            if bare and len(bare) < len(word) and bare[-1].isalnum() and bare[-1] < "\u0250":
                parted[word] = (bare, word[len(bare) :])
        self.learn([w for w in {*missing.difference(parted), *(p for own in parted.values() for p in own)} if w not in self.known])
        self.known.update((w, self.known[bare] + self.known[signs]) for w, (bare, signs) in parted.items())
        return b"".join(self.known[w] if ids is None else ids for w, ids in zip(words, found, strict=True))


@lru_cache(maxsize=4)
def words_of(file: str) -> Words:
    return Words(file)


def pieces(df: DataFrame, tokenizer_file: str, capacity: int, text_col: str, id_col: str) -> DataFrame:
    """id_col, piece, length, ids_crc32: each document's ids and an end, cut only where they exceed the capacity."""

    def cut(text: str | None) -> tuple[list[int], list[int]]:
        tokenizer, held, lengths, sums, size = words_of(tokenizer_file), b"", [], [], 4 * capacity
        for words in tokenizer.slices(text or ""):
            held += tokenizer.ids(words)
            while len(held) > size:  # the end is still to come
                whole = len(held) // size - (len(held) % size == 0)
                for k in range(whole):
                    sums.append(zlib.crc32(held[k * size : (k + 1) * size]))
                lengths += [capacity] * whole
                held = held[whole * size :]
        held += END
        for k in range(0, len(held), size):
            sums.append(zlib.crc32(held[k : k + size]))
            lengths.append(len(held[k : k + size]) // 4)
        return lengths, sums

    made = map_texts(df, text_col, [id_col], "n_ array<int>, c_ array<long>", cut).toDF("i", "n", "c")
    return made.select("i", F.posexplode(F.arrays_zip("n", "c"))).select("i", F.col("pos").alias("piece"), F.col("col.n").alias("length"), F.col("col.c").alias("ids_crc32"))


def best_pattern(worth: np.ndarray, sizes: list[int], capacity: int) -> tuple[np.ndarray, float]:
    """How many of each size fill one sequence for the most worth: a knapsack over the capacity."""
    value, took = np.zeros(capacity + 1), np.zeros((len(sizes), capacity + 1), np.int16)
    for g, size in enumerate(sizes):
        before = value.copy()
        for c in range(1, capacity // size + 1) if worth[g] > 0 else ():
            filled = before[: -c * size] + c * worth[g]
            better = filled > value[c * size :] + 1e-12
            value[c * size :][better] = filled[better]
            took[g, c * size :][better] = c
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for g in range(len(sizes) - 1, -1, -1):
        pattern[g] = took[g, room]
        room -= int(pattern[g]) * sizes[g]
    return pattern, float(value[capacity])


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """(pattern, copies): the fewest sequences in fractions that hold `demand` of each size, by column generation.

    Ends within NEAR of the least number possible, which the worth of the best pattern bounds from
    below. At most one pattern for each size.
    """
    k = len(sizes)
    fill = np.array([capacity // s for s in sizes], float)
    base, inverse, need = np.diag(fill), np.diag(1 / fill), np.array(demand, float)
    for turn in range(50 * k + 50):
        if turn % 256 == 255:
            inverse = np.linalg.inv(base)  # rounding of the steps goes
        copies = np.maximum(inverse @ need, 0)
        pattern, value = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-9 or copies.sum() * (1 - 1 / value) <= max(0.25, NEAR * copies.sum()):
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, copies / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        base[:, out] = pattern
        row = inverse[out] / direction[out]
        direction[out] = 0
        inverse -= np.outer(direction, row)
        inverse[out] = row
    copies = np.maximum(np.linalg.solve(base, need), 0)
    return [(base[:, j].astype(np.int64), float(copies[j])) for j in range(k)]


def runs(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(length, first place, number), the longest first."""
    out, at = [], 0
    for length in sorted(counts, reverse=True):
        out.append((length, at, counts[length]))
        at += counts[length]
    return out


def grouped(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: int = LARGE) -> list[tuple[int, int, int]]:
    """(size, first place, number) of the groups of large lengths; the size is the longest of a group.

    Pieces that fill a sequence are a group of their own; the others are dealt to groups of equal
    cardinality, or one for each length if there are no more of these.
    """
    rows = [r for r in runs(counts) if r[0] > capacity // large]
    out, rest = [r for r in rows if r[0] == capacity], [r for r in rows if r[0] < capacity]
    if len(rest) <= groups:
        return out + rest
    first, number = rest[0][1], sum(r[2] for r in rest)
    edges = sorted({first + number * g // groups for g in range(groups)})
    places = [r[1] for r in rest]
    for a, b in zip(edges, [*edges[1:], first + number], strict=True):
        size = rest[bisect_left(places, a + 1) - 1][0]
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1], out[-1][2] + b - a)
        else:
            out.append((size, a, b - a))
    return out


def slots(groups: list[tuple[int, int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]], int]:
    """Intervals (first place, number, first sequence, copies) of the pieces with slots, (first place, number) of those without, and the number of sequences.

    Place p of an interval goes to the sequence first + (p - first place) % copies. Whole copies of each configuration are taken.
    """
    if not groups:
        return [], [], 0
    found = configurations([g[0] for g in groups], [g[2] for g in groups], capacity)
    used, out, sequences = [0] * len(groups), [], 0
    for pattern, copies in found:
        copies = int(copies + 1e-9)
        if not copies:
            continue
        for g in np.flatnonzero(pattern).tolist():
            _, first, number = groups[g]
            n = min(int(pattern[g]) * copies, number - used[g])
            if n > 0:
                out.append((first + used[g], n, sequences, copies))
                used[g] += n
        sequences += copies
    left = [(first + u, number - u) for (_, first, number), u in zip(groups, used, strict=True) if u < number]
    return sorted(out), left, sequences


def best_fit(items: list[tuple[int, int, int]], rooms: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """Events (first place, first sequence, pieces for each) of best fit, and how many sequences there are then.

    items: (length, first place, number), the longest first. rooms: how many sequences have each room;
    they are numbered by room and then opened anew. Sequences of one history are handled together.
    """
    waiting: dict[int, list[tuple[int, int]]] = {}
    number = 0
    for room in sorted(rooms):
        waiting[room] = [(number, rooms[room])]
        number += rooms[room]
    order, out = sorted(r for r in waiting if r), []
    for length, at, left in items:
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                opened = -(-left // (capacity // length))
                put(waiting, order, capacity, (number, opened))
                number += opened
                i = bisect_left(order, length)
            room = order[i]
            first, n = waiting[room].pop()
            if not waiting[room]:
                order.pop(i)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((at, first, each))
                at, left = at + full * each, left - full * each
                put(waiting, order, room - each * length, (first, full))
                first, n = first + full, n - full
            if n and left:  # the last one takes what is left
                out.append((at, first, left))
                put(waiting, order, room - left * length, (first, 1))
                at, left, first, n = at + left, 0, first + 1, n - 1
            if n:
                put(waiting, order, room, (first, n))
    return out, number


def put(waiting: dict[int, list[tuple[int, int]]], order: list[int], room: int, group: tuple[int, int]) -> None:
    if room and not waiting.setdefault(room, []):
        insort(order, room)
    if room:
        waiting[room].append(group)


def of_places(items: list[tuple[int, int, int]], ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """items (length, first place, number) within the ranges (first place, number), both by place."""
    out = []
    for a, n in ranges:
        for length, first, number in items:
            low, high = max(a, first), min(a + n, first + number)
            if low < high:
                out.append((length, low, high - low))
    return out


def mapped(df: DataFrame, starts: np.ndarray, fn, name: str) -> DataFrame:
    """df with column `name` (long): fn(places, their intervals' numbers) of the column place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    arrow, at = to_arrow_schema(schema), df.columns.index("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(at).to_numpy()
            found = fn(place, np.searchsorted(starts, place, "right") - 1)
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)], pa.array(found, pa.int64())], schema=arrow)

    return df.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, groups: int = GROUPS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per piece of each document: which sequence holds it, and where.

    A null or empty text is its end alone. Repeated rows are packed as often as they occur. An empty
    table gives an empty result. Other columns, whatever their names, take no part. Pieces of one length are
    alike to the plan; ties are ordered by id and piece. Result: id_col, piece, start, length, ids_crc32,
    sequence_id (from 0, without gaps), offset.
    """
    with scratch() as keep:
        small_batches(df.sparkSession)
        cut = materialize(pieces(df, tokenizer_file, capacity, text_col, id_col).withColumn("short", -F.col("length")), "pack-pieces")
        counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
        placed = running(cut, ["short", "i", "piece"], [], "pack-placed").drop("short")
        taken, left, sequences = slots(grouped(counts, capacity, groups), capacity)
        every = runs(counts)
        small = [r for r in every if r[0] <= capacity // LARGE]

        bounds = sorted([(a, n, q, m) for a, n, q, m in taken] + [(a, n, -1, 1) for a, n in left] + [(r[1], r[2], -1, 1) for r in small])
        starts, first, copies = (np.array([b[k] for b in bounds], np.int64) for k in (0, 2, 3))
        slot = lambda p, i: np.where(first[i] < 0, -1, first[i] + (p - starts[i]) % copies[i])
        slotted = materialize(mapped(placed, starts, slot, "slot"), "pack-slotted")

        rooms = slotted.where("slot >= 0").groupBy("slot").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("room"))
        rooms = materialize(rooms, "pack-rooms")
        free = {r[0]: r[1] for r in rooms.groupBy("room").count().collect()}  # at most `capacity` rows
        events, _ = best_fit(of_places(every, left) + small, free, capacity)
        number = running(rooms, ["room", "slot"], [], "pack-numbered").select("slot", F.col("place").alias("sequence_id"))
        events.sort()
        begins, goal, each = (np.array([e[k] for e in events], np.int64) for k in range(3))
        fitted = mapped(slotted.where("slot < 0"), begins, lambda p, i: goal[i] + (p - begins[i]) // each[i], "sequence_id")
        held = slotted.where("slot >= 0").join(number, "slot")
        columns = ["i", "piece", "length", "ids_crc32", "place", "sequence_id"]
        both = held.select(columns).union(fitted.select(columns))
        order = Window.partitionBy("sequence_id").orderBy("place")  # at most `capacity` rows of each
        offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
        out = both.select(F.col("i").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))
        return keep(out, "pack")
