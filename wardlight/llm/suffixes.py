"""Suffix-array deduplication: repeated byte strings from Burrows-Wheeler transforms merged shard by shard.

Symbols. A text is parsed at anchors: in each run of some places the gram of the smallest hash. A
repeated string has the same anchors wherever it stands, but for those near its ends. The bytes
between two anchors, with the second one's gram, are one symbol; the text is a string of symbols
that begins with a head, and ends with a tail and END.

Shards. Each shard sorts the suffixes of its strings once, to the end, and keeps that order, the
common prefix of neighbours and the transform's step back to the suffix that begins a symbol before.

Merge. The interleave of all shards is refined level by level: at level h its blocks hold the
suffixes that agree in h symbols, each block an interval of every shard's order. Where a block
splits, the neighbours' common prefix is shorter than the level. A level comes from the one before by
STEP walks back through the transform: the block of a suffix is told by the blocks of its STEP
parts. Shards exchange each interval once with its size; of the summed sizes, one of 1 ends a block, and
any other gets a number that no other block has. No suffix is sorted again, no merged order is gathered
in one place, and the merge goes on until no block is left or all lengths that windows need are there.

Repeats. A window (the bytes of one string looked for) is covered by the symbols that it touches. If they
are a block of the merged transform, it repeats. Else its edges stick out of its repeated block: windows
are equal that have the same block, by its number, and the same bytes before and behind it. So
edges are asked about only where the merge has a block, and without its blocks no window is found.
Windows of several lengths are told by the same blocks: the parse is made for the shortest, and the
lengths share every question but the one about edges.

Keys are 128 bits, so that among 10^14 strings two that differ meet with a chance below 10^-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, materialize_by, parts_for, scratch, small_batches, tidy
from .exchange import ANSWER, ASKED, arrow, distinct, fans, joined, owner, rows_of, totals, value
from .packing import mix, pack, unpack

#: A repeat is a string of LENGTH bytes; anchors are strings of GRAM bytes.
LENGTH, GRAM = 400, 32
#: Passages of over 50 words have more bytes than this, short set phrases have fewer.
PASSAGE = 256
#: A level's blocks are told by STEP blocks of the level before.
STEP = 4
#: Text of a shard, and of a range of keys.
SHARD_BYTES, RANGE_BYTES, LEAST_RANGES = 2 << 20, 16 << 20, 8
#: Places hashed at once.
CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
#: Beyond any common prefix: suffixes that agree to their end.
WHOLE = 1 << 40
END = np.uint64(1)  # even numbers are blocks

u64 = np.uint64


def width_of(length: int, gram: int) -> int:
    """Places in a run: every window holds three runs, so at least three anchors and two whole symbols."""
    return max(1, (length - gram + 1) // 3)


class Hashes:
    """Hashes of any substrings of some bytes, by prefix sums of two polynomials modulo 2^64."""

    power = back = np.ones(1, np.uint64)
    values = [mix(np.arange(256, dtype=np.uint64), np.full(256, seed, np.uint64)) | u64(1) for seed in (77, 78)]

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes.power) < n:
            room = -(-n // CHUNK) * CHUNK  # so that texts hardly longer don't need new ones
            for name, by in (("power", BASE), ("back", pow(BASE, -1, 1 << 64))):
                steps = np.full(room, by, np.uint64)
                steps[0] = 1
                setattr(Hashes, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = []
        for value in self.values:
            sums = np.zeros(n, np.uint64)
            np.multiply(value[data], Hashes.power[: n - 1], out=sums[1:])
            self.sums.append(np.cumsum(sums, dtype=np.uint64, out=sums))

    def of(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return mix((s[b] - s[a]) * Hashes.back[a], (b - a).astype(np.uint64))

    def grams(self, a: int, b: int, size: int) -> np.ndarray:
        """Hashes of the strings of `size` bytes that start at a to b, which tell anchors by their high bits."""
        s = self.sums[0]
        found = s[a + size : b + size] - s[a:b]
        found *= Hashes.back[a:b]
        return found


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by minima of blocks from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(hashes: Hashes, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all texts of at least length bytes that lie one after the other: places, and the first run of each.

    A run is named by its first place; the runs of an anchor follow each other. Equal hashes count
    by place, leftmost first.
    """
    width, n = width_of(length, gram), len(hashes.sums[0]) - 1
    runs = n - gram - width + 2
    if runs <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(runs + 1, np.int32)  # runs that lie within a text
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, np.minimum(runs, (starts + sizes - gram - width + 2)[long]), -1)
    inside = np.cumsum(inside[:-1]) > 0
    low, places, firsts = u64((1 << 21) - 1), [], []
    for a in range(0, runs, CHUNK):
        b = min(runs, a + CHUNK)
        if not inside[a:b].any():
            continue
        found = hashes.grams(a, b + width - 1, gram)
        found = (smallest((found & ~low) | np.arange(len(found), dtype=np.uint64), width) & low).astype(np.int64) + a
        own = np.flatnonzero(inside[a:b])
        found = found[own]
        turns = np.flatnonzero(np.diff(found, prepend=-1))
        places.append(found[turns])
        firsts.append(own[turns] + a)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, firsts = np.concatenate(places), np.concatenate(firsts)
    new = np.diff(places, prepend=-1) != 0  # an anchor of two chunks
    return places[new], firsts[new]


class Shard:
    """Parse of a shard's texts, the order of their suffixes, and what the merge says about them.

    Texts lie one after the other. counts: anchors of each text (0: too short, no symbols). Of the
    order: suffix (the symbol that begins it) and common (symbols that it shares with the one before).
    lengths: of the windows, the shortest first, for which the texts are parsed.
    """

    def __init__(self, length: int, gram: int, sizes: np.ndarray, counts: np.ndarray, places: np.ndarray, firsts: np.ndarray, keys: list[np.ndarray], order: np.ndarray, common: np.ndarray, longer: tuple[int, ...] = ()):
        self.lengths = (length, *longer)
        self.length, self.gram, self.sizes, self.counts, self.places, self.firsts, self.keys, self.order, self.common = length, gram, sizes, counts, places, firsts, keys, order, common
        self.starts = np.cumsum(sizes) - sizes
        self.begin, self.end, self.last, self.of_anchor = self.symbols(sizes, counts, places, gram)
        n = len(order)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.place = place
        first = np.zeros(n, bool)
        first[np.unique(self.last)[:-1] + 1 if n else []] = True
        first[0:1] = True
        #: The transform: place of the suffix that begins a symbol before, -1 at a text's start.
        self.back = np.where(first[order], -1, place[order - 1]) if n else np.zeros(0, np.int64)

    @staticmethod
    def symbols(sizes: np.ndarray, counts: np.ndarray, places: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all symbols: begin, end, last symbol of the own text; and the symbol that begins at each anchor."""
        parsed = np.flatnonzero(counts)
        starts = (np.cumsum(sizes) - sizes)[parsed]
        strings = counts[parsed] + 1
        heads = np.cumsum(strings) - strings
        total = int(strings.sum())
        of_anchor = np.arange(len(places)) + np.repeat(np.arange(len(parsed)), counts[parsed]) + 1
        begin, end = np.zeros(total, np.int64), np.zeros(total, np.int64)
        begin[heads], begin[of_anchor] = starts, places
        end[of_anchor - 1] = places + gram
        end[heads + strings - 1] = starts + sizes[parsed]
        return begin, end, np.repeat(heads + strings - 1, strings), of_anchor

    @classmethod
    def of(cls, texts: list[bytes], length: int, gram: int, longer: tuple[int, ...] = ()) -> Shard:
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        hashes = Hashes(np.frombuffer(b"".join(texts), np.uint8))
        places, firsts = anchors(hashes, starts, sizes, length, gram)
        counts = np.bincount(np.searchsorted(starts + sizes, places, "right"), minlength=len(sizes))[: len(sizes)] if len(sizes) else sizes
        begin, end, last, _ = cls.symbols(sizes, counts, places, gram)
        kind = np.zeros(len(begin), np.uint64)
        kind[last], kind[0:1] = 2, 1
        kind[np.unique(last)[:-1] + 1 if len(last) else []] = 1
        keys = [mix(hashes.of(w, begin, end), kind) for w in (0, 1)]
        return cls(length, gram, sizes, counts, places, firsts, keys, *cls.sort(keys, last), longer)

    @staticmethod
    def sort(keys: list[np.ndarray], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of all suffixes to their ends, END first, and the common prefixes of neighbours."""
        n, at = len(last), np.arange(len(last))
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number, longest = distinct(*keys, np.zeros(n, np.uint64))[1], int((last - at).max()) + 1
        sizes = np.bincount(number)
        # a suffix's rank is the first place of those that agree with it; only these are ranked anew
        ranks, alike = [(np.cumsum(sizes) - sizes + 1)[number]], np.flatnonzero(sizes[number] > 1)
        while (step := 1 << len(ranks) - 1) < longest and len(alike):
            rank = ranks[-1].copy()
            ahead = np.where(alike + step <= last[alike], rank[np.minimum(alike + step, n - 1)], 0)
            found, number, sizes = np.unique(rank[alike] * (n + 2) + ahead, return_inverse=True, return_counts=True)
            before, base = np.cumsum(sizes) - sizes, found // (n + 2)
            rank[alike] = (base + before - before[np.searchsorted(base, base)])[number]
            ranks.append(rank)
            alike = alike[sizes[number] > 1]
        order = np.argsort(ranks[-1], kind="stable")
        common = np.zeros(n, np.int64)
        own = np.flatnonzero(ranks[0][order[:-1]] == ranks[0][order[1:]])
        a, b = order[own], order[own + 1]
        same = np.zeros(len(own), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + same, b + same
            agree = (x <= last[a]) & (y <= last[b])
            agree[agree] = ranks[k][x[agree]] == ranks[k][y[agree]]
            same[agree] += 1 << k
        same[(a + same > last[a]) & (b + same > last[b])] = WHOLE
        common[own + 1] = same
        return order, common

    def dump(self) -> bytes:
        parts = [pack(self.sizes), pack(self.counts), pack(self.places), pack(self.firsts), *map(pack, self.keys), pack(self.order), pack(self.common)]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def load(cls, data: bytes, length: int, gram: int, longer: tuple[int, ...] = ()) -> Shard:
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(unpack(data[at + 8 : at + 8 + n]))
            at += 8 + n
        ints = [p.astype(np.int64) for p in (*parts[:4], *parts[6:])]
        return cls(length, gram, *ints[:4], parts[4:6], *ints[4:], longer)

    # The merge

    def intervals(self, h: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the order that agree in h symbols, where inside: their first places, and each place's interval (of all)."""
        heads = self.common < h
        number = np.cumsum(heads) - 1
        at = np.flatnonzero(heads)
        kept = inside[at]
        renumber = np.cumsum(kept) - 1
        return at[kept], np.where(inside, renumber[number], -1)

    def ahead(self, back: np.ndarray) -> np.ndarray:
        """Of each place the one that leads to it by `back`, -1 where none does."""
        out = np.full(len(back), -1, np.int64)
        ok = np.flatnonzero(back >= 0)
        out[back[ok]] = ok
        return out

    def level(self, h: int, block: np.ndarray | None, back: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Level h from the level before, whose blocks these are and whose symbols a step of `back` walks:
        (block where it doesn't change, first places of intervals asked about, interval of each place, their (keys, checks, counts))."""
        n = len(self.order)
        if block is None:
            carried, asked = np.zeros(n, np.uint64), np.ones(n, bool)
            parts = [key[self.order] for key in self.keys]
        else:
            ahead = self.ahead(back)
            over = ahead < 0  # the level before reaches END
            carried, asked = np.where(over, block, u64(0)), np.zeros(n, bool)
            at = own = np.flatnonzero((block > 0) & ~over)
            alive, pieces = np.ones(len(own), bool), [block[own]]
            for _ in range(1, STEP):
                at = np.where(at >= 0, ahead[at], -1)
                pieces.append(np.where(at < 0, END, block[at]))
                alive &= pieces[-1] > 0
            asked[own[alive]] = True
        heads, number = self.intervals(h, asked)
        if block is not None:
            pieces = [piece[np.searchsorted(own, heads)] for piece in pieces]
            parts = [pieces[0], pieces[-1]]
            for piece in pieces[1:]:
                parts[0] = mix(parts[0], piece)
            for piece in pieces[-2::-1]:
                parts[1] = mix(parts[1] ^ u64(0x5DEECE66D), piece)
        else:
            parts = [part[heads] for part in parts]
        sizes = np.bincount(number[number >= 0], minlength=len(heads)).astype(np.uint64)
        return carried, heads, number, (*parts, sizes)

    def merge(self, answers: dict[str, np.ndarray]) -> tuple[int, tuple | None, dict[int, np.ndarray]]:
        """(the level to ask about, what to ask, blocks of each suffix by level): as far as answers go."""
        h, block, back, done = 1, None, self.back, {}
        while True:
            carried, heads, number, asks = self.level(h, block, None if h == 1 else back)
            if f"x{h}" not in answers:
                return h, asks, done
            _, at, _, _, _ = distinct(*asks)
            found = value(answers[f"x{h}"])[at] << u64(1)
            block = np.where(number >= 0, np.concatenate([found, np.zeros(1, np.uint64)])[number], carried)
            done[h] = block[self.place]
            if h > 1:
                back = self.walk(back)
            h *= STEP

    def walk(self, back: np.ndarray) -> np.ndarray:
        out = back
        for _ in range(STEP - 1):
            out = np.where(out >= 0, back[out], -1)
        return out

    @staticmethod
    def told(blocks: dict[int, np.ndarray], first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings of `count` symbols from `first`: (whether all blocks that tell them are there, two keys)."""
        alive = np.ones(len(first), bool)
        keys = [count.astype(np.uint64), mix(count.astype(np.uint64), u64(5))]
        levels = np.array(sorted(blocks), np.int64)
        for k, h in enumerate(levels.tolist()):
            own = np.flatnonzero((count >= h) & ((count < h * STEP) | (k == len(levels) - 1)))
            for step in range(STEP):
                # parts side by side, the last one moved back so that it ends with the string
                own = own[count[own] > step * h]
                offset = np.minimum(step * h, count[own] - h)
                piece = blocks[h][first[own] + offset]
                alive[own] &= piece > 0
                keys[0][own] = mix(keys[0][own], piece)
                keys[1][own] = mix(piece ^ u64(0x5DEECE66D), keys[1][own])
        return alive, keys[0], keys[1]

    # Windows

    def segments(self, alive: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Runs of starts of windows of a length alike in the symbols they touch and in their own first and last anchor:
        (start, stop, first symbol, symbols, first anchor, last anchor). Only windows that hold two
        whole symbols, one after the other, that are alive; no other can repeat."""
        texts = np.flatnonzero(self.counts)
        shift = length - self.gram - width_of(self.length, self.gram) + 1
        two = np.flatnonzero(alive[:-1] & alive[1:] & (self.last[:-1] > np.arange(len(alive) - 1))) if len(alive) else np.zeros(0, np.int64)
        lo, hi = self.starts[texts], (self.starts + self.sizes - length + 1)[texts]
        if not len(two):
            return (np.zeros(0, np.int64),) * 6
        from_, to = self.end[two + 1] - length, self.begin[two] + 1
        to = np.maximum.accumulate(to)
        own = np.searchsorted(lo, self.begin[two], "right") - 1
        marks = [np.maximum(from_, lo[own]), to]
        for some in (self.begin, self.end - length + 1, self.firsts, self.firsts - shift):
            at = np.searchsorted(from_, some, "right") - 1
            marks.append(some[(at >= 0) & (some < to[at])])
        marks = np.sort(np.concatenate(marks), kind="stable")
        marks = marks[np.diff(marks, prepend=-1) != 0]
        at, which = np.searchsorted(from_, marks, "right") - 1, np.searchsorted(lo, marks, "right") - 1
        ok = (at >= 0) & (which >= 0)
        ok &= (marks < to[at]) & (marks < hi[which])
        stop = np.append(marks[1:], np.iinfo(np.int64).max)[ok]
        marks, which = marks[ok], which[ok]
        stop = np.minimum(stop, hi[which])
        symbol = np.searchsorted(self.begin, marks, "right") - 1
        touched = np.searchsorted(self.end, marks + length, "left") - symbol + 1
        first = np.searchsorted(self.firsts, marks, "right") - 1
        final = np.searchsorted(self.firsts, marks + shift, "right") - 1
        return marks, stop, symbol, touched, first, final

    def most_touched(self) -> int:
        """Most symbols that a window touches."""
        at = np.flatnonzero(self.last > np.arange(len(self.last)))
        ends = np.minimum(self.begin[at + 1] - 1 + self.lengths[-1], self.end[self.last[at]])
        return int((np.searchsorted(self.end, ends, "left") - at + 1).max(initial=0))

    def covers(self, blocks: dict[int, np.ndarray], touched: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], tuple]:
        """Strings of symbols that windows touch and that may repeat, each place's once for all lengths: (of each length its segments' strings or -1, what to ask)."""
        pairs = [symbol * (1 << 20) + symbols for symbol, symbols in touched]  # rise with the window's start
        new = [np.diff(pair, prepend=-1) != 0 for pair in pairs]
        one, at = np.unique(np.concatenate([pair[n] for pair, n in zip(pairs, new, strict=True)]), return_inverse=True)
        alive, k1, k2 = self.told(blocks, one >> 20, one & ((1 << 20) - 1))
        number = np.split(np.where(alive, np.cumsum(alive) - 1, -1)[at], np.cumsum([int(n.sum()) for n in new])[:-1])
        number = [own[np.cumsum(n) - 1] for own, n in zip(number, new, strict=True)]
        return number, (k1[alive], k2[alive], np.ones(int(alive.sum()), np.uint64))

    def state(self, answers: dict[str, np.ndarray]) -> dict:
        """Everything known of the segments of each length, as far as answers go."""
        _, _, blocks = self.merge(answers)
        found = [self.segments(blocks[1] > 0, length) for length in self.lengths]
        s = {"blocks": blocks, "lengths": [{"length": n, "start": f[0], "stop": f[1], "first": f[4], "final": f[5]} for n, f in zip(self.lengths, found, strict=True)]}
        numbers, s["asks"] = self.covers(blocks, [f[2:4] for f in found])
        if "c" not in answers:
            return s
        one, at, _, _, _ = distinct(*s["asks"])
        answer, own = answers["c"][at], np.zeros(len(at), bool)
        own[one] = True
        repeated, own = value(answer) > 1, own & owner(answer)
        for w, number in zip(s["lengths"], numbers, strict=True):
            fill = lambda x: np.where(number >= 0, np.append(x, False)[number], False).astype(bool)  # noqa: B023, E731
            w["decided"] = fill(repeated)
            w["head"] = self.of_anchor[w["first"]]
            # a repeated string's windows are asked about by one of its places alone
            asked = np.flatnonzero(~w["decided"] | fill(own))
            head, tail = w["head"][asked], self.of_anchor[w["final"][asked]]
            new = (np.diff(head, prepend=-1) != 0) | (np.diff(tail, prepend=-1) != 0)  # segments side by side share them
            alive, w["mid1"], w["mid2"] = (x[np.cumsum(new) - 1] for x in self.told(blocks, head[new], (tail - head)[new]))
            w["asked"], w["mid1"], w["mid2"] = asked[alive], w["mid1"][alive], w["mid2"][alive]
            w["open"] = ~w["decided"][w["asked"]]
        heads = [(w["head"][w["asked"][w["open"]]], w["head"][w["asked"][~w["open"]]]) for w in s["lengths"]]
        open_, closed = (np.unique(np.concatenate(h)) for h in zip(*heads, strict=True))
        ask, places = np.unique(np.concatenate([open_, closed]), return_index=True)
        one_block = blocks[1]
        after = one_block[ask + 1]
        s["asks"] = mix(one_block[ask], after), after, np.where(places < len(open_), u64(1), u64(1 << 31))
        if "u" not in answers:
            return s
        _, at, _, _, _ = distinct(*s["asks"])
        found = np.zeros(len(self.begin) + 1, np.uint64)
        found[ask] = value(answers["u"])[at]
        several = (found & u64((1 << 31) - 1)) + (found >> u64(31)) > 1
        others = (found & u64((1 << 31) - 1)) > 0
        for w in s["lengths"]:
            head = w["head"][w["asked"]]
            part = np.where(w["open"], several[head], others[head])
            w["part"], w["mid1"], w["mid2"] = w["asked"][part], w["mid1"][part], w["mid2"][part]
        return s

    def edges(self, s: dict, texts: list[bytes]) -> tuple[list[np.ndarray], tuple]:
        """Of each length the window starts of the segments that take part, and what to ask about them all. Only the texts that they lie in are hashed."""
        which = [np.searchsorted(self.starts + self.sizes, w["start"][w["part"]], "right") for w in s["lengths"]]
        used = np.unique(np.concatenate(which))
        hashes = Hashes(np.frombuffer(b"".join([texts[k] for k in used.tolist()]), np.uint8))
        moved = np.zeros(len(self.sizes), np.int64)
        moved[used] = self.starts[used] - (np.cumsum(self.sizes[used]) - self.sizes[used])
        starts, keys = [], ([], [])
        for k, (w, own) in enumerate(zip(s["lengths"], which, strict=True)):
            part = w["part"]
            sizes = (w["stop"] - w["start"])[part]
            each = lambda x: np.repeat(x, sizes)  # noqa: B023, E731
            off = each(moved[own])
            p = np.arange(len(off)) - each(np.cumsum(sizes) - sizes) + each(w["start"][part])
            a, b, c, d = p - off, each(self.places[w["first"][part]]) - off, each(self.places[w["final"][part]]) - off, p + w["length"] - off
            mid1, mid2 = w["mid1"], w["mid2"]
            if k:  # no window is taken for one of another length
                mid1, mid2 = mix(mid1, u64(k)), mix(mid2, u64(k))
            keys[0].append(mix(mix(each(mid1), hashes.of(0, a, b)), hashes.of(0, c, d)))
            keys[1].append(mix(mix(each(mid2), hashes.of(1, c, d)), hashes.of(1, a, b)))
            starts.append(p)
        k1, k2 = map(np.concatenate, keys)
        return starts, (k1, k2, np.ones(len(k1), np.uint64))

    def sends(self, kind: str, answers: dict[str, np.ndarray], texts: Callable[[], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, with checks and numbers, that the shard asks about: blocks x1 ..., covers c, open places u, edges w."""
        if kind[0] == "x":
            h, asks, _ = self.merge(answers)
        else:
            s = self.state(answers)
            asks = s["asks"]
            if kind == "w":
                none = np.zeros(0, np.uint64)
                asks = self.edges(s, texts())[1] if any(len(w["part"]) for w in s["lengths"]) else (none, none, none)
        return distinct(*asks)[2:]

    def removed(self, answers: dict[str, np.ndarray], texts: list[bytes]) -> dict[int, np.ndarray]:
        """For each text with repeats of the shortest length, 1 for every byte that a repeated window covers."""
        out = {}
        for k, spans in self.spans(answers, texts)[0].items():
            out[k] = np.zeros(int(self.sizes[k]), bool)
            for a, b in spans:
                out[k][a:b] = True
        return out

    def spans(self, answers: dict[str, np.ndarray], texts: list[bytes]) -> list[dict[int, list[tuple[int, int]]]]:
        """For each length and text with repeats of it, the runs of bytes that repeated windows cover, as (start, end)."""
        if not len(self.begin):
            return [{} for _ in self.lengths]
        s = self.state(answers)
        starts, repeated = [np.zeros(0, np.int64)] * len(self.lengths), np.zeros(0, bool)
        if any(len(w["part"]) for w in s["lengths"]):
            starts, asks = self.edges(s, texts)
            repeated = (value(answers["w"]) > 1)[distinct(*asks)[1]]
        repeated = np.split(repeated, np.cumsum([len(p) for p in starts])[:-1])
        return [self.joined(w, p[r]) for w, p, r in zip(s["lengths"], starts, repeated, strict=True)]

    def joined(self, w: dict, p: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Spans by text of the decided segments of a length and its windows at p."""
        seg = np.flatnonzero(w["decided"])
        from_, to = np.concatenate([w["start"][seg], p]), np.concatenate([w["stop"][seg] - 1, p]) + w["length"]
        if not len(from_):
            return {}
        order = np.argsort(from_)
        from_, to = from_[order], to[order]  # both rise, since window starts of segments are apart
        own = np.searchsorted(self.starts + self.sizes, from_, "right")
        new = np.flatnonzero(np.append(True, (from_[1:] > to[:-1]) | (own[1:] != own[:-1])))
        own, from_, to = own[new], from_[new], to[np.append(new[1:] - 1, len(to) - 1)]
        first, out = self.starts[own], {}
        for k, a, b in zip(own.tolist(), (from_ - first).tolist(), (to - first).tolist(), strict=True):
            out.setdefault(k, []).append((a, b))
        return out


def shards(df: DataFrame, text_col: str, id_col: str, lengths: tuple[int, ...], gram: int, shard_bytes: int) -> DataFrame:
    """A row per shard: parse, ids, texts (compressed, with their sizes in parse), most symbols that a window touches.

    A shard ends with the text that reaches shard_bytes, so memory follows the longest text.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t"))
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("parse", T.BinaryType()), T.StructField("texts", T.BinaryType()), T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("most", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def flush(name: str, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        shard = Shard.of(texts, lengths[0], gram, lengths[1:])
        row = (name, shard.dump(), packed, ids, shard.most_touched())
        return pa.RecordBatch.from_arrays([pa.array([c], out.field(k).type) for k, c in enumerate(row)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, total = TaskContext.get().partitionId(), 0, 0
        ids, texts = [], []
        for batch in batches:
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py() or b"")
                total += len(texts[-1]) + 16
                if total >= shard_bytes:
                    yield flush(f"{part}-{n}", ids, texts)
                    ids, texts, total, n = [], [], 0, n + 1
        if ids:
            yield flush(f"{part}-{n}", ids, texts)
        tidy()

    return rows.mapInArrow(run, schema)


def known(table: pa.Table, kinds: list[str]) -> dict[str, np.ndarray]:
    """Answers by kind; none of a kind that the shard had nothing to ask about."""
    return {kind: joined(table.filter(pc.equal(table.column("kind"), kind))) for kind in kinds}


def texts_of(packed: bytes, sizes: np.ndarray) -> list[bytes]:
    whole = memoryview(zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(sizes.sum()))))
    ends = np.cumsum(sizes).tolist()
    return [bytes(whole[e - n : e]) for e, n in zip(ends, sizes.tolist(), strict=True)]


def ask(sent: DataFrame, answers: DataFrame, kind: str, before: list[str], ranges: int, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """Every shard's keys of a kind, dealt to ranges; before: the kinds answered."""

    def run(own: pa.Table, so_far: pa.Table) -> pa.Table:
        shard = Shard.load(own.column("parse")[0].as_py(), lengths[0], gram, lengths[1:])
        keys, checks, numbers = shard.sends(kind, known(so_far, before), lambda: texts_of(own.column("texts")[0].as_py(), shard.sizes))
        tidy()
        return arrow(rows_of(own.column("shard")[0].as_py(), keys, checks, numbers, ranges), ASKED)

    columns = ["shard", "parse", *["texts"] * (kind == "w")]
    return sent.select(*columns).groupBy("shard").cogroup(answers.groupBy("block")).applyInArrow(run, ASKED)


def repeats(df: DataFrame, text_col: str, id_col: str, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, list[str]]:
    """The shards, all answers of the merge and about the windows' edges, and their kinds."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()["bytes"] or 0
    hops = fans(max(LEAST_RANGES, -(-total // RANGE_BYTES)))
    sent = materialize_by(shards(df, text_col, id_col, lengths, gram, shard_bytes), "suffix_shards", "shard", parts_for(df.sparkSession, total))
    size = sent.agg(F.max("most").alias("most"), F.count("*").alias("n")).first()
    answers = df.sparkSession.createDataFrame([], f"{ANSWER}, kind string")
    kinds, h = [], 1
    while h <= (size["most"] or 0):
        kinds.append(f"x{h}")
        h *= STEP
    kinds += ["c", "u", "w"]
    for k, kind in enumerate(kinds):
        got = totals(ask(sent, answers, kind, kinds[:k], hops[0], lengths, gram), hops, size["n"], ids=kind[0] == "x", tag="suffix")
        got = materialize(got.withColumn("kind", F.lit(kind)), f"suffix-{kind}")
        answers = answers.union(got)
    return sent, answers, kinds


def per_text(df: DataFrame, text_col: str, id_col: str, made: T.StructType, fn, lengths: tuple[int, ...], gram: int, shard_bytes: int) -> DataFrame:
    """id_col and what fn(raw, spans of each length) makes of each text; lengths: the shortest first."""
    with scratch() as keep:
        sent, answers, kinds = repeats(df, text_col, id_col, lengths, gram, shard_bytes)
        schema = T.StructType([df.schema[id_col], *made.fields])
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)

        def run(own: pa.Table, so_far: pa.Table) -> pa.Table:
            shard = Shard.load(own.column("parse")[0].as_py(), lengths[0], gram, lengths[1:])
            texts = texts_of(own.column("texts")[0].as_py(), shard.sizes)
            found = shard.spans(known(so_far, kinds), texts)
            rows = [fn(raw, *[spans.get(k, []) for spans in found]) for k, raw in enumerate(texts)]
            tidy()
            ids = own.column("ids").combine_chunks().flatten().cast(out.field(0).type)
            return pa.table([ids, *[pa.array(list(c), out.field(k + 1).type) for k, c in enumerate(zip(*rows, strict=True))]], schema=out)

        own = sent.drop("most")
        return keep(own.groupBy("shard").cogroup(answers.groupBy("block")).applyInArrow(run, schema), "suffix-result")


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    edges = [0, *[edge for span in spans for edge in span], len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spans_of(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def dedup_digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, passage: int | None = None) -> DataFrame:
    """Removes every byte covered by a string of length bytes that starts at two or more places of all texts, and shows shorter passages.

    Texts are UTF-8 bytes (null: empty); strings never cross texts, may overlap, and are judged on
    the input. Repeated rows are texts of their own, so all their strings of that length repeat. An
    empty table gives an empty result; other columns of df, whatever their names, take no part.
    Result, a row per row of df: id_col, n_bytes, n_removed, n_spans (long), kept_sha256, clean_text
    (what is left, without characters cut by a string's edge), spans (array of start, end in bytes),
    n_passage_bytes (long) and passages (as spans): what strings of `passage` bytes (PASSAGE, or length
    if that is less) cover that start at two or more places. These are told in the same merge and not removed.
    """
    passage = min(PASSAGE, length) if passage is None else passage
    if passage > length:
        raise ValueError("passages are no longer than the strings removed")

    def fn(raw: bytes, passages: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple:
        left = kept_bytes(raw, spans)
        return len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"), spans_of(spans), sum(b - a for a, b in passages), spans_of(passages)

    made = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("clean_text", T.StringType()), T.StructField("spans", SPANS), T.StructField("n_passage_bytes", T.LongType()), T.StructField("passages", SPANS)])
    return per_text(df, text_col, id_col, made, fn, (passage, length), gram, shard_bytes)


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id_col, clean_text (what is left; a character cut by a string's edge is dropped) and spans (array of start, end in bytes).

    Nulls, repeated rows and empty tables are taken as by dedup_digest.
    """

    def fn(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
        return kept_bytes(raw, spans).decode("utf-8", "ignore"), spans_of(spans)

    made = T.StructType([T.StructField("clean_text", T.StringType()), T.StructField("spans", SPANS)])
    return per_text(df, text_col, id_col, made, fn, (length,), gram, shard_bytes)
