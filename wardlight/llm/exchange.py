"""Sums by key over all blocks, answered to each block in its own order.

A block (some megabytes of text) asks about each of its distinct keys once. Its keys go to equal
ranges of the keys, a row for each range in which it has any. With many ranges that would be blocks
times ranges, which grows with the square of the data; so keys pass through hops of at most FAN
ranges each: at a hop, about FAN blocks are merged range by range into one node, which asks at the
next hop as a block does, and hands the answers on. Rows are at most FAN for a block and hop, hops
grow with the logarithm of the data, and a group holds about as many keys as a block. A key that
every block has is merged on its way, so no range is hot.

Keys are sorted uint64; where equal ones must be told apart, checks holds 64 bits more of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .packing import pack, pack_sorted, unpack, unpack_sorted

#: Most ranges, and about as many blocks, of one hop.
FAN = 128
ASKED = "block string, part long, keys binary, checks binary, counts binary"
ANSWER = "block string, part long, answer binary"
MERGED = "kind int, node string, block string, part long, keys binary, checks binary, counts binary"


def fans(ranges: int, most: int = 0) -> list[int]:
    """Ranges that each hop splits a range into, for at least `ranges` at the end."""
    hops, most = 1, most or FAN
    while most**hops < ranges:
        hops += 1
    each = next(f for f in range(1, most + 1) if f**hops >= ranges)
    return [each] * hops


def split(keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray, first: int, ranges: int, total: int) -> Iterator[tuple[int, bytes, bytes | None, bytes]]:
    """(range, keys, checks, counts) of the ranges from first that have any; total: ranges of all the keys."""
    low = np.array([((first + i) << 64) // total for i in range(1, ranges)], dtype=np.uint64)
    edges = [0, *np.searchsorted(keys, low).tolist(), len(keys)]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            yield first + i, pack_sorted(keys[a:b]), None if checks is None else checks[a:b].tobytes(), pack(counts[a:b])


def rows_of(name: str, keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray, ranges: int) -> list[tuple]:
    """The rows (ASKED) that a block asks with at the first hop."""
    return [(name, *r) for r in split(keys, checks, counts, 0, ranges, ranges)]


def distinct(keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(first of each distinct key, its number in place of each, keys, checks, sums of counts) in order of the keys."""
    if checks is None:
        found, first, at = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.zeros(len(found), np.uint64)
        np.add.at(sums, at, counts)
        return first, at, found, None, sums
    order = np.argsort(keys)  # keys of different checks hardly ever meet
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if (~new[1:] & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    at = np.empty(len(k), np.int64)
    at[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(counts[order].astype(np.uint64), starts) if len(starts) else np.zeros(0, np.uint64)
    return np.minimum.reduceat(order, starts) if len(starts) else order, at, k[starts], c[starts], sums


def group_of(group: pa.Table) -> tuple[pa.Table, list[int], tuple]:
    """A group's rows ordered by block, where each one's keys end, and its distinct keys."""
    group = group.sort_by("block")
    parts = [unpack_sorted(p) for p in group.column("keys").to_pylist()]
    checks = None if group.column("checks").null_count else np.concatenate([np.frombuffer(c, np.uint64) for c in group.column("checks").to_pylist()])
    counts = np.concatenate([unpack(c) for c in group.column("counts").to_pylist()])
    return group, np.cumsum([0, *map(len, parts)]).tolist(), distinct(np.concatenate(parts), checks, counts)


def flags(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 for the first of each key, 2 for those that several have."""
    out = np.where(np.bincount(at, minlength=len(first))[at] > 1, np.uint64(2), np.uint64(0))
    out[first] |= np.uint64(1)
    return out


def value(answer: np.ndarray) -> np.ndarray:
    return answer >> np.uint64(2)


def several(answer: np.ndarray) -> np.ndarray:
    """Whether other blocks asked about the key too."""
    return (answer & np.uint64(2)) > 0


def owner(answer: np.ndarray) -> np.ndarray:
    """Whether the block is the one of those that asked which owns the key."""
    return (answer & np.uint64(1)) > 0


#: Arrow types of the columns above.
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def arrow(rows: list[tuple], ddl: str) -> pa.Table:
    schema = pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def settle(asked: DataFrame, ids: bool) -> DataFrame:
    """The last hop: a range is whole in one group."""

    def run(group: pa.Table) -> pa.Table:
        group, ends, (first, at, _, _, sums) = group_of(group)
        if ids:
            part = group.column("part")[0].as_py()
            sums = np.where(sums > 1, np.uint64(part << 32) + np.arange(1, len(sums) + 1, dtype=np.uint64), np.uint64(0))
        answer = (sums[at] << np.uint64(2)) | flags(first, at)
        rows = [(b, p, pack(answer[x:y])) for b, p, x, y in zip(group.column("block").to_pylist(), group.column("part").to_pylist(), ends, ends[1:], strict=False)]
        tidy()
        return arrow(rows, ANSWER)

    return asked.groupBy("part").applyInArrow(run, ANSWER)


def totals(asked: DataFrame, hops: list[int], blocks: int, ids: bool = False, tag: str = "exchange") -> DataFrame:
    """Rows (ANSWER) for every row asked (ASKED): for each key its sum over all blocks (value), and flags (several, owner).

    ids: in place of the sum, a number of the key that no other key has, or 0 where the sum is 1.
    blocks: about how many blocks ask.
    """
    return hop(asked, hops, 1, max(1, blocks), ids, tag)


def hop(asked: DataFrame, hops: list[int], before: int, blocks: int, ids: bool, tag: str) -> DataFrame:
    total = before * hops[0]
    if len(hops) == 1:
        return settle(asked, ids)
    groups, ranges = -(-blocks // FAN), hops[1]

    def merge(group: pa.Table) -> pa.Table:
        node = group.column("g")[0].as_py()
        group, ends, (first, at, keys, checks, sums) = group_of(group.drop_columns(["g"]))
        part = group.column("part")[0].as_py()
        name = f"{node}.{part}"
        back = (at.astype(np.uint64) << np.uint64(2)) | flags(first, at)
        rows = [(0, name, b, part, pack(back[x:y]), None, None) for b, x, y in zip(group.column("block").to_pylist(), ends, ends[1:], strict=False)]
        rows += [(1, name, None, *r) for r in split(keys, checks, sums, part * ranges, ranges, total * ranges)]
        tidy()
        return arrow(rows, MERGED)

    number = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g")
    merged = materialize(asked.select(number, "*").groupBy("g", "part").applyInArrow(merge, MERGED), f"{tag}-merged")
    up = merged.where("kind = 1").select(F.col("node").alias("block"), "part", "keys", "checks", "counts")
    got = hop(up, hops[1:], total, groups, ids, tag)

    def down(asked: pa.Table, got: pa.Table) -> pa.Table:
        answer = joined(got)
        rows = []
        for block, part, back in zip(asked.column("block").to_pylist(), asked.column("part").to_pylist(), asked.column("keys").to_pylist(), strict=True):
            back = unpack(back)
            own = answer[value(back).astype(np.int64)]
            rows.append((block, part, pack((own & ~np.uint64(1)) | (own & back & np.uint64(1)) | (back & np.uint64(2)))))
        tidy()
        return arrow(rows, ANSWER)

    asking = merged.where("kind = 0").select("node", "block", "part", "keys")
    return asking.groupBy("node").cogroup(got.withColumnRenamed("block", "node").groupBy("node")).applyInArrow(down, ANSWER)


def joined(got: pa.Table) -> np.ndarray:
    """A block's answers in the order of its keys."""
    got = got.sort_by("part")
    return np.concatenate([np.zeros(0, np.uint64), *[unpack(a) for a in got.column("answer").to_pylist()]])
