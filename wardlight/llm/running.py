"""Running sums and running digests over rows in a global order, in two passes and without one task for all.

Rows are dealt to ranges of the order, each range is summed by itself and written, and what stands
before a range is the sum over the ranges before it: one row for each range, which is all that
reaches the driver. So no group of rows, however hot, has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

#: Digests of sequences: polynomials in BASE modulo a Mersenne prime. Two different ones among 10^12 meet with a chance of about 10^-14.
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1B54A32D192ED03F7A13B75
#: The digest of the empty sequence.
EMPTY = 1


def packed(value: int) -> bytes:
    return value.to_bytes(16, "big")


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def running(df: DataFrame, order: list[str], sums: list[str], tag: str) -> DataFrame:
    """df with `place`, the number of rows before in the order, and `<s>_before`, the sum of s over these, for each s of sums.

    order: columns that name a row; where rows tie, each still gets a place of its own. df is read
    twice, so it had better be a written table. Nulls of sums count as 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    before = ["place", *[f"{s}_before" for s in sums]]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in before], T.StructField("range_", T.IntegerType())])
    arrow, names = to_arrow_schema(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, totals = TaskContext.get().partitionId(), [0] * len(before)
        for batch in batches:
            n = batch.num_rows
            values = [np.ones(n, np.int64), *[batch.column(names.index(s)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for s in sums]]
            sofar = [t + np.cumsum(v) - v for t, v in zip(totals, values, strict=True)]
            totals = [t + int(v.sum()) for t, v in zip(totals, values, strict=True)]
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sofar), pa.array(np.full(n, part, np.int32))], schema=arrow)

    local = materialize(ranges(df, order).mapInArrow(run, schema), tag)
    each = local.groupBy("range_").agg(F.count("*"), *[F.sum(s) for s in sums]).orderBy("range_").collect()  # a row for each range
    sofar, rows = [0] * len(before), []
    for r in each:
        rows.append((r[0], *sofar))
        sofar = [a + (b or 0) for a, b in zip(sofar, r[1:], strict=True)]
    starts = df.sparkSession.createDataFrame(rows, "range_ int, " + ", ".join(f"start{i}_ long" for i in range(len(before))))
    return local.join(F.broadcast(starts), "range_").select(*df.columns, *[(F.col(c) + F.col(f"start{i}_")).alias(c) for i, c in enumerate(before)])


def chained(df: DataFrame, key: str, order: list[str], token: str, tag: str) -> DataFrame:
    """df with `place`, a row's number (from 0) among those of its key, and `above` and `node`, digests of the key's tokens before it and up to it.

    key: long without nulls; token: 16 bytes. order: columns that order the rows of a key. Digests of
    ranges are joined as polynomials are, so a key of very many rows is split at any place.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    made = [T.StructField("place", T.LongType()), T.StructField("above", T.BinaryType()), T.StructField("node", T.BinaryType())]
    schema = T.StructType([*df.schema.fields, *made])
    local_schema = T.StructType([*schema.fields, T.StructField("range_", T.IntegerType()), T.StructField("first_", T.BooleanType()), T.StructField("edge_", T.BooleanType())])
    arrow, local_arrow, names = to_arrow_schema(schema), to_arrow_schema(local_schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, now, start, place, value = TaskContext.get().partitionId(), None, None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            places, above, node, first = [], [], [], []
            for k, t in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index(token)).to_pylist(), strict=True):
                if k != now:
                    start = k if now is None else start
                    now, place, value = k, 0, 0
                places.append(place)
                above.append(packed(value))
                value = (value * BASE + int.from_bytes(t, "big")) % PRIME
                node.append(packed(value))
                first.append(k == start)
                place += 1
            edge = np.zeros(batch.num_rows, bool)
            edge[0] = held is None
            columns = [c.cast(f.type) for c, f in zip(batch.columns, local_arrow, strict=False)]
            columns += [pa.array(places, pa.int64()), pa.array(above, pa.binary()), pa.array(node, pa.binary()), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(first), pa.array(edge)]
            held = pa.RecordBatch.from_arrays(columns, schema=local_arrow)
        if held is not None:  # the range's last row
            edge = held.column("edge_").to_numpy(zero_copy_only=False).copy()
            edge[-1] = True
            yield held.set_column(held.num_columns - 1, local_arrow.field(held.num_columns - 1), pa.array(edge))

    local = materialize(ranges(df, [key, *order]).mapInArrow(run, local_schema), tag)
    starts = carried(local.where("edge_").select("range_", F.col(key).alias("key"), "place", "node", "first_").orderBy("range_", "first_", "place").collect())
    n = len(names)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, above, node = (batch.column(n + i).to_pylist() for i in range(3))
            for i, (part, first) in enumerate(zip(batch.column("range_").to_pylist(), batch.column("first_").to_pylist(), strict=True)):
                count, value = starts.get(part, (0, EMPTY)) if first else (0, EMPTY)
                power = pow(BASE, places[i], PRIME) if first and part in starts else None
                if power is None:  # as most rows: only the empty sequence stands before their key's first
                    power = powers(places[i])
                above[i] = packed((value * power + int.from_bytes(above[i], "big")) % PRIME)
                node[i] = packed((value * power * BASE + int.from_bytes(node[i], "big")) % PRIME)
                places[i] += count
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns[:n], arrow, strict=False)], pa.array(places, pa.int64()), pa.array(above, pa.binary()), pa.array(node, pa.binary())], schema=arrow)

    return local.mapInArrow(mend, schema)


KNOWN = [1]


def powers(i: int) -> int:
    """BASE to the power of i; small ones are kept."""
    if i >= 4096:
        return pow(BASE, i, PRIME)
    while len(KNOWN) <= i:
        KNOWN.append(KNOWN[-1] * BASE % PRIME)
    return KNOWN[i]


def carried(edges: list) -> dict[int, tuple[int, int]]:
    """range: (rows, digest) that its first key has in the ranges before; of a first and a last row of each range, which may be one."""
    by_range: dict[int, list] = {}
    for r in edges:
        by_range.setdefault(r["range_"], []).append(r)
    out, key, count, value = {}, None, 0, EMPTY
    for part, rows in sorted(by_range.items()):
        first = next(r for r in rows if r["first_"] and r["place"] == 0)
        last = max(rows, key=lambda r: (not r["first_"], r["place"]))
        before = (count, value) if key is not None and key == first["key"] else (0, EMPTY)
        if before[0]:
            out[part] = before
        begun = before if last["first_"] else (0, EMPTY)
        n = last["place"] + 1
        key, count, value = last["key"], begun[0] + n, (begun[1] * pow(BASE, n, PRIME) + int.from_bytes(last["node"], "big")) % PRIME
    return out
