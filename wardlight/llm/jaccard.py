"""N-gram Jaccard join with adaptive multi-match prefixes.

Sets. A document's set are the keys of its distinct 3-word shingles; documents of equal sets are
one node. Counting. Blocks of documents exchange their distinct keys for exact document
frequencies (see exchange). Prefixes. Each set is ordered from rare to frequent; two sets
that link and share t keys share l of their prefixes of n - t + l keys. Each node takes the l
of least estimated cost, known from the frequencies: what reading the prefix's lists costs, and
what verifying its candidates costs, of which there are fewer the more matches are asked for.
A pair must share min(l, l') prefix keys. Keys of frequency 1 match nothing and aren't sent.

Linking. A list of m nodes isn't expanded into m * m pairs: first each list's least unusual node
is compared with the others, those that link become one class, and only nodes of different classes
are still paired. That loses no link between classes, so the components are exact. Keys that no
other node has bound what a pair can share; many copies of one text that differ from each other
too much are told apart by that bound before they are paired. What is left of a long list is paired
in cells of CELL by CELL nodes. Sets stay in their blocks, and only those of candidates are fetched.

Keys are 64 bits: of 10^12 pairs of sets of a thousand keys, one in twenty times one pair holds two keys that meet.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, materialize_by, parts_for, scratch, small_batches, tidy
from .exchange import ASKED, arrow, fans, joined, rows_of, totals, value
from .graph import components
from .packing import mix, pack, pack_sorted, unpack, unpack_sorted

#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT, SHINGLE = 90, 3
BLOCK_BYTES, RANGE_BYTES, LEAST_RANGES = 1 << 20, 8 << 20, 8
#: Cost of verifying a candidate, against reading one entry of a list; the most matches that are asked for.
VERIFY_COST, MOST_MATCHES = 8.0, 8
#: Rounds of comparing each list's first node with the others before the remaining pairs are made.
STAR_ROUNDS = 3
#: Nodes on a side of the cells that the rest of a list is paired in.
CELL = 256


def shingle_keys(words: list[np.ndarray], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct keys of each document's shingles, from the keys of its words."""
    out = []
    for w in words:
        if not len(w):
            out.append(w)
            continue
        n = min(size, len(w))
        key = np.full(len(w) - n + 1, n, np.uint64)
        for d in range(n):
            key = mix(key, w[d : len(w) - n + 1 + d])
        out.append(np.unique(key))
    return out


def word_keys(texts: list[str | None]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    tokens = [np.fromiter(map(numbers.__getitem__, (t or "").encode().lower().split()), np.int64) for t in texts]
    keys = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], dtype=np.uint64)
    return [keys[t] if len(t) else np.zeros(0, np.uint64) for t in tokens]


def overlap_needed(n: int, percent: int = PERCENT) -> int:
    """Keys that a set of n shares at least with any set it links with."""
    return -(-percent * n // 100)


def choose_matches(frequency: np.ndarray, n: int, percent: int = PERCENT) -> int:
    """The number of matches of least estimated cost; frequency: of the set's keys from rare to frequent.

    Estimated for partners of the same size, which share 2 * percent * n / (100 + percent) keys.
    """
    most = min(MOST_MATCHES, overlap_needed(n, percent))
    base = n - -(-2 * percent * n // (100 + percent))
    entries = np.cumsum(frequency - 1)[base : base + most]
    matches = np.arange(1, len(entries) + 1)
    return int(matches[np.argmin(entries + VERIFY_COST * entries / matches)])


def blocks(df: DataFrame, text_col: str, id_col: str, size: int, block_bytes: int) -> DataFrame:
    """A row per block: its name, its documents (ids, digests, sizes of sets), their distinct keys and the sets by places in these."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("keys", T.BinaryType()), T.StructField("sets", T.BinaryType()), T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("sizes", T.ArrayType(T.LongType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def flush(name: str, ids: list, texts: list) -> pa.RecordBatch:
        sets = shingle_keys(word_keys(texts), size)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=12).hexdigest() if len(s) else None for s in sets]
        own = list({d: s for d, s in zip(digests, sets, strict=True) if d}.values())
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        places = [np.searchsorted(keys, s) for s in own]  # rising within a set: differences are small
        jumps = np.concatenate([np.zeros(0, np.int64), *[np.diff(p, prepend=0) for p in places]])
        row = (name, pack_sorted(keys), pack(jumps), ids, digests, [len(s) for s in sets])
        return pa.RecordBatch.from_arrays([pa.array([c], out.field(k).type) for k, c in enumerate(row)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, total = TaskContext.get().partitionId(), 0, 0
        ids, texts = [], []
        for batch in batches:
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py())
                total += len((texts[-1] or "").encode()) + 16
                if total >= block_bytes:
                    yield flush(f"{part}-{n}", ids, texts)
                    ids, texts, total, n = [], [], 0, n + 1
        if ids:
            yield flush(f"{part}-{n}", ids, texts)
        tidy()

    return rows.mapInArrow(run, schema)


def sets_of(jumps: np.ndarray, digests: list, sizes: list) -> Iterator[tuple[str, np.ndarray]]:
    """(digest, places of the keys) of a block's distinct sets."""
    at = 0
    for digest, n in {d: n for d, n in zip(digests, sizes, strict=True) if d}.items():
        yield digest, np.cumsum(jumps[at : at + n])
        at += n


def ask(sent: DataFrame, ranges: int) -> DataFrame:
    """Each block's distinct keys, with how many of its sets have them, dealt to ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, keys, jumps, digests, sizes = (batch.column(c)[k].as_py() for c in range(5))
                keys = unpack_sorted(keys)
                counts = np.zeros(len(keys), np.uint64)
                for _, own in sets_of(unpack(jumps).astype(np.int64), digests, sizes):
                    counts[own] += np.uint64(1)  # a set has a key once
                yield from arrow(rows_of(name, keys, None, counts, ranges), ASKED).to_batches()
        tidy()

    return sent.select("block", "keys", "sets", "digests", "sizes").mapInArrow(run, ASKED)


#: Own keys are told from others up to so many blocks that hold copies of a node; beyond, none counts as own.
MOST_COPIES = 64
PREFIX = "block string, digest string, n long, matches int, rare array<int>, tokens array<long>, spots array<int>"


def prefixes(sent: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Nodes with prefix keys that others have, once for each block: block, digest, n, matches (l), rare (how many of its keys have frequency 1, 2, ...), tokens (of the prefix) and their spots (places in the order)."""
    made = pa.schema([("block", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("matches", pa.int32()), ("rare", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64())), ("spots", pa.list_(pa.int32()))])

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        name, keys = block.column("block")[0].as_py(), unpack_sorted(block.column("keys")[0].as_py())
        jumps = unpack(block.column("sets")[0].as_py()).astype(np.int64)
        frequency = value(joined(got)).astype(np.int64)  # of all blocks' nodes; copies in other blocks count again
        out = []
        for digest, own in sets_of(jumps, block.column("digests")[0].as_py(), block.column("sizes")[0].as_py()):
            n = len(own)
            common = frequency[own]
            order = np.lexsort((own, common))
            ranked = common[order]
            base = n - overlap_needed(n, percent)
            if ranked[base] == 1:
                continue  # a linked set would share a key of the shortest prefix, and all of those are its own
            matches = choose_matches(ranked, n, percent)
            prefix = own[order[: base + matches]]
            spots = np.flatnonzero(frequency[prefix] > 1)
            out.append((name, digest, n, matches, np.bincount(common[common <= MOST_COPIES], minlength=MOST_COPIES + 1)[1:].tolist(), keys[prefix[spots]].astype(np.int64).tolist(), spots.tolist()))
        tidy()
        columns = list(zip(*out, strict=True)) if out else [[]] * len(made)
        return pa.table([pa.array(list(c), made.field(k).type) for k, c in enumerate(columns)], schema=made)

    own = sent.select("block", "keys", "sets", "digests", "sizes")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, PREFIX)


def one_node(found: DataFrame) -> DataFrame:
    """Copies of a set in several blocks as one node. Keys whose frequency is the number of these blocks are in no other node: odd counts them."""
    columns = ["block", "n", "matches", "rare", "tokens", "spots"]
    nodes = found.groupBy("digest").agg(F.count("*").alias("blocks"), *[F.first(c).alias(c) for c in columns])
    return nodes.withColumn("odd", F.coalesce(F.get("rare", F.col("blocks").cast("int") - 1), F.lit(0)).cast("long")).drop("rare", "blocks")


def may_link(percent: int):
    """Whether a common key can count for a pair: the pair's sets can reach the threshold at all, and the key lies in both prefixes.

    Sets of n and other_n keys that link share t = percent * (n + other_n) / (100 + percent) of them,
    so the first l of these lie among the first n - t + l and other_n - t + l keys, l being the
    smaller number of matches. Keys that no other set has (odd) are never shared.
    """
    both = F.col("n") + F.col("other_n")
    shared = F.least(F.col("n") - F.col("odd"), F.col("other_n") - F.col("other_odd"))
    t = F.ceil(both * percent / (100 + percent))
    l = F.least("matches", "other_matches")  # noqa: E741
    return (shared * 100 >= (both - shared) * percent) & (F.col("spot") < F.col("n") - t + l) & (F.col("other_spot") < F.col("other_n") - t + l)


def fetch(sent: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, keys (packed) of the sets wanted: (block, digest)."""
    made = pa.schema([("digest", pa.string()), ("keys", pa.binary())])

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        names, out = set(wanted.column("digest").to_pylist()), []
        if names:
            keys = unpack_sorted(block.column("keys")[0].as_py())
            sets = sets_of(unpack(block.column("sets")[0].as_py()).astype(np.int64), block.column("digests")[0].as_py(), block.column("sizes")[0].as_py())
            out = [(digest, pack_sorted(keys[own])) for digest, own in sets if digest in names]
            tidy()
        return pa.table([pa.array([r[k] for r in out], made.field(k).type) for k in range(2)], schema=made)

    own = sent.select("block", "keys", "sets", "digests", "sizes")
    return own.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, "digest string, keys binary")


def verify(pairs: DataFrame, nodes: DataFrame, sent: DataFrame, percent: int, entries: int) -> DataFrame:
    """Those of pairs (a, b) whose sets reach the threshold, written; entries: of all lists."""
    pairs = materialize(pairs, "join-pairs", entries)
    named = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    sets = materialize(fetch(sent, nodes.select("digest", "block").join(named, "digest")), "join-sets")
    both = pairs.join(sets.withColumnsRenamed({"digest": "a", "keys": "ka"}), "a").join(sets.withColumnsRenamed({"digest": "b", "keys": "kb"}), "b").select("a", "b", "ka", "kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch, keep = big.slice(at, 512), []
                sets = {raw: unpack_sorted(raw) for c in (2, 3) for raw in set(batch.column(c).to_pylist())}
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return materialize(both.mapInArrow(run, "a string, b string"), "join-links", pairs.count())


def cells(left: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two copies of the lists' entries, dealt so that those of a list meet in cells of about CELL entries of each."""
    dealt = left.join(sizes, "token").withColumn("cells", F.ceil(F.col("size") / CELL).cast("int"))
    own, every = F.pmod(F.xxhash64("digest"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    rows = dealt.withColumn("row", own).withColumn("column", every)
    columns = dealt.withColumn("column", own).withColumn("row", every)
    return rows, columns


def link(nodes: DataFrame, sent: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Class of each node that has a link: node, label (see graph.components)."""
    spark = nodes.sparkSession
    lists = materialize(nodes.select("digest", "n", "matches", "odd", F.explode(F.arrays_zip("tokens", "spots")).alias("z")).select("digest", "n", "matches", "odd", F.col("z.tokens").alias("token"), F.col("z.spots").alias("spot")), "join-lists")
    entries = lists.count()
    labels = spark.createDataFrame([], "node string, label string")
    fits = may_link(percent)
    seen = ["digest", "label", "n", "odd", "spot", "matches"]
    for turn in range(STAR_ROUNDS + 1):
        now = lists.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        # first the nodes with the fewest keys of their own, which copies of a text have in common; then others by chance
        order = F.struct((F.col("odd") if not turn else F.xxhash64("digest", "token", F.lit(turn))).alias("by"), *seen)
        open_lists = now.groupBy("token").agg(F.min(order).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high")
        open_lists = materialize(open_lists.drop("low", "high"), "join-open", entries)
        if not open_lists.limit(1).count():
            break
        if turn == STAR_ROUNDS:  # whatever is left between different classes
            rows, columns = cells(now.join(open_lists.select("token"), "token", "left_semi"), open_lists.select("token", "size"))
            others = columns.select("token", "row", "column", *[F.col(c).alias("other" if c == "digest" else f"other_{c}") for c in seen])
            pairs = rows.join(others, ["token", "row", "column"]).where((F.col("label") < F.col("other_label")) & fits)
        else:
            heads = open_lists.select("token", *[F.col(f"first.{c}").alias("other" if c == "digest" else f"other_{c}") for c in seen])
            pairs = now.join(heads, "token").where((F.col("label") != F.col("other_label")) & fits)
        found = pairs.groupBy(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("matches", "other_matches")).alias("least")).where("shared >= least").select("a", "b")
        new = verify(found, nodes, sent, percent, entries)
        if new.limit(1).count():
            labels = relabelled(labels, new, entries)
    return labels


def relabelled(labels: DataFrame, new: DataFrame, entries: int) -> DataFrame:
    """labels (node, label) after new links (a, b): only classes are joined, by their labels, so earlier links aren't looked at again."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    ends = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b"))
    ends = materialize(ends, "join-ends", entries)
    over = components(ends, "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("least"))
    nodes = labels.union(ends.select("a", "label_a")).union(ends.select("b", "label_b")).distinct()
    return materialize(nodes.join(over, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "join-labels", entries)


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Component of each document under links of Jaccard similarity of percent / 100 or more.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lower-cased; fewer than size words
    are one shingle; texts without words (null too) have an empty set and no link. Result, a row
    per row of df: id_col, n_shingles, component_id (the smallest id_col reachable; null ids are
    passed over). Rows of equal sets, repeated rows included, are always linked. An empty table
    gives an empty result; other columns of df, whatever their names, take no part. A block ends with
    the text that reaches block_bytes, so memory follows the longest text.
    """
    total = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()["bytes"] or 0
    hops = fans(max(LEAST_RANGES, -(-total // RANGE_BYTES)))
    with scratch() as keep:
        sent = materialize_by(blocks(df, text_col, id_col, size, block_bytes), "join_blocks", "block", parts_for(df.sparkSession, total))
        with scratch() as keep_nodes:
            answers = totals(ask(sent, hops[0]), hops, sent.count(), tag="join")
            nodes = keep_nodes(one_node(prefixes(sent, answers, percent)), "join-nodes")
        labels = link(nodes, sent, percent)
        docs = sent.select(F.explode(F.arrays_zip("ids", "digests", "sizes")).alias("d")).select(F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"), F.col("d.sizes").alias("n_shingles"))
        lowest = docs.where("digest is not null").groupBy("digest").agg(F.min("id").alias("low"))
        classes = lowest.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        least = classes.groupBy("label").agg(F.min("low").alias("component_id"))
        of = classes.join(least, "label").select("digest", "component_id")
        joined_ = docs.join(of, "digest", "left")
        return keep(joined_.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")), "join-result")
