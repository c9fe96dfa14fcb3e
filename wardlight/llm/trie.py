"""The prefix trie of rebuilt conversations by preorder intervals.

A node is a distinct sequence of first turns, named by a digest. Conversations are ranked in
lexicographic order of their turns, so that a node's members are an interval that begins at `first`
and ends n_convs later. Nodes in the order of (first, depth) are in preorder, and a sum over a
subtree is the running sum at the end of its interval less the one at its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .running import EMPTY, chained, packed, running

#: Conversations that share the opening of the first of their family, and the most turns of it.
FAMILY, MOST_SHARED = 20, 4
#: Bytes of ids in a row before they are digested.
CHUNK = 256 << 10
WORD = r"[^ \t-\r]+"


def shared_turns(conv: F.Column) -> F.Column:
    """h: how many opening turns a conversation takes from its family's first."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(MOST_SHARED))


def own_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, place, digest (of role and text), words: each conversation's turns in order; equal turns by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), words.alias("words"))
    placed = chained(materialize(rows, "trie-turns"), "conv_id", ["turn", "digest"], "digest", "trie-own")
    return materialize(placed.select("conv_id", "place", "digest", "words"), "trie-placed")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, depth, above, node, digest, words: a row per turn of each rebuilt conversation; own: as of own_turns."""
    first = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    convs = own.where("place = 0").select("conv_id", first, shared_turns(F.col("conv_id")).alias("h")).where("h > 0")
    openings = own.where(F.col("place") < MOST_SHARED - 1).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    shared = convs.join(openings, "base").where("place < h").select("conv_id", "place", "digest", "words")
    rest = own.where(F.col("place") >= shared_turns(F.col("conv_id")))
    rows = materialize(rest.union(shared).withColumnRenamed("place", "at"), "trie-rows")
    found = chained(rows, "conv_id", ["at"], "digest", "trie-chain")
    return materialize(found.select("conv_id", (F.col("place") + 1).alias("depth"), "above", "node", "digest", "words"), "trie-rebuilt")


def id_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): the ids in order, joined by commas.

    Sorted ranges write ids together as rows of at most about CHUNK bytes; only these meet, in
    order, where a digest is fed. So memory holds one such row, however many members end at a node.
    """
    schema = pa.schema([("node", pa.binary()), ("least", pa.int64()), ("ids", pa.string())])
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size, ready = None, [], 0, []
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (node != now or size >= CHUNK):
                    ready.append((now, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                now = node
                ids.append(conv)
                size += 8
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
                ready = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], schema=schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            ready = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        ready.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ready, strict=True)], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    lines = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, least long, ids string")
    return lines.repartition(parts, "node").sortWithinPartitions("node", "least").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per node of the trie of rebuilt conversations, from the root down.

    Turns are ordered by turn, null first; equal ones by a digest of role and text, so repeated rows are
    turns of their own. A null role or text is empty; rows without a conversation belong to none and are
    left out; other columns, whatever their names, take no part. An empty table has no conversation and
    so no node. Result: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    then preorder (the node's number, from 0) and subtree_end (that of the first node behind its subtree).

    A path is ranked by the turns behind which conversations part, since the others order nothing.
    Such a path of b turns needs b conversations that leave it at different depths, so over b * b / 2
    turns in all: with 10^12 turns a key has under 50 MB, whatever the longest conversation.
    """
    with scratch() as keep:
        own = own_turns(df, conv_col, turn_col, role_col, text_col)
        turns = rebuilt(own)
        root = F.lit(packed(EMPTY))
        last = turns.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
        convs = own.where("place = 0").select("conv_id")
        ends = materialize(convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", root).alias("node")), "trie-ends")
        whole = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
        nodes = materialize(turns.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("above").alias("above"), F.max("words").alias("words")), "trie-nodes")

        upper = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("above_convs"))
        below = nodes.where("depth > 1").join(upper, "above")
        top = nodes.where("depth = 1").withColumns({"parent_conv_id": F.lit(whole["least"]).cast("long"), "above_convs": F.lit(whole["n"])})
        nodes = materialize(below.unionByName(top), "trie-parents")

        stops = ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_ends"))
        stops = materialize(stops, "trie-stops")
        paths = materialize(turns.join(stops.select("conv_id"), "conv_id", "left_semi").select("conv_id", "depth", "node", "digest"), "trie-paths")
        parting = materialize(paths.join(nodes.where("n_convs < above_convs").select("node"), "node", "left_semi").select("conv_id", "depth", F.hex("digest").alias("step")), "trie-parting")
        keys = parting.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "step"))), lambda x: x["step"]), "").alias("path"))
        ranked = stops.join(keys, "conv_id", "left").select("conv_id", F.coalesce("path", F.lit("")).alias("path"), "n_ends")
        ranked = running(materialize(ranked, "trie-keys"), ["path", "conv_id"], ["n_ends"], "trie-ranked").select("conv_id", F.col("n_ends_before").alias("first"))

        begins = materialize(paths.select("conv_id", "node").join(ranked, "conv_id").select("node", "first"), "trie-begins")
        notes = begins.select("node", "first", F.lit(None).cast("long").alias("child")).union(nodes.select("above", F.lit(None).cast("long"), F.lit(1).cast("long")))
        notes = notes.groupBy("node").agg(F.min("first").alias("first"), F.sum("child").alias("n_children"))
        tree = nodes.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "words").union(df.sparkSession.range(1).where(F.lit(whole["n"] > 0)).select(root, F.lit(whole["least"]).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(whole["n"]), F.lit(0).cast("long")))
        tree = tree.join(notes, "node", "left").withColumns({"first": F.coalesce("first", F.lit(0).cast("long")), "n_children": F.coalesce("n_children", F.lit(0).cast("long"))})
        tree = tree.join(id_digests(ends.select("node", "conv_id")), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
        tree = tree.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words"), "behind": F.col("first") + F.col("n_convs")})
        tree = running(materialize(tree.drop("node", "words"), "trie-tree"), ["first", "depth"], ["leaf", "saved"], "trie-preorder")

        total = tree.agg(F.count("*").alias("n"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaf"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
        starts = tree.groupBy(F.col("first").alias("behind")).agg(F.min("place").alias("place_behind"), F.min("leaf_before").alias("leaf_behind"), F.min("saved_before").alias("saved_behind"))
        found = tree.join(starts, "behind", "left")
        over = lambda c, n: F.coalesce(f"{c}_behind", F.lit(total[n]).cast("long"))
        out = found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (over("leaf", "leaf") - F.col("leaf_before")).alias("n_leaves"), (over("saved", "saved") - F.col("saved_before")).alias("saved_tokens"), "ends_sha256", F.col("place").alias("preorder"), over("place", "n").alias("subtree_end"))
        return keep(out, "trie")
