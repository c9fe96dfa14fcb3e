"""LM scoring with a weighted backoff automaton over smoothed trigrams, counted over all training documents.

Counting. Documents are gathered into blocks where they lie. A block asks for the totals of its
distinct words (see exchange), then of its pairs of words, then of its triples. What one block
alone has need not be asked about: a pair is asked about only if other blocks have both of its words,
a triple only if others have both of its pairs, and else its count is the block's own. No model is collected
anywhere: a block gets the part that its texts touch, and a frequent word is one entry per block.
Keys are 64-bit hashes of words; among 10^9 words two that meet have a chance of 3 %.

Model (hierarchical Dirichlet smoothing), c counting training texts, each of which ends with END:
p(w) = (c(w) + 1) / (N + V + 1), p(w | v) = (c(vw) + PAIR_WEIGHT * p(w)) / (c(v) + PAIR_WEIGHT) and
p(w | uv) = (c(uvw) + TRIPLE_WEIGHT * p(w | v)) / (c(uv) + TRIPLE_WEIGHT). As an automaton: a
state for each pair and each word seen, and the root; arcs for the triples, pairs and words seen; a failure arc
of weight TRIPLE_WEIGHT / (c(uv) + TRIPLE_WEIGHT) from a pair to its second word, and one of weight
PAIR_WEIGHT / (c(v) + PAIR_WEIGHT) from a word to the root, which has an arc for every word, those never
seen included. An arc leads to the state of the longest end of what was read that has one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, materialize_by, parts_for, scratch, small_batches, tidy, training_rest
from .exchange import ANSWER, ASKED, arrow, fans, joined, owner, rows_of, several, totals, value
from .packing import mix, pack, pack_sorted, unpack, unpack_sorted

#: Bytes of text in a block, and of text for each range of keys.
BLOCK_BYTES, RANGE_BYTES, LEAST_RANGES = 4 << 20, 8 << 20, 8
#: Weight of the shorter context in a pair's and a triple's probability.
PAIR_WEIGHT, TRIPLE_WEIGHT = 8.0, 4.0
#: The end of a text; no word is empty.
END = b""
KINDS = ("words", "pairs", "triples")


class Block:
    """Whole texts as numbers of their distinct words, which are ordered by key."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        end = numbers[END]
        tokens: list[int] = []
        lengths = []
        for text in texts:
            own = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six separators
            tokens.extend(map(numbers.__getitem__, own))
            tokens.append(end)
            lengths.append(len(own) + 1)
        keys = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.tokens, self.lengths = keys[order], rank[np.array(tokens, np.int64)], np.array(lengths, np.int64)
        self.end = int(rank[end])

    def grams(self) -> None:
        """Distinct pairs (first, second) with each token's pair that it ends (pair_at), and distinct triples
        (first pair, second pair) with each token's triple (triple_at, -1 for the first of a text)."""
        n = len(self.keys)
        before = np.empty_like(self.tokens)
        before[0:1], before[1:] = self.end, self.tokens[:-1]  # after an end, the next text's first word follows the end
        codes, self.pair_at = np.unique(before * n + self.tokens, return_inverse=True)
        self.first, self.second = codes // n, codes % n
        self.starts = np.cumsum(self.lengths) - self.lengths
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        codes, found = np.unique(self.pair_at[at - 1] * len(self.first) + self.pair_at[at], return_inverse=True)
        self.triple_at = np.full(len(self.tokens), -1, np.int64)
        self.triple_at[at] = found
        self.former, self.latter = codes // max(1, len(self.first)), codes % max(1, len(self.first))

    def own(self, held: np.ndarray) -> dict[str, np.ndarray]:
        """Counts of words, pairs and triples in texts that aren't held out."""
        weight = np.repeat(~held, self.lengths)
        inner = weight & (self.triple_at >= 0)
        sizes = len(self.keys), len(self.first), len(self.former)
        return {k: np.bincount(at, minlength=n).astype(np.uint64) for k, at, n in zip(KINDS, (self.tokens[weight], self.pair_at[weight], self.triple_at[inner]), sizes, strict=True)}

    def asks(self, kind: str, shared: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words, pairs or triples are asked about, their keys), by the keys' order; shared: the words, or pairs, that other blocks have."""
        if kind == "words":
            return np.arange(len(self.keys)), self.keys
        keys = mix(self.keys[self.first], self.keys[self.second])
        if kind == "pairs":
            asked = shared[self.first] & shared[self.second]
        else:
            asked = shared[self.former] & shared[self.latter]
            keys = mix(keys[self.former], self.keys[self.second[self.latter]])
        at = np.flatnonzero(asked)
        at = at[np.argsort(keys[at], kind="stable")]
        return at, keys[at]

    def totals(self, own: dict[str, np.ndarray], answers: dict[str, np.ndarray], kinds: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray | None]:
        """Counts in all training texts of the kinds that are answered, and which of the last kind other blocks have."""
        known, shared = {}, None
        for kind in kinds:
            at, _ = self.asks(kind, shared)
            answer = answers.get(kind, np.zeros(0, np.uint64))
            known[kind], shared = own[kind].copy(), np.zeros(len(own[kind]), bool)
            known[kind][at], shared[at] = value(answer), several(answer)
        return known, shared

    def dump(self) -> bytes:
        parts = [pack_sorted(self.keys), pack(self.tokens), pack(self.lengths), pack(np.array([self.end]))]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def load(cls, data: bytes) -> Block:
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        block = cls.__new__(cls)
        block.keys = unpack_sorted(parts[0])
        block.tokens, block.lengths = unpack(parts[1]).astype(np.int64), unpack(parts[2]).astype(np.int64)
        block.end = int(unpack(parts[3])[0])
        block.grams()
        return block


class Automaton:
    """The part of the model that a block's texts touch.

    State 0 is the root, 1 + v the word v, 1 + words + p the pair p. weights: of the arcs of words (from
    the root), pairs and triples; seen: whether the arc is there. fail: weight of each state's failure arc.
    """

    def __init__(self, block: Block, known: dict[str, np.ndarray], tokens: int, distinct: int):
        c1, c2, c3 = (known[k].astype(float) for k in KINDS)
        p1 = (c1 + 1.0) / (tokens + distinct + 1.0)
        p2 = (c2 + PAIR_WEIGHT * p1[block.second]) / (c1[block.first] + PAIR_WEIGHT)
        p3 = (c3 + TRIPLE_WEIGHT * p2[block.latter]) / (c2[block.former] + TRIPLE_WEIGHT)
        self.block, self.words = block, len(block.keys)
        self.weights, self.seen = [np.log10(p) for p in (p1, p2, p3)], [c > 0 for c in (c1, c2, c3)]
        self.fail = np.concatenate([[0.0], np.log10(PAIR_WEIGHT / (c1 + PAIR_WEIGHT)), np.log10(TRIPLE_WEIGHT / (c2 + TRIPLE_WEIGHT))])
        self.fail_to = np.concatenate([[0], np.zeros(self.words, np.int64), 1 + block.second])

    def run(self) -> np.ndarray:
        """log10 probability of each text: all texts are read side by side, each once from left to right, from the state of a text's start."""
        block, (seen1, seen2, seen3), words = self.block, self.seen, self.words
        word, pair = block.tokens, block.pair_at
        into = np.where(seen2[pair], 1 + words + pair, np.where(seen1[word], 1 + word, 0))  # where the arc of a token leads
        into[word == block.end] = 1 + block.end if seen1[block.end] else 0
        arc3 = (block.triple_at >= 0) & seen3[block.triple_at] if len(seen3) else np.zeros(len(word), bool)
        arc2 = seen2[pair]
        order = np.argsort(-block.lengths, kind="stable")
        starts, lengths = block.starts[order], block.lengths[order]
        active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
        state = np.full(len(order), 1 + block.end if seen1[block.end] else 0)
        total = np.zeros(len(order))
        for t, m in enumerate(active.tolist()):
            at, s, sum_ = starts[:m] + t, state[:m], total[:m]
            hit = (s > words) & arc3[at]
            sum_[hit] += self.weights[2][block.triple_at[at[hit]]]
            lost = np.flatnonzero((s > words) & ~hit)  # no arc: on to the second word
            sum_[lost] += self.fail[s[lost]]
            s[lost] = self.fail_to[s[lost]]
            open_ = ~hit
            hit = open_ & (s > 0) & arc2[at]
            sum_[hit] += self.weights[1][pair[at[hit]]]
            open_ &= ~hit
            lost = np.flatnonzero(open_)
            sum_[lost] += self.fail[s[lost]] + self.weights[0][word[at[lost]]]  # the root's failure arc weighs nothing
            state[:m] = into[at]
        out = np.empty(len(order))
        out[order] = total
        return out


def blocks(df: DataFrame, text_col: str, id_col: str, held: F.Column, block_bytes: int) -> DataFrame:
    """A row per block: its name, ids, held and its texts as numbers. A block ends with the text that reaches block_bytes, so memory follows the longest text."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("texts", T.BinaryType()), T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("held", T.ArrayType(T.BooleanType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def flush(name: str, ids: list, held: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c], out.field(k).type) for k, c in enumerate((name, Block(texts).dump(), ids, held))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size = TaskContext.get().partitionId(), 0, 0
        ids, held, texts = [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                ids.append(batch.column(0)[k].as_py())
                held.append(batch.column(1)[k].as_py())
                texts.append(text)
                size += len((text or "").encode()) + 16
                if size >= block_bytes:
                    yield flush(f"{part}-{n}", ids, held, texts)
                    ids, held, texts, size, n = [], [], [], 0, n + 1
        if ids:
            yield flush(f"{part}-{n}", ids, held, texts)
        tidy()

    return rows.mapInArrow(run, schema)


def loaded(rows: pa.Table, got: pa.Table) -> tuple[Block, np.ndarray, dict[str, np.ndarray]]:
    """A block, which of its texts are held out, and the answers so far by kind."""
    kinds = set(got.column("kind").to_pylist())
    answers = {k: joined(got.filter(pc.equal(got.column("kind"), k))) for k in kinds}
    return Block.load(rows.column("texts")[0].as_py()), np.array(rows.column("held")[0].as_py(), bool), answers


def ask(sent: DataFrame, answers: DataFrame, kind: str, ranges: int) -> DataFrame:
    """Each block's words, pairs or triples that others may count too, with their counts in its training texts, dealt to ranges."""

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        block, held, answers = loaded(rows, got)
        own = block.own(held)
        at, keys = block.asks(kind, block.totals(own, answers, KINDS[: KINDS.index(kind)])[1])
        tidy()
        return arrow(rows_of(rows.column("block")[0].as_py(), keys, None, own[kind][at], ranges), ASKED)

    return sent.select("block", "texts", "held").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ASKED)


def score_texts(df: DataFrame, held: F.Column | None = None, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """log10 probability of every whole text under the model of the documents that aren't held out.

    held: boolean column of df (default: crc32 of the id modulo 7 is 2). Null texts count as
    empty and consist of the end alone. Rows are independent texts: repeated rows are counted and
    scored as often as they occur. Without training documents every token has probability 1. An
    empty table gives an empty result; other columns of df, whatever their names, take no part.
    Result: id_col, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double, rounded to
    6 places, since sums of logarithms differ in their last bits with the order of their terms).
    """
    held = training_rest(id_col, 7) == 2 if held is None else held
    size = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()["bytes"] or 0
    hops = fans(max(LEAST_RANGES, -(-size // RANGE_BYTES)))
    with scratch() as keep:
        sent = materialize_by(blocks(df, text_col, id_col, held, block_bytes), "lm_blocks", "block", parts_for(df.sparkSession, size))
        number = sent.count()
        answers = df.sparkSession.createDataFrame([], f"{ANSWER}, kind string")
        for kind in KINDS:
            got = totals(ask(sent, answers, kind, hops[0]), hops, number, tag="lm")
            answers = answers.union(materialize(got.withColumn("kind", F.lit(kind)), f"lm-{kind}"))
        whole = vocabulary(sent, answers)
        return keep(scored(sent, answers, whole["tokens"] or 0, whole["distinct"] or 0, id_col, df.schema[id_col].dataType), "lm-scores")


def vocabulary(sent: DataFrame, answers: DataFrame):
    """Training tokens and distinct words of all blocks: each word is counted by the block that owns its answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = distinct = 0
        for batch in batches:
            for packed in batch.column(0):
                answer = unpack(packed.as_py())
                own = value(answer[owner(answer)])
                tokens, distinct = tokens + int(own.sum()), distinct + int(np.count_nonzero(own))
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([distinct], pa.int64())], names=["tokens", "distinct"])

    return answers.where("kind = 'words'").select("answer").mapInArrow(run, "tokens long, distinct long").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()


def scored(sent: DataFrame, answers: DataFrame, tokens: int, distinct: int, id_col: str, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        block, held, answers = loaded(rows, got)
        known, _ = block.totals(block.own(held), answers, KINDS)
        model = Automaton(block, known, tokens, distinct)
        n_known = np.add.reduceat(model.seen[0].astype(np.int64)[block.tokens], block.starts)
        base, scores = np.add.reduceat(model.weights[0][block.tokens], block.starts), model.run()
        n = len(scores)
        tidy()
        return pa.table([rows.column("ids").combine_chunks().flatten().cast(out.field(0).type), rows.column("held").combine_chunks().flatten(), pa.array(block.lengths), pa.array(n_known), pa.array([tokens] * n, pa.int64()), pa.array(np.round(base, 6)), pa.array(np.round(scores, 6))], schema=out)

    return sent.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of score_texts over documents, crc32 included."""
    return rf"""
WITH RECURSIVE crc(i, v, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS idt FROM {docs}),
h AS (SELECT rid, doc_id, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(idt, ''), lambda c: ord(c)::BIGINT)),
  lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 7 = 2 AS held_out FROM d, tab),
w AS (SELECT rid, doc_id, held_out, list_append(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+'), '') AS ws FROM h),
p AS (SELECT rid, held_out, CASE WHEN i = 1 THEN NULL WHEN i = 2 THEN '' ELSE ws[i - 2] END AS x, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS v, ws[i] AS w FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM w)),
u AS (SELECT w, count(*)::DOUBLE AS c FROM p WHERE NOT held_out GROUP BY w),
b AS (SELECT v, w, count(*)::DOUBLE AS c FROM p WHERE NOT held_out GROUP BY v, w),
t3 AS (SELECT x, v, w, count(*)::DOUBLE AS c FROM p WHERE NOT held_out AND x IS NOT NULL GROUP BY x, v, w),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS k FROM u),
q AS (SELECT p.rid, p.x IS NOT NULL AS deep, coalesce(u.c, 0) AS cw, coalesce(y.c, 0) AS cv, coalesce(b.c, 0) AS cvw, coalesce(z.c, 0) AS cxv, coalesce(t3.c, 0) AS cxvw, (coalesce(u.c, 0) + 1) / (s.n + s.k + 1)::DOUBLE AS pw
  FROM p LEFT JOIN u ON u.w = p.w LEFT JOIN u y ON y.w = p.v LEFT JOIN b ON b.v = p.v AND b.w = p.w
  LEFT JOIN b z ON z.v = p.x AND z.w = p.v LEFT JOIN t3 ON t3.x = p.x AND t3.v = p.v AND t3.w = p.w, s),
q2 AS (SELECT *, (cvw + {PAIR_WEIGHT} * pw) / (cv + {PAIR_WEIGHT}) AS p2 FROM q),
r AS (SELECT rid, count(*) AS n_tokens, count(*) FILTER (cw > 0) AS n_known, fsum(log10(pw)) AS base_score,
  fsum(log10(CASE WHEN deep THEN (cxvw + {TRIPLE_WEIGHT} * p2) / (cxv + {TRIPLE_WEIGHT}) ELSE p2 END)) AS score FROM q2 GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM s) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM r JOIN w USING (rid)
"""
