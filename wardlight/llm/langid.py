"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Two gated recurrent layers read the bytes of a text, one from each end; every position gets
probabilities of the languages from both states, and a document the mean over its positions.
Gates and candidates are piecewise linear (hard sigmoid and hard tanh), in training and in use.

A text is read in pieces side by side; each also reads `overlap` bytes before and behind it, from a zero
state, whose own labels are left to the neighbours. So every position is labelled by states that have read that
many bytes on either side (gates forget much sooner), and positions and documents are labelled by the same pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy, training_rest

LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    #: Bytes of a piece, and bytes read before and behind it.
    piece: int = 128
    overlap: int = 24
    #: Languages learned: the most frequent ones, up to so many.
    most_labels: int = 200
    #: The bound of the labelled sample that training sees: documents per language, and pieces per document.
    sample_docs: int = 400
    sample_pieces: int = 4
    train_piece: int = 64
    steps: int = 400
    batch: int = 256
    rate: float = 0.02
    seed: int = 5


#: Pieces read side by side.
LANES = 2048


def hard_sigmoid(x):
    return np.clip(0.25 * x + 0.5, 0.0, 1.0)


class Network:
    """Weights of both directions; arrays are (units, pieces) so that products run over many pieces at once."""

    def __init__(self, labels: list[str], settings: Settings):
        rng, h = np.random.default_rng(settings.seed), settings.hidden
        self.labels, self.hidden = labels, h
        make = lambda *shape: (rng.standard_normal(shape) * 0.4).astype(np.float32)
        # rows of E: what a byte adds to update gate, reset gate, candidate; W: the same of the state
        self.p = {"out": make(len(labels), 2 * h), "bias": np.zeros((len(labels), 1), np.float32)}
        for d in "fb":
            self.p |= {"E" + d: make(256, 3 * h), "W" + d: make(2 * h, h), "C" + d: make(h, h)}

    def states(self, d: str, data: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, units, pieces) of direction d over data (pieces, steps); piece order is by length,
        longest first, and at step t only the first active[t] are not over."""
        h, (n, steps) = self.hidden, data.shape
        E, W, C = self.p["E" + d], self.p["W" + d], self.p["C" + d]
        out = np.zeros((steps, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            m = active[t]
            if not m:
                continue
            x, s = np.ascontiguousarray(E[data[:m, t]].T), state[:, :m]
            gates = W @ s
            gates += x[: 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0.0, 1.0, out=gates)
            z, r = gates[:h], gates[h:]
            cand = C @ (r * s)
            cand += x[2 * h :]
            raw = cand.copy() if keep is not None else None
            np.clip(cand, -1.0, 1.0, out=cand)
            new = s + z * (cand - s)
            if keep is not None:
                keep.append((t, m, s.copy(), z, r, cand, raw))
            state[:, :m] = new
            out[t, :, :m] = new
        return out

    def positions(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (steps, labels, pieces) of every position; zero past a piece's end."""
        active = np.searchsorted(-lengths, -np.arange(data.shape[1]) - 0.5)
        f, b = self.states("f", data, active), self.states("b", data, active)
        h = self.hidden
        logits = np.matmul(self.p["out"][:, :h], f)
        logits += np.matmul(self.p["out"][:, h:], b)
        logits += self.p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits *= np.arange(data.shape[1])[:, None, None] < lengths[None, None, :]
        return logits

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time of the mean cross entropy of all positions; pieces are full."""
        n, steps = data.shape
        h, p = self.hidden, self.p
        active = np.full(steps, n)
        kept: dict[str, list] = {"f": [], "b": []}
        f, b = (self.states(d, data, active, kept[d]) for d in "fb")
        both = np.concatenate([f, b], axis=1)
        logits = np.matmul(p["out"], both) + p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        loss = float(-np.log(prob[:, target, np.arange(n)] + 1e-9).mean())
        delta = prob
        delta[:, target, np.arange(n)] -= 1.0
        delta /= n * steps
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["out"] = np.einsum("tln,tun->lu", delta, both, optimize=True)
        grad["bias"] = delta.sum(axis=(0, 2))[:, None]
        into = np.matmul(p["out"].T, delta)
        for d, part in (("f", into[:, :h]), ("b", into[:, h:])):
            W, C = p["W" + d], p["C" + d]
            later = np.zeros((h, n), np.float32)
            for t, _, s, z, r, cand, raw in reversed(kept[d]):
                ds = part[t] + later
                dcand = ds * z * ((raw > -1.0) & (raw < 1.0))
                dz = ds * (cand - s) * 0.25 * ((z > 0.0) & (z < 1.0))
                drs = C.T @ dcand
                dr = drs * s * 0.25 * ((r > 0.0) & (r < 1.0))
                gates = np.concatenate([dz, dr])
                grad["W" + d] += gates @ s.T
                grad["C" + d] += dcand @ (r * s).T
                np.add.at(grad["E" + d], data[:, t], np.concatenate([gates, dcand]).T)
                later = ds * (1.0 - z) + drs * r + W.T @ gates
        return grad, loss


def train(pieces: np.ndarray, target: np.ndarray, labels: list[str], settings: Settings) -> Network:
    """Adam over random batches with equal weight of the languages."""
    net, rng = Network(labels, settings), np.random.default_rng(settings.seed + 1)
    own = [np.flatnonzero(target == k) for k in range(len(labels))]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, settings.steps + 1):
        at = np.concatenate([rng.choice(o, settings.batch // len(labels) + 1) for o in own])
        grad, _ = net.gradients(pieces[at], target[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = settings.rate * min(1.0, 4 * (1 - step / (settings.steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(cut: DataFrame, shares: dict[str, float], most: int) -> dict[str, list]:
    """The pieces of the first `most` documents of each language by their order. A share, about three times the
    sample, bounds the order, so that tasks send few rows whatever the input's size."""
    bound = F.lit(None).cast("boolean")
    for label, share in shares.items():
        fits = F.lit(True) if share >= 1 else F.col("order") < int(-(1 << 63) + share * (1 << 64))
        bound = F.when(F.col("lang") == label, fits).otherwise(bound)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "pieces"))
    found: dict[str, list] = {}
    for r in cut.where(bound).withColumn("n", first).where(F.col("n") <= most).select("lang", "pieces").collect():
        found.setdefault(r["lang"], []).append(r["pieces"])
    return found


def fit(df: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """Trains on a bounded sample of df's rows with a language: for each, settings.sample_docs documents by
    the smallest hash of id and text, of each settings.sample_pieces pieces of bytes evenly spread over the whole text.

    The driver receives no more than the pieces. None where no row is labelled, an empty table included;
    rows with a null or empty text, or a null language, teach nothing; a null id counts as a name of its own.
    """
    rows = df.where(F.col(lang_col).isNotNull() & (F.octet_length(F.col(text_col)) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("order"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.most_labels).collect()}
    labels = sorted(counts)
    if not labels:
        return None
    size, n = settings.train_piece, settings.sample_pieces
    spots = [F.substring("raw", F.greatest(F.lit(1), F.floor((F.length("raw") - size) * (i + 0.5) / n) + 1).cast("int"), F.lit(size)) for i in range(n)]
    cut = rows.select("lang", "order", F.array(*spots).alias("pieces"))
    found = sample(cut, {k: 3 * settings.sample_docs / counts[k] for k in labels}, settings.sample_docs)
    short = [k for k in labels if len(found.get(k, ())) < min(settings.sample_docs, counts[k])]
    if short:
        found |= sample(cut, dict.fromkeys(short, 2.0), settings.sample_docs)
    pieces, target = [], []
    for k, label in enumerate(labels):
        for raws in found[label]:
            for raw in raws:
                pieces.append((bytes(raw) * (size // max(1, len(raw)) + 1))[:size])
                target.append(k)
    data = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, size)
    return train(data, np.array(target), labels, settings)


def middles(net: Network, texts: list[bytes], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every byte of all texts once: (text of each piece, first byte of each piece, probabilities of its bytes
    as (steps, labels, pieces), 0 past its end)."""
    cuts = []
    for k, raw in enumerate(texts):
        for at in range(0, len(raw), settings.piece):
            a, b = max(0, at - settings.overlap), min(len(raw), at + settings.piece + settings.overlap)
            cuts.append((b - a, k, at, a, b))
    cuts.sort(key=lambda c: -c[0])
    for i in range(0, len(cuts), LANES):
        own = cuts[i : i + LANES]
        lengths, owner, at, a = (np.array([c[j] for c in own]) for j in range(4))
        steps = int(lengths[0])
        data = np.frombuffer(b"".join([texts[k][x:y].ljust(steps, b"\0") for _, k, _, x, y in own]), np.uint8).reshape(len(own), steps)
        found = net.positions(data, lengths)
        before = at - a
        inner = np.minimum(settings.piece, np.array([len(texts[k]) for k in owner.tolist()]) - at)
        rows = before[None, :] + np.arange(settings.piece)[:, None]
        held = np.take_along_axis(found, np.minimum(rows, steps - 1)[:, None, :], axis=0)
        held *= (np.arange(settings.piece)[:, None] < inner[None, :])[:, None, :]
        yield owner, at, held


def predict_bytes(net: Network, texts: list[bytes], settings: Settings = Settings()) -> np.ndarray:
    """Mean probabilities (texts, labels) over all positions of each whole text; zeros for empty ones."""
    out = np.zeros((len(texts), len(net.labels)), np.float64)
    for owner, _, held in middles(net, texts, settings):
        np.add.at(out, owner, held.sum(axis=0, dtype=np.float64).T)
    return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def label_positions(net: Network, text: str, settings: Settings = Settings()) -> list[str]:
    """The language of every byte of a text; the document's probabilities are the mean of those behind them."""
    raw = text.encode()
    found = np.zeros(len(raw), np.int64)
    for _, at, held in middles(net, [raw], settings):
        best = held.argmax(axis=1)
        for k, start in enumerate(at.tolist()):
            stop = min(len(raw), start + settings.piece)
            found[start:stop] = best[: stop - start, k]
    return [net.labels[k] for k in found.tolist()]


def identify(df: DataFrame, net: Network | None, text_col: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """Adds lang_pred and score (mean probability of that language) to df's columns `keep` (default: all).

    und with score 0 where text is null or has no letter, or no language was learned. Rows are
    independent. Columns of those names in df are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, model = to_arrow_schema(schema), pickle.dumps(net)
    small_batches(df.sparkSession)
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("t"))
    most = 1 << 19

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, stop = [], 0, at
                while stop < batch.num_rows and size < most and stop - at < 2048:
                    text = batch.column(len(keep))[stop].as_py()
                    texts.append(text.encode() if net and text and LETTER.search(text) else b"")
                    size, stop = size + len(texts[-1]), stop + 1
                found = predict_bytes(net, texts, settings) if net else np.zeros((len(texts), 1))
                best = found.argmax(axis=1)
                names = [net.labels[k] if t else "und" for k, t in zip(best, texts, strict=True)]
                scores = np.where([len(t) > 0 for t in texts], found[np.arange(len(texts)), best], 0.0)
                part = batch.slice(at, stop - at)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.clip(scores, 0.0, 1.0), pa.float64())], schema=arrow)
                at = stop
        tidy()

    return rows.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")


def identify_documents(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """Learns from documents whose crc32 of the id modulo 4 is not 2, and predicts all: id_col, held_out, lang_pred, score.

    Null texts and texts without a letter are und with score 0, as is every row where nothing was learned; an
    empty table gives an empty result. Repeated rows are predicted alike; other columns take no part.
    """
    held = training_rest(id_col, 4) == 2
    net = fit(df.where(~held), settings, id_col=id_col)
    rows = df.select(F.col(id_col), held.alias("held_out"), F.col("text"))
    return identify(rows, net, "text", [id_col, "held_out"], settings)
