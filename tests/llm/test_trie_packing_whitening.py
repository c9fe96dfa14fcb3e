"""The prefix trie, packing and whitening against brute force; running sums and digests over split keys."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from wardlight.llm import binpack, common, queries, running, trie, whitening


def plain_trie(rows):
    """Counter of result rows by prefixes as tuples."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def talk(seed, convs=90):
    rng = random.Random(seed)
    lines = ["hi", "how are  you", "fine\nthanks", "", None, "bye now then", "Straße 😀"]
    rows = []
    for c in [*range(convs), 1000, 1001, -7, -20]:
        said = [(rng.choice(["user", "assistant", None]), rng.choice(lines)) for _ in range(rng.randrange(1, 5))] if c % 3 else [("user", "hi"), ("assistant", "fine\nthanks"), ("user", "x y")]
        rows += [(c, i if rng.random() < 0.9 else None, r, t) for i, (r, t) in enumerate(said)]
    rows += rows[:9]  # repeated rows are turns
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = talk(seed) + [(None, 1, "user", "lost"), (5, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, place int, node string").repartition(3)
    found = trie.prefix_trie(df)
    got = found.collect()
    assert Counter(tuple(r)[:8] for r in got) == plain_trie(rows)
    order = sorted(got, key=lambda r: r.preorder)
    assert [r.preorder for r in order] == list(range(len(got)))
    for r in order:  # subtrees are intervals
        inside = order[r.preorder : r.subtree_end]
        assert sum(x.n_children == 0 for x in inside) == r.n_leaves and all(x.depth > r.depth for x in inside[1:])
    assert trie.prefix_trie(df.limit(0)).count() == 0
    alone = trie.prefix_trie(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert Counter(tuple(r)[:8] for r in alone) == plain_trie([(1, 0, "user", "x")])


def test_trie_of_one_long_and_many_equal_conversations(spark):
    """A conversation of half of all turns lies in many ranges, and hundreds of members end at one node."""
    rows = [(40, i, "user", f"turn {i}") for i in range(600)] + [(41 + i, k, "user", t) for i in range(150) for k, t in enumerate(["a", "b c"])]
    rows += [(400 + i, k, "user", f"turn {k}") for i in range(5) for k in range(100 * i + 3)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert Counter(tuple(r)[:8] for r in got) == plain_trie(rows)


def test_running_sums_and_digests(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randbytes(16), rng.choice([None, 0, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, d binary, v long").repartition(5)
    sofar = 0
    for n, r in enumerate(sorted(running.running(df, ["k", "i"], ["v"], "t").collect(), key=lambda r: (r.k, r.i))):
        assert (r.place, r.v_before) == (n, sofar)
        sofar += r.v or 0
    seen = defaultdict(lambda: (0, running.EMPTY))
    for r in sorted(running.chained(df, "k", ["i"], "d", "t").collect(), key=lambda r: (r.k, r.i)):
        n, value = seen[r.k]
        after = (value * running.BASE + int.from_bytes(r.d, "big")) % running.PRIME
        assert (r.place, bytes(r.above), bytes(r.node)) == (n, running.packed(value), running.packed(after))
        seen[r.k] = n + 1, after
    assert running.running(df.limit(0), ["k", "i"], ["v"], "t").count() == running.chained(df.limit(0), "k", ["i"], "d", "t").count() == 0


def spread(seed, n=300, dims=12):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dims)) * np.linspace(1, 0.2, dims) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0] + 3


def plain_whitening(vectors, k):
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("dims, n", [(12, 300), (3, 40), (40, 200)])
def test_whitening(spark, dims, n):
    vectors = spread(dims, n, dims).tolist()
    rows = [(i, v, "a", 1) for i, v in enumerate([*vectors, *vectors[:5], *[vectors[0]] * 20])]
    bad = [(9001, None, "a", 1), (9002, [1.0, None, *[0.0] * (dims - 2)], "a", 1), (9003, [float("nan")] * dims, "b", 1), (9004, [float("inf"), *[0.0] * (dims - 1)], "a", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, x string, component int").repartition(4)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    k = min(4, dims)
    count, far, white, shares = plain_whitening([r[1] for r in rows], k)
    assert len(got) == len(rows) * k and (got.n == count).all() and (got.identity_error < 1e-9).all()
    found = got.whitened.to_numpy().reshape(-1, k)
    assert np.allclose(found * np.sign((found * white).sum(axis=0)), white, atol=1e-8)
    assert (got.deviation.to_numpy().reshape(-1, k) == far[:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), shares, rtol=1e-9)


def test_whitening_of_few_short_and_huge_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == whitening.whiten(make([(1, None)])).count() == whitening.whiten(make([(1, [])])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector varies nowhere
    got = sorted(whitening.whiten(make([(1, [1.0]), (2, [1.0, 2.0]), (3, [])])).collect(), key=lambda r: r.vec_id)
    assert {r.component for r in got} == {1, 2} and all(r.n == 3 for r in got)  # short ones end in zeros
    huge = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert [r.deviation for r in huge if r.vec_id == 1] == [None] and all(int(r.deviation_text) > 2**63 for r in huge if r.vec_id == 1)


def test_lanczos_restarts():
    """Equal eigenvalues, missing ranks and one direction alone."""
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for e in ([5.0] * 12 + [1.0] * 18, [3.0, 3.0] + [0.0] * 28, [1.0] + [0.0] * 29, list(np.linspace(9, 1, 30))):
        m = q @ np.diag(e) @ q.T
        values, vectors = whitening.block_lanczos(lambda x, m=m: m @ x, 30, 4, block=4)
        assert np.allclose(values, sorted(e, reverse=True)[:4], atol=1e-12)
        assert np.allclose(m @ vectors, vectors * values, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-11)


FILE = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_encoded_as_texts_are():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(FILE), binpack.Words(FILE)
    texts = ["a\x01b  \x01 c", "Σίσυφος ΣΑΣ İstanbul ẹ́", "don't  'S x y​z 12,34?!...", "", "   ", "x" * 3000, "<|endoftext|> hi<|startoftext|>x", "İ K K̊ Å", "ab\x0bcd\x0cef\x85gh ij", "ÉTÉ été\r\n\tÉTÉ", "a\x1cb \x1f c\u2003d\u00a0e\u2028f", "word, word. don't, 3,! x²). a\u0301, (x), été... l's, \u4e2d\u6587, 's, ...,"]
    for text in texts + [" ".join(texts) * 3]:
        assert b"".join(map(words.ids, words.slices(text))) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:40]


def lengths_of(kind, n, seed=5):
    rng = random.Random(seed)
    return {"even": [rng.randrange(1, 65) for _ in range(n)], "large": [rng.randrange(22, 65) for _ in range(n)], "whole": [64] * n, "hot": [rng.choice([30, 30, 30, rng.randrange(1, 64)]) for _ in range(n)]}[kind]


@pytest.mark.parametrize("kind", ["even", "large", "whole", "hot"])
@pytest.mark.parametrize("groups", [5, 256])
def test_plans_fit_and_are_tight(kind, groups):
    lengths, cap = sorted(lengths_of(kind, 800), reverse=True), 64
    counts = Counter(lengths)
    taken, left, _ = binpack.slots(binpack.grouped(counts, cap, groups), cap)
    every, held = binpack.runs(counts), defaultdict(list)
    for first, n, q, copies in taken:
        for p in range(first, first + n):
            held[q + (p - first) % copies].append(p)
    rooms = {q: cap - sum(lengths[p] for p in own) for q, own in held.items()}
    order = sorted(rooms, key=lambda q: (rooms[q], q))
    small = [r for r in every if r[0] <= cap // binpack.LARGE]
    events, number = binpack.best_fit(binpack.of_places(every, left) + small, Counter(rooms.values()), cap)
    final = defaultdict(list, {i: held[q] for i, q in enumerate(order)})
    waiting = [p for _, a, n in [*binpack.of_places(every, left), *small] for p in range(a, a + n)]
    events.sort()
    starts = [e[0] for e in events]
    for p in waiting:
        first, goal, each = events[np.searchsorted(starts, p, "right") - 1]
        final[goal + (p - first) // each].append(p)
    assert sorted(p for own in final.values() for p in own) == list(range(len(lengths)))
    assert all(sum(lengths[p] for p in own) <= cap for own in final.values()) and len(final) == number
    if groups > cap:  # exact sizes: as good as best fit decreasing
        assert number <= binpack.best_fit(every, {}, cap)[1]


def test_packing(spark):
    from tokenizers import Tokenizer

    rng, whole = random.Random(4), Tokenizer.from_file(FILE)
    texts = [None, "", "word", *[" ".join(rng.choice(["alpha", "Straße", "zorp,", "q9"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]]
    texts += [" ".join(["long"] * n) for n in (63, 64, 127, 128, 129, 1000)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x")] * 2 + [(None, "lost", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, sequence_id string").repartition(3)
    got = binpack.pack_documents(df, FILE, 64).collect()
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in rows}
    want = Counter()
    for d, *_ in rows:
        for k in range(0, len(ids[d]), 64):
            part = np.array(ids[d][k : k + 64], "<u4")
            want[d, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert -(-total // 64) <= len(held) <= 1.03 * total / 64 + 2 and set(held) == set(range(len(held)))
    assert binpack.pack_documents(df.limit(0), FILE, 64).count() == 0


def test_scratch_of_two_threads(spark):
    """What one thread's operator wrote isn't removed by another's."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both = Barrier(2, timeout=60)

    def one(k):
        with common.scratch() as keep:
            first = common.materialize(spark.range(k), "t")
            both.wait()  # both are open
            kept = keep(first, "kept")
            if k == 5:
                both.wait()
            else:
                both.wait()
                assert first.count() == k
        return kept.count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(one, [5, 7])) == [5, 7]


def test_results_can_be_removed(spark):
    with common.results():
        with common.scratch() as keep:
            kept = keep(spark.range(3), "r")
        path = kept.inputFiles()[0]
        assert kept.count() == 3
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()


def test_registered():
    assert {"op11_embedding_whitening", "op12_best_fit_packing", "op13_prefix_trie"} <= set(queries.QUERIES) and "op13_prefix_trie" in queries.ORACLES


def test_url_rules_of_equal_length(spark):
    """The first given wins, whatever the order."""
    from pyspark.sql import functions as F

    from wardlight.llm import urls

    df = spark.createDataFrame([("x.org", "/abc")], "host string, path string")
    for rules in ([("block", "org/ab"), ("allow", "x.org/")], [("allow", "x.org/"), ("block", "org/ab")]):
        assert df.select(urls.rule_of(F.col("host"), F.col("path"), rules)).first()[0] == rules[0][1]
