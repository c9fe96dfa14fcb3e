"""Language identification and language-model scoring: gradients, held-out accuracy, brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from wardlight.llm import backoff, langid, packing
from wardlight.llm.common import training_rest

SMALL = langid.Settings(steps=60, sample_docs=40, train_piece=32, batch=64)


def test_gradients_match_differences():
    settings = langid.Settings(hidden=4)
    net = langid.Network(["a", "b", "c"], settings)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    data, target = rng.integers(0, 256, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    grad, _ = net.gradients(data, target)
    for k in ("out", "bias", "Wf", "Cb", "Ef", "Eb"):
        place = tuple(rng.integers(0, s) for s in net.p[k].shape)
        if k[0] == "E":
            place = (int(data[0, 3]), place[1])
        slopes = []
        for d in (1e-3, -1e-3):
            net.p[k][place] += d
            slopes.append(net.gradients(data, target)[1])
            net.p[k][place] -= d
        assert abs((slopes[0] - slopes[1]) / 2e-3 - grad[k][place]) < 2e-3, k


def corpus(n=240):
    rng = random.Random(1)
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["zürich", "straße", "über", "schön"], "z": ["où", "façade", "élève", "garçon"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60))), lang) for i in range(n) for lang in [rng.choice("xyz")]]
    return [*rows, (n, None, "x"), (n + 1, "", None), (n + 2, "12 !?", "y"), (None, "straße über", None)]


def test_language_id(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in corpus()], "doc_id long, text string, lang string, score double")
    found = langid.identify_documents(df, SMALL).collect()
    assert len(found) == len(corpus())
    truth = {d: lang for d, _, lang in corpus()}
    seen = [r for r in found if r.held_out and truth.get(r.doc_id) and r.lang_pred != "und"]
    assert len(seen) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in seen) >= 0.95 * len(seen)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (240, 241, 242):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    net = langid.fit(df.where(training_rest("doc_id", 4) != 2), SMALL)
    assert len(langid.label_positions(net, "straße")) == 7 and langid.label_positions(net, "") == []
    assert langid.fit(df.where("lang is null")) is None
    assert {r.lang_pred for r in langid.identify(df.drop("lang"), None).collect()} == {"und"}
    assert langid.identify(df.limit(0), net).count() == 0
    clash = langid.identify(df.selectExpr("doc_id as t_", "text", "lang as k0", "1.0 as t"), net)
    assert clash.columns == ["t_", "text", "k0", "t", "lang_pred", "score"] and {r.t_: r.lang_pred for r in clash.collect()} == {r.doc_id: r.lang_pred for r in langid.identify(df, net).collect()}


def test_positions_and_documents_agree():
    """Documents are the mean of their positions, each of which is labelled once, with the bytes around its piece."""
    rng = random.Random(4)
    words = {"a": ["the", "house", "is"], "b": ["das", "grüne", "haus"]}
    raws = [" ".join(rng.choice(words["ab"[k % 2]]) for _ in range(30)).encode()[:32] for k in range(200)]
    net = langid.train(np.frombuffer(b"".join(raws), np.uint8).reshape(-1, 32), np.arange(200) % 2, ["a", "b"], langid.Settings(steps=200, train_piece=32, batch=64))
    parts = [" ".join(rng.choice(words["ab"[k % 2]]) for _ in range(40)) + " " for k in range(10)]
    raw = "".join(parts).encode()
    for settings in (SMALL, langid.Settings(piece=1, overlap=9), langid.Settings(piece=5000, overlap=3)):
        plain = np.zeros((len(raw), 2))
        for at in range(0, len(raw), settings.piece):  # each piece by itself
            a, b = max(0, at - settings.overlap), min(len(raw), at + settings.piece + settings.overlap)
            found = net.positions(np.frombuffer(raw[a:b], np.uint8)[None, :], np.array([b - a]))[:, :, 0]
            stop = min(len(raw), at + settings.piece)
            plain[at:stop] = found[at - a : stop - a]
        assert langid.label_positions(net, raw.decode(), settings) == [net.labels[k] for k in plain.argmax(axis=1)]
        mean = langid.predict_bytes(net, [b"", raw, b"x"], settings)
        assert np.allclose(mean[1], plain.mean(axis=0), atol=1e-5) and not mean[0].any() and abs(mean[2].sum() - 1) < 1e-5


def test_languages_of_long_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the house " * 100_000, "en"), (2, None, None), (3, "", "en"), (4, "12 34", "de")], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify_documents(df, SMALL).collect()}
    assert found[2].lang_pred == found[3].lang_pred == found[4].lang_pred == "und" and found[1].lang_pred in ("en", "de", "und")
    assert langid.identify_documents(df.limit(0), SMALL).count() == 0


def plain_scores(rows):
    tokens = {k: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for k, (_, t) in enumerate(rows)}
    held = {k: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for k, (d, _) in enumerate(rows)}
    uni, pairs, triples = Counter(), Counter(), Counter()
    for k, ws in tokens.items():
        if not held[k]:
            uni.update(ws)
            pairs.update(zip(["\n", *ws], ws))
            triples.update(zip(["\n", *ws], ws, ws[1:]))
    n, v = sum(uni.values()), len(uni)
    for k, ws in tokens.items():
        p = [(uni[w] + 1) / (n + v + 1) for w in ws]
        two = [(pairs[a, w] + backoff.PAIR_WEIGHT * q) / (uni[a] + backoff.PAIR_WEIGHT) for a, w, q in zip(["\n", *ws], ws, p)]
        three = [(triples[a, b, w] + backoff.TRIPLE_WEIGHT * q) / (pairs[a, b] + backoff.TRIPLE_WEIGHT) for a, b, w, q in zip(["\n", *ws], ws, ws[1:], two[1:])]
        full = [math.log10(q) for q in [two[0], *three]]
        yield rows[k][0], held[k], len(ws), sum(uni[w] > 0 for w in ws), n, sum(map(math.log10, p)), sum(full)


def test_backoff_scores(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "É", "é", "a|b", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "the cat"), (3, rows[3][1]), (202, "x " * 3000)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    found = backoff.score_texts(df, block_bytes=400).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=repr)
    want = sorted(plain_scores(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-6)
    assert backoff.score_texts(df.limit(0)).count() == 0
    held = backoff.score_texts(df.where("doc_id = 1"), held=df.doc_id.isNotNull()).first()
    assert (held.train_tokens, held.n_known, held.score) == (0, 0, 0.0)


def model_of(texts, held):
    block = backoff.Block.load(backoff.Block(texts).dump())
    known = block.own(np.array(held))
    return block, backoff.Automaton(block, known, int(known["words"].sum()), int(np.count_nonzero(known["words"])))


def test_probabilities_sum_to_one():
    """After any two words, the probabilities of all next tokens and of one never seen add up to 1."""
    train, names = ["a b a c", "b a", "a b a b"], ["a", "b", "c", ""]
    for context in ([], ["a"], ["b", "a"], ["c", "c"], ["x", "a"], ["a", "x"]):
        total = 0.0
        for name in [*names, "never"]:
            both = [" ".join([*context, name]), " ".join(context)]
            _, model = model_of([*train, *both], [False] * 3 + [True] * 2)
            # the text without the next token ends in its place
            long, short = model.run()[3:]
            block = model.block
            end = np.searchsorted(block.keys, block.keys[block.end])
            if name:
                _, rest = model_of([*train, " ".join([*context, name])], [False] * 3 + [True])
                last = rest.run()[3] - prefix_score(train, [*context, name])
                total += 10 ** (long - last - prefix_score(train, context))
            else:
                total += 10 ** (short - prefix_score(train, context))
            assert end == block.end
        assert abs(total - 1) < 1e-9


def prefix_score(train, words):
    """log10 probability of words without an end, from the plain formulas."""
    uni, pairs, triples = Counter(), Counter(), Counter()
    for t in train:
        ws = [*t.split(), "\n"]
        uni.update(ws), pairs.update(zip(["\n", *ws], ws)), triples.update(zip(["\n", *ws], ws, ws[1:]))
    n, v, out = sum(uni.values()), len(uni), 0.0
    for i, w in enumerate(words):
        a = words[i - 1] if i else "\n"
        q = (uni[w] + 1) / (n + v + 1)
        q = (pairs[a, w] + backoff.PAIR_WEIGHT * q) / (uni[a] + backoff.PAIR_WEIGHT)
        if i:
            u = words[i - 2] if i > 1 else "\n"
            q = (triples[u, a, w] + backoff.TRIPLE_WEIGHT * q) / (pairs[u, a] + backoff.TRIPLE_WEIGHT)
        out += math.log10(q)
    return out


def test_the_third_word_and_each_failure_count():
    train = ["the red house is big", "a red car is fast", "the red house is old"] * 3
    texts = ["the red house", "a red house", "the blue house", "zzz yyy house"]
    block, model = model_of([*train, *texts], [False] * len(train) + [True] * len(texts))
    scores = model.run()[len(train) :]
    assert scores[0] > scores[1] > scores[3]  # `house` after `the red`, after `a red` by one failure, after nothing known by two
    model.seen[2][:] = False
    assert (model.run()[len(train) :][:2] != scores[:2]).any()


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (packing.unpack_sorted(packing.pack_sorted(keys)) == keys).all()
        assert (packing.unpack(packing.pack(keys)) == keys).all()
