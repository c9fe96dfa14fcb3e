"""The recurrent network against a plain one that reads a position at a time, and pieces against whole texts."""

import math
import random
from dataclasses import replace

import numpy as np

from wardlight.llm import langid


def plain_states(net, d, raw):
    """The gated unit by its formulas, one byte and one unit at a time."""
    h, p = net.hidden, {k: v.astype(float).tolist() for k, v in net.p.items()}
    hard, clip = (lambda x: min(1.0, max(0.0, 0.25 * x + 0.5))), (lambda x: min(1.0, max(-1.0, x)))
    state, out = [0.0] * h, {}
    for t in range(len(raw)) if d == "f" else range(len(raw) - 1, -1, -1):
        x = p["E" + d][raw[t]]
        gate = [hard(x[i] + sum(p["W" + d][i][j] * state[j] for j in range(h))) for i in range(2 * h)]
        z, r = gate[:h], gate[h:]
        cand = [clip(x[2 * h + i] + sum(p["C" + d][i][j] * r[j] * state[j] for j in range(h))) for i in range(h)]
        state = [s + g * (c - s) for s, g, c in zip(state, z, cand, strict=True)]
        out[t] = state
    return [out[t] for t in range(len(raw))]


def plain_positions(net, raw):
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    found = []
    for f, b in zip(plain_states(net, "f", raw), plain_states(net, "b", raw), strict=True):
        logits = [p["bias"][k][0] + sum(w * s for w, s in zip(p["out"][k], [*f, *b], strict=True)) for k in range(len(net.labels))]
        top = max(logits)
        each = [math.exp(x - top) for x in logits]
        found.append([e / sum(each) for e in each])
    return found


def test_positions_and_documents_as_a_plain_network_has_them():
    settings = langid.Settings(hidden=4, piece=11, overlap=3)
    net, rng = langid.Network(["a", "b", "c"], settings), random.Random(4)
    texts = ["x", "straße über où", "a" * 11, "".join(rng.choice("abcé ü") for _ in range(57)), ""]
    got = langid.predict_bytes(net, [t.encode() for t in texts], settings)
    for text, pooled in zip(texts, got, strict=True):
        raw, held = text.encode(), []
        for at in range(0, len(raw), settings.piece):
            a, b = max(0, at - settings.overlap), min(len(raw), at + settings.piece + settings.overlap)
            held += plain_positions(net, raw[a:b])[at - a : at - a + min(settings.piece, len(raw) - at)]
        want = np.mean(held, axis=0) if held else np.zeros(3)
        assert np.allclose(pooled, want, atol=1e-5)
        assert langid.label_positions(net, text, settings) == [net.labels[int(np.argmax(x))] for x in held]


def test_pieces_judge_as_whole_texts_do():
    """What a state restarted at pieces costs: against one state over the whole text, nothing here."""
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["zürich", "straße", "über", "schön"], "z": ["où", "façade", "élève", "garçon"]}
    rng, settings = random.Random(2), langid.Settings(steps=80, train_piece=32, batch=64)
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    pieces = [(text(k, 40).encode()[:32], i) for i, k in enumerate("xyz") for _ in range(60)]
    data = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8).reshape(-1, 32)
    net = langid.train(data, np.array([t for _, t in pieces]), list("xyz"), settings)
    texts, truth = zip(*[(text(k, n).encode(), i) for i, k in enumerate("xyz") for n in (30, 90, 400)], strict=True)
    cut = langid.predict_bytes(net, texts, settings).argmax(axis=1)
    whole = langid.predict_bytes(net, texts, replace(settings, piece=1 << 13)).argmax(axis=1)
    assert cut.tolist() == whole.tolist() == list(truth)
