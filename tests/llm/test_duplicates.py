"""The Jaccard join and the suffix deduplication against brute force, and the pipeline's stages."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wardlight.llm import exchange, graph, jaccard, packing, suffixes


def shingles(text, size=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_components(rows, size=3, percent=90):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    return Counter((d, len(s), lowest.get(find(i), None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def family_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 120))]
        for _ in range(rng.randrange(3, 25)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(copy[: len(copy) - rng.randrange(0, 4)]))
    chain = [f"c{i}" for i in range(80)]
    rows += [" ".join(chain[k : k + 60]) for k in range(0, 20)]  # each links with its neighbours only
    rows += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    rows += [None, "", " ", "One", "one", "ONE two", "one two", "É", "é"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[4]), (None, "alone here now")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed, monkeypatch):
    size, percent = (5, 80) if seed == 3 else (3, 90)
    if seed == 2:
        monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)  # all by the last, exhaustive round, in many cells
        monkeypatch.setattr(jaccard, "CELL", 3)
        monkeypatch.setattr(jaccard, "LEAST_RANGES", 30)
        monkeypatch.setattr(exchange, "FAN", 4)
    rows = family_rows(seed)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string").repartition(3)
    found = jaccard.near_duplicates(df, percent=percent, size=size, block_bytes=4000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(rows, size, percent)


def test_rows_of_an_exchange_follow_the_blocks():
    """However many ranges there are, a block sends at most FAN rows at a hop, and hops grow with their logarithm."""
    rng = np.random.default_rng(2)
    for ranges in (1, 7, 100, 1000, 10**6, 10**9):
        hops = exchange.fans(ranges, 16)
        assert np.prod([float(h) for h in hops]) >= ranges and max(hops) <= 16 and len(hops) <= 1 + np.log(ranges) / np.log(16)
        keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
        rows = exchange.rows_of("b", keys, None, np.ones(len(keys), np.uint64), hops[0])
        assert len(rows) <= hops[0] and sum(len(packing.unpack_sorted(r[2])) for r in rows) == len(keys)


@pytest.mark.parametrize("fan, ranges", [(128, 1), (128, 9), (3, 20), (2, 30)])
def test_totals_of_blocks(spark, monkeypatch, fan, ranges):
    """Sums, shared keys and owners are right whatever the number of hops, checks told apart."""
    monkeypatch.setattr(exchange, "FAN", fan)
    rng, hops = random.Random(fan + ranges), exchange.fans(ranges)
    pool = [(rng.randrange(1 << 64), check) for _ in range(60) for check in (1, 2)]
    blocks, rows = {}, []
    for b in range(9):
        own = sorted(rng.sample(pool, 40))
        blocks[str(b)] = {k: rng.randrange(1, 9) for k in own}
        keys, checks = (np.array([k[i] for k in own], np.uint64) for i in range(2))
        rows += exchange.rows_of(str(b), keys, checks, np.array([blocks[str(b)][k] for k in own], np.uint64), hops[0])
    asked = spark.createDataFrame(rows, exchange.ASKED).repartition(3)
    got = exchange.totals(asked, hops, len(blocks)).toPandas()
    sums, having, owners = Counter(), Counter(), Counter()
    for own in blocks.values():
        sums.update(own)
        having.update(own.keys())
    for b, own in blocks.items():
        part = got[got.block == b].sort_values("part")
        answer = np.concatenate([packing.unpack(a) for a in part.answer])
        for key, a in zip(sorted(own), answer):
            assert int(exchange.value(a)) == sums[key] and bool(exchange.several(a)) == (having[key] > 1)
            owners[key] += bool(exchange.owner(a))
    assert set(owners.values()) == {1}


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0


def test_matches_rise_with_cost():
    rare, frequent = np.ones(200, np.int64) * 2, np.sort(np.r_[np.ones(10, np.int64) * 500, np.ones(190, np.int64) * 600])
    assert jaccard.choose_matches(rare, 200) >= 1 and jaccard.overlap_needed(200) == 180
    assert 1 <= jaccard.choose_matches(frequent, 200) <= jaccard.MOST_MATCHES


def test_components_of_a_path_and_a_star(spark):
    links = [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("s00", f"s{i:02}") for i in range(1, 9)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**{f"p{i:02}": "p00" for i in range(31)}, **{f"s{i:02}": "s00" for i in range(9)}}


def test_components_of_a_long_chain_of_random_names(spark):
    names = [f"{i:04}" for i in range(1000)]
    random.Random(7).shuffle(names)
    links = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    assert {r.node: r.label for r in graph.components(links).collect()} == dict.fromkeys(names, "0000")


def plain_removed(texts, length):
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                mark[i : i + length] = True
        out.append(mark)
    return out


def merged(groups, length, gram, forget=""):
    shards = [suffixes.Shard.load(suffixes.Shard.of(g, length, gram).dump(), length, gram) for g in groups]
    answers, most, kinds = [{} for _ in shards], max(s.most_touched() for s in shards), []
    while suffixes.STEP ** len(kinds) <= most:
        kinds.append(f"x{suffixes.STEP ** len(kinds)}")
    for kind in [*kinds, "c", "u", "w"]:
        sent = [s.sends(kind, a, lambda g=g: g) for s, a, g in zip(shards, answers, groups)]
        first, at, _, _, sums = exchange.distinct(*map(np.concatenate, zip(*sent)))
        if kind[0] == "x":
            sums = np.where(sums > (1 << 62 if kind == forget else 1), np.arange(1, len(sums) + 1, dtype=np.uint64), np.uint64(0))
        answer, place = (sums[at] << np.uint64(2)) | exchange.flags(first, at), 0
        for (keys, _, _), a in zip(sent, answers):
            a[kind] = answer[place : place + len(keys)]
            place += len(keys)
    return [s.removed(a, g) for s, a, g in zip(shards, answers, groups)]


@pytest.mark.parametrize("seed", range(40))
def test_merge_of_shards(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(suffixes, "CHUNK", rng.choice([1 << 19, 50, 97]))
    length, gram = rng.choice([24, 40]), rng.choice([4, 8])
    alphabet = rng.choice([b"ab", b"abcdefgh", bytes(range(65, 90))])
    noise = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    base = [noise(rng.randrange(10, 200)) for _ in range(4)]
    part = lambda b: b[rng.randrange(len(b)) :][: rng.randrange(80)]
    texts = [b"".join(rng.choice([rng.choice(base), noise(rng.randrange(60)), part(rng.choice(base)), b"xy" * rng.randrange(40)]) for _ in range(rng.randrange(6))) for _ in range(12)]
    texts += texts[:2]
    groups = [texts[:5], texts[5:9], texts[9:]]
    got = [r.get(i, np.zeros(len(t), bool)) for r, g in zip(merged(groups, length, gram), groups) for i, t in enumerate(g)]
    assert all((a == b).all() for a, b in zip(got, plain_removed(texts, length)))


def several_lengths(groups, lengths, gram):
    made = [suffixes.Shard.of(g, lengths[0], gram, lengths[1:]) for g in groups]
    shards = [suffixes.Shard.load(s.dump(), lengths[0], gram, lengths[1:]) for s in made]
    answers, most, kinds = [{} for _ in shards], max(s.most_touched() for s in made), []
    while suffixes.STEP ** len(kinds) <= most:
        kinds.append(f"x{suffixes.STEP ** len(kinds)}")
    for kind in [*kinds, "c", "u", "w"]:
        sent = [s.sends(kind, a, lambda g=g: g) for s, a, g in zip(shards, answers, groups)]
        first, at, _, _, sums = exchange.distinct(*map(np.concatenate, zip(*sent)))
        if kind[0] == "x":
            sums = np.where(sums > 1, np.arange(1, len(sums) + 1, dtype=np.uint64), np.uint64(0))
        answer = np.split((sums[at] << np.uint64(2)) | exchange.flags(first, at), np.cumsum([len(keys) for keys, _, _ in sent])[:-1])
        for a, own in zip(answers, answer):
            a[kind] = own
    return [s.spans(a, g) for s, a, g in zip(shards, answers, groups)]


def runs(mark):
    edges = np.flatnonzero(np.diff(mark.astype(int), prepend=0, append=0)).tolist()
    return list(zip(edges[::2], edges[1::2]))


@pytest.mark.parametrize("seed", range(40))
def test_several_lengths_in_one_merge(seed, monkeypatch):
    rng = random.Random(1000 + seed)
    monkeypatch.setattr(suffixes, "CHUNK", rng.choice([1 << 19, 50, 97]))
    gram, lengths = rng.choice([4, 8]), rng.choice([(24, 40), (24, 25), (24, 24), (32, 60, 200)])
    alphabet = rng.choice([b"ab", b"abcdefgh", bytes(range(65, 90))])
    noise = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    base = [noise(rng.randrange(10, 250)) for _ in range(4)]
    part = lambda b: b[rng.randrange(len(b)) :][: rng.randrange(80)]
    texts = [b"".join(rng.choice([rng.choice(base), noise(rng.randrange(60)), part(rng.choice(base)), b"xy" * rng.randrange(40)]) for _ in range(rng.randrange(6))) for _ in range(12)]
    texts += texts[:2] + [b""]
    groups = [texts[:5], texts[5:9], texts[9:]]
    found = several_lengths(groups, lengths, gram)
    for k, length in enumerate(lengths):
        got = [spans[k].get(i, []) for spans, g in zip(found, groups) for i in range(len(g))]
        assert got == [runs(mark) for mark in plain_removed(texts, length)]


def test_transform_and_order():
    """The shard's order is that of its whole suffixes, common their common prefixes, and back steps to the symbol before."""
    shard = suffixes.Shard.of([b"abcabcabdabc" * 30, b"xyzabcabcabd" * 30, b"abcabcabdabc" * 30], 24, 4)
    number = exchange.distinct(*shard.keys, np.zeros(len(shard.order), np.uint64))[1]
    suffix = [tuple(number[i : shard.last[i] + 1]) for i in range(len(number))]
    ordered = [suffix[i] for i in shard.order]
    assert ordered == sorted(ordered)
    for place, i in enumerate(shard.order):
        starts = i == 0 or shard.last[i - 1] != shard.last[i]
        assert (shard.back[place] == -1) == starts and (starts or shard.order[shard.back[place]] == i - 1)
        if place:
            a, b = ordered[place - 1], ordered[place]
            assert shard.common[place] == (suffixes.WHOLE if a == b else next(k for k in range(len(b)) if a[k : k + 1] != b[k : k + 1]))


def test_nothing_is_found_without_the_merge():
    """Forgetting the blocks of a level loses repeats: windows are found by blocks alone."""
    rng = random.Random(3)
    noise = lambda n: bytes(rng.choice(b"abcdefghij ") for _ in range(n))
    passage = noise(900)
    groups = [[noise(300) + passage + noise(200), noise(500)], [noise(350) + passage[100:700]]]
    whole, want = merged(groups, 400, 32), plain_removed([t for g in groups for t in g], 400)
    assert [whole[0][0].sum(), whole[1][0].sum()] == [want[0].sum(), want[2].sum()] == [600, 600]
    assert merged(groups, 400, 32, "x1") == [{}, {}]
    assert sum(m.sum() for found in merged(groups, 400, 32, "x4") for m in found.values()) < 1200


@pytest.mark.parametrize("fan", [128, 3])
def test_dedup_digest(spark, monkeypatch, fan):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdéß ") for _ in range(rng.randrange(1, 9)))
    passage = "".join(word() for _ in range(150))
    texts = [None, "", "x" * 399, "x" * 400, "y" * 401, passage, "a" + passage[:450] + "b", word() * 300]
    texts += ["".join(word() for _ in range(200)) for _ in range(10)] + [passage + "".join(word() for _ in range(50)) + passage]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "twin " + texts[9]), (None, "twin " + texts[9])]
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(suffixes, "LEAST_RANGES", 9)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), r, mark in zip(rows, raw, plain_removed(raw, 400)):
        spans = int(np.count_nonzero(np.diff(mark.astype(int), prepend=0) == 1))
        want[d, len(r), int(mark.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~mark].tobytes()).hexdigest()] += 1
    found = suffixes.dedup_digest(df, shard_bytes=3000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want
    assert suffixes.dedup_digest(df.limit(0)).count() == 0
    clean = {r.doc_id: r for r in suffixes.remove_repeats(df.where("doc_id is not null"), shard_bytes=3000).collect()}
    assert clean[4].clean_text == "" and [(s.start, s.end) for s in clean[4].spans] == [(0, 401)] and clean[1].clean_text == ""


def test_passages_of_over_50_words(spark):
    """A passage of 51 words and 300 bytes in two documents is shown, and stays, as no 400 bytes repeat; as brute force at both lengths."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    words = lambda n: " ".join(word(rng.randrange(2, 9)) for _ in range(n))
    passage, long = " ".join([word(5) for _ in range(50)] + [""]) + "x", words(120)
    assert len(passage.split()) == 51 and len(passage) == 301
    texts = [f"{words(80)} {passage} {words(80)}", f"{passage} {words(200)}", words(300), f"{words(30)} {long}", f"{long} {words(9)} {passage[:255]}", "x" * 256, "y" * 257, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in suffixes.dedup_digest(df, shard_bytes=2000).collect()}
    raw = [(t or "").encode() for t in texts]
    for d, mark, passages in zip(range(len(raw)), plain_removed(raw, 400), plain_removed(raw, 256)):
        r = found[d]
        assert (r.n_removed, [(x.start, x.end) for x in r.spans]) == (mark.sum(), runs(mark))
        assert (r.n_passage_bytes, [(x.start, x.end) for x in r.passages]) == (passages.sum(), runs(passages))
        assert r.clean_text.encode() == np.frombuffer(raw[d], np.uint8)[~mark].tobytes()
    assert [found[d].n_removed > 0 for d in range(8)] == [False, False, False, True, True, False, False, False]
    assert [found[d].n_passage_bytes >= 300 for d in range(5)] == [True, True, False, True, True]
    with pytest.raises(ValueError, match="passages"):
        suffixes.dedup_digest(df, length=200, passage=256)
    assert {r.doc_id: r.n_passage_bytes for r in suffixes.dedup_digest(df, length=200).collect()} == {d: m.sum() for d, m in enumerate(plain_removed(raw, 200))}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = {"en": ["the", "house", "is", "green", "water"], "de": ["straße", "über", "schön", "grün", "haus"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(f"{rng.choice(words[lang])}{rng.choice('abcdefgh')}" for _ in range(rng.randrange(30, 120))), lang if i % 5 else None, f"s{i % 3}", 0))
    rows += [(900 + k, rows[k][1], "en", "s0", 0) for k in range(5)] + [(950, None, None, None, None), (951, "123 456", "en", "s1", 0)]
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(90))
    rows = [(d, f"{t} {passage}" if 20 <= d < 23 else t, *r) for d, t, *r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, states = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        states.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    langs, near, cut, mixed, ids = states
    assert {r.doc_id for r in langs} == {d for d, *_ in rows} - {950, 951} and all(r.lang for r in langs)
    components = {d: c for d, _, c in plain_components([(r.doc_id, r.text) for r in langs], 5, 80)}
    assert {r.doc_id for r in near} == {d for d, c in components.items() if d == c}
    raw = [r.text.encode() for r in near]
    left = {r.doc_id: np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for r, b, m in zip(near, raw, plain_removed(raw, corpus_pipeline.REPEAT_BYTES))}
    assert {r.doc_id: r.text for r in cut} == {d: t for d, t in left.items() if t.split()}
    assert set(mixed) <= set(cut) and len(ids) == len(mixed) and all(len(r.ids) == r.n_tokens for r in ids)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.decoded_sha256) for r in ids) == Counter((r.doc_id, digest(r.text)) for r in mixed)
    copies, weights = Counter((r.doc_id, r.text) for r in mixed), Counter()
    for r in mixed:
        weights[r.source] += len(r.text)
    assert set(weights) == {r.source for r in cut} and len(copies) < len(mixed)
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_pipeline_near_duplicates_of_equal_ids(spark):
    """Ids that repeat with different texts are different documents; one row of each component stays."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (2, c), (None, b), (None, c), (3, a + " end"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == Counter([(1, a), (1, b), (2, c), (4, None), (5, "")])


def test_intermediate_tables_go_and_a_cluster_needs_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from wardlight.llm import common

    unset = SimpleNamespace(get=lambda k, d=None: None, set=lambda k, v: None)
    for master, fine in (("local[4]", True), ("local", True), ("yarn", False), ("spark://x:7077", False), ("local-cluster[2,1,1024]", False)):
        session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
        if fine:
            assert common.shared_dir(session).startswith("file:")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                common.shared_dir(session)
    import os

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = suffixes.dedup_digest(spark.createDataFrame([(1, "x" * 900), (2, "y")], "doc_id long, text string"))
    assert found.count() == 2 and len(set(os.listdir(folder)) - before) == 1  # the result
    assert not spark.sql(f"SHOW TABLES IN {common.DATABASE}").collect()
