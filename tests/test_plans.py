"""Relational plans: agreement with the kernel, overlaps against the kernel's, plan shapes, oracle queries at the smallest scale."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wardlight.functions import evade, texts
from wardlight.operators import kernel, moderation
from wardlight.plans import queries, relational, reports
from wardlight.sources import lexicon
from wardlight.sources.lexicon import Entry, Options

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "conversations", "events", "lineitem")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(cell, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(map(cell, r)) for r in rel.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall()), key=repr)
    assert sorted((tuple(map(cell, r)) for r in df.select(*names).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_resolve_agrees_with_the_kernel(spark):
    rng = random.Random(5)
    tiers = {0: "skeleton", 2: "exact"}
    rows = []
    for k in range(300):
        spans = [(s := rng.randrange(12), s + rng.randrange(1, 6), rng.choice((0, 2)), rng.randrange(5), o) for o in range(rng.randrange(1, 8))]
        rows.append((k, spans))
    df = spark.createDataFrame(rows, f"k int, c array<{relational.SPAN}>")
    for r in df.select("k", relational.resolve(F.col("c")).alias("kept")).collect():
        found = [kernel.Found(s, e, tiers[rank], Entry("x", str(o), v)) for s, e, rank, v, o in rows[r.k][1]]
        assert [(x.s, x.e, x.v) for x in r.kept] == [(c.start, c.end, c.entry.severity) for c in kernel.resolve(found)]


def test_hidden_words_are_found(spark):
    words = spark.createDataFrame([("thing",), ("erble",)], "w string")
    results = reports.flagged(reports.cases(words), "all", Options()).collect()
    assert len(evade.LATIN) == 61 and {r.axis for r in results} == set(evade.LATIN) - {"repeat.twin", "split.short", "split.three_chunks"}
    missed = {r.axis for r in results if not r.hit}
    assert not missed & {"look.digit_first", "look.cyrillic_all", "look.wide", "insert.zero_width", "insert.picture", "repeat.vowel", "mask.one", "split.spaces", "split.lines", "case.alternating", "context.longer"}
    unique = reports.unique_cases(reports.cases(words))
    assert unique.groupBy("hidden").count().where("count > 1").count() == 0


def plain_ways(w):
    """Some of the ways, written out."""
    first = next((k for k, c in enumerate(w) if c in "aeiou"), None)
    return {
        "mask.two": f"{w[0]}**{w[3:]}" if len(w) >= 4 else None,
        "insert.two_dots": f"{w[0]}.{w[1:3]}.{w[3:]}" if len(w) >= 5 else None,
        "repeat.vowel": None if first is None else w[:first] + 5 * w[first] + w[first + 1 :],
        "repeat.twin": next((w[:k] + 4 * w[k] + w[k + 1 :] for k in range(1, len(w)) if w[k] == w[k - 1]), None),
        "split.three_chunks": f"{w[:2]} {w[2:4]} {w[4:]}" if len(w) >= 6 else None,
        "case.alternating": "".join(c.upper() if k % 2 else c for k, c in enumerate(w)),
        "sound.no_vowels": (lambda x: x if 3 <= len(x) < len(w) else None)("".join(c for c in w if c not in "aeiou")),
        "look.cyrillic_vowel": next((w[:k] + dict(zip(*evade.CYRILLIC))[c] + w[k + 1 :] for k, c in enumerate(w) if c in "aeiou" and c in evade.CYRILLIC[0]), None),
        "context.longer": f"#{w[0].upper()}{w[1:]}This",
    }


def test_ways_of_hiding(spark):
    words = ["thing", "bookkeeper", "rhythm", "ab", "glass", "cyclic", "xyz", "uiui", "pffft"]
    made = reports.cases(spark.createDataFrame([(w,) for w in words], "w string")).collect()
    got = {(r.w, r.axis): r.hidden for r in made}
    for w in words:
        for way, want in plain_ways(w).items():
            assert got.get((w, way)) == want, (w, way)


def test_expansion_counts(spark):
    words = spark.createDataFrame([("en", 1, "ab"), ("en", 2, "abcdef"), ("de", 1, "xyz")], "suite string, place int, w string")
    cases = reports.expand(words).collect()
    assert len({(r.suite, r.hidden) for r in cases}) == len(cases)
    by = {(r.suite, r.axis): r.w for r in cases if r.kind == "generated"}
    assert by["en", "mask.one"] == "abcdef" and by["en", "case.upper"] == "ab" and ("de", "mask.one") not in by
    counts = {r.suite: r for r in reports.composition(words).collect()}
    assert counts["en"].control == 2 and counts["en"].total == sum(r.suite == "en" for r in cases) and "mask.one" in counts["de"].inapplicable and "repeat.twin" in counts["en"].inapplicable


def test_origins_and_repeats(spark):
    heads = spark.createDataFrame([("try",), ("tries",), ("make",), ("box",), ("go",)], "w string")
    made = {r.w for r in reports.inflections(heads).collect()}
    assert {"trying", "tried", "maker", "making", "boxes", "boxed"} <= made and "tries" not in made and "gos" not in made
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("a", "x")], "text string, source string")
    assert [(r.text, r.times, r.places) for r in reports.repeated(df).collect()] == [("a", 3, ["x", "y"])]


def test_dictionary_side_is_broadcast(spark):
    for name in ("token_hits", "prefix_hits", "collapsed_hits", "masked_hits"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan, name


def test_scan_reads_the_columns_it_needs(spark):
    plan = queries.QUERIES["token_hits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("n, k", [(1000, 4), (7, 3), (3, 10), (0, 2)])
def test_evenly_spaced_sample(spark, n, k):
    df = spark.range(n).union(spark.range(n)).repartition(5)
    got = sorted(r.id for r in reports.sample_evenly(df, "id", k).collect())
    assert got == (list(range(n)) if n <= k else [i * n // k for i in range(k)])


def test_languages(spark):
    rows = {r.language: r for r in lexicon.list_languages(lexicon.to_frame(spark)).collect()}
    assert rows["hi"].lemma_count == 2 and rows["hi"].scripts == ["Deva"] and rows["en"].load_order == 0


def test_folds_of_every_word(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abehiopxzé0134579@!|$-.,'’ñ̈🔥мङ") for _ in range(rng.randrange(1, 9))) for _ in range(600)] + ["phooone", "s3lf-made", "don't", "café,", "4x4", "aaa!!!"]
    spark.createDataFrame([(k, w, "en", "x") for k, w in enumerate([*words, *words[:50]])], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    folds = {
        "fold_pairs": lambda w: texts.run(texts.PAIRS, w),
        "fold_singles": lambda w: texts.run(texts.SINGLES, w),
        "fold_marks": lambda w: texts.run(texts.MARKS, re.sub("([aeiou])", "\\1\u0308", w)),
        "fold_leet": lambda w: texts.run([texts.Leet()], w.translate(str.maketrans("eio", "310"))),
    }
    many = Counter([*words, *words[:50]])
    for name, fold in folds.items():
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert {(r.token, r.folded, r.n) for r in rows} == {(w, fold(w), n) for w, n in many.items()} and len(rows) == len(many), name


def test_keep_first_of_given_spans(spark):
    rng = random.Random(8)
    pieces = ["thing", "Thing", "things", "éthing", "thingé", "_thing", "thing2", "“thing”", "naïve", "🔥", "🔥thing🔥", "ङthing", "thing\u0308", "a", " ", " ", ", ", "\n"]
    rows = [(k, None if k == 7 else "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))), rng.choice(["en", "de", "fr", "es", None]), "x") for k in range(300)]
    found = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("text", F.lower("text"))
    letter = lambda c: c == "_" or unicodedata.category(c)[0] in "LMN"
    want = {}
    for k, text, _, _ in rows:
        out = low = (text or "").lower()
        for i in range(len(low) - 4):
            if low[i : i + 5] == "thing" and not letter(low[i - 1 : i] or " ") and not letter(low[i + 5 : i + 6] or " "):
                out = out[: i + 1] + "****" + out[i + 5 :]
        if out != low:
            want[k] = out
    whole = r"(?<![\p{L}\p{M}\p{N}_])thing(?![\p{L}\p{M}\p{N}_])"
    at = relational.spans(found, "text", whole).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    got = found.join(at, "doc_id").select("doc_id", moderation.censor_spans("text", "spans", "*", True).alias("censored")).collect()
    assert {r.doc_id: r.censored for r in got} == want and len(got) == len(want) > 50


def test_hidden_hits_of_every_term(spark, tmp_path):
    exact = queries.DEFAULT.exact
    terms = sorted(f for f in exact if re.fullmatch("[a-z]{5,8}", f) and not re.search(r"(.)\1", f))
    assert "thing" in terms and len(terms) > 3
    hide = {"spelled_hits": ".".join, "chunked_hits": lambda f: f"{f[:3]}-{f[3:]}", "collapsed_hits": lambda f: f[:2] + f[2] * 3 + f[3:]}
    for name, hidden in hide.items():
        rows = [(k, f"so , {hidden(f)} , and {hidden(f)} ; plain", "en", "x") for k, f in enumerate(terms)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = queries.QUERIES[name](spark, str(tmp_path / name)).collect()
        by = ["doc_id", "lemma", *(["language"] if "language" in got[0] else [])]
        want = Counter()
        for k, f in enumerate(terms):
            for e in dict.fromkeys(exact[f]):
                want[(k, e.lemma, e.language)[: len(by)]] += 2
        assert {tuple(r[c] for c in by): r.n for r in got} == want, name


def test_small_files_are_dealt_to_all_cores(spark):
    from wardlight.sources import tables

    found = tables.read(spark, SF, "documents")
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism > 1 and found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert tables.spread(found).rdd.getNumPartitions() == found.rdd.getNumPartitions()


def test_reports_equal_the_kernel(spark):
    """Scorecard, misses and isolation, counted text by text with the scanner."""
    options = Options()
    words = ["thing", "erble", "frobnicate", "keit", "tion"]
    made = reports.cases(spark.createDataFrame([(w,) for w in words], "w string"))
    rows = made.collect()
    hit = {r.hidden: kernel.scanner(options).any(r.hidden) for r in rows}
    card = {r.axis: (r.caught, r.cases) for r in reports.scorecard(reports.flagged(made, "all", options)).collect()}
    want = {}
    for r in rows:
        caught, cases = want.get(r.axis, (0, 0))
        want[r.axis] = caught + hit[r.hidden], cases + 1
    assert card == want
    missed = {r.axis: (r.missed, r.words, r.cases) for r in reports.misses(reports.flagged(made, "all", options)).collect()}
    assert missed == {a: (n - c, sorted(x.w for x in rows if x.axis == a and not hit[x.hidden]), n) for a, (c, n) in want.items() if c < n}
    alone = {r.library: (r.caught, r.cases) for r in reports.isolation(made, options).collect()}
    packs = {"all": options} | {p.language: Options(packs=(p,)) for p in options.packs}
    assert alone == {k: (sum(kernel.scanner(o).any(r.hidden) for r in rows), len(rows)) for k, o in packs.items()}


def test_even_sample_of_more_values_than_a_sample_of_the_order_sees(spark):
    # ranges that are drawn anew for each reading of the values would move the places
    words = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("w")).unionByName(spark.range(5).select(F.lit(None).cast("string").alias("w"))).repartition(6)
    want = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(60_000))
    for k in (7, 40):
        assert sorted(r.w for r in reports.sample_evenly(words, "w", k).collect()) == [want[i * 60_000 // k] for i in range(k)]
