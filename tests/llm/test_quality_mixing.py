"""Quality rules and mixing against plain definitions; URL rules and the template tree on small cases."""

import math
import random
import re
from collections import Counter

import pytest

from wardlight.llm import mixing, quality, urls

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(4)
    made = [None, "", " ", "a", "a b c", "a a a a", "x\x0b\x0cy\r\nz\n\n", "é\u00a0é #| <>"]
    for n in (3, 10, 60, 200, 900):
        for alphabet in (3, 30, 3000):
            made.append("".join(f"w{rng.randrange(alphabet)}" + rng.choice([" ", "  ", "\n", ". ", "\t"]) for _ in range(n)))
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    nav = " | ".join(f"item{i}" for i in range(80))
    noise = " ".join(f"w{i}###" for i in range(80))
    return [*made, prose, nav, noise, prose + "\n" + nav, prose * 3, prose + "\nAll rights reserved.", "line one here.\n" * 40]


def test_quality_counts(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(rows)] + [(None, rows[-1], 1)] * 2, "doc_id long, text string, n_words int")
    found = quality.quality_report(df).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        text = rows[r.doc_id] if r.doc_id is not None else rows[-1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text), text
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in found}
    n = len(rows)
    assert [kept[i] for i in range(n - 7, n)] == [True, False, False, False, False, True, False]


def test_clean_lines(spark):
    df = spark.createDataFrame([(1, "Good line.\nHome | About | Help | Terms\n\nAll rights reserved.\nAnother good one!"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.clean_lines(df).collect()}
    assert rows[1].clean_text == "Good line.\n\nAnother good one!" and (rows[1].line_words, rows[1].lost_words) == (15, 10)
    assert rows[2].clean_text is None and rows[2].lost_words == 0
    assert quality.quality_report(df.limit(0)).count() == 0


def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


@pytest.mark.parametrize("few", [True, False])
def test_mixing_counts(spark, few):
    import hashlib

    rows = [(i, "x" * (10 + i % 7), ["a", "b", None, "c"][i % 4 if i % 3 else 0]) for i in range(400)] + [(7, None, "b"), (7, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as copy_no", "'s' as mean")
    weights = {"a": 0.5, "b": 30.0}
    found = mixing.poisson_mix(df, weights, seed=3, broadcast_sources=100 if few else 0).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source or ""] += len(text or "")
    share = sum(weights.get(s, 1.0) for s in sizes)
    counts = Counter(r.doc_id for r in found)
    for doc, text, source in set(rows):
        if doc == 7:
            continue
        digest = hashlib.md5((text or "").encode()).hexdigest()
        rate = weights.get(source or "", 1.0) / share * sum(sizes.values()) / sizes[source or ""]
        draws = max(1, math.ceil(rate / mixing.MEAN_AT_ONCE))
        want = sum(poisson(rate / draws, int(hashlib.md5(f"3|{doc}|{digest}|{j}".encode()).hexdigest()[:13], 16) / 2**52) for j in range(1, draws + 1))
        assert counts[doc] == want
    assert {r.copy_no for r in found if r.doc_id == max(counts, key=counts.get)} >= {1, 2}
    assert len({r.shuffle_key for r in found}) > 0.9 * len(found)


def test_mixing_draws_by_text_too(spark):
    rows = [(None, f"text {i} " * 30, "a" if i % 2 else "b") for i in range(300)] + [(7, f"words {i}" * 90, "a") for i in range(100)] + [(8, "x" * 900_000, "b")]
    found = mixing.poisson_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {}).collect()
    copies = Counter(r.text for r in found)
    assert 2 < len({copies[t] for _, t, _ in rows[:300]}) and 1 < len({copies[t] for _, t, _ in rows[300:400]})


def test_clean_lines_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "Fine line here.\n| » | » |\nMore text.", 5, "x", True)], "k int, text string, lost_words int, line_stats_ string, passed_ boolean")
    row = quality.clean_lines(df).first()
    assert (row.k, row.line_stats_, row.passed_, row.clean_text) == (1, "x", True, "Fine line here.\nMore text.") and row.lost_words == 5 and row.line_words == 10
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "Impressum\n" * 50_000)], "doc_id int, text string")
    found = {r.doc_id: r for r in quality.quality_report(long).collect()}
    assert found[1].n_words == 300_000 and not found[1].kept and not found[2].kept and found[2].clean_text == "\n" * 0


def test_mixing_empty_and_blank(spark):
    df = spark.createDataFrame([(1, "", "a"), (None, None, None)], "doc_id long, text string, source string")
    assert mixing.poisson_mix(df, {}).count() == 0 and mixing.poisson_mix(df.limit(0), {}).count() == 0


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "nothing": ("", "", None), "http://A.Example.ORG/es/1?q#f": ("a.example.org", "/es/1", "example.org/es/"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"), "http://example.org/en/2": ("example.org", "/en/2", "org/"), "http://badexample.org/es/1": ("badexample.org", "/es/1", "org/"),
        "x://y.com/de/": ("y.com", "/de/", "com/de/"), "http://org": ("org", "", None), "a://b://c.com/fr/": ("b:", "//c.com/fr/", None), "http://t.com?x=/de/": ("t.com", "", None), "http://É.com/fr/é": ("É.com", "/fr/é", "com/fr/"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] + [(None, "x://y.com/de/", None)] * 2, "page_id long, url string, host string")
    found = urls.judge(df, RULES).collect()
    assert len(found) == len(cases) + 2
    for r in found:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == list(cases.values())[r.page_id]
        if r.rule:
            assert r.verdict == {w: v for v, w in RULES}[r.rule]
        assert r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_template_tree(spark):
    """Pages with rare last segments share a template; a branch of blocked labels is rejected, its sibling isn't."""
    rows = [(i, f"http://h.net/bad/item{i}/x", 1 if i % 2 else None) for i in range(60)] + [(100 + i, f"http://h.net/good/item{i}/x", 0 if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, mark int")
    for limits in (urls.TreeLimits(), urls.TreeLimits(broadcast_bytes=-1)):
        found = {r.page_id: r for r in urls.judge(df, [], label=df.mark, limits=limits).collect()}
        assert len(found) == 120
        assert all((r.verdict == "block") == (p < 100) for p, r in found.items())
        assert len({r.template for r in found.values()}) == 2


def test_templates_decide_on_other_hosts(spark):
    """A host without labels is judged by what its templates mean elsewhere, at any depth, and by wildcards alone."""
    rows = [(i, f"http://h{i % 3}.net/en/shop/item{i}x/deals", 1) for i in range(120)] + [(120 + i, f"http://h{i % 3}.net/en/shop/item{i}x/about", 0) for i in range(120)]
    rows += [(300 + i, f"http://new.net/en/shop/thing{i}x/{w}", None) for i, w in enumerate(["deals", "about"] * 30)]
    deep = "/".join(["a"] * 400)
    rows += [(500, f"http://new.net/{deep}", None), (501, "http://new.net/" + "b" * 200_000, None), (502, "http://new.net/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, mark int")
    found = {r.page_id: r for r in urls.judge(df, [], label=df.mark).collect()}
    assert len(found) == len(rows)
    assert all(found[p].verdict == ("block" if "deals" in u else "allow") for p, u, _ in rows if 300 <= p < 500)
    assert found[300].template == "/en/shop/*/deals" and found[500].template == f"/{deep}" and len(found[501].path) == 200_001
    flat = {r.page_id: r for r in urls.judge(df, [], label=df.mark, limits=urls.TreeLimits(fanout=10**6)).collect()}
    assert any(flat[p].verdict != found[p].verdict for p in range(300, 360))  # without wildcards nothing is shared
    one = spark.createDataFrame([(p, "http://h.net/", m) for p, _, m in rows], df.schema)
    assert len({r.verdict for r in urls.judge(one, [], label=one.mark).collect()}) == 1  # the tree gone, one verdict is left


def test_like_branches_share_their_counts(spark):
    """a and b are told apart from c, and not from each other: the few pages of b count like those of a."""
    rows = [(i, f"http://h.net/a/x{'yz'[i % 2]}", int(i > 1)) for i in range(30)] + [(100 + i, "http://h.net/b/x", int(i > 0)) for i in range(4)] + [(200 + i, "http://h.net/c/x", 0) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, mark int")
    found = {r.page_id: r for r in urls.judge(df, [], label=df.mark).collect()}
    apart = {r.page_id: r for r in urls.judge(df, [], label=df.mark, limits=urls.TreeLimits(similar=-0.5)).collect()}
    assert found[100].purity > apart[100].purity > 0.5 and found[100].verdict == "block" and found[200].verdict == "allow"
