"""The scan kernel: tiers, traps, vetoes, overlaps, and that all ways into it agree."""

import json
import random
from dataclasses import replace

import pytest

from wardlight.functions import texts
from wardlight.operators import kernel, moderation
from wardlight.sources import lexicon
from wardlight.sources.lexicon import Entry, Options, Pack

#: A custom word also has a key by its sound; most cases here are about the other tiers.
OPTIONS = Options(custom_words=("blort",), skeleton=False)
SOUNDS = replace(OPTIONS, skeleton=True)


def found(text, options=OPTIONS):
    return [(c.entry.lemma, c.tier, text[c.start : c.end]) for c in kernel.scanner(options).scan(text)]


HITS = [
    ("Frobnicate!", "frobnicate", "exact", "Frobnicate"),
    ("a fr0bnicate", "frobnicate", "exact", "fr0bnicate"),
    ("frobn​icate", "frobnicate", "exact", "frobn​icate"),
    ("ＦＲＯＢＮＩＣＡＴＥ", "frobnicate", "exact", "ＦＲＯＢＮＩＣＡＴＥ"),
    ("frоbnicate", "frobnicate", "exact", "frоbnicate"),
    ("blort", "blort", "exact", "blort"),
    ("bl0rt!", "blort", "exact", "bl0rt"),
    ("blortttt ok", "blort", "exact", "blortttt"),
    ("bbbblort", "blort", "exact", "bbbblort"),
    ("Bblort", "blort", "exact", "Bblort"),
    ("bl*rt", "blort", "masked", "bl*rt"),
    ("b**rt5", "blort", "masked", "b**rt"),
    ("b8ort", "blort", "masked", "b8ort"),
    ("8l*rt", "blort", "masked", "8l*rt"),
    ("bl\U0001f525ort", "blort", "masked", "bl\U0001f525ort"),
    ("#BlortNow", "blort", "exact", "Blort"),
    ("@myBLORTIs", "blort", "exact", "BLORT"),
    ("b l o r t", "blort", "separated", "b l o r t"),
    ("say: b.l.o.r.t", "blort", "separated", "b.l.o.r.t"),
    ("a b l o r t", "blort", "separated", "b l o r t"),
    ("bl.ort", "blort", "separated", "bl.ort"),
    ("bl-o-rt", "blort", "separated", "bl-o-rt"),
    ("fr ob nic ate", "frobnicate", "separated", "fr ob nic ate"),
    ("झम्पूड़", "झम्पूड़", "exact", "झम्पूड"),  # offsets of a cluster are those of its first character
    ("पर झंपूड", "झम्पूड़", "exact", "झंपूड"),
    ("jhampud", "झम्पूड़", "skeleton", "jhampud"),
    ("பிம்பிலஐ", "பிம்பில", "exact", "பிம்பிலஐ"),
    ("keitxyz", "keit", "exact", "keitxyz"),
    ("the erble of", "erble", "exact", "erble of"),
]
CLEAN = ["", " ", "blorts", "xblort", "blo.", "bl rt", "*lort", "blor*", "b****t", "bl**", "b.l.o.r", "bl ort", "re.bl-ort-er", "4chan", "covid19", "8blort", "\U0001f525lort", "C#BlortsNow", "zorp gardens", "Frobnicate County", "keiteinä", "b  l  o  r  t", "b (l) o r t", "x-b-l-o-r-t", "a 1 b 2", "bloort", "ering the"]


@pytest.mark.parametrize("text,lemma,tier,surface", HITS)
def test_hits(text, lemma, tier, surface):
    assert (lemma, tier, surface) in found(text, SOUNDS if tier == "skeleton" else OPTIONS)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert [f for f in found(text) if f[0] not in ("thing",)] == []


def test_original_decides_boundaries():
    assert found("bl0rt!") and not found("blort1x")


def test_allow_phrases_reach_all_tiers():
    allowed = replace(OPTIONS, custom_allow=("blort valley", "blort"))
    for text in ("blort", "b l o r t", "bl.ort", "#BlortNow", "blort valley", "BLORT"):
        assert not found(text, allowed)
    near = replace(OPTIONS, custom_allow=("blort valley",))
    assert not found("b l o r t valley", near) and found("b l o r t alley", near) and not found("#BlortValley", near)


def test_merging_over_packs():
    one = kernel.scanner(OPTIONS).scan("thing")[0].entry
    assert (one.severity, one.language, one.categories, one.casual_use) == (2, "fr", ("gendered", "general"), False)


def test_filters_come_after_merging():
    for o, n in ((Options(min_severity=2), 1), (Options(min_severity=3), 0), (Options(categories=("gendered",)), 1), (Options(categories=("slur",)), 0)):
        assert len(kernel.scanner(o).scan("thing")) == n


def test_options_leave_tiers_out():
    assert not found("bl*rt", replace(OPTIONS, masked=False)) and not found("jhampud")
    assert found("blorts", SOUNDS) == [("blort", "skeleton", "blort")] and not found("blorty ablort", SOUNDS)[1:]


def random_texts(n=400):
    rng = random.Random(11)
    parts = ["blort", "frobnicate", "thing", " ", ".", "-", "*", "8", "\U0001f525", "#", "@", "b", "l", "o", "r", "t", "erble of", "zorp gardens", "झम्पूड़", "ः", "é", "\n", "BL", "ort", "jampur", "ering the"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_spans_lie_in_the_text_and_clean_agrees():
    s = kernel.scanner(OPTIONS)
    for text in random_texts():
        got = s.scan(text)
        assert all(0 <= c.start < c.end <= len(text) for c in got)
        assert bool(got) == bool(s.surviving(text))


def test_notes_skip_nothing():
    """Tiers that a word's notes rule out would have found nothing."""
    s = kernel.Scanner(OPTIONS)
    for text in [*random_texts(), *(t for t, *_ in HITS), *CLEAN, "b.l o.r t", "x.b l", "b l\to\nr/t", "bl.or t", "(bl ort) fr-ob nic ate"]:
        plain, _, _, notes = s.passes(text) if text else ([], None, None, 0)
        if plain and not notes & kernel.SPELL:
            assert not [*s.spelled_hits(plain[-1])], text
        if plain and not notes & kernel.CHUNK:
            assert not [*s.chunk_hits(plain[-1])], text


def test_without_the_automaton_library(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    plain = kernel.Scanner(OPTIONS)
    for text in random_texts(150):
        assert [(c.start, c.end, c.tier, c.entry.lemma) for c in plain.scan(text)] == [(c.start, c.end, c.tier, c.entry.lemma) for c in kernel.scanner(OPTIONS).scan(text)]


def test_overlap_order():
    e = lambda v: Entry("x", f"s{v}", v)
    f = kernel.Found
    got = kernel.resolve([f(0, 5, "skeleton", e(4)), f(2, 4, "exact", e(1)), f(3, 9, "exact", e(2)), f(20, 22, "masked", e(1))])
    assert [(c.start, c.end) for c in got] == [(3, 9), (20, 22)]


def test_columns(spark):
    texts = [t for t, *_ in HITS] + CLEAN + [None, "\U0001f600 blort"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("doc_id", "text", moderation.scan("text", OPTIONS).alias("s"), moderation.is_clean("text", OPTIONS).alias("clean"), moderation.censor("text", OPTIONS).alias("c")).collect()
    for r in rows:
        want = kernel.scanner(OPTIONS).scan(r.text)
        assert [(m.char_start, m.char_end) for m in r.s.matches] == [(c.start, c.end) for c in want]
        assert r.clean == (not want) and r.s.max_severity == max((c.entry.severity for c in want), default=None)
        assert r.c == r.text if not want else r.c != r.text
    last = rows[-1].s.matches[0]
    assert (last.start, last.end, last.char_start, last.surface) == (3, 8, 2, "blort")
    assert moderation.scan_rows(df, options=OPTIONS).count() == sum(len(r.s.matches) for r in rows)
    checked = moderation.check(df, options=OPTIONS).where("doc_id = 0").first()
    assert (checked.clean, checked.match_count, checked.languages) == (False, 1, [p.language for p in lexicon.PACKS])


def test_sql_functions(spark):
    moderation.register(spark, OPTIONS)
    r = spark.sql("select is_clean('ok') a, censor('x blort') b, skeleton_key('phool') c, base_fold('É') d, scan('blort').max_severity e").first()
    assert tuple(r) == (True, "x *****", "fl", "é", 2)
    assert spark.sql("select surface, char_start from scan_rows('a blort and thing')").count() == 2
    with pytest.raises(ValueError):
        moderation.for_languages(["xx"])
    assert [p.language for p in moderation.for_languages(["fr", "en"]).packs] == ["en", "fr"]


def test_lexicon(spark, tmp_path):
    assert lexicon.problems(e for p in lexicon.PACKS for e in p.entries) == []
    bad = [Entry("x", "a", 9), Entry("x", "b", 1, ()), Entry("x", "c", 1, match_mode="prefix"), Entry("x", "d", 1, romanizations=("D",)), Entry("x", "a", 1), Entry("x", "f", 1, variants=("b",))]
    assert len(lexicon.problems(bad)) >= 6
    lexicon.to_frame(spark).write.json(f"{tmp_path}/lexicon")
    packs = lexicon.from_frame(lexicon.read(spark, f"{tmp_path}/lexicon"))
    again, first = Options(packs=packs), Options(packs=tuple(replace(p, allowlist=()) for p in lexicon.PACKS))
    assert {f: [e.lemma for e in es] for f, es in again.exact.items()} == {f: [e.lemma for e in es] for f, es in first.exact.items()}
    with pytest.raises(ValueError):
        lexicon.from_frame(lexicon.to_frame(spark), most=3)
    keyed = Options(packs=(Pack("x", "x", (Entry("x", "one", 1, romanizations=("bakatar",)), Entry("x", "two", 3, romanizations=("bakator",)), Entry("x", "three", 3, romanizations=("bokator",)))),))
    assert keyed.sounds["bktr"].lemma == "two"


def test_word_list(spark, tmp_path):
    (tmp_path / "words.txt").write_text("One\none \n\ntwo\n")
    assert {r.word for r in lexicon.word_list(spark, str(tmp_path / "words.txt")).collect()} == {"one", "two"}


def test_expanders():
    from wardlight.sources import expanders

    forms = lambda w, **k: set(expanders.english(w, **k))
    assert forms("stop") == {"stops", "stopped", "stopping", "stopper", "stoppers"} and forms("blame") == {"blames", "blamed", "blaming", "blamer", "blamers"}
    assert forms("bury") == {"buries", "buried", "burying", "burier", "buriers"} and forms("box") == {"boxes", "boxed", "boxing", "boxer", "boxers"}
    assert forms("hooker") == {"hookers"} and forms("bimbo") == {"bimbos"} and forms("pixie") == {"pixies"} and forms("glass") >= {"glasses", "glassed"} and forms("play") >= {"plays", "playing", "player"}
    assert not forms("things") and not forms("running") and not forms("Big") and not forms("ab") and forms("cock", exclude=frozenset(["cocker"])) == {"cocks", "cocked", "cocking"}
    assert expanders.hindi("dala") == ["dale", "dalo", "dalon"] and expanders.hindi("dali") == ["daliyon", "daliyan"] and expanders.hindi("dalu") == ["daluon", "dalua", "dalus"]
    assert expanders.hindi("chod") == ["chodo", "chode", "chodu", "chodon", "chodne"] and expanders.hindi("a b") == []
    assert expanders.tamil("பிள்ள") == ["பிள"] and expanders.tamil("ab்b") == [] and expanders.punjabi("ਝੁੱਮ") == ["ਝੁਮ"] and expanders.punjabi("ਝੁਮ") == []
    grown = expanders.expand((Entry("en", "stop", 1, variants=("blame",)), Entry("en", "stops", 2)), expanders.english, exclude=("blamed",))
    assert "stops" not in grown[0].variants and "blamed" not in grown[0].variants and "blaming" in grown[0].variants and len({s for e in grown for s in e.surfaces}) == sum(len(e.surfaces) for e in grown)
    roman = expanders.expand((Entry("hi", "झ", 1, romanizations=("dala",)), Entry("hi", "ञ", 1, romanizations=("dalo",))), expanders.hindi)
    assert roman[0].romanizations == ("dala", "dale", "dalon")


def test_plain_graphemes():
    for text in ("", "abc", "e\u0301a", "\u0915\u094d\u0937\u093f", "\U0001f468\u200d\U0001f469", "\u200ca", "\u0bae\u0bcd\u0bae"):
        parts = [text[a:b] for a, b in texts.plain_graphemes(text)]
        assert "".join(parts) == text
    cut = lambda text: [text[a:b] for a, b in texts.plain_graphemes(text)]
    assert cut("e\u0301a") == ["e\u0301", "a"] and cut("\u0915\u094d\u0937\u093f") == ["\u0915\u094d\u0937\u093f"] and cut("\U0001f468\u200d\U0001f469x") == ["\U0001f468\u200d\U0001f469", "x"]
    assert cut("\u0ab0\u0acd\u0ab0") == ["\u0ab0\u0acd", "\u0ab0"]  # its virama isn't among those that join


def test_messages(spark, tmp_path):
    from wardlight.streaming import messages

    say = lambda i, method, **p: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": p})
    lines = [say(1, "check_text", text="blort"), "", "{bad", say(2, "nothing", text="x"), say(3, "scan_text"), say(4, "censor_text", text="a blort"), say(5, "censor_text", text="a", mask=""), say(6, "scan_text", text="blort", minSeverity=3), json.dumps({"id": 7}), say(8, "ping")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lines.txt").write_text("\n".join(lines))
    batch = messages.answer(spark.read.text(str(tmp_path / "in")), OPTIONS).collect()
    got = {None if r.id is None else int(r.id): r for r in batch}
    assert [got[i].error for i in (None, 2, 3, 5, 7)] == [-32700, -32601, -32602, -32602, -32600] and len(batch) == len(lines) - 1
    assert json.loads(got[1].result)["clean"] is False and json.loads(got[4].result)["censored"] == "a *****" and json.loads(got[6].result)["matchCount"] == 0
    q = messages.stream_lines(spark, str(tmp_path / "in"), OPTIONS).writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("answers").collect(), key=repr) == sorted(batch, key=repr)


def test_message_arguments(spark):
    from wardlight.streaming import messages

    entries = (Entry("en", "blort", 1, skeleton_safe=False), Entry("en", "blaarta", 4, romanizations=("blaarta",)), Entry("en", "zonk", 2, skeleton_safe=False))
    options = Options(packs=(Pack("en", "English", entries),))
    assert [(c.entry.severity, c.tier) for c in kernel.scanner(options).surviving("a blort")] == [(1, "exact"), (4, "skeleton")]
    asked = [
        ("check_text", {"text": "a blort", "minSeverity": 3}),
        ("check_text", {"text": "a blort"}),
        ("scan_text", {"text": "a blort", "minSeverity": 3}),
        ("censor_text", {"text": "a zonk", "mask": "#"}),
        ("censor_text", {"text": "a zonk", "keepFirst": True}),
        ("censor_text", {"text": "zonk blaarta", "minSeverity": 3, "mask": "-", "keepFirst": True}),
        ("censor_text", {"text": "a zonk", "minSeverity": 3}),
        ("censor_text", {"text": "", "mask": "#"}),
        ("censor_text", {"text": "a zonk"}),
    ]
    lines = [(json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}),) for i, (m, p) in enumerate(asked)]
    got = {int(r.id): json.loads(r.result) for r in messages.answer(spark.createDataFrame(lines, "value string"), options).collect()}
    assert (got[0]["clean"], got[0]["matchCount"], got[0]["maxSeverity"]) == (False, 1, 4)
    assert (got[1]["matchCount"], got[1]["maxSeverity"]) == (1, 1)
    assert [(m["severity"], m["tier"]) for m in got[2]["matches"]] == [(4, "skeleton")]
    assert [got[i]["censored"] for i in range(3, 9)] == ["a ####", "a z***", "zonk b------", "a zonk", "", "a ****"]
    assert [got[i]["matchCount"] for i in range(3, 9)] == [1, 1, 1, 0, 0, 1] and "censored" not in got[1]


def test_message_languages_and_protocol(spark):
    from wardlight.streaming import messages

    packs = (Pack("en", "English", (Entry("en", "blort", 1, skeleton_safe=False),), ("blort hill",)), Pack("de", "German", (Entry("de", "blort", 3, skeleton_safe=False),)))
    options = Options(packs=packs)
    say = lambda i, method, **p: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": p})
    lines = {
        "a": say("a", "check_text", text="blort", languages=["en"]), "b": say("b", "check_text", text="blort"), "c": say("c", "check_text", text="blort hill", languages=["de"]), "d": say("d", "check_text", text="blort hill"),
        "e": say("e", "tools/call", name="censor_text", arguments={"text": "blort", "mask": "#"}), "f": say("f", "list_languages"), "g": say("g", "tools/list"), "h": say("h", "initialize", protocolVersion="2024-11-05"),
        "i": say("i", "check_text", text="x", languages=["xx"]), "j": say("j", "check_text", text="x", languages=[]), "k": say("k", "check_text", text="x", other=1), "l": say("l", "check_text", text=5), "m": say("m", "check_text", text="x", minSeverity=2.5),
        "n": say("n", "check_text", text="x", mask="#"), "o": say("o", "tools/call", name="rm"), "p": say("p", "censor_text", text="x", keepFirst="yes"), "q": say("q", "list_languages", text="x"),
    }
    extra = [json.dumps({"jsonrpc": "2.0", "method": "ping"}), "[1]", json.dumps({"jsonrpc": "2.0", "id": {}, "method": "ping"}), json.dumps({"jsonrpc": "1.0", "id": 9, "method": "ping"}), say(7, "ping")]
    rows = messages.answer(spark.createDataFrame([(x,) for x in [*lines.values(), *extra]], "value string"), options).collect()
    got = {json.loads(r.id): r for r in rows if r.id}
    read = {k: json.loads(got[k].result) for k in "abcdefgh"}
    assert [(read[k]["matchCount"], read[k].get("maxSeverity")) for k in "abcd"] == [(1, 1), (1, 3), (1, 3), (0, None)]  # a lexicon of its own, allow phrases too
    assert read["a"]["languages"] == ["en"] and read["b"]["languages"] == ["en", "de"] and read["e"]["censored"] == "#####"
    assert [(x["code"], x["lemmaCount"]) for x in read["f"]["languages"]] == [("en", 1), ("de", 1)] and read["f"]["defaultLanguages"] == ["en", "de"]
    assert [t["name"] for t in read["g"]["tools"]] == list(messages.TOOLS) and read["h"]["protocolVersion"] == "2024-11-05"
    assert {k: got[k].error for k in "ijklmnopq"} == dict.fromkeys("ijklmnpq", -32602) | {"o": -32601}
    assert sorted(r.error for r in rows if r.id is None) == [-32600, -32600] and got[9].error == -32600 and got[7].result == "{}"


def test_a_failing_text_is_one_error(spark, monkeypatch):
    from wardlight.streaming import messages

    lines = [(json.dumps({"jsonrpc": "2.0", "id": i, "method": "scan_text", "params": {"text": t}}),) for i, t in enumerate(["blort", "a \ud800"])]
    rows = {r.id: r for r in messages.answer(spark.createDataFrame(lines, "value string"), OPTIONS).collect()}
    assert rows["0"].error is None and rows["1"].error in (None, messages.PARSE_ERROR, messages.INTERNAL_ERROR)


def test_severity_windows(spark):
    from pyspark.sql import functions as F

    from wardlight.streaming import messages

    df = spark.createDataFrame([("2026-01-01 00:10:00", "blort"), ("2026-01-01 00:50:00", "fine"), ("2026-01-01 01:10:00", "frobnicate")], "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows = messages.severity_windows(df.withColumn("scan", moderation.scan("text", OPTIONS))).orderBy("window").collect()
    assert [(r.texts, r.matches, r.max_severity) for r in rows] == [(2, 1, 2), (1, 1, 3)]
