"""The scan inside the JVM against the kernel, on texts whose words aren't hidden by masks, pictures, tags or separators."""

import random

from wardlight.operators import moderation, native
from wardlight.sources.lexicon import Options

WORDS = ["thing", "THING", "things", "thiiing", "tthing", "ering the", "ering", "erble of", "erble", "zorp gardens", "zorp", "frobnicate county", "frobnicator", "fr0bnicate", "th!ng", "tion!", "$tion", "keiteinäx", "keitwort", "keit", "xkeit", "the", "of", "jhampoodx", "pimbilakk", "timbaktu", "instansy", "тhing", "thíng", "ＴＨＩＮＧ", "th​ing", "😀", "झम्पूड़", "eauoi,", "(thing)", "thing,thing", "timbacktoo", "jham pood", "ঝিম্পলুক"]


def compared(spark, texts, options=Options()):
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    columns = ["doc_id", *native.MATCH]
    got, want = (sorted(map(str, f.select(*columns).collect())) for f in (native.scan_rows(df, options=options), moderation.scan_rows(df, options=options)))
    return got, want


def test_equals_the_kernel(spark):
    rng = random.Random(2)
    texts = [rng.choice([" ", "  ", "\n"]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts = [t for t in texts if moderation.texts.unicodedata.is_normalized("NFC", t)] + [None, "", "  ", "thing"] * 2
    got, want = compared(spark, texts)
    assert got == want and len(want) > 250


def test_filters_and_empty_tables(spark):
    texts = ["thing erble zorp keit", "zorp gardens thing"]
    for options in (Options(min_severity=3), Options(categories=("slur", "violence")), Options(skeleton=False), Options(packs=(), custom_words=("zorp",), custom_allow=("zorp g",))):
        got, want = compared(spark, texts, options)
        assert got == want
    empty = native.scan_rows(spark.createDataFrame([], "text string, lemma string, row_ int"))
    assert empty.count() == 0 and empty.columns == ["row_", *native.MATCH]
    assert "Python" not in native.scan_rows(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().toString()


def test_pieces_that_cannot_hit_stay_in_their_row(spark):
    quiet = "the house, 1999 (well-known) don't größe été THE!! keyboard\n" * 40
    df = spark.createDataFrame([(quiet + "a thing here  and zorp\tgardens\n",), (quiet,), (None,)], "text string")
    got = native.pieces(df, "text", [], Options()).select("piece", "start", "before", "after").collect()
    start = len(quiet) + 2
    assert sorted(map(tuple, got)) == [("thing", start, "a", "here"), ("zorp", start + 16, "and", None)]
