"""Folds with offsets as columns against the folds of single texts."""

import random

from pyspark.sql import functions as F

from wardlight.functions import offsets, texts
from wardlight.functions import tables as t


def samples(n=400):
    rng = random.Random(7)
    plain = "aabbxkhpsteiouzwqyc4310579@!|$XKHPİ"
    odd = "".join(map(chr, (0x200B, 0x301, 0x300, 0x430, 0x435, 0xE9, 0x1D41A, 0xFF21, 0x92E, 0x94D, 0x928, 0x9CE, 0x9CD, 0x9A8, 0xD7A, 0xD4D, 0x903, 0x1F600)))
    words = ["".join(rng.choice(plain if rng.random() < 0.75 else odd) for _ in range(rng.randrange(0, 14))) for _ in range(n)]
    return [*words, "", "kshhxx", "exx", "phph", "kshkshh", "aaaa", "x", "hh", "क््", "ন্্ক"]


def test_folds_keep_offsets(spark):
    words = [w for w in samples() if texts.unicodedata.is_normalized("NFC", w)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    base = df.select("w", *[c.alias(f"b_{i}") for i, c in enumerate(offsets.fields(offsets.base(offsets.original(F.col("w")))))])
    made = offsets.latin(offsets.Traced(F.col("b_0"), F.col("b_1")))
    latin = base.select("*", made.text.alias("l_0"), made.at.alias("l_1"))
    one, said = (fn(offsets.Traced(F.col("l_0"), F.col("l_1"))) for fn in (offsets.single, offsets.sound))
    found = latin.select("*", *[c.alias(f"s_{i}") for i, c in enumerate(offsets.fields(one))], *[c.alias(f"k_{i}") for i, c in enumerate(offsets.fields(said))]).collect()
    checked = 0
    for r in found:
        want, at = texts.trace([*texts.POINTS, *texts.CLUSTERS], r.w)
        assert (r.b_0, r.b_1) == (want, at), r.w
        if "ph" in want and any(x in want for x in t.LEET_SIGNS):
            continue
        want, at = texts.trace(texts.LATIN, want, at)
        assert (r.l_0, r.l_1) == (want, at), (r.w, r.b_0)
        assert (r.s_0, r.s_1) == texts.trace(texts.SINGLES, want, at), r.w
        assert (r.k_0, r.k_1) == texts.trace(texts.SKELETON, want, at), (r.w, want)
        checked += 1
    assert checked > 250


def test_no_python_in_the_plan(spark):
    x = offsets.sound(offsets.latin(offsets.base(offsets.original(F.col("w")))))
    plan = spark.createDataFrame([("a",)], "w string").select(x.at)._jdf.queryExecution().toString()
    assert "Python" not in plan
