"""Evaluation: hidden words by axis, scorecards, votes, what single packs and allow phrases carry."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evade
from ..operators import moderation
from ..sources.lexicon import Options


def cases(words: DataFrame, col: str = "w") -> DataFrame:
    """Each word hidden in every way that applies to it: w, axis, hidden. Made within the row."""
    made = F.array(*[F.struct(F.lit(way).alias("axis"), evade.evade(col, way).alias("hidden")) for way in evade.LATIN])
    return words.select(col, F.explode(F.filter(made, lambda m: m["hidden"].isNotNull())).alias("m")).select(col, "m.*")


def native_cases(words: DataFrame, col: str = "w") -> DataFrame:
    """The same for words of other scripts, between their grapheme clusters."""
    return words.select(col, F.explode(evade.evade_native(col)).alias("m")).select(col, F.col("m.way").alias("axis"), F.col("m.hidden").alias("hidden"))


def candidates(words: DataFrame) -> DataFrame:
    """What a suite (suite, place, w) is expanded to: its words as controls, and for each way the first word that it applies to."""
    order = {way: k for k, way in enumerate(evade.LATIN)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    made = F.array(*[F.struct(F.lit(way).alias("axis"), evade.evade("w", way).alias("hidden")) for way in order])
    rows = words.select("suite", "place", "w", F.explode(F.filter(made, lambda m: m["hidden"].isNotNull())).alias("m")).select("suite", "place", "w", "m.*")
    first = rows.groupBy("suite", "axis").agg(F.min(F.struct("place", "w", "hidden")).alias("f"))
    generated = first.select("suite", F.lit("generated").alias("kind"), "axis", "f.w", "f.hidden", (F.lit(1_000_000) + rank[F.col("axis")]).cast("long").alias("turn"))
    control = words.select("suite", F.lit("control").alias("kind"), F.lit("plain").alias("axis"), "w", F.col("w").alias("hidden"), F.col("place").cast("long").alias("turn"))
    return control.unionByName(generated)


def expand(words: DataFrame) -> DataFrame:
    """The cases of each suite, one for each hidden text, the earliest of equal ones: suite, kind, axis, w, hidden."""
    kept = candidates(words).groupBy("suite", "hidden").agg(F.min(F.struct("turn", "kind", "axis", "w")).alias("m"))
    return kept.select("suite", "m.kind", "m.axis", "m.w", "hidden")


def composition(words: DataFrame) -> DataFrame:
    """For each suite its cases by kind and in all, how many collapsed into an equal one, and the ways that apply to none of its words."""
    every = candidates(words).groupBy("suite").agg(F.count("*").alias("made"), F.collect_set("axis").alias("axes"))
    counts = expand(words).groupBy("suite").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("control", "generated")], F.count("*").alias("total"))
    ways = F.array(*map(F.lit, sorted(evade.LATIN)))
    return counts.join(every, "suite").select("suite", "control", "generated", "total", (F.col("made") - F.col("total")).alias("collapsed"), F.array_except(ways, "axes").alias("inapplicable"))


def unique_cases(made: DataFrame) -> DataFrame:
    """One case per hidden text; the first axis by name stands for equal ones, and collapsed counts them."""
    return made.groupBy("hidden").agg(F.min(F.struct("axis", "w")).alias("m"), F.count("*").alias("collapsed")).select("m.w", "m.axis", "hidden", "collapsed")


def flagged(made: DataFrame, library: str, options: Options) -> DataFrame:
    return made.withColumn("library", F.lit(library)).withColumn("hit", ~moderation.is_clean("hidden", options))


def scorecard(results: DataFrame) -> DataFrame:
    """Caught and all cases of each library and axis."""
    return results.groupBy("library", "axis").agg(F.sum(F.col("hit").cast("long")).alias("caught"), F.count("*").alias("cases"))


def misses(results: DataFrame) -> DataFrame:
    """Axes with misses, with their words, beside the axis totals."""
    totals = results.groupBy("axis").agg(F.count("*").alias("cases"))
    missed = results.where(~F.col("hit")).groupBy("axis").agg(F.count("*").alias("missed"), F.sort_array(F.collect_set("w")).alias("words"))
    return missed.join(totals, "axis")


def tiers(found: DataFrame, case_col: str) -> DataFrame:
    """In how many cases each tier found something; a case may count for several."""
    return found.select(case_col, "tier").distinct().groupBy("tier").agg(F.count("*").alias("cases"))


def votes(claims: DataFrame) -> DataFrame:
    """How many libraries claim each word (w, library)."""
    return claims.groupBy("w").agg(F.countDistinct("library").alias("votes")).withColumn("alone", F.col("votes") == 1)


def vote_summary(claims: DataFrame) -> DataFrame:
    """For each library its words and those that no other claims."""
    return claims.join(votes(claims), "w").groupBy("library").agg(F.count("*").alias("claimed"), F.sum(F.col("alone").cast("long")).alias("alone"))


def isolation(made: DataFrame, options: Options) -> DataFrame:
    """Cases that each pack catches alone, and that all catch together; the cases are read once."""
    by = {"all": options} | {p.language: replace(options, packs=(p,)) for p in options.packs}
    clean = made.select(moderation.is_clean_each("hidden", list(by.values())).alias("clean_"))
    hit = clean.select(*[(~F.col("clean_")[i]).cast("long").alias(f"hit_{k}") for i, k in enumerate(by)])
    sums = hit.agg(*[F.sum(f"hit_{k}").alias(k) for k in by], F.count("*").alias("cases"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("library"), F.col(k).alias("caught")) for k in by])).alias("m"), "cases").select("m.*", "cases")


#: Regular English endings: (whether they apply to the word w, what is made of it); more than the language has does no harm.
ENDINGS = (
    ("true", "concat(w, 's')"), ("true", "concat(w, 'ly')"), ("w rlike '(s|x|z|ch|sh)$'", "concat(w, 'es')"), ("w rlike '(s|x|z|ch|sh)$'", "concat(w, 'ed')"),
    ("w rlike '[^aeiou]y$'", "concat(substr(w, 1, length(w) - 1), 'ies')"), ("w rlike '[^aeiou]y$'", "concat(substr(w, 1, length(w) - 1), 'ied')"),
    *[("w rlike 'e$'", f"concat(w, '{x}')") for x in ("d", "r", "st")], ("w rlike 'e$'", "concat(substr(w, 1, length(w) - 1), 'ing')"),
    *[("w rlike '[^e]$'", f"concat(w, '{x}')") for x in ("ed", "ing", "er", "est")],
)


def inflections(words: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """w: the distinct regular inflections of words of a-z of three letters or more, those words left out; only those in among (w), if given."""
    fair = words.where(F.col("w").rlike("^[a-z]{3,}$"))
    made = F.array(*[F.expr(f"CASE WHEN {test} THEN {form} END") for test, form in ENDINGS])
    rows = fair.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("w"))
    return (rows if among is None else rows.join(among, "w", "left_semi")).distinct().join(words, "w", "left_anti")


def origins(headwords: DataFrame, compounds: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """w, origin: headword, compound, or inflection of a headword.

    among (w): only these words as headwords and inflections, if given.
    """
    made = inflections(headwords)
    if among is not None:
        headwords, made = headwords.join(among, "w", "left_semi"), inflections(headwords, among)
    parts = headwords.select("w", F.lit("headword").alias("origin")).unionByName(compounds.select("w", F.lit("compound").alias("origin")))
    return parts.unionByName(made.select("w", F.lit("inflection").alias("origin")))


def origin_split(words: DataFrame, claims: DataFrame) -> DataFrame:
    """Flagged words of each library by origin; words: (w, origin), claims: (w, library)."""
    found = claims.distinct().join(words, "w")
    return found.groupBy("library").agg(*[F.count(F.when(F.col("origin") == k, 1)).alias(k) for k in ("headword", "compound", "inflection")])


def repeated(df: DataFrame, text_col: str = "text", by: str = "source") -> DataFrame:
    """Texts that occur more than once, with how often and in what; empty where every text is its own."""
    counts = df.groupBy(text_col, by).agg(F.count("*").alias("n"))
    return counts.groupBy(text_col).agg(F.sum("n").alias("times"), F.sort_array(F.collect_list(by)).alias("places")).where("times > 1")


def allow_dependence(df: DataFrame, options: Options, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that are clean thanks to allow phrases alone: clean as compiled, not clean without the phrases."""
    bare = tuple(replace(p, allowlist=(), entries=tuple(replace(e, allowlist=()) for e in p.entries)) for p in options.packs)
    # phrases only ever take matches away
    each = moderation.is_clean_each(text_col, [replace(options, packs=bare, custom_allow=()), options], narrowing=True)
    both = df.select(each.alias("clean_")).select(F.col("clean_")[1].alias("clean"), F.col("clean_")[0].alias("clean_bare"))
    return both.groupBy("clean", "clean_bare").agg(F.count("*").alias("texts"))


def synthetic(lists: DataFrame, n: int, profane: str, every: int = 3) -> DataFrame:
    """lists (with a column list of words), and place, text: n texts of 10, 20 and 30 of its words; each `every`-th has the profane word once."""
    rows = lists.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    length = ((F.col("place") % 3 + 1) * 10).cast("int")
    word = lambda j: F.get("list", ((F.col("place") + j) % F.size("list")).cast("int"))
    made = F.transform(F.sequence(F.lit(0), length - 1), lambda j: F.when((j == 4) & (F.col("place") % every == 0), F.lit(profane)).otherwise(word(j)))
    return rows.withColumn("text", F.array_join(made, " "))


#: Plain sentences in six alphabets or styles, for texts of any length.
CORPORA = {
    "ascii": "a small boat drifts past the old stone bridge at noon".split(),
    "prose": "Meanwhile, 17 Tall Ships (built in 1904) sail; the EU says \"fine\" \u2014 why not?".split(),
    "devanagari": "आज मौसम अच्छा है और नदी के किनारे बहुत लोग घूम रहे हैं".split(),
    "tamil": "இன்று வானம் தெளிவாக உள்ளது ஆற்றின் கரையில் பலர் நடக்கிறார்கள்".split(),
    "bengali": "আজ আকাশ পরিষ্কার এবং নদীর ধারে অনেক মানুষ হাঁটছে".split(),
    "gurmukhi": "ਅੱਜ ਮੌਸਮ ਚੰਗਾ ਹੈ ਅਤੇ ਦਰਿਆ ਦੇ ਕੰਢੇ ਬਹੁਤ ਲੋਕ ਘੁੰਮ ਰਹੇ ਹਨ".split(),
}


def sentences(spark: SparkSession) -> DataFrame:
    """CORPORA as lists of words (lang, list)."""
    return spark.createDataFrame(list(CORPORA.items()), "lang string, list array<string>")


def synthetic_corpora(lists: DataFrame, sizes: tuple[int, ...], profane: str, every: tuple[int, ...] = (0, 10)) -> DataFrame:
    """corpus (lang of lists), words, every, text: each list repeated to so many words, every so many-th (from the first) the profane one; 0: none."""
    rows = lists.select(F.col("lang").alias("corpus"), "list", F.explode(F.array(*map(F.lit, sizes))).alias("words")).withColumn("every", F.explode(F.array(*map(F.lit, every))))
    word = lambda i: F.when((F.col("every") > 0) & (i % F.greatest("every", F.lit(1)) == 0), F.lit(profane)).otherwise(F.get("list", (i % F.size("list")).cast("int")))
    return rows.select("corpus", "words", "every", F.array_join(F.transform(F.sequence(F.lit(0), F.col("words") - 1), word), " ").alias("text"))


#: Values whose order gives the ranges of sample_evenly, and how many of them lie in a range.
DRAWN, DRAWN_EACH = 2048, 16


def sample_evenly(df: DataFrame, order: str, k: int) -> DataFrame:
    """k distinct values of a column at even distances in its order (all if there are no more), exactly.

    Values are counted in ranges between fixed bounds, so every reading of df gives the same places. The bounds are
    among DRAWN values of the least hashes (strings by their first 64 characters), which reach the driver with a
    count for each range; the ranges that hold a place are sorted.
    """
    values = df.select(order).where(F.col(order).isNotNull()).distinct()
    short = F.substring(order, 1, 64) if dict(values.dtypes)[order] == "string" else F.col(order)
    drawn = values.orderBy(F.xxhash64(order), order).limit(DRAWN).select(short.alias("v")).distinct().orderBy("v").collect()
    bounds = F.array(*[F.lit(r["v"]) for r in drawn[DRAWN_EACH::DRAWN_EACH]])
    dealt = values.withColumn("range_", F.size(F.filter(bounds, lambda b: b <= F.col(order))) if len(drawn) > DRAWN_EACH else F.lit(0))
    counts = {r["range_"]: r["count"] for r in dealt.groupBy("range_").count().collect()}
    total, before, places = sum(counts.values()), 0, []
    wanted = range(total) if total <= k else [i * total // k for i in range(k)]
    for part in sorted(counts):
        places += [(part, i - before + 1) for i in wanted if before <= i < before + counts[part]]
        before += counts[part]
    if not total:
        return df.select(order).limit(0)
    rows = dealt.where(F.col("range_").isin(sorted({p for p, _ in places}))).withColumn("row_", F.row_number().over(Window.partitionBy("range_").orderBy(order)))
    held = {p: [i for q, i in places if q == p] for p, _ in places}
    fits = F.lit(False)
    for part, own in held.items():
        fits = fits | ((F.col("range_") == part) & F.col("row_").isin(own))
    return rows.where(fits).select(order)
