"""The lexicon: its schema, rows of its own for demonstration and tests, readers, checks, and its compiled form tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts

# The categories of terms, and the tiers of matches.
CATEGORIES = ("sexual", "gendered", "general", "slur", "casteist", "religious", "violence", "ableist")
LEAST_KEY = 4

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("language", T.StringType(), False),
        T.StructField("lemma", T.StringType(), False),
        T.StructField("script", T.StringType(), False),
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("categories", T.ArrayType(T.StringType()), False),
        T.StructField("romanizations", T.ArrayType(T.StringType())),
        T.StructField("variants", T.ArrayType(T.StringType())),
        T.StructField("allowlist", T.ArrayType(T.StringType())),
        T.StructField("match_mode", T.StringType(), False),
        T.StructField("skeleton_safe", T.BooleanType(), False),
        T.StructField("casual_use", T.BooleanType(), False),
        T.StructField("load_order", T.IntegerType(), False),
        T.StructField("pack_name", T.StringType()),
        T.StructField("pack_allowlist", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Entry:
    language: str
    lemma: str
    severity: int
    categories: tuple[str, ...] = ("general",)
    script: str = "Latn"
    romanizations: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    match_mode: str = "word"
    skeleton_safe: bool = True
    casual_use: bool = False
    load_order: int = 0

    @property
    def surfaces(self) -> tuple[str, ...]:
        return (self.lemma, *self.variants, *self.romanizations)


@dataclass(frozen=True)
class Pack:
    language: str
    name: str
    entries: tuple[Entry, ...]
    allowlist: tuple[str, ...] = ()


#: Neutral packs of invented terms in several scripts; real lexicons are data to be loaded.
PACKS = (
    Pack(
        "en",
        "English (neutral)",
        (
            Entry("en", "frobnicate", 3, ("general", "gendered"), variants=("frobnicated", "frobnicator")),
            Entry("en", "thing", 1, casual_use=True, variants=("things",)),
            Entry("en", "thtion", 2, ("slur",), romanizations=("thtion",), skeleton_safe=False),
            Entry("en", "ering", 3, ("sexual",), allowlist=("ering the",)),
            Entry("en", "erble", 4, ("violence",), variants=("erble of",)),
            Entry("en", "zorp", 2, ("general",), skeleton_safe=False),
        ),
        ("zorp gardens", "frobnicate county"),
    ),
    Pack("fr", "French (neutral)", (Entry("fr", "tion", 2, ("general",)), Entry("fr", "eauoi", 1, ("religious",)), Entry("fr", "thing", 2, ("gendered",)))),
    Pack("de", "German (neutral)", (Entry("de", "keit", 3, ("ableist",), match_mode="prefix", allowlist=("keiteinä",)), Entry("de", "ungie", 2, ("general",)))),
    Pack("hi", "Hindi (neutral)", (Entry("hi", "झम्पूड़", 3, ("general",), "Deva", romanizations=("jhampood", "jhampur", "jham pood")), Entry("hi", "टिंबक", 4, ("slur",), "Deva", romanizations=("timbaktu", "instan")))),
    Pack("ta", "Tamil (neutral)", (Entry("ta", "பிம்பில", 2, ("general",), "Taml", romanizations=("pimbila",), match_mode="prefix", allowlist=("பிம்பிலக்",)),)),
    Pack("bn", "Bengali (neutral)", (Entry("bn", "ঝিম্পলুক", 2, ("general",), "Beng", romanizations=("jhimpoluk",)), Entry("bn", "টংরিপা", 3, ("ableist",), "Beng"))),
    Pack("gu", "Gujarati (neutral)", (Entry("gu", "ઝબૂકિયો", 1, ("general",), "Gujr", romanizations=("zabukidovan",)),)),
    Pack("kn", "Kannada (neutral)", (Entry("kn", "ಝಿಂಪಲಿ", 2, ("gendered",), "Knda", romanizations=("jhimpalige",)),)),
    Pack("ml", "Malayalam (neutral)", (Entry("ml", "ഞിമ്പലൻ", 2, ("general",), "Mlym", romanizations=("njimbalan",)),)),
    Pack("mr", "Marathi (neutral)", (Entry("mr", "झिंपळ्या", 2, ("general",), "Deva", romanizations=("jhimpalya",), skeleton_safe=False),)),
    Pack("or", "Odia (neutral)", (Entry("or", "ଝିମ୍ପଲା", 3, ("slur",), "Orya", romanizations=("zhimpolaka",)),)),
    Pack("pa", "Punjabi (neutral)", (Entry("pa", "ਝੁੱਮਪਲ", 2, ("general",), "Guru", variants=("ਝੁਮਪਲ",), romanizations=("jhumpal",)),)),
    Pack("te", "Telugu (neutral)", (Entry("te", "ఝింపలోడు", 2, ("general",), "Telu", romanizations=("jhimpalodu",)),)),
)


def custom(words: Iterable[str]) -> list[Entry]:
    """Ad-hoc words: language custom, severity 2, category general, themselves as romanisation."""
    return [Entry("custom", w, 2, romanizations=(w.lower(),)) for w in words]


@dataclass(frozen=True)
class Options:
    """What a matcher is built with; sets of languages are compiled apart, since merging and vetoes depend on what is loaded."""

    packs: tuple[Pack, ...] = PACKS
    min_severity: int = 0
    categories: tuple[str, ...] | None = None
    skeleton: bool = True
    masked: bool = True
    custom_words: tuple[str, ...] = ()
    custom_allow: tuple[str, ...] = ()

    @cached_property
    def entries(self) -> list[Entry]:
        rows = [e for p in self.packs for e in p.entries] + custom(self.custom_words)
        return [replace(e, load_order=i) for i, e in enumerate(rows)]

    @cached_property
    def allowed(self) -> list[str]:
        """Forms of all allow phrases: custom ones, the packs', the entries'."""
        phrases = [*self.custom_allow, *(a for p in self.packs for a in p.allowlist), *(a for e in self.entries for a in e.allowlist)]
        return list(dict.fromkeys(f for phrase in phrases for f in texts.forms(phrase)))

    @cached_property
    def exact(self) -> dict[str, list[Entry]]:
        """Every form and the entries that have it, in loading order."""
        out: dict[str, list[Entry]] = {}
        for e in self.entries:
            for surface in e.surfaces:
                for form in texts.forms(surface):
                    out.setdefault(form, []).append(e)
        return out

    @cached_property
    def collapsed(self) -> dict[str, list[Entry]]:
        return {f: e for f, e in self.exact.items() if texts.run(texts.SINGLES, f) == f}

    @cached_property
    def sounds(self) -> dict[str, Entry]:
        """The most severe entry of each key of a one-word romanisation, the first loaded of equals."""
        out: dict[str, Entry] = {}
        for e in self.entries:
            for word in e.romanizations if e.skeleton_safe else ():
                key = texts.skeleton_key(word)
                if not regex.search(r"\s", word) and len(key) >= LEAST_KEY and (key not in out or e.severity > out[key].severity):
                    out[key] = e
        return out


def problems(entries: Iterable[Entry]) -> list[str]:
    """What is wrong with lexicon rows, in words; an empty list if nothing is."""
    out, seen, lemmas = [], {}, set()
    for e in entries:
        at = f"{e.language}/{e.lemma}"
        if e.severity not in range(5):
            out.append(f"{at}: severity {e.severity}")
        if not e.categories or len(set(e.categories)) < len(e.categories) or set(e.categories) - set(CATEGORIES):
            out.append(f"{at}: categories {e.categories}")
        if e.match_mode not in ("word", "prefix"):
            out.append(f"{at}: match_mode {e.match_mode}")
        if e.match_mode == "prefix" and (not e.allowlist or len(e.lemma) < (4 if e.script == "Latn" else 3)):
            out.append(f"{at}: a prefix needs an allowlist and enough letters")
        if any(not regex.fullmatch("[a-z ]+", r) or r != r.strip() for r in e.romanizations):
            out.append(f"{at}: romanizations {e.romanizations}")
        if e.lemma != e.lemma.strip() or not e.lemma or (e.language, e.lemma) in lemmas:
            out.append(f"{at}: lemma is blank, padded or given twice")
        if e.skeleton_safe and e.romanizations and all(len(texts.skeleton_key(r)) < LEAST_KEY for r in e.romanizations):
            out.append(f"{at}: all keys are short, so it can't be skeleton_safe")
        lemmas.add((e.language, e.lemma))
        for s in dict.fromkeys(e.surfaces):
            other = seen.setdefault((e.language, s), e.lemma)
            if other != e.lemma:
                out.append(f"{at}: surface {s} is also {other}'s")
    return out


def to_rows(entries: Iterable[Entry], packs: Iterable[Pack] = ()) -> list[tuple]:
    of = {p.language: (p.name, list(p.allowlist)) for p in packs}
    return [(e.language, e.lemma, e.script, e.severity, list(e.categories), list(e.romanizations), list(e.variants), list(e.allowlist), e.match_mode, e.skeleton_safe, e.casual_use, e.load_order, *of.get(e.language, (None, None))) for e in entries]


def to_frame(spark: SparkSession, options: Options = Options()) -> DataFrame:
    return spark.createDataFrame(to_rows(options.entries, options.packs), ENTRY_SCHEMA)


def from_frame(df: DataFrame, most: int = 200_000) -> tuple[Pack, ...]:
    """Packs of lexicon rows (from spark.read.json or parquet with ENTRY_SCHEMA); a lexicon of more than `most` rows is refused.

    A pack's name is its language where its rows give none; its allow phrases are those of all its rows, in their order.
    """
    rows = df.orderBy("load_order").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lexicon rows")
    packs: dict[str, list[Entry]] = {}
    names: dict[str, str] = {}
    allowed: dict[str, dict[str, None]] = {}
    for row in rows:
        r = row.asDict()
        entry = Entry(r["language"], r["lemma"], r["severity"], tuple(r["categories"]), r["script"], tuple(r["romanizations"] or ()), tuple(r["variants"] or ()), tuple(r["allowlist"] or ()), r["match_mode"], r["skeleton_safe"], r["casual_use"], r["load_order"])
        packs.setdefault(r["language"], []).append(entry)
        names.setdefault(r["language"], r.get("pack_name") or r["language"])
        allowed.setdefault(r["language"], {}).update(dict.fromkeys(r.get("pack_allowlist") or ()))
    return tuple(Pack(k, names[k], tuple(v), tuple(allowed[k])) for k, v in packs.items())


def read(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(ENTRY_SCHEMA).format(kind).load(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lower-case lines of text files: word."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a relation whose size the engine knows: from Arrow. Of plain tuples it would make an RDD of unknown size and shuffle all that is joined to it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=_parse_datatype_string(schema))


def form_table(spark: SparkSession, options: Options = Options()) -> DataFrame:
    """One row per (form, entry): the exact patterns for relational plans, small enough to broadcast."""
    rows = [(f, len(f), f.count(" ") + 1, e.lemma, e.language, e.severity, list(e.categories), e.match_mode, e.casual_use, e.load_order) for f, entries in options.exact.items() for e in dict.fromkeys(entries)]
    return local(spark, rows, "form string, form_len int, grams int, lemma string, language string, severity int, categories array<string>, match_mode string, casual_use boolean, load_order int")


def allow_table(spark: SparkSession, options: Options = Options()) -> DataFrame:
    return spark.createDataFrame([(f,) for f in options.allowed], "phrase string")


def key_table(spark: SparkSession, options: Options = Options()) -> DataFrame:
    return local(spark, [(k, len(k), e.lemma, e.severity) for k, e in options.sounds.items()], "key string, key_len int, lemma string, severity int")


def summaries(options: Options) -> list[dict]:
    """Code, name, scripts (in order of first use) and number of lemmas of each loaded pack."""
    return [{"code": p.language, "name": p.name, "scripts": list(dict.fromkeys(e.script for e in p.entries)), "lemmaCount": len(p.entries)} for p in options.packs]


def list_languages(df: DataFrame) -> DataFrame:
    """Lemmas and scripts (in order of first use) of each language of lexicon rows."""
    scripts = df.groupBy("language", "script").agg(F.min("load_order").alias("first"), F.count("*").alias("n"))
    out = scripts.groupBy("language").agg(F.sum("n").alias("lemma_count"), F.array_sort(F.collect_list(F.struct("first", "script"))).alias("s"), F.min("first").alias("order"))
    return out.select("language", "lemma_count", F.transform("s", lambda x: x["script"]).alias("scripts"), F.col("order").alias("load_order"))
