"""Scanning as columns, tables, SQL functions and a table function."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.lexicon import PACKS, Options
from ..sources.tables import small_batches
from .kernel import Found, resolve, scanner

# Offsets count UTF-16 units (start, end); char_start and char_end count characters, as SQL's substring does.
MATCH = "struct<lemma:string,surface:string,tier:string,language:string,severity:int,categories:array<string>,casual_use:boolean,start:int,end:int,char_start:int,char_end:int>"
RESULT = f"matches array<{MATCH}>, max_severity int"


def units(text: str, at: int) -> int:
    """UTF-16 units before character at."""
    return at if text.isascii() else len(text[:at].encode("utf-16-le")) // 2


def as_dict(text: str, c: Found) -> dict:
    e = c.entry
    return {"lemma": e.lemma, "surface": text[c.start : c.end], "tier": c.tier, "language": e.language, "severity": e.severity, "categories": list(e.categories), "casual_use": e.casual_use, "start": units(text, c.start), "end": units(text, c.end), "char_start": c.start, "char_end": c.end}


#: Texts whose results are built at once; a batch of Arrow may hold thousands.
AT_ONCE = 256


def slices(batches: Iterator) -> Iterator:
    """Batches of series, or of tuples of them, in parts of at most AT_ONCE rows."""
    for batch in batches:
        size = len(batch[0] if isinstance(batch, tuple) else batch)
        for at in range(0, max(size, 1), AT_ONCE):
            part = lambda x, at=at: x.iloc[at : at + AT_ONCE]
            yield tuple(map(part, batch)) if isinstance(batch, tuple) else part(batch)


def in_parts() -> None:
    """Lets the active session hand texts to Python in small batches."""
    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def scan(col: Column | str, options: Options = Options()) -> Column:
    """struct<matches, max_severity> of a text column; one compiled lexicon per Python worker. Null: no matches."""
    in_parts()

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scan_one = scanner(options).scan
        for batch in slices(batches):
            found = [[as_dict(text, c) for c in scan_one(text)] for text in batch]
            yield pd.DataFrame({"matches": found, "max_severity": pd.array([max((m["severity"] for m in ms), default=None) for ms in found], dtype="Int32")})

    return run(F.col(col) if isinstance(col, str) else col)


def scan_each(text: Column, least: Column, mask: Column, keep_first: Column, hide: Column, languages: Column, options: Options = Options()) -> Column:
    """As scan, with arguments of each row, and `censored`: the text masked at these same matches where hide holds.

    Candidates of a severity under least go before overlaps are resolved, so they hide no others.
    languages (array, or null for all) choose the packs that the row's lexicon is compiled of. failed: the
    scan of a text broke off; the other rows go on.
    """
    in_parts()

    @F.pandas_udf(f"{RESULT}, censored string, failed boolean")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            found, censored, failed = [], [], []
            for x, low, m, first, wanted, codes in zip(*batch, strict=True):
                kept, hidden, broken = [], None, False
                try:
                    own = options if codes is None else replace(options, packs=tuple(p for p in options.packs if p.language in set(codes)))
                    kept = resolve([c for c in scanner(own).surviving(x) if c.entry.severity >= low]) if x else []
                    hidden = texts.censor_text(x, [(c.start, c.end) for c in kept], m, bool(first)) if wanted and x is not None else None
                except Exception:  # of one text; the answer says so
                    kept, broken = [], True
                found.append([as_dict(x, c) for c in kept])
                censored.append(hidden)
                failed.append(broken)
            yield pd.DataFrame({"matches": found, "max_severity": pd.array([max((m["severity"] for m in ms), default=None) for ms in found], dtype="Int32"), "censored": pd.Series(censored, dtype="object"), "failed": failed})

    return run(text, least, mask, keep_first, hide, languages)


def is_clean(col: Column | str, options: Options = Options()) -> Column:
    """Whether scan finds nothing; null texts are clean."""
    in_parts()

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = scanner(options).any
        for batch in batches:
            yield pd.Series([not found(text) for text in batch], dtype="bool")

    return run(F.col(col) if isinstance(col, str) else col)


def is_clean_each(col: Column | str, each: list[Options], narrowing: bool = False) -> Column:
    """is_clean for several options as one array, by one Python worker for all of them: columns of their own would have a worker each.

    narrowing: what one of the options finds, all before it find, so a text that is clean for one is clean for all after it.
    """
    in_parts()

    @F.pandas_udf("array<boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        founds = [scanner(options).any for options in each]
        for batch in batches:
            rows = []
            for text in batch:
                row: list[bool] = []
                for found in founds:
                    row.append(bool(narrowing and row and row[-1]) or not found(text))
                rows.append(row)
            yield pd.Series(rows, dtype="object")

    return run(F.col(col) if isinstance(col, str) else col)


def counted(col: Column | str, options: Options = Options()) -> Column:
    """struct<n, most>: how many matches scan finds and the highest severity, without the matches."""
    in_parts()

    @F.pandas_udf("n int, most int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scan_one = scanner(options).scan
        for batch in batches:
            found = [[c.entry.severity for c in scan_one(text)] for text in batch]
            yield pd.DataFrame({"n": pd.array([*map(len, found)], dtype="int32"), "most": pd.array([max(x, default=None) for x in found], dtype="Int32")})

    return run(F.col(col) if isinstance(col, str) else col)


def censor(col: Column | str, options: Options = Options(), mask: str = "*", keep_first: bool = False) -> Column:
    """The text with its matches masked, a mask for each grapheme cluster; null stays null."""
    if not mask:
        raise ValueError("mask is empty")
    in_parts()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan_one = scanner(options).scan
        for batch in slices(batches):
            yield pd.Series([None if text is None else texts.censor_text(text, [(c.start, c.end) for c in scan_one(text)], mask, keep_first) for text in batch], dtype="object")

    return run(F.col(col) if isinstance(col, str) else col)


def censor_spans(text: Column | str, spans: Column | str, mask: str = "*", keep_first: bool = False) -> Column:
    """The text with given spans (array of struct<start, end> in characters) masked."""

    @F.pandas_udf("string")
    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else texts.censor_text(x, [(s["start"], s["end"]) for s in (() if y is None else y)], mask, keep_first) for x, y in zip(text, spans, strict=True)], dtype="object")

    return run(text, spans)


def check(df: DataFrame, col: str = "text", options: Options = Options()) -> DataFrame:
    """df with clean, match_count, max_severity and the languages used; columns of df of these names are replaced.

    Null and empty texts are clean; repeated rows are checked each; an empty table gives an empty result.
    """
    if options.min_severity not in range(5):
        raise ValueError(f"min_severity {options.min_severity}")
    held = free(df, "scan_")
    found = df.withColumn(held, counted(col, options))
    languages = F.array(*[F.lit(p.language) for p in options.packs]).cast("array<string>")
    made = {"clean": F.col(f"{held}.n") == 0, "match_count": F.col(f"{held}.n"), "max_severity": F.col(f"{held}.most"), "languages": languages}
    return found.select(*[c for c in df.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def scan_rows(df: DataFrame, col: str = "text", options: Options = Options()) -> DataFrame:
    """A row per match: df's columns but the text, then the match's, which replace columns of df of the same names.

    Null and empty texts have no match; repeated rows repeat theirs; an empty table gives an empty result.
    """
    held = free(df, "m_")
    rows = df.withColumn(held, F.explode(scan(col, options)["matches"]))
    fields = rows.schema[held].dataType.names
    return rows.select(*[c for c in df.columns if c != col and c not in fields], f"{held}.*")


def for_languages(codes: list[str] | None, packs=PACKS, **more) -> Options:
    """Options of the packs of these languages, in loading order whatever the order asked for; unknown codes are refused."""
    unknown = set(codes or ()) - {p.language for p in packs}
    if unknown:
        raise ValueError(f"no such language: {', '.join(sorted(unknown))}")
    return Options(packs=tuple(p for p in packs if codes is None or p.language in codes), **more)


def register(spark: SparkSession, options: Options = Options()) -> None:
    """SQL functions scan, is_clean, censor, skeleton_key, base_fold, latin_fold and the table function scan_rows."""

    def one(fn, kind):
        @F.pandas_udf(kind)
        def run(batch: pd.Series) -> pd.Series:
            return batch.map(fn, na_action="ignore")

        return run

    @F.pandas_udf(RESULT)
    def scan_sql(batch: pd.Series) -> pd.DataFrame:
        found = [[as_dict(text, c) for c in scanner(options).scan(text)] for text in batch]
        return pd.DataFrame({"matches": found, "max_severity": pd.array([max((m["severity"] for m in ms), default=None) for ms in found], dtype="Int32")})

    spark.udf.register("scan", scan_sql)
    spark.udf.register("is_clean", one(lambda x: not scanner(options).any(x), "boolean"))
    spark.udf.register("censor", one(lambda x: texts.censor_text(x, [(c.start, c.end) for c in scanner(options).scan(x)]), "string"))
    for name in ("skeleton_key", "base_fold", "latin_fold"):
        spark.udf.register(name, one(getattr(texts, name), "string"))

    @F.udtf(returnType="lemma string, surface string, tier string, severity int, char_start int, char_end int")
    class Rows:
        def eval(self, text: str):
            for c in scanner(options).scan(text):
                yield c.entry.lemma, text[c.start : c.end], c.tier, c.entry.severity, c.start, c.end

    spark.udtf.register("scan_rows", Rows)
