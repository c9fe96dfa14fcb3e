"""The tiers as relational plans: tokens joined to small lexicon tables, vetoes, merging, overlaps.

They hold for texts whose base fold is lower case alone; the kernel covers the rest. No join is
hinted: the engine broadcasts a lexicon whose size it knows to be under its threshold, and above
that shuffles both sides by key, splitting what frequent tokens make large. All joins are on equal
keys, so a lexicon of any size is looked up, never looked through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c

SPAN = "struct<s:int,e:int,r:int,v:int,o:int>"


def tokens(df: DataFrame, text_col: str = "text", pattern: str = c.WORD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per token: keep, pos (from 0), token in lower case."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), F.lit(0))
    return df.select(*keep, F.posexplode(found).alias("pos", "token"))


def token_hits(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Tokens equal to a one-word form: words' columns and the entry's, which replace columns of words of the same names."""
    entries = forms.where("grams = 1").withColumnRenamed("form", "token")
    return words.drop(*[c for c in entries.columns if c != "token"]).join(entries, "token")


def phrase_hits(df: DataFrame, forms: DataFrame, grams: int, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs of `grams` words, one space apart, equal to a form; made within the row, without a shuffle."""
    words = F.col("words")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - grams + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(grams)), " ")), lambda x: x != "")
    run = df.select(*keep, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{M}\p{N} ]+|  +")).alias("part"))
    run = run.select(*keep, F.filter(F.split("part", " "), lambda x: x != "").alias("words"))
    return run.select(*keep, F.explode(pairs).alias("form")).join(forms.where(F.col("grams") == grams), "form")


def lengths(table: DataFrame, column: str) -> Column:
    """The distinct lengths of a lexicon table as an array literal; the readers bound the table."""
    return F.array(*[F.lit(r[0]) for r in table.select(column).distinct().orderBy(column).collect()]).cast("array<int>")


def prefix_hits(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Tokens that start with a form of prefix mode; joined on the form's length of first characters."""
    stems = forms.where("match_mode = 'prefix' and grams = 1")
    cut = words.withColumn("form_len", F.explode(F.filter(lengths(stems, "form_len"), lambda n: n <= F.length("token"))))
    return cut.withColumn("form", F.substr("token", F.lit(1), F.col("form_len"))).join(stems, ["form", "form_len"])


def collapsed_hits(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Stretched tokens (a run of three, or a doubled first letter) that collapse to a form without doubles."""
    stretched = words.where(F.col("token").rlike(r"(?s)(.)\1\1") | F.col("token").rlike(r"(?s)^(.)\1")).withColumn("form", c.collapse_all(F.col("token")))
    stable = forms.where((F.col("grams") == 1) & (c.collapse_all(F.col("form")) == F.col("form")))
    return stretched.join(stable, "form")


def best(hits: DataFrame, by: list[str]) -> DataFrame:
    """Of the entries that a token fits, the severest, of equals the first loaded."""
    entry = F.struct("severity", (-F.col("load_order")).alias("first"), "lemma", "language")
    return hits.groupBy(*by).agg(F.max(entry).alias("best")).select(*by, "best.lemma", "best.language", "best.severity")


#: Letters by how often texts have them, the most frequent first.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def letter_pairs(forms: DataFrame) -> DataFrame:
    """forms of one word with `pair`, a row for each two of their letters: the length, both places and both letters."""
    letters = F.transform(F.split("form", ""), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    made = forms.where("grams = 1").select("*", F.posexplode(letters).alias("first_", "one_"))
    made = made.select("*", F.explode(F.slice(letters, F.col("first_") + 2, F.greatest(F.size(letters) - F.col("first_") - 1, F.lit(0)))).alias("two_"))
    return made.withColumn("pair", F.concat_ws(" ", "form_len", "one_.i", "one_.x", "two_.i", "two_.x")).drop("first_", "one_", "two_")


def wildcards(words: DataFrame, forms: DataFrame, hidden: str) -> DataFrame:
    """Tokens and the forms that they fit where a character of `hidden` stands for any letter.

    A token is looked up by its two rarest letters that are seen, with their places: an equi-join whose
    matches don't grow with the lexicon but by the forms alike in both. Tokens see two letters at least.
    """
    seen = F.filter(F.transform(F.split("token", ""), lambda x, i: F.struct(F.when(F.instr(F.lit(FREQUENT), x) == 0, -99).otherwise(-F.instr(F.lit(FREQUENT), x)).alias("rare"), i.alias("i"), x.alias("x"))), lambda z: F.instr(F.lit(hidden), z["x"]) == 0)
    two = F.sort_array(F.transform(F.slice(F.array_sort(seen), 1, 2), lambda z: F.struct(z["i"], z["x"])))
    keyed = words.withColumn("two_", two).withColumn("pair", F.concat_ws(" ", F.length("token"), F.col("two_")[0]["i"], F.col("two_")[0]["x"], F.col("two_")[1]["i"], F.col("two_")[1]["x"])).drop("two_")
    fits = F.expr(f"form like regexp_replace(token, '[{hidden}]', '_')")
    return keyed.join(letter_pairs(forms), "pair").where(fits).drop("pair")


def masked_hits(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Tokens with one to three masks inside that fit a form of their length."""
    masks = F.length("token") - F.length(F.translate("token", "*#@$%", ""))
    fair = words.where(masks.between(1, 3) & ~F.col("token").rlike(r"^[*#@$%]|[*#@$%]$") & (F.length("token") - masks >= 2))
    return best(wildcards(fair, forms, "*#@$%"), [*words.columns])


def digit_masked_hits(words: DataFrame, forms: DataFrame) -> DataFrame:
    """As masked_hits, with digits as masks: at most two, never last, first only with another one."""
    masks = F.length("token") - F.length(F.translate("token", "*#@$%0123456789", ""))
    fair = words.where(F.col("token").rlike("[0-9]") & (F.length("token") >= 4) & masks.between(1, 2) & ~F.col("token").rlike(r"[*#@$%0-9]$|^[*#@$%]") & (~F.col("token").rlike("^[0-9]") | (masks == 2)))
    fair = fair.where(F.length(F.regexp_replace("token", r"\P{L}", "")) >= 2)
    return best(wildcards(fair, forms, "*#@$%0123456789"), [*words.columns])


def tagged_parts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Parts, in lower case, of #CamelCase and @CamelCase tokens of the original text."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![\p{L}\p{M}\p{N}])[#@]([\p{L}\p{N}_]+)"), F.lit(1))
    parts = df.select(*keep, F.explode(found).alias("tag")).withColumn("parts", F.split("tag", r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"))
    return parts.where(F.size("parts") > 1).select(*keep, "tag", F.explode(F.transform("parts", lambda x: F.lower(x))).alias("token")).where(F.length("token") >= 3)


def spelled_words(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words of four letters or more written with one separator between each two letters."""
    run = r"(?<![\p{L}\p{M}\p{N}])\p{L}(?:[ \t.\-_\n/]\p{L}(?![\p{L}\p{M}\p{N}])){3,}"
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(run), F.lit(0))
    return df.select(*keep, F.explode(found).alias("run")).withColumn("token", F.regexp_replace("run", r"[ \t.\-_\n/]", ""))


def chunked_words(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words written as two to four pieces of up to five letters bound by dots or hyphens, whole runs only."""
    run = r"(?<![\p{L}\p{M}\p{N}][.\-]|[\p{L}\p{M}\p{N}])\p{L}{1,5}(?:[.\-]\p{L}{1,5}){1,3}(?![\p{L}\p{M}\p{N}]|[.\-][\p{L}\p{M}\p{N}])"
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(run), F.lit(0))
    rows = df.select(*keep, F.explode(found).alias("run")).withColumn("token", F.regexp_replace("run", r"[.\-]", ""))
    return rows.where((F.length("token") >= 4) & F.col("run").rlike(r"\p{L}\p{L}"))


def sound_hits(words: DataFrame, keys: DataFrame) -> DataFrame:
    """Tokens whose sound begins with a key and has at most three letters after it. Each distinct token sounds once."""
    sounded = words.select("token").distinct().withColumn("sound", c.skeleton_key(F.col("token")))
    over = F.length("sound")
    fits = F.filter(lengths(keys, "key_len"), lambda n: (n <= over) & (over - n <= 3))
    cut = sounded.withColumn("key_len", F.explode(fits)).withColumn("key", F.substr("sound", F.lit(1), F.col("key_len")))
    return words.join(cut.join(keys, ["key", "key_len"]), "token")


def spans(df: DataFrame, text_col: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Where the matches of a pattern lie: keep (which names a row), token, start, end in characters of the lower-case text."""
    lower = F.lower(F.col(text_col))
    found, between = F.regexp_extract_all(lower, F.lit(pattern), F.lit(0)), F.split(lower, pattern)
    # the match after gap i starts where all gaps and matches before it end: a running sum over the row's own pieces
    # a running sum over the row's own pieces, within the row
    rows = df.select(*keep, found.alias("found"), between.alias("between")).where(F.size("found") > 0)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        at = state["end"] + F.length(p["between"])
        end = at + F.length(p["found"])
        return F.struct(end.alias("end"), F.concat(state["out"], F.array(F.struct(p["found"].alias("token"), at.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.arrays_zip(F.slice("between", F.lit(1), F.size("found")).alias("between"), F.col("found"))
    return rows.select(*keep, F.inline(F.aggregate(pairs, start, step)["out"]))


def veto(found: DataFrame, allowed: DataFrame, by: list[str]) -> DataFrame:
    """Matches not inside an allowed span of the same document: one pass in order of the starts, with the furthest end of
    the allowed spans so far. Rows with a null in `by` are of one document.
    """
    rows = found.select(*[F.col(k).alias(f"by{i}") for i, k in enumerate(by)], F.col("start").alias("start_"), F.lit(1).alias("kind_"), F.lit(None).cast("int").alias("reach_"), F.col("end").alias("end_"), F.struct(*found.columns).alias("row_"))
    spans = allowed.select(*[F.col(k).alias(f"by{i}") for i, k in enumerate(by)], F.col("start").alias("start_"), F.lit(0).alias("kind_"), F.col("end").cast("int").alias("reach_"), F.lit(None).cast("int").alias("end_"), F.lit(None).cast(rows.schema["row_"].dataType).alias("row_"))
    order = Window.partitionBy(*[f"by{i}" for i in range(len(by))]).orderBy("start_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.union(spans).withColumn("cover_", F.max("reach_").over(order)).where("kind_ = 1 and (cover_ is null or cover_ < end_)")
    return out.select("row_.*")


def merge_entries(hits: DataFrame, by: list[str]) -> DataFrame:
    """Entries of one lemma in one place as one: the highest severity and its language, all categories in order, casual only if all are."""
    row = F.struct((-F.col("severity")).alias("weak"), "load_order", "language", "severity", "categories", "casual_use")
    out = hits.groupBy(*by, "lemma").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select(*by, "lemma", F.col("rows")[0]["language"].alias("language"), F.col("rows")[0]["severity"].alias("severity"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["categories"]))).alias("categories"), F.forall("rows", lambda r: r["casual_use"]).alias("casual_use"))


def resolve(candidates: Column) -> Column:
    """Overlaps among array<struct<s,e,r,v,o>> (start, end, rank, severity, order) of one text, kept ones by start.

    Candidates in order of (start, longer, order) are kept, or replace the kept one that they overlap
    where (rank, severity, length) is higher. All kept before the last one end where it starts or before, so
    a candidate is held against the last alone.
    """
    ordered = F.array_sort(candidates, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["e"] != b["e"], b["e"] - a["e"]).otherwise(a["o"] - b["o"]))
    weight = lambda x: F.struct(x["r"], x["v"], x["e"] - x["s"])
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, n: Column) -> Column:
        last = F.get(state["last"], F.lit(0))
        apart = last.isNull() | (last["e"] <= n["s"])
        better = F.when(apart | (weight(n) > weight(last)), F.array(n)).otherwise(state["last"])
        return F.struct(F.when(apart, F.concat(state["kept"], state["last"])).otherwise(state["kept"]).alias("kept"), better.alias("last"))

    return F.aggregate(ordered, F.struct(none.alias("kept"), none.alias("last")), step, lambda state: F.concat(state["kept"], state["last"]))
