"""Line-first quality rules in DataFrame functions only: failing lines go, then documents that lose too much."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAKS

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture and notices in four languages, matched in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "copyright ©", "enable javascript", "licensed under", "log in", "newsletter", "privacy policy", "read more", "released under the",
    "share this", "sign in", "sign up", "skip to content", "subscribe now", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "impressum", "jetzt abonnieren", "nutzungsbedingungen", "weiterlesen",
    "accepter les cookies", "cliquez ici", "conditions générales", "lire la suite", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "aviso legal", "haga clic aquí", "iniciar sesión", "leer más", "política de privacidad", "todos los derechos reservados",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; a line fails if one rule does."""

    #: Separators (| » > • ·) standing alone, per 100 words of the line, and at least.
    nav_percent: int = 25
    nav_least: int = 2
    #: Words with runs of marks (!! ## %%) at their end or symbols in them, per 100 words, and at least.
    marks_percent: int = 30
    marks_least: int = 2
    #: A line of more words than this needs a sentence end somewhere.
    unpunctuated_words: int = 40
    #: Boilerplate counts in lines of up to this many words; in longer ones it is part of prose.
    boilerplate_words: int = 25
    #: The document goes if its failing lines hold more than this percentage of its words.
    lost_percent: int = 40


def count_of(text: Column, pattern: str) -> Column:
    """Matches of a Java pattern, counted without making them into strings."""
    return F.regexp_count(text, F.lit(pattern))


def line_stats(lines: Column, rules: LineRules) -> Column:
    """Of each line: the line, its words, and whether it fails. A rule looks at lines of its length only."""
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), count_of(x, r"[^ \t-\r]+").alias("words")))

    def fails(s: Column) -> Column:
        line, words = s["line"], s["words"]
        bars, marks = count_of(line, r"(?<![^ \t-\r])[|»>•·](?![^ \t-\r])"), count_of(line, r"(?:[!?#*$%&]{2,}|[#*$%&<>])(?=[ \t-\r]|$)")
        nav = line.rlike("[|»>•·]") & (bars >= rules.nav_least) & (bars * 100 >= words * rules.nav_percent)
        noisy = line.rlike("[!?#*$%&<>]") & (marks >= rules.marks_least) & (marks * 100 >= words * rules.marks_percent)
        bare = (words > rules.unpunctuated_words) & ~line.rlike(r"[.!?…。！？:;][\"'”’»)\]]*(?:[ \t-\r]|$)")
        boiler = (words <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
        return nav | noisy | bare | boiler

    return F.transform(counted, lambda s: F.struct(s["line"].alias("line"), s["words"].alias("words"), fails(s).alias("fails")))


def clean_lines(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds clean_text (the lines that pass, joined by \\n), lost_words and line_words (long), which replace columns of those names.

    Lines without words pass. Null text: null clean_text, 0 words. Every line of the whole text
    is judged; rows are independent of each other, an empty table gives an empty one.
    """
    made = ("clean_text", "lost_words", "line_words")
    kept = [c for c in df.columns if c not in made]
    # all of df's columns in one, so that no name of theirs can clash
    rows = df.select(F.struct(*[F.col(c) for c in kept]).alias("row"), line_stats(F.split(F.col(text_col), "\n"), rules).alias("lines"))
    words = lambda test: F.coalesce(F.aggregate("lines", F.lit(0).cast("bigint"), lambda t, s: t + F.when(test(s), s["words"]).otherwise(0)), F.lit(0).cast("bigint"))
    clean = F.array_join(F.transform(F.filter("lines", lambda s: ~s["fails"]), lambda s: s["line"]), "\n")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], clean.alias("clean_text"), words(lambda s: s["fails"]).alias("lost_words"), words(lambda s: F.lit(True)).alias("line_words"))


def repeated_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Adds the number of words that lie in 3-word windows found twice or more in the row's words.

    Windows become numbers of a hash above and the position below, in as many bits as the row
    needs, so that one sort of longs brings equal windows together; neighbours of equal hash are
    compared word by word, and where those differ, all windows of that hash are.
    """
    w = F.col(words_col)
    bits = F.length(F.bin(F.size(w)))
    made = df.withColumn("bits_", bits)
    window_hash = "transform(sequence(0, size({w}) - 3), i -> shiftleft(shiftright(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), bits_), bits_) | cast(i as bigint))"
    made = made.withColumn("coded_", F.expr(f"if(size({words_col}) < 4, cast(array() as array<bigint>), {window_hash.format(w=words_col)})"))
    made = made.withColumn("coded_", F.sort_array("coded_"))
    made = made.withColumn("mask_", F.expr("shiftleft(1L, bits_) - 1"))
    near = "(shiftright(get(coded_, {j}), bits_) = shiftright(x, bits_) and {same})"
    same = " and ".join(f"get({words_col}, cast(get(coded_, {{j}}) & mask_ as int) + {d}) = get({words_col}, cast(x & mask_ as int) + {d})" for d in range(3))
    either = " or ".join(f"coalesce({near.format(j=j, same=same.format(j=j))}, false)" for j in ("i - 1", "i + 1"))
    alike = " and ".join(f"get({words_col}, cast(y & mask_ as int) + {d}) = get({words_col}, cast(x & mask_ as int) + {d})" for d in range(3))
    beside = " or ".join(f"coalesce(shiftright(get(coded_, {j}), bits_) = shiftright(x, bits_), false)" for j in ("i - 1", "i + 1"))
    any_ = f"({beside}) and exists(coded_, y -> y <> x and shiftright(y, bits_) = shiftright(x, bits_) and {alike})"
    made = made.withColumn("at_", F.expr(f"filter(coded_, (x, i) -> {either} or ({any_}))"))
    made = made.withColumn("at_", F.sort_array(F.expr("transform(at_, x -> x & mask_)")))
    covered = F.expr("aggregate(transform(at_, (x, i) -> least(3L, coalesce(get(at_, i + 1) - x, 3L))), 0L, (t, x) -> t + x)")
    return made.withColumn(out, covered).drop("bits_", "coded_", "mask_", "at_")


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Word and line counts of every whole text and the verdict of the line rules.

    Result, a row per row of df: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed (fewer than 50 words, or over half of them in repeated
    3-word windows), kept (false if base_failed; else whether the failing lines hold at most
    rules.lost_percent of the words), lost_words (long), clean_text (the lines that pass). Null texts have no words and fail.
    Rows are independent: repeated rows give repeated results, an empty table an empty one.
    """
    text = F.coalesce(F.col("q_text"), F.lit(""))
    base = df.select(F.col(id_col).alias("q_id"), F.col(text_col).cast("string").alias("q_text"))
    base = base.select(
        "q_id",
        "q_text",
        F.array_remove(F.split(text, BREAKS), "").alias("q_words"),
        F.length(F.regexp_replace(text, BREAKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("q_lines"),
    )
    base = base.select("q_id", "q_text", "q_words", "word_chars", "n_symbols", F.size("q_words").cast("bigint").alias("n_words"), (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint").alias("n_dup_lines"))
    base = repeated_words(base, "q_words", "n_repeat_words").drop("q_words")
    judged = clean_lines(base, "q_text", rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~failed & (100 * F.col("lost_words") <= rules.lost_percent * F.col("line_words")))
    return judged.select(F.col("q_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "clean_text")


def oracle(rules: LineRules = LineRules(), docs: str = "documents") -> str:
    """DuckDB SQL of quality_report over documents."""
    phrases = "|".join(BOILERPLATE)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, text IS NOT NULL AS known FROM {docs}),
w AS (SELECT rid, doc_id, text, known, regexp_extract_all(text, '[^ \t-\r]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + d)::BIGINT AS n FROM rep, generate_series(0, 2) x(d) GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS li FROM w),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY rid),
s AS (SELECT rid, line, li, len(regexp_extract_all(line, '[^ \t-\r]+')) AS words,
  len(list_filter(regexp_extract_all(line, '[^ \t-\r]+'), lambda x: regexp_full_match(x, '[|»>•·]'))) AS bars,
  len(list_filter(regexp_extract_all(line, '[^ \t-\r]+'), lambda x: regexp_matches(x, '[!?#*$%&]{{2,}}$|[#*$%&<>]$'))) AS marks,
  regexp_matches(line, '[.!?…。！？:;]["''”’»)\]]*([ \t-\r]|$)') AS ends,
  regexp_matches(lower(line), '{phrases}') AS boiler FROM l),
v AS (SELECT rid, line, li, words, (bars >= {rules.nav_least} AND bars * 100 >= words * {rules.nav_percent}) OR (marks >= {rules.marks_least} AND marks * 100 >= words * {rules.marks_percent})
  OR (NOT ends AND words > {rules.unpunctuated_words}) OR (boiler AND words <= {rules.boilerplate_words}) AS bad FROM s),
lost AS (SELECT rid, sum(words)::BIGINT AS line_words, coalesce(sum(words) FILTER (bad), 0)::BIGINT AS lost_words, coalesce(string_agg(line, chr(10) ORDER BY li) FILTER (NOT bad), '') AS clean_text FROM v GROUP BY rid),
r AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, line_words, lost_words, CASE WHEN known THEN clean_text END AS clean_text FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= {rules.lost_percent} * line_words AS kept, lost_words, clean_text FROM r
"""
