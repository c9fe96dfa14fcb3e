"""A query for each operator, and DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import evade, texts
from ..functions import tables as t
from ..operators import moderation, native
from ..sources import lexicon
from ..sources.lexicon import Options
from ..sources.tables import dealt, read, small_batches
from ..streaming import messages
from . import relational as r
from . import reports, scan_sql
from .scan_sql import ACCENTS, LETTERS, W, doubled, sound_sql, values

DEFAULT = Options()
#: Words that get hidden in texts before they are looked for; all are terms of the default lexicon.
WORD = "thing"
MASKED_TOKEN = r"[\p{L}\p{M}*#@$%]+"
DIGIT_TOKEN = r"[\p{L}\p{M}\p{N}*#@$%]+"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def whole_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What the kernel reads: ids and texts, in parts whose size doesn't grow with the table."""
    return dealt(spark, sf, "documents", ["doc_id", "text"])


def form_rows(options: Options = DEFAULT) -> list[tuple]:
    return [(f, len(f), f.count(" ") + 1, e.lemma, e.language, e.severity, e.categories, e.match_mode, e.casual_use, e.load_order) for f, entries in options.exact.items() for e in dict.fromkeys(entries)]


FORMS = values("forms", "form, form_len, grams, lemma, language, severity, categories, match_mode, casual_use, load_order", form_rows())
KEYS = values("keys", "key, key_len, lemma, severity", [(k, len(k), e.lemma, e.severity) for k, e in DEFAULT.sounds.items()])
TOKENS = rf"words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM documents)"
HITS = f"hits AS (SELECT w.doc_id, f.* FROM words w JOIN forms f ON f.form = w.token AND f.grams = 1)"
BEST = "first_value(lemma) OVER k AS lemma, first_value(severity) OVER k AS severity"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return r.token_hits(r.tokens(docs(spark, sf)), lexicon.form_table(spark))


# --- dictionary joins -------------------------------------------------------------------------


@query(f"WITH {FORMS}, {TOKENS}, {HITS} SELECT doc_id, lemma, language, count(*) AS n FROM hits GROUP BY ALL")
def token_hits(spark, sf):
    return hits(spark, sf).groupBy("doc_id", "lemma", "language").agg(F.count("*").alias("n"))


@query(f"WITH {FORMS}, {TOKENS}, {HITS} SELECT d.doc_id, max(severity) AS max_severity, count(lemma) AS match_count, count(lemma) = 0 AS clean FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id")
def doc_severity(spark, sf):
    found = hits(spark, sf).groupBy("doc_id").agg(F.max("severity").alias("max_severity"), F.count("*").alias("match_count"))
    return docs(spark, sf).select("doc_id").join(found, "doc_id", "left").select("doc_id", "max_severity", F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"), F.isnull("match_count").alias("clean"))


@query(f"WITH {FORMS}, {TOKENS}, {HITS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)")
def clean_documents(spark, sf):
    return docs(spark, sf).select("doc_id").join(hits(spark, sf), "doc_id", "left_anti")


@query(f"WITH {FORMS}, {TOKENS}, {HITS} SELECT doc_id, lemma, count(*) AS n FROM hits WHERE severity >= 3 GROUP BY ALL")
def min_severity_filter(spark, sf):
    return hits(spark, sf).where("severity >= 3").groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


@query(f"WITH {FORMS}, {TOKENS}, {HITS} SELECT doc_id, lemma, count(*) AS n FROM hits WHERE list_has_any(categories, ['gendered', 'slur']) GROUP BY ALL")
def category_filter(spark, sf):
    return hits(spark, sf).where(F.arrays_overlap("categories", F.array(F.lit("gendered"), F.lit("slur")))).groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


@query(rf"""WITH {FORMS}, parts AS (SELECT doc_id, list_filter(string_split(unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}} ]+|  +')), ' '), lambda x: x <> '') AS ws FROM documents),
pairs AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS form FROM (SELECT *, unnest(generate_series(1, len(ws) - 1)) AS i FROM parts WHERE len(ws) > 1))
SELECT doc_id, lemma, count(*) AS n FROM pairs JOIN forms USING (form) WHERE grams = 2 GROUP BY ALL""")
def phrase_hits(spark, sf):
    return r.phrase_hits(docs(spark, sf), lexicon.form_table(spark), 2).groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


@query(f"WITH {FORMS}, {TOKENS} SELECT doc_id, token, lemma, count(*) AS n FROM words JOIN forms ON match_mode = 'prefix' AND starts_with(token, form) GROUP BY ALL")
def prefix_hits(spark, sf):
    return r.prefix_hits(r.tokens(docs(spark, sf)), lexicon.form_table(spark)).groupBy("doc_id", "token", "lemma").agg(F.count("*").alias("n"))


STRETCHED = "concat('thi', repeat('n', 2 + cast(doc_id % 4 as int)), 'g')"


TRIPLE = "|".join(x * 3 for x in LETTERS)


@query(rf"""WITH {FORMS}, stretched AS (SELECT doc_id, regexp_replace(text, '\b{WORD}\b', 'thi' || repeat('n', (2 + doc_id % 4)::INT) || 'g', 'g') AS text FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM stretched),
wide AS (SELECT doc_id, token, {doubled('token', 1)} AS single FROM words WHERE regexp_matches(token, '{TRIPLE}') OR substr(token, 1, 1) = substr(token, 2, 1))
SELECT doc_id, lemma, count(*) AS n FROM wide JOIN forms ON form = single AND grams = 1 AND {doubled('form', 1)} = form GROUP BY ALL""")
def collapsed_hits(spark, sf):
    put = docs(spark, sf).withColumn("text", F.regexp_replace("text", F.lit(rf"\b{WORD}\b"), F.expr(STRETCHED)))
    return r.collapsed_hits(r.tokens(put), lexicon.form_table(spark)).groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


def masked_sql(pattern: str, put: str, test: str, marks: str) -> str:
    return rf"""WITH {FORMS}, hidden AS (SELECT doc_id, regexp_replace(text, '\b{WORD}\b', '{put}', 'g') AS text FROM documents),
words AS (SELECT doc_id, row_number() OVER () AS pos, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{pattern}')) AS token FROM hidden)),
fair AS (SELECT *, len(regexp_extract_all(token, '[{marks}]')) AS k FROM words WHERE regexp_matches(token, '[{marks}]')),
fits AS (SELECT w.doc_id, w.pos, w.token, f.lemma, f.severity, row_number() OVER (PARTITION BY w.pos ORDER BY f.severity DESC, f.load_order) AS b
  FROM fair w JOIN forms f ON f.grams = 1 AND f.form_len = length(w.token) AND f.form LIKE regexp_replace(w.token, '[{marks}]', '_', 'g') WHERE {test})
SELECT doc_id, token, lemma, severity, count(*) AS n FROM fits WHERE b = 1 GROUP BY ALL"""


@query(masked_sql(MASKED_TOKEN, "th*ng", "k BETWEEN 1 AND 3 AND NOT regexp_matches(token, '^[*#@$%]|[*#@$%]$') AND length(token) - k >= 2", "*#@$%"))
def masked_hits(spark, sf):
    put = docs(spark, sf).withColumn("text", F.regexp_replace("text", rf"\b{WORD}\b", "th*ng"))
    return r.masked_hits(r.tokens(put, pattern=MASKED_TOKEN), lexicon.form_table(spark)).groupBy("doc_id", "token", "lemma", "severity").agg(F.count("*").alias("n"))


@query(masked_sql(DIGIT_TOKEN, "th8ng", r"length(token) >= 4 AND k BETWEEN 1 AND 2 AND regexp_matches(token, '[0-9]') AND NOT regexp_matches(token, '[*#@$%0-9]$|^[*#@$%]') AND (NOT regexp_matches(token, '^[0-9]') OR k = 2) AND length(regexp_replace(token, '\P{L}', '', 'g')) >= 2", "*#@$%0-9"))
def digit_masked_hits(spark, sf):
    put = docs(spark, sf).withColumn("text", F.regexp_replace("text", rf"\b{WORD}\b", "th8ng"))
    return r.digit_masked_hits(r.tokens(put, pattern=DIGIT_TOKEN), lexicon.form_table(spark)).groupBy("doc_id", "token", "lemma", "severity").agg(F.count("*").alias("n"))


@query(rf"WITH {FORMS}, tagged AS (SELECT doc_id, len(regexp_extract_all(text, '\b{WORD}\b')) AS n FROM documents) SELECT doc_id, lemma, language, n FROM tagged JOIN forms ON form = '{WORD}' WHERE n > 0")
def tagged_hits(spark, sf):
    put = docs(spark, sf).withColumn("text", F.regexp_replace("text", rf"\b{WORD}\b", ".#SoThing."))
    return r.token_hits(r.tagged_parts(put), lexicon.form_table(spark)).groupBy("doc_id", "lemma", "language").agg(F.count("*").alias("n"))


def islands_sql(put: str, one: str, seam: str, fair: str) -> str:
    """Runs of words with one separator between each two, as whole words; one: which words take part."""
    return rf"""WITH {FORMS}, hidden AS (SELECT row_number() OVER () AS rid, doc_id, lower(regexp_replace(text, '\b{WORD}\b', '{put}', 'g')) AS l FROM documents),
cut AS (SELECT rid, doc_id, regexp_extract_all(l, '{W}') AS ts, regexp_split_to_array(l, '{W}') AS gs FROM hidden),
parted AS (SELECT rid, doc_id, i, ts[i] AS token, gs[i] AS gap FROM (SELECT *, unnest(generate_series(1, len(ts))) AS i FROM cut)),
marked AS (SELECT *, {one} AS part, coalesce(lag(i) OVER o = i - 1 AND regexp_full_match(gap, '{seam}'), false) AS tied, lag({one}) OVER o AS before FROM parted WINDOW o AS (PARTITION BY rid ORDER BY i)),
runs AS (SELECT *, sum(CASE WHEN tied AND part = before THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked),
whole AS (SELECT rid, doc_id, run, string_agg(token, '' ORDER BY i) AS token, count(*) AS pieces, max(length(token)) AS longest, bool_and(part) AS part FROM runs GROUP BY rid, doc_id, run)
SELECT doc_id, lemma, language, count(*) AS n FROM whole w JOIN forms f ON f.form = w.token AND f.grams = 1 WHERE w.part AND {fair} GROUP BY ALL"""


@query(islands_sql(", t.h.i.n.g ,", r"regexp_full_match(token, '\p{L}')", r"[ \t.\-_\n/]", "pieces >= 4"))
def spelled_hits(spark, sf):
    put = docs(spark, sf).withColumn("text", F.regexp_replace("text", rf"\b{WORD}\b", ", t.h.i.n.g ,"))
    return r.token_hits(r.spelled_words(put), lexicon.form_table(spark)).groupBy("doc_id", "lemma", "language").agg(F.count("*").alias("n"))


# a run of words bound by dots or hyphens is taken whole, so its longer words take part too and rule it out
@query(islands_sql(", th-ing ,", "true", r"[.\-]", r"pieces BETWEEN 2 AND 4 AND longest BETWEEN 2 AND 5 AND length(w.token) >= 4 AND regexp_full_match(w.token, '\p{L}+')"))
def chunked_hits(spark, sf):
    put = docs(spark, sf).withColumn("text", F.regexp_replace("text", rf"\b{WORD}\b", ", th-ing ,"))
    return r.token_hits(r.chunked_words(put), lexicon.form_table(spark)).groupBy("doc_id", "lemma", "language").agg(F.count("*").alias("n"))


@query(f"WITH {KEYS}, {TOKENS}, sounded AS (SELECT doc_id, token, {sound_sql('token')} AS sound FROM words) SELECT doc_id, token, lemma, count(*) AS n FROM sounded JOIN keys ON starts_with(sound, key) AND length(sound) - key_len <= 3 GROUP BY ALL")
def sound_hits(spark, sf):
    return r.sound_hits(r.tokens(docs(spark, sf)), lexicon.key_table(spark)).groupBy("doc_id", "token", "lemma").agg(F.count("*").alias("n"))


SPOKEN = [(w, e.lemma, e.severity, e.load_order) for e in DEFAULT.entries if e.skeleton_safe for w in e.romanizations if " " not in w]


@query("WITH " + values("spoken", "word, lemma, severity, load_order", SPOKEN) + f", keyed AS (SELECT {sound_sql('word')} AS key, * FROM spoken), best AS (SELECT key, first(lemma ORDER BY severity DESC, load_order) AS lemma, max(severity) AS severity FROM keyed WHERE length(key) >= 4 GROUP BY key)" + f", {TOKENS}, said AS (SELECT {sound_sql('token')} AS key, count(*) AS n FROM (SELECT DISTINCT token FROM words) GROUP BY 1) SELECT key, lemma, severity, coalesce(n, 0) AS words FROM best LEFT JOIN said USING (key)")
def best_per_key(spark, sf):
    """The severest entry of each sound, and how many distinct words of the documents sound just so."""
    spoken = spark.createDataFrame(SPOKEN, "word string, lemma string, severity int, load_order int")
    keys = spoken.withColumn("key", c.skeleton_key(F.col("word"))).where("length(key) >= 4")
    said = r.tokens(docs(spark, sf)).select("token").distinct().groupBy(c.skeleton_key(F.col("token")).alias("key")).agg(F.count("*").alias("words"))
    return keys.groupBy("key").agg(F.max(F.struct("severity", (-F.col("load_order")).alias("first"), "lemma")).alias("b")).select("key", "b.lemma", "b.severity").join(said, "key", "left").withColumn("words", F.coalesce("words", F.lit(0)))


@query(rf"WITH {FORMS}, shown AS (SELECT doc_id, len(regexp_extract_all(text, '\b{WORD}\b')) AS n FROM documents) SELECT doc_id, '{WORD}' AS surface, n FROM shown WHERE n > 0")
def picture_hits(spark, sf):
    """Emoji inside a word, by the kernel."""
    put = whole_texts(spark, sf).withColumn("text", F.regexp_replace("text", rf"\b{WORD}\b", ", th\U0001f525ing ,"))
    found = moderation.scan_rows(put, options=Options(custom_words=())).where("tier = 'masked' and surface like '%\U0001f525%'")
    return found.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(WORD).alias("surface"), "n")


# --- vetoes, merging, overlaps, spans ---------------------------------------------------------

#: The one-word forms as whole words.
ONE_OF = r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(f for f in DEFAULT.exact if " " not in f) + r")(?![\p{L}\p{M}\p{N}])"
SPANS_SQL = rf"""placed AS (SELECT doc_id, lower(text) AS l, regexp_extract_all(lower(text), '{W}') AS ts, regexp_split_to_array(lower(text), '{W}') AS gs FROM documents),
spans AS (SELECT doc_id, ts[i] AS token, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ts[1:i - 1], lambda x: length(x))), 0))::INT AS start FROM (SELECT *, unnest(generate_series(1, len(ts))) AS i FROM placed))"""


@query(f"WITH {FORMS}, {SPANS_SQL} SELECT doc_id, token, start, (start + length(token))::INT AS \"end\" FROM spans WHERE token IN (SELECT form FROM forms WHERE grams = 1)")
def span_offsets(spark, sf):
    return r.spans(docs(spark, sf), "text", ONE_OF).select("doc_id", "token", "start", "end")


ALLOWING = [f for f in DEFAULT.allowed if f.isascii()]


@query(f"""WITH {FORMS}, {SPANS_SQL}, allowing(phrase) AS (VALUES {", ".join(f"('{x}')" for x in ALLOWING)}),
gaps AS (SELECT doc_id, length(phrase) AS n, list_transform(string_split(lower(text), phrase), lambda p: length(p)) AS gaps FROM documents JOIN allowing ON contains(lower(text), phrase)),
allowed AS (SELECT doc_id, (list_sum(gaps[1:k]) + (k - 1) * n)::INT AS a, (list_sum(gaps[1:k]) + k * n)::INT AS b FROM (SELECT *, unnest(generate_series(1, len(gaps) - 1)) AS k FROM gaps))
SELECT doc_id, token, start FROM spans s WHERE token IN (SELECT form FROM forms WHERE grams = 1) AND NOT EXISTS (SELECT 1 FROM allowed x WHERE x.doc_id = s.doc_id AND a <= start AND start + length(token) <= b)""")
def allow_veto(spark, sf):
    found = r.spans(docs(spark, sf), "text", ONE_OF)
    allowed = r.spans(docs(spark, sf), "text", "|".join(ALLOWING))
    return r.veto(found, allowed, ["doc_id"]).select("doc_id", "token", "start")


@query(f"""WITH {FORMS}, {TOKENS}, {HITS}, rows AS (SELECT DISTINCT doc_id, lemma, language, severity, categories, casual_use, load_order FROM hits),
merged AS (SELECT doc_id, lemma, first(language ORDER BY severity DESC, load_order) AS language, max(severity) AS severity, flatten(list(categories ORDER BY severity DESC, load_order)) AS all_categories, bool_and(casual_use) AS casual_use FROM rows GROUP BY doc_id, lemma)
SELECT doc_id, lemma, language, severity, list_filter(all_categories, lambda c, i: list_position(all_categories, c) = i) AS categories, casual_use FROM merged""")
def merge_entries(spark, sf):
    return r.merge_entries(hits(spark, sf), ["doc_id"])


@query(f"""WITH c AS (SELECT l_orderkey AS k, (l_partkey % 40)::INT AS s, (l_partkey % 40 + 1 + l_suppkey % 9)::INT AS e, (l_linenumber % 2 * 2)::INT AS r, (l_suppkey % 5)::INT AS v, l_linenumber::INT AS o FROM lineitem),
resolved AS (SELECT k, count(*) AS n, {scan_sql.resolve_sql("list([{'s': s, 'e': e, 'r': r, 'v': v}] ORDER BY s, e DESC, o)")} AS kept FROM c GROUP BY k)
SELECT k, n, array_to_string(list_transform(list_sort(list_transform(kept, lambda x: {{'s': x.s, 'e': x.e}})), lambda x: x.s || '-' || x.e), ' ') AS kept FROM resolved""")
def overlap_resolution(spark, sf):
    """All groups, most of which overlap; kept spans by start, then end."""
    spans = F.array_sort(F.transform("kept", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return resolved(spark, sf).select("k", "n", F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["s"], x["e"])), " ").alias("kept"))


def resolved(spark, sf):
    items = read(spark, sf, "lineitem")
    span = F.struct((F.col("l_partkey") % 40).cast("int").alias("s"), (F.col("l_partkey") % 40 + 1 + F.col("l_suppkey") % 9).cast("int").alias("e"), (F.col("l_linenumber") % 2 * 2).cast("int").alias("r"), (F.col("l_suppkey") % 5).cast("int").alias("v"), F.col("l_linenumber").cast("int").alias("o"))
    # an order has a handful of lines, as a text has of candidates
    made = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(span).alias("c"), F.count("*").alias("n"))
    return made.select("k", "n", r.resolve(F.col("c")).alias("kept"))


def scanned_sql(options: Options, select: str, source: str = "SELECT doc_id, text FROM documents") -> str:
    return f"WITH {scan_sql.ctes(options, source)}\n{select}"


def censored_sql(options: Options, shown: str = "''", left: int = 0) -> str:
    """All texts with their matches masked; shown: what is left of a match, of so many clusters."""
    return scanned_sql(options, f"""SELECT doc_id, censored FROM (WITH cover AS (SELECT rid, s, e, max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kept),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s, e) AS island FROM cover),
spans AS (SELECT rid, min(s) AS s, max(e) AS e FROM islands GROUP BY rid, island),
pieces AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM spans),
masked AS (SELECT rid, string_agg(substr(text, before + 1, s - before) || {shown} || repeat('*', (length_grapheme(substr(text, s + 1, e - s)) - {left})::INT), '' ORDER BY s) AS head, max(e) AS stop FROM pieces JOIN t USING (rid) GROUP BY rid)
SELECT doc_id, coalesce(head || substr(text, stop + 1), text) AS censored FROM t LEFT JOIN masked USING (rid))""")


OWN = Options(packs=(), custom_words=("thing", "tion"), custom_allow=("thing of",))


@query(censored_sql(OWN))
def censor_custom(spark, sf):
    """Words and an allow phrase given by the caller, masked in all documents."""
    return whole_texts(spark, sf).select("doc_id", moderation.censor("text", OWN).alias("censored"))


@query(censored_sql(DEFAULT, "left_grapheme(substr(text, s + 1, e - s), 1)", 1))
def censor_keep_first(spark, sf):
    """All documents, the first cluster of each match left."""
    return whole_texts(spark, sf).select("doc_id", moderation.censor("text", keep_first=True).alias("censored"))


# --- folds ------------------------------------------------------------------------------------


def per_word(name: str, column: Callable, sql: str) -> None:
    """A query over the distinct tokens of all documents, with how often each occurs."""

    def run(spark, sf):
        words = r.tokens(docs(spark, sf), pattern="[^ \t\n]+").groupBy("token").agg(F.count("*").alias("n"))
        return words.select("token", column(F.col("token")).alias("folded"), "n")

    run.__name__ = name
    query(f"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[^ \\t\\n]+')) AS token FROM documents), words AS (SELECT token, count(*) AS n FROM w GROUP BY token) SELECT token, {sql} AS folded, n FROM words")(run)


CONFUSABLE_SQL = f"translate(token, '{''.join(ACCENTS)}', '{''.join(ACCENTS.values())}')"


per_word("fold_upper", lambda w: c.ascii_lower(F.translate(w, LETTERS, LETTERS.upper())), f"translate(translate(token, '{LETTERS}', '{LETTERS.upper()}'), '{LETTERS.upper()}', '{LETTERS}')")
per_word("fold_confusables", c.fold_confusables, CONFUSABLE_SQL)
#: Ranges of code points that reports escape.
SHOWN = ((1, 31), (0xAD, 0xAD), (0xC0, 0x24F), (0x300, 0x4FF), (0x200B, 0x200F), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0xFE00, 0xFE0F))


def kept_chars(test: str) -> str:
    """token without the characters that fail a test on c (its characters), x and i."""
    return f"array_to_string(list_filter(string_split(token, ''), lambda x, i: {test}), '')"


def leet_sql() -> str:
    """fold_leet of a word in which e, i and o are written 3, 1 and 0, signs and digits as the letters they stand for."""
    digits, letters = "".join(t.LEET_DIGITS), "".join(t.LEET_DIGITS.values())
    put = "translate(token, 'eio', '310')"
    run = "substr(x, 1, 1)"  # a run of a-z and digits, or of anything else
    count = "length(regexp_replace(x, '[^a-z]', '', 'g'))"
    whole = f"({count} >= 2 OR ({count} = 1 AND length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]{{2}}')))"
    beside = f"array_to_string(list_transform(string_split(x, ''), lambda y, j: CASE WHEN regexp_matches(y, '[0-9]') AND (regexp_matches(coalesce(string_split(x, '')[j + 1], ''), '[a-z]') OR (j > 1 AND regexp_matches(string_split(x, '')[j - 1], '[a-z]'))) THEN translate(y, '{digits}', '{letters}') ELSE y END), '')"
    mapped = f"CASE WHEN NOT regexp_matches({run}, '[a-z0-9]') THEN x WHEN regexp_matches({run}, '[0-9]') THEN CASE WHEN {whole} THEN translate(x, '{digits}', '{letters}') ELSE x END ELSE {beside} END"
    words = f"array_to_string(list_transform(regexp_extract_all({put}, '[a-z0-9]+|[^a-z0-9]+'), lambda x: {mapped}), '')"
    # signs are judged on the input, and the folds above keep every character's place
    seen = f"string_split({put}, '')"
    signs = f"array_to_string(list_transform(string_split({words}, ''), lambda x, i: CASE WHEN x IN ('{"', '".join(t.LEET_SIGNS)}') AND (regexp_matches(coalesce({seen}[i + 1], ''), '[a-z]') OR (i > 1 AND regexp_matches({seen}[i - 1], '[a-z]'))) THEN translate(x, '{''.join(t.LEET_SIGNS)}', '{''.join(t.LEET_SIGNS.values())}') ELSE x END), '')"
    return f"replace({signs}, 'ph', 'f')"


per_word("fold_pairs", c.collapse_pairs, kept_chars("NOT (i > 2 AND x = string_split(token, '')[i - 1] AND x = string_split(token, '')[i - 2])"))
per_word("fold_singles", c.collapse_all, kept_chars("NOT (i > 1 AND x = string_split(token, '')[i - 1])"))
per_word("skeleton_keys", c.skeleton_key, sound_sql("token"))
per_word("fold_width", lambda w: c.fold_width(F.translate(w, LETTERS, "".join(chr(ord(x) + t.WIDE_SHIFT) for x in LETTERS))), "token")
per_word("fold_invisible", lambda w: c.strip_invisible(F.regexp_replace(w, "([aeiou])", "$1\u200b")), f"translate(token, '{t.INVISIBLE}', '')")
per_word("fold_marks", lambda w: c.strip_marks(F.regexp_replace(w, "([aeiou])", "$1\u0308")), r"regexp_replace(regexp_replace(token, '([aeiou])', '\1' || chr(776), 'g'), '([A-Za-z])[' || chr(768) || '-' || chr(879) || ']+', '\1', 'g')")
per_word("show_hidden", lambda w: c.escaped(F.concat(F.translate(w, "aeo", "аео"), F.lit("\u200b"))), f"array_to_string(list_transform(string_split(translate(token, 'aeo', 'аео') || chr(8203), ''), lambda x: CASE WHEN {' OR '.join(f'ord(x) BETWEEN {a} AND {b}' for a, b in SHOWN)} THEN '\\u' || lpad(upper(printf('%x', ord(x))), 4, '0') ELSE x END), '')")
per_word("fold_leet", lambda w: c.fold_leet(F.translate(w, "eio", "310")), leet_sql())


@query("SELECT doc_id, nfc_normalize(text) = text AS same, length(nfc_normalize(text)) AS n FROM documents")
def nfc_fold(spark, sf):
    """Decomposes each text and composes it again, by the kernel's NFC step."""

    small_batches(spark)

    @F.pandas_udf("string")
    def compose(batch: pd.Series) -> pd.Series:
        import unicodedata

        return batch.map(lambda x: texts.run(texts.LOOSE_NFC, unicodedata.normalize("NFD", x)), na_action="ignore")

    made = whole_texts(spark, sf).select("doc_id", "text", compose("text").alias("composed"))
    return made.select("doc_id", (F.col("composed") == F.col("text")).alias("same"), F.length("composed").cast("long").alias("n"))


PROFILE = {
    "all_ascii": r"NOT regexp_matches(text, '[^\x00-\x7f]')", "has_upper": "regexp_matches(text, '[A-Z]')", "has_digit": "regexp_matches(text, '[0-9]')", "has_mask": "regexp_matches(text, '[*#@$%]')",
    "has_tag": "regexp_matches(text, '[#@]')", "has_leet": "regexp_matches(text, 'ph|[@431!|0$57269]')",
    "has_mark": "regexp_matches(text, '[' || chr(768) || '-' || chr(879) || ']')", "has_spelled": r"regexp_matches(text, '(?s)\p{L}[ \t.\-_\n/].[ \t.\-_\n/].[ \t.\-_\n/]')", "has_bound": r"regexp_matches(text, '[\p{L}\p{M}\p{N}][.\-][\p{L}\p{M}\p{N}]')",
}
RUN = f"""list_reduce(list_transform(string_split(text, ''), lambda x: {{'c': x, 'n': 1, 'most': 1}}), lambda a, x: {{'c': x.c, 'n': CASE WHEN a.c = x.c THEN a.n + 1 ELSE 1 END, 'most': greatest(a.most, CASE WHEN a.c = x.c THEN a.n + 1 ELSE 1 END)}}).most"""
PROFILE |= {"has_stretch": "coalesce(run, 0) >= 3", "has_repeat": "coalesce(run, 0) >= 2"}


@query(f"WITH d AS (SELECT doc_id, text, CASE WHEN text <> '' THEN {RUN} END AS run FROM documents) SELECT doc_id, " + ", ".join(f"{sql} AS {k}" for k, sql in PROFILE.items()) + " FROM d")
def profile_flags(spark, sf):
    return docs(spark, sf).select("doc_id", c.profile(F.col("text")).alias("p")).select("doc_id", *[f"p.{k}" for k in PROFILE])


# --- catalogue, kernel, reports, streams ------------------------------------------------------


@query("WITH " + values("e", "language, script, i", [(e.language, e.script, e.load_order) for e in DEFAULT.entries]) + f", {FORMS}, {TOKENS}, {HITS}, h AS (SELECT language, count(*) AS n FROM hits GROUP BY language) SELECT language, count(*) AS lemma_count, list(DISTINCT script) AS scripts, min(i) AS load_order, coalesce(any_value(n), 0) AS hits FROM e LEFT JOIN h USING (language) GROUP BY language")
def list_languages(spark, sf):
    """Every language of the lexicon, and how many words of the documents are its terms."""
    found = hits(spark, sf).groupBy("language").agg(F.count("*").alias("n"))
    return lexicon.list_languages(lexicon.to_frame(spark)).join(found, "language", "left").withColumn("hits", F.coalesce("n", F.lit(0))).drop("n")


UNITS = r"length(regexp_replace(substr(text, 1, {at}), '[^\x{10000}-\x{10ffff}]', '', 'g'))"
MATCHES = f"""SELECT doc_id, lemma, substr(text, s + 1, e - s) AS surface, tier, language, severity, categories, casual_use, (s + {UNITS.replace('{at}', 's')})::INT AS start, (e + {UNITS.replace('{at}', 'e')})::INT AS "end", s::INT AS char_start, e::INT AS char_end FROM kept"""
CHECKED = "SELECT doc_id, any_value(t.text) AS text, count(lemma)::INT AS match_count, max(severity) AS max_severity FROM t LEFT JOIN (SELECT rid, lemma, severity FROM kept) k USING (rid) GROUP BY rid, doc_id"
BARE = Options(packs=tuple(replace(p, allowlist=(), entries=tuple(replace(e, allowlist=()) for e in p.entries)) for p in DEFAULT.packs))


@query(scanned_sql(DEFAULT, MATCHES))
def scan_matches(spark, sf):
    return moderation.scan_rows(whole_texts(spark, sf))


@query(scanned_sql(DEFAULT, MATCHES))
def scan_native(spark, sf):
    """As scan_matches, all inside the JVM: folds and their offsets as columns."""
    return native.scan_rows(docs(spark, sf).select("doc_id", "text"))


FR, BOTH = ("fr", 2, ("gendered",), False), ("fr", 2, ("gendered", "general"), False)
#: Words hidden in each way that the SQL of whole scans can't say, with what the rules of the tiers make of them:
#: (hidden, lemma, language, severity, categories, casual use, tier, where the match starts in it and how long it is).
PLANTED = [
    ("th*ng", "thing", *FR, "masked", 0, 5), ("e@ble", "erble", "en", 4, ("violence",), False, "masked", 0, 5), ("th8ng", "thing", *FR, "masked", 0, 5), ("th\U0001f525ing", "thing", *FR, "masked", 0, 6),
    ("fr0bnicate", "frobnicate", "en", 3, ("general", "gendered"), False, "exact", 0, 10), ("t.h.i.n.g", "thing", *FR, "separated", 0, 9), ("fro-bni-cate", "frobnicate", "en", 3, ("general", "gendered"), False, "separated", 0, 12),
    ("#SoThing", "thing", *FR, "exact", 3, 5), ("\uff34\uff28\uff29\uff2e\uff27", "thing", *BOTH, "exact", 0, 5), ("th\u200bing", "thing", *BOTH, "exact", 0, 6), ("thi\u0301ng", "thing", *BOTH, "exact", 0, 6), ("\u0442hing", "thing", *BOTH, "exact", 0, 5),
]


@query("WITH " + values("planted", "k, hidden, lemma, language, severity, categories, casual_use, tier, from_, n", [(k, *p) for k, p in enumerate(PLANTED)]) + ", " + scan_sql.ctes(DEFAULT, "SELECT doc_id, text || ' ;; ' AS text FROM documents") + ", " + f"""
whole AS (SELECT doc_id, text || hidden || ' .' AS text, lemma, language, severity, categories, casual_use, tier, length(text) + from_ AS s, length(text) + from_ + n AS e FROM t JOIN planted ON k = doc_id % {len(PLANTED)}
  UNION ALL SELECT doc_id, text, lemma, language, severity, categories, casual_use, tier, s, e FROM kept) {MATCHES.replace('FROM kept', 'FROM whole')}""")
def scan_planted(spark, sf):
    """All documents with one hidden word at the end, by turns."""
    hidden = F.array(*[F.lit(p[0]) for p in PLANTED])
    put = F.concat("text", F.lit(" ;; "), F.get(hidden, (F.col("doc_id") % len(PLANTED)).cast("int")), F.lit(" ."))
    return moderation.scan_rows(whole_texts(spark, sf).select("doc_id", put.alias("text")))


@query(scanned_sql(DEFAULT, f"SELECT doc_id, match_count = 0 AS clean, match_count, max_severity, {scan_sql.quoted([p.language for p in DEFAULT.packs])} AS languages FROM ({CHECKED})"))
def check_texts(spark, sf):
    return moderation.check(whole_texts(spark, sf)).drop("text")


@query(censored_sql(DEFAULT))
def censor_texts(spark, sf):
    return whole_texts(spark, sf).select("doc_id", moderation.censor("text").alias("censored"))


@query(f"WITH {FORMS}, {TOKENS}, {HITS}, f AS (SELECT DISTINCT doc_id FROM hits) SELECT toxic, count(*) AS labelled, count(f.doc_id) AS flagged FROM labels l LEFT JOIN f USING (doc_id) GROUP BY toxic")
def label_confusion(spark, sf):
    flagged = hits(spark, sf).select("doc_id").distinct().withColumn("flag", F.lit(1))
    return read(spark, sf, "labels").join(flagged, "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("labelled"), F.count("flag").alias("flagged"))


@query(f"WITH {FORMS}, words AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM conversations) SELECT conv_id, min(turn) AS first_turn, count(*) AS n FROM words JOIN forms ON form = token AND grams = 1 GROUP BY conv_id")
def conversation_first_hit(spark, sf):
    words = r.tokens(read(spark, sf, "conversations"), keep=("conv_id", "turn"))
    return r.token_hits(words, lexicon.form_table(spark)).groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query(f"WITH {FORMS}, {TOKENS}, v AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM words GROUP BY token) SELECT token, lemma, n, documents FROM v JOIN forms ON form = token AND grams = 1")
def vocabulary_sweep(spark, sf):
    """Every distinct word of the corpus against the lexicon."""
    v = r.tokens(docs(spark, sf)).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
    return r.token_hits(v, lexicon.form_table(spark)).select("token", "lemma", "n", "documents")


@query(f"WITH {FORMS}, {TOKENS}, v AS (SELECT DISTINCT token AS w FROM words WHERE token IN (SELECT form FROM forms)) " + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT w, '{way}' AS axis, {evade.duck('w', way)} AS hidden FROM v" for way in evade.LATIN) + ") WHERE hidden IS NOT NULL")
def battery_cases(spark, sf):
    return reports.cases(hits(spark, sf).select(F.col("token").alias("w")).distinct())


@query()
def battery_scorecard(spark, sf):
    return reports.scorecard(reports.flagged(reports.cases(hits(spark, sf).select(F.col("token").alias("w")).distinct()), "all", DEFAULT))


@query()
def misses_by_axis(spark, sf):
    return reports.misses(reports.flagged(reports.cases(hits(spark, sf).select(F.col("token").alias("w")).distinct()), "all", DEFAULT))


@query(scanned_sql(DEFAULT, "SELECT tier, count(DISTINCT doc_id) AS cases FROM kept GROUP BY tier"))
def tier_counts(spark, sf):
    return reports.tiers(moderation.scan_rows(whole_texts(spark, sf)), "doc_id")


def readers(spark, sf):
    words = hits(spark, sf).select(F.col("token").alias("w"), "language", "severity").distinct()
    return words.select("w", F.col("language").alias("library")).unionByName(words.where("severity >= 3").select("w", F.lit("strict").alias("library"))).distinct()


VOTE_SQL = f"WITH {FORMS}, {TOKENS}, h AS (SELECT DISTINCT w.token AS w, language, severity FROM words w JOIN forms f ON f.form = w.token AND grams = 1), l AS (SELECT w, language AS library FROM h UNION SELECT w, 'strict' FROM h WHERE severity >= 3)"


@query(f"{VOTE_SQL} SELECT w, count(DISTINCT library) AS votes, count(DISTINCT library) = 1 AS alone FROM l GROUP BY w")
def votes(spark, sf):
    return reports.votes(readers(spark, sf))


@query(f"{VOTE_SQL}, v AS (SELECT w, count(DISTINCT library) AS votes FROM l GROUP BY w) SELECT library, count(*) AS claimed, count(*) FILTER (votes = 1) AS alone FROM l JOIN v USING (w) GROUP BY library")
def vote_summary(spark, sf):
    return reports.vote_summary(readers(spark, sf))


@query()
def pack_isolation(spark, sf):
    cases = reports.cases(hits(spark, sf).select(F.col("token").alias("w")).distinct())
    return reports.isolation(cases, DEFAULT)


@query(f"""SELECT clean, clean_bare, count(*) AS texts FROM (SELECT rid, doc_id, match_count = 0 AS clean FROM ({scanned_sql(DEFAULT, CHECKED.replace("SELECT doc_id", "SELECT rid, doc_id"))})) a
JOIN (SELECT rid, match_count = 0 AS clean_bare FROM ({scanned_sql(BARE, CHECKED.replace("SELECT doc_id", "SELECT rid, doc_id"))})) b USING (rid) GROUP BY clean, clean_bare""")
def allow_dependence(spark, sf):
    return reports.allow_dependence(whole_texts(spark, sf), DEFAULT)


#: The 20 most frequent words of each language of the documents, as one list.
COMMON = rf"""counted AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM documents WHERE lang IS NOT NULL) GROUP BY lang, token),
common AS (SELECT lang, list(token ORDER BY n DESC, token) AS list FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS k FROM counted) WHERE k <= 20 GROUP BY lang)"""


def common_words(spark, sf) -> DataFrame:
    """lang, list: its 20 most frequent words in documents, the most frequent first."""
    counted = r.tokens(docs(spark, sf).where("lang is not null"), keep=("lang",)).groupBy("lang", "token").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("k <= 20")
    return ranked.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("list"))


@query(f"WITH {COMMON} SELECT lang, i AS place, list[i % len(list) + 1] AS word, i % 3 = 0 AS profane, array_to_string(list_transform(range((i % 3 + 1) * 10), lambda j: CASE WHEN j = 4 AND i % 3 = 0 THEN '{WORD}' ELSE list[(i + j) % len(list) + 1] END), ' ') AS text FROM (SELECT *, unnest(range(60)) AS i FROM common)")
def synthetic_corpus(spark, sf):
    """Test texts of 10, 20 and 30 words made of each language's most frequent words; each third has a term of the lexicon."""
    return reports.synthetic(common_words(spark, sf), 60, WORD).select("lang", "place", F.get("list", (F.col("place") % F.size("list")).cast("int")).alias("word"), (F.col("place") % 3 == 0).alias("profane"), "text")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, median(value) AS median_value, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def hourly_medians(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.median("value").alias("median_value"), F.min("value").alias("least"), F.max("value").alias("most"))


ANSWERS = f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'check_text' AS method, CASE WHEN text IS NOT NULL THEN '{{"clean":' || (match_count = 0) || ',"matchCount":' || match_count || coalesce(',"maxSeverity":' || max_severity, '') || ',"languages":[{",".join(f'"{p.language}"' for p in DEFAULT.packs)}]}}' END AS result, CASE WHEN text IS NULL THEN -32602 END AS error FROM ({CHECKED})"""


@query(scanned_sql(DEFAULT, ANSWERS))
def message_stream(spark, sf):
    """Requests as lines of JSON, answered by the file stream's batch twin."""
    lines = whole_texts(spark, sf).select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("doc_id").alias("id"), F.lit("check_text").alias("method"), F.struct("text").alias("params"))).alias("value"))
    return messages.answer(lines, DEFAULT)


SUITES = "suites AS (SELECT language AS suite, form AS w, row_number() OVER (PARTITION BY language ORDER BY form) AS place FROM (SELECT DISTINCT language, form FROM forms JOIN (SELECT DISTINCT token FROM words) ON token = form WHERE grams = 1 AND regexp_full_match(form, '[a-z]+')))"
MADE = " UNION ALL ".join(f"SELECT suite, place, w, '{way}' AS axis, {evade.duck('w', way)} AS hidden, {1_000_000 + k} AS turn FROM suites" for k, way in enumerate(evade.LATIN))
EXPANDED = f"""{SUITES}, made AS (SELECT * FROM ({MADE}) WHERE hidden IS NOT NULL), firsts AS (SELECT *, row_number() OVER (PARTITION BY suite, axis ORDER BY place) AS f FROM made),
candidates AS (SELECT suite, 'control' AS kind, 'plain' AS axis, w, w AS hidden, place AS turn FROM suites UNION ALL SELECT suite, 'generated', axis, w, hidden, turn FROM firsts WHERE f = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY suite, hidden ORDER BY turn) AS f FROM candidates), expanded AS (SELECT suite, kind, axis, w, hidden FROM kept WHERE f = 1)"""


def suites(spark, sf) -> DataFrame:
    """The terms of each language that documents hold."""
    forms = hits(spark, sf).where(F.col("token").rlike("^[a-z]+$")).select(F.col("language").alias("suite"), F.col("token").alias("w")).distinct()
    return forms.withColumn("place", F.row_number().over(Window.partitionBy("suite").orderBy("w")))


@query(f"WITH {FORMS}, {TOKENS}, {EXPANDED} SELECT * FROM expanded")
def case_expansion(spark, sf):
    """Each language's words hidden in every way, the first word that a way applies to, equal texts once."""
    return reports.expand(suites(spark, sf))


@query(f"""WITH {FORMS}, {TOKENS}, {EXPANDED}, axes(axis) AS (VALUES {", ".join(f"('{way}')" for way in sorted(evade.LATIN))}),
missing AS (SELECT suite, list(axis ORDER BY axis) AS inapplicable FROM (SELECT DISTINCT suite FROM suites), axes WHERE (suite, axis) NOT IN (SELECT (suite, axis) FROM candidates) GROUP BY suite)
SELECT suite, (SELECT count(*) FROM expanded x WHERE x.suite = s.suite AND kind = 'control') AS control, (SELECT count(*) FROM expanded x WHERE x.suite = s.suite AND kind = 'generated') AS generated, (SELECT count(*) FROM expanded x WHERE x.suite = s.suite) AS total,
(SELECT count(*) FROM candidates c WHERE c.suite = s.suite) - (SELECT count(*) FROM expanded x WHERE x.suite = s.suite) AS collapsed, coalesce(inapplicable, []) AS inapplicable FROM (SELECT DISTINCT suite FROM suites) s LEFT JOIN missing USING (suite)""")
def battery_composition(spark, sf):
    return reports.composition(suites(spark, sf))


ORIGINS = rf"""heads AS (SELECT DISTINCT token AS w FROM words), fair AS (SELECT w FROM heads WHERE regexp_full_match(w, '[a-z]{{3,}}')),
made AS ({" UNION ".join(f"SELECT {form} AS w FROM fair WHERE {test.replace('w rlike ', 'regexp_matches(w, ') + (')' if 'rlike' in test else '')}" for test, form in reports.ENDINGS)}),
listed AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS ts FROM documents), pairs AS (SELECT DISTINCT ts[i] || ' ' || ts[i + 1] AS w FROM (SELECT ts, unnest(generate_series(1, len(ts) - 1)) AS i FROM listed WHERE len(ts) > 1)),
origins AS (SELECT w, 'headword' AS origin FROM heads UNION ALL SELECT w, 'compound' FROM pairs UNION ALL SELECT w, 'inflection' FROM made WHERE w NOT IN (SELECT w FROM heads)),
claims AS (SELECT DISTINCT w, language AS library FROM (SELECT w, unnest(string_split(w, ' ')) AS part FROM origins) JOIN forms ON form = part AND grams = 1)"""


@query(f"WITH {FORMS}, {TOKENS}, {ORIGINS} SELECT library, count(*) FILTER (origin = 'headword') AS headword, count(*) FILTER (origin = 'compound') AS compound, count(*) FILTER (origin = 'inflection') AS inflection FROM claims JOIN origins USING (w) GROUP BY library")
def origin_split(spark, sf):
    """Words of the corpus, pairs of neighbours and regular inflections that each language's dictionary flags."""
    heads = r.tokens(docs(spark, sf)).select(F.col("token").alias("w")).distinct()
    terms = lexicon.form_table(spark).where("grams = 1").select(F.col("form").alias("w")).distinct()
    listed = docs(spark, sf).select(F.regexp_extract_all(F.lower("text"), F.lit(W), F.lit(0)).alias("ts")).where(F.size("ts") > 1)
    # pairs without a term count for no dictionary, so each term is put together with its two neighbours
    near = F.transform("ts", lambda x, i: F.struct(x.alias("w"), F.when(i > 0, F.get("ts", i - 1)).alias("before"), F.get("ts", i + 1).alias("after")))
    termed = listed.select(F.inline(near)).join(terms, "w", "left_semi")
    both = F.array(F.when(F.col("before").isNotNull(), F.concat_ws(" ", "before", "w")), F.when(F.col("after").isNotNull(), F.concat_ws(" ", "w", "after")))
    pairs = termed.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("w")).distinct()
    words = reports.origins(heads, pairs, terms)
    parts = words.select("w", F.explode(F.split("w", " ")).alias("token"))
    return reports.origin_split(words, r.token_hits(parts, lexicon.form_table(spark)).select("w", F.col("language").alias("library")))


@query("SELECT md5(text) AS text_md5, any_value(n) AS times, list(source ORDER BY source) AS places FROM (SELECT DISTINCT text, source FROM documents) JOIN (SELECT text, count(*) AS n FROM documents GROUP BY text) USING (text) WHERE n > 1 GROUP BY text")
def repeated_texts(spark, sf):
    """Texts that are counted more than once, and the sources that have them."""
    return reports.repeated(docs(spark, sf)).select(F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "times", "places")


@query(f"WITH {TOKENS}, listed AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT token FROM words)) SELECT token FROM listed WHERE i IN (SELECT k * n // 40 FROM range(40) t(k))")
def even_sample(spark, sf):
    """40 words at even distances in the order of the corpus's vocabulary."""
    return reports.sample_evenly(r.tokens(docs(spark, sf)), "token", 40)


@query(f"""WITH {COMMON}, made AS (SELECT lang AS corpus, words, every, list_transform(range(words), lambda i: CASE WHEN every > 0 AND i % greatest(every, 1) = 0 THEN '{WORD}' ELSE list[i % len(list) + 1] END) AS ws
FROM common, (VALUES (100), (1000)) a(words), (VALUES (0), (10)) b(every)) SELECT corpus, words, every, array_to_string(ws, ' ') AS text FROM made""")
def synthetic_corpora(spark, sf):
    """Texts of each language's most frequent words, in two lengths, with and without a term of the lexicon."""
    return reports.synthetic_corpora(common_words(spark, sf), (100, 1000), WORD)


OTHER_SCRIPTS = "v AS (SELECT DISTINCT token AS w FROM words WHERE regexp_matches(token, '[^\\x00-\\x7f]'))"


@query(f"WITH {TOKENS}, {OTHER_SCRIPTS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT w, '{way}' AS axis, {sql} AS hidden FROM v" for way, sql in evade.duck_native("w").items()) + ") WHERE hidden IS NOT NULL")
def native_cases(spark, sf):
    """Words of documents with letters beyond ASCII, hidden between their grapheme clusters."""
    return reports.native_cases(r.tokens(docs(spark, sf)).where(F.col("token").rlike(r"[^\x00-\x7f]")).select(F.col("token").alias("w")).distinct())
