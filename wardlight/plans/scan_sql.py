"""DuckDB SQL of whole scans, for comparison: exact words, prefixes and phrases in three folds, and sounds.

It says the tiers over texts whose folds are lower case, look-alike letters, signs that stand for letters,
`ph` and runs; of digits that stand for letters, masks, tags, spelled-out words and pictures it says
nothing, so it holds for texts without words hidden so (see queries.scan_planted for those). Offsets, merging of entries, allow
phrases and overlaps are as in the kernel.
"""

from __future__ import annotations

from ..functions import tables as t
from ..sources.lexicon import Options

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Look-alike letters that lower-case texts of the tables can hold.
ACCENTS = {a: b for a, b in t.confusables().items() if ord(a) < 0x250}
W = r"[\p{L}\p{M}\p{N}]+"
BLANKS = "[" + t.SPACES + "]+"


def quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(quoted, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows) + ")"


def accents(w: str) -> str:
    return f"translate({w}, '{''.join(ACCENTS)}', '{''.join(ACCENTS.values())}')"


def signs(w: str) -> str:
    """Signs beside a letter as the letter that they stand for, in upper case; all judged on the input, which is in lower case."""
    for sign, letter in t.LEET_SIGNS.items():
        for pattern, made in ((f"([a-z])[{sign}]", f"\\1{letter.upper()}"), (f"[{sign}]([a-z])", f"{letter.upper()}\\1")):
            w = f"regexp_replace({w}, '{pattern}', '{made}', 'g')"
    return w


def latin(w: str) -> str:
    """The latin fold of a word in lower case, but for digits."""
    return doubled(f"replace(lower({signs(accents(w))}), 'ph', 'f')", 2)


def doubled(w: str, k: int) -> str:
    """Runs of a letter of more than k as k; RE2 has no backreferences, so letter by letter."""
    for x in LETTERS:
        w = f"regexp_replace({w}, '{x}{{{k + 1},}}', '{x * k}', 'g')"
    return w


def sound_sql(w: str) -> str:
    """skeleton_key in SQL."""
    for group, sound in t.SOUNDS.items():
        w = f"replace({w}, '{group}', '{''.join(t.LETTERS.get(x, x) for x in sound).upper()}')"
    w = f"lower(translate(replace({w}, 'x', 'ks'), 'zwqyc', 'jvkik'))"
    w = f"regexp_replace(regexp_replace({w}, '([a-z])h+', '\\1', 'g'), '([a-z])[aeiou]+', '\\1', 'g')"
    return f"regexp_replace({doubled(w, 1)}, '[^a-z]', '', 'g')"


def entry_rows(options: Options) -> list[tuple]:
    return [(e.load_order, e.lemma, e.language, e.severity, e.categories, e.casual_use) for e in options.entries]


def ctes(options: Options, source: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs ending in kept: rid, doc_id, text, lemma, language, severity, categories, casual_use, tier, s, e (characters)."""
    forms = [(f, len(f), f.count(" ") + 1, e.match_mode, e.load_order, f in options.collapsed) for f, entries in options.exact.items() for e in dict.fromkeys(entries)]
    made = [
        values("entries", "entry, lemma, language, severity, categories, casual_use", entry_rows(options)),
        values("forms", "form, form_len, grams, match_mode, entry, stable", forms),
        values("keys", "key, key_len, entry", [(k, len(k), e.load_order) for k, e in options.sounds.items()] or [(None, 0, 0)]),
        values("allowing", "phrase", [(f,) for f in options.allowed] or [(None,)]),
        f"t AS (SELECT row_number() OVER () AS rid, doc_id, text, lower(coalesce(text, '')) AS l FROM ({source}))",
        # words, where they start, and their folds
        f"cut AS (SELECT rid, regexp_extract_all(l, '{W}') AS ts, regexp_split_to_array(l, '{W}') AS gs FROM t)",
        "parted AS (SELECT rid, i, ts[i] AS token, gs[i] AS gap, gs[i + 1] AS after FROM (SELECT *, unnest(generate_series(1, len(ts))) AS i FROM cut))",
        "placed AS (SELECT *, (sum(length(gap) + length(token)) OVER (PARTITION BY rid ORDER BY i) - length(token))::INT AS s FROM parted)",
        f"distinct_words AS (SELECT token, latin, {doubled('latin', 1)} AS single FROM (SELECT token, {latin('token')} AS latin FROM (SELECT DISTINCT token FROM placed)))",
        "folded AS (SELECT p.*, latin, single, (s + length(token))::INT AS e FROM placed p JOIN distinct_words USING (token))",
        f"stretched AS (SELECT *, regexp_matches(token, '{'|'.join(x * 3 for x in LETTERS)}') OR substr(token, 1, 1) = substr(token, 2, 1) AS wide FROM folded)",
        # words that signs make longer: as placed, on a text of equal length
        f"signed AS (SELECT rid, {signs(accents('l'))} AS l FROM t WHERE regexp_matches(l, '[{''.join(t.LEET_SIGNS)}]'))",
        f"signed_cut AS (SELECT rid, regexp_extract_all(l, '{W}') AS ts, regexp_split_to_array(l, '{W}') AS gs FROM signed)",
        "signed_parted AS (SELECT rid, i, ts[i] AS token, gs[i] AS gap FROM (SELECT *, unnest(generate_series(1, len(ts))) AS i FROM signed_cut))",
        "signed_placed AS (SELECT *, (sum(length(gap) + length(token)) OVER (PARTITION BY rid ORDER BY i) - length(token))::INT AS s FROM signed_parted)",
        f"signed_run AS (SELECT rid, s, (s + length(token))::INT AS e, {doubled("replace(lower(token), 'ph', 'f')", 2)} AS latin FROM signed_placed WHERE regexp_matches(token, '[A-Z]'))",
        f"signed_words AS (SELECT r.rid, s, e, latin, (e + CASE substr(text, e, 1) {' '.join(f"WHEN '{x}' THEN length(regexp_extract(substr(text, e + 1), '^[{x}]*'))" for x in t.LEET_SIGNS)} ELSE 0 END)::INT AS stop FROM signed_run r JOIN t USING (rid))",
        # exact: (span, entry, the part that an allow phrase has to cover)
        """words_hit AS (SELECT rid, s, e, entry, form_len, match_mode, token AS x, form FROM stretched JOIN forms ON grams = 1 AND form = token
  UNION ALL SELECT rid, s, e, entry, form_len, match_mode, latin, form FROM stretched JOIN forms ON grams = 1 AND form = latin AND latin <> token
  UNION ALL SELECT rid, s, e, entry, form_len, match_mode, single, form FROM stretched JOIN forms ON grams = 1 AND form = single AND stable AND wide AND single <> latin
  UNION ALL SELECT rid, s, e, entry, form_len, match_mode, token, form FROM stretched JOIN forms ON match_mode = 'prefix' AND starts_with(token, form) AND token <> form
  UNION ALL SELECT rid, s, e, entry, form_len, match_mode, latin, form FROM stretched JOIN forms ON match_mode = 'prefix' AND starts_with(latin, form) AND latin <> form AND latin <> token
  UNION ALL SELECT rid, s, stop, entry, form_len, match_mode, latin, form FROM signed_words JOIN forms ON grams = 1 AND form = latin
  UNION ALL SELECT p.rid, p.s, w.stop, entry, form_len, match_mode, p.latin || '+', form FROM stretched p JOIN forms ON match_mode = 'prefix' AND starts_with(p.latin, form) JOIN signed_words w ON w.rid = p.rid AND w.s <= p.s AND p.e < w.e)""",
        """phrases_hit AS (SELECT a.rid, a.s, b.e, entry FROM stretched a JOIN stretched b ON b.rid = a.rid AND b.i = a.i + 1 AND b.gap = ' '
  JOIN forms ON grams = 2 AND (form = a.token || ' ' || b.token OR form = a.latin || ' ' || b.latin))""",
        "exact AS (SELECT rid, s, e, entry, s + CASE WHEN x <> form THEN form_len ELSE e - s END AS tested FROM words_hit UNION ALL SELECT rid, s, e, entry, e FROM phrases_hit)",
        """merging AS (SELECT DISTINCT rid, s, e, x.lemma, x.entry, tested FROM exact JOIN entries x USING (entry))""",
        """merged AS (SELECT rid, s, e, m.lemma, max(tested) AS tested, list({'language': language, 'severity': severity, 'categories': categories} ORDER BY severity DESC, m.entry) AS es,
  bool_and(casual_use) AS casual_use, min(m.entry) AS entry FROM merging m JOIN entries USING (entry) GROUP BY rid, s, e, m.lemma)""",
        """exact_found AS (SELECT rid, s, e, tested, lemma, es[1].language AS language, es[1].severity AS severity, list_distinct_in_order(flatten(list_transform(es, lambda x: x.categories))) AS categories, casual_use, 'exact' AS tier, 2 AS r, entry AS o FROM merged)""".replace("list_distinct_in_order(flatten(list_transform(es, lambda x: x.categories)))", "list_filter(flatten(list_transform(es, lambda x: x.categories)), lambda c, i: list_position(flatten(list_transform(es, lambda x: x.categories)), c) = i)"),
        # sounds: of what stands between white space
        f"blank_cut AS (SELECT rid, regexp_extract_all(l, '[^{t.SPACES}]+') AS ts, regexp_split_to_array(l, '[^{t.SPACES}]+') AS gs FROM t)",
        "blank_parted AS (SELECT rid, i, ts[i] AS word, gs[i] AS gap FROM (SELECT *, unnest(generate_series(1, len(ts))) AS i FROM blank_cut))",
        "blank_placed AS (SELECT *, (sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY i) - length(word))::INT AS s FROM blank_parted)",
        f"lat AS (SELECT word, {latin('word')} AS lat FROM (SELECT DISTINCT word FROM blank_placed))",
        f"sounded AS (SELECT word, lat, {sound_sql('lat')} AS sound FROM lat)",
        "sounding AS (SELECT word, lat, key, entry FROM sounded JOIN keys ON starts_with(sound, key) AND length(sound) - key_len <= 3)",
        f"""reached AS (SELECT word, key, entry, length(regexp_extract(lower({signs(accents('word'))}), '^[^a-z]*')) AS a, min(m) AS b FROM (SELECT *, unnest(generate_series(1, length(word))) AS m FROM sounding)
  WHERE starts_with({sound_sql(latin('substr(word, 1, m)'))}, key) GROUP BY word, key, entry)""",
        "sound_found AS (SELECT rid, s + a AS s, s + b AS e, s + b AS tested, lemma, language, severity, categories, casual_use, 'skeleton' AS tier, 0 AS r, 1000000 + entry AS o FROM blank_placed JOIN reached USING (word) JOIN entries USING (entry))",
        # allow phrases, wherever they stand
        f"""allowed AS (SELECT rid, length(phrase) AS n, list_transform(string_split(x, phrase), lambda p: length(p)) AS gaps FROM (SELECT rid, l AS x FROM t UNION ALL SELECT rid, {accents('l')} FROM t) JOIN allowing ON contains(x, phrase)),
allow_spans AS (SELECT DISTINCT rid, (list_sum(gaps[1:k]) + (k - 1) * n)::INT AS a, (list_sum(gaps[1:k]) + k * n)::INT AS b FROM (SELECT *, unnest(generate_series(1, len(gaps) - 1)) AS k FROM allowed))""",
        """candidates AS (SELECT c.* FROM (SELECT * FROM exact_found UNION ALL SELECT * FROM sound_found) c
  WHERE NOT EXISTS (SELECT 1 FROM allow_spans w WHERE w.rid = c.rid AND w.a <= c.s AND c.tested <= w.b))""",
        "listed AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s, e DESC, o) AS n FROM candidates)",
        f"resolved AS (SELECT rid, {resolve_sql('list([{s: s, e: e, r: r, v: severity, n: n}] ORDER BY n)')} AS kept FROM listed GROUP BY rid)",
        "kept AS (SELECT rid, doc_id, text, lemma, language, severity, categories, casual_use, tier, x.s, x.e FROM (SELECT rid, unnest(kept).n AS n FROM resolved) JOIN listed x USING (rid, n) JOIN t USING (rid))",
    ]
    return ",\n".join(made)


def resolve_sql(ordered: str) -> str:
    """Overlaps among an ordered list of one-element lists of {{s, e, r, v, ...}}: the fold of relational.resolve."""
    at = "list_position(list_transform(a, lambda y: x[1].s < y.e AND y.s < x[1].e), true)"
    weight = lambda c: f"{{'r': {c}.r, 'v': {c}.v, 'n': {c}.e - {c}.s}}"
    swapped = f"list_concat(list_concat(a[1:{at} - 1], x), a[{at} + 1:])"
    return f"list_reduce({ordered}, lambda a, x: CASE WHEN coalesce({at}, 0) = 0 THEN list_concat(a, x) WHEN {weight('x[1]')} > {weight(f'a[{at}]')} THEN {swapped} ELSE a END)"
