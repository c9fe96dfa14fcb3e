"""Folds as columns: values only, all inside the JVM, for relational plans and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t

WORD = r"[\p{L}\p{M}\p{N}]+"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def one_for_one(col: Column, table: dict[str, str]) -> Column:
    """Characters by a table; those replaced by nothing are deleted, those by more handled one after another."""
    single = {a: b for a, b in table.items() if len(b) == 1}
    gone = [a for a, b in table.items() if not b]
    out = F.translate(col, "".join([*single, *gone]), "".join(single.values()))
    for a, b in table.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ALPHABET.upper(), ALPHABET)


def strip_invisible(col: Column) -> Column:
    return F.translate(col, t.INVISIBLE, "")


def fold_width(col: Column) -> Column:
    wide = range(t.WIDE_FIRST, t.WIDE_LAST + 1)
    return F.translate(col, "".join(map(chr, wide)), "".join(chr(c - t.WIDE_SHIFT) for c in wide))


def fold_indic(col: Column) -> Column:
    """Characters of each script, then nasals before a virama, then runs of the virama."""
    out = one_for_one(col, t.indic_points())
    for rules in t.SCRIPTS.values():
        v = rules["virama"]
        if rules["nasals"]:
            out = F.regexp_replace(out, f"[{rules['nasals']}]{v}" + "+" * rules["runs"], rules["anusvara"])
        if rules["runs"]:
            out = F.regexp_replace(out, f"{v}{v}+", v)
    return out


def base_fold(col: Column) -> Column:
    """As texts.base_fold for text in NFC."""
    return fold_indic(F.lower(fold_width(strip_invisible(col))))


def fold_confusables(col: Column) -> Column:
    return one_for_one(col, t.confusables())


def strip_marks(col: Column) -> Column:
    return F.regexp_replace(col, r"(?<=[A-Za-z])[̀-ͯ]+", "")


def collapse_pairs(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)(.)\1{2,}", "$1$1")


def collapse_all(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)(.)\1+", "$1")


def leet_letters(token: Column) -> Column:
    """Signs and digits that stand for letters, one for one, for one token at a time (they look at most one character away)."""
    digits, letters = "".join(t.LEET_DIGITS), "".join(t.LEET_DIGITS.values())

    def word(w: Column) -> Column:
        n = F.length(F.regexp_replace(w, "[^a-z]", ""))
        whole = (n >= 2) | ((n == 1) & (F.length(w) >= 4) & ~w.rlike("^[0-9]{2}"))
        swapped = F.translate(w, digits, letters)
        beside = F.array_join(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.when(F.substring(w, i, F.lit(1)).rlike("[0-9]") & (F.substring(w, i + 1, F.lit(1)).rlike("[a-z]") | ((i > 1) & F.substring(w, i - 1, F.lit(1)).rlike("[a-z]"))), F.substring(swapped, i, F.lit(1))).otherwise(F.substring(w, i, F.lit(1)))), "")
        return F.when(~w.rlike("^[a-z0-9]"), w).when(w.rlike("^[0-9]"), F.when(whole, swapped).otherwise(w)).otherwise(beside)

    joined = F.array_join(F.transform(F.regexp_extract_all(token, F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0)), word), "")
    # arrays side by side: a lambda that named one itself would make it again for each character
    chars = F.split(token, "")
    beside = F.arrays_zip(chars.alias("c"), F.concat(F.array(F.lit("")), chars).alias("before"), F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))).alias("after"), F.split(joined, "").alias("made"))
    signs = F.transform(beside, lambda z: F.when(z["c"].isin(*t.LEET_SIGNS) & (F.coalesce(z["after"].rlike("[a-z]"), F.lit(False)) | z["before"].rlike("[a-z]")), F.translate(z["c"], "".join(t.LEET_SIGNS), "".join(t.LEET_SIGNS.values()))).otherwise(z["made"]))
    return F.when(token.rlike("[0-9" + "".join(t.LEET_SIGNS) + "]"), F.array_join(signs, "")).otherwise(token)


def fold_leet(token: Column) -> Column:
    """As the leet step: `ph` becomes f too."""
    return F.replace(leet_letters(token), F.lit("ph"), F.lit("f"))


def latin_fold(token: Column) -> Column:
    return collapse_pairs(fold_leet(strip_marks(fold_confusables(token))))


def skeleton_key(col: Column) -> Column:
    """As texts.skeleton_key; the input is in lower case. Letter groups pass through capitals so that none is replaced twice."""
    out = col
    for group, sound in t.SOUNDS.items():
        done = "".join(t.LETTERS.get(c, c) for c in sound)
        out = F.replace(out, F.lit(group), F.lit(done.upper()))
    out = F.replace(out, F.lit("x"), F.lit("ks"))
    single = {a: b for a, b in t.LETTERS.items() if len(b) == 1}
    out = F.lower(F.translate(out, "".join(single), "".join(single.values())))
    out = F.regexp_replace(out, "(?<=[a-z])h+", "")
    out = F.regexp_replace(out, "(?<=[a-z])[aeiou]+", "")
    out = F.regexp_replace(out, r"(?s)(.)\1+", "$1")
    out = F.regexp_replace(out, f"[^a-z{t.SPACES}]+", "")
    return F.regexp_replace(out, f"[{t.SPACES}]+", " ")


def profile(col: Column) -> Column:
    """What a text contains, as booleans that decide which folds and tiers can matter."""
    flags = {
        "all_ascii": r"^\p{ASCII}*$",
        "has_upper": "[A-Z]",
        "has_digit": "[0-9]",
        "has_mask": r"[*#@$%]",
        "has_tag": "[#@]",
        "has_leet": r"ph|[@431!|0$57269]",
        "has_stretch": r"(?s)(.)\1\1",
        "has_repeat": r"(?s)(.)\1",
        "has_mark": r"[̀-ͯ]",
        "has_spelled": r"(?s)\p{L}[ \t.\-_\n/].[ \t.\-_\n/].[ \t.\-_\n/]",
        "has_bound": r"[\p{L}\p{M}\p{N}][.\-][\p{L}\p{M}\p{N}]",
    }
    return F.struct(*[col.rlike(p).alias(k) for k, p in flags.items()])


def escaped(col: Column) -> Column:
    """For reports: characters that can't be seen or that look like others, as \\uXXXX; native scripts stay as they are."""
    shown = F.transform(F.split(col, ""), lambda c: F.when(c.rlike(f"[{t.ESCAPED}]"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))).otherwise(c))
    return F.array_join(shown, "")
