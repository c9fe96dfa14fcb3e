"""Ways in which words are hidden, as expressions of Spark SQL or of DuckDB, for evaluating recall.

A way is made of a few parts (characters exchanged, put in, repeated or left out), each of which writes the
same expression for either engine. A way that doesn't apply to a word is null for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import graphemes

VOWELS = "aeiou"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Which characters stand for which letters.
LEET_DIGIT = ("abegilostz", "4839110572")
LEET_SIGN = ("acilst", "@(!|$+")
CYRILLIC = ("acdehijkmopstxy", "асԁеһіјкморѕтху")
GREEK = ("abeikmnoptuvxy", "αβεικμηορτυνχγ")
ACCENTED = ("aceinouy", "áçéíñóúý")
EXTENDED = ("acdegilnorstuz", "āċđēġıłńōřşţūż")
SMALL_CAPS = ("abcdefghijklmnoprstuvwyz", "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ")
# Where alphabets of other forms start.
BOLD, CIRCLED, IN_BRACKETS, WIDE = 0x1D41A, 0x24D0, 0x249C, 0xFF41
# What is put between letters.
FIRE, ACUTE, ZERO_WIDTH, JOINER, NON_JOINER, SELECTOR = "\U0001f525", "́", "​", "͏", "‌", "️"
# Respellings, the first whose left side occurs counts; the second list replaces every one of its first.
CONSONANTS = (("ck", "k"), ("ph", "f"), ("c", "k"), ("ss", "zz"), ("s", "z"), ("f", "ph"), ("th", "t"), ("gh", "g"), ("kh", "k"), ("j", "z"), ("v", "w"), ("d", "dh"))


def alphabet(start: int) -> tuple[str, str]:
    return LOWER, "".join(chr(start + k) for k in range(26))


def text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "\n") + "'"


@dataclass(frozen=True)
class Engine:
    """How an engine writes what the two write differently. c is a character, i its place from 1."""

    name: str

    def joined(self, w: str, sep: str = "''") -> str:
        return f"array_join(split({w}, ''), {sep})" if self.name == "spark" else f"array_to_string(string_split({w}, ''), {sep})"

    def mapped(self, w: str, made: str) -> str:
        if self.name == "spark":
            return f"array_join(transform(split({w}, ''), (c, k) -> {made.replace('{i}', '(k + 1)')}), '')"
        return f"array_to_string(list_transform(string_split({w}, ''), lambda c, k: {made.replace('{i}', 'k')}), '')"

    def kept(self, w: str, test: str) -> str:
        if self.name == "spark":
            return f"array_join(filter(split({w}, ''), c -> {test}), '')"
        return f"array_to_string(list_filter(string_split({w}, ''), lambda c: {test}), '')"

    def first_twin(self, w: str) -> str:
        """Place of the first letter that equals the one before it, 0 if none does."""
        same = f"substr({w}, i, 1) = substr({w}, i - 1, 1)"
        if self.name == "spark":
            return f"(CASE WHEN exists(sequence(2, greatest(2, length({w}))), i -> {same} AND i <= length({w})) THEN cast(array_position(transform(sequence(2, greatest(2, length({w}))), i -> {same}), true) as int) + 1 ELSE 0 END)"
        return f"coalesce(nullif(list_position(list_transform(generate_series(2, length({w})), lambda i: {same}), true), 0) + 1, 0)::INT"


SPARK, DUCK = Engine("spark"), Engine("duck")
Way = Callable[[str, Engine], str]


def at_first(letters: str) -> Callable[[str], str]:
    """Place of the first of these letters; beyond the word if there is none."""
    return lambda w: f"(length(regexp_extract({w}, '^[^{letters}]*', 0)) + 1)"


def where(test: Callable[[str], str], way: Way) -> Way:
    return lambda w, e: f"CASE WHEN {test(w)} THEN {way(w, e)} END"


def least(n: int, way: Way) -> Way:
    return where(lambda w: f"length({w}) >= {n}", way)


def having(letters: str, way: Way) -> Way:
    return where(lambda w: f"length(regexp_extract({w}, '[{letters}]', 0)) > 0", way)


def swap_all(table: tuple[str, str]) -> Way:
    return having(table[0], lambda w, e: f"translate({w}, {text(table[0])}, {text(table[1])})")


def change(w: str, at: str, made: Callable[[str], str]) -> str:
    """w with what made gives for the letter at a place."""
    return f"concat(substr({w}, 1, {at} - 1), {made(f'substr({w}, {at}, 1)')}, substr({w}, {at} + 1))"


def swap_first(table: tuple[str, str], among: str = "") -> Way:
    letters = "".join(c for c in table[0] if not among or c in among)
    return having(letters, lambda w, e: change(w, at_first(letters)(w), lambda c: f"translate({c}, {text(table[0])}, {text(table[1])})"))


def put(place: int, what: str) -> Way:
    """what instead of the letter at a place."""
    return lambda w, e: change(w, str(place), lambda c: text(what))


def insert(after: int, what: str) -> Way:
    return lambda w, e: f"concat(substr({w}, 1, {after}), {text(what)}, substr({w}, {after + 1}))"


def vowel(made: Callable[[str], str]) -> Way:
    """What made gives for the first vowel."""
    return having(VOWELS, lambda w, e: change(w, at_first(VOWELS)(w), made))


def around(before: str, after: str, inner: Way = lambda w, e: w) -> Way:
    return lambda w, e: f"concat({text(before)}, {inner(w, e)}, {text(after)})"


def spaced(sep: str, inner: Way = lambda w, e: w) -> Way:
    return lambda w, e: e.joined(inner(w, e), text(sep))


def titled(w: str, e: Engine) -> str:
    return change(w, "1", lambda c: f"upper({c})")


def respelled(w: str, e: Engine) -> str:
    """The first of CONSONANTS that occurs, at its first place."""
    out = "NULL"
    for a, b in reversed(CONSONANTS):
        out = f"CASE WHEN instr({w}, '{a}') > 0 THEN concat(substr({w}, 1, instr({w}, '{a}') - 1), '{b}', substr({w}, instr({w}, '{a}') + {len(a)})) ELSE {out} END"
    return out


def revowelled(w: str, e: Engine) -> str:
    first = lambda a, b: f"WHEN instr({w}, '{a}') > 0 THEN concat(substr({w}, 1, instr({w}, '{a}') - 1), '{b}', substr({w}, instr({w}, '{a}') + 1))"
    return f"CASE WHEN instr({w}, 'i') > 0 THEN replace({w}, 'i', 'y') {first('u', 'oo')} {first('a', 'aa')} END"


def devowelled(w: str, e: Engine) -> str:
    out = e.kept(w, f"instr('{VOWELS}', c) = 0")
    return f"CASE WHEN length({out}) >= 3 AND length({out}) < length({w}) THEN {out} END"


def stretched_twin(w: str, e: Engine) -> str:
    at = e.first_twin(w)
    return f"CASE WHEN {at} > 0 THEN {change(w, at, lambda c: f'repeat({c}, 4)')} END"


leet = swap_first(LEET_DIGIT)
#: A word with its first leet digit in place, for ways on top of it; null without one.
on_leet = lambda way: lambda w, e: way(f"({leet(w, e)})", e)


def leet_stretch(times: int) -> Way:
    """After leet, the first vowel repeated, or else the end drawn out by three."""
    def way(w: str, e: Engine) -> str:
        drawn = f"concat({w}, repeat(substr({w}, length({w}), 1), 3))" if times == 4 else w
        return f"CASE WHEN length(regexp_extract({w}, '[{VOWELS}]', 0)) > 0 THEN {change(w, at_first(VOWELS)(w), lambda c: f'repeat({c}, {times})')} ELSE {drawn} END"

    return on_leet(way)


def masked_stretch(w: str, e: Engine) -> str:
    made = f"({leet_stretch(3)(w, e)})"
    return f"CASE WHEN length(({leet(w, e)})) >= 4 THEN upper({change(made, f'(length({made}) - 1)', lambda c: text('*'))}) END"


#: 61 ways of hiding words of Latin letters, by kind.
LATIN: dict[str, Way] = {
    "look.digit_first": leet, "look.digit_all": swap_all(LEET_DIGIT), "look.sign_all": swap_all(LEET_SIGN),
    "look.cyrillic_vowel": swap_first(CYRILLIC, VOWELS), "look.cyrillic_all": swap_all(CYRILLIC), "look.greek_vowel": swap_first(GREEK, VOWELS), "look.greek_all": swap_all(GREEK),
    "look.bold": swap_all(alphabet(BOLD)), "look.circled": swap_all(alphabet(CIRCLED)), "look.bracketed": swap_all(alphabet(IN_BRACKETS)), "look.wide": swap_all(alphabet(WIDE)),
    "look.accented": swap_all(ACCENTED), "look.extended": swap_all(EXTENDED), "look.small_caps": swap_all(SMALL_CAPS), "look.four_for_vowel": vowel(lambda c: "'4'"),
    "insert.zero_width": least(3, insert(2, ZERO_WIDTH)), "insert.acute": vowel(lambda c: f"concat({c}, {text(ACUTE)})"), "insert.acute_all": lambda w, e: e.mapped(w, f"concat(c, {text(ACUTE)})"), "insert.joiner": least(3, insert(2, JOINER)),
    "insert.dot": least(3, insert(2, ".")), "insert.two_dots": least(5, lambda w, e: f"concat(substr({w}, 1, 1), '.', substr({w}, 2, 2), '.', substr({w}, 4))"), "insert.picture": least(3, insert(2, FIRE)),
    "repeat.vowel": vowel(lambda c: f"repeat({c}, 5)"), "repeat.end": lambda w, e: f"concat({w}, repeat(substr({w}, length({w}), 1), 3))", "repeat.start": lambda w, e: f"concat(substr({w}, 1, 1), {w})", "repeat.all": lambda w, e: e.mapped(w, "concat(c, c)"), "repeat.twin": stretched_twin,
    "mask.one": least(4, put(3, "*")), "mask.two": least(4, lambda w, e: f"concat(substr({w}, 1, 1), '**', substr({w}, 4))"), "mask.three": least(5, lambda w, e: f"concat(substr({w}, 1, 1), '***', substr({w}, 5))"), "mask.hash": least(4, put(3, "#")), "mask.edge": put(1, "*"),
    "split.spaces": spaced(" "), "split.dots": spaced("."), "split.hyphens": spaced("-"), "split.lines": spaced("\n"), "split.slashes": spaced("/"), "split.beside_letters": around("u r a ", "", spaced(" ")), "split.plural": spaced(" ", lambda w, e: f"concat({w}, 's')"),
    "split.short": where(lambda w: f"length({w}) < 4", spaced(" ")), "split.two_chunks": least(4, insert(2, " ")), "split.three_chunks": least(6, lambda w, e: f"concat(substr({w}, 1, 2), ' ', substr({w}, 3, 2), ' ', substr({w}, 5))"),
    "case.upper": lambda w, e: f"upper({w})", "case.alternating": lambda w, e: e.mapped(w, "CASE WHEN {i} % 2 = 0 THEN upper(c) ELSE c END"), "case.title": titled,
    "context.hashtag": around("#", " trending now"), "context.handle": around("hey @", " look"), "context.url": around("https://example.com/", "-page"), "context.mail": around("write to ", "@example.com"), "context.pictures": around("", f" {FIRE * 3}"), "context.longer": around("#", "This", titled), "context.emphasis": around("**", "**"),
    "sound.no_vowels": devowelled, "sound.consonant": respelled, "sound.vowel": revowelled,
    "both.leet_mask": on_leet(least(4, put(3, "*"))), "both.lookalike_mask": lambda w, e: least(4, put(3, "*"))(f"({swap_first(CYRILLIC, VOWELS)(w, e)})", e), "both.leet_stretch": leet_stretch(4), "both.spaces_upper": spaced(" ", lambda w, e: f"upper({w})"), "both.leet_zero_width": on_leet(least(3, insert(2, ZERO_WIDTH))), "both.three": masked_stretch,
}

#: Six ways of hiding words of other scripts, between grapheme clusters: (clusters needed, first, put between, what follows).
NATIVE: dict[str, Callable[[list[str]], str | None]] = {
    "insert.non_joiner": lambda g: None if len(g) < 2 else g[0] + NON_JOINER + "".join(g[1:]),
    "insert.selector": lambda g: None if len(g) < 2 else g[0] + SELECTOR + "".join(g[1:]),
    "insert.dot": lambda g: None if len(g) < 2 else g[0] + "." + "".join(g[1:]),
    "repeat.cluster": lambda g: None if len(g) < 2 else g[0] + 3 * g[1] + "".join(g[1:]),
    "mask.one": lambda g: None if len(g) < 3 else g[0] + "*" + "".join(g[2:]),
    "context.hashtag": lambda g: "#" + "".join(g),
}


def evade(col: str, way: str) -> Column:
    """A column's words hidden in a way; null where it doesn't apply."""
    return F.expr(LATIN[way](f"`{col}`", SPARK))


def evade_native(col: Column | str) -> Column:
    """array<struct<way, hidden>> of the native ways that apply to a word."""
    @F.pandas_udf("array<struct<way:string,hidden:string>>")
    def run(words: pd.Series) -> pd.Series:
        def all_of(w: str | None) -> list[dict]:
            clusters = [w[a:b] for a, b in graphemes(w)] if w else []
            return [{"way": name, "hidden": made} for name, fn in NATIVE.items() if clusters and (made := fn(clusters)) is not None]

        return words.map(all_of)

    return run(col)


def duck(word: str, way: str) -> str:
    """The same in DuckDB's SQL, of a column named word."""
    return LATIN[way](word, DUCK)


def duck_native(word: str) -> dict[str, str]:
    """The native ways in DuckDB's SQL, of a column named word."""
    n, first, rest = f"length_grapheme({word})", f"substring_grapheme({word}, 1, 1)", f"substring_grapheme({word}, 2)"
    between = lambda what: f"CASE WHEN {n} >= 2 THEN {first} || {what} || {rest} END"
    return {
        "insert.non_joiner": between(text(NON_JOINER)), "insert.selector": between(text(SELECTOR)), "insert.dot": between("'.'"), "repeat.cluster": between(f"repeat(substring_grapheme({word}, 2, 1), 3)"),
        "mask.one": f"CASE WHEN {n} >= 3 THEN {first} || '*' || substring_grapheme({word}, 3) END", "context.hashtag": f"'#' || {word}",
    }
