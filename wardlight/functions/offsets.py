"""Folds as columns that keep offsets: a text, and for each of its characters where it stems from.

A step first marks: it makes a text as long as the one before, with GONE where a character goes.
Then it keeps what isn't gone, of the text and of the offsets alike, so steps compose by indexing,
and all of it stays inside the JVM. A character that becomes several passes its offset on to each.
The input is in NFC. Steps are linear in the text; texts without a hit needn't be traced at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as c
from . import tables as t

#: Private characters: what goes, and the sound of two letters until it is spelled.
GONE, TWO = "\ue000", "\ue001"
SPELLED = {TWO: "ks"}


@dataclass(frozen=True)
class Traced:
    """text, and at: array<int> with an offset into the original for each character of text."""

    text: Column
    at: Column

    def beside(self, *chars: Column) -> Column:
        """The offsets zipped with arrays as long as text; a lambda that named an array itself would make it again for each element."""
        return F.arrays_zip(self.at.alias("at"), *[x.alias(f"c{i}") for i, x in enumerate(chars)])

    def marked(self, made: Column) -> Traced:
        """made: as long as text, with GONE for what goes."""
        stays = F.filter(self.beside(F.split(made, "")), lambda z: z["c0"] != GONE)
        return Traced(F.translate(made, GONE, ""), F.transform(F.filter(stays, lambda z: z["at"].isNotNull()), lambda z: z["at"]))

    def each(self, made: Column) -> Traced:
        """made: as long as text, nothing goes."""
        return Traced(made, self.at)

    def longer(self, table: dict[str, str]) -> Traced:
        """Characters by what is longer; each new character stems from where the old one did."""
        text = self.text
        for a, b in table.items():
            text = F.replace(text, F.lit(a), F.lit(b))

        def spread(z: Column) -> Column:
            own = F.array(z["at"])
            for x, y in table.items():
                own = F.when(z["c0"] == x, F.array_repeat(z["at"], len(y))).otherwise(own)
            return own

        return Traced(text, F.when(self.text.rlike("[" + "".join(table) + "]"), F.flatten(F.transform(self.beside(F.split(self.text, "")), spread))).otherwise(self.at))

    def runs(self, most: int) -> Traced:
        """Runs of a character are cut to `most`; the first ones stay."""
        chars = F.split(self.text, "")
        shifted = [F.concat(F.array_repeat(F.lit(""), k), chars) for k in range(1, most + 1)]

        def stays(z: Column) -> Column:
            same = z["at"].isNotNull()
            for k in range(1, most + 1):
                same = same & (z[f"c{k}"] == z["c0"])
            return z["at"].isNotNull() & ~same

        return Traced(F.regexp_replace(self.text, r"(?s)(.)\1{%d,}" % most, "$1" * most), F.transform(F.filter(self.beside(chars, *shifted), stays), lambda z: z["at"]))

    def span(self, start: Column, end: Column) -> tuple[Column, Column]:
        """Where characters start to end (behind the last) of text lie in the original."""
        first = F.get(self.at, start)
        return first, F.greatest(F.get(self.at, end - 1) + 1, first + 1)


def original(text: Column) -> Traced:
    return Traced(text, F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda _, i: i))


def base(x: Traced) -> Traced:
    """As texts.base_fold of text in NFC."""
    points = t.indic_points()
    gone = t.INVISIBLE + "".join(a for a, b in points.items() if not b)
    longer = {a: b for a, b in points.items() if len(b) > 1}
    x = x.longer({"\u0130": "i\u0307"} | longer)
    wide = range(t.WIDE_FIRST, t.WIDE_LAST + 1)
    single = {a: b for a, b in points.items() if len(b) == 1}
    made = F.translate(x.text, gone + "".join(map(chr, wide)) + "".join(single), GONE * len(gone) + "".join(chr(w - t.WIDE_SHIFT) for w in wide) + "".join(single.values()))
    x = x.marked(F.lower(made))
    indic, marked = x.text.rlike("[\u0900-\u0dff]"), x.text
    for rules in t.SCRIPTS.values():
        v = rules["virama"]
        if rules["nasals"]:
            again = r"|(?<!^)\G" if rules["runs"] else ""
            marked = F.regexp_replace(marked, f"(?:(?<=[{rules['nasals']}]){again}){v}", GONE)
            marked = F.regexp_replace(marked, f"[{rules['nasals']}](?={GONE})", rules["anusvara"])
    x = x.marked(F.when(indic, marked).otherwise(x.text))
    marked = x.text
    for rules in t.SCRIPTS.values():
        if rules["runs"]:
            marked = F.regexp_replace(marked, f"(?<={rules['virama']}){rules['virama']}", GONE)
    return x.marked(F.when(indic, marked).otherwise(x.text))


def latin(x: Traced) -> Traced:
    """As texts.latin_fold of one token in the base fold."""
    x = x.each(c.fold_confusables(x.text))
    x = x.marked(F.regexp_replace(x.text, r"(?:(?<=[A-Za-z])|(?<!^)\G)[\u0300-\u036f]", GONE))
    x = x.marked(F.replace(c.leet_letters(x.text), F.lit("ph"), F.lit("f" + GONE)))
    return x.runs(2)


def single(x: Traced) -> Traced:
    """The latin fold with runs of one."""
    return x.runs(1)


def sound(x: Traced) -> Traced:
    """As texts.skeleton_key of text in lower case."""
    marked = x.text
    for group, said in t.SOUNDS.items():
        done = TWO if len(said) > 1 else t.LETTERS.get(said, said).upper()
        marked = F.replace(marked, F.lit(group), F.lit(done + GONE * (len(group) - 1)))
    one = {a: b for a, b in t.LETTERS.items() if len(b) == 1}
    marked = F.lower(F.translate(marked, "x" + "".join(one), TWO + "".join(one.values())))
    x = x.marked(marked).longer(SPELLED)
    x = x.marked(F.regexp_replace(x.text, "(?<=[a-z])h", GONE))
    x = x.marked(F.regexp_replace(x.text, "(?<=[a-z])[aeiou]", GONE))
    x = x.runs(1)
    x = x.marked(F.regexp_replace(x.text, f"[^a-z{t.SPACES}]", GONE))
    return x.marked(F.regexp_replace(F.regexp_replace(x.text, f"(?<=[{t.SPACES}])[{t.SPACES}]", GONE), f"[{t.SPACES}]", " "))


def fields(x: Traced) -> list[Column]:
    return [x.text.alias("text"), x.at.alias("at")]
