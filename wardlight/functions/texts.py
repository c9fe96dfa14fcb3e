"""Folds of single texts in Python, with offsets on demand, for the scan kernel.

A fold is a list of steps; a step replaces the matches of a pattern. Without offsets a step is one
call of the pattern's sub; with offsets the same matches are walked once more. So texts without a
candidate, nearly all, never pay for offsets, and both forms come from one definition.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import regex

from . import tables as t


@dataclass(frozen=True)
class Step:
    """Replaces each match of pattern by make, a function of it or a template; keep: output character i stems from input character start + i, else all from start."""

    pattern: re.Pattern
    make: Callable[[re.Match], str] | str
    keep: bool = False

    def value(self, text: str) -> str:
        return self.pattern.sub(self.make, text)

    def offsets(self, text: str, at: list[int]) -> tuple[str, list[int]]:
        out, places, end = [], [], 0
        for m in self.pattern.finditer(text):
            made = m.expand(self.make) if isinstance(self.make, str) else self.make(m)
            out += [text[end : m.start()], made]
            places += at[end : m.start()]
            places += at[m.start() : m.start() + len(made)] if self.keep else [at[m.start()]] * len(made) if made else []
            end = m.end()
        return "".join([*out, text[end:]]), places + at[end:]


class Table(dict):
    """For str.translate: characters of make(c) of length one, made when first met."""

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make = make

    def __missing__(self, cp: int) -> int:
        made = self.make(chr(cp))
        self[cp] = ord(made) if len(made) == 1 else cp
        return self[cp]


@dataclass(frozen=True)
class Swap:
    """Replaces characters one for one, so offsets stay."""

    table: dict
    #: Whether ASCII characters can be among those replaced.
    ascii: bool = True

    def value(self, text: str) -> str:
        return text if not self.ascii and text.isascii() else text.translate(self.table)

    def offsets(self, text: str, at: list[int]) -> tuple[str, list[int]]:
        return self.value(text), at


INDIC = t.indic_points()


def point(c: str) -> str:
    """One character without invisibles and full width, in the script's plain form, in lower case."""
    if c in t.INVISIBLE:
        return ""
    if t.WIDE_FIRST <= ord(c) <= t.WIDE_LAST:
        c = chr(ord(c) - t.WIDE_SHIFT)
    if "ऀ" <= c <= "෿":
        return INDIC.get(c, c)
    return c.lower()


def clusters() -> list[Step]:
    """Nasals with a virama become the anusvara, then runs of a virama one."""
    nasal, runs, made = [], [], {}
    for rules in t.SCRIPTS.values():
        if rules["nasals"]:
            nasal.append(f"[{rules['nasals']}]{rules['virama']}" + "+" * rules["runs"])
            made |= dict.fromkeys(rules["nasals"], rules["anusvara"])
        if rules["runs"]:
            runs.append(rules["virama"])
    return [Step(regex.compile("|".join(nasal)), lambda m: made[m[0][0]]), Step(regex.compile(f"([{''.join(runs)}])\\1+"), lambda m: m[1])]


#: Characters whose plain form isn't one character.
LONGER = regex.compile("[" + t.INVISIBLE + "".join(c for c, r in INDIC.items() if len(r) != 1) + "İ]")
SEGMENT = regex.compile(r"(?s).\p{M}+")
LOOSE_SEGMENT = regex.compile(r"(?s)[^\x00-\x7f]\p{M}*|.\p{M}+")
MARK = regex.compile(r"\p{M}")
NFC = [Step(SEGMENT, lambda m: unicodedata.normalize("NFC", m[0]))]
LOOSE_NFC = [Step(LOOSE_SEGMENT, lambda m: unicodedata.normalize("NFC", m[0]))]
POINTS = [Step(LONGER, lambda m: point(m[0])), Swap(Table(point))]
CLUSTERS = clusters()
ASCII_LOWER = [Swap({c: c + 32 for c in range(65, 91)})]

CONFUSABLES = [Swap({ord(a): ord(b) for a, b in t.confusables().items()}, ascii=False)]
MARKS = [Step(re.compile(r"(?<=[A-Za-z])[̀-ͯ]+"), "")]
DIGIT_TOKEN = re.compile(r"(?<![a-z0-9])(?=[a-z]*[0-9])[a-z0-9]+")


def digit_token(w: str) -> str:
    """A token of a-z and digits with the digits that count as letters replaced; same length."""
    letters = sum(c.isalpha() for c in w)
    if not w[0].isdigit():
        return "".join(t.LEET_DIGITS.get(c, c) if (i + 1 < len(w) and w[i + 1].isalpha()) or w[i - 1].isalpha() else c for i, c in enumerate(w))
    if letters >= 2 or (letters == 1 and len(w) >= 4 and not w[1].isdigit()):
        return "".join(t.LEET_DIGITS.get(c, c) for c in w)
    return w


def leet(m: re.Match) -> str:
    w = m[0]
    return t.LEET_SIGNS[w] if w in t.LEET_SIGNS else digit_token(w)


class Leet:
    """ph becomes f; signs beside a letter and digits by their token become letters, all judged on the input."""

    signs = Step(re.compile(DIGIT_TOKEN.pattern + r"|(?<=[a-z])[@!|$]|[@!|$](?=[a-z])"), leet, keep=True)
    ph = re.compile("ph")

    def value(self, text: str) -> str:
        return self.offsets(text, None)[0]

    def offsets(self, text: str, at: list[int] | None) -> tuple[str, list[int] | None]:
        swapped = self.signs.value(text)
        out, places, end = [], [], 0
        for m in self.ph.finditer(text):  # of the input: a sign never becomes p or h
            out += [swapped[end : m.start()], "f"]
            if at is not None:
                places += [*at[end : m.start()], at[m.start()]]
            end = m.end()
        out.append(swapped[end:])
        return "".join(out), None if at is None else places + at[end:]


PAIRS = [Step(re.compile(r"(?s)(.)\1{2,}"), r"\1\1", keep=True)]
SINGLES = [Step(re.compile(r"(?s)(.)\1+"), r"\1")]
LATIN = [*CONFUSABLES, *MARKS, Leet(), *PAIRS]
SKELETON = [
    Step(re.compile("|".join(t.SOUNDS)), lambda m: t.SOUNDS[m[0]]),
    Step(re.compile("x"), "ks"),
    Swap({ord(a): ord(b) for a, b in t.LETTERS.items() if len(b) == 1}),
    Step(re.compile("(?<=[a-z])h+"), ""),
    Step(re.compile("(?<=[a-z])[aeiou]+"), ""),
    *SINGLES,
    Step(re.compile(f"[^a-z{t.SPACES}]+"), ""),
    Step(re.compile(f"[{t.SPACES}]+"), " "),
]


def base_steps(text: str) -> list:
    """The steps of the base fold for this text: ASCII texts are only put into lower case."""
    if text.isascii():
        return ASCII_LOWER
    if not unicodedata.is_normalized("NFC", text):
        return [*LOOSE_NFC, *POINTS, *CLUSTERS]
    return [*NFC, *POINTS, *CLUSTERS] if MARK.search(text) else POINTS


def run(steps: list, text: str) -> str:
    for s in steps:
        text = s.value(text)
    return text


def trace(steps: list, text: str, at: list[int] | None = None) -> tuple[str, list[int]]:
    """The folded text and, for each of its characters, where it stems from."""
    at = list(range(len(text))) if at is None else at
    for s in steps:
        text, at = s.offsets(text, at)
    return text, at


def base_fold(text: str) -> str:
    return run(base_steps(text), text)


def latin_fold(text: str) -> str:
    return run(LATIN, text)


def skeleton_key(word: str) -> str:
    """How a word sounds: consonants only, but for a first vowel. The input is in lower case."""
    return run(SKELETON, word)


BLANK = re.compile(f"([{t.SPACES}]+)")


class Words:
    """latin, single and sounding forms of whole texts from those of their words, which are kept.

    No step of these folds looks over white space, so a text's fold is that of its words with the
    white space between; runs of it are shortened as the steps would. Texts repeat their words, so
    most cost a lookup. note(word) adds what else is to be known of a word.
    """

    def __init__(self, note: Callable[[str], int], most: int = 200_000):
        self.note, self.most = note, most
        self.kept: dict[str, tuple[str, str, str, int]] = {}

    def learn(self, words: list[str]) -> None:
        """Folds new words together, a line each: no step looks over a line's end, and none but the last joins lines."""
        lines = run(LATIN, "\n".join(words))
        single, sound = run(SINGLES, lines), run(SKELETON[:-1], lines)
        for word, *made in zip(words, lines.split("\n"), single.split("\n"), sound.split("\n"), strict=True):
            self.kept[word] = (*made, self.note(made[0]))

    def fold(self, base: str) -> Folded:
        return Folded(self, base)


class Folded:
    """latin, single, sound and the union of the notes of a base text, and for each fold the parts that it is
    made of: (parts of the base text, what became of each)."""

    def __init__(self, words: Words, base: str):
        parts = BLANK.split(base)
        kept = words.kept
        if len(kept) > words.most:
            kept.clear()
        if new := [w for w in dict.fromkeys(parts[::2]) if w not in kept]:
            words.learn(new)
        self.parts = parts
        self.made = made = [kept[w] for w in parts[::2]]
        self.notes = 0
        for m in made:
            self.notes |= m[3]
        blanks = parts[1::2]
        self.alike = max(map(len, blanks), default=0) < 2  # white space that no step shortens
        self.pairs = blanks if self.alike else [run(PAIRS, b) for b in blanks]
        self.singles = blanks if self.alike else [run(SINGLES, b) for b in blanks]
        self.latin, self.single = "".join(self.latin_parts[1]), "".join(self.single_parts[1])
        sounds = [m[2] for m in made]
        said = " ".join(filter(None, sounds))
        if said and blanks:
            said = " " * (not sounds[0]) + said + " " * (not sounds[-1])
        elif blanks:
            said = " "
        self.sound = said

    def __iter__(self):
        return iter((self.latin, self.single, self.sound, self.notes))

    def woven(self, k: int, blanks: list[str]) -> tuple[list[str], list[str]]:
        out = [""] * len(self.parts)
        out[::2] = [m[k] for m in self.made]
        out[1::2] = blanks
        return self.parts, out

    @property
    def latin_parts(self) -> tuple[list[str], list[str]]:
        return self.woven(0, self.pairs)

    @property
    def single_parts(self) -> tuple[list[str], list[str]]:
        return self.woven(1, self.singles)

    @property
    def sound_parts(self) -> tuple[list[str], list[str]]:
        """White space becomes one blank between words that sound; that blank is said to stem from the first of it."""
        parts, out = self.woven(2, [""] * (len(self.parts) // 2))
        said = [k for k in range(0, len(parts), 2) if out[k]]
        gaps = {k + 1 for k in said[:-1]}
        if len(parts) > 1 and (not said or said[0]):
            gaps.add(1)
        if said and said[-1] < len(parts) - 1:
            gaps.add(said[-1] + 1)
        for k in gaps:
            out[k] = " "
        return parts, out


#: The folds of Words, by name.
FOLDS = {"latin": LATIN, "single": [*LATIN, *SINGLES], "sound": [*LATIN, *SKELETON[:-1]]}


@lru_cache(maxsize=50_000)
def traced(fold: str, part: str) -> list[int]:
    """Where each character of a folded part of a base text stems from in it."""
    return trace(FOLDS[fold], part)[1]


def forms(term: str) -> list[str]:
    """A dictionary term's base and latin forms, each once, empty ones left out."""
    base = base_fold(term)
    return [f for f in dict.fromkeys((base, latin_fold(base))) if f]


def graphemes(text: str) -> list[tuple[int, int]]:
    """Extended grapheme clusters as character ranges."""
    return [m.span() for m in regex.finditer(r"\X", text)]


# Viramas that join the next letter in the plain rule.
JOINING = "\u094d\u09cd\u0bcd\u0c4d\u0ccd\u0d4d"
PLAIN_CLUSTER = regex.compile(rf"(?s).(?:[\p{{M}}\u200c\u200d]|(?<=[{JOINING}\u200d]).)*")


def plain_graphemes(text: str) -> list[tuple[int, int]]:
    """Clusters by a plain rule, where no full segmentation is at hand: marks and joiners extend, and a joiner or a virama takes the next character along."""
    return [m.span() for m in PLAIN_CLUSTER.finditer(text)]


#: Two ASCII characters always lie in different clusters, but for a line's two ends.
APART = re.compile(r"(?!\r\n)[\x00-\x7f](?=[\x00-\x7f])")


def clusters_over(text: str, a: int, b: int) -> tuple[int, int]:
    """Where the grapheme clusters that a span (not empty) touches begin and end; only the text from one sure boundary to the next is cut."""
    start = a
    while start > 0 and not APART.match(text, start - 1):
        start -= 1
    m = APART.search(text, b - 1)
    parts = [(start + x, start + y) for x, y in graphemes(text[start : m.end() if m else len(text)])]
    return next(x for x, y in parts if y > a), next(y for _, y in parts if y >= b)


def censor_text(text: str, spans: list[tuple[int, int]], mask: str = "*", keep_first: bool = False) -> str:
    """text with a mask for each grapheme cluster that a span touches; spans may overlap or lie outside.

    keep_first leaves the first cluster of each covered stretch.
    """
    wanted = sorted((max(0, a), min(len(text), b)) for a, b in spans)
    covered: list[list[int]] = []
    for a, b in wanted:
        if a >= b:
            continue
        first, last = clusters_over(text, a, b)
        if covered and first < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], last)
        else:
            covered.append([first, last])
    out, end = [], 0
    for first, last in covered:
        parts = graphemes(text[first:last])
        shown = text[first : first + parts[0][1]] if keep_first else ""
        out += [text[end:first], shown, mask * (len(parts) - (1 if keep_first else 0))]
        end = last
    return "".join([*out, text[end:]])
