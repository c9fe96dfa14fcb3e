"""The scan of one text: every tier, vetoes and overlap resolution, with spans into the original.

A text is read in passes: the base fold, the latin fold, the latin fold with runs collapsed, and
how words sound. Passes are folded without offsets; offsets are made for passes with a hit only.

Texts repeat their words, and what a word between blanks can take part in is known once it was seen
by itself. So only stretches around words that may be part of a match are read in passes (Sieve).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from itertools import accumulate

import regex

from ..functions import tables as t
from ..functions import texts
from ..sources.lexicon import Entry, Options

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]")
WORDS = regex.compile(r"(?:(?![\U00010000-\U0010ffff])[\p{L}\p{M}\p{N}])+")
LETTER = regex.compile(r"\p{L}")
STRETCH = regex.compile(r"(?s)(.)\1\1")
MASKED = regex.compile(r"[\p{L}\p{M}*#@$%]+")
DIGIT_MASKED = regex.compile(r"(?<![\p{L}\p{M}\p{N}*#@$%])(?=(?:(?![0-9])[\p{L}\p{M}\p{N}*#@$%])*+[0-9])[\p{L}\p{M}\p{N}*#@$%]+")
PICTURE = regex.compile(r"\p{Extended_Pictographic}")
PICTURED = regex.compile(r"(?:[\p{L}\p{M}]|\p{Extended_Pictographic})+")
DIGIT = regex.compile("[0-9]")
PIECE = r"(?:(?![\U00010000-\U0010ffff])[\p{L}\p{M}\p{N}])"
CHUNKS = regex.compile(rf"(?<!{PIECE}){PIECE}{{1,5}}+(?:[.\- \t]{PIECE}{{1,5}}+)+(?!{PIECE})")
ASCII_CHUNKS = re.compile(r"(?<![a-z0-9])[a-z0-9]{1,5}+(?:[.\- \t][a-z0-9]{1,5}+)+(?![a-z0-9])")
FIRST_PIECES = re.compile(r"[^.\- \t]+")
WORD_END = regex.compile(PIECE)
TAGGED = regex.compile(r"(?<![\p{L}\p{M}\p{N}])[#@][\p{L}\p{N}_]+")
SEAM = regex.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
SPELLED = regex.compile(r"(?s)(?=\p{L}[ \t.\-_\n/].[ \t.\-_\n/].[ \t.\-_\n/])")
SPELLED_ASCII = re.compile(r"[a-z](?:[ \t.\-_\n/][a-z]){3}")
# Ranks of the tiers where spans overlap; letters that may stand before a spelled-out word.
RANK = {"exact": 2, "masked": 2, "separated": 2, "skeleton": 0}
ARTICLES = "aio"
SPELLED_LEAST, CHUNKS_MOST, TAIL_MOST = 4, 4, 3
#: Notes on words: may begin a chunked word; may be part of a spelled-out one.
CHUNK, SPELL = 1, 2
SPELL_SHAPE = regex.compile(r"(?s)^.$|.[.\-_/].[.\-_/]|^.?[.\-_/].[.\-_/]|[.\-_/].[.\-_/]?$|^[.\-_/].$")


@dataclass
class Found:
    """A candidate: span, tier, entry, and the part of the span that an allow phrase has to cover."""

    start: int
    end: int
    tier: str
    entry: Entry
    core: tuple[int, int] | None = None

    @property
    def tested(self) -> tuple[int, int]:
        return self.core or (self.start, self.end)


class Finder:
    """All places of all patterns in a text, by end and then the longer first."""

    def __init__(self, patterns: list[str]):
        self.patterns = [p for p in patterns if p]
        try:
            import ahocorasick
        except ImportError:
            self.machine, self.by_first = None, {}
            for p in self.patterns:
                self.by_first.setdefault(p[0], []).append(p)
        else:
            self.machine = ahocorasick.Automaton()
            for p in self.patterns:
                self.machine.add_word(p, p)
            if self.patterns:
                self.machine.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, str]]:
        if not self.patterns:
            return iter(())
        if self.machine is not None:
            return ((end + 1 - len(p), end + 1, p) for end, p in self.machine.iter(text))
        hits = [(i, i + len(p), p) for i, c in enumerate(text) for p in self.by_first.get(c, ()) if text.startswith(p, i)]
        return iter(sorted(hits, key=lambda h: (h[1], h[0])))


class Pass:
    """A fold of the original. origin(i) is where its character i stems from, made when first asked for.

    A fold of words (see texts.Words) is traced word by word, for those that a hit lies in; else the
    whole text is.
    """

    def __init__(self, original: str, text: str, steps: list, base: Pass | None = None, fold: str = "", words: texts.Folded | None = None):
        self.original, self.text, self.steps, self.base, self.fold, self.words = original, text, steps, base, fold, words
        self.same = base is None and steps is texts.ASCII_LOWER

    @cached_property
    def at(self) -> list[int]:
        text, at = texts.trace(self.steps, self.original)
        assert text == self.text
        return at

    @cached_property
    def parts(self) -> tuple[list[str], list[str]]:
        return getattr(self.words, f"{self.fold}_parts")

    @cached_property
    def starts(self) -> tuple[list[int], list[int]]:
        """Where each part starts, in the base text and in the fold."""
        return [0, *accumulate(map(len, self.parts[0]))], [0, *accumulate(map(len, self.parts[1]))]

    def origin(self, i: int) -> int:
        if self.same:
            return i
        if self.base is None:
            return self.at[i]
        k = bisect_right(self.starts[1], i) - 1
        before, after = self.parts[0][k], self.parts[1][k]
        j = i - self.starts[1][k]
        return self.base.origin(self.starts[0][k] + (j if before == after else texts.traced(self.fold, before)[j]))

    def span(self, start: int, end: int) -> tuple[int, int]:
        first = self.origin(start)
        return first, max(self.origin(end - 1) + 1, first + 1)

    def open_at(self, i: int) -> bool:
        """Whether the character at i isn't part of a word, in the pass or in the original."""
        if not 0 <= i < len(self.text):
            return True
        c = self.text[i]
        if not c.isalnum() and not WORD.match(c):
            return True
        c = self.original[self.origin(i)]
        return not c.isalnum() and not WORD.match(c)

    def open_around(self, start: int, end: int) -> bool:
        return self.open_at(start - 1) and self.open_at(end)


def word_before(text: str, end: int) -> str:
    """The word that ends at `end`, found by walking back from there."""
    start = end
    while start > 0 and WORD.match(text[start - 1]):
        start -= 1
    return text[start:end]


class Cover:
    """Whether any of given spans covers one: those that start no later, by the furthest of their ends."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.reach = [a for a, _ in spans], [*accumulate((b for _, b in spans), max)]

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and self.reach[k] >= end


def severest(entries: list[Entry]) -> Entry:
    """The first of the highest severity."""
    return max(entries, key=lambda e: e.severity)


def merged(a: Entry, b: Entry) -> Entry:
    """Two entries of one lemma and span: the severer one's data, both's categories, casual only if both are."""
    if a is b:
        return a
    lead, other = (b, a) if b.severity > a.severity else (a, b)
    return replace(lead, categories=tuple(dict.fromkeys(lead.categories + other.categories)), casual_use=a.casual_use and b.casual_use)


#: What a piece of a text, cut at white space, may take part in: a match that lies in it or begins at its end; one that depends on the
#: run of short words around it; it is a lone letter, ends in one, begins with one; it ends with the head of a form, may go on
#: with one; it holds a word that no run of short words goes over.
HIT, WIDE, LONE, ENDS, BEGINS, HEAD, NEXT, LONG = (1 << k for k in range(8))
#: White space between pieces; an invisible character doesn't end a piece.
PIECES = re.compile(f"([{''.join(c for c in t.SPACES if c not in t.INVISIBLE)}]+)")
#: What str.split takes for white space and PIECES doesn't.
ODD_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not PIECES.match(c)).replace("\\", "") + "]")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Signs behind a word that no fold makes a letter of.
ENDING = ",.;:?"
#: What stands between stretches: no tier reads over two line ends.
GLUE = "\n\n"
#: Characters that aren't marks and whose plain form has one, which is folded by what else is in the text.
MARKED = {c for c, made in texts.INDIC.items() if not texts.MARK.match(c) and texts.MARK.search(made)}


def having(*bits: int) -> bytes:
    """A character class of the bytes that have any of some bits."""
    return b"[" + b"".join(re.escape(bytes([v])) for v in range(256) if any(v & b for b in bits)) + b"]"


#: Letters that every base fold leaves, and their plain ones.
PLAIN = dict(zip(map(chr, range(97, 123)), map(chr, range(97, 123)), strict=True)) | {a: b for a, b in t.confusables().items() if a.isalpha() and a.lower() == a and unicodedata.is_normalized("NFC", a) and a <= "\uffff" and not texts.LONGER.match(a) and texts.point(a) == a and b.isascii() and b.isalpha() and b.islower()}
#: One long word of such letters that the latin fold leaves as long as it is.
LONG_WORD = re.compile(f"(?!.*ph|.*(.)\\1\\1)[{''.join(map(re.escape, PLAIN))}]{{7,}}[{ENDING}]?")
RUN = re.compile(r"(.)\1+")


def coarse_table() -> dict[int, str]:
    """For str.translate: consonants as the classes that the rules of sounds leave alone; all else but line ends goes."""
    kind = {c: c for c in "bcdfgjklmnpqrstvwyz"} | dict.fromkeys("aeiouh", "") | {"x": "ks"}
    rules = [("ph", "f"), *t.SOUNDS.items(), *t.LETTERS.items()]
    over = lambda x: RUN.sub(r"\1", "".join(kind.get(c, "") for c in x))
    for _ in range(64):
        apart = next(((over(a), over(b)) for a, b in rules if over(a) != over(b)), None)
        if apart is None:
            break
        one = [*apart[0], *apart[1]]  # letters that a rule swaps are of one class, those that it drops of none
        to = "" if "" in apart else min(one)
        kind = {c: "".join(to if y in one else y for y in k) for c, k in kind.items()}
    return {ord(a): kind[b] for a, b in PLAIN.items()} | {ord(x): "" for x in ENDING}


COARSE = coarse_table()


def coarse(text: str) -> str:
    """Letters as classes of sounds, runs as one: where a form or a sound begins a word, its coarse form begins the word's."""
    return RUN.sub(r"\1", text.translate(COARSE))


class Sieve:
    """Which stretches of a text can hold a match: those around pieces that hit by themselves, as read by the scanner's own
    tiers, around lone letters beside lone letters and around short words that begin a form together.

    A stretch has the pieces around it that a phrase or an allow phrase can reach, and where a match depends on the run of
    short words that it lies in, all of that run.
    """

    def __init__(self, scanner: Scanner, most: int = 600_000, most_chars: int = 8_000_000):
        self.scanner, self.most, self.most_chars = scanner, most, most_chars
        forms = [*scanner.exact, *scanner.collapsed, *scanner.options.allowed]
        #: Whether forms are words one blank apart and sounds are words, as all that is said here needs.
        self.fair = all(f.split() == f.split(" ") for f in forms) and all(k.split() == [k] for k in scanner.sounds)
        self.firsts = tuple(dict.fromkeys(f.split(" ")[0] for f in (*scanner.exact, *scanner.collapsed) if " " in f))
        fit = {f: own for forms in (scanner.exact, scanner.collapsed) for f, own in forms.items() if all(c in PLAIN or c in ENDING for c in f)}
        self.equal = {coarse(f) for f in fit}
        self.starts = tuple({coarse(f) for f, own in fit.items() if any(e.match_mode == "prefix" for e in own)} | {coarse(k) for k in scanner.sounds})
        self.stops = tuple({coarse(f) for f in self.firsts if all(c in PLAIN or c in ENDING for c in f)})
        self.inner = {f[i : i + 2] for f in scanner.exact for i in range(1, len(f))}
        self.reach = max((f.count(" ") + 1 for f in forms), default=1) + 2
        self.kept: dict[str, int] = {"": 0}
        self.chars = 0
        self.edges: dict[str, tuple[str, str]] = {}
        self.hit, self.wide = re.compile(having(HIT, WIDE)), having(WIDE)
        self.lone = re.compile(b"(?<=" + having(ENDS) + b")" + having(LONE) + b"(?=" + having(BEGINS) + b")")
        self.pair = re.compile(having(HEAD) + b"(?=" + having(NEXT) + b")")

    def flags(self, pieces: list[str]) -> bytes:
        if len(self.kept) > self.most or self.chars > self.most_chars:
            self.kept, self.chars = {"": 0}, 0
        found = [*map(self.kept.get, pieces)]
        if None in found:
            self.learn([*dict.fromkeys(p for p, v in zip(pieces, found, strict=True) if v is None)])
            found = map(self.kept.__getitem__, pieces)
        return bytes(found)

    def learn(self, new: list[str]) -> None:
        """Long words that begin like no form are told by that; all others are read."""
        words = [p for p in new if LONG_WORD.fullmatch(p)]
        quiet = [p for p, x in zip(words, coarse("\n".join(words)).split("\n"), strict=True) if x not in self.equal and not x.startswith(self.starts) and not (self.stops and x.endswith(self.stops))] if words else []
        self.kept.update(dict.fromkeys(quiet, LONG | NEXT))
        self.chars += sum(map(len, quiet))
        if len(quiet) < len(new):
            self.learn_read([p for p in new if p not in self.kept] if quiet else new)

    def learn_read(self, new: list[str]) -> None:
        """Reads new pieces together, a line each, as a text; but for runs of words no tier looks over a line's end."""
        joined, own = "\n".join(new), self.scanner
        plain, collapsed, sounds, _ = own.passes(joined)
        found = [*own.exact_hits(joined, plain, collapsed), *own.sound_hits(sounds)]
        found += [c for p in plain if own.options.masked for c in own.masked_hits(p)]
        starts = [0, *accumulate(len(p) + 1 for p in new)]
        hit = {bisect_right(starts, c.start) - 1 for c in found}
        hit |= {bisect_right(starts, m.start()) - 1 for m in TAGGED.finditer(joined)}
        if not MARKED.isdisjoint(joined):
            hit |= {k for k, piece in enumerate(new) if not MARKED.isdisjoint(piece)}
        known, kept, firsts, inner = own.words.kept, self.kept, self.firsts, self.inner
        narrow = joined.isascii() or max(plain[-1].text, default="") <= "\uffff"
        for piece, base in zip(new, plain[0].text.split("\n"), strict=True):
            latin, single, _, note = known[base] if base else ("", "", "", 0)
            if narrow and len(latin) > 6 and latin[:-1].isalpha() and (latin[-1].isalpha() or latin[-1] in ENDING):  # one long word, as most new pieces are
                kept[piece] = LONG | NEXT * (latin[:2] in inner) | (0 if base == latin else ENDS | BEGINS) | (HIT if firsts and (base.endswith(firsts) or latin.endswith(firsts) or single.endswith(firsts)) else 0)
            else:
                kept[piece] = self.shape(base, latin, single, note)
        for k in hit:
            kept[new[k]] |= HIT
        self.chars += len(joined)

    def shape(self, base: str, latin: str, single: str, note: int) -> int:
        if not latin:
            return HIT
        own = self.scanner
        out = HIT * bool(self.firsts and (base.endswith(self.firsts) or latin.endswith(self.firsts) or single.endswith(self.firsts)))
        plain = latin.isascii() and latin.isalnum()
        runs = [latin] if plain else WORDS.findall(latin)
        if len(latin) == 1:
            out |= (LONE | ENDS | BEGINS) * latin.isalpha()
        elif not plain:
            odd = base != latin  # a sign that became a letter still ends a word
            out |= WIDE * bool(note & SPELL) | ENDS * (odd or (latin[-1].isalpha() and not WORD.match(latin[-2]))) | BEGINS * (odd or (latin[0].isalpha() and not WORD.match(latin[1])))
        if runs:
            out |= HEAD * (runs[-1] in own.heads) | NEXT * (len(runs[0]) == 1 or runs[0][:2] in self.inner) | LONG * any(len(x) > 5 for x in runs)
            out |= WIDE * any(x in own.heads and x + y in own.beginnings for x, y in zip(runs, runs[1:], strict=False))
        return out

    def ends(self, piece: str) -> tuple[str, str]:
        """The first and the last word of a piece."""
        if piece not in self.edges:
            if len(self.edges) > 20_000:
                self.edges.clear()
            runs = WORDS.findall(texts.latin_fold(texts.base_fold(piece)))
            self.edges[piece] = (runs[0], runs[-1]) if runs else ("", "")
        return self.edges[piece]

    def together(self, a: str, b: str) -> bool:
        x, y = self.ends(a)[1], self.ends(b)[0]
        return x in self.scanner.heads and x + y in self.scanner.beginnings

    def stretches(self, text: str) -> list[tuple[int, int]] | None:
        """Where matches can lie, from the first to the last; None: anywhere."""
        if not self.fair:
            return None
        low = text.lower() if text.isascii() else text.translate(LOWER)  # as long as the text; tags, which case divides, hit as such
        pieces, at = low.split(), None
        if sum(map(len, pieces)) + len(pieces) - 1 != len(low) or ODD_SPACE.search(low):  # not one blank between each two
            parts = PIECES.split(low)
            pieces, at = parts[::2], [0, *accumulate(map(len, parts))]
        flags = self.flags(pieces)
        wide = {m.start() for m in self.lone.finditer(flags)}
        wide |= {m.start() for m in self.pair.finditer(flags) if self.together(pieces[m.start()], pieces[m.start() + 1])}
        held = {m.start() for m in self.hit.finditer(flags)}
        if not wide and not held:
            return []
        spans: list[list[int]] = []
        last, until = len(pieces) - 1, -1
        for i in sorted(wide | held):
            a = b = i
            if i in wide or flags[i] & WIDE:
                if i < until:  # of the run before
                    continue
                a = max(0, i - 1)
                while a > 0 and not flags[a] & LONG:
                    a -= 1
                b = min(last, i + 1)
                while b < last and not flags[b] & LONG:
                    b += 1
                until = b
            a, b = max(0, a - self.reach), min(last, b + self.reach)
            if spans and a <= spans[-1][1] + 1:
                spans[-1][0], spans[-1][1] = min(a, spans[-1][0]), max(b, spans[-1][1])
                while len(spans) > 1 and spans[-1][0] <= spans[-2][1] + 1:
                    b, a = spans.pop()[1], spans[-1][0]
                    spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        if at is None:
            starts = [0, *accumulate(len(p) + 1 for p in pieces)]
            return [(starts[a], starts[b + 1] - 1) for a, b in spans]
        return [(at[2 * a], at[2 * b + 1]) for a, b in spans]


class Scanner:
    """A compiled lexicon; build once per process (see scanner())."""

    def __init__(self, options: Options):
        self.options = options
        self.allowed = set(options.allowed)
        self.exact, self.collapsed, self.sounds = options.exact, options.collapsed, options.sounds
        self.find_exact, self.find_collapsed, self.find_sounds = Finder(list(self.exact)), Finder(list(self.collapsed)), Finder(list(self.sounds))
        self.find_allowed = Finder(options.allowed)
        self.find_allowed_collapsed = Finder(list(dict.fromkeys(texts.run(texts.SINGLES, f) for f in options.allowed)))
        self.heads = {f[:n] for f in self.exact for n in range(1, 6)}
        self.beginnings = {f[:n] for f in self.exact for n in range(2, len(f) + 1)}
        self.words = texts.Words(self.note)
        self.sieve: Sieve | None = None  # made when first asked for
        #: Forms of one word by their length and each letter with its place.
        self.by_letter: dict[tuple[int, int, str], list[str]] = {}
        for form in self.exact:
            if " " not in form:
                for i, c in enumerate(form):
                    self.by_letter.setdefault((len(form), i, c), []).append(form)

    def note(self, word: str) -> int:
        """CHUNK if a piece of a latin word begins a form, SPELL if single letters and separators alternate in it or at its ends."""
        if len(word) > 6 and word[:-1].isalpha() and (word[-1].isalpha() or word[-1] in ENDING):
            return 0
        if word.isalpha():  # by itself a piece between blanks, which has two to four letters
            return CHUNK * (2 <= len(word) <= 4 and word in self.heads) | SPELL * (len(word) == 1)
        pieces = WORDS.findall(word)
        return CHUNK * any(len(w) <= 5 and w in self.heads for w in pieces) | SPELL * bool(SPELL_SHAPE.search(word))

    def passes(self, text: str, steps: list | None = None) -> tuple[list[Pass], Pass | None, Pass | None, int]:
        """Uncollapsed passes, the collapsed one, the sounds; those equal to the pass before are left out. Then the words' notes."""
        steps = texts.base_steps(text) if steps is None else steps
        base = Pass(text, texts.run(steps, text), steps)
        plain, words = [base], self.words.fold(base.text)
        made = lambda fold: Pass(text, getattr(words, fold), [], base, fold, words)
        if words.latin != base.text:
            plain.append(made("latin"))
        collapsed = made("single") if words.single != words.latin else None
        sounds = made("sound") if self.options.skeleton and self.sounds else None
        return plain, collapsed, sounds, words.notes

    def exact_hits(self, text: str, plain: list[Pass], collapsed: Pass | None) -> list[Found]:
        out: list[Found] = []
        known: dict[tuple, Found] = {}
        for p in [*plain, *([collapsed] if collapsed else [])]:
            stretched = p is collapsed
            finder, entries = (self.find_collapsed, self.collapsed) if stretched else (self.find_exact, self.exact)
            for start, end, form in finder(p.text):
                if not p.open_at(start - 1):
                    continue
                closed = not p.open_at(end)
                for entry in entries[form]:
                    prefix = entry.match_mode == "prefix"
                    if closed and not prefix:
                        continue
                    tail = WORDS.match(p.text, end) if prefix else None
                    a, b = p.span(start, tail.end() if tail else end)
                    core = p.span(start, end) if tail else None
                    while b < len(text) and text[b] == text[b - 1] <= "￿":
                        b += 1
                    if stretched and not STRETCH.search(text[a:b]) and not text[a : a + 1].lower() == text[a + 1 : min(b, a + 2)].lower():
                        continue
                    prior = known.get((entry.lemma, a, b))
                    if prior:
                        prior.entry = merged(prior.entry, entry)
                    else:
                        known[entry.lemma, a, b] = found = Found(a, b, "exact", entry, core)
                        out.append(found)
        return out

    def tagged_hits(self, text: str) -> list[Found]:
        """Parts of #CamelCase and @CamelCase tokens of the original."""
        out = []
        for m in TAGGED.finditer(text):
            cuts = [m.start() + 1, *(s.start() for s in SEAM.finditer(text, m.start() + 1, m.end()) if s.start() > m.start() + 1), m.end()]
            parts = [text[a:b].lower() for a, b in zip(cuts, cuts[1:], strict=False)]
            for k, part in enumerate(parts if len(parts) > 1 else ()):
                joined = [part, *(f"{x} {part}" for x in parts[max(0, k - 1) : k]), *(f"{part} {x}" for x in parts[k + 1 : k + 2])]
                entries = [e for f in texts.forms(part) for e in self.exact.get(f, ())]
                if len(part) >= 3 and entries and not self.allowed.intersection(joined):
                    out.append(Found(cuts[k], cuts[k + 1], "exact", severest(entries)))
        return out

    def fitting(self, token: str, hidden: str) -> Entry | None:
        """The severest entry with a form that equals token where no character is hidden."""
        seen = [(i, c) for i, c in enumerate(token) if c not in hidden]
        if not seen:
            return None
        forms = min((self.by_letter.get((len(token), i, c), ()) for i, c in seen), key=len)  # those of the rarest letter that is seen
        fits = [e for form in forms if all(form[i] == c for i, c in seen) for e in self.exact[form]]
        return severest(fits) if fits else None

    def masked_hits(self, p: Pass) -> Iterator[Found]:
        masks, digits = t.MASKS, t.MASKS + "0123456789"
        if any(c in p.text for c in masks):
            for m in MASKED.finditer(p.text):
                token, n = m[0], sum(c in masks for c in m[0])
                if 1 <= n <= 3 and token[0] not in masks and token[-1] not in masks and len(token) - n >= 2 and (entry := self.fitting(token, masks)):
                    yield Found(*p.span(*m.span()), "masked", entry)
        for m in DIGIT_MASKED.finditer(p.text) if DIGIT.search(p.text) else ():
            token, n = m[0], sum(c in digits for c in m[0])
            fair = len(token) >= 4 and 1 <= n <= 2 and token[-1] not in digits and token[0] not in masks and (token[0] not in digits or n == 2)
            if fair and sum(bool(LETTER.match(c)) for c in token) >= 2 and (entry := self.fitting(token, digits)):
                yield Found(*p.span(*m.span()), "masked", entry)
        if not p.text.isascii() and PICTURE.search(p.text):
            for m in PICTURED.finditer(p.text):
                token = m[0]
                bare, n = PICTURE.subn("", token)
                edge = PICTURE.match(token[0]) or PICTURE.match(token[-1])
                if 1 <= n <= 2 and not edge and len(bare) >= 3 and bare in self.exact and bare not in self.allowed and p.open_around(*m.span()):
                    yield Found(*p.span(*m.span()), "masked", severest(self.exact[bare]))

    def spelled_hits(self, p: Pass) -> Iterator[Found]:
        """Runs of single letters with one separator between each two."""

        def alone(i: int) -> bool:
            return i < len(p.text) and p.text[i] <= "￿" and bool(LETTER.match(p.text[i]))

        after = 0
        for m in SPELLED.finditer(p.text) if not p.text.isascii() or SPELLED_ASCII.search(p.text) else ():
            i = m.start()
            if i < after or not alone(i) or not p.open_around(i, i + 1):
                continue
            end = i + 1
            while end < len(p.text) and p.text[end] in t.SEPARATORS and alone(end + 1) and p.open_at(end + 2):
                end += 2
            after, run = end, p.text[i:end:2]
            for skip in (0, 1) if run[0] in ARTICLES else (0,):
                word, start = run[skip:], i + 2 * skip
                if len(word) < SPELLED_LEAST:
                    break
                before = word_before(p.text, start - 1) if start and p.text[start - 1] in t.SEPARATORS else ""
                follows = WORDS.match(p.text, end + 1) if end < len(p.text) and p.text[end] in t.SEPARATORS else None
                if self.allowed.intersection((word, f"{before} {word}", f"{word} {follows[0] if follows else ''}")):
                    break
                if word in self.exact:
                    yield Found(*p.span(start, end), "separated", severest(self.exact[word]))
                    break

    def chunk_hits(self, p: Pass) -> Iterator[Found]:
        """Words written as two to four short pieces."""
        found: list[tuple[int, Found]] = []
        for m in (ASCII_CHUNKS if p.text.isascii() else CHUNKS).finditer(p.text):
            a, b = m.span()
            pieces = FIRST_PIECES.findall(m[0])
            if not any(x in self.heads and x + y in self.beginnings for x, y in zip(pieces, pieces[1:], strict=False)):
                continue  # no two pieces begin a form
            words = [w.span() for w in WORDS.finditer(p.text, a, b)]
            # what joins the run's ends to a word before or after, which is longer
            before = p.text[a - 1] if a > 1 and WORD_END.match(p.text, a - 2) else ""
            after = p.text[b] if b < len(p.text) and WORDS.match(p.text, b + 1) else ""
            gaps = [before, *(p.text[y] for _, y in words[:-1]), after]
            for walk, (joins, longest) in enumerate(((t.BINDING + t.LOOSE, 4), (t.BINDING, 5))):
                if walk and not any(c in t.BINDING for c in gaps[1:-1]):
                    continue
                piece = [y - x <= longest and not DIGIT.search(p.text, x, y) for x, y in words]
                k = 0
                while k < len(words):
                    last = k
                    while piece[k] and last + 1 < len(words) and gaps[last + 1] in joins and piece[last + 1]:
                        last += 1
                    bound = (gaps[k] and gaps[k] in t.BINDING) or (gaps[last + 1] and gaps[last + 1] in t.BINDING)
                    x, y = words[k][0], words[last][1]
                    if last > k and last - k < CHUNKS_MOST and not bound and p.text[x : words[k][1]] in self.heads:
                        parts = [p.text[i:j] for i, j in words[k : last + 1]]
                        loose = any(g in t.LOOSE for g in gaps[k + 1 : last + 1])
                        word = "".join(parts)
                        fair = len(word) >= SPELLED_LEAST and max(map(len, parts)) > 1 and not (loose and (len(parts) < 3 or min(map(len, parts)) < 2))
                        if fair and word in self.exact and not self.allowed.intersection((word, " ".join(parts))):
                            found.append((walk, Found(*p.span(x, y), "separated", severest(self.exact[word]))))
                    k = last + 1
        return (f for _, f in sorted(found, key=lambda f: f[0]))  # those of the first walk come first

    def sound_hits(self, p: Pass | None) -> Iterator[Found]:
        """Words that begin with a key and have little after it."""
        for start, end, key in self.find_sounds(p.text) if p else ():
            stop = p.text.find(" ", end)
            if (not start or p.text[start - 1] == " ") and (len(p.text) if stop < 0 else stop) - end <= TAIL_MOST:
                yield Found(*p.span(start, end), "skeleton", self.sounds[key])

    def allow_spans(self, text: str, plain: list[Pass], collapsed: Pass | None) -> list[tuple[int, int]]:
        out = [p.span(a, b) for p in plain for a, b, _ in self.find_allowed(p.text)]
        stretched = [collapsed.span(a, b) for a, b, _ in self.find_allowed_collapsed(collapsed.text)] if collapsed else []
        return out + [(a, b) for a, b in stretched if STRETCH.search(text[a:b])]

    def tiers(self, text: str, steps: list | None = None) -> Iterator[tuple[list[Found], Callable[[], list[tuple[int, int]]]]]:
        """Candidates tier by tier, made when asked for, each with a way to the spans of allow phrases."""
        plain, collapsed, sounds, notes = self.passes(text, steps)
        spans: list[list[tuple[int, int]]] = []

        def allowed() -> list[tuple[int, int]]:
            if not spans:
                spans.append(self.allow_spans(text, plain, collapsed))
            return spans[0]

        yield self.exact_hits(text, plain, collapsed), allowed
        yield self.tagged_hits(text), allowed
        for p in plain if self.options.masked else ():
            yield [*self.masked_hits(p)], allowed
        yield [*self.spelled_hits(plain[-1])] if notes & SPELL else [], allowed
        yield [*self.chunk_hits(plain[-1])] if notes & CHUNK else [], allowed
        yield [*self.sound_hits(sounds)], allowed

    def kept(self, found: list[Found], allowed: list[tuple[int, int]]) -> list[Found]:
        o = self.options
        covered = Cover(allowed)
        found = [c for c in found if not covered(*c.tested)]
        return [c for c in found if c.entry.severity >= o.min_severity and (o.categories is None or set(o.categories) & set(c.entry.categories))]

    def narrowed(self, text: str) -> tuple[str, list[tuple[int, int]] | None]:
        """The stretches of a text that can hold matches as one text, and (start here, start in the text) of each; None: the text as it is."""
        if self.sieve is None:
            self.sieve = Sieve(self)
        spans = self.sieve.stretches(text)
        if spans is None or 10 * sum(b - a for a, b in spans) > 7 * len(text):
            return text, None
        starts = [0, *accumulate(b - a + len(GLUE) for a, b in spans)]
        return GLUE.join(text[a:b] for a, b in spans), [(here, a) for here, (a, _) in zip(starts, spans, strict=False)]

    def surviving(self, text: str) -> list[Found]:
        """Candidates in the order of the tiers, without those that an allow phrase covers or a filter drops."""
        part, places = self.narrowed(text)
        if not part:
            return []
        out = self.surviving_in(part, texts.base_steps(text))
        if places is None:
            return out
        starts = [here for here, _ in places]
        for c in out:
            here, there = places[bisect_right(starts, c.start) - 1]
            c.start, c.end, c.core = c.start + there - here, c.end + there - here, c.core and (c.core[0] + there - here, c.core[1] + there - here)
        return out

    def surviving_in(self, text: str, steps: list | None = None) -> list[Found]:
        """The same, with all of the text read in passes."""
        return [c for found, allowed in self.tiers(text, steps) if found for c in self.kept(found, allowed())]

    def any(self, text: str | None) -> bool:
        """Whether anything survives; later tiers aren't tried once something has."""
        part = self.narrowed(text)[0] if text else ""
        return bool(part) and any(found and self.kept(found, allowed()) for found, allowed in self.tiers(part, texts.base_steps(text)))

    def scan(self, text: str | None) -> list[Found]:
        """The matches of a text, none overlapping but where a replacement left it so; null has none."""
        return resolve(self.surviving(text)) if text else []


def resolve(found: list[Found]) -> list[Found]:
    """Overlaps, first come first kept, unless a later one has the higher (rank, severity, length) than the one it meets.

    Candidates come by start, so all kept before the last one end where it starts or before: only the last can be met.
    """
    kept: list[Found] = []
    weigh = lambda c: (RANK[c.tier], c.entry.severity, c.end - c.start)
    for c in sorted(found, key=lambda c: (c.start, -c.end)):
        if not kept or kept[-1].end <= c.start:
            kept.append(c)
        elif weigh(c) > weigh(kept[-1]):
            kept[-1] = c
    return kept


@lru_cache(maxsize=16)
def scanner(options: Options) -> Scanner:
    """The compiled scanner of options, kept per process."""
    return Scanner(options)
