"""Spellings that packs derive from their own surfaces when they are made, by language.

A rule makes forms of one surface; expand() applies it to a whole pack. What is excluded, or is any
entry's surface already, isn't added: the first entry that has a form keeps it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

import regex

from .lexicon import Entry

Rule = Callable[[str, frozenset[str]], list[str]]

# English endings by the shape of the word, the first that fits: (shape, letters cut, letters added).
PLURALS = ((r"(?:s|x|z|ch|sh)$", 1, "es"), (r"[^aeiou]y$", 1, "ies"), ("$", 0, "s"))
# English verb stems by the shape of the word, the first that fits: (shape, stem of -ed and -er, stem of -ing); none: no verb.
VERBS = (
    (r"er$|[aeiouy]e$|[aiou]$", None, None),
    (r"e$", lambda w: w[:-1], lambda w: w[:-1]),
    (r"[^aeiou]y$", lambda w: w[:-1] + "i", lambda w: w),
    (r"[^aeiou][aeiou][^aeioucwxy]$", lambda w: w + w[-1], lambda w: w + w[-1]),
    (r"$", lambda w: w, lambda w: w),
)
# Endings of romanised Hindi by the last letter: (letters cut, endings).
HINDI = {"a": (1, ("e", "o", "on")), "i": (0, ("yon", "yan")), "u": (0, ("on", "a", "s"))}
HINDI_REST = (0, ("o", "e", "u", "on", "ne"))


def english(word: str, exclude: frozenset[str] = frozenset()) -> list[str]:
    """Plural, -ed, -ing, -er and -ers of a word of a-z that isn't inflected already; without -er there is no -ers."""
    if not regex.fullmatch("[a-z]{3,}", word) or regex.search("(?:[^s]s|ed|ing)$", word):
        return []
    _, cut, ending = next(rule for rule in PLURALS if regex.search(rule[0], word))
    out = [word[: len(word) - (cut if ending == "ies" else 0)] + ending]
    _, stem, rising = next(rule for rule in VERBS if regex.search(rule[0], word))
    if stem:
        agent = stem(word) + "er"
        out += [stem(word) + "ed", rising(word) + "ing", *([] if agent in exclude else [agent, agent + "s"])]
    return out


def hindi(word: str, exclude: frozenset[str] = frozenset()) -> list[str]:
    """The family of a romanised noun or stem of one word."""
    if regex.search(r"\s", word):
        return []
    cut, endings = HINDI.get(word[-1], HINDI_REST)
    return [word[: len(word) - cut] + e for e in endings]


def tamil(word: str, exclude: frozenset[str] = frozenset()) -> list[str]:
    """The spelling with doubled consonants (consonant, pulli, the same consonant) written once."""
    single = regex.sub(r"(\p{Script=Tamil})்(?=\1)", "", word)
    return [single] if single != word and " " not in word else []


def punjabi(word: str, exclude: frozenset[str] = frozenset()) -> list[str]:
    """The spelling without addaks."""
    return [word.replace("ੱ", "")] if "ੱ" in word and " " not in word else []


RULES: dict[str, Rule] = {"en": english, "hi": hindi, "ta": tamil, "pa": punjabi}


def expand(entries: Iterable[Entry], rule: Rule, exclude: Iterable[str] = ()) -> tuple[Entry, ...]:
    """Entries with what the rule makes of their surfaces: of romanisations for Hindi, else of lemmas and variants, as variants."""
    entries, left = tuple(entries), frozenset(exclude)
    roman = rule is hindi
    seen = {s for e in entries for s in (e.lemma, *e.variants, *(() if rule is english else e.romanizations))}
    out = []
    for e in entries:
        made = []
        for surface in e.romanizations if roman else (e.lemma, *e.variants):
            for form in rule(surface, left):
                if form not in seen and form not in left:
                    seen.add(form)
                    made.append(form)
        out.append(replace(e, romanizations=e.romanizations + tuple(made)) if roman else replace(e, variants=e.variants + tuple(made)))
    return tuple(out)
