"""Fixed values of the folds: characters, their replacements and the sets of each script."""

from __future__ import annotations

import unicodedata

# Characters that are deleted wherever they stand.
INVISIBLE = "​‌‍­﻿⁠᠎"
# What reports show as escapes: control, accented and Latin look-alike letters, marks, Greek, Cyrillic, invisibles, selectors.
ESCAPED = "\x01-\x1f\xad\u00c0-\u024f\u0300-\u036f\u0370-\u03ff\u0400-\u04ff\u200b-\u200f\u2060\ufeff\ufe00-\ufe0f"
# Full-width forms stand this far above their ASCII characters.
WIDE_FIRST, WIDE_LAST, WIDE_SHIFT = 0xFF01, 0xFF5E, 0xFEE0
# White space of the skeleton fold.
SPACES = "\t\n\x0b\x0c\r                  　﻿"

# For each Indic script what is deleted, what is replaced, its virama, the nasals
# that a virama makes into its anusvara, and whether runs of the virama are one.
SCRIPTS = {
    "Deva": dict(drop="़ः", map={"ँ": "ं", "ऱ": "र"}, virama="्", nasals="नमणङञ", anusvara="ं", runs=False),
    "Beng": dict(drop="়ঃ", map={"ঁ": "ং", "ৎ": "ত্"}, virama="্", nasals="নমণঙঞ", anusvara="ং", runs=True),
    "Guru": dict(drop="਼ਃ", map={"ਁ": "ਂ", "ੰ": "ਂ"}, virama="੍", nasals="", anusvara="", runs=True),
    "Gujr": dict(drop="઼ઃ", map={"ઁ": "ં"}, virama="્", nasals="નમણઙઞ", anusvara="ં", runs=True),
    "Orya": dict(drop="଼ଃ", map={"ଁ": "ଂ"}, virama="୍", nasals="ନମଣଙଞ", anusvara="ଂ", runs=True),
    "Taml": dict(drop="ஃ", map={"ஜ": "ச", "ஶ": "ச", "ஷ": "ச", "ஸ": "ச", "ன": "ந"}, virama="்", nasals="", anusvara="", runs=True),
    "Telu": dict(drop="ః఼", map={"ౘ": "చ", "ౙ": "జ"}, virama="్", nasals="ఙఞణనమ", anusvara="ం", runs=True),
    "Knda": dict(drop="ಃ಼", map={}, virama="್", nasals="ಙಞಣನಮ", anusvara="ಂ", runs=True),
    "Mlym": dict(drop="ഃ", map={"ൺ": "ണ്", "ൻ": "ന്", "ർ": "ര്", "ൽ": "ല്", "ൾ": "ള്", "ൿ": "ക്", "ൔ": "മ്", "ൕ": "യ്", "ൖ": "ഴ്"}, virama="്", nasals="", anusvara="", runs=True),
}

# Letters that look like Latin ones, without those that decompose to a Latin letter and marks.
LOOKALIKES = (
    ("аеорсхуіѕ", "aeopcxyis"),
    ("АЕОРСХУІЅ", "aeopcxyis"),
    ("νουαρτ", "vouapt"),
    ("ΝΟΥΑΡΤ", "vouapt"),
    ("ƒçàáâãäåèéêëìíîïòóôõöùúûüñýÿšž", "fcaaaaaaeeeeiiiiooooouuuunyysz"),
    ("øđħıłŧ", "odhilt"),
    ("ԁһјкмт", "dhjkmt"),
    ("ԀҺЈКМТ", "dhjkmt"),
    ("βεικμηχγ", "beikmnxy"),
    ("ΒΕΙΚΜΧ", "beikmx"),
    ("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz"),
)
# Code points of the mathematical alphabets that aren't assigned.
MATH_UNASSIGNED = (0x1D455, 0x1D49D, 0x1D4A0, 0x1D4A1, 0x1D4A3, 0x1D4A4, 0x1D4A7, 0x1D4A8, 0x1D4AD, 0x1D4BA, 0x1D4BC, 0x1D4C4, 0x1D506, 0x1D50B, 0x1D50C, 0x1D515, 0x1D51D, 0x1D53A, 0x1D53F, 0x1D545, 0x1D547, 0x1D548, 0x1D549, 0x1D551)

# Signs and digits that stand for letters.
LEET_SIGNS = {"@": "a", "!": "i", "|": "i", "$": "s"}
LEET_DIGITS = {"4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "7": "t", "2": "z", "6": "g", "9": "g"}

# Letter groups of one sound, longest first, and single letters of the same sound.
SOUNDS = {"kshh": "ks", "ksh": "ks", "chh": "c", "ch": "c", "bh": "b", "dh": "d", "gh": "g", "jh": "j", "kh": "k", "ph": "f", "sh": "s", "th": "t", "zh": "j"}
LETTERS = {"z": "j", "w": "v", "q": "k", "y": "i", "c": "k", "x": "ks"}

# Characters that hide a letter, and those that stand between spelled-out letters.
MASKS = "*#@$%"
SEPARATORS = " \t.-_\n/"
BINDING, LOOSE = ".-", " \t"


def indic_points() -> dict[str, str]:
    """Every Indic character that is replaced or (by nothing) deleted."""
    out: dict[str, str] = {}
    for rules in SCRIPTS.values():
        out |= dict.fromkeys(rules["drop"], "") | rules["map"]
    return out


def confusables() -> dict[str, str]:
    """Every character that is read as an ASCII letter or digit, from the tables and from rules."""
    out: dict[str, str] = {}
    for first, last in ((0x100, 0x24F), (0x1E00, 0x1EFF)):
        for c in map(chr, range(first, last + 1)):
            base, *marks = unicodedata.normalize("NFD", c)
            if marks and base.isascii() and base.isalpha() and all("̀" <= m <= "ͯ" for m in marks):
                out[c] = base.lower()
    alphabet, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for cp in range(0x1D400, 0x1D6A4):
        if cp not in MATH_UNASSIGNED:
            out[chr(cp)] = alphabet[(cp - 0x1D400) % 26]
    out |= {chr(0x1D6A4): "i", chr(0x1D6A5): "j"}
    out |= {chr(cp): digits[(cp - 0x1D7CE) % 10] for cp in range(0x1D7CE, 0x1D800)}
    out |= {chr(cp): alphabet[(cp - 0x249C) % 26] for cp in range(0x249C, 0x24EA)}
    out |= {chr(cp): alphabet[(cp - 0x1F110) % 32] for cp in range(0x1F110, 0x1F18A) if (cp - 0x1F110) % 32 < 26}
    for sources, targets in LOOKALIKES:
        out |= dict(zip(sources, targets, strict=True))
    return out
