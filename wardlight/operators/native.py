"""The scan as a plan inside the JVM: exact, prefix, collapsed and sounding hits of whole texts, with spans into the original.

Texts are cut at white space. Pieces that can't hit are told within their row, from coarse folds of
some pieces together, and never leave it. The others are gathered by piece with their places, folded and
looked up once for a block of rows. Offsets are made for pieces that hit only. No step looks at more than a
piece and its two neighbours.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import offsets
from ..functions import tables as t
from ..functions import texts
from ..plans import relational as r
from ..sources.lexicon import Options, local
from . import kernel

W = r"[\p{L}\p{M}\p{N}]"
MARK = ""


#: White space but the blank is read as line ends: of these two alone a character class is told by a table, of all
#: white space by a chain of tests, which takes eighteen times as long.
BLANKS = " \\n"
OTHER_BLANKS = t.SPACES.replace(" ", "").replace("\n", "")
TAIL_MOST = 3
MATCH = ("lemma", "surface", "tier", "language", "severity", "categories", "casual_use", "start", "end", "char_start", "char_end")


def probes(spark: SparkSession, options: Options) -> DataFrame:
    """The lexicon as a table of what is looked up: key, kind (word, stem or sound), rest (the word that has to follow),
    stable (a form without doubled letters) and the entry's data."""
    if any(f.count(" ") > 1 for f in [*options.exact, *options.allowed]):
        raise ValueError("phrases of more than two words need the kernel")
    rows = []
    for form, own in options.exact.items():
        word, _, rest = form.partition(" ")
        for e in dict.fromkeys(own):
            rows.append((word, "word", rest, form in options.collapsed, e))
            if e.match_mode == "prefix" and not rest:
                rows.append((form, "stem", "", form in options.collapsed, e))
    rows += [(key, "sound", "", True, e) for key, e in options.sounds.items() if options.skeleton]
    rows = [(*r[:4], e.load_order, e.lemma, e.language, e.severity, list(e.categories), e.casual_use) for *r, e in rows for r in [tuple(r)]]
    return local(spark, rows, "key string, kind string, rest string, stable boolean, entry int, lemma string, language string, severity int, categories array<string>, casual_use boolean")


def lengths(keys: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in sorted(set(map(len, keys)))]).cast("array<int>")


def starts_of(text: Column, one: str) -> Column:
    """Where runs of characters of the class `one` begin; linear in the text."""
    marked = F.split(F.regexp_replace(text, f"(?<!{one}){one}", MARK), "")
    return F.transform(F.filter(F.transform(marked, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z["x"] == MARK), lambda z: z["i"])


#: Characters of a part of a text, which ends with a piece: texts are cut to large parts first, so that places in a long text are counted in proportion.
PARTS = (32_000, 320)
ASTRAL = "[\U00010000-\U0010ffff]"
LAST_PIECE, FIRST_PIECE = f"(?<![^{BLANKS}])([^{BLANKS}]++) \\z", f"^[^{BLANKS}]++"
#: In coarse folds: a character that only the folds themselves can judge, and what stands between words.
ODD, APART = "\ue002", "-"
#: Signs that stand for vowels, which no sound has, beside a letter and part words elsewhere.
VOWELS = {a: b for a, b in t.LEET_SIGNS.items() if b in "aeiou"}
SIGNS = "".join(VOWELS)
#: So many keys are compared within a row; of a larger lexicon all pieces are looked up.
COMPARED = 20_000
#: Rows whose equal pieces are folded once, as a power of two, so that the places of a frequent piece are many lists.
BLOCK = 8


def cut(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """A row per part of `most` characters, to the end of the last piece and the white space behind it: names, start, wide (characters of two units
    before the part), t_, prior (the piece before it and the blank between, if one blank is all), next (the piece behind it)."""
    parts = rows.select(*names, "start", "wide", "prior", "next", F.regexp_extract_all("t_", F.lit(f"(?s).{{1,{most}}}+[^{BLANKS}]*+[{BLANKS}]*+"), F.lit(0)).alias("parts"), F.col("t_").rlike(ASTRAL).alias("astral"))

    def before(size) -> Column:
        return F.aggregate("parts", F.array(F.lit(0)), lambda found, x: F.concat(found, F.array(F.coalesce(F.element_at(found, -1), F.lit(0)) + size(x))))

    wide = F.when(F.col("astral"), before(wide_in)).otherwise(F.array_repeat(F.lit(0), F.size("parts")))
    ahead = F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))
    zipped = F.arrays_zip(F.col("parts").alias("t_"), before(F.length).alias("start_"), wide.alias("wide_"), F.concat(F.array("prior"), F.col("parts")).alias("prior_"), F.concat(ahead, F.array("next")).alias("next_"))
    out = parts.select(*names, "start", "wide", F.inline(zipped)).where("t_ is not null")
    return out.select(*names, (F.col("start") + F.col("start_")).alias("start"), (F.col("wide") + F.col("wide_")).alias("wide"), "t_", F.regexp_extract("prior_", LAST_PIECE, 0).alias("prior"), F.regexp_extract("next_", FIRST_PIECE, 0).alias("next"))


def wide_in(text: Column) -> Column:
    return F.when(text.rlike(ASTRAL), F.length(F.regexp_replace(text, ASTRAL.replace("[", "[^"), ""))).otherwise(F.lit(0))


@cache
def dull() -> str:
    """Signs that no fold changes and that part words."""
    signs = [c for c in map(chr, range(0x21, 0x2100)) if unicodedata.category(c)[0] in "PS" and c not in t.SPACES and c not in t.LEET_SIGNS]
    return "".join(c for c in signs if texts.latin_fold(texts.base_fold(f"a{c}a")) == f"a{c}a")


@cache
def rare() -> str:
    """Letters that no fold changes, which no sound has; of those that a character class tells by a table."""
    letters = [c for c in map(chr, range(0xC0, 0x100)) if unicodedata.category(c) == "Ll" and c not in kernel.PLAIN]
    return "".join(c for c in letters if texts.latin_fold(texts.base_fold(f"a{c}a")) == f"a{c}a")


def coarse_words(line: Column) -> Column:
    """Pieces, one blank apart, in plain letters: `ph` as f, runs as one letter, APART between words. Pieces of ASCII without
    a letter are empty. Words that become one word by any of the folds are one here, SIGNS left as they are; what else there is has ODD."""
    x = F.regexp_replace(line, "(?<![^ ])[\\x00-\\x1f!-@\\[-`{-\\x7f]++(?![^ ])", "")
    plain = {a: b for a, b in kernel.PLAIN.items() if a != b}
    x = F.translate(F.lower(x), "".join(plain) + dull().replace(APART, ""), "".join(plain.values()) + APART * (len(dull()) - 1))
    x = F.regexp_replace(x, f"[^a-z{rare()}{SIGNS} {APART}]++", ODD)
    x = F.regexp_replace(F.replace(x, F.lit("ph"), F.lit("f")), r"([a-z])\1+", "$1")
    return F.regexp_replace(x, f"(?<![^ ]){APART}++|(?<!{APART}){APART}++(?![^ ])", "")


def coarse_sounds(words: Column) -> Column:
    """kernel.coarse of pieces in coarse words."""
    table = {chr(a): b for a, b in kernel.COARSE.items() if a < 128 and chr(a).isalpha()}
    x = words
    for a, b in table.items():
        if len(b) > 1:
            x = F.replace(x, F.lit(a), F.lit(b))
    single = {a: b for a, b in table.items() if len(b) == 1}
    x = F.translate(x, "".join(single) + "".join(a for a, b in table.items() if not b) + rare() + SIGNS + APART, "".join(single.values()))
    return F.regexp_replace(x, r"([a-z])\1+", "$1")


def coarse_key(key: str) -> str:
    """As coarse_words of one word; of a key with other letters, which only pieces with ODD can have, anything."""
    return texts.run(texts.SINGLES, "".join(kernel.PLAIN.get(c, c) for c in key).replace("ph", "f"))


def can_hit(options: Options):
    """A test of the coarse words and sounds of a piece, or None if all pieces have to be looked up. No piece that hits fails it."""
    words = {f.partition(" ")[0] for f in options.exact}
    if len(words) + len(options.sounds) > COMPARED or not all(any(c.isalpha() for c in w) for w in words):
        return None
    stems = {f for f, own in options.exact.items() if " " not in f and any(e.match_mode == "prefix" for e in own)}
    # a stem's last p may be half of a ph
    equal, begin = {coarse_key(w) for w in words}, {coarse_key(f).rstrip("p") for f in stems}
    sounds = {kernel.coarse(k) for k in options.sounds} if options.skeleton else set()
    if "" in begin | sounds:
        return None

    def begins(x: Column, keys: set[str]) -> Column:
        out = F.lit(False)
        for n in sorted({len(k) for k in keys}):
            out = out | F.substr(x, F.lit(1), F.lit(n)).isin(*sorted(k for k in keys if len(k) == n))
        return out

    def word(x: Column) -> Column:
        return x.isin(*sorted(equal)) | begins(x, begin)

    def any_word(x: Column) -> Column:
        return word(x) | (x.contains(APART) & F.exists(F.split(x, f"{APART}+"), word))

    def test(x: Column, sound: Column) -> Column:
        letters = F.translate(F.regexp_replace(x, f"(?<![a-z])[{SIGNS}](?![a-z])", APART), SIGNS, "".join(VOWELS.values()))
        signed = x.rlike(f"[{SIGNS}]") & (any_word(F.regexp_replace(x, f"[{SIGNS}]", APART)) | any_word(F.regexp_replace(letters, r"([a-z])\1+", "$1")))
        return x.contains(ODD) | any_word(x) | begins(sound, sounds) | signed

    return test


def pieces(df: DataFrame, text_col: str, keep: list[str], options: Options) -> DataFrame:
    """A row per piece of each text that can hit: row_ (names the text), k0, k1 ... (the columns kept), start, piece, before and
    after (the neighbour one blank away, else null), wide (characters of two units before it)."""
    names = ["row_", *[f"k{i}" for i in range(len(keep))]]
    rows = df.select(F.monotonically_increasing_id().alias("row_"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.lit(0).alias("start"), F.lit(0).alias("wide"), F.translate(text_col, OTHER_BLANKS, "\n" * len(OTHER_BLANKS)).alias("t_"), F.lit("").alias("prior"), F.lit("").alias("next"))
    for most in PARTS:
        rows = cut(rows, names, most)
    made = rows.withColumn("found", F.regexp_extract_all("t_", F.lit(f"[^{BLANKS}]+"), F.lit(0)))
    test = can_hit(options)
    given = [F.col("found").alias("piece"), F.sequence(F.lit(0), F.size("found")).alias("i")]
    if test is not None:
        made = made.withColumn("words", coarse_words(F.array_join("found", " ")))
        made = made.withColumn("sounds", F.split(coarse_sounds(F.col("words")), " ")).withColumn("words", F.split("words", " "))
        given += [F.col("words").alias("words"), F.col("sounds").alias("sounds")]
    out = made.select(*names, "start", "wide", "t_", "prior", "next", F.inline(F.arrays_zip(*given))).where("piece is not null")
    if test is not None:  # of rows, not inside an array: only that is compiled
        out = out.where(test(F.col("words"), F.col("sounds")))
    lead = F.length("t_") - F.length(F.ltrim("t_", F.lit(" \n")))
    own = lead + F.length(F.array_join(F.slice(F.regexp_extract_all("t_", F.lit(f"[^{BLANKS}]+[{BLANKS}]*"), F.lit(0)), F.lit(1), F.col("i")), ""))
    out = out.withColumn("own", own).withColumn("left", F.substr("t_", F.lit(1), F.col("own")))
    behind = F.concat(F.substr("t_", F.col("own") + F.length("piece") + 1, F.length("t_")), F.col("next"))
    beside = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return out.select(*names, (F.col("start") + F.col("own")).alias("start"), "piece", (F.col("wide") + wide_in(F.col("left"))).alias("wide"), beside(F.concat("prior", "left"), LAST_PIECE).alias("before"), beside(behind, f"^ ([^{BLANKS}]++)").alias("after"))


def folded(v: DataFrame, col: str) -> DataFrame:
    """v with the folds of a column as texts: base, latin, single."""
    nothing = F.array().cast("array<int>")
    v = v.withColumn("base", offsets.base(offsets.Traced(F.col(col), nothing)).text)
    v = v.withColumn("latin", F.when(F.col("base").rlike(r"^[a-z]*$") & ~F.col("base").rlike(r"ph|(.)\1\1"), F.col("base")).otherwise(offsets.latin(offsets.Traced(F.col("base"), nothing)).text))
    return v.withColumn("single", F.regexp_replace("latin", r"(?s)(.)\1+", "$1"))


def traced(v: DataFrame, col: str) -> DataFrame:
    """v with the offsets of these folds: base_at, latin_at, single_at."""
    v = v.withColumn("base_at", offsets.base(offsets.original(F.col(col))).at)
    v = v.withColumn("latin_at", offsets.latin(offsets.Traced(F.col("base"), F.col("base_at"))).at)
    return v.withColumn("single_at", offsets.single(offsets.Traced(F.col("latin"), F.col("latin_at"))).at)


def once(df: DataFrame, keep: list[str], made: dict[str, Column], fields) -> DataFrame:
    """keep, and what fields(z) makes of the struct z of `made`. What is made is made once for a row: without the
    generator, the optimizer would write the folds into every later use and filter."""
    held = F.array(F.struct(*[v.alias(k) for k, v in made.items()]))
    return df.select(*keep, F.inline(F.transform(held, lambda z: F.struct(*[v.alias(k) for k, v in fields(z).items()]))))


def run_after(text: Column, end: Column) -> Column:
    """How often the character before `end` follows there once more."""
    behind = F.substr(text, end + 1, F.length(text))
    return F.length(behind) - F.length(F.ltrim(behind, F.substr(text, end, F.lit(1))))


def looked_up(v: DataFrame, options: Options) -> DataFrame:
    """A row per probe of each piece: piece, its places and folds, level, from_ and to_ (the word's place in that fold), n (length of key), key, kind.

    A word of a fold is looked up whole and by its beginnings, what sounds by its beginnings that have little behind them.
    """
    folds = [F.struct(F.lit("base").alias("level"), F.col("base").alias("x"))]
    folds += [F.when(F.col(k) != F.col(below), F.struct(F.lit(k).alias("level"), F.col(k).alias("x"))) for k, below in (("latin", "base"), ("single", "latin"))]
    if options.skeleton and options.sounds:
        folds.append(F.struct(F.lit("sound").alias("level"), offsets.sound(offsets.Traced(F.col("latin"), F.array().cast("array<int>"))).text.alias("x")))
    rows = v.select("piece", "places", "base", "latin", "single", F.inline(F.filter(F.array(*folds), lambda z: z.isNotNull())))
    whole = (F.col("level") == "sound") | F.col("x").rlike(f"^{W}+$")
    found = F.when(whole, F.array(F.struct(F.lit(0).alias("from_"), F.col("x").alias("word")))).otherwise(F.arrays_zip(starts_of(F.col("x"), W).alias("from_"), F.regexp_extract_all(F.col("x"), F.lit(W + "+"), F.lit(0)).alias("word")))
    rows = rows.select("piece", "places", "base", "latin", "single", "level", "x", F.inline(found))
    stems = lengths([f for f, own in options.exact.items() if any(e.match_mode == "prefix" for e in own)])
    size, sound = F.length("word"), F.col("level") == "sound"
    begins = F.when(sound, F.filter(lengths(list(options.sounds)), lambda n: (n <= size) & (size - n <= TAIL_MOST))).otherwise(F.filter(stems, lambda n: n < size))
    kind = F.when(sound, "sound").otherwise("stem")
    tried = F.transform(begins, lambda n: F.struct(n.alias("n"), F.substr("word", F.lit(1), n).alias("key"), kind.alias("kind")))
    tried = F.when(sound, tried).otherwise(F.concat(F.array(F.struct(size.alias("n"), F.col("word").alias("key"), F.lit("word").alias("kind"))), tried))
    last = (F.col("from_") + size == F.length("x")).alias("last")
    return rows.select("piece", "places", "base", "latin", "single", "level", "from_", (F.col("from_") + size).alias("to_"), last, F.inline(tried))


#: Of an entry, as probes() has it.
ENTRY = ["entry", "lemma", "language", "severity", "categories", "casual_use"]


def piece_hits(v: DataFrame, lexicon: DataFrame, options: Options) -> DataFrame:
    """piece, places, level, a, b, tested (in characters of the piece), rest, and the entry's data: what hits in each row of pieces."""
    hit = looked_up(v, options).join(lexicon, ["key", "kind"])
    hit = hit.where(((F.col("level") != "single") | (F.col("stable") & (F.col("rest") == ""))) & ((F.col("rest") == "") | F.col("last")))
    hit = traced(hit, "piece")
    said = offsets.sound(offsets.Traced(F.col("latin"), F.col("latin_at"))).at
    at = F.when(F.col("level") == "base", F.col("base_at")).when(F.col("level") == "latin", F.col("latin_at")).when(F.col("level") == "single", F.col("single_at")).otherwise(said)
    keep = ["piece", "places", "level", "rest", *ENTRY]
    to = F.when(F.col("kind") == "sound", F.col("from_") + F.col("n")).otherwise(F.col("to_"))
    hit = once(hit, keep, {"at": at, "n": F.col("n"), "from_": F.col("from_"), "to_": to}, lambda z: {"a": F.get(z["at"], z["from_"]), "end_": F.get(z["at"], z["to_"] - 1) + 1, "core": F.get(z["at"], z["from_"] + z["n"] - 1) + 1, "part": z["n"] < z["to_"] - z["from_"]})
    grows = (F.col("rest") == "") & (F.col("level") != "sound")
    hit = once(hit, [*keep, "a", "core", "part"], {"b": F.when(grows, F.col("end_") + run_after(F.col("piece"), F.col("end_"))).otherwise(F.col("end_"))}, lambda z: {"b": z["b"]})
    hit = once(hit, [*keep, "a", "b", "core", "part"], {"seen": F.substr("piece", F.col("a") + 1, F.col("b") - F.col("a"))}, lambda z: {"stretched": z["seen"].rlike(r"(?s)(.)\1\1") | (F.lower(F.substr(z["seen"], F.lit(1), F.lit(1))) == F.lower(F.substr(z["seen"], F.lit(2), F.lit(1))))})
    hit = hit.where((F.col("level") != "single") | F.col("stretched"))
    return hit.select(*keep, "a", "b", F.when(F.col("part"), F.col("core")).otherwise(F.col("b")).alias("tested"))


def phrased(found: DataFrame) -> DataFrame:
    """Of hits of which a word has to follow, those where it does, one blank away, with the span to its end; all others as they are."""
    keep = [c for c in found.columns if c not in ("b", "tested")]
    follows = F.when(F.col("rest") != "", F.coalesce("after", F.lit("")))
    x = traced(folded(found.withColumn("follows", follows), "follows"), "follows")
    base = F.col("level") == "base"
    made = {"x": F.when(base, F.col("base")).otherwise(F.col("latin")), "at": F.when(base, F.col("base_at")).otherwise(F.col("latin_at")), "word": F.col("rest"), "b0": F.col("b"), "tested0": F.col("tested")}
    x = once(x, keep, made, lambda z: {"fits": (z["word"] == "") | (F.startswith(z["x"], z["word"]) & ~F.substr(z["x"], F.length(z["word"]) + 1, F.lit(1)).rlike(W)), "end_": F.when(z["word"] != "", F.get(z["at"], F.length(z["word"]) - 1) + 1), "b0": z["b0"], "tested0": z["tested0"]}).where("fits")
    end = F.length("piece") + 1 + F.col("end_") + run_after(F.col("after"), F.col("end_"))
    return x.select(*keep, F.when(F.col("rest") == "", F.col("b0")).otherwise(end).alias("b"), F.when(F.col("rest") == "", F.col("tested0")).otherwise(end).alias("tested"))


def allowed_out(found: DataFrame, options: Options, keep: list[str]) -> DataFrame:
    """found without the spans at_ to upto of near (a piece with its neighbours) that an allow phrase covers.

    Only stretches of a phrase's length that cover the span are looked at, and looked up in the set of phrases.
    """
    plain, short = options.allowed, list(dict.fromkeys(texts.run(texts.SINGLES, f) for f in options.allowed))
    made = {k: F.col(k) for k in ("base", "latin", "single", "base_at", "latin_at", "single_at", "near", "at_", "upto")}

    def stretches(z: Column, level: str, n: int, phrases: list[str]) -> Column:
        x, at = z[level], z[f"{level}_at"]

        def fits(i: Column) -> Column:
            a, b = F.get(at, i), F.get(at, i + n - 1) + 1
            stretched = F.substr(z["near"], a + 1, b - a).rlike(r"(?s)(.)\1\1") if level == "single" else F.lit(True)
            return (a <= z["at_"]) & (b >= z["upto"]) & F.substr(x, i + 1, F.lit(n)).isin(phrases) & stretched

        return F.exists(F.when(F.length(x) >= n, F.sequence(F.lit(0), F.length(x) - n)).otherwise(F.array().cast("array<int>")), fits)

    def covered(z: Column, level: str) -> Column:
        known, out = short if level == "single" else plain, F.lit(False)
        for n in sorted({len(f) for f in known}):
            out = out | stretches(z, level, n, [f for f in known if len(f) == n])
        return out

    x = traced(folded(found, "near"), "near")
    flagged = once(x, keep, made, lambda z: {"vetoed_": covered(z, "base") | covered(z, "latin") | covered(z, "single")})
    return flagged.where("not vetoed_").select(*keep)


def scan_rows(df: DataFrame, text_col: str = "text", options: Options = Options()) -> DataFrame:
    """A row per match: df's columns but the text, then the match's, as moderation.scan_rows gives for texts whose words
    aren't hidden by masks, pictures, tags or separators. Text is taken to be in NFC.

    Null and empty texts have no match; repeated rows repeat theirs; an empty table gives an empty result. Where
    df has columns of the match's names, the match's replace them.
    """
    keep = [c for c in df.columns if c != text_col and c not in MATCH]
    names = ["row_", *[f"k{i}" for i in range(len(keep))]]
    place = F.struct(*names, "wide", "start", "before", "after")
    v = pieces(df, text_col, keep, options).groupBy("piece", F.shiftright("row_", BLOCK).alias("block")).agg(F.collect_list(place).alias("places"))
    found = piece_hits(folded(v, "piece"), probes(df.sparkSession, options), options)
    found = phrased(found.select(*[c for c in found.columns if c != "places"], F.inline("places")))
    shift = F.coalesce(F.length("before") + 1, F.lit(0))
    found = admitted(found, options).withColumn("tier", F.when(F.col("level") == "sound", "skeleton").otherwise("exact"))
    found = found.withColumn("wide", F.col("wide") + wide_in(F.substr("piece", F.lit(1), F.col("a"))))
    found = found.select(*names, "wide", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b")).alias("e"), (F.col("start") + F.col("tested")).alias("tested"), (shift + F.col("a")).alias("at_"), F.concat_ws(" ", "before", "piece", "after").alias("near"), "tier", *ENTRY)
    # one row for each lemma and span: the severest entry's data, all categories, the widest part that a phrase has to cover
    row = F.struct((-F.col("severity")).alias("weak"), F.col("entry").alias("o"), "language", "severity", "categories")
    merged = found.groupBy(*names, "tier", "s", "e", "lemma").agg(F.array_sort(F.collect_set(row)).alias("es"), F.max("tested").alias("tested"), F.bool_and("casual_use").alias("casual_use"), F.min("entry").alias("entry"), F.first("near").alias("near"), F.first("at_").alias("at_"), F.first("wide").alias("wide"))
    merged = merged.withColumn("upto", F.col("at_") + F.col("tested") - F.col("s"))
    if options.allowed:
        merged = allowed_out(merged, options, [c for c in merged.columns if c != "upto"])
    surface = F.substr("near", F.col("at_") + 1, F.col("e") - F.col("s"))
    units = F.col("s") + F.col("wide")
    rank = F.when(F.col("tier") == "exact", 2).otherwise(0)
    order = F.when(F.col("tier") == "exact", F.col("entry")).otherwise(F.col("entry") + 1_000_000)
    match = F.struct(F.col("s"), (-F.col("e")).alias("longer"), order.alias("o"), F.col("e"), rank.alias("r"), F.col("es")[0]["severity"].alias("severity"), F.col("es")[0]["language"].alias("language"), F.array_distinct(F.flatten(F.transform("es", lambda x: x["categories"]))).alias("categories"), "lemma", surface.alias("surface"), "tier", "casual_use", units.alias("start"), (units + F.col("e") - F.col("s") + wide_in(surface)).alias("end"))
    listed = merged.select(*names, match.alias("m")).groupBy(*names).agg(F.array_sort(F.collect_list("m")).alias("all"))
    kept = r.resolve(F.transform("all", lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["r"].alias("r"), x["severity"].alias("v"), i.alias("o"))))
    out = listed.select(*names, "all", F.explode(kept).alias("k_")).select(*names, F.get("all", F.col("k_.o")).alias("m"))
    fields = {"char_start": "s", "char_end": "e"}
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *[F.col(f"m.{fields.get(c, c)}").cast({"severity": "int"}.get(c, "int") if c in ("severity", "start", "end", "char_start", "char_end") else out.schema["m"].dataType[c].dataType).alias(c) for c in MATCH])


def admitted(found: DataFrame, options: Options) -> DataFrame:
    found = found.where(F.col("severity") >= options.min_severity)
    if options.categories is None:
        return found
    return found.where(F.arrays_overlap("categories", F.array(*[F.lit(x) for x in options.categories]).cast("array<string>")))
