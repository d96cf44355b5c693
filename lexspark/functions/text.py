"""Romanisation and Han text functions as Column expressions; nothing here runs Python on executors."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tone marks by digit, particles that count as words without a tone, source weights,
# half-width punctuation, weekday names from Sunday on.
TONE_MARKS = {"2": "́", "3": "̀", "5": "̂", "7": "̄", "8": "̍", "9": "̆"}
PARTICLES = ("a", "e", "i", "o", "u", "m", "ng")
SOURCE_WEIGHTS = {"moe": 1000, "itaigi": 800, "taihoa": 500, "maryknoll": 300, "embree": 300, "kamjitian": 250, "taijit": 200, "pehoe": 200, "sitbut": 200}
OTHER_WEIGHT = 100
HALF_WIDTH = {"，": ",", "。": ".", "！": "!", "？": "?", "：": ":", "「": '"', "」": '"', "（": "(", "）": ")"}
WEEKDAYS_HAN = ("禮拜日", "拜一", "拜二", "拜三", "拜四", "拜五", "拜六")
WEEKDAYS_ROMAN = ("Lé-pài-ji̍t", "Pài-it", "Pài-jī", "Pài-sann", "Pài-sì", "Pài-gōo", "Pài-la̍k")

#: Marks that the numbering functions know; 9 is written but never read.
READ_MARKS = {m: d for d, m in TONE_MARKS.items() if d != "9"}
#: Bounds a word as the numbering scripts do: neither letter, digit nor underscore follows.
_WORD_END = r"(?![\p{L}\p{N}_])"
#: Blocks of Han characters in the basic plane.
HAN = r"[一-鿿㐀-䶿]"
CHARACTER = "(?s)."
#: White space that parts words: Unicode's and the four separators U+001C to U+001F; spelled out, as a class of single characters is quicker than a Unicode property.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def swap(c: Column, *pairs: tuple[str, str]) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def resub(c: Column, *pairs: tuple[str, str]) -> Column:
    """Regular replacements, one after the other."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def joined(c: Column, separator: str, step) -> Column:
    """The parts of a text between separators, each through step, joined again."""
    return F.array_join(F.transform(F.split(c, f"\\Q{separator}\\E", -1), step), separator)


def characters(c: Column) -> Column:
    """The code points as an array."""
    return F.regexp_extract_all(c, F.lit(CHARACTER), F.lit(0))


def _composed() -> list[tuple[str, str]]:
    pairs = [(unicodedata.normalize("NFC", b + m), b + m) for b in "aeioumnAEIOUMN" for m in TONE_MARKS.values()]
    return [p for p in pairs if len(p[0]) == 1]


def decomposed(c: Column) -> Column:
    """NFD for the letters and marks of this orthography (a closed set made by rule)."""
    return swap(c, *_composed())


def composed(c: Column) -> Column:
    """NFC for the same closed set."""
    return swap(c, *((b, a) for a, b in _composed()))


# --- tones ----------------------------------------------------------------------------------


def implicit_tone(c: Column) -> Column:
    """Syllables of lower-case letters alone get their tone: 4 after p, t, k, h, else 1. Others stay."""
    tone = lambda s: F.when(s.rlike("[ptkh]$"), F.lit("4")).otherwise(F.lit("1"))
    return joined(c, "-", lambda s: F.when(s.rlike("^[a-z]+$"), F.concat(s, tone(s))).otherwise(s))


def strip_final_tones(c: Column, delimiter: str = "-") -> Column:
    """A last digit 1-9 of each syllable is dropped; syllables are joined by the delimiter."""
    return F.array_join(F.transform(F.split(c, "-", -1), lambda s: F.regexp_replace(s, "[1-9]$", "")), delimiter)


def strip_all_tones(c: Column) -> Column:
    """All digits 1-9 are dropped."""
    return F.regexp_replace(c, "[1-9]", "")


def strip_tones_before_breaks(c: Column) -> Column:
    """A digit after a letter is dropped at the end and before a space or hyphen."""
    return resub(c, ("([a-z])([1-9])$", "$1"), (r"([a-z])([1-9])([\s\-])", "$1$3"))


def strip_marks(c: Column) -> Column:
    """Combining marks are dropped and a dotless i gets its dot; letters with a built-in mark stay."""
    return swap(F.regexp_replace(c, "[̀-ͯ]", ""), ("ı", "i"))


def code_to_key(c: Column) -> Column:
    """Hyphens to spaces; a light-tone boundary (two hyphens) to two spaces."""
    return swap(c, ("--", "\x00"), ("-", " "), ("\x00", "  "))


def key_to_code(c: Column) -> Column:
    return swap(c, ("  ", "\x00"), (" ", "-"), ("\x00", "--"))


def marks_to_digits(c: Column) -> Column:
    """Tone marks become digits where they stand; the rest is left decomposed."""
    return F.translate(decomposed(c), "".join(READ_MARKS), "".join(READ_MARKS.values()))


def _tone_digit(s: Column) -> Column:
    """The digit of the last tone mark in a decomposed syllable, or empty."""
    mark = F.regexp_extract(s, f"(?s).*([{''.join(READ_MARKS)}])", 1)
    return F.translate(mark, "".join(READ_MARKS), "".join(READ_MARKS.values()))


def _unmarked(s: Column) -> Column:
    return composed(F.regexp_replace(s, f"[{''.join(READ_MARKS)}]", ""))


def numbered(c: Column) -> Column:
    """Marked syllables get their digit at the end; unmarked ones stay as they are."""
    return joined(decomposed(c), "-", lambda s: F.concat(_unmarked(s), _tone_digit(s)))


def numbered_all(c: Column) -> Column:
    """Lower-cased; every syllable gets a digit at the end of its letters, 1 if it has no mark. Punctuation around it stays, and runs of white space become one space."""
    marks = "".join(READ_MARKS)

    def syllable(s: Column) -> Column:
        front = F.regexp_extract(s, rf"^([^\p{{L}}{marks}]*)", 1)
        back = F.regexp_extract(s, rf"([^\p{{L}}{marks}]*)$", 1)
        core = F.regexp_extract(s, rf"^[^\p{{L}}{marks}]*(.*?)[^\p{{L}}{marks}]*$", 1)
        tone = F.when(_tone_digit(core) == "", F.lit("1")).otherwise(_tone_digit(core))
        return F.when(core == "", s).otherwise(F.concat(front, _unmarked(core), tone, back))

    words = F.split(F.trim(F.regexp_replace(decomposed(F.lower(c)), r"(?U)\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: joined(w, "-", syllable)), " ")


# --- spelling systems; the pairs of letters and their order are fixed values -----------------


def tl_to_poj_words(c: Column) -> Column:
    """The script's rules: ing and ik change only at a word's end, and a tone digit is no end."""
    return resub(c, ("tsh", "chh"), ("ts", "ch"), ("ing" + _WORD_END, "eng"), ("ik" + _WORD_END, "ek"), ("ua", "oa"), ("ue", "oe"))


def tl_to_poj(c: Column) -> Column:
    """The display rules: ing and ik change before anything but a letter a-z; nn and oo get their special signs."""
    return resub(
        c,
        ("tsh", "chh"),
        ("ts", "ch"),
        ("ing([^a-z])", "eng$1"),
        ("ing$", "eng"),
        ("ik([^a-z])", "ek$1"),
        ("ik$", "ek"),
        ("nn([^g̀-Ϳ])", "ⁿ$1"),
        ("nn$", "ⁿ"),
        ("o([̀-̿])o", "o$1͘"),
        ("oo", "o͘"),
        ("ua", "oa"),
        ("ue", "oe"),
    )


def poj_to_tl(c: Column) -> Column:
    return resub(F.lower(c), ("ⁿ", "nn"), ("o͘", "oo"), ("ou", "oo"), ("chh", "tsh"), ("ch", "ts"), ("eng" + _WORD_END, "ing"), ("ek" + _WORD_END, "ik"), ("oa", "ua"), ("oe", "ue"))


def marked_syllable(s: Column) -> Column:
    """A last tone digit becomes a mark on the main vowel (tones 1, 4 and 6 have none)."""
    tone = F.right(s, F.lit(1))
    base = F.regexp_replace(s, "(?s).$", "")
    mark = F.translate(tone, "".join(TONE_MARKS) + "146", "".join(TONE_MARKS.values()))
    at = lambda sub: F.instr(base, sub)
    ere = at("ere")
    place = (
        F.when(at("oo") > 0, at("oo"))
        .when(at("a") > 0, at("a"))
        .when(ere > 0, ere + 2)
        .when(at("e") > 0, at("e"))
        .when(at("o") > 0, at("o"))
        .when((at("i") > 0) | (at("u") > 0), F.greatest(at("i"), at("u")))
        .when(F.substring(base, 1, 2) == "nn", F.lit(2))
        .when(base.rlike("[mn]"), F.length(F.regexp_extract(base, "^([^mn]*)", 1)) + 1)
        .otherwise(F.lit(0))
    )
    with_mark = F.concat(F.left(base, place), mark, F.substring(base, place + 1, F.length(base)))
    return F.when(~tone.rlike("[1-9]"), s).when((mark == "") | (place == 0), base).otherwise(with_mark)


def marked(c: Column) -> Column:
    """Numbered syllables, spaces between, as marked ones with hyphens between; light-tone boundaries stay."""
    group = lambda g: F.array_join(F.transform(F.filter(F.split(g, r"\s+"), lambda x: x != ""), marked_syllable), "-")
    return joined(c, "--", group)


def poj_marks(c: Column) -> Column:
    """Marks moved as that spelling wants: oa, oe at a syllable's end carry theirs on o, ui on u; iu stays."""
    m = "([̀-̿])"
    return resub(c, (f"oa{m}-", "o$1a-"), (f"oa{m}ⁿ", "o$1aⁿ"), (f"oa{m}$", "o$1a"), (f"oe{m}-", "o$1e-"), (f"oe{m}ⁿ", "o$1eⁿ"), (f"oe{m}$", "o$1e"), (f"ui{m}", "u$1i"))


def capitalised(c: Column) -> Column:
    """A first letter a-z in upper case."""
    return F.when(c.rlike("^[a-z]"), F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))).otherwise(c)


# Spelling rules in order, (pattern, replacement); each adds variants to those found so far.
SPELLING_RULES = (("[1-9]$", ""), ("^ts", "ch"), ("^tsh", "chh"), ("^j", "l"), ("ing", "eng"), ("ik", "ek"), ("ua", "oa"), ("ue", "oe"), ("oo", "ou"), ("nn", "ⁿ"), ("ph", "f"), ("nng", "ng"), ("h$", ""))
#: The rule for initials, of low priority.
ABBREVIATION = "^([ptkmnbglsjhiuc]g?s?h?h?).*"


def spelling_variants(c: Column) -> Column:
    """All spellings of a syllable that the rules derive, the given one first; empty ones are dropped."""
    found = reduce(lambda got, r: F.array_union(got, F.transform(got, lambda x: F.regexp_replace(x, r[0], r[1]))), SPELLING_RULES, F.array(c))
    return F.filter(found, lambda x: x != "")


def abbreviation(c: Column) -> Column:
    return F.regexp_replace(c, ABBREVIATION, "$1")


# --- tokens ---------------------------------------------------------------------------------


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


#: The white space below U+0100, character by character, and that above. Texts nearly always lack the latter, and patterns with a short class take a third of the time.
_NARROW, _WIDE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0", r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _core(space: str) -> str:
    """A word without what isn't Latin at its edges: from its first letter to its last letter, digit or hyphen."""
    return rf"[{_LATIN}](?:[^{space}]*[{_LATIN}0123456789\-])?"


def _slot(space: str) -> str:
    """A word with its core as group, which is empty if the word has no letter."""
    return rf"[^{space}{_LATIN}]*+({_core(space)})[^{space}]*+|[^{space}]++"


def _each_word(c: Column, pattern, group: int) -> Column:
    found = lambda space: F.regexp_extract_all(c, F.lit(pattern(space)), F.lit(group))
    return F.when(c.rlike(_WIDE), found(SPACE)).otherwise(found(_NARROW))


def edge_stripped(c: Column) -> Column:
    """Words without what isn't Latin at their edges; empty ones are dropped. One pass of one pattern over the text: nothing is left of a word behind its match that could match again."""
    return _each_word(c, _core, 0)


def slots(c: Column) -> Column:
    """edge_stripped with an empty text in the place of each word that has no letter."""
    return _each_word(c, _slot, 1)


def is_token(c: Column) -> Column:
    """A tone digit, or a particle."""
    return c.rlike("[1-9]") | F.lower(c).isin(*PARTICLES)


def tokens(c: Column) -> Column:
    """Numbered words and particles of a line; hyphenated words are one."""
    return F.filter(edge_stripped(c), is_token)


_EDGES = r""".,;:!?"'()\[\]{}。，、；：！？「」『』（）"""


def marked_tokens(c: Column) -> Column:
    """tokens(), or if a line has none, its words with Latin letters and tone marks."""
    strip = lambda x: composed(F.regexp_replace(x, f"^[{_EDGES}]+|[{_EDGES}]+$", ""))
    ok = lambda x: x.rlike("[a-zA-Z]") & (decomposed(x).rlike("[̀-ͯ]") | is_token(x))
    plain = tokens(c)
    return F.when(F.size(plain) > 0, plain).otherwise(F.filter(F.transform(_words(c), strip), ok))


# --- Han text, weights ----------------------------------------------------------------------


def han_count(c: Column) -> Column:
    """Characters of Unicode category Lo."""
    return F.regexp_count(c, F.lit(r"\p{Lo}"))


def rule_type(c: Column) -> Column:
    """han if any character is Han, else lo."""
    return F.when(han_count(c) > 0, F.lit("han")).otherwise(F.lit("lo"))


def length_modifier(c: Column) -> Column:
    n = han_count(c)
    return F.when(n == 0, F.lit(1.0)).when(n == 1, F.lit(0.8)).when(n <= 3, F.lit(1.2)).otherwise(F.lit(0.6))


def source_weight(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), F.lit(OTHER_WEIGHT))


def entry_weight(base: Column, length: Column, sources: Column, count: Column) -> Column:
    """Source weight, length modifier, a tenth more for each further source, and corpus counts; truncated."""
    boost = F.lit(1) + F.log10(F.lit(1) + count) * 0.2
    return (base * length * F.pow(F.lit(1.1), sources - 1) * boost).cast("int")


def phrase_weight(count: Column, base: int = 500) -> Column:
    return (base * (1 + F.log10(1 + count) * 0.3)).cast("int")


def light_tone_weight(count: Column, plain: Column) -> Column:
    """300 to 1500 by the count's logarithm, at least 100 below the plain variant's weight (null: none) but never under 300."""
    raw = F.least(F.lit(1500), F.greatest(F.lit(300), (300 + F.log10(1 + count) * 150).cast("int")))
    return F.when(plain.isNull(), raw).otherwise(F.greatest(F.lit(300), F.least(raw, plain - 100)))


def syllable_count(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, "-", -1)))


# --- light-tone marks in text ---------------------------------------------------------------


def with_light_mark(text: Column, before: Column) -> Column:
    """The text with two hyphens after `before` syllables: a Han character is one, a run of other letters, digits and marks is one that ends at a sign, space or the text's end. Unchanged if there is no such place.

    Fold over the characters: place found, syllables, whether in a Latin run, and characters passed.
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit(False).alias("roman"), F.lit(0).alias("i"))

    def step(s, ch):
        han, roman = ch.rlike(r"^\p{Lo}$"), ch.rlike(r"^[\p{L}\p{N}\p{M}]$")
        n = F.when(han | (roman & ~s["roman"]), s["n"] + 1).otherwise(s["n"])
        ends = ~han & ~roman & s["roman"] & (s["n"] == before)
        place = F.when(s["pos"] > 0, s["pos"]).when(han & (n == before), s["i"] + 1).when(ends, s["i"]).otherwise(F.lit(0))
        return F.struct(place.alias("pos"), n.alias("n"), (~han & roman).alias("roman"), (s["i"] + 1).alias("i"))

    def end(s):
        return F.when(s["pos"] > 0, s["pos"]).when(s["roman"] & (s["n"] == before), s["i"]).otherwise(F.lit(0))

    place = F.aggregate(characters(text), start, step, end)
    put = F.concat(F.left(text, place), F.lit("--"), F.substring(text, place + 1, F.length(text)))
    return F.when((place == 0) & (before > 0), text).otherwise(put)


def marked_after(text: Column, n: Column) -> Column:
    """The text with two hyphens after n characters; null if n lies outside of it."""
    put = F.concat(F.left(text, n), F.lit("--"), F.substring(text, n + 1, F.length(text)))
    return F.when((n > 0) & (n < F.length(text)), put)


def marked_key(syllables: Column, tail: Column) -> Column:
    """Syllables joined by spaces with two hyphens before the last `tail`; null if that leaves one side empty."""
    n = F.size(syllables)
    put = F.concat(F.array_join(F.slice(syllables, 1, n - tail), " "), F.lit("--"), F.array_join(F.slice(syllables, n - tail + 1, tail), " "))
    return F.when((tail > 0) & (tail < n), put)


# --- display --------------------------------------------------------------------------------


def bracketed(c: Column) -> Column:
    """What stands in the first square brackets; empty if none."""
    return F.regexp_extract(c, r"(?s)\[(.*?)\]", 1)


def roman_of(comment: Column, poj: bool) -> Column:
    """The romanisation in a comment, marked; of two spellings (TL:... POJ:...) the one wanted."""
    inner = bracketed(comment)
    dual = F.regexp_extract(inner, r"POJ:(.+)" if poj else r"TL:(.*?)\s+POJ:", 1)
    plain = poj_marks(marked(tl_to_poj(inner))) if poj else marked(inner)
    both = inner.rlike(r"TL:.*?\s+POJ:.+")
    return F.when(inner == "", F.lit(None)).when(both, marked(dual)).otherwise(plain)


def both_spellings(roman: Column) -> Column:
    """A comment with both spellings, if they differ."""
    other = tl_to_poj(roman)
    return F.when(other == roman, F.concat(F.lit("["), roman, F.lit("]"))).otherwise(F.concat(F.lit("[TL:"), roman, F.lit(" POJ:"), other, F.lit("]")))


def readings(comment: Column, poj: bool = False) -> Column:
    """Numbered readings as marked ones, word by word; a bracketed note behind a word stays. Comments without digits stay."""

    def word(w):
        note = F.regexp_extract(w, r"^.+?(\(.*\))$", 1)
        body = F.left(w, F.length(w) - F.length(note))
        body = poj_marks(marked(tl_to_poj(body))) if poj else marked(body)
        return F.concat(body, note)

    words = F.filter(F.split(comment, r"\s+"), lambda x: x != "")
    return F.when(comment.rlike("[1-9]"), F.array_join(F.transform(words, word), " ")).otherwise(comment)


def half_width(c: Column) -> Column:
    return swap(c, *HALF_WIDTH.items())


def ends_sentence(c: Column) -> Column:
    return F.right(c, F.lit(1)).isin(".", "!", "?", "。", "！", "？")


def first_character(c: Column) -> Column:
    return F.left(c, F.lit(1))


def last_character(c: Column) -> Column:
    return F.right(c, F.lit(1))


def date_han(d: Column) -> Column:
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS_HAN)), F.dayofweek(d))
    return F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日 "), day)


def weekday_roman(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS_ROMAN)), F.dayofweek(d))


# --- glosses --------------------------------------------------------------------------------


def code_variants(c: Column) -> Column:
    """All codes of a cell: the mark for a substitute is dropped, slashes part variants, blank ones go."""
    parts = F.split(F.replace(c, F.lit("(替)"), F.lit("")), "/", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def first_code(c: Column) -> Column:
    """The first code of a cell in strict form, lower-case letters, digits, spaces and hyphens; null if it isn't."""
    code = F.trim(F.split(F.regexp_replace(c, r"\([替白文俗雅]\)", ""), "/")[0])
    return F.when(code.rlike(r"^[a-z0-9][a-z0-9 \-]*$"), code)


def gloss_words(c: Column) -> Column:
    """The words of a Mandarin gloss: notes in brackets go, sentences give none, words hold Han and have six characters at most."""
    bare = F.trim(F.regexp_replace(c, r"\([^)]*\)", ""))
    parts = F.transform(F.split(bare, "[、，,;]"), lambda x: F.trim(x))
    return F.when(bare.rlike("[。！？；：]"), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda w: w.rlike(HAN) & (F.length(w) <= 6)))


def characters_with_syllables(word: Column, code: Column) -> Column:
    """(character, syllable) pairs of a word if there are as many of both, two at least; else none."""
    han, syllables = F.regexp_extract_all(word, F.lit(HAN), F.lit(0)), F.split(code, "-", -1)
    pairs = F.zip_with(han, syllables, lambda a, b: F.struct(a.alias("character"), b.alias("syllable")))
    return F.when((F.size(han) == F.size(syllables)) & (F.size(han) >= 2), pairs).otherwise(F.filter(pairs, lambda _: F.lit(False)))
