"""Text functions of the conflation engine: normalisation of names, house numbers and codes, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafuse.functions.core import let

# Articles, titles and digit words of the street-name normal form, in the order in which they apply.
ARTICLES = ("DE LA", "DU", "DES", "LE", "LA", "LES", "DE", "D")
TITLES = {
    "MARECHAL": "MAL", "PRESIDENT": "PDT", "GENERAL": "GAL", "COMMANDANT": "CDT", "CAPITAINE": "CAP", "REGIMENT": "REGT", "SAINTE": "STE", "SAINT": "ST",
}
DIGITS = ("ZERO", "UN", "DEUX", "TROIS", "QUATRE", "CINQ", "SIX", "SEPT", "HUIT", "NEUF")
NUMBER_WORDS = {"DIX": "UNZERO", "ONZE": "UNUN", "DOUZE": "UNDEUX"}
SMALL_WORDS = ("de", "la", "le", "du", "des", "les", "d", "l")
# Fixed value: house number with an optional repetition word or letter.
HOUSE_NUMBER = r"(?i)^([0-9]+)((?: bis)|(?: ter)|(?: quater)|(?: quinquies)|(?:[A-Za-z?]*))\b"
REPETITIONS = {"B": "bis", "T": "ter", "Q": "quater"}

_ACCENTED = {}
for _code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
    _base = unicodedata.normalize("NFD", chr(_code))[0]
    if _base != chr(_code) and _base.isascii():
        _ACCENTED[chr(_code)] = _base


def to_ascii(s: Column) -> Column:
    """Letters without their accents; other non-ASCII characters go."""
    return F.regexp_replace(F.translate(s, "".join(_ACCENTED), "".join(_ACCENTED.values())), r"[^\x00-\x7F]", "")


def roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def digit_words(n: int) -> str:
    return "".join(DIGITS[int(d)] for d in str(n))


def normalize_street(s: Column, abbreviations: dict[str, str]) -> Column:
    """The normal form under which street names of two registers are compared.

    The steps apply strictly in order: ASCII, upper case, separators to spaces, street type (up to
    three words) to its abbreviation, digits to words, articles and titles inside the name, a last roman
    number up to XXIII to digit words. Null stays null, empty stays empty.
    """
    s = F.upper(to_ascii(s))
    s = F.regexp_replace(F.translate(s, "-'/", "   "), " +", " ")
    def typed(x: Column) -> Column:
        out = F
        for long, short in sorted(abbreviations.items(), key=lambda kv: (len(kv[0].split()), kv[0])):  # the shortest that fits wins
            fits = (x == long) | F.startswith(x, F.lit(long + " "))
            out = out.when(fits, F.concat(F.lit(short), F.substring(x, F.lit(len(long) + 1), F.length(x))))
        return x if out is F else out.otherwise(x)

    s = let(s, typed)
    s = F.replace(s, F.lit(" EME "), F.lit("EME "))
    s = reduce(lambda c, d: F.replace(c, F.lit(str(d)), F.lit(DIGITS[d])), range(10), s)
    for old, new in (*NUMBER_WORDS.items(),):
        s = F.replace(s, F.lit(f" {old} "), F.lit(f" {new} "))
    for w in ARTICLES:
        s = F.replace(s, F.lit(f" {w} "), F.lit(" "))
    for old, new in TITLES.items():
        s = F.replace(s, F.lit(f" {old} "), F.lit(f" {new} "))
    words = F.create_map(*[F.lit(x) for n in range(1, 24) for x in (roman(n), digit_words(n))])

    def numbered(x: Column) -> Column:
        last = F.regexp_extract(x, r" ([IVX]+)$", 1)
        word = F.element_at(words, last)
        return F.when(word.isNotNull(), F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(last)), word)).otherwise(x)

    return let(s, numbered)


def web_normalize(s: Column) -> Column:
    """The form that a select box is searched by."""
    s = to_ascii(F.lower(s))
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(s, "-_'", "   "), r"\bsainte?\b", "st"), " +", " "))


def capitalize(s: Column) -> Column:
    """Every word with a capital first letter."""
    return F.initcap(F.lower(s))


def humanise_title(s: Column) -> Column:
    """Title case with small articles, except for the first word."""
    words = F.split(F.initcap(F.lower(s)), " ")
    small = [w for w in SMALL_WORDS]
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(w)), " ")


def house_number(s: Column) -> tuple[Column, Column, Column]:
    """Number, suffix and rest of an address; empty strings where there is none."""
    number, suffix = F.regexp_extract(s, HOUSE_NUMBER, 1), F.regexp_extract(s, HOUSE_NUMBER, 2)
    rest = F.trim(F.substring(s, F.length(number) + F.length(suffix) + 1, F.length(s)))
    return number, F.trim(suffix), rest


def repetition(letter: Column) -> Column:
    """Bis, ter or quater for its letter; null for other letters."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in REPETITIONS.items() for x in kv]), F.upper(letter))


def postal_truncate(s: Column) -> Column:
    """The lines before the last one that begins with a postal code, joined by spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)^(.*)(^|\n)[0-9]{5}.*$", "$1"), "\n", " "))


def interval_numbers(s: Column) -> Column:
    """The numbers of "n à m", every second one; null for other texts."""
    low, high = (F.regexp_extract(s, "^([0-9]+) [àa] ([0-9]+)", g) for g in (1, 2))
    n, m = F.when(low != "", low.cast("int")), F.when(high != "", high.cast("int"))
    return F.when(n <= m, F.sequence(n, m, F.lit(2)))


def insee_code(department: Column, commune: Column) -> Column:
    """The national commune code; a metropolitan department comes with a leading zero."""
    metropole = F.concat(F.substring(department, 2, 2), F.substring(commune, 3, 3))
    return F.when(F.substring(department, 1, 1) == "0", metropole).otherwise(F.concat(F.substring(department, 1, 2), F.substring(commune, 3, 3)))


def xml_escape(s: Column) -> Column:
    """In one pass, ampersands first."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def html_unescape(s: Column) -> Column:
    """The entities that commune names come with."""
    for old, new in (("&#039;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s
