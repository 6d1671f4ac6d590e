"""Label cleaning and field extraction from listing text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickline.functions.numbers import once

# Target geographies, the first one named in a label counts.
CANONICAL_GEOS = ["Kelowna", "Vancouver", "Toronto", "Canada"]
# Number words of bedroom labels, from zero.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five"]
# Names of a dwelling without a separate bedroom.
NO_BEDROOM = ["studio", "bachelor"]
# Spellings that name a target city.
CITY_SPELLINGS = {
    "vancouver, bc": "Vancouver",
    "city of vancouver": "Vancouver",
    "vancouver": "Vancouver",
    "toronto, on": "Toronto",
    "city of toronto": "Toronto",
    "toronto": "Toronto",
    "kelowna, bc": "Kelowna",
    "kelowna": "Kelowna",
}
# Square feet per square metre; letters that no accent rule takes apart.
SQFT_PER_M2 = 10.7639
OWN_LETTERS = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Þ": "Th", "þ": "th"}
STROKED = {"Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h", "ı": "i"}
# Public rule of postal codes: letter digit letter, digit letter digit; D F I O Q U are not used, W and Z not in front.
POSTAL_FRONT, POSTAL_LETTER = "ABCEGHJ-NPRSTVXY", "ABCEGHJ-NPRSTV-Z"
POSTAL_CODE = rf"(?i)\b([{POSTAL_FRONT}][0-9][{POSTAL_LETTER}])[ -]?([0-9][{POSTAL_LETTER}][0-9])\b"
# A count, with a half where there is one, and the words that may follow it.
COUNT = r"(?i)\b([0-9]{1,3}(?:[.][0-9])?)[ -]*"
BED_WORDS, BATH_WORDS = r"(?:bed|bdrm|br\b)", r"(?:bath|ba\b)"
AMOUNT = r"(?i)\b([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*"
SQFT_WORDS, M2_WORDS = r"(?:sq[.]?\s*ft|square f(?:ee|oo)t|ft²|ft2)", r"(?:m2|m²|sq[.]?\s*m\b|square met)"


def _plain_letters() -> dict[str, str]:
    """Each accented Latin letter below U+0250 with the letter it is made from."""
    table = dict(STROKED)
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            table[chr(code)] = base
    return table


PLAIN_LETTERS = _plain_letters()


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Small literal dictionary as an expression; a missing key is null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents; ligatures are written out."""
    c = F.translate(c, "".join(PLAIN_LETTERS), "".join(PLAIN_LETTERS.values()))
    for letter, plain in OWN_LETTERS.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return c


def canonical_geo(c: Column) -> Column:
    """The first target geography whose name is a word of the label, else null."""
    words = F.split(F.lower(strip_accents(c)), "[^a-z]+")

    def named(tokens: Column) -> Column:
        return F.coalesce(*(F.when(F.array_contains(tokens, geo.lower()), geo) for geo in CANONICAL_GEOS))

    return once(words, named)


def clean_geo_label(c: Column) -> Column:
    """``CMA of Ottawa – Gatineau, Ontario (map)`` to ``Ottawa - Gatineau``."""
    s = F.regexp_replace(F.replace(c, F.lit("CMA of "), F.lit("")), r" \(map\)", "")
    s = F.replace(s, F.lit("–"), F.lit("-"))
    return F.initcap(F.lower(F.trim(F.regexp_replace(s, r",.*", ""))))


def map_city_or_title(c: Column, spellings: dict[str, str] | None = None) -> Column:
    key = F.lower(F.trim(c))
    return F.coalesce(lookup(key, spellings or CITY_SPELLINGS), F.initcap(key))


def normalise_bedrooms(c: Column) -> Column:
    """Bedroom label to ``0BR .. 4BR+``: its first number, or the number word or dwelling name it starts with; above five null."""
    label = F.lower(F.trim(c.cast("string")))
    first_word = F.regexp_extract(label, "^([a-z]+)", 1)
    word = F.nullif(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), first_word), F.lit(0)) - 1
    number = F.coalesce(
        F.regexp_extract(label, "([0-9]+)", 1).try_cast("int"), word.cast("int"), F.when(first_word.isin(NO_BEDROOM), 0)
    )
    return once(number, lambda n: F.when(n <= 3, F.concat(n.cast("string"), F.lit("BR"))).when(n < len(NUMBER_WORDS), "4BR+"))


# Words that name a property type, types in the order of precedence; in titles and in trails.
TYPE_WORDS = {
    "Townhouse": ["townhouse", "town house"],
    "Condo": ["condo"],
    "Apartment": ["apartment", "suite"],
    "Detached": ["house", "detached", "home"],
}
TRAIL_WORDS = {"Condo": ["condo"], "Apartment": ["apartment"], "Townhouse": ["town"], "Detached": ["house"]}


def _named_type(label: Column, words: dict[str, list[str]], other: Column) -> Column:
    """The first type with a word in the label, else ``other``; null for a null or empty label."""
    low = F.lower(label)
    named = (F.when(low.rlike("|".join(some)), F.lit(kind)) for kind, some in words.items())
    return F.when(label != "", F.coalesce(*named, other))


def normalise_property_type(c: Column) -> Column:
    return _named_type(c, TYPE_WORDS, F.initcap(F.trim(c)))


def breadcrumb_property_type(c: Column) -> Column:
    """Type from the last step of a ``A / B / C`` trail."""
    tail = F.trim(F.element_at(F.split(c, "/"), -1))
    return _named_type(tail, TRAIL_WORDS, tail)


def _number_at(c: Column, pattern: str, kind: str) -> Column:
    return F.replace(F.regexp_extract(c, pattern, 1), F.lit(","), F.lit("")).try_cast(kind)


def parse_price(c: Column) -> Column:
    """First number of the text as a whole amount."""
    return _number_at(c, r"(\d[\d,]*)", "bigint")


def parse_beds(c: Column) -> Column:
    return _number_at(c, COUNT + BED_WORDS, "double")


def parse_baths(c: Column) -> Column:
    return _number_at(c, COUNT + BATH_WORDS, "double")


def parse_area_sqft(c: Column) -> Column:
    """Whole square feet; square metres are converted."""
    metres = _number_at(c, AMOUNT + M2_WORDS, "double")
    return F.coalesce(_number_at(c, AMOUNT + SQFT_WORDS, "bigint"), F.round(metres * SQFT_PER_M2).cast("bigint"))


def extract_postal_code(c: Column) -> Column:
    """The first postal code of the text as ``A1A 1A1``, else null."""
    halves = [F.upper(F.regexp_extract(c, POSTAL_CODE, k)) for k in (1, 2)]
    return F.when(halves[0] != "", F.concat_ws(" ", *halves))


def listing_id(source: str, url: Column, native_id: Column | None = None) -> Column:
    hashed = F.left(F.sha1(url), F.lit(16))
    return F.concat(F.lit(f"{source}:"), hashed if native_id is None else F.coalesce(native_id, hashed))


def details_field(c: Column, label: str) -> Column:
    """Value of a ``label: value`` line of a details panel."""
    value = F.trim(F.regexp_extract(c, rf"(?im)^\s*{label}\s*:?\s*(.+)$", 1))
    return F.nullif(value, F.lit(""))


def strip_tags(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags removed, spaces squeezed."""
    s = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalise_pid(c: Column) -> Column:
    """First eight digits of a table identifier; fewer digits is null."""
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    return once(digits, lambda d: F.when(F.length(d) >= 8, F.left(d, F.lit(8))))


def strip_model_suffix(c: Column) -> Column:
    return F.replace(c, F.lit("_backtest"), F.lit(""))
