"""Text and address functions as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property types of either language and their plurals.
PROPERTY_TYPES = {
    "maison": "house", "maisons": "house", "house": "house",
    "appartement": "apartment", "appartements": "apartment", "apartment": "apartment",
    "terrain": "land", "terrains": "land", "land": "land",
    "local commercial": "commercial", "locaux commerciaux": "commercial", "commercial": "commercial",
    "autre": "other", "autres": "other", "other": "other",
}
# French labels of property types.
TYPE_LABELS = {"house": "Maison", "apartment": "Appartement", "land": "Terrain", "commercial": "Commercial", "other": "Autre"}
# Street types as they are shortened for matching.
SHORT_STREETS = {"AVENUE": "AV", "BOULEVARD": "BD", "PLACE": "PL", "ALLEE": "AL", "IMPASSE": "IMP"}
# Words left out when addresses are compared.
STREET_WORDS = ["RUE", "AVENUE", "AV", "BOULEVARD", "BD", "PLACE", "PL", "ALLEE", "IMPASSE", "IMP"]

#: The ASCII forms of all characters that have one: what is left of their compatibility decomposition without marks.  Generated.
_ASCII = {chr(c): a for c in range(0x80, sys.maxunicode + 1) if (a := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode())}
_ONE = {c: a for c, a in _ASCII.items() if len(a) == 1}
_MORE = {c: a for c, a in _ASCII.items() if len(a) > 1}
#: Those in Latin text, which are looked for one by one.
_LATIN = {c: a for c, a in _MORE.items() if c < "\u0180"}
_OTHER = {c: a for c, a in _MORE.items() if c >= "\u0180"}


def _spans(letters: list[str]) -> str:
    """A character class of ``letters``, in ascending order."""
    spans: list[list[int]] = []
    for c in map(ord, letters):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in spans) + "]"


def fold(text: Column) -> Column:
    """Without accents; letters that have no ASCII form vanish.  Equal to NFKD and dropping non-ASCII for all of Unicode.

    Text that is ASCII already goes through untouched, and only text with a letter of several outside Latin is taken apart.
    """
    at = lambda c: F.instr(F.lit("".join(_OTHER)), c)
    form = lambda c: F.when((c != "") & (at(c) > 0), F.split_part(F.lit("\x00".join(_OTHER.values())), F.lit("\x00"), at(c))).otherwise(c)
    apart = lambda t: F.array_join(F.transform(F.split(t, ""), form), "")
    out = F.when(text.rlike(_spans(list(_OTHER))), apart(text)).otherwise(text)
    out = F.translate(out, "".join(_ONE), "".join(_ONE.values()))
    for c, a in _LATIN.items():
        out = F.replace(out, F.lit(c), F.lit(a))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.regexp_replace(out, "[^\\x00-\\x7F]", "")).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def clean_upper(text: Column) -> Column:
    """Normalised address or city: folded, upper case, punctuation as spaces, single spaces; null is ''."""
    return squeeze(F.regexp_replace(F.upper(fold(F.coalesce(text, F.lit("")))), "[^\\w\\s]", " "))


def match_form(address: Column) -> Column:
    """The form in which addresses are matched: upper case before folding, no brackets, short street types, no postcodes."""
    out = fold(F.upper(F.coalesce(address, F.lit(""))))
    out = F.regexp_replace(F.regexp_replace(out, "\\([^)]*\\)", ""), "[^\\w\\s]", " ")
    for long, short in SHORT_STREETS.items():
        out = F.replace(out, F.lit(f" {long} "), F.lit(f" {short} "))
    return squeeze(F.regexp_replace(out, "\\d{5}", ""))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_address(address: Column) -> Column:
    """struct(number, street, city): a leading number with at most one letter; the city follows a comma, else begins at a postcode."""
    text = fold(F.upper(F.coalesce(address, F.lit(""))))
    number = "^(\\d+\\s*[A-Z]?)[\\s,]"
    rest = F.trim(F.regexp_replace(text, number, ""))
    rest = F.when(text.rlike(number), rest).otherwise(text)
    parts, before = F.split(rest, ","), F.regexp_extract(rest, "^(.*?)\\b\\d{5}\\b", 1)
    comma, postcode = F.size(parts) > 1, rest.rlike("\\b\\d{5}\\b")
    street = F.when(comma, parts[0]).when(postcode, before).otherwise(rest)
    city = F.when(comma, F.get(parts, F.lit(1))).when(postcode, F.substr(rest, F.length(before) + 1)).otherwise(F.lit(""))
    return F.struct(
        F.trim(_found(text, number)).alias("number"),
        F.when(comma | postcode, F.trim(street)).otherwise(street).alias("street"),
        F.trim(city).alias("city"),
    )


def street_digits(number: Column) -> Column:
    return F.regexp_replace(number, "[^0-9]", "").try_cast("int")


def numbers_agree(a: Column, b: Column) -> Column:
    """Both numbers there and their digits equal or at most 2 apart."""
    return F.coalesce(F.abs(street_digits(a) - street_digits(b)) <= 2, F.lit(False))


def compare_form(address: Column) -> Column:
    """Upper case without punctuation and street words; accents stay."""
    words = F.split(squeeze(F.regexp_replace(F.upper(F.coalesce(address, F.lit(""))), "[^\\p{L}\\p{N}_\\s]", "")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(STREET_WORDS)), " ")


def split_listing_address(text: Column) -> Column:
    """struct(address, city, postal_code) of 'A - City 75001', 'A - City' or a mere address."""
    text = F.coalesce(text, F.lit(""))
    full, short = "(.+)\\s-\\s(.+)\\s(\\d{5})", "(.+)\\s-\\s(.+)"
    is_full, is_short = text.rlike(full), text.rlike(short)
    loose = F.regexp_extract(text, short, 2)
    return F.struct(
        F.when(is_full, F.trim(F.regexp_extract(text, full, 1))).when(is_short, F.trim(F.regexp_extract(text, short, 1))).otherwise(text).alias("address"),
        F.when(is_full, F.trim(F.regexp_extract(text, full, 2))).when(is_short, F.trim(F.regexp_replace(loose, "\\d{5}", ""))).otherwise("").alias("city"),
        F.when(is_full, F.regexp_extract(text, full, 3)).when(is_short, F.regexp_extract(loose, "(\\d{5})", 1)).otherwise("").alias("postal_code"),
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def absolute_url(url: Column, base: str) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(url.startswith("/"), F.concat(F.lit(base.rstrip("/")), url)).otherwise(url)


def market_url(base: str, region: Column, region_code: Column, dep_name: Column, dep: Column, city: Column, insee: Column) -> Column:
    """Region, department and city pages lie under each other."""
    head = F.concat_ws("-", F.coalesce(slug(region), F.lit("france")), F.coalesce(region_code, F.lit("00")))
    return F.concat(F.lit(base.rstrip("/") + "/"), head, F.lit("/"), F.coalesce(F.nullif(slug(dep_name), F.lit("")), dep), F.lit("-"), dep, F.lit("/"), slug(city), F.lit("-"), insee, F.lit("/"))


def search_url(base: str, lat: Column, lon: Column, zoom: Column, types: Column, period: Column) -> Column:
    pairs = [("center", F.concat_ws(";", lon.cast("string"), lat.cast("string"))), ("zoom", zoom.cast("string")), ("propertytypes", types), ("minmonthyear", period), ("maxmonthyear", period)]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *(F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in pairs)))


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


# Words that tell a type in the text of a listing, and those by which a text is taken to name one.
TYPE_WORDS = [("appartement", "apartment"), ("maison", "house"), ("terrain", "land"), ("commercial", "commercial")]
NAMING_WORDS = ["appartement", "maison", "terrain", "local", "commercial"]


def names_type(text: Column) -> Column:
    return F.lower(text).rlike("|".join(NAMING_WORDS))


def property_type(raw: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(PROPERTY_TYPES), F.trim(F.lower(F.coalesce(raw, F.lit(""))))), F.lit("other"))


def postcode(raw: Column) -> Column:
    """What stands before a point, trimmed, cut or zero-padded to 5."""
    return F.lpad(F.substr(F.trim(F.substring_index(raw, ".", 1)), F.lit(1), F.lit(5)), 5, "0")


def first_five_digits(raw: Column) -> Column:
    return F.nullif(F.substr(F.regexp_replace(raw, "\\D", ""), F.lit(1), F.lit(5)), F.lit(""))


def insee(raw: Column) -> Column:
    """A valid 5-character municipality code, Corsica's 2A and 2B included, else null."""
    code = postcode(raw)
    return F.when(code.rlike("^(\\d{5}|2[AB]\\d{3})$"), code)


def department_of(given: Column, insee_code: Column, postal_code: Column) -> Column:
    """The given department, else that of the municipality code, else that of the postcode; '' counts as none."""
    own = [F.nullif(c, F.lit("")) for c in (given, insee_code, postal_code)]
    return F.coalesce(own[0], department(own[1]), department(own[2]))


def department(insee_code: Column) -> Column:
    return F.when(insee_code.startswith("97"), F.substr(insee_code, F.lit(1), F.lit(3))).otherwise(F.substr(insee_code, F.lit(1), F.lit(2)))


def region_of(context: Column) -> Column:
    return F.trim(F.substring_index(context, ",", 1))


def query_key(address: Column, city: Column, code: Column) -> Column:
    return F.concat_ws(", ", address, city, code)


def describe(kind: Column, surface: Column, rooms: Column) -> Column:
    """'Maison • 120m² • 4 pièces'; parts that are null or 0 are left out."""
    label = F.coalesce(F.try_element_at(_lookup(TYPE_LABELS), kind), F.initcap(kind))
    return F.concat_ws(
        " • ", label, F.when(surface != 0, F.concat(surface.cast("string"), F.lit("m²"))), F.when(rooms != 0, F.concat(rooms.cast("string"), F.lit(" pièces")))
    )


def price_label(price: Column) -> Column:
    return F.when(price != 0, F.concat(F.replace(F.format_number(price, 0), F.lit(","), F.lit(" ")), F.lit("€"))).otherwise("Prix non disponible")


def geopoint(text: Column) -> Column:
    parts = F.split(text, ",")
    return F.struct(F.trim(F.get(parts, F.lit(0))).try_cast("double").alias("lat"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("lon"))


def listing_price(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("int"), F.lit(0))


def listing_rooms(text: Column) -> Column:
    return F.coalesce(F.when(F.trim(text).rlike("^\\d+$"), F.trim(text).try_cast("int")), F.lit(0))


def listing_surface(text: Column) -> Column:
    return F.coalesce(F.replace(F.trim(F.replace(text, F.lit("m²"), F.lit(""))), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
