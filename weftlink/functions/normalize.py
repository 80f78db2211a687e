"""Names and addresses as column expressions.

Everything is JVM-side but Unicode normalisation, for which Spark has no function: `unicode_form`
is one Arrow UDF, left out with unicode=False (then the results are exact for ASCII).  Word classes
are spelt [\\p{L}\\p{N}_], word ends as look-arounds, white space as (?U)\\s.
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import LEGAL_SUFFIXES, NO_ADDRESS, REGIONS, ROADS, SHORT_LEGAL, SHORT_ROADS

W = r"[\p{L}\p{N}_]"
START, END = rf"(?<!{W})", rf"(?!{W})"
SPACE = r"(?U)\s+"
PUNCTUATION = r"""[.,;:!?()\[\]{}'"/\\|_#@*+=~`^-]"""
NON_LATIN = r"(?U)[^\u0000-\u024F\u2000-\u206F\s]"
_COMMA = "\ue000"  # stands for a comma of the raw text while it is normalised


def _udf(form: str):
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normal


def unicode_form(c: Column, form: str = "NFKC") -> Column:
    return _udf(form)(c)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or the words nan or none."""
    return c.isNull() | F.lower(strip(c)).isin("", "nan", "none")


def _clean(c: Column) -> Column:
    """basic_clean of a text that is in NFKC already."""
    c = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return strip(F.regexp_replace(F.regexp_replace(c, PUNCTUATION, " "), SPACE, " "))


def basic_clean(c: Column, unicode: bool = True) -> Column:
    """Lower case, & as and, ASCII punctuation as blanks, white space collapsed; '' for blank values."""
    return F.when(is_blank(c), F.lit("")).otherwise(_clean(unicode_form(c) if unicode else c))


def has_non_latin(c: Column) -> Column:
    return F.coalesce(c.rlike(NON_LATIN), F.lit(False))


def split_tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def dedupe_tokens(tokens: Column) -> Column:
    """The first of equal tokens stays, in order."""
    return F.array_distinct(tokens)


def sorted_text(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


#: More words first, as listed among equals.
_SUFFIX = START + "(" + "|".join(sorted(LEGAL_SUFFIXES, key=lambda s: -len(s.split()))) + ")$"


def legal_suffix(clean: Column) -> Column:
    """The canonical legal form at the end of a cleaned name, or null."""
    return F.try_element_at(_map(LEGAL_SUFFIXES), F.nullif(F.regexp_extract(clean, _SUFFIX, 1), F.lit("")))


def name_core(clean: Column) -> Column:
    """The cleaned name without its legal form."""
    return strip(F.regexp_replace(F.regexp_replace(clean, _SUFFIX, ""), SPACE, " "))


def normalize_name(c: Column, unicode: bool = True) -> Column:
    """struct: name_raw, name_clean, name_core, legal_suffix, name_tokens, name_tokens_sorted, is_non_latin, name_length."""
    clean = basic_clean(c, unicode)
    tokens = dedupe_tokens(split_tokens(clean))
    return F.struct(F.coalesce(c, F.lit("")).alias("name_raw"), clean.alias("name_clean"), name_core(clean).alias("name_core"), legal_suffix(clean).alias("legal_suffix"),
                    tokens.alias("name_tokens"), sorted_text(tokens).alias("name_tokens_sorted"), has_non_latin(c).alias("is_non_latin"), F.length(clean).alias("name_length"))


def numeric_tokens(c: Column) -> Column:
    """All standalone numbers of a raw text."""
    return F.regexp_extract_all(c, F.lit(START + r"\p{Nd}+" + END), F.lit(0))


def first_of_length(tokens: Column, least: int, most: int) -> Column:
    return F.try_element_at(F.filter(tokens, lambda t: (F.length(t) >= least) & (F.length(t) <= most)), F.lit(1))


def pin_code(c: Column) -> Column:
    """The first standalone number of 4 to 6 digits, or null."""
    return first_of_length(numeric_tokens(c), 4, 6)


def landmark(c: Column) -> Column:
    """`near ...` in lower case, or null."""
    return F.nullif(strip(F.regexp_extract(F.lower(c), START + r"near(?U:\s)+[a-z0-9 .]+", 0)), F.lit(""))


def address_tokens(c: Column, unicode: bool = True) -> Column:
    """Tokens after region codes (whole segments) and road words are expanded; the first of equals stays."""
    c = F.regexp_replace(c, rf"(?i){START}n(?U:\s)*/(?U:\s)*a{END}", " ")
    c = F.replace(c, F.lit(","), F.lit(_COMMA))
    c = unicode_form(c) if unicode else c
    regions, roads = _map(REGIONS), _map(ROADS)

    def segment(s: Column) -> Column:
        clean = F.when(is_blank(s), F.lit("")).otherwise(_clean(s))
        return F.coalesce(F.try_element_at(regions, clean), clean)

    text = F.array_join(F.filter(F.transform(F.split(c, _COMMA), segment), lambda s: s != ""), " ")
    return dedupe_tokens(F.transform(split_tokens(text), lambda t: F.coalesce(F.try_element_at(roads, t), t)))


def normalize_address(c: Column, unicode: bool = True) -> Column:
    """struct: address_raw, address_clean, address_tokens, address_tokens_sorted, pin_code, numeric_tokens,
    landmark_phrase, is_missing, is_non_latin, address_length."""
    missing = is_blank(c)
    none = F.array().cast("array<string>")
    tokens = F.when(missing, none).otherwise(address_tokens(c, unicode))
    clean = F.array_join(tokens, " ")
    return F.struct(F.coalesce(c, F.lit("")).alias("address_raw"), clean.alias("address_clean"), tokens.alias("address_tokens"), sorted_text(tokens).alias("address_tokens_sorted"),
                    F.when(~missing, pin_code(c)).alias("pin_code"), F.when(missing, none).otherwise(numeric_tokens(c)).alias("numeric_tokens"),
                    F.when(~missing, landmark(c)).alias("landmark_phrase"), missing.alias("is_missing"), (~missing & has_non_latin(c)).alias("is_non_latin"), F.length(clean).alias("address_length"))


def with_normal_forms(records: DataFrame, unicode: bool = True) -> DataFrame:
    """records with the structs `name` and `address`."""
    return records.withColumns({"name": normalize_name(F.col("business_name"), unicode), "address": normalize_address(F.col("business_address"), unicode)})


# --- other forms -----------------------------------------------------------------------------
def clean_text(c: Column, unicode: bool = True) -> Column:
    """NFKD with white space collapsed; '' for null."""
    c = F.coalesce(c, F.lit(""))
    return strip(F.regexp_replace(unicode_form(c, "NFKD") if unicode else c, SPACE, " "))


def serialize_record(name: Column, address: Column, country: Column | None = None, drop_country: bool = True, prefix_fields: bool = False, canonicalize: bool = False, unicode: bool = True) -> Column:
    """The non-empty fields, joined by ` | `; with prefixes; or in canonical form (core and legal form, expanded address)."""
    if canonicalize:
        clean = basic_clean(name, unicode)
        name = F.concat_ws(" ", F.nullif(name_core(clean), F.lit("")), legal_suffix(clean))
        address = F.array_join(F.when(is_blank(address), F.array().cast("array<string>")).otherwise(address_tokens(address, unicode)), " ")
    else:
        name, address = clean_text(name, unicode), clean_text(address, unicode)
    parts = [("name", name), ("address", address)]
    if country is not None and not drop_country:
        parts.append(("country", clean_text(country, unicode)))
    filled = [F.when(c != "", F.concat(F.lit(f"{k}: " if prefix_fields else ""), c)) for k, c in parts]
    return F.concat_ws(" | ", *filled)


def raw_pin(c: Column) -> Column:
    """The first standalone run of 4 to 6 digits in a raw address, or null."""
    return F.nullif(F.regexp_extract(c, START + r"\p{Nd}{4,6}" + END, 0), F.lit(""))


def raw_first_token(c: Column) -> Column:
    """The first token of a raw name, anything but ASCII letters, digits and white space blanked; or null."""
    return F.nullif(F.split_part(F.regexp_replace(strip(F.lower(F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s]", " "))), SPACE, " "), F.lit(" "), F.lit(1)), F.lit(""))


def char_ngrams(c: Column, n: int, padded: bool = True) -> Column:
    """The distinct n-grams of ` text ` (padded) or of the text."""
    c = F.concat(F.lit(" "), c, F.lit(" ")) if padded else c
    last = F.length(c) - n + 1
    grams = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n))))
    return F.array_distinct(F.coalesce(grams, F.array().cast("array<string>")))


def acronym(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, F.lit(1), F.lit(1))), "")


def parse_id_list(c: Column) -> Column:
    """A comma list of ids as an array, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x)), lambda x: x != "")


# --- the short forms -------------------------------------------------------------------------
def _short_tokens(c: Column) -> Column:
    return split_tokens(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), SPACE, " "))


def short_name(c: Column) -> Column:
    """Lower case, no punctuation, and no legal terms wherever they stand."""
    return F.array_join(F.filter(_short_tokens(c), lambda t: ~t.isin(*SHORT_LEGAL)), " ")


def short_address(c: Column) -> Column:
    """Lower case, no punctuation, five road words expanded."""
    roads = _map(SHORT_ROADS)
    return F.array_join(F.transform(_short_tokens(c), lambda t: F.coalesce(F.try_element_at(roads, t), t)), " ")


def short_pin(c: Column) -> Column:
    """The first standalone number of 5 or 6 digits, or ''."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), START + r"\p{Nd}{5,6}" + END, 0)


def serialize_plain(name: Column, address: Column) -> Column:
    """name | address, or the name alone where the address is a word for none."""
    name, address = strip(F.coalesce(name, F.lit(""))), strip(F.coalesce(address, F.lit("")))
    return F.when(F.lower(address).isin(*NO_ADDRESS), name).otherwise(F.concat(name, F.lit(" | "), address))


def source_prefix(c: Column) -> Column:
    """S2 or S3 of a candidate's id, else ''."""
    return F.regexp_extract(c, "^(S[23])-", 1)


def bytes_text(c: Column) -> Column:
    """A size in bytes with its unit, to two digits."""
    value, out = c.cast("double"), None
    for k, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB")))):
        text = F.concat(F.format_string("%.2f", F.bround(value / 1024 ** k, 2)), F.lit(f" {unit}"))
        out = text if out is None else F.when(value < 1024 ** (k + 1), text).otherwise(out)
    return out
