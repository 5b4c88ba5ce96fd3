"""Text, list and code expressions of the raw tables."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions.core import let, lookup
from newsloom.functions.fixed import EVENT_ROOT_CODES, LANGUAGE_NAMES

LOCATION = "array<struct<geo_type:bigint,name:string,country_code:string,adm1_code:string,lat:double,lon:double>>"


@F.pandas_udf(StringType())
def _unescape(raw: pd.Series) -> pd.Series:
    return raw.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Case and accents away: decomposed, without combining marks."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c)), na_action="ignore")


def clean_title(raw: Column) -> Column:
    """Entities resolved, white space collapsed; null if nothing is left.

    Only titles with an ampersand reach the Python function; it gets nulls for the others.
    """
    coded = F.contains(raw, F.lit("&"))
    said = F.when(coded, _unescape(F.when(coded, raw))).otherwise(raw)
    return F.nullif(F.trim(F.regexp_replace(said, r"(?U)\s+", " ")), F.lit(""))


def page_title(extras: Column) -> Column:
    found = F.regexp_extract(extras, r"<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    return clean_title(F.when(extras.rlike(r"<PAGE_TITLE>(.*?)</PAGE_TITLE>"), found))


def source_language_code(info: Column) -> Column:
    return F.nullif(F.regexp_extract(info, r"(?i)srclc:([^; ]+)", 1), F.lit(""))


def language_name(info: Column) -> Column:
    """A language's name; no translation info means English, unknown codes stay codes."""
    code = F.lower(F.nullif(F.regexp_extract(info, r"srclc:([a-zA-Z]+)", 1), F.lit("")))
    return F.when(code.isNull(), F.lit("English")).otherwise(lookup(LANGUAGE_NAMES, code, code))


def document_language(translated: Column, code: Column) -> Column:
    return F.when(translated, code).otherwise(F.lit("eng"))


def split_list(value: Column) -> Column:
    """A ``;`` list: trimmed, without empties, first occurrences in order."""
    items = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def parse_locations(value: Column) -> Column:
    """Locations of a ``;`` list of ``#`` fields; the first of equal type, name and codes
    counts even if its numbers can't be read, and items that can't be read go."""
    items = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.split(x, "#")), lambda f: F.size(f) >= 7)
    key = lambda f: F.slice(f, 1, 4)

    def first_of_each(all_items: Column) -> Column:
        return let(F.transform(all_items, key), lambda keys: F.filter(all_items, lambda f, i: F.array_position(keys, key(f)) == i + 1))

    firsts = let(items, first_of_each)

    def parsed(f: Column) -> Column:
        at = lambda i: F.element_at(f, i)
        return F.struct(
            at(1).try_cast("bigint").alias("geo_type"),
            at(2).alias("name"),
            F.nullif(at(3), F.lit("")).alias("country_code"),
            F.nullif(at(4), F.lit("")).alias("adm1_code"),
            at(6).try_cast("double").alias("lat"),
            at(7).try_cast("double").alias("lon"),
            (((at(6) != "") & at(6).try_cast("double").isNull()) | ((at(7) != "") & at(7).try_cast("double").isNull())).alias("bad"),
        )

    good = F.filter(F.transform(firsts, parsed), lambda s: s["geo_type"].isNotNull() & ~s["bad"])
    return F.transform(good, lambda s: s.dropFields("bad")).cast(LOCATION)


def tone_part(value: Column, position: int, kind: str = "double") -> Column:
    return F.get(F.split(value, ","), F.lit(position)).try_cast(kind)


def normalised_title(title: Column) -> Column:
    """Lower case, without an outlet's name at the end, letters and digits only."""
    bare = F.regexp_replace(F.lower(title), r"(?U)\s+[-|–—:]\s+[^-|–—:]{1,60}$", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def wire_key(title: Column, has_gkg: Column, persons: Column, organizations: Column, themes: Column, url: Column) -> Column:
    """What copies of one report share: title, else entities, else nothing but the page itself."""
    said = normalised_title(title)
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), "|")
    some = has_gkg & ((F.coalesce(F.size(persons), F.lit(0)) + F.coalesce(F.size(organizations), F.lit(0))) > 0)
    return (
        F.when(title.isNotNull() & (F.length(said) >= 15), F.concat(F.lit("t:"), said))
        .when(some, F.concat(F.lit("e:"), joined(persons), F.lit("##"), joined(organizations), F.lit("##"), joined(themes)))
        .otherwise(F.concat(F.lit("u:"), url))
    )


def token_match(text: Column, token: str) -> Column:
    """A token of an alphabet with spaces between words: a whole word; any other: part of the text."""
    if re.fullmatch(r"[\w'-]+", token) and re.search("[a-z\u0400-\u04ff]", token):
        return text.rlike(rf"(?U)(^|\W)\Q{token}\E(\W|$)")
    return F.contains(text, F.lit(token))


def root_label(code: Column) -> Column:
    return lookup(EVENT_ROOT_CODES, code, F.lit("Unknown"))
