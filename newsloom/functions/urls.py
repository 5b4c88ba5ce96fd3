"""URL expressions. All are native columns, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.core import let, lookup
from newsloom.functions.fixed import GENERIC_TWO_LETTER, ISO2_TO_FIPS, STOPWORDS, TLD_COUNTRIES, TRACKING_PARAMS

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HOST = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#@]*)"


def url_domain(url: Column) -> Column:
    """The host in lower case without ``www.``; empty where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^\[|\]$", "")
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _quoted(part: Column) -> Column:
    """Decode and encode again a part of a query, as form data."""
    plain = F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """One spelling per page: lower scheme and host, no ``www.``, user, port, fragment or
    tracking parameters, query re-encoded, no slash at the end.

    Each part is cut out once and bound, as later ones name it several times.
    """

    def parts(clean: Column) -> Column:
        part = lambda i: F.regexp_extract(clean, _PARTS, i)
        return F.struct(F.lower(part(1)).alias("scheme"), url_domain(clean).alias("host"), part(3).alias("path"), _kept_query(part(4)).alias("query"))

    def rooted(p: Column) -> Column:
        bare = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], "/+$", "")).otherwise(p["path"])
        path = F.when(p["path"] == "", F.lit("/")).when((p["host"] != "") & (bare != "") & ~F.startswith(bare, F.lit("/")), F.concat(F.lit("/"), bare)).otherwise(bare)
        return let(path, lambda x: written(p, x))

    def written(p: Column, path: Column) -> Column:
        scheme = F.when(p["scheme"] == "", F.lit("http")).otherwise(p["scheme"])
        slashes = F.when((p["host"] != "") | F.startswith(path, F.lit("/")), F.lit("//")).otherwise(F.lit(""))
        return F.concat(scheme, F.lit(":"), slashes, p["host"], path, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")))

    return let(F.translate(F.trim(url), "\t\r\n", ""), lambda clean: let(parts(clean), rooted))


def _kept_query(query: Column) -> Column:
    def keeps(pair: Column) -> Column:
        return (pair != "") & let(F.lower(_decoded_name(pair)), lambda n: ~F.startswith(n, F.lit("utm_")) & ~n.isin(*TRACKING_PARAMS))

    def again(pair: Column) -> Column:
        value = F.when(F.contains(pair, F.lit("=")), F.substr(pair, F.locate("=", pair) + 1)).otherwise(F.lit(""))
        return F.concat(_quoted(F.substring_index(pair, "=", 1)), F.lit("="), _quoted(value))

    return F.array_join(F.transform(F.filter(F.split(query, "&"), keeps), again), "&")


def _decoded_name(pair: Column) -> Column:
    raw = F.substring_index(pair, "=", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def slug_path(url: Column) -> Column:
    """The path, percent-decoded and in lower case. ``+`` stays, as paths have no form encoding."""
    path = F.regexp_extract(url, _PARTS, 3)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def url_words(path: Column) -> Column:
    """The distinct topic words of a path, without date segments, stop words and long numbers."""
    undated = F.regexp_replace(path, r"(?<=/)(?:\d{1,2}|(?:19|20)\d{2})(?=/)", "")
    found = F.regexp_extract_all(F.lower(undated), F.lit(r"(?U)([^\W_]+)"), 1)
    return F.array_distinct(
        F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS) & ~(w.rlike(r"^\p{Nd}+$") & (F.length(w) >= 5)))
    )


def clean_token(word: Column) -> Column:
    """Whether a word is neither hexadecimal junk nor a number of other than three digits."""
    return ~(word.rlike(r"^(?=.*\d)(?=.*[a-f])[0-9a-f]+$")) & (~word.rlike(r"^\p{Nd}+$") | (F.length(word) == 3))


def derived_title(url: Column, domain: Column) -> Column:
    """A headline from the slug: the last path segment with three letters running, else the one before."""
    path = F.split_part(F.split_part(F.regexp_replace(url, r"^https?://[^/]+/?", ""), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    from_end = lambda k: F.coalesce(F.try_element_at(segments, F.lit(-k)), F.lit(""))
    letters = r"[A-Za-z]{3}"
    tail = F.when(from_end(1).rlike(letters), from_end(1)).when(from_end(2).rlike(letters), from_end(2)).otherwise(F.lit(""))
    words = F.trim(F.regexp_replace(F.regexp_replace(tail, r"\.(html?|shtml|phtml|php|aspx?|jsp|cms|amp)$", ""), r"[^A-Za-z0-9]+", " "))
    return F.when(F.length(words) < 3, F.concat(domain, F.lit(" article"))).otherwise(words)


def country_of_tld(domain: Column) -> Column:
    """A country's name by the domain's ending; empty where it tells none."""
    return lookup(TLD_COUNTRIES, F.regexp_extract(F.lower(domain), r"\.([a-z]{2})$", 1), F.lit(""))


def fips_of_tld(domain: Column) -> Column:
    """The FIPS code behind a national ending; null for generic ones."""
    tld = F.substring_index(domain, ".", -1)
    national = tld.rlike(r"^[a-z]{2}$") & ~tld.isin(*GENERIC_TWO_LETTER)
    return F.when(national, lookup(ISO2_TO_FIPS, F.upper(tld), F.upper(tld)))


def parent_domains(domain: Column) -> Column:
    """The domain and its parents, longest first, never a bare ending."""
    labels = F.split(domain, r"\.")
    parents = F.transform(
        F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.concat(F.array(domain), parents)
