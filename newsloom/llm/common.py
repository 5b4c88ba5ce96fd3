"""Helpers shared by the corpus operators: words, and what they take from the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.core import let
from newsloom.plans.cutpoint import materialize, release

__all__ = ["NOT_SPACE", "SPACE", "let", "materialize", "n_words", "release", "words"]

#: ASCII white space, the only characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text, in order: runs of anything but ASCII white space. Null: no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words as long."""
    return F.size(words(text)).cast("long")
