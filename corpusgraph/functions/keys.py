"""Identity keys that need Unicode normalisation, which has no built-in form: Arrow batches, one call for each distinct need."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

from . import text as T

_SPACE = re.compile(r"\s+")
# Section numbers in front of a heading.
_NUMBER = re.compile(r"^(?:第[一二三四五六七八九十百千\d]+[章节篇]|[一二三四五六七八九十]+[、．.]|[（(][一二三四五六七八九十\d]+[)）]|\d+(?:[.．]\d+)*[、．.]?(?=\D))\s*")


@F.pandas_udf(t.StringType())
def compact(s: pd.Series) -> pd.Series:
    """Compatibility form, no white space, case folded; null is empty."""
    return s.fillna("").map(lambda x: _SPACE.sub("", unicodedata.normalize("NFKC", x)).casefold())


@F.pandas_udf(t.StringType())
def label(s: pd.Series) -> pd.Series:
    """A heading in compatibility form without its number."""
    return s.fillna("").map(lambda x: _NUMBER.sub("", _SPACE.sub(" ", unicodedata.normalize("NFKC", x)).strip()).strip())


@F.pandas_udf(t.StringType())
def topic_key(s: pd.Series) -> pd.Series:
    """A ranking key of a title: no number, no gloss in brackets, compact."""

    def one(x: str) -> str:
        x = _NUMBER.sub("", unicodedata.normalize("NFKC", x).strip())
        return _SPACE.sub("", re.sub(r"\([^)]*\)", "", x)).casefold()

    return s.fillna("").map(one)


def heading_key(path: Column, content: Column) -> Column:
    """A stable key of where a passage stands: its deepest heading, else its first sentence."""
    deepest = F.coalesce(F.get(F.reverse(F.filter(path, lambda p: T.text(p) != "")), 0), F.lit(""))
    shown = F.when(deepest != "", label(deepest)).otherwise(T.excerpt(content, 80))
    return F.substring(F.sha2(F.to_json(F.struct(shown.alias("heading"))), 256), 1, 24)
