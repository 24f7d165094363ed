"""Text functions: XML escapes, entities, title keys, episode numbers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The five characters that XML escapes, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_xml(text: Column) -> Column:
    for char, entity in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape(text: str) -> str:
    for char, entity in ESCAPES:
        text = text.replace(char, entity)
    return text


_ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode(text: str) -> str:
    """One pass over the five names and numeric references; what isn't valid stays as it is."""
    if "&" not in text:
        return text
    if "&#" not in text:  # what the names stand for makes no new name, so the ampersand comes last
        for char, entity in reversed(ESCAPES):
            text = text.replace(entity, char)
        return text

    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        digits = (m[1] or m[2]).lstrip("0")
        code = int(digits or "0", 10 if m[1] else 16) if len(digits) < 8 else 0
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _ENTITY.sub(one, text)


@F.pandas_udf(T.StringType())
def _decode_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else decode(t))


def decode_entities(text: Column) -> Column:
    """Texts without an ampersand pass unchanged; Python sees nulls in their place, for it is called on every row."""
    needed = F.contains(text, F.lit("&"))
    return F.when(needed, _decode_udf(F.when(needed, text))).otherwise(text)


_SPACE = re.compile(r"[\t-\r \xa0  -     　﻿]+")


def title_key(text: str) -> str:
    """Case, accents and the amount of white space don't count."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
    return _SPACE.sub(" ", bare.lower()).strip(" ")


@F.pandas_udf(T.StringType())
def _title_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else title_key(t))


_PLAIN = r"\A[\t-\r -~]*\z"


def normal_title(text: Column) -> Column:
    """ASCII titles are folded by built-in functions; only others go through Unicode normalisation in Python."""
    folded = lambda t: F.lower(F.trim(F.regexp_replace(t, r"[\t\n\x0b\f\r ]+", " ")))
    plain = text.rlike(_PLAIN)
    return F.when(plain, folded(text)).otherwise(_title_udf(F.when(~plain, text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _titles_udf(titles: pd.Series) -> pd.Series:
    return titles.map(lambda x: [None if t is None else title_key(t) for t in x] if x is not None else None)


def normal_titles(titles: Column) -> Column:
    """``normal_title`` of each element; an array goes to Python only if one of its titles has to."""
    folded = lambda t: F.lower(F.trim(F.regexp_replace(t, r"[\t\n\x0b\f\r ]+", " ")))
    plain = F.coalesce(F.forall(titles, lambda t: F.coalesce(t.rlike(_PLAIN), F.lit(True))), F.lit(True))
    return F.when(plain, F.transform(titles, folded)).otherwise(_titles_udf(F.when(~plain, titles)))


def titles_match(a: Column, b: Column) -> Column:
    """Whether two arrays of title keys share one; empty arrays never do."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def _part(value: Column | None) -> Column:
    return F.lit(None).cast("int") if value is None else value


def xmltv_ns(season: Column | None, episode: Column | None, part: Column | None = None, parts: Column | None = None) -> Column:
    """1-based numbers as the 0-based ``season.episode.part/parts``."""
    dash = lambda c: F.coalesce((_part(c) - 1).cast("string"), F.lit(""))
    own = F.when(_part(part).isNull(), F.lit("0/1")).otherwise(F.concat(dash(part), F.coalesce(F.concat(F.lit("/"), _part(parts).cast("string")), F.lit(""))))
    return F.concat(dash(season), F.lit("."), dash(episode), F.lit("."), own)


def _two(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def onscreen(season: Column, episode: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("S"), _two(season)), F.lit("")), F.coalesce(F.concat(F.lit("E"), _two(episode)), F.lit("")))


def yes_no(text: Column) -> Column:
    return F.when(text == "yes", True).when(text == "no", False)
