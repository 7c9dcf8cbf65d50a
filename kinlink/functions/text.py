"""Text normalisation as Column functions; Python only where Spark has no Unicode tables."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scripts import folded, romanised, romanised_word  # noqa: F401

# Legal forms that the legal-name normaliser drops.
LEGAL_FORMS = (
    "pvt", "private", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "llc", "llp", "co", "company",
    "sarl", "sas", "sa", "sci", "eurl", "snc",
)
_LEGAL = r"(?i)\b(" + "|".join(LEGAL_FORMS) + r")\b"


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def drop_legal_forms(text: Column) -> Column:
    return F.regexp_replace(text, _LEGAL, " ")


def drop_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-z0-9\s]", " ")


def _unless_ascii(change, text: Column) -> Column:
    """ASCII texts as they are, others changed in Python; only those go there."""
    return F.when(is_ascii(text), text).otherwise(change(F.when(~is_ascii(text), text)))


@F.pandas_udf(StringType())
def _romanise(texts: pd.Series) -> pd.Series:
    return texts.map(romanised, na_action="ignore")


def romanise(text: Column) -> Column:
    """ASCII texts stay as they are; of others every word that is not ASCII is spelt in Latin letters, words joined by a blank."""
    return _unless_ascii(_romanise, text)


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(folded, na_action="ignore")


def fold(text: Column) -> Column:
    """Every character in ASCII by a table of code points; what has no entry there stays."""
    return _unless_ascii(_fold, text)


@F.pandas_udf(StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


def _script(text: str | None) -> str:
    if not (text or "").strip():
        return "EMPTY/UNKNOWN"
    found = Counter(unicodedata.name(c, "UNKNOWN").split()[0] for c in text if c.isalpha())
    return found.most_common(1)[0][0] if found else "NUMERIC/PUNCT_ONLY"


def script_ranges(end: int = 0x3100) -> list[tuple[int, int, str]]:
    """The letters below a code point as ranges (first, last, first word of their names): the rule as data, for other engines."""
    out: list[tuple[int, int, str]] = []
    for p in range(end):
        if chr(p).isalpha():
            name = unicodedata.name(chr(p), "UNKNOWN").split()[0]
            if out and out[-1][1:] == (p - 1, name):
                out[-1] = (out[-1][0], p, name)
            else:
                out.append((p, p, name))
    return out


@F.pandas_udf(StringType())
def dominant_script(texts: pd.Series) -> pd.Series:
    """First word of the Unicode name that most letters have; ties go to the one seen first."""
    return texts.map(_script)


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def joined(name: Column, address: Column) -> Column:
    """Name and address with one blank between, nulls as empty."""
    return F.concat_ws(" ", _filled(name), _filled(address))


def norm_library(name: Column, address: Column, romanised: bool = True) -> Column:
    text = joined(name, address)
    return romanise(text) if romanised else text


def norm_production(name: Column, address: Column) -> Column:
    return romanise(F.lower(joined(name, address)))


def norm_universal(name: Column, address: Column) -> Column:
    text = F.lower(romanise(joined(name, address)))
    return collapse(F.regexp_replace(text, r"['’`-]", " "))


def norm_legal(name: Column, address: Column, romanised: bool = False) -> Column:
    """By code points, or romanised by words; a letter that has no rule in a word is folded by itself."""
    text = strip(joined(name, address))
    text = F.lower(romanise(text) if romanised else fold(text))
    return collapse(drop_punctuation(drop_legal_forms(text)))


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(romanise(_filled(name))), F.lit(r"\b[a-z0-9]+\b"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Unicode words in lower case."""
    return F.regexp_extract_all(F.lower(_filled(text)), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def without_repeats(tokens: Column) -> Column:
    """Tokens of which none equals the one before it."""
    once = F.transform(F.array(tokens), lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1))))
    return once[0]
