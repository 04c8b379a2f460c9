"""Scalar functions on strings, as Column expressions. A null gives a null unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

NON_ASCII = r"[^\x00-\x7F]"


def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


nfc_udf = F.pandas_udf(_nfc, T.StringType())


def nfc(c: Column) -> Column:
    """Unicode NFC. Only values with non-ASCII characters go to Python."""
    return F.coalesce(nfc_udf(F.when(c.rlike(NON_ASCII), c)), c)


def null_if(c: Column, markers: Iterable[str], key: Column | None = None) -> Column:
    """c, or null where key (c itself by default) is one of the markers."""
    return F.when(~(c if key is None else key).isin(list(markers)), c)


def load_missing(c: Column) -> Column:
    """Load markers and blank strings become null; whole cell, case matters, nothing is trimmed."""
    return F.when(~(c.isin(list(K.LOAD_MARKERS)) | c.rlike(r"^\s*$")), c)


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def clean_string(c: Column) -> Column:
    """Tags to spaces, invisible characters gone, NFC, white space collapsed and trimmed, null words to null."""
    c = F.regexp_replace(strip_html(c), "[​-‏﻿‪-‮]", "")
    return null_if(x := F.trim(F.regexp_replace(nfc(c), r"(?U)\s+", " ")), K.CLEAN_MARKERS, x)


def title_case(c: Column) -> Column:
    """Each run of letters capitalised; unlike initcap, digits, apostrophes and hyphens end a run."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))), "")


def upper_strip(c: Column) -> Column:
    return F.upper(F.trim(c))


def standard_case(c: Column, acronyms: Iterable[str] = K.CASE_ACRONYMS) -> Column:
    """Title case with acronyms in upper case; blank is null."""
    t = F.trim(c)
    return F.when(F.upper(t).isin(list(acronyms)), F.upper(t)).when(t != "", title_case(t))


def normalize_email(c: Column, compat: bool = False) -> Column:
    """First thing in the text that looks like an address, in lower case, with ` at ` and `.at.` read as @.

    compat: ` at ` loses the letter after it, as a character class that was meant as a group has it.
    """
    v = F.lower(F.trim(c))
    v = F.regexp_replace(v, r"\.at\.| [at ]|\s+at\s+", "@") if compat else F.regexp_replace(v, r"\s+at\s+|\.at\.", "@")
    return F.nullif(F.regexp_extract(F.regexp_replace(v, r"\s+", ""), K.EMAIL_INSIDE, 0), F.lit(""))


def _national(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def normalize_phone(c: Column) -> Column:
    """Digits without country code 91 or 1; null unless there are 7 to 15 that are not all the same."""
    d = _national(c)
    return F.when(F.length(d).between(7, 15) & (F.replace(d, F.left(d, F.lit(1)), F.lit("")) != ""), d)


def dedup_phone(c: Column) -> Column:
    """Digits without country code; empty if there are fewer than 7."""
    d = _national(F.coalesce(c, F.lit("")))
    return F.when(F.length(d) >= 7, d).otherwise("")


def dedup_key(c: Column) -> Column:
    """Lower case and trimmed; empty for null and for words that mean nothing."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isNull() | v.isin(list(K.DEDUP_MARKERS)), "").otherwise(v)


def is_valid(c: Column) -> Column:
    return dedup_key(c) != ""


def profile_key(c: Column) -> Column:
    """How values are compared when exact duplicates are counted: lower case, trimmed, null words null."""
    v = F.lower(F.trim(c.cast("string")))
    return null_if(v, K.PROFILE_MARKERS)


def impute_missing(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c.cast("string"))).isin(list(K.IMPUTE_MARKERS)), c)


def has_non_ascii(c: Column) -> Column:
    return c.rlike(NON_ASCII)


def script_of(c: Column) -> Column:
    """Script of the first character that is in one of SCRIPTS, else Latin."""
    ranges = "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for _, a, b in K.SCRIPTS)
    # code point of the character: unicode big-endian, without surrogates as all ranges lie below them
    first = F.regexp_extract(F.coalesce(c, F.lit("")), f"[{ranges}]", 0)
    point = F.conv(F.hex(F.encode(first, "UTF-16BE")), 16, 10).cast("int")
    out = F.when(first == "", "Latin")
    for name, a, b in K.SCRIPTS:
        out = out.when(point.between(a, b), name)
    return out


def fix_boolean(c: Column) -> Column:
    """yes/y/true/1/t/on and no/n/false/0/f/off; null for anything else."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("yes", "y", "true", "1", "t", "on"), True).when(v.isin("no", "n", "false", "0", "f", "off"), False)
