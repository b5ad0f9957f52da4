"""Text expressions. All run inside the JVM except NFKC, which Spark has no function for."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace of the Unicode standard plus the four ASCII separators, as a regex class body.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
#: Finds the first character of a normalised text.
SOMETHING = f"[^{WS}]"
CJK = r"\x{4e00}-\x{9fff}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Collapse every whitespace run to one space and strip the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{WS}]+", " "))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose case folding is not their lower case, found from the Unicode tables."""
    single, target, multi = [], [], {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if len(char.lower()) > 1:
            continue
        folded = char.lower().casefold()
        if folded == char.lower() or char.lower() != char:
            continue
        if len(folded) == 1:
            single.append(char)
            target.append(folded)
        else:
            multi[char] = folded
    return "".join(single), "".join(target), multi


def casefold(c: Column | str) -> Column:
    """Unicode case folding: lower case, then the characters where the two differ."""
    source, target, multi = _fold_tables()
    lower = F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))
    rare = F.translate(lower, source, target)
    for char, text in multi.items():
        rare = F.replace(rare, F.lit(char), F.lit(text))
    # Looking each character up takes longer than all else, and texts of Latin-1 letters have none of these.
    first, *rest = sorted({*source, *multi} - {"ß"})
    return F.when(lower.rlike(f"[{first}{rest[0]}-{rest[-1]}]"), rare).otherwise(lower)


def grams(c: Column, n: int) -> Column:
    """All overlapping runs of `n` characters, in order, found in one pass."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def comparison_text(c: Column | str) -> Column:
    """Folded text with everything but letters, digits, underscore and whitespace removed."""
    return F.regexp_replace(casefold(c), rf"[^\p{{L}}\p{{N}}_{WS}]", "")


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str]:
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isascii():
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def tokens(c: Column | str) -> Column:
    """Index tokens: CJK characters one by one; otherwise letter and digit runs, no case, no accents."""
    spaced = F.regexp_replace(F.lower(col(c)), f"([{CJK}])", " $1 ")
    plain = F.translate(F.regexp_replace(spaced, r"[\x{300}-\x{331}]", ""), *_accent_tables())
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def topic_key(c: Column | str) -> Column:
    """ASCII snake case; empty when nothing comparable is left."""
    ascii_only = F.regexp_replace(col(c), r"[^\x00-\x7F]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", ""))


@F.pandas_udf(T.StringType())
def nfkc_compact(values: pd.Series) -> pd.Series:
    """NFKC form with all whitespace removed."""
    return values.map(lambda v: None if v is None else "".join(unicodedata.normalize("NFKC", v).split()))


def sha(c: Column | str, length: int = 64) -> Column:
    return F.substring(F.sha2(col(c).cast("string").cast("binary"), 256), 1, length)


def sha_int(c: Column | str) -> Column:
    """60 bits of a digest as a BIGINT, for order-free sums and exclusive-or."""
    return F.conv(F.substring(F.sha2(col(c).cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("bigint")
