"""Text normalisation and tokens."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def folded(text: Column) -> Column:
    """NFKC and case folding. For ASCII text lower() is the same: such rows go through Python as nulls."""
    return F.coalesce(_fold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


#: Blocks whose compatibility characters ``folded_characters`` knows: Latin-1, punctuation and spaces, super- and subscripts, letterlike symbols and
#: numerals, enclosed numbers and letters, CJK symbols and units, half and full widths.
_BLOCKS = ((0xA0, 0x180), (0x2000, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0x3000, 0x3400), (0xFF00, 0xFFF0))


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters of the blocks that NFKC and case folding turn into one other than lower() does, what they turn into, and those that turn into several."""
    single, into, several = [], [], {}
    for c in (chr(code) for low, high in _BLOCKS for code in range(low, high)):
        f = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())
        if len(f) > 1:
            several[c] = f
        elif f != c.lower():
            single.append(c)
            into.append(f)
    return "".join(single), "".join(into), several


def folded_characters(text: Column) -> Column:
    """NFKC and case folding character by character, in the JVM, so that it can be used within arrays.

    Beyond ``_BLOCKS`` it is lower(). Sequences that NFKC composes (a letter and a combining mark) are left apart; ``folded`` does all of it.
    """
    single, into, several = _foldings()
    # One literal, which the optimizer turns into a map once.
    spelled = F.str_to_map(F.lit("\1".join(f"{c}\2{f}" for c, f in several.items())), F.lit("\1"), F.lit("\2"))
    one = lambda t: F.lower(F.translate(t, single, into))
    # The map is looked through from its beginning, so only characters that can be in it are looked up.
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) == 1, F.lower(c)).otherwise(F.coalesce(F.try_element_at(spelled, c), one(c)))), "")
    # A class of hundreds of characters costs a regular expression a test of each at every place; ASCII is told by its length.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).when(F.char_length(F.translate(text, "".join(several), "")) < F.char_length(text), each).otherwise(one(text))


def collapsed(text: Column) -> Column:
    """White space, Unicode's included, collapsed to single spaces and stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(folded(text), r"(?U)\s+", "")


#: Spellings of the currency anywhere and after a number, punctuation that separates words, and the pattern of a word.
CURRENCY, CURRENCY_AFTER = "人民币|块钱", "rmb|cny|yuan"
PUNCTUATION = "[，,。；;：:！!？?、|]+"
WORD = r"[a-z0-9]+(?:[._+/-][a-z0-9]+)*"


def search_query(text: Column) -> Column:
    """A query's normal form: folded, amounts in 元, punctuation as spaces. A null is an empty query."""
    s = F.regexp_replace(F.coalesce(folded(text), F.lit("")), CURRENCY, "元")
    s = F.regexp_replace(s, rf"(?U)(?<=\d)\s*(?:{CURRENCY_AFTER})\b", "元")
    return collapsed(F.regexp_replace(s, PUNCTUATION, " "))


def with_currency(folded_text: Column) -> Column:
    """Folded text with amounts in 元: a query's normal form as far as its tokens depend on it. Most texts are only looked through."""
    s = folded_text
    for spelling in CURRENCY.split("|"):
        s = F.replace(s, F.lit(spelling), F.lit("元"))
    named = [folded_text.contains(x) for x in CURRENCY_AFTER.split("|")]
    return F.when(named[0] | named[1] | named[2], F.regexp_replace(s, rf"(?U)(?<=\d)\s*(?:{CURRENCY_AFTER})\b", "元")).otherwise(s)


def tokens(text: Column) -> Column:
    """Distinct tokens of normalised text: bigrams of runs of Han characters (single ones kept), then words and numbers."""
    han = F.regexp_extract_all(text, F.lit(r"([㐀-䶿一-鿿]+)"), 1)
    pairs = F.flatten(F.transform(han, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    return F.array_distinct(F.when(text.rlike("[㐀-䶿一-鿿]"), F.concat(pairs, words)).otherwise(words))


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, Unicode as it is; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical(s: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where it is none."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical_json(json.loads(x, parse_constant=lambda _: 1 / 0))
        except (ValueError, ZeroDivisionError):
            return None

    return s.map(one)


def seed63(text: Column) -> Column:
    """A seed of 63 bits: the first 16 digits of SHA-256, masked."""
    digest = F.conv(F.left(F.sha2(text, 256), F.lit(16)), 16, 10).cast("decimal(20,0)")
    return F.pmod(digest, F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")
