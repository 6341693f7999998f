"""Where a request says something: exact places of a text, and prices with what they bound. Offsets are code points, ends exclusive."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pieces that a stated price is made of.
NUMBER = r"(\d+(?:\.\d+)?)\s*(万|千|[kK])?"
SHORTHAND = r"(\d+(?:\.\d+)?)\s*万\s*(\d+(?:\.\d+)?)\s*(千)?"
TOPIC, CONTROL = r"(?:预算|价格)?", r"(?:控制)?在?"
NEED = r"(?:控制在?|要|得|需|需要)?"
AT_MOST = r"(?:不超过|不要超过|别超|不能超过|不得超过|不可超过|不高于|最高|至多|封顶(?:在)?)"
AT_LEAST = r"(?:不低于|至少|最低|不少于|高于|超过)"
UNDER, OVER, AROUND, TO = r"(?:以内|以下|之内)", r"(?:以上|起)", r"(?:左右|上下)", r"(?:-|~|～|至|到)"

#: Fixed values: (form, operator) in the order in which they claim their places.
FORMS = (
    (rf"{TOPIC}\s*{NEED}\s*{AT_MOST}\s*{SHORTHAND}\s*元?", "lte"),
    (rf"{SHORTHAND}\s*元?\s*{UNDER}", "lte"),
    (rf"{TOPIC}{CONTROL}\s*{NUMBER}\s*元?\s*{TO}\s*{NUMBER}\s*元?(?:之间)?", "between"),
    (rf"{TOPIC}\s*{NEED}\s*{AT_MOST}\s*{NUMBER}\s*元?", "lte"),
    (rf"{NUMBER}\s*元?\s*{UNDER}", "lte"),
    (rf"{TOPIC}\s*{AT_LEAST}\s*{NUMBER}\s*元?", "gte"),
    (rf"{NUMBER}\s*元?\s*{OVER}", "gte"),
    (rf"{NUMBER}\s*元?\s*\+", "gte"),
    (rf"{TOPIC}{CONTROL}\s*{NUMBER}\s*元?\s*{AROUND}", "approximately"),
)
FACTORS = {"万": 10_000.0, "千": 1_000.0, "k": 1_000.0}


def exact_spans(text: Column, value: Column) -> Column:
    """(start, end) of every place of ``value`` in ``text``, case aside, left to right without overlaps; none for an empty value."""
    parts = F.split(text, F.concat(F.lit(r"(?iu)\Q"), value, F.lit(r"\E")), -1)
    size = F.length(value)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, 1, k), (k - 1) * size, lambda a, p: a + F.length(p)))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).alias("end")))
    return F.when(text.isNotNull() & (F.coalesce(size, F.lit(0)) > 0) & (F.size(parts) > 1), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _worth(found: re.Match, operator: str, shorthand: bool) -> tuple[float, float] | None:
    """(lower, upper) of a match; None if it is no price."""

    def scaled(k: int) -> float:
        return float(found[k]) * FACTORS.get((found[k + 1] or "").lower(), 1.0)

    if shorthand:
        rest = float(found[2])
        worth = float(found[1]) * FACTORS["万"] + rest * (FACTORS["千"] if found[3] or rest < 10 else 1.0)
        return (worth, worth) if worth > 0 else None
    if operator == "between":
        low, high = scaled(1), scaled(3)
        return (low, high) if 0 < low <= high else None
    return scaled(1), scaled(1)


def prices_of(text: str | None) -> list[dict]:
    """All prices of a text by their start. A form leaves out what overlaps an earlier form's place; ranges only claim theirs."""
    out: list[dict] = []
    for k, (pattern, operator) in enumerate(_COMPILED):
        for m in pattern.finditer(text or ""):
            if operator != "between" and any(m.start() < s["end"] and s["start"] < m.end() for s in out):
                continue
            worth = _worth(m, operator, k < 2)
            if worth is not None:
                out.append({"start": m.start(), "end": m.end(), "operator": operator, "low": worth[0], "high": worth[1]})
    return sorted(out, key=lambda s: s["start"])


_COMPILED = tuple((re.compile(p), o) for p, o in FORMS)


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("operator", T.StringType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    )
)


@F.pandas_udf(SPANS)
def price_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """(start, end, operator, low, high) of every price a text states: lte, gte, between or approximately. A null has none."""
    for batch in texts:
        yield batch.map(prices_of)
