"""Spans of turns in token coordinates: aligned to the runs of a mask, moved after a removal, cut to what was kept, and proved equal again.

All of it is array algebra within the row of a session. Each step gives ``fault``, the first reason why the spans can't be told, or null, and ``spans``,
which are empty where there is a fault.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contracts import first_reason

#: Kinds of a turn, and the coordinates in which spans are given.
CALL, FINAL, SPACE = "tool_call", "assistant_termination", "unpadded_response_v1"


def runs(mask: Column) -> Column:
    """Array of (start, end) of the runs of ones in an array of zeros and ones."""
    places = F.when(F.size(mask) > 0, F.sequence(F.lit(0), F.size(mask) - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.coalesce(F.get(mask, i), F.lit(0)) == 1
    starts, ends = F.filter(places, lambda i: one(i) & ~one(i - 1)), F.filter(places, lambda i: one(i) & ~one(i + 1))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(x["s"].alias("start"), (x["e"] + 1).alias("end")))


def _result(fault: Column, spans: Column) -> Column:
    return F.struct(fault.alias("fault"), F.when(fault.isNull(), spans).otherwise(F.slice(spans, 1, 0)).alias("spans"))


def materialised(turns: Column, mask: Column, mask_runs: Column) -> Column:
    """(fault, spans) of turns (turn_id, kind, generated_token_count, credit_eligible), in order, by the ``runs`` of a response's mask.

    Each turn has a run of its own, as long as what it generated, and the zeros after it as its observation. Only the last turn, if it ends the
    session, may be cut short or be missing altogether.
    """
    n, kept = F.size(turns), F.least(F.size(turns), F.size(mask_runs))
    last = F.get(turns, n - 1)
    numbered = F.transform(F.slice(turns, 1, kept), lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.get(mask_runs, i).alias("run"), F.coalesce(F.get(mask_runs, i + 1)["start"], F.size(mask)).alias("until")))
    length = lambda x: x["run"]["end"] - x["run"]["start"]
    short = lambda x: x["t"]["generated_token_count"] > length(x)
    ends = lambda x: x["t"]["kind"] == FINAL
    mismatch = F.exists(numbered, lambda x: (x["t"]["generated_token_count"] != length(x)) & ~(short(x) & (x["i"] + 1 == n) & ends(x)))
    ids = F.transform(turns, lambda t: t["turn_id"])
    fault = first_reason(
        mask_begins_without_a_turn=(F.size(mask) > 0) & (F.get(mask, F.lit(0)) != 1),
        mask_is_not_binary=F.exists(mask, lambda m: m.isNull() | ~m.isin(0, 1)),
        turns_and_runs_differ=~(n - F.size(mask_runs)).isin(0, 1),
        only_a_final_turn_may_be_missing=(n == F.size(mask_runs) + 1) & ~F.coalesce(last["kind"] == FINAL, F.lit(False)),
        repeated_turn=F.size(F.array_distinct(ids)) < n,
        unknown_kind=F.exists(turns, lambda t: t["kind"].isNull() | ~t["kind"].isin(CALL, FINAL)),
        turn_after_the_final_one=F.exists(F.slice(turns, 1, F.greatest(n - 1, F.lit(0))), lambda t: t["kind"] == FINAL),
        token_count_mismatch=mismatch,
        final_turn_with_observation=F.exists(numbered, lambda x: ends(x) & (x["until"] != x["run"]["end"])),
        observation_missing=F.exists(numbered, lambda x: (x["t"]["kind"] == CALL) & (x["until"] == x["run"]["end"]) & F.coalesce(x["t"]["credit_eligible"], F.lit(False))),
    )
    spans = F.transform(
        numbered,
        lambda x: F.struct(
            x["t"]["turn_id"].alias("turn_id"),
            x["t"]["kind"].alias("kind"),
            F.lit(SPACE).alias("coordinate_space"),
            x["run"]["start"].alias("start"),
            x["run"]["end"].alias("end"),
            x["until"].alias("observation_end"),
            short(x).alias("truncated"),
            F.when(short(x), False).otherwise(x["t"]["credit_eligible"]).alias("credit_eligible"),
        ),
    )
    return _result(fault, spans)


def _moved(spans: Column, change) -> Column:
    """``spans`` with new values for some fields."""
    names = ("turn_id", "kind", "coordinate_space", "start", "end", "observation_end", "truncated", "credit_eligible")
    return F.transform(spans, lambda s: F.struct(*(change(s).get(f, s[f]).alias(f) for f in names)))


def rebased(spans: Column, removed: Column) -> Column:
    """(fault, spans) after the first ``removed`` tokens have gone; spans within them go, too, and none may be cut in two."""
    fault = first_reason(
        negative_removal=removed < 0,
        invalid_span=F.exists(spans, lambda s: (s["start"] < 0) | (s["start"] >= s["end"])),
        span_cut_in_two=F.exists(spans, lambda s: (s["start"] < removed) & (s["end"] > removed)),
    )
    left = F.filter(spans, lambda s: s["end"] > removed)
    return _result(fault, _moved(left, lambda s: {f: s[f] - removed for f in ("start", "end", "observation_end")}))


def finalised(spans: Column, mask: Column, mask_runs: Column) -> Column:
    """(fault, spans) within what was kept of a response. The spans have to be the ``runs`` of its mask, no more and no fewer."""
    n = F.size(mask)
    inside = _moved(F.filter(spans, lambda s: s["start"] < n), lambda s: {"end": F.least(s["end"], n), "observation_end": F.least(s["observation_end"], n), "truncated": s["truncated"] | (s["end"] > n)})
    both = F.transform(inside, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    ids = F.transform(spans, lambda s: s["turn_id"])
    fault = first_reason(
        repeated_turn=F.size(F.array_distinct(ids)) < F.size(ids),
        invalid_span=F.exists(spans, lambda s: (s["start"] < 0) | (s["start"] >= s["end"])),
        spans_are_not_the_runs=both != mask_runs,
    )
    return _result(fault, inside)


def removable(spans: Column, most: Column) -> Column:
    """The most tokens, up to ``most``, that can go from the front in whole groups of a turn and its observation; zero if not one can."""
    return F.coalesce(F.array_max(F.filter(F.transform(spans, lambda s: s["observation_end"]), lambda e: e <= most)), F.lit(0))
