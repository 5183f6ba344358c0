"""Sessions as folds over an event log: states by allowed transitions, timing roll-ups, resumable items."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ASKED = {"submit": "proposed", "reject": "insufficient"}
_CHOSEN = _ASKED | {"choose": "confirmed"}
# States of a session and the steps that lead on from each. A submission whose text says too little is
# `reject`; a question that is chosen is confirmed at once; an answer looks up its material first where there is none.
TRANSITIONS = {
    "new": _ASKED,
    "insufficient": _ASKED,
    "proposed": _CHOSEN | {"confirm": "confirmed", "edit": "confirmed"},
    "confirmed": _CHOSEN | {"confirm": "confirmed", "edit": "confirmed", "retrieve": "retrieved", "compose": "answered", "answer": "answered"},
    "retrieved": _CHOSEN | {"edit": "confirmed", "retrieve": "retrieved", "compose": "answered", "answer": "answered"},
    "answered": _CHOSEN | {"edit": "confirmed", "retrieve": "retrieved", "compose": "answered", "answer": "answered", "reflect": "reflected"},
    "reflected": _CHOSEN | {"edit": "confirmed", "reflect": "reflected"},
}


def folded(steps: Column, transitions: Mapping[str, Mapping[str, str]] = TRANSITIONS, start: str = "new") -> Column:
    """struct<state, refused> after an array of steps in order; a step that isn't allowed is refused."""
    table = F.create_map(*[F.lit(x) for s, steps_ in transitions.items() for k, t in steps_.items() for x in (f"{s}|{k}", t)])
    first = F.struct(F.lit(start).alias("state"), F.lit(0).alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        to = F.element_at(table, F.concat_ws("|", acc["state"], e))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["refused"] + to.isNull().cast("int")).alias("refused"))

    return F.aggregate(steps, first, step)


def session_states(events: DataFrame, key: str, order: list[str], step: Column) -> DataFrame:
    """(key, n_events, state, refused). A session's steps are one ordered array, as long as one person's log."""
    rows = events.select(key, F.struct(*order, step.alias("step")).alias("e"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("log"))
    out = lists.withColumn("f", folded(F.transform("log", lambda e: e["step"])))
    return out.select(key, F.size("log").alias("n_events"), "f.state", "f.refused")


def timings(events: DataFrame, key: str, stage: str, ts: str, order: str) -> DataFrame:
    """(key, stage, calls, seconds): time from each event to the next one of its session, by stage."""
    w = Window.partitionBy(key).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = F.lead(at).over(w) - at
    spent = events.select(key, stage, F.coalesce(gap, F.lit(0)).alias("us"))
    return spent.groupBy(key, stage).agg(F.count("*").alias("calls"), F.round(F.sum("us") / 1e6, 3).alias("seconds"))


def usage(payload: str, fields: list[str]) -> list[Column]:
    """Numbers of a JSON payload, null where it has none."""
    return [F.get_json_object(payload, f"$.{f}").cast("long").alias(f) for f in fields]


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that a resumed run still has to do."""
    return items.join(done.select(key), key, "left_anti")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each question with the answer that follows it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return out.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
