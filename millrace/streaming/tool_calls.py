"""Tool calls as a stream: the calls of a message as state, with event-time timeouts that let go of calls nobody ends."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import events as E

#: How long a call may stay open or be ended again by its run; and how late events may come.
EXPIRY, LATE = 30 * 24 * 3600 * 1000, "10 minutes"
#: A row of the result without its message.
ROW = "position long, version long, id string, name string, event string, text string, expired boolean"


def folded(calls: list[list], n: int, rows: Iterable[tuple]) -> tuple[int, list[tuple]]:
    """Takes (seq, event, name, run_id, text, ms) in their order into the calls of a message, which has had n; how many it
    has had then, and a row (position, version, id, name, event, text) for the call of every start and end. A run and the
    open calls of a tool are looked up, so that a message of many calls takes time in proportion."""
    runs, opened, out = {}, {}, []

    def known(call: list) -> None:
        if call[2] is not None:
            runs.setdefault(call[2], call)
        if not call[5] and call[3] is not None:
            opened.setdefault(call[3], []).append(call)

    for call in calls:
        known(call)
    for seq, event, name, run_id, text, ms in rows:
        if event == "on_tool_start":
            calls.append([seq, n, run_id, name, ms, False])
            known(calls[-1])
            out.append((n, seq, run_id, name, event, None))
            n += 1
            continue
        # the first call of its run, else the latest open one of its tool
        call = runs.get(run_id) if run_id is not None else None
        if call is None:
            stack = opened.get(name, [])
            while stack and stack[-1][5]:
                stack.pop()
            call = stack[-1] if stack else None
        if call is not None:
            call[5] = True
            out.append((call[1], seq, call[2], call[3], event, text))
    return n, out


def _taken(expiry: int):
    """State of a message: how many calls it has had, and those that are open or may be ended again by their run, in the
    order of their starts. Every start and end gives a row for its call, the end's seq as its version; so does the timeout
    for a call that is still open when it expires. Events, calls and rows are JSON: a group costs Python by its columns."""

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, calls = state.get if state.exists else (0, "[]")
        calls, made = json.loads(calls), []
        if not state.hasTimedOut:
            rows = sorted((json.loads(x) for f in frames for x in f["e"]), key=lambda r: r["seq"])
            n, made = folded(calls, n, (tuple(map(r.get, ("seq", "event", "name", "run_id", "text", "ms"))) for r in rows))
        out, now = [(*r, False) for r in made], state.getCurrentWatermarkMs()
        out += [(c[1], c[0], c[2], c[3], "on_tool_start", None, True) for c in calls if c[4] + expiry <= now and not c[5]]
        # an ended call without a run can't be ended again
        kept = [c for c in calls if c[4] + expiry > now and (not c[5] or c[2] is not None)]
        state.update((n, json.dumps(kept)))
        if kept:
            state.setTimeoutTimestamp(min(c[4] for c in kept) + expiry)
        names = [c.split(" ")[0] for c in ROW.split(", ")]
        yield pd.DataFrame({"message_id": [key[0]], "rows": [json.dumps([dict(zip(names, r, strict=True)) for r in out])]})

    return take


def stream_tool_calls(events: DataFrame, expiry: int = EXPIRY, late: str = LATE) -> DataFrame:
    """message_id and the columns of ROW for every start and end of a call. events: message_id, seq, event, name, run_id,
    text and ts (the event time). A micro-batch's events of one message are taken in the order of seq."""
    kinds = ("on_tool_start", "on_tool_end", "on_tool_error")
    event = F.to_json(F.struct("seq", "event", "name", "run_id", "text", F.unix_millis("ts").alias("ms")))
    rows = events.withWatermark("ts", late).where(F.col("event").isin(*kinds)).select("message_id", "ts", event.alias("e"))
    made = rows.groupBy("message_id").applyInPandasWithState(_taken(expiry), "message_id long, rows string", "n long, calls string", "append", GroupStateTimeout.EventTimeTimeout)
    kind = "array<struct<" + ROW.replace(" ", ":").replace(",:", ",") + ">>"
    return made.select("message_id", F.inline(F.from_json("rows", kind, {"maxStringLen": str(2**31 - 1)})))


def last_calls(versions: DataFrame) -> DataFrame:
    """The calls that rows of stream_tool_calls add up to, as `events.tool_calls` gives them."""
    rows = versions.groupBy("message_id", "position").agg(F.max_by(F.struct("id", "name", "event", "text"), "version").alias("r")).select("message_id", "position", "r.*")
    failed, ended = F.col("event") == "on_tool_error", F.col("event") != "on_tool_start"
    state = F.when(~ended, "open").when(failed, "error").otherwise("done")
    return rows.select(
        "message_id", F.col("position").cast("int").alias("position"), "id", "name", state.alias("state"),
        F.when(ended & ~failed, E.tool_output(F.col("text"))).alias("output"), F.when(failed, F.coalesce("text", F.lit("Tool error"))).alias("error"),
    )
