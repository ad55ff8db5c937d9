"""Event streams folded into messages and tool calls.

A message's events are ordered by `seq`. Texts are joined by an expression over the message's parts. Tool calls are
folded by message and tool name, in order, by a pass that keeps nothing but the calls that are open; ends that name
their call by its run are paired by windows before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

ROLES = ("user", "assistant", "system")
#: The events that are dispatched.
KINDS = ("on_chat_model_stream", "on_llm_new_token", "on_chat_model_end", "on_llm_end", "on_tool_start", "on_tool_end", "on_tool_error", "error")


def convert_messages(messages: DataFrame) -> DataFrame:
    """Rows of the known roles, null content as empty text."""
    return messages.where(F.col("role").isin(*ROLES)).withColumn("content", F.coalesce("content", F.lit("")))


def _field(v: Column, key: str) -> Column:
    """A string field of a variant object, null if it is no string."""
    value = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def readable_text(chunk: Column) -> Column:
    """A chunk that looks like JSON gives its readable part: a text field of an object, or the joined items of a list;
    anything else stays as it is."""
    s = T.strip(chunk)
    looks = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
    v = F.try_parse_json(s)
    last = F.try_element_at(F.try_variant_get(v, "$.messages", "array<variant>"), F.lit(-1))
    from_object = F.coalesce(*[_field(v, k) for k in ("answer", "content", "message", "text")], _field(last, "content"), F.to_json(v))

    def item(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        fields = F.coalesce(*[F.nullif(_field(x, k), F.lit("")) for k in ("preview", "content", "answer", "title")], F.lit(""))
        return F.when(kind.startswith("OBJECT"), fields).when(kind == "VOID", "").otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))

    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), lambda x: x != "")
    return F.when(looks & v.isNotNull(), F.when(s.startswith("["), F.array_join(items, "\n")).otherwise(from_object)).otherwise(chunk)


def tool_arguments(data: Column) -> Column:
    """Joined string `args` of tool_call_chunks, else of invalid_tool_calls, of an event's JSON data."""
    return _arguments(F.try_parse_json(data))


def _arguments(v: Column) -> Column:
    args = lambda key: F.array_join(F.filter(F.transform(F.try_variant_get(v, f"$.{key}", "array<variant>"), lambda x: _field(x, "args")), lambda a: a.isNotNull()), "")
    return F.coalesce(F.nullif(args("tool_call_chunks"), F.lit("")), args("invalid_tool_calls"), F.lit(""))


def _shown(v: Column) -> Column:
    """A variant as text: a string as it is, anything else as JSON; null for null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v) != "VOID", F.to_json(v))


def as_text(value: Column) -> Column:
    """Display text of a JSON value: nothing for null, a list's strings and `text` fields in a row, else the value."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    part = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(_field(x, "text"), F.lit(""))).otherwise(F.coalesce(_shown(x), F.lit("null")))
    listed = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), "")
    return F.coalesce(F.when(kind.startswith("ARRAY"), listed).otherwise(_shown(v)), F.lit(""))


def parse_events(events: DataFrame) -> DataFrame:
    """kind, text, tool, id and error of (event, name, run_id, data) rows with JSON data: what a stream, token, end, tool or
    error event says. Unknown events, and events that say nothing, are left out."""
    v, event = F.try_parse_json("data"), F.col("event")
    at = lambda path: F.try_variant_get(v, path, "variant")
    string = lambda path: F.when(F.schema_of_variant(at(path)) == "STRING", F.try_variant_get(v, path, "string"))
    stream = F.coalesce(F.nullif(string("$.chunk.content"), F.lit("")), F.nullif(_arguments(at("$.chunk")), F.lit("")))
    tool, error = F.nullif(F.col("name"), F.lit("")), _shown(at("$.error"))
    text = (
        F.when(event == "on_chat_model_stream", stream)
        .when(event == "on_llm_new_token", string("$.token"))
        .when(event.isin("on_chat_model_end", "on_llm_end"), _shown(at("$.output.content")))
        .when(event == "on_tool_start", F.coalesce(_shown(at("$.input")), F.lit("{}")))
        .when(event == "on_tool_end", _shown(at("$.output")))
    )
    tools = event.isin("on_tool_start", "on_tool_end", "on_tool_error")
    says = F.when(tools, tool.isNotNull()).when(event == "error", F.coalesce(error != "", F.lit(False))).otherwise(text.isNotNull())
    made = events.where(event.isin(*KINDS)).withColumn("_says", says).where("_says")
    return made.select(
        event.alias("kind"), text.alias("text"), F.when(tools, tool).alias("tool"), F.when(tools, F.coalesce("run_id", F.lit(""))).alias("id"),
        F.when(event == "on_tool_error", F.coalesce(error, F.lit(""))).when(event == "error", error).alias("error"),
    )


def tool_output(data: Column) -> Column:
    """Tool output as text: strings as they are, an object's `content` or `output` if it is a string, else JSON."""
    v = F.try_parse_json(data)
    own = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(own, F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(_field(v, "content"), _field(v, "output"))), data)


def event_text(event: Column, text: Column) -> Column:
    """What an event adds to its message."""
    return F.when(event == "on_chat_model_stream", F.coalesce(readable_text(text), F.lit(""))).when(event == "error", F.concat(F.lit("\n[Error] "), F.coalesce(text, F.lit("")))).otherwise("")


def message_texts(events: DataFrame, key: str = "message_id") -> DataFrame:
    """key and the text that the events (key, seq, event, text) of each message add up to, in order."""
    parts = F.sort_array(F.collect_list(F.struct("seq", event_text(F.col("event"), F.col("text")).alias("t"))))
    return events.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("content"))


def joined_versions(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the whole content of rows (keys, version, content) that each hold what a version adds."""
    parts = F.sort_array(F.collect_list(F.struct("version", "content")))
    return deltas.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["content"]), "").alias("content"))


def last_versions(versions: DataFrame, keys: list[str], value: str = "content") -> DataFrame:
    return versions.groupBy(*keys).agg(F.max_by(value, "version").alias(value), F.max("version").alias("version"))


def _closings(ordered: DataFrame, key: str) -> DataFrame:
    """key, start and end (seq of both) of every event that closes a call, of rows (key, tool, seq, opens, target): an end
    closes its target, else the latest open call of its tool. Rows are dealt by key and tool and sorted; a pass over them
    remembers the open calls of one tool of one message."""
    kinds = {c: ordered.schema[c].dataType.simpleString() for c in (key, "seq")}

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, open_calls, order = None, set(), []
        for frame in frames:
            out = []
            for k, tool, seq, opens, target in zip(*(frame[c].tolist() for c in (key, "tool", "seq", "opens", "target"))):
                if (k, tool) != group:
                    group, open_calls, order = (k, tool), set(), []
                if opens:
                    open_calls.add(seq)
                    order.append(seq)
                    continue
                if pd.isna(target):
                    while order and order[-1] not in open_calls:
                        order.pop()
                    if not order or tool is None:
                        continue
                    target = order.pop()
                target = type(seq)(target)
                open_calls.discard(target)
                out.append((k, target, seq))
            yield pd.DataFrame(out, columns=[key, "start", "end"])

    dealt = ordered.repartition(key, "tool").sortWithinPartitions(key, "tool", "seq")
    return dealt.mapInPandas(fold, f"{key} {kinds[key]}, start {kinds['seq']}, end {kinds['seq']}")


def tool_calls(events: DataFrame, key: str = "message_id") -> DataFrame:
    """key, position and the call's id, name, state, output and error, for every call of every message: a start opens a
    call; an end or error closes the first with its run_id, else the latest open one of its name; one without either is
    ignored. seq is unique within a message."""
    rows = events.where(F.col("event").isin("on_tool_start", "on_tool_end", "on_tool_error")).select(key, "seq", "event", "name", "run_id", "text")
    opens = F.col("event") == "on_tool_start"
    before = Window.partitionBy(key, "run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(opens, F.struct("seq", "name"))).over(before)
    named = rows.where("run_id is not null").withColumn("_first", F.when(~opens, first))
    target = F.lit(None).cast(named.schema["_first"].dataType)
    both = named.unionByName(rows.where("run_id is null").withColumn("_first", target))
    # a named call is closed among the calls of its own tool
    tool = F.when(F.col("_first").isNotNull(), F.col("_first.name")).otherwise(F.col("name"))
    closed = _closings(both.select(key, tool.alias("tool"), "seq", opens.alias("opens"), F.col("_first.seq").alias("target")), key)
    last = closed.groupBy(key, "start").agg(F.max("end").alias("end"))
    ends = rows.where(~opens).select(key, F.col("seq").alias("end"), F.col("event").alias("_event"), F.col("text").alias("_text"))
    calls = rows.where(opens).select(key, F.col("seq").alias("start"), F.col("run_id").alias("id"), "name").join(last, [key, "start"], "left").join(ends, [key, "end"], "left")
    failed = F.col("_event") == "on_tool_error"
    state = F.when(F.col("_event").isNull(), "open").when(failed, "error").otherwise("done")
    return calls.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).alias("position"), "id", "name", state.alias("state"),
        F.when(F.col("_event").isNotNull() & ~failed, tool_output(F.col("_text"))).alias("output"), F.when(failed, F.coalesce("_text", F.lit("Tool error"))).alias("error"),
    )


def paired_by_run(events: DataFrame, key: str = "message_id") -> DataFrame:
    """Starts with the end or error of the same run_id, where every event has one: a join instead of a fold."""
    starts = events.where("event = 'on_tool_start'").select(key, "run_id", "name", F.col("seq").alias("start_seq"))
    ends = events.where("event in ('on_tool_end', 'on_tool_error')").groupBy(key, "run_id").agg(F.max(F.struct("seq", "event")).alias("e"))
    joined = starts.join(ends, [key, "run_id"], "left")
    state = F.when(F.col("e").isNull(), "open").when(F.col("e.event") == "on_tool_error", "error").otherwise("done")
    return joined.select(key, "run_id", "name", "start_seq", F.col("e.seq").alias("end_seq"), state.alias("state"))
