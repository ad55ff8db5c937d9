"""Event-stream queries: messages from `conversations`, tool calls and windows from `events`, in batch and streaming.

Tool events are derived: a click starts a call of the user's message, a purchase ends one, an error of that name fails
one; each call's name is the event's property bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import events as E
from millrace.sources import event_log
from millrace.sources import tables as S
from millrace.streaming import folds, tool_calls


def messages_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role")).alias("role"), F.nullif("text", F.lit("")).alias("content"))
    return E.convert_messages(rows)


def _message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one message: each turn a text event, a turn of the system an error."""
    turns = S.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "error").otherwise("on_chat_model_stream")
    return turns.select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), kind.alias("event"), "text")


def message_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.message_texts(_message_events(spark, sf_dir))


def history_last_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("version"), F.col("text").alias("content"))
    return E.last_versions(rows, ["conv_id", "role"])


def _tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_tool_events(S.table(spark, sf_dir, "events")).drop("ts")


def _as_tool_events(events: DataFrame) -> DataFrame:
    rows = events.where("event_type in ('click', 'purchase')")
    name = F.concat(F.lit("tool"), F.col("event_id") % 3)
    kind = F.when(F.col("event_type") == "click", "on_tool_start").otherwise("on_tool_end")
    run = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), F.col("event_id")))
    return rows.select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), kind.alias("event"), name.alias("name"), run.alias("run_id"), F.col("props").alias("text"), "ts")


def tool_pairing_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tool_calls(_tool_events(spark, sf_dir))


def tool_pairing_runid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose ends carry the run of the user's last start: pairs by run only."""
    rows = _tool_events(spark, sf_dir)
    last = F.last(F.when(F.col("event") == "on_tool_start", F.concat(F.lit("r"), F.col("seq"))), ignorenulls=True).over(Window.partitionBy("message_id").orderBy("seq"))
    return E.paired_by_run(rows.withColumn("run_id", last).where("run_id is not null"))


def event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one of the eight kinds with the data of its kind, parsed; some say nothing and go."""
    rows = S.table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 10)
    kind = F.get(F.array(*map(F.lit, (*E.KINDS, "on_chain_start", "on_chat_model_stream"))), F.col("k").cast("int"))
    text = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    content = F.struct(text.alias("content"))
    called = F.struct(F.lit("").alias("content"), F.array(F.struct(text.alias("args"))).alias("tool_call_chunks"))
    data = (
        F.when(F.col("k") == 0, F.to_json(F.struct(content.alias("chunk")))).when(F.col("k") == 9, F.to_json(F.struct(called.alias("chunk"))))
        .when(F.col("k") == 1, F.to_json(F.struct(text.alias("token")))).when(F.col("k") == 2, F.to_json(F.struct(content.alias("output")))).when(F.col("k") == 3, "{}")
        .when(F.col("k") == 4, F.to_json(F.struct(F.struct(F.col("user_id").alias("q")).alias("input")))).when(F.col("k") == 5, F.to_json(F.struct(text.alias("output"))))
        .otherwise(F.to_json(F.struct(text.alias("error"))))
    )
    name = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("tool"), F.col("user_id") % 3))
    shaped = rows.select(kind.alias("event"), name.alias("name"), F.col("event_id").cast("string").alias("run_id"), data.alias("data"))
    return E.parse_events(shaped).groupBy("kind", "text", "tool", "error").agg(F.count("*").alias("n"), F.count_if(F.col("id") != "").alias("n_ids"))


def event_extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"answer": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.col("event_type"))
    return rows.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), E.readable_text(wrapped).alias("readable"))


def event_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, every seventh broken, parsed again: broken ones are skipped."""
    rows = S.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("ts"), F.col("event_type").alias("event"), F.lit("n").alias("name"), F.col("user_id").cast("string").alias("run_id"), F.struct(F.col("value").alias("v")).alias("data")))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return S.event_lines(rows.select(broken.alias("value"))).select("ts", "event", "run_id")


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    made = S.table(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n")


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 hour", "30 minutes")
    return S.table(spark, sf_dir, "events").groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.table(spark, sf_dir, "events").groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("session_window.start").alias("start"), "n")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts by a stream over the same file: the last version of every window, those still open included."""
    ts = folds.stream_table(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    made = folds.tumbling(ts).select(F.col("window.start").alias("start"), "event_type", "n")
    versions = folds.run_to_versions(made, S.shared_path(spark, "stream-tumbling"))
    return E.last_versions(versions, ["start", "event_type"], "n").select("start", "event_type", "n")


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message fold as a stream with keyed state; its versions put together are the batch result."""
    turns = folds.stream_table(spark, f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("role") == "system", "error").otherwise("on_chat_model_stream")
    events = turns.select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), kind.alias("event"), "text")
    versions = folds.run_to_table(folds.stream_message_texts(events), S.shared_path(spark, "stream-fold"))
    return E.joined_versions(versions, ["message_id"])


def event_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines through the log's sink, every seventh broken, and read as a stream from its byte ranges."""
    event_log.register(spark)
    rows = S.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("ts"), F.col("event_type").alias("event"), F.lit("n").alias("name"), F.col("user_id").cast("string").alias("run_id"), F.struct(F.col("value").alias("v")).alias("data")))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    path = S.shared_path(spark, "event-log")
    rows.select(broken.alias("value")).write.format("line_log").mode("append").save(path)
    read = spark.readStream.format("line_log").load(path)
    return folds.run_to_table(S.event_lines(read).select("ts", "event", "run_id"), S.shared_path(spark, "event-log-read"))


def tool_calls_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of tool_pairing_fallback by a stream that keeps the calls of a message as state."""
    rows = folds.stream_table(spark, f"{sf_dir}/events.parquet")
    events = _as_tool_events(rows).withColumn("ts", F.col("ts").cast("timestamp"))
    with folds.rocksdb(spark):
        versions = folds.run_to_table(tool_calls.stream_tool_calls(events), S.shared_path(spark, "tool-calls"))
    return tool_calls.last_calls(versions)


QUERIES = {f.__name__: f for f in (
    messages_convert, message_fold, history_last_version, tool_pairing_fallback, tool_pairing_runid, event_dispatch, event_extract_json, event_log_lines, events_tumbling, events_sliding, events_session, stream_tumbling, stream_fold,
    event_log_source, tool_calls_stream,
)}
_TUMBLING = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
_FOLD = "SELECT conv_id AS message_id, string_agg(CASE WHEN role = 'system' THEN chr(10) || '[Error] ' || text ELSE text END, '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id"
ORACLES = {
    "messages_convert": "SELECT conv_id, turn, role, coalesce(nullif(text, ''), '') AS content FROM conversations WHERE turn % 5 <> 4 AND role IN ('user', 'assistant', 'system')",
    "message_fold": _FOLD,
    "stream_fold": _FOLD,
    "history_last_version": "SELECT conv_id, role, arg_max(text, turn) AS content, max(turn) AS version FROM conversations GROUP BY conv_id, role",
    "tool_pairing_runid": """WITH t AS (SELECT user_id AS message_id, event_id AS seq, event_type, 'tool' || (event_id % 3) AS name FROM events WHERE event_type IN ('click', 'purchase')),
        r AS (SELECT *, max(CASE WHEN event_type = 'click' THEN seq END) OVER (PARTITION BY message_id ORDER BY seq) AS run FROM t),
        e AS (SELECT message_id, run, max(seq) AS end_seq FROM r WHERE event_type = 'purchase' AND run IS NOT NULL GROUP BY ALL)
        SELECT r.message_id, 'r' || r.run AS run_id, r.name, r.seq AS start_seq, end_seq, CASE WHEN end_seq IS NULL THEN 'open' ELSE 'done' END AS state
        FROM r LEFT JOIN e ON r.message_id = e.message_id AND r.run = e.run WHERE r.event_type = 'click'""",
    # an end carries no run of a start here, so starts and ends of a tool nest like brackets: those of one depth alternate
    "tool_pairing_fallback": """WITH t AS (SELECT user_id AS message_id, event_id AS seq, event_type, 'tool' || (event_id % 3) AS name, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS step, props,
          CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS id FROM events WHERE event_type IN ('click', 'purchase')),
        s AS (SELECT *, sum(step) OVER (PARTITION BY message_id, name ORDER BY seq) AS total FROM t),
        d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY message_id, name ORDER BY seq)) AS depth FROM s),
        e AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY message_id, name ORDER BY seq), 0) AS was FROM d),
        l AS (SELECT *, CASE WHEN step = 1 THEN depth ELSE was END AS level FROM e WHERE step = 1 OR was > 0),
        p AS (SELECT *, lead(step) OVER w AS next_step, lead(props) OVER w AS next_props FROM l WINDOW w AS (PARTITION BY message_id, name, level ORDER BY seq))
        SELECT message_id, (row_number() OVER (PARTITION BY message_id ORDER BY seq) - 1)::INT AS position, id, name, CASE WHEN next_step = -1 THEN 'done' ELSE 'open' END AS state,
          CASE WHEN next_step = -1 THEN next_props END AS output, NULL::VARCHAR AS error FROM p WHERE step = 1""",
    "event_dispatch": """WITH r AS (SELECT event_id, event_id % 10 AS k, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS t, CASE WHEN event_id % 7 <> 0 THEN 'tool' || (user_id % 3) END AS tool, user_id FROM events),
        e AS (SELECT CASE k WHEN 0 THEN 'on_chat_model_stream' WHEN 1 THEN 'on_llm_new_token' WHEN 2 THEN 'on_chat_model_end' WHEN 4 THEN 'on_tool_start' WHEN 5 THEN 'on_tool_end' WHEN 6 THEN 'on_tool_error'
            WHEN 7 THEN 'error' ELSE 'on_chat_model_stream' END AS kind, CASE WHEN k IN (0, 1, 2, 5, 9) THEN t WHEN k = 4 THEN '{"q":' || user_id || '}' END AS text,
          CASE WHEN k IN (4, 5, 6) THEN tool END AS tool, CASE WHEN k IN (6, 7) THEN t END AS error, k IN (4, 5, 6) AS called FROM r
          WHERE k NOT IN (3, 8) AND (k NOT IN (0, 7, 9) OR t <> '') AND (k NOT IN (4, 5, 6) OR tool IS NOT NULL))
        SELECT kind, text, tool, error, count(*) AS n, count(*) FILTER (called) AS n_ids FROM e GROUP BY ALL""",
    "event_extract_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS readable FROM events",
    "event_log_lines": "SELECT event_id AS ts, event_type AS event, user_id::VARCHAR AS run_id FROM events WHERE event_id % 7 <> 0",
    "event_log_source": "SELECT event_id AS ts, event_type AS event, user_id::VARCHAR AS run_id FROM events WHERE event_id % 7 <> 0",
    "events_tumbling": _TUMBLING,
    "stream_tumbling": _TUMBLING,
    "events_sliding": "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY start",
    "events_session": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s""",
}
ORACLES["tool_calls_stream"] = ORACLES["tool_pairing_fallback"]
