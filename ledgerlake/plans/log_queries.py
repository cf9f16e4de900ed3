"""Event log: lines, levels, messages, redaction, search, tail, progress and retention, derived from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import events, masking, scalar
from ledgerlake.operators import eventlog
from ledgerlake.operators.relational import search_log
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables, query
from ledgerlake.session import scratch_path
from ledgerlake.sources import growing
from ledgerlake.streaming import progress, tail

# Event name of each event type in the log.
NAMES = {
    "click": "file:after", "view": "file:before", "error": "connection:error", "purchase": "build:complete", "signup": "config:created",
}
NAME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
STATUS_SQL = "CASE WHEN value < 10 THEN 'failed' WHEN value < 15 THEN 'skipped' ELSE 'success' END"
NUMBER_SQL = "regexp_extract(props, '[0-9]+')"


def _name() -> Column:
    return scalar.label_of(F.col("event_type"), NAMES)


def _status() -> Column:
    return F.when(F.col("value") < 10, "failed").when(F.col("value") < 15, "skipped").otherwise("success")


def _data() -> Column:
    """Payload as JSON; an error event carries no status."""
    status = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(_status())
    return F.to_json(
        F.struct(
            F.concat(F.lit("sql/f_"), F.col("user_id"), F.lit(".sql")).alias("filepath"),
            status.alias("status"),
            F.get_json_object("props", "$.k").cast("int").alias("durationMs"),
            F.concat(F.lit("c_"), F.col("user_id")).alias("configName"),
            F.col("event_type").alias("name"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("refused "), "event_id")).alias("error"),
            F.get_json_object("props", "$.k").cast("int").alias("filesRun"),
            F.lit(0).alias("filesSkipped"),
        )
    )


def _log(t: Tables) -> DataFrame:
    return t.events.select("event_id", _name().alias("type"), _data().alias("data"))


# --- lines -----------------------------------------------------------------------------------------------------------


def _lines(t: Tables, *more: str) -> DataFrame:
    """JSON lines. Clicks are cut off, views lack a field, signups have a number where a string is due."""
    head = F.concat(
        F.lit('{"time":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('","level":"info","type":"'), _name(), F.lit('"')
    )
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", head)
        .when(kind == "view", F.concat(head, F.lit("}")))
        .when(kind == "signup", F.concat(head, F.lit(',"message":5}')))
        .otherwise(F.concat(head, F.lit(',"message":"event '), "event_id", F.lit('","data":'), "props", F.lit("}")))
    )
    return t.events.select(*more, line.alias("value"))


ENTRIES_SQL = f"""
entries AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, 'info' AS level, {NAME_SQL} AS type, 'event ' || event_id AS message,
         replace(props, ' ', '') AS data, CAST(NULL AS VARCHAR) AS context
  FROM events WHERE event_type IN ('error', 'purchase'))"""


@query("S3", f"WITH {ENTRIES_SQL} SELECT * FROM entries")
def s3_parse_log_lines(t: Tables) -> DataFrame:
    return eventlog.parse_lines(_lines(t))


@query(
    "O6",
    f"""
WITH {ENTRIES_SQL}
SELECT *, (SELECT count(*) FROM events) AS total_lines, (SELECT count(*) FROM events) > 50 AS has_more
FROM entries ORDER BY time DESC LIMIT 50""",
)
def o6_tail_of_log(t: Tables) -> DataFrame:
    return eventlog.tail(_lines(t), 50)


@query(
    "P5",
    f"WITH {ENTRIES_SQL} SELECT time, type, message FROM entries WHERE lower(type) LIKE '%build%' OR lower(message) LIKE '%build%' OR lower(level) LIKE '%build%'",
)
def p5_search_log(t: Tables) -> DataFrame:
    return search_log(eventlog.parse_lines(_lines(t)), "BUILD").select("time", "type", "message")


# --- levels and messages ---------------------------------------------------------------------------------------------

LEVEL_SQL = """CASE WHEN type = 'connection:error' THEN 'error' WHEN type IN ('file:after', 'build:complete', 'config:created') THEN 'info'
       ELSE 'debug' END"""


@query("L1", f"SELECT event_id, type, {LEVEL_SQL} AS level FROM (SELECT event_id, {NAME_SQL} AS type FROM events)")
def l1_classify_events(t: Tables) -> DataFrame:
    return t.events.select("event_id", _name().alias("type")).withColumn("level", events.classify_event(F.col("type")))


@query(
    "P9",
    f"SELECT event_id, type FROM (SELECT event_id, {NAME_SQL} AS type FROM events) WHERE type <> 'file:before'",
)
def p9_level_threshold(t: Tables) -> DataFrame:
    return eventlog.threshold(t.events.select("event_id", _name().alias("type")), "info")


@query(
    "L2",
    f"""
SELECT event_id, CASE WHEN type IN ('file:after', 'build:complete') AND status NOT IN ('success', 'skipped') THEN 'error'
       ELSE {LEVEL_SQL} END AS level
FROM (SELECT event_id, {NAME_SQL} AS type, {STATUS_SQL} AS status FROM events)""",
)
def l2_level_override(t: Tables) -> DataFrame:
    status = F.get_json_object("data", "$.status")
    return _log(t).select("event_id", events.entry_level(F.col("type"), status).alias("level"))


@query(
    "L3",
    f"""
SELECT event_id, type, CASE type
         WHEN 'file:before' THEN 'Executing sql/f_' || user_id || '.sql'
         WHEN 'file:after' THEN CASE WHEN status = 'success' THEN 'Executed sql/f_' || user_id || '.sql (' || n || 'ms)'
                                     ELSE 'Failed sql/f_' || user_id || '.sql: undefined' END
         WHEN 'connection:error' THEN 'Connection error for c_' || user_id || ': refused ' || event_id
         WHEN 'build:complete' THEN CASE WHEN status = 'success' THEN 'Build complete: ' || n || ' run, 0 skipped (' || n || 'ms)'
                                         ELSE 'Build failed after ' || n || ' files (' || n || 'ms)' END
         ELSE 'Created config: signup' END AS message
FROM (SELECT *, {NAME_SQL} AS type, {STATUS_SQL} AS status, {NUMBER_SQL} AS n FROM events)""",
)
def l3_event_messages(t: Tables) -> DataFrame:
    message = events.event_message(F.col("type"), F.col("data"))
    return _log(t).select("event_id", "type", message.alias("message"))


@query(
    "L3",
    f"""
SELECT event_id, 'custom ' || event_type || ': user="' || repeat('u', CAST(least(n, 47) AS INTEGER)) || CASE WHEN n > 50 THEN '...' ELSE
         repeat('u', CAST(greatest(n - 47, 0) AS INTEGER)) END || '", k=' || n || ', tags=[2 items]' AS message
FROM (SELECT *, CAST({NUMBER_SQL} AS BIGINT) AS n FROM events)""",
)
def l3_generic_messages(t: Tables) -> DataFrame:
    """Events without a template: their first three fields."""
    number = F.get_json_object("props", "$.k").cast("int")
    data = F.to_json(
        F.struct(
            F.repeat(F.lit("u"), number).alias("user"),
            number.alias("k"),
            F.array(F.lit(1), F.lit(2)).alias("tags"),
            F.lit("x").alias("unseen"),
        )
    )
    message = events.event_message(F.concat(F.lit("custom:"), "event_type"), data)
    return t.events.select("event_id", message.alias("message"))


@query(
    "L3",
    f"""
SELECT event_id, 'custom ' || event_type || ': user="' || repeat('u', CAST(n AS INTEGER)) || '", k=' || n || ', tags=[2 items], last="x"' AS message
FROM (SELECT *, CAST({NUMBER_SQL} AS BIGINT) AS n FROM events)""",
)
def l3_whole_messages(t: Tables) -> DataFrame:
    """The same with all fields and whole texts."""
    number = F.get_json_object("props", "$.k").cast("int")
    data = F.to_json(F.struct(F.repeat(F.lit("u"), number).alias("user"), number.alias("k"), F.array(F.lit(1), F.lit(2)).alias("tags"), F.lit("x").alias("last")))
    message = events.event_message(F.concat(F.lit("custom:"), "event_type"), data, events.WHOLE)
    return t.events.select("event_id", message.alias("message"))


# --- redaction -------------------------------------------------------------------------------------------------------

SECRET_SQL = f"repeat('s', CAST(CAST({NUMBER_SQL} AS INTEGER) % 20 AS INTEGER)) || CASE WHEN event_type = 'click' THEN '\"q' ELSE '' END"
MASK_SQL = """'<{label} ' || {shown} || CASE WHEN length(secret) > 12 THEN '...' ELSE '' END || ' (' || length(secret) || ') />'"""
STARS_SQL = "repeat('*', CAST(least(length(secret), 12) AS INTEGER))"
REVEAL_SQL = """CASE WHEN length(secret) < 4 THEN repeat('*', CAST(length(secret) AS INTEGER)) ELSE
  rpad(left(secret, CAST(least(ceil(length(secret) / 5.0), 4) AS INTEGER)), CAST(least(length(secret), 12) AS INTEGER), '*') END"""


def _secret() -> Column:
    number = F.get_json_object("props", "$.k").cast("int") % 20
    return F.concat(F.repeat(F.lit("s"), number), F.when(F.col("event_type") == "click", '"q').otherwise(""))


@query(
    "L5",
    f"""
SELECT event_id, {MASK_SQL.format(label="ApiKey", shown=STARS_SQL)} AS masked, {MASK_SQL.format(label="ApiKey", shown=REVEAL_SQL)} AS revealed
FROM (SELECT event_id, {SECRET_SQL} AS secret FROM events)""",
)
def l5_mask_values(t: Tables) -> DataFrame:
    key = F.lit("api_key")
    return t.events.select(
        "event_id",
        masking.mask_value(_secret(), key).alias("masked"),
        masking.mask_value(_secret(), key, verbose=True).alias("revealed"),
    )


def _secret_json(secret: Column) -> Column:
    inner = F.struct(secret.alias("API_KEY"), F.lit(7).alias("token"), F.lit("password").alias("hint"))
    item = F.struct(secret.alias("dbPassword"), F.col("event_id").alias("id"))
    return F.to_json(F.struct(secret.alias("password"), inner.alias("nested"), F.array(item).alias("items"), F.col("user_id").alias("user")))


@query(
    "L4",
    f"""
SELECT event_id, '{{"password":"' || {MASK_SQL.format(label="Password", shown=STARS_SQL)} || '","nested":{{"API_KEY":"'
         || {MASK_SQL.format(label="ApiKey", shown=STARS_SQL)} || '","token":7,"hint":"password"}},"items":[{{"dbPassword":"'
         || {MASK_SQL.format(label="DbPassword", shown=STARS_SQL)} || '","id":' || event_id || '}}],"user":' || user_id || '}}' AS data
FROM (SELECT event_id, user_id, {SECRET_SQL} AS secret FROM events)""",
)
def l4_redact_json(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", _secret_json(_secret()).alias("data"))
    return eventlog.redact(raw, masking.secret_keys(extra=["dbPassword"]))


@query(
    "L4",
    f"""
SELECT event_id, '{{"pass\\u0077ord":"' || {MASK_SQL.format(label="Password", shown=STARS_SQL)} || '","list":[{{"api\\u005fkey" : "'
         || {MASK_SQL.format(label="ApiKey", shown=STARS_SQL)} || '","open\\u0021":"' || event_type || '"}}]}}' AS data
FROM (SELECT *, {SECRET_SQL} AS secret FROM events)""",
)
def l4_redact_escaped_keys(t: Tables) -> DataFrame:
    """Keys that are secret only once their escapes are read, nested and in arrays."""
    value = F.substr(F.to_json(F.struct(_secret().alias("v"))), F.lit(6))  # with its quotes and the closing brace
    value = F.substr(value, F.lit(1), F.length(value) - 1)
    data = F.concat(
        F.lit('{"pass\\u0077ord":'), value, F.lit(',"list":[{"api\\u005fkey" : '), value, F.lit(',"open\\u0021":"'), F.col("event_type"), F.lit('"}]}')
    )
    return eventlog.redact(t.events.select("event_id", data.alias("data")), masking.secret_keys())


# --- streaming -------------------------------------------------------------------------------------------------------


@query(
    "L6",
    f"WITH {ENTRIES_SQL} SELECT time, level, type, message, data FROM entries",
)
def l6_live_tail(t: Tables) -> DataFrame:
    """Log lines arrive in a folder; a stream parses, filters and redacts what is there."""
    spark = t.spark
    folder, output, checkpoint = (scratch_path(spark, part) for part in ("log", "tail", "tail-state"))
    _lines(t).write.text(folder)
    tail.start_tail(tail.tail_stream(spark, folder), output, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(output).select("time", "level", "type", "message", "data")


@query(
    "L6",
    f"WITH {ENTRIES_SQL} SELECT time, level, type, message, data FROM entries",
)
def l6_growing_log(t: Tables) -> DataFrame:
    """The same lines in files that grow: after a first run half of the lines are appended and one file is rotated.

    The newest line is cut in two by the end of the first run.
    """
    spark = t.spark
    folder, output, checkpoint = (scratch_path(spark, part) for part in ("growing", "tail", "tail-state"))
    number = F.col("event_id")
    lines = _lines(t, "event_id").select("event_id", F.concat("value", F.lit("\n")).alias("text"))
    newest = lines.agg(F.max("event_id")).scalar()
    lines = lines.withColumn("file", F.concat(F.lit("app-"), F.pmod(F.xxhash64("event_id"), F.lit(8)), F.lit(".log")))
    cut = lines.where(number == newest)
    first = lines.where((number % 2 == 0) & (number < newest)).unionByName(cut.withColumn("text", F.substr("text", F.lit(1), F.lit(30))))
    later = lines.where((number % 2 == 1) & (number < newest)).unionByName(cut.select(F.lit(-1).alias("event_id"), F.substr("text", F.lit(31)).alias("text"), "file"))

    def run() -> None:
        tail.start_tail(tail.tail_stream(spark, folder), output, checkpoint, once=True).awaitTermination()

    growing.append_texts(first, folder, order="event_id")
    run()
    growing.append_texts(later.where("event_id < 0 OR event_id % 4 = 1"), folder, order="event_id")
    growing.rotate(folder, "app-3.log", "app-3.log.1")
    growing.append_texts(later.where("event_id % 4 = 3"), folder, order="event_id")
    run()
    return spark.read.parquet(output).select("time", "level", "type", "message", "data")


RUN_NAMES = {"view": "file:before", "click": "file:after", "signup": "file:skip", "error": "file:dry-run"}


def _run_events(log: DataFrame) -> DataFrame:
    build = F.when(F.col("value") < 15, "build:start").otherwise("build:complete")
    kind = F.coalesce(scalar.label_of(F.col("event_type"), RUN_NAMES), build)
    return log.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        kind.alias("type"),
        F.when(F.col("value") < 20, "failed").otherwise("success").alias("status"),
        F.concat(F.lit("f_"), F.col("event_id")).alias("filepath"),
        F.get_json_object("props", "$.k").cast("int").alias("file_count"),
        F.col("ts").alias("time"),
    )


PROGRESS_SQL = f"""
WITH run AS (
  SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'file:before' WHEN 'click' THEN 'file:after'
           WHEN 'signup' THEN 'file:skip' WHEN 'error' THEN 'file:dry-run'
           ELSE CASE WHEN value < 15 THEN 'build:start' ELSE 'build:complete' END END AS type,
         value >= 20 AS good, 'f_' || event_id AS filepath, CAST({NUMBER_SQL} AS INTEGER) AS file_count
  FROM events)
SELECT run_id, count(*) FILTER (WHERE type = 'file:after' AND good) AS files_run, count(*) FILTER (WHERE type = 'file:skip') AS files_skipped,
       count(*) FILTER (WHERE type IN ('file:after', 'file:dry-run') AND NOT good) AS files_failed,
       count(*) FILTER (WHERE type = 'file:dry-run' AND good) AS files_dry_run,
       arg_max(file_count, seq) FILTER (WHERE type = 'build:start') AS files_total,
       coalesce(arg_max(CASE type WHEN 'build:start' THEN 'running' ELSE 'complete' END, seq) FILTER (WHERE type LIKE 'build:%'), 'idle') AS phase,
       arg_max(CASE WHEN good THEN 'success' ELSE 'failed' END, seq) FILTER (WHERE type = 'build:complete') AS status,
       nullif(arg_max(CASE WHEN type = 'file:before' THEN filepath ELSE '' END, seq) FILTER (WHERE type <> 'file:skip'), '') AS current_file
FROM run GROUP BY run_id"""


@query("L7", PROGRESS_SQL)
def l7_run_progress(t: Tables) -> DataFrame:
    return eventlog.run_progress(_run_events(t.events))


@query("L7", PROGRESS_SQL)
def l7_run_progress_stream(t: Tables) -> DataFrame:
    """The same counters, kept by a stream over the event table that is stopped and started again; silent runs leave its state."""
    spark = t.spark
    folder, output, checkpoint = (scratch_path(spark, part) for part in ("run-events", "progress", "progress-state"))
    middle = t.events.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(ts), max(ts)) div 2, min(ts))")).scalar()
    for part in (t.events.where(F.col("ts") < middle), t.events.where(F.col("ts") >= middle)):
        part.write.mode("append").parquet(folder)
        log = spark.readStream.schema(t.events.schema).parquet(folder)
        changes = progress.progress_stream(_run_events(log), silence_minutes=6 * 60)
        progress.start_progress(changes, output, checkpoint, once=True).awaitTermination()
    return progress.current_progress(spark, output)


# --- retention -------------------------------------------------------------------------------------------------------


@query("L8", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-02-28 12:00:00'")
def l8_retained_history(t: Tables) -> DataFrame:
    as_of = F.lit("1998-08-31 12:00:00").cast("timestamp_ntz")
    return eventlog.retained(t.orders.select("o_orderkey", "o_orderdate"), as_of, 6, "o_orderdate")


@query("L8", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-02-28 12:00:00'")
def l8_dropped_history(t: Tables) -> DataFrame:
    as_of = F.lit("1998-08-31 12:00:00").cast("timestamp_ntz")
    return eventlog.dropped(t.orders, as_of, 6, "o_orderdate").select("o_orderkey")
