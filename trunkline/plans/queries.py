"""One query for each log operator, over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.functions import masking as M
from trunkline.functions import text as T
from trunkline.operators import browse as B
from trunkline.operators.query import LogQuery, filter_exact_level, filter_query, filter_thresholds, search_display
from trunkline.operators.rotation import retained, rotated
from trunkline.schema import events_as_log
from trunkline.sources.plaintext import assemble
from trunkline.sources.protobuf import decoded_records, encoded_records

BASE_SQL = """WITH lg AS (SELECT epoch_us(ts) // 1000 AS timestamp_millis,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS level_id,
  ['TRACE','DEBUG','INFO','WARN','ERROR'][CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END] AS level,
  'user-' || user_id AS context, event_type || ' user=' || user_id || ' props=' || props AS message,
  event_id AS record_index, (event_id // 512)::INT AS trunk_index, user_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS stamp FROM events)
"""
SHOWN = "stamp || ' [' || level || '] ' || message"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
START = 1_704_067_200_000  # any bound does; the tables' times decide how many rows it keeps


def query(name: str, sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (BASE_SQL if base else "") + sql
        return f

    return register


def simple(name: str, build, sql: str) -> None:
    """A query over the log view."""
    query(name, sql)(lambda spark, sf_dir: build(events_as_log(spark, sf_dir)))


# columns are made when a query runs: there may be no session yet when this module is imported
def ts():
    return F.col("timestamp_millis")


def lvl():
    return F.col("level")


def msg():
    return F.col("message")


def shown():
    return T.display_text(ts(), lvl(), msg())


def _base(d: DataFrame) -> F.Column:
    """The log's first time stamp, as a subquery."""
    return d.agg(F.min("timestamp_millis")).scalar()


KEYS = ["record_index", "timestamp_millis", "level_id", "message"]
SQL_KEYS = "record_index, timestamp_millis, level_id, message"
LATE = 1_900_000_000_000

# ---- filters
simple("filter_query", lambda d: filter_query(d, LogQuery(START, LATE, "WARN", "user=1")).select("record_index", shown().alias("display")),
       f"SELECT record_index, {SHOWN} AS display FROM lg WHERE timestamp_millis BETWEEN {START} AND {LATE} AND level_id >= 3 AND contains(message, 'user=1')")
simple("filter_time_start", lambda d: filter_query(d, LogQuery(start=START + 864_000_000)).select(*KEYS), f"SELECT {SQL_KEYS} FROM lg WHERE timestamp_millis >= {START + 864_000_000}")
simple("filter_time_end", lambda d: filter_query(d, LogQuery(end=START + 864_000_000)).select(*KEYS), f"SELECT {SQL_KEYS} FROM lg WHERE timestamp_millis <= {START + 864_000_000}")
simple("filter_min_level", lambda d: filter_query(d, LogQuery(minimum_level="WARN")).select(*KEYS), f"SELECT {SQL_KEYS} FROM lg WHERE level_id >= 3")
simple("filter_keyword", lambda d: filter_query(d, LogQuery(keyword='{"k": 6')).select(*KEYS), f"""SELECT {SQL_KEYS} FROM lg WHERE contains(message, '{{"k": 6')""")
simple("filter_exact_level", lambda d: filter_exact_level(d, "WARN").select(*KEYS), f"SELECT {SQL_KEYS} FROM lg WHERE level_id = 3")
simple("search_display", lambda d: search_display(d, " [ERROR] error user=2 ").select(*KEYS), f"SELECT {SQL_KEYS} FROM lg WHERE contains({SHOWN}, '[ERROR] error user=2')")
simple("filter_thresholds", lambda d: filter_thresholds(d, "DEBUG", {"console": "WARN", "file": "TRACE"}).select("record_index", "appender"),
       "SELECT record_index, appender FROM lg, (VALUES ('console', 3), ('file', 0)) a(appender, need) WHERE level_id >= 1 AND level_id >= need")

# ---- projections
simple("display_text", lambda d: d.select("record_index", shown().alias("display")), f"SELECT record_index, {SHOWN} AS display FROM lg")
simple("format_timestamp", lambda d: d.select("record_index", T.format_timestamp(ts()).alias("stamp")), "SELECT record_index, stamp FROM lg")
simple("parse_timestamp", lambda d: d.select("record_index", T.parse_timestamp(T.format_timestamp(ts())).alias("millis")), "SELECT record_index, timestamp_millis AS millis FROM lg")
simple("offset_millis", lambda d: d.select("record_index", T.checked_offset(ts(), _base(d)).alias("offset_millis")),
       "SELECT record_index, timestamp_millis - (SELECT min(timestamp_millis) FROM lg) AS offset_millis FROM lg")
simple("rebuild_timestamp", lambda d: d.select("record_index", T.rebuilt_timestamp(_base(d), T.checked_offset(ts(), _base(d)).cast("string").cast("long")).alias("millis")), "SELECT record_index, timestamp_millis AS millis FROM lg")
simple("level_to_id", lambda d: d.select("record_index", T.level_to_id(lvl()).alias("id")), "SELECT record_index, level_id::INT AS id FROM lg")
simple("id_to_level", lambda d: d.select("record_index", T.id_to_level(F.col("level_id")).alias("name")), "SELECT record_index, level AS name FROM lg")
simple("level_to_proto", lambda d: d.select("record_index", T.level_to_proto(F.col("level_id")).alias("id")), "SELECT record_index, (level_id + 1)::INT AS id FROM lg")
simple("level_label", lambda d: d.select("record_index", T.level_label(lvl()).alias("label")), "SELECT record_index, '[' || level || ']' AS label FROM lg")
simple("level_command_name", lambda d: d.select("record_index", T.level_command_name(lvl()).alias("name")), "SELECT record_index, lower(level) AS name FROM lg")
simple("level_from_token", lambda d: d.select("record_index", T.level_from_token(F.when(F.col("level_id") == 4, F.lit(" fatal ")).when(F.col("level_id") == 2, F.lit("other")).otherwise(F.lower(lvl()))).alias("name")),
       "SELECT record_index, CASE level_id WHEN 4 THEN 'ERROR' WHEN 2 THEN NULL ELSE level END AS name FROM lg")
simple("raw_line_bytes", lambda d: d.select("record_index", T.raw_line_bytes(msg()).alias("n")), "SELECT record_index, 9 + strlen(message) AS n FROM lg")
simple("format_size", lambda d: d.select("record_index", T.format_size(F.col("record_index") * 977).alias("size")),
       "SELECT record_index, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MiB', n / 1048576.0) ELSE printf('%.2f GiB', n / 1073741824.0) END AS size FROM (SELECT record_index, record_index * 977 AS n FROM lg)")
simple("format_duration", lambda d: d.select("record_index", T.format_duration(F.col("record_index") * 911).alias("took")),
       "SELECT record_index, CASE WHEN n >= 1000000 THEN printf('%.3fs', n / 1e6) WHEN n >= 1000 THEN (n // 1000) || 'ms' ELSE n || 'us' END AS took FROM (SELECT record_index, record_index * 911 AS n FROM lg)")
simple("progress_percent", lambda d: d.select("record_index", T.progress_percent(F.col("record_index"), F.lit(12_345)).alias("p")), "SELECT record_index, record_index * 100 // 12345 AS p FROM lg")
simple("progress_percent_2dp", lambda d: d.select("record_index", T.progress_percent_2dp(F.col("record_index"), F.lit(4096)).alias("p")), "SELECT record_index, round(record_index * 100.0 / 4096, 2) AS p FROM lg")
simple("compression_ratio", lambda d: d.select("record_index", T.compression_ratio(F.col("record_index"), F.col("user_id")).alias("r")),
       "SELECT record_index, CASE WHEN record_index = 0 THEN '0.00%' ELSE printf('%.2f%%', user_id / record_index::DOUBLE * 100.0) END AS r FROM lg")
simple("parse_size_bytes", lambda d: d.select("record_index", T.parse_size_bytes(F.concat(F.col("record_index").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("", " B", "KB", "mb", "GB")]), F.col("level_id") + 1))).alias("n")),
       "SELECT record_index, record_index * [1, 1, 1024, 1048576, 1073741824][level_id + 1] AS n FROM lg")
simple("throwable_message", lambda d: d.select("record_index", T.throwable_message(msg(), F.when(F.col("level_id") == 4, F.lit("java.lang.E\n\tat x\r\n\n"))).alias("text")),
       "SELECT record_index, CASE WHEN level_id = 4 THEN message || chr(10) || 'java.lang.E' || chr(10) || chr(9) || 'at x' ELSE message END AS text FROM lg")

# ---- parsing plaintext
_LINES = "SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line_no FROM documents"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("line_no", "line"))


@query("split_lines", f"SELECT doc_id, line_no::INT AS line_no, line FROM ({_LINES})", base=False)
def split_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


simple("is_record_start", lambda d: d.select("record_index", T.is_record_start(F.when(F.col("level_id") > 1, shown()).otherwise(msg())).alias("start")), "SELECT record_index, level_id > 1 AS start FROM lg")


def _content():
    return F.when(F.col("level_id") == 0, F.concat(F.lit("[GID:] "), msg())).when(F.col("level_id") == 4, F.concat(F.lit("[FATAL] "), msg())).otherwise(F.concat(F.lit("["), F.lower(lvl()), F.lit("] "), msg()))


simple("parse_level", lambda d: d.select("record_index", T.parse_level(_content())[0].alias("parsed"), T.parse_level(_content())[1].alias("rest")),
       "SELECT record_index, CASE WHEN level_id = 0 THEN 'INFO' ELSE level END AS parsed, CASE WHEN level_id = 0 THEN '[GID:] ' || message ELSE message END AS rest FROM lg")


@query("assemble_multiline", "SELECT doc_id, 0::BIGINT AS record_index, 1777672860253 AS timestamp_millis, 'WARN' AS level, list_aggregate(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: CASE WHEN regexp_full_match(x, '[ \\t\\x0B\\f\\r\\n]*') THEN '' ELSE x END), 'string_agg', chr(10)) AS message FROM documents", base=False)
def assemble_multiline(spark, sf_dir):
    """Every document as a record of a log: a stamped line, and its other lines."""
    lines = _lines(spark, sf_dir)
    stamped = F.when(F.col("line_no") == 0, F.concat(F.lit("2026-05-01 22:01:00,253 [WARN] "), F.when(F.col("line").rlike(r"^\s*$"), F.lit("")).otherwise(F.col("line")))).otherwise(F.col("line"))
    out = assemble(lines.select(F.col("doc_id").cast("string").alias("file"), "line_no", stamped.alias("line")))
    return out.select(F.col("file").cast("long").alias("doc_id"), "record_index", "timestamp_millis", "level", "message")


# ---- masking and patterns


def _pii():
    return F.concat(F.lit("password=p"), F.col("user_id").cast("string"), F.lit(" tel 138"), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit(" mail u"), F.col("user_id").cast("string"), F.lit("@example.com end"))


_PII = "('password=p' || user_id || ' tel 138' || lpad(user_id::VARCHAR, 8, '0') || ' mail u' || user_id || '@example.com end')"
_MASKED = "('password=****** tel 138****' || right(lpad(user_id::VARCHAR, 8, '0'), 4) || ' mail u***@example.com end')"
_SQL_PW = "regexp_replace({}, '(?i)(password\\s*[=:]\\s*)[^\\s,;]+', '\\1******', 'g')"
simple("mask_password", lambda d: d.select("record_index", M.mask_content(_pii(), ["password"]).alias("m")), f"SELECT record_index, {_SQL_PW.format(_PII)} AS m FROM lg")
simple("mask_mobile", lambda d: d.select("record_index", M.mask_content(_pii(), ["mobile"]).alias("m")), f"SELECT record_index, regexp_replace({_PII}, '(^|[^0-9])(1[3-9][0-9])[0-9]{{4}}([0-9]{{4}})([^0-9]|$)', '\\1\\2****\\3\\4', 'g') AS m FROM lg")
simple("mask_email", lambda d: d.select("record_index", M.mask_content(_pii(), ["email"]).alias("m")), f"SELECT record_index, regexp_replace({_PII}, '(?:([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,63}}|[A-Za-z0-9._%+-])@([A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', '\\1***@\\2', 'g') AS m FROM lg")
simple("mask_content", lambda d: d.select("record_index", M.mask_content(_pii(), ["email", "unknown", "mobile", "password"]).alias("m")), f"SELECT record_index, {_MASKED} AS m FROM lg")
_VALUE = "user_id::VARCHAR"


def _value():
    return F.col("user_id").cast("string")


for _rule, _sql in {
    "password": "'******'",
    "mobile": f"CASE WHEN length({_VALUE}) < 7 THEN '******' ELSE left({_VALUE}, 3) || '****' || right({_VALUE}, 4) END",
    "partial": f"CASE WHEN length({_VALUE}) <= 4 THEN '****' ELSE left({_VALUE}, 2) || '****' || right({_VALUE}, 2) END",
}.items():
    simple(f"mask_var_{_rule}", lambda d, r=_rule: d.select("record_index", M.mask_variable("v", _value(), {"v": r}).alias("m")), f"SELECT record_index, {_sql} AS m FROM lg")
simple("mask_var_email", lambda d: d.select("record_index", M.mask_variable("v", F.concat(F.when(F.col("level_id") > 1, F.lit("ab")).otherwise(F.lit("a")), F.lit("@x"), _value()), {"v": "email"}).alias("m")),
       f"SELECT record_index, CASE WHEN level_id > 1 THEN 'a***@x' || {_VALUE} ELSE '***' END AS m FROM lg")
simple("mask_variable", lambda d: d.select("record_index", M.mask_variable("plain", _value(), {"other": "password"}).alias("m"), M.mask_variable("other", F.when(F.col("level_id") > 1, _value()), {"other": "Password"}).alias("n")),
       f"SELECT record_index, {_VALUE} AS m, CASE WHEN level_id > 1 THEN '******' ELSE '' END AS n FROM lg")


def _vars():
    return F.create_map(F.lit("id"), F.concat(F.lit("REQ-"), F.lpad(_value(), 6, "0")))


_pattern = "%logger|%thread|%messages|%x|%var{id}|%var{none:-guest}|%env{NO_SUCH_NAME:-d}"
simple("render_pattern", lambda d: d.select("record_index", M.render_pattern(_pattern, _pii(), F.col("source"), F.col("context"), _vars(), ["password", "mobile", "email"], {"id": "partial"}, {}).alias("body")),
       f"SELECT record_index, 'events|' || context || '|' || {_MASKED} || 's|%x|RE****' || right(lpad({_VALUE}, 6, '0'), 2) || '|guest|d' AS body FROM lg")
simple("format_line", lambda d: d.select("record_index", T.display_text(ts(), lvl(), M.render_pattern("[%logger] [%context] %message", msg(), F.col("source"), F.col("context"), _vars(), environ={})).alias("line")),
       "SELECT record_index, stamp || ' [' || level || '] [events] [' || context || '] ' || message AS line FROM lg")
simple("context_put", lambda d: d.select("record_index", F.to_json(M.context_put(M.context_put(_vars(), "a", "1"), "id", None)).alias("vars")), """SELECT record_index, '{"a":"1"}' AS vars FROM lg""")
simple("context_remove", lambda d: d.select("record_index", F.size(M.context_remove(_vars(), "id")).alias("n"), F.size(M.context_remove(_vars(), None)).alias("m")), "SELECT record_index, 0 AS n, 1 AS m FROM lg")
simple("context_clear", lambda d: d.select("record_index", F.to_json(M.context_put(M.context_clear(), "a", "1")).alias("vars")), """SELECT record_index, '{"a":"1"}' AS vars FROM lg""")
simple("placeholder_default", lambda d: d.select("record_index", F.coalesce(F.element_at(_vars(), M.placeholder("x:-y:-z")[0]), F.lit(M.placeholder("x:-y:-z")[1])).alias("v")), "SELECT record_index, 'y:-z' AS v FROM lg")
simple("split_by_level", lambda d: d.select("record_index", M.split_by_level_path("logs/app.log", lvl()).alias("a"), M.split_by_level_path("logs/%level.log", lvl()).alias("b"), M.split_by_level_path("app", lvl()).alias("c")),
       "SELECT record_index, 'logs/app-' || lower(level) || '.log' AS a, 'logs/' || lower(level) || '.log' AS b, 'app-' || lower(level) AS c FROM lg")
simple("archive_name", lambda d: d.select("record_index", M.archive_name(F.lit("a-%i.log"), F.col("level_id")).alias("a"), M.archive_name(F.lit("a.log"), F.col("level_id")).alias("b")),
       "SELECT record_index, 'a-' || level_id || '.log' AS a, 'a.log.' || level_id AS b FROM lg")

# ---- index, windows, search
_INDEX = "(SELECT trunk_index, min(record_index) AS record_start_index, count(*) AS line_count, sum(9 + strlen(message))::BIGINT AS raw_bytes FROM lg GROUP BY 1)"
simple("trunk_index", B.trunk_index, f"SELECT * FROM {_INDEX}")
simple("total_records", lambda d: B.total_records(B.trunk_index(d)), f"SELECT sum(line_count)::BIGINT AS total_records, count(*) AS trunk_count FROM {_INDEX}")
_ASKED = "SELECT record_index * 3 AS record_index FROM lg"
_OWNER = f"SELECT a.record_index, i.trunk_index, coalesce(i.trunk_index + 1, 0) AS position FROM ({_ASKED}) a LEFT JOIN {_INDEX} i ON a.record_index >= i.record_start_index AND a.record_index < i.record_start_index + i.line_count"
simple("trunk_of_record", lambda d: B.trunk_of_record(d.select((F.col("record_index") * 3).alias("record_index")), B.trunk_index(d)).select("record_index", "trunk_index"), f"SELECT record_index, trunk_index FROM ({_OWNER})")
simple("trunk_position", lambda d: B.trunk_of_record(d.select((F.col("record_index") * 3).alias("record_index")), B.trunk_index(d)).select("record_index", "position"), f"SELECT record_index, position FROM ({_OWNER})")
simple("trunk_count", lambda d: B.total_records(B.trunk_index(d)).select("trunk_count"), f"SELECT count(*) AS trunk_count FROM {_INDEX}")
simple("trunk_record_start", lambda d: B.trunk_index(d).select("trunk_index", "record_start_index"), f"SELECT trunk_index, record_start_index FROM {_INDEX}")
simple("read_window", lambda d: B.read_window(d, 700, 900).select(*KEYS), f"SELECT {SQL_KEYS} FROM lg WHERE record_index >= 700 AND record_index < 1600")
simple("read_last_window", lambda d: B.read_last_window(d, 300).select(*KEYS), f"SELECT {SQL_KEYS} FROM lg ORDER BY record_index DESC LIMIT 300")
for _name, _step in {"move_down": 1, "move_up": -1, "page_down": B.page_step(200, 40), "page_up": -B.page_step(200, 40), "quarter_page_down": B.quarter_step(39), "move_to_top": -(1 << 40), "move_to_bottom": 1 << 40}.items():
    simple(_name, lambda d, s=_step: d.select("record_index", B.moved(F.col("record_index"), d.agg(F.count("*")).scalar(), s).alias("moved")),
           f"SELECT record_index, greatest(0, least(record_index + {_step}, (SELECT count(*) FROM lg) - 1)) AS moved FROM lg")
simple("jump_to_line", lambda d: d.where(F.col("record_index") == B.jump_target(128, 1000)).select(*KEYS), f"SELECT {SQL_KEYS} FROM lg WHERE record_index = 127")
simple("trunk_visit_order", lambda d: B.trunk_index(d).select("trunk_index", B.visit_rank(F.col("trunk_index"), 7).alias("rank")),
       f"SELECT trunk_index, CASE WHEN trunk_index = 7 THEN 0 WHEN trunk_index > 7 THEN 2 * (trunk_index - 7) - 1 ELSE 2 * (7 - trunk_index) END AS rank FROM {_INDEX}")
_KEY = "purchase user=2"
_HITS = f"(SELECT trunk_index, record_index FROM lg WHERE contains({SHOWN}, '{_KEY}'))"
simple("search_initial_target", lambda d: B.search_initial_target(d, _KEY, 3700, 7),
       f"""SELECT trunk_index, CASE WHEN trunk_index = 7 THEN coalesce(min(record_index) FILTER (record_index > 3700), max(record_index) FILTER (record_index < 3700), min(record_index))
       WHEN trunk_index > 7 THEN min(record_index) ELSE max(record_index) END AS record_index, count(*) AS matches_so_far FROM {_HITS} GROUP BY trunk_index ORDER BY abs(trunk_index - 7), trunk_index < 7 LIMIT 1""")  # fmt: skip
simple("search_matches_so_far", lambda d: B.search_initial_target(d, _KEY, 3700, 7).select("matches_so_far"), f"SELECT count(*) AS matches_so_far FROM {_HITS} GROUP BY trunk_index ORDER BY abs(trunk_index - 7), trunk_index < 7 LIMIT 1")
simple("search_trunk_matches", lambda d: B.matches(d, _KEY).groupBy("trunk_index").agg(F.sort_array(F.collect_list("record_index")).alias("hits")), f"SELECT trunk_index, list(record_index ORDER BY record_index) AS hits FROM {_HITS} GROUP BY 1")
simple("next_match", lambda d: B.next_match(d, _KEY, 3700), f"SELECT coalesce(min(record_index) FILTER (record_index > 3700), min(record_index)) AS record_index FROM {_HITS}")
simple("prev_match", lambda d: B.prev_match(d, _KEY, 3), f"SELECT coalesce(max(record_index) FILTER (record_index < 3), max(record_index)) AS record_index FROM {_HITS}")
simple("level_filter_view", lambda d: B.level_filter_view(d, "INFO", 3700, 7, 150),
       """SELECT record_index, record_index + 1 AS line_number, message, CASE WHEN trunk_index = 7 THEN 0 WHEN trunk_index > 7 THEN 2 * (trunk_index - 7) - 1 ELSE 2 * (7 - trunk_index) END AS visit,
       (trunk_index = 7 AND record_index < 3700)::INT AS lap FROM lg WHERE level_id = 2 ORDER BY visit, lap, CASE WHEN trunk_index < 7 THEN -record_index ELSE record_index END LIMIT 150""")  # fmt: skip

# ---- rendering
_TWO = "(SELECT record_index, 'u' || chr(10) || message AS text FROM lg)"
simple("highlight_ranges", lambda d: d.select("record_index", F.transform(T.highlight_ranges(msg(), "us"), lambda r: r["start"]).alias("starts")),
       "SELECT record_index, list_transform(list_filter(range(1, length(message)), lambda i: substr(message, i, 2) = 'us'), lambda i: (i - 1)::INT) AS starts FROM lg")
simple("wrap_rows", lambda d: d.select("record_index", F.posexplode(T.wrap_rows(F.concat(F.lit("u\n"), msg()), 16)).alias("row", "r")).select("record_index", "row", "r.content"),
       "SELECT record_index, (CASE WHEN i = 0 THEN 0 ELSE i END)::INT AS row, CASE WHEN i = 0 THEN 'u' ELSE substr(message, (i - 1) * 16 + 1, 16) END AS content FROM lg, range(0, 20) t(i) WHERE i = 0 OR i <= greatest(1, ceil(length(message) / 16.0))")
simple("row_highlights", lambda d: d.select("record_index", F.size(T.row_highlights(T.highlight_ranges(msg(), "user"), F.lit(0), F.lit(8))).alias("n")), "SELECT record_index, (CASE WHEN strpos(message, 'user') BETWEEN 1 AND 8 THEN 1 ELSE 0 END)::INT AS n FROM lg")
simple("line_number_width", lambda d: d.agg(T.line_number_width(F.count("*")).alias("w")), "SELECT greatest(6, length(count(*)::VARCHAR))::INT AS w FROM lg")
simple("content_width", lambda d: d.agg(T.content_width(F.lit(80), T.line_number_width(F.count("*"))).alias("w")), "SELECT greatest(1, 80 - greatest(6, length(count(*)::VARCHAR)) - 2)::INT AS w FROM lg")
_FRAME = f"SELECT record_index, i::INT AS row, CASE WHEN i = 0 THEN (record_index + 1)::VARCHAR END AS line_number, substr(txt, i * 40 + 1, 40) AS content, record_index = 110 AS focused, (row_number() OVER (ORDER BY record_index, i) - 1)::INT AS frame_row FROM (SELECT record_index, {SHOWN} AS txt FROM lg WHERE record_index >= {{}} AND record_index < {{}}), range(0, 20) t(i) WHERE i < greatest(1, ceil(length(txt) / 40.0))"
_FRAMES = "SELECT n::INT AS frame_row, record_index, line_number, coalesce(content, '') AS content, coalesce(focused, false) AS focused FROM range(0, 50) t(n) LEFT JOIN ({}) ON frame_row = n"
for _name, _lo, _hi in (("frame_rows", 100, 140), ("frame_rows_padded", 105, 112)):
    simple(_name, lambda d, a=_lo, b=_hi: B.frame_rows(B.read_window(d, a, b - a), "user", 40, 110, 50).select("frame_row", "record_index", "line_number", "content", "focused"), _FRAMES.format(_FRAME.format(_lo, _hi)))
simple("header_text", lambda d: B.total_records(B.trunk_index(d)).select(F.format_string("Trunkline | file=%s | records=%d | trunks=%d/%d | line=%d", F.lit("events"), "total_records", F.lit(1), "trunk_count", F.lit(1)).alias("header")),
       f"SELECT 'Trunkline | file=events | records=' || sum(line_count)::BIGINT || ' | trunks=1/' || count(*) || ' | line=1' AS header FROM {_INDEX}")
_COUNTED = f"SELECT record_index, greatest(1, ceil(length({SHOWN}) / 40.0))::INT AS rows FROM lg"
simple("bottom_page", lambda d: B.bottom_page(d, 40, 31, 50),
       f"SELECT record_index, rows FROM (SELECT *, sum(rows) OVER (ORDER BY record_index DESC) AS upto FROM ({_COUNTED}) ORDER BY record_index DESC LIMIT 50) WHERE upto <= 31")


@query("resolve_viewport", f"""SELECT min(top) AS top FROM (SELECT t.top, sum(c.rows) AS before FROM (SELECT greatest(100, 401 - 15) + i AS top FROM range(0, 15) r(i)) t LEFT JOIN ({_COUNTED}) c ON c.record_index >= t.top AND c.record_index < 400 GROUP BY t.top)
  WHERE coalesce(before, 0) <= 19 AND top <= 400""")
def resolve_viewport(spark, sf_dir):
    """From record 100 at the top to record 400 in focus, in a view of 20 rows and 15 records."""
    top = B.resolve_top(events_as_log(spark, sf_dir), 100, 400, 40, 20, 15)
    return spark.createDataFrame([(top,)], "top long")


# ---- packing, batches, order


simple("assign_batches", lambda d: B.trunk_index(d).select("trunk_index", B.batch_of(F.col("trunk_index"), B.trunk_index(d).agg(F.count("*")).scalar(), 6).alias("batch")), f"SELECT trunk_index, ntile(6) OVER (ORDER BY trunk_index) - 1 AS batch FROM {_INDEX}")
simple("batch_summary", lambda d: B.batch_summary(d.withColumn("batch", F.floor(F.col("trunk_index") / 4).cast("int"))),
       "SELECT batch, n, first_ts, last_ts, coalesce(first_ts < lag(last_ts) OVER (ORDER BY batch), false) AS violation FROM (SELECT (trunk_index // 4)::INT AS batch, count(*) AS n, min(timestamp_millis) AS first_ts, max(timestamp_millis) AS last_ts FROM lg GROUP BY 1)")


@query("order_check", "SELECT trunk_index, count(*) FILTER (timestamp_millis < prev) AS violations FROM (SELECT trunk_index, timestamp_millis, lag(timestamp_millis) OVER (PARTITION BY trunk_index ORDER BY record_index) AS prev FROM lg) GROUP BY 1")
def order_check(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("timestamp_millis").over(Window.partitionBy("trunk_index").orderBy("record_index"))
    return events_as_log(spark, sf_dir).withColumn("prev", before).groupBy("trunk_index").agg(F.count_if(F.col("timestamp_millis") < F.col("prev")).alias("violations"))


@query("generate_fixture", "SELECT i AS chunk, record_index, timestamp_millis + i * ((SELECT max(timestamp_millis) - min(timestamp_millis) FROM lg) + 1) AS timestamp_millis, message FROM lg, range(0, 3) t(i)")
def generate_fixture(spark, sf_dir):
    """A log repeated three times, each time moved by its span and a millisecond."""
    log = events_as_log(spark, sf_dir)
    span = log.agg(F.max("timestamp_millis") - F.min("timestamp_millis") + 1).scalar()
    return log.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>"))).select("chunk", "record_index", (F.col("timestamp_millis") + F.col("chunk") * span).alias("timestamp_millis"), "message")


# ---- rotation

_ROTATE_BYTES = 4096
#: Segment boundaries by jumps over running totals; ``next`` is where the following segment begins.
_SEGMENTS = """(WITH RECURSIVE s AS (
  SELECT target, record_index, sum(strlen(message) + 1) OVER (PARTITION BY target ORDER BY record_index)::BIGINT AS total
  FROM (SELECT *, 'logs/app-' || lower(level) || '.log' AS target FROM lg)
), seg AS (
  SELECT DISTINCT target, 0::BIGINT AS segment, 0::BIGINT AS base FROM s
  UNION ALL
  SELECT g.target, g.segment + 1, {next} FROM seg g JOIN s ON s.target = g.target AND s.total > g.base
  GROUP BY g.target, g.segment, g.base HAVING max(s.total) > {next}
) SELECT s.record_index, s.target, max(g.segment) AS segment FROM s JOIN seg g ON g.target = s.target AND g.base < s.total GROUP BY ALL)"""
_BEFORE = _SEGMENTS.format(next=f"greatest(min(s.total), max(CASE WHEN s.total <= g.base + {_ROTATE_BYTES} THEN s.total END))")
_AFTER = _SEGMENTS.format(next=f"min(CASE WHEN s.total > g.base + {_ROTATE_BYTES} THEN s.total END)")


def _segmented(d: DataFrame, after: bool = False) -> DataFrame:
    sized = d.select(M.split_by_level_path("logs/app.log", lvl()).alias("target"), "record_index", (F.octet_length("message") + 1).alias("size"))
    return rotated(sized, "target", "size", "record_index", _ROTATE_BYTES, after).select("record_index", "target", "segment")


simple("rotate_text", _segmented, f"SELECT record_index, target, segment FROM {_BEFORE}")
simple("rotate_tog", lambda d: _segmented(d, after=True), f"SELECT record_index, target, segment FROM {_AFTER}")
simple("archive_shift", lambda d: retained(_segmented(d), "target", 2).select("record_index", "target", "archive"),
       f"SELECT record_index, target, nullif(age, 0) AS archive FROM (SELECT *, max(segment) OVER (PARTITION BY target) - segment AS age FROM {_BEFORE}) WHERE age <= 2")


# ---- protobuf


@query("proto_record", "SELECT timestamp_millis, level_id::INT AS level_id, 'events' AS source, context, message FROM lg")
def proto_record(spark, sf_dir):
    """Records to messages and back."""
    log = events_as_log(spark, sf_dir).withColumn("attributes", F.create_map(F.lit("format"), F.lit("trunk")))
    return decoded_records(encoded_records(log)).drop("attributes")


from trunkline.plans import file_queries  # noqa: E402, F401  adds its queries to those here
