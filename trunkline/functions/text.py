"""Parsing, formatting and rendering of log text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trunkline.schema import LEVEL_ALIASES, LEVELS, MAX_OFFSET

RECORD_START = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} "
STAMP = "yyyy-MM-dd HH:mm:ss,SSS"


def is_record_start(line: Column) -> Column:
    return line.rlike(RECORD_START)


def parse_timestamp(line: Column, strict: bool = True) -> Column:
    """UTC milliseconds of the leading 23 characters; an impossible date is an error, or null if not strict."""
    head = F.substring(line, 1, 23)
    got = F.unix_millis(F.try_to_timestamp(head, F.lit(STAMP)))
    return F.when(got.isNull() & head.isNotNull(), F.raise_error(F.concat(F.lit("no such time: "), head)).cast("long")).otherwise(got) if strict else got


def level_from_token(token: Column) -> Column:
    word = F.upper(F.trim(token))
    out = F.when(word.isin(*LEVELS), word)
    for alias, level in LEVEL_ALIASES.items():
        out = out.when(word == alias, F.lit(level))
    return out


def parse_level(content: Column) -> tuple[Column, Column]:
    """(level, message) of the text after the time stamp."""
    token = level_from_token(F.regexp_extract(content, r"^\[([^\]]*)\]", 1))
    return F.coalesce(token, F.lit("INFO")), F.when(token.isNotNull(), F.regexp_replace(content, r"^\[[^\]]*\] ?", "")).otherwise(content)


def split_lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def format_timestamp(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), STAMP)


def _or_error(value: Column, known: Column, what: str, given: Column) -> Column:
    """``value`` where it is known, null for a null input, else an error."""
    return F.when(known | given.isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"no such {what}: "), given.cast("string"))).cast("int"))


def level_to_id(level: Column) -> Column:
    at = (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1).cast("int")
    return _or_error(at, at >= 0, "level", level)


def id_to_level(level_id: Column) -> Column:
    known = level_id.between(0, len(LEVELS) - 1)
    name = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.when(known, level_id + 1).otherwise(1))
    return F.when(known, name).otherwise(F.raise_error(F.concat(F.lit("no such level id: "), level_id.cast("string"))).cast("string"))


def level_to_proto(level_id: Column) -> Column:
    return _or_error((level_id + 1).cast("int"), level_id.between(0, len(LEVELS) - 1), "level id", level_id)


def proto_to_level(severity: Column) -> Column:
    """0, which means unspecified, and unknown numbers are errors."""
    return _or_error((severity - 1).cast("int"), severity.between(1, len(LEVELS)), "severity", severity)


def rebuilt_timestamp(base: Column, offset: Column) -> Column:
    return base + F.when(offset.between(0, MAX_OFFSET), offset).otherwise(F.raise_error(F.lit("a record's offset is out of range")).cast("long"))


def level_label(level: Column) -> Column:
    return F.concat(F.lit("["), level, F.lit("]"))


def level_command_name(level: Column) -> Column:
    return F.lower(level)


def display_text(millis: Column, level: Column, message: Column) -> Column:
    return F.concat(format_timestamp(millis), F.lit(" "), level_label(level), F.lit(" "), message)


def checked_offset(millis: Column, base: Column) -> Column:
    offset = millis - base
    return F.when(offset.between(0, MAX_OFFSET), offset).otherwise(F.raise_error(F.lit("a record's offset is out of range")).cast("long"))


def raw_line_bytes(message: Column) -> Column:
    return (F.lit(9) + F.octet_length(message)).cast("long")


def fixed(value: Column, digits: int) -> Column:
    """So many decimals of the exact binary value, ties to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def format_size(size: Column) -> Column:
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"]
    for i, unit in enumerate(units, 1):
        text = F.concat(fixed(size / F.lit(float(1024**i)), 2), F.lit(f" {unit}"))
        out = out.when(size < 1024 ** (i + 1), text) if i < len(units) else out.otherwise(text)
    return out


def format_duration(micros: Column) -> Column:
    return (
        F.when(micros >= 1_000_000, F.concat(fixed(micros / 1e6, 3), F.lit("s")))
        .when(micros >= 1_000, F.concat(F.floor(micros / 1000).cast("string"), F.lit("ms")))
        .otherwise(F.concat(micros.cast("string"), F.lit("us")))
    )


def compression_ratio(source: Column, output: Column) -> Column:
    return F.concat(fixed(F.when(source == 0, F.lit(0.0)).otherwise(output / source * 100.0), 2), F.lit("%"))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100)).otherwise(F.expr("1") * F.floor(done * 100 / total)).cast("long")


def progress_percent_2dp(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(done * 100.0 / total, 2))


def parse_size_bytes(text: Column) -> Column:
    """``1KB``, ``2 MB``, ``3GB``, ``10B`` or a bare number; blank is 0; anything else an error."""
    clean = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    unit = F.regexp_extract(clean, r"^[0-9]+\s*(KB|MB|GB|B|)$", 1)
    number = F.regexp_extract(clean, r"^([0-9]+)", 1).try_cast("long")
    scale = F.when(unit == "KB", F.lit(1024)).when(unit == "MB", F.lit(1024**2)).when(unit == "GB", F.lit(1024**3)).otherwise(F.lit(1))
    bad = ~clean.rlike(r"^[0-9]+\s*(KB|MB|GB|B)?$")
    return F.when(clean == "", F.lit(0)).when(bad, F.raise_error(F.concat(F.lit("no such size: "), clean)).cast("long")).otherwise(number * scale).cast("long")


def throwable_message(message: Column, trace: Column) -> Column:
    return F.when(trace.isNull(), message).otherwise(F.regexp_replace(F.concat(message, F.lit("\n"), trace), r"[\r\n]+$", ""))


def highlight_ranges(text: Column, keyword: str) -> Column:
    """Half-open ranges of code points of all hits, left to right, none overlapping."""
    pieces = F.slice(F.split(text, r"\Q" + keyword.replace(r"\E", r"\E\\E\Q") + r"\E", -1), 1, F.size(F.split(text, r"\Q" + keyword.replace(r"\E", r"\E\\E\Q") + r"\E", -1)) - 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("got"))
    n = len(keyword)

    def step(acc, piece):
        start = acc["at"] + F.length(piece)
        return F.struct((start + n).alias("at"), F.concat(acc["got"], F.array(F.struct(start.alias("start"), (start + n).alias("end")))).alias("got"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["got"])


def wrap_rows(text: Column, width: int) -> Column:
    """Rows of ``width`` code points for each line; an empty line is one empty row. Each row knows where it starts in the text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,content:string>>").alias("rows"))

    def step(acc, line):
        count = F.greatest(F.ceil(F.length(line) / width), F.lit(1)).cast("int")
        rows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((acc["at"] + i * width).alias("start"), F.substr(line, i * width + 1, F.lit(width)).alias("content")))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.concat(acc["rows"], rows).alias("rows"))

    return F.aggregate(F.split(text, "\n", -1), zero, step, lambda acc: acc["rows"])


def row_highlights(ranges: Column, start: Column, length: Column) -> Column:
    """Ranges cut to a row and counted from its start."""
    met = F.filter(ranges, lambda r: (r["start"] < start + length) & (r["end"] > start))
    return F.transform(met, lambda r: F.struct((F.greatest(r["start"], start) - start).alias("start"), (F.least(r["end"], start + length) - start).alias("end")))


def line_number_width(total: Column) -> Column:
    return F.greatest(F.lit(6), F.length(total.cast("string")))


def content_width(width: Column, number_width: Column) -> Column:
    return F.greatest(F.lit(1), width - number_width - 2)
