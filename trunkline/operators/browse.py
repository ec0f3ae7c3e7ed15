"""Index, windows, paging, search and views over records with ``record_index`` and ``trunk_index``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trunkline.functions.text import display_text, highlight_ranges, row_highlights, wrap_rows
from trunkline.schema import LEVELS, MAX_TRUNK_RECORDS


def trunk_index(records: DataFrame) -> DataFrame:
    """(trunk_index, record_start_index, line_count, raw_bytes): records are numbered densely, so starts are minima; no sort."""
    return records.groupBy("trunk_index").agg(
        F.min("record_index").alias("record_start_index"), F.count("*").alias("line_count"), F.sum(F.octet_length("message") + F.lit(9)).cast("long").alias("raw_bytes")
    )


def total_records(index: DataFrame) -> DataFrame:
    return index.agg(F.sum("line_count").cast("long").alias("total_records"), F.count("*").alias("trunk_count"))


def read_window(records: DataFrame, start: int, count: int) -> DataFrame:
    """Records [start, start + count); the bounds are pushed to the scan."""
    return records.where((F.col("record_index") >= max(0, start)) & (F.col("record_index") < start + max(0, count)))


def read_last_window(records: DataFrame, count: int, total: int | None = None) -> DataFrame:
    """The last ``count`` records; without a total, the largest index is a subquery of the plan."""
    if total is not None:
        return read_window(records, max(0, total - count), count)
    return records.where(F.col("record_index") > records.agg(F.max("record_index")).scalar() - F.lit(count))


def trunk_of_record(lookups: DataFrame, index: DataFrame) -> DataFrame:
    """``lookups`` (record_index, ...) with trunk_index, null where no trunk holds the record, and position, which is 1 more, or 0.

    ``index`` has (trunk_index, record_start_index, line_count). Both sides meet by the range of ``MAX_TRUNK_RECORDS``
    records that they fall in; a trunk falls in two at most, so this is an equi-join whatever the sizes.
    """
    width = MAX_TRUNK_RECORDS + 1
    end = F.col("record_start_index") + F.col("line_count")
    bins = F.sequence(F.floor(F.col("record_start_index") / width), F.floor((end - 1) / width))
    held = index.where("line_count > 0").select(F.col("trunk_index").alias("_trunk"), F.col("record_start_index").alias("_from"), end.alias("_to"), F.explode(bins).alias("_bin"))
    asked = lookups.withColumn("_bin", F.floor(F.col("record_index") / width))
    met = (asked["_bin"] == held["_bin"]) & (F.col("record_index") >= F.col("_from")) & (F.col("record_index") < F.col("_to"))
    out = asked.join(held, met, "left").select(*[asked[c] for c in lookups.columns if c not in ("trunk_index", "position")], F.col("_trunk").alias("trunk_index"))
    return out.withColumn("position", F.coalesce(F.col("trunk_index") + 1, F.lit(0)))


def page_step(page: int, height: int) -> int:
    return max(1, min(page, max(1, height - 1)))


def moved(current: Column, total: Column, step: int) -> Column:
    """The cursor ``step`` records on, or back, kept inside."""
    return F.greatest(F.lit(0), F.least(current + step, total - 1))


def quarter_step(page: int) -> int:
    return max(1, page // 4)


def jump_target(line: int, total: int) -> int:
    if line < 1:
        raise ValueError("lines count from 1")
    return max(0, min(line - 1, total - 1))


def visit_rank(trunk: Column, current: int) -> Column:
    """0 for the current trunk, then outward; the trunk ahead comes before the one behind."""
    away = F.abs(trunk - current)
    return F.when(away == 0, F.lit(0)).otherwise(away * 2 - (trunk > current).cast("int")).cast("int")


def matches(records: DataFrame, keyword: str) -> DataFrame:
    return records.where(F.contains(display_text(F.col("timestamp_millis"), F.col("level"), F.col("message")), F.lit(keyword)))


def search_initial_target(records: DataFrame, keyword: str, current: int, current_trunk: int) -> DataFrame:
    """One row: trunk_index, record_index that a search jumps to, and the matches of the trunks visited so far.

    In the current trunk the first match after the cursor, else the last before it, else the first; in a
    later trunk its first match, in an earlier one its last.
    """
    idx = F.col("record_index")
    hit = matches(records, keyword).groupBy("trunk_index").agg(
        F.count("*").alias("n"), F.min("record_index").alias("first"), F.max("record_index").alias("last"),
        F.min(F.when(idx > current, idx)).alias("after"), F.max(F.when(idx < current, idx)).alias("before"),
    )
    trunk = F.col("trunk_index")
    target = F.when(trunk == current_trunk, F.coalesce("after", "before", "first")).when(trunk > current_trunk, F.col("first")).otherwise(F.col("last"))
    return hit.withColumn("rank", visit_rank(trunk, current_trunk)).orderBy("rank").limit(1).select("trunk_index", target.alias("record_index"), F.col("n").alias("matches_so_far"))


def next_match(records: DataFrame, keyword: str, current: int) -> DataFrame:
    idx = F.col("record_index")
    return matches(records, keyword).agg(F.coalesce(F.min(F.when(idx > current, idx)), F.min(idx)).alias("record_index"))


def prev_match(records: DataFrame, keyword: str, current: int) -> DataFrame:
    idx = F.col("record_index")
    return matches(records, keyword).agg(F.coalesce(F.max(F.when(idx < current, idx)), F.max(idx)).alias("record_index"))


def level_filter_view(records: DataFrame, level: str, current: int, current_trunk: int, capacity: int) -> DataFrame:
    """The first ``capacity`` records of a level in outward order, with their line numbers."""
    idx, trunk = F.col("record_index"), F.col("trunk_index")
    lap = F.when((trunk == current_trunk) & (idx < current), F.lit(1)).otherwise(F.lit(0))
    within = F.when(trunk < current_trunk, -idx).otherwise(idx)
    rows = records.where(F.col("level_id") == LEVELS.index(level)).select("record_index", (idx + 1).alias("line_number"), "message", visit_rank(trunk, current_trunk).alias("visit"), lap.alias("lap"), within.alias("within"))
    return rows.orderBy("visit", "lap", "within").limit(capacity).select("record_index", "line_number", "message", "visit", "lap")


def wrapped(records: DataFrame, keyword: str | None, width: int, focus: int) -> DataFrame:
    """Wrapped rows of records: line number on the first row only, highlights, focus."""
    text = display_text(F.col("timestamp_millis"), F.col("level"), F.col("message"))
    ranges = highlight_ranges(F.col("content"), keyword) if keyword else F.array().cast("array<struct<start:int,end:int>>")
    rows = records.select("record_index", text.alias("content")).select("record_index", ranges.alias("ranges"), F.posexplode(wrap_rows(F.col("content"), width)).alias("row", "piece"))
    return rows.select(
        "record_index", "row", F.when(F.col("row") == 0, (F.col("record_index") + 1).cast("string")).alias("line_number"), F.col("piece.content").alias("content"),
        row_highlights(F.col("ranges"), F.col("piece.start"), F.length("piece.content")).alias("highlight_ranges"), (F.col("record_index") == focus).alias("focused"),
    )


def frame_rows(records: DataFrame, keyword: str | None, width: int, focus: int, capacity: int) -> DataFrame:
    """A frame of exactly ``capacity`` rows: wrapped rows in order, cut at the capacity, and blank rows below.

    A record has a row at least, so no more than ``capacity`` records are wrapped and numbered.
    """
    from pyspark.sql import Window

    some = records.orderBy("record_index").limit(max(0, capacity))
    numbered = wrapped(some, keyword, width, focus).withColumn("frame_row", (F.row_number().over(Window.orderBy("record_index", "row")) - 1).cast("int"))
    grid = records.sparkSession.range(max(0, capacity)).select(F.col("id").cast("int").alias("frame_row"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return grid.join(numbered, "frame_row", "left").select(
        "frame_row", "record_index", "line_number", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("highlight_ranges", none).alias("highlight_ranges"), F.coalesce("focused", F.lit(False)).alias("focused")
    )


def row_counts(records: DataFrame, width: int) -> DataFrame:
    """(record_index, rows) that each record takes at a width."""
    text = display_text(F.col("timestamp_millis"), F.col("level"), F.col("message"))
    return records.select("record_index", F.size(wrap_rows(text, width)).alias("rows"))


def bottom_page(records: DataFrame, width: int, capacity: int, visible: int, total: int | None = None) -> DataFrame:
    """(record_index, rows): of the last ``visible`` records, those that are left when leading ones go until all rows fit."""
    from pyspark.sql import Window

    below = Window.orderBy(F.desc("record_index")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = row_counts(read_last_window(records, visible, total), width)  # ``visible`` rows at most
    return sized.withColumn("_upto", F.sum("rows").over(below)).where(F.col("_upto") <= capacity).drop("_upto")


def resolve_top(records: DataFrame, top: int, current: int, width: int, capacity: int, visible: int) -> int:
    """Where the viewport begins: it moves only as far as the focus would leave it, counting wrapped rows."""
    top = max(min(top, current), current + 1 - max(1, visible))
    before = sorted(row_counts(read_window(records, top, current - top), width).collect())  # fewer than ``visible`` rows
    rows = sum(r.rows for r in before)
    for r in before:
        if rows <= max(0, capacity - 1):
            break
        rows -= r.rows
        top += 1
    return top


def batch_of(trunk: Column, total: Column, workers: int) -> Column:
    """The batch, from 0, of a trunk among ``total``: contiguous groups, the first ones one longer where it doesn't come out even."""
    groups = F.least(F.lit(workers), total)
    each, more = F.floor(total / groups), total % groups
    ahead = more * (each + 1)
    return F.when(trunk < ahead, F.floor(trunk / (each + 1))).otherwise(more + F.floor((trunk - ahead) / F.greatest(each, F.lit(1)))).cast("long")


def batch_summary(records: DataFrame) -> DataFrame:
    """(batch, n, first_ts, last_ts, violation): whether a batch starts before the one before it ended. ``batch`` is a column."""
    from pyspark.sql import Window

    by = records.groupBy("batch").agg(F.count("*").alias("n"), F.min("timestamp_millis").alias("first_ts"), F.max("timestamp_millis").alias("last_ts"))
    before = F.lag("last_ts").over(Window.orderBy("batch"))  # one row a batch
    return by.withColumn("violation", F.coalesce(F.col("first_ts") < before, F.lit(False)))


def parse_viewer_command(text: str) -> tuple[str, object]:
    """(kind, argument) of ``:help``, ``:N``, ``:level`` or ``/keyword``."""
    if text.startswith("/"):
        word = text[1:].strip()
        if not word:
            raise ValueError("a search needs a keyword")
        return "search", word
    if not text.startswith(":"):
        raise ValueError(f"no such command: {text}")
    word = text[1:].strip()
    if word == "help":
        return "help", None
    if word.isdecimal():
        if int(word) < 1:
            raise ValueError("lines count from 1")
        return "jump", int(word)
    level = "ERROR" if word.upper() == "FATAL" else word.upper()
    if level not in LEVELS:
        raise ValueError(f"no such command: {text}")
    return "level", level
