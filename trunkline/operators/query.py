"""Log queries compiled to one predicate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trunkline.functions.text import display_text
from trunkline.schema import LEVELS


@dataclass(frozen=True)
class LogQuery:
    """Conjunction of inclusive time bounds, a minimum level and a substring of the message; None doesn't filter."""

    start: int | None = None
    end: int | None = None
    minimum_level: str | None = None
    keyword: str | None = None

    def predicate(self) -> Column:
        parts = []
        if self.start is not None:
            parts.append(F.col("timestamp_millis") >= self.start)
        if self.end is not None:
            parts.append(F.col("timestamp_millis") <= self.end)
        if self.minimum_level is not None:
            parts.append(F.col("level_id") >= LEVELS.index(self.minimum_level))
        if self.keyword:
            parts.append(F.contains(F.col("message"), F.lit(self.keyword)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_query(records: DataFrame, query: LogQuery | None) -> DataFrame:
    return records if query is None else records.where(query.predicate())


def filter_exact_level(records: DataFrame, level: str) -> DataFrame:
    return records.where(F.col("level_id") == LEVELS.index(level))


def search_display(records: DataFrame, keyword: str) -> DataFrame:
    """Records whose display text holds the trimmed keyword."""
    keyword = keyword.strip()
    if not keyword:
        raise ValueError("a search needs a keyword")
    return records.where(F.contains(display_text(F.col("timestamp_millis"), F.col("level"), F.col("message")), F.lit(keyword)))


def filter_thresholds(records: DataFrame, root: str, appenders: dict[str, str]) -> DataFrame:
    """A row for each appender that takes the record; ``appenders`` maps names to their levels (configuration, a handful)."""
    takes = F.array_compact(F.array(*[F.when(F.col("level_id") >= LEVELS.index(level), F.lit(name)) for name, level in sorted(appenders.items())]))
    return records.where(F.col("level_id") >= LEVELS.index(root)).withColumn("appender", F.explode(takes))
