"""A reader's session over a log: searching and filtering trunk by trunk outward, with progress and cancelling.

The order of trunks is the session's, the scanning Spark's: trunks are read in waves that grow, one job a
wave, which returns one number or a few a trunk. A callback sees each trunk's progress in order
and may cancel after any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trunkline.functions.text import display_text, wrap_rows
from trunkline.operators.browse import matches
from trunkline.schema import LEVELS

FIRST_WAVE, LAST_WAVE = 8, 4096


class Cancelled(Exception):
    pass


@dataclass(frozen=True)
class Progress:
    scanned: int
    total: int
    position: int  # of the trunk just scanned, from 1

    @property
    def percent(self) -> int:
        return 100 if not self.total else self.scanned * 100 // self.total


Report = Callable[[Progress], bool | None]  # False cancels


def outward(current: int, total: int) -> Iterator[int]:
    """The current trunk, then ahead and behind in turn."""
    if total:
        yield current
    for away in range(1, total):
        if current + away < total:
            yield current + away
        if current - away >= 0:
            yield current - away


def waves(order: Iterator[int]) -> Iterator[list[int]]:
    size, held = FIRST_WAVE, []
    for trunk in order:
        held.append(trunk)
        if len(held) == size:
            yield held
            size, held = min(2 * size, LAST_WAVE), []
    if held:
        yield held


@dataclass
class Search:
    keyword: str
    origin: int
    order: Iterator[list[int]]  # waves of trunks outward
    hits: dict[int, list[int]] = field(default_factory=dict)  # trunk to its matches
    waiting: list[int] = field(default_factory=list)  # trunks of the present wave that are read but not passed
    read: dict[int, list[int]] = field(default_factory=dict)

    @property
    def ordered(self) -> list[int]:
        return sorted(i for found in self.hits.values() for i in found)


class Session:
    """``records`` (record_index, trunk_index, timestamp_millis, level, level_id, message) in ``trunks`` trunks."""

    def __init__(self, records: DataFrame, trunks: int, current: int = 0, current_trunk: int = 0) -> None:
        self.records, self.trunks, self.current, self.current_trunk = records, trunks, current, current_trunk
        self.active: Search | None = None
        self.level: str | None = None

    def _advance(self, search: Search, report: Report | None) -> list[int]:
        """Scan on to the next trunk with matches, and return them; none: all trunks are scanned."""
        while True:
            if not search.waiting:
                wave = next(search.order, [])
                if not wave:
                    return []
                found = matches(self.records.where(F.col("trunk_index").isin(wave)), search.keyword).select("trunk_index", "record_index").collect()
                search.waiting, search.read = wave, {}
                for r in found:
                    search.read.setdefault(r.trunk_index, []).append(r.record_index)
            trunk = search.waiting.pop(0)
            search.hits[trunk] = sorted(search.read.pop(trunk, []))
            if report and report(Progress(len(search.hits), self.trunks, trunk + 1)) is False:
                self.clear_search()
                raise Cancelled("the search was cancelled")
            if search.hits[trunk]:
                return search.hits[trunk]

    def search(self, keyword: str, report: Report | None = None) -> int:
        """Start a search and go to its first target; returns the matches found so far."""
        keyword = keyword.strip()
        if not keyword:
            raise ValueError("a search needs a keyword")
        self.active = None
        search = Search(keyword, self.current_trunk, waves(outward(self.current_trunk, self.trunks)))
        found = self._advance(search, report)
        if not found:
            raise ValueError(f"keyword not found: {keyword}")
        self.active = search
        trunk = max((t for t in search.hits if search.hits[t] == found))
        if trunk == self.current_trunk:
            after, before = [i for i in found if i > self.current], [i for i in found if i < self.current]
            target = after[0] if after else before[-1] if before else found[0]
        else:
            target = found[0] if trunk > self.current_trunk else found[-1]
        self.current = target
        return len(search.ordered)

    def step(self, ahead: bool, report: Report | None = None) -> int:
        """Go to the next match, or the one before: among those found, then scanning on, then around."""
        if self.active is None:
            raise ValueError("no search is active")
        beyond = lambda: [i for i in self.active.ordered if (i > self.current if ahead else i < self.current)]
        while not beyond() and self._advance(self.active, report):
            pass
        some = beyond() or self.active.ordered
        self.current = some[0] if ahead else some[-1]
        return self.current

    def clear_search(self) -> None:
        self.active = None

    def filter_level(self, level: str, width: int, capacity: int, report: Report | None = None) -> list[Progress]:
        """Scan outward until the level's wrapped rows fill the view, then show only that level; the progress made."""
        rows = F.size(wrap_rows(display_text(F.col("timestamp_millis"), F.col("level"), F.col("message")), width))
        done, filled = [], 0
        for wave in waves(outward(self.current_trunk, self.trunks)):
            of = self.records.where(F.col("trunk_index").isin(wave) & (F.col("level_id") == LEVELS.index(level)))
            got = {r.trunk_index: r.n for r in of.groupBy("trunk_index").agg(F.sum(rows).alias("n")).collect()}
            for trunk in wave:
                filled += got.get(trunk, 0)
                done.append(Progress(len(done) + 1, self.trunks, trunk + 1))
                if report and report(done[-1]) is False:
                    raise Cancelled("the filter was cancelled")
                if filled >= capacity:
                    break
            if filled >= capacity:
                break
        self.level = level
        return done

    def clear_filter(self) -> None:
        self.level = None
