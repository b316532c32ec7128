"""Chapters carried over pages that arrive in any order.

A page's chapter is known when all pages before it are there.  For each file the state is which page is awaited, the last heading before it, and the headings of pages that came too
early; nothing of their texts is kept.  When the awaited page comes, it and all that follow without a gap leave.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import detect_chapter
from ..schema import NO_CHAPTER

CARRIED = "path string, page_idx long, chapter string, complete boolean"


class Carry(StatefulProcessor):
    """Per path: the awaited page and last heading, and headings of pages that are early."""

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "page long, chapter string")
        self.early = handle.getMapState("early", "page long", "own string")

    def _where(self) -> tuple[int, str]:
        return tuple(self.at.get()) if self.at.exists() else (0, NO_CHAPTER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        path = key[0]
        awaited, chapter = self._where()
        for r in rows:
            if r.page_idx < awaited:  # after it was given up: its chapter is its own heading, or the last one before
                yield Row(path=path, page_idx=r.page_idx, chapter=r.own or chapter, complete=False)
            else:
                self.early.updateValue((r.page_idx,), (r.own,))
        while self.early.containsKey((awaited,)):
            chapter = self.early.getValue((awaited,))[0] or chapter
            self.early.removeKey((awaited,))
            yield Row(path=path, page_idx=awaited, chapter=chapter, complete=True)
            awaited += 1
        self.at.update((awaited, chapter))
        if self.patience_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if self.early.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The awaited page did not come in time: those that wait leave without it."""
        awaited, chapter = self._where()
        for page, own in sorted((k[0], v[0]) for k, v in self.early.iterator()):
            chapter = own or chapter
            yield Row(path=key[0], page_idx=page, chapter=chapter, complete=False)
            awaited = page + 1
        self.early.clear()
        self.at.update((awaited, chapter))

    def close(self) -> None:
        pass


def carry_chapters(pages: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """(path, page_idx, chapter, complete) of a stream of pages (path, page_idx from 0, text, scanned).

    A page that came once all before it had comes out with the chapter that ``blocks.carry_chapter`` gives it.  With ``patience_ms``, pages that wait
    longer for an earlier one leave with the last heading known, and ``complete`` is false for these and for pages that come after they were given up.  A page that is sent twice before it
    leaves counts once.  Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
    """
    own = F.when(~F.col("scanned"), detect_chapter(F.col("text")))
    narrow = pages.select("path", F.col("page_idx").cast("long").alias("page_idx"), own.alias("own"))
    return narrow.groupBy("path").transformWithState(Carry(patience_ms), CARRIED, "Append", "None" if patience_ms is None else "ProcessingTime")
