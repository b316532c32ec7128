"""Many queries at once, given as a table.

Queries are dealt into blocks of bounded size.  Each block's keywords make one automaton with failure and output links, sent to all tasks, and one
pass over the texts counts all of them; scores go by query, and are ranked like those of one query.  Plans depend on the number of
blocks, not of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import keywords_column
from .locate import MOST_RESULTS, _place, _ranked

#: Characters of the keywords of a block of queries: what one automaton holds.
BLOCK_CHARS = 1 << 19
#: Texts whose scores are looked at together, and files whose best scores a task remembers.
_TEXTS, _FILES = 128, 1000


class Keywords:
    """Counts keywords in texts, each from left to right without overlaps, in one pass over a text."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.links = ahocorasick.Automaton()
        for k, w in enumerate(words):
            self.links.add_word(w, (k, len(w)))
        self.links.make_automaton()
        self.n = len(words)

    def counts(self, text: str) -> np.ndarray:
        found = [0] * self.n
        free = [0] * self.n  # where the next occurrence of a word may begin
        for end, (k, size) in self.links.iter(text):
            if end - size + 1 >= free[k]:
                found[k] += 1
                free[k] = end + 1
        return np.array(found)


def query_blocks(queries: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """(query_id, words) of queries with keywords, in blocks of about so many characters; dealt by hash, so none depends on the order."""
    known = queries.select("query_id", keywords_column(F.coalesce("query", F.lit(""))).alias("words")).where(F.size("words") > 0)
    size = known.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))).first()[0] or 0
    n = -(-size // block_chars)
    return [known.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]


def locate_table(blocks: DataFrame, queries: DataFrame, limit: int = MOST_RESULTS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(query_id, result_rank, file, page, score, block_ord) for each row of ``queries`` (query_id, query), as ``locate`` finds it.

    A block of queries is on the driver and in each task as words, about ``block_chars`` characters; all its queries are scored in one pass over the blocks' texts.  A task lets go on what may be in a result by what it
    has seen itself, so that few scores of the many that a frequent word has are shuffled, and no text.  Queries without keywords find nothing; query_ids should be unique.
    """
    place = _place(blocks)
    found = [_scores(blocks.where("text <> ''").select("file", "page", *place, "text"), part.collect(), limit) for part in query_blocks(queries, block_chars)]
    kind = queries.schema["query_id"].dataType.simpleString()
    if not found:
        none = blocks.where("false").select(F.lit(None).cast(kind).alias("query_id"), F.lit(0).alias("result_rank"), "file", "page", F.lit(0).cast("long").alias("score"), *place)
        return none
    hits = reduce(DataFrame.unionByName, found).withColumn("query_id", F.col("query_id").cast(kind))
    order = Window.partitionBy("query_id").orderBy(F.col("rank_in_file") > 1, F.desc("score"), *place)
    out = _ranked(hits, ["query_id"], limit).withColumn("result_rank", F.row_number().over(order)).where(F.col("result_rank") <= limit)
    return out.select("query_id", "result_rank", "file", "page", "score", *place)


class Best:
    """What a task has seen so far of each query: its highest scores, and the best of each file.

    A text can only be in a query's result as the best of its file, or if fewer than ``limit`` texts have higher scores.
    """

    def __init__(self, queries: int, limit: int):
        self.top = np.zeros((queries, limit), np.int32)
        self.files: dict[str | None, np.ndarray] = {}

    def may_rank(self, files: list[str | None], scores: np.ndarray) -> np.ndarray:
        """Which of some texts' scores (a row a text, a column a query) can be in a result; equal ones can, by their places."""
        limit = self.top.shape[1]
        self.top = np.partition(np.concatenate([self.top, scores.T.astype(np.int32)], axis=1), len(scores), axis=1)[:, -limit:]
        if len(self.files) > _FILES:
            self.files.clear()  # more rows than needed go on then, none is lost
        names, of = np.unique([str(f) for f in files], return_inverse=True)
        best = np.stack([np.maximum(self.files.get(n, 0), scores[of == k].max(axis=0)) for k, n in enumerate(names)])
        self.files.update(zip(names.tolist(), best, strict=True))
        return (scores > 0) & ((scores >= self.top.min(axis=1)) | (scores >= best[of]))


def _scores(texts: DataFrame, queries: list, limit: int) -> DataFrame:
    """(the texts' columns, query_id, score) of texts that may be in a result of a block of queries."""
    words = sorted({w for q in queries for w in q.words})
    number = {w: k for k, w in enumerate(words)}
    ids = [q.query_id for q in queries]
    # words of each query, one after another
    of = np.array([number[w] for q in queries for w in q.words])
    first = np.cumsum([0, *(len(q.words) for q in queries)])[:-1]
    columns = [c for c in texts.columns if c != "text"]
    kind = pa.array(ids).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = Keywords(words), Best(len(ids), limit)
        for batch in batches:
            for begin in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(begin, _TEXTS)
                scores = np.stack([np.add.reduceat(known.counts(t.as_py())[of], first) for t in part.column("text")])
                row, query = np.nonzero(best.may_rank(part.column("file").to_pylist(), scores))
                at, who = pa.array(row), pa.array(ids, kind).take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in columns), who, pa.array(scores[row, query].astype(np.int64))], [*columns, "query_id", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text"]
    id_kind = "string" if pa.types.is_string(kind) else "long"
    return texts.mapInArrow(run, ", ".join([*fields, f"query_id {id_kind}", "score long"]))
