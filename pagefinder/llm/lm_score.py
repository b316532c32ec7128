"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model (``ORDER`` 3 unless told otherwise) with Dirichlet smoothing: after a context h

    p(w | h) = (c(h w) + PRIOR * p(w | h')) / (c(h) + PRIOR),  h' being h without its first word,

down to the root, p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).  As an automaton: every context seen in training is a
state; a seen n-gram is an arc out of its context's state with weight log p(w | h); a word without an arc
takes the failure arc to the state of h', which weighs log(PRIOR / (c(h) + PRIOR)), and so on down to the root,
which has an arc for every word.  A text is one walk from left to right: the state carries the words
just read, and the weights of all arcs taken are summed.

Both training and scoring cover all texts, and no table of the whole model is ever in one place.
Texts are dealt into chunks.  A chunk asks for the counts of just the n-grams that its texts hold, which are all
the states and arcs they can reach; requests carry the chunk's training counts, so one shuffle both
sums counts over the corpus and answers them.  N-grams go to parts by their hash, so parts are even
whatever words are frequent, and there are as many parts as chunks: what a task holds stays the same
as the corpus grows.  What is gathered grows with the corpus.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket5, materialize, only_cache, partitions

ORDER = 3
#: How many imagined observations of the shorter context's distribution stand beside the real ones (of 1, 2, 4, ... 32
#: the last gave held-out texts of the sf0.1 table the best score, -3.72 a token; unigrams -4.19, bigrams -3.87).
PRIOR = 32.0
#: Tokens after which a chunk is closed; a longer text has a chunk of its own.
CHUNK_TOKENS = 1_500_000
#: Tokens of a walk, and walks that are made side by side.
WALK, WALKS = 256, 1024
#: Bits of its hash that an n-gram of several words is told by: 56, as requests are mostly these; words have all 64.
KEPT = np.uint64(0xFFFFFFFFFFFFFF00)
#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space is x20 and x09-x0D, which is what bytes.split() takes.
END, START = b"\n", b"\n\n"  # no word holds white space


def _zip(*arrays: np.ndarray) -> bytes:
    parts = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def _unzip(data: bytes, *types: str) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(types)}Q", data), 8 * len(types), []
    for n, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + n]), t))
        at += n
    return out


def _zip_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as steps, by bytes of equal weight: the high ones are zeros and vanish."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _zip(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unzip_keys(data: bytes) -> np.ndarray:
    planes = _unzip(data, "u1")[0].reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Chunk:
    """Texts as tokens, each text after its start and with its end, and the n-grams they hold."""

    begins: np.ndarray  # of each text: the place of its start
    token: np.ndarray  # places of tokens (all but the starts)
    keys: np.ndarray  # distinct n-grams of 1 to ``order`` words, and the start, ascending
    grams: list[np.ndarray]  # by order - 1 and place: the n-gram ending there (index into keys), -1 if a text is too short
    words: np.ndarray  # of each key: whether it is a single word

    @classmethod
    def build(cls, texts: list[bytes], order: int) -> Chunk:
        vocabulary = {START: 0, END: 1}
        tokens: list[int] = []
        begins = []
        fresh = vocabulary.setdefault
        for t in texts:
            begins.append(len(tokens))
            tokens.append(0)
            tokens += [fresh(w, len(vocabulary)) for w in t.translate(LOWER).split()]
            tokens.append(1)
        a = np.array(tokens, dtype=np.int64)
        del tokens
        word = _mixed(np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64))
        begin = np.array(begins, dtype=np.int64)
        depth = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        h, all_keys, valid = word[a], [], []
        for k in range(order):
            if k:
                h = _mixed(np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + word[a] + np.uint64(k))
            valid.append(np.flatnonzero(depth >= k))
            all_keys.append(h[valid[k]] & KEPT if k else h)
        keys, at = np.unique(np.concatenate(all_keys), return_inverse=True)
        grams, done = [], 0
        for v in valid:
            g = np.full(len(a), -1, np.int32)
            g[v] = at[done : done + len(v)]
            done += len(v)
            grams.append(g)
        single = np.zeros(len(keys), bool)
        single[grams[0][a > 0]] = True
        return cls(begin, np.flatnonzero(a), keys, grams, single)

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in the texts to learn from."""
        use = np.repeat(learn, np.diff(np.append(self.begins, len(self.grams[0]))))
        return sum(np.bincount(g[use & (g >= 0)], minlength=len(self.keys)) for g in self.grams)

    def cuts(self, parts: int) -> np.ndarray:
        """Where each part's keys begin: parts are equal ranges of the hash."""
        borders = np.array([-(-(p << 64) // parts) for p in range(1, parts)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, borders), [len(self.keys)]])

    def requests(self, learn: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        """For each part: the keys asked for, and which are words and the counts to be added."""
        n, cut = self.counts(learn), self.cuts(parts)
        for q in range(parts):
            i, j = int(cut[q]), int(cut[q + 1])
            if j > i:
                yield q, _zip_keys(self.keys[i:j]), _zip(np.packbits(self.words[i:j]), n[i:j].astype("<u4"))

    def automaton(self, answers: dict[int, bytes], tokens: int, kinds: int, prior: float) -> Automaton:
        count = np.concatenate([np.zeros(0, np.int64), *(_unzip(answers[q], "<i8")[0] for q in sorted(answers))])
        return Automaton.build(self, count, tokens, kinds, prior)


@dataclass
class Automaton:
    """States and arcs that a chunk's texts can take.

    A state is a context, named by its n-gram (an index into the chunk's keys), or the root; it exists if the context was seen.  An arc is named by the n-gram
    that it completes, and exists if that was seen; arcs of the root exist for every word.
    """

    count: np.ndarray  # of each n-gram
    fail: np.ndarray  # of each state: the state without its first word, -1 for the root
    fail_weight: np.ndarray  # of each state: what its failure arc weighs
    arc_weight: np.ndarray  # of each arc: the logarithm of the word's probability in its state

    @classmethod
    def build(cls, chunk: Chunk, count: np.ndarray, tokens: int, kinds: int, prior: float) -> Automaton:
        """Weights of arcs from the root up: a longer context's probability leans on that of the shorter one."""
        fail, state = np.full(len(count), -1, np.int32), np.zeros(len(count), np.int32)
        p = (count + 0.5) / (tokens + 0.5 * (kinds + 1))
        for k in range(1, len(chunk.grams)):
            at = np.flatnonzero(chunk.grams[k] >= 0)
            gram = chunk.grams[k][at]
            fail[gram], state[gram] = chunk.grams[k - 1][at], chunk.grams[k - 1][at - 1]
            mine = np.zeros(len(count), bool)
            mine[gram] = True
            gram = np.flatnonzero(mine)
            p[gram] = (count[gram] + prior * p[fail[gram]]) / (count[state[gram]] + prior)
        return cls(count, fail, np.log10(prior / (count + prior)), np.log10(p, out=p))

    def start(self, chunk: Chunk, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states (and their lengths) after the words up to some places: the longest contexts that exist."""
        state, size = np.full(len(place), -1, np.int64), np.zeros(len(place), np.int64)
        for k in range(len(chunk.grams) - 1):
            gram = chunk.grams[k][place]
            seen = (gram >= 0) & (self.count[gram] > 0) & (size == k)
            state[seen], size[seen] = gram[seen], k + 1
        return state, size

    def walk(self, chunk: Chunk) -> np.ndarray:
        """Of each token: the summed weights of the arcs taken at it.

        Every walk carries a state from token to token.  Walks go side by side, a token of each at a time; a long text is several walks of ``WALK`` tokens, each of which
        begins in the state that the one before ends in.
        """
        here = chunk.token
        text = np.searchsorted(chunk.begins, here, "right") - 1
        nth = here - chunk.begins[text] - 1
        lead = np.flatnonzero(nth % WALK == 0)  # the first token of each walk
        ends = np.append(lead, len(here))
        weight = np.zeros(len(here))
        for i in range(0, len(lead), WALKS):  # so many walks side by side
            self._side_by_side(chunk, lead[i : i + WALKS], np.diff(ends[i : i + WALKS + 1]), weight)
        return weight

    def _side_by_side(self, chunk: Chunk, lead: np.ndarray, left: np.ndarray, weight: np.ndarray) -> None:
        """Adds the weights of some walks, given by their first tokens and lengths.

        A state is the n-gram of ``size`` words that ends before the token; its arc is the n-gram one word longer that ends at it, and its failure arc leads to the state
        one word shorter.  What these weigh is looked up for all places of the walks at once.
        """
        here, order = chunk.token, len(chunk.grams)
        base = here[lead[0]] - 1
        places = slice(base, here[lead[-1] + left[-1] - 1] + 1)
        grams = [g[places] for g in chunk.grams]
        seen = np.stack([(g >= 0) & (self.count[g] > 0) for g in grams])
        arc = np.stack([self.arc_weight[g] for g in grams])
        failing = np.stack([self.fail_weight[g] for g in grams])
        size = self.start(chunk, here[lead] - 1)[1]
        longest_first = np.argsort(-left, kind="stable")
        lead, left, size = lead[longest_first], left[longest_first], size[longest_first]
        for step in range(int(left[0])):
            n = int(np.searchsorted(-left, -step, "left"))  # walks that have a token left
            token, size = lead[:n] + step, size[:n]
            place = here[token] - base
            spent = np.zeros(n)
            for _ in range(order - 1):  # along failure arcs until there is an arc for the word
                stuck = np.flatnonzero((size > 0) & ~seen[size, place])
                if not len(stuck):
                    break
                spent[stuck] += failing[size[stuck] - 1, place[stuck] - 1]
                size[stuck] -= 1
            weight[token] = spent + arc[size, place]
            # on to the context that the arc completes; a word that was never seen leads to the root
            size = np.minimum(size + 1, order - 1)
            size = np.where((size > 0) & seen[size - 1, place], size, 0)

    def traverse(self, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """By text: tokens, known tokens, summed root weights, summed weights of the arcs taken."""
        here = chunk.token
        word = chunk.grams[0][here]
        first = np.searchsorted(here, chunk.begins)
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return add(np.ones(len(here), np.int64)), add((self.count[word] > 0).astype(np.int64)), add(self.arc_weight[word]), add(self.walk(chunk))


def _answer(table: pa.Table) -> pa.Table:
    """Sums the requests to one part of the model, and answers each chunk in the order it asked."""
    chunks = table.column("chunk").to_pylist()
    keys = [_unzip_keys(x) for x in table.column("keys").to_pylist()]
    told = [_unzip(x, "u1", "<u4") for x in table.column("told").to_pylist()]
    kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([x[1] for x in told]), len(kinds)).astype(np.int64)
    single = np.zeros(len(kinds), bool)
    rows, end = [], 0
    for name, k, x in zip(chunks, keys, told, strict=True):
        begin, end = end, end + len(k)
        single[at[begin:end][np.unpackbits(x[0], count=len(k)).astype(bool)]] = True
        rows.append((name, _zip(total[at[begin:end]].astype("<i8")), 0, 0))
    rows.append(("", b"", int(total[single].sum()), int((total[single] > 0).sum())))
    c = list(zip(*rows, strict=True))
    q = table.column("q")[0].as_py()
    return pa.table({"chunk": pa.array(c[0], pa.string()), "q": pa.array([q] * len(rows), pa.int32()), "data": pa.array(c[1], pa.binary()), "tokens": pa.array(c[2], pa.int64()), "kinds": pa.array(c[3], pa.int64())})


def _chunks(docs: DataFrame, learn: Column, chunk_tokens: int) -> DataFrame:
    """(chunk, data, about): runs of a task's texts, compressed, and their ids, roles and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        held: list[tuple[int | None, bytes, bool]] = []
        size = made = 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            ids, texts, use = zip(*held, strict=True)
            name, held, size, made = f"{task}-{made}", [], 0, made + 1
            lengths = np.array([len(t) for t in texts], "<i8")
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            about = _zip(np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array(use, "u1"), lengths)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed], pa.binary()), pa.array([about], pa.binary())], names=["chunk", "data", "about"])

        for batch in batches:
            for doc, text, use in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                raw = (text or "").encode()
                n = len(raw) // 6 + 1
                if held and size + n > chunk_tokens:
                    yield flush()
                held.append((doc, raw, use))
                size += n
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(run, "chunk string, data binary, about binary")


def _opened(data: bytes, about: bytes, order: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, and ids, which of them are missing, and roles of its texts."""
    ids, none, use, lengths = _unzip(about, "<i8", "u1", "u1", "<i8")
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(lengths.sum()))
    ends = np.cumsum(lengths)
    chunk = Chunk.build([raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], order)
    return chunk, ids, none.astype(bool), use.astype(bool)


def score(docs: DataFrame, learn: Column | None = None, order: int = ORDER, prior: float = PRIOR, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score), a row a row of ``docs``.

    ``learn``: which rows the model is learnt from (default: all); null counts as no.  Words are runs
    without ASCII white space after lower-casing A-Z; each text has one end token, so null and
    empty texts have a score too.  base_score is the unigram's (root arcs only).  With no
    training rows every word has the same weight.  Copies and rows of equal or null doc_id are scored and
    learnt each; a text of any length is one chunk at most; other columns are not looked at.
    """
    if order < 1:
        raise ValueError("order is 1 at least")
    chunks = materialize(_chunks(docs, F.lit(True) if learn is None else learn, chunk_tokens), "chunks")
    parts = max(partitions(docs.sparkSession), chunks.count())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, about in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                chunk, _, _, use = _opened(data, about, order)
                q, keys, told = zip(*chunk.requests(use, parts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(q)), pa.array(q, pa.int32()), pa.array(keys, pa.binary()), pa.array(told, pa.binary())], names=["chunk", "q", "keys", "told"])

    asked = chunks.mapInArrow(ask, "chunk string, q int, keys binary, told binary")
    answers = materialize(asked.groupBy("q").applyInArrow(_answer, "chunk string, q int, data binary, tokens long, kinds long"), "answers")
    total = answers.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = total.tokens or 0, total.kinds or 0

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        by_part = dict(zip(right.column("q").to_pylist(), right.column("data").to_pylist(), strict=True))
        for data, about in zip(left.column("data").to_pylist(), left.column("about").to_pylist(), strict=True):
            chunk, ids, none, use = _opened(data, about, order)
            n, known, base, s = chunk.automaton(by_part, tokens, kinds, prior).traverse(chunk)
            for o, x in zip(out, (pa.array(ids, mask=none), use, n, known, np.full(len(n), tokens), base, s), strict=True):
                o.append(pa.array(x))
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "learnt", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table({k: pa.chunked_array(o, t) for k, o, t in zip(names, out, types, strict=True)})

    both = chunks.groupBy("chunk").cogroup(answers.where("chunk <> ''").select("chunk", "q", "data").groupBy("chunk"))
    return both.applyInArrow(traverse, "doc_id long, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), bucket5() != 1)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute_force(docs: list[tuple[int, str | None]], order: int = ORDER, prior: float = PRIOR) -> dict[int, tuple]:
    """The contract and the model's formula, token by token, for tests."""
    import math
    from collections import Counter

    cut = lambda t: [START, *(t or "").encode().translate(LOWER).split(), END]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    count: Counter[tuple[bytes, ...]] = Counter()
    for d, t in docs:
        if not held[d]:
            ws = cut(t)
            count.update(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    words = {g[0]: n for g, n in count.items() if len(g) == 1 and g[0] != START}
    total, kinds = sum(words.values()), len(words)

    def p(w: bytes, h: tuple[bytes, ...]) -> float:
        if not h:
            return (words.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))
        return (count[(*h, w)] + prior * p(w, h[1:])) / (count[h] + prior)

    out = {}
    for d, t in docs:
        ws = cut(t)
        at = range(1, len(ws))
        base = sum(math.log10(p(ws[i], ())) for i in at)
        s = sum(math.log10(p(ws[i], tuple(ws[max(0, i - order + 1) : i]))) for i in at)
        out[d] = (held[d], len(ws) - 1, sum(words.get(ws[i], 0) > 0 for i in at), total, base, s)
    return out
