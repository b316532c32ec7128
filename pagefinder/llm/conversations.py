"""Conversations as a prefix trie: which beginnings they share, and what storing each only once saves.

Every prefix of a conversation has a digest.  The smallest conversation with a prefix owns its node; who owns a prefix
owns all that follows, so each conversation owns a chain of nodes from some depth to its end, found by
binary search against the minima of digests.  Chains hang on the nodes of others, and sums over subtrees are made chain by chain, bottom-up.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, scratch
from .ordering import numbered, running

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share a beginning: each group of so many ids takes up to ``SHARED`` - 1 first turns of its first one.
GROUP, SHARED = 20, 4
#: Turns of a conversation whose running sums one task makes; ids that one string of a digest has.
_RUN, _IDS = 4096, 8192


def _digest(*parts: Column) -> Column:
    """128 bits of texts, told apart by their lengths."""
    sized = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    return F.md5(F.concat(*sized))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn_md5, words): turns of each conversation numbered from 1; texts stay where they are.

    Order: turn (null first), then role, then the digest of role and text.  Null roles and texts are empty; rows without conv_id belong to no conversation.
    A conversation of any length is cut between range partitions.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.select("conv_id", "turn", "role", _digest(F.col("role"), F.col("text")).alias("turn_md5"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    placed = numbered(rows, ["conv_id", F.asc_nulls_first("turn"), "role", "turn_md5"], tag="turns")
    first = placed.groupBy("conv_id").agg(F.min("rank").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("at"), "turn_md5", "words")


def share_beginnings(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, turn_md5, words), and conversations (conv_id, length).

    Conversation c begins with the first h turns of c - c % ``group``, where h is crc32 of its number modulo ``shared``, and goes on with its own after its first h.
    """
    known = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    known = known.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = known.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = known.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    # at most ``shared`` - 1 turns of a base, for ``group`` conversations
    heads = turns.where(F.col("at") < shared).withColumnRenamed("conv_id", "base").join(convs.select("base", "conv_id", "head"), "base").where("at <= head")
    tails = turns.where(F.col("at") > 0).join(convs.select("conv_id", "h", "head"), "conv_id").where("at > h")
    rebuilt = heads.select("conv_id", F.col("at").alias("depth"), "turn_md5", "words").unionByName(tails.select("conv_id", (F.col("head") + F.col("at") - F.col("h")).alias("depth"), "turn_md5", "words"))
    return rebuilt, convs.select("conv_id", "length")


def prefix_digests(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, prefix, words): the digest of the first ``depth`` turns.

    It is the sums of four 32-bit parts of the digests of (depth, turn), so that running sums make it, a run of turns a task, however long a conversation is.
    """
    here = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_md5")))
    parts = {f"d{k}": F.conv(F.substring(here, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    hashed = materialize(rebuilt.select("conv_id", "depth", "words", *(c.alias(k) for k, c in parts.items())), "rebuilt")
    sums = running(hashed, "conv_id", F.expr(f"depth div {_RUN}"), "depth", tuple(parts))
    whole = [(F.col(f"before_{k}") + F.col(k)).cast("string") for k in parts]
    return sums.select("conv_id", "depth", F.unhex(F.md5(F.concat_ws(",", *whole))).alias("prefix"), "words")


def first_owned(prefixes: DataFrame, minima: DataFrame, convs: DataFrame, root: int) -> DataFrame:
    """(conv_id, length, first, parent): the depth from which a conversation owns its nodes, and who owns the node before.

    A conversation without nodes of its own has first = length + 1, and parent owns the node it ends in.  All conversations search at once: in each round those that are not
    settled ask for the owner of the prefix in the middle.  Rounds grow with the logarithm of the longest conversation.
    """
    state = convs.where(F.col("conv_id") != root).select("conv_id", "length", F.lit(0).cast("long").alias("low"), (F.col("length") + 1).alias("high"), F.lit(root).cast("long").alias("parent"))
    state, done = materialize(state, "search"), []
    while True:
        done.append(state.where("high - low <= 1"))
        open_ = state.where("high - low > 1")
        if open_.isEmpty():
            break
        asked = open_.withColumn("depth", F.expr("(low + high) div 2")).join(prefixes.select("conv_id", "depth", "prefix"), ["conv_id", "depth"])
        told = asked.join(minima.select("depth", "prefix", "owner"), ["depth", "prefix"])
        mine = F.col("owner") == F.col("conv_id")
        step = told.select("conv_id", "length", F.when(mine, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        state = materialize(step, "search")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("conv_id", "length", F.col("high").alias("first"), "parent").unionByName(convs.where(F.col("conv_id") == root).select("conv_id", "length", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("parent")))


def subtree_sums(chains: DataFrame, root: int, sums: tuple[str, ...]) -> DataFrame:
    """(conv_id, sums): totals over each chain and all chains that hang on it, from (conv_id, parent, sums).

    After k rounds a chain has the totals of chains fewer than 2**k steps below and points 2**k steps up; so rounds grow with the logarithm of the tree's
    height.  Chains that hang on the root's, the most usual parent, are settled without a join.
    """
    state = materialize(chains.select("conv_id", "parent", *sums), "chains")
    while not (live := state.where("parent is not null")).isEmpty():
        given = live.groupBy("parent").agg(*(F.sum(s).alias(f"_{s}") for s in sums)).withColumnRenamed("parent", "conv_id")
        up = state.where("parent is not null").select(F.col("conv_id").alias("parent"), F.col("parent").alias("_up"))
        below = live.where(F.col("parent") != root).join(up, "parent", "left").select("conv_id", F.col("_up").alias("parent"), *sums)
        rest = state.where(F.col("parent").isNull() | (F.col("parent") == root)).select("conv_id", F.lit(None).cast("long").alias("parent"), *sums)
        after = below.unionByName(rest).join(given, "conv_id", "left").select("conv_id", "parent", *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums))
        after = materialize(after, "chains")
        discard(state)
        state = after
    return state.select("conv_id", *sums)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes (conv_id, depth) that conversations ``member`` end in.

    The ids of a node are ranged over tasks and strung together there, thousands to a string; only these strings, in order, go to one task, which
    hashes them as a stream.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": key[0], "depth": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema)

        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            for c, d, m in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "member")), strict=True):
                if (c, d) != key or len(ids) == _IDS:
                    if ids:
                        yield row()
                    key, ids = (c, d), []
                ids.append(m)
        if ids:
            yield row()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        names = ["conv_id", "depth", "ends_sha256"]
        for batch in batches:
            for c, d, ids in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "ids")), strict=True):
                if (c, d) == key:
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (c, d), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out])
                out = []
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, sha.hexdigest()), strict=True))])

    spread = ends.repartitionByRange(partitions(ends.sparkSession), "conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    strung = spread.select("conv_id", "depth", "member").mapInArrow(strings, "conv_id long, depth long, first long, ids string")
    dealt = strung.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return dealt.select("conv_id", "depth", "ids").mapInArrow(hashes, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations of (conv_id, turn, role, text).

    conv_id (smallest member) and depth tell nodes apart; parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 say what is at the node and below it.
    Repeated rows are turns of their own; empty and null texts are turns without words; very long ones are read once and leave a digest.  Rows without conv_id
    are no conversation's, other columns are not read, and an empty table has no node.  What moves is digests and numbers, never texts.
    """
    spark = conversations.sparkSession
    with scratch() as keep:
        turns = materialize(ordered_turns(conversations), "ordered")
        rebuilt, convs = share_beginnings(turns, group, shared)
        root = convs.agg(F.min("conv_id")).first()[0]
        if root is None:
            return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
        prefixes = materialize(prefix_digests(rebuilt), "prefixes")
        minima = materialize(prefixes.groupBy("depth", "prefix").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "minima")
        found = materialize(first_owned(prefixes, minima, convs, root), "owned")
        chains = found.where("first <= length")
        top = convs.agg(F.lit(root).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words"))
        nodes = minima.select("owner", "depth", "n_convs", "words").unionByName(top)
        attached = chains.where("parent is not null").groupBy(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n_attached"))
        own = nodes.join(attached, ["owner", "depth"], "left").join(chains.select(F.col("conv_id").alias("owner"), "length", "first", "parent"), "owner")
        last, attached_here = F.col("depth") == F.col("length"), F.coalesce("n_attached", F.lit(0))
        own = own.select("owner", "depth", "parent", "first", "n_convs", (attached_here + (~last).cast("long")).alias("n_children"), (last & (attached_here == 0)).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
        own = materialize(own, "nodes")
        sums = own.groupBy(F.col("owner").alias("conv_id")).agg(F.max("parent").alias("parent"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        totals = subtree_sums(sums, root, ("leaf", "saved"))
        hung = totals.join(chains.where("parent is not null").select("conv_id", F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")), "conv_id")
        hung = hung.groupBy("owner", "depth").agg(F.sum("leaf").alias("hung_leaf"), F.sum("saved").alias("hung_saved"))
        local = own.join(hung, ["owner", "depth"], "left").withColumns({k: F.col(k) + F.coalesce(f"hung_{k}", F.lit(0)) for k in ("leaf", "saved")}).drop("hung_leaf", "hung_saved")
        below = running(materialize(local, "local"), "owner", F.expr(f"depth div {_RUN}"), "depth", ("leaf", "saved"), backwards=True)
        # a conversation ends in its own chain's last node, or in the node where the search ended
        ends = found.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
        parent = F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent"))
        out = below.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaf") + F.col("before_leaf")).alias("n_leaves"), (F.col("saved") + F.col("before_saved")).alias("saved_tokens"))
        out = out.join(ends_digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
        return keep(out, "trie")


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Prefixes are keyed by chained digests; every node is joined with all its ancestors.
ORACLE_SQL = rf"""WITH RECURSIVE step AS (SELECT range AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM step WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || octet_length(encode(coalesce(text, ''))) || ':' || coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, own, xor(list_reduce(list_transform(range(0, length(CAST(conv_id AS VARCHAR)) + 1), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE CAST(ord(substring(CAST(conv_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT) END),
  lambda c, x: xor(c >> 8, entries[xor(c & 255, x) + 1])), 4294967295) % {SHARED} AS h FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id), crc),
cv AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS head, least(c.h, coalesce(b.own, 0)) + greatest(c.own - c.h, 0) AS length FROM c LEFT JOIN c b ON c.base = b.conv_id),
r AS (SELECT cv.conv_id, pos AS depth, role, text FROM cv JOIN t ON t.conv_id = cv.base AND pos <= head UNION ALL SELECT cv.conv_id, head + pos - h, role, text FROM cv JOIN t USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS k, '' AS up, CAST(0 AS BIGINT) AS w FROM cv UNION ALL
  SELECT p.conv_id, r.depth, sha256(p.k || octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text), p.k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
n AS (SELECT depth, k, max(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w FROM p GROUP BY depth, k),
ch AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth - 1, up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (depth, k)),
anc AS (SELECT depth, k, up, depth AS adepth, k AS ak, up AS aup FROM m UNION ALL SELECT anc.depth, anc.k, anc.up, n.depth, n.k, n.up FROM anc JOIN n ON n.depth = anc.adepth - 1 AND n.k = anc.aup WHERE anc.adepth > 0),
s AS (SELECT adepth AS depth, ak AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM anc JOIN m USING (depth, k) GROUP BY adepth, ak),
e AS (SELECT p.depth, p.k, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends FROM p JOIN cv ON p.conv_id = cv.conv_id AND p.depth = cv.length GROUP BY p.depth, p.k)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN s USING (depth, k) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.k = m.up LEFT JOIN e ON e.depth = m.depth AND e.k = m.k"""


def brute_force(rows: list[tuple], group: int = GROUP, shared: int = SHARED) -> dict[tuple[int, int], tuple]:
    """(conv_id, depth) -> (parent, n_convs, n_children, n_leaves, saved, ends) of (conv_id, turn, role, text), in plain Python."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role.encode())}:{role}{len(text.encode())}:{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, role.encode(), md5), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    full = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % shared
        full[c] = tuple(own.get(c - c % group, [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    words = lambda t: len([w for w in t.translate({i: " " for i in (*range(9, 14), 32)}).split(" ") if w])
    value = {n: (len(members[n]) - 1) * (words(n[-1][1]) if n else 0) for n in members}
    out = {}
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(full[c]) == len(node))
        out[m[0], len(node)] = (members[node[:-1]][0] if node else None, len(m), kids[node], sum(not kids[n] for n in below[node]), sum(value[n] for n in below[node]), hashlib.sha256(ends.encode()).hexdigest())
    return out
