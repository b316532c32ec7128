"""Named queries over the driver's tables, and the same in SQL.

``documents`` stand for blocks: file = source, page = place in the source by doc_id; every query reads all
rows and whole texts.  What documents have no column for (producers, images, times of change) is derived
from doc_id alike in both engines; short, garbled and scanned cases are in the tests' fixtures.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keywords import keywords_column
from ..operators import blocks as B
from ..operators import cache, config, locate, ocr, polish, query_table, report, substring_index
from ..schema import NO_CHAPTER
from ..sources.shared import delete, shared_folder

QUERY = "the and that"
WORDS = ["the", "and", "that"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks with their texts; every fifth is a scan."""
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    text = F.coalesce("text", F.lit(""))
    d = documents(spark, sf_dir)
    return d.select(F.col("source").alias("file"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), page.alias("page"), F.lit(NO_CHAPTER).alias("chapter"), text.alias("text"), (F.col("doc_id") % 5 == 0).alias("scanned"), F.col("doc_id").alias("block_ord"))


def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks with their texts; page is the doc_id, so that no window is needed."""
    d = documents(spark, sf_dir)
    return d.select(F.col("source").alias("file"), F.col("doc_id").alias("page"), F.lit(NO_CHAPTER).alias("chapter"), "text", F.col("doc_id").alias("block_ord"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs, every fifth under a heading mark."""
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.concat(F.lit("第"), (F.col("pos") + 1).cast("string"), F.lit("章 "), F.col("line"))
    return d.select("doc_id", "pos", F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, head).otherwise(F.col("line")).alias("text"))


SQL_LINES = """l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
lines AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 5 = 0 THEN '第' || (pos + 1) || '章 ' || line ELSE line END AS text FROM l0)"""
SQL_BLOCKS = f"""blocks AS (SELECT source AS file, source || '/' || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, '{NO_CHAPTER}' AS chapter, coalesce(text, '') AS text, doc_id % 5 = 0 AS scanned, doc_id AS block_ord FROM documents)"""
_blank, _numeral = r"[\s\x1c-\x1f]", "[一二三四五六七八九十百千零0-9]"


def sql_strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_blank}+|{_blank}+$', '', 'g')"


def sql_first_line(t: str) -> str:
    return sql_strip(rf"regexp_extract({t}, '^{_blank}*([^\n\r]*)', 1)")


def sql_chapter(t: str) -> str:
    line = sql_first_line(t)
    tests = (rf"^\s*第\s*{_numeral}+\s*[章节節条].*", r"^\s*[一二三四五六七八九十]+\s*[、.\s].{0,40}$", r"^\s*\d+(\.\d+)*\s+\S.{0,40}$")
    return f"CASE WHEN {' OR '.join(f'''regexp_matches({line}, '{x}')''' for x in tests)} THEN substring({line}, 1, 60) END"


def sql_count(t: str, word: str) -> str:
    return f"((length({t}) - length(replace({t}, '{word}', ''))) // {len(word)})"


def sql_score(t: str, words: list[str]) -> str:
    return "CAST(" + " + ".join(sql_count(t, w) for w in words) + " AS BIGINT)"


def sql_garbled(t: str) -> str:
    return rf"""(length({sql_strip(t)}) >= 20 AND length(regexp_replace({t}, '[^\p{{L}}\p{{N}}，。、；："（）《》【】—…· \t\n]', '', 'g')) / length({t}) < 0.25)"""


SQL_RANKED = f"""hits AS (SELECT source AS file, doc_id AS page, substring(text, 1, 600) AS snippet, {sql_score("text", WORDS)} AS score, doc_id AS block_ord FROM documents WHERE text <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, block_ord) AS rn FROM hits WHERE score > 0),
final AS (SELECT *, row_number() OVER (ORDER BY rn > 1, score DESC, block_ord) AS result_rank FROM ranked ORDER BY result_rank LIMIT 500)"""


# --- sources ---


@query("""SELECT doc_id, path, suffix FROM (SELECT doc_id, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM (SELECT doc_id, source || '/' || doc_id ||
CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.doc' WHEN 3 THEN '.txt' ELSE '' END AS path FROM documents)) WHERE suffix IN ('.pdf', '.docx', '.doc')""")
def suffix_dispatch(spark, sf_dir):
    from ..sources.files import supported

    ends = F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".doc", ".txt", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return supported(documents(spark, sf_dir).select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ends).alias("path")))


@query("""SELECT 'documents' AS origin, doc_id AS block_ord, source AS file, length(text) AS n_chars FROM documents UNION ALL
SELECT 'pages', page_id, split_part(url, '/', -1), length(html) FROM pages""")
def format_union(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("block_ord"), F.col("source").alias("file"), F.length("text").cast("long").alias("n_chars"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("origin"), F.col("page_id").alias("block_ord"), T.base_name(F.col("url")).alias("file"), F.length("html").cast("long").alias("n_chars"))
    return d.unionByName(p)


# --- page and file classes ---


@query(rf"""WITH p AS (SELECT source AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_idx, text AS raw_text, doc_id % 4 = 0 AS img,
CASE source WHEN 'src3' THEN 'ScanSnap Manager' ELSE 'Writer' END AS producer FROM documents),
f AS (SELECT path, max(lower(producer)) AS producer, coalesce(bool_or(page_idx < 3 AND length({sql_strip("raw_text")}) >= 50), false) AS t, coalesce(bool_or(page_idx < 3 AND img), false) AS i FROM p GROUP BY path)
SELECT path, CASE WHEN contains(producer, 'scan') OR (i AND NOT t) THEN 'scanned' WHEN i AND t THEN 'mixed' ELSE 'digital' END AS pdf_class FROM f""")
def pdf_classify(spark, sf_dir):
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    maker = F.when(F.col("source") == "src3", "ScanSnap Manager").otherwise("Writer")
    return B.pdf_classes(documents(spark, sf_dir).select(F.col("source").alias("path"), page.alias("page_idx"), F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("n_images"), maker.alias("producer")))


@query(f"""WITH p AS (SELECT doc_id, {sql_strip("text")} AS t FROM documents)
SELECT doc_id, length(t) < 10 OR (length(t) < 400 AND doc_id % 2 = 1) OR {sql_garbled("t")} AS scanned FROM p""")
def page_scan_class(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.strip(F.col("text")).alias("t")).select("doc_id", B.is_scanned_page(F.col("t"), F.col("doc_id") % 2 == 0).alias("scanned"))


@query(rf"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {sql_garbled("text")} AS garbled FROM documents""")
def garbled_ratio(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"), T.is_garbled(F.col("text")).alias("garbled"))


# --- chapters ---


@query(f"WITH {SQL_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, {sql_chapter('text')} AS chapter FROM lines")
def chapter_detect(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.detect_chapter(F.col("text")).alias("chapter"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, coalesce(last_value(CASE WHEN pos % 3 <> 1 THEN {sql_chapter('text')} END IGNORE NULLS)
OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '{NO_CHAPTER}') AS chapter FROM lines""")
def chapter_carry(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("scanned", F.col("pos") % 3 == 1)
    return B.carry_chapter(rows, "doc_id", "pos").select("doc_id", "pos", "chapter")


@query(f"""WITH {SQL_LINES}, s AS (SELECT doc_id, pos, {sql_strip('text')} AS text FROM lines), h AS (SELECT *, {sql_chapter('text')} IS NOT NULL AS head FROM s WHERE text <> ''),
n AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN head THEN substring(text, 1, 60) END), '{NO_CHAPTER}') AS chapter, string_agg(text, chr(10) ORDER BY pos) AS text FROM n GROUP BY doc_id, section""")
def section_fold(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("para_idx"), "text", F.lit(None).cast("string").alias("style"))
    return B.fold_sections(rows, "doc_id").select("doc_id", F.col("section").cast("long").alias("section"), "chapter", "text")


# one file of all lines, in order of doc_id and place, whose runs are shared by tasks
_LONGEST, _DOCS_A_RUN = 1_000_000, 50
_SQL_PLACE = f"coalesce(doc_id, -1) * {_LONGEST} + pos"


def _one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.lit("all").alias("path"), (F.coalesce("doc_id", F.lit(-1)) * _LONGEST + F.col("pos")).alias("place"), "text", (F.col("pos") % 3 == 1).alias("scanned"))


@query(f"""WITH {SQL_LINES}, p AS (SELECT {_SQL_PLACE} AS place, CASE WHEN pos % 3 <> 1 THEN {sql_chapter('text')} END AS own FROM lines)
SELECT place, coalesce(last_value(own IGNORE NULLS) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING), '{NO_CHAPTER}') AS chapter FROM p""")
def chapter_carry_runs(spark, sf_dir):
    return B.carry_chapter(_one_file(spark, sf_dir), "path", "place", rows=_DOCS_A_RUN * _LONGEST).select("place", "chapter")


@query(f"""WITH {SQL_LINES}, s AS (SELECT {_SQL_PLACE} AS place, {sql_strip('text')} AS text FROM lines), h AS (SELECT *, {sql_chapter('text')} IS NOT NULL AS head FROM s WHERE text <> ''),
n AS (SELECT *, sum(CAST(head AS INT)) OVER (ORDER BY place) AS section FROM h)
SELECT CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN head THEN substring(text, 1, 60) END), '{NO_CHAPTER}') AS chapter, md5(string_agg(text, chr(10) ORDER BY place)) AS text_md5 FROM n GROUP BY section""")
def section_fold_runs(spark, sf_dir):
    rows = _one_file(spark, sf_dir).select("path", F.col("place").alias("para_idx"), "text", F.lit(None).cast("string").alias("style"))
    return B.fold_sections(rows, "path", rows=_DOCS_A_RUN * _LONGEST).select("section", "chapter", F.md5("text").alias("text_md5"))


@query(f"WITH {SQL_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, coalesce({sql_chapter('text')}, 'carried') AS chapter FROM lines")
def ocr_chapter_override(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", ocr.override_chapter(F.lit("carried"), F.col("text")).alias("chapter"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
c AS (SELECT doc_id, CASE WHEN pos % 4 = 3 THEN '' ELSE t END AS t, pos, (pos % 10) / 10.0 AS conf FROM l)
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (t <> ''), '') AS text, round(coalesce(avg(CAST(conf AS DOUBLE)) FILTER (t <> ''), 1.0), 6) AS conf FROM c GROUP BY doc_id""")
def ocr_confidence(spark, sf_dir):
    line = lambda t, i: F.struct(F.when(i % 4 == 3, "").otherwise(t).alias("text"), (i % 10 / 10.0).cast("double").alias("conf"))
    d = documents(spark, sf_dir).select("doc_id", F.transform(F.split("text", "\n"), line).alias("l"))
    return d.select("doc_id", ocr.lines_text(F.col("l")).alias("text"), F.round(ocr.lines_confidence(F.col("l")), 6).alias("conf"))


# --- keywords, scores, ranks ---


@query("""WITH t AS (SELECT item_id, regexp_extract_all(text, '[一-龥]+|[A-Za-z0-9._%-]+') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t)
SELECT item_id, word, CAST(row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS INT) AS place FROM u GROUP BY item_id, word""")
def keyword_tokens(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", F.posexplode(keywords_column(F.col("text"))).alias("place", "word")).select("item_id", "word", (F.col("place") + 1).alias("place"))


@query(f"SELECT * FROM (SELECT doc_id, {sql_score('text', WORDS)} AS score FROM documents WHERE text <> '') WHERE score > 0")
def block_score(spark, sf_dir):
    return locate.scored(documents(spark, sf_dir), WORDS).select("doc_id", "score")


@query(f"WITH {SQL_RANKED} SELECT file, CAST(page AS VARCHAR) AS page, '{NO_CHAPTER}' AS chapter, snippet, '关键词命中' AS reason, score, block_ord FROM final")
def locate_ranked(spark, sf_dir):
    return locate.locate(plain_blocks(spark, sf_dir), QUERY).drop("page_label", "rank_in_file")


_BATCH = {1: "the 和 and", 2: "de 以及 la", 3: "und 在哪里"}


@query(
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT {i} AS query_id, source AS file, doc_id AS page, doc_id AS block_ord, {sql_score('text', w)} AS score FROM documents" for i, w in ((1, ["the", "and"]), (2, ["de", "la"]), (3, ["und"])))
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, block_ord) AS rn FROM s WHERE score > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn > 1, score DESC, block_ord) AS result_rank FROM r)
SELECT query_id, CAST(result_rank AS INT) AS result_rank, file, page, score, block_ord FROM f WHERE result_rank <= 500"""
)
def locate_batch(spark, sf_dir):
    return locate.locate_many(plain_blocks(spark, sf_dir), _BATCH)


RARE, RARE_WORDS = "heing 以及 schst 和 laou", ["heing", "schst", "laou"]


def _index(spark: SparkSession, sf_dir: str, **how) -> str:
    """The documents under a new substring index in the shared folder."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    substring_index.build(plain_blocks(spark, sf_dir), path, **how)
    return path


def _limited(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """A limited result, without the index that it comes from."""
    out = spark.createDataFrame(found.drop("page_label", "rank_in_file").collect(), found.drop("page_label", "rank_in_file").schema)
    delete(spark, path)
    return out


def _sql_ranked(words: list[str]) -> str:
    return SQL_RANKED.replace(sql_score("text", WORDS), sql_score("text", words)) + f" SELECT file, CAST(page AS VARCHAR) AS page, '{NO_CHAPTER}' AS chapter, snippet, '关键词命中' AS reason, score, block_ord FROM final"


@query(f"WITH {_sql_ranked(RARE_WORDS)}")
def locate_indexed(spark, sf_dir):
    """Rare words by a trigram index that is built over all documents."""
    path = _index(spark, sf_dir)
    return _limited(spark, path, substring_index.locate(spark, path, RARE))


@query(f"WITH {_sql_ranked(WORDS)}")
def locate_top(spark, sf_dir):
    """Frequent words, segment by segment of the index, as far as scores can matter."""
    path = _index(spark, sf_dir, segment_blocks=256)
    return _limited(spark, path, substring_index.locate_top(spark, path, QUERY))


@query("""WITH t AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[一-龥]+|[A-Za-z0-9._%-]+')) AS word FROM benchmark),
w AS (SELECT DISTINCT word FROM t), c AS (SELECT word, source AS file, doc_id, (length(text) - length(replace(text, word, ''))) // length(word) AS n FROM w JOIN documents ON contains(text, word)),
s AS (SELECT query_id, file, doc_id, CAST(sum(n) AS BIGINT) AS score FROM t JOIN c USING (word) GROUP BY query_id, file, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, doc_id) AS rn FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn > 1, score DESC, doc_id) AS result_rank FROM r)
SELECT query_id, CAST(result_rank AS INT) AS result_rank, file, doc_id AS page, score, doc_id AS block_ord FROM f WHERE result_rank <= 500""")
def locate_table(spark, sf_dir):
    """Each text of the benchmark as a query over all documents."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return query_table.locate_table(plain_blocks(spark, sf_dir), b)


@query(f"""SELECT file, CAST(sum(score) AS BIGINT) AS n_hits, min(block_ord) AS first_ord FROM (SELECT source AS file, doc_id AS block_ord, {sql_score('text', WORDS)} AS score FROM documents)
WHERE score > 0 GROUP BY file""")
def file_hit_counts(spark, sf_dir):
    return report.file_hits(plain_blocks(spark, sf_dir), WORDS)


# --- reports ---


@query(f"""WITH {SQL_BLOCKS} SELECT count(*) AS n_blocks, count(*) FILTER (NOT scanned AND text <> '') AS n_text_blocks, count(DISTINCT file) FILTER (NOT scanned AND text <> '') AS n_text_files,
count(*) FILTER (scanned) AS n_scanned_blocks, count(DISTINCT file) FILTER (scanned) AS n_scanned_files, count(*) FILTER (scanned AND text <> '') AS n_ocr_done FROM blocks""")
def index_status(spark, sf_dir):
    return report.index_status(blocks(spark, sf_dir))


@query(f"WITH {SQL_BLOCKS} SELECT file, count(*) AS n_pages, count(*) FILTER (text <> '') AS n_ocr_done FROM blocks WHERE scanned GROUP BY file")
def scanned_files(spark, sf_dir):
    return report.scanned_files(blocks(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked(locate.locate(plain_blocks(spark, sf_dir), QUERY))


@query(f"WITH {SQL_RANKED} SELECT file, count(*) AS n_hits, string_agg(CAST(page AS VARCHAR), '、' ORDER BY result_rank) AS pages, CAST(min(result_rank) AS INT) AS first_rank FROM final GROUP BY file")
def group_results(spark, sf_dir):
    return report.group_results(_results(spark, sf_dir))


@query(f"WITH {SQL_RANKED} SELECT count(DISTINCT file) AS n_files, count(*) AS n_results FROM final")
def result_totals(spark, sf_dir):
    return report.totals(_results(spark, sf_dir))


@query(
    f"WITH {SQL_RANKED} SELECT file, count(*) AS n_hits, md5('用户在文件「' || file || '」中搜索「{QUERY}」，找到了 ' || count(*) || ' 处匹配内容。' || chr(10) || chr(10) || "
    + " || chr(10) || ".join(f"'{x}'" for x in polish.RULES.replace("{query}", QUERY).split("\n"))
    + f" || string_agg('【第' || page || '页 {NO_CHAPTER}】' || chr(10) || snippet, chr(10) || chr(10) ORDER BY result_rank)) AS prompt_md5 FROM final GROUP BY file"
)
def prompt_text(spark, sf_dir):
    return polish.prompts(_results(spark, sf_dir), QUERY).select("file", "n_hits", F.md5("prompt").alias("prompt_md5"))


@query(f"SELECT doc_id, md5(replace(text, 'the', '{T.HIGHLIGHT.format('the')}')) AS marked_md5 FROM documents")
def highlight_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.highlight(F.col("text"), ["the"])).alias("marked_md5"))


# --- cache and settings ---


def _files(spark: SparkSession, sf_dir: str, late: int) -> DataFrame:
    """Documents as files; those of the last shift have changed since."""
    d = documents(spark, sf_dir)
    modified = F.when(F.col("doc_id") % 7 == late, "2024-02-02").otherwise("2024-01-01")
    return d.select("doc_id", "source", cache.cache_key(F.concat_ws("/", "source", F.col("doc_id").cast("string")), modified).alias("cache_key"))


_SQL_KEY = "md5(source || '/' || doc_id || '|' || CASE WHEN doc_id % 7 = {} THEN '2024-02-02' ELSE '2024-01-01' END || '|v10')"


@query(f"SELECT doc_id, {_SQL_KEY.format(3)} AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    return _files(spark, sf_dir, 3).select("doc_id", "cache_key")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("doc_id") % 11 == 0, "unreadable")
    return _files(spark, sf_dir, 9).select("cache_key", error.alias("ocr_error"))


_SQL_CACHE = f"""WITH f AS (SELECT doc_id, {_SQL_KEY.format(3)} AS cache_key FROM documents), c AS (SELECT {_SQL_KEY.format(9)} AS cache_key FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, cache_key FROM f WHERE """


@query(_SQL_CACHE + "EXISTS (SELECT 1 FROM c WHERE c.cache_key = f.cache_key)")
def cache_hits(spark, sf_dir):
    return cache.hits(_files(spark, sf_dir, 3), _cached(spark, sf_dir)).select("doc_id", "cache_key")


@query(_SQL_CACHE + "NOT EXISTS (SELECT 1 FROM c WHERE c.cache_key = f.cache_key)")
def cache_misses(spark, sf_dir):
    return cache.misses(_files(spark, sf_dir, 3), _cached(spark, sf_dir)).select("doc_id", "cache_key")


@query("SELECT count(DISTINCT " + _SQL_KEY.format(9) + ") AS n_entries FROM documents")
def cache_entries(spark, sf_dir):
    return cache.entries(_cached(spark, sf_dir))


@query("""SELECT coalesce(g.name, d.name) AS name, coalesce(g.value, d.value) AS value FROM (SELECT DISTINCT source || '/' || lang AS name, CASE WHEN source < 'src2' THEN NULL ELSE lang END AS value FROM documents WHERE source || lang IS NOT NULL) g
FULL JOIN (SELECT DISTINCT source || '/en' AS name, 'default' AS value FROM documents WHERE source IS NOT NULL) d ON g.name = d.name""")
def config_merge(spark, sf_dir):
    """A setting for each source and language under defaults for each source."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null").select("source", "lang").distinct()
    given = d.where("lang is not null").select(F.concat_ws("/", "source", "lang").alias("name"), F.when(F.col("source") >= "src2", F.col("lang")).alias("value"))
    return config.merge(given, d.select(F.concat(F.col("source"), F.lit("/en")).alias("name"), F.lit("default").alias("value")).distinct())


# --- functions that callers bring, with fixed stand-ins ---


@query(f"""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT doc_id, pos, {sql_strip('line')} AS text FROM l0), h AS (SELECT *, {sql_chapter('text')} IS NOT NULL AS head FROM s WHERE text <> ''),
n AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id || '.docx' AS file, coalesce(max(CASE WHEN head THEN substring(text, 1, 60) END), '{NO_CHAPTER}') AS chapter, string_agg(text, chr(10) ORDER BY pos) AS text, false AS scanned FROM n GROUP BY doc_id, section""")
def docx_read(spark, sf_dir):
    """Documents written as .docx inside the engine and read back as sections."""
    from ..sources import files as source

    rows = documents(spark, sf_dir)

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        for b in batches:
            out = []
            for doc, text in zip(b.doc_id, b.text, strict=True):
                body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in (text or "").split("\n"))
                with zipfile.ZipFile(raw := io.BytesIO(), "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                out.append((f"{doc}.docx", ".docx", len(raw.getvalue()), raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "suffix", "length", "content"])

    files = rows.select("doc_id", "text").mapInPandas(pack, "path string, suffix string, length long, content binary")
    return B.section_blocks(source.read_paragraphs(files)).select("file", "chapter", "text", "scanned")


@query(
    f"""WITH {SQL_BLOCKS} SELECT file, CAST(page AS INT) AS page, CASE WHEN scanned THEN substring('第' || page || '章 ' || path, 1, 60) ELSE chapter END AS chapter,
CASE WHEN scanned THEN '第' || page || '章 ' || path || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END ELSE text END AS text, scanned, CASE WHEN scanned THEN CASE WHEN text <> '' THEN 0.75 ELSE CAST(0.5 AS DOUBLE) END END AS ocr_conf, CAST(NULL AS VARCHAR) AS ocr_error FROM blocks"""
)
def ocr_udf(spark, sf_dir):
    """Every fifth document as a scan, whose text a stand-in engine finds where the rendering says; the others keep their texts."""
    b = blocks(spark, sf_dir)
    image = F.struct(F.when(F.col("scanned"), F.concat_ws("\n", "path", "text")).alias("pdf_path"), F.col("page").alias("page_idx"), F.lit(300).alias("dpi"))
    b = b.withColumn("render_info", image).withColumn("text", F.when(F.col("scanned"), "").otherwise(F.col("text"))).withColumn("ocr_error", F.lit(None).cast("string"))

    def engine(image, page, dpi):
        path, text = image.split("\n", 1)
        return [(f"第{page}章 {path}", 0.5), ("", 0.1), (text, 1.0)]

    return ocr.recognise(b, engine).select("file", "page", "chapter", "text", "scanned", "ocr_conf", "ocr_error")


_SQL_PROMPT = (
    f"WITH {SQL_RANKED} SELECT file, count(*) AS n_hits, '用户在文件「' || file || '」中搜索「{QUERY}」，找到了 ' || count(*) || ' 处匹配内容。' || chr(10) || chr(10) || "
    + " || chr(10) || ".join(f"'{x}'" for x in polish.RULES.replace("{query}", QUERY).split("\n"))
    + f" || string_agg('【第' || page || '页 {NO_CHAPTER}】' || chr(10) || snippet, chr(10) || chr(10) ORDER BY result_rank) AS prompt FROM final GROUP BY file"
)


@query(f"SELECT file, CAST(length(prompt) AS VARCHAR) || ' {T.HIGHLIGHT.format('the')}' AS answer, false AS failed FROM ({_SQL_PROMPT})")
def polish_udf(spark, sf_dir):
    """Hits of each file summarised by a stand-in model."""
    chat = lambda messages, temperature: iter([f"{len(messages[1]['content'])} the"])
    return polish.polish(_results(spark, sf_dir), QUERY, chat)
