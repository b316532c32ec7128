"""Summaries of a file's hits by a language model the caller brings."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import keywords
from ..functions.text import highlight
from ..sources.shared import delete, exists, opened_folder

# Fixed values.
SYSTEM = "你是专业的文档内容整理助手，擅长将 OCR 识别的杂乱文字整理为清晰美观的格式。"
TEMPERATURE = 0.1
HEAD = ("用户在文件「", "」中搜索「{query}」，找到了 ", " 处匹配内容。\n\n")
HIT = ("【第", "页 ", "】\n")
RULES = (
    "请将每段内容整理为清晰、美观的格式：\n"
    "1. 修正 OCR 错误字符和乱码\n"
    "2. 保留所有原始信息（数字、日期、金额、单位等不可修改）\n"
    "3. 提取与「{query}」最相关的核心信息\n"
    "4. 用 Markdown 格式输出，适当使用 **加粗**、表格、列表\n"
    "5. 每段用 ### 标注页码和章节\n\n"
    "以下是原始内容：\n\n"
)

#: (messages, temperature) -> pieces of the answer.
Chat = Callable[[list[dict[str, str]], float], Iterator[str]]


def prompt(file: Column, query: str, hits: Column) -> Column:
    """``hits``: array of structs page, chapter, snippet in order."""
    parts = F.array_join(F.transform(hits, lambda h: F.concat(F.lit(HIT[0]), h["page"], F.lit(HIT[1]), h["chapter"], F.lit(HIT[2]), h["snippet"])), "\n\n")
    return F.concat(F.lit(HEAD[0]), file, F.lit(HEAD[1].replace("{query}", query)), F.size(hits).cast("string"), F.lit(HEAD[2]), F.lit(RULES.replace("{query}", query)), parts)


def prompts(results: DataFrame, query: str) -> DataFrame:
    """(file, n_hits, prompt, snippets): a row a file of ranked results."""
    hit = F.struct("result_rank", F.coalesce(F.col("page"), F.lit("—")).alias("page"), F.col("chapter"), F.col("snippet"))
    groups = results.groupBy("file").agg(F.sort_array(F.collect_list(hit)).alias("h"))
    return groups.select("file", F.size("h").cast("long").alias("n_hits"), prompt(F.col("file"), query, F.col("h")).alias("prompt"), F.array_join(F.transform("h", lambda x: x["snippet"]), "\n\n").alias("snippets"))


def answers(prompts: DataFrame, chat: Chat, ledger: str, model: str = "") -> DataFrame:
    """(prompt_key, answer) of each distinct prompt, from a ledger in a shared folder that is asked before the model.

    Prompts that have no answer there are put to the model, one call each.  An answer is noted under its prompt's digest as soon as it is there, so a task that is
    run again finds what it asked before; then all answers of the run are committed as one table, which results are read from.  Failures are kept apart, and
    tried again in the next run.  ``model`` tells apart answers of different models.
    """
    spark = prompts.sparkSession
    run_id = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    asked = prompts.select(prompt_key(F.col("prompt"), model).alias("prompt_key"), "prompt").dropDuplicates(["prompt_key"])
    known = _ledger(spark, ledger)
    todo = asked if known is None else asked.join(known, "prompt_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = opened_folder(f"{ledger}/calls")
        for batch in batches:
            found, errors = [], []
            for key, text in zip(batch.prompt_key, batch.prompt, strict=True):
                try:
                    found.append(_noted(store, f"{base}/{key}") or _call(chat, text, store, f"{base}/{key}"))
                    errors.append(None)
                except Exception as e:
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"prompt_key": batch.prompt_key, "answer": found, "error": errors})

    told = todo.mapInPandas(run, "prompt_key string, answer string, error string")
    told.write.parquet(f"{ledger}/runs/run={run_id}")  # committed as a whole
    delete(spark, f"{ledger}/calls")
    return _ledger(spark, ledger).join(asked.select("prompt_key"), "prompt_key", "left_semi")


def prompt_key(prompt: Column, model: str = "") -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n{TEMPERATURE}\n{SYSTEM}\n"), prompt), 256)


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(prompt_key, answer) of committed runs, without failures."""
    if not exists(spark, f"{path}/runs"):
        return None
    return spark.read.schema("prompt_key string, answer string, error string, run string").parquet(f"{path}/runs").where("answer is not null").groupBy("prompt_key").agg(F.max_by("answer", "run").alias("answer"))


def _noted(store, path: str) -> str | None:
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return json.loads(f.read())["answer"]


def _call(chat: Chat, text: str, store, path: str) -> str:
    answer = "".join(chat([{"role": "system", "content": SYSTEM}, {"role": "user", "content": text}], TEMPERATURE))
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.part") as f:
        f.write(json.dumps({"answer": answer}).encode())
    store.move(f"{path}.part", path)  # whole or not at all
    return answer


def polish(results: DataFrame, query: str, chat: Chat | None = None, ledger: str | None = None, model: str = "") -> DataFrame:
    """(file, answer, failed): one call a file; without a model, or if it fails, the snippets, keywords marked.

    With a ``ledger`` (a shared folder) a prompt that was answered before is not put to the model again (``answers``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch.prompt:
                try:
                    found.append("".join(chat([{"role": "system", "content": SYSTEM}, {"role": "user", "content": text}], TEMPERATURE)))
                except Exception:
                    found.append(None)
            yield pd.DataFrame({"file": batch.file, "answer": found, "snippets": batch.snippets})

    asked = prompts(results, query)
    if chat is None:
        asked = asked.select("file", F.lit(None).cast("string").alias("answer"), "snippets")
    elif ledger is not None:
        told = answers(asked, chat, ledger, model)
        asked = asked.withColumn("prompt_key", prompt_key(F.col("prompt"), model)).join(told, "prompt_key", "left").select("file", "answer", "snippets")
    else:
        asked = asked.select("file", "prompt", "snippets").mapInPandas(run, "file string, answer string, snippets string")
    return asked.select("file", highlight(F.coalesce("answer", "snippets"), keywords(query)).alias("answer"), F.col("answer").isNull().alias("failed"))
