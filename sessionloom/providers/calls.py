"""Prompts of a DataFrame to a model, partition by partition, with a cache.

Spark may evaluate a plan more than once, and repeats failed tasks; a model
must not be asked again for that. So replies are written to a cache table,
keyed by a hash of all that decides them, model and server among it, and only
prompts that it lacks are sent. Until that table is written every call is in a
write-ahead log (``log``), which a repeated task reads first.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.jsontext import extract
from ..joins import shuffled
from ..scratch import Scratch
from ..storage import Store
from .base import ContextOverflow, Provider
from .log import CallFailed, PromptLog, opened, usage
from .schema import mismatch

ATTEMPTS = 3
STRICTER = "\nReply with one valid JSON object and nothing else."
CACHE = "prompt_key string, response string, input_tokens long, output_tokens long, calls int, error string, request string"


def ask(
    provider: Provider, system: str, prompt: str, temperature: float, max_tokens: int, wait: Callable[[float], None] = time.sleep, log: PromptLog | None = None,
    declared: StructType | None = None,
) -> tuple:
    """One prompt's JSON reply: retried with growing waits, and asked once more if it is no JSON object.

    With ``declared`` fields it is asked once more too if one has another type,
    and told which. What is wrong after that is the error, beside the reply.
    With a ``log`` what it holds is not asked again, and calls and tokens are those of its request.
    """
    spent, calls, error, value, wrong = [0, 0], 0, None, None, None

    def result(reply: str | None, why: str | None) -> tuple:
        return (reply, *log.spent, log.made, why) if log else (reply, *spent, calls, why)

    for step, suffix in enumerate(("", STRICTER)):
        said = f" {wrong[0].upper()}{wrong[1:]}." if wrong else ""
        for attempt in range(ATTEMPTS):
            complete = functools.partial(provider.complete, system + suffix + said, prompt, temperature, max_tokens)
            try:
                calls += 1
                reply = log.call(step, attempt, complete)[0] if log else complete()
                spent[0] += reply.input_tokens
                spent[1] += reply.output_tokens
                value, error = extract(reply.text), None
                break
            except ContextOverflow as e:
                return result(None, f"context overflow: {e}")
            except Exception as e:  # noqa: BLE001 - a failed call is a row's error, not the job's
                error = str(e) if isinstance(e, CallFailed) else f"{type(e).__name__}: {e}"
                if attempt + 1 < ATTEMPTS:
                    wait(float(2**attempt))
        if error:
            break
        wrong = None
        if isinstance(value, dict) and not value.get("_parse_error"):
            wrong = mismatch(value, declared) if declared else None
            if not wrong:
                break
    if error is None:
        error = wrong or (None if isinstance(value, dict) else "the reply is no JSON object")
    return result(None if value is None else json.dumps(value, ensure_ascii=False), error)


def identity(factory: Callable[[], Provider]) -> str:
    """Kind, server and model of the providers that a factory makes."""
    provider = factory()
    try:
        server = getattr(provider, "base_url", "")
        return ":".join([f"{type(provider).__module__}.{type(provider).__qualname__}", *[server] * bool(server), provider.model_name])
    finally:
        provider.close()


def call_model(
    df: DataFrame, system: str, prompt_col: str, factory: Callable[[], Provider], cache: str,
    temperature: float = 0.2, max_tokens: int = 4096, concurrency: int = 8, used: Callable[[str, Row], None] | None = None, reply: str | None = None,
) -> DataFrame:
    """``df`` with response (JSON), input_tokens, output_tokens, calls and error for the prompt of each row.

    ``cache`` is a folder in a store that all workers reach: Parquet files that
    grow under ``replies``, and the log of running requests under ``log``. Equal
    prompts are asked once; a null one is not asked. At most ``concurrency``
    partitions ask at a time. ``used`` is told the model and the sums (calls,
    input_tokens, output_tokens) of what was asked now, calls of lost tasks
    included (their tokens only if the reply came). ``reply`` declares fields and
    types, as ``a string not null, b array<int>``: a reply of other types is asked
    for once more and then an error of its row. Replies are kept by declaration.
    """
    spark = df.sparkSession
    model = identity(factory)
    log, logged = opened(spark, f"{cache}/log")
    store = Store(spark, cache)
    table = store.path("replies")
    declared = StructType.fromDDL(reply) if reply else None
    decides = [F.lit(x) for x in (model, system, str(temperature), str(max_tokens), *([declared.json()] if declared else []))]
    keyed = df.withColumn("prompt_key", F.sha2(F.concat_ws("\x1f", *decides, F.col(prompt_col)), 256))
    # Read twice here and by all that follows: what led to the prompts is computed once.
    keyed = Scratch(spark, "prompts").save(keyed, "prompts")
    wanted = keyed.select("prompt_key", F.col(prompt_col).alias("prompt")).where("prompt is not null").dropDuplicates(["prompt_key"])
    if store.exists("replies"):
        wanted = wanted.join(shuffled(spark.read.schema(CACHE).parquet(table).where("error is null").select("prompt_key")), "prompt_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, task = None, log.task(TaskContext.get().partitionId())
        try:
            for batch in batches:
                provider = provider or factory()
                rows = []
                for k, p in zip(batch["prompt_key"], batch["prompt"], strict=True):
                    calls = task.prompt(k)
                    rows.append((k, *ask(provider, system, p, temperature, max_tokens, log=calls, declared=declared), log.request))
                    task.close(calls)
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in CACHE.split(", ")])
            task.gather()
        finally:
            if provider is not None:
                provider.close()

    wanted.repartition(concurrency, "prompt_key").sortWithinPartitions("prompt_key").mapInPandas(run, CACHE).write.mode("append").parquet(table)
    if used:
        used(model, usage(spark, log, logged))
    # The table has all of it now.
    logged.delete(log.request)
    replies = spark.read.schema(CACHE).parquet(table).join(shuffled(keyed.select("prompt_key")), "prompt_key", "left_semi")
    # A prompt that failed before and was asked again has two rows: the good one counts.
    best = replies.groupBy("prompt_key").agg(F.max_by(F.struct("response", "input_tokens", "output_tokens", "calls", "error"), F.when(F.col("error").isNull(), 1).otherwise(0)).alias("r"))
    return keyed.join(shuffled(best), "prompt_key", "left").select(*df.columns, "r.*")
