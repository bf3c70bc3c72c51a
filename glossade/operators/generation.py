"""Requests for text continuations: prompts, token budgets, what is left to do, and what was used. Sending them is left to a Generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def budget(n: Column, ratio: Column) -> tuple[Column, Column]:
    """(least, most) model tokens for n parsed tokens at a ratio of model to parsed tokens."""
    base = F.when(n > 0, n * ratio).otherwise(0.0)
    least = F.when(n > 0, F.ceil(F.least(base * 0.5, ratio * 20))).otherwise(1)
    most = F.when(n > 0, F.ceil(F.least(base * 1.5, ratio * 200))).otherwise(1)
    least = F.greatest(least, F.lit(1))
    return least.cast("int"), F.greatest(most, least + F.when(n > 0, 0).otherwise(1)).cast("int")


def prompts(items: DataFrame, config: DataFrame) -> DataFrame:
    """items (item_id, lang, first_half, n_second) with user_prompt, min_tokens and max_tokens by the language's frame (`{}` is the text) and ratio.

    config has a row a language (a few dozen). Languages without one are dropped here: see missing_languages().
    """
    met = items.join(F.broadcast(config.select(F.col("lang_code").alias("lang"), "prompt_frame", "token_ratio")), "lang")
    least, most = budget(F.col("n_second"), F.col("token_ratio"))
    return met.select("item_id", "lang", F.replace("prompt_frame", F.lit("{}"), F.trim("first_half")).alias("user_prompt"), least.alias("min_tokens"), most.alias("max_tokens"))


def missing_languages(items: DataFrame, config: DataFrame) -> DataFrame:
    return items.select("lang").distinct().join(config.select(F.col("lang_code").alias("lang")), "lang", "left_anti")


def remaining(items: DataFrame, done: DataFrame, on: str = "item_id") -> DataFrame:
    """Items without a finished record."""
    return items.join(done.select(on).distinct(), on, "left_anti")


def run_stats(records: DataFrame) -> DataFrame:
    """Items, requests and tokens by language and over all (a null language)."""
    return records.rollup("lang").agg(F.count("*").alias("items"), F.sum("num_attempts").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def continue_texts(requests: DataFrame, generate, schema: str, attempts: int = 3, per_minute: float | None = None):
    """Runs an injected Generator (list of request dicts -> dicts of the schema) over batches.

    A batch that fails is tried again, `attempts` times in all, and then fails the task. per_minute bounds the requests of one task: divide a
    provider's limit by the tasks that run at once.
    """

    def run(batches):
        import time

        import pandas as pd

        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        free = time.monotonic()
        for pdf in batches:
            rows = pdf.to_dict("records")
            for n in range(1, attempts + 1):
                if per_minute:
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = max(free, time.monotonic()) + 60 * len(rows) / per_minute
                try:
                    got = [*generate(rows)]
                    break
                except Exception:
                    if n == attempts:
                        raise
            yield pd.DataFrame(got, columns=names)

    return requests.mapInPandas(run, schema)
