"""Batch inference with an injected client, and the prompt rows it reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

CORRECTION = "\n\nThe last reply is invalid ({error}); answer again and correct it."


def batch_infer(
    prompts: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str], str]],
    validate: Callable[[str], str | None], retries: int = 3,
) -> DataFrame:
    """Attempt rows ``(key, attempt, status, reply, error)`` of every prompt.

    ``client`` is called once per Python worker and returns ``prompt -> reply``.
    ``validate`` returns an error text or None; the text is added to the next try.
    """
    schema = T.StructType(
        [prompts.schema[key], T.StructField("attempt", T.IntegerType()), T.StructField("status", T.StringType()),
         T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[prompt], strict=True):
                correction = ""
                for attempt in range(1, retries + 1):
                    reply, error = None, None
                    try:
                        reply = ask(text + correction)
                        error = validate(reply)
                    except Exception as e:  # noqa: BLE001 - a failed call is an attempt row
                        error = f"{type(e).__name__}: {e}"
                    out.append((k, attempt, "failed" if error else "accepted", reply, error))
                    if not error:
                        break
                    correction = CORRECTION.format(error=error)
            yield pd.DataFrame(out, columns=[key, "attempt", "status", "reply", "error"])

    return prompts.select(key, prompt).mapInPandas(run, schema)


def split_attempts(attempts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Accepted replies, and the keys without one with their last error."""
    accepted = attempts.where("status = 'accepted'").select(key, "attempt", "reply")
    last = attempts.groupBy(key).agg(F.max_by("error", "attempt").alias("error"), F.max("attempt").alias("attempts"))
    return accepted, last.join(accepted.select(key), key, "left_anti")


def prompt_rows(rows: DataFrame, keys: list[str], order: str, payload: list[str], field: str, instruction: str) -> DataFrame:
    """Instruction plus a JSON payload with the ordered items of each (bounded) batch."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *payload)))
    items = F.transform(packed, lambda i: F.struct(*[i[p].alias(p) for p in payload]))
    grouped = rows.groupBy(*keys).agg(items.alias(field))
    body = F.to_json(F.struct(*keys, field))
    return grouped.select(*keys, F.size(field).alias("items"), F.concat(F.lit(instruction + "\n\nInput:\n"), body).alias("prompt"))
