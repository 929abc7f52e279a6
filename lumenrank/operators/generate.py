"""Text generation as a batch job between a prompts table and a completions table.

The model itself is a pluggable callable ``fn(prompts: list[str], max_new_tokens) ->
list[str]``, run once per Arrow batch inside ``mapInPandas``. When a batch raises, its
prompts are tried one by one, so only a prompt that fails by itself has no completion;
its ``error`` says why. The consumers treat a null completion as "no completion" (HyDE
falls back to the raw query, listwise keeps the order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lumenrank import config as C

Generator = Callable[[list[str], int], list[str]]


def generate(prompts: DataFrame, fn: Generator | None, max_new_tokens: int = C.LISTWISE_MAX_NEW_TOKENS,
             key: str = "qid", prompt_col: str = "prompt") -> DataFrame | None:
    """``(key, completion, error)`` for every prompt row; ``None`` when there is no generator."""
    if fn is None:
        return None

    def call(prompts: list[str]) -> list[str]:
        out = list(fn(prompts, max_new_tokens))
        if len(out) != len(prompts):
            raise ValueError("generator returned a different number of completions")
        return out

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return call([prompt])[0], None
        except Exception as e:  # noqa: BLE001 - reported in the row's ``error``
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").tolist()
            try:
                done = [(c, None) for c in call(prompts)]
            except Exception:  # noqa: BLE001 - some prompt of the batch failed
                done = [one(p) for p in prompts]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "completion": pd.Series([c for c, _ in done], dtype="object"),
                                "error": pd.Series([e for _, e in done], dtype="object")})

    key_type = dict(prompts.dtypes)[key]
    return prompts.select(key, prompt_col).mapInPandas(run, f"{key} {key_type}, completion string, error string")
