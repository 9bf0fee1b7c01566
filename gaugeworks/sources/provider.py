"""Text generation as a pluggable partition function; the mock provider needs nothing outside.

A provider is a callable that takes a list of prompts and returns as many objects. It runs on the executors, a batch a
call, so it must be picklable.
"""

import json
import re

import pandas as pd
from pyspark.sql import DataFrame


def outermost_object(text: str) -> dict | None:
    """The JSON object that a text holds between its first and last brace."""
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        value = json.loads(m.group()) if m else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def mock(prompts: list[str]) -> list[str]:
    """The same answer for the same prompt."""
    return [json.dumps({"stem": p[:80], "n_words": len(p.split())}) for p in prompts]


def complete(prompts: DataFrame, key: str, prompt: str, provider=mock) -> DataFrame:
    """(key, answer): the JSON object that the provider gives for each prompt, null if it gives none."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            answers = [outermost_object(a) for a in provider(pdf[prompt].fillna("").tolist())]
            yield pd.DataFrame({key: pdf[key], "answer": [None if a is None else json.dumps(a, sort_keys=True) for a in answers]})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string")
