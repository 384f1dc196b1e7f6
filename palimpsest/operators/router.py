"""Calls of models through providers in order: the next one answers where one can't for now.

A provider is made once a task and called prompt by prompt. What it raises is sorted: a timeout of the request, too many requests,
a fault of the server or of the network is for now, and the next provider is asked (after ``attempts`` tries of this one); anything
else is the request's own fault, which no other provider would mend, and ends it. Every row says which provider answered, its place
in the order, how many calls that took, and the last error where none did. A row's failure is its own: the others are answered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Model = Callable[[str], str]


class Failure(Exception):
    """What a provider answered instead: the status of a response."""

    def __init__(self, status: int, said: str = ""):
        super().__init__(status, said)
        self.status, self.said = status, said

    def __str__(self) -> str:
        return f"status {self.status}" + f": {self.said}" * bool(self.said)


@dataclass(frozen=True)
class Provider:
    name: str
    make: Callable[[], Model]


def passing(error: Exception) -> bool:
    """Whether another provider, or another try, may do better."""
    if isinstance(error, Failure):
        return error.status in (408, 429) or error.status >= 500
    return isinstance(error, (ConnectionError, TimeoutError))


def answered(prompts: DataFrame, providers: list[Provider], prompt: str = "prompt", attempts: int = 1) -> DataFrame:
    """``prompts`` with answer, provider, tier (0 is the first provider), calls and error. A null prompt is not asked: all are null."""
    if not providers:
        raise ValueError("no provider to ask")
    schema = T.StructType([*prompts.schema.fields, *(T.StructField(c, k) for c, k in (("answer", T.StringType()), ("provider", T.StringType()), ("tier", T.IntegerType()), ("calls", T.IntegerType()), ("error", T.StringType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Model] = {}

        def ask(text: str | None) -> tuple:
            if text is None:
                return (None,) * 5
            calls, error = 0, None
            for tier, p in enumerate(providers):
                for _ in range(attempts):
                    calls += 1
                    try:
                        if p.name not in made:
                            made[p.name] = p.make()
                        return made[p.name](text), p.name, tier, calls, None
                    except Exception as e:  # whatever a provider raises is this row's
                        error = f"{p.name}: {e}"
                        if not passing(e):
                            return None, None, None, calls, error
            return None, None, None, calls, error

        for b in batches:
            said = pd.DataFrame([ask(x) for x in b[prompt]], columns=["answer", "provider", "tier", "calls", "error"], index=b.index, dtype=object)
            yield pd.concat([b, said], axis=1)

    return prompts.mapInPandas(run, schema)
