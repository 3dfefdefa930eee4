"""Plug points: answers, encoders, scorers and memories that models stand behind, with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AnswerBackend(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame: ...


class PatchRetriever(Protocol):
    def retrieve(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame: ...


class SemanticMemory(Protocol):
    def build_index(self, docs: DataFrame) -> DataFrame: ...

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class FirstOption:
    """The deterministic backend: the first option, with full confidence."""

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("raw", F.get("options", 0)).withColumn("confidence", F.lit(1.0))


class ModelBackend:
    """A model behind Arrow batches; ``load`` runs once a worker and returns a function from prompts to answers."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[str]]]):
        self.load = load

    def answer(self, prompts: DataFrame) -> DataFrame:
        load = self.load

        @F.pandas_udf("string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for b in batches:
                yield pd.Series(model(b.tolist()))

        return prompts.withColumn("raw", ask("prompt")).withColumn("confidence", F.lit(1.0))


def encode_patches(patches: DataFrame, load: Callable[[], Callable[[list[bytes]], list[list[float]]]], column: str = "content") -> DataFrame:
    """Vectors of image bytes by an encoder loaded once a worker."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.tolist()))

    return patches.withColumn("vec", encode(column))


def confidence(logprob: Column) -> Column:
    return F.coalesce(F.exp(logprob), F.lit(1.0))


class TopK:
    def retrieve(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
        from marlstone.operators import vectors

        return vectors.topk(pool, queries, k)


class NoRetrieval:
    def retrieve(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
        return pool.limit(0)


class LexicalMemory:
    """BM25 over documents (id, text)."""

    def build_index(self, docs: DataFrame) -> DataFrame:
        self.docs = docs
        return docs

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        from marlstone.operators import retrieval

        return retrieval.ranked(retrieval.bm25(self.docs, queries), k=k)


RETRIEVERS: dict[str, Callable[[], PatchRetriever]] = {"none": NoRetrieval, "cosine": TopK}
MEMORIES: dict[str, Callable[[], SemanticMemory]] = {"lexical": LexicalMemory}


def make(registry: dict, name: str):
    if name not in registry:
        raise KeyError(f"{name!r} is none of {sorted(registry)}")
    return registry[name]()
