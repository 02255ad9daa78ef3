"""Hooks for instruments that are not expressions: sentence and document extractors, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SentenceExtractor(Protocol):
    """Features of single sentences."""

    name: str
    feature_names: Sequence[str]

    def extract_sentence(self, text: str) -> dict[str, float]: ...


class DocumentExtractor(Protocol):
    """One vector for every sentence of a document, from the whole of it."""

    name: str
    feature_names: Sequence[str]

    def extract_essay(self, text: str, spans: Sequence[tuple[int, int]]) -> Sequence[dict[str, float]]: ...


def run_sentence_extractor(sentences: DataFrame, make: Callable[[], SentenceExtractor], names: Sequence[str], keys: list[str]) -> DataFrame:
    """The extractor over all sentences in Arrow batches; `make` runs once in every worker, so models load lazily."""
    types = dict(sentences.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{n} double" for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ex = None
        for pdf in batches:
            ex = ex or make()
            rows = [ex.extract_sentence(t) for t in pdf["sentence"]]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=list(names), dtype="float64")], axis=1)

    return sentences.select(*keys, "sentence").mapInPandas(run, schema)


def run_document_extractor(docs: DataFrame, sentences: DataFrame, make: Callable[[], DocumentExtractor], names: Sequence[str], key: str = "doc_id") -> DataFrame:
    """The extractor over whole documents with their spans; a wrong number of vectors is an error."""
    spans = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent_idx", "start", "end"))).alias("spans"))  # the spans of one document
    schema = f"{key} {dict(docs.dtypes)[key]}, sent_idx int, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ex = None
        for pdf in batches:
            ex = ex or make()
            out = []
            for k, text, sp in zip(pdf[key], pdf["text"], pdf["spans"]):
                got = ex.extract_essay(text, [(s["start"], s["end"]) for s in sp])
                if len(got) != len(sp):
                    raise ValueError(f"{len(got)} vectors for {len(sp)} sentences")
                out += [(k, s["sent_idx"], *(v.get(n) for n in names)) for s, v in zip(sp, got)]
            yield pd.DataFrame(out, columns=[key, "sent_idx", *names])

    return docs.select(key, "text").join(spans, key).mapInPandas(run, schema)


@dataclass
class Registry:
    """Instruments by name with their state."""

    _items: dict[str, object] = field(default_factory=dict)
    _state: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, item: object) -> None:
        if name in self._items:
            raise ValueError(f"{name} is registered already")
        self._items[name], self._state[name] = item, "registered"

    def get(self, name: str) -> object:
        return self._items[name]

    def status(self, name: str) -> str:
        return self._state[name]

    def mark_ready(self, name: str) -> None:
        self._mark(name, "ready")

    def mark_error(self, name: str) -> None:
        self._mark(name, "error")

    def is_ready(self, name: str) -> bool:
        return self._state[name] == "ready"

    def _mark(self, name: str, state: str) -> None:
        if name not in self._items:
            raise KeyError(name)
        self._state[name] = state
