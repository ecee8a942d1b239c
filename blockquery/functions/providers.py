"""Semantic providers as plug-ins: a protocol, a registry and a fallback chain that runs inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame

FAILOVER = ("rate_limit", "timeout", "server")


class ProviderError(RuntimeError):
    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


class Provider(Protocol):
    def answer(self, field_key: str, context: str) -> str | None: ...


REGISTRY: dict[str, Callable[[], Provider]] = {}


def register(name: str, make: Callable[[], Provider]) -> None:
    REGISTRY[name] = make


def chain_answer(providers: Sequence[tuple[str, Provider]], field_key: str, context: str) -> tuple[str, str, int]:
    """(code, provider, failures): the first success; another kind of error ends the walk as unknown."""
    failures = 0
    for name, provider in providers:
        try:
            found = provider.answer(field_key, context)
        except ProviderError as e:
            failures += 1
            if e.kind not in FAILOVER:
                break
            continue
        if found is not None:
            return found, name, failures
    return "unknown", "none", failures


def complete(rows: DataFrame, chain: Sequence[tuple[str, Callable[[], Provider]]]) -> DataFrame:
    """(doc_id, field_key, context) to codes; each worker makes its providers once."""
    made = list(chain)

    def run(batches: Iterable):
        import pyarrow as pa

        providers = [(name, make()) for name, make in made]
        for batch in batches:
            answers = [chain_answer(providers, f, c or "") for f, c in zip(batch.column("field_key").to_pylist(), batch.column("context").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("field_key"), *(pa.array([a[k] for a in answers], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64())))],
                names=["doc_id", "field_key", "code", "provider", "failures"],
            )

    return rows.select("doc_id", "field_key", "context").mapInArrow(run, "doc_id long, field_key string, code string, provider string, failures long")
