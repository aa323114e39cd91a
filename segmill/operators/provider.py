"""Translation providers: a batch of texts in, as many out; failures are retried, halved, and at last left as the source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.slices import slices

#: Gets (id, text) pairs, returns what it has by id.
Provider = Callable[[list[tuple[str, str]]], dict[str, str]]


def copy(batch: list[tuple[str, str]]) -> dict[str, str]:
    return dict(batch)


def delays(base: float, retries: int, exponential: bool = True) -> list[float]:
    """Seconds before each retry: base * 2**n, or base * (n + 1)."""
    return [base * (2**n if exponential else n + 1) for n in range(retries)]


def with_retries(provider: Provider, waits: list[float]) -> Provider:
    def run(batch: list[tuple[str, str]]) -> dict[str, str]:
        for wait in [*waits, None]:
            try:
                return provider(batch)
            except (TimeoutError, ConnectionError):
                if wait is None:
                    raise
                time.sleep(wait)
        return {}

    return run


def halved(provider: Provider, batch: list[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """id -> (translated, status). A batch that fails or lacks ids is cut in two; what fails alone is the source."""
    try:
        got = provider(batch)
        if all(i in got and got[i] for i, _ in batch):
            return {i: (got[i], "translated") for i, _ in batch}
    except Exception:  # noqa: BLE001  whatever a provider raises, the texts must come out
        pass
    if len(batch) == 1:
        return {batch[0][0]: (batch[0][1], "source-copy")}
    m = len(batch) // 2
    return halved(provider, batch[:m]) | halved(provider, batch[m:])


def translated(pending: DataFrame, provider: Provider, batch: int = 40, key: str = "id", text: str = "source") -> DataFrame:
    """pending with translated and status. Tasks may run again, so a provider must give the same result for the same ids."""
    names = [StructField(c, StringType()) for c in ("translated", "status")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at, n in slices(whole.columns):
                rows = whole.slice(at, n)
                pairs = list(zip(map(str, rows.column(key).to_pylist()), rows.column(text).to_pylist()))
                new = []
                for i in range(0, n, batch):
                    out = halved(provider, pairs[i : i + batch])
                    new += [out[k] for k, _ in pairs[i : i + batch]]
                for j, c in enumerate(names):
                    rows = rows.append_column(c.name, pa.array([x[j] for x in new], pa.string()))
                yield rows

    return pending.mapInArrow(run, StructType([*pending.schema.fields, *names]))
