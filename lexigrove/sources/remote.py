"""Calls of remote services from workers: which errors are worth another try, bounded retries, and identity checks of what comes back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Error classes of client libraries that stand for a lost connection, and status codes that pass.
CONNECTION_ERRORS = frozenset({"APIConnectionError", "APITimeoutError", "RemoteProtocolError"})
TOO_MANY, SERVER_ERROR = 429, 500


class Generator(Protocol):
    """Gives one structured item for each asked one, each with the id it was asked under."""

    def generate(self, items: list[dict]) -> list[dict]: ...


def transient(error: BaseException | None) -> bool:
    """Whether the error, or one that led to it, may not come again: lost connections, time-outs, busy or failing servers."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        code = getattr(error, "status_code", None)
        if isinstance(code, int) and (code == TOO_MANY or code >= SERVER_ERROR):
            return True
        if type(error).__name__ in CONNECTION_ERRORS or isinstance(error, OSError):
            return True
        error = error.__cause__ or error.__context__
    return False


def with_retries(call: Callable, attempts: int = 3, wait: float = 1.0):
    """The call's result; transient errors are tried again, each time after twice the wait."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception as error:
            if not left or not transient(error):
                raise
            time.sleep(wait)
            wait *= 2


def same_identities(asked: Sequence, got: Sequence) -> bool:
    """Whether every id came back once and none besides; order is free."""
    return len(got) == len(set(got)) and set(got) == set(asked)


def generate(items: DataFrame, load: Callable[[], Generator], key: str, batch: int = 8, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, result, error): structured items generated in batches, one row for each asked one.

    ``load`` makes the generator once in each worker.  A batch whose ids do not come back as asked, or that fails for
    good, gives its items without result and with the error, so that a local fallback can take them.
    """
    kind = items.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        service = load()
        for part in parts:
            records = part.to_dict("records")
            rows = []
            for at in range(0, len(records), batch):
                own = records[at : at + batch]
                ids = [r[key] for r in own]
                try:
                    found = with_retries(lambda own=own: service.generate(own), attempts, wait)
                    if not same_identities(ids, [f.get(key) for f in found]):
                        raise ValueError("identity mismatch")
                    by_id = {f[key]: json.dumps(f, ensure_ascii=False, sort_keys=True) for f in found}
                    rows += [(i, by_id[i], "") for i in ids]
                except Exception as error:  # noqa: BLE001  one failed batch does not lose the others
                    rows += [(i, None, f"{type(error).__name__}: {error}") for i in ids]
            yield pd.DataFrame(rows, columns=[key, "result", "error"])

    return items.mapInPandas(run, f"`{key}` {kind}, result string, error string")
