"""Publication of a snapshot: gates, an exclusive lock, activation, rollback and status.  Driver-side by nature."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources import fencing
from ..sources.files import read_pointer, write_pointer
from .gates import decide


@contextmanager
def exclusive(path: str, stale_after: float = 3600.0, spark: SparkSession | None = None) -> Iterator[fencing.Lease]:
    """The lock that goes by ``path``, with its token; a lock whose owner is gone, or that is too old on another host, is followed."""
    with fencing.leased(f"{path}.tokens", stale_after, spark) as lease:
        yield lease


def _active(pointer: str) -> dict | None:
    """What the greatest token has published; a pointer file of older releases counts until somebody publishes."""
    found = fencing.current(f"{pointer}.published")
    return read_pointer(pointer) if found is None else found


def _publish(pointer: str, payload: dict, lease: fencing.Lease) -> None:
    """Files the payload under the holder's token, and shows what is newest in the pointer file, for readers of that."""
    fencing.publish(f"{pointer}.published", payload, lease)
    write_pointer(pointer, _active(pointer))


def activate(spark: SparkSession, pointer: str, snapshot: str, gates: Callable[[SparkSession, str], DataFrame], digest: Callable[[SparkSession, str], str]) -> dict:
    """Make a snapshot the active one if all gates pass and its digest is the same before and after they ran."""
    with exclusive(f"{pointer}.lock") as lease:
        before = digest(spark, snapshot)
        result = decide(gates(spark, snapshot)).first().asDict()
        if digest(spark, snapshot) != before:
            raise RuntimeError("the snapshot changed while it was checked")
        if not result["passed"]:
            raise RuntimeError(f"{result['n_failed']} of {result['n_gates']} gates failed")
        old = _active(pointer)
        payload = {"snapshot": snapshot, "digest": before, "previous": None if old is None else {k: old[k] for k in ("snapshot", "digest")}, "active": True}
        _publish(pointer, payload, lease)
        return payload


def rollback(pointer: str) -> dict:
    """Point to the snapshot before the active one."""
    with exclusive(f"{pointer}.lock") as lease:
        now = _active(pointer)
        if not now or not now.get("previous"):
            raise RuntimeError("there is no earlier snapshot")
        payload = {**now["previous"], "previous": None, "active": True}
        _publish(pointer, payload, lease)
        return payload


def deactivate(pointer: str) -> None:
    with exclusive(f"{pointer}.lock") as lease:
        now = _active(pointer)
        if now:
            _publish(pointer, {**now, "active": False}, lease)


def status(spark: SparkSession, pointer: str, digest: Callable[[SparkSession, str], str]) -> dict:
    """ready, inactive, missing or changed."""
    now = _active(pointer)
    if now is None:
        return {"state": "missing"}
    if not now.get("active"):
        return {"state": "inactive", **now}
    return {"state": "ready" if digest(spark, now["snapshot"]) == now["digest"] else "changed", **now}
