"""A lock on the shared file system whose holders have growing tokens, and a pointer that only goes forward.

A lock is a folder of small files that are created once and never deleted while they matter: token N's file
says who holds it and until when, ``N.released`` that it has been given back.  Whoever creates the file after
the newest one holds the lock; of several that see a stale holder, one can create it.  A holder that was only
slow cannot do harm: what it publishes is filed under its own, smaller token, and readers take the greatest.
"""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .shared_files import create_once, modified, names, read_bytes


class Held(TimeoutError):
    """Somebody else has the lock."""


class Fenced(RuntimeError):
    """A later holder has published meanwhile, or has taken the lock."""


@dataclass
class Lease:
    path: str
    token: int
    spark: SparkSession | None = None

    def renew(self) -> None:
        """Starts the lease's time anew, under the same token; raises Fenced if another token is out."""
        if newest(self.spark, self.path) != self.token:
            raise Fenced(f"{self.path}: token {self.token} has been followed")
        n = sum(x.startswith(f"{self.token:012d}.renewed") for x in names(self.spark, self.path))
        create_once(self.spark, f"{self.path}/{self.token:012d}.renewed-{n:06d}", json.dumps({"time": time.time()}).encode())

    def release(self) -> None:
        create_once(self.spark, f"{self.path}/{self.token:012d}.released", b"{}")


def newest(spark: SparkSession | None, path: str) -> int:
    """The greatest token given out; 0 for none."""
    return max((int(n[:-5]) for n in names(spark, path) if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _state(spark: SparkSession | None, path: str, token: int, lasts: float) -> str:
    """free, held or stale."""
    found = names(spark, path)
    if not token or f"{token:012d}.released" in found:
        return "free"
    file = f"{path}/{token:012d}.json"
    marks = [f"{path}/{n}" for n in found if n.startswith(f"{token:012d}.renewed")]
    seen = max(modified(spark, f) for f in [file, *marks])
    try:
        owner = json.loads(read_bytes(spark, file))
    except ValueError:  # a file system that creates and fills in two steps: its time tells all the same
        owner = {}
    if owner.get("host") == socket.gethostname() and isinstance(owner.get("pid"), int):
        try:
            os.kill(owner["pid"], 0)
        except ProcessLookupError:
            return "stale"
        except PermissionError:
            pass
    return "stale" if time.time() - seen > owner.get("lasts", lasts) else "held"


def acquire(path: str, lasts: float = 3600.0, spark: SparkSession | None = None) -> Lease:
    """The lock with a new token; raises Held if another has it and is neither gone nor overdue."""
    now = newest(spark, path)
    if _state(spark, path, now, lasts) == "held":
        raise Held(f"locked: {path}")
    mine = {"pid": os.getpid(), "host": socket.gethostname(), "lasts": lasts}
    if not create_once(spark, f"{path}/{now + 1:012d}.json", json.dumps(mine).encode()):
        raise Held(f"locked: {path}")  # another one was first
    return Lease(path, now + 1, spark)


@contextmanager
def leased(path: str, lasts: float = 3600.0, spark: SparkSession | None = None) -> Iterator[Lease]:
    lease = acquire(path, lasts, spark)
    try:
        yield lease
    finally:
        lease.release()


def publish(pointer: str, value: dict, lease: Lease) -> None:
    """Makes ``value`` the pointer's, once a token; raises Fenced where a later holder has published before."""
    if (held := _published(lease.spark, pointer)) and held[-1] > lease.token:
        raise Fenced(f"{pointer}: token {held[-1]} came after {lease.token}")
    if not create_once(lease.spark, f"{pointer}/{lease.token:012d}.json", json.dumps(value).encode()):
        raise Fenced(f"{pointer}: token {lease.token} has been used")


def _published(spark: SparkSession | None, pointer: str) -> list[int]:
    return [int(n[:-5]) for n in names(spark, pointer) if n.endswith(".json")]


def current(pointer: str, spark: SparkSession | None = None) -> dict | None:
    """The value of the greatest token: a write that was overtaken is never seen, even if it comes after all checks."""
    held = _published(spark, pointer)
    return json.loads(read_bytes(spark, f"{pointer}/{held[-1]:012d}.json")) if held else None
