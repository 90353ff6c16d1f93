"""Long conversions with progress, cancellation and resumption.

The files that are not converted yet are dealt out to parts; each part is one Spark job under the conversion's own tag
and one commit of Spark's writer, so finished parts stay and a cancelled part leaves nothing that readers see.  A
watcher asks ``should_stop`` and reports progress while jobs run; stopping interrupts the tag, and with it only this
conversion's jobs, whatever else the session runs.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared_files import names


@dataclass
class Progress:
    """Files and parts of this run; ``skipped`` files had been converted before."""

    total: int
    skipped: int
    done: int = 0
    parts: int = 0
    parts_done: int = 0
    state: str = "running"


def converted(spark: SparkSession, target: str) -> DataFrame | None:
    """Rows of all finished parts."""
    found = [f"{target}/{n}" for n in names(spark, target) if n.startswith("part-") and "_SUCCESS" in names(spark, f"{target}/{n}")]
    return spark.read.option("mergeSchema", "true").parquet(*found) if found else None


def convert(
    files: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, key: str = "sha256", part_files: int = 1000,
    progress: Callable[[dict], None] | None = None, should_stop: Callable[[], bool] | None = None, every: float = 0.2,
) -> dict:
    """Converts the files (rows with ``key``) that ``target`` does not hold yet; returns the final progress.

    ``work`` turns rows of files into rows that keep ``key`` (every file gives one at least, so that it counts as done).
    Two numbers reach the driver.  State is ``done``, ``cancelled`` or, while it runs, ``running``; a failure is raised,
    and what was finished before it stays.
    """
    spark = files.sparkSession
    before = converted(spark, target)
    left = files if before is None else files.join(before.select(key).distinct(), key, "left_anti")
    total, open_files = files.count(), left.count()
    said = Progress(total, total - open_files, parts=-(-open_files // part_files))
    tag, run, over = f"convert-{uuid.uuid4().hex}", uuid.uuid4().hex, threading.Event()

    def tell() -> None:
        if progress is not None:
            progress(asdict(said))

    failure: list[BaseException] = []

    def work_through() -> None:
        spark.addTag(tag)
        try:
            for n in range(said.parts):
                if said.state == "cancelled":
                    return
                part = left.where(F.pmod(F.xxhash64(key), F.lit(said.parts)) == n)
                path = f"{target}/part-{run}-{n:06d}"
                work(part).write.parquet(path)
                said.parts_done += 1
                said.done += spark.read.parquet(path).select(key).distinct().count()
        except BaseException as error:  # noqa: BLE001  handed to the caller's thread
            failure.append(error)
        finally:
            spark.removeTag(tag)
            over.set()

    runner = threading.Thread(target=inheritable_thread_target(spark)(work_through), daemon=True)
    tell()
    runner.start()
    seen = 0
    while not over.wait(every):
        if said.parts_done != seen:
            seen = said.parts_done
            tell()
        if said.state == "running" and should_stop is not None and should_stop():
            said.state = "cancelled"
        if said.state == "cancelled":
            spark.interruptTag(tag)  # again until the runner has seen it: a job may just have been about to start
    runner.join()
    if said.state == "running":
        if failure:
            raise failure[0]
        said.state = "done"
    tell()
    return asdict(said)
