"""Label files as a data source with a commit: a file an image, ``dataset.yaml`` and ``manifest.csv`` appear together or not at all.

    spark.dataSource.register(LabelFiles)
    rows.write.format("label_files").option("path", folder).option("names", "crack,spall").mode("append").save()

``rows``: split, stem, lines.  Tasks write below a folder of the job's own beside the target; the commit adds
the two small files and renames that folder, once.  A task that is run again replaces its own files by equal
ones; a job that fails leaves nothing, and one whose driver died leaves no target, only a folder that
``leftovers`` names.  ``mode("overwrite")`` keeps the old data set until the rename.
"""

from __future__ import annotations

import contextlib
import csv
import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .annotations import dataset_yaml
from .shared_files import local_path

COLUMNS = ("split", "stem", "lines")
MANIFEST = ("split", "stem", "file", "n_lines", "sha256")


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int


class LabelWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        found = local_path(options["path"])
        if found is None:
            raise ValueError("label files are written to a path that driver and executors mount")
        self.path, self.names, self.overwrite = found.rstrip("/"), [n for n in options.get("names", "").split(",") if n], overwrite
        self.scratch = f"{self.path}.{uuid.uuid4().hex}.writing"
        os.makedirs(f"{self.scratch}/_parts")

    def write(self, rows: Iterator[Row]) -> Written:
        part, seen = TaskContext.get().partitionId(), 0
        own = f"{self.scratch}/_parts/{part:06d}.csv"
        mine = f"{own}.{uuid.uuid4().hex}"
        with open(mine, "w", encoding="utf-8", newline="") as listed:
            out = csv.writer(listed)
            for row in rows:
                split, stem, lines = (row[c] for c in COLUMNS)
                if not stem or os.path.basename(stem) != stem or os.path.basename(split or "") != (split or ""):
                    raise ValueError(f"no file name: {split!r}, {stem!r}")
                data = ((lines or "") + ("\n" if lines else "")).encode()
                file = f"labels/{split or 'train'}/{stem}.txt"
                where = f"{self.scratch}/{file}"
                for folder in (f"{self.scratch}/labels", os.path.dirname(where)):
                    with contextlib.suppress(FileExistsError):
                        os.mkdir(folder)  # not the job's folder: a task that outlives its job must not bring that back
                with open(f"{where}.{uuid.uuid4().hex}.part", "wb") as made:
                    made.write(data)
                os.replace(made.name, where)
                out.writerow((split or "train", stem, file, data.count(b"\n"), hashlib.sha256(data).hexdigest()))
                seen += 1
        os.replace(mine, own)
        return Written(f"{part:06d}.csv", seen)

    def commit(self, messages: list[Written | None]) -> None:
        parts = f"{self.scratch}/_parts"
        with open(f"{self.scratch}/manifest.csv", "wb") as whole:
            whole.write((",".join(MANIFEST) + "\r\n").encode())
            for message in sorted((m for m in messages if m is not None), key=lambda m: m.part):
                with open(f"{parts}/{message.part}", "rb") as file:
                    shutil.copyfileobj(file, whole)
        shutil.rmtree(parts)
        with open(f"{self.scratch}/dataset.yaml", "w", encoding="utf-8") as file:
            file.write(dataset_yaml(self.path, self.names))
        if os.path.exists(self.path):
            if not self.overwrite:
                shutil.rmtree(self.scratch)
                raise FileExistsError(self.path)
            old = f"{self.path}.{uuid.uuid4().hex}.replaced"
            os.rename(self.path, old)
            os.rename(self.scratch, self.path)
            shutil.rmtree(old)
        else:
            os.rename(self.scratch, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        """The folder is renamed first, so that tasks which still run find none to write to."""
        gone = f"{self.scratch}.gone"
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.scratch, gone)
        for _ in range(3):
            shutil.rmtree(gone, ignore_errors=True)


class LabelFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "split string, stem string, lines string"

    def writer(self, schema, overwrite: bool) -> LabelWriter:
        return LabelWriter(self.options, overwrite)


def leftovers(path: str) -> list[str]:
    """Folders that jobs whose driver died have left beside a target."""
    folder, name = os.path.split(path.rstrip("/"))
    return sorted(f"{folder}/{n}" for n in os.listdir(folder) if n.startswith(f"{name}.") and n.endswith(".writing"))
