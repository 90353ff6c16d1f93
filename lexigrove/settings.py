"""Versioned library settings as one JSON file, and the command line: ``python -m lexigrove run NAME --tables DIR --out DIR``."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict, dataclass, field, fields

from .sources.files import write_pointer

VERSION = 2


@dataclass
class Retrieval:
    """Limits of searches and chunking."""

    top_k: int = 6
    max_chars: int = 10_000
    fusion_k: int = 60
    chunk_size: int = 1200
    chunk_overlap: int = 160


@dataclass
class Settings:
    version: int = VERSION
    retrieval: Retrieval = field(default_factory=Retrieval)
    scopes: dict[str, list[str]] = field(default_factory=dict)

    def problems(self) -> list[str]:
        """What keeps the settings from being used; none if they are sound."""
        r = self.retrieval
        found = [] if self.version == VERSION else [f"unsupported version {self.version}"]
        if r.chunk_size <= 0 or not 0 <= r.chunk_overlap < r.chunk_size:
            found.append("chunk size and overlap do not fit")
        if r.top_k < 1 or r.max_chars < 100 or r.fusion_k < 1:
            found.append("retrieval limits are too low")
        return found


def load(path: str) -> Settings:
    """Settings of a file, defaults if there is none.  Version 1 kept the retrieval limits at the top level; unknown fields go."""
    if not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    known = {f.name for f in fields(Retrieval)}
    limits = data.get("retrieval", data if data.get("version", 1) == 1 else {})
    version = VERSION if data.get("version", 1) == 1 else data["version"]
    return Settings(version, Retrieval(**{k: v for k, v in limits.items() if k in known}), {str(k): list(v) for k, v in data.get("scopes", {}).items()})


def save(settings: Settings, path: str) -> None:
    """Replaces the file as a whole; refuses settings that are not sound."""
    if found := settings.problems():
        raise ValueError("; ".join(found))
    write_pointer(path, asdict(settings))


def main(args: list[str] | None = None) -> None:
    from .plans import registry
    from .session import session

    parser = argparse.ArgumentParser(prog="lexigrove", description="Runs a registered query over a folder of Parquet tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("--tables", required=True, help="folder of <table>.parquet")
    run.add_argument("--out", required=True, help="folder that does not exist yet")
    run.add_argument("--master", default=None)
    asked = parser.parse_args(args)
    if asked.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    registry.QUERIES[asked.name](session(asked.master), asked.tables).write.mode("errorifexists").parquet(asked.out)
