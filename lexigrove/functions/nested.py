"""Nested values: recursive masking of secrets and paths, canonical JSON, citations anywhere in a structure."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose values are blanked.
SECRET_KEYS = re.compile(r"token|secret|password|passwd|api[_-]?key|authorization|credential", re.I)
_ABSOLUTE = re.compile(r"^(?:[A-Za-z]:[\\/]|/|\\\\)")
_REDACT = [(re.compile(r"\bsk-[A-Za-z0-9._-]{8,}\b"), "<redacted>"), (re.compile(r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+"), r"\1<redacted>")]


def sanitise(value, key: str = ""):
    """Blank under secret keys, base name for absolute paths, secrets in texts masked; everything else as it is."""
    if key and SECRET_KEYS.search(key):
        return "" if isinstance(value, str) else None
    if isinstance(value, dict):
        return {k: sanitise(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [sanitise(v) for v in value]
    if isinstance(value, str):
        if _ABSOLUTE.match(value) and "\n" not in value:
            return re.split(r"[\\/]", value.rstrip("\\/"))[-1]
        for pattern, mark in _REDACT:
            value = pattern.sub(mark, value)
    return value


def absolute_paths(value, at: str = "$") -> list[str]:
    """Places of absolute paths in a structure."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in absolute_paths(v, f"{at}.{k}")]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in absolute_paths(v, f"{at}[{i}]")]
    return [at] if isinstance(value, str) and _ABSOLUTE.match(value) else []


def url_citations(value) -> dict[str, str]:
    """URL to title of every citation anywhere in a structure; the last one of a URL wins."""
    out: dict[str, str] = {}
    if isinstance(value, dict):
        url = str(value.get("url") or "")
        if url.startswith(("http://", "https://")) and value.get("title"):
            out[url] = str(value["title"])
        for v in value.values():
            out |= url_citations(v)
    elif isinstance(value, list):
        for v in value:
            out |= url_citations(v)
    return out


def _over_json(text: str | None, function, fallback):
    try:
        return function(json.loads(text)) if text else fallback
    except ValueError:
        return fallback


@F.pandas_udf(T.StringType())
def sanitise_json(values: pd.Series) -> pd.Series:
    """JSON text after ``sanitise``; text that is no JSON is masked as text."""
    return values.map(lambda v: None if v is None else _over_json(v, lambda x: json.dumps(sanitise(x), ensure_ascii=False, sort_keys=True), sanitise(v)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def path_places(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _over_json(v, absolute_paths, []))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def citations(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _over_json(v, url_citations, {}))


def strict_schema(schema: dict) -> dict:
    """A JSON schema in which every object lists all its properties as required and allows no others."""
    if isinstance(schema, list):
        return [strict_schema(s) for s in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(v) for k, v in schema.items() if k != "default"}
    if isinstance(out.get("properties"), dict):
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out
