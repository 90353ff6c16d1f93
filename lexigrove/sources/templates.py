"""DOCX templates: placeholders found, values and finding loops filled in, picture budgets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = re.compile(r"\{\{\s*([A-Za-z0-9_.#/ ]+?)\s*\}\}")
_LOOP = re.compile(r"\{\{\s*#each\s+(\w+)\s*\}\}(.*?)\{\{\s*/each\s*\}\}", re.S)
_RUNS = re.compile(r"(<w:t(?:\s[^>]*)?>)([^<]*)(</w:t>)")
_PARAGRAPH = re.compile(r"<w:p(?:\s[^>]*)?>.*?</w:p>", re.S)


def fill(text: str, values: dict) -> str:
    """Loops first, then keys; unknown keys stay as they are."""
    text = _LOOP.sub(lambda m: "".join(fill(m[2], {**values, **row}) for row in values.get(m[1], [])), text)
    return _KEY.sub(lambda m: str(values[m[1]]) if m[1] in values else m[0], text)


def _joined(paragraph: str) -> str:
    """A paragraph with a placeholder spread over runs gets its text in the first run."""
    parts = _RUNS.findall(paragraph)
    whole = "".join(p[1] for p in parts)
    if len(parts) < 2 or "{{" not in whole or _KEY.findall(whole) == [k for p in parts for k in _KEY.findall(p[1])]:
        return paragraph
    texts = iter([whole] + [""] * (len(parts) - 1))
    return _RUNS.sub(lambda m: m[1] + next(texts) + m[3], paragraph)


def _over_parts(content: bytes, change: Callable[[str], str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for entry in source.infolist():
            data = source.read(entry.filename)
            if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", entry.filename):
                data = change(data.decode("utf-8")).encode("utf-8")
            target.writestr(entry, data)
    return out.getvalue()


def placeholders(content: bytes) -> list[str]:
    """Keys of a template in order of first use."""
    found: list[str] = []

    def look(xml: str) -> str:
        found.extend(k for k in _KEY.findall(_PARAGRAPH.sub(lambda m: _joined(m[0]), xml)) if not k.startswith(("#", "/")))
        return xml

    _over_parts(content, look)
    return list(dict.fromkeys(found))


def render(content: bytes, values: dict) -> bytes:
    """The template with values filled in; texts are escaped for XML."""
    from xml.sax.saxutils import escape

    def safe(v):
        return [{k: escape(str(x)) for k, x in row.items()} for row in v] if isinstance(v, list) else escape(str(v))

    clean = {k: safe(v) for k, v in values.items()}
    return _over_parts(content, lambda xml: fill(_PARAGRAPH.sub(lambda m: _joined(m[0]), xml), clean))


@F.pandas_udf(T.ArrayType(T.StringType()))
def template_keys(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [] if v is None else placeholders(bytes(v)))


def attachments(images: DataFrame, most: int, most_each: int, most_total: int, by: str = "report_id") -> DataFrame:
    """Pictures within a count, a size each and a total, in order; ``reason`` says why one is left out.

    ``images``: report_id, position, n_bytes.  A picture that is too large by itself uses up nothing.
    """
    fits = F.col("n_bytes") <= most_each
    order = Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(fits, F.col("n_bytes")).otherwise(0)).over(order)
    place = F.sum(F.when(fits, 1).otherwise(0)).over(order)
    return images.withColumn("reason", F.when(~fits, "too_large").when(place > most, "count").when(used > most_total, "total").otherwise("included"))


def fit_inside(width: int, height: int, box_width: int, box_height: int) -> tuple[int, int]:
    """Largest size with the same proportions inside a box."""
    scale = min(box_width / width, box_height / height)
    return max(1, round(width * scale)), max(1, round(height * scale))


def shrink(encode: Callable[[float, int], bytes], most: int, quality: int = 90, tries: int = 10) -> tuple[bytes, float, int] | None:
    """Encoded picture of at most ``most`` bytes: quality goes down first, then the scale by 0.82 a step."""
    scale = 1.0
    for _ in range(tries):
        data = encode(scale, quality)
        if len(data) <= most:
            return data, scale, quality
        if quality > 50:
            quality -= 10
        else:
            scale *= 0.82
    return None
