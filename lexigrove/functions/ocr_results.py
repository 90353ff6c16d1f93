"""Recognition results of any shape as rows, by VARIANT expressions.

Recognisers return columns (``{"boxes"|"polys": [...], "txts"|"texts": [...], "scores"|"scores_list": [...]}``), rows
(``[[box, text, score], ...]``, the score left out or null), or such rows with the time they took (``[rows, seconds]``).
Results come as JSON text.  What is missing stays null: no box or confidence is made up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that the columns of a result go by, the first that is there counts.
BOXES, TEXTS, SCORES = ("boxes", "polys"), ("txts", "texts"), ("scores", "scores_list")

_LIST = "array<variant>"


def _list(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, _LIST)


def _first(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_list(value, f"$.{n}") for n in names])


def _triple(box: Column, text: Column, score: Column) -> Column:
    return F.struct(box.alias("box"), text.alias("text"), score.alias("score"))


def triples(value: Column) -> Column:
    """A VARIANT result as an array of (box, text, score), each a VARIANT or null."""
    texts, boxes, scores = _first(value, TEXTS), _first(value, BOXES), _first(value, SCORES)
    columns = F.transform(texts, lambda t, i: _triple(F.get(boxes, i), t, F.get(scores, i)))
    rows = _list(value)
    timed = (F.size(rows) == 2) & _list(F.get(rows, F.lit(0))).isNotNull() & F.schema_of_variant(F.get(rows, F.lit(1))).rlike("^(?!ARRAY|OBJECT)")
    rows = F.when(timed, _list(F.get(rows, F.lit(0)))).otherwise(rows)
    whole = F.filter(F.transform(rows, lambda r: _list(r)), lambda r: F.size(r) >= 2)
    return F.coalesce(columns, F.transform(whole, lambda r: _triple(F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.get(r, F.lit(2)))))


def corners(box: Column) -> Column:
    """[x0, y0, x1, y1] around a polygon's points; null where a point is no pair of numbers."""
    points = F.try_variant_get(box, "$", "array<array<double>>")
    sound = (F.size(points) > 0) & F.forall(points, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    axis = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    return F.when(sound, F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1))))


def ocr_rows(results: DataFrame, column: str = "result") -> DataFrame:
    """The other columns with one row a recognised text: order (from 0), text (trimmed, never empty), bbox, confidence.

    A result that is null, no JSON, or of another shape gives no rows.
    """
    rest = [c for c in results.columns if c != column]
    rows = results.select(*rest, F.posexplode(triples(F.try_parse_json(F.col(column)))).alias("order", "t"))
    text = F.trim(F.regexp_replace(F.try_variant_get("t.text", "$", "string"), r"^\s+|\s+$", ""))
    made = rows.select(*rest, "order", text.alias("text"), corners(F.col("t.box")).alias("bbox"), F.try_variant_get("t.score", "$", "double").alias("confidence"))
    return made.where(F.col("text") != "")
