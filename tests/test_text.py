"""Text and identity expressions on authored strings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import identity
from lexigrove.functions import text as X


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("expression", "value", "expected"),
    [
        (X.clean, " a\u00a0\r b\t\n c ", "a b c"),
        (X.clean_lines, " a  b \n\n c\t d ", "a b\nc d"),
        (X.index_clean, "a\u3000b\r\nc\u00a0d", "a b c\u00a0d"),
        (X.token_count, "裂缝宽度 0.3mm, ok!", 4 + 2 + 1 + 1),
        (X.char_count, "ab, cd", 5),
        (X.normal_standard, "GB 50010—2010", "gb50010-2010"),
        (X.normal_title, "Report (final).PDF", "reportfinal"),
        (X.normal_title, "桥梁检测(2).docx", "桥梁检测"),
        (X.clauses, "见 5.2.1 条和第3.4条, 5.2.1", ["5.2.1", "3.4"]),
        (X.standards, "按 GB 50010-2010 和 JGJ18—2016", ["gb50010-2010", "jgj18-2016"]),
        (X.standards, "见GB50010-2010", []),
        (X.leading_clause, "5.2.1 一般规定", "5.2.1"),
        (X.heading_of, "第3章 总则", "第3章 总则"),
        (X.heading_of, "3.1 This ends here.", ""),
        (X.explicit_terms, "Crack width 5.2.1 裂缝", ["crack", "width", "5.2.1", "裂缝"]),
        (X.fallback_terms, "如何处理裂缝", ["何处", "处理", "理裂", "裂缝", "如何处", "何处理", "处理裂", "理裂缝"]),
        (X.redact, "mail a.b@c.org key sk-abcdefghijklmnop1234", "mail [MAIL] key [KEY]"),
        (X.basename, "C:\\data\\x.pdf", "x.pdf"),
        (X.unwrap_url, "https://r.example/?uddg=https%3A%2F%2Fa.org%2Fx&y=1", "https://a.org/x"),
        (X.needs_web, "最新的检测结果", False),
        (X.needs_web, "请联网查最新检测结果", True),
        (X.failure_kind, "JSONDecodeError: x", "invalid_structured_output"),
        (X.failure_kind, "read Timed Out", "provider_unavailable"),
        (X.damage_level, "高風險", "high"),
        (X.compatibility, "Ｓtraße １", "strasse1"),
        (X.fold_any, "Résumé Straße", "resume straße"),
        (X.usable, " …! ", False),
    ],
)
def test_values(spark, expression, value, expected):
    assert one(spark, expression, value) == expected


@pytest.mark.parametrize(
    ("question", "kind"),
    [("GB 50010-2010 的要求", "exact_identifier"), ("5.2.1 说了什么", "exact_identifier"), ("查表得到的值", "table_query"), ("裂缝宽度限值", "numeric_unit"), ("什么情形不得施工", "risk_condition"), ("为什么开裂", "natural_semantic"), ("裂缝", "general"), ("concept", "numeric_unit")],
)
def test_route(spark, question, kind):
    assert one(spark, lambda c: X.route(c)["query_type"], question) == kind


def test_unknown_level_raises(spark):
    with pytest.raises(Exception, match="unsupported damage level"):
        one(spark, X.damage_level, "awful")


def test_identity(spark):
    row = spark.createDataFrame([("p", "d")], "a string, b string").select(identity.document_id(F.col("a"), F.col("b")).alias("i"), identity.content_hash(F.lit(" A\n b ")).alias("h"), identity.canonical_json(b=F.lit(1), a=F.lit("x")).alias("j"), identity.name_uuid(F.col("a")).alias("u")).first()
    assert row["i"] == hashlib.sha256(b"p:d").hexdigest()[:20] and row["h"] == hashlib.sha1(b"a b").hexdigest() and row["j"] == '{"a":"x","b":1}' and row["u"][14] == "5"


def test_table_digest_ignores_order(spark):
    rows = spark.range(500).withColumn("t", F.sha1(F.col("id").cast("string")))
    a, b = (identity.table_digest(r, "id", "t", buckets=16).first() for r in (rows, rows.orderBy(F.desc("t")).repartition(7)))
    assert a == b and a["n_rows"] == 500 and a != identity.table_digest(rows.where("id <> 3"), "id", "t", buckets=16).first()
