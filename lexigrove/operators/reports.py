"""Inspection reports and plans: findings grouped and ranked, evidence joined, lines assembled, values projected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LEVELS, basename, damage_level, level_rank
from .reconcile import last_wins, reconcile


def category_of(label: Column, aliases: dict[str, str]) -> Column:
    """Category of a damage label by alias, ``other`` where there is none."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.lit(None).cast("map<string,string>")
    key = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)[\s_-]+", ""))
    return F.coalesce(F.element_at(names, key), F.lit("other"))


def by_category(findings: DataFrame, category: str = "category", level: str = "level") -> DataFrame:
    """Count and highest level of each category, with the pictures concerned."""
    rows = findings.withColumn("_rank", level_rank(F.col(level)))
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.count_distinct("image_name").alias("n_images"), F.max_by(level, "_rank").alias("highest"))


def overall_level(findings: DataFrame, level: str = "level") -> DataFrame:
    """Highest level of all findings, one row; undetermined if there are none."""
    return findings.agg(F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce(F.max(level_rank(F.col(level))), F.lit(0)).cast("int") + 1).alias("level"), F.count("*").alias("n"))


def template_values(findings: DataFrame, categories: list[str]) -> DataFrame:
    """One row of ``<category>_count`` and ``<category>_level`` values for each run."""
    rows = findings.withColumn("_rank", level_rank(F.col("level")))
    values = [v for c in categories for v in (F.count_if(F.col("category") == c).alias(f"{c}_count"), F.max_by(F.when(F.col("category") == c, F.col("level")), F.when(F.col("category") == c, F.col("_rank"))).alias(f"{c}_level"))]
    return rows.groupBy("run_id").agg(*values, F.count("*").alias("total_count"))


# Categories of damage (field prefix, key, name, accepted spellings), level names and phrases of the report.
CATEGORIES = [
    ("f1", "non_structural", "非结构裂缝", ["microcrack", "non structural crack", "非结构裂缝", "微裂缝"]),
    ("f2", "structural", "结构裂缝", ["structural crack", "结构裂缝"]),
    ("f3", "minor_spalling", "轻微剥落", ["minor spalling", "轻微剥落"]),
    ("f4", "moderate_spalling", "中度剥落", ["moderate spalling", "中度剥落"]),
    ("f5", "major_spalling", "严重剥落/脱层", ["major spalling", "severe spalling", "delamination", "严重剥落", "脱层"]),
    ("f6", "rebar_damage", "钢筋腐蚀/钢筋暴露", ["rebar corrosion", "rebar exposure", "steel corrosion", "钢筋腐蚀", "露筋"]),
    ("f7", "concrete_crushing", "混凝土压碎", ["concrete crushing", "混凝土压碎"]),
    ("f8", "deformation", "结构变形", ["deformation", "structural deformation", "结构变形"]),
]
LEVEL_NAMES = {"undetermined": "待判定", "low": "低", "medium": "中", "high": "高", "critical": "危急"}
CONFIRMED, UNCONFIRMED = "AI辅助判断，已人工确认", "AI辅助判断，待人工复核"
NOT_PROVIDED, NOT_APPLICABLE, NOT_DETECTED, YES, NO = "未提供", "不适用（无尺度换算）", "未检出", "是", "否"
CRACKS, DEFECTS, SHAPE = CATEGORIES[:2], CATEGORIES[2:7], CATEGORIES[7:]
NO_ACTION = "由专业工程师结合现场尺度、构件资料和检测规范复核后确定处置。"


def damage_category(label: Column) -> Column:
    """Key of the category that a damage type is a spelling of, or NULL."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"(?U)[\s_-]+", " "))
    names = F.create_map(*[F.lit(x) for _, key, _, spellings in CATEGORIES for s in spellings for x in (s, key)])
    return F.element_at(names, plain)


def report_values(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """(report_id, values): the template's values of each report as a map.  Pixels are never turned into quantities.

    ``findings``: report_id, position, damage_type, level, recommended_action; ``reports``: report_id, confirmed,
    overall_level (may be NULL), asset_id, component, project_name, inspection_time, n_images.
    One aggregate per report gives each category's count and highest level; everything else is a projection of it.
    """
    rank = F.greatest(F.coalesce(level_rank(F.lower("level")), F.lit(0)), F.lit(0))
    rows = findings.select("report_id", "position", damage_category(F.col("damage_type")).alias("key"), rank.alias("rank"), F.trim(F.coalesce("recommended_action", F.lit(""))).alias("action"))
    per = [v for _, key, _, _ in CATEGORIES for v in (F.count_if(F.col("key") == key).alias(f"n_{key}"), F.max(F.when(F.col("key") == key, F.col("rank"))).alias(f"r_{key}"))]
    actions = F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("position", "action"))), lambda x: x["action"] != ""), lambda x: x["action"]))
    grouped = rows.groupBy("report_id").agg(*per, F.count("*").alias("n_all"), F.max("rank").alias("r_all"), actions.alias("actions"))
    met = reports.join(grouped, "report_id", "left")
    text = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(NOT_PROVIDED))
    names = F.array(*[F.lit(LEVEL_NAMES[x]) for x in LEVELS])
    suffix = F.when(F.coalesce("confirmed", F.lit(False)), CONFIRMED).otherwise(UNCONFIRMED)
    label = lambda r: F.concat(F.element_at(names, (F.coalesce(r, F.lit(0)) + 1).cast("int")), F.lit("（"), suffix, F.lit("）"))
    high = len(LEVELS) - 2
    warn = lambda r: F.when(F.coalesce(r, F.lit(0)) >= high, YES).otherwise(NO)
    n, r = (lambda key: F.coalesce(f"n_{key}", F.lit(0))), (lambda key: F.col(f"r_{key}"))
    level = lambda key: F.when(n(key) > 0, label(r(key))).otherwise(NOT_DETECTED)
    worst = lambda kinds: F.greatest(*[r(k) for _, k, _, _ in kinds], F.lit(None).cast("int"))
    listed = lambda kinds: F.coalesce(F.nullif(F.concat_ws("、", *[F.when(n(k) > 0, name) for _, k, name, _ in kinds]), F.lit("")), F.lit(NOT_DETECTED))
    of = lambda kinds: F.when(worst(kinds).isNotNull(), label(worst(kinds))).otherwise(NOT_DETECTED)
    overall = F.coalesce(level_rank(F.lower("overall_level")), F.col("r_all"), F.lit(0))
    values: dict[str, Column] = {
        "project_name": text("project_name"), "component_name": text("component"), "component_id": text("asset_id"), "c11": text("asset_id"), "inspection_date": text("inspection_time"),
        "c14": F.coalesce("n_images", F.lit(0)).cast("string"), "c15": label(overall), "assessment_level": label(overall), "overall": label(overall), "finding_summary": listed(CATEGORIES), "crack_types": listed(CRACKS),
        "surface_damage_types": listed(DEFECTS), "crack": of(CRACKS), "defect": of(DEFECTS), "deform": of(SHAPE), "deformation_warning": warn(worst(SHAPE)), "warn": F.when(overall >= high, "存在").otherwise("不存在"),
        "recommendation_text": F.coalesce(F.nullif(F.array_join("actions", "；"), F.lit("")), F.lit(NO_ACTION)), "n_findings": F.coalesce("n_all", F.lit(0)).cast("string"),
    }
    for prefix, key, name, _ in CATEGORIES:
        crack = key in ("non_structural", "structural")
        values |= {f"{prefix}n": n(key).cast("string"), f"{prefix}g": level(key), f"{prefix}x": F.when(n(key) > 0, warn(r(key))).otherwise(NO), f"{key}_assessment_level" if crack else f"{key}_level": level(key)}
        values |= dict.fromkeys([f"{prefix}a", *((f"{prefix}w", f"{prefix}l", f"{key}_max_width") if crack else (f"{prefix}r", f"{key}_ratio"))], F.lit(NOT_APPLICABLE))
        if crack:
            values[f"{key}_warning"] = warn(r(key))
    values |= dict.fromkeys(["c21", "c22", "c23", "c24", "c25", "maximum_width", "area_ratio"], F.lit(NOT_APPLICABLE))
    values |= dict.fromkeys(["component_location", "component_type", "dimensions", "concrete_grade", "cover_thickness", "environment_class", "component_importance", "inspection_unit", "c12", "c13"], F.lit(NOT_PROVIDED))
    return met.select("report_id", F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).alias("values"))


#: Words of a project's description, and what each asks of the report, of checks and of safety.
PROJECT_RULES = [
    (["地下室", "地下空间", "地下工程"], "underground"), (["停车库", "地下车库", "车库"], "parking"), (["设备机房", "机房"], "plant_room"), (["防火", "消防"], "fire"),
    (["荷载传递", "空间支撑", "主体结构", "抗震"], "structure"), (["居民楼", "住宅", "小区"], "residential"),
]


def project_topics(overview: Column) -> Column:
    """Topics of PROJECT_RULES whose words a project's description holds, in rule order."""
    t = F.coalesce(overview, F.lit(""))
    return F.array_compact(F.array(*[F.when(reduce(lambda x, y: x | y, [F.contains(t, F.lit(w)) for w in words]), topic) for words, topic in PROJECT_RULES]))


def project_notes(projects: DataFrame, notes: DataFrame) -> DataFrame:
    """(project_id, kind, notes): the notes of each project's topics, in rule order.

    ``projects``: project_id, overview; ``notes``: topic, kind (report, check or safety), note.
    """
    topics = projects.select("project_id", F.posexplode(project_topics(F.col("overview"))).alias("at", "topic"))
    listed = F.array_sort(F.collect_list(F.struct("at", "note")))
    return topics.join(notes, "topic").groupBy("project_id", "kind").agg(listed.alias("n")).select("project_id", "kind", F.transform("n", lambda x: x["note"]).alias("notes"))


def review_ready(report: DataFrame) -> DataFrame:
    """(rule, report_id) of what keeps reports from being confirmed: no reviewer, an open level, or findings that do not correspond.

    ``report``: report_id, reviewer, levels (array), n_expected, n_actual.
    """
    rules = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "reviewer_missing"), F.when(F.array_contains("levels", "undetermined"), "level_undetermined"),
            F.when(F.col("n_expected") != F.col("n_actual"), "correspondence"),
        )
    )
    return report.select(F.explode(rules).alias("rule"), "report_id")


def _report(rows: DataFrame) -> list[Column]:
    """What numbers one report apart from another: its run or report id, where the rows have one."""
    return [F.col(c) for c in ("run_id", "report_id") if c in rows.columns] or [F.lit(0)]


def repair_lines(findings: DataFrame, images: DataFrame, rules: DataFrame) -> DataFrame:
    """Numbered repair lines: each finding with its picture's evidence (last row wins) and the method of its category.

    ``findings``: position, image_name, finding_index, category, level; ``images``: image_name, pos, path; ``rules``: category, method.
    """
    evidence = last_wins(images, ["image_name"], "pos").select("image_name", "path")
    met = findings.join(evidence, "image_name", "left").join(rules, "category", "left")
    number = F.row_number().over(Window.partitionBy(*_report(findings)).orderBy("position", "image_name", "finding_index"))
    return met.select(F.format_string("W-%03d", number).alias("line_id"), "position", "image_name", "finding_index", "category", damage_level(F.col("level")).alias("level"), F.coalesce("method", F.lit("review")).alias("method"), "path", F.col("path").isNotNull().alias("has_image"))


def assemble_plan(lines: DataFrame, drafts: DataFrame) -> DataFrame:
    """Lines with their drafts by position; a line without a draft keeps its place."""
    return lines.join(drafts.withColumnRenamed("position", "_p"), F.col("position") == F.col("_p"), "left").drop("_p")


def merge_review(items: DataFrame, edits: DataFrame, key: str, editable: list[str]) -> DataFrame:
    """Reviewed values replace the draft's in the editable columns only."""
    own = edits.select(key, *[F.col(c).alias(f"_{c}") for c in editable])
    return items.join(own, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in editable else F.col(c) for c in items.columns if c != key])


def unique_append(drafts: DataFrame, by: str, values: str) -> DataFrame:
    """Distinct values of ordered drafts in order of first appearance."""
    rows = drafts.select(by, "draft_no", F.posexplode(values).alias("pos", "value")).where("value <> ''")
    first = rows.groupBy(by, "value").agg(F.min(F.struct("draft_no", "pos")).alias("at"))
    return first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select(by, F.transform("v", lambda x: x["value"]).alias(values))


def correspondence(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Findings that a report lacks, repeats or adds."""
    return reconcile(expected, actual, "image_name", "finding_index")


def render_selection(lines: DataFrame, most: int) -> DataFrame:
    """Pictures to render: most severe first, at most ``most``; with counts of what was left."""
    ranked = lines.where("has_image").withColumn("_r", level_rank(F.col("level"))).withColumn("place", F.row_number().over(Window.partitionBy(*_report(lines)).orderBy(F.col("_r").desc(), "line_id")))
    return ranked.withColumn("selected", F.col("place") <= most).drop("_r")


def profile_query(values: DataFrame, most: int = 900) -> DataFrame:
    """Search text of each report from its field values: no paths, hashes, JSON or long texts, each value once, cut at max(120, most)."""
    t = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    kept = values.withColumn("t", t).where((F.col("t") != "") & (F.length("t") <= 240) & ~F.col("t").rlike(r"^[\[{]|^[A-Z]:\\") & ~F.col("t").rlike("^[0-9a-fA-F]{12,}$"))
    first = F.row_number().over(Window.partitionBy("report_id", F.lower("t")).orderBy("position"))
    once = kept.withColumn("_n", first).where("_n = 1")
    joined = once.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("position", "t"))).alias("v"))
    return joined.select("report_id", F.substring(F.array_join(F.transform("v", lambda x: x["t"]), " "), 1, max(120, most)).alias("query"))


def citation_catalog(rows: DataFrame) -> DataFrame:
    """(marker, document_id, source_name, location) of markers that stand for one file only; conflicting markers are dropped entirely.

    ``rows``: marker, document_id, source_name.  A marker names its document; of the source name only the last part
    of a path stays, so two paths to one name are no conflict; rows whose marker is malformed or names another document do not count.
    """
    form = r"^\[KB:([^:\]]+):([^\]]+)\]$"
    named = rows.select(F.trim("marker").alias("marker"), F.trim(F.col("document_id").cast("string")).alias("document_id"), F.trim(basename(F.col("source_name"))).alias("source_name"))
    ok = named.where(F.col("marker").rlike(form) & (F.regexp_extract("marker", form, 1) == F.col("document_id")) & (F.col("source_name") != ""))
    # least and greatest name instead of a set of them: a partial aggregate of fixed size
    found = ok.groupBy("marker", "document_id").agg(F.min("source_name").alias("source_name"), F.max("source_name").alias("_last")).where("source_name = _last")
    return found.select("marker", "document_id", "source_name", F.regexp_extract("marker", form, 2).alias("location"))


def unknown_references(references: DataFrame, retrieved: DataFrame, key: str = "draft_id") -> DataFrame:
    """(key, marker) of references to what was not retrieved for the same draft, once each; a draft with any is to be refused.

    ``references`` and ``retrieved``: the key and marker.  Null markers refer to nothing.
    """
    asked = references.select(key, F.trim("marker").alias("marker")).where("marker <> ''").distinct()
    return asked.join(retrieved.select(key, F.trim("marker").alias("marker")), [key, "marker"], "left_anti")


def render_citations(texts: DataFrame, catalog: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """Known markers become their source names, unknown ones ``[unverified]``; a cut marker at the end is held back."""
    whole = F.regexp_replace(text, r"\[KB:[^\]]*$", "")
    marks = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(whole, F.lit(r"(\[KB:[^\]]+\])"), F.lit(1)))).alias("marker"))
    names = marks.join(catalog, "marker", "left").select(key, "marker", F.coalesce(F.concat(F.lit("["), "source_name", F.lit("]")), F.lit("[unverified]")).alias("name"))
    lookup = names.groupBy(key).agg(F.collect_list(F.struct("marker", "name")).alias("m"))
    fold = F.aggregate(F.coalesce("m", F.array().cast("array<struct<marker:string,name:string>>")), whole, lambda a, x: F.replace(a, x["marker"], x["name"]))
    return texts.join(lookup, key, "left").withColumn(text, fold).drop("m")


def common_heading(paths: Column) -> Column:
    """Longest common beginning of heading paths (array of arrays)."""
    first = F.get(paths, 0)
    same = lambda i: F.forall(paths, lambda p: F.coalesce(F.get(p, i) == F.get(first, i), F.lit(False)))
    upto = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(first) - 1, F.lit(0))), F.lit(0), lambda a, i: F.when((a == i) & same(i), a + 1).otherwise(a))
    return F.when(F.size(paths) > 0, F.slice(first, F.lit(1), upto)).otherwise(F.array().cast("array<string>"))


#: Fixed value: what marks items that no service wrote.
LOCAL = "local_fallback"


def fallback_items(findings: DataFrame, phrases: DataFrame) -> DataFrame:
    """Report items from the findings alone: description and action of the category's phrases, for review by a person.

    ``findings``: report_id, position, image_name, finding_index, damage_type, level; ``phrases``: key, description, action.
    """
    rows = findings.withColumn("key", F.coalesce(damage_category(F.col("damage_type")), F.lit("other"))).join(phrases, "key", "left")
    return rows.select(
        "report_id", "position", "image_name", "finding_index", "damage_type", F.coalesce(F.lower("level"), F.lit(LEVELS[0])).alias("level"), F.coalesce("description", F.col("damage_type"), F.lit("")).alias("description"),
        F.coalesce(F.nullif(F.col("action"), F.lit("")), F.lit(NO_ACTION)).alias("recommended_action"), F.lit(LOCAL).alias("source"), F.lit(True).alias("needs_review"),
    )


def render_report(reports: DataFrame, items: DataFrame) -> DataFrame:
    """(report_id, markdown): title, level and one section for each item in order.

    ``reports``: report_id, title, overall_level; ``items``: report_id, position, image_name, damage_type, level, description, recommended_action.
    """
    names = F.create_map(*[F.lit(x) for pair in LEVEL_NAMES.items() for x in pair])
    level = lambda c: F.coalesce(F.element_at(names, F.lower(c)), F.lit(LEVEL_NAMES[LEVELS[0]]))
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("position", "image_name"))
    section = F.concat_ws("\n", F.concat(F.lit("## "), place.cast("string"), F.lit(". "), F.coalesce("damage_type", F.lit("")), F.lit(" – "), level("level")), F.concat(F.lit("`"), "image_name", F.lit("`")), F.lit(""), F.nullif(F.col("description"), F.lit("")), F.concat(F.lit("> "), "recommended_action"))
    parts = items.select("report_id", place.alias("n"), section.alias("s")).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("p"))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), level("overall_level"))
    return reports.join(parts, "report_id", "left").select("report_id", F.concat_ws("\n\n", head, F.array_join(F.transform("p", lambda x: x["s"]), "\n\n")).alias("markdown"))


def render_plan(plans: DataFrame, lines: DataFrame) -> DataFrame:
    """(report_id, markdown): a plan's lines as one table, in order of their numbers.

    ``plans``: report_id, title; ``lines``: report_id, line_id, image_name, category, level, method.
    """
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    columns = ["line_id", "image_name", "category", "level", "method"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    parts = lines.select("report_id", "line_id", row.alias("s")).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "s"))).alias("p"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = F.when(F.size("p") > 0, F.concat_ws("\n", F.lit(head), F.array_join(F.transform("p", lambda x: x["s"]), "\n")))
    return plans.join(parts, "report_id", "left").select("report_id", F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), body).alias("markdown"))


def generation_manifest(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Audit rows of answers: which passages each saw, without their texts, and one digest of all of its evidence.

    ``answers``: answer_id, model, template_version, source_mode; ``chunks``: answer_id, rank, chunk_id, document_id, role, text.
    """
    seen = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "role")))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.sha2("text", 256).alias("h")))), lambda x: F.concat_ws(":", x["chunk_id"], x["h"])), "\n"), 256)
    own = chunks.groupBy("answer_id").agg(seen.alias("retrieved"), digest.alias("evidence_digest"))
    return answers.join(own, "answer_id", "left")
