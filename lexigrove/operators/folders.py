"""Folder trees as materialised paths: closure, cascade, scope resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import folder_id


def below(path: Column, root: Column) -> Column:
    """Is ``path`` the folder or inside it?  A name that is a prefix of another is not."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path and all paths above it, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def closure(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, relative_path) of every folder inside each root, by equi-join on exploded ancestors."""
    up = folders.select("relative_path", F.explode(ancestors(F.col("relative_path"))).alias("root"))
    return up.join(roots.select("root").distinct(), "root")


def closure_by_parent(folders: DataFrame, roots: list[str]) -> DataFrame:
    """The same by parent links (``folder_id``, ``parent_id``), breadth first in SQL recursion."""
    seeds = folders.sparkSession.createDataFrame([(r,) for r in roots], "folder_id string")
    return folders.sparkSession.sql(
        "WITH RECURSIVE t AS (SELECT folder_id, folder_id AS root, 0 AS depth FROM {seeds} UNION ALL SELECT f.folder_id, t.root, t.depth + 1 FROM {folders} f JOIN t ON f.parent_id = t.folder_id) SELECT * FROM t",
        seeds=seeds, folders=folders,
    )


def move(folders: DataFrame, old: str, new: str) -> DataFrame:
    """Rename or move a folder: every path inside it follows, and ids with the paths."""
    path = F.col("relative_path")
    moved = F.when(below(path, F.lit(old)), F.concat(F.lit(new), F.expr(f"substring(relative_path, {len(old) + 1})"))).otherwise(path)
    return folders.withColumn("relative_path", moved).withColumn("folder_id", folder_id(F.col("relative_path")))


def remove(folders: DataFrame, documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Folders without the removed subtree, and documents with their folder cleared if it was inside."""
    gone = below(F.col("relative_path"), F.lit(path))
    return folders.where(~gone), documents.withColumn("relative_path", F.when(gone, F.lit("")).otherwise(F.col("relative_path")))


def documents_below(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents in any root or below it, once each.  An empty closure is an empty scope."""
    up = documents.select("document_id", F.explode(ancestors(F.col("relative_path"))).alias("root"))
    return documents.join(up.join(roots.select("root").distinct(), "root").select("document_id").distinct(), "document_id", "left_semi")


def resolve_scope(documents: DataFrame, ids: DataFrame | None, roots: DataFrame | None) -> DataFrame:
    """Ready documents that are asked for by id and by folder; either may be absent, which means no limit."""
    out = documents.where("status = 'ready'")
    if ids is not None:
        out = out.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    if roots is not None:
        out = documents_below(out, roots)
    return out


def compare_scopes(active: DataFrame, resolved: DataFrame) -> DataFrame:
    """(document_id, part): what both scopes hold, what only the active one, what only the resolved one."""
    a, b = (rows.select("document_id").distinct().withColumn(name, F.lit(True)) for rows, name in ((active, "_a"), (resolved, "_b")))
    part = F.when(F.col("_a").isNull(), "resolved_only").when(F.col("_b").isNull(), "active_only").otherwise("both")
    return a.join(b, "document_id", "fullouter").select("document_id", part.alias("part"))


# -- edits ---------------------------------------------------------------------------
#
# ``folders``: folder_id, parent_id ('' at the top), name, relative_path.  ``edits``: edit_id, action (create, rename,
# move, delete), folder_id, parent_id, name; create needs parent_id and name, rename name, move parent_id.  A folder
# keeps its id when it is renamed or moved, so documents keep theirs.

#: Characters that names lose, and names that are none.
NAME_DROPS, NO_NAMES = r'[\\/:*?"<>|]+', ("", ".", "..")


def folder_name(name: Column) -> Column:
    """The name without characters that paths may not hold; NULL if nothing is left that names a folder."""
    bare = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), NAME_DROPS, ""))
    return F.when(~bare.isin(*NO_NAMES), bare)


def _placed(folders: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with the folder's own path (old), the path above its new place (above) and its new path (new)."""
    own = folders.select("folder_id", F.col("relative_path").alias("old"), F.col("parent_id").alias("_old_parent"), F.col("name").alias("_old_name"))
    rows = edits.select("edit_id", "action", "folder_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), folder_name(F.col("name")).alias("name")).join(own, "folder_id", "left")
    rows = rows.withColumn("parent_id", F.when(F.col("action") == "rename", F.col("_old_parent")).otherwise(F.col("parent_id")))
    rows = rows.withColumn("name", F.when(F.col("action") == "move", F.col("_old_name")).otherwise(F.col("name")))
    rows = rows.join(folders.select(F.col("folder_id").alias("parent_id"), F.col("relative_path").alias("_above")), "parent_id", "left")
    above = F.when(F.col("parent_id") == "", "").otherwise(F.col("_above"))
    new = F.when(F.col("action") != "delete", F.when(above == "", F.col("name")).otherwise(F.concat(above, F.lit("/"), F.col("name"))))
    return rows.withColumns({"above": above, "new": new}).drop("_old_parent", "_old_name", "_above")


def judge_edits(folders: DataFrame, edits: DataFrame) -> DataFrame:
    """(edit_id, action, folder_id, parent_id, name, old, new, problem) of every edit; no problem means it can be applied.

    All edits are judged on the folders as they are.  Edits of one batch must not touch each other: of those that
    change one folder, and of those that want one path, the one with the least edit_id counts (repeated, same_target), and
    a folder inside one that changes too, or a new place inside it, waits (nested, moving_parent).  A folder that
    is created where it stands already is no problem and changes nothing.
    """
    rows = _placed(folders, edits)
    taken = folders.select(F.col("relative_path").alias("new"), F.col("folder_id").alias("_holder"))
    rows = rows.join(taken, "new", "left")
    changes = F.col("action").isin("rename", "move", "delete")
    own = (
        F.when(~F.col("action").isin("create", "rename", "move", "delete") | F.col("action").isNull(), "unknown_action")
        .when(changes & F.col("old").isNull(), "no_folder")
        .when(F.col("action").isin("create", "rename") & F.col("name").isNull(), "bad_name")
        .when(F.col("action").isin("create", "move") & F.col("above").isNull(), "no_parent")
        .when((F.col("action") == "move") & below(F.col("above"), F.col("old")), "inside_itself")
        .when(F.col("action").isin("rename", "move") & (F.col("_holder") != F.col("folder_id")), "taken")
    )
    rows = rows.withColumn("problem", own)
    sound = rows.where("problem is null")
    # the first edit of each folder and of each new path, by aggregation: no window over one folder's edits
    first_change = sound.where(changes).groupBy("old").agg(F.min("edit_id").alias("_first_change"))
    first_target = sound.where("new is not null").groupBy("new").agg(F.min("edit_id").alias("_first_target"))
    roots = first_change.select(F.col("old").alias("root"))
    inner = sound.where(changes).select("edit_id", "old", F.explode(ancestors(F.col("old"))).alias("root")).where("root <> old").join(roots, "root").select("edit_id").distinct().withColumn("_nested", F.lit(True))
    into = sound.where("above <> ''").select("edit_id", F.explode(ancestors(F.col("above"))).alias("root")).join(roots, "root").select("edit_id").distinct().withColumn("_moving", F.lit(True))
    met = rows.join(first_change, "old", "left").join(first_target, "new", "left").join(inner, "edit_id", "left").join(into, "edit_id", "left")
    shared = (
        F.when(changes & (F.col("_first_change") < F.col("edit_id")), "repeated").when(F.col("_first_target") < F.col("edit_id"), "same_target")
        .when(F.coalesce("_nested", F.lit(False)), "nested").when(F.coalesce("_moving", F.lit(False)), "moving_parent")
    )
    return met.select("edit_id", "action", "folder_id", "parent_id", "name", "old", "new", F.coalesce("problem", shared).alias("problem"))


def apply_edits(folders: DataFrame, documents: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders and documents after all edits without a problem: paths below follow, deleted folders take what is in them along.

    ``documents``: folder_id and whatever else.  Each path meets the changed folders by equality on its ancestors.
    """
    good = judge_edits(folders, edits).where("problem is null")
    changed = good.where("action <> 'create'").select(F.col("old").alias("_root"), "action", F.col("new").alias("_new"), F.col("name").alias("_name"), F.col("parent_id").alias("_parent"))
    up = folders.select("folder_id", F.explode(ancestors(F.col("relative_path"))).alias("_root")).join(changed, "_root")
    met = folders.join(up, "folder_id", "left")
    self_changed = F.coalesce(F.col("relative_path") == F.col("_root"), F.lit(False))
    path = F.when(F.col("_new").isNotNull(), F.concat("_new", F.expr("substring(relative_path, length(_root) + 1)"))).otherwise(F.col("relative_path"))
    kept = met.where("action is null or action <> 'delete'").select(
        "folder_id", F.when(self_changed, F.col("_parent")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(self_changed, F.col("_name")).otherwise(F.col("name")).alias("name"), path.alias("relative_path")
    )
    made = good.where("action = 'create'").join(folders.select(F.col("relative_path").alias("new")), "new", "left_anti")
    made = made.select(folder_id(F.col("new")).alias("folder_id"), "parent_id", "name", F.col("new").alias("relative_path"))
    gone = met.where("action = 'delete'").select("folder_id")
    return kept.unionByName(made), documents.join(gone, "folder_id", "left_anti")


def edit(folders: DataFrame, documents: DataFrame, action: str, folder: str = "", parent: str = "", name: str = "") -> tuple[DataFrame, DataFrame]:
    """One edit; what is wrong with it is raised."""
    one = folders.sparkSession.createDataFrame([(0, action, folder, parent, name)], "edit_id int, action string, folder_id string, parent_id string, name string")
    problem = judge_edits(folders, one).first()["problem"]
    if problem is not None:
        raise ValueError(f"{action}: {problem}")
    return apply_edits(folders, documents, one)
