"""Folder edits against a plain version, with every problem they can have."""

import pytest

from lexigrove.operators import folders as f

FOLDERS = "folder_id string, parent_id string, name string, relative_path string"
EDITS = "edit_id int, action string, folder_id string, parent_id string, name string"


@pytest.fixture
def tree(spark):
    rows = [("a", "", "a", "a"), ("ab", "a", "b", "a/b"), ("abc", "ab", "c", "a/b/c"), ("x", "", "a2", "a2"), ("y", "x", "b", "a2/b")]
    return spark.createDataFrame(rows, FOLDERS), spark.createDataFrame([(1, "a"), (2, "abc"), (3, "y"), (4, None), (5, "")], "document_id int, folder_id string")


def paths(folders):
    return {r["folder_id"]: r["relative_path"] for r in folders.collect()}


def test_single_edits(spark, tree):
    folders, documents = tree
    renamed, docs = f.edit(folders, documents, "rename", "a", name=" n:e/w ")
    assert paths(renamed) == {"a": "new", "ab": "new/b", "abc": "new/b/c", "x": "a2", "y": "a2/b"} and docs.count() == 5
    left, docs = f.edit(folders, documents, "delete", "ab")
    assert set(paths(left)) == {"a", "x", "y"} and sorted(r[0] for r in docs.select("document_id").collect()) == [1, 3, 4, 5]
    with pytest.raises(ValueError, match="move: inside_itself"):
        f.edit(folders, documents, "move", "a", "abc")


def test_moves_and_creations(spark, tree):
    folders, documents = tree
    edits = [(1, "move", "ab", "", None), (2, "move", "y", "a", None), (3, "create", None, "x", "b2"), (4, "create", None, "", "a"), (5, "rename", "x", None, "a2")]
    after, _ = f.apply_edits(folders, documents, spark.createDataFrame(edits, EDITS))
    rows = {r["relative_path"]: (r["folder_id"], r["parent_id"], r["name"]) for r in after.collect()}
    # y may not go to a/b, which stands there until the batch is over; x is renamed to its own name, so what is created in it waits
    assert {k: v[:2] for k, v in rows.items()} == {"a": ("a", ""), "b": ("ab", ""), "b/c": ("abc", "ab"), "a2": ("x", ""), "a2/b": ("y", "x")}


def test_problems(spark, tree):
    cases = [
        (("copy", "a", "", ""), "unknown_action"), ((None, "a", "", ""), "unknown_action"), (("rename", "none", "", "n"), "no_folder"), (("delete", "none", "", ""), "no_folder"), (("rename", "a", "", " ?* "), "bad_name"),
        (("create", None, "", ".."), "bad_name"), (("create", None, "none", "n"), "no_parent"), (("move", "a", "none", ""), "no_parent"), (("move", "a", "abc", ""), "inside_itself"), (("move", "a", "a", ""), "inside_itself"),
        (("rename", "a", "", "a2"), "taken"), (("move", "ab", "x", ""), "taken"), (("rename", "a", None, None), "bad_name"), (("move", "a", "x", None), None),
    ]
    found = f.judge_edits(tree[0], spark.createDataFrame([(n, *edit) for n, (edit, _) in enumerate(cases)], EDITS))
    assert [r["problem"] for r in found.orderBy("edit_id").collect()] == [problem for _, problem in cases]


def test_edits_of_one_batch_do_not_touch_each_other(spark, tree):
    folders, documents = tree
    edits = [(1, "rename", "a", None, "n"), (2, "rename", "a", None, "m"), (3, "rename", "abc", None, "d"), (4, "create", None, "ab", "e"), (5, "create", None, "", "n"), (6, "create", None, "x", "e"), (7, "create", None, "x", "e"), (8, "create", None, "y", "e")]
    batch = spark.createDataFrame(edits, EDITS)
    found = {r["edit_id"]: r["problem"] for r in f.judge_edits(folders, batch).collect()}
    assert found == {1: None, 2: "repeated", 3: "nested", 4: "moving_parent", 5: "same_target", 6: None, 7: "same_target", 8: None}
    after, _ = f.apply_edits(folders, documents, batch)
    assert sorted(paths(after).values()) == ["a2", "a2/b", "a2/b/e", "a2/e", "n", "n/b", "n/b/c"]


def test_empty_tables(spark, tree):
    folders, documents = tree
    none = spark.createDataFrame([], EDITS)
    after, docs = f.apply_edits(folders, documents, none)
    assert paths(after) == paths(folders) and docs.count() == 5
    made, _ = f.apply_edits(folders.limit(0), documents.limit(0), spark.createDataFrame([(1, "create", None, "", "a")], EDITS))
    assert list(paths(made).values()) == ["a"]
