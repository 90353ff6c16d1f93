"""Files with credentials, and the move from a vector archive to a published set."""

import hashlib
import json

import numpy as np
import pytest

from lexigrove.operators import activation, publish
from lexigrove.sources import secrets, vector_archive
from lexigrove.sources.files import write_pointer

SECRET = "password = " + "'" + "x" * 8 + "'"


def test_files_with_credentials(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    files = {
        "plain.txt": b"nothing here, token: none", "own.json": b'{"api_key": "abcdefgh"}', "bad.MD": b"\xff\xfe sk-" + b"a" * 16 + b" \xff " + SECRET.encode(), "short.txt": b"sk-abc secret='1234567'", "mixed.yml": b"token: 'abcdefgh\"",
        "code.py": SECRET.encode(), "empty.txt": b"", "large.txt": SECRET.encode() + b" " * 200,
    }
    for name, content in files.items():
        (deep / name).write_bytes(content)
    found = sorted((r["path"].rsplit("/", 1)[1], r["kind"]) for r in secrets.scan(spark, str(tmp_path), most=150).collect())
    assert found == [("bad.MD", "assignment"), ("bad.MD", "key"), ("own.json", "assignment")]
    assert [r["path"].rsplit("/", 1)[1] for r in secrets.unread(spark, str(tmp_path), most=150).collect()] == ["large.txt"]
    with pytest.raises(ValueError, match="in .*bad.MD") as error:
        secrets.refuse(spark, str(tmp_path))
    assert "xxxx" not in str(error.value)
    clean = tmp_path / "clean"
    clean.mkdir()
    (clean / "a.txt").write_text("fine")
    secrets.refuse(spark, str(clean))


@pytest.fixture
def corpus(spark, tmp_path):
    rows = [(f"c{i}", f"h{i}", f"d{i % 3}", "retrieval", f"text {i}") for i in range(20)] + [("p", "h", "d0", "context_only", "")]
    index = spark.createDataFrame(rows, "chunk_id string, content_hash string, document_id string, retrieval_role string, text_search string")
    archive, pointer = f"{tmp_path}/v.npz", f"{tmp_path}/active.json"
    vector_archive.write_archive(archive, [f"c{i}" for i in range(20)], np.random.default_rng(3).normal(size=(20, 4)).astype(np.float32))
    digest = hashlib.sha256(open(archive, "rb").read()).hexdigest()
    write_pointer(pointer, {"snapshot": "s", "digest": "0", "previous": None, "active": True, "vector_archive": archive, "archive_sha256": digest})
    return index, archive, pointer, str(tmp_path / "sets")


def test_migration_publishes_verifies_and_then_points(spark, corpus):
    index, archive, pointer, root = corpus
    done = publish.migrate_archive(index, pointer, root, "v", "m")
    assert done["status"] == "ready" and (done["count"], done["dimension"]) == (20, 4) and publish.healthy(spark, root, "v")
    now = activation._active(pointer)
    assert now["vector_set"]["name"] == "v" and now["snapshot"] == "s" and json.loads(open(pointer).read()) == now
    assert publish.migrate_archive(index, pointer, root, "v", "m")["status"] == "already_migrated"


def test_what_fails_leaves_the_pointer_alone(spark, corpus, monkeypatch):
    index, archive, pointer, root = corpus
    before = open(pointer).read()
    with pytest.raises(ValueError, match="row without a vector"):
        publish.migrate_archive(index.unionByName(index.where("chunk_id = 'c1'").withColumn("chunk_id", index["document_id"])), pointer, root, "v", "m")
    with pytest.raises(ValueError, match="vector without a row"):
        publish.migrate_archive(index.where("chunk_id <> 'c1'"), pointer, root, "v", "m")
    with monkeypatch.context() as patch:
        patch.setattr(publish, "healthy", lambda *_: False)  # the set is written, its check fails
        with pytest.raises(ValueError, match="not healthy"):
            publish.migrate_archive(index, pointer, root, "v", "m")
    assert open(pointer).read() == before
    assert publish.migrate_archive(index, pointer, root, "v", "m")["status"] == "ready"  # takes up what stands there


def test_other_archives_and_pointers_are_refused(spark, corpus):
    index, archive, pointer, root = corpus
    with open(archive, "ab") as file:
        file.write(b"x")
    with pytest.raises(ValueError, match="not the one expected"):
        publish.migrate_archive(index, pointer, root, "v", "m")
    write_pointer(pointer, {"snapshot": "s", "active": True})
    with pytest.raises(ValueError, match="names no vector archive"):
        publish.migrate_archive(index, pointer, root, "v", "m")
    activation.deactivate(pointer)
    with pytest.raises(ValueError, match="no active corpus"):
        publish.migrate_archive(index, pointer, root, "v", "m")
