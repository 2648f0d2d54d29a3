"""Commits on versioned tables: pinned readers, killed and competing writers, shared folders."""

import pytest

from curatum.sources import tables, versioned

SCHEMA = "id long, name string, version int"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(i, f"n{i}", 1) for i in range(40)] + [(3, "n3 again", 2), (3, "n3 old", 0)]
    assert versioned.create_table(spark.createDataFrame(rows, SCHEMA), path, buckets=8) == 1
    return path


def test_commits_and_pinned_readers(spark, table):
    first = versioned.read_table(spark, table)
    before = _rows(first)
    assert len(before) == 40 and (3, "n3 again", 2) in before
    assert versioned.upsert_table(spark.createDataFrame([(3, "late", 1), (5, "new", 2), (100, "more", 1), (None, "no key", 1)], SCHEMA), table) == 2
    now = _rows(versioned.read_table(spark, table))
    assert _rows(first) == before == _rows(versioned.read_table(spark, table, 1))
    assert (3, "n3 again", 2) in now and (5, "new", 2) in now and (100, "more", 1) in now and len(now) == 42
    assert versioned.upsert_table(spark.createDataFrame([(None, "no key", 1)], SCHEMA), table) == 3
    assert _rows(versioned.read_table(spark, table)) == now  # a row without key is known by its content


def test_only_touched_buckets_are_written(spark, table):
    versioned.upsert_table(spark.createDataFrame([(7, "x", 9)], SCHEMA), table)
    old, new = (versioned.manifest(spark, table, v)["folders"] for v in (1, 2))
    assert sum(old[b] != new[b] for b in new) == 1 and set(old) == set(new)
    assert versioned.upsert_table(spark.createDataFrame([], SCHEMA), table) == 3
    assert versioned.manifest(spark, table, 3)["folders"] == new


def test_killed_writer_leaves_the_table(spark, table, monkeypatch):
    before = _rows(versioned.read_table(spark, table))
    monkeypatch.setattr(versioned, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        versioned.upsert_table(spark.createDataFrame([(1, "half", 9)], SCHEMA), table)
    monkeypatch.undo()
    assert versioned.versions(spark, table) == [1] and _rows(versioned.read_table(spark, table)) == before
    # killed between the draft and its name
    files = versioned._Files(spark, table)
    files.write("versions/draft-left", "{")
    assert versioned.versions(spark, table) == [1] and _rows(versioned.read_table(spark, table)) == before
    assert versioned.upsert_table(spark.createDataFrame([(1, "whole", 9)], SCHEMA), table) == 2


def test_competing_writers(spark, table, monkeypatch):
    """A writer that is overtaken merges again into what the other published; no change is lost."""
    write, overtaken = versioned._write, []

    def slow(rows, *rest):
        found = write(rows, *rest)
        if not overtaken:
            overtaken.append(True)
            versioned.upsert_table(spark.createDataFrame([(1, "other", 5), (2, "other", 5)], SCHEMA), table)
        return found

    monkeypatch.setattr(versioned, "_write", slow)
    assert versioned.upsert_table(spark.createDataFrame([(1, "mine", 6), (3, "mine", 6)], SCHEMA), table) == 3
    now = dict((r[0], r[1]) for r in _rows(versioned.read_table(spark, table)))
    assert (now[1], now[2], now[3]) == ("mine", "other", "mine")
    overtaken.clear()
    with pytest.raises(versioned.Conflict):
        versioned.upsert_table(spark.createDataFrame([(1, "once", 7)], SCHEMA), table, attempts=1)
    with pytest.raises(versioned.Conflict):
        versioned.create_table(spark.createDataFrame([(1, "again", 1)], SCHEMA), table)


def test_expire(spark, table):
    for v in (2, 3, 4):
        versioned.upsert_table(spark.createDataFrame([(v, f"v{v}", v)], SCHEMA), table)
    now = _rows(versioned.read_table(spark, table))
    assert versioned.expire(spark, table, keep=2) > 0
    assert versioned.versions(spark, table) == [3, 4] and _rows(versioned.read_table(spark, table)) == now
    assert versioned.expire(spark, table, keep=2) == 0


def test_empty_and_missing(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    with pytest.raises(FileNotFoundError):
        versioned.read_table(spark, path)
    versioned.create_table(spark.createDataFrame([], SCHEMA), path)
    assert _rows(versioned.read_table(spark, path)) == []
    versioned.upsert_table(spark.createDataFrame([(1, None, 1)], SCHEMA), path)
    assert _rows(versioned.read_table(spark, path)) == [(1, None, 1)]
    assert tables.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA), spark.createDataFrame([(1, "b", 2)], SCHEMA)).collect()[0].name == "b"
