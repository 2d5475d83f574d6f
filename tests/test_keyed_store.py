"""The stored keyed table: commits, writers that die half-way, repeated changes, untouched buckets."""

import glob

import pytest

from factorlake.sources.keyed_store import KeyedStore


@pytest.fixture
def store(spark, tmp_path):
    made = KeyedStore(spark, str(tmp_path / "table"), "k long, name string, v double", ["k"], buckets=8)
    made.upsert("first", rows_of(spark, [(i, f"n{i}", float(i)) for i in range(40)]))
    return made


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k long, name string, v double")


def held(store):
    return {r.k: (r.name, r.v) for r in store.read().collect()}


def test_changes_and_reads(spark, store):
    assert held(store) == {i: (f"n{i}", float(i)) for i in range(40)}
    store.upsert("second", rows_of(spark, [(3, "x", 30.0), (99, "new", 1.0)]))
    store.update("third", spark.createDataFrame([(4, -4.0), (1000, 1.0)], "k long, v double"))
    store.insert_if_absent("fourth", rows_of(spark, [(5, "no", 0.0), (100, "yes", 2.0), (100, "yes", 2.0)]))
    store.delete("fifth", spark.createDataFrame([(6,), (7,)], "k long"))
    expected = {i: (f"n{i}", float(i)) for i in range(40) if i not in (6, 7)} | {3: ("x", 30.0), 99: ("new", 1.0), 4: ("n4", -4.0), 100: ("yes", 2.0)}
    assert held(store) == expected
    assert [tuple(r) for r in store.get(k=99).collect()] == [(99, "new", 1.0)] and store.get(k=6).count() == 0


def test_a_change_touches_only_its_buckets(spark, store):
    before = store.state()[1]
    store.upsert("one", rows_of(spark, [(3, "x", 30.0)]))
    after = store.state()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    files = store.rows({b: c for b, c in after.items() if c == 2}).inputFiles()
    assert files and all("commit=2" in f for f in files)
    assert len(glob.glob(f"{store.path}/data/commit=2/bucket=*")) == 1


def test_a_writer_that_dies_leaves_the_last_commit(spark, store, monkeypatch):
    before, change = held(store), rows_of(spark, [(3, "x", 30.0), (41, "y", 1.0)])
    commit = KeyedStore.commit

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedStore, "commit", die)
    with pytest.raises(RuntimeError):
        store.upsert("second", change)
    assert held(store) == before and glob.glob(f"{store.path}/data/commit=2")
    monkeypatch.setattr(KeyedStore, "commit", commit)
    assert store.upsert("second", change)
    assert held(store) == before | {3: ("x", 30.0), 41: ("y", 1.0)}


def test_a_change_counts_once(spark, store):
    assert store.upsert("second", rows_of(spark, [(3, "x", 30.0)])) and not store.upsert("second", rows_of(spark, [(3, "other", 0.0)]))
    assert held(store)[3] == ("x", 30.0)


def test_empty_tables_and_buckets(spark, tmp_path):
    empty = KeyedStore(spark, str(tmp_path / "t"), "k long, name string, v double", ["k"], buckets=4)
    assert empty.read().count() == 0 and empty.get(k=1).count() == 0
    empty.upsert("a", rows_of(spark, [(1, "a", 1.0)]))
    empty.delete("b", spark.createDataFrame([(1,)], "k long"))
    assert empty.read().count() == 0 and not empty.upsert("a", rows_of(spark, [(1, "a", 1.0)]))
    empty.upsert("c", rows_of(spark, [(1, None, None)]))
    assert held(empty) == {1: (None, None)}
