"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suffixloom.queries import QUERIES
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    sql = entry.oracle_sql()[name]
    verdict, _, _ = compare(spark, duck, SF_DIR, name, entry.queries()[name], sql)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rewritten_tables_are_read_again(spark, tmp_path):
    def bwt_of(names):
        path = str(tmp_path / "nation.parquet")
        spark.createDataFrame(list(enumerate(names)), "n_nationkey long, n_name string").write.mode("overwrite").parquet(path)
        return "".join(r.ch for r in QUERIES["bwt_nation"](spark, str(tmp_path)).orderBy("bwt_idx").collect())

    assert bwt_of(["ab"]) == "b\x02a" and bwt_of(["aab", "b"]) == "bb\x02aa\x02"


def test_the_rest_works_without_a_library_of_the_subpackage(monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.warns(UserWarning, match="zstandard"):
        importlib.reload(entry)
    assert set(entry.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
