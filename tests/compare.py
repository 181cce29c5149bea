"""Run registered queries against their SQL: python tests/compare.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as e  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    t0 = time.time()
    got = query(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return f"rows only: {len(got)}", t1 - t0, 0.0
    want = con.execute(sql).df()
    t2 = time.time()
    cols = sorted(want.columns)
    if sorted(got.columns) != cols:
        return f"COLUMNS {sorted(got.columns)} {cols}", t1 - t0, t2 - t1
    for c in cols:  # whole numbers beside nulls come as floats from the one and as nullable integers from the other
        if str(got[c].dtype) == "float64" and str(want[c].dtype) == "Int64":
            got[c] = got[c].astype("Int64")
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in cols if str(got[c].dtype) != str(want[c].dtype)}
    a = got[cols].sort_values(cols).reset_index(drop=True)
    b = want[cols].sort_values(cols).reset_index(drop=True)
    same = len(a) == len(b) and a.astype(str).equals(b.astype(str))
    return f"{'ok' if same else 'DIFFERENT'} {len(a)}/{len(b)} {types or ''}", t1 - t0, t2 - t1


if __name__ == "__main__":
    sf = sys.argv[1]
    session = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "20g")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    sqls, qs = e.oracle_sql(), e.queries()
    for n in sys.argv[2:] or qs:
        try:
            out = compare(session, connect(sf), sf, n, qs[n], sqls.get(n))
        except Exception as err:  # report and go on
            out = (f"FAILED {type(err).__name__} {str(err)[:600]}", 0.0, 0.0)
        print(f"{n:32s} {out[0]}  spark {out[1]:.1f}s sql {out[2]:.1f}s", flush=True)
