"""python tests/check_oracle.py [SF_DIR] [NAME...]: every query against its SQL in DuckDB."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))

import duckdb

import __spark_entry__ as entry
from tests.compare import same
from tickspark.session import local_session

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, names = local_session(), sys.argv[2:] or list(entry.queries())
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    sql = entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            print(f"{name:28} {len(got):7} {time.time() - start:6.2f}s", same(got, con.execute(sql[name]).df()) if name in sql else "rows only", flush=True)
        except Exception as e:
            print(f"{name:28} ERROR {str(e)[:600]}", flush=True)
