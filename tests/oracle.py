"""Run registered queries and their SQL side by side.

    python -m tests.oracle [folder] [name ...]
"""

import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(db, sql, frame):
    """None when both give the same rows, else what differs."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    expected = _values(result.fetchall(), names)
    got = _values([tuple(r) for r in frame.collect()], frame.columns)
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if got != expected:
        extra = [x for x in got if x not in set(expected)][:3]
        lacking = [x for x in expected if x not in set(got)][:3]
        return f"{len(got)} rows, {len(expected)} expected\n  extra {extra}\n  lacking {lacking}"
    return None


def main():
    from recordloom.queries import BUILDERS, SQL
    from recordloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(BUILDERS)
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = BUILDERS[name](spark, folder)
            if name in SQL:
                problem = compare(db, SQL[name], frame)
                size = "match" if problem is None else problem
            else:
                problem, size = None, f"{frame.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = size = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {size}",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main())
