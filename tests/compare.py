"""Run queries next to their SQL twins and compare the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vocalis")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v))
    return "NULL" if v is None else str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(frame, con, sql) -> str | None:
    """None when both sides hold the same rows, otherwise a short account."""
    left = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    right = canonical([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = set(left[1]), set(right[1])
    cut = lambda rows: [tuple(x[:80] for x in r) for r in sorted(rows)[:3]]
    return f"rows {len(left[1])} / {len(right[1])}; only spark {cut(a - b)}; only sql {cut(b - a)}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sqls, bad = session(), connection(sf_dir), oracle_sql(), []
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in sqls:
                note = difference(frame, con, sqls[name])
                verdict = "same" if note is None else "DIFFERENT " + note
            else:
                note, verdict = None, f"{frame.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            note, verdict = "error", "ERROR " + str(e)[:600]
        if note:
            bad.append(name)
        print(f"{name:32s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print(f"{len(bad)} not right: {bad}")


if __name__ == "__main__":
    main()
