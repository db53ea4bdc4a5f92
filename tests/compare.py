"""Runs registered queries beside their SQL and compares the rows."""

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES.split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    """Text that tells NULL, NaN, empty text and the kinds of values apart; whole numbers of any width are one kind."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, int):
        return f"int {value}"
    if isinstance(value, (float, decimal.Decimal)):
        return "NaN" if math.isnan(value) else f"num {float(value) + 0.0!r}"
    return f"{type(value).__name__} {value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir, query, sql, db=None):
    """Empty text when both sides agree, else what differs."""
    db = db or connect(sf_dir)
    frame = query(spark, sf_dir)
    got = _rows(frame.columns, frame.collect())
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    want = _rows(columns, result.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} <> {sorted(columns)}"
    if got != want:
        wrong = [pair for pair in zip(got, want) if pair[0] != pair[1]][:3]
        return f"rows {len(got)} / {len(want)}, first differences {wrong}"
    return "" if want else "no rows on either side"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from session import start

    spark = start()
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    chosen = sys.argv[1:] or list(entry.queries())
    database, failed = connect(folder), []
    for name in chosen:
        begun = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                outcome = "" if entry.queries()[name](spark, folder).count() else "no rows"
            else:
                outcome = compare(spark, folder, entry.queries()[name], sql, database)
        except Exception as problem:  # noqa: BLE001
            outcome = f"{type(problem).__name__}: {str(problem)[:600]}"
        print(f"{'ok  ' if not outcome else 'FAIL'} {time.time() - begun:6.1f}s {name} {outcome}", flush=True)
        if outcome:
            failed.append(name)
    print(len(chosen), "queries,", len(failed), "failed:", " ".join(failed))
