"""Compare a Spark result with the oracle's, value by value, ignoring row order."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder):
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return "float" if isinstance(value, float) else type(value).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, db, sql):
    """None when equal, else a description of the first difference."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} oracle {sorted(names)}"
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"rows differ: spark {len(got)} oracle {len(want)}"
    for a, b in zip(got, want):
        if a != b or any(kind(x) != kind(y) for x, y in zip(a, b)):
            return f"columns {sorted(names)}\n  spark  {a!r:.1500}\n  oracle {b!r:.1500}"
    return None
