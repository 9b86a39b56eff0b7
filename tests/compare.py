"""Rows of two engines as comparable text."""

import datetime
import decimal


def shown(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


def same(df, duck, sql):
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(names, r.fetchall())
