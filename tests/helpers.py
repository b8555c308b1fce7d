"""Comparison of results."""

import decimal


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(df, *columns):
    return sorted((tuple(plain(r[c]) for c in (columns or df.columns)) for r in df.collect()), key=repr)


def column(df, name, *order):
    return [plain(r[name]) for r in df.orderBy(*order).collect()]


def near(a, b):
    return [plain(x) for x in a] == [plain(x) for x in b]


def agree(df, sql, con):
    """Whether a DataFrame and DuckDB's result of sql hold the same rows, by column name."""
    got = df.collect()
    names = sorted(df.columns)
    cursor = con.execute(sql)
    there = [d[0] for d in cursor.description]
    assert sorted(there) == names
    wanted = cursor.fetchall()
    a = sorted(repr(tuple(plain(r[n]) for n in names)) for r in got)
    b = sorted(repr(tuple(plain(r[there.index(n)]) for n in names)) for r in wanted)
    assert len(a) == len(b)
    assert a == b
