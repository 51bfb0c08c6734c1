"""Rows of a Spark query against rows of its SQL twin."""

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def _plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return repr(value)


def rows_of(rows, order):
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def assert_same(df, duck, sql):
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in found.description}
    assert sorted(names) == sorted(df.columns)
    assert kinds == dict(df.dtypes)
    columns = sorted(names)
    want = rows_of(found.fetchall(), [names.index(c) for c in columns])
    got = rows_of([tuple(r) for r in df.select(*columns).collect()], range(len(columns)))
    assert got == want
