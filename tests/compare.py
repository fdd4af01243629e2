import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return norm(float(v)) if v % 1 else str(int(v))
    return v


def sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def check_query(spark, duck, data, query, sql):
    df = query(spark, data)
    got = sorted_rows(df.columns, df.collect())
    if sql is None:
        return got
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted_rows(cols, cur.fetchall())
    return got
