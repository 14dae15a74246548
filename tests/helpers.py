import math


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if type(v).__name__ == "Decimal":
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def rows(df):
    return canon([tuple(r) for r in df.collect()], df.columns)
