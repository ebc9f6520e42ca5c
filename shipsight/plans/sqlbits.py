"""Small builders for the SQL texts."""

LM = "(SELECT m FROM lm)"


def win(n: int, skip: int = 0, idx: str = "month_idx") -> str:
    return f"({idx} > {LM} - {skip + n} AND {idx} <= {LM} - {skip})"


def d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def tot(v: str, cond: str = "TRUE") -> str:
    return f"coalesce(CAST(sum({v}) FILTER (WHERE {cond}) AS DOUBLE), 0)"


def avg(v: str, cond: str = "TRUE") -> str:
    return f"(CAST(sum({v}) FILTER (WHERE {cond}) AS DOUBLE) / nullif(count({v}) FILTER (WHERE {cond}), 0))"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"
