"""Pieces of oracle SQL used by several queries."""

from __future__ import annotations


def interp(points: str, keys: str, q: float) -> str:
    """Piecewise-linear value at q from rows (keys, c, v), flat outside."""
    b = f"max({{'c': c, 'v': v}}) FILTER (c <= {q}e0)"
    a = f"min({{'c': c, 'v': v}}) FILTER (c > {q}e0)"
    return (f"CASE WHEN ({b}) IS NULL THEN min(v) WHEN ({a}) IS NULL THEN max(v) ELSE "
            f"({b}).v + (({a}).v-({b}).v)*({q}e0-({b}).c)/(({a}).c-({b}).c) END")


def weighted_points(src: str, keys: str, v: str, w: str, tie: str) -> str:
    """Midpoint positions of a weighted sample."""
    return (f"SELECT {keys}, {v} AS v, (sum({w}) OVER (PARTITION BY {keys} ORDER BY {v}, {tie} "
            f"ROWS UNBOUNDED PRECEDING) - {w}/2e0)/sum({w}) OVER (PARTITION BY {keys}) AS c "
            f"FROM {src}")


def phi(z: str) -> str:
    """Normal CDF, the polynomial of the Spark expression."""
    t = f"(1e0/(1e0+0.2316419e0*abs({z})))"
    poly = (f"((((1.330274429e0*{t}-1.821255978e0)*{t}+1.781477937e0)*{t}-0.356563782e0)*{t}"
            "+0.319381530e0)")
    tail = f"(0.3989422804014327e0*exp(-0.5e0*{z}*{z})*{poly}*{t})"
    return f"(CASE WHEN {z}>=0 THEN 1e0-{tail} ELSE {tail} END)"


def canonical_sql(named: dict[str, str]) -> str:
    """`functions.exprs.canonical` of named SQL expressions."""
    return "||".join(
        f"'{n}:'||coalesce(length(({e})::VARCHAR)||':'||({e})::VARCHAR,'-')||';'"
        for n, e in sorted(named.items()))
