"""Shared SQL fragments of the oracle queries (DuckDB dialect)."""

from __future__ import annotations

# name -> (names it needs, body)
_CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, body: str, needs: list[str] | None = None) -> None:
    _CTES[name] = (needs or [], body.strip())


def sql(needs: list[str], body: str, once: bool = False) -> str:
    """``WITH`` clause over the named fragments and what they need, then ``body``. ``once``: each fragment is computed once."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in _CTES[n][0]:
                visit(m)
            order.append(n)

    for n in needs:
        visit(n)
    kept = " MATERIALIZED" if once else ""
    clause = ",\n".join(f"{n} AS{kept} ({_CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {clause}\n{body.strip()}" if order else body.strip()


def rnd(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Twin of ``functions.num.rnd``."""
    e = f"(CAST(({expr}) AS DOUBLE) + 1.7e-9::DOUBLE)"
    out = f"CASE WHEN abs({e}) < {0.5 * 10.0**-digits:.{digits + 2}f} THEN 0.0::DOUBLE ELSE round({e}, {digits}) END"
    return f"{out} AS {name}" if name else out
