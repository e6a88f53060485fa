"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from edgetide.plans.derived import SQL


def registrar() -> tuple[dict, dict, Callable]:
    """Two dictionaries and a decorator that files a query, by its function's name, with its SQL."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None):  # noqa: ANN202
        def file(f):  # noqa: ANN001, ANN202
            queries[name or f.__name__] = f
            if sql:
                oracle[name or f.__name__] = sql
            return f

        return file

    return queries, oracle, query


def over(graph: str, body: str, *parts: str) -> str:
    """SQL with `e` as the graph, further named parts, and a final select."""
    return "with recursive e as (" + SQL[graph] + ")" + "".join(f", {p}" for p in parts) + " " + body


#: The total order of a signal and of an update log.
S = "s as (select row_number() over (order by ts, src, dst) as step, * from e)"
SU = "s as (select row_number() over (order by ts, op desc, src, dst) as step, * from e)"
ARRIVALS = "a as (select least(src, dst) as u, greatest(src, dst) as v, min(step) as step, arg_min(src, step) as src from s where src <> dst group by 1, 2)"
COLLAPSED = "c as (select * from (select step, least(src, dst) as u, greatest(src, dst) as v, op, lag(op, 1, 1) over (partition by least(src, dst), greatest(src, dst) order by step) as po from s where src <> dst) where po <> op)"
INTERVALS = "iv as (select u, v, step as s0, e0 from (select *, lead(step) over (partition by u, v order by step) as e0 from c) where op = 0)"


def reports_sql(pf: int) -> str:
    return f"rep as (select k, (k - 1) * {pf} + 1 as st, least(k * {pf}, n) as endp from (select count(*) as n from s), range(1, 1000000) t(k) where (k - 1) * {pf} < n)"


def windowed_sql(window: int, source: str = "e") -> tuple[str, ...]:
    """Parts that end in `wu`, the windowed updates of a signal."""
    return (
        f"o as (select distinct src, dst, ts from {source})",
        "g as (select *, lag(ts) over w as p, lead(ts) over w as nx from o window w as (partition by src, dst order by ts))",
        f"""wu as (select src, dst, 0 as op, ts from g where p is null or p + {window} < ts union all
            select src, dst, 1, ts + {window} from g where (nx is not null and ts + {window} < nx) or (nx is null and ts + {window} < (select max(ts) from {source})))""",
    )
