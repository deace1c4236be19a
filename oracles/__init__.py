"""DuckDB statements that state each query's result independently of Spark."""


def all_sql() -> dict[str, str]:
    from oracles import horizontal, leadlag, outcomes, relations, reporting, screening, texts
    from oracles.base import compose
    out = {}
    for module in (screening, horizontal, relations, leadlag, texts, outcomes, reporting):
        out.update({k: compose(v) for k, v in module.SQL.items()})
    return out
