"""DuckDB text for factor expressions, used only to check results.

Primitives are written here independently of the Spark operators; the factor formula
itself (the expression) is shared.
"""

from __future__ import annotations

from quantspark.functions.expr import Node, passes

W = "PARTITION BY symbol ORDER BY trade_date"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ROW_SQL = {
    "add": lambda a, b: f"({a} + {b})",
    "sub": lambda a, b: f"({a} - {b})",
    "mul": lambda a, b: f"({a} * {b})",
    "div": lambda a, b: f"({a} / nullif({b}, 0.0))",
    "pow": lambda a, b: f"(CASE WHEN ({a}) < 0 AND ({b}) <> floor({b}) THEN NULL WHEN ({a}) = 0 AND ({b}) < 0 THEN NULL ELSE pow({a}, {b}) END)",
    "neg": lambda a: f"(-({a}))",
    "abs": lambda a: f"abs({a})",
    "sign": lambda a: f"CAST(sign({a}) AS DOUBLE)",
    "log": lambda a: f"(CASE WHEN {a} > 0 THEN ln({a}) END)",
    "sqrt": lambda a: f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)",
    "exp": lambda a: f"exp({a})",
    "floor": lambda a: f"CAST(floor({a}) AS DOUBLE)",
    "lt": lambda a, b: f"({a} < {b})",
    "le": lambda a, b: f"({a} <= {b})",
    "gt": lambda a, b: f"({a} > {b})",
    "ge": lambda a, b: f"({a} >= {b})",
    "eq": lambda a, b: f"({a} = {b})",
    "and": lambda a, b: f"({a} AND {b})",
    "or": lambda a, b: f"({a} OR {b})",
    "where": lambda c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)",
    "coalesce": lambda *xs: f"coalesce({', '.join(xs)})",
    "isnull": lambda a: f"({a} IS NULL)",
    "notnull": lambda a: f"({a} IS NOT NULL)",
    "greatest": lambda *xs: f"greatest({', '.join(xs)})",
    "least": lambda *xs: f"least({', '.join(xs)})",
    "nullif": lambda a, b: f"nullif({a}, {b})",
}


def _roll(fn):
    def op(x, n, need):
        return f"CASE WHEN count({x}) OVER {frame(n)} >= {need} THEN {fn}({x}) OVER {frame(n)} END"

    return op


def _pair(fn, digits):
    def op(a, b, n, need):
        x = f"CASE WHEN ({b}) IS NOT NULL THEN {a} END"
        y = f"CASE WHEN ({a}) IS NOT NULL THEN {b} END"
        v = f"{fn}({x}, {y}) OVER {frame(n)}"
        if fn == "corr":
            flat = f"min({x}) OVER {frame(n)} = max({x}) OVER {frame(n)} OR min({y}) OVER {frame(n)} = max({y}) OVER {frame(n)}"
            v = f"CASE WHEN {flat} OR isnan({v}) THEN NULL ELSE {v} END"
        return f"CASE WHEN count({x}) OVER {frame(n)} >= {need} THEN round({v}, {digits}) END"

    return op


def _ts_rank(x, n, need):
    r = f"round({x}, 10)"
    arr = f"list({r}) OVER {frame(n)}"
    below = f"len(list_filter({arr}, lambda v: v < {r}))"
    ties = f"len(list_filter({arr}, lambda v: v = {r}))"
    cnt = f"count({x}) OVER {frame(n)}"
    return f"CASE WHEN {x} IS NOT NULL AND {cnt} >= {need} THEN ({below} + ({ties} + 1) / 2.0) / {cnt} END"


def _arg(pick):
    def op(x, n, need):
        r = f"round({x}, 10)"
        arr = f"list({r}) OVER {frame(n)}"
        return (
            f"CASE WHEN count({x}) OVER {frame(n)} >= {need} THEN "
            f"CAST(list_position({arr}, {pick}({r}) OVER {frame(n)}) AS DOUBLE) END"
        )

    return op


def _mad(x, n, need):
    dev = (
        f"list_sum(list_transform(list({x}) OVER {frame(n)}, "
        f"lambda v: abs(v - avg({x}) OVER {frame(n)})))"
    )
    cnt = f"count({x}) OVER {frame(n)}"
    return f"CASE WHEN {cnt} >= {need} THEN {dev} / {cnt} END"


def _decay(x, n):
    parts = " + ".join(f"{float(n - i)} * lag({x}, {i}) OVER ({W})" for i in range(n))
    return f"round(({parts}) / {n * (n + 1) / 2.0}, 10)"


def _ema(x, alpha, rows):
    arr = f"list_filter(list({x}) OVER {frame(rows)}, lambda v: v IS NOT NULL)"
    return (
        f"CASE WHEN len({arr}) > 0 THEN list_reduce({arr}, "
        f"lambda acc, v: acc * {1.0 - alpha!r} + v * {alpha!r}) END"
    )


def _run(fn, frame_text="ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"):
    def op(x):
        if fn in ("last_value", "first_value"):
            return f"{fn}({x} IGNORE NULLS) OVER ({W} {frame_text})"
        return f"{fn}({x}) OVER ({W} {frame_text})"

    return op


TS_SQL = {
    "delay": lambda x, n: f"lag({x}, {n}) OVER ({W})",
    "lead": lambda x, n: f"lead({x}, {n}) OVER ({W})",
    "mean": _roll("avg"),
    "sum": _roll("sum"),
    "std": _roll("stddev_samp"),
    "stdp": _roll("stddev_pop"),
    "var": _roll("var_samp"),
    "max": _roll("max"),
    "min": _roll("min"),
    "product": _roll("product"),
    "count": lambda x, n, need: f"CAST(count({x}) OVER {frame(n)} AS DOUBLE)",
    "corr": _pair("corr", 10),
    "cov": _pair("covar_samp", 10),
    "slope": lambda x, n, need: (
        f"CASE WHEN count({x}) OVER {frame(n)} >= {need} THEN "
        f"regr_slope({x}, CAST(bar_no_ AS DOUBLE)) OVER {frame(n)} END"
    ),
    "ts_rank": _ts_rank,
    "argmax": _arg("max"),
    "argmin": _arg("min"),
    "mad": _mad,
    "decay": _decay,
    "ema": _ema,
    "cumsum": _run("sum"),
    "cummax": _run("max"),
    "ffill": _run("last_value"),
    "bfill": _run("first_value", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
    "first": _run("first_value"),
    "bar_index": lambda: f"CAST(row_number() OVER ({W}) AS DOUBLE)",
    "bars_total": lambda: "CAST(count(*) OVER (PARTITION BY symbol) AS DOUBLE)",
    "prior_max": lambda x, n, need: (
        f"CASE WHEN count({x}) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {need} "
        f"THEN max({x}) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    ),
}


def _section(by):
    return "PARTITION BY " + ", ".join(["trade_date", *by])


def _rank(x, ascending, by):
    r = f"round({x}, 10)"
    p = _section(by)
    way = "ASC" if ascending else "DESC"
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({p} ORDER BY {r} {way} NULLS LAST) "
        f"+ (count(*) OVER ({p}, {r}) - 1) / 2.0) / count({x}) OVER ({p}) END"
    )


def _sec(fn):
    return lambda x, by: f"{fn}({x}) OVER ({_section(by)})"


def _regr(fn):
    return lambda y, x, by: f"{fn}({y}, {x}) OVER ({_section(by)})"


CS_SQL = {
    "rank": _rank,
    "xquantile": lambda x, q, by: f"quantile_cont({x}, {q!r}) OVER ({_section(by)})",
    "xcount": lambda x, by: f"CAST(count({x}) OVER ({_section(by)}) AS DOUBLE)",
    "xmean": _sec("avg"),
    "xsum": _sec("sum"),
    "xstd": _sec("stddev_samp"),
    "xstdp": _sec("stddev_pop"),
    "xmin": _sec("min"),
    "xmax": _sec("max"),
    "xslope": _regr("regr_slope"),
    "xintercept": _regr("regr_intercept"),
}


def text_of(node: Node, done: set[str]) -> str:
    if node.key in done:
        return "n_" + node.key
    if node.kind == "lit":
        v = node.params[0]
        if v is None:
            return "CAST(NULL AS DOUBLE)"
        return str(v).lower() if isinstance(v, bool) else f"CAST({float(v)!r} AS DOUBLE)"
    if node.kind == "field":
        return {"turnover": "turnover_rate"}.get(node.params[0], node.params[0])
    args = [text_of(a, done) for a in node.args]
    if node.op == "round":
        return f"round({args[0]}, {node.params[0]})"
    return ROW_SQL[node.op](*args)


def factor_sql(source: str, outputs: dict[str, Node], keys=("symbol", "trade_date"), digits=6,
               where: str = "") -> str:
    """SELECT keys and rounded outputs over ``source``, one CTE per pass; ``digits`` may differ by output."""
    by_name = digits if isinstance(digits, dict) else dict.fromkeys(outputs, digits)
    plan = passes(outputs.values())
    ctes = [f"s0 AS (SELECT *, row_number() OVER ({W}) AS bar_no_ FROM {source})"]
    done: set[str] = set()
    for i, (kind, nodes) in enumerate(plan, start=1):
        table = TS_SQL if kind == "ts" else CS_SQL
        cols = [
            f"{table[n.op](*[text_of(a, done) for a in n.args], *n.params)} AS n_{n.key}"
            for n in nodes
        ]
        ctes.append(f"s{i} AS (SELECT *, {', '.join(cols)} FROM s{i - 1})")
        done |= {n.key for n in nodes}
    outs = [f"round({text_of(n, done)} + 1e-9, {by_name.get(name, 6)}) + 0.0 AS {name}" for name, n in outputs.items()]
    tail = f" WHERE {where}" if where else ""
    return (
        "WITH " + ", ".join(ctes)
        + f" SELECT {', '.join(list(keys) + outs)} FROM s{len(plan)}{tail}"
    )
