"""Add factor expressions to a bar panel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.functions.expr import Node, passes, unfolded
from quantspark.operators.cross_section import CS, attach_sections
from quantspark.operators.rowwise import ROW
from quantspark.operators.timeseries import BLOCK, TS
from quantspark.session import DEFAULT_MAX_GROUP_ROWS, DEFAULT_TASK_ROWS, MAX_GROUP_ROWS, TASK_ROWS, int_conf

#: plain names of raw fields that differ from their column
FIELD_COLUMN = {"turnover": "turnover_rate"}


def column_of(node: Node, done: Mapping[str, str]) -> Column:
    """Row-level Column; ts/cs nodes must already be columns named in ``done``."""
    if node.key in done:
        return F.col(done[node.key])
    if node.kind == "lit":
        value = node.params[0]
        if isinstance(value, bool):
            return F.lit(value)
        return F.lit(None).cast("double") if value is None else F.lit(float(value))
    if node.kind == "field":
        name = node.params[0]
        return F.col(FIELD_COLUMN.get(name, name))
    args = [column_of(a, done) for a in node.args]
    if node.op == "round":
        return F.round(args[0], node.params[0])
    return ROW[node.op](*args)


def shared_rows(roots: Iterable[Node], done: Mapping[str, str]) -> list[list[Node]]:
    """Row nodes below ``roots`` that are read more than once, in layers that only read the ones before.

    An expression is a graph but a Column is a tree: a node that is read twice would be written out twice, and
    all below it again. Spark's method for such a row outgrows what the JVM compiles (8,000 bytes).
    """
    uses: dict[str, int] = {}
    nodes: dict[str, Node] = {}  # arguments first

    def visit(node: Node) -> None:
        uses[node.key] = uses.get(node.key, 0) + 1
        if node.kind != "row" or node.key in done or uses[node.key] > 1:
            return
        for arg in node.args:
            visit(arg)
        nodes[node.key] = node

    for root in roots:
        visit(root)
    depth: dict[str, int] = {}
    layers: list[list[Node]] = []
    for key, node in nodes.items():
        depth[key] = max((depth.get(a.key, 0) for a in node.args), default=0)
        if uses[key] > 1:
            layers += [[]] * (depth[key] == len(layers))
            layers[depth[key]] = [*layers[depth[key]], node]
            depth[key] += 1
    return layers


def with_shared(df: DataFrame, roots: Iterable[Node], done: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a column for each row node that ``roots`` read more than once, and ``done`` with their names."""
    named = dict(done)
    for layer in shared_rows(roots, done):
        df = df.withColumns({"r_" + n.key: column_of(n, named) for n in layer})
        named.update({n.key: "r_" + n.key for n in layer})
    return df, named


def ready(roots: Iterable[Node], done: Mapping[str, str]) -> dict[str, Node]:
    """The largest row nodes below ``roots`` that the columns so far suffice for, where they leave fewer columns to carry than they read."""
    found: dict[str, Node] = {}
    now: set[str] = set()  # columns that are read as things stand
    then: set[str] = set()  # those that are read besides ``found``
    seen: set[tuple[str, bool]] = set()

    def visit(node: Node, inside: bool) -> bool:
        """True where a column is read."""
        if node.kind == "lit":
            return False
        if node.kind == "field" or node.key in done:
            now.add(node.key)
            if not inside:
                then.add(node.key)
            return True
        if node.kind != "row" or (node.key, inside) in seen:
            return True
        seen.add((node.key, inside))
        known = node.deps <= done.keys()
        reads = any([visit(a, inside or known) for a in node.args])
        if known and reads and not inside:
            found[node.key] = node
        return reads

    for root in roots:
        visit(root, False)
    return found if len(found) + len(then) < len(now) else {}


def with_ready(df: DataFrame, roots: Iterable[Node], done: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a column for each node of ``ready``, and ``done`` with their names."""
    found = ready(roots, done)
    df, named = with_shared(df, found.values(), done)
    added = {"r_" + k: column_of(n, named) for k, n in found.items() if k not in named}
    return df.withColumns(added) if added else df, {**done, **{k: "r_" + k for k in found}}


def bounds(df: DataFrame, symbol: str, date: str) -> tuple[int, int]:
    """Upper bounds of what ``sizes`` gives for one row per symbol and date of ``df``, which need not be built for them."""
    n = df.groupBy(symbol).count().agg(F.sum("count"), F.count(F.lit(1))).first()
    rows, symbols = int(n[0] or 0), int(n[1] or 0)
    return min(rows, symbols * df.select(date).distinct().count()), symbols


def largest_section(df: DataFrame, date: str) -> int:
    """Rows of the largest cross-section (one partially aggregated job)."""
    row = df.groupBy(date).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def sizes(df: DataFrame, date: str) -> tuple[int, int]:
    """Rows in all, and of the largest cross-section (one partially aggregated job)."""
    row = df.groupBy(date).count().agg(F.sum("count"), F.max("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


#: columns, windows among them, of the rows that ``quantspark.taskRows`` counts; wider ones count for more
TASK_COLUMNS = 32


def dealt(df: DataFrame, rows: int | None, key: str, windows: int = 0) -> DataFrame:
    """``df`` by ``key`` in so many partitions that a window task holds about ``quantspark.taskRows`` rows.

    A pass chains many sorts in one task and AQE joins small partitions by their compressed bytes, so
    without this a task grows with the table. Every sort holds all columns so far: where they and the
    ``windows`` to come are more than TASK_COLUMNS, a task gets fewer rows in proportion. Small or
    unmeasured tables stay as they are.
    """
    limit = int_conf(df.sparkSession, TASK_ROWS, DEFAULT_TASK_ROWS)
    limit = max(1, limit * TASK_COLUMNS // max(TASK_COLUMNS, len(df.columns) + windows))
    if rows is None or rows <= limit:
        return df
    return df.repartition(max(-(-rows // limit), df.sparkSession.sparkContext.defaultParallelism), key)


def with_factors(
    df: DataFrame,
    outputs: Mapping[str, Node],
    *,
    symbol: str = "symbol",
    date: str = "trade_date",
    section_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``df`` plus one column per entry of ``outputs``.

    ``section_rows`` is the known size of the largest date section; when the caller does
    not know it and a cross-section is needed, it is measured. Sections beyond
    ``quantspark.maxGroupRows`` use the bucketed form. With ``rows``, the known number of rows, each
    pass runs in partitions of bounded size.
    """
    outputs = unfolded(outputs)
    plan = passes(outputs.values())
    limit = int_conf(df.sparkSession, MAX_GROUP_ROWS, DEFAULT_MAX_GROUP_ROWS)
    if section_rows is None and any(kind == "cs" for kind, _ in plan):
        rows, section_rows = sizes(df, date)
    wide = (section_rows or 0) > limit
    keep = df.columns
    w = Window.partitionBy(symbol).orderBy(date)
    if any(n.op == "slope" for kind, nodes in plan for n in nodes):
        df = df.withColumn("bar_no_", F.row_number().over(w))
    done: dict[str, str] = {}
    dealt_by = None
    for i, (kind, nodes) in enumerate(plan):
        by = symbol if kind == "ts" else None if wide else date
        if by not in (None, dealt_by):
            if by == date and i:  # rows go to their dates with the results of row arithmetic instead of all that it reads
                df, done = with_ready(df, [*(a for _, ns in plan[i:] for n in ns for a in n.args), *outputs.values()], done)
            together = takewhile(lambda p: p[0] == kind, plan[i:])  # passes that this task goes on with
            df = dealt(df, rows, by, sum(len(n) for _, n in together))
        dealt_by = by
        added: dict[str, Column] = {}
        blocks: dict[str, dict[str, Column]] = {}
        behind: dict[str, dict[str, Column]] = {}
        requests = []
        # a window reads its arguments more than once; the wide form writes all columns, so it gets no more of them
        by_row = kind == "ts" or not wide
        df, named = with_shared(df, [a for n in nodes for a in (*n.args, *n.args)], done) if by_row else (df, done)
        for n in nodes:
            name = "n_" + n.key
            args = [column_of(a, named) for a in n.args]
            if kind == "ts":
                if n.op == "previous_block_sum":
                    run = "n_" + Node("block_running_sum", "ts", n.args).key
                    run = F.col(run) if any(run == "n_" + m.key for m in nodes) else None
                    behind.setdefault(n.args[-1].key, {})[name] = BLOCK[n.op](symbol, date, *args, run)
                elif n.op == "block_running_sum":
                    blocks.setdefault(n.args[-1].key, {})[name] = BLOCK[n.op](symbol, date, *args)
                elif n.op in BLOCK:
                    added[name] = BLOCK[n.op](symbol, date, *args)
                else:
                    added[name] = TS[n.op](w, *args, *n.params)
            else:
                part = [date, *n.params[-1]]
                if wide:
                    requests.append((name, n.op, part, args, n.params[:-1], n.args[0].key))
                else:
                    added[name] = CS[n.op](part, *args, *n.params[:-1])
        if requests:
            df = attach_sections(df, requests)
        if added:
            df = df.withColumns(added)
        for block in {**blocks, **behind}:  # the sums of one block in one order of the rows
            for sums in (blocks.get(block), behind.get(block)):
                df = df.withColumns(sums) if sums else df
        done.update({n.key: "n_" + n.key for n in nodes})
    df, done = with_shared(df, outputs.values(), done)
    return df.select(
        *[F.col(c) for c in keep],
        *[column_of(node, done).alias(name) for name, node in outputs.items()],
    )
