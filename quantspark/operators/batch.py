"""Batch jobs over a family of factors: shared intermediates once, failures one by one.

One plan with all windows of a family takes minutes to analyse and carries every column through
every shuffle; one job per factor computes the same windows again and again. Between the two, a
family is cut into jobs of bounded width by what the factors share. Windows that several jobs
need are computed first and written beside the bars, and each job reads the columns it names.
A job that fails is halved until the factors that break it stand alone: these give error rows,
all others their values. Only a formula, or the values it meets, makes a factor fail; where a disk,
a machine or the session fails, the batch raises, so that what is missing never looks like a result.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Semaphore

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions.expr import Node, field, unfolded, windows_in
from quantspark.operators.cross_section import AGGREGATES, CS
from quantspark.operators.panel import FIELD_COLUMN, with_factors
from quantspark.operators.rowwise import ROW
from quantspark.operators.timeseries import BLOCK, TS
from quantspark.session import drop_folder, new_folder

log = logging.getLogger(__name__)

KEYS = ["symbol", "trade_date"]
#: windows of one job; a plan with many more takes longer to analyse than to run
WIDTH = 48
#: jobs that are planned and run at a time; planning takes the driver's cores, not the executors'
AT_ONCE = 4
#: beyond so many bars one job runs at a time: it has tasks for all cores, and no disk holds the shuffles of several
ALONE_ROWS = 1_000_000
#: rows of one file of values; flags shrink to so few bytes that readers, who deal by bytes, would take too many at once
FILE_ROWS = 500_000
#: compression of what a batch writes: a third smaller than the default
PACKED = "zstd"
#: shuffle files of a query go when it ends, not when the driver happens to collect its garbage
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
VALUES = "symbol {symbol}, trade_date date, factor_name string, value double"


#: classes of SQLSTATE for values and expressions that do not fit, and states of files, which are no formula's fault
FORMULA_STATES, FILE_STATES = ("22", "42", "0A"), ("42K03", "42K04")


class Broken(ValueError):
    """A formula that cannot be computed on the given bars."""


class Incomplete(RuntimeError):
    """Some factors of a batch that must be whole have no values."""


def of_formula(error: Exception) -> bool:
    """True where a formula or the values that it meets are at fault; else what runs it is: disk, memory, files, session."""
    state = error.getSqlState() if isinstance(error, PySparkException) else None
    if state:
        return state.startswith(FORMULA_STATES) and state not in FILE_STATES
    if isinstance(error, PySparkException):  # wrong arguments have no state
        return isinstance(error, (TypeError, ValueError, LookupError, AttributeError))
    return not isinstance(error, (Py4JError, OSError, MemoryError))


@dataclass(frozen=True)
class Outcome:
    """``values``: symbol, trade_date, factor_name, value. ``errors``: the message of each failed factor."""

    values: DataFrame
    errors: dict[str, str]
    names: Sequence[str]

    def whole(self) -> DataFrame:
        """``values``, of every factor asked for; raises where one has failed."""
        if self.errors:
            raise Incomplete("; ".join(f"{name}: {error}" for name, error in self.errors.items()))
        return self.values

    def status(self) -> DataFrame:
        """One row per factor asked for: rows written, dates covered, and the error where it failed."""
        spark = self.values.sparkSession
        asked = spark.createDataFrame([(n, self.errors.get(n)) for n in self.names], "factor_name string, error string")
        written = self.values.groupBy("factor_name").agg(
            F.count(F.lit(1)).alias("row_count"), F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date")
        )
        return asked.join(written, "factor_name", "left").select(
            "factor_name", F.coalesce("row_count", F.lit(0)).alias("row_count"), "min_date", "max_date", "error"
        )


# --- planning ----------------------------------------------------------------


def known(node: Node, columns: frozenset[str], seen: set[str]) -> None:
    """Raises ``Broken`` where a formula names a column or an operator that does not exist."""
    if node.key in seen:
        return
    seen.add(node.key)
    if node.kind == "field" and FIELD_COLUMN.get(node.params[0], node.params[0]) not in columns:
        raise Broken(f"no column {node.params[0]}")
    operators = {"row": ROW, "ts": {**TS, **BLOCK, "ema": None}, "cs": CS}.get(node.kind)
    if operators is not None and node.op not in operators and node.op != "round":
        raise Broken(f"no operator {node.op}")
    for arg in node.args:
        known(arg, columns, seen)


def formulas(factors: Mapping[str, Node | Callable[[], Node]], columns: Sequence[str]) -> tuple[dict[str, Node], dict[str, str]]:
    """The formulas that can be planned, and why the others cannot; a callable builds its formula here."""
    good, errors = {}, {}
    for name, formula in factors.items():
        try:
            node = formula() if callable(formula) else formula
            known(node, frozenset(columns), set())
            good[name] = node
        except Exception as error:  # one formula never stops the others
            errors[name] = f"{type(error).__name__}: {error}"
    return unfolded(good), errors


def windows_of(node: Node) -> frozenset[str]:
    found: dict[str, Node] = {}
    windows_in(node, found, set())
    return frozenset(found)


def packed(nodes: Mapping[str, Node], width: int) -> list[dict[str, Node]]:
    """Jobs of at most ``width`` windows (a single factor may have more), by what factors share.

    Each job starts with the widest factor left and takes, while there is room, the one with the
    most windows in common per window that it adds.
    """
    left = {name: windows_of(node) for name, node in nodes.items()}
    jobs = []
    while left:
        first = max(left, key=lambda n: (len(left[n]), n))
        have, names = set(left.pop(first)), [first]
        while True:
            fits = [n for n, w in left.items() if len(have | w) <= width]
            if not fits:
                break
            best = max(fits, key=lambda n: ((len(left[n] & have) + 1) / (len(left[n] - have) + 1), n))
            have |= left.pop(best)
            names.append(best)
        jobs.append({n: nodes[n] for n in nodes if n in names})
    return jobs


def shared_windows(jobs: Sequence[Mapping[str, Node]]) -> dict[str, Node]:
    """The windows that two jobs or more reach first when they read shared ones as columns."""
    users: dict[str, set[int]] = {}
    found: dict[str, Node] = {}
    for i, job in enumerate(jobs):
        for node in job.values():
            for key in windows_of(node):
                users.setdefault(key, set()).add(i)
            windows_in(node, found, set())
    common = {k for k, jobs_ in users.items() if len(jobs_) > 1}
    reached: dict[str, Node] = {}

    def visit(node: Node, seen: set[str]) -> None:
        if node.key in seen:
            return
        seen.add(node.key)
        if node.key in common:
            reached[node.key] = node
            return
        for arg in node.args:
            visit(arg, seen)

    for job in jobs:
        seen: set[str] = set()
        for node in job.values():
            visit(node, seen)
    return reached


def column(key: str) -> str:
    return f"shared_{key}"


def reading(node: Node, shared: Mapping[str, Node], done: dict[str, Node]) -> Node:
    """``node`` with each shared window read as a column."""
    if node.key not in done:
        if node.key in shared:
            done[node.key] = field(column(node.key))
        else:
            args = [reading(a, shared, done) for a in node.args]
            same = all(new is old for new, old in zip(args, node.args))
            done[node.key] = node if same else Node(node.op, node.kind, args, node.params)
    return done[node.key]


def fields_of(node: Node, found: set[str], seen: set[str]) -> None:
    if node.key in seen:
        return
    seen.add(node.key)
    if node.kind == "field":
        found.add(FIELD_COLUMN.get(node.params[0], node.params[0]))
    if node.kind == "cs":
        found.update(node.params[-1])  # sections may be split by a column
    for arg in node.args:
        fields_of(arg, found, seen)


def columns_read(outputs: Iterable[Node]) -> list[str]:
    """The columns below ``outputs`` besides the keys."""
    found: set[str] = set()
    seen: set[str] = set()
    for node in outputs:
        fields_of(node, found, seen)
    return sorted(found - set(KEYS))


# --- running -----------------------------------------------------------------


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query in here."""
    kept = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, kept)


def run_factors(
    bars: DataFrame,
    factors: Mapping[str, Node | Callable[[], Node]],
    *,
    section_rows: int | None = None,
    rows: int | None = None,
    width: int = WIDTH,
    start=None,
    end=None,
) -> Outcome:
    """All factors over ``bars``, which are read once.

    ``values`` holds the present, finite values with ``start <= trade_date <= end``, as tables under the
    folder of ``spark.checkpoint.dir``. A factor whose formula cannot be built, names an unknown
    column or operator, or fails while it runs, has no value and an entry in ``errors``; a job that
    something else stops raises.
    ``rows`` is the number of bars; when the caller does not know it, they are counted. Each job's
    shuffle files go with the job.
    """
    spark = bars.sparkSession
    nodes, errors = formulas(factors, bars.columns)
    folder = new_folder(spark)
    jobs = packed(nodes, width)
    shared = shared_windows(jobs)
    base = bars.select(*KEYS, *columns_read(nodes.values()))
    with short_shuffles(spark):
        parts = run_jobs(base, folder, jobs, nodes, shared, errors, section_rows, rows, start, end)
    return Outcome(written(bars, parts), errors, list(factors))


def of_date(node: Node) -> bool:
    """Whether a window has one value for each date."""
    return node.kind == "cs" and node.op in AGGREGATES and not node.params[-1]


def with_windows(table: DataFrame, folder: str, nodes: Mapping[str, Node], shared: Mapping[str, Node],
                 section_rows: int | None, rows: int) -> tuple[DataFrame, dict[str, Node]]:
    """``table`` with a column for each shared window, and the windows that have one.

    Windows with one value for each date are a table of the calendar, which is broadcast, so no bar is shuffled by
    date for them. The others are written beside what the jobs read of the bars, unless they are windows by symbol of
    the first pass alone: a job gets those in a pass of its own for less than another table of the bars takes.
    """
    spark = table.sparkSession
    dates = {k: n for k, n in shared.items() if of_date(n)}
    read: dict[str, Node] = {}  # dates that are columns of the table
    done: dict[str, Node] = {}
    calendars: list[DataFrame] = []
    while left := {k: n for k, n in dates.items() if k not in read}:
        level = {k: n for k, n in left.items() if not (windows_of(n) - {k}) & left.keys()}
        args = {a.key: reading(a, read, done) for n in level.values() for a in n.args}
        inputs = with_factors(table.select(*KEYS, *columns_read(args.values())), {"a_" + k: a for k, a in args.items()}, section_rows=section_rows, rows=rows)
        values = [AGGREGATES[n.op](*[F.col("a_" + a.key) for a in n.args]).alias(column(k)) for k, n in level.items()]
        path = f"{folder}/sections/level={len(calendars)}"
        inputs.groupBy(F.col("trade_date").alias("date_")).agg(*values).write.parquet(path)
        calendars.append(spark.read.parquet(path))
        table = with_calendar(table, calendars[-1])
        read.update(level)
        done = {}
    rest = {k: reading(n, read, done) for k, n in shared.items() if k not in read}
    if not any(n.deps or n.kind == "cs" for n in rest.values()):
        return table, read
    shared = {**read, **rest}
    wide = with_factors(table, {column(k): n for k, n in rest.items()}, section_rows=section_rows, rows=rows)
    done = {}
    of_bars = set(columns_read([reading(n, shared, done) for n in nodes.values()])) - set(map(column, read))
    wide.select(*KEYS, *sorted(of_bars)).write.option("compression", PACKED).parquet(f"{folder}/bars")
    drop_folder(spark, f"{folder}/base")
    table = spark.read.parquet(f"{folder}/bars")
    for calendar in calendars:
        table = with_calendar(table, calendar)
    return table, shared


def with_calendar(table: DataFrame, calendar: DataFrame) -> DataFrame:
    """``table`` with the columns of ``calendar``, one row for each ``date_`` of the table."""
    return table.join(F.broadcast(calendar), F.col("trade_date").eqNullSafe(F.col("date_")), "left").drop("date_")


def run_jobs(base: DataFrame, folder: str, jobs: Sequence[Mapping[str, Node]], nodes: Mapping[str, Node], shared: Mapping[str, Node],
             errors: dict[str, str], section_rows: int | None, rows: int | None, start, end) -> list[str]:
    """Writes the bars, their shared windows, then the values of every job, whose folders it returns.

    Each of these is a query of its own, whose shuffle files go before the next one's come. Failures of
    formulas go to ``errors``; any other that halving a job does not mend is raised.
    """
    spark = base.sparkSession
    parts: list[str] = []
    base.write.option("compression", PACKED).parquet(f"{folder}/base")
    table = spark.read.parquet(f"{folder}/base")
    if rows is None:
        rows = table.count()
    # the widest job's shuffles come while few values lie beside them
    jobs = sorted(jobs, key=lambda job: -len(columns_read([reading(n, shared, {}) for n in job.values()])))
    try:
        table, shared = with_windows(table, folder, nodes, shared, section_rows, rows)
    except Exception as error:  # some shared window fails: each job computes its own instead
        log.warning("shared windows failed, jobs run on their own: %s", error)
        table, shared = spark.read.parquet(f"{folder}/base"), {}
    turn = Semaphore(AT_ONCE if rows <= ALONE_ROWS else 1)

    def run(names: list[str], mark: str) -> None:
        done: dict[str, Node] = {}
        outputs = {n: reading(nodes[n], shared, done) for n in names}
        part = f"{folder}/values/job={mark}"
        try:
            out = with_factors(table.select(*KEYS, *columns_read(outputs.values())), outputs, section_rows=section_rows, rows=rows)
            with turn:
                store(in_range(long_values(out, names), start, end), part)
            parts.append(part)
        except Exception as error:
            drop_folder(spark, part)
            if len(names) == 1:
                if not of_formula(error):
                    raise
                errors[names[0]] = f"{type(error).__name__}: {str(error)[:500]}"
                log.warning("factor %s failed: %s", names[0], error)
                return
            half = len(names) // 2
            run(names[:half], f"{mark}a")
            run(names[half:], f"{mark}b")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        try:
            for finished in [pool.submit(inheritable_thread_target(spark)(run), list(job), str(i)) for i, job in enumerate(jobs)]:
                finished.result()
        except Exception:
            pool.shutdown(cancel_futures=True)
            drop_folder(spark, folder)
            raise
    for name in ("base", "bars", "sections"):
        drop_folder(spark, f"{folder}/{name}")
    return parts


def run_frames(spark_bars: DataFrame, parts: Mapping[str, Callable[[], DataFrame]]) -> Outcome:
    """The same for factors that are frames (symbol, trade_date and a column of each factor's name).

    ``parts`` maps a label to a callable; the factors of a part that fails stand as its label. As in
    ``run_factors``, what is not the part's own failure is raised.
    """
    spark = spark_bars.sparkSession
    folder = new_folder(spark)
    errors: dict[str, str] = {}
    names: list[str] = []
    done: list[str] = []
    for i, (label, make) in enumerate(parts.items()):
        part = f"{folder}/values/job={i}"
        try:
            with short_shuffles(spark):
                frame = make()
                own = [c for c in frame.columns if c not in KEYS]
                store(long_values(frame, own), part)
            names += own
            done.append(part)
        except Exception as error:
            if not of_formula(error):
                drop_folder(spark, folder)
                raise
            drop_folder(spark, part)
            errors[label] = f"{type(error).__name__}: {str(error)[:500]}"
            names.append(label)
    return Outcome(written(spark_bars, done), errors, names)


def long_values(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Factor columns to rows; missing and non-finite values are left out."""
    long = wide.select(*KEYS, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(KEYS, list(names), "factor_name", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def store(values: DataFrame, part: str) -> None:
    values.write.options(compression=PACKED, maxRecordsPerFile=FILE_ROWS).parquet(part)


def in_range(rows: DataFrame, start, end) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("trade_date") >= start)
    return rows if end is None else rows.where(F.col("trade_date") <= end)


def written(bars: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The values of all jobs that went through, each of which must still be there; no job gives an empty frame."""
    spark = bars.sparkSession
    schema = VALUES.format(symbol=bars.schema["symbol"].dataType.simpleString())
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
