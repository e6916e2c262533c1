"""Factor expressions: plain Python values that name a computation on a bar panel.

A factor such as ``-corr(rank(open), rank(volume), 10)`` mixes three kinds of work:
row arithmetic, per-symbol windows (``ts``) and per-date cross-sections (``cs``).
Keeping the expression as a small value lets ``operators.panel.with_factors`` add
every window of the same kind in one pass, so that N factors share shuffles.
"""

from __future__ import annotations

import hashlib
import math


class Node:
    """One computation: ``op`` over ``args`` with literal ``params``."""

    __slots__ = ("op", "kind", "args", "params", "key", "deps")

    def __init__(self, op, kind, args=(), params=()):
        self.op, self.kind = op, kind
        self.args = tuple(wrap(a) for a in args)
        self.params = tuple(params)
        text = f"{kind}:{op}:{self.params!r}:" + ",".join(a.key for a in self.args)
        self.key = hashlib.sha1(text.encode()).hexdigest()[:14]
        below = [a.deps for a in self.args]
        below += [{a.key} for a in self.args if a.kind in ("ts", "cs")]
        self.deps = frozenset().union(*below)

    def __add__(self, o):
        return Node("add", "row", (self, o))

    def __radd__(self, o):
        return Node("add", "row", (o, self))

    def __sub__(self, o):
        return Node("sub", "row", (self, o))

    def __rsub__(self, o):
        return Node("sub", "row", (o, self))

    def __mul__(self, o):
        return Node("mul", "row", (self, o))

    def __rmul__(self, o):
        return Node("mul", "row", (o, self))

    def __truediv__(self, o):
        return Node("div", "row", (self, o))

    def __rtruediv__(self, o):
        return Node("div", "row", (o, self))

    def __pow__(self, o):
        return Node("pow", "row", (self, o))

    def __neg__(self):
        return Node("neg", "row", (self,))

    def __abs__(self):
        return Node("abs", "row", (self,))

    def __lt__(self, o):
        return Node("lt", "row", (self, o))

    def __le__(self, o):
        return Node("le", "row", (self, o))

    def __gt__(self, o):
        return Node("gt", "row", (self, o))

    def __ge__(self, o):
        return Node("ge", "row", (self, o))

    def eq(self, o):
        return Node("eq", "row", (self, o))

    def __and__(self, o):
        return Node("and", "row", (self, o))

    def __or__(self, o):
        return Node("or", "row", (self, o))


def wrap(value) -> Node:
    return value if isinstance(value, Node) else Node("lit", "lit", (), (value,))


def field(name: str) -> Node:
    return Node("field", "field", (), (name,))


# --- row functions -----------------------------------------------------------


def _row(op):
    def build(*args):
        return Node(op, "row", args)

    build.__name__ = op
    return build


sign, log, sqrt, exp = _row("sign"), _row("log"), _row("sqrt"), _row("exp")
where, coalesce, isnull = _row("where"), _row("coalesce"), _row("isnull")
greatest, least, nullif = _row("greatest"), _row("least"), _row("nullif")
floor_, block_no = _row("floor"), _row("block_no")


def notnull(x):
    return Node("notnull", "row", (x,))


def rounded(x, digits):
    return Node("round", "row", (x,), (digits,))


def clip(x, lo, hi):
    """Bound x, keeping NULL as NULL (least/greatest alone would skip it)."""
    return where(isnull(x), None, least(greatest(x, lo), hi))


def flag(cond):
    """1.0 / 0.0; an unknown comparison counts as false."""
    return where(cond, 1.0, 0.0)


def mean_of(*xs):
    """Mean over the values that are present; NULL when none is."""
    total, count = wrap(0.0), wrap(0.0)
    for x in xs:
        total = total + coalesce(x, 0.0)
        count = count + where(isnull(x), 0.0, 1.0)
    return total / count


def sum_of(*xs, at_least=1):
    total, count = wrap(0.0), wrap(0.0)
    for x in xs:
        total = total + coalesce(x, 0.0)
        count = count + where(isnull(x), 0.0, 1.0)
    return where(count >= float(at_least), total, None)


# --- per-symbol windows ------------------------------------------------------


def delay(x, n=1):
    return Node("delay", "ts", (x,), (n,))


def lead(x, n=1):
    return Node("lead", "ts", (x,), (n,))


def delta(x, n=1):
    return wrap(x) - delay(x, n)


def pct(x, n=1):
    return wrap(x) / delay(x, n) - 1.0


def _rolling(op):
    def build(x, n, need=None):
        return Node(op, "ts", (x,), (n, n if need is None else need))

    build.__name__ = op
    return build


mean, total, stdev = _rolling("mean"), _rolling("sum"), _rolling("std")
stdev_pop, variance = _rolling("stdp"), _rolling("var")
rmax, rmin, product = _rolling("max"), _rolling("min"), _rolling("product")
ts_rank, argmax, argmin = _rolling("ts_rank"), _rolling("argmax"), _rolling("argmin")
slope, mean_abs_dev, count_of = _rolling("slope"), _rolling("mad"), _rolling("count")


def corr(a, b, n, need=None):
    return Node("corr", "ts", (a, b), (n, n if need is None else need))


def cov(a, b, n, need=None):
    return Node("cov", "ts", (a, b), (n, n if need is None else need))


def decay_linear(x, n):
    return Node("decay", "ts", (x,), (n,))


def kept(x):
    """x as a column of its own as soon as it can be computed, so that what it is made of need not be carried on."""
    return Node("kept", "ts", (x,))


def ema(x, span):
    """Span EMA (adjust=False) that skips NULLs.

    As one window of ``rows`` bars the cut tail is < 1e-16; ``unfold_ema`` gives the
    running-sum form that Spark evaluates in one pass over the bars.
    """
    alpha = 2.0 / (span + 1.0)
    rows = math.ceil(math.log(1e-16) / math.log(1.0 - alpha))
    return Node("ema", "ts", (x,), (alpha, rows))


#: running sums restart before the weight ratio inside a block reaches this
BLOCK_RANGE = 1e150


def _ema_by_running_sums(x: Node, alpha: float) -> Node:
    """Linear-time EMA: with b = 1 - alpha, E_t = b^j (sum of y up to t) with y = a x b^-j.

    ``j`` counts present values from the start of a block; blocks are so long that only
    the block before the current one still carries weight.
    """
    keep = 1.0 - alpha
    size = float(int(math.log(BLOCK_RANGE) / -math.log(keep)))
    at = Node("seen", "ts", (x,)) - 1.0
    block = block_no(at / size)
    j = at - block * size
    y = x * where(at.eq(0.0), 1.0, alpha) * (wrap(keep) ** -j)
    run = Node("block_running_sum", "ts", (y, block))
    before = Node("previous_block_sum", "ts", (y, block)) * wrap(keep) ** size
    return kept(where(at >= 0.0, wrap(keep) ** j * (coalesce(run, 0.0) + coalesce(before, 0.0)), None))


def unfold_ema(node: Node, done: dict[str, Node]) -> Node:
    """``node`` with every EMA below it in running-sum form."""
    if node.key not in done:
        args = [unfold_ema(a, done) for a in node.args]
        if node.op == "ema":
            done[node.key] = _ema_by_running_sums(args[0], node.params[0])
        elif any(new is not old for new, old in zip(args, node.args)):
            done[node.key] = Node(node.op, node.kind, args, node.params)
        else:
            done[node.key] = node
    return done[node.key]


def unfold_fill(node: Node, done: dict[str, Node]) -> Node:
    """``node`` with every back-fill that only stands in for a forward-fill as the symbol's first present value.

    Before the first present value, and only there, the forward-fill of the same values is NULL.
    """
    if node.key not in done:
        args = [unfold_fill(a, done) for a in node.args]
        if node.op == "coalesce":
            filled = [a.args[0].key if a.op == "ffill" else None for a in args]
            args = [
                Node("first_of_all", "ts", a.args) if a.op == "bfill" and a.args[0].key in filled[:i] else a
                for i, a in enumerate(args)
            ]
        if any(new is not old for new, old in zip(args, node.args)):
            done[node.key] = Node(node.op, node.kind, args, node.params)
        else:
            done[node.key] = node
    return done[node.key]


#: windows of so many bars and more are put together from shorter ones
WIDE = 40
_WIDE_OPS = ("mean", "sum", "std", "stdp", "var", "max", "min", "count", "corr", "cov")


class _Parts:
    """The two parts of a window of n bars, out of blocks of n bars.

    A window ends inside one block and begins inside the one before: it is the start of its own block
    up to the bar, and the end of the block before from n - 1 bars ago on. Both parts grow bar by
    bar, so a window costs the same whatever its length, and nothing is ever subtracted.
    """

    def __init__(self, n: int):
        self.n = n
        at = Node("bar_index", "ts") - 1.0
        self.block = block_no(at / float(n))
        # the last bar of a block has its whole window inside the block
        self.reaches_back = (at + 1.0) > (floor_((at + 1.0) / float(n)) * float(n))

    def start(self, fn: str, *xs) -> Node:
        return Node(f"block_start_{fn}", "ts", (*xs, self.block))

    def end(self, fn: str, *xs) -> Node:
        ended = Node("delay", "ts", (Node(f"block_end_{fn}", "ts", (*xs, self.block)),), (self.n - 1,))
        return where(self.reaches_back, ended, None)

    def added(self, fn: str, *xs) -> Node:
        return coalesce(self.start(fn, *xs), 0.0) + coalesce(self.end(fn, *xs), 0.0)

    def joined(self, cross: str, x: Node, y: Node) -> Node:
        """Sum of products about the means, ``cross`` within the parts: the parts' own and that of their means."""
        na, nb = self.start("count", x), coalesce(self.end("count", x), 0.0)
        shift = where((na > 0.0) & (nb > 0.0), self.between(x) * self.between(y) * na * nb / (na + nb), 0.0)
        return self.added(cross, *((x,) if x is y else (x, y))) + shift

    def between(self, x: Node) -> Node:
        return self.start("mean", x) - self.end("mean", x)


def _from_pieces(op: str, x: Node, n: int, need: int) -> Node:
    """An extreme of n bars out of those of about the root of n bars, side by side.

    All of them run in the order of the bars, so unlike parts of blocks they take no sort of their own.
    """
    seen = Node("seen", "ts", (x,))
    count = seen - coalesce(delay(seen, n), 0.0)
    size = math.isqrt(n)
    piece = Node(op, "ts", (x,), (size, 1))
    # the oldest piece may overlap the one before
    pieces = [piece, *[delay(piece, i) for i in range(size, n - size, size)], delay(piece, n - size)]
    value = (greatest if op == "max" else least)(*pieces)
    return kept(where((count >= float(need)) & (count > 0.0), value, None))


def _from_parts(op: str, xs: tuple[Node, ...], n: int, need: int) -> Node:
    if op in ("max", "min"):
        return _from_pieces(op, xs[0], n, need)
    p = _Parts(n)
    if op == "count":
        return p.added("count", xs[0])
    if op in ("corr", "cov"):
        a, b = xs
        x, y = where(notnull(b), a, None), where(notnull(a), b, None)
        count, cross = p.added("count", x), p.joined("cross", x, y)
        if op == "cov":
            return where(count >= float(need), rounded(cross / nullif(count - 1.0, 0.0), 10), None)
        spread = sqrt(p.joined("square", x, x)) * sqrt(p.joined("square", y, y))
        flat = [least(p.start("min", v), p.end("min", v)).eq(greatest(p.start("max", v), p.end("max", v))) for v in (x, y)]
        return where((count >= float(need)) & where(flat[0] | flat[1], False, True), rounded(cross / spread, 10), None)
    (x,) = xs
    count = p.added("count", x)
    if op in ("sum", "mean"):
        value = p.added("sum", x) if op == "sum" else p.added("sum", x) / count
    else:
        square = p.joined("square", x, x)
        value = square / nullif(count if op == "stdp" else count - 1.0, 0.0)
        value = value if op == "var" else sqrt(value)
    return where((count >= float(need)) & (count > 0.0), value, None)


def unfold_wide(node: Node, done: dict[str, Node]) -> Node:
    """``node`` with every wide window below it put together from parts of blocks."""
    if node.key not in done:
        args = tuple(unfold_wide(a, done) for a in node.args)
        if node.kind == "ts" and node.op in _WIDE_OPS and node.params[0] >= WIDE:
            done[node.key] = _from_parts(node.op, args, *node.params)
        elif any(new is not old for new, old in zip(args, node.args)):
            done[node.key] = Node(node.op, node.kind, args, node.params)
        else:
            done[node.key] = node
    return done[node.key]


def unfolded(outputs) -> dict[str, Node]:
    """The same outputs by name, with averages, wide windows and fills in the form that is linear in the bars."""
    fill_done: dict[str, Node] = {}
    ema_done: dict[str, Node] = {}
    wide_done: dict[str, Node] = {}
    return {
        name: unfold_wide(unfold_ema(unfold_fill(node, fill_done), ema_done), wide_done) for name, node in outputs.items()
    }


def cumulative(x):
    return Node("cumsum", "ts", (x,))


def ffill(x):
    return Node("ffill", "ts", (x,))


def bfill(x):
    return Node("bfill", "ts", (x,))


def first_value(x):
    return Node("first", "ts", (x,))


def running_max(x):
    return Node("cummax", "ts", (x,))


def bar_index():
    return Node("bar_index", "ts")


def bars_total():
    return Node("bars_total", "ts")


def prior_max(x, n, need):
    """Maximum over the n bars before the current one."""
    return Node("prior_max", "ts", (x,), (n, need))


# --- per-date cross-sections -------------------------------------------------


def rank(x, by=(), ascending=True):
    """Average-tie percentile rank within the date (and the ``by`` fields)."""
    return Node("rank", "cs", (x,), (ascending, tuple(by)))


def _xs(op):
    def build(*args, by=()):
        return Node(op, "cs", args, (tuple(by),))

    build.__name__ = op
    return build


xmean, xsum, xcount = _xs("xmean"), _xs("xsum"), _xs("xcount")
xstd, xstdp, xmin, xmax = _xs("xstd"), _xs("xstdp"), _xs("xmin"), _xs("xmax")
xslope, xintercept = _xs("xslope"), _xs("xintercept")


def xquantile(x, q, by=()):
    return Node("xquantile", "cs", (x,), (q, tuple(by)))


def zscore(x, by=()):
    """Sample-deviation z-score; a constant section gives NULL."""
    return (wrap(x) - xmean(x, by=by)) / xstd(x, by=by)


def zscore_pop(x, by=()):
    return (wrap(x) - xmean(x, by=by)) / xstdp(x, by=by)


def demean(x, by=()):
    return wrap(x) - xmean(x, by=by)


def scale(x, a=1.0):
    return wrap(x) * a / (xsum(abs(wrap(x))) + 1e-8)


def winsorize(x, limit=0.025, by=()):
    return clip(x, xquantile(x, limit, by), xquantile(x, 1.0 - limit, by))


def residual(y, x, by=()):
    """OLS residual of y on x; with too little data it falls back to y minus its mean."""
    y, x = wrap(y), wrap(x)
    ok = notnull(y) & notnull(x)
    ym, xm = where(ok, y, None), where(ok, x, None)
    enough = (xcount(ym, by=by) >= 3.0) & (xmin(xm, by=by) < xmax(xm, by=by))
    fitted = y - xintercept(ym, xm, by=by) - xslope(ym, xm, by=by) * x
    spare = where(xcount(y, by=by) >= 2.0, y - xmean(y, by=by), None)
    return where(enough, fitted, spare)


def bucket(x, groups, by=()):
    """Quantile bucket 0..groups-1 (equal to qcut when the edges are distinct)."""
    label = wrap(0.0)
    for i in range(1, groups):
        label = label + where(wrap(x) > xquantile(x, i / groups, by), 1.0, 0.0)
    return where(isnull(x), None, label)


# --- staging -----------------------------------------------------------------


def windows_in(node: Node, found: dict[str, Node], seen: set[str]) -> None:
    """Collect all ts/cs nodes below ``node``, dependencies first."""
    if node.key in seen:
        return
    seen.add(node.key)
    for arg in node.args:
        windows_in(arg, found, seen)
    if node.kind in ("ts", "cs"):
        found.setdefault(node.key, node)


def passes(outputs) -> list[tuple[str, list[Node]]]:
    """Group window nodes into passes: everything ready of one kind goes together."""
    pending: dict[str, Node] = {}
    seen: set[str] = set()
    for node in outputs:
        windows_in(node, pending, seen)
    done: set[str] = set()
    plan: list[tuple[str, list[Node]]] = []
    kind = "ts"
    while pending:
        ready = [n for n in pending.values() if n.kind == kind and n.deps <= done]
        if not ready:
            kind = "cs" if kind == "ts" else "ts"
            continue
        plan.append((kind, ready))
        for n in ready:
            done.add(n.key)
            del pending[n.key]
    return plan
