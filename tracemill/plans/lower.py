"""Syntax trees to DataFrames.

Every table's columns are renamed to `alias.column` at its scan, which makes
each name unique after joins; Catalyst folds the renaming away and still pushes
filters and columns down.  Names are bound here, against the schemas; all
optimisation is Catalyst's, but for bounds on a partition column (bounds.py).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.catalog import Catalog, Table
from tracemill.errors import BindError
from tracemill.functions import temporal
from tracemill.functions.scalars import SCALARS, Scalar
from tracemill.operators.joins import BROADCAST_BYTES
from tracemill.plans import syntax as s
from tracemill.plans.bounds import bounds, constant
from tracemill.plans.parser import interval_ns
from tracemill.sizes import estimated_bytes

AGGREGATES = frozenset("count sum avg min max stddev percentile rate delta histogram_quantile count_distinct approx_count_distinct".split())
#: An estimate of size from which there is none.
UNKNOWN = 1 << 62
TYPES = {"bigint": "bigint", "long": "bigint", "int": "int", "integer": "int", "double": "double", "float": "double", "string": "string", "varchar": "string", "text": "string", "boolean": "boolean"}
#: Functions of windows alone, with the arguments that they take.
RANKINGS = {"row_number": (0, 0), "rank": (0, 0), "dense_rank": (0, 0), "ntile": (1, 1), "lag": (1, 2), "lead": (1, 2), "first_value": (1, 1), "last_value": (1, 1)}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b,
    "||": lambda a, b: F.concat(a.cast("string"), b.cast("string")),
}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def has_aggregate(e: s.Expr) -> bool:
    return isinstance(e, s.Call) and e.name in AGGREGATES or any(has_aggregate(c) for c in s.children(e))


def has_over(e: s.Expr) -> bool:
    return isinstance(e, s.Over) or any(has_over(c) for c in s.children(e))


def rendered(e: s.Expr) -> str:
    """The name of a column without an alias."""
    if isinstance(e, s.Name):
        return e.name
    if isinstance(e, s.Star):
        return "*"
    if isinstance(e, s.Literal):
        return str(e.value).lower() if isinstance(e.value, bool) or e.value is None else str(e.value)
    if isinstance(e, s.Interval):
        return f"{e.ns}ns"
    if isinstance(e, s.Call):
        return f"{e.name}({', '.join(map(rendered, e.args))})" + (f" filter ({rendered(e.where)})" if e.where is not None else "")
    if isinstance(e, s.Unary):
        return f"{e.op}{' ' * e.op.isalpha()}{rendered(e.x)}"
    if isinstance(e, s.Binary):
        return f"{rendered(e.a)} {e.op} {rendered(e.b)}"
    return f"{type(e).__name__.lower()}({', '.join(map(rendered, s.children(e)))})"


def rebuilt(e: s.Expr, swap: Callable[[s.Expr], s.Expr | None]) -> s.Expr:
    """e with each part, from the top, that swap gives something for replaced by it."""
    new = swap(e)
    if new is not None:
        return new
    if isinstance(e, (s.Unary, s.IsNull, s.Like, s.Cast)):
        return replace(e, x=rebuilt(e.x, swap))
    if isinstance(e, s.Case):
        return s.Case(tuple((rebuilt(a, swap), rebuilt(b, swap)) for a, b in e.whens), rebuilt(e.other, swap))
    if isinstance(e, s.Over):
        whole = s.Call(e.call.name, tuple(rebuilt(a, swap) for a in e.call.args), None if e.call.where is None else rebuilt(e.call.where, swap))
        return s.Over(whole, tuple(rebuilt(x, swap) for x in e.partition), tuple(s.Order(rebuilt(o.expr, swap), o.descending) for o in e.order), e.frame)
    if isinstance(e, s.Sets):
        return s.Sets(e.kind, tuple(rebuilt(k, swap) for k in e.keys), tuple(tuple(rebuilt(k, swap) for k in x) for x in e.sets))
    if isinstance(e, s.Binary):
        return replace(e, a=rebuilt(e.a, swap), b=rebuilt(e.b, swap))
    if isinstance(e, s.Between):
        return replace(e, x=rebuilt(e.x, swap), low=rebuilt(e.low, swap), high=rebuilt(e.high, swap))
    if isinstance(e, s.In):
        return replace(e, x=rebuilt(e.x, swap), items=tuple(rebuilt(i, swap) for i in e.items))
    if isinstance(e, s.Call):
        return replace(e, args=tuple(rebuilt(a, swap) for a in e.args), where=None if e.where is None else rebuilt(e.where, swap))
    return e


class Lowering:
    def __init__(self, catalog: Catalog, now: int, join_hint: str | None = None, functions: dict[str, Scalar] = SCALARS):
        self.catalog, self.now, self.join_hint, self.functions = catalog, now, join_hint, functions
        self.scope: dict[str, Table] = {}
        #: Columns that joins by name have made one: name to the table that has it.
        self.shared: dict[str, str] = {}
        #: Group keys and aggregates by their trees, once rows are grouped.
        self.grouped: dict[s.Expr, Column] | None = None
        self.df: DataFrame

    # Names

    def inner(self, name: s.Name) -> str | None:
        """The inner name of a column of the tables in scope; None if there is none."""
        if name.table is not None:
            if name.table not in self.scope:
                raise BindError(f"unknown table {name.table!r}")
            if name.name not in self.scope[name.table].df.columns:
                raise BindError(f"table {name.table!r} has no column {name.name!r}")
            return f"{name.table}.{name.name}"
        if name.name in self.shared:
            return f"{self.shared[name.name]}.{name.name}"
        found = [a for a, t in self.scope.items() if name.name in t.df.columns]
        if len(found) > 1:
            raise BindError(f"column {name.name!r} is ambiguous: it is in {', '.join(found)}")
        return f"{found[0]}.{name.name}" if found else None

    def bound(self, e: s.Expr, aliases: dict[str, s.Expr], alias_first: bool) -> s.Expr:
        """e with select aliases written out and column names qualified."""

        def swap(x: s.Expr) -> s.Expr | None:
            if not isinstance(x, s.Name):
                return None
            alias = aliases.get(x.name) if x.table is None else None
            if alias is not None and alias_first:
                return alias
            name = self.inner(x)
            if name is not None:
                return s.Name(name[name.index(".") + 1 :], name[: name.index(".")])
            if alias is None:
                raise BindError(f"unknown column {x.name!r}")
            return alias

        return rebuilt(e, swap)

    # Expressions

    def kind(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def width(self, e: s.Expr, what: str) -> int:
        ns = interval_ns(e.value) if isinstance(e, s.Literal) and isinstance(e.value, str) else constant(e, self.now)
        if ns is None or ns <= 0:
            raise BindError(f"{what} has to be a positive interval or number of nanoseconds")
        return ns

    def fraction(self, e: s.Expr) -> float:
        q = e.value if isinstance(e, s.Literal) else None
        if isinstance(q, bool) or not isinstance(q, (int, float)) or not 0 <= q <= 1:
            raise BindError("a quantile has to be a number in 0..1")
        return float(q)

    def column(self, e: s.Expr) -> Column:
        if self.grouped is not None and e in self.grouped:
            return self.grouped[e]
        if isinstance(e, s.Literal):
            return F.lit(e.value)
        if isinstance(e, s.Interval):
            return F.lit(e.ns)
        if isinstance(e, s.Name):
            if self.grouped is not None:
                raise BindError(f"column {e.name!r} is neither grouped nor in an aggregate")
            return quoted(f"{e.table}.{e.name}")
        if isinstance(e, s.Unary):
            return -self.column(e.x) if e.op == "-" else ~self.column(e.x)
        if isinstance(e, s.Binary):
            a, b = self.column(e.a), self.column(e.b)
            return self.quotient(a, b) if e.op == "/" else _COMPARE[e.op](a, b)
        if isinstance(e, s.IsNull):
            return self.column(e.x).isNull()
        if isinstance(e, s.Between):
            return self.column(e.x).between(self.column(e.low), self.column(e.high))
        if isinstance(e, s.In):
            x = self.column(e.x)
            if all(isinstance(i, s.Literal) for i in e.items):
                return x.isin([i.value for i in e.items])
            out = x == self.column(e.items[0])
            for i in e.items[1:]:
                out = out | (x == self.column(i))
            return out
        if isinstance(e, s.Like):
            return self.column(e.x).like(e.pattern.replace("\\", "\\\\"))
        if isinstance(e, s.Call):
            return self.call(e)
        if isinstance(e, s.Case):
            out = None
            for test, value in e.whens:
                out = F.when(self.condition(test), self.column(value)) if out is None else out.when(self.condition(test), self.column(value))
            return out.otherwise(self.column(e.other))
        if isinstance(e, s.Cast):
            if e.to not in TYPES:
                raise BindError(f"unknown type {e.to!r}; there are {', '.join(sorted(TYPES))}")
            return self.column(e.x).try_cast(TYPES[e.to])
        if isinstance(e, s.Over):
            return self.over(e)
        raise BindError("* is allowed in SELECT and count(*) only")

    def condition(self, e: s.Expr) -> Column:
        return F.lit(None).cast("boolean") if e == s.Literal(None) else self.column(e)

    def quotient(self, a: Column, b: Column) -> Column:
        """Of whole numbers, truncated, and an error for a zero divisor; else a double, null for a zero divisor."""
        if isinstance(self.kind(a), T.IntegralType) and isinstance(self.kind(b), T.IntegralType):
            return F.call_function("div", a, b)
        return F.try_divide(a.cast("double"), b.cast("double"))

    def call(self, e: s.Call) -> Column:
        if e.name in AGGREGATES:
            raise BindError(f"aggregate {e.name}() is not allowed here")
        if e.where is not None:
            raise BindError(f"FILTER needs an aggregate, not {e.name}()")
        if e.name == "now":
            return F.lit(self.now)
        if e.name == "time_bucket":
            if len(e.args) != 2:
                raise BindError("time_bucket(width, time) takes two arguments")
            return temporal.time_bucket(self.width(e.args[0], "a bucket's width"), self.column(e.args[1]))
        if e.name not in self.functions:
            raise BindError(f"unknown function {e.name}()")
        least, most, build = self.functions[e.name]
        if not least <= len(e.args) <= most:
            raise BindError(f"{e.name}() takes {least}" + (f" to {most}" * (most != least)) + f" arguments, not {len(e.args)}")
        return build(*[a.value if isinstance(a, s.Literal) and i else self.column(a) for i, a in enumerate(e.args)])

    def over(self, e: s.Over) -> Column:
        """A ranking, a neighbour's value or an aggregate over a window. Nulls are last, as in ORDER BY."""
        name, args = e.call.name, e.call.args
        window = Window.partitionBy(*[self.column(p) for p in e.partition])
        if e.order:
            window = window.orderBy(*self.sorted([(o.expr, o.descending) for o in e.order]))
        if e.frame is not None:
            low, high = e.frame
            window = window.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
        if name in AGGREGATES:
            if name in ("histogram_quantile", "percentile", "rate", "delta"):
                raise BindError(f"{name}() has no OVER")
            return self.aggregate(e.call, True).over(window)
        if name not in RANKINGS:
            raise BindError(f"{name}() has no OVER")
        least, most = RANKINGS[name]
        if not least <= len(args) <= most or not e.order:
            raise BindError(f"{name}() OVER needs {least}" + f" to {most}" * (most != least) + " arguments and ORDER BY")
        if name in ("row_number", "rank", "dense_rank"):
            made = getattr(F, name)()
        elif name in ("first_value", "last_value"):
            made = getattr(F, name)(self.column(args[0]))
        else:
            last = args[-1].value if isinstance(args[-1], s.Literal) and isinstance(args[-1].value, int) else None
            if last is None and (name == "ntile" or len(args) == 2):
                raise BindError(f"{name}() takes a whole number")
            made = F.ntile(last) if name == "ntile" else getattr(F, name)(self.column(args[0]), last if len(args) == 2 else 1)
        return made.over(window)

    def sorted(self, order: list[tuple[s.Expr, bool]]) -> list[Column]:
        return [c.desc_nulls_last() if down else c.asc_nulls_last() for e, down in order for c in [self.column(e)]]

    # Aggregates

    def aggregate(self, e: s.Call, over: bool = False) -> Column:
        """The aggregate as a column, except for quantiles."""
        n = len(e.args)
        if n < 1 or any(has_aggregate(a) for a in e.args) and e.name != "rate" and not over:
            raise BindError(f"{e.name}() can't take these arguments")
        keep = self.column(e.where) if e.where is not None else None
        if e.name == "rate":
            if n != 2:
                raise BindError("rate(x, window) takes two arguments")
            x, window = e.args[0], self.width(e.args[1], "a window")
            counted = x if isinstance(x, s.Call) and x.name in AGGREGATES else s.Call("count", (x,), e.where)
            return temporal.per_second(self.aggregate(counted), window)
        if isinstance(e.args[0], s.Star):
            if e.name != "count" or n != 1:
                raise BindError(f"{e.name}(*) is not allowed")
            return F.count(F.lit(1) if keep is None else F.when(keep, 1))
        x = self.column(e.args[0])
        x = x if keep is None else F.when(keep, x)
        if e.name == "delta":
            return temporal.delta(x, self.time_order())
        if n != 1:
            raise BindError(f"{e.name}() takes one argument")
        simple = {"count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "count_distinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct}
        return F.sum(x.cast("double")) if e.name == "sum" else simple[e.name](x)

    def time_order(self) -> Column:
        for alias, t in self.scope.items():
            if t.time is not None:
                return F.struct(*[quoted(f"{alias}.{c}") for c in (t.time, *t.ties)])
        raise BindError("delta() needs a table with a time column")

    def group(self, keys: list[s.Expr], calls: list[s.Call]) -> None:
        """Group self.df; keys and calls are then in self.grouped."""
        sets = keys[0] if len(keys) == 1 and isinstance(keys[0], s.Sets) else None
        keys = list(sets.keys) if sets else keys
        names = [f"__k{i}" for i in range(len(keys))]
        base = self.df.withColumns({n: self.column(k) for n, k in zip(names, keys)})
        ranks = [c for c in calls if c.name in ("histogram_quantile", "percentile")]
        made = {c: f"__a{i}" for i, c in enumerate(calls)}
        plain = [self.aggregate(c).alias(made[c]) for c in calls if c not in ranks]
        if sets is None:
            by = base.groupBy(*names)
        elif ranks:
            raise BindError(f"{ranks[0].name}() can't be grouped by {sets.kind}")
        elif sets.kind == "sets":
            by = base.groupingSets([[F.col(names[keys.index(k)]) for k in x] for x in sets.sets], *[F.col(n) for n in names])
        else:
            by = getattr(base, sets.kind)(*names)
        out = by.agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
        # Quantiles of one value share their work.
        alike: dict[tuple[s.Expr, s.Expr | None], list[s.Call]] = {}
        for c in ranks:
            between = c.name == "percentile"
            if between and len(c.args) != 2:
                raise BindError("percentile(x, q) takes two arguments")
            if not between and len(c.args) not in (2, 3):
                raise BindError("histogram_quantile(q, x) takes two arguments, and a number of buckets that is not used")
            if any(map(has_aggregate, c.args)):
                raise BindError(f"{c.name}() can't take these arguments")
            alike.setdefault((c.args[0] if between else c.args[1], c.where), []).append(c)
        for (value, where), mine in alike.items():
            x = self.column(value)
            x = x if where is None else F.when(self.column(where), x)
            asked = [(self.fraction(c.args[1] if c.name == "percentile" else c.args[0]), made[c], c.name == "percentile") for c in mine]
            found = temporal.quantiles(base.withColumn("__x_in", x), names, "__x_in", asked)
            found = found.withColumnsRenamed({n: f"__r{n}" for n in names})
            on = F.lit(True)
            for n in names:
                on = on & F.col(n).eqNullSafe(F.col(f"__r{n}"))
            out = out.join(found, on, "left").drop(*[f"__r{n}" for n in names])
        self.df = out
        self.grouped = {c: F.col(n) for c, n in made.items()} | {k: F.col(n) for k, n in zip(keys, names)}

    # Statement

    def scan(self, source: s.Source, where: s.Expr | None) -> DataFrame:
        t = self.scope[source.name]
        df = t.df
        if t.partition is not None and t.time is not None:
            low, high = bounds(where, lambda e: isinstance(e, s.Name) and (e.table, e.name) == (source.name, t.time), self.now)
            part, width = t.partition
            if low is not None:
                df = df.filter(F.col(part) >= low - low % width)
            if high is not None:
                df = df.filter(F.col(part) <= high - high % width)
        return df.select(*[quoted(c).alias(f"{source.name}.{c}") for c in df.columns])

    def joined_by_name(self, left: DataFrame, right: DataFrame, j: s.Join) -> DataFrame:
        """A join on columns of one name; without a table, the name means the column that has a value."""
        on, mine = F.lit(True), j.source.name
        for c in j.using:
            others = {a: t for a, t in self.scope.items() if a != mine and c in t.df.columns and f"{a}.{c}" in left.columns}
            theirs = self.shared.get(c) or next(iter(others), None)
            if theirs is None or c not in self.scope[mine].df.columns:
                raise BindError(f"column {c!r} of USING isn't in both tables")
            if len(others) > 1 and c not in self.shared:
                raise BindError(f"column {c!r} is ambiguous: it is in {', '.join(others)}")
            on = on & (quoted(f"{theirs}.{c}") == quoted(f"{mine}.{c}"))
            self.shared[c] = theirs
        out = left.join(right, on, j.how)
        if j.how in ("left_semi", "left_anti"):
            del self.scope[mine]
        elif j.how in ("right", "full"):
            out = out.withColumns({f"{self.shared[c]}.{c}": F.coalesce(quoted(f"{self.shared[c]}.{c}"), quoted(f"{mine}.{c}")) for c in j.using})
        return out

    def below(self) -> "Lowering":
        return Lowering(self.catalog, self.now, self.join_hint, self.functions)

    def lower(self, q: s.Select | s.Compound | s.With) -> DataFrame:
        if isinstance(q, s.With):
            catalog = Catalog(self.catalog)
            for name, query in q.named:
                catalog.register(name, Lowering(catalog, self.now, self.join_hint, self.functions).lower(query))
            return Lowering(catalog, self.now, self.join_hint, self.functions).lower(q.query)
        return self.compound(q) if isinstance(q, s.Compound) else self.single(q)

    def compound(self, q: s.Compound) -> DataFrame:
        a, b = self.below().lower(q.a), self.below().lower(q.b)
        if len(a.columns) != len(b.columns):
            raise BindError(f"{q.op.upper()} of {len(a.columns)} and of {len(b.columns)} columns")
        b = b.toDF(*a.columns)
        if q.op == "union":
            out = a.union(b) if q.all else a.union(b).distinct()
        elif q.op == "intersect":
            out = a.intersectAll(b) if q.all else a.intersect(b)
        else:
            out = a.exceptAll(b) if q.all else a.subtract(b)
        if not (q.order or q.limit is not None or q.offset):
            return out
        whole = s.Select((s.Item(s.Star()),), s.Source("", "", None), (), None, (), None, q.order, q.limit, q.offset)
        catalog = Catalog(self.catalog)
        catalog.register("", out)
        return Lowering(catalog, self.now, None, self.functions).lower(whole)

    def single(self, q: s.Select) -> DataFrame:
        for source in (q.source, *(j.source for j in q.joins)):
            if source.name in self.scope:
                raise BindError(f"two tables are called {source.name!r}")
            self.scope[source.name] = self.catalog.table(source.table) if source.query is None else Table(self.below().lower(source.query))
        where = None if q.where is None else self.bound(q.where, {}, False)
        if where is not None and has_aggregate(where):
            raise BindError("an aggregate is not allowed in WHERE")
        if any(has_over(e) for e in (q.where, q.having, *q.group) if e is not None):
            raise BindError("OVER is allowed in SELECT and ORDER BY only")
        self.df = self.scan(q.source, where)
        for j in q.joins:
            right = self.scan(j.source, where)
            if self.join_hint and not (self.join_hint == "broadcast" and BROADCAST_BYTES < estimated_bytes(right) < UNKNOWN):
                right = right.hint(self.join_hint)
            left = self.df
            if j.how == "cross":
                self.df = left.crossJoin(right)
                continue
            if j.using:
                self.df = self.joined_by_name(left, right, j)
                continue
            on = self.bound(j.on, {}, False)
            self.df = left.join(right)  # for types
            on = self.condition(on)
            self.df = left.join(right, on, j.how)
            if j.how in ("left_semi", "left_anti"):
                del self.scope[j.source.name]
        if where is not None:
            self.df = self.df.filter(self.condition(where))

        aliases: dict[str, s.Expr] = {}
        items: list[tuple[s.Expr, str]] = []
        for item in q.items:
            if isinstance(item.expr, s.Star):
                items += [(s.Name(c, a), c) for a, t in self.scope.items() for c in t.df.columns if self.shared.get(c, a) == a]
                continue
            e = self.bound(item.expr, aliases, False)
            items.append((e, item.alias or rendered(item.expr)))
            if item.alias:
                aliases[item.alias] = e
        keys = list(dict.fromkeys(self.bound(g, aliases, False) for g in q.group))
        having = None if q.having is None else self.bound(q.having, aliases, True)
        order = [(self.bound(o.expr, aliases, True), o.descending) for o in q.order]
        if any(map(has_aggregate, keys)):
            raise BindError("an aggregate is not allowed in GROUP BY")

        calls: dict[s.Call, None] = {}

        def collect(e: s.Expr) -> None:
            if isinstance(e, s.Call) and e.name in AGGREGATES:
                calls[e] = None
            else:
                for c in s.children(e):
                    collect(c)

        for e in (*(e for e, _ in items), *([] if having is None else [having]), *(e for e, _ in order)):
            collect(e)
        if keys or calls:
            self.group(keys, list(calls))
        if having is not None:
            self.df = self.df.filter(self.condition(having))

        shown = [self.column(e).alias(name) for e, name in items]
        if q.distinct:
            if lost := [e for e, _ in order if e not in [x for x, _ in items]]:
                raise BindError(f"with DISTINCT, ORDER BY takes selected expressions only, not {rendered(lost[0])}")
            place = {e: i for i, (e, _) in reversed(list(enumerate(items)))}
            names = [f"__s{i}" for i in range(len(items))]
            self.df = self.df.select(*[self.column(e).alias(n) for (e, _), n in zip(items, names)]).distinct()
            sort = [(F.col(names[place[e]]), down) for e, down in order]
            shown = [F.col(n).alias(name) for n, (_, name) in zip(names, items)]
        else:
            sort = [(self.column(e), down) for e, down in order]
        if sort:
            # Nulls are last in either direction.
            self.df = self.df.orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in sort])
        if q.offset:
            self.df = self.df.offset(q.offset)
        if q.limit is not None:
            self.df = self.df.limit(q.limit)
        return self.df.select(*shown)

