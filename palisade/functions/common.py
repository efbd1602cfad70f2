"""Small column helpers shared by every module."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Length argument of ``substring`` that means: to the end.
REST = (1 << 31) - 1
_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(c: Column) -> Column:
    """Trim every kind of white space on both ends."""
    return F.btrim(c, F.lit(_SPACES))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


class Stages:
    """Records DataFrame methods (``withColumn``, ``select``, ``filter``, ...) to be replayed on any DataFrame."""

    def __init__(self) -> None:
        self._ops: list[tuple[str, tuple, dict]] = []

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("columns", "schema"):
            raise AttributeError(name)

        def record(*args, **kwargs):
            self._ops.append((name, args, kwargs))
            return self

        return record

    def _add_opaque(self, cols: dict[str, Column]) -> Stages:
        self._ops.append(("__opaque", (), cols))
        return self

    def _replay(self, df: DataFrame) -> DataFrame:
        barriers = [i for i, op in enumerate(self._ops) if op[0] == "__opaque"]
        for i, (name, args, kwargs) in enumerate(self._ops):
            if name == "__opaque":
                # only the last barrier can be reached by a later filter; the others would just copy rows
                df = opaque(df, **kwargs) if i == barriers[-1] else df.withColumns(kwargs)
            else:
                df = getattr(df, name)(*args, **kwargs)
        return df


_RECORDED: dict[tuple, Stages] = {}


def recorded(fn):
    """Build the column expressions of a DataFrame -> DataFrame function once per set of arguments.

    A normaliser consists of some thousand column calls; each crosses from Python to the JVM, which takes seconds per use.
    The function must refer to columns by name only and take hashable arguments."""

    @functools.wraps(fn)
    def wrapper(df, *args, **kwargs):
        if isinstance(df, Stages):
            return fn(df, *args, **kwargs)
        key = (fn, id(SparkContext._active_spark_context), args, tuple(sorted(kwargs.items())))
        if key not in _RECORDED:
            stages = Stages()
            fn(stages, *args, **kwargs)
            _RECORDED[key] = stages
        return _RECORDED[key]._replay(df)

    return wrapper


def opaque(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns so that later filters cannot be rewritten in terms of what computes them.

    A staged normaliser refers to its own intermediate columns many times; without this, pushing one filter
    below the stages would multiply those expressions out.  The expressions run in a projection; the one-element
    ``inline`` on top of it only passes references on, within whole-stage codegen."""
    if isinstance(df, Stages):
        return df._add_opaque(cols)
    staged = df.withColumns({f"__o_{n}": c for n, c in cols.items()})
    struct = F.struct(*[F.col(f"__o_{n}").alias(n) for n in cols])
    return staged.select("*", F.inline(F.array(struct))).drop(*[f"__o_{n}" for n in cols])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression to a name so that ``body`` can use it many times while it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A table of constants as a local relation, so that its size is known to the optimizer."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = list(rows)
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], type=arrow.field(i).type) for i in range(len(arrow))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=struct)


def literal_map(mapping: Mapping[str, object]) -> Column:
    """Map literal; constant folded once per plan."""
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def lookup(mapping: Mapping[str, object], key: Column, default: object = None) -> Column:
    """Constant lookup; NULL or ``default`` for keys that are absent."""
    hit = F.try_element_at(literal_map(mapping), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def sorted_set(c: Column) -> Column:
    """Distinct, non-null, ascending array; NULL counts as empty."""
    element = F.array_compact(F.array_distinct(c))
    return F.array_sort(F.coalesce(element, F.array().cast("array<string>")))


def shorten(c: Column, n: int) -> Column:
    """At most n characters; what is cut is marked by an ellipsis in the last place."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def list_text(c: Column) -> Column:
    return F.array_join(c, ", ")


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without time zone (session zone is UTC)."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)
