"""Ordered scans that stay distributed when one key, or no key at all, holds the data.

A window over ``(keys, order)`` puts a whole key into one task. Here a frame whose groups
are all small uses exactly that plain window. The groups above ``rows_per_block`` are range
partitioned on all of ``(keys, order)`` and written to the checkpoint dir, with the number of
the partition as the row's block: equal order values are told apart by the columns that break
ties, and every group has edges of its own. The window runs per ``(keys, block)``, one summary
row per block is carried forward, and the carry is joined back. The result is the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

BLOCK = "_blk"
ROWS_PER_BLOCK = 250_000
TASK_ROWS = 250_000
MAX_BLOCKS = 32_768
CONF_ROWS = "spark.residua.rowsPerBlock"


def rows_per_block(df: DataFrame, override: int | None = None) -> int:
    if override:
        return override
    return int(df.sparkSession.conf.get(CONF_ROWS, str(ROWS_PER_BLOCK)))


def dealt(df: DataFrame, keys: Sequence[str], bound: DataFrame | None = None) -> DataFrame:
    """Rows dealt by ``keys`` into so many tasks that each gets about ``TASK_ROWS``.

    Partitions that are merged up to a size on disk hold millions of packed rows, which an aggregate or a sort then has in
    memory several times over; a count, which parquet answers from its footers, bounds that. ``bound`` is a cheaper frame with at least as many rows.
    """
    total = (df if bound is None else bound).count()
    return df.repartition(max(math.ceil(total / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join on ``keys``, keeping the left copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


@dataclass
class OrderedFrame:
    """A DataFrame with keys, a total order, and (only where needed) blocks."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    blocked: bool
    size: int

    @classmethod
    def of(
        cls, df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None, bound: DataFrame | None = None, deal: bool = False
    ) -> "OrderedFrame":
        """Decide from counts whether any group is too large for one window task.

        ``order`` must be total (end it with a unique tie column). ``bound`` is a cheaper frame with the same key columns
        and at least as many rows per key; where it is given, the counting runs on it instead. ``deal`` deals groups into
        tasks by the number of rows, for frames that a count is cheap on.
        """
        size = rows_per_block(df, rows)
        keys, order = tuple(keys), tuple(order)
        counted = df if bound is None else bound
        if not keys:
            total = counted.count()
            if total <= size:
                return cls(df, keys, order, False, size)
            hot = df
        else:
            sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_group_rows"))
            large = checkpointed(sizes.filter(F.col("_group_rows") > size))
            total = large.agg(F.sum("_group_rows")).first()[0]
            if not total:
                return cls(dealt(df, keys, counted) if deal else df, keys, order, False, size)
            hot = join_on(df, large.select(*keys), keys, "left_semi")
        blocks = min(MAX_BLOCKS, math.ceil(total / size))
        cut = checkpointed(hot.repartitionByRange(blocks, *keys, *order).withColumn(BLOCK, F.spark_partition_id()))
        if keys:
            cut = cut.unionByName(join_on(df, large.select(*keys), keys, "left_anti").withColumn(BLOCK, F.lit(-1)))
            if deal:
                cut = dealt(cut, [*keys, BLOCK], counted)
        return cls(cut, keys, order, True, size)

    @property
    def parts(self) -> list[str]:
        return [*self.keys, BLOCK] if self.blocked else list(self.keys)

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def done(self) -> DataFrame:
        return self.df.drop(BLOCK) if self.blocked else self.df

    def _with(self, df: DataFrame) -> "OrderedFrame":
        return OrderedFrame(df, self.keys, self.order, self.blocked, self.size)

    def running(self, aggs: Mapping[str, tuple[str, Column | str]], inclusive: bool = True) -> "OrderedFrame":
        """Running sum/count/max/min up to the current row, or up to the row before it.

        ``aggs`` maps output name to (function, column).
        """
        fold = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
        frame = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        cols = {n: (f, F.col(c) if isinstance(c, str) else c) for n, (f, c) in aggs.items()}
        local = self.df.withColumns({n: fold[f](c).over(frame) for n, (f, c) in cols.items()})
        if not self.blocked:
            return self._with(local)
        totals = self.df.groupBy(*self.parts).agg(*[fold[f](c).alias(f"_t_{n}") for n, (f, c) in cols.items()])
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        again = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
        carry = totals.select(
            *self.parts, *[again[f](f"_t_{n}").over(before).alias(f"_k_{n}") for n, (f, _) in cols.items()]
        )
        # the first block of a key carries nothing in, so only cut keys have rows here
        carry = carry.filter(" OR ".join(f"_k_{n} IS NOT NULL" for n in cols))
        joined = join_on(local, carry, self.parts)
        out = {}
        for n, (f, _) in cols.items():
            a, b = F.col(n), F.col(f"_k_{n}")
            if f in ("sum", "count"):
                out[n] = F.coalesce(a + b, a, b)
            else:
                out[n] = F.greatest(a, b) if f == "max" else F.least(a, b)
        return self._with(joined.withColumns(out).drop(*[f"_k_{n}" for n in cols]))

    def row_number(self, name: str = "rn") -> "OrderedFrame":
        return self.running({name: ("count", F.lit(1))})

    def cume_dist(self, name: str) -> "OrderedFrame":
        """Share of rows of the key with an order value at or below this row's (first order column)."""
        value = self.order[0]
        frame = Window.partitionBy(*self.parts).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
        here = F.count(F.lit(1)).over(Window.partitionBy(*self.parts))
        local = self.df.withColumns({"_le": F.count(F.lit(1)).over(frame), "_here": here})
        if not self.blocked:
            return self._with(local.withColumn(name, F.col("_le") / F.col("_here")).drop("_le", "_here"))
        # a value that ends a block may go on at the head of the next ones
        wrapped = F.struct(F.col(value).alias("v"))
        totals = local.groupBy(*self.parts).agg(
            F.count(F.lit(1)).alias("_t"), F.min("_le").alias("_head"), F.min(wrapped).alias("_lo"), F.max(wrapped).alias("_hi")
        )
        heads = totals.groupBy(*self.keys, F.col("_lo").alias("_hi")).agg(F.sum("_head").alias("_heads"))
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy(*self.keys, "_lo").orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.keys)
        on = F.when(F.col("_lo") == F.col("_hi"), F.sum("_head").over(behind)).otherwise(F.col("_heads"))
        carry = join_on(totals, heads, [*self.keys, "_hi"]).select(
            *self.parts,
            F.col("_hi"),
            F.coalesce(on, F.lit(0)).alias("_on"),
            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_k"),
            F.sum("_t").over(whole).alias("_all"),
            F.count(F.lit(1)).over(whole).alias("_blocks"),
        ).filter("_blocks > 1").drop("_blocks")
        local = join_on(local, carry, self.parts)
        le = F.col("_le") + F.coalesce("_k", F.lit(0)) + F.when(wrapped.eqNullSafe(F.col("_hi")), F.col("_on")).otherwise(0)
        return self._with(local.withColumn(name, le / F.coalesce("_all", "_here")).drop("_le", "_here", "_hi", "_on", "_k", "_all"))

    def neighbour(self, columns: Mapping[str, str], step: int) -> "OrderedFrame":
        """Previous (step -1) or next (step 1) row's values as new columns: new name -> source."""
        fn = F.lag if step < 0 else F.lead
        w = self.window()
        if not self.blocked:
            return self._with(self.df.withColumns({n: fn(c).over(w) for n, c in columns.items()}))
        edge_w = w if step < 0 else Window.partitionBy(*self.parts).orderBy(*[F.col(o).desc() for o in self.order])
        local = self.df.withColumns(
            {**{n: fn(c).over(w) for n, c in columns.items()}, "_edge": F.row_number().over(edge_w) == 1}
        )
        pick = F.max_by if step < 0 else F.min_by
        packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
        ends = self.df.groupBy(*self.parts).agg(pick(packed, F.struct(*self.order)).alias("_end"))
        ends = ends.withColumn("_end", fn("_end").over(Window.partitionBy(*self.keys).orderBy(BLOCK)))
        ends = ends.filter(F.col("_end").isNotNull())
        joined = join_on(local, ends, self.parts)
        out = {n: F.when(F.col("_edge"), F.col("_end")[n]).otherwise(F.col(n)) for n in columns}
        return self._with(joined.withColumns(out).drop("_edge", "_end"))

    def bounded_frame(
        self, before: int, after: int, columns: Mapping[str, Callable[[object], Column]]
    ) -> DataFrame:
        """Columns over the frame ``before`` rows back to ``after`` rows ahead.

        A large key is cut by row position into chunks; each chunk also gets copies of the
        rows its frames reach into (at most ``before + after`` per chunk).
        """
        if not self.blocked:
            w = self.window().rowsBetween(-before, after)
            return self.df.withColumns({n: make(w) for n, make in columns.items()})
        chunk = max(self.size, before + after + 1)
        placed = self.row_number("_rn").done()
        pos = F.col("_rn") - 1
        home = F.floor(pos / chunk).cast("bigint")
        inside = (pos % chunk).cast("bigint")
        copies = F.array_compact(
            F.array(
                home,
                F.when((inside < after) & (home > 0), home - 1),
                F.when(inside >= chunk - before, home + 1),
            )
        )
        spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
        w = Window.partitionBy(*self.keys, "_chunk").orderBy("_rn").rowsBetween(-before, after)
        out = spread.withColumns({n: make(w) for n, make in columns.items()})
        return out.filter(F.col("_home") == F.col("_chunk")).drop("_rn", "_home", "_chunk")


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", rows: int | None = None) -> DataFrame:
    return OrderedFrame.of(df, keys, order, rows).row_number(name).done()


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key. The rank filter sits on the window, so Spark cuts each
    group to ``n`` rows before the shuffle and a hot key never reaches one task whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
