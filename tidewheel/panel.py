"""A panel: one wide table of many series, with the roles of its columns.

A row is one time of one series: a key column, a time column (timestamp in UTC or long position) and
value columns. Roles are ``target`` (what is forecast), ``observed`` (known in the past only),
``known`` (known ahead too) and ``static`` (one value a series). Missing values are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

ROLES = ("target", "observed", "known", "static")


@dataclass(frozen=True)
class Panel:
    """A table with its key, its time column and the role of each value column."""

    df: DataFrame
    key: str
    ts: str
    roles: dict[str, str] = field(default_factory=dict)
    freq: str | None = None

    def columns(self, *roles: str) -> list[str]:
        """Value columns of these roles (of all, without any), in the order of the roles."""
        wanted = roles or ROLES
        return [c for r in wanted for c, role in self.roles.items() if role == r]

    def on(self, df: DataFrame, **roles: str) -> Panel:
        """The same panel over another table; ``roles`` adds columns."""
        kept = {c: r for c, r in (self.roles | roles).items() if c in df.columns}
        return replace(self, df=df, roles=kept)


def in_order(key: str | list[str], ts: str) -> WindowSpec:
    """Rows of one series in time order. All operators use this one window, so Spark sorts once."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(ts)


def whole(key: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def position(df: DataFrame, key: str, ts: str, step: str | None = None, name: str = "pos") -> DataFrame:
    """Add the position in the series: by arithmetic on a fixed step such as ``1 day`` (an aggregate
    and a join, no sort of long series), else by counting rows."""
    if step is None:
        return df.withColumn(name, F.row_number().over(in_order(key, ts)) - 1)
    first = df.groupBy(key).agg(F.min(ts).alias("_first"))
    seconds = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {step})")
    return df.join(first, key).withColumn(name, F.floor((F.unix_micros(ts) - F.unix_micros("_first")) / seconds).cast("long")).drop("_first")


def with_blocks(df: DataFrame, key: str, ts: str, step: str, block: int) -> DataFrame:
    """Add ``_block``: rows of ``block`` steps of time each, counted from the epoch."""
    length = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {step})") * block
    return df.withColumn("_block", F.floor(F.unix_micros(ts) / length))


def in_blocks(df: DataFrame, key: str, ts: str, step: str, need: int, block: int, fn) -> DataFrame:
    """Apply an operator that looks ``need`` rows back to series of any length.

    Each series is cut into blocks of ``block`` positions; the last ``need`` rows of a block are
    copied into the next, ``fn(df, keys)`` works by (key, block), and the copies go again. So no
    task holds a whole series, and one long series is worked on by many tasks.
    """
    at = position(df, key, ts, step, "_pos")
    own = F.floor(F.col("_pos") / block)
    both = F.when(F.col("_pos") % block >= block - need, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = at.withColumn("_own", own).withColumn("_block", F.explode(both))
    return fn(dealt, [key, "_block"]).filter("_block = _own").drop("_pos", "_own", "_block")


def is_missing(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isNull()
