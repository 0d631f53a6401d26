"""Finite-state scans: order-dependent folds of few states as a parallel prefix over transition functions.

A row maps each state to a next one, so a block of rows does too, and blocks compose. Functions of blocks are composed
upwards, start states go down again, and every block replays its own rows. Only a block of rows is ever together, so one key
that holds most rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import cut_lineage

#: Rows of a block, and blocks of a block of blocks.
BLOCK = 512

Step = Callable[[Column, Column], tuple[Column, Column]]


def _apply(function: Column, at: Column) -> Column:
    """State and count after a block's ``function``, for one that enters it as ``at``."""
    reached = F.get(function, at["state"].cast("int"))
    return F.struct(reached["state"].alias("state"), (at["opened"] + reached["opened"]).alias("opened"))


def _identity(states: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(states)), lambda s: F.struct(s.cast("int").alias("state"), F.lit(0).cast("long").alias("opened")))


def _start() -> Column:
    return F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("opened"))


def _entered(items: Column, start: Column, after: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(item, state before it)`` of every item in order."""
    grown = F.aggregate(
        items, F.struct(start.alias("at"), F.lit([]).cast(f"array<{kind}>").alias("list")),
        lambda acc, x: F.struct(after(acc["at"], x).alias("at"), F.concat(acc["list"], F.array(out(x, acc["at"]))).alias("list")),
    )
    return grown["list"]


def scan_states(rows: DataFrame, keys: Sequence[str], ordinal: str, symbol: str, states: int, step: Step, carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``keys, ordinal, carry, opened``: how often ``step`` has opened something, up to and with each row.

    ``step(state, symbol)`` gives the next state, 0 to ``states``, and whether the row opens something; a key starts in state 0.
    ``ordinal`` is the row's place in its key, from 0 without gaps. Rows and blocks of ``block`` are grouped twice; what
    remains per key is one function per ``block`` squared rows. Blocks are checkpointed: they are read to compose and to replay.
    """
    keys = list(keys)
    at = F.col(ordinal)

    def moved(state: Column, value: Column) -> Column:
        after, opens = step(state["state"], value)
        return F.struct(after.cast("int").alias("state"), (state["opened"] + F.when(opens, 1).otherwise(0)).alias("opened"))

    cells = rows.select(*keys, F.floor(at / (block * block)).alias("_upper"), F.floor(at / block).alias("_lower"), F.struct(at.cast("long").alias("o"), F.col(symbol).cast("int").alias("x"), *carry).alias("_cell"))
    lower = cells.groupBy(*keys, "_upper", "_lower").agg(F.sort_array(F.collect_list("_cell")).alias("_cells"))
    function = F.aggregate("_cells", _identity(states), lambda f, c: F.transform(f, lambda s: moved(s, c["x"])))
    lower = cut_lineage(lower.withColumn("_own", function))
    composed = lambda items: F.aggregate(items, _identity(states), lambda f, c: F.transform(f, lambda s: _apply(c["f"], s)))

    blocks = lower.select(*keys, "_upper", F.struct(F.col("_lower").alias("n"), F.col("_own").alias("f")).alias("_f"))
    upper = blocks.groupBy(*keys, "_upper").agg(F.sort_array(F.collect_list("_f")).alias("_fs"))
    whole = upper.select(*keys, F.struct(F.col("_upper").alias("n"), composed(F.col("_fs")).alias("f")).alias("_f"))
    top = whole.groupBy(*keys).agg(F.sort_array(F.collect_list("_f")).alias("_fs"))

    kind = "struct<n: bigint, at: struct<state: int, opened: bigint>>"
    enter = lambda items, start: _entered(items, start, lambda at, c: _apply(c["f"], at), lambda c, at: F.struct(c["n"].alias("n"), at.alias("at")), kind)
    starts = top.select(*keys, F.explode(enter(F.col("_fs"), _start())).alias("_s")).select(*keys, F.col("_s.n").alias("_upper"), F.col("_s.at").alias("_at"))
    starts = upper.join(starts, [*keys, "_upper"]).select(*keys, "_upper", F.explode(enter(F.col("_fs"), F.col("_at"))).alias("_s"))
    starts = starts.select(*keys, "_upper", F.col("_s.n").alias("_lower"), F.col("_s.at").alias("_at"))

    kept = "".join(f", {c}: {dict(rows.dtypes)[c]}" for c in carry)
    replayed = _entered(
        F.col("_cells"), F.col("_at"), lambda at, c: moved(at, c["x"]),
        lambda c, at: F.struct(c["o"].alias("o"), *[c[name].alias(name) for name in carry], moved(at, c["x"])["opened"].alias("opened")), f"struct<o: bigint{kept}, opened: bigint>",
    )
    found = lower.join(starts, [*keys, "_upper", "_lower"]).select(*keys, F.explode(replayed).alias("_r"))
    return found.select(*keys, F.col("_r.o").alias(ordinal), *[F.col(f"_r.{name}").alias(name) for name in carry], F.col("_r.opened").alias("opened"))
