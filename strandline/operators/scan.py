"""States of a rule in which each row of a job needs the state that the row before left, over jobs of any length.

The rules here are monotone: below one bound of the state before, the new state is a number; below a second one it is another; beyond that
it is the state before and a shift, up to a cap. What several rows make of a state is a rule of the same form, so a block of rows is one
rule: blocks are composed in parallel, the states at their borders follow from the blocks' rules in the same way, a level up, and then each
block is gone through by itself. No task has more than a block of a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.arrays import bound
from strandline.sources.staging import written

BLOCK = 256  # rows
INFINITE = float("inf")


def rule(low: Column, first: Column, high: Column, second: Column, shift: Column | float, cap: Column | float = INFINITE) -> Column:
    """`first` for states below `low`, `second` below `high`, and from there on the state and `shift`, `cap` at most. `second` must lie
    between `first` and what comes after."""
    high = F.greatest(low, high)
    number = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    parts = {"low": low, "first": first, "high": high, "second": F.when(high > low, second).otherwise(first), "shift": shift, "cap": cap}
    return F.struct(*[number(v).alias(k) for k, v in parts.items()])


def applied(r: Column, state: Column) -> Column:
    return F.when(state < r["low"], r["first"]).when(state < r["high"], r["second"]).otherwise(F.least(r["cap"], state + r["shift"]))


def composed(m: Column, f: Column) -> Column:
    """The rule that first goes by m, then by f."""
    beyond = lambda at: F.when(f[at] <= m["cap"], f[at] - m["shift"]).otherwise(INFINITE)
    both = F.struct(
        F.greatest(m["high"], beyond("low")).alias("u"), F.greatest(m["high"], beyond("high")).alias("v"),
        applied(f, m["first"]).alias("a"), applied(f, m["second"]).alias("b")
    )

    def joined(x: Column) -> Column:
        make = lambda low, first, high, second: F.struct(
            low.alias("low"), first.alias("first"), high.alias("high"), second.alias("second"), (m["shift"] + f["shift"]).alias("shift"),
            F.least(f["cap"], F.when(m["cap"] >= f["high"], m["cap"] + f["shift"]).otherwise(INFINITE)).alias("cap"),
        )
        one = make(x["u"], f["first"], x["v"], F.when(x["v"] > x["u"], f["second"]).otherwise(f["first"]))  # all that was a number comes below f's first bound
        # the numbers that m gives lie below f's second bound, as does the lower part of what follows them
        joins = (x["b"] == f["second"]) | (m["high"] == m["low"])
        two = F.when(joins, make(m["low"], x["a"], x["v"], f["second"])).otherwise(make(m["high"], f["first"], x["v"], f["second"]))
        return F.when(x["u"] > m["high"], one).when(x["v"] > m["high"], two).otherwise(make(m["low"], x["a"], m["high"], x["b"]))

    return bound(both, joined)


def states(rows: DataFrame, step: Callable[[Column, Column], Column], rule_of: Callable[[Column], Column]) -> DataFrame:
    """rows (job_id, idx from 0 on, ...) with before (the state that the row before left, minus infinity for a job's first), at (that which
    the row leaves) and next (that of the row after it, null for a job's last).

    step(state, row) is the rule itself, rule_of(row) the same as a `rule`, which only tells the states at the borders of blocks. Jobs of
    one block need none."""
    entry = F.struct("idx", F.struct(*rows.columns).alias("row"))
    blocks = rows.groupBy("job_id", F.expr(f"cast(idx div {BLOCK} AS long)").alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    blocks = written(blocks.select("job_id", "block", F.transform("rows", lambda x: x["row"]).alias("rows")), "blocks")
    several = not blocks.where("block > 0").isEmpty()
    if several:
        nothing = rule(*[F.lit(-INFINITE)] * 4, 0.0)
        rules = blocks.select(
            "job_id", F.col("block").alias("idx"),
            F.aggregate("rows", nothing, lambda m, r: bound(rule_of(r), lambda f: composed(m, f))).alias("rule")
        )
        borders = states(rules, lambda state, r: applied(r["rule"], state), lambda r: r["rule"])
        blocks = blocks.join(borders.select("job_id", F.col("idx").alias("block"), "before"), ["job_id", "block"])
    else:
        blocks = blocks.withColumn("before", F.lit(-INFINITE))
    none = F.expr("cast(array() AS array<double>)")
    on = lambda s, r: bound(step(s["last"], r), lambda x: F.struct(x.alias("last"), F.concat(s["out"], F.array(x)).alias("out")))
    done = blocks.withColumn("at", F.aggregate("rows", F.struct(F.col("before").alias("last"), none.alias("out")), on, lambda s: s["out"]))
    following = F.lit(None).cast("double")
    if several:
        done = written(done, "states")
        heads = done.select("job_id", "block", F.lead(F.get("at", F.lit(0))).over(Window.partitionBy("job_id").orderBy("block")).alias("following"))
        done, following = done.join(heads, ["job_id", "block"]), F.col("following")
    size = F.size("rows")
    item = lambda i: F.struct(
        F.get("rows", i).alias("row"), F.when(i == 0, F.col("before")).otherwise(F.get("at", i - 1)).alias("before"), F.get("at", i).alias("at"),
        F.when(i + 1 < size, F.get("at", i + 1)).otherwise(following).alias("next"),
    )
    out = done.select(F.explode(F.transform(F.sequence(F.lit(0), size - 1), item)).alias("x"))
    return out.select("x.row.*", "x.before", "x.at", "x.next")
