"""State machines over ordered rows, as a scan over transition functions.

The status of a row depends on all earlier rows of its key, yet no task walks a whole key. An action is a function from statuses to statuses, and
functions compose: rows of a key are cut into blocks by position, a block is folded into one function, the functions of earlier blocks
are composed in rounds (blocks of blocks), and each block is then walked from the status it is entered with. No group has more than ``SPAN`` members.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_checkpoint_dir
from .ordered import running_before

SPAN = 256

#: Actions: the status a row takes on, and the statuses it may come from (None: any).
Transitions = Mapping[str, tuple[str, Sequence[str] | None]]


def _function(action: Column, transitions: Transitions, statuses: Sequence[str]) -> Column:
    """Numbers of the next statuses by number of the status; -1 where the action is illegal or unknown."""
    nowhere = F.array(*[F.lit(-1)] * len(statuses))
    known = []
    for name, (target, sources) in transitions.items():
        known += [F.lit(name), F.array(*[F.lit(statuses.index(target) if sources is None or s in sources else -1) for s in statuses])]
    return F.coalesce(F.try_element_at(F.create_map(*known), action), nowhere)


def _then(first: Column, second: Column) -> Column:
    """First one function, then the other; -1 leaves a status as it is."""
    return F.transform(first, lambda s: F.when(F.get(second, s) < 0, s).otherwise(F.get(second, s)))


def _identity(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def _before(blocks: DataFrame, n: int, span: int) -> DataFrame:
    """(slot, block, before) of (slot, block, f): the composition of all earlier blocks of the slot, itself composed in blocks."""
    last = blocks.agg(F.max("block")).first()[0]
    if not last:
        return blocks.select("slot", "block", _identity(n).alias("before"))
    above = blocks.groupBy("slot", F.floor(F.col("block") / span).alias("upper")).agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("members"))
    start = F.struct(_identity(n).alias("now"), F.array().cast("array<array<int>>").alias("out"))
    walked = F.aggregate("members", start, lambda acc, m: F.struct(_then(acc["now"], m["f"]).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))
    above = above.withColumn("walked", walked).checkpoint()
    outer = _before(above.select("slot", F.col("upper").alias("block"), F.col("walked.now").alias("f")), n, span)
    outer = outer.select("slot", F.col("block").alias("upper"), F.col("before").alias("outer"))
    each = above.join(outer, ["slot", "upper"]).select("slot", "outer", F.explode(F.arrays_zip(F.col("members.block").alias("block"), F.col("walked.out").alias("inner"))).alias("m"))
    return each.select("slot", F.col("m.block").alias("block"), _then(F.col("outer"), F.col("m.inner")).alias("before"))


def run_machine(
    rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], action: Column, transitions: Transitions, statuses: Sequence[str],
    started: DataFrame | None = None, span: int = SPAN,
) -> DataFrame:
    """``rows`` with ``status`` (after the row) and ``accepted``. An illegal or unknown action is not accepted and changes nothing.

    A key starts in the first of ``statuses``, or in that of ``started`` (keys, status). ``bucket`` must not decrease along ``order``, which must be total
    within a key; null keys are a key. No rows, no result.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    n, names = len(statuses), F.array(*[F.lit(s) for s in statuses])
    placed = running_before(rows.withColumn("_f", _function(action, transitions, statuses)), keys, bucket, order, F.lit(1), "_pos")
    member = F.struct("_pos", F.col("_f").alias("f"), F.struct(*rows.columns).alias("row"))
    cut = placed.groupBy(F.struct(*keys).alias("slot"), F.floor(F.col("_pos") / span).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members")).checkpoint()
    folded = cut.select("slot", "block", F.aggregate("members", _identity(n), lambda acc, m: _then(acc, m["f"])).alias("f"))
    entered = _before(folded, n, span)
    begin = F.lit(0)
    if started is not None:
        known = started.select(F.struct(*keys).alias("slot"), (F.array_position(names, F.col("status")) - 1).cast("int").alias("from"))
        entered, begin = entered.join(known, "slot", "left"), F.coalesce("from", F.lit(0))
    entered = entered.select("slot", "block", F.get("before", begin).alias("enter"))

    def walk(acc: Column, m: Column) -> Column:
        step = F.get(m["f"], acc["now"])
        now = F.when(step < 0, acc["now"]).otherwise(step)
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.struct(now.alias("now"), (step >= 0).alias("accepted")))).alias("out"))

    start = F.struct(F.col("enter").alias("now"), F.array().cast("array<struct<now: int, accepted: boolean>>").alias("out"))
    each = cut.join(entered, ["slot", "block"]).select(F.explode(F.arrays_zip(F.col("members.row").alias("row"), F.aggregate("members", start, walk)["out"].alias("after"))).alias("m"))
    return each.select("m.row.*", F.get(names, F.col("m.after.now")).alias("status"), F.col("m.after.accepted").alias("accepted"))
