"""As-of and positional joins; joins on a range alone are rewritten by the emitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], times: tuple[Column, Column], op: str = ">=", outer: bool = False, names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Each left row with the nearest right row of its keys whose time satisfies `left op right`.

    Both sides are united and sorted once by (keys, time); the last right row seen is the match, so the
    cost is one shuffle and one sort of both sides, never a product. A null key or time matches nothing.
    Of right rows with equal keys and times one is taken. Result: two struct columns named as `names`.
    """
    if op not in (">=", ">", "<=", "<"):
        raise ValueError(f"an as-of join needs an inequality, not {op!r}")
    some = "_k"
    lk = F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)], F.lit(0).alias("z"))
    rk = F.struct(*[k.alias(f"k{i}") for i, (_, k) in enumerate(keys)], F.lit(0).alias("z"))
    whole_l, whole_r = F.struct(*[left[c] for c in left.columns]), F.struct(*[right[c] for c in right.columns])
    lt, rt = left.schema, right.schema
    can = times[0].isNotNull()
    bad = F.lit(False)
    for k, _ in keys:
        bad = bad | k.isNull()
    first = 0 if op in (">=", "<=") else 1  # whether an equal time on the right comes before the left row
    a = left.select(lk.alias(some), times[0].alias("_t"), F.lit(1 - first if first else 1).alias("_o"), whole_l.alias("_l"), F.lit(None).cast(rt).alias("_r"), (~can | bad).alias("_bad"))
    ok = times[1].isNotNull()
    for _, k in keys:
        ok = ok & k.isNotNull()
    b = right.filter(ok).select(rk.alias(some), times[1].alias("_t"), F.lit(first).alias("_o"), F.lit(None).cast(lt).alias("_l"), whole_r.alias("_r"), F.lit(False).alias("_bad"))
    order = F.col("_t").asc() if op[0] == ">" else F.col("_t").desc()
    w = Window.partitionBy(some).orderBy(order, "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionAll(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    match = F.when(~F.col("_bad"), F.col("_m"))
    out = both.select(F.col("_l").alias(names[0]), match.alias(names[1]))
    return out if outer else out.filter(F.col(f"`{names[1]}`").isNotNull())


def with_row_index(df: DataFrame, name: str = "_row") -> DataFrame:
    """The position of each row in partition order, from 0, without moving rows.

    Partition sizes are one number a partition; what stands before each is joined in by broadcast (16 bytes a
    partition). The input is read twice and must come in the same partitions both times, as tables and files do.
    """
    tagged = df.withColumn("_mono", F.monotonically_increasing_id())
    part = F.shiftright("_mono", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(part).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    placed = tagged.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def positional_join(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Pairs rows by position; the shorter side is filled with nulls. Result: two struct columns."""
    a = with_row_index(left.select(F.struct(*[left[c] for c in left.columns]).alias("_l")))
    b = with_row_index(right.select(F.struct(*[right[c] for c in right.columns]).alias("_r")))
    return a.join(b, "_row", "full").select(F.col("_l").alias(names[0]), F.col("_r").alias(names[1]))
