"""Global running sums and row numbers without a one-partition window.

A caller names bucket expressions that never fall along the wanted order (for example the whole
percent of a score, or the first digits of a hash). Totals per bucket are summed up level by level,
and each row's running sum is its bucket's offset plus a window inside the bucket. Buckets are pure
functions of the row, so a recomputed task gives the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.scalars import hash_order, name, with_exprs

HASH_DIGITS = 4  # 65,536 buckets per hash-ordered group


def window(partition: Sequence[str], order: Sequence[str], frame: str = "") -> str:
    """SQL window specification."""
    by = f"PARTITION BY {', '.join(partition)} " if partition else ""
    return f"OVER ({by}ORDER BY {', '.join(order)} {frame})" if order else f"OVER ({by})"


def prefix_sum(df: DataFrame, sums: Mapping[str, str], order: Sequence[str], buckets: Sequence[str] = (),
               partition: Sequence[str] = (), totals: Mapping[str, str] | None = None) -> DataFrame:
    """Append inclusive running sums ``sums = {new column: summed column}`` along ``order``.

    ``buckets`` are columns from coarse to fine; ordering by them and then by ``order`` must be the
    wanted order. ``totals`` appends whole-partition sums in the same way, without another pass.
    Bucket and partition columns must be non-nullable expressions, so that the two uses of the input
    share one shuffle.
    """
    totals = totals or {}
    keys = [*partition, *buckets]
    over = window(keys, order, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    inside = {new: f"sum({old}) {over}" for new, old in sums.items()}
    if not buckets:
        whole = {new: f"sum({old}) {window(partition, [])}" for new, old in totals.items()}
        return with_exprs(df, {**inside, **whole})
    summed = dict.fromkeys([*sums.values(), *totals.values()])
    grouped = df.groupBy(*keys).agg(*[F.expr(f"sum({old}) AS _t_{old}") for old in summed])
    offsets = prefix_sum(grouped, {f"_c_{new}": f"_t_{old}" for new, old in sums.items()}, [buckets[-1]], buckets[:-1],
                         partition, {new: f"_t_{old}" for new, old in totals.items()})
    offsets = offsets.selectExpr(*keys, *[f"_c_{new} - _t_{old} AS _o_{new}" for new, old in sums.items()], *totals)
    joined = with_exprs(df.join(offsets, keys), inside)
    return with_exprs(joined, {new: f"{new} + _o_{new}" for new in sums}).drop(*[f"_o_{new}" for new in sums])


def hash_ranked(df: DataFrame, id_col: str, seed: int | str, partition: Sequence[str] = (), rank: str = "rank",
                key: str | None = None, size: str | None = None, digits: int = HASH_DIGITS) -> DataFrame:
    """Append the 1-based position of each row in the seeded hash order (ids must be distinct).

    ``key`` replaces the hashed id, for example to give each repeat its own order; ``size`` names a
    column for the number of rows of the partition. Rows without a partition value form their own one.
    """
    groups = {f"_g{i}": f"coalesce(CAST({name(c)} AS STRING), '')" for i, c in enumerate(partition)}
    keyed = df.selectExpr("*", f"{hash_order(key or id_col, seed)} AS _h", "1L AS _one",
                          *[f"{e} AS {g}" for g, e in groups.items()])
    keyed = keyed.selectExpr("*", f"substring(_h, 1, {digits}) AS _b")
    totals = {size: "_one"} if size else {}
    return prefix_sum(keyed, {rank: "_one"}, ["_h", id_col], ["_b"], list(groups), totals).drop("_h", "_one", "_b", *groups)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in ``order``, or in the order of all other columns where none is given.

    ``row_number() = 1`` becomes a group limit that every task applies before the shuffle, so a key
    that many rows share sends one row per task; unused columns are pruned from the scan.
    """
    order = list(order) or [f"`{c}`" for c in df.columns if c not in keys]
    numbered = df.selectExpr("*", f"row_number() {window(keys, order)} AS _rn")
    return numbered.filter("_rn = 1").select(*df.columns)
