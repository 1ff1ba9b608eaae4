"""Pages from anywhere in a long listing, without sorting the listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOTS = 63
#: Rows that one task may sort.
SORTED_ROWS = 100_000
_NEVER = (1 << 63) - 1
_Key = tuple[int, str]


def _below(key: _Key) -> Column:
    return (F.col("_at") < key[0]) | ((F.col("_at") == key[0]) & (F.col("_tie") < key[1]))


def _slot(pivots: list[_Key], first: int = 0) -> Column:
    """How many pivots are not above a row, by halving the list of pivots."""
    if not pivots:
        return F.lit(first)
    middle = len(pivots) // 2
    return F.when(_below(pivots[middle]), _slot(pivots[:middle], first)).otherwise(_slot(pivots[middle + 1:], first + middle + 1))


def page_at(
    rows: DataFrame, offset: int, limit: int, at: str = "created_at", tie: str = "target_id", pivots: int = PIVOTS, sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the listing newest first, equal times by ``tie``; rows without a time last.

    A distributed selection: some rows are chosen as pivots by a hash, all rows are counted between them, and only the
    rows between the pivots around the page go on, until few enough are left to sort. Each round reads the two sort
    columns and hands one count per pivot to the driver; rounds grow with the logarithm of the table. Rows of equal time
    and tie cannot be told apart and may change places.
    """
    order = {"_at": F.coalesce(-F.unix_micros(F.col(at).cast("timestamp")), F.lit(_NEVER)), "_tie": F.coalesce(F.col(tie).cast("string"), F.lit(""))}
    part, size, skipped, round_ = rows.withColumns(order), None, 0, 0
    while True:
        sample = part.select("_at", "_tie").orderBy(F.xxhash64("_at", "_tie", F.lit(round_))).limit(pivots).collect()
        keys = sorted({(row["_at"], row["_tie"]) for row in sample})
        counts = dict(part.groupBy(_slot(keys).alias("slot")).agg(F.count("*")).collect())
        first, before = 0, skipped
        while first < len(keys) and before + counts.get(first, 0) <= offset:
            before += counts.get(first, 0)
            first += 1
        last, left = first, counts.get(first, 0)
        while last < len(keys) and before + left < offset + limit:
            last += 1
            left += counts.get(last, 0)
        if first > 0:
            part = part.where(~_below(keys[first - 1])).where(_not_after(rows, at, keys[first - 1][0]))
        if last < len(keys):
            part = part.where(_below(keys[last]))
        stuck, size, skipped, round_ = left == size, left, before, round_ + 1
        if left <= max(sorted_rows, 2 * limit) or stuck:
            break
    page = part.orderBy("_at", "_tie").offset(max(0, offset - skipped)).limit(limit)
    return page.drop(*order)


def _not_after(rows: DataFrame, at: str, before: int) -> Column:
    """A comparison of the stored column that lets a scan skip files; a day too wide, for the sake of time zones."""
    if before == _NEVER:
        return F.lit(True)
    kind = dict(rows.dtypes)[at]
    moment = F.timestamp_micros(F.lit(-before)) + F.expr("interval 1 day")
    return F.col(at).isNull() | (F.col(at) <= (moment.cast(kind) if kind.startswith("timestamp") or kind == "date" else moment))
