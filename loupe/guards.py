"""Size checks for data that is broadcast or brought to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.session import keep

# largest per-label (or per-group) table joined by broadcast, in rows and in bytes of their JSON
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a small derived table after proving its size, else leave the join to Spark.

    The table (typically one narrow row per label) is kept in the shared folder
    and measured; the join then reads the kept rows, so measuring costs no second
    pass over the data it was aggregated from. Above ``max_rows`` or ``max_bytes``
    the kept table comes back without the hint, for a shuffled join.
    """
    small = keep(df)
    rows, size = small.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(small)
    return small


# most rows of a per-label / per-language table brought to the driver
MAX_DRIVER_ROWS = 1_000_000


def collect_bounded(df: DataFrame, what: str, max_rows: int = MAX_DRIVER_ROWS) -> list:
    """Collect a small table, fetching at most ``max_rows + 1`` rows.

    The limit bounds what reaches the driver even when the table is larger
    than expected; then the size is refused instead of truncated.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; too many to bring to the driver")
    return rows
