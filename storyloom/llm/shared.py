"""What the operators of this subpackage share: tables in the shared folder, and a join that hot keys do not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.sources.scratch import new_path, remove_written, saved, shared_dir

__all__ = ["HOT_SHARE", "new_path", "remove_written", "saved", "shared_dir", "spread_join"]

#: A key is hot if more than one in so many rows has it; so there are fewer hot keys than this.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``lookup``, which has one row per key and says in ``count`` how many of the
    ``total`` rows have it.

    Rows of hot keys stay where they are and meet their keys' rows, fewer than HOT_SHARE, by broadcast; only the others
    are dealt by key, so that no key is a large part of a task. Both tables are read twice.
    """
    hot = F.col(count) * HOT_SHARE > total
    known = F.broadcast(lookup.filter(hot))
    here = rows.join(known, keys)
    rest = rows.join(known.select(*keys), keys, "left_anti").join(lookup.filter(~hot), keys)
    return here.unionByName(rest)
