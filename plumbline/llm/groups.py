"""Groups that tasks read whole, and keys too large for one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def whole_groups(frames: Iterator[pd.DataFrame], key: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of about ``rows`` rows that cut no key's rows apart; the input is sorted by key."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            whole = pd.concat(held, ignore_index=True)
            last = (whole[key] == whole[key].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield whole[~last].reset_index(drop=True)
                whole = whole[last]
            held = [whole]
    if held:
        yield pd.concat(held, ignore_index=True)


#: A key with more than this part of all rows is joined without a shuffle of its rows.
HOT_PART = 1000


def join_by_key(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with their key's only row of ``found``, whose column copies says how many rows have it.

    Rows of a hot key stay where they are: of ``total`` rows fewer than ``HOT_PART`` keys can have
    more than one in ``HOT_PART``, so what is broadcast has fewer rows than that at every size.
    """
    hot = F.col("copies") * HOT_PART > total
    large = F.broadcast(found.where(hot))
    rest = rows.join(F.broadcast(found.where(hot).select(key)), key, "left_anti")
    return rows.join(large, key).unionByName(rest.join(found.where(~hot), key))
