"""Sorted grouped maps without one Python call per group.

``groupBy().applyInPandas`` starts a call per group, which dominates for many small groups.
Here the rows of a group are made adjacent by a hash repartition and a sort, and one
``mapInPandas`` walks over batches, handing over whole groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def sorted_group_map(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Apply ``fn`` to frames that hold whole groups of ``keys``, sorted by ``keys`` then ``order``.

    ``fn`` sees many groups at once. Groups must be bounded (chunk hot keys first); null keys
    form a group like any other value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            k = batch[keys]
            last = k.iloc[-1]
            same = ((k == last) | (k.isna() & last.isna())).all(axis=1).to_numpy()
            cut = len(batch) - (int((~same[::-1]).argmax()) if not same.all() else len(batch))
            if cut > 0:
                whole = pd.concat([*held, batch.iloc[:cut]], ignore_index=True) if held else batch.iloc[:cut].reset_index(drop=True)
                first = held[-1][keys].iloc[-1] if held else None
                held = [batch.iloc[cut:]]
                del first
                yield fn(whole)
            elif held:
                h = held[-1][keys].iloc[-1]
                if bool(((h == last) | (h.isna() & last.isna())).all()):
                    held.append(batch)
                else:
                    whole = pd.concat(held, ignore_index=True)
                    held = [batch]
                    yield fn(whole)
            else:
                held = [batch]
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
