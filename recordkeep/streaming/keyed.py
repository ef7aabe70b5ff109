"""New records of a stream against a snapshot that grows with it: every code is held as keyed state, once.

The state of a code says that it is known. It starts from the codes of the snapshot, which are read once, when a
checkpoint is new, and partitioned like the stream; from then on each accepted record adds its own. Nothing is rewritten:
a batch touches the codes that it brings, the store keeps the rest and writes only changes to the checkpoint, from which a
stopped or lost query goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLAG = "is_known"


class Known(StatefulProcessor):
    """Lets the first row of an unknown code through, by ``order`` within a batch; known codes only if they are asked for."""

    def __init__(self, order: str, keep_known: bool):
        self.order, self.keep_known = order, keep_known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "since boolean")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.known.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen = self.known.exists()
        if seen and not self.keep_known:
            for _ in rows:  # to the end, so that the next key starts at its own
                pass
            return
        best = None
        for part in rows:
            own = part.nsmallest(1, self.order) if pd.api.types.is_numeric_dtype(part[self.order]) else part.sort_values(self.order, kind="stable").head(1)
            best = own if best is None or own[self.order].iloc[0] < best[self.order].iloc[0] else best
        if best is not None:
            self.known.update((True,))
            yield best.assign(**{FLAG: seen})

    def close(self) -> None:
        pass


def unseen_stream(records: DataFrame, snapshot: DataFrame, order: str, key: str = "code", keep_known: bool = False) -> DataFrame:
    """X2 against a growing snapshot: the first row of each ``key`` that neither ``snapshot`` nor an earlier batch holds.

    With ``keep_known`` the first row of a known key in a batch comes too, ``is_known``. ``snapshot`` counts when a
    checkpoint is new; rows without a key drop out. Start the query under :func:`keyed_state`.
    """
    kind = StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in records.dtypes) + f", {FLAG} boolean")
    own = snapshot.where(F.col(key).isNotNull()).select(key).distinct().groupBy(key)
    found = records.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(Known(order, keep_known), kind, "append", "none", own)
    return found if keep_known else found.drop(FLAG)


class keyed_state:
    """While this holds, queries are started with a state store that keyed state needs."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *error) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)
