"""Cash flows from a stream of cumulative snapshots.

State per fund: the last totals and their date, in a state store that a restarted
query reads back. A restated decrease gives no flow, and a snapshot older than
the last one gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "fund_id long, date date, amount double"
LAST = "as_of date, contributions double, distributions double"
#: Where a session is told its state store, the one that typed state needs, and Spark's default, which can't hold it.
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLAIN = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


class Differencing(StatefulProcessor):
    """Flows of one fund, from the totals that its state holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("as_of")
        last, out = self.last.get(), []
        for r in arrived.itertuples(index=False):
            if last is not None and r.as_of <= last[0]:
                continue
            called, paid = float(r.contributions), float(r.distributions)
            if last is not None:
                called, paid = called - last[1], paid - last[2]
            amount = max(paid, 0.0) - max(called, 0.0)
            if amount:
                out.append((key[0], r.as_of, amount))
            last = (r.as_of, float(r.contributions), float(r.distributions))
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["fund_id", "date", "amount"])

    def close(self) -> None:
        pass


def stream_flows(snapshots: DataFrame) -> DataFrame:
    """(fund_id, date, amount) as snapshots (fund_id, as_of, contributions, distributions) arrive.

    A query takes its state store from the session when it starts, so a session
    with Spark's default is set to ``STORE``, and stays so unless ``with_state``
    sets it back. Any other choice is left alone.
    """
    conf = snapshots.sparkSession.conf
    if conf.get(STORE_KEY) == PLAIN:
        conf.set(STORE_KEY, STORE)
    return snapshots.groupBy("fund_id").transformWithStateInPandas(statefulProcessor=Differencing(), outputStructType=OUT, outputMode="append", timeMode="none")


class with_state:
    """While it lasts, the session keeps state in ``STORE``, in so many partitions if given."""

    def __init__(self, spark: SparkSession, partitions: int | None = None) -> None:
        self.conf = spark.conf
        self.wanted = {STORE_KEY: STORE} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})

    def __enter__(self) -> None:
        self.before = {k: self.conf.get(k, None) for k in self.wanted}
        for k, v in self.wanted.items():
            self.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.conf.set(k, v) if v is not None else self.conf.unset(k)
