"""The refresh as streams: payloads into the catalogue, running counts, and pages that overlap."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.status import STALE_MINUTES
from ..operators.tables import Catalog, upsert_offers


def ingest_payloads(stream: DataFrame, catalog: Catalog, normalise: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Upserts each batch of payload rows into the catalogue's offers and groups as a new version, and switches to it.

    A batch writes the parts that it touches. A version's name has the batch's number, so a batch that is run again after a failure writes
    the same version from the same one before it: nothing is applied twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        upsert_offers(catalog, normalise(batch), ["seq"], f"batch-{batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_progress(lines: DataFrame) -> DataFrame:
    """Products of each chain so far, from log lines (chain, products); for update or complete mode."""
    return lines.groupBy("chain").agg(F.sum("products").alias("products"), F.count("*").alias("lines"))


#: Steps of a chain within a run, in order, and those that end it.
STEPS = ("started", "fetched", "done", "failed")
FINAL = ("done", "failed")
STATE = "run_id string, chain string, step string, products long, at timestamp, error string"


def chain_states(lines: DataFrame, lateness: str = "5 minutes", minutes: int = STALE_MINUTES) -> DataFrame:
    """The state of each run's chain, told anew whenever log lines (run_id, chain, step, products, ts) move it on, as a stream in update mode.

    A state is the furthest step so far, the most products that a line told, and the last line's time: lines in another
    order give the same. If no line comes for the minutes, by the lines' own time, a timer fails the chain with the error timed out;
    a chain that has ended is forgotten then. Lines that come later than the lateness are dropped.
    """
    minute = 60_000

    def follow(key, frames, state):
        if state.hasTimedOut:
            rank, products, at = state.get
            state.remove()
            if STEPS[rank] not in FINAL:
                yield pd.DataFrame([(*key, "failed", products, pd.Timestamp(at, unit="us"), "timed out")], columns=names)
            return
        rank, products, at = state.get if state.exists else (0, 0, 0)
        for frame in frames:
            known = frame[frame["step"].isin(STEPS)]
            rank = max([rank, *known["step"].map(STEPS.index)])
            products = max([products, *frame["products"].dropna().astype(int)])
            at = max([at, *(frame["ts"].astype("datetime64[us]").astype("int64"))])
        state.update((int(rank), int(products), int(at)))
        state.setTimeoutTimestamp(max(at // 1000 + minutes * minute, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, STEPS[rank], products, pd.Timestamp(at, unit="us"), None)], columns=names)

    names = [c.split()[0] for c in STATE.split(", ")]
    timed = lines.select("run_id", "chain", "step", "products", "ts").withWatermark("ts", lateness)
    return timed.groupBy("run_id", "chain").applyInPandasWithState(follow, STATE, "rank int, products long, at long", "update", GroupStateTimeout.EventTimeTimeout)


def dedupe_pages(products: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first row of each store and product among pages that overlap, if both come within the lateness."""
    return products.withWatermark("scraped_at", lateness).dropDuplicatesWithinWatermark(["chain", "store_id", "product_id"])


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 day", lateness: str = "2 days") -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"))
