"""Live analysis with Structured Streaming: chunks of a feed in, figures or events out.

State is one analyzer and one realigner for each stream, of bounded size: counters
for each PID (at most 8192), table sections of at most 4099 bytes and the last
unaligned bytes.  Chunks of one stream that arrive together are taken by their number.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsloom.functions.wire import PACKET, decode_packets
from tsloom.sources.packets import Realigner
from tsloom.streaming.core import Analyzer

STATS_SQL = "stream_id string, packets long, payload_bytes long, null_packets long, continuity_errors long, packets_lost long, transport_errors long, duplicates long, pes_packets long, sync_losses long, crc_errors long, dvb_crc_errors long, pcr_discontinuities long, pcr_repetition_errors long, pts_repetition_errors long, pat_repetition_errors long, pmt_repetition_errors long, late_timestamps long, errored_seconds long, observed_seconds long"
EVENTS_SQL = "stream_id string, packet_no long, ordinal int, event string, pid int, a long, b long, c long"


class Feed:
    """A stream's bytes so far: realigned, decoded and analyzed."""

    def __init__(self, stream_id: str):
        self.stream_id, self.align, self.analyzer = stream_id, Realigner(), Analyzer(stream_id)

    def take(self, data: bytes) -> list[dict]:
        number = self.align.packets
        found, losses = self.align.feed(data)
        out = []
        for raw in found:
            while losses and losses[0][0] <= number:
                out += self._loss(losses.pop(0))
            n = len(raw) // PACKET
            rows = decode_packets(np.frombuffer(raw, np.uint8), number + np.arange(n), pa.array([self.stream_id] * n, pa.string())).to_pylist()
            for row in rows:
                out += [e | {"packet_no": row["packet_no"]} for e in self.analyzer.feed(row)]
            number += n
        for loss in losses:
            out += self._loss(loss)
        return [e | {"stream_id": self.stream_id} for e in out]

    def _loss(self, loss: tuple[int, int]) -> list[dict]:
        return [e | {"packet_no": loss[0]} for e in self.analyzer.sync_lost(loss[1])]


def _step(pick):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed = pickle.loads(state.get[0]) if state.exists else Feed(key[0])
        chunks = pd.concat(batches).sort_values("chunk_no")
        events = [e for data in chunks["data"] for e in feed.take(bytes(data))]
        state.update((pickle.dumps(feed),))
        yield pick(key[0], feed, events)

    return step


def _events(_: str, __: Feed, events: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in EVENTS_SQL.split(", ")]
    return pd.DataFrame(events, columns=names).astype({"pid": "Int32", "a": "Int64", "b": "Int64", "c": "Int64"})


def _figures(stream_id: str, feed: Feed, _: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in STATS_SQL.split(", ")]
    return pd.DataFrame([feed.analyzer.stats() | {"stream_id": stream_id}], columns=names)


def live_events(chunks: DataFrame) -> DataFrame:
    """Append-only events of a stream of chunks (stream_id, chunk_no, data)."""
    return chunks.groupBy("stream_id").applyInPandasWithState(_step(_events), EVENTS_SQL, "state binary", "append", GroupStateTimeout.NoTimeout)


def live_stats(chunks: DataFrame) -> DataFrame:
    """Current figures of each stream that got chunks (output mode update)."""
    return chunks.groupBy("stream_id").applyInPandasWithState(_step(_figures), STATS_SQL, "state binary", "update", GroupStateTimeout.NoTimeout)


def tap(chunks: DataFrame, forward, alarms, checkpoint: str):
    """Passes every micro-batch on unchanged and its events to alarms(df, epoch); a failing listener stops neither."""

    def both(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            forward(batch, epoch)
            try:
                alarms(batch, epoch)
            except Exception as error:  # noqa: BLE001  a listener's fault must not stop the feed
                print(f"listener failed in batch {epoch}: {error}")
        finally:
            batch.unpersist()

    return chunks.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).start()
