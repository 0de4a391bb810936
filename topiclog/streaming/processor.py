"""Command streams through the kernel, one state for each topic, with Structured Streaming.

The state store holds each topic's kernel; a restart from the checkpoint goes on where the last finished batch ended. Events equal
those of the batch replay of the same commands, as long as a topic's commands arrive in batches in order of cmd_seq. With `clients` a stream has what
replay_clients has: pacing, long polls, automatic acks and subscriptions; what comes due between commands is answered with the next of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from topiclog.operators.kernel import COMMAND, EVENT, Topic
from topiclog.operators.replay import Clients

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = [x.split()[0] for x in EVENT.split(", ")]


class TopicProcessor(StatefulProcessor):
    """Applies a micro-batch's commands of one topic in order of cmd_seq; start() makes a topic's first state."""

    def __init__(self, start=Topic):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("topic", "kernel binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        topic = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()
        batch = pd.concat(list(rows)).sort_values("cmd_seq").astype(object)
        whole = lambda v: [int(x) for x in v] if hasattr(v, "__len__") and not isinstance(v, str) else v
        out = []
        for row in batch.to_dict("records"):
            out += topic.apply({k: whole(v) if hasattr(v, "__len__") or not pd.isna(v) else None for k, v in row.items()})
        self.state.update((pickle.dumps(topic),))
        frame = pd.DataFrame(out, columns=COLUMNS)
        for name in ("msg_offset", "priority", "lease_id", "deadline_ms", "ord"):
            frame[name] = frame[name].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def read_commands(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Command files as they arrive; the number of files a batch is the backpressure."""
    return spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def events(commands: DataFrame, clients: bool = False) -> DataFrame:
    """Events of a stream of commands, by the state machine alone or with what a leader does around it for clients."""
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return commands.groupBy("topic").transformWithStateInPandas(TopicProcessor(Clients if clients else Topic), EVENT, "Append", "None")


def write_events(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once files of events; takes what is there and stops."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
