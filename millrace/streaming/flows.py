"""Flow operators on streams: sessions, two-timeout assembly with state, labeling, running counts, validated ingest."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions.flow import text_key
from millrace.operators.contract import coerce, row_rules
from millrace.operators.labeling import label_flows


def idle_flows(packets: DataFrame, idle: str, late: str = "10 minutes") -> DataFrame:
    """Flows by idle timeout alone, as session windows (``ts`` a timestamp, ``key``)."""
    p = packets.withColumn("key", text_key()) if "key" not in packets.columns else packets
    return p.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), "key").agg(F.count(F.lit(1)).alias("n_pkts"), F.sum("wire_len").alias("n_bytes")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_pkts", "n_bytes")


FLOW = "key string, t_start_us bigint, t_end_us bigint, n_pkts bigint, n_bytes bigint"
FLOW_COLUMNS = [c.split()[0] for c in FLOW.split(", ")]
#: States that the keys of a stream share: a state costs some milliseconds a batch, whatever it holds.
BUCKETS = 1_024


def _packed(flows: pd.DataFrame) -> bytes:
    """Flows (``FLOW_COLUMNS``) in Arrow's format, each key once."""
    columns = [pa.array(flows["key"], pa.string(), from_pandas=True).dictionary_encode(), *[pa.array(flows[c].astype("int64")) for c in FLOW_COLUMNS[1:]]]
    batch = pa.RecordBatch.from_arrays(columns, names=FLOW_COLUMNS)
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
        return out.getvalue().to_pybytes()


def _unpacked(chunks: list[bytes]) -> pd.DataFrame:
    if not chunks:
        return pd.DataFrame({c: pd.Series(dtype="object" if c == "key" else "int64") for c in FLOW_COLUMNS})
    tables = [pa.ipc.open_stream(c).read_all() for c in chunks]
    whole = pa.concat_tables([t.set_column(0, "key", t.column(0).cast(pa.string())) for t in tables])
    return whole.to_pandas()


def joined_flows(flows: pd.DataFrame, idle_us: int, active_us: int) -> tuple[pd.DataFrame, np.ndarray]:
    """``flows`` (a packet is a flow of one) joined by both timeouts in order of key and time; and whether each is its key's last.

    Of a key's flows only the first may be more than a packet. Packets of one time need no order, they share a flow.
    """
    if flows.empty:
        return flows, np.zeros(0, dtype=bool)
    codes = pd.factorize(flows["key"], use_na_sentinel=False)[0]
    order = np.lexsort((flows["t_end_us"], codes))
    flows, codes = flows.iloc[order], codes[order]
    start, end = flows["t_start_us"].to_numpy(), flows["t_end_us"].to_numpy()
    new = np.ones(len(flows), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (start[1:] - end[:-1] > idle_us)
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(flows))
    over = end[stop - 1] - start[first] > active_us
    for at, z in zip(first[over].tolist(), stop[over].tolist(), strict=True):
        while (at := at + int(np.searchsorted(end[at:z], start[at] + active_us, "right"))) < z:
            new[at] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(flows))
    sums = {c: np.add.reduceat(flows[c].to_numpy(), first) for c in ("n_pkts", "n_bytes")}
    made = pd.DataFrame({"key": flows["key"].to_numpy()[first], "t_start_us": start[first], "t_end_us": end[stop - 1]} | sums)
    return made, np.append(codes[first][1:] != codes[first][:-1], True)


class OpenFlows(StatefulProcessor):
    """The open flows of a bucket of keys, one a key, and the packets that the watermark hasn't passed yet.

    Packets wait until the watermark is beyond them, so they are taken in order of time whatever batches they came in; a
    flow is handed out when no packet that may still come can belong to it. A bucket has one timer, at the earliest time
    at which one of both is due. Its state is its keys' open flows and their packets of the watermark's delay, packed, so
    that the number of calls to the state store grows with the buckets and not with the keys or packets.
    """

    def __init__(self, idle_us: int, active_us: int):
        self.idle, self.active = idle_us, active_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getValueState("flows", "packed binary")
        self.timer = handle.getValueState("timer", "at bigint")
        self.waiting = handle.getListState("waiting", "packed binary")

    def _wake(self, first_us: int, before: int | None) -> None:
        """Set the timer; packets and deadlines of a millisecond are due when the watermark is beyond it."""
        at = first_us // 1000 + 1
        if before is not None and before <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chunks, first = [], []
        for b in rows:
            if len(b):
                chunks.append((_packed(pd.DataFrame({"key": b["key"], "t_start_us": b["ts_us"], "t_end_us": b["ts_us"], "n_pkts": 1, "n_bytes": b["wire_len"]})),))
                first.append(int(b["ts_us"].min()))
        if chunks:
            self.waiting.appendList(chunks)
            before = self.timer.get()
            self._wake(min(first), before[0] if before else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = _unpacked([c for (c,) in self.waiting.get()])
        before = self.flows.get()
        due = (waiting["t_start_us"] < passed).to_numpy()
        flows, last = joined_flows(pd.concat([_unpacked([before[0]] if before else []), waiting[due]]), self.idle, self.active)
        deadline = np.minimum(flows["t_end_us"] + self.idle, flows["t_start_us"] + self.active).to_numpy()
        still = last & ~(deadline < passed)
        rest = waiting[~due]
        if due.any():
            self.waiting.clear()
            if len(rest):
                self.waiting.put([(_packed(rest),)])
        if still.any():
            self.flows.update((_packed(flows[still]),))
        elif before:
            self.flows.clear()
        times = [*deadline[still].tolist(), *rest["t_start_us"].tolist()]
        if times:
            self._wake(min(times), None)
        if not still.all():
            yield flows[~still]

    def close(self) -> None:
        pass


def assembled_flows(packets: DataFrame, idle_us: int, active_us: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Flows by idle and active timeouts in order of time, handed out as they end; needs the RocksDB state store.

    How the packets were cut into batches makes no difference, as long as none is later than the watermark; Spark drops
    those that are and counts them in the query's progress. Keys are dealt to ``buckets`` states by hash; a bucket's
    packets of the watermark's delay are held by one task at a time, so more packets than some millions a bucket want
    more buckets. A checkpoint goes on with the number it was begun with.
    """
    p = packets.withColumn("key", text_key()).withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    rows = p.select("bucket", "key", "ts", "ts_us", F.col("wire_len").cast("bigint").alias("wire_len"))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=OpenFlows(idle_us, active_us), outputStructType=FLOW, outputMode="Append", timeMode="EventTime")


def labeled_stream(flows: DataFrame, rules: Sequence[Mapping], capture: str | None = None) -> DataFrame:
    """Rules are one expression, so a stream is labelled without state or join."""
    return label_flows(flows, rules, capture)


def projected_stream(flows: DataFrame, reference: DataFrame, label: str, tolerance: float, key: Sequence[str]) -> DataFrame:
    """T4: flows of a stream joined to the static reference events within the tolerance, by key and time bin."""
    r = reference.select(*key, F.col("t_start").alias("_rt"))
    r = r.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("_rt") / tolerance) + d for d in (-1, 0, 1)])))
    nearest = r.groupBy(*key, "_bin").agg(F.collect_set("_rt").alias("_rts"))
    f = flows.withColumn("_bin", F.floor(F.col("t_start") / tolerance))
    joined = f.join(nearest, [*key, "_bin"], "left")
    hit = F.coalesce(F.exists("_rts", lambda t: F.abs(t - F.col("t_start")) <= tolerance), F.lit(False)) & (F.col("binary_label") == "BENIGN")
    return joined.withColumns({"label": F.when(hit, label).otherwise(F.col("label")), "binary_label": F.when(hit, "ATTACK").otherwise(F.col("binary_label"))}).drop("_bin", "_rts")


def running_counts(rows: DataFrame, by: str, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """T5: rows of each class in tumbling windows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def validated_stream(rows: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Canonical rows to one folder, rows that break a rule of V1 to another with the rules' names.

    Each batch writes folders of its own (``batch=n``) and replaces what an earlier try has left there, so a batch
    that runs again after a failure doubles no row.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        named = F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in row_rules().items()]))
        flows = coerce(batch).withColumn("problems", named).persist()
        flows.where(F.size("problems") == 0).drop("problems").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        flows.where(F.size("problems") > 0).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        flows.unpersist()

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
