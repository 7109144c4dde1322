"""The operators over unbounded input, with Structured Streaming.

Decisions never depend on Spark's own watermark, which moves by micro-batch:
where a cut-off decides, the journal's positions do, so that any division of a
stream into batches gives the same results as one pass over all of it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators import replay
from tallyloom.operators.late_events import FingerTree
from tallyloom.operators.redelivery import DeliveryStore
from tallyloom.session import cut

PERIODS = "flow_id string, period_start_us long, rows long, corrections long, refused long, closed boolean, pos long"


def deliver(stream: DataFrame, store: DeliveryStore, checkpoint: str):
    """Starts a query that keeps each message of a stream of deliveries once. Batches given again add nothing."""
    return stream.writeStream.foreachBatch(lambda df, n: store.accept(df, n) and None).option("checkpointLocation", checkpoint).start()


def period_counts(stream: DataFrame, sources: dict[str, list[str]], lateness_us: dict[str, int], period_us: dict[str, int]) -> DataFrame:
    """Counts by flow and period of a stream of journal rows (flow_id, pos, source, seq, seen, time), told anew whenever they change.

    State of a flow: its sources' clocks, the open periods' counts and the identities of open periods. Rows of a
    micro-batch are taken in the order of ``pos``; batches must come in that order. Identities of closed periods
    are let go, so another delivery of such a row is told as refused.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flow = key[0]
        names, late, size = sorted(sources.get(flow, [])), lateness_us.get(flow, 0), period_us.get(flow, 1)
        clocks, keys, counts, corrections, ids, id_periods = state.get if state.exists else ([None] * len(names), [], [], [], [], [])
        clock_of = dict(zip(names, clocks))
        tree = FingerTree()
        for k, n, m in zip(keys, counts, corrections):
            tree.add(k, n, m)
        seen = dict(zip(ids, id_periods))
        touched: dict[int, list] = {}
        out: list[tuple] = []
        rows = pd.concat(list(batches)).sort_values("pos")
        for pos, source, seq, is_seen, time in rows[["pos", "source", "seq", "seen", "time"]].itertuples(index=False):
            if pd.isna(time):
                continue
            clock = None if not clock_of or None in clock_of.values() else min(clock_of.values())
            identity = f"{source}\x1f{seq}"
            if is_seen and identity not in seen:
                period = int(time) // size
                if clock is not None and time < clock - late:
                    out.append((flow, period * size, 0, 0, 1, False, pos))
                else:
                    corrects = int(clock is not None and clock >= (period + 1) * size)
                    tree.add(period, 1, corrects)
                    own = touched.setdefault(period, [0, 0, pos])
                    own[0], own[1], own[2] = own[0] + 1, own[1] + corrects, pos
                seen[identity] = period
            if source in clock_of and (clock_of[source] is None or time > clock_of[source]):
                clock_of[source] = int(time)
                if None not in clock_of.values():
                    edge = (min(clock_of.values()) - late) // size
                    for period, n, m in tree.close(1, edge):
                        out.append((flow, period * size, n, m, 0, True, pos))
                        touched.pop(period, None)
        rest = tree.close(1, float("inf"))
        out += [(flow, p * size, n, m, 0, False, touched[p][2]) for p, n, m in rest if p in touched]
        open_ = None if None in clock_of.values() or not clock_of else (min(clock_of.values()) - late) // size
        seen = {i: p for i, p in seen.items() if open_ is None or p >= open_}  # older ones would be refused anyway
        state.update((list(clock_of.values()), [p for p, _, _ in rest], [n for _, n, _ in rest], [m for _, _, m in rest], list(seen), list(seen.values())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PERIODS.split(", ")])

    held = "clocks array<long>, keys array<long>, counts array<long>, corrections array<long>, ids array<string>, id_periods array<long>"
    return stream.groupBy("flow_id").applyInPandasWithState(run, PERIODS, held, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, lateness: str, period: str, *by: str) -> DataFrame:
    """Counts by period with Spark's own watermark, where results need not be the same for every division into batches."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, period), *by).agg(F.count("*").alias("rows"))


class Reconciliation:
    """Decisions of a reconciliation journal that comes in batches: those of ``replay`` over all of it, however it is divided.

    Works as the function of ``foreachBatch``. Each batch writes a step: its decisions, the state of all blocks, the
    records seen, and last of all what it has counted, which makes the step complete. A batch given again after a
    failure starts from the last complete step before it and writes the same. A block is folded where its batch's
    entries are; its state holds what is open, and all blocks' states are written anew with each batch.
    """

    _STATE = "account string, currency string, state binary, " + replay.SCHEMA

    def __init__(self, path: str, config: replay.StreamConfig) -> None:
        self.path, self.config = path, config

    def _steps(self, spark: SparkSession) -> list[int]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = path(self.path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n[5:]) for n in names if n.startswith("step-") and files.exists(path(f"{self.path}/{n}/counted/_SUCCESS")))

    def _new(self, batch: DataFrame, steps: list[int]) -> DataFrame:
        """The batch without records that earlier ones brought; the same record with other content is an error."""
        if not steps:
            return batch
        content = F.sha2(F.to_json(F.struct(*replay._RECORD)), 256)
        seen = batch.sparkSession.read.parquet(*[f"{self.path}/step-{n}/seen" for n in steps]).select(F.col("side").alias("_side"), F.col("id").alias("_id"), "content")
        both = batch.join(seen, (F.col("kind") == "arrival") & (F.col("side") == F.col("_side")) & (F.col("id") == F.col("_id")), "left")
        told = F.raise_error(F.concat(F.lit("delivered with different content: "), "side", F.lit("/"), "id"))
        other = F.col("content").isNotNull() & (F.col("content") != content)
        return both.withColumn("kind", F.when(other, told).otherwise(F.col("kind"))).filter(F.col("content").isNull() | other).select(*batch.columns)

    def accept(self, batch: DataFrame, batch_id: int) -> None:
        spark, config = batch.sparkSession, self.config
        steps = [n for n in self._steps(spark) if n < batch_id]
        at, last = f"{self.path}/step-{batch_id}", f"{self.path}/step-{steps[-1]}" if steps else None
        counted = spark.read.parquet(f"{last}/counted").first() if last else {"positions": 0, **dict.fromkeys(replay.SIDES)}
        before, reached = counted["positions"], {s: counted[s] for s in replay.SIDES if counted[s] is not None}
        entries = cut(replay.positions(self._new(batch, steps)).withColumn("position", F.col("position") + before))
        arrivals, progress = entries.filter("kind = 'arrival'"), entries.filter("kind = 'progress'")
        moves = [tuple(r) for r in progress.groupBy("side", "until").agg(F.min("position").alias("position")).select("position", "side", "until").orderBy("position").collect()]  # no more than two for each day of the calendar
        shared = spark.sparkContext.broadcast((moves, reached))

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            told, known = shared.value
            own = pickle.loads(right["state"].iloc[0]) if len(right) else replay.BlockReplay(config)
            for side, day in known.items():
                own.reach(side, day)
            rows = left.astype(object).where(left.notna(), None).to_dict("records") if len(left) else []
            events = [(int(r["position"]), None, r) for r in rows] + [(p, side, until) for p, side, until in told]
            for position, side, what in sorted(events, key=lambda e: e[0]):
                if side is not None:
                    own.progress(position, side, what)
                    continue
                amount = what["amount"] if isinstance(what["amount"], Decimal) else Decimal(str(what["amount"]))
                own.record(position, what["side"], {"id": what["id"], "amount": amount, "value_date": what["value_date"], "reference": what["reference"]})
            out, own.out = own.out, []
            block = (right if len(right) else left)[["account", "currency"]].iloc[0].to_dict()
            rows = [{**block, **d} for d in out] + [{**block, "state": pickle.dumps(own)}]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in self._STATE.split(", ")]).astype(object)
            return frame.where(frame.notna(), None).astype({c: "Int64" for c in ("chain_version", "decided_at", "final_at", "step")})

        state = spark.read.parquet(f"{last}/state") if last else spark.createDataFrame([], "account string, currency string, state binary")
        out = cut(arrivals.groupBy("account", "currency").cogroup(state.groupBy("account", "currency")).applyInPandas(run, self._STATE))
        out.filter("state is null").drop("state").write.mode("overwrite").parquet(f"{at}/decisions")
        out.filter("state is not null").select("account", "currency", "state").write.mode("overwrite").parquet(f"{at}/state")
        arrivals.select("side", "id", F.sha2(F.to_json(F.struct(*replay._RECORD)), 256).alias("content")).write.mode("overwrite").parquet(f"{at}/seen")
        tops = [F.greatest(F.max(F.when((F.col("kind") == "progress") & (F.col("side") == s), F.col("until"))), F.lit(reached.get(s)).cast("date")).alias(s) for s in replay.SIDES]
        entries.agg((F.count("*") + F.lit(before)).alias("positions"), *tops).coalesce(1).write.mode("overwrite").parquet(f"{at}/counted")

    def decisions(self, spark: SparkSession) -> DataFrame:
        """All decisions so far."""
        return spark.read.parquet(*[f"{self.path}/step-{n}/decisions" for n in self._steps(spark)])


def reconcile(stream: DataFrame, into: Reconciliation, checkpoint: str):
    """Starts a query that replays a stream of journal entries."""
    return stream.writeStream.foreachBatch(lambda df, n: into.accept(df, n)).option("checkpointLocation", checkpoint).start()
