"""Made-up traffic with a known truth: requests, upstreams, relays, two-sided events and journals with faults.

Every value is a function of the seed and the row's number, so a table of any
size is made where its rows are, and the same seed makes the same rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ranking import ranked

STALL_SHARE, STALL_S = 0.005, (1.0, 5.0)  # fixed values: how often an upstream stalls, and for how long


def uniform(seed: int, what: str, *of: Column) -> Column:
    """From 0 to below 1, by the seed, a name and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *of), 11).cast("double") / F.lit(float(1 << 53))


def normal(seed: int, what: str, *of: Column) -> Column:
    u, v = (F.greatest(uniform(seed, f"{what}{n}", *of), F.lit(1e-12)) for n in "uv")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _hex(seed: int, what: str, *of: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), F.lit(what), *of), 256), 1, 32)


def requests(spark: SparkSession, n: int, rate_per_s: float, seed: int, connections: int = 32, begin_ns: int = 0) -> DataFrame:
    """One row for each request sent: trace_id, path, conn_key, stream_id, timestamp_ns."""
    i = F.col("id")
    own = spark.range(n).select(i, _hex(seed, "trace", i).alias("trace_id"), F.floor(uniform(seed, "conn", i) * connections).alias("c"))
    at = F.lit(begin_ns) + F.floor((i + uniform(seed, "gap", i)) * F.lit(1e9 / rate_per_s)).cast("long")
    return own.select("trace_id", F.concat(F.lit("/truth-"), "trace_id").alias("path"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("conn_key"), (2 * i + 1).alias("stream_id"), at.alias("timestamp_ns"))


def upstream(received: DataFrame, seed: int, median_s: float = 0.02, spread: float = 0.5, most_bytes: int = 4096) -> DataFrame:
    """Arrivals answered after a log-normal time, now and then after a stall, with a body of any size up to a bound."""
    u = uniform(seed, "stall", F.col("path"), F.col("stream_id"))
    stall = F.when(u < STALL_SHARE, F.lit(STALL_S[0]) + uniform(seed, "long", F.col("path"), F.col("stream_id")) * (STALL_S[1] - STALL_S[0])).otherwise(0.0)
    took = F.lit(median_s) * F.exp(F.lit(spread) * normal(seed, "latency", F.col("path"), F.col("stream_id"))) + stall
    arrived = received.withColumnRenamed("timestamp_ns", "arrival_ns")
    return arrived.withColumns({"timestamp_ns": F.col("arrival_ns") + F.floor(took * 1e9).cast("long"), "response_size": F.floor(uniform(seed, "body", F.col("path"), F.col("stream_id")) * (most_bytes + 1)).cast("long")})


def relayed(sent: DataFrame, seed: int, fresh: bool = False, delay_ns: int = 100_000) -> DataFrame:
    """The requests as a relay passes them on: without their headers, or with a fresh trace, which it logs (path, trace_id)."""
    trace = _hex(seed, "fresh", F.col("path"), F.col("stream_id")) if fresh else F.lit("")
    return sent.withColumns({"trace_id": trace, "timestamp_ns": F.col("timestamp_ns") + F.lit(delay_ns)})


def two_sided_events(spark: SparkSession, n: int, rate_per_s: float, jitter_ns: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Left and right events (id, t, duration) of the same requests, their times told apart by up to the jitter; equal numbers are true pairs."""
    i = F.col("id")
    t = F.floor((i + uniform(seed, "gap", i)) * F.lit(1e9 / rate_per_s)).cast("long")
    took = F.floor(F.lit(2e7) * F.exp(F.lit(0.5) * normal(seed, "took", i))).cast("long")
    off = lambda what: F.floor((uniform(seed, what, i) * 2 - 1) * jitter_ns).cast("long")
    left = spark.range(n).select(F.concat(F.lit("l"), i.cast("string")).alias("id"), t.alias("t"), took.alias("duration"))
    right = spark.range(n).select(F.concat(F.lit("r"), i.cast("string")).alias("id"), (t + off("t")).alias("t"), (took + off("d")).alias("duration"))
    return left, right


@dataclass(frozen=True)
class Faults:
    """Shares of exchanges, or of observations, that go wrong."""

    reuse: float = 0.0  # carries the id of the exchange before it, from some inbound side on
    swap: float = 0.0  # two exchanges change ids, from some inbound side on
    swap_inside: float = 0.0  # the same, from an outbound side of a relay on
    loss: float = 0.0
    duplicates: float = 0.0
    late: float = 0.0
    keyless: float = 0.0  # without its connection
    disorder_us: int = 0

    def __post_init__(self) -> None:
        shares = (self.reuse, self.swap, self.swap_inside, self.loss, self.duplicates, self.late, self.keyless)
        if not all(0 <= s <= 1 for s in shares) or self.disorder_us < 0:
            raise ValueError("shares of faults lie between 0 and 1, disorder is no less than 0")


def journal(spark: SparkSession, exchanges: int, hops: int, faults: Faults, seed: int, gap_us: int = 1_000, window_us: int = 500, connections: int = 8) -> tuple[DataFrame, DataFrame]:
    """A journal of exchanges that pass ``hops`` relays, with faults, and the flow's configuration.

    Journal: flow_id, pos, kind, source, seq, point, side, keys, time, and for the score exchange, fault (reuse, swap,
    swap_inside, late, duplicate or null). An exchange takes part in one change of ids at most.
    """
    if not 1 <= hops <= 5:
        raise ValueError("between 1 and 5 relays")
    points = ["client", *[f"relay-{k}" for k in range(1, hops + 1)], "server"]
    sides = [(points[(j + 1) // 2], "outbound" if j % 2 == 0 else "inbound") for j in range(2 * (hops + 1))]
    i, u = F.col("i"), lambda what, *of: uniform(seed, what, *of)
    inbound, inner = list(range(1, len(sides), 2)), list(range(2, len(sides) - 1, 2))
    pick = lambda places, what, of: F.get(F.array(*map(F.lit, places)), F.floor(u(what, of) * len(places)).cast("int"))
    reuses = lambda x: (u("reuse", x) < faults.reuse) & (x > 0) & ~(u("reuse", x - 1) < faults.reuse)
    first = i - i % 2  # swaps happen within pairs of exchanges
    busy = reuses(first) | reuses(first + 1) | reuses(first + 2)
    whole = first + 1 < exchanges
    swaps = whole & ~busy & (u("swap", first) < faults.swap)
    inside = whole & ~busy & ~swaps & (u("inside", first) < faults.swap_inside)
    each = spark.range(exchanges).withColumnRenamed("id", "i")
    each = each.withColumn("change", F.when(reuses(i), "reuse").when(swaps, "swap").when(inside, "swap_inside"))
    begins = F.when(F.col("change") == "reuse", pick(inbound, "reuse at", i)).when(F.col("change") == "swap", pick(inbound, "swap at", first)).when(F.col("change") == "swap_inside", pick(inner, "inside at", first))
    each = each.withColumn("begins", begins).withColumn("j", F.explode(F.array(*map(F.lit, range(len(sides))))))
    changed = F.coalesce(F.col("j") >= F.col("begins"), F.lit(False))
    carries = F.when(changed & (F.col("change") == "reuse"), i - 1).when(changed, 4 * F.floor(i / 2) + 1 - i).otherwise(i).cast("long")
    names = F.array(*[F.struct(F.lit(p).alias("point"), F.lit(s).alias("side")) for p, s in sides])
    hop = F.floor(F.col("j") / 2).cast("int")
    connection = F.concat(F.lit("10.0."), hop.cast("string"), F.lit(".1:"), (40_000 + i % connections).cast("string"), F.lit("/"), (2 * F.floor(i / connections) + 1).cast("string"))
    keys = F.create_map(F.lit("traceparent"), _hex(seed, "trace", carries), F.lit("tuple5"), F.when(u("keyless", i, F.col("j")) >= faults.keyless, connection))
    rows = each.filter(u("loss", i, F.col("j")) >= faults.loss).select(
        i.alias("exchange"), "j", F.get(names, F.col("j")).alias("s"), F.map_filter(keys, lambda k, v: v.isNotNull()).alias("keys"), (i * gap_us + F.col("j") * 10).alias("time"),
        F.when(u("late", i, F.col("j")) < faults.late, "late").when(changed, F.col("change")).alias("fault"),
    )
    rows = rows.select("exchange", F.col("s.point").alias("source"), (F.col("exchange") * 2 + F.col("j") % 2).alias("seq"), "s.point", "s.side", "keys", "time", "fault")
    end = exchanges * gap_us + window_us + faults.disorder_us + 1
    is_late = F.coalesce(F.col("fault") == "late", F.lit(False))
    order = F.col("time") + F.floor(u("jitter", F.col("source"), F.col("seq")) * (faults.disorder_us + 1))
    told = rows.withColumn("order", F.when(is_late, F.lit(2 * end + 10)).otherwise(order)).withColumn("kind", F.lit("seen"))
    copies = rows.filter(~is_late & (u("copy", F.col("source"), F.col("seq")) < faults.duplicates)).withColumns({"order": order + 1 + F.floor(u("after", F.col("source"), F.col("seq")) * gap_us * 5), "kind": F.lit("seen"), "fault": F.lit("duplicate")})
    clocks = spark.range(0, exchanges, 5).select(F.explode(F.array(*map(F.lit, points))).alias("source"), (F.col("id") * gap_us).alias("time"))
    clocks = clocks.unionByName(spark.createDataFrame([(p, end) for p in points], "source string, time long"))
    clocks = clocks.select("source", "time", (F.col("time") + faults.disorder_us + 1).alias("order"), F.lit("advance").alias("kind"))
    both = told.unionByName(copies).unionByName(clocks, allowMissingColumns=True).withColumn("flow_id", F.lit("made"))
    placed = ranked(both.withColumn("_by", F.struct("kind", "source", "seq", "fault")), ["flow_id"], ["order", "_by"]).withColumnRenamed("rank", "pos")
    config = spark.createDataFrame([("made", points, window_us, faults.disorder_us, None)], "flow_id string, sources array<string>, window_us long, lateness_us long, max_silence_us long")
    return placed.select("flow_id", "pos", "kind", "source", "seq", "point", "side", "keys", "time", "exchange", "fault"), config


def hops_of(spark: SparkSession, hops: int) -> DataFrame:
    """The joins of a journal's hops: by trace, and by connection."""
    points = ["client", *[f"relay-{k}" for k in range(1, hops + 1)], "server"]
    rows = [(f"{a} -> {b}", [k], k == "traceparent", a, "outbound", b, "inbound") for a, b in zip(points, points[1:]) for k in ("traceparent", "tuple5")]
    return spark.createDataFrame(rows, "place string, keys array<string>, authored boolean, up_point string, up_side string, down_point string, down_side string")
