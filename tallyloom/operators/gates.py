"""Rules fixed before a measurement that turn it into a verdict. Aggregates come from Spark, a verdict needs one row of them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.runs import order_statistics

D = Decimal

# Sample sizes and bounds of the gates.
MIN_REPS, EXTENDED_REPS, MIN_OPS, MAX_SD = 5, 10, 10_000, D("0.015")
P95_MAX_S, P99_MAX_S, MIN_SIGNALS = 1.0, 2.0, 100


def achievable(value: Decimal, n: int) -> bool:
    """Whether value, at its own number of places, is k / n for some whole k."""
    if n == 0:
        return True
    places = max(0, -int(value.as_tuple().exponent))
    k = (value * n).to_integral_value(ROUND_HALF_EVEN)
    return 0 <= k <= n and (k / n).quantize(D(1).scaleb(-places)) == value


@dataclass(frozen=True)
class Thresholds:
    q_acceptable_min: Decimal
    d_min: Decimal = D("0.95")
    d_acc_min: Decimal = D("0.99")
    unresolved_max: Decimal = D("0.03")
    r_min: Decimal = D("0.80")
    e_min: Decimal = D("0.90")
    capture_failure_max: Decimal = D("0.01")
    truth_coverage_min: Decimal = D("0.95")
    borderline_band: Decimal = D("0.02")
    d_acc_band: Decimal = D("0.005")

    def __post_init__(self) -> None:
        over_zero = {"r_min", "borderline_band", "d_acc_band"}
        wrong = [n for n, v in vars(self).items() if not 0 <= v <= 1 or (n in over_zero and v == 0)]
        if wrong:
            raise ValueError(f"not a fraction, or 0 where it may not be: {', '.join(wrong)}")


@dataclass(frozen=True)
class Metrics:
    d_cov: Decimal
    d_acc: Decimal
    r: Decimal | None
    t: Decimal | None
    truth_coverage: Decimal
    capture_failure: Decimal
    n: int
    n_residual: int | None

    def __post_init__(self) -> None:
        shares = {"d_cov": self.n, "truth_coverage": self.n, "capture_failure": self.n, "r": self.n_residual, "t": self.n_residual}
        for name, n in (shares | {"d_acc": None}).items():
            v = getattr(self, name)
            if v is not None and (not 0 <= v <= 1 or (n is not None and not achievable(v, n))):
                raise ValueError(f"{name} = {v} is no share of its sample")
        if (self.r is None) != (self.t is None) or (self.r is None) != (self.n_residual is None):
            raise ValueError("r, t and n_residual are measured together")
        if self.r is not None and self.t > self.r:
            raise ValueError("t can't be over r")
        if self.n < MIN_OPS or (self.n_residual is not None and self.n_residual < MIN_OPS):
            raise ValueError(f"a sample has at least {MIN_OPS}")

    def derived(self, th: Thresholds) -> dict[str, Decimal | None]:
        """d, the share decided rightly; f, what is left to scoring; e, what both reach together; q, how much of what scoring could find it does, where it can find enough."""
        d = self.d_cov * self.d_acc
        known = self.r is not None
        return {"d": d, "f": 1 - d, "e": d + (1 - d) * self.t if known else None, "q": self.t / self.r if known and self.r >= th.r_min else None}


@dataclass(frozen=True)
class _Point:
    d: Decimal
    d_acc: Decimal
    unresolved: Decimal
    r: Decimal | None
    t: Decimal | None

    def possible(self) -> bool:
        return self.d <= self.d_acc and (self.r is None or self.t <= self.r)

    def verdict(self, th: Thresholds) -> str:
        measured = self.r is not None
        covered = self.d >= th.d_min
        reliable = covered and self.d_acc >= th.d_acc_min and self.unresolved <= th.unresolved_max
        if self.d == 1 == self.d_acc:
            return "A"
        if covered and not reliable:
            return "NEEDS_DIFFERENT_MECHANISM"
        if not measured:
            return "CORRELATOR_NOT_MEASURED"
        found = self.r >= th.r_min
        if reliable:
            return "A" if found and self.t / self.r >= th.q_acceptable_min else "A_WITH_WEAK_RESIDUAL"
        if not found:
            return "NEEDS_DIFFERENT_MECHANISM"
        return "B_HYBRID" if self.d + (1 - self.d) * self.t >= th.e_min else "C_SCORING_REQUIRED"


def gate0(m: Metrics, th: Thresholds) -> str:
    if m.capture_failure > th.capture_failure_max:
        return "NULL"
    return "VALID" if m.truth_coverage >= th.truth_coverage_min else "VALID_BUT_INCONCLUSIVE"


def decide(m: Metrics, th: Thresholds) -> dict:
    """run, verdict, nominal, checked. BORDERLINE if moving any one input by its band would change the verdict."""
    run = gate0(m, th)
    if run != "VALID":
        return {"run": run, "verdict": None, "nominal": None, "checked": False}
    at = _Point(m.d_cov * m.d_acc, m.d_acc, 1 - m.truth_coverage, m.r, m.t)
    nominal = at.verdict(th)
    checked = m.r is not None
    bands = dict.fromkeys(("d", "unresolved", "r", "t"), th.borderline_band) | {"d_acc": th.d_acc_band}
    moved = [replace(at, **{n: getattr(at, n) + s * b}) for n, b in bands.items() for s in (-1, 1)] if checked else []
    shaky = any(p.possible() and p.verdict(th) != nominal for p in moved)
    return {"run": run, "verdict": "BORDERLINE" if shaky else nominal, "nominal": nominal, "checked": checked}


def spreads(repetitions: DataFrame) -> DataFrame:
    """By group: repetitions, fewest operations, and whether any metric's sample deviation is over the bound, in exact decimals.

    ``repetitions``: seed (fixed / variable), rep, metric, value DECIMAL, ops.
    """
    v = F.col("value").cast("decimal(18,9)")
    each = repetitions.groupBy("seed", "metric").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum((v * v).cast("decimal(28,18)")).alias("q"), F.min("ops").alias("ops"))
    n = F.col("n").cast("decimal(6,0)")
    over = n * F.col("q") - (F.col("s").cast("decimal(18,9)") * F.col("s").cast("decimal(18,9)")) > F.lit(MAX_SD * MAX_SD) * n * (n - 1)
    return each.groupBy("seed").agg(F.min("n").alias("reps"), F.max("n").alias("most_reps"), F.min("ops").alias("ops"), F.bool_or(over).alias("wide"))


def stability(repetitions: DataFrame) -> str:
    by = {r["seed"]: r for r in spreads(repetitions).collect()}  # two rows
    if any(s not in by or by[s]["reps"] < MIN_REPS or by[s]["ops"] < MIN_OPS for s in ("fixed", "variable")):
        return "INSUFFICIENT"
    if any(r["reps"] != r["most_reps"] for r in by.values()):
        raise ValueError("all repetitions must have the same metrics")
    if by["fixed"]["wide"]:
        return "UNSTABLE" if by["fixed"]["reps"] >= EXTENDED_REPS else "EXTEND_TO_10"
    return "STABLE_LOAD_SENSITIVE" if by["variable"]["wide"] else "STABLE"


def availability(signals: DataFrame, skew: DataFrame) -> DataFrame:
    """Latency of each signal less its node's clock skew; a node without a measured skew is an error."""
    joined = signals.join(skew, "node", "left")
    own = F.col("ingest_time") - (F.col("event_time") - F.col("skew_s"))
    return joined.withColumn("latency_s", F.when(F.col("skew_s").isNull(), F.raise_error(F.concat(F.lit("no skew for node "), "node")).cast("double")).otherwise(own))


def latency_gate(latencies: DataFrame) -> DataFrame:
    """n, p95, p99 (nearest rank) and verdict: PASS, FAIL, TOO_FEW, NOT_FINITE or NEGATIVE."""
    x = F.col("latency_s")
    odd = F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = latencies.agg(F.count("*").alias("n"), odd.alias("odd"), F.count_if(x < 0).alias("negative"))
    told = order_statistics(latencies, [], "latency_s", {"p95": ("nearest", "0.95"), "p99": ("nearest", "0.99")}).drop("n")
    out = out.join(F.broadcast(told), F.lit(True), "left")  # one row joins one
    ok = (F.col("p95") <= P95_MAX_S) & (F.col("p99") <= P99_MAX_S)
    verdict = F.when(F.col("n") < MIN_SIGNALS, "TOO_FEW").when(F.col("odd") > 0, "NOT_FINITE").when(F.col("negative") > 0, "NEGATIVE").when(ok, "PASS").otherwise("FAIL")
    return out.select("n", "p95", "p99", verdict.alias("verdict"))
