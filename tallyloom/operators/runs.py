"""What a measured run is worth: where spans belong, which requests pair, what the joins found, and how far times can be trusted.

Requests carry a truth id in their path; it labels what happened and is never
used to link. Every operator is a plan of joins and aggregations by request or
by group; order statistics come from distributed ranks.

Defined results: paths and headers that are null or in another form have no id;
requests seen more than once on a side pair with nothing unless an operator says
which one counts; groups without values have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import ranked

TRUTH = r"/truth-([0-9a-f]{32})(?:$|[/?])"  # fixed value: the label in a path
SERVER, CLIENT = "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT"  # fixed values
LEAST_DISTINCT, HOLDS_US, PARTIAL_US = 0.99, 100, 1_000
SIGNALS, LOCATING, STARTS = ("start", "end", "duration"), ("start", "end"), ("start", "handlerStart")


def truth_id(path: Column) -> Column:
    found = F.regexp_extract(path, TRUTH, 1)
    return F.when(found != "", found)


def trace_of(header: Column) -> Column:
    """The trace of a header version-trace-parent-flags, '' for any other form."""
    parts = F.split(header, "-")
    return F.when(F.size(parts) == 4, F.get(parts, F.lit(1))).otherwise(F.lit(""))


def placed(kind: Column, port: Column, server: Column, client: Column, upstream_port: int, hops: int) -> Column:
    """point and side of a span: the upstream by its port, relays by the name on their end; null elsewhere."""
    number = lambda name: F.regexp_extract(name, r"^hop-([1-9]\d*)$", 1).try_cast("int")
    at = lambda point, side: F.struct(point.alias("point"), F.lit(side).alias("side"))
    return (
        F.when((kind == SERVER) & (port.try_cast("int") == upstream_port), at(F.lit("fake-upstream"), "inbound"))
        .when((kind == SERVER) & number(server).between(1, hops), at(server, "inbound"))
        .when((kind == CLIENT) & number(client).between(1, hops), at(client, "outbound"))
    )


def selected(kind: str, port: int | None = None, attributes: dict[str, str] | None = None) -> Column:
    """Spans (kind, hostPort, attributes) of one observation point."""
    where = F.col("kind") == kind
    if port is not None:
        where = where & (F.col("hostPort").try_cast("int") == port)
    for name, value in (attributes or {}).items():
        where = where & (F.col("attributes")[name] == value)
    return F.coalesce(where, F.lit(False))


def without_known(rows: DataFrame, known: DataFrame, id_: str) -> DataFrame:
    """Rows whose id isn't that of traffic known to be outside the run; rows without an id stay."""
    return rows.join(known.select(id_).filter(F.col(id_).isNotNull()).distinct(), id_, "left_anti")


def seen_once(rows: DataFrame, by: list[str], id_: str, keep: list[str]) -> DataFrame:
    """The ids with one row only, with the columns to keep of it."""
    counted = rows.filter(F.col(id_).isNotNull()).groupBy(*by, id_).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in keep])
    return counted.filter("_n = 1").drop("_n")


def true_pairs(rows: DataFrame, by: list[str], up: tuple[str, str], down: tuple[str, str], keep: list[str], order: str) -> DataFrame:
    """One pair for each truth id seen on both ends; of several rows of an end the last in ``order`` counts. Columns up and down."""
    ends = []
    for name, (point, side) in (("up", up), ("down", down)):
        own = rows.filter((F.col("point") == point) & (F.col("side") == side) & F.col("truth").isNotNull())
        ends.append(own.groupBy(*by, "truth").agg(F.max_by(F.struct(*keep), order).alias(name)))
    return ends[0].join(ends[1], [*by, "truth"])


def validity(requests: DataFrame, observed: DataFrame, outside: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of requests (by, trace_id): how the observed events (by, truth, reported) account for them, and whether the run counts.

    An event of an id in ``outside`` (by, id) is told apart. Events without a truth id, of requests that weren't sent
    or repeated ones make the run INVALID, and its accuracy null.
    """
    sent = requests.groupBy(*by, F.col("trace_id").alias("truth")).agg(F.count("*").alias("_sent"))
    known = outside.select(*by, F.col("id").alias("_id"), F.lit(True).alias("_outside")).distinct()
    seen = observed.withColumn("_id", F.coalesce("truth", "reported")).join(known, [*by, "_id"], "left")
    inside = seen.filter("_outside is null")
    each = inside.filter("truth is not null").groupBy(*by, "truth").agg(F.count("*").alias("n"), F.first("reported").alias("reported"))
    both = sent.join(each, [*by, "truth"], "full")
    names = sent.select(*by, F.col("truth").alias("reported"), F.lit(True).alias("_named"))
    both = both.join(names, [*by, "reported"], "left")
    one, expected = F.col("n") == 1, F.col("_sent").isNotNull()
    told = both.groupBy(*by).agg(
        F.count_if(expected).alias("attempted"), F.count_if(expected & one & (F.col("reported") == F.col("truth"))).alias("correct"),
        F.count_if(expected & one & ~F.col("reported").eqNullSafe(F.col("truth")) & F.col("_named").isNotNull()).alias("swapped"),
        F.count_if(expected & one & F.col("_named").isNull()).alias("unknown"), F.count_if(expected & F.col("n").isNull()).alias("missing"),
        F.count_if(expected & (F.col("n") > 1)).alias("duplicated"), F.coalesce(F.sum(F.when(~expected, F.col("n"))), F.lit(0)).alias("unexpected"),
    )
    apart = seen.groupBy(*by).agg(F.count_if(F.col("_outside")).alias("outside"), F.count_if(F.col("_outside").isNull() & F.col("truth").isNull()).alias("unlabelled"), F.count_if(F.col("_outside").isNull()).alias("selected"))
    out = told.join(apart, by, "left").na.fill(0, ["outside", "unlabelled", "selected"])
    valid = (F.col("unlabelled") + F.col("unexpected") + F.col("duplicated") == 0) & (F.col("selected") > 0)
    return out.withColumn("status", F.when(valid, "VALID").otherwise("INVALID")).withColumn("accuracy", F.when(valid, F.col("correct") / F.col("attempted")))


def adjacent(reported: DataFrame, points: list[str], by: list[str]) -> DataFrame:
    """For each two points that follow one another: requests seen once at both, and those for which both report the same id. ``reported``: by, point, truth, id."""
    once = seen_once(reported, [*by, "point"], "truth", ["id"])
    own = once.withColumn("_at", F.array_position(F.array(*map(F.lit, points)), F.col("point"))).filter("_at > 0")
    after = own.select(*by, "truth", (F.col("_at") - 1).alias("_at"), F.col("id").alias("_next"))
    both = own.join(after, [*by, "truth", "_at"])
    return both.groupBy(*by, "_at").agg(F.count("*").alias("both_seen"), F.count_if(F.col("id").eqNullSafe(F.col("_next"))).alias("same_id")).select(*by, F.get(F.array(*map(F.lit, points)), (F.col("_at") - 1).cast("int")).alias("from"), F.get(F.array(*map(F.lit, points)), F.col("_at").cast("int")).alias("to"), "both_seen", "same_id")


def wire(requests: DataFrame, received: DataFrame, by: list[str]) -> DataFrame:
    """What the last receiver read from the headers: by request (by, trace_id, baggage), from its records (by, truth, trace_id, baggage)."""
    sent = requests.groupBy(*by, F.col("trace_id").alias("truth")).agg(F.max("baggage").alias("_baggage"))
    once = seen_once(received, by, "truth", ["trace_id", "baggage"])
    both = sent.join(once.withColumn("_once", F.lit(True)), [*by, "truth"], "left")
    got = F.col("_once").isNotNull()
    return both.groupBy(*by).agg(
        F.count("*").alias("measured"), F.count_if(got).alias("reached_once"), F.count_if(F.col("trace_id") == F.col("truth")).alias("received_once"),
        F.count_if(got & (F.coalesce("trace_id", F.lit("")) == "")).alias("traceparent_absent"), F.count_if(got & F.col("_baggage").eqNullSafe(F.col("baggage"))).alias("baggage_exact"), F.count_if(got & (F.coalesce("baggage", F.lit("")) == "")).alias("baggage_absent"),
    )


def delays(requests: DataFrame, received: DataFrame, by: list[str]) -> DataFrame:
    """kind (arrival, answer), delay_us and the time of release of every request that both logs tell: (by, trace_id, timestamp_ns, duration_ns) and (by, truth, arrival_ns, timestamp_ns)."""
    sent = requests.select(*by, F.col("trace_id").alias("truth"), F.col("timestamp_ns").alias("_sent"), (F.col("timestamp_ns") + F.col("duration_ns")).alias("_back"))
    both = sent.join(received.filter("arrival_ns is not null and arrival_ns <> 0"), [*by, "truth"])
    kinds = F.array(
        F.struct(F.lit("arrival").alias("kind"), (F.col("arrival_ns") - F.col("_sent")).alias("ns"), F.col("arrival_ns").alias("at_ns")),
        F.struct(F.lit("answer").alias("kind"), (F.col("_back") - F.col("timestamp_ns")).alias("ns"), F.col("_back").alias("at_ns")),
    )
    each = both.select(*by, "truth", F.explode(kinds).alias("k"))
    return each.select(*by, "truth", "k.kind", F.floor(F.col("k.ns") / 1000).cast("long").alias("delay_us"), "k.at_ns")


def contained(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of the pairs (up, down with start and end) whose downstream interval lies inside the upstream one."""
    inside = (F.col("up.start") <= F.col("down.start")) & (F.col("down.end") <= F.col("up.end"))
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(inside).alias("inside")).withColumn("share", F.col("inside") / F.col("pairs"))


# -- order statistics -----------------------------------------------------------


def _index(how: str, p: str, n: Column) -> Column:
    """Place, from 0, of a quantile by each of the definitions in use; ``p`` is decimal text, so that no rounding moves it."""
    share = F.lit(p).cast("decimal(10,6)") * n.cast("decimal(18,0)")
    return {
        "nearest": F.greatest(F.lit(0), F.ceil(share).cast("long") - 1),
        "floor": F.least(n - 1, F.floor(share).cast("long")),
        "half": F.floor(n / 2).cast("long"),
        "median_low": F.floor((n - 1) / 2).cast("long"),
    }[how]


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """n and, for each name, the value at the place that (definition, p) gives: nearest (rank up), floor (index down, capped), half, median_low, or median (mean of the middle two)."""
    group = list(by) or ["_one"]
    own = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), *([] if by else [F.lit(0).alias("_one")]))
    counted = own.groupBy(*group).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    held = ranked(own, group, ["_v"]).join(counted.select(*[F.col(g).alias(f"_g_{g}") for g in group], "n"), same)
    n, at = F.col("n"), lambda place: F.max(F.when(F.col("rank") == place, F.col("_v")))
    told = [((at(_index("median_low", p, n)) + at(_index("half", p, n))) / 2 if how == "median" else at(_index(how, p, n))).alias(name) for name, (how, p) in wanted.items()]
    return held.groupBy(*group).agg(F.max("n").alias("n"), *told).drop("_one")


def trust(offsets: DataFrame, by: list[str]) -> DataFrame:
    """How far a time field can be trusted: (by, offset_us, value), an offset from a reference and the field itself.

    n, distinct_ratio, sd_us (of the population), p50, p99 and max of the distance from the median offset, and verdict:
    HOLDS up to 100 us at p99, PARTIAL up to 1,000, FAILS beyond or where too few values differ.
    """
    middle = order_statistics(offsets, by, "offset_us", {"_middle": ("median", "0.5")}).drop("n")
    off = offsets.join(middle, by).withColumn("_off", F.abs(F.col("offset_us") - F.col("_middle")))
    told = order_statistics(off, by, "_off", {"p50_us": ("median", "0.5"), "p99_us": ("nearest", "0.99")}).drop("n")
    sums = off.groupBy(*by).agg(F.count("offset_us").alias("n"), F.count_distinct("value").alias("_values"), F.stddev_pop("offset_us").alias("sd_us"), F.max("_off").alias("max_us"))
    out = sums.join(told, by).withColumn("distinct_ratio", F.col("_values") / F.col("n"))
    verdict = F.when(F.col("distinct_ratio") < LEAST_DISTINCT, "FAILS").when(F.col("p99_us") <= HOLDS_US, "HOLDS").when(F.col("p99_us") <= PARTIAL_US, "PARTIAL").otherwise("FAILS")
    return out.select(*by, "n", "distinct_ratio", "sd_us", "p50_us", "p99_us", "max_us", verdict.alias("verdict"))


# -- calibration ----------------------------------------------------------------


def signal_statistics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Offset (low median of the gaps) and quantiles of the distance from it, for each signal and receiver's start; ``pairs``: by, up (start, end), down (start, end, handler)."""
    each = []
    for taken in STARTS:
        begun = F.col("down.start" if taken == "start" else "down.handler")
        gaps = {"start": begun - F.col("up.start"), "end": F.col("up.end") - F.col("down.end"), "duration": (F.col("up.end") - F.col("up.start")) - (F.col("down.end") - begun)}
        each += [F.struct(F.lit(taken).alias("receiver_start"), F.lit(i).alias("place"), F.lit(s).alias("signal"), gaps[s].cast("long").alias("gap")) for i, s in enumerate(SIGNALS)]
    told, group = pairs.select(*by, F.explode(F.array(*each)).alias("g")).select(*by, "g.*"), [*by, "receiver_start", "place", "signal"]
    offsets = order_statistics(told, group, "gap", {"offset_us": ("median_low", "0.5")}).drop("n")
    off = told.join(offsets, group).withColumn("_off", F.abs(F.col("gap") - F.col("offset_us")))
    quantiles = order_statistics(off, group, "_off", {"p50": ("floor", "0.5"), "p99": ("floor", "0.99"), "p999": ("floor", "0.999"), "most": ("floor", "1")})
    return offsets.join(quantiles, group)


def chosen_signals(statistics: DataFrame, by: list[str]) -> DataFrame:
    """The rule fixed beforehand: the quietest signal that locates a request comes first, the quietest other one is kept if at most three times as loud, and of the receiver's starts that with the quietest first signal counts.

    by, receiver_start, signal, rank (1, 2), offset_us, window_us, margin_us.
    """
    held = statistics.groupBy(*by, "receiver_start").agg(F.sort_array(F.collect_list(F.struct("p999", "place", "signal", "offset_us", "p99"))).alias("s"))  # three rows a group
    first = F.get(F.filter("s", lambda x: x["signal"].isin(*LOCATING)), F.lit(0))
    held = held.withColumn("a", first)
    held = held.withColumn("b", F.get(F.filter("s", lambda x: x["signal"] != F.col("a.signal")), F.lit(0)))
    best = held.groupBy(*by).agg(F.min_by(F.struct("receiver_start", "a", "b"), F.struct("a.p999", F.col("receiver_start") != "start")).alias("k"))
    kept = F.when(F.col("k.b.p999") <= 3 * F.col("k.a.p999"), F.array("k.a", "k.b")).otherwise(F.array("k.a"))
    return best.select(*by, "k.receiver_start", F.col("k.a.p99").alias("margin_us"), F.posexplode(kept).alias("i", "s")).select(*by, "receiver_start", "s.signal", (F.col("i") + 1).alias("rank"), "s.offset_us", F.greatest(F.lit(1).cast("long"), F.col("s.p999")).alias("window_us"), "margin_us")


def request_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Requests a second between the first start and the last end (microseconds); 0 where no time passes."""
    span = F.max("end") - F.min("start")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), span.alias("span_us")).withColumn("rate_per_s", F.when(F.col("span_us") > 0, F.col("n") / (F.col("span_us") / 1e6)).otherwise(F.lit(0.0)))


# -- scores -----------------------------------------------------------------------


def time_and_duration_candidates(left: DataFrame, right: DataFrame, by: list[str], window: int, most_off: Column) -> DataFrame:
    """Pairs (by, left_id, right_id, off) of events (by, id, t, duration) no further than ``window`` apart in time, whose durations differ by at most ``most_off`` (of the left duration, l.duration)."""
    width = 2 * window + 1
    low = F.floor((F.col("t") - window) / F.lit(width))
    l = left.withColumn("_b", F.explode(F.array(low, low + 1))).alias("l")  # noqa: E741
    r = right.withColumn("_b", F.floor(F.col("t") / F.lit(width))).alias("r")
    same = (F.col("l._b") == F.col("r._b")) & (F.abs(F.col("l.t") - F.col("r.t")) <= window)
    for c in by:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    off = F.abs(F.col("l.duration") - F.col("r.duration"))
    return l.join(r, same).filter(off <= most_off).select(*[F.col(f"l.{c}") for c in by], F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), off.alias("off"))


def correlator_score(candidates: DataFrame, decided: DataFrame, truth: DataFrame, lefts: DataFrame) -> DataFrame:
    """R (the true partner is among the candidates) and T (it was chosen) of all left records, and what became of the others.

    ``candidates``: left, right; ``decided``: left, status, right; ``truth``: left, right, one row each; ``lefts``: left.
    """
    real = truth.select("left", F.col("right").alias("_real"))
    recalled = candidates.join(real, (candidates["left"] == real["left"]) & (candidates["right"] == F.col("_real")), "left_semi").select("left").distinct().withColumn("_recalled", F.lit(True))
    some = candidates.select("left").distinct().withColumn("_some", F.lit(True))
    told = decided.select("left", "status", F.col("right").alias("_told"))
    every = lefts.select("left").distinct().join(real, "left", "left").join(recalled, "left", "left").join(some, "left", "left").join(told, "left", "left")
    matched = F.coalesce(F.col("status") == "MATCHED", F.lit(False))
    right = matched & (F.col("_told") == F.col("_real"))
    out = every.agg(
        F.count("*").alias("total"), F.count_if("_recalled").alias("recalled"), F.count_if(right).alias("correct"), F.count_if(matched & ~F.col("_told").eqNullSafe(F.col("_real"))).alias("wrong"),
        F.count_if(F.col("status") == "AMBIGUOUS").alias("ambiguous"), F.count_if(F.col("status") == "OVERSIZED").alias("oversized"), F.count_if(F.col("_some").isNull()).alias("no_candidate"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumns({"r": share("recalled"), "t": share("correct")})


def join_score(links: DataFrame, seen: DataFrame, ends: DataFrame) -> DataFrame:
    """By place: links, correct, wrong, lost (keyed on both ends and not linked rightly), keyless, both_seen.

    ``links``: place, up_truth, down_truth; ``seen``: point, side, truth, keyed; ``ends``: place, up_point, up_side, down_point, down_side.
    """
    own = seen.filter("truth is not null").groupBy("point", "side", "truth").agg(F.max("keyed").alias("keyed"))
    sides = []
    for e in ("up", "down"):
        at = ends.select("place", F.col(f"{e}_point").alias("point"), F.col(f"{e}_side").alias("side"))
        sides.append(own.join(at, ["point", "side"]).select("place", "truth", F.col("keyed").alias(e)))
    both = sides[0].join(sides[1], ["place", "truth"])
    right = links.filter("up_truth = down_truth").select("place", F.col("up_truth").alias("truth"), F.lit(True).alias("_linked")).distinct()
    met = both.join(right, ["place", "truth"], "left")
    keyed = F.col("up") & F.col("down")
    told = met.groupBy("place").agg(F.count("*").alias("both_seen"), F.count_if(~keyed).alias("keyless"), F.count_if(keyed & F.col("_linked").isNull()).alias("lost"))
    made = links.groupBy("place").agg(F.count("*").alias("links"), F.count_if(F.col("up_truth") == F.col("down_truth")).alias("correct"))
    out = told.join(made, "place", "full").na.fill(0, ["both_seen", "keyless", "lost", "links", "correct"])
    return out.withColumn("wrong", F.col("links") - F.col("correct"))


def timing_score(decided: DataFrame, sizes: DataFrame, rate_per_s: float, window_us: int, most_density: float = 1.0) -> DataFrame:
    """One row: what a timed join's upper side came to, and the sizes of its components.

    ``decided``: side, status, right (whether a partner is the true one); ``sizes``: size, one row for each component.
    ``density`` is how many requests fall into a window at this rate; over ``most_density`` the join isn't feasible.
    """
    up = decided.filter("side = 'outbound'")
    names = ("AMBIGUOUS", "UNMATCHED", "OVERSIZED", "NO_CANDIDATE", "DENSE")
    told = up.agg(F.count_if(F.col("status") == "MATCHED").alias("links"), F.count_if((F.col("status") == "MATCHED") & F.col("right")).alias("correct"), *[F.count_if(F.col("status") == n).alias(n.lower()) for n in names])
    held = order_statistics(sizes, [], "size", {"component_p50": ("half", "0.5"), "component_p99": ("floor", "0.99"), "component_max": ("floor", "1")}).drop("n")
    density = rate_per_s * 2 * window_us / 1e6
    out = told.join(F.broadcast(held), F.lit(True), "left").na.fill(0)  # one row joins one
    return out.withColumn("wrong", F.col("links") - F.col("correct")).withColumns({"density": F.lit(round(density, 3)), "feasible": F.lit(density <= most_density)})


def replay_score(finals: DataFrame, truth: DataFrame) -> DataFrame:
    """By place, what final decisions (place, source, seq, kind, partners) are worth: ``truth`` has source, seq and the id of what they saw."""
    own = finals.join(truth.withColumnRenamed("truth", "_own"), ["source", "seq"], "left")
    mate = truth.select(F.struct("source", "seq").alias("_p"), F.col("truth").alias("_other"))
    own = own.withColumn("_p", F.get("partners", F.lit(0))).join(mate, "_p", "left")
    linked = F.col("kind") == "LINKED"
    return own.groupBy("place").agg(F.count("*").alias("decisions"), F.count_if(linked).alias("linked"), F.count_if(linked & F.col("_own").isNotNull() & (F.col("_own") == F.col("_other"))).alias("correct"), F.count_if(linked & ~F.col("_own").eqNullSafe(F.col("_other"))).alias("wrong"), F.count_if(~linked).alias("undecided"))


# -- processor load --------------------------------------------------------------


def saturation(cores: DataFrame, busy: float = 95.0) -> DataFrame:
    """second, the busiest core's share and whether it counts as saturated; ``cores``: second, core, busy."""
    return cores.groupBy("second").agg(F.max("busy").alias("busiest")).withColumn("saturated", F.col("busiest") >= busy)


def foreign_load(processes: DataFrame, seconds: Column, own: list[str], declared: str) -> DataFrame:
    """process, mean share of a core over all seconds, and whose it is: own, declared or foreign; ``processes``: second, process, cpu."""
    whose = F.when(F.col("process").isin(*own), "own").when(F.col("process") == declared, "declared").otherwise("foreign")
    return processes.groupBy("process").agg((F.sum("cpu") / F.greatest(seconds, F.lit(1)) / 100).alias("cores")).withColumn("whose", whose)


def top(df: DataFrame, value: str, name: str, n: int = 6) -> DataFrame:
    """The ``n`` largest, equal ones by name."""
    return df.orderBy(F.desc(value), name).limit(n)


def missing_positions(expected: DataFrame, seen: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` places, in ``order``, of expected ids that nothing has seen."""
    placed_ = ranked(expected.withColumn("_one", F.lit(0)), ["_one"], order)
    return placed_.join(seen.select("id").distinct(), "id", "left_anti").select(F.col("rank").alias("position"), "id").orderBy("position").limit(n)
