"""Two sides of records matched by declared, ordered rules; every unmatched left record gets its reasons.

Records: id, account, amount DECIMAL(18,2), value_date, reference, currency. A
block is an account and a currency, null being a currency of its own. Rules run
in order, each on what is still free; within a rule candidates are taken by
score, then left id, then right ids, none of whose records is taken.

Greedy taking is done in rounds: a candidate that is first for its left and for
each of its rights is taken, what it touches leaves, and so on; with a total
order this equals the sequence. Candidates that only ids can tell apart (equal
references; equal amount and date) are paired rank by rank at once, so equal
records don't take a round each.

The subset sums of M3 and the pairwise reasons stay within blocks of at most
``max_block_candidates`` right records; larger blocks are told as too large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.digests import UNIT, digest, digest_text, short_hash
from tallyloom.operators.ranking import ranked
from tallyloom.session import cut

# Names and order of rules and reasons, base scores and penalties.
RULES = ["M0_REFERENCE", "M1_EXACT", "M2_TOLERANT", "M3_AGGREGATE"]
BASES = {"M0_REFERENCE": "1.0", "M1_EXACT": "0.9", "M2_TOLERANT": "0.8", "M3_AGGREGATE": "0.6"}
AMOUNT_PENALTY, DATE_PENALTY, SIZE_PENALTY = "0.05", "0.05", "0.01"
REASONS = ["NO_CANDIDATE", "AMOUNT_OUT_OF_TOLERANCE", "DATE_OUT_OF_WINDOW", "AGGREGATE_NOT_FOUND", "LOST_TO_BETTER_CANDIDATE", "BLOCK_TOO_LARGE"]

_CANDIDATE = ["account", "currency", "left_id", "right_ids", "rule", "score", "amount_residual", "date_gap_days"]


@dataclass(frozen=True)
class Tolerance:
    amount_abs: Decimal = Decimal("0.00")
    amount_rel: Decimal = Decimal("0")
    date_days: int = 0
    max_aggregate_size: int = 3
    max_block_candidates: int = 32

    def ruleset_id(self) -> str:
        own = [self.amount_abs, self.amount_rel, self.date_days, self.max_aggregate_size, self.max_block_candidates]
        return short_hash("|".join([*RULES, *map(str, own)]))

    def limit(self, amount: Column) -> Column:
        return (F.lit(self.amount_abs).cast("decimal(18,6)") + F.abs(amount) * F.lit(self.amount_rel).cast("decimal(9,6)")).cast("decimal(18,6)")


def score(rule: str, residual: Column, limit: Column, gap: Column, tol: Tolerance, size: int = 1) -> Column:
    """Base less penalties for residual, date gap and size, to six places, half to even."""
    d = lambda text: F.lit(Decimal(text))
    out = d(BASES[rule])
    part = F.abs(residual).cast("decimal(18,6)") / limit * d(AMOUNT_PENALTY)
    out = out - F.when(limit > 0, part).otherwise(F.lit(Decimal(0)))
    if tol.date_days:
        out = out - gap.cast("decimal(18,6)") / F.lit(tol.date_days).cast("decimal(18,6)") * d(DATE_PENALTY)
    return F.bround(out - F.lit(Decimal(size - 1)) * d(SIZE_PENALTY), 6).cast("decimal(9,6)")


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.alias("l"), right.alias("r")


def _block() -> Column:
    return (F.col("l.account") == F.col("r.account")) & F.col("l.currency").eqNullSafe(F.col("r.currency"))


def _gap() -> Column:
    return F.abs(F.datediff("l.value_date", "r.value_date"))


def _residual() -> Column:
    return F.col("l.amount") - F.col("r.amount")


def _candidate(joined: DataFrame, rule: str, points: Column, residual: Column, gap: Column, rights: Column | None = None) -> DataFrame:
    rights = F.array("r.id") if rights is None else rights
    return joined.select("l.account", "l.currency", F.col("l.id").alias("left_id"), rights.alias("right_ids"), F.lit(rule).alias("rule"), points.alias("score"), residual.cast("decimal(18,2)").alias("amount_residual"), gap.alias("date_gap_days"))


def by_reference(left: DataFrame, right: DataFrame, tol: Tolerance) -> DataFrame:
    """M0: equal, non-empty reference in the block; amount and date don't matter."""
    l, r = _sides(left.filter("reference <> ''"), right.filter("reference <> ''"))  # noqa: E741
    return _candidate(l.join(r, _block() & (F.col("l.reference") == F.col("r.reference"))), RULES[0], F.lit(Decimal("1.000000")).cast("decimal(9,6)"), _residual(), _gap())


def exact(left: DataFrame, right: DataFrame, tol: Tolerance) -> DataFrame:
    """M1: equal amount, date within the window."""
    zero = F.lit(Decimal("0.00"))
    return _candidate(_near(left, right, tol, F.col("l.amount") == F.col("r.amount")), RULES[1], score(RULES[1], zero, F.lit(Decimal("0.000000")), _gap(), tol), zero, _gap())


def _near(left: DataFrame, right: DataFrame, tol: Tolerance, same: Column | None = None) -> DataFrame:
    """Pairs of a block within the date window, met in buckets of the date, so a large block isn't compared whole."""
    width = tol.date_days + 1
    bucket = F.floor(F.unix_date("value_date") / F.lit(width))
    l = left.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))  # noqa: E741
    l, r = _sides(l, right.withColumn("_b", bucket))  # noqa: E741
    where = _block() & (F.col("l._b") == F.col("r._b")) & (_gap() <= tol.date_days)
    return l.join(r, where if same is None else where & same)


def tolerant(left: DataFrame, right: DataFrame, tol: Tolerance) -> DataFrame:
    """M2: amount within the left record's tolerance, date within the window."""
    limit = tol.limit(F.col("l.amount"))
    pairs = _near(left, right, tol).filter(F.abs(_residual()) <= limit)
    return _candidate(pairs, RULES[2], score(RULES[2], _residual(), limit, _gap(), tol), _residual(), _gap())


def aggregate(left: DataFrame, right: DataFrame, tol: Tolerance) -> DataFrame:
    """M3: 2 to ``max_aggregate_size`` right records in the window that sum to the left amount within its tolerance.

    ``right`` must hold blocks within ``max_block_candidates`` only; sets grow in the order of their ids.
    """
    one = _near(left, right, tol).select("l.account", "l.currency", F.col("l.id").alias("left_id"), F.col("l.amount").alias("want"), F.col("r.id").alias("rid"), F.col("r.amount").alias("got"), _gap().alias("gap"))
    grown = one.select("account", "currency", "left_id", "want", F.array("rid").alias("right_ids"), F.col("got").alias("total"), F.col("gap").alias("far"))
    found = []
    for size in range(2, tol.max_aggregate_size + 1):
        more = one.select(F.col("left_id").alias("_left"), "rid", "got", "gap")
        grown = grown.join(more, (F.col("left_id") == F.col("_left")) & (F.element_at("right_ids", -1) < F.col("rid"))).select(
            "account", "currency", "left_id", "want", F.concat("right_ids", F.array("rid")).alias("right_ids"), (F.col("total") + F.col("got")).cast("decimal(18,2)").alias("total"), F.greatest("far", "gap").alias("far")
        )
        limit, residual = tol.limit(F.col("want")), F.col("want") - F.col("total")
        found.append(
            grown.filter(F.abs(residual) <= limit).select("account", "currency", "left_id", "right_ids", F.lit(RULES[3]).alias("rule"), score(RULES[3], residual, limit, F.col("far"), tol, size).alias("score"), residual.cast("decimal(18,2)").alias("amount_residual"), F.col("far").alias("date_gap_days"))
        )
    return reduce(DataFrame.unionByName, found) if found else by_reference(left, right, tol).filter(F.lit(False))


GENERATORS = {"M0_REFERENCE": by_reference, "M1_EXACT": exact, "M2_TOLERANT": tolerant, "M3_AGGREGATE": aggregate}


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy taking of sorted candidates held by one task."""
    used_left: set[str] = set()
    used_right: set[str] = set()
    for pdf in batches:
        kept = []
        for left, rights in zip(pdf["left_id"], pdf["right_ids"]):
            won = left not in used_left and used_right.isdisjoint(rights)
            if won:
                used_left.add(left)
                used_right.update(rights)
            kept.append(won)
        yield pdf[kept]


def take(candidates: DataFrame, few: int = 200_000) -> DataFrame:
    """The candidates that greedy taking in the order score, left id, right ids accepts, by rounds of dominance; the last ``few`` are taken by one task in their order."""
    rest = cut(candidates.withColumn("_key", F.struct((-F.col("score")).alias("s"), "left_id", "right_ids")))
    taken: list[DataFrame] = []
    while (n := rest.count()) > 0:
        if n <= few:
            taken.append(rest.repartition(1).sortWithinPartitions("_key").drop("_key").mapInPandas(_in_order, candidates.schema).withColumn("_key", F.lit(None)))
            break
        best_left = rest.groupBy("left_id").agg(F.min("_key").alias("_best"))
        touched = rest.select("left_id", "_key", F.explode("right_ids").alias("right_id"))
        best_right = touched.groupBy("right_id").agg(F.min("_key").alias("_first"))
        first = rest.join(best_left, "left_id").filter("_key = _best").drop("_best")
        agreed = first.select("_key", F.explode("right_ids").alias("right_id")).join(best_right, "right_id").groupBy("_key").agg(F.bool_and(F.col("_key") == F.col("_first")).alias("_ok")).filter("_ok").select("_key")
        won = cut(first.join(agreed, "_key", "left_semi").select(*rest.columns))
        taken.append(won)
        gone_right = won.select(F.explode("right_ids").alias("right_id"))
        lost = touched.join(gone_right, "right_id", "left_semi").select("_key").distinct()
        rest = cut(rest.join(won.select("left_id"), "left_id", "left_anti").join(lost, "_key", "left_anti").select(*rest.columns))
    return reduce(DataFrame.unionByName, taken).drop("_key") if taken else candidates.limit(0)


def zipped(left: DataFrame, right: DataFrame, by: list[str], rule: str, tol: Tolerance, filled: str | None = None) -> DataFrame:
    """Records that agree in ``by``, paired in the order of their ids: what greedy taking does where only ids tell candidates apart."""
    if filled:
        left, right = left.filter(F.col(filled) != ""), right.filter(F.col(filled) != "")
    sides = [ranked(s, ["account", "currency", *by], ["id"]) for s in (left, right)]
    l, r = _sides(*sides)  # noqa: E741
    same = _block() & (F.col("l.rank") == F.col("r.rank"))
    for c in by:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    points = F.lit(Decimal(BASES[rule])).cast("decimal(9,6)")
    return _candidate(l.join(r, same), rule, points, _residual(), _gap())


@dataclass
class Outcome:
    matches: DataFrame
    rejects: DataFrame
    counters: DataFrame
    ruleset_id: str

    def fingerprints(self) -> DataFrame:
        """One for each decision; a match's residual is text as told, that of an exact match is 0."""
        residual = F.when(F.col("rule") == "M1_EXACT", F.lit("0")).otherwise(F.col("amount_residual").cast("string"))
        m = self.matches.select("left_id", digest(F.lit("MATCH"), F.col("left_id"), F.array_join("right_ids", ","), F.col("rule"), residual).alias("fingerprint"))
        return m.unionByName(self.rejects.select("left_id", digest(F.lit("BREAK"), F.col("left_id"), F.col("right_id"), F.col("reason")).alias("fingerprint")))

    def result_hash(self) -> str:
        """Hash of all decisions, whatever their order: that of their sorted fingerprints, from a size on of the hashes of those that begin alike, and so on."""
        rows = cut(self.fingerprints().select("fingerprint"))
        n, depth = rows.count(), 0
        while n > 10_000 * 16**depth:
            depth += 1
        while depth > 0:  # groups of some thousand
            alike = F.substring("fingerprint", 1, depth)
            rows = rows.groupBy(alike.alias("p")).agg(F.array_join(F.sort_array(F.collect_list("fingerprint")), UNIT).alias("all")).select(F.concat("p", F.sha2("all", 256)).alias("fingerprint"))
            depth -= 3
        return digest_text(self.ruleset_id, *sorted(r[0] for r in rows.collect()))


def _sized(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The left records with their block's number of right records, and the right records with it."""
    n = right.groupBy("account", "currency").agg(F.count("*").alias("n_right")).select(F.col("account").alias("_a"), F.col("currency").alias("_c"), "n_right")
    same = (F.col("account") == F.col("_a")) & F.col("currency").eqNullSafe(F.col("_c"))
    return tuple(s.join(n, same, "left").withColumn("n_right", F.coalesce("n_right", F.lit(0))).drop("_a", "_c") for s in (left, right))


def reconcile(left: DataFrame, right: DataFrame, tol: Tolerance | None = None, more: dict[str, Callable[[DataFrame, DataFrame, Tolerance], DataFrame]] | None = None) -> Outcome:
    """Matches, rejects (one reason for each pair of an unmatched left record and its block, or for the record) and counters.

    ``more`` has rules of the caller's own by name, which run after the others on what they leave: each gives the
    candidates (account, currency, left_id, right_ids, rule, score, amount_residual, date_gap_days) of free records.
    """
    tol = tol or Tolerance()
    columns = ["id", "account", "amount", "value_date", "reference", "currency"]
    left, right = (s.select(*columns) for s in (left, right))
    free_left, free_right = (cut(s) for s in _sized(left, right))
    all_left, all_right = free_left, free_right
    taken, evaluated = [], []
    generators = GENERATORS | (more or {})
    for rule in [*RULES, *[r for r in more or {} if r not in RULES]]:
        l, r = free_left, free_right  # noqa: E741
        if rule == "M3_AGGREGATE":
            l, r = (s.filter(F.col("n_right") <= tol.max_block_candidates) for s in (l, r))  # noqa: E741
            if tol.max_aggregate_size < 2:
                continue
        candidates = generators[rule](l, r, tol)
        if generators[rule] in (by_reference, exact):
            by = ["reference"] if rule == "M0_REFERENCE" else ["amount", "value_date"]
            evaluated.append(_pair_count(l, r, rule, tol))
            won = cut(zipped(l, r, by, rule, tol, "reference" if rule == "M0_REFERENCE" else None))
            if rule == "M1_EXACT" and tol.date_days:
                l, r = _without(l, r, won)  # noqa: E741
                won = won.unionByName(take(exact(l, r, tol).filter("date_gap_days > 0")))
        else:
            candidates = cut(candidates)
            evaluated.append(candidates.agg(F.count("*").alias("n")))
            won = take(candidates)
        won = cut(won.select(*_CANDIDATE))
        taken.append(won)
        free_left, free_right = (cut(s) for s in _without(free_left, free_right, won))
    matches = reduce(DataFrame.unionByName, taken)
    rejects = audit(free_left, all_right, free_right, tol)
    counters = _counters(all_left, all_right, matches, free_left, free_right, evaluated, tol)
    return Outcome(matches, rejects, counters, tol.ruleset_id())


def _pair_count(left: DataFrame, right: DataFrame, rule: str, tol: Tolerance) -> DataFrame:
    """How many candidates M0 or M1 has, without making them: counts of equal keys multiplied."""
    by = ["account", "currency", "reference"] if rule == "M0_REFERENCE" else ["account", "currency", "amount", "value_date"]
    sides = [s.filter("reference <> ''") if rule == "M0_REFERENCE" else s for s in (left, right)]
    l, r = (s.groupBy(*by).agg(F.count("*").alias("n")).alias(a) for s, a in zip(sides, "lr"))  # noqa: E741
    same = _block() & (F.col("l.reference") == F.col("r.reference") if rule == "M0_REFERENCE" else (F.col("l.amount") == F.col("r.amount")) & (_gap() <= tol.date_days))
    return l.join(r, same).agg(F.coalesce(F.sum(F.col("l.n") * F.col("r.n")), F.lit(0)).alias("n"))


def _without(left: DataFrame, right: DataFrame, won: DataFrame) -> tuple[DataFrame, DataFrame]:
    rights = won.select(F.explode("right_ids").alias("id"))
    return left.join(won.select(F.col("left_id").alias("id")), "id", "left_anti"), right.join(rights, "id", "left_anti")


def audit(unmatched: DataFrame, rights: DataFrame, free: DataFrame, tol: Tolerance) -> DataFrame:
    """left_id, right_id, reason. A taken right record is told as lost before its date is looked at."""
    alone = unmatched.select(F.col("id").alias("left_id"), F.lit(None).cast("string").alias("right_id"), F.when(F.col("n_right") == 0, "NO_CANDIDATE").when(F.col("n_right") > tol.max_block_candidates, "BLOCK_TOO_LARGE").alias("reason")).filter("reason is not null")
    small = F.col("n_right").between(1, tol.max_block_candidates)
    marked = rights.filter(small).join(free.select(F.col("id").alias("_free")), F.col("id") == F.col("_free"), "left")
    l, r = _sides(unmatched.filter(small), marked)  # noqa: E741
    pairs = l.join(r, _block())
    reason = F.when(F.col("r._free").isNull(), "LOST_TO_BETTER_CANDIDATE").when(_gap() > tol.date_days, "DATE_OUT_OF_WINDOW").when(F.abs(_residual()) > tol.limit(F.col("l.amount")), "AMOUNT_OUT_OF_TOLERANCE")
    each = pairs.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), reason.alias("reason"), (F.col("r._free").isNotNull() & (_gap() <= tol.date_days)).alias("near"))
    out = alone.unionByName(each.filter("reason is not null").drop("near"))
    if tol.max_aggregate_size >= 2:
        several = each.groupBy("left_id").agg(F.count_if("near").alias("n")).filter("n >= 2")
        out = out.unionByName(several.select("left_id", F.lit(None).cast("string").alias("right_id"), F.lit("AGGREGATE_NOT_FOUND").alias("reason")))
    return out


def _counters(left: DataFrame, right: DataFrame, matches: DataFrame, unmatched: DataFrame, free: DataFrame, evaluated: list[DataFrame], tol: Tolerance) -> DataFrame:
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "value")
    blocks = left.select("account", "currency").union(right.select("account", "currency")).distinct()
    parts = [one("records_left", left), one("records_right", right), one("blocks", blocks), one("unmatched_left", unmatched), one("unmatched_right", free)]
    parts.append(reduce(DataFrame.union, evaluated).agg(F.sum("n").alias("value")).select(F.lit("candidates_evaluated").alias("counter"), "value"))
    parts.append(matches.groupBy(F.concat(F.lit("matched_"), "rule").alias("counter")).agg(F.count("*").alias("value")))
    parts.append(one("manual_review", unmatched.filter(F.col("n_right") > tol.max_block_candidates)))
    return reduce(DataFrame.union, parts).filter("value > 0 or counter in ('records_left', 'records_right', 'blocks')")
