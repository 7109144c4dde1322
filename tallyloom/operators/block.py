"""Matching of the records of one small block in plain Python: what a stream's fold evaluates again and again.

The same rules as ``matching``, for a few open records at a time; the two are
tested against one another. Records are dicts with id, amount (Decimal),
value_date and reference.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal
from itertools import combinations

from tallyloom.operators.matching import AMOUNT_PENALTY, BASES, DATE_PENALTY, REASONS, RULES, SIZE_PENALTY, Tolerance

_SIX = Decimal("0.000001")


def days_apart(a: dict, b: dict) -> int:
    return abs((a["value_date"] - b["value_date"]).days)


def limit_of(amount: Decimal, tol: Tolerance) -> Decimal:
    return tol.amount_abs + abs(amount) * tol.amount_rel


def points(rule: str, residual: Decimal, limit: Decimal, gap: int, tol: Tolerance, size: int) -> Decimal:
    if rule == "M0_REFERENCE":
        return Decimal("1.0")
    out = Decimal(BASES[rule]) - (size - 1) * Decimal(SIZE_PENALTY)
    if limit and rule != "M1_EXACT":
        out -= abs(residual) / limit * Decimal(AMOUNT_PENALTY)
    if tol.date_days:
        out -= Decimal(gap) / tol.date_days * Decimal(DATE_PENALTY)
    return out.quantize(_SIX, ROUND_HALF_EVEN)


def _fits(rule: str, left: dict, rights: tuple, residual: Decimal, limit: Decimal, gap: int, tol: Tolerance) -> bool:
    if rule == "M0_REFERENCE":
        return bool(left["reference"]) and left["reference"] == rights[0]["reference"]
    bound = Decimal(0) if rule == "M1_EXACT" else limit
    return gap <= tol.date_days and abs(residual) <= bound


def evaluate(lefts: list[dict], rights: list[dict], tol: Tolerance, in_block: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """Matches (left id, right ids, rule, score, residual, gap) and rejects (left id, right id or None, reason).

    ``in_block`` is the number of right records of the whole block where these are only a part of it.
    """
    in_block = len(rights) if in_block is None else in_block
    lefts, rights = sorted(lefts, key=lambda r: r["id"]), sorted(rights, key=lambda r: r["id"])
    large = in_block > tol.max_block_candidates
    used_left: set[str] = set()
    used_right: set[str] = set()
    matches: list[tuple] = []
    for rule in RULES:
        if rule == "M3_AGGREGATE" and large:
            continue
        sizes = range(2, tol.max_aggregate_size + 1) if rule == "M3_AGGREGATE" else (1,)
        free = [r for r in rights if r["id"] not in used_right]
        found = []
        for left in lefts:
            if left["id"] in used_left:
                continue
            limit = limit_of(left["amount"], tol)
            near = free if rule == "M0_REFERENCE" else [r for r in free if days_apart(left, r) <= tol.date_days]
            for size in sizes:
                for some in combinations(near, size):
                    residual = left["amount"] - sum((r["amount"] for r in some), Decimal(0))
                    gap = max(days_apart(left, r) for r in some)
                    if _fits(rule, left, some, residual, limit, gap, tol):
                        residual = Decimal(0) if rule == "M1_EXACT" else residual
                        found.append((-points(rule, residual, limit, gap, tol, size), left["id"], tuple(r["id"] for r in some), residual, gap))
        for score, left_id, right_ids, residual, gap in sorted(found):
            if left_id not in used_left and used_right.isdisjoint(right_ids):
                used_left.add(left_id)
                used_right.update(right_ids)
                matches.append((left_id, right_ids, rule, -score, residual, gap))
    rejects: list[tuple] = []
    for left in lefts:
        if left["id"] in used_left:
            continue
        if not in_block or large:
            rejects.append((left["id"], None, "BLOCK_TOO_LARGE" if in_block else "NO_CANDIDATE"))
            continue
        near = 0
        for r in rights:
            if r["id"] in used_right:
                rejects.append((left["id"], r["id"], "LOST_TO_BETTER_CANDIDATE"))
            elif days_apart(left, r) > tol.date_days:
                rejects.append((left["id"], r["id"], "DATE_OUT_OF_WINDOW"))
            else:
                near += 1
                rejects.append((left["id"], r["id"], "AMOUNT_OUT_OF_TOLERANCE"))
        if near >= 2 and tol.max_aggregate_size >= 2:
            rejects.append((left["id"], None, "AGGREGATE_NOT_FOUND"))
    return matches, rejects


def reason_text(reasons: set[str]) -> str:
    return "+".join(sorted(reasons, key=REASONS.index)) if reasons else "NO_CANDIDATE"
