"""Scores of texts for abusive, hateful and sexually explicit language, by a chain of linear classifiers.

Texts are cut into sentences, quoted parts included, and each sentence is
brought into plain form: markup, quote marks, invisible and look-alike letters,
digits that stand for letters, letters set apart and letters drawn out are
undone. Its features are hashed n-grams of bytes with and without the spaces,
so letters of all scripts count; disguises are undone of Latin letters only.

The classifiers form a chain: abuse, hate, sexual, any. Each later linear model
also takes the probabilities of the earlier ones; in training these are
out-of-fold predictions, so that a later model sees them as good or bad as they
will be on new texts. A document's scores are the greatest of its sentences.

Labelled rows are used up to ``most_samples``, those with the least hash of the
text first. Rows of kind 'offensive' teach the last model only, as their kind
isn't known. Terms of the starting list are samples of their categories.

Defined results: null and empty texts have no sentence and score 0; labels of
language are not used; samples without text or category teach nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import MARKS, plain, unquoted_marks

STAGES = ("abuse", "hate", "sexual", "any")
SIZE = 1 << 17
SPACED, CLOSED = (3, 5), (4, 6)
THRESHOLD = 0.03  # three times the prior
LONG = 600  # letters of a sentence that are looked at at once
TERM_WEIGHT = 1.0
UNKNOWN_KIND_WEIGHT = 3.0  # these are mostly of the languages that have few samples

_LEET = str.maketrans("@4310$57", "aaeiosst")
_TOKEN = re.compile(r"(?<!\S)[a-z]*+[^a-z\s]\S*+")  # a token with anything but plain letters in it
_APART = re.compile(r"(?<![a-z0-9])(?:[a-z0-9@$][ \-_.*·]{1,2}){3,}[a-z0-9@$](?![a-z0-9])")
_DRAWN = re.compile(r"([a-z])\1{2,}")
_MASK = re.compile(r"(?<=[a-z0-9])[_*](?=[a-z0-9])")
_NUMBER = re.compile(r"[\d.,:%]+$")
_OTHER = re.compile(rf"(?:[^a-z0# \u0080-\U0010ffff]|[^\w\x00-\x7f{MARKS}])+")  # letters of all scripts stay
_END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|\n\s*\n|\n(?=\s*[-*•] )")
_BREAK = re.compile(r"\s*\n\s*")


def _closed(m: re.Match) -> str:
    return re.sub(r"[ \-_.*·]", "", m.group())


def _letters(m: re.Match) -> str:
    token = m.group()
    if token.isalpha():
        return token
    if _NUMBER.match(token):
        return "0"
    return token.translate(_LEET) if any(c.isalpha() for c in token) else token


@lru_cache(maxsize=50_000)
def _normal(sentence: str) -> str:
    s = _APART.sub(_closed, sentence.casefold())
    s = _TOKEN.sub(_letters, _MASK.sub("#", s))
    return " ".join(_OTHER.sub(" ", _DRAWN.sub(r"\1", s)).split())


def normal(sentence: str) -> str:
    """A plain sentence as lower-case words, with disguises of letters undone. Short ones are remembered, as texts are quoted and posted again."""
    return _normal(sentence) if len(sentence) <= LONG else _normal.__wrapped__(sentence)


def sentences(text: str | None) -> list[str]:
    if not text:
        return []
    out = []
    for part in _END.split(unquoted_marks(plain(text))):
        own = normal(_BREAK.sub(" ", part))
        if len(own) <= LONG:
            out += [own] if own else []
        else:  # overlapping pieces
            out += [own[i : i + LONG] for i in range(0, len(own) - LONG // 2, LONG // 2)]
    return out


def _features(rows: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: features by place, whether the place begins an n-gram of one row, the rows' first places."""
    if not rows:
        return
    spaced = np.frombuffer("".join(f" {r} \n" for r in rows).encode(), np.uint8)
    for letters, sizes in ((spaced, SPACED), (spaced[spaced != 32], CLOSED)):
        ends = np.flatnonzero(letters == 10)
        starts = np.r_[0, ends[:-1] + 1]
        left = np.repeat(ends, np.diff(np.r_[starts, len(letters)])) - np.arange(len(letters))
        wide = np.r_[letters.astype(np.uint64), np.zeros(8, np.uint64)]
        for n in sizes:
            h = np.full(len(letters), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + wide[j : j + len(letters)]
            h ^= h >> np.uint64(29)
            yield ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(47)).astype(np.int64), left >= n, starts


def _sparse(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all features; a row's values are its n-grams' counts over the root of their number."""
    r, f = [], []
    for feature, begins, starts in _features(rows):
        row = np.searchsorted(starts, np.arange(len(feature)), side="right") - 1
        r.append(row[begins])
        f.append(feature[begins])
    row, feature = np.concatenate(r), np.concatenate(f)
    key, counts = np.unique(row * SIZE + feature, return_counts=True)
    row, feature = key // SIZE, key % SIZE
    total = np.bincount(row, weights=counts, minlength=len(rows))
    return row, feature, counts / np.sqrt(np.maximum(total, 1))[row]


@dataclass
class Chain:
    weights: np.ndarray  # SIZE x stages
    bias: np.ndarray
    chained: np.ndarray  # what stage i (row) takes from the probability of stage j (column)

    def scores(self, rows: list[str]) -> np.ndarray:
        """Probabilities of the stages for normal sentences."""
        return np.concatenate([np.zeros((0, len(STAGES))), *(self._scores(rows[i : i + 2_000]) for i in range(0, len(rows), 2_000))])

    def _scores(self, rows: list[str]) -> np.ndarray:
        sums, counts = np.zeros((len(rows), len(STAGES))), np.zeros(len(rows))
        for feature, begins, starts in _features(rows):
            gained = self.weights[feature] * begins[:, None]
            sums += np.add.reduceat(gained, starts, axis=0)
            counts += np.add.reduceat(begins.astype(np.int64), starts)
        base = sums / np.sqrt(np.maximum(counts, 1))[:, None] + self.bias
        p = np.zeros_like(base)
        for i in range(len(STAGES)):
            p[:, i] = _sigmoid(base[:, i] + p[:, :i] @ self.chained[i, :i])
        return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: np.ndarray, base: float) -> np.ndarray:
    """Weighted logistic regression with a ridge for each column and a given intercept, by Newton's method."""

    def loss(b: np.ndarray) -> float:
        x = z @ b + base
        return float((w * (np.logaddexp(0, x) - y * x)).sum() + 0.5 * (ridge * b * b).sum())

    b = np.zeros(z.shape[1])
    now = loss(b)
    for _ in range(40):
        p = _sigmoid(z @ b + base)
        gradient = z.T @ (w * (p - y)) + ridge * b
        curve = (z * (w * p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(curve + np.diag(ridge), gradient)
        size = 1.0
        while (then := loss(b - size * step)) > now and size > 1e-4:
            size /= 2
        b -= size * step
        if now - then < 1e-7 * max(1.0, now):
            break
        now = then
    return b


def fit(samples: list[tuple[str, str]], terms: list[tuple[str, str]], most_samples: int = 3_000, ridge: float = 0.05, folds: int = 5, prior: float = 0.01) -> Chain:
    """The chain from labelled texts (text, category) and a starting list (term, category).

    ``prior`` is the probability of a sentence of which nothing is known; samples hold far more abuse than a corpus does.
    """
    samples = sorted(samples, key=lambda s: (zlib.crc32(s[0].encode()), s))[:most_samples]
    rows, labels, weight = [], [], []
    for (text, category), w in [*((s, 1.0) for s in samples), *((t, TERM_WEIGHT) for t in sorted(terms))]:
        if own := " ".join(sentences(text)):
            rows.append(own)
            labels.append(category)
            weight.append(w * (UNKNOWN_KIND_WEIGHT if category == "offensive" else 1))
    n = len(rows)
    row, feature, value = _sparse(rows)
    gram = np.zeros((n, n))
    for low in range(0, SIZE, 4096):  # in blocks of features, to hold few of them at a time
        some = (feature >= low) & (feature < low + 4096)
        block = np.zeros((n, 4096), np.float32)
        block[row[some], feature[some] - low] = value[some]
        used = block.any(axis=0)
        block = block[:, used]
        gram += block @ block.T
    size, axes = np.linalg.eigh(gram)
    kept = size > 1e-6
    size, axes = size[kept], axes[:, kept]
    z = axes * np.sqrt(size)
    y_of = {s: np.array([float(c == s) for c in labels]) for s in STAGES[:-1]} | {"any": np.array([float(c != "none") for c in labels])}
    known = np.array([c != "offensive" for c in labels])
    fold = np.array([zlib.crc32(" ".join(r.split()[:3]).encode()) % folds for r in rows])
    base = np.array(weight)
    weights, bias, chained = np.zeros((SIZE, len(STAGES)), np.float32), np.zeros(len(STAGES)), np.zeros((len(STAGES), len(STAGES)))
    before = np.zeros((n, 0))
    for i, stage in enumerate(STAGES):
        y = y_of[stage]
        use = base * (known if stage != "any" else 1)
        share = max(1e-6, (use * y).sum() / max(1e-6, use.sum()))
        use = use * np.where(y == 1, min(4.0, 0.5 / share), 1.0)
        full = np.hstack([z, before])
        ridges = np.r_[np.full(z.shape[1], ridge), np.full(before.shape[1], 0.5)]
        intercept = float(np.log(prior / (1 - prior)))
        b = _logistic(full, y, use, ridges, intercept)
        weights[:, i] = np.bincount(feature, weights=value * (axes @ (b[: z.shape[1]] / np.sqrt(size)))[row], minlength=SIZE)
        chained[i, :i], bias[i] = b[z.shape[1] :], intercept
        held = np.zeros(n)
        for k in range(folds):
            out = fold == k
            if out.any() and not out.all():
                held[out] = _sigmoid(full[out] @ _logistic(full[~out], y[~out], use[~out], ridges, intercept))
        before = np.hstack([before, held[:, None]])
    return Chain(weights, bias, chained)


def score(documents: DataFrame, chain: Chain, keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns to ``keep``, the greatest probability of each stage over the sentences, and the number of sentences; one row for each row."""
    shared = documents.sparkSession.sparkContext.broadcast(chain)  # of fixed size
    narrow = documents.select("doc_id", *keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), 500):
                part = pdf.iloc[low : low + 500]
                own = [sentences(t) for t in part["text"]]
                each = {s: i for i, s in enumerate(dict.fromkeys(s for x in own for s in x))}  # repeated ones are scored once
                p = shared.value.scores(list(each))[[each[s] for x in own for s in x]]
                counts = np.array([len(x) for x in own])
                out = np.zeros((len(own), len(STAGES)))
                some = counts > 0
                if some.any():
                    out[some] = np.maximum.reduceat(p, (np.cumsum(counts) - counts)[some], axis=0)
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in ("doc_id", *keep)}, **{s: out[:, i] for i, s in enumerate(STAGES)}, "sentences": counts})

    kinds = dict(documents.dtypes)
    return narrow.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep)) + ", abuse double, hate double, sexual double, any double, sentences long")
