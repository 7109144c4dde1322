"""Held-out items that turn up in a corpus, whole or in part, by a distributed positional inverted index.

``Index`` holds the postings of all words of all texts, by shard of the corpus:
for each word of a shard the documents and positions at which it stands. An item
is looked for in stretches of ``length`` successive words of which at least
``length - 1`` must stand in the text unchanged and in order. Of any two words
of a stretch one must be there, so its two rarest in the corpus are anchors.
Anchors meet postings in a join, which sends an item to those shards only that
hold one of its anchors. There the anchors' postings, less the words' offsets in
the item, give the places at which the item could begin. At all these places at
once the offset-adjusted postings of the words around the anchor are counted;
where enough are left, the lists are intersected in order, exactly and, for
phrases with a word left out or split and with words put in, with the same
lists up to two places on.

Items, their anchors and postings meet in shuffles only. Long items are cut into
pieces that overlap by all but one word of a stretch; where there are many items
those of a shard are searched in lots.

Defined results: null and empty texts and items give nothing; items of fewer
than ``length`` words have no case; with ``whole`` each item, of any length, is
one phrase that must stand in the text exactly; each (item, document) comes once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import words
from tallyloom.session import cut, written

SHARD_WORDS = 400_000
PIECE_WORDS = 2_000
LOT_ITEMS = 20_000
_PLAY = 2  # how far words of a stretch may stand from where they would without a change


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Postings of the texts, in shards of about SHARD_WORDS words. The row of the word '' tells the shard's documents and their lengths."""
    task, made = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    lengths: list[int] = []
    terms: dict[str, int] = {}
    codes: list[np.ndarray] = []

    def shard() -> pd.DataFrame:
        code = np.concatenate(codes) if codes else np.empty(0, np.int32)
        size = np.array(lengths, np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        at = (np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        names = list(terms)
        rows = [("", len(ids), np.array(ids, np.int64).tobytes(), size.astype(np.int32).tobytes())]
        if len(code):
            rows += [(names[code[o[0]]], len(o), doc[o].tobytes(), at[o].tobytes()) for o in np.split(order, cuts)]
        out = pd.DataFrame(rows, columns=["term", "n", "docs", "places"])
        out.insert(0, "shard", (task << 24) + made)
        return out

    total = 0
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            own = words(text)
            if not own:
                continue
            ids.append(doc_id)
            lengths.append(len(own))
            codes.append(np.fromiter((terms.setdefault(w, len(terms)) for w in own), np.int32, len(own)))
            total += len(own)
            if total >= SHARD_WORDS:
                yield shard()
                made, total, ids, lengths, terms, codes = made + 1, 0, [], [], {}, []
    if ids:
        yield shard()


class Index:
    """A positional inverted index over (doc_id, text), kept as a table in the shared folder."""

    schema = "shard long, term string, n int, docs binary, places binary"

    def __init__(self, documents: DataFrame) -> None:
        narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
        self.postings = written(narrow.mapInPandas(_postings, self.schema))

    def search(self, items: DataFrame, length: int = 12, whole: bool = False) -> DataFrame:
        """(item_id, doc_id) of the documents that hold a stretch of the item; ``items`` has item_id and text."""
        told = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
        pieces = cut(told.mapInPandas(_pieces(length, whole), "item_id long, piece int, words array<string>"))
        lots = -(-pieces.count() // LOT_ITEMS)
        found = self.postings.filter("term <> ''").join(pieces.select(F.explode("words").alias("term")).distinct(), "term", "left_semi")
        found = cut(found)
        frequency = found.groupBy("term").agg(F.sum("n").alias("f"))
        each = pieces.select("item_id", "piece", F.posexplode("words").alias("at", "term")).join(frequency, "term", "left")
        rare = each.groupBy("item_id", "piece").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("f", F.lit(0)).alias("f")))), lambda x: x["f"]).alias("f"))
        anchored = pieces.join(rare, ["item_id", "piece"]).withColumn("at", F.explode(_anchors(length, whole)("f")))
        sought = anchored.select("item_id", "piece", "at", F.col("words")[F.col("at")].alias("term")).join(found.select("shard", "term"), "term")
        sought = sought.groupBy("shard", "item_id", "piece").agg(F.collect_list("at").alias("anchors"))
        sought = sought.join(pieces, ["item_id", "piece"]).withColumn("lot", F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(1, lots))).cast("int"))
        sought = cut(sought)
        asked = sought.select("shard", F.col("lot").alias("part")).distinct()
        held = found.unionByName(self.postings.filter("term = ''")).join(asked, "shard")
        pairs = held.groupBy("shard", "part").cogroup(sought.groupBy("shard", "lot")).applyInPandas(_searcher(length, whole), "item_id long, doc_id long")
        return pairs.distinct()


def _pieces(length: int, whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item_id, text in zip(pdf["item_id"], pdf["text"]):
                own = words(text)
                if whole and own:
                    rows.append((item_id, 0, own))
                elif not whole and len(own) >= length:
                    rows += [(item_id, i, own[low : low + PIECE_WORDS]) for i, low in enumerate(range(0, len(own) - length + 1, PIECE_WORDS - length + 1))]
            yield pd.DataFrame(rows, columns=["item_id", "piece", "words"])

    return run


def _anchors(length: int, whole: bool):
    """Offsets of the two rarest words of each stretch (of the rarest one of a whole phrase) where one of them is in the corpus."""

    @F.pandas_udf("array<int>")
    def run(frequencies: pd.Series) -> pd.Series:
        out = []
        for f in frequencies:
            seen = np.asarray(f, np.int64)
            if whole:
                out.append([int(seen.argmin())] if seen.all() else [])
                continue
            windows = np.lib.stride_tricks.sliding_window_view(seen, length)
            two = np.argpartition(windows, 1, axis=1)[:, :2] + np.arange(len(windows))[:, None]
            at = np.unique(two[(seen[two] > 0).any(axis=1)])
            out.append(at[seen[at] > 0].tolist())
        return pd.Series(out)

    return run


def _searcher(length: int, whole: bool):
    def search(held: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        pairs: set[tuple[int, int]] = set()
        if len(held) and len(sought):
            code = {w: i for i, w in enumerate(held["term"])}
            head = held[held["term"] == ""].iloc[0]
            ids, sizes = np.frombuffer(head["docs"], np.int64), np.frombuffer(head["places"], np.int32).astype(np.int64)
            pad = 2 * length  # places around documents at which no word stands
            begins = np.cumsum(sizes + pad) - sizes
            stands = np.full(int((sizes + pad).sum()) + pad, -1, np.int32)
            postings: dict[int, np.ndarray] = {}
            for term, docs, places in zip(held["term"], held["docs"], held["places"]):
                if term:
                    at = begins[np.frombuffer(docs, np.int32)] + np.frombuffer(places, np.int32)
                    postings[code[term]] = at
                    stands[at] = code[term]
            for item_id, anchors, own in zip(sought["item_id"], sought["anchors"], sought["words"]):
                item = np.fromiter((code.get(w, -2) for w in own), np.int32, len(own))
                if whole:
                    places = postings[item[anchors[0]]] - anchors[0]
                    for k, c in enumerate(item):  # the list of each word, less its offset, keeps what it shares with those before
                        places = places[(places >= 0) & (places + k < len(stands))]
                        places = places[stands[places + k] == c]
                    doc = np.searchsorted(begins, places, side="right") - 1
                    pairs.update((item_id, int(ids[d])) for d in np.unique(doc))
                    continue
                starts = _starts(item, np.asarray(anchors), postings, stands, length)
                doc = np.searchsorted(begins, starts[:, 1], side="right") - 1
                done: set[int] = set()
                for d, start in zip(doc, starts[:, 0]):
                    if d not in done and _holds(item, stands, int(start), int(begins[d]), int(begins[d] + sizes[d]), length):
                        done.add(d)
                pairs.update((item_id, int(ids[d])) for d in done)
        return pd.DataFrame(sorted(pairs), columns=["item_id", "doc_id"])

    return search


def _starts(item: np.ndarray, anchors: np.ndarray, postings: dict[int, np.ndarray], stands: np.ndarray, length: int) -> np.ndarray:
    """Places at which the item could begin and a place of it that is in the text: those of the anchors' postings around which enough words of a stretch stand."""
    lists = [(np.full(len(postings[item[a]]), a), postings[item[a]]) for a in anchors]
    offset, place = (np.concatenate(x) for x in zip(*lists))
    around = np.arange(1 - length, length)
    wide = np.r_[np.full(length, -2, np.int32), item, np.full(length, -2, np.int32)]
    out = []
    for low in range(0, len(place), 4096):
        o, p = offset[low : low + 4096], place[low : low + 4096]
        wanted = wide[o[:, None] + around + length]
        hits = np.zeros(wanted.shape, bool)
        for move in range(-_PLAY, _PLAY + 1):
            hits |= stands[np.clip(p[:, None] + around + move, 0, len(stands) - 1)] == wanted
        sums = np.cumsum(np.c_[np.zeros(len(p), np.int8), hits], axis=1, dtype=np.int8)
        some = (sums[:, length:] - sums[:, :-length]).max(axis=1) >= length - 1
        out.append(np.stack([p[some] - o[some], p[some]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _holds(item: np.ndarray, stands: np.ndarray, start: int, low: int, high: int, length: int) -> bool:
    """Whether a stretch of the item stands in places low to high when its words are laid out from ``start`` on, or up to _PLAY places before or after.

    Along a stretch the layout may move on, where the text has other words in between, and once back, where it lacks a word.
    """
    n = len(item)
    at = start + np.arange(-_PLAY, _PLAY + 1)[:, None] + np.arange(n)
    hits = ((at >= low) & (at < high) & (stands[np.clip(at, 0, len(stands) - 1)] == item)).astype(np.int8)
    sums = np.lib.stride_tricks.sliding_window_view(hits, length, axis=1)
    held = sums.sum(axis=2)
    if held[_PLAY].max() >= length - 1:
        return True
    some = np.flatnonzero(held.sum(axis=0) >= length - 1)  # the others have too few words at any layout
    if not len(some):
        return False
    steps = sums[:, some, :]
    whole = np.full((len(at), len(some)), 0, np.int8)  # words held so far by layout, none left out
    short = np.full_like(whole, -length)  # the same with one left out
    for k in range(length):
        back = np.full_like(short, -length)
        back[:-1] = whole[1:]
        short = np.maximum.accumulate(np.maximum(short, back), axis=0) + steps[:, :, k]
        whole = np.maximum.accumulate(whole, axis=0) + steps[:, :, k]
    return bool(max(whole.max(), short.max()) >= length - 1)
