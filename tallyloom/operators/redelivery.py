"""Messages delivered more than once: exactly one copy of each identity.

Rows are put into time buckets by their time of capture. Each bucket has a
Bloom filter of its identities, in blocks of 65,536 bits, all bits of an
identity in one block. A second plane of the filter tells the bits that were
set at least twice. A row *matches* its own bucket if its bits are all set
twice there, and another one if they are all set in it. A row that matches none
is definitely the only one of its identity and goes no further. All others,
the possible repeats, are stored by bucket, and each is verified exactly
against what is stored in the buckets that it matches, and in no others.

Partial filters are made where the rows are read and merged as lists of bit
positions, so an identity with any number of copies costs each task one entry.
Finished filters are broadcast while they stay under ``max_filter_bytes``;
beyond that distinct hashes and filters meet by groups of blocks in a shuffle.
The numbers of blocks of all buckets then fit the number of groups, a power of
two: multiples of it, or smaller powers of two. So a group of hash values needs
its own share of each bucket's blocks only, or one block of a small bucket.

Defined results: a row whose identity has a null part can't be recognised
again; it is never a repeat and is always kept. Null capture times have a
bucket of their own. Of several copies the one captured first is kept (null
last), then the lowest batch, then the least remaining columns in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, partitions, written

BLOCK_BITS = 65_536
PROBES = 6
MAX_BUCKETS = 62  # and one for rows without a time: a row's matching buckets fit the bits of a long
GROUP_BYTES = 2 << 20
_UNKNOWN = -1


@dataclass
class Layout:
    """Which blocks of the whole filter each time bucket has."""

    origin: int
    width: int
    buckets: list[int]
    blocks: list[int]
    first: list[int] = field(init=False)
    fixed: int = 0

    def __post_init__(self) -> None:
        self.first = [0, *np.cumsum(self.blocks).tolist()]

    @property
    def size(self) -> int:
        return self.first[-1]

    @property
    def bytes(self) -> int:
        return self.size * BLOCK_BITS // 8 * 2

    def bucket_of(self, seconds):
        return F.when(seconds.isNull(), F.lit(_UNKNOWN)).otherwise(F.floor((seconds - F.lit(self.origin)) / F.lit(self.width))).cast("int")


def _grouped(layout: Layout) -> tuple[Layout, int]:
    """The layout with its numbers of blocks raised to fit a number of groups, and that number. At most twice the blocks."""
    groups = 1 << max(0, math.ceil(layout.bytes / GROUP_BYTES) - 1).bit_length()
    fit = [-(-n // groups) * groups if n >= groups else 1 << (n - 1).bit_length() for n in layout.blocks]
    return Layout(layout.origin, layout.width, layout.buckets, fit), groups


def _probe(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = hashes.view(np.uint64)
    start, step = u & np.uint64(0xFFFF), ((u >> np.uint64(16)) & np.uint64(0xFFFF)) | np.uint64(1)
    bits = (start[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(0xFFFF)
    return u >> np.uint64(40), bits.astype(np.int64)


def _partial(layout: Layout):
    """Bit positions set once and twice or more by the rows of one task, by block."""
    where = {b: (layout.first[i], layout.blocks[i]) for i, b in enumerate(layout.buckets)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [np.empty((0, 2), np.int64)]
        for pdf in batches:
            block, bits = _probe(pdf["h"].to_numpy(np.int64))
            if layout.fixed:
                first, count = pdf["bucket"].to_numpy(np.int64), np.uint64(layout.fixed)
            else:
                first = pdf["bucket"].map(lambda b: where[b][0]).to_numpy(np.int64)
                count = pdf["bucket"].map(lambda b: where[b][1]).to_numpy(np.uint64)
            cell = ((first + (block % count).astype(np.int64))[:, None] * BLOCK_BITS + bits).ravel()
            kept.append(np.stack(np.unique(cell, return_counts=True), axis=1))
            if len(kept) > 64:
                kept = [_fold(kept)]
        cells, seen = _fold(kept).T
        blocks, starts = np.unique(cells // BLOCK_BITS, return_index=True)
        rows = []
        for block, a, z in zip(blocks.tolist(), starts, [*starts[1:], len(cells)]):
            own = (cells[a:z] % BLOCK_BITS).astype(np.uint16)
            rows.append((block, own.tobytes(), own[seen[a:z] > 1].tobytes()))
        yield pd.DataFrame(rows, columns=["block", "once", "twice"])

    return run


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(parts)
    cells, at = np.unique(both[:, 0], return_inverse=True)
    return np.stack([cells, np.bincount(at, weights=both[:, 1], minlength=len(cells)).astype(np.int64)], axis=1)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(BLOCK_BITS, np.int32)
    for once in pdf["once"]:
        counts[np.frombuffer(once, np.uint16)] += 1
    twice = counts > 1
    for more in pdf["twice"]:
        twice[np.frombuffer(more, np.uint16)] = True
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "once": [np.packbits(counts > 0).tobytes()], "twice": [np.packbits(twice).tobytes()]})


def _all_set(plane: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the rows have all their bits set; those that fail early are not looked at again."""
    alive = np.arange(len(rows))
    for i in range(PROBES):
        b = bits[alive, i]
        alive = alive[(plane[rows[alive], b >> 3] >> (7 - (b & 7))) & 1 == 1]
    out = np.zeros(len(rows), bool)
    out[alive] = True
    return out


def _matches(layout: Layout, slot_of, once: np.ndarray, twice: np.ndarray, bucket: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The buckets that each row matches, as bits by their place in the layout."""
    block, bits = _probe(h)
    out = np.zeros(len(h), np.int64)
    for i, b in enumerate(layout.buckets):
        at = layout.first[i] + (block % np.uint64(layout.blocks[i])).astype(np.int64)
        own = bucket == b
        for mask, plane in ((own, twice), (~own, once)):
            some = np.flatnonzero(mask)
            out[some] |= _all_set(plane, slot_of(at[some]), bits[some]).astype(np.int64) << i
    return out


@dataclass
class Screen:
    """The finished filters over the rows of one table, and the way rows are held against them."""

    layout: Layout
    filters: DataFrame
    keys: list[str]
    time: str
    groups: int  # 0: the filters are broadcast

    def tagged(self, df: DataFrame) -> DataFrame:
        """The rows with ``_bucket``, ``_h`` and ``_mask``, the buckets that they match (0: definitely new)."""
        whole = F.lit(True)
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        rows = df.withColumn("_bucket", self.layout.bucket_of(F.unix_seconds(F.col(self.time)))).withColumn("_h", F.xxhash64(*self.keys)).withColumn("_whole", whole)
        rows = self._by_block_group(rows) if self.groups else self._broadcast(rows)
        return rows.withColumn("_mask", F.when(F.col("_whole"), F.col("_mask")).otherwise(F.lit(0)).cast("long")).drop("_whole")

    def stored(self, maybe: DataFrame) -> DataFrame:
        """Possible repeats as a table by bucket, each bucket in parts by hash."""
        n = partitions(maybe.sparkSession)
        parts = max(1, n // max(1, len(self.layout.buckets)))
        return written(maybe.repartition(n, "_bucket", F.pmod("_h", F.lit(parts))).drop("_h"), "_bucket")

    def verified(self, stored: DataFrame) -> DataFrame:
        """The identities that are stored more than once in the buckets matched by one of their rows, and their number of copies."""
        matched = F.array(*[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(b)) for i, b in enumerate(self.layout.buckets)]) if self.layout.buckets else F.array().cast("array<int>")
        asked = stored.select(*self.keys, F.explode(F.filter(matched, lambda b: b.isNotNull())).alias("_bucket")).distinct()
        held = stored.groupBy("_bucket", *self.keys).agg(F.count("*").alias("_n"))
        return asked.join(held, ["_bucket", *self.keys]).groupBy(*self.keys).agg(F.sum("_n").alias("copies")).filter("copies > 1")

    def _broadcast(self, rows: DataFrame) -> DataFrame:
        layout = self.layout
        once = np.zeros((layout.size, BLOCK_BITS // 8), np.uint8)
        twice = np.zeros_like(once)
        for r in self.filters.toLocalIterator():
            once[r["block"]] = np.frombuffer(r["once"], np.uint8)
            twice[r["block"]] = np.frombuffer(r["twice"], np.uint8)
        shared = rows.sparkSession.sparkContext.broadcast((once, twice))

        @F.pandas_udf("long")
        def mask(bucket: pd.Series, h: pd.Series) -> pd.Series:
            return pd.Series(_matches(layout, lambda at: at, *shared.value, bucket.to_numpy(np.int64), h.to_numpy(np.int64)))

        return rows.withColumn("_mask", mask("_bucket", "_h"))

    def _wanted(self) -> DataFrame:
        """The filter blocks with each group (g) of hash values that needs them."""
        layout, groups, own = self.layout, self.groups, []
        for first, n in zip(layout.first, layout.blocks):
            step = min(n, groups)
            own.append(F.when((F.col("block") >= first) & (F.col("block") < first + n), F.sequence(F.pmod(F.col("block") - first, F.lit(step)).cast("long"), F.lit(groups - 1).cast("long"), F.lit(step).cast("long"))))
        return self.filters.select(F.explode(F.coalesce(*own)).alias("g"), "block", "once", "twice") if own else self.filters.select(F.lit(0).cast("long").alias("g"), "block", "once", "twice")

    def _by_block_group(self, rows: DataFrame) -> DataFrame:
        """Distinct hashes meet the filter blocks that they may need in groups of hash values; rows learn of the few that may repeat."""
        layout, groups = self.layout, self.groups
        asked = rows.select("_h", "_bucket").distinct().withColumn("_group", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(groups)))
        wanted = self._wanted()

        def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(right["block"].to_numpy())
            at = right["block"].to_numpy()[order]
            empty = np.zeros(BLOCK_BITS // 8, np.uint8)  # stands for the blocks in which nothing is set
            once, twice = (np.stack([*[np.frombuffer(x, np.uint8) for x in right[c].iloc[order]], empty]) for c in ("once", "twice"))

            def slot_of(x: np.ndarray) -> np.ndarray:
                slot = np.searchsorted(at, x)
                return np.where(np.r_[at, -1][slot] == x, slot, len(at))

            out = _matches(layout, slot_of, once, twice, left["_bucket"].to_numpy(np.int64), left["_h"].to_numpy(np.int64))
            some = out != 0
            return pd.DataFrame({"_h2": left["_h"][some], "_b2": left["_bucket"][some], "_mask": out[some]})

        found = asked.groupBy("_group").cogroup(wanted.groupBy("g")).applyInPandas(test, "_h2 long, _b2 int, _mask long")
        joined = rows.join(found, (F.col("_h") == F.col("_h2")) & (F.col("_bucket") == F.col("_b2")), "left")
        return joined.withColumn("_mask", F.coalesce("_mask", F.lit(0).cast("long"))).drop("_h2", "_b2")


def screen(df: DataFrame, keys: list[str], time: str, bucket_seconds: int = 3600, bits_per_id: int = 16, max_filter_bytes: int = 64 << 20) -> Screen:
    """Filters over all rows of ``df``. Buckets are widened until there are at most MAX_BUCKETS of them."""
    seconds = F.unix_seconds(F.col(time))
    hour = F.floor(seconds / F.lit(bucket_seconds))
    hours = cut(df.groupBy(hour.alias("hour")).agg(F.count("*").alias("n")))
    low, high = hours.agg(F.min("hour"), F.max("hour")).first()
    low, high = (0, 0) if low is None else (low, high)
    layout = Layout(low * bucket_seconds, bucket_seconds * math.ceil((high - low + 1) / MAX_BUCKETS), [], [])
    counts = sorted(hours.groupBy(layout.bucket_of(F.col("hour") * F.lit(bucket_seconds)).alias("b")).agg(F.sum("n")).collect())  # at most MAX_BUCKETS + 1 rows
    extra = 2 * max(0, math.ceil(math.log2(max(1, len(counts)) / 8)))
    layout = Layout(layout.origin, layout.width, [b for b, _ in counts], [max(1, math.ceil(n * (bits_per_id + extra) / BLOCK_BITS)) for _, n in counts])
    layout, groups = _grouped(layout) if layout.bytes > max_filter_bytes else (layout, 0)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    hashed = df.select(layout.bucket_of(seconds).alias("bucket"), F.xxhash64(*keys).alias("h"))
    filters = hashed.mapInPandas(_partial(layout), "block long, once binary, twice binary").groupBy("block").applyInPandas(_merge, "block long, once binary, twice binary")
    return Screen(layout, filters, keys, time, groups)


def _named(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _narrow(df: DataFrame, keys: list[str], time: str, *more) -> tuple[DataFrame, list[str]]:
    """The identity as k0, k1, ... and the time as t, so that no other column's name can clash."""
    own = [f"k{i}" for i in range(len(keys))]
    return df.select(*[_named(k).alias(n) for k, n in zip(keys, own)], _named(time).alias("t"), *more), own


def repeats(df: DataFrame, keys: list[str], time: str, **options) -> DataFrame:
    """Each identity with more than one row, and its number of copies."""
    narrow, own = _narrow(df, keys, time)
    held = screen(narrow, own, "t", **options)
    found = held.verified(held.stored(held.tagged(narrow).filter("_mask <> 0").select("_bucket", "_mask", "_h", *own)))
    return found.select(*[F.col(n).alias(k) for n, k in zip(own, keys)], "copies")


def exactly_one(df: DataFrame, keys: list[str], time: str, then: list[str] = (), **options) -> DataFrame:
    """One row of each identity, with all columns; see the module for which."""
    ties = [time, *then, *[c for c in df.columns if c not in (time, *then, *keys)]]
    order = F.struct(*[x for i, c in enumerate(ties) for x in (_named(c).isNull().alias(f"n{i}"), _comparable(df, c).alias(f"c{i}"))])
    rows, own = _narrow(df, keys, time, F.struct(*[_named(c).alias(f"v{i}") for i, c in enumerate(df.columns)]).alias("row"), order.alias("order"))
    held = screen(rows, own, "t", **options)
    tagged = written(held.tagged(rows).withColumn("_new", F.col("_mask") == 0), "_new")
    kept = held.stored(tagged.filter("not _new").drop("_new"))  # all copies of an identity lie in the buckets that its rows match
    first = kept.groupBy(*own).agg(F.min_by("row", "order").alias("row"))
    both = tagged.filter("_new").select("row").unionByName(first.select("row"))
    return both.select(*[F.col(f"row.v{i}").alias(c) for i, c in enumerate(df.columns)])


def _comparable(df: DataFrame, name: str):
    """Maps have no order; their JSON text stands for them."""
    return F.to_json(_named(name)) if "map<" in df.schema[name].dataType.simpleString() else _named(name)


class DeliveryStore:
    """Kept messages as a table by time bucket, with the buckets' filters beside it; one ``accept`` for each delivered batch.

    Works as the function of ``foreachBatch``: a batch given again after a failure finds its identities stored and
    adds nothing. Filters have a fixed number of blocks a bucket, so those of each batch are appended, and put
    together into a new generation now and then. A batch's hashes meet the filters of all buckets by the number of
    the block, in ranges of buckets, so any number of buckets will do. A bucket that outgrows its blocks only sends
    more rows to the exact comparison, which reads the matching buckets only.
    """

    def __init__(self, path: str, keys: list[str], time: str, bucket_seconds: int = 3600, blocks_per_bucket: int = 32, buckets_at_once: int = 512, most_files: int = 256) -> None:
        self.path, self.keys, self.time = path, keys, time
        self.bucket_seconds, self.blocks, self.at_once, self.most_files = bucket_seconds, blocks_per_bucket, buckets_at_once, most_files

    def _generations(self, spark) -> list[int]:
        """Those that are complete; the last one counts."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[8:]) for n in names if n.startswith("filters-") and files.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def _matching(self, own: DataFrame, filters: DataFrame) -> DataFrame:
        """_h, _in: each hash of the batch with each bucket whose filter has all its bits."""
        blocks, at_once = self.blocks, self.at_once
        merged = filters.groupBy("block").applyInPandas(_merge, "block long, once binary, twice binary")
        bucket = F.floor(F.col("block") / F.lit(blocks)).cast("int")
        parts = merged.select(bucket.alias("_in"), F.pmod("block", F.lit(blocks)).alias("at"), F.floor(bucket / F.lit(at_once)).alias("lot"), "once")
        lots = [r[0] for r in filters.select(F.floor(bucket / F.lit(at_once)).alias("lot")).distinct().collect()]  # one for so many buckets
        asked = own.select("_h").distinct().select("_h", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(blocks)).alias("at"), F.explode(F.array(*map(F.lit, lots))).alias("lot"))

        def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            h = left["_h"].to_numpy(np.int64)
            bits, out = _probe(h)[1], []
            for b, once in zip(right["_in"], right["once"]):
                hit = h[_all_set(np.frombuffer(once, np.uint8)[None, :], np.zeros(len(h), np.int64), bits)]
                out.append(pd.DataFrame({"_h": hit, "_in": b}))
            return pd.concat(out) if out else pd.DataFrame({"_h": [], "_in": []})

        return asked.groupBy("lot", "at").cogroup(parts.groupBy("lot", "at")).applyInPandas(test, "_h long, _in int")

    def accept(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Adds the batch's new messages to the store and returns them."""
        spark, keys = batch.sparkSession, self.keys
        seconds = F.unix_seconds(F.col(self.time))
        bucket = F.coalesce(F.floor(seconds / F.lit(self.bucket_seconds)), F.lit(_UNKNOWN)).cast("int")
        own = cut(exactly_one(batch, keys, self.time).withColumn("_bucket", bucket).withColumn("_h", F.xxhash64(*keys)))
        generation = max(self._generations(spark), default=None)
        if generation is not None:
            filters = spark.read.parquet(f"{self.path}/filters-{generation}")
            if len(filters.inputFiles()) > self.most_files:
                generation += 1
                filters.groupBy("block").applyInPandas(_together, "block long, once binary, twice binary").write.mode("overwrite").parquet(f"{self.path}/filters-{generation}")
                filters = spark.read.parquet(f"{self.path}/filters-{generation}")
            matching = cut(self._matching(own, filters))
            touched = [r[0] for r in matching.select("_in").distinct().collect()]  # at most the number of buckets
            stored = spark.read.schema(own.drop("_h").schema).parquet(f"{self.path}/rows").filter(F.col("_bucket").isin(touched))
            asked = own.select("_h", *keys).join(matching, "_h")
            known = asked.join(stored.select(F.col("_bucket").alias("_in"), *keys), ["_in", *keys], "left_semi").select(*keys).distinct()
            own = cut(own.join(known, keys, "left_anti"))
        layout = Layout(0, self.bucket_seconds, [], [])
        layout.fixed = self.blocks
        own.drop("_h").write.mode("append").partitionBy("_bucket").parquet(f"{self.path}/rows")
        marks = own.select((F.col("_bucket").cast("long") * self.blocks).alias("bucket"), F.col("_h").alias("h"))
        marks.mapInPandas(_partial(layout), "block long, once binary, twice binary").write.mode("append").parquet(f"{self.path}/filters-{generation or 0}")
        return own.drop("_h", "_bucket")


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    """The partial filters of one block as one."""
    both = [np.concatenate([np.frombuffer(x, np.uint16) for x in pdf[c]]) for c in ("once", "twice")]
    cells, seen = np.unique(both[0], return_counts=True)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "once": [cells.tobytes()], "twice": [np.union1d(cells[seen > 1], both[1]).astype(np.uint16).tobytes()]})
