"""Problem 6: fill containers of fixed capacity, by exact-complement hashing over the sizes.

Sizes are whole numbers up to the capacity, so all items together are a table of at most `capacity` rows (size, number
of items), whatever their count. The plan is made on that table: for the largest size left, the gap it leaves is looked
up among the available single sizes, pair sums and triple sums; a hit is used as often as the numbers allow. What no
combination fills exactly goes best-fit into the containers that stay open. The plan says how many containers hold
which sizes; the items get their places in parallel, by their rank among those of their size.

An item larger than the capacity is cut into full containers and a rest; no other item is split.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import materialize, table
from .tokens import with_tokens

CAPACITY = 4096
#: Items of one size that are ranked together.
RANK_ROWS = 100_000


class Plan:
    """Containers by content: (sizes, how many); `left` is the number of items of each size still to place."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for size, n in counts.items():
            self.left[size] = n
        self.made: list[tuple[tuple[int, ...], int]] = []
        have = (self.left > 0).astype(float)
        have[0] = 0
        n = 1 << (2 * capacity + 1).bit_length()
        f = np.fft.rfft(have, n)
        self.pair = np.fft.irfft(f * f, n)[: capacity + 1] > 0.5  # sums of two sizes; shrinks as sizes run out
        g = np.fft.rfft(self.pair.astype(float), n)
        self.triple = np.fft.irfft(f * g, n)[: capacity + 1] > 0.5

    def _use(self, sizes: tuple[int, ...]) -> bool:
        """Make as many containers of these sizes as there are items."""
        need = np.bincount(sizes, minlength=self.capacity + 1)
        kinds = np.flatnonzero(need)
        times = int((self.left[kinds] // need[kinds]).min())
        if times:
            self.left[kinds] -= times * need[kinds]
            self.made.append((sizes, times))
        return times > 0

    def _pair_for(self, gap: int) -> tuple[int, int] | None:
        if gap < 2 or not self.pair[gap]:
            return None
        b = np.arange(gap - 1, (gap - 1) // 2, -1)
        b = b[b >= gap - b]
        ok = (self.left[b] > 0) & (self.left[gap - b] > 0) & ((b != gap - b) | (self.left[b] > 1))
        hit = np.flatnonzero(ok)
        if not len(hit):
            self.pair[gap] = False
            return None
        return int(b[hit[0]]), int(gap - b[hit[0]])

    def _triple_for(self, gap: int) -> tuple[int, ...] | None:
        if gap < 3 or not self.triple[gap]:
            return None
        for a in np.flatnonzero(self.left[1 : gap - 1])[::-1] + 1:
            if self.pair[gap - a]:
                self.left[a] -= 1
                rest = self._pair_for(gap - int(a))
                self.left[a] += 1
                if rest:
                    return int(a), *rest
        self.triple[gap] = False
        return None

    def exact(self, most: int = 3) -> None:
        """Combinations that fill a container to the last token, for the largest sizes first: by one other size, then by
        pairs, then by triples (`most` at once), so that small sizes aren't spent where a single one would do."""
        if self.left[self.capacity]:
            self._use((self.capacity,))
        for find in (self._one_for, self._pair_for, self._triple_for)[:most]:
            for size in range(self.capacity - 1, 0, -1):
                while self.left[size]:
                    self.left[size] -= 1
                    combo = find(self.capacity - size)
                    self.left[size] += 1
                    if not combo or not self._use((size, *combo)):
                        break

    def _one_for(self, gap: int) -> tuple[int] | None:
        return (gap,) if self.left[gap] else None

    def best_fit(self) -> None:
        """What is left, largest first, each into the fullest container that still has room."""
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room -> contents
        rooms: list[int] = []

        def put(content: tuple[int, ...], times: int) -> None:
            room = self.capacity - sum(content)
            if room < smallest:
                self.made.append((content, times))
            else:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((content, times))

        sizes = np.flatnonzero(self.left)[::-1]
        sizes = sizes[sizes > 0]
        smallest = int(sizes[-1]) if len(sizes) else self.capacity + 1
        for size in map(int, sizes):
            n = int(self.left[size])
            while n:
                at = bisect_left(rooms, size)
                if at == len(rooms):
                    each = self.capacity // size
                    if n >= each:
                        put((size,) * each, n // each)
                    if n % each:
                        put((size,) * (n % each), 1)
                    break
                room = rooms[at]
                content, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                fit = min(room // size, n)
                used = min(times, n // fit)
                put((*content, *(size,) * fit), used)
                n -= used * fit
                if times > used:
                    put(content, times - used)
            self.left[size] = 0
        self.made += [c for contents in open_.values() for c in contents]


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, items of the size per container, containers, first container) of each content and size."""
    plans = []
    for most in (3, 2, 1):  # few small items left can make the shorter combinations better; take the fewest containers
        plan = Plan({s: n for s, n in counts.items() if s > 0}, capacity)
        plan.exact(most)
        plan.best_fit()
        plans.append(plan)
    plan = min(plans, key=lambda p: sum(times for _, times in p.made))
    given: dict[int, int] = {}
    slots, container = [], 0
    for content, times in plan.made:
        for size in sorted(set(content)):
            each = content.count(size)
            slots.append((size, given.get(size, 0), each, times, container))
            given[size] = given.get(size, 0) + each * times
        container += times
    if counts.get(0):
        slots.append((0, 0, counts[0], 1, 0))  # nothing to hold: all in the first container
    return slots


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, key, part, size, item_tokens): every item in a container, an oversized one in several parts.

    `size` is the item's whole size, null counts as 0; items of size 0 come into the first container. Keys shall be
    unique; repeated ones are items of their own. An empty table gives no rows.
    """
    spark = items.sparkSession
    whole = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    parts = F.greatest(F.ceil(whole / F.lit(capacity)), F.lit(1)).cast("int")
    cut = items.select(F.col(key).alias("key"), whole.alias("whole"), F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    each = F.least(F.col("whole") - (F.col("part") - 1) * F.lit(capacity), F.lit(capacity).cast("bigint"))
    cut = materialize(cut.withColumn("size", each), "items")
    counts = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}  # at most capacity + 1 rows
    by_size: dict[int, list[tuple[int, int, int, int]]] = {}
    for s, first, per, times, container in plan_slots(counts, capacity):
        by_size.setdefault(s, []).append((first, per, times, container))
    places = {s: np.array(v, dtype=np.int64) for s, v in by_size.items()}
    held = spark.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        for b in batches:
            sizes, ranks = b.column(3).to_numpy(), b.column(4).to_numpy()
            out = np.zeros(b.num_rows, dtype=np.int64)
            for s in np.unique(sizes):
                here = sizes == s
                p = places[s]
                at = np.searchsorted(p[:, 0], ranks[here], side="right") - 1
                out[here] = p[at, 3] + (ranks[here] - p[at, 0]) // p[at, 1]
            yield pa.RecordBatch.from_arrays([pa.array(out), b.column(0), b.column(2), b.column(3), b.column(1)], ["container_id", key, "part", "size", "item_tokens"])

    # a size of many items is ranked in as many parts as it needs for RANK_ROWS items each; a row per size
    many = spark.createDataFrame([(s, max(1, -(-n // RANK_ROWS))) for s, n in counts.items()], "size bigint, parts bigint")
    salted = cut.join(F.broadcast(many), "size").withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").count().select("size", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    w = Window.partitionBy("size", "salt").orderBy("key", "part")
    ranked = salted.withColumn("r", F.row_number().over(w)).join(offsets, ["size", "salt"]).select("key", "whole", "part", "size", (F.col("r") - 1 + F.col("offset")).alias("rank"))
    kind = items.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"container_id bigint, {key} {kind}, part int, size bigint, item_tokens bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, share of the capacity used, containers filled to the last token."""
    per = packed.groupBy("container_id").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"),
        F.count(F.when(F.col("used") == capacity, 1)).alias("full"),
    )


def packed_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "n_tokens")


def contents(packed: DataFrame) -> DataFrame:
    """(sizes, containers): what containers hold, as sizes in order, and how many hold just that."""
    per = packed.groupBy("container_id").agg(F.array_sort(F.collect_list("size")).alias("sizes"))  # no more than a container has room for
    return per.groupBy("sizes").agg(F.count("*").alias("containers"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that the packing put into more than one container."""
    spread = packed_mails(spark, sf_dir).groupBy("doc_id").agg(F.min("container_id").alias("first"), F.max("container_id").alias("last"), F.max("part").alias("parts"))
    return spread.filter("first < last AND parts > 1").select("doc_id")  # an id that comes twice is not split


def p6_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(packed_mails(spark, sf_dir).filter("size > 0"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_mails(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(packed_mails(spark, sf_dir))


# The rows don't depend on the tokenizer; a token has some three to four characters, and no size lies near the capacity.
P6_FOUND_SQL = f"SELECT doc_id FROM documents WHERE length(text) > 3.5 * {CAPACITY}"
