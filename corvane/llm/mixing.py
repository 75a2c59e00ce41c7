"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are dealt into blocks. Block i of a source with weight w is released at floor(i / w) and due at
ceil((i + 1) / w), in block slots; earliest deadline first fills the slots, and keeps each source's count within less
than one block of its share at every slot. Weights are used as they are, as exact fractions. When a source has run out,
a new phase begins, in which the others share by their weights. The driver walks the slots once, a step a block, and
keeps the state at the start of each stretch; from these, tasks deal the stretches side by side.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

#: Slots of a cycle in ``shares``, and of a stretch that is dealt at once (at least one a source).
CYCLE, STRETCH = 1000, 1 << 14
#: Rows of a block, and rows by which a source is dealt over tasks.
BLOCK = 16
DEAL = 1 << 16


def shares(weights: Mapping[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Whole shares of a cycle by largest remainder; each source gets one slot at least, so with more sources than
    ``cycle`` the cycle is as long as there are sources. ``mix`` doesn't round: its weights are exact."""
    cycle = max(cycle, len(weights))
    total = sum(weights.values())
    exact = {s: cycle * w / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s)):
        if sum(out.values()) >= cycle:
            break
        out[s] += 1
    while sum(out.values()) > cycle:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1e18, s))] -= 1
    return out


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in the very proportions of the weights (a float is a fraction whose denominator is a power of two)."""
    if not all(math.isfinite(w) and w >= 0 for w in weights):
        raise ValueError("weights must be finite and not negative")
    parts = [Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in parts))
    return [int(x * scale) for x in parts]


class Deal:
    """The schedule from a state on: ``done`` blocks of each source at ``slot``, in a phase that began at ``start`` with
    ``first`` blocks done. Sources of weight 0 share evenly when all others have run out."""

    def __init__(self, sizes: list[int], weights: list[int], slot: int = 0, start: int = 0, done: list[int] | None = None, first: list[int] | None = None):
        self.sizes, self.weights, self.slot, self.start = sizes, weights, slot, start
        self.done, self.first = list(done or [0] * len(sizes)), list(first or [0] * len(sizes))

    def state(self) -> tuple[int, int, list[int], list[int]]:
        return self.slot, self.start, list(self.done), list(self.first)

    def run(self, slots: int) -> list[int]:
        """The sources of the next ``slots`` slots, or of those that are left."""
        out: list[int] = []
        done, sizes, push, pop = self.done, self.sizes, heapq.heappush, heapq.heappop
        while len(out) < slots and (left := [s for s, n in enumerate(sizes) if done[s] < n]):
            part = self.weights if any(self.weights[s] for s in left) else [1] * len(sizes)
            left, first, t = [s for s in left if part[s]], self.first, self.slot - self.start
            total = sum(part[s] for s in left)
            later = [((done[s] - first[s]) * total // part[s], s) for s in left]
            heapq.heapify(later)
            ready: list[tuple[int, int]] = []
            while len(out) < slots:
                while later and later[0][0] <= t:
                    s = pop(later)[1]
                    push(ready, (-(-(done[s] - first[s] + 1) * total // part[s]), s))
                s = pop(ready)[1]
                out.append(s)
                done[s] += 1
                t += 1
                if done[s] == sizes[s]:
                    self.start, self.first = self.start + t, list(done)
                    t = 0
                    break
                push(later, ((done[s] - first[s]) * total // part[s], s))
            self.slot = self.start + t
        return out


def one_cycle(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one cycle, earliest deadline first among the released blocks."""
    names = sorted(parts)
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for t, s in enumerate(Deal([parts[s] for s in names], [parts[s] for s in names]).run(sum(parts.values()))):
        slots[names[s]].append(t)
    return slots


def block_slots(spark, blocks: Mapping[str, int], weights: Mapping[str, float], stretch: int = STRETCH) -> DataFrame:
    """A row a block: _source, source_block, slot. Each task deals stretches from the states that the driver has kept."""
    names = sorted(blocks)
    sizes, parts, stretch = [blocks[s] for s in names], exact([weights[s] for s in names]), max(stretch, len(names))
    deal, states = Deal(sizes, parts), []
    for _ in range(0, sum(sizes), stretch):
        states.append(deal.state())
        deal.run(stretch)
    columns = ["slot", "start", "done", "first"]
    held = spark.createDataFrame(pd.DataFrame(states, columns=columns), "slot long, start long, done array<long>, first array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.to_pylist():
                at = Deal(sizes, parts, **state)
                done, own, places = at.done.copy(), [], at.run(stretch)
                for s in places:
                    own.append(done[s])
                    done[s] += 1
                slots = pa.array(range(state["slot"], state["slot"] + len(places)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([names[s] for s in places], pa.string()), pa.array(own, pa.int64()), slots], ["_source", "source_block", "slot"])

    tasks = min(len(states), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return held.repartition(tasks).mapInArrow(run, "_source string, source_block long, slot long")


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, by: str = "source", key: str = "doc_id", block: int = BLOCK, cycle: int = STRETCH) -> DataFrame:
    """Adds ``source_block`` (the block's index in its source), ``slot`` (its place in the mixture, gapless from 0) and
    ``block_row``. All rows stay.

    Within a source, rows stand in order of a hash of the key. Sources without a weight get 1; without ``weights`` each
    source gets the square root of its row count. A null source is a source of its own. No rows: no rows. ``cycle`` is the
    number of slots that are dealt at once; the result doesn't depend on it.
    ``df`` is read twice: pass a table. The sources are collected with their counts; the driver holds their number, and
    their number once more for each stretch.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(by)), F.lit(""))
    dealt = df.withColumns({"_source": name, "_hash": F.xxhash64(F.col(key).cast("string"))})
    spark = df.sparkSession
    counts = dealt.groupBy("_source", F.shiftrightunsigned("_hash", 52).alias("_fine")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "mix-counts")  # 4096 rows a source at most
    sizes = {r[0]: r[1] for r in counts.groupBy("_source").agg(F.sum("n")).collect()}
    if not sizes:
        return dealt.drop("_source", "_hash").withColumns({c: F.lit(0).cast("long") for c in ("source_block", "slot", "block_row")})
    if weights is None:
        target = {s: n**0.5 for s, n in sizes.items()}
    else:
        target = {s: float(weights.get(s[1:], 1.0)) for s in sizes}
    slots = block_slots(spark, {s: -(-n // block) for s, n in sizes.items()}, target, cycle)
    # A source's rows are numbered by task-sized hash ranges; the counts of the ranges before shift each range.
    before = Window.partitionBy("_source").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_fine", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    offsets = offsets.repartition("_source", "_fine")  # a source's ranges are many blocks
    blocks = F.explode(F.sequence(F.floor(F.col("_before") / block), F.floor((F.col("_before") + F.col("n") - 1) / block)))
    ranges = offsets.select("_source", "_fine", "_before", blocks.alias("source_block")).join(slots, ["_source", "source_block"])
    # In a source, slots grow with the blocks.
    ranges = written(ranges.groupBy("_source", "_fine", "_before").agg(F.array_sort(F.collect_list("slot")).alias("_slots")), "mix-slots")
    inside = F.row_number().over(Window.partitionBy("_source", "_fine").orderBy("_hash", key)) - 1
    placed = dealt.withColumn("_fine", F.shiftrightunsigned("_hash", 52)).withColumn("_inside", inside).join(ranges, ["_source", "_fine"])
    placed = placed.withColumn("_at", F.col("_before") + F.col("_inside"))
    placed = placed.withColumn("source_block", F.floor(F.col("_at") / block)).withColumn("block_row", F.col("_at") % block)
    slot = F.get("_slots", (F.col("source_block") - F.floor(F.col("_before") / block)).cast("int"))
    return placed.withColumn("slot", slot).drop("_source", "_hash", "_fine", "_inside", "_before", "_at", "_slots")


def in_mix_order(df: DataFrame, mixed: DataFrame | None = None, **kwargs) -> DataFrame:
    """The rows of ``df`` with their own columns, laid out in the mixture's order: files and rows follow the slots."""
    held = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df["doc_id"].alias("doc_id"), df["source"].alias("source"))
    done = mix(held, **kwargs)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return done.repartitionByRange(parts, "slot", "block_row").sortWithinPartitions("slot", "block_row").select("_row.*")


def mix_digest(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, source, source_block, slot, block_row."""
    return mix(documents.select("doc_id", "source")).select("doc_id", "source", "source_block", "slot", "block_row")
