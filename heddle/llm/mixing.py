"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash, form blocks of `block` documents. Target weights are exact
fractions w of the sum. The j-th block of a source is released at floor(j / w) and due by ceil((j + 1) / w);
among released blocks the earliest deadline takes each slot. All deadlines are met, so after any number of
slots each source has got its exact target share to within less than one block, however long the run:
nothing is rounded. The schedule repeats after as many slots as the shares' common denominator has, when
all sources stand at their targets; only one such period is computed on the driver, whatever the corpus holds.

Nothing is dropped or repeated: a source that runs dry leaves its later slots empty, and the others
go on in the same order. Without given weights the targets are the sources' document counts to the
power `alpha`, in whole thousandths of at least one, so that small sources come up sooner than by plain proportion.

Edge cases: a null source is a source of its own; rows that share doc_id and source share one place;
given weights need not name all sources: those not named, or of weight 0, come after all others, so
they aren't lost; a float weight means its shortest decimal form; negative or non-finite weights raise
ValueError, and so do weights whose period would be over MOST_SLOTS (say them in fewer digits); null and
empty texts are documents like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import common

BLOCK = 16
ALPHA = 0.7
#: The longest period that is computed.
MOST_SLOTS = 1_000_000
#: Rows that are broadcast.
FEW = 20_000

Weight = int | float | Fraction | Decimal


def by_name(s: str | None) -> tuple[bool, str]:
    return s is None, s or ""


def exact(weights: dict[str | None, Weight]) -> dict[str | None, int]:
    """Each source's slots in one period: the weights as whole numbers without a common factor, those of 0 left out."""
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    parts = {s: Fraction(str(w)) for s, w in weights.items() if w}
    below = math.lcm(*(p.denominator for p in parts.values()))
    whole = {s: int(p * below) for s, p in parts.items()}
    shared = math.gcd(*whole.values())
    whole = {s: w // shared for s, w in whole.items()}
    if sum(whole.values()) > MOST_SLOTS:
        raise ValueError(f"these weights repeat after {sum(whole.values())} slots, more than {MOST_SLOTS}; give them with fewer digits")
    return whole


def by_counts(counts: dict[str | None, int], alpha: float = ALPHA, parts: int = 1000) -> dict[str | None, int]:
    """Target weights for document counts: their powers in whole parts, one at least, of about `parts`."""
    total = sum(n**alpha for n in counts.values())
    return {s: max(1, round(parts * n**alpha / total)) for s, n in counts.items()}


def schedule(shares: dict[str | None, int]) -> list[str | None]:
    """The source of each slot of one period, by earliest deadline first among released blocks."""
    period = sum(shares.values())
    names = sorted(shares, key=by_name)
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[names[i]]), i, j))
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append(names[i])
        if j + 1 < shares[names[i]]:
            heapq.heappush(waiting, ((j + 1) * period // shares[names[i]], i, j + 1))
    return out


def places(docs: DataFrame, weights: dict[str | None, Weight] | None = None, block: int = BLOCK, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, source, block, slot, place) of each distinct (doc_id, source) of docs.

    The mixed order is by slot, then place within the slot's block.
    """
    spark = docs.sparkSession
    d = common.stored(docs.select("doc_id", F.col("source").cast("string").alias("source")).distinct(), "sources")
    counts = {r.source: r["count"] for r in d.groupBy("source").count().collect()}  # a row for each source, as the weights have
    shares = exact({s: weights.get(s, 0) for s in counts} if weights is not None else by_counts(counts, alpha))
    whole = sum(shares.values())
    slots: dict[str | None, list[int]] = {s: [] for s in shares}
    for slot, s in enumerate(schedule(shares)):
        slots[s].append(slot)
    blocks = {s: -(-n // block) for s, n in counts.items()}
    end = max((((blocks[s] - 1) // len(at)) * whole + at[(blocks[s] - 1) % len(at)] + 1 for s, at in slots.items()), default=0)
    sizes = []  # source, slots a period, first slot if of no weight
    for s in sorted(counts, key=by_name):
        sizes.append((s, shares.get(s, 0), end))
        end += 0 if s in shares else blocks[s]
    table = pa.table({
        "s": pa.array([s for s, at in slots.items() for _ in at], pa.string()),
        "nth": pa.array([j for at in slots.values() for j in range(len(at))], pa.int64()),
        "at": pa.array([x for at in slots.values() for x in at], pa.int64()),
    })
    table = spark.createDataFrame(table)
    # a row for each slot of a period; a long one is joined by a shuffle, in which steps spread a hot source
    table = F.broadcast(table) if whole <= FEW else table.hint("merge")
    sizes = spark.createDataFrame(sizes, "s string, quanta long, after long")
    sizes = F.broadcast(sizes) if len(counts) <= FEW else sizes.hint("merge")
    r = common.ranked(d, "source", ["doc_id"], "rank")
    r = r.withColumn("block", F.floor(F.col("rank") / block).cast("long")).withColumn("place", F.col("rank") % block)
    r = r.join(sizes, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = F.greatest("quanta", F.lit(1))
    r = r.withColumns({"turn": F.floor(F.col("block") / per).cast("long"), "step": F.when(F.col("quanta") > 0, F.col("block") % per)})
    r = r.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("nth")), "left")
    slot = F.when(F.col("quanta") > 0, F.col("turn") * whole + F.col("at")).otherwise(F.col("after") + F.col("block"))
    return r.select("doc_id", "source", "block", slot.alias("slot"), "place")


def mix(docs: DataFrame, weights: dict[str | None, Weight] | None = None, block: int = BLOCK, alpha: float = ALPHA) -> DataFrame:
    """All rows of docs (doc_id, source, ...) with their columns, sorted into the mixed order."""
    p = common.stored(places(docs, weights, block, alpha), "places")
    p = p.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("slot").alias("__slot"), F.col("place").alias("__place"))
    # places grow with the corpus: always a shuffle join, never a broadcast
    joined = docs.join(p.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")))
    return joined.orderBy("__slot", "__place").select(*docs.columns)
