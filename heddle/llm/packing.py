"""Shortest-pack-first packing over the histogram of lengths.

Texts are encoded once into a narrow table of pieces: a document's ids with the end id, cut into whole
sequences and one rest. The driver sees only the histogram of piece lengths (at most `size` rows). It
places lengths longest first, each into the packs with the most room, and keeps counts of packing
patterns; the patterns are joined back to the pieces by their rank within their length.

Given places of documents in an order (as of mixing), packs of all patterns are spread evenly and
numbered along it, and take each length's pieces in that order, so a share of the sequences holds about
that share of the order.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; null doc_ids
stay; an empty table gives no piece; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import scans
from heddle.llm import common, tokens

SIZE = 1024

Runs = tuple[tuple[int, int], ...]


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, Runs]]:
    """(packs, ((length, times), ...)) for a histogram {length: pieces}, by shortest pack first."""
    room: dict[int, list[tuple[int, Runs]]] = {}
    largest: list[int] = []  # heap of -room
    done: list[tuple[int, Runs]] = []

    def put(space: int, packs: int, runs: Runs) -> None:
        if not space:
            done.append((packs, runs))
            return
        if not room.get(space):
            room[space] = []
            heapq.heappush(largest, -space)
        room[space].append((packs, runs))

    def grown(runs: Runs, length: int) -> Runs:
        if runs and runs[-1][0] == length:
            return (*runs[:-1], (length, runs[-1][1] + 1))
        return (*runs, (length, 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while largest and not room[-largest[0]]:
                heapq.heappop(largest)
            if largest and -largest[0] >= length:
                space = -largest[0]
                packs, runs = room[space].pop()
                n = min(packs, left)
                if packs > n:
                    room[space].append((packs - n, runs))
                put(space - length, n, grown(runs, length))
                left -= n
                continue
            # nothing has room: the next pieces fill fresh packs, one after another
            times = size // length
            if full := left // times:
                put(size - times * length, full, ((length, times),))
            if rest := left % times:
                put(size - rest * length, 1, ((length, rest),))
            left = 0
    return done + [x for packs in room.values() for x in packs]


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = tokens.NAME) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids, cut into runs of size and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(np.frombuffer(enc.encode(text.as_py()), dtype=enc.dtype), tokens.END).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    for column, x in zip(out, (doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def placed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column length of 1 to size."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most size rows
    slots, at, base = [], dict.fromkeys(histogram, 0), 0
    for packs, runs in patterns(histogram, size):
        offset = 0
        for length, times in runs:
            slots.append((length, at[length], at[length] + packs * times, packs, base, offset))
            at[length] += packs * times
            offset += length * times
        base += packs
    # a pattern's distinct lengths add up to size at most, so there are under sqrt(2 * size) slots a pattern
    table = spark.createDataFrame(slots, "len long, lo long, hi long, packs long, base long, off long")
    r = common.ranked(cut, "length", ["doc_id", "start"], "rank")
    t = r.join(F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    t = t.withColumn("nth", F.col("rank") - F.col("lo"))
    return t.select(
        *cut.columns,
        (F.col("base") + F.col("nth") % F.col("packs")).alias("sequence_id"),
        (F.col("off") + F.floor(F.col("nth") / F.col("packs")) * F.col("length")).cast("long").alias("offset"),
    )


def _summed(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of key before the row; __bin (dropped) cuts a key's rows along the order."""
    d = common.stored(df.withColumn("__v", value), "binned")
    starts = d.groupBy(F.col(key).alias("__k"), F.col("__bin").alias("__b")).agg(F.sum("__v").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = Window.partitionBy(key, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__r", F.coalesce(F.sum("__v").over(within), F.lit(0)))
    d = d.join(starts.hint("merge"), (F.col(key) == F.col("__k")) & (F.col("__bin") == F.col("__b")))
    return d.select(*[c for c in df.columns if c != "__bin"], (F.col("__start") + F.col("__r")).cast("long").alias(out))


def placed_along(cut: DataFrame, size: int = SIZE, per_bin: int = 2_000, step: int = 10_000) -> DataFrame:
    """As placed, for pieces with a column position: sequences are filled and numbered along it."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most size rows
    rows, whole = [], 0
    for p, (packs, runs) in enumerate(patterns(histogram, size)):
        offset = 0
        for length, times in runs:
            rows.append((p, packs, length, times, offset))
            offset += length * times
        whole += packs
    table = spark.createDataFrame(rows, "pattern long, packs long, len long, times long, off long")
    bins = max(1, -(-whole // per_bin))
    each = table.select("pattern", "packs").distinct().withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1, F.lit(step).cast("long"))))
    each = each.repartition("pattern", "from").withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + step, F.col("packs")) - 1)))
    # the packs of a pattern come at even distances
    each = each.select("pattern", ((F.col("nth") + 0.5) / F.col("packs")).alias("turn"), F.lit(0).alias("all"))
    each = each.withColumn("__bin", F.floor(F.col("turn") * bins).cast("int"))
    packs = common.stored(_summed(each, "all", ["turn", "pattern"], F.lit(1), "sequence_id").select("pattern", "sequence_id"), "packs")
    # a pattern's distinct lengths add up to size at most, so there are under sqrt(2 * size) slots a pattern
    slots = packs.join(F.broadcast(table.drop("packs")), "pattern").drop("pattern").withColumn("__bin", F.floor(F.col("sequence_id") / per_bin).cast("int"))
    slots = _summed(slots, "len", ["sequence_id"], F.col("times"), "lo")
    slots = slots.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    slots = slots.select("len", (F.col("lo") + F.col("t")).alias("at"), "sequence_id", (F.col("off") + F.col("t") * F.col("len")).alias("offset"))
    pieces_ = sum(histogram.values())
    ranked = scans.binned(cut, F.col("position"), max(per_bin, pieces_ // 1_000))
    ranked = _summed(ranked, "length", ["position", "doc_id", "start", "ids_crc32"], F.lit(1), "rank")
    joined = ranked.join(slots.hint("merge"), (F.col("length") == F.col("len")) & (F.col("rank") == F.col("at")))
    return joined.select(*[c for c in cut.columns if c != "position"], "sequence_id", "offset")


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str = tokens.NAME, places: DataFrame | None = None) -> DataFrame:
    """A row for each piece of docs (doc_id, text), with its place in a sequence of at most size ids.

    places: (doc_id, slot, place) as of mixing.places; sequences then follow that order.
    """
    cut = pieces(docs, size, tokenizer)
    if places is None:
        return placed(common.stored(cut, "pieces"), size)
    first = places.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.struct("slot", "place")).alias("__at"))
    width = places.agg(F.coalesce(F.max("place"), F.lit(0)) + 1).first()[0]
    cut = common.stored(cut, "pieces").join(common.stored(first, "first").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    cut = cut.withColumn("position", F.coalesce(F.col("__at.slot") * width + F.col("__at.place"), F.lit(0))).drop("__id", "__at")
    return placed_along(common.stored(cut, "placed"), size)
