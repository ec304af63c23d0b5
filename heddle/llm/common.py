"""What several corpus operators share: shared-folder tables, bounded groups, ranks, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.session import scratch, shared_dir, stored

__all__ = ["scratch", "shared_dir", "stored"]

#: Rows that one Arrow batch carries to Python; texts can be long, so batches are kept short.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def paired_chunks(df: DataFrame, keys: list[str], spread: str, limit: int) -> DataFrame:
    """Cuts every group of keys into chunks of about limit rows and deals out pairs of chunks.

    Adds gi <= gj and side. A group (keys, gi, gj) holds chunk gi (side 1) and chunk gj (side 2), or
    one chunk alone (side 0, gi = gj); any two rows of a key meet in exactly one group, which has at
    most about 2 * limit rows. Groups of one key land in different tasks, so a hot key spreads.
    spread: the column whose hash picks the chunk.
    """
    hot = df.groupBy(*keys).count().where(F.col("count") > limit)
    hot = stored(hot.select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("chunks")), "hot")
    n = hot.count()
    if n == 0:
        return df.withColumns({"gi": F.lit(0), "gj": F.lit(0), "side": F.lit(0)})
    small = F.broadcast(hot) if n <= 20_000 else hot  # rows of a few bytes; beyond that a shuffle join
    own = F.pmod(F.xxhash64(F.lit(7), F.col(spread)), F.col("chunks")).cast("int")
    out = (
        df.join(small, keys, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    return out.withColumns({
        "gi": F.least("own", "other"),
        "gj": F.greatest("own", "other"),
        "side": F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2),
    }).drop("chunks", "own", "other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream sorted by keys, of at least `least` rows but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k)[rows - 1].as_py() for k in keys]
        lo, hi = 0, rows - 1  # first row of the last group, by bisection
        names = [table.column(k) for k in keys]
        while lo < hi:
            mid = (lo + hi) // 2
            if [c[mid].as_py() for c in names] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield table.slice(0, lo)
            held = table.slice(lo).to_batches()
            rows -= lo
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ranked(df: DataFrame, key: str, order: list[str], out: str, per_bin: int = 1_000) -> DataFrame:
    """Adds out: the row's 0-based rank (long) within key, in the order of a hash of `order`.

    Hash-ordered bins of about per_bin rows each are ranked by a window and moved up by the sizes of
    the bins before them, so no task sorts a whole hot key. `order` should identify a row; rows that
    agree in it are whole repeats and may trade ranks. Null keys form a group of their own.
    """
    sizes = stored(df.groupBy(F.col(key).alias("__k")).agg(F.ceil(F.count("*") / per_bin).alias("__bins")), "sizes")
    keys = sizes.count()
    sizes = F.broadcast(sizes) if keys <= 20_000 else sizes
    d = df.withColumn("__h", F.xxhash64(F.lit(11), *[F.col(c) for c in order]))
    d = d.join(sizes, F.col(key).eqNullSafe(F.col("__k")), "left")
    # the hash's upper 32 bits, unsigned, cut the key's rows into equal bins
    share = F.shiftrightunsigned("__h", 32) / F.lit(float(1 << 32))
    d = stored(d.withColumn("__bin", F.floor(share * F.col("__bins")).cast("int")).drop("__k", "__bins"), "binned")
    starts = d.groupBy(F.col(key).alias("__k"), F.col("__bin").alias("__b")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))), "starts")
    starts = F.broadcast(starts) if starts.count() <= 50_000 else starts
    within = Window.partitionBy(key, "__bin").orderBy("__h", *order)
    d = d.withColumn("__r", F.row_number().over(within) - 1)
    d = d.join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bin") == F.col("__b")))
    return d.select(*df.columns, (F.col("__start") + F.col("__r")).cast("long").alias(out))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex of edges (a, b): root is the smallest vertex that it reaches.

    Alternates large and small stars until nothing changes; each round is written to the shared
    folder. Vertices stay distributed; the driver sees one row of counts a round.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges"
    )
    if e.isEmpty():
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    seen = None
    for _ in range(rounds):
        # large star: every larger neighbour of a moves to the smallest of a and its neighbours
        low = both(e).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both(e).where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours move to the smallest of them; all edges point down
        big = stored(big, "big")
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        hung = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = stored(hung.union(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    pairs = e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return pairs.union(e.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that they need no install of it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="heddle-code-")
        atexit.register(shutil.rmtree, folder, True)  # Spark copies the file at once
        path = Path(folder) / "heddle.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow with short batches; rows: how many a batch carries."""
    shipped(df.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(f, schema)
