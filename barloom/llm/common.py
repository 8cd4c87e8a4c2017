"""What the corpus operators share: word rules, one-pass text maps, row keys and connected components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
}


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8: the split of bytes knows exactly that white space."""
    return text.encode().split() if text else []


def texts(batch: pa.RecordBatch, column: int | str, slice_rows: int = 256) -> Iterator[str | None]:
    """A column's values, few at a time as Python objects, so that long texts don't pile up."""
    values = batch.column(column)
    for at in range(0, len(values), slice_rows):
        yield from values.slice(at, slice_rows).to_pylist()


def map_texts(df: DataFrame, text: str, keep: Sequence[str], out: Sequence[tuple[str, str]], make: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """One Arrow pass: the columns `keep`, then those that the function from make() (called once a task) gives for each text."""
    kept = [df.schema[k] for k in keep]
    ddl = ", ".join([f"`{k.name}` {k.dataType.simpleString()}" for k in kept] + [f"`{n}` {t}" for n, t in out])
    types = [ARROW.get(t) for _, t in out]
    names = [*keep, *(n for n, _ in out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_text = make()
        for batch in batches:
            if batch.num_rows:
                columns = zip(*map(per_text, texts(batch, len(keep))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=names)

    return df.select(*keep, F.col(text).cast("string").alias("_text_")).mapInArrow(run, ddl)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def in_fold(doc_id: Column, n: int, which: int) -> Column:
    """Whether the row is held out. A row without an id isn't."""
    return F.coalesce(fold(doc_id, n) == which, F.lit(False))


def use_checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: where the cluster says; one of our own only on a local master with nothing set, as in tests."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: later steps neither repeat the work nor lose it with an executor."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: Seconds that a statement takes at least for its shuffle files to be given back at once.
SWEEP_S = 1.0


def sweep(spark: SparkSession) -> None:
    """Gives back the shuffle files of statements that have ended. Spark deletes them once the driver's garbage is collected, which
    on its own happens the more rarely for the input the larger the steps are, so that a chain of steps piles up all it shuffles."""
    gc.collect()
    spark.sql("SELECT 1").collect()  # listeners hold the last statement until they hear of another
    with contextlib.suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5000)
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables in the shared checkpoint folder that cut lineage like checkpoints and can be deleted once they are used up.

    Those that take long also give back the shuffle files behind them: the table replaces these."""

    def __init__(self, spark: SparkSession):
        self.spark, self.serial = spark, 0
        self.folder = f"{use_checkpoints(spark)}/scratch-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        self.serial += 1
        path = f"{self.folder}/{self.serial}"
        began = time.monotonic()
        df.write.parquet(path)
        if time.monotonic() - began >= SWEEP_S:
            sweep(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path_ = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path_)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def marks(hashes: DataFrame, slots: int = 1 << 18) -> DataFrame:
    """(slot, bits): which of 64 * slots bits the long column `h` hits. At most `slots` rows, whatever the number of hashes."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    return hashes.groupBy(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(F.bit_or(bit).alias("bits"))


def marked(df: DataFrame, h: Column, marked_by: DataFrame, hit: bool = True, slots: int = 1 << 18) -> DataFrame:
    """The rows whose hash hits a bit of marks(), or the others. No shuffle; rows that hit may do so by chance, the others are none of the marked."""
    names = df.columns
    held = df.withColumn("_h_", h).withColumn("_slot_", F.shiftrightunsigned("_h_", 6).bitwiseAND(F.lit(slots - 1)))
    found = held.join(F.broadcast(marked_by.select(F.col("slot").alias("_slot_"), F.col("bits").alias("_bits_"))), "_slot_", "inner" if hit else "left")
    bit = F.expr("coalesce(shiftrightunsigned(_bits_, cast(_h_ & 63 as int)), 0L) & 1")
    return found.where(bit == (1 if hit else 0)).select(*(f"`{n}`" for n in names))


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) can reach.

    Large-star and small-star steps in turn: a node's neighbours are linked to the least of them, so paths shorten
    by a factor in each round and hubs are only ever aggregated, not paired. Ends when a round changes no edge.
    Nodes in no edge aren't returned. Raises if `rounds` aren't enough. The minima are a written table, so that both
    sides of their join are plain shuffles, whose skewed partitions (hubs) Spark splits at run time.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.put(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    was = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = scratch.put(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        new = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m"))).where("u <> v").distinct()
        seen = Observation()
        new = scratch.put(new.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        scratch.drop(e, least, down)
        e, now = new, seen.get
        if now == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        was = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
