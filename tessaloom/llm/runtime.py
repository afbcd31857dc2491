"""Session helpers shared by the operators: table reading, lineage cuts, Arrow mapping."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session in one process (master
    local...) gets a temporary one; a cluster is an error, as no other folder is known to be shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store Spark reaches it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner", share: int = 500, total: int | None = None) -> DataFrame:
    """``rows`` (materialised; ``total`` of them, where that is known) joined with ``groups``, one
    row a key that has ``size`` rows. Keys of at least 1/``share`` of all rows, ``share`` of them
    at most, are broadcast, so that their rows stay where they are; the others are shuffled."""
    from pyspark.sql import functions as F

    hot = cut(groups.filter(F.col(size) >= max(1, (rows.count() if total is None else total) // share)))
    small = F.broadcast(hot.drop(size))
    return rows.join(small, key, how).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.drop(size), key, how))


def bounded_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df``, after its session was told to send Python at most about ``most`` bytes in a batch
    (a batch of 10,000 very long texts would fill an executor); a lower setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = conf.get(key, None)
    if have is None or not have.removesuffix("b").isdigit() or int(have.removesuffix("b")) > most:
        conf.set(key, str(most))
    return df


def release() -> None:
    """Gives back what a Python worker holds beyond its partition: workers idle between stages,
    and an executor's memory counts them all."""
    import ctypes
    import gc

    from . import bpe, textops

    bpe.forget()
    textops.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[dict], dict | None], schema: StructType, max_chars: int = 1 << 20) -> DataFrame:
    """mapInArrow over slices of at most about ``max_chars`` characters of text (one row at
    least), so that a worker's memory follows one slice and never a whole batch. ``fn`` gets
    columns as Python lists and returns columns as lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)
    text_columns = [i for i, f in enumerate(df.schema.fields) if f.dataType.simpleString() == "string"]
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, rows = 0, batch.num_rows
            sizes = [0] * rows
            for i in text_columns:
                for k, n in enumerate(pa.compute.binary_length(batch.column(i)).to_pylist()):
                    sizes[k] += n or 0
            while start < rows:
                end, held = start, 0
                while end < rows and (end == start or held + sizes[end] <= max_chars):
                    held += sizes[end]
                    end += 1
                part = batch.slice(start, end - start)
                start = end
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema)
                part = out = None
        release()

    return bounded_batches(df).mapInArrow(run, schema)
