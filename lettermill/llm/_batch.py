"""Shared plumbing of the operators: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input in a slice of a batch.
SLICE = 1 << 21
#: Column names that a query adds; an input column of the same name is replaced.
ID, HOST = "__id", "__host"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def schema_arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in ddl.split(","))])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], ddl: str) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns given as lists."""
    names = [x.strip().split(" ", 1)[0] for x in ddl.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_arrow(ddl)
        for batch in batches:
            # Work arrays are some tens of bytes a character: a batch is taken in slices of bounded size.
            step = max(1, batch.num_rows * SLICE // max(batch.nbytes, SLICE))
            for at in range(0, batch.num_rows, step):
                yield one(batch.slice(at, step), schema)

    def one(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        out = fn(batch)
        return pa.RecordBatch.from_arrays([pa.array(out[n], schema.field(n).type) for n in names], schema=schema)

    return df.mapInArrow(run, ddl)


def strings(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session makes a folder of its own; a cluster's executors
    have no folder in common then, and it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


@lru_cache(1)
def one_blas_thread() -> None:
    """Matrix products in this process on one thread: Spark has a task on every core already."""
    try:
        with open("/proc/self/maps") as f:
            paths = {x.split()[-1] for x in f if "openblas" in x}
        for path in paths:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
                    break
    except OSError:  # another system or another library: its own setting holds
        pass
