"""Checkpointed replay, fingerprints and the audit of a chain."""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridwash.operators.cells import quoted
from gridwash.operators.segments import hashable
from gridwash.plans.steps import Step, apply_step, replay
from gridwash.session import frozen, shared_folder

CHECKPOINT_EVERY = 10
log = logging.getLogger(__name__)


def checkpoint_key(base: str, steps: Sequence[Step]) -> str:
    """Address of a chain's result: base path and the exact steps. An edited step has another address."""
    return hashlib.sha256("\x1f".join([base, *[s.to_json() for s in steps]]).encode()).hexdigest()


class ChainStore:
    """Results of chains as Parquet in the shared folder, each with a marker beside it that is written last."""

    MARK = ".done"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/gridwash/chains"

    def finished(self) -> set[str]:
        """Addresses of all complete results, from one listing."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return set()
        names = [entry.getPath().getName() for entry in files.listStatus(folder)]
        return {n.removesuffix(self.MARK) for n in names if n.endswith(self.MARK)}

    def read(self, address: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{address}")

    def write(self, address: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{address}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(path + self.MARK)
        return self.read(address)


def _storage_failed(exc: BaseException) -> bool:
    """Whether the folder is to blame, and not a step: an I/O error here or as the deepest cause in the JVM."""
    cause = getattr(exc, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    return isinstance(exc, OSError) or cause is not None and "java.io." in cause.getClass().getName()


def replay_checkpointed(base_path: str, df: DataFrame, steps: Sequence[Step],
                        every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Like replay, but goes on from the longest stored beginning of the chain, and stores the result of a chain that has
    gone ``every`` steps beyond it.

    ``base_path`` names the table that ``df`` reads, which never changes under that name. So a growing chain replays fewer
    than ``every`` steps, and chains with a common start share work. ``every`` of 0 or less stores and looks up nothing.
    A folder that cannot be read or written costs a warning and the stored result, nothing else; an error in a step is the
    caller's.
    """
    if every <= 0 or not steps:
        return replay(df, steps)
    addresses = [checkpoint_key(base_path, steps[:k]) for k in range(1, len(steps) + 1)]
    table, done = df, 0
    try:
        store = ChainStore(df.sparkSession)
        finished = store.finished()
        done = max((k for k, address in enumerate(addresses, 1) if address in finished), default=0)
        table = store.read(addresses[done - 1]) if done else df
    except Exception as exc:
        if not _storage_failed(exc):
            raise
        log.warning("stored chains cannot be read: %s", exc)
        return replay(df, steps)
    result = replay(table, steps[done:])
    if len(steps) - done < every:
        return result
    try:
        return store.write(addresses[-1], result)
    except Exception as exc:
        if not _storage_failed(exc):
            raise
        log.warning("a chain of %d steps could not be stored: %s", len(steps), exc)
        return result


# Keeps a fingerprint within a bigint however many rows are summed.
_MODULUS = 2**61 - 1


def row_digest(df: DataFrame, portable: bool = True) -> Column:
    """Hash of one row as a number; NULL differs from empty text.

    The portable form (first 60 bits of an MD5 over the cells as text) can be
    recomputed in any engine; the other one skips the text and is several times faster.
    """
    cells = [quoted(c) for c in df.columns]
    if portable:
        texts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cells]
        return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *texts)), 1, 15), 16, 10).cast("bigint")
    return F.xxhash64(*hashable(df), *[c.isNull() for c in cells])


def table_fingerprint(df: DataFrame, portable: bool = True) -> DataFrame:
    """Rows and a hash of the content that ignores row order but counts copies."""
    total = F.coalesce(F.sum(row_digest(df, portable).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    wrapped = F.pmod(total, F.lit(_MODULUS).cast("decimal(38,0)")).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("row_count"), wrapped.alias("fingerprint"))


def schema_fingerprint(catalog: DataFrame, export: str = "export", name: str = "name",
                       dtype: str = "dtype") -> DataFrame:
    """16 hex digits per export over its sorted ``name:dtype`` list; equal schemas give equal digits.

    A list is as long as one table has columns.
    """
    item = F.concat_ws(":", quoted(name), quoted(dtype))
    joined = F.concat_ws("|", F.sort_array(F.collect_list(item)))
    return catalog.select(export, name, dtype).distinct().groupBy(export).agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def schema_drift(catalog: DataFrame, baseline, export: str = "export") -> DataFrame:
    """Per export of ``catalog(export, name, dtype)``: fingerprint, and how it differs from the baseline export.

    Exports are matched with the baseline by name, in any case. A baseline without columns is an error.
    """
    distinct = catalog.select(export, F.lower("name").alias("name"), "dtype").distinct()
    base = distinct.filter(F.col(export) == F.lit(baseline)).groupBy("name").agg(F.max("dtype").alias("base_dtype"))
    size = base.count()
    if not size:
        raise ValueError(f"baseline {baseline} has no columns")
    matched = distinct.join(base, "name", "left").groupBy(export).agg(
        F.count_if(F.col("base_dtype").isNull()).alias("new_columns"),
        F.count_if(F.col("base_dtype") != F.col("dtype")).alias("retyped_columns"),
        (F.lit(size) - F.count("base_dtype")).alias("missing_columns"))
    return schema_fingerprint(catalog, export).join(matched, export)


def step_audit(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """One row per step: rows, columns and fingerprint before and after, and seconds taken.

    Each step runs once: its result is written to the shared folder, measured while it is written, and read by the next.
    The table itself never reaches the driver.
    """
    spark = df.sparkSession

    def written(table: DataFrame, k: int) -> tuple[DataFrame, int, int, float]:
        began = time.perf_counter()
        seen = Observation(f"step-{k}")
        total = F.coalesce(F.sum(row_digest(table, portable=False).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        state = frozen(table.observe(seen, F.count(F.lit(1)).alias("rows"), total.alias("digest")), "audit")
        return state, seen.get["rows"], int(seen.get["digest"]) % _MODULUS, time.perf_counter() - began

    df, rows, print_, _ = written(df, 0)
    out = []
    for i, step in enumerate(steps, 1):
        after, rows_after, print_after, seconds = written(apply_step(df, step), i)
        out.append((i, step.op, step.instruction, rows, rows_after, df.columns, after.columns,
                    print_, print_after, seconds))
        df, rows, print_ = after, rows_after, print_after
    return spark.createDataFrame(out, "step_number int, op string, instruction string, rows_before long, "
                                      "rows_after long, columns_before array<string>, columns_after array<string>, "
                                      "fingerprint_before long, fingerprint_after long, seconds double")
