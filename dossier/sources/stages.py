"""Stages on shared storage: compute once, reuse while inputs and settings stay the same."""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="dossier-")
    return _local_dirs[app]


@dataclass
class Scratch:
    """Tables and broadcasts of a piece of work, which its end releases."""

    paths: list[str] = field(default_factory=list)
    broadcasts: list[Broadcast] = field(default_factory=list)


_scratch: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables settled and vectors sent inside are removed at the end: what is to stay must be written by then.

    For work that is repeated, like the batches of a stream. Frames that read these tables are of no
    use afterwards.
    """
    held = Scratch()
    token = _scratch.set(held)
    try:
        yield held
    finally:
        _scratch.reset(token)
        for sent in held.broadcasts:
            sent.destroy()
        for path in held.paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def hold(broadcast: Broadcast) -> Broadcast:
    """Note a broadcast for the end of the work it serves."""
    held = _scratch.get()
    if held is not None:
        held.broadcasts.append(broadcast)
    return broadcast


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write the frame to the shared folder and read it back, so that it is computed exactly once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    held = _scratch.get()
    if held is not None:
        held.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core, for work that is heavy per row.

    Only a scan of few splits (one small file) is redistributed; a large one stays as it is read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def input_fingerprint(spark: SparkSession, files: list[str]) -> str:
    """Digest over path, size and modification time of the input files; contents are not read."""
    if not files:
        raise ValueError("a frame without input files cannot be told from another one: give source=, a frame read from files")
    listed = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    row = listed.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("x"),
    ).first()
    return f"{row['n']}-{row['bytes']}-{row['x']}"


def fingerprint(df: DataFrame, config: Mapping) -> str:
    """Key of a stage: its input files, settings and the code version."""
    parts = [input_fingerprint(df.sparkSession, sorted(df.inputFiles())), json.dumps(config, sort_keys=True, default=str)]
    return hashlib.sha256("|".join([str(VERSION), *parts]).encode()).hexdigest()[:16]


def read_meta(spark: SparkSession, path: str, key: str) -> dict | None:
    """Meta data of a finished stage, or nothing."""
    try:
        rows = spark.read.json(f"{path}/{key}/meta").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0].asDict(recursive=True) if rows else None


def materialize(
    df: DataFrame | Callable[[], DataFrame],
    path: str,
    config: Mapping,
    source: DataFrame | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Compute or load a Parquet stage below ``path``.

    The key covers the files of ``source`` (default: of the frame itself) and ``config``. The meta
    row is written last, so a stage that was cut short is computed again.
    """
    if source is None:
        source = df() if callable(df) else df
    spark = spark or source.sparkSession
    key = fingerprint(source, config)
    if read_meta(spark, path, key) is None:
        _write(df() if callable(df) else df, path, key, config)
    return spark.read.parquet(f"{path}/{key}/data")


def _write(frame: DataFrame, path: str, key: str, config: Mapping, facts: Mapping | None = None) -> None:
    """Write a stage, its meta row last."""
    spark, data = frame.sparkSession, f"{path}/{key}/data"
    frame.write.mode("overwrite").parquet(data)
    written = spark.read.parquet(data)
    meta = {
        "created_at": datetime.now(timezone.utc).isoformat(),
        "rows": written.count(),
        "columns": written.columns,
        "version": VERSION,
        "config": json.dumps(dict(config), sort_keys=True, default=str),
        "facts": json.dumps(dict(facts or {}), sort_keys=True),
    }
    schema = "created_at string, rows long, columns array<string>, version int, config string, facts string"
    spark.createDataFrame([tuple(meta.values())], schema).coalesce(1).write.mode("overwrite").json(f"{path}/{key}/meta")


@dataclass(frozen=True)
class Stage:
    """A stored table, the facts kept with it, and whether it was there already."""

    key: str
    frame: DataFrame
    facts: dict
    reused: bool


class StageGraph:
    """Stages that build on each other below one path.

    The key of a stage covers its name, its settings and the keys of everything it is made of, so a
    change of an input, a setting or a lower stage gives all stages above it another key.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def key(self, name: str, config: Mapping, inputs: Sequence[Stage | str]) -> str:
        below = [i.key if isinstance(i, Stage) else i for i in inputs]
        parts = json.dumps([VERSION, name, dict(config), below], sort_keys=True, default=str)
        return f"{name}-{hashlib.sha256(parts.encode()).hexdigest()[:16]}"

    def stage(
        self,
        name: str,
        build: Callable[[], tuple[DataFrame, Mapping]],
        config: Mapping,
        inputs: Sequence[Stage | str],
    ) -> Stage:
        """Load a stage, or compute it with ``build``, which gives the frame and facts to keep with it."""
        key = self.key(name, config, inputs)
        meta = read_meta(self.spark, self.path, key)
        if meta is None:
            frame, facts = build()
            _write(frame, self.path, key, config, facts)
        found = read_meta(self.spark, self.path, key) if meta is None else meta
        return Stage(key, self.spark.read.parquet(f"{self.path}/{key}/data"), json.loads(found["facts"]), meta is not None)


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of parts below a folder; no rows while there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
