"""A model of a spinning disk: where files lie, and what a trace of block accesses costs.

The cost of an access depends on the one before it only (its last block and cylinder), so a trace is one window over
its sequence numbers. To keep that window off a single task, the trace is cut into runs of RUN accesses: within a run the
window is partitioned, and each run gets the end of the run before it from a small table.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.nodes import PlanError

RUN = 1_000_000
#: Fixed value: the least gap after a file, and before the scratch region, in bytes.
GAP_BYTES = 10_000_000_000


@dataclass(frozen=True)
class Disk:
    """The defaults of the modelled disk."""

    block_size: int = 4096
    rpm: float = 7200.0
    blocks_per_track: int = 1024
    heads_per_cylinder: int = 4
    total_cylinders: int = 500_000
    track_to_track_seek_ms: float = 0.8
    full_stroke_seek_ms: float = 18.0
    transfer_rate_mb_s: float = 150.0

    def __post_init__(self) -> None:
        if self.block_size <= 0:
            raise PlanError(f"block size must be positive, not {self.block_size}")

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, given: dict) -> "Disk":
        if set(given) != {f.name for f in fields(cls)}:
            raise PlanError(f"not a disk configuration: {sorted(given)}")
        return cls(**given)


@dataclass(frozen=True)
class Extent:
    file_id: str
    start_block: int
    num_blocks: int


def layout(sizes: Iterable[tuple[str, int]], block_size: int = 4096) -> tuple[list[Extent], int]:
    """Where files of these (id, bytes) lie, one after the other with wide gaps, and where the scratch region starts."""
    least = -(-GAP_BYTES // block_size)
    at, extents = 0, []
    for file_id, size in sizes:
        if " " in file_id:
            raise PlanError(f"file id {file_id!r} has a space")
        if size <= 0 or size % block_size:
            raise PlanError(f"the size of {file_id} ({size}) isn't a positive multiple of {block_size}")
        blocks = size // block_size
        extents.append(Extent(file_id, at, blocks))
        at += blocks + max(4 * blocks, least)
    return extents, max((e.start_block + e.num_blocks for e in extents), default=0) + least


def load_config(path: str | Path) -> tuple[Disk, list[tuple[str, int]]]:
    """The disk and the (id, bytes) of its files from a configuration file; checked by laying them out."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    if set(given) != {"disk_config", "files"}:
        raise PlanError("a disk configuration has the members disk_config and files")
    disk = Disk.from_json(given["disk_config"])
    sizes = []
    for f in given["files"]:
        file = Path(f["file_path"])
        if not file.exists():
            raise PlanError(f"file {file} doesn't exist")
        sizes.append((f["id"], file.stat().st_size))
    layout(sizes, disk.block_size)
    return disk, sizes


def check_writes(trace: DataFrame, scratch_start: int) -> DataFrame:
    """The accesses of a trace (seq, kind, start_block, num_blocks) that write below the scratch region."""
    return trace.filter((F.col("kind") == "write") & (F.col("start_block") < scratch_start))


def _nanoseconds(ms: Column) -> Column:
    return F.round(ms * 1_000_000.0).cast("long")


def access_costs(trace: DataFrame, disk: Disk = Disk()) -> DataFrame:
    """trace (seq long, kind 'read' or 'write', start_block long, num_blocks long) + cylinders, seek_ns, rotation_ns,
    transfer_ns. Accesses of no block count as accesses but cost nothing and move nothing. seq must be unique."""
    per_cylinder = disk.blocks_per_track * disk.heads_per_cylinder
    moving = trace.filter("num_blocks > 0")
    rows = moving.select("seq", "kind", "start_block", "num_blocks", (F.col("start_block") + F.col("num_blocks") - 1).alias("_end"), F.floor(F.col("seq") / RUN).alias("_run"))
    within = Window.partitionBy("_run").orderBy("seq")
    ends = rows.groupBy("_run").agg(F.max_by("_end", "seq").alias("_last"))
    ends = ends.select("_run", F.lag("_last", 1, 0).over(Window.orderBy("_run")).alias("_before_run"))  # a row for each run
    rows = rows.withColumn("_lag", F.lag("_end").over(within)).join(ends, "_run").withColumn("_before", F.coalesce("_lag", "_before_run"))
    cylinder = F.floor(F.col("start_block") / per_cylinder)
    crossed = F.floor(F.col("_end") / per_cylinder) - cylinder
    distance = F.abs(cylinder - F.floor(F.col("_before") / per_cylinder))
    reach = F.sqrt(F.least(distance / F.lit(float(disk.total_cylinders)), F.lit(1.0)))
    seek = F.when(distance == 0, 0.0).when(distance == 1, disk.track_to_track_seek_ms).otherwise(disk.track_to_track_seek_ms + (disk.full_stroke_seek_ms - disk.track_to_track_seek_ms) * reach)
    rotation = F.when(F.col("start_block") == F.col("_before") + 1, 0.0).otherwise(0.5 * 60.0 / disk.rpm * 1000.0)
    transfer = F.col("num_blocks") * disk.block_size / 1_000_000.0 / disk.transfer_rate_mb_s * 1000.0
    costs = rows.select(
        "seq", "kind", "start_block", "num_blocks", (distance + crossed).cast("long").alias("cylinders"),
        _nanoseconds(seek + crossed * disk.track_to_track_seek_ms).alias("seek_ns"), _nanoseconds(rotation).alias("rotation_ns"), _nanoseconds(transfer).alias("transfer_ns"),
    )
    still = trace.filter("num_blocks <= 0").select("seq", "kind", "start_block", "num_blocks", *(F.lit(0).cast("long").alias(c) for c in ("cylinders", "seek_ns", "rotation_ns", "transfer_ns")))
    return costs.unionByName(still)


def metrics(trace: DataFrame, disk: Disk = Disk()) -> DataFrame:
    """One row: reads, writes, blocks, cylinders and microseconds of a trace."""

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    def micro(c: Column) -> Column:
        return F.floor((c + 500) / 1000).cast("long")

    seek, rotation, transfer = (total(c) for c in ("seek_ns", "rotation_ns", "transfer_ns"))
    return access_costs(trace, disk).agg(
        F.count(F.when(F.col("kind") == "read", 1)).alias("total_reads"), F.count(F.when(F.col("kind") == "write", 1)).alias("total_writes"),
        total("num_blocks").alias("total_blocks_processed"), total("cylinders").alias("total_cylinders_traveled"), micro(seek + rotation + transfer).alias("total_io_time_us"),
        micro(seek).alias("total_seek_time_us"), micro(rotation).alias("total_rotational_latency_us"), micro(transfer).alias("total_transfer_time_us"),
    )


class BlockStore:
    """The store's text protocol over an in-memory trace: answers layout questions and records accesses.

    Spark owns storage here; the store lets recorded request scripts be priced with metrics().
    """

    def __init__(self, sizes: Iterable[tuple[str, int]], disk: Disk = Disk()):
        self.disk = disk
        extents, self.scratch = layout(sizes, disk.block_size)
        self.extents = {e.file_id: e for e in extents}
        self.trace: list[tuple[int, str, int, int]] = []

    def request(self, line: str) -> str | None:
        """The answer to one request; None when it ends the session."""
        words = line.split()
        match [w.lower() for w in words[:2]], words[2:]:
            case (["exit"], []) | ([], []):
                return None
            case ["get", "block-size"], []:
                return str(self.disk.block_size)
            case ["get", "anon-start-block"], []:
                return str(self.scratch)
            case ["get", "file"], [what, file_id] if what.lower() in ("start-block", "num-blocks"):
                if file_id not in self.extents:
                    raise PlanError(f"unknown file {file_id!r}")
                e = self.extents[file_id]
                return str(e.start_block if what.lower() == "start-block" else e.num_blocks)
            case [verb, "block"], [start, n] if verb in ("get", "put") and start.isdigit() and n.isdigit():
                if verb == "put" and int(start) < self.scratch:
                    raise PlanError(f"blocks below {self.scratch} are write protected")
                self.trace.append((len(self.trace) + 1, "read" if verb == "get" else "write", int(start), int(n)))
                return ""
        raise PlanError(f"unknown request {line!r}")

    def metrics(self, spark: SparkSession) -> DataFrame:
        return metrics(spark.createDataFrame(self.trace, "seq long, kind string, start_block long, num_blocks long"), self.disk)
