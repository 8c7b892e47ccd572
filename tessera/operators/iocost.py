"""Cost of a trace of disk requests: seeks, rotation and transfer on a simulated disk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_previous


@dataclass(frozen=True)
class DiskFile:
    id: str
    size: int


@dataclass(frozen=True)
class Disk:
    """Geometry and speed; the values are those of a common desktop disk."""

    block_size: int = 4096
    rpm: int = 7200
    blocks_per_track: int = 1024
    heads: int = 4
    cylinders: int = 500_000
    track_seek_ms: float = 0.8
    full_seek_ms: float = 18.0
    mb_per_s: float = 150.0
    files: tuple[DiskFile, ...] = field(default_factory=tuple)

    @property
    def cylinder_blocks(self) -> int:
        return self.blocks_per_track * self.heads

    def check(self) -> None:
        """Raises ValueError on a disk or files that make no sense."""
        if self.block_size <= 0:
            raise ValueError("the block size must be positive")
        for f in self.files:
            if not f.id or any(c.isspace() for c in f.id):
                raise ValueError(f"a file's id has no spaces: {f.id!r}")
            if f.size <= 0 or f.size % self.block_size:
                raise ValueError(f"{f.id}: {f.size} bytes are no whole number of blocks")

    def layout(self) -> tuple[dict[str, tuple[int, int]], int]:
        """First block and number of blocks of each file, and the first block after the last gap.

        Behind a file stays a gap of four times its size, ten gigabytes at least.
        """
        room = -(-10_000_000_000 // self.block_size)
        at, out = 0, {}
        for f in self.files:
            n = f.size // self.block_size
            out[f.id] = (at, n)
            at += n + max(4 * n, room)
        return out, at


def request_costs(trace: DataFrame, disk: Disk = Disk(), seq: str = "seq", start: str = "start_block", blocks: str = "n_blocks") -> DataFrame:
    """The trace with what each request costs: cylinders, seek_ns, rot_ns, transfer_ns.

    ``seq`` is an integer column that orders the requests.  The disk starts at cylinder 0, behind
    block 0.  Requests of no blocks move nothing and cost nothing.
    """
    per = disk.cylinder_blocks
    rows = trace.select("*", F.col(start).alias("_sb"), F.col(blocks).alias("_nb"))
    none, rows = rows.filter("_nb <= 0"), rows.filter("_nb > 0")
    rows = rows.withColumn("_eb", F.col("_sb") + F.col("_nb") - 1)
    rows = rows.withColumn("_sc", F.floor(F.col("_sb") / F.lit(float(per))).cast("long")).withColumn("_ec", F.floor(F.col("_eb") / F.lit(float(per))).cast("long"))
    rows = with_previous(rows, seq, ["_eb", "_ec"])
    far = F.abs(F.coalesce(F.col("prev__ec"), F.lit(0)) - F.col("_sc"))
    crossed = F.col("_ec") - F.col("_sc")
    follows = F.col("_sb") == F.coalesce(F.col("prev__eb"), F.lit(0)) + 1
    share = F.sqrt(F.least(F.lit(1.0), far / F.lit(float(disk.cylinders))))
    seek = F.when(far == 0, 0.0).when(far == 1, disk.track_seek_ms).otherwise(F.lit(disk.track_seek_ms) + F.lit(disk.full_seek_ms - disk.track_seek_ms) * share)
    ns = lambda ms: F.round(ms * 1_000_000).cast("long")
    turn = F.lit(round(0.5 * 60 / disk.rpm * 1000 * 1_000_000)).cast("long")
    move = F.col("_nb") * disk.block_size / F.lit(1_000_000.0) / disk.mb_per_s * 1000
    keep = [F.col(c) for c in trace.columns]
    paid = rows.select(*keep, (far + crossed).cast("long").alias("cylinders"), ns(seek + crossed * F.lit(disk.track_seek_ms)).alias("seek_ns"), F.when(follows, F.lit(0).cast("long")).otherwise(turn).alias("rot_ns"), ns(move).alias("transfer_ns"))
    zero = F.lit(0).cast("long")
    return paid.unionByName(none.select(*keep, *[zero.alias(c) for c in ("cylinders", "seek_ns", "rot_ns", "transfer_ns")]))


def io_cost(trace: DataFrame, disk: Disk = Disk(), seq: str = "seq", start: str = "start_block", blocks: str = "n_blocks", write: str | None = None) -> DataFrame:
    """One row: reads, blocks, cylinders, seek_ns, rot_ns, transfer_ns of the whole trace.

    With ``write``, a boolean column that marks requests that write, also writes, and in
    microseconds io_us, seek_us, rot_us and transfer_us; reads then leaves the writes out.
    """
    costs = request_costs(trace, disk, seq, start, blocks)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    parts = ("seek_ns", "rot_ns", "transfer_ns")
    writes = F.coalesce(F.col(write), F.lit(False)) if write else F.lit(False)
    out = costs.agg(F.count_if(~writes).alias("reads"), *([F.count_if(writes).alias("writes")] if write else []), total(blocks).alias("blocks"), *[total(c).alias(c) for c in ("cylinders", *parts)])
    if not write:
        return out
    out = out.withColumn("io_ns", sum((F.col(c) for c in parts), F.lit(0).cast("long")))
    return out.select("*", *[F.floor((F.col(c) + 500) / F.lit(1000)).cast("long").alias(c.replace("_ns", "_us")) for c in ("io_ns", *parts)])


def micros(ns: int) -> int:
    """Nanoseconds as microseconds, halves up."""
    return (ns + 500) // 1000
