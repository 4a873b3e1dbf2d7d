"""Claims on pending work: leases on ranges of ids, for several workers at a time.

A range's leases are files numbered one after the other. Whoever creates the next file, in one step of the file system, holds the range
until its lease expires; then the one after may be created. Done is a file too, which only the holder of the newest lease
writes. So no two workers hold a range, a lost worker's range comes back, and nothing is removed by hand. Clocks are the file
system's and the drivers'; a lease should be longer than they may differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.sources.sinks import create_new


@dataclass(frozen=True)
class Claim:
    range: int
    lease: int
    owner: str


class Claims:
    def __init__(self, spark: SparkSession, path: str, owner: str, seconds: float = 600, size: int = 10_000):
        self.spark, self.path, self.owner, self.seconds, self.size = spark, path.rstrip("/"), owner, seconds, size
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, n: int) -> list[str]:
        at = self._at(str(n))
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _create(self, name: str) -> bool:
        return create_new(self.spark, f"{self.path}/{name}", self.owner.encode())

    def _age(self, name: str) -> float:
        return (self.spark._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(self._at(name)).getModificationTime()) / 1000

    def range_of(self, id_col: str = "id"):
        return F.floor(F.col(id_col) / self.size)

    def take(self, pending: DataFrame, id_col: str = "id", most: int = 1) -> list[Claim]:
        """At most `most` ranges of pending rows that are free. A number a range comes to the driver."""
        out = []
        for r in pending.select(self.range_of(id_col).alias("n")).distinct().orderBy("n").toLocalIterator():
            if len(out) == most:
                break
            claim = self.take_range(r.n)
            if claim:
                out.append(claim)
        return out

    def take_range(self, n: int) -> Claim | None:
        names = self._names(n)
        if "done" in names:
            return None
        last = max((int(x) for x in names if x.isdigit()), default=0)
        if last and self._age(f"{n}/{last}") < self.seconds:
            return None
        return Claim(n, last + 1, self.owner) if self._create(f"{n}/{last + 1}") else None

    def holds(self, claim: Claim) -> bool:
        names = self._names(claim.range)
        return "done" not in names and max(int(x) for x in names if x.isdigit()) == claim.lease

    def renew(self, claim: Claim) -> bool:
        """A claim that is still held lasts for its whole time again; False if it is lost."""
        if not self.holds(claim):
            return False
        self._fs.setTimes(self._at(f"{claim.range}/{claim.lease}"), self.spark._jvm.java.lang.System.currentTimeMillis(), -1)
        return True

    def done(self, claim: Claim) -> bool:
        """False if another has taken the range, or ended it; what this worker did then must not count."""
        return self.holds(claim) and self._create(f"{claim.range}/done")

    def work(self, pending: DataFrame, stage: Callable[[DataFrame], None], id_col: str = "id") -> Iterator[int]:
        """Take ranges and run stage on each range's rows until none is free; the numbers of those that this worker ended. A stage may run
        twice for a range whose lease expires under it, so it appends by key."""
        while claims := self.take(pending, id_col):
            for claim in claims:
                stage(pending.filter(self.range_of(id_col) == claim.range))
                if self.done(claim):
                    yield claim.range
