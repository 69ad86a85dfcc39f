"""States of a sampler on disk: numbered, committed whole, resumed after a lost driver.

A state is a folder ``scan-N`` with the vectors and a one-row manifest (the
prior, the log probability, the seed).  It is written under another name and
renamed once it is whole, so a folder of that name is always complete; the file
system's renames must be atomic.  A fit that finds states goes on from the last
one, and since a round's draws depend on the state, the seed and the round's
number alone, it ends as it would have without a break.  The last and the best
state are kept, others are deleted when a later one is committed.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import hdp

_MANIFEST = "scan long, seed long, log_probability double, mu array<double>, scatter array<array<double>>, kappa double, nu double, tau double, gamma double"
_STATE = ["vec_id", "group_id", "table_id", "dish_id", "x"]


@dataclass(frozen=True)
class State:
    """One committed state: after ``scan`` rounds."""

    scan: int
    seed: int
    log_probability: float
    prior: hdp.Prior
    path: str

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


class States:
    """The states of one fit under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def scans(self) -> list[int]:
        """Numbers of the committed states, ascending; two at most are kept besides one that is being replaced."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"scan-(\d+)", n)))

    def read(self, scan: int) -> State:
        path = f"{self.root}/scan-{scan}"
        m = self.spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()
        prior = hdp.Prior(np.array(m.mu), np.array(m.scatter), m.kappa, m.nu, m.tau, m.gamma)
        return State(m.scan, m.seed, m.log_probability, prior, path)

    def last(self) -> State | None:
        found = self.scans()
        return self.read(found[-1]) if found else None

    def best(self) -> State | None:
        """The state with the highest log probability; the earlier of two alike."""
        return max((self.read(k) for k in self.scans()), key=lambda s: (s.log_probability, -s.scan), default=None)

    def commit(self, vectors: DataFrame, prior: hdp.Prior, scan: int, seed: int, log_probability: float) -> State:
        """Write one state whole, then give it its name; a state of that number stays as it was committed first."""
        making, final = f"{self.root}/making-{uuid.uuid4().hex}", f"{self.root}/scan-{scan}"
        vectors.select(*_STATE).write.parquet(f"{making}/vectors")
        row = (scan, seed, float(log_probability), [float(x) for x in prior.mu], [[float(x) for x in r] for r in prior.scatter], *map(float, (prior.kappa, prior.nu, prior.tau, prior.gamma)))
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.parquet(f"{making}/manifest")
        if self._fs.exists(self._path(final)) or not self._fs.rename(self._path(making), self._path(final)):
            self._fs.delete(self._path(making), True)
        return self.read(scan)

    def clear(self) -> None:
        """Delete what is neither last nor best, and what was left unfinished."""
        best, last = self.best(), self.last()
        kept = {f"scan-{s.scan}" for s in (best, last) if s}
        for status in self._fs.listStatus(self._path(self.root)):
            if status.getPath().getName() not in kept:
                self._fs.delete(status.getPath(), True)


def fit(
    vectors: DataFrame, prior: hdp.Prior, scans: int, seed: int, states: States, proposals: int = 0, scales: bool = False, by_distance: bool = False, every: int = 1
) -> State | None:
    """Rounds up to ``scans`` in all, from the last state of ``states`` on, or from ``vectors`` where there is none.

    A state is committed after every ``every`` rounds and after the last.  A round's
    own intermediate tables go with it.  A state of another seed is refused.  The
    last state is returned; ``states.best()`` has the best.
    """
    spark = vectors.sparkSession
    last = states.last()
    if last and last.seed != seed:
        raise ValueError(f"{states.root} holds states of seed {last.seed}")
    done, now, prior = (last.scan, last.vectors(spark), last.prior) if last else (0, vectors, prior)
    for r in range(done, scans):
        work = f"{states.root}/work-{uuid.uuid4().hex}"

        def cut(table: DataFrame, name: int | str, work: str = work) -> DataFrame:
            path = f"{work}/{name}"
            table.write.parquet(path)
            return spark.read.schema(table.schema).parquet(path)

        now, prior = hdp.one_round(now, prior, r, seed, cut, proposals, scales, by_distance)
        if (r + 1) % every == 0 or r + 1 == scans:
            probability = hdp.log_probability(hdp.dishes(now, prior), prior)
            last = states.commit(now, prior, r + 1, seed, probability if math.isfinite(probability) else -math.inf)
            now = last.vectors(spark)
            states.clear()
    return last
