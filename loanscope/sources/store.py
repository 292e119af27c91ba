"""A store of computed tables under the checkpoint folder, keyed by their input files (SRC5).

A result is kept under its name and a key made of the names, sizes and times of all input files
and its own schema, so any query or session that shares the folder finds it again, and
a changed input leads to another key. A result is reused for ``expiry`` seconds and its folder is
removed after ``removal`` seconds, which leaves time for readers that still hold it.

Every write goes to a folder of its own, which counts from the moment the writer's
``_SUCCESS`` file is there: sessions that build the same result at once, lost executors and broken
writes leave nothing half-read.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

EXPIRY_S = 600
REMOVAL_S = 6 * 3600


def inputs_digest(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of all files under ``paths``.

    The binary-file source lists them in parallel and, without its content column, opens
    none; sums of hashes do not depend on the order of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), "path", "length", "modificationTime").cast("decimal(20,0)"))
    told = files.agg(F.count(F.lit(1)), F.sum("length"), total(1), total(2)).first()
    return hashlib.sha256(repr([*sorted(paths), *map(str, told)]).encode()).hexdigest()


class Store:
    def __init__(self, spark: SparkSession, base: str | None = None, expiry: float = EXPIRY_S, removal: float = REMOVAL_S):
        self.spark, self.expiry, self.removal = spark, expiry, max(removal, expiry)
        self.base = f"{(base or checkpoint_dir(spark)).rstrip('/')}/store"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    @staticmethod
    def _age(folder: str) -> float:
        return time.time() - int(folder.split("-")[0]) / 1000

    def _found(self, place: str) -> str | None:
        """The newest complete folder that has not expired."""
        for folder in reversed(self._children(place)):
            if self._age(folder) < self.expiry and self._fs.exists(self._path(f"{place}/{folder}/_SUCCESS")):
                return f"{place}/{folder}"
        return None

    def remove_old(self, name: str) -> list[str]:
        """Deletes the folders of ``name`` that are past removal; their paths."""
        gone = []
        for key in self._children(f"{self.base}/{name}"):
            place = f"{self.base}/{name}/{key}"
            folders = self._children(place)
            old = [f for f in folders if self._age(f) >= self.removal]
            for folder in old:
                self._fs.delete(self._path(f"{place}/{folder}"), True)
                gone.append(f"{place}/{folder}")
            if folders and len(old) == len(folders):
                self._fs.delete(self._path(place), False)
        return gone

    def table(self, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """``build()`` as a written table, found again while its inputs are the same."""
        df = build()
        key = hashlib.sha256((inputs_digest(self.spark, inputs) + df.schema.json()).encode()).hexdigest()[:32]
        place = f"{self.base}/{name}/{key}"
        found = self._found(place)
        if found is None:
            self.remove_old(name)
            found = f"{place}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(found)
        return self.spark.read.schema(df.schema).parquet(found)
