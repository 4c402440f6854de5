"""``spark.read.format("voxel_regions")``: region files of a local folder or zip archive as a table.

One partition per region file or archive entry, so files outside the box or outside pushed
down ranges of rx and rz are never opened. For stores that only Spark reads see
``stratavox.sources.regions.discover``.
"""

from __future__ import annotations

import operator
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from stratavox.sources.regions import Box, coords_of

SCHEMA = "rx int, rz int, path string, content binary"
NAME = "voxel_regions"


@dataclass
class RegionPartition(InputPartition):
    """A file, or an entry of an archive."""

    rx: int
    rz: int
    path: str
    archive: str | None = None

    def read(self) -> bytes:
        if self.archive is None:
            with open(self.path, "rb") as f:
                return f.read()
        with zipfile.ZipFile(self.archive) as z:
            return z.read(self.path)


def find(path: str, box: Box) -> list[RegionPartition]:
    """Region files under a folder at any depth, or entries with ``region/r.`` of an archive, in order of their names."""
    if os.path.isfile(path):
        with zipfile.ZipFile(path) as z:
            named = [(n, path) for n in z.namelist() if n.endswith(".mca") and "region/r." in n]
    elif os.path.isdir(path):
        named = [(os.path.join(d, n), None) for d, _, names in os.walk(path) for n in names if n.endswith(".mca")]
    else:
        raise FileNotFoundError(path)
    found = [(coords_of(n), n, archive) for n, archive in named]
    return [RegionPartition(*c, n, archive) for c, n, archive in sorted(found, key=lambda f: f[1]) if c and box.has_region(*c)]


_TESTS = {
    "EqualTo": operator.eq,
    "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge,
    "LessThan": operator.lt,
    "LessThanOrEqual": operator.le,
    "In": lambda v, values: v in values,
}


class RegionReader(DataSourceReader):
    def __init__(self, path: str, box: Box):
        self.path, self.box = path, box
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes ranges, equalities and lists over rx and rz; yields the rest."""
        for f in filters:
            if type(f).__name__ in _TESTS and f.attribute in (("rx",), ("rz",)):
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, p: RegionPartition) -> bool:
        return all(_TESTS[kind](getattr(p, axis), value) for axis, kind, value in self.tests)

    def partitions(self) -> list[RegionPartition]:
        return [p for p in find(self.path, self.box) if self._wanted(p)]

    def read(self, partition: RegionPartition | None) -> Iterator[tuple]:
        if partition is not None and hasattr(partition, "rx"):
            yield partition.rx, partition.rz, partition.path, partition.read()


class RegionSource(DataSource):
    """Options: path; cx, cz (blocks) and radius (chunks) for a box."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RegionReader:
        o = self.options
        box = Box.around(int(o.get("cx", 0)), int(o.get("cz", 0)), int(o["radius"])) if "radius" in o else Box()
        return RegionReader(o["path"], box)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegionSource)
