"""A Python data source for label points, planned by tiles, with the bounding box as pushed filters.

``spark.dataSource.register(LabelSource)``, then
``spark.read.format("kerbline_labels").option("path", ...).load().where("lat >= 40 and lat <= 41")``.
``path`` is a list of endpoints, parted by commas, of which each should hold the whole: folders, as absolute
paths or URIs of any store that Arrow opens (local, HDFS, S3, GCS).  An endpoint has JSON lines, in
files of its own or in folders named ``tile=<row>_<column>`` after floor(lat / size) and floor(lon / size),
where ``size`` is the option ``tile_deg``.

A tile is a partition.  Only tiles that the pushed box meets are listed and opened.  A tile is
read whole from the first endpoint that can be read; where it breaks, from the next one, so
no row is lost or doubled; when none can be read, the query fails.
A service behind HTTP is the same reader with another ``_lines``; this one needs no network.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

SCHEMA = "label_id long, label_type string, severity double, lat double, lon double"


class Tile(InputPartition):
    """The place of a tile, or of a file without one, below its endpoints."""

    def __init__(self, name: str):
        self.name = name


class LabelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoints = [p.strip().rstrip("/") for p in options["path"].split(",")]
        self.size = float(options.get("tile_deg", "0.02"))
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on lat and lon choose tiles and are applied while reading; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, LessThanOrEqual)) and f.attribute in (("lat",), ("lon",)):
                self.bounds.append((f.attribute[0], "ge" if isinstance(f, GreaterThanOrEqual) else "le", float(f.value)))
            else:
                yield f

    def _meets(self, name: str) -> bool:
        """Whether the box meets a tile; what is not a tile may hold anything."""
        if not name.startswith("tile="):
            return True
        try:
            place = dict(zip(("lat", "lon"), map(int, name.removeprefix("tile=").split("_")), strict=True))
        except ValueError:
            return True
        return all(place[c] >= math.floor(x / self.size) if kind == "ge" else place[c] <= math.floor(x / self.size) for c, kind, x in self.bounds)

    def partitions(self) -> list[Tile]:
        names, errors = set(), []
        for endpoint in self.endpoints:
            try:
                store, folder = FileSystem.from_uri(endpoint)
                found = store.get_file_info(FileSelector(folder))
            except OSError as e:
                errors.append(e)
                continue
            names |= {f.base_name for f in found if f.type == FileType.Directory or f.path.endswith(".jsonl")}
        if len(errors) == len(self.endpoints):
            raise errors[-1]
        return [Tile(n) for n in sorted(names) if not n.startswith((".", "_")) and self._meets(n)]

    def _lines(self, endpoint: str, name: str) -> list[str]:
        """All lines of a tile at one endpoint."""
        store, folder = FileSystem.from_uri(endpoint)
        info = store.get_file_info(f"{folder}/{name}")
        if info.type == FileType.NotFound:
            raise FileNotFoundError(f"{endpoint}/{name}")
        files = [info] if info.type == FileType.File else sorted(store.get_file_info(FileSelector(info.path)), key=lambda f: f.path)
        out: list[str] = []
        for f in files:
            if f.base_name.startswith((".", "_")):
                continue
            with store.open_input_stream(f.path) as stream:
                out += io.TextIOWrapper(stream, encoding="utf-8").readlines()
        return out

    def read(self, partition: Tile) -> Iterator[tuple]:
        error: Exception | None = None
        for endpoint in self.endpoints:
            try:
                lines = self._lines(endpoint, partition.name)
                break
            except (OSError, UnicodeDecodeError) as e:
                error = e
        else:
            raise error or FileNotFoundError(partition.name)
        for line in lines:
            try:
                r = json.loads(line)
            except ValueError:
                continue
            place = {"lat": r.get("lat"), "lon": r.get("lon")}
            if all(place[c] is not None and (place[c] >= x if kind == "ge" else place[c] <= x) for c, kind, x in self.bounds):
                yield r.get("label_id"), r.get("label_type"), r.get("severity"), place["lat"], place["lon"]


class LabelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kerbline_labels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LabelReader:
        return LabelReader(self.options)
