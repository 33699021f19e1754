"""Deep Zoom folders as a Spark data source: tables of tiles are written to files and read back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .containers import manifest_xml
from .files import get, opened, put, remove

SCHEMA = "level int, col int, row_ int, bytes binary"


@dataclass
class Written(WriterCommitMessage):
    keys: tuple[tuple[int, int, int], ...]


class Column(InputPartition):
    def __init__(self, level: int, names: list[str]):
        self.level, self.names = level, names


class Writer(DataSourceWriter):
    """Tiles go to <folder>_files/<level>/<col>_<row>.<kind>; a tile that comes twice fails the job; the manifest commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind = options["path"].rstrip("/"), options.get("format", "png")
        self.tile, self.overlap = int(options.get("tileSize", 256)), int(options.get("overlap", 1))
        self.width, self.height = int(options["width"]), int(options["height"])
        if overwrite:
            remove(f"{self.path}_files")

    def write(self, rows) -> WriterCommitMessage:
        keys = []
        for r in rows:
            put(f"{self.path}_files/{r['level']}/{r['col']}_{r['row_']}.{self.kind}", [bytes(r["bytes"])])
            keys.append((r["level"], r["col"], r["row_"]))
        return Written(tuple(keys))

    def commit(self, messages) -> None:
        seen: set[tuple[int, int, int]] = set()
        for m in messages:
            for k in m.keys if m else ():
                if k in seen:
                    self.abort(messages)
                    raise ValueError("tile {} {}_{} was written twice".format(*k))
                seen.add(k)
        put(f"{self.path}.dzi", [manifest_xml(self.tile, self.overlap, self.kind, self.width, self.height).encode()])

    def abort(self, messages) -> None:
        remove(f"{self.path}_files")


class Reader(DataSourceReader):
    """One partition a level; with the option `levels` (0,2,5) only those are listed."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.levels = {int(x) for x in options["levels"].split(",")} if options.get("levels") else None
        manifest = get(f"{self.path}.dzi").decode()
        self.kind = re.search(r'Format="(\w+)"', manifest)[1]

    def partitions(self):
        from pyarrow import fs

        files, path = opened(f"{self.path}_files")
        out = []
        for info in files.get_file_info(fs.FileSelector(path)):
            level = int(info.base_name)
            if self.levels is None or level in self.levels:
                out.append(Column(level, [x.base_name for x in files.get_file_info(fs.FileSelector(info.path)) if x.base_name.endswith(f".{self.kind}")]))
        return out

    def read(self, partition):
        for name in partition.names:
            col, row = map(int, name.split(".")[0].split("_"))
            yield partition.level, col, row, get(f"{self.path}_files/{partition.level}/{name}")


class DeepZoom(DataSource):
    """df.write.format("deepzoom").option("width", ..).option("height", ..).save(uri); spark.read.format("deepzoom").load(uri)."""

    @classmethod
    def name(cls) -> str:
        return "deepzoom"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, overwrite)

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    from tessera.shipping import ship

    ship(spark)
    spark.dataSource.register(DeepZoom)
