"""A folder of saved pages as a stream that reads a file again when it has changed; Spark's file source reads each name once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Names of saved pages.
ENDINGS = (".html", ".htm", ".mhtml")


class _File(InputPartition):
    def __init__(self, path: str, changed: str):
        super().__init__(path)
        self.path, self.changed = path, changed


class _Reader(DataSourceStreamReader):
    """Offsets are {path: time of change in nanoseconds}; a batch is what is new or changed between two of them."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {}
        for at, folders, names in os.walk(self.folder):
            folders.sort()
            for name in sorted(names):
                path = os.path.join(at, name)
                if name.lower().endswith(ENDINGS):
                    try:
                        found[path] = str(os.stat(path).st_mtime_ns)
                    except FileNotFoundError:  # it went meanwhile
                        continue
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [_File(path, changed) for path, changed in after.items() if before.get(path) != changed]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            with open(partition.path, encoding="utf-8", errors="replace") as f:
                yield partition.path, int(partition.changed), f.read()
        except FileNotFoundError:
            return


class ChangedPages(DataSource):
    """Format ``changed_pages``: rows (url, changed_ns, html) of the option path, a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "changed_pages"

    def schema(self) -> str:
        return "url string, changed_ns long, html string"

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options["path"])


def changed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """New and changed pages of a folder as a stream of (url, changed_ns, html).

    A file that goes is no row, and comes as a new one if it is saved again.
    """
    spark.dataSource.register(ChangedPages)
    return spark.readStream.format("changed_pages").option("path", folder).load()
