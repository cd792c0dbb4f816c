"""Version manifests as a streaming source whose offsets are the versions themselves.

A folder holds manifests as source=<name>/code=<version>/<file>.json, as Spark writes them. The offset of a stream is the highest version of
each source, so the checkpoint is the watermark: a restart goes on behind the versions that the last finished batch has seen, and
repeats the batch that was under way. Each batch has one partition a source; its versions come in rising order. A manifest
below its source's offset is not read any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, code long, version_name string, manifest string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _listed(path: str) -> dict[str, list[int]]:
    """Each source's versions, rising."""
    fs, root = _open(path)
    out: dict[str, list[int]] = {}
    for source in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if source.type == pafs.FileType.Directory and source.base_name.startswith("source="):
            codes = [x.base_name.partition("=")[2] for x in fs.get_file_info(pafs.FileSelector(source.path)) if x.base_name.startswith("code=")]
            out[source.base_name.partition("=")[2]] = sorted(int(c) for c in codes if c.lstrip("-").isdigit())
    return out


@dataclass
class Versions(InputPartition):
    """The versions of a source above `after`, up to `upto`."""

    source: str
    after: int | None
    upto: int


class ManifestReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: codes[-1] for s, codes in _listed(self.path).items() if codes}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Versions(s, start.get(s), upto) for s, upto in sorted(end.items()) if start.get(s) is None or start[s] < upto]

    def read(self, partition: Versions) -> Iterator[tuple]:
        fs, root = _open(self.path)
        for code in _listed(self.path).get(partition.source, []):
            if (partition.after is None or code > partition.after) and code <= partition.upto:
                found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(f"{root}/source={partition.source}/code={code}")) if x.base_name.endswith(".json"))
                for path in found:
                    with fs.open_input_stream(path) as f:
                        text = f.read().decode()
                    for line in filter(None, text.splitlines()):
                        yield partition.source, code, json.loads(line).get("version_name"), line


class ManifestSource(DataSource):
    """spark.readStream.format("manifests").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "manifests"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ManifestReader(self.options["path"])


def manifest_stream(spark: SparkSession, folder: str):
    """A stream of (source, code, version_name, manifest)."""
    spark.dataSource.register(ManifestSource)
    return spark.readStream.format("manifests").load(folder)
