"""A Spark data source of source trees that never enters a folder which the rules leave out.

The driver lists the folders that are kept, level by level, and packs their files into partitions of about equal bytes;
tasks open the files of their partition.  A path is local or a URI that ``pyarrow.fs`` knows.  Links are not followed;
folders and files that cannot be read are left out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.operators import files

SCHEMA = "rel_path string, size long, modified timestamp, content binary"
#: A partition's bytes and files, bytes of a batch, folders that are listed at once.
PART_BYTES, PART_FILES, BATCH_BYTES, AT_ONCE = 32 << 20, 2000, 8 << 20, 16


@dataclass(frozen=True)
class Rules:
    """Which folders are entered and which files are kept; ``files.path_verdict`` as a plain function."""

    extensions: tuple[str, ...] | None = None
    dirs: tuple[str, ...] = files.SKIP_DIRS
    names: tuple[str, ...] = files.SKIP_FILES
    partials: tuple[str, ...] = files.SKIP_PARTS
    max_bytes: int | None = files.MAX_BYTES

    def enters(self, folder: str) -> bool:
        return folder not in self.dirs and not folder.startswith(".")

    def keeps(self, name: str, size: int) -> bool:
        end = name.rpartition(".")[2] if "." in name else ""
        return ((self.extensions is None or end in self.extensions) and name not in self.names and not any(p in name for p in self.partials)
                and (self.max_bytes is None or size <= self.max_bytes))


class Tree:
    """Lists and reads below a root."""

    def __init__(self, root: str):
        local = root.removeprefix("file://") if root.startswith("file:/") else root
        self.local = "://" not in local
        self.fs, self.root = (None, local.removeprefix("file:")) if self.local else fs.FileSystem.from_uri(root)
        self.root = self.root.rstrip("/") or "/"

    def entries(self, folder: str) -> list[tuple[str, bool, int, float]]:
        """(name, is a folder, size, modification time) of what is in a folder; links are left out."""
        at = f"{self.root}/{folder}" if folder else self.root
        try:
            if self.local:
                with os.scandir(at) as found:
                    kept = [e for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
                    return [(e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_size, e.stat(follow_symlinks=False).st_mtime) for e in kept]
            found = self.fs.get_file_info(fs.FileSelector(at))
            return [(e.base_name, e.type == fs.FileType.Directory, e.size or 0, e.mtime.timestamp() if e.mtime else 0.0) for e in found if e.type in (fs.FileType.Directory, fs.FileType.File)]
        except OSError:
            return []

    def content(self, path: str) -> bytes | None:
        try:
            if self.local:
                with open(f"{self.root}/{path}", "rb") as f:
                    return f.read()
            with self.fs.open_input_stream(f"{self.root}/{path}") as f:
                return f.read()
        except OSError:
            return None


def kept(tree: Tree, rules: Rules) -> Iterator[tuple[str, int, float]]:
    """(path, size, modification time) of the files that the rules keep, by folder; no other folder is listed."""
    level = [""]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while level:
            below = []
            for folder, entries in zip(level, pool.map(tree.entries, level), strict=True):
                for name, is_folder, size, modified in sorted(entries):
                    path = f"{folder}/{name}" if folder else name
                    if is_folder and rules.enters(name):
                        below.append(path)
                    elif not is_folder and rules.keeps(name, size):
                        yield path, size, modified
            level = below


def packed(found, bytes_: int = PART_BYTES, most: int = PART_FILES) -> list[list[tuple[str, int, float]]]:
    """Files into partitions that differ little in bytes: the largest file goes to the partition with the fewest bytes."""
    import heapq

    found = sorted(found, key=lambda f: (-f[1], f[0]))
    n = max(1, -(-sum(f[1] for f in found) // bytes_), -(-len(found) // most))
    parts: list[list] = [[] for _ in range(n)]
    heap = [(0, 0, k) for k in range(n)]  # bytes, files, partition
    for f in found:
        size, count, k = heapq.heappop(heap)
        parts[k].append(f)
        heapq.heappush(heap, (size + f[1], count + 1, k))
    return [sorted(p) for p in parts if p]


class Part(InputPartition):
    def __init__(self, listed):
        super().__init__(None)
        self.listed = listed


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.with_content = options["path"], options.get("content", "true") == "true"
        told = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(options.get("rules", "{}")).items()}
        self.rules = Rules(**told)
        self.bytes_ = int(options.get("partbytes", PART_BYTES))

    def partitions(self):
        return [Part(p) for p in packed(kept(Tree(self.root), self.rules), self.bytes_)] or [Part([])]

    def read(self, partition):
        tree, rows, size = Tree(self.root), [], 0
        for path, length, modified in partition.listed:
            content = tree.content(path) if self.with_content else None
            if self.with_content and content is None:
                continue  # it is gone
            rows.append((path, length, datetime.fromtimestamp(modified, timezone.utc), content))
            size += len(content or b"") + 200
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = [("rel_path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "quarry_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def tree(spark: SparkSession, root: str, rules: Rules = Rules(), content: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:  # noqa: B008
    """(rel_path, size, modified, content) of the files below ``root`` that the rules keep; without ``content`` no file is opened."""
    spark.dataSource.register(TreeSource)
    told = json.dumps({k: getattr(rules, k) for k in Rules.__dataclass_fields__})
    return spark.read.format("quarry_tree").option("rules", told).option("content", str(content).lower()).option("partbytes", part_bytes).load(root)
