"""A committing sink for trees of files: `df.write.format("strata_tree").mode("append").save(root)` of (path, content).

Each task writes its files, and a list of them, into a staging folder of its own attempt under the root. When all tasks
are done, the driver moves the files of those attempts that count to their paths and removes the
staging folder of the job; an abort only removes it. So a task that runs twice, or a job that fails,
leaves no file and no half of one; files that the tree has keep their old content until then.
Folders that begin with _ are not read by Spark's file sources. Any store works that Arrow can open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files that the driver moves at a time.
MOVERS = 16


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if urlparse(root).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(root).path.rstrip("/")
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")


def safe_path(path: str) -> str:
    """A path inside the tree; anything else is refused."""
    parts = path.split("/")
    if not path or any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_"):
        raise ValueError(f"no path inside a tree: {path!r}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    """The attempt whose files count, and how many they are; their paths are in its list."""

    attempt: str
    files: int


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = store_of(self.root)
        attempt, n = uuid.uuid4().hex, 0
        folder = f"{root}/{self.job}/{attempt}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/paths") as paths:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    with store.open_output_stream(f"{folder}/{n}") as out:
                        out.write(content.as_buffer() if content.is_valid else b"")
                    paths.write(safe_path(path).encode() + b"\n")
                    n += 1
        return Staged(attempt, n)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.root)
        made: set[str] = set()

        def move(staged: str, path: str) -> None:
            folder = f"{root}/{path}".rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            store.move(staged, f"{root}/{path}")

        with ThreadPoolExecutor(MOVERS) as pool:
            for message in filter(None, messages):
                folder = f"{root}/{self.job}/{message.attempt}"
                with store.open_input_stream(f"{folder}/paths") as f:
                    paths = f.read().decode().splitlines()
                for done in [pool.submit(move, f"{folder}/{i}", p) for i, p in enumerate(paths)]:
                    done.result()
        self.abort([])

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.root)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class TreeSource(DataSource):
    """The sink by its name; trees are read by emit.read_tree()."""

    @classmethod
    def name(cls) -> str:
        return "strata_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree is only appended to; files of the same path are replaced")
        if [f.name for f in schema.fields] != ["path", "content"]:
            raise ValueError("a tree is written from (path, content)")
        return TreeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
