"""Page files as a data source: one file per row, staged by tasks and moved into place by the driver.

``df.write.format("page_files").mode("append").save(folder)`` takes (``rel_path``, ``text``). A task writes
into a staging folder of its own below the target; when all tasks have ended well the driver moves the
files to their names. A task that dies leaves nothing but staging, and of a repeated task only the attempt
that reports counts. Files of the same name are replaced, others stay; mode ``overwrite`` (a full
rebuild) also removes page files that were not written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MOVERS = 16


def _file_system(path: str):
    """File system and plain path of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _checked(rel_path: str | None) -> str:
    parts = (rel_path or "").split("/")
    if not rel_path or rel_path.startswith("/") or any(p in ("", ".", "..") or p.startswith("_staging-") for p in parts):
        raise ValueError(f"not a path below the folder: {rel_path!r}")
    return rel_path


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str] = field(default_factory=list)


class PageFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = _file_system(self.staging)
        staged = Staged(f"task-{uuid.uuid4().hex}")
        made, seen = set(), set()
        for batch in iterator:
            for rel_path, text in zip(batch.column("rel_path").to_pylist(), batch.column("text").to_pylist()):
                name = f"{root}/{staged.folder}/{_checked(rel_path)}"
                parent = name.rsplit("/", 1)[0]
                if parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                with files.open_output_stream(name) as out:
                    out.write((text or "").encode())
                if rel_path not in seen:
                    staged.names.append(rel_path)
                    seen.add(rel_path)
        return staged

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = _file_system(self.path)
        staging = _file_system(self.staging)[1]
        # A name that two tasks wrote goes to the later of them, and is moved once.
        target = {name: m.folder for m in messages if m is not None for name in m.names}
        for parent in sorted({f"{root}/{name}".rsplit("/", 1)[0] for name in target}):
            files.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(lambda item: files.move(f"{staging}/{item[1]}/{item[0]}", f"{root}/{item[0]}"), target.items()))
        if self.overwrite:
            from pyarrow import fs

            for found in files.get_file_info(fs.FileSelector(root, recursive=True)):
                name = found.path.removeprefix(root).lstrip("/")
                if found.type == fs.FileType.File and name.endswith(".md") and name not in target and not name.startswith("_staging-"):
                    files.delete_file(found.path)
        self._drop_staging()

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        from pyarrow import fs

        files, staging = _file_system(self.staging)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> PageFilesWriter:
        if not {"rel_path", "text"} <= set(schema.fieldNames()):
            raise ValueError("page files need rel_path and text")
        return PageFilesWriter(self.options["path"], overwrite)


def write_page_files(spark: SparkSession, pages: DataFrame, folder: str, full_rebuild: bool = False) -> None:
    """Write (``rel_path``, ``text``) rows to files below ``folder``."""
    spark.dataSource.register(PageFiles)
    pages.select("rel_path", "text").write.format("page_files").mode("overwrite" if full_rebuild else "append").save(folder)
