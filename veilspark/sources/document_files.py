"""A sink that writes one file for each row, as a Spark data source with commit and abort.

Rows are (folder, file_name, content). A task writes below ``path``/_staging-<job>/<attempt>; when all tasks have succeeded, the commit moves each successful
attempt's folder to ``path``/part-<job>-<n>, one rename a task whatever the number of files; attempts that failed or were
run twice never become visible, and an abort removes the staging folder. Tasks may still run when the job is aborted: the job makes the staging folder with a
mark in it, a task never makes that folder and leaves nothing once the mark is gone. Files are at ``path``/part-*/<folder>/<file_name>.

Paths are those of any file system that Arrow knows by its address (file, hdfs, s3 and others).

Defined cases: null content is an empty file; characters that file names can't hold become "_", as do "." and "..", null or
blank folders and names are "_"; of rows with one folder and name in a task the later ones get a number; no rows give no file.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "folder string, file_name string, content string"
OPEN = "_open"  # the mark of a job that was not aborted


def located(path: str):
    """The file system of a path or address, and the path there."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + re.sub("^(?:file:)?/*", "", path)
    return fs.FileSystem.from_uri(path)


def _files(path: str):
    system, root = located(path)
    return system, root.rstrip("/")


def _is(system, place: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(place).type != fs.FileType.NotFound


def _part(name: str | None) -> str:
    clean = re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", name or "").strip()
    return "_" if clean in ("", ".", "..") else clean


@dataclass
class Written(WriterCommitMessage):
    """What a successful attempt left in the staging folder."""

    attempt: str
    n_files: int


class DocumentFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex
        system, root = _files(path)
        system.create_dir(f"{root}/{self.staging}", recursive=True)
        with system.open_output_stream(f"{root}/{self.staging}/{OPEN}"):
            pass

    @property
    def staging(self) -> str:
        return f"_staging-{self.job}"

    def write(self, iterator) -> Written:
        system, root = _files(self.path)
        attempt, used = uuid.uuid4().hex, {}
        own = f"{root}/{self.staging}/{attempt}"
        for row in iterator:
            folder, name = _part(row[0]), _part(row[1])
            nth = used[folder, name] = used.get((folder, name), 0) + 1
            if nth > 1:
                stem, dot, end = name.rpartition(".")
                name = f"{stem}_{nth}.{end}" if dot else f"{name}_{nth}"
            place = f"{own}/{folder}"
            for made in (own, place):
                system.create_dir(made, recursive=False)
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write((row[2] or "").encode("utf-8"))
            if not _is(system, f"{root}/{self.staging}/{OPEN}"):  # where a file makes its folders again, it goes with them
                if _is(system, own):
                    system.delete_dir(own)
                raise RuntimeError("the job was aborted")
        return Written(attempt, sum(used.values()))

    def commit(self, messages) -> None:
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        for n, done in enumerate(m for m in messages if m is not None and m.n_files):
            system.move(f"{root}/{self.staging}/{done.attempt}", f"{root}/part-{self.job}-{n}")
        self._clear(system, root)

    def abort(self, messages) -> None:
        self._clear(*_files(self.path))

    def _clear(self, system, root: str) -> None:
        staging = f"{root}/{self.staging}"
        if _is(system, f"{staging}/{OPEN}"):
            system.delete_file(f"{staging}/{OPEN}")
        for tries in range(20, -1, -1):  # a task that still runs may add a file while the folder is emptied
            if not _is(system, staging):
                return
            try:
                system.delete_dir(staging)
            except OSError:
                if not tries:
                    raise
                time.sleep(0.05)


class DocumentFiles(DataSource):
    """``df.write.format("document_files").mode("append").save(path)``"""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DocumentFilesWriter:
        if overwrite:
            raise ValueError("document files are only added")
        return DocumentFilesWriter(self.options["path"])


def write_documents(rows: DataFrame, path: str) -> None:
    """Adds one file for each row (folder, file_name, content)."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    rows.select("folder", "file_name", "content").write.format(DocumentFiles.name()).mode("append").save(path)


def read_documents(spark, path: str) -> DataFrame:
    """folder, file_name, content of the files that are committed."""
    from pyspark.sql import functions as F

    files = spark.read.option("recursiveFileLookup", True).text(f"{path.rstrip('/')}/part-*", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.url_decode(F.element_at(parts, -2)).alias("folder"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))
