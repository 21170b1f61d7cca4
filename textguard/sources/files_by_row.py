"""A sink that writes one file for each row, named by the row: ``df.write.format("textguard_files").save(path)``.

Rows are (folder, file, body). Tasks write below a folder of their own job, and only the commit of the whole job moves the files
to folder/file; a job that fails removes what its tasks wrote, so nothing of it is seen. With ``mode("overwrite")`` files of
the same name are replaced, others stay; ``append`` refuses names that exist. Of rows with equal names the first by body counts, as the caller
dedups them (see ``write_files``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """(place while the job runs, name in the end) of the files of a task."""

    files: list[tuple[str, str]]


def checked(part: str | None) -> str:
    """A name that cannot leave its folder."""
    if not part or part in (".", "..") or "/" in part or "\\" in part or "\0" in part:
        raise ValueError(f"no file name: {part!r}")
    return part


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def _system(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        system, top = self._system()
        own, files = f"{top}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for n, row in enumerate(iterator):
            staged = f"{own}/{n}"
            with system.open_output_stream(staged) as out:
                out.write((row["body"] or "").encode())
            files.append((staged, f"{checked(row['folder'])}/{checked(row['file'])}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = self._system()
        files = sorted((name, staged) for m in messages if m for staged, name in m.files)
        names = [name for name, _ in files]
        there = {f.path for f in system.get_file_info([f"{top}/{n}" for n in names]) if f.type != fs.FileType.NotFound} if names else set()
        if len(set(names)) < len(names) or (there and not self.overwrite):
            self.abort(messages)
            raise FileExistsError(f"{len(there)} files exist, {len(names) - len(set(names))} names come again")
        for folder in sorted({n.partition("/")[0] for n in names}):
            system.create_dir(f"{top}/{folder}", recursive=True)
        for name, staged in files:
            system.move(staged, f"{top}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, top = self._system()
        if system.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.job}")


class FilesByRow(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textguard_files"

    def schema(self) -> str:
        return "folder string, file string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str) -> None:
    """Write rows (folder, file, body) as files, in place of those of the same name; of equal names the smallest body counts."""
    files.sparkSession.dataSource.register(FilesByRow)
    one = files.groupBy("folder", "file").agg(F.min("body").alias("body"))
    one.select("folder", "file", "body").write.format("textguard_files").mode("overwrite").save(path)
