"""A sink for rows that are files: each row's bytes become a file of the row's name, whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from viaduct.session import ready

SUCCESS = "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class NamedFilesWriter(DataSourceWriter):
    """Writes each file under another name first and moves it when it is whole, so readers never see a part of one.

    A task that runs again, or a job that does, puts the same files in the same places. The driver marks the folder when
    all tasks have told how much they wrote; a failed job leaves no mark.
    """

    def __init__(self, path: str):
        self.path = path

    def _folder(self):
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        system, folder = self._folder()
        made: set[str] = set()
        files = size = 0
        for name, content in iterator:
            place, _, base = f"{folder}/{name}".rpartition("/")
            if place not in made:
                system.create_dir(place, recursive=True)
                made.add(place)
            draft = f"{place}/.{base}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(bytes(content))
            system.move(draft, f"{place}/{base}")
            files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list) -> None:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        told = [m for m in messages if m is not None]
        with system.open_output_stream(f"{folder}/{SUCCESS}") as out:
            out.write(f"{sum(m.files for m in told)} files, {sum(m.bytes for m in told)} bytes\n".encode())

    def abort(self, messages: list) -> None:
        system, folder = self._folder()
        if system.get_file_info(f"{folder}/{SUCCESS}").type == fs.FileType.File:
            system.delete_file(f"{folder}/{SUCCESS}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write ``files(name, content)`` below ``path``, on this machine or any file system that pyarrow knows.

    Names are relative and may have folders; of rows of one name any stays. Files of other names are left as they are.
    """
    ready(files.sparkSession).dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").mode("append").option("path", path).save()
