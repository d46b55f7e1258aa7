"""A sink that writes one file a row under a given name, for image folders, sidecars and saved responses.

A Python data source: tasks write their own rows, each first beside its place and then moved to it, so that a
task that is repeated writes the same files again and readers never see a part of one. Any store that pyarrow has a
file system for will do; the folder must be one that all executors reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    files: int


def file_system(folder: str):
    """The file system and path of a folder."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return system, base.rstrip("/")


def checked(name: str) -> str:
    """A name below a folder; names lead nowhere else."""
    if not name or name.startswith("/") or any(part in ("", ".", "..") for part in name.split("/")):
        raise ValueError(f"not a name of a file below the folder: {name!r}")
    return name


def place_of(folder: str, name: str):
    """The file system and path of a name below the folder."""
    name = checked(name)
    system, base = file_system(folder)
    return system, f"{base}/{name}"


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        n, made = 0, set()
        system, root = file_system(self.folder)
        for row in iterator:
            parent, base = f"{root}/{checked(row['name'])}".rsplit("/", 1)
            path = f"{parent}/{base}"
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            beside = f"{parent}/_{uuid.uuid4().hex}.{base}.tmp"
            with system.open_output_stream(beside) as out:
                out.write(bytes(row["content"] or b""))
            system.move(beside, path)
            n += 1
        return Written(n)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"])


def write_named(rows: DataFrame, folder: str, name: Column, content: Column) -> None:
    """A file ``folder/name`` for each row; content is binary, or text that is written as UTF-8. Names are unique; a file of the same name is replaced."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select(name.alias("name"), content.cast("binary").alias("content")).write.format("named_files").mode("append").save(folder)
