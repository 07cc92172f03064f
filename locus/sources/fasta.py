"""A data source that writes sequences as FASTA and their metadata as CSV, part by part, in one pass."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Characters that a part holds before it passes them to its file.
CHUNK = 1 << 20


def _store(path: str):
    """The file system of a path and the path in it; local folders or any store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int


class FastaWriter(DataSourceWriter):
    """Parts go to a folder of the job's own; the commit moves them to sequences/ and metadata/.

    A part's name holds its partition and attempt, and only parts whose message the commit gets
    are moved, so what a lost or repeated task left behind is not seen.
    """

    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path.rstrip("/"), [f.name for f in schema.fields]
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}"
        store, root = _store(f"{self.path}/_{self.job}")
        store.create_dir(root, recursive=True)
        meta = [c for c in self.columns if c not in ("seq_id", "seq")]
        n = 0
        with store.open_output_stream(f"{root}/{part}.fasta") as fasta, store.open_output_stream(f"{root}/{part}.csv") as table:
            text, lines = [], io.StringIO()
            out = csv.writer(lines, lineterminator="\n")
            out.writerow(["peak_id", *meta])
            size = 0
            for row in rows:
                text.append(f">{row['seq_id']}\n{row['seq'] or ''}\n")
                out.writerow([row["seq_id"], *["" if row[c] is None else row[c] for c in meta]])
                n, size = n + 1, size + len(text[-1])
                if size >= CHUNK:
                    fasta.write("".join(text).encode())
                    table.write(lines.getvalue().encode())
                    text, size = [], 0
                    lines.seek(0)
                    lines.truncate()
            fasta.write("".join(text).encode())
            table.write(lines.getvalue().encode())
        return Written(part, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for folder in ("sequences", "metadata.csv"):
            store.create_dir(f"{root}/{folder}", recursive=True)
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{root}/_{self.job}/{m.part}.csv", f"{root}/metadata.csv/{m.part}.csv")
                store.move(f"{root}/_{self.job}/{m.part}.fasta", f"{root}/sequences/{m.part}.fasta")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_{self.job}")


class FastaWithMetadata(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_with_metadata"

    def writer(self, schema: StructType, overwrite: bool) -> FastaWriter:
        if overwrite:
            raise ValueError("only appends")
        return FastaWriter(self.options["path"], schema)
