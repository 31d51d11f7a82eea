"""The data source ``permit_ledger``: appends that are whole or have not happened.

``df.write.format("permit_ledger").mode("append").save(path)`` and the same as a
stream's sink. A task writes its rows to Parquet files of its own, under a hidden
name until each is complete, and tells the driver their names, digests and sizes.
The commit adds one record to the log under the path (``history``); readers take
the files that records name and no others. So a failed task, a second attempt, a
crash before or within the commit leave at most files that nobody reads, and
nothing to undo before the next append. An aborted job removes its own files.

Options: ``expected``, the number that the batch must get, or the write fails
because another writer was faster; ``stream``, the name under which a streaming
query's batches are taken once, however often they are replayed (a streaming
write needs it).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from permitlake.sources.history import Folder, History

NAME = "permit_ledger"
FILE_ROWS = 2_000_000  #: so that a file's digest can be computed in one row


class _Hashing:
    """A file that is hashed as it is written."""

    def __init__(self, out) -> None:  # noqa: ANN001
        self.out, self.digest, self.closed = out, hashlib.sha256(), False

    def write(self, data: bytes) -> int:
        self.digest.update(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.out.close()

    def tell(self) -> int:
        return self.out.tell()

    def readable(self) -> bool:
        return False

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: pa.Schema, options: dict[str, str]) -> None:
        self.path, self.schema, self.file_rows = path, schema, int(options.get("file_rows", FILE_ROWS))
        self.expected = int(options["expected"]) if "expected" in options else None

    def folder(self) -> Folder:
        return Folder(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, out, open_file = self.folder(), Written(), None
        for batch in iterator:
            for at in range(0, batch.num_rows, self.file_rows):
                if open_file is None:
                    name = f"{uuid.uuid4().hex}.parquet"
                    sink = _Hashing(folder.output(f"_{name}"))
                    open_file = [name, sink, pq.ParquetWriter(pa.PythonFile(sink, mode="w"), self.schema), 0]
                part = batch.slice(at, self.file_rows)
                open_file[2].write_table(pa.Table.from_batches([part]).cast(self.schema))
                open_file[3] += part.num_rows
                if open_file[3] >= self.file_rows:
                    out.files.append(self._done(folder, open_file))
                    open_file = None
        if open_file is not None:
            out.files.append(self._done(folder, open_file))
        return out

    def _done(self, folder: Folder, open_file: list) -> dict:
        name, sink, writer, rows = open_file
        writer.close()
        sink.close()
        folder.move(f"_{name}", name)
        return {"name": name, "sha256": sink.digest.hexdigest(), "rows": rows}

    def commit(self, messages: list[Written | None]) -> None:
        History(self.folder()).append([f for m in messages if m for f in m.files], self.expected)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for f in m.files if m else ():
                self.folder().remove(f["name"])


class StreamWriter(BatchWriter, DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: pa.Schema, options: dict[str, str]) -> None:
        super().__init__(path, schema, options)
        self.stream = options["stream"]

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        History(self.folder()).append([f for m in messages if m for f in m.files], None, (self.stream, batchId))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        super().abort(messages)


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("the ledger is only appended to")
        return BatchWriter(self.options["path"], to_arrow_schema(schema), dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"], to_arrow_schema(schema), dict(self.options))
