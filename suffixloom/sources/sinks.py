"""Writers: parquet tables, and the two binary formats as part files.

The binary writers are a Spark data source: each task writes the bytes of its runs to a
part file whose name is the place of its first byte, so that the part files in the order
of their names are the single file.  Tasks write below ``_attempts``; what the successful
attempts wrote is moved into place when the job commits, so lost and repeated tasks leave
nothing.  Paths are local to all tasks (a shared folder) or a URI that pyarrow opens.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import Scratch, partitions_for

# A run is its length as little-endian unsigned 64 bit, then its symbol;
# a symbol takes one byte.
RUN_RECORD = "<QB"
RECORD_BYTES = struct.calcsize(RUN_RECORD)
LARGEST_SYMBOL = 255
LARGEST_CHARACTER = 127
CHUNK = 1 << 20
FORMAT = "suffixloom-bytes"
ATTEMPTS = "_attempts"


class SymbolTooLarge(ValueError):
    """A symbol that takes more than one byte."""


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``bwt_idx, ch`` or ``run_id, ch, run_len`` as a distributed parquet table."""
    df.write.mode(mode).parquet(path)


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):  # with one slash or three
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    at: int | None


def _records(sym: np.ndarray, run_len: np.ndarray):
    """The bytes of run records."""
    out = np.zeros(len(sym), np.dtype([("n", "<u8"), ("s", "u1")]))
    out["n"], out["s"] = run_len, sym
    yield out.tobytes()


def _symbols(sym: np.ndarray, run_len: np.ndarray):
    """The bytes that runs stand for, about ``CHUNK`` at a time."""
    ends, at = np.cumsum(run_len), 0
    while at < len(sym):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right"))
        if stop > at:
            yield np.repeat(sym[at:stop].astype(np.uint8), run_len[at:stop]).tobytes()
        else:  # one long run
            left, piece, stop = int(run_len[at]), bytes([int(sym[at])]) * CHUNK, at + 1
            while left:
                yield piece[:left]
                left -= min(left, CHUNK)
        at = stop


class ByteWriter(DataSourceArrowWriter):
    """Writes ``at, sym, run_len`` rows, which are sorted inside their partition, as bytes."""

    def __init__(self, path: str, records: bool):
        self.path, self.records = path, records

    def write(self, batches) -> Written:
        files, root = _files(self.path)
        attempt = f"{ATTEMPTS}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        first, out = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
                out, first = files.open_output_stream(f"{root}/{attempt}"), batch.column("at")[0].as_py()
            sym, run_len = batch.column("sym").to_numpy(), batch.column("run_len").to_numpy()
            for data in (_records if self.records else _symbols)(sym, run_len):
                out.write(data)
        if out is not None:
            out.close()
        return Written(attempt, first)

    def commit(self, messages) -> None:
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.at is not None:
                files.move(f"{root}/{m.attempt}", f"{root}/part-{m.at:020d}")
        self._clean(files, root)

    def abort(self, messages) -> None:
        self._clean(*_files(self.path))

    @staticmethod
    def _clean(files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{ATTEMPTS}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{ATTEMPTS}")


class ByteSink(DataSource):
    """``df.write.format("suffixloom-bytes")`` for rows ``at BIGINT, sym INT, run_len BIGINT``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> ByteWriter:
        return ByteWriter(self.options["path"], self.options.get("records", "false") == "true")


def _write(runs: DataFrame, path: str, records: bool, binary: bool, scratch: Scratch | None) -> None:
    """Check and order the runs and write them, each at the place where its bytes belong."""
    from pyarrow import fs

    spark = runs.sparkSession
    files, root = _files(path)
    if files.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    kept = (scratch or Scratch(spark)).save(runs.select("run_id", "bwt_idx", "sym", "run_len"), "written-runs")
    most = LARGEST_SYMBOL if binary else LARGEST_CHARACTER
    found = kept.agg(F.count("*").alias("n"), F.max("sym").alias("sym")).first()
    if found.n and found.sym > most:
        raise SymbolTooLarge(f"symbol {found.sym} does not fit one byte of {'bytes' if binary else 'text'}")
    parts = partitions_for(spark, found.n)
    per = -(-max(found.n, 1) // parts)
    at = F.col("run_id") * RECORD_BYTES if records else F.col("bwt_idx")
    spark.dataSource.register(ByteSink)
    (kept.repartitionById(parts, F.expr(f"cast(run_id div {per} as int)")).sortWithinPartitions("run_id")
     .select(at.alias("at"), "sym", "run_len")
     .write.format(FORMAT).option("path", path).option("records", str(records).lower()).mode("append").save())


def write_bwt_parts(runs: DataFrame, path: str, binary: bool = False, scratch: Scratch | None = None) -> None:
    """One byte per symbol, as part files below ``path``, a new folder.  ``binary``: the symbols are
    bytes of BINARY texts; else they are characters, and those beyond ASCII are refused."""
    _write(runs, path, False, binary, scratch)


def write_rl_bwt_parts(runs: DataFrame, path: str, binary: bool = False, scratch: Scratch | None = None) -> None:
    """9-byte run records, written like :func:`write_bwt_parts`."""
    _write(runs, path, True, binary, scratch)


def _ordered_runs(runs: DataFrame, binary: bool):
    most = LARGEST_SYMBOL if binary else LARGEST_CHARACTER
    for r in runs.select("run_id", "sym", "run_len").orderBy("run_id").toLocalIterator(prefetchPartitions=True):
        if r.sym > most:
            raise SymbolTooLarge(f"symbol {r.sym} does not fit one byte of {'bytes' if binary else 'text'}")
        yield r


def write_bwt_file(runs: DataFrame, path: str, binary: bool = False) -> None:
    """``<path>.bwt``: one byte per symbol.  Streams partition by partition to one
    local file, so it is an export for single-file consumers, not the way to keep
    large results; use :func:`write_bwt_parts` or :func:`write_table` for those."""
    with open(f"{path}.bwt", "wb") as out:
        for r in _ordered_runs(runs, binary):
            left = r.run_len
            while left:
                n = min(left, CHUNK)
                out.write(bytes([r.sym]) * n)
                left -= n


def write_rl_bwt_file(runs: DataFrame, path: str, binary: bool = False) -> None:
    """``<path>.rl_bwt``: 9-byte run records, exported like :func:`write_bwt_file`."""
    with open(f"{path}.rl_bwt", "wb") as out:
        for r in _ordered_runs(runs, binary):
            out.write(struct.pack(RUN_RECORD, r.run_len, r.sym))
