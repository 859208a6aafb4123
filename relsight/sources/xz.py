"""xz text as a Spark data source: several tasks read a file, by the blocks that its index lists, and each task writes a file of several blocks.

The index stands at a stream's end and gives the sizes of its blocks. A
partition is a run of blocks; it decodes each from the stream's header and
the block's own bytes, a piece at a time. A line belongs to the partition in
which the line break before it lies, which reads on into the blocks after it;
so all but a file's first partition begin after their first line break.
Files without an index (lzma) are one partition.
"""

from __future__ import annotations

import json
import lzma
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "relsight_xz"
MAGIC = b"\xfd7zXZ\0"
#: Decoded bytes of a partition, and bytes that are decoded at a time.
PARTITION, STEP = 64 << 20, 1 << 20
#: Text bytes of a stream that the writer makes.
STREAM = 16 << 20


def opened(path: str) -> pa.NativeFile:
    """A file of any file system that Arrow knows; Hadoop writes local ones with one slash."""
    local = path.removeprefix("file://").removeprefix("file:")
    where, at = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return where.open_input_file(at)


def number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number of an index, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def blocks(file: pa.NativeFile) -> list[tuple[int, int, int, int]] | None:
    """The blocks of all streams of a file: stream, start, size and decoded size; nothing for a file of another format."""
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        return None

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    found, end = [], file.size()
    while end > 0:
        if read(end - 4, 4) == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        footer = read(end - 12, 12)
        if footer[-2:] != b"YZ":
            raise lzma.LZMAError("no stream ends here")
        size = (int.from_bytes(footer[4:8], "little") + 1) * 4
        index = read(end - 12 - size, size)
        records, at = number(index, 1)
        sizes = []
        for _ in range(records):
            unpadded, at = number(index, at)
            plain, at = number(index, at)
            sizes.append(((unpadded + 3) // 4 * 4, plain))
        start = end - 12 - size - sum(s for s, _ in sizes)
        own, stream = [], start - 12
        for packed, plain in sizes:
            own.append((stream, start, packed, plain))
            start += packed
        found, end = own + found, stream
    return found


def decoded(file: pa.NativeFile, run: list[tuple[int, int, int, int]] | None) -> Iterator[bytes]:
    """The text of a run of blocks, or of a whole file without an index."""
    if run is None:
        file.seek(0)
        yield from unpacked(file, file.size(), lzma.LZMADecompressor())
    for stream, start, size, _ in run or []:
        unpack = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        file.seek(stream)
        unpack.decompress(file.read(12))
        file.seek(start)
        yield from unpacked(file, size, unpack)


def unpacked(file: pa.NativeFile, size: int, unpack: lzma.LZMADecompressor) -> Iterator[bytes]:
    while (size or not unpack.needs_input) and not unpack.eof:
        fed = file.read(min(size, STEP)) if unpack.needs_input else b""
        if unpack.needs_input and not fed:
            raise EOFError("the file ends within a block")
        size -= len(fed)
        if piece := unpack.decompress(fed, max_length=4 * STEP):
            yield piece


class Blocks(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.raw, self.size = json.loads(options["paths"]), options.get("raw") == "true", int(options.get("partition", PARTITION))

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self.paths:
            with opened(path) as file:
                found = blocks(file)
            if found is None:
                out.append(Blocks(path, -1, -1))
                continue
            first = held = 0
            for i, block in enumerate(found):
                held += block[3]
                if held >= self.size or i == len(found) - 1:
                    out.append(Blocks(path, first, i + 1))
                    first, held = i + 1, 0
        # Spark asks for one partition at least.
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as file:
            found = blocks(file)
            run = None if found is None else found[partition.first : partition.last]
            after = [] if found is None else found[partition.last :]
            for lines in self.lines(file, run, after, partition.first > 0):
                n = len(lines)
                yield pa.record_batch([pa.array(lines, pa.string()), pa.repeat(partition.path, n), pa.repeat(pa.scalar(max(partition.first, 0), pa.int64()), n)], names=["value", "file", "block"])

    def cut(self, text: bytes) -> list[str]:
        """The lines of a text that ends with a line break, a piece at a time."""
        found = text.decode("utf-8", "replace")
        if not self.raw and "\r" in found:
            found = found.replace("\r\n", "\n").replace("\r", "\n")
        return found.split("\n")[:-1]

    def lines(self, file: pa.NativeFile, run: list | None, after: list, skipping: bool) -> Iterator[list[str]]:
        rest: list[bytes] = []
        for piece in decoded(file, run):
            if skipping:
                at = piece.find(b"\n")
                if at < 0:
                    continue
                piece, skipping = piece[at + 1 :], False
            at = piece.rfind(b"\n") + 1
            if at:
                yield self.cut(b"".join([*rest, piece[:at]]))
                rest = []
            rest.append(piece[at:])
        if skipping:
            return
        for piece in decoded(file, after):
            at = piece.find(b"\n")
            rest.append(piece if at < 0 else piece[:at])
            if at >= 0:
                yield self.cut(b"".join([*rest, b"\n"]))
                return
        if line := b"".join(rest):
            yield self.cut(line + b"\n")


def compressed(text: bytes) -> bytes:
    """One stream. Hash chains a few links deep take half the time of the preset's trees. Edges came out as small, other text up to a quarter larger; a longer dictionary than the text would find no more."""
    return lzma.compress(text, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "mf": lzma.MF_HC4, "depth": 4, "dict_size": max(4096, len(text))}])


class Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class Writer(DataSourceArrowWriter):
    """A file a task, under a hidden name until all tasks are done."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.stream, self.head = options["path"], int(options.get("stream", STREAM)), options.get("head", "")

    def where(self) -> tuple[fs.FileSystem, str]:
        local = self.folder.removeprefix("file://").removeprefix("file:")
        return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = self.where()
        where.create_dir(folder, recursive=True)
        path = f"{folder}/.part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.xz"
        held = f"{self.head}\n".encode() if self.head else b""
        with where.open_output_stream(path) as out:
            for batch in iterator:
                lines = batch.column("value").fill_null("").to_pylist()
                held, at = held + "".join([f"{x}\n" for x in lines]).encode(), 0
                while len(held) - at >= self.stream:
                    end = held.index(b"\n", at + self.stream - 1) + 1
                    out.write(compressed(held[at:end]))
                    at = end
                held = held[at:]
            out.write(compressed(held))
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = self.where()
        for m in messages:
            if m:
                where.move(m.path, f"{folder}/{m.path.rsplit('/', 1)[-1].removeprefix('.')}")

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = self.where()
        for m in messages:
            if m:
                where.delete_file(m.path)


class XzText(DataSource):
    """value, file and block (the partition's first block) of xz and lzma text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, file string, block long"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read_xz(spark: SparkSession, paths: list[str], raw: bool = False, partition: int = PARTITION) -> DataFrame:
    """Lines of xz or lzma files; ``raw`` ones end at line feeds only."""
    spark.dataSource.register(XzText)
    return spark.read.format(NAME).options(paths=json.dumps(paths), raw=str(raw).lower(), partition=partition).load()


def write_xz(lines: DataFrame, folder: str, stream: int = STREAM, head: str = "") -> None:
    """One xz file a partition, of streams of about ``stream`` bytes of text each; ``head``, if given, is the first line of each file."""
    lines.sparkSession.dataSource.register(XzText)
    lines.select("value").write.format(NAME).mode("append").options(path=folder, stream=stream, head=head).save()
