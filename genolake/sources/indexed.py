"""Tab-separated text in compressed blocks with an index by position: a Spark data source that reads regions and writes files.

A file is a row of gzip members, each of at most 64 kB of text, that say their own
size; beside it stands an index (.tbi) from bins of positions to the places of
lines, as block and place in the block.  A scan of a region opens only the blocks
of its bins; a whole scan is cut into partitions at places that the index names.

    spark.dataSource.register(indexed.IndexedText)
    spark.read.format("indexed_text").schema("chr string, pos int, cell_ref int").option("region", "chr1:1-5000000").load(path)
    df.sortWithinPartitions("chr", "pos").write.format("indexed_text").mode("append").save(folder)

Only the columns of the schema are parsed.  Files are opened by pyarrow's file
systems, from the tasks, so that any store that those reach can hold them.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Fixed values of the format: text of a block, the empty last block, bits of the smallest bin and levels above it, the summary's bin, the flag of positions from 0.
BLOCK_TEXT = 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SMALL, LEVELS, SUMMARY, FROM_ZERO = 14, 5, 37450, 0x10000

#: The end of an index's name until its job has ended.
WAITING = ".tbi.waiting"


def level_starts() -> list[int]:
    """The number of the first bin of each level, the widest first: 1, 8, 64 .. bins."""
    return [(8**k - 1) // 7 for k in range(LEVELS + 1)]


def bin_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds [start, end), from 0."""
    out, last = np.zeros(len(start), np.int64), end - 1
    for level, first in enumerate(level_starts()):
        shift = SMALL + 3 * (LEVELS - level)
        out = np.where(start >> shift == last >> shift, first + (start >> shift), out)
    return out


def bins_over(start: int, end: int) -> set[int]:
    """All bins that reach into [start, end)."""
    out: set[int] = set()
    for level, first in enumerate(level_starts()):
        shift = SMALL + 3 * (LEVELS - level)
        out.update(range(first + (start >> shift), first + (end - 1 >> shift) + 1))
    return out


@dataclass
class Index:
    """names: chromosomes in order; bins: for each, bin to (begin, end) places; linear: for each, the first place of each window."""

    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[list[int]]
    columns: tuple[int, int, int] = (1, 2, 0)
    kind: int = 0
    skip: int = 0

    def to_bytes(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        out = [b"TBI\1", struct.pack("<8i", len(self.names), self.kind, *self.columns, ord("#"), self.skip, len(names)), names]
        for bins, linear in zip(self.bins, self.linear, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out += [struct.pack("<Ii", number, len(chunks)), *(struct.pack("<2Q", *c) for c in chunks)]
            out += [struct.pack("<i", len(linear)), struct.pack(f"<{len(linear)}Q", *linear)]
        return b"".join(out)

    @classmethod
    def of_bytes(cls, data: bytes) -> Index:
        at = 0

        def take(form: str):
            nonlocal at
            got = struct.unpack_from("<" + form, data, at)
            at += struct.calcsize("<" + form)
            return got

        if take("4s")[0] != b"TBI\1":
            raise ValueError("not an index of block-compressed text")
        count, kind, c0, c1, c2, _, skip, length = take("8i")
        names = [n.decode() for n in take(f"{length}s")[0].split(b"\0")[:count]]
        out = cls(names, [], [], (c0, c1, c2), kind, skip)
        for _ in range(count):
            bins: dict[int, list[tuple[int, int]]] = {}
            for _ in range(take("i")[0]):
                number, chunks = take("Ii")
                flat = take(f"{2 * chunks}Q")
                bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
            bins.pop(SUMMARY, None)
            out.bins.append(bins)
            out.linear.append(list(take(f"{take('i')[0]}Q")))
        return out

    def region(self, name: str, start: int, end: int) -> list[tuple[int, int]]:
        """Places of all lines that may reach into positions start to end, from 1, put together where they touch."""
        if name not in self.names or end < start:
            return []
        k = self.names.index(name)
        low, high = max(0, start - 1), min(max(end, 1), 1 << (SMALL + 3 * LEVELS))
        if low >= high:
            return []
        linear, window = self.linear[k], low >> SMALL
        least = linear[min(window, len(linear) - 1)] if linear else 0
        wanted = bins_over(low, high)
        chunks = sorted((max(a, least), b) for number, each in self.bins[k].items() if number in wanted for a, b in each if b > least)
        return joined(chunks)

    def places(self) -> list[tuple[int, int]]:
        """All lines, as pieces that begin at every place the index names."""
        chunks = sorted(c for bins in self.bins for each in bins.values() for c in each)
        if not chunks:
            return []
        begins = sorted({a for a, _ in chunks} | {x for linear in self.linear for x in linear if x >= chunks[0][0]})
        return list(zip(begins, [*begins[1:], max(b for _, b in chunks)], strict=True))


def joined(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in chunks:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def packed(pieces: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Pieces in groups of about so many compressed bytes; a group's pieces are put together where they touch."""
    out: list[list[tuple[int, int]]] = []
    full = size
    for a, b in pieces:
        if full >= size:
            out.append([])
            full = 0
        out[-1].append((a, b))
        full += max(1, (b >> 16) - (a >> 16))
    return [joined(group) for group in out]


def member(text: bytes, level: int = 6) -> bytes:
    """One block of the file."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(text), len(text))


def members(stream, begin: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place in the file, text) of the blocks from ``begin`` to the one at ``end``."""
    stream.seek(begin)
    place = begin
    while end is None or place <= end:
        head = stream.read(18)
        if len(head) < 18:
            return
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not block-compressed text")
        extra = struct.unpack_from("<H", head, 10)[0]
        field_ = head[12:18] if extra == 6 else None
        if field_ is None or field_[:2] != b"BC":
            more = head[12:] + stream.read(extra - 6)
            at = 0
            while more[at : at + 2] != b"BC":
                at += 4 + struct.unpack_from("<H", more, at + 2)[0]
            size = struct.unpack_from("<H", more, at + 4)[0] + 1
        else:
            size = struct.unpack("<H", field_[4:])[0] + 1
        body = stream.read(size - 12 - extra)
        yield place, zlib.decompress(body[:-8], -15)
        place += size


def text_of(stream, pieces: list[tuple[int, int]]) -> Iterator[bytes]:
    """The whole lines of each piece."""
    for a, b in pieces:
        parts = []
        for place, text in members(stream, a >> 16, b >> 16):
            high = b & 0xFFFF if place == b >> 16 else len(text)
            parts.append(text[a & 0xFFFF if place == a >> 16 else 0 : high])
        yield b"".join(parts)


def first_lines(stream, skip: int = 0) -> str:
    """The names of the columns: the last line that begins with #, or the last of the lines that the index skips."""
    rest = b""
    last = None
    for _, text in members(stream, 0):
        *lines, rest = (rest + text).split(b"\n")
        for line in lines:
            if not line.startswith(b"#") and skip <= 0:
                return (last or b"").decode().lstrip("#")
            last, skip = line, skip - 1
    return (last or b"").decode().lstrip("#")


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[str]:
    """The file itself, or the compressed files of a folder in order; one without an index isn't finished."""
    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    there = {f.base_name for f in where.get_file_info(fs.FileSelector(at))}
    return [f"{path.rstrip('/')}/{name}" for name in sorted(there) if name.endswith(".gz") and f"{name}.tbi" in there]


def load_index(path: str) -> Index:
    where, at = store(path + ".tbi")
    with where.open_input_file(at) as stream:
        return Index.of_bytes(b"".join(text for _, text in members(stream, 0)))


def parse_region(text: str) -> tuple[str, int, int]:
    """chr, or chr:start-end."""
    name, colon, span = text.rpartition(":")
    if not colon:
        return text, 1, 1 << 29
    start, dash, end = span.replace(",", "").partition("-")
    if not (start.isdigit() and dash and end.isdigit()):
        raise ValueError(f"a region is chr or chr:start-end, not {text}")
    return name, int(start), int(end)


@dataclass
class Piece(InputPartition):
    """Places of one file, and which columns are chromosome and position; without places nothing is read."""

    path: str = ""
    pieces: list[tuple[int, int]] = field(default_factory=list)
    chromosome_at: int = 0
    position_at: int = 1
    skip: int = 0


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.schema = path, schema
        self.split = int(options.get("splitBytes", 16 << 20))
        self.names = options["names"].split("\t") if options.get("names") else None
        self.region = parse_region(options["region"]) if options.get("region") else None
        self.low, self.high, self.name = None, None, None

    def names_of(self, path: str) -> tuple[str, str]:
        index, header = load_index(path), self.header(path)
        return header[index.columns[0] - 1], header[index.columns[1] - 1]

    @staticmethod
    def header(path: str, skip: int = 0) -> list[str]:
        where, at = store(path)
        with where.open_input_file(at) as stream:
            return first_lines(stream, skip).split("\t")

    def wanted(self) -> tuple[str, int, int] | None:
        if self.region or self.name is None:
            return self.region
        return self.name, self.low if self.low is not None else 1, self.high if self.high is not None else 1 << 29

    def partitions(self):
        out, region = [], self.wanted()
        for path in files(self.path):
            index = load_index(path)
            for group in packed(index.region(*region) if region else index.places(), self.split):
                if group:
                    out.append(Piece(path, group, index.columns[0] - 1, index.columns[1] - 1, index.skip))
        return out or [Piece()]

    def read(self, partition: Piece):
        target = to_arrow_schema(self.schema)
        if not partition.pieces:
            return
        header = self.header(partition.path, partition.skip)
        header = self.names + header[len(self.names) :] if self.names else header
        if lost := [f.name for f in self.schema if f.name not in header]:
            raise ValueError(f"no column {', '.join(lost)} in {partition.path}")
        chromosome, position = header[partition.chromosome_at], header[partition.position_at]
        read = list(dict.fromkeys([*target.names, chromosome, position]))
        kinds = {n: target.field(n).type if n in target.names else pa.string() if n == chromosome else pa.int64() for n in read}
        options = csv.ConvertOptions(column_types=kinds, include_columns=read, null_values=["NA"], strings_can_be_null=True, quoted_strings_can_be_null=False)
        region = self.wanted()
        where, at = store(partition.path)
        with where.open_input_file(at) as stream:
            for text in text_of(stream, partition.pieces):
                if not text:
                    continue
                got = csv.read_csv(io.BytesIO(text), csv.ReadOptions(column_names=header, use_threads=False), csv.ParseOptions(delimiter="\t", quote_char=False, double_quote=False), options)
                if region:  # a line that only reaches into the region belongs to the one before
                    inside = pc.and_(pc.equal(got[chromosome], region[0]), pc.and_(pc.greater_equal(got[position], region[1]), pc.less_equal(got[position], region[2])))
                    got = got.filter(inside)
                yield from got.select(target.names).cast(target).to_batches()


class PushingReader(Reader):
    """A reader that Spark hands its filters to; Spark allows one only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        """Equality of the chromosome and bounds of the position choose blocks; Spark still checks every filter."""
        chromosome, position = self.names_of(files(self.path)[0]) if files(self.path) else (None, None)
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and column == chromosome:
                self.name = f.value
            elif column == position and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low or 0, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high or 1 << 29, f.value - isinstance(f, LessThan))
            yield f


@dataclass
class Done(WriterCommitMessage):
    path: str | None = None


class Writer(DataSourceArrowWriter):
    """A file and its index for each partition that has rows; rows come by chromosome and position (the first two columns).

    A file counts once its index has its name, which is given at the end of the
    whole job: what a lost or repeated task has written isn't read.
    """

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        from pyspark import TaskContext

        where, folder = store(self.path)
        target, out = None, None
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    where.create_dir(folder, recursive=True)
                    target = where.open_output_stream(f"{folder}/{name}", compression=None)
                    out = Builder(target, "#" + "\t".join(f.name for f in self.schema))
                out.add(batch)
            if out is None:
                return Done()
            index = out.finish()
            target.close()
            with where.open_output_stream(f"{folder}/{name}{WAITING}", compression=None) as stream:
                for k in range(0, len(index), BLOCK_TEXT):
                    stream.write(member(index[k : k + BLOCK_TEXT]))
                stream.write(END)
        except BaseException:
            if target is not None:
                target.close()
            remove(where, f"{folder}/{name}")
            raise
        return Done(f"{folder}/{name}")

    def commit(self, messages) -> None:
        where, _ = store(self.path)
        for m in messages:
            if m is not None and m.path:
                where.move(m.path + WAITING, m.path + ".tbi")

    def abort(self, messages) -> None:
        where, _ = store(self.path)
        for m in messages:
            if m is not None and m.path:
                remove(where, m.path)


def remove(where: fs.FileSystem, path: str) -> None:
    for name in (path, path + WAITING, path + ".tbi"):
        if where.get_file_info(name).type == fs.FileType.File:
            where.delete_file(name)


class Builder:
    """Writes lines as blocks and gathers the index."""

    def __init__(self, stream, header: str):
        self.stream, self.rest, self.blocks, self.at = stream, b"", [], 0
        self.total, self.last = 0, None
        self.names: list[str] = []
        self.rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.put(header.encode() + b"\n")

    def put(self, text: bytes) -> None:
        self.total += len(text)
        self.rest += text
        while len(self.rest) >= BLOCK_TEXT:
            self.flush(self.rest[:BLOCK_TEXT])
            self.rest = self.rest[BLOCK_TEXT:]

    def flush(self, text: bytes) -> None:
        body = member(text)
        self.blocks.append(self.at)
        self.at += len(body)
        self.stream.write(body)

    def add(self, batch: pa.RecordBatch) -> None:
        shown = [pc.coalesce(c.cast(pa.string()), pa.scalar("NA")) for c in batch.columns]
        lines = pc.binary_join_element_wise(*shown, "\t")
        size = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        begin = self.total + np.cumsum(size) - size
        chromosome, position = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        if batch.column(0).null_count or batch.column(1).null_count:
            raise ValueError("a line needs a chromosome and a position")
        change = [k for k in range(len(chromosome)) if k == 0 or chromosome[k] != chromosome[k - 1]]
        for a, b in zip(change, [*change[1:], len(chromosome)], strict=True):
            own = position[a:b].astype(np.int64)
            fresh = self.last is None or self.last[0] != chromosome[a]
            if (np.diff(own) < 0).any() or (not fresh and own[0] < self.last[1]) or (fresh and chromosome[a] in self.names):
                raise ValueError("rows must be sorted by chromosome and position")
            if fresh:
                self.names.append(chromosome[a])
            self.last = (chromosome[a], int(own[-1]))
            self.rows.append((len(self.names) - 1, own - 1, begin[a:b], (begin + size)[a:b]))
        self.put(("\n".join(lines.to_pylist()) + "\n").encode())

    def finish(self) -> bytes:
        if self.rest:
            self.flush(self.rest)
        self.blocks.append(self.at)
        self.stream.write(END)
        blocks = np.array(self.blocks, np.int64)
        place = lambda u: blocks[u // BLOCK_TEXT] << 16 | u % BLOCK_TEXT
        index = Index(self.names, [{} for _ in self.names], [[] for _ in self.names])
        for k, start, begin, end in self.rows:
            low, high, number = place(begin), place(end), bin_of(start, start + 1)
            first = np.flatnonzero(np.append(True, np.diff(number) != 0))
            for a, b in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(number) - 1], strict=True):
                index.bins[k].setdefault(int(number[a]), []).append((int(low[a]), int(high[b])))
            windows, at = np.unique(start >> SMALL, return_index=True)
            linear = index.linear[k]
            for window, j in zip(windows.tolist(), at.tolist(), strict=True):
                linear += [int(low[j])] * (window + 1 - len(linear))  # windows without lines point to the next
        index.bins = [{number: joined(sorted(chunks)) for number, chunks in bins.items()} for bins in index.bins]
        return index.to_bytes()


class IndexedText(DataSource):
    """options: path; region (chr or chr:start-end); splitBytes, the compressed bytes of a partition;
    names, of the columns in order, tab-separated, instead of the header's; pushdown.

    Without a schema all columns are text, the position a number.  NA is NULL.  A
    region of a chromosome that a file doesn't know has no rows.  With pushdown
    (``read`` asks for it where Spark is set to allow it) filters on the chromosome
    and the position choose blocks as ``region`` does.
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_text"

    def schema(self) -> StructType:
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no compressed file in {self.options['path']}")
        index = load_index(found[0])
        names = Reader.header(found[0], index.skip)
        return StructType([StructField(n, IntegerType() if k == index.columns[1] - 1 else StringType()) for k, n in enumerate(names)])

    def reader(self, schema: StructType) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(self.options["path"], schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are only added: give a new folder")
        return Writer(self.options["path"], schema)


def read(spark: SparkSession, path: str, schema: str | StructType | None = None, region: str | tuple[str, int, int] | None = None, split_bytes: int | None = None, names: list[str] | None = None) -> DataFrame:
    """The rows of a file or a folder of files, of a region if one is given; ``names`` go before those of the header."""
    spark.dataSource.register(IndexedText)
    pushes = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    reader = spark.read.format("indexed_text").option("pushdown", pushes)
    reader = reader.schema(schema) if schema is not None else reader
    if region is not None:
        reader = reader.option("region", region if isinstance(region, str) else f"{region[0]}:{region[1]}-{region[2]}")
    reader = reader.option("names", "\t".join(names)) if names else reader
    return (reader.option("splitBytes", split_bytes) if split_bytes else reader).load(path)


def known(path: str) -> bool:
    """Whether the path is a compressed file with an index, in a store that pyarrow reaches."""
    if not path.endswith(".gz"):
        return False
    try:
        where, at = store(path)
        return where.get_file_info(at + ".tbi").type == fs.FileType.File
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def write(df: DataFrame, folder: str) -> None:
    """A folder of files with their indexes, ranged and sorted by the first two columns: chromosome and position."""
    df.sparkSession.dataSource.register(IndexedText)
    by = df.columns[:2]
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.format("indexed_text").mode("append").save(folder)
