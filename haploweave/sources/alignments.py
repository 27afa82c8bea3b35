"""Alignments from SAM text and from BAM.

SAM goes through the text source: lines are split with SQL functions, so columns
that are not asked for are not made and filters run before any parsing. BAM goes
through a Python data source: with an index beside it a file is cut into parts
between records, and a range (by options, or by filters on tid and pos) reads only
the blocks that the index names; without one a task has a file. A task inflates
block by block and parses record by record, holding a block and a record. Files
are opened through Arrow's file systems; where these don't reach, a file goes to a
task whole through the binaryFile source. Both give the columns of
schemas.ALIGNMENT and of schemas.MATE, so that a writer can hand on what it got.
CRAM needs a codec that is not there and is refused.
"""
from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..schemas import ALIGNMENT, MATE
from .bam_index import Index, cut

FULL = f"{ALIGNMENT}, {MATE}"
#: Tags that have columns of their own, or are written anew.
OWN_TAGS = ("NM", "MD", "cs", "SA", "hs", "HP", "PS")
SEQ_CODE, CIGAR_CODE = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contig dictionary of a SAM header: tid, name, len, in the header's order."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ")).select(F.monotonically_increasing_id().alias("k"), "value")
    from pyspark.sql import Window

    field = lambda tag: F.regexp_extract("value", rf"\t{tag}:([^\t]+)", 1)
    return lines.select((F.row_number().over(Window.orderBy("k")) - 1).cast("int").alias("tid"), field("SN").alias("name"), field("LN").cast("long").alias("len"))


def header_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a SAM or BAM header but for the dictionary's and the first: read groups, programs, comments."""
    if path.endswith(".parquet"):
        return []
    if path.endswith((".sam", ".sam.gz")):
        found = [r["value"] for r in spark.read.text(path).filter(F.col("value").rlike("^@(RG|PG|CO)\t")).collect()]
    else:
        found = first_parts(spark, path)[0].split("\n")
    return [x for x in found if x.startswith(("@RG", "@PG", "@CO"))]


def read_sam(spark: SparkSession, path: str, input_idx: int = 0, inputs: int = 64) -> DataFrame:
    """Alignments of a SAM file. read_id numbers the lines, the same in every run over the same file, apart from those of
    ``inputs`` other files."""
    contigs = F.broadcast(sam_contigs(spark, path).select("tid", "name"))
    rows = spark.read.text(path).filter(~F.col("value").startswith("@")).select((F.monotonically_increasing_id() * max(64, inputs) + input_idx).alias("read_id"), F.split("value", "\t").alias("f"))
    cell = lambda i: F.get("f", F.lit(i))
    tag = lambda name, kind: F.nullif(F.regexp_extract(F.array_join(F.slice("f", 12, F.size("f")), "\t"), rf"(?:^|\t){name}:{kind}:([^\t]*)", 1), F.lit(""))
    quality = F.when(cell(10) == "*", F.lit(None)).otherwise(F.unhex(F.array_join(F.transform(F.filter(F.split(cell(10), ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c) - 33), 2, "0")), "")))
    hs = F.transform(F.filter(F.split(F.regexp_replace(F.coalesce(tag("hs", "B"), F.lit("")), "^[a-zA-Z],", ""), ","), lambda x: x != ""), lambda x: x.cast("long"))
    out = rows.select(
        "read_id", cell(0).alias("qname"), cell(1).cast("int").alias("flag"), cell(2).alias("chrom"), (cell(3).cast("long") - 1).alias("pos"), cell(4).cast("int").alias("mapq"), cell(5).alias("cigar"),
        F.when(cell(9) == "*", "").otherwise(cell(9)).alias("seq"), quality.alias("qual"), tag("NM", "[a-zA-Z]").try_cast("int").alias("nm"), tag("MD", "Z").alias("md"), tag("cs", "Z").alias("cs"), tag("SA", "Z").alias("sa"), hs.alias("hs"),
        F.lit(input_idx).alias("input_idx"),
        F.when(cell(6) == "=", cell(2)).when(cell(6) != "*", cell(6)).alias("mate_chrom"), (cell(7).cast("long") - 1).alias("mate_pos"), cell(8).cast("int").alias("tlen"),
        F.array_join(F.filter(F.slice("f", 12, F.size("f")), lambda x: ~F.substring(x, 1, 2).isin(*OWN_TAGS)), "\t").alias("tags"),
    )
    joined = out.join(contigs, F.col("chrom") == F.col("name"), "left").withColumn("tid", F.coalesce("tid", F.lit(-1)))
    return joined.select(*[c.split()[0] for c in FULL.split(", ")])


# --- BAM ---


def block_size(data: bytes, at: int) -> int:
    """Size of the BGZF block at an offset."""
    p, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while p < end:
        a, b, n = struct.unpack_from("<BBH", data, p)
        if (a, b, n) == (66, 67, 2):
            return struct.unpack_from("<H", data, p + 4)[0] + 1
        p += 4 + n
    raise ValueError("not a BGZF file: a block has no size")


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the BGZF blocks of a file."""
    at = 0
    while at + 18 <= len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            raise ValueError("not a BGZF file")
        extra, size = struct.unpack_from("<H", data, at + 10)[0], block_size(data, at)
        yield at, zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        at += size


def blocks_of(f, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the BGZF blocks of an open file from an offset on, one after another."""
    f.seek(at)
    while head := f.read(18):
        if len(head) < 18 or head[:2] != b"\x1f\x8b":
            raise ValueError("not a BGZF file")
        head += f.read(max(0, 12 + struct.unpack_from("<H", head, 10)[0] - 18))
        size = block_size(head, 0)
        yield at, next(blocks(head + f.read(size - len(head))))[1]
        at += size


def records_of(f, first: int | None = None, last: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes without their size) of the records of an open file that begin at ``first`` or later and before
    ``last``, both virtual offsets of records; None: the first record, and the end."""
    inflated = blocks_of(f, (first or 0) >> 16)
    held, ends = bytearray(), []  # what is inflated; of its blocks, where each ends there, and its offset
    at, dropped, begun = (first or 0) & 0xFFFF, 0, 0  # begun: where the block of the record begins

    def more() -> bool:
        where, block = next(inflated, (0, None))
        if block is None:
            return False
        held.extend(block)
        ends.append((dropped + len(held), where))
        return True

    if first is None:
        while True:
            if not more() and not held:
                raise ValueError("not a BAM file")
            try:
                at = bam_header(bytes(held))[2]
                break
            except (struct.error, IndexError):
                if not more():
                    raise
    while True:
        while len(held) < at + 4 or len(held) < at + 4 + struct.unpack_from("<i", held, at)[0]:
            gone = min(at, len(held))
            del held[:gone]
            dropped, at = dropped + gone, at - gone
            if not more():
                return
        while ends[0][0] <= dropped + at:
            begun = ends.pop(0)[0]
        offset = ends[0][1] << 16 | (dropped + at - begun)
        if last is not None and offset >= last:
            return
        size = struct.unpack_from("<i", held, at)[0]
        yield offset, bytes(held[at + 4 : at + 4 + size])
        at += 4 + size


def located(path: str) -> tuple:
    """A file system of Arrow's and the path there."""
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)


def opened(path: str):
    """A file for reading from any place."""
    files, name = located(path)
    return files.open_input_file(name)


def index_of(path: str) -> Index | None:
    """The index beside a BAM file, if there is one."""
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        try:
            with opened(name) as f:
                return Index.parse(f.read())
        except FileNotFoundError:
            continue
    return None


def read_number(offset: int, inputs: int, number: int) -> int:
    """An id for the record at a virtual offset of one of several files: the same however the files are cut. No two records begin
    in the same 32 bytes."""
    return (offset >> 16 << 11 | (offset & 0xFFFF) >> 5) * max(64, inputs) + number


def reference_end(raw: bytes) -> int:
    """Where a record's alignment ends on the reference (0-based, not included); a read without bases there takes one."""
    pos, name_len, n_cigar = struct.unpack_from("<i", raw, 4)[0], raw[8], struct.unpack_from("<H", raw, 12)[0]
    ops = struct.unpack_from(f"<{n_cigar}I", raw, 32 + name_len)
    return pos + (sum(c >> 4 for c in ops if CIGAR_CODE[c & 15] in "MDN=X") or 1)


def bam_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs, and where records begin, of inflated BAM."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    text, at = data[8 : 8 + n].split(b"\0")[0].decode(), 8 + n
    contigs = []
    count = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(count):
        size = struct.unpack_from("<i", data, at)[0]
        contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    return text, contigs, at


def tags(raw: bytes) -> dict:
    """Auxiliary fields by tag."""
    out, at = {}, 0
    forms = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            out[name] = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            form = forms[chr(raw[at])]
            n = struct.unpack_from("<i", raw, at + 1)[0]
            out[name] = list(struct.unpack_from(f"<{n}{form}", raw, at + 5))
            at += 5 + n * struct.calcsize(form)
        else:
            out[name] = struct.unpack_from("<" + forms[kind], raw, at)[0]
            at += struct.calcsize(forms[kind])
    return out


def bam_parts(inflated: Iterator[tuple[int, bytes]]) -> Iterator:
    """(header text, contigs), then the records (without their sizes) of inflated blocks."""
    held = bytearray()
    for _, block in inflated:
        held += block
        try:
            text, contigs, at = bam_header(bytes(held))
            break
        except (struct.error, IndexError):
            continue  # the header goes on in the next block
    else:
        text, contigs, at = bam_header(bytes(held))
    yield text, contigs
    while True:
        while at + 4 <= len(held) and at + 4 + (size := struct.unpack_from("<i", held, at)[0]) <= len(held):
            yield bytes(held[at + 4 : at + 4 + size])
            at += 4 + size
        del held[:at]
        at = 0
        _, block = next(inflated, (0, None))
        if block is None:
            return
        held += block


def tag_texts(raw: bytes) -> str:
    """Auxiliary fields as SAM writes them, but for those with columns of their own."""
    out, at = [], 0
    forms = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    shown = lambda v: str(np.float32(v)) if isinstance(v, float) else str(v)
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            text, at = f"{kind}:{raw[at:end].decode()}", end + 1
        elif kind == "B":
            form, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{forms[form]}", raw, at + 5)
            text, at = ",".join([f"B:{form}", *map(shown, values)]), at + 5 + n * struct.calcsize(forms[form])
        elif kind == "A":
            text, at = f"A:{chr(raw[at])}", at + 1
        else:
            text, at = f"{'f' if kind == 'f' else 'i'}:{shown(struct.unpack_from('<' + forms[kind], raw, at)[0])}", at + struct.calcsize(forms[kind])
        if name not in OWN_TAGS:
            out.append(f"{name}:{text}")
    return "\t".join(out)


def bam_record(raw: bytes, contigs: list[tuple[str, int]], read_id: int, input_idx: int) -> tuple:
    """Columns of schemas.ALIGNMENT and MATE of a record (without its size)."""
    tid, pos, name_len, mapq, _, n_cigar, flag, n_seq, mate_tid, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    qname = raw[at : at + name_len - 1].decode()
    at += name_len
    ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
    at += 4 * n_cigar
    packed = raw[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2
    seq = "".join(SEQ_CODE[b >> 4] + SEQ_CODE[b & 15] for b in packed)[:n_seq]
    qual = raw[at : at + n_seq]
    at += n_seq
    t = tags(raw[at:])
    hs = t.get("hs")
    return (
        read_id, qname, flag, tid, contigs[tid][0] if tid >= 0 else None, pos, mapq, "".join(f"{c >> 4}{CIGAR_CODE[c & 15]}" for c in ops), seq, None if qual[:1] == b"\xff" else qual,
        t.get("NM"), t.get("MD"), t.get("cs"), t.get("SA"), hs if isinstance(hs, list) else [], input_idx,
        contigs[mate_tid][0] if mate_tid >= 0 else None, mate_pos, tlen, tag_texts(raw[at:]),
    )


#: More than all places on a contig.
ANYWHERE = -(1 << 31), 1 << 31


class BamPartition(InputPartition):
    def __init__(self, path: str, number: int, first: int | None, last: int | None):
        super().__init__((path, number, first, last))


class BamReader(DataSourceReader):
    """Options: path, paths (one a line); tid, beg, fin for reads that overlap a range (0-based, fin not included; 0: to the
    end); numbers (the inputs' own, one a path) and inputs, for ids; split, about how many bytes a part has at least (32 MB)."""

    def __init__(self, options, schema: StructType | None = None):
        self.schema = to_arrow_schema(schema or StructType.fromDDL(FULL))  # tasks have no session to parse it
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split("\n") if p]
        if not self.paths:
            raise ValueError("a path is needed")
        for p in self.paths:
            if p.endswith(".cram"):
                raise ValueError(f"CRAM is not supported: {p}")
        self.tid, self.beg, self.fin = (int(options.get(k, d)) for k, d in (("tid", -1), ("beg", 0), ("fin", 0)))
        self.numbers = [int(n) for n in options["numbers"].split(",")] if "numbers" in options else list(range(len(self.paths)))
        self.inputs, self.split = int(options.get("inputs", len(self.paths))), int(options.get("split", 32 << 20))
        self.starts = list(ANYWHERE)  # what filters ask of pos: from, to excluded

    def partitions(self):
        out = []
        for path, number in zip(self.paths, self.numbers):
            index, parts = index_of(path), [(None, None)]
            if index is not None:
                if self.tid >= 0:  # a read over a place from which on reads are asked for may begin before it
                    beg, fin = max(self.beg, self.starts[0], 0), min(self.fin or 1 << 29, self.starts[1], 1 << 29)
                    parts = index.stretches(self.tid, beg, fin) if beg < fin else []
                cuts = index.cuts()
                parts = [p for part in parts for p in cut(part, cuts, self.split)]
            out += [BamPartition(path, number, *p) for p in parts]
        return out

    def read(self, partition):
        if partition is None:  # no part has reads
            return
        path, number, first, last = partition.value
        schema, rows = self.schema, []
        with opened(path) as f:
            _, contigs = next(bam_parts(blocks_of(f)))
            for offset, raw in records_of(f, first, last):
                tid, pos = struct.unpack_from("<ii", raw)
                if self.tid >= 0 and (tid != self.tid or (self.fin and pos >= self.fin) or reference_end(raw) <= self.beg) or not self.starts[0] <= pos < self.starts[1]:
                    continue
                rows.append(dict(zip(schema.names, bam_record(raw, contigs, read_number(offset, self.inputs, number), number))))
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class FilteringBamReader(BamReader):
    """For sessions that push filters into Python sources (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: Sequence[Filter]) -> Iterator[Filter]:
        """Takes tid and pos into the choice of blocks; Spark applies all filters again."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("tid",) and isinstance(f, EqualTo) and self.tid in (-1, value):
                self.tid = value
            elif getattr(f, "attribute", None) == ("pos",) and isinstance(value, int):
                low = {GreaterThan: value + 1, GreaterThanOrEqual: value, EqualTo: value}.get(type(f))
                high = {LessThan: value, LessThanOrEqual: value + 1, EqualTo: value + 1}.get(type(f))
                self.starts = [max(self.starts[0], self.starts[0] if low is None else low), min(self.starts[1], self.starts[1] if high is None else high)]
            yield f


class BamSource(DataSource):
    """spark.read.format("bam").load(path); with the option pushdown = true it takes filters, as the session's setting must say too."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return FULL

    def reader(self, schema):
        return (FilteringBamReader if self.options.get("pushdown") == "true" else BamReader)(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Files that a path or pattern names, on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        raise FileNotFoundError(path)
    return sorted(str(x.getPath().toString()) for x in found)


def read_bam(spark: SparkSession, path: str, input_idx: int = 0, inputs: int = 64, split: int = 32 << 20) -> DataFrame:
    """Alignments of BAM files on any file system that Spark reads. Several files of a pattern are one input; ids are by file."""
    if path.endswith(".cram"):
        raise ValueError(f"CRAM is not supported: {path}")
    files = files_of(spark, path)
    many = max(inputs, len(files))
    try:
        for f in files:
            opened(f).close()
    except Exception:  # not a file system of Arrow's: each file goes to a task whole
        return _read_whole(spark, path, input_idx, many)
    register(spark)
    reader = spark.read.format("bam").option("paths", "\n".join(files)).option("split", split).option("inputs", many)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if len(files) == 1:
        return reader.option("numbers", input_idx).load()
    return reader.load().withColumn("input_idx", F.lit(input_idx))


def _read_whole(spark: SparkSession, path: str, input_idx: int, inputs: int) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(FULL))

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                f, rows = io.BytesIO(raw), []
                _, contigs = next(bam_parts(blocks_of(f)))
                for offset, record in records_of(f):
                    rows.append(dict(zip(schema.names, bam_record(record, contigs, read_number(offset, inputs, input_idx), input_idx))))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FULL)


def first_parts(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and contigs of a BAM file, of its first blocks."""
    file = files_of(spark, path)[0]
    try:
        f = opened(file)
    except Exception:  # not a file system of Arrow's: through Spark, in a task

        def run(batches):
            for batch in batches:
                text, contigs = next(bam_parts(blocks(batch.column(0)[0].as_py())))
                yield pa.RecordBatch.from_pylist([{"text": text, "names": [n for n, _ in contigs], "sizes": [k for _, k in contigs]}])

        r = spark.read.format("binaryFile").load(file).select("content").mapInArrow(run, "text string, names array<string>, sizes array<long>").first()
        return r["text"], list(zip(r["names"], r["sizes"]))
    with f:
        return next(bam_parts(blocks_of(f)))


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contig dictionary of a BAM file: tid, name, len."""
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(first_parts(spark, path)[1])], "tid int, name string, len long")


def read_inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All inputs of a sample, one after another, told apart by input_idx."""
    from functools import reduce

    read = lambda i, p: read_sam(spark, p, i, len(paths)) if p.endswith((".sam", ".sam.gz")) else spark.read.parquet(p) if p.endswith(".parquet") else read_bam(spark, p, i, len(paths))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(i, p) for i, p in enumerate(paths)])
