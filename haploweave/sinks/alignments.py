"""Alignments with haplotype tags, as SAM text or BAM, optionally with refined CIGARs.

Reads are joined by id, so what a tile skipped or a filter dropped cannot shift
others; a read in several tiles takes the tags of the first. Sorting by coordinate
is a range partitioning, not one task.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.repeats import Window as Reference
from ..operators.align import gapped
from ..operators.digars import cigar_ops
from ..options import Options
from ..schemas import ALIGNMENT, MATE
from ..sources.alignments import located
from ..sources.bam_index import Index, bin_of

PROGRAM = "collect-variation"
COLUMNS = [c.split()[0] for c in ALIGNMENT.split(", ")]


def tagged(alignments: DataFrame, reads: DataFrame) -> DataFrame:
    """Alignments with hp and ps; tags they had are replaced, unphased reads have none."""
    w = Window.partitionBy("read_id").orderBy("chunk_id")
    first = reads.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    tags = first.select("read_id", F.when(F.col("hap") > 0, F.col("hap")).alias("hp"), F.when((F.col("hap") > 0) & (F.col("phase_set") > 0), F.col("phase_set")).alias("ps"))
    return alignments.drop("hp", "ps").join(tags, "read_id", "left")


def stripped(alignments: DataFrame) -> DataFrame:
    return alignments.drop("hp", "ps").withColumn("hp", F.lit(None).cast("int")).withColumn("ps", F.lit(None).cast("long"))


def by_coordinate(rows: DataFrame) -> DataFrame:
    """Unmapped reads last."""
    return rows.orderBy(F.col("tid") < 0, "tid", "pos", "read_id")


def sam_header(contigs: Sequence[tuple[str, int]], command: str = "", sort: str = "coordinate", kept: Sequence[str] = ()) -> str:
    """kept: the input's lines of read groups, programs and comments; this program follows the last of its programs."""
    lines = [f"@HD\tVN:1.6\tSO:{sort}"] + [f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs] + list(kept)
    ids = [f[3:] for line in kept if line.startswith("@PG") for f in line.split("\t") if f.startswith("ID:")]
    own = PROGRAM if PROGRAM not in ids else f"{PROGRAM}.{len(ids)}"
    return "\n".join([*lines, f"@PG\tID:{own}\tPN:{PROGRAM}" + (f"\tPP:{ids[-1]}" if ids else "") + (f"\tCL:{command}" if command else "")]) + "\n"


def with_mates(rows: DataFrame) -> DataFrame:
    """rows with the columns of MATE: as they are, or, where an input had none, no mate and no further tags."""
    kinds = dict(c.rsplit(" ", 1) for c in MATE.split(", "))
    return rows.withColumns({c: F.lit({"mate_pos": -1, "tlen": 0}.get(c)).cast(t) for c, t in kinds.items() if c not in rows.columns}).fillna({"mate_pos": -1, "tlen": 0})


def sam_lines(rows: DataFrame) -> DataFrame:
    """One text column. Needs the columns of ALIGNMENT and hp, ps; those of MATE are written where there are any."""
    c, rows = F.col, with_mates(rows)
    mate = F.when(c("mate_chrom").isNull(), "*").when(c("mate_chrom") == c("chrom"), "=").otherwise(c("mate_chrom"))
    quality = F.when(c("qual").isNull(), "*").otherwise(F.array_join(F.transform(F.filter(F.split(F.regexp_replace(F.hex("qual"), "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.chr(F.conv(x, 16, 10).cast("int") + 33)), ""))
    tag = lambda name, kind, col: F.when(col.isNotNull(), F.concat(F.lit(f"{name}:{kind}:"), col.cast("string")))
    hs = F.when(F.size("hs") > 0, F.concat(F.lit("hs:B:I,"), F.array_join(F.transform("hs", lambda x: x.cast("string")), ",")))
    base = [c("qname"), c("flag").cast("string"), F.coalesce("chrom", F.lit("*")), (c("pos") + 1).cast("string"), c("mapq").cast("string"), F.when(c("cigar") == "", "*").otherwise(c("cigar")), mate, (c("mate_pos") + 1).cast("string"), c("tlen").cast("string"), F.when(c("seq") == "", "*").otherwise(c("seq")), quality]
    tags = [F.nullif(c("tags"), F.lit("")), tag("NM", "i", c("nm")), tag("MD", "Z", c("md")), tag("cs", "Z", c("cs")), tag("SA", "Z", c("sa")), hs, tag("HP", "i", c("hp")), tag("PS", "i", c("ps"))]
    return rows.select(F.concat_ws("\t", *base, *tags).alias("value"))


def write_sam(rows: DataFrame, path: str, contigs: Sequence[tuple[str, int]], command: str = "", kept: Sequence[str] = ()) -> None:
    rows.sparkSession.createDataFrame([(sam_header(contigs, command, kept=kept).rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}/header")
    sam_lines(by_coordinate(rows)).write.text(f"{path}/records")


# --- Tags of an alignment with =, X, I, D ---


def edit_distance(digars: list[dict]) -> int:
    return sum(d["len"] for d in digars if d["type"] in ("SNP", "INS", "DEL"))


def md_tag(digars: list[dict], ref: Reference) -> str:
    """Matches as numbers, mismatched and deleted reference bases; insertions leave no trace."""
    out, same = "", 0
    for d in digars:
        if d["type"] == "EQ":
            same += d["len"]
        elif d["type"] in ("SNP", "DEL"):
            out += f"{same}{'^' if d['type'] == 'DEL' else ''}" + "".join(ref.base(d["pos"] + k) for k in range(d["len"]))
            same = 0
    return out + str(same)


def cs_tag(digars: list[dict], ref: Reference, seq: str) -> str:
    """Short form, bases in lower case."""
    out, same = "", 0
    for d in [*digars, None]:
        if d is not None and d["type"] == "EQ":
            same += d["len"]
            continue
        if same:
            out += f":{same}"
            same = 0
        if d is None:
            break
        if d["type"] == "SNP":
            out += f"*{ref.base(d['pos'])}{seq[d['qi']]}".lower()
        elif d["type"] == "INS":
            out += "+" + seq[d["qi"] : d["qi"] + d["len"]].lower()
        elif d["type"] == "DEL":
            out += "-" + "".join(ref.base(d["pos"] + k) for k in range(d["len"])).lower()
    return out


def cigar_of(digars: list[dict], primary: bool = True) -> str:
    """CIGAR of events; neighbours of a kind are joined. Hard clips of a primary alignment, whose bases are there, become soft."""
    code = {"EQ": "=", "SNP": "X", "INS": "I", "DEL": "D", "SOFT": "S", "HARD": "S" if primary else "H"}
    out: list[list] = []
    for d in digars:
        if out and out[-1][0] == code[d["type"]]:
            out[-1][1] += d["len"]
        else:
            out.append([code[d["type"]], d["len"]])
    return "".join(f"{n}{op}" for op, n in out)


def rewrite(read: dict, regions: list[tuple[int, int]], ref: Reference, options: Options) -> list[dict]:
    """Events of a read with those inside the given regions replaced by a new alignment of its bases there."""
    digars = read["digars"]
    for beg, fin in regions:
        if read["beg"] > beg or read["fin"] < fin:
            continue
        before, after, lo, hi = [], [], None, None
        for d in digars:
            spans = d["type"] in ("EQ", "SNP", "DEL")
            last = d["pos"] + (d["len"] if spans else 0) - 1
            if (last < beg if spans else d["pos"] < beg or (d["type"] in ("SOFT", "HARD") and not after and lo is None)):
                before.append(d)
                continue
            if d["pos"] > fin and (d["type"] != "INS" or d["pos"] > fin + 1):
                after.append(d)
                continue
            used = d["type"] != "DEL"
            a, b = d["qi"], d["qi"] + (d["len"] if used else 0)
            if d["type"] == "EQ":
                head, tail = max(0, beg - d["pos"]), max(0, last - fin)
                if head:
                    before.append(d | {"len": head})
                if tail:
                    after.append(d | {"pos": fin + 1, "len": tail, "qi": b - tail})
                a, b = a + head, b - tail
            elif d["type"] == "DEL" and (d["pos"] < beg or last > fin):
                before, after, lo = [], [], None  # a deletion across the border stays as it is
                break
            lo, hi = (a if lo is None else min(lo, a)), (b if hi is None else max(hi, b))
        if lo is None:
            continue
        seq = (read["seq"] or "").upper()
        x, y = gapped("".join(ref.base(i) for i in range(beg, fin + 1)), seq[lo:hi], options)
        digars = before + events_of(x, y, beg, lo, seq) + after
    return digars


def events_of(x: str, y: str, pos: int, qi: int, seq: str) -> list[dict]:
    out: list[dict] = []
    for p, q in zip(x, y):
        kind = "INS" if p == "-" else "DEL" if q == "-" else "EQ" if p == q else "SNP"
        if out and out[-1]["type"] == kind and kind != "SNP":
            out[-1]["len"] += 1
        else:
            out.append({"pos": pos, "type": kind, "len": 1, "qi": qi, "low_quality": False, "alt": ""})
        if kind in ("INS", "SNP"):
            out[-1]["alt"] = seq[out[-1]["qi"] : out[-1]["qi"] + out[-1]["len"]]
        pos += p != "-"
        qi += q != "-"
    return out


def refined(aln: dict, digars: list[dict], ref: Reference) -> dict:
    """An alignment with position and CIGAR of its events; NM, MD and cs are made anew where it had them and the CIGAR changed."""
    cigar = cigar_of(digars, not aln["flag"] & 0x900)
    first = next((d["pos"] for d in digars if d["type"] in ("EQ", "SNP", "DEL")), aln["pos"] + 1)
    out = dict(aln) | {"pos": first - 1, "cigar": cigar}
    if cigar_ops(cigar) != cigar_ops(aln["cigar"]):
        for tag, made in (("nm", lambda: edit_distance(digars)), ("md", lambda: md_tag(digars, ref)), ("cs", lambda: cs_tag(digars, ref, aln["seq"]))):
            if aln.get(tag) is not None:
                out[tag] = made()
    return out


# --- BAM ---


def bam_bytes(contigs: Sequence[tuple[str, int]], command: str = "", kept: Sequence[str] = ()) -> bytes:
    text = sam_header(contigs, command, kept=kept).encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    return head + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)


def tag_bytes(text: str) -> bytes:
    """A tag as BAM holds it, of a tag as SAM writes it."""
    name, kind, value = text.split(":", 2)
    form = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    out = name.encode() + kind.encode()
    if kind in "ZH":
        return out + value.encode() + b"\0"
    if kind == "A":
        return out + value.encode()[:1]
    if kind == "B":
        of, *values = value.split(",")
        return out + of.encode() + struct.pack(f"<i{len(values)}{form[of]}", len(values), *(float(v) if of == "f" else int(v) for v in values))
    if kind == "f":
        return out + struct.pack("<f", float(value))
    return name.encode() + (b"i" + struct.pack("<i", int(value)) if -(2**31) <= int(value) < 2**31 else b"I" + struct.pack("<I", int(value)))


def record_bytes(a: dict, tids: dict[str, int] | None = None) -> bytes:
    ops = cigar_ops(a["cigar"])
    seq, qual = a["seq"] or "", a["qual"]
    codes = ["=ACMGRSVTWYHKDBN".find(c) if c in "=ACMGRSVTWYHKDBN" else 15 for c in seq.upper()] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    span = sum(n for op, n in ops if op in "MDN=X") or 1
    tags = b"".join(name + b"Z" + str(v).encode() + b"\0" for name, v in ((b"MD", a.get("md")), (b"cs", a.get("cs")), (b"SA", a.get("sa"))) if v is not None)
    tags += b"".join(name + b"i" + struct.pack("<i", int(v)) for name, v in ((b"NM", a.get("nm")), (b"HP", a.get("hp")), (b"PS", a.get("ps"))) if v is not None)
    if a.get("hs"):
        tags += b"hsBI" + struct.pack(f"<i{len(a['hs'])}I", len(a["hs"]), *a["hs"])
    tags = b"".join(tag_bytes(t) for t in (a.get("tags") or "").split("\t") if t) + tags
    mate = (tids or {}).get(a.get("mate_chrom"), -1)
    name = a["qname"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", a["tid"], a["pos"], len(name), a["mapq"], bin_of(max(0, a["pos"]), max(0, a["pos"]) + span), len(ops), a["flag"], len(seq), mate, a.get("mate_pos", -1) if mate >= 0 else -1, a.get("tlen") or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for op, n in ops) + packed + (bytes(qual) if qual is not None else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


#: Inflated bytes of a block.
BLOCK = 65280


def bgzf(data: bytes) -> bytes:
    """BGZF blocks of data, without the end marker."""
    out = []
    for at in range(0, len(data), BLOCK):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[at : at + BLOCK]
        body = c.compress(part) + c.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


#: Fixed value: the empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class Blocks:
    """Records as BGZF blocks, block by block, and their index; blocks are counted from byte 1, so that no place is 0."""

    def __init__(self, contigs: int):
        self.held, self.done, self.begins, self.index = bytearray(), 0, [1], Index(contigs)
        self.waiting: list[tuple[int, int, int, int, int]] = []  # records whose blocks are not written yet

    def add(self, record: bytes) -> None:
        first = self.done + len(self.held)
        self.held += record
        tid, pos, name, n_cigar = *struct.unpack_from("<iiB", record, 4), struct.unpack_from("<H", record, 16)[0]
        if tid >= 0:
            ops = struct.unpack_from(f"<{n_cigar}I", record, 36 + name)
            span = sum(c >> 4 for c in ops if "MIDNSHP=X"[c & 15] in "MDN=X") or 1
            self.waiting.append((tid, max(0, pos), max(0, pos) + span, first, self.done + len(self.held)))

    def take(self, all_: bool = False) -> bytes:
        """Full blocks, and what is left at the end."""
        out, at = [], 0
        while len(self.held) - at >= BLOCK or (all_ and at < len(self.held)):
            out.append(bgzf(bytes(self.held[at : at + BLOCK])))
            self.begins.append(self.begins[-1] + len(out[-1]))
            at += BLOCK
        del self.held[:at]
        self.done += at
        ready = [w for w in self.waiting if all_ or w[4] <= self.done]
        self.waiting = self.waiting[len(ready) :]
        last = len(self.begins) - 1
        for *where, first, end in ready:
            a, b = first // BLOCK, min(end // BLOCK, last)
            self.index.add(*where, self.begins[a] << 16 | first % BLOCK, self.begins[b] << 16 | (end % BLOCK if b * BLOCK <= end < (b + 1) * BLOCK and b < last else 0))
        return b"".join(out)


class BamWriter(DataSourceWriter):
    """A BAM file a task in a folder, or (option ``one_file``) one file with its index beside it. A failed job leaves nothing behind.

    For one file tasks write their blocks beside it; when all have ended they are put together in the order of the tasks' rows,
    stream by stream, and only a whole file takes the name."""

    def __init__(self, options, columns):
        self.path, self.columns = options["path"].rstrip("/"), columns
        self.contigs = [(x.rsplit(":", 1)[0], int(x.rsplit(":", 1)[1])) for x in options.get("contigs", "").split(",") if x]
        self.command, self.kept = options.get("command", ""), [x for x in options.get("kept", "").split("\n") if x]
        self.one = options.get("one_file", "false") == "true"
        self.run = uuid.uuid4().hex
        self.folder = f"{self.path}.parts-{self.run}" if self.one else self.path

    def header(self) -> bytes:
        return bgzf(bam_bytes(self.contigs, self.command, self.kept))

    def write(self, rows):
        from pyspark import TaskContext

        files, folder = located(self.folder)
        files.create_dir(folder, recursive=True)
        message = WriterCommitMessage()
        message.part, message.name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.bam"
        blocks, tids = Blocks(len(self.contigs)), {n: i for i, (n, _) in enumerate(self.contigs)}
        with files.open_output_stream(f"{folder}/{message.name}.{self.run}") as f:
            if not self.one:
                f.write(self.header())
            for r in rows:
                blocks.add(record_bytes(dict(zip(self.columns, r)), tids))
                if len(blocks.held) >= 1 << 20:
                    f.write(blocks.take())
            f.write(blocks.take(True))
            if not self.one:
                f.write(END)
        message.index = blocks.index.bytes() if self.one else b""
        return message

    def commit(self, messages):
        files, folder = located(self.folder)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        if not self.one:
            for m in parts:
                files.move(f"{folder}/{m.name}.{self.run}", f"{folder}/{m.name}")
            self.clean(files, folder)
            return
        _, path = located(self.path)
        index, size = Index(len(self.contigs)), 0
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/whole") as f:
            head = self.header()
            f.write(head)
            size += len(head)
            for m in parts:
                index.append(Index.parse(m.index), size - 1)
                with files.open_input_stream(f"{folder}/{m.name}.{self.run}") as part:
                    while piece := part.read(8 << 20):
                        f.write(piece)
                        size += len(piece)
            f.write(END)
        with files.open_output_stream(f"{folder}/index") as f:
            f.write(index.bytes())
        files.move(f"{folder}/whole", path)
        files.move(f"{folder}/index", f"{path}.bai")
        files.delete_dir(folder)

    def clean(self, files, folder: str) -> None:
        """Deletes what this job's failed attempts have left in the folder."""
        from pyarrow import fs

        for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.path.endswith(self.run):
                files.delete_file(x.path)

    def abort(self, messages):
        from pyarrow import fs

        files, folder = located(self.folder)
        if self.one:
            if files.get_file_info(folder).type != fs.FileType.NotFound:
                files.delete_dir(folder)
        else:
            self.clean(files, folder)


class BamSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_file"

    def writer(self, schema, overwrite):
        return BamWriter(self.options, [f.name for f in schema])


def write_bam(rows: DataFrame, path: str, contigs: Sequence[tuple[str, int]], command: str = "", kept: Sequence[str] = (), one_file: bool = False) -> None:
    """Sorted part files in a folder, or one sorted file with its index. CRAM is refused: its codec is not there."""
    if path.endswith(".cram"):
        raise ValueError("CRAM is not supported")
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(BamSink)
    full = with_mates(rows).select(*COLUMNS, *[c.split()[0] for c in MATE.split(", ")], "hp", "ps")
    writer = by_coordinate(full).write.format("bam_file").option("contigs", ",".join(f"{n}:{s}" for n, s in contigs)).option("command", command).option("kept", "\n".join(kept))
    writer.option("one_file", str(one_file).lower()).mode("append").save(path)
