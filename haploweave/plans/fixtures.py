"""Projection of the driver's tables on reads, sites and intervals.

The tables hold no sequencing data; this deterministic projection does. The same
in SQL is ``CTE``, for the queries' oracles.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digars import pieces
from ..operators.ranges import overlap_join
from ..schemas import ALIGNMENT
from ..sources.text import moved

#: Reads go so far beyond the last start, and contigs with them.
BEYOND = 2000
#: Sites are shown by reads that go so many bases beyond them.
MARGIN = 40
#: Number of the base at a place, of A, C, G and T.
BASE = "(((pos * 2654435761 + tid * 40503) >> 16) % 4)"

VIEWS = {
    "fx_g": "SELECT 10 * COUNT(*) AS g FROM orders",
    "fx_reads": "SELECT o_orderkey AS read_id, CAST(o_custkey % 4 AS INT) AS tid, (o_orderkey * 37) % g + 1 AS beg, (o_orderkey * 37) % g + 400 + (o_custkey * 13) % 1600 AS fin, CAST((o_orderkey + o_custkey) % 2 AS INT) AS rev, CAST(o_custkey % 61 AS INT) AS mapq, CASE o_orderstatus WHEN 'P' THEN 1024 WHEN 'O' THEN 0 ELSE 16 END AS flag, CAST(o_orderkey % 2 AS INT) AS input_idx FROM orders CROSS JOIN fx_g",
    "fx_sites": "SELECT p_partkey AS site_id, CAST(p_partkey % 4 AS INT) AS tid, (p_partkey * 61) % g + 1 AS pos, CASE WHEN p_size % 5 < 3 THEN 'SNP' WHEN p_size % 5 = 3 THEN 'INS' ELSE 'DEL' END AS typ, SUBSTR('ACGT', CAST((p_partkey * 7 + p_size) % 4 AS INT) + 1, 1) AS alt, CAST(p_size % 10 AS INT) AS zyg FROM part CROSS JOIN fx_g",
    "fx_obs": "SELECT read_id, tid, rev, site_id, pos, typ, alt, (read_id * 13 + site_id * 7) % 40 + 1 AS q, CASE WHEN (read_id * 31 + site_id * 17) % 100 < 4 THEN 1 - gt ELSE gt END AS allele FROM (SELECT r.read_id, r.tid, r.rev, s.site_id, s.pos, s.typ, s.alt, CASE WHEN s.zyg IN (0, 1) THEN 1 WHEN s.zyg = 2 THEN 0 WHEN s.zyg = 3 THEN CASE WHEN r.read_id % 9 = 0 THEN 1 ELSE 0 END WHEN (r.read_id + s.zyg) % 2 = 0 THEN 1 ELSE 0 END AS gt FROM fx_reads r JOIN fx_sites s ON r.tid = s.tid AND s.pos BETWEEN r.beg AND r.fin) t",
    "fx_noise": "SELECT read_id, tid, nb AS beg, LEAST(nb + 20 + ln * 15, fin) AS fin FROM (SELECT r.read_id, r.tid, r.fin, CAST(l_linenumber AS BIGINT) AS ln, r.beg + (l_partkey * 11 + l_linenumber * 97) % (r.fin - r.beg + 1) AS nb FROM lineitem JOIN fx_reads r ON l_orderkey = r.read_id WHERE l_partkey % 10 = 0) t",
    "fx_lowcomp": "SELECT c_custkey AS lc_id, CAST((c_custkey - c_custkey % 3) % 4 AS INT) AS tid, ((c_custkey - c_custkey % 3) * 97) % g + 1 + (c_custkey % 3) * 20 AS beg, ((c_custkey - c_custkey % 3) * 97) % g + 10 + (c_custkey % 3) * 20 + c_custkey % 50 AS fin FROM customer CROSS JOIN fx_g",
    "fx_chunks": "SELECT DISTINCT tid, pos - (pos - 1) % 5000 AS beg, pos - (pos - 1) % 5000 + 4999 AS fin FROM fx_sites",
    "fx_sidecar": "SELECT s_suppkey AS set_id, CAST(s_nationkey AS BIGINT) AS thread FROM supplier UNION SELECT s_suppkey, 100 + s_suppkey % 7 FROM supplier",
    "fx_hs": "SELECT read_id, read_id % n AS set_id FROM fx_reads CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c UNION SELECT read_id, (read_id * 3 + 1) % n FROM fx_reads CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c",
    "fx_shown": f"SELECT o.read_id, o.tid, r.beg, r.fin, o.pos, o.typ, CASE WHEN o.typ = 'SNP' THEN SUBSTR('ACGT', CAST(({BASE.replace('pos', 'o.pos').replace('tid', 'o.tid')} + 1 + o.site_id % 3) % 4 AS INT) + 1, 1) WHEN o.typ = 'INS' THEN SUBSTR('ACGTACGT', CAST(o.site_id % 4 AS INT) + 1, CAST(1 + s.zyg % 3 AS INT)) ELSE '' END AS alt, CAST(CASE WHEN o.typ = 'SNP' THEN 1 WHEN o.typ = 'INS' THEN 0 ELSE s.zyg + 20 END AS INT) AS ref_len FROM fx_obs o JOIN fx_reads r ON o.read_id = r.read_id JOIN fx_sites s ON o.site_id = s.site_id WHERE o.allele = 1 AND o.pos >= r.beg + {MARGIN} AND o.pos + {MARGIN} <= r.fin",
}
CTE = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())


def bases(beg: int, fin: int, tid: int) -> str:
    """Bases of a contig from place beg to fin."""
    return np.frombuffer(b"ACGT", np.uint8)[((np.arange(beg, fin + 1, dtype=np.int64) * 2654435761 + tid * 40503) >> 16) % 4].tobytes().decode()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Fixtures:
    """The projection as DataFrames, made with DataFrame code."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def g(self) -> int:
        return 10 * self.table("orders").count()

    def reads(self) -> DataFrame:
        start = (F.col("o_orderkey") * 37) % self.g
        return self.table("orders").select(
            F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 4).cast("int").alias("tid"), (start + 1).alias("beg"), (start + 400 + (F.col("o_custkey") * 13) % 1600).alias("fin"),
            ((F.col("o_orderkey") + F.col("o_custkey")) % 2).cast("int").alias("rev"), (F.col("o_custkey") % 61).cast("int").alias("mapq"),
            F.when(F.col("o_orderstatus") == "P", 1024).when(F.col("o_orderstatus") == "O", 0).otherwise(16).alias("flag"), (F.col("o_orderkey") % 2).cast("int").alias("input_idx"),
        )

    def sites(self) -> DataFrame:
        size = F.col("p_size")
        kind = F.when(size % 5 < 3, "SNP").when(size % 5 == 3, "INS").otherwise("DEL")
        return self.table("part").select(
            F.col("p_partkey").alias("site_id"), (F.col("p_partkey") % 4).cast("int").alias("tid"), ((F.col("p_partkey") * 61) % self.g + 1).alias("pos"), kind.alias("typ"),
            F.substring(F.lit("ACGT"), ((F.col("p_partkey") * 7 + size) % 4).cast("int") + F.lit(1), F.lit(1)).alias("alt"), (size % 10).cast("int").alias("zyg"),
        )

    def covered(self, reads: DataFrame | None = None) -> DataFrame:
        """Reads beside each site that they cover, with what they show there: a banded join of reads and sites."""
        # As a row of a bin a site takes many times its room in the file, so that sites are not left to be broadcast by size.
        pairs = overlap_join(reads if reads is not None else self.reads(), moved(self.sites()), right_span=("pos", "pos"), prefix="s_", bin_size=2048)
        read, site, zyg = F.col("read_id"), F.col("s_site_id"), F.col("s_zyg")
        genotype = F.when(zyg.isin(0, 1), 1).when(zyg == 2, 0).when(zyg == 3, F.when(read % 9 == 0, 1).otherwise(0)).when((read + zyg) % 2 == 0, 1).otherwise(0)
        allele = F.when((read * 31 + site * 17) % 100 < 4, 1 - genotype).otherwise(genotype)
        return pairs.select("read_id", "tid", "beg", "fin", "rev", site.alias("site_id"), F.col("s_pos").alias("pos"), F.col("s_typ").alias("typ"), F.col("s_alt").alias("alt"), zyg.alias("zyg"), ((read * 13 + site * 7) % 40 + 1).alias("q"), allele.alias("allele"))

    def obs(self, reads: DataFrame | None = None) -> DataFrame:
        """What each read shows at each site it covers."""
        return self.covered(reads).drop("beg", "fin", "zyg")

    def noise(self) -> DataFrame:
        lines = self.table("lineitem").filter("l_partkey % 10 = 0").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("ln"))
        r = self.reads().select("read_id", "tid", "beg", "fin")
        start = F.col("beg") + (F.col("l_partkey") * 11 + F.col("ln") * 97) % (F.col("fin") - F.col("beg") + 1)
        return lines.join(r, F.col("l_orderkey") == F.col("read_id")).select("read_id", "tid", start.alias("beg"), F.least(start + 20 + F.col("ln") * 15, F.col("fin")).alias("fin"))

    def lowcomp(self) -> DataFrame:
        key = F.col("c_custkey")
        base, step = key - key % 3, (key % 3) * 20
        return self.table("customer").select(key.alias("lc_id"), (base % 4).cast("int").alias("tid"), ((base * 97) % self.g + 1 + step).alias("beg"), ((base * 97) % self.g + 10 + step + key % 50).alias("fin"))

    def chunks(self) -> DataFrame:
        beg = F.col("pos") - (F.col("pos") - 1) % 5000
        return self.sites().select("tid", beg.alias("beg"), (beg + 4999).alias("fin")).distinct()

    def sidecar(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").cast("long").alias("thread")).unionByName(s.select(F.col("s_suppkey").alias("set_id"), (100 + F.col("s_suppkey") % 7).cast("long").alias("thread"))).distinct()

    def hs(self) -> DataFrame:
        n = self.table("supplier").count()
        r = self.reads().select("read_id")
        return r.select("read_id", (F.col("read_id") % n).alias("set_id")).unionByName(r.select("read_id", ((F.col("read_id") * 3 + 1) % n).alias("set_id"))).distinct()

    # --- Alignments: what each read shows, as rows of an alignment file, and the reference that it is aligned to ---

    def contigs(self) -> DataFrame:
        return self.spark.range(4).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("chr"), F.col("id") + 1).alias("name"), F.lit(self.g + BEYOND).cast("long").alias("len"))

    def reference(self, tile: int = 10_000, over: int = 0) -> DataFrame:
        """chrom, tile, beg, seq: bases are a function of their place. A tile goes on over so many bases of the next."""
        rows = self.contigs().select("tid", F.col("name").alias("chrom"), "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / tile))).alias("tile"))
        begins = F.col("tile") * tile + 1
        # Four contigs are four rows, so tiles are dealt out before their bases are made.
        rows = rows.select("chrom", "tile", begins.alias("beg"), F.least(begins + tile - 1 + over, F.col("len")).alias("fin"), "tid").repartition(max(partitions(self.spark), self.spark.sparkContext.defaultParallelism), "chrom", "tile")

        def made(batches):
            for whole in batches:
                for batch in pieces(whole, 64):
                    seq = [bases(*x) for x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(seq, pa.string())], ["chrom", "tile", "beg", "seq"])

        return rows.mapInArrow(made, "chrom string, tile long, beg long, seq string")

    def shown(self) -> DataFrame:
        """Sites where a read has the alternate: read_id, pos, typ, alt, ref_len."""
        # Of the one join: keys are unique, so sites and reads need not be joined again for what only they have.
        rows = self.covered().filter((F.col("allele") == 1) & (F.col("pos") >= F.col("beg") + MARGIN) & (F.col("pos") + MARGIN <= F.col("fin")))
        other = (F.shiftright(F.col("pos") * F.lit(2654435761) + F.col("tid") * 40503, 16) % 4 + 1 + F.col("site_id") % 3) % 4
        alt = F.when(F.col("typ") == "SNP", F.substring(F.lit("ACGT"), other.cast("int") + F.lit(1), F.lit(1))).when(F.col("typ") == "INS", F.substring(F.lit("ACGTACGT"), (F.col("site_id") % 4).cast("int") + F.lit(1), (1 + F.col("zyg") % 3).cast("int"))).otherwise("")
        size = F.when(F.col("typ") == "SNP", 1).when(F.col("typ") == "INS", 0).otherwise(F.col("zyg") + 20)
        return rows.select("read_id", "pos", "typ", alt.alias("alt"), size.cast("int").alias("ref_len"))

    def alignments(self) -> DataFrame:
        """Rows of schemas.ALIGNMENT: each read's bases and CIGAR, of the reference and what it shows."""
        told = self.shown().groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("pos", "typ", "alt", "ref_len"))).alias("sites"))  # a read covers a few
        reads = self.reads().join(self.contigs().select(F.col("tid").alias("of"), F.col("name").alias("chrom")), F.col("tid") == F.col("of")).drop("of")
        # Bases come last, so that no exchange or sort carries them: a read is shorter than BEYOND, and lies in one tile that goes so far over.
        tile = 10_000
        rows = reads.join(told, "read_id", "left").withColumn("tile", F.floor((F.col("beg") - 1) / tile))
        rows = rows.join(moved(self.reference(tile, BEYOND).select("chrom", "tile", F.col("beg").alias("tb"), "seq")), ["chrom", "tile"])
        rows = rows.withColumn("ref_seq", F.substring("seq", (F.col("beg") - F.col("tb") + 1).cast("int"), (F.col("fin") - F.col("beg") + 1).cast("int"))).drop("seq", "tb", "tile")
        # From each site: what matches before it, and itself; then what matches to the end.
        last = F.lit(0).cast("int")
        start = F.struct(last.alias("at"), F.lit("").alias("cigar"), F.lit("").alias("seq"))

        def step(done, site):
            at = (site["pos"] - F.col("beg")).cast("int")
            before = F.concat((at - done["at"]).cast("string"), F.lit("="))
            own = F.when(site["typ"] == "SNP", F.lit("1X")).when(site["typ"] == "INS", F.concat(F.length(site["alt"]).cast("string"), F.lit("I"))).otherwise(F.concat(site["ref_len"].cast("string"), F.lit("D")))
            return F.struct((at + site["ref_len"]).cast("int").alias("at"), F.concat(done["cigar"], before, own).alias("cigar"), F.concat(done["seq"], F.substring(F.col("ref_seq"), done["at"] + F.lit(1), at - done["at"]), site["alt"]).alias("seq"))

        def end(done):
            rest = F.length("ref_seq") - done["at"]
            return F.struct(F.concat(done["cigar"], rest.cast("string"), F.lit("=")).alias("cigar"), F.concat(done["seq"], F.substring(F.col("ref_seq"), done["at"] + F.lit(1), rest)).alias("seq"))

        none = F.array().cast("array<struct<pos:bigint,typ:string,alt:string,ref_len:int>>")
        made = rows.withColumn("made", F.aggregate(F.coalesce("sites", none), start, step, end))
        values = {
            "qname": F.format_string("r%08d", "read_id"), "pos": F.col("beg") - 1, "cigar": F.col("made.cigar"), "seq": F.col("made.seq"), "flag": F.col("flag").bitwiseOR(16 * F.col("rev")),
            "qual": F.unhex(F.repeat(F.lit("23"), F.length("made.seq"))), "nm": F.lit(0), "hs": F.array().cast("array<bigint>"),
        }
        kinds = dict(c.rsplit(" ", 1) for c in ALIGNMENT.split(", "))
        return made.select(*[values.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
