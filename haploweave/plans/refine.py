"""Refined alignments: positions and CIGARs from events, noisy regions aligned anew."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.repeats import Window
from ..operators.digars import parse
from ..operators.ranges import overlap_join
from ..sinks.alignments import refined, rewrite
from ..sources.text import slices
from .collect import Result


def refine(alignments: DataFrame, result: Result) -> DataFrame:
    """Alignments with refined position, CIGAR and (where they were there) NM, MD and cs. Reads that were skipped or filtered
    stay as they are. One narrow pass over reads joined with their reference and the noisy regions they cover."""
    o = result.options
    names = {r["name"]: r["len"] for r in result.contigs.collect()}  # one row a contig
    used = result.reads.filter("NOT skipped").groupBy("read_id").agg(F.first("tid").alias("tid"), F.min("beg").alias("beg"), F.max("fin").alias("fin"))
    named = F.broadcast(result.contigs.select(F.col("tid").alias("ctid"), F.col("name").alias("chrom")))
    spans = used.join(named, F.col("tid") == F.col("ctid")).select("read_id", "tid", "chrom", "beg", "fin")
    pieces = slices(spans, result.reference, ["read_id"])
    noisy = result.tiles.select("tid", F.explode("noisy").alias("n")).select("tid", "n.beg", "n.fin").distinct()
    over = overlap_join(spans.select("read_id", "tid", "beg", "fin"), noisy).groupBy("read_id").agg(F.array_sort(F.collect_list(F.array("r_beg", "r_fin"))).alias("regions"))
    rows = alignments.join(pieces, "read_id", "left").join(over, "read_id", "left").select(*alignments.columns, "ref_seq", "ref_beg", "regions")
    schema = to_arrow_schema(alignments.schema)

    def run(batches):
        for batch in batches:
            out = []
            for a in batch.to_pylist():
                seq, start, regions = a.pop("ref_seq"), a.pop("ref_beg"), a.pop("regions") or []
                if seq is None:
                    out.append(a)
                    continue
                window = Window(seq, start)
                read = parse(a, names.get(a["chrom"], 0), window, o) | {"seq": a["seq"]}
                out.append(refined(a, rewrite(read, [tuple(r) for r in regions], window, o), window))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, alignments.schema)
