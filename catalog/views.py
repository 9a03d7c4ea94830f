"""Input views over the given tables, once in Spark and once as SQL."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqharbor.functions.ranking import blocked_rank
from seqharbor.functions.spread import spread
from seqharbor.session import small_batches

# Every character becomes a base: letters one by one, all others by code point class.
LETTERS = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ACGTACGTACGTACGTNCGTACGTACACGTACGTACGTACGTNCGTACGTAC",
)
OTHERS = (("[\\x00-\\x20]", "A"), ("[\\x21-\\x40]", "C"), ("[\\x5B-\\xBF]", "G"), ("[^ACGTN]", "T"))
FOLDS = [f"fold_{i}" for i in range(5)]
CLASSES = 5
LABELS = ["Animal", "Plant", "Fungi", "Protist", "Prokaryote"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SLICE_BYTES = 4 << 20  # text that a task turns into bases at once

# What ``LETTERS`` and ``OTHERS`` say of code points below 0xC0, as one table; all others are T.
PLAIN = dict(zip(*LETTERS)) | {
    chr(c): base
    for first, last, base in ((0x00, 0x20, "A"), (0x21, 0x40, "C"), (0x5B, 0x60, "G"), (0x7B, 0xBF, "G"))
    for c in range(first, last + 1)
}


def bases(batches):
    """(name, text) to (name, sequence)."""
    table = np.full(0xC1, ord("T"), dtype=np.uint8)
    for letter, base in PLAIN.items():
        table[ord(letter)] = ord(base)
    ascii_table = table.tobytes() + bytes(256 - len(table))

    def read(text: str | None) -> bytes | None:
        if text is None:
            return None
        if text.isascii():
            return text.encode().translate(ascii_table)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        return table[np.minimum(points, 0xC0)].tobytes()

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in pairwise(cuts):
            found = pa.array([read(text) for text in batch.column(1).slice(a, b - a).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found], names=batch.schema.names)


def _sequences(named: DataFrame) -> DataFrame:
    name = named.columns[0]
    return named.mapInArrow(bases, f"{name} string, seq string")


def sequences(spark, sf) -> DataFrame:
    docs = spread(table(small_batches(spark), sf, "documents").select("doc_id", "text"), "doc_id")
    return _sequences(docs.select(F.concat(F.lit("doc"), "doc_id").alias("accession"), F.col("text").alias("seq")))


def references(spark, sf) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return _sequences(items.select(F.concat(F.lit("b"), "item_id").alias("target"), F.col("text").alias("seq")))


def gene_chunks(spark, sf) -> DataFrame:
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.select(
        "user_id", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("bucket")
    ).select(
        F.concat(F.lit("u"), "user_id", F.lit("_"), "bucket").alias("accession"),
        (F.lit(5000) + F.col("bucket") * 100).alias("chunk_len"),
    )


def genes(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("_"), F.col("event_id") % 16).alias("accession"),
        "event_id",
        "event_type",
        "value",
    )
    ranked = blocked_rank(
        events, ["accession"], F.floor(F.col("event_id") / 65536), ["event_id"], "idx"
    )
    begin = F.greatest(F.lit(1), 1 + 400 * (F.col("idx") - 1) - F.col("event_id") % 7)
    residues = 30 + (F.col("event_id") * 37) % 300
    kind = F.col("event_id") % 6
    motif = (
        F.when(kind == 0, None)
        .when(kind == 1, "AGGAG")
        .when(kind == 2, "TAAA")
        .when(kind == 3, "tata")
        .when(kind == 4, "AGxAG")
        .otherwise("CCC")
    )
    return ranked.select(
        "accession",
        F.col("idx").cast("int").alias("idx"),
        begin.cast("int").alias("begin_pos"),
        (begin + 3 * residues - 1).cast("int").alias("end_pos"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("strand"),
        residues.cast("int").alias("aa_len"),
        motif.alias("motif"),
        F.col("value").alias("score"),
    )


def hits(spark, sf) -> DataFrame:
    quantity = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey", F.lit("_"), "l_linenumber").alias("query"),
        F.concat(F.lit("m"), F.col("l_partkey") % 60).alias("target"),
        (F.col("l_discount") / 50).alias("evalue"),
        (F.col("l_extendedprice") / 100).alias("bits"),
        F.floor(quantity * 10).cast("bigint").alias("qlen"),
        F.lit(200).cast("bigint").alias("tlen"),
        F.lit(1).cast("bigint").alias("qstart"),
        F.floor(quantity * 7).cast("bigint").alias("qend"),
        F.lit(1).cast("bigint").alias("tstart"),
        F.least(F.lit(200), F.floor(quantity * 7)).cast("bigint").alias("tend"),
        F.floor(quantity * 7).cast("bigint").alias("alnlen"),
    )


def hit_chunks(spark, sf) -> DataFrame:
    """Every order is a chunk, also one without hits."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("accession"),
        (F.lit(500) + F.col("o_custkey") % 9500).cast("int").alias("chunk_len"),
    )


def markers(spark, sf) -> DataFrame:
    codes = ["K", "KT", "A", "F", "P", "T", "E", "U"]
    code = F.when(F.col("p_partkey") % 9 == 0, codes[0])
    for i, name in enumerate(codes[1:], start=1):
        code = code.when(F.col("p_partkey") % 9 == i, name)
    return table(spark, sf, "part").select(
        F.concat(F.lit("m"), "p_partkey").alias("marker"),
        F.when(F.col("p_size") % 3 == 0, "CC").otherwise("vv").alias("specificity_class"),
        code.alias("class_code"),
        (F.col("p_retailprice") / 10).alias("cutoff"),
    )


def marker_ref(spark, sf, folds: int = 2) -> DataFrame:
    """The marker reference per fold; a fold scales the cutoffs."""
    numbers = F.array(*[F.lit(i) for i in range(folds)])
    return markers(spark, sf).select("*", F.explode(numbers).alias("f")).select(
        F.concat(F.lit("fold_"), "f").alias("fold"),
        "marker",
        "class_code",
        (F.col("cutoff") * (F.lit(1.0) + F.col("f") * 0.25)).alias("cutoff"),
    )


def gene_hits(spark, sf, written: DataFrame | None = None) -> DataFrame:
    """Alignment hits whose queries are proteins of the gene view, or of that view once written."""
    g = written or genes(spark, sf)
    aligned = F.floor(F.col("aa_len") * F.lit(0.75)).cast("bigint")
    return g.select(
        F.concat("accession", F.lit("_"), "idx").alias("query"),
        F.concat(F.lit("m"), (F.col("idx") * 7 + F.col("aa_len")) % 60).alias("target"),
        ((F.col("aa_len") % 12) / F.lit(10000.0)).alias("evalue"),
        (F.col("aa_len") * F.lit(1.5)).alias("bits"),
        F.col("aa_len").cast("bigint").alias("qlen"),
        F.lit(250).cast("bigint").alias("tlen"),
        F.lit(1).cast("bigint").alias("qstart"),
        aligned.alias("qend"),
        F.lit(1).cast("bigint").alias("tstart"),
        F.least(F.lit(250), aligned).cast("bigint").alias("tend"),
        aligned.alias("alnlen"),
    )


def proteins(spark, sf) -> DataFrame:
    """Proteins of the gene view; every tenth is not on record."""
    return genes(spark, sf).where(F.col("idx") % 10 != 0).select(
        F.concat("accession", F.lit("_"), "idx").alias("protein_id"),
        F.repeat(F.lit("MK"), F.col("aa_len") % 9).alias("amino_acid_sequence"),
        F.col("begin_pos").alias("protein_start"),
        F.col("end_pos").alias("protein_end"),
        F.col("strand").alias("protein_strand"),
        (F.col("begin_pos") == 1).alias("partial_begin"),
        F.lit(False).alias("partial_end"),
        F.lit("ATG").alias("start_type"),
        F.coalesce("motif", F.lit("")).alias("rbs_motif"),
        F.lit("").alias("rbs_spacer"),
        F.lit(11).alias("translation_table"),
    )


def fold_scores(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(FOLDS) - 1))).alias("f")
    )
    scores = [
        F.element_at("embedding", F.col("f") * CLASSES + F.lit(i + 1)).cast("double") * 8.0
        for i in range(CLASSES)
    ]
    return e.select(
        F.concat(F.lit("g"), "label", F.lit("_chunk"), "vec_id", F.lit("_"), F.col("vec_id") + 10)
        .alias("accession"),
        F.concat(F.lit("fold_"), "f").alias("fold"),
        (500 + (F.col("vec_id") * 137) % 9500).alias("chunk_len"),
        F.array(*scores).alias("logits"),
        F.col("vec_id"),
        F.col("f"),
    )


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("grp"),
        F.col("vec_id").alias("pos"),
        (F.col("vec_id") % 5 != 0).alias("mask"),
        F.col("embedding").alias("vec"),
    )


def labels(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.concat(F.lit("doc"), "doc_id").alias("accession"),
        F.when(F.col("quality") == 1, "Prokaryote").otherwise("Other").alias("label"),
    )


def _sql_letters(text: str) -> str:
    seq = f"translate({text},'{LETTERS[0]}','{LETTERS[1]}')"
    for pattern, base in OTHERS:
        seq = f"regexp_replace({seq},'{pattern}','{base}','g')"
    return seq


SQL = {
    "v_sequences": f"select concat('doc',doc_id) accession, {_sql_letters('text')} seq from documents",
    "v_references": f"select concat('b',item_id) target, {_sql_letters('text')} seq from benchmark",
    "v_gene_chunks": """select concat('u',user_id,'_',bucket) accession, (5000+bucket*100)::int chunk_len
        from (select distinct user_id from events) a, (select unnest(range(0,17)) bucket) b""",
    "v_genes": """select accession, idx::int idx, b::int begin_pos, (b+3*aa_len-1)::int end_pos,
          strand, aa_len::int aa_len, motif, score from (
        select accession, idx, greatest(1, 1+400*(idx-1)-event_id%7) b,
          case when event_type in ('click','view') then 1 else -1 end strand,
          30+(event_id*37)%300 aa_len,
          case event_id%6 when 0 then null when 1 then 'AGGAG' when 2 then 'TAAA'
            when 3 then 'tata' when 4 then 'AGxAG' else 'CCC' end motif, value score
        from (select *, concat('u',user_id,'_',event_id%16) accession,
          row_number() over (partition by user_id, event_id%16 order by event_id) idx
          from events) a) b""",
    "v_hits": """select concat('o',l_orderkey,'_',l_linenumber) query, concat('m',l_partkey%60) target,
        l_discount/50 evalue, l_extendedprice/100 bits, floor(l_quantity*10)::bigint qlen,
        200::bigint tlen, 1::bigint qstart, floor(l_quantity*7)::bigint qend, 1::bigint tstart,
        least(200,floor(l_quantity*7))::bigint tend, floor(l_quantity*7)::bigint alnlen from lineitem""",
    "v_hit_chunks": """select concat('o',o_orderkey) accession, (500+o_custkey%9500)::int chunk_len
        from orders""",
    "v_markers": """select concat('m',p_partkey) marker,
        case when p_size%3=0 then 'CC' else 'vv' end specificity_class,
        case p_partkey%9 when 0 then 'K' when 1 then 'KT' when 2 then 'A' when 3 then 'F'
          when 4 then 'P' when 5 then 'T' when 6 then 'E' when 7 then 'U' else null end class_code,
        p_retailprice/10 cutoff from part""",
    "v_marker_ref": """select concat('fold_',f) fold, marker, class_code,
        cutoff*(1::double+f*0.25::double) cutoff from v_markers, (select unnest(range(0,2)) f) t""",
    "v_gene_hits": """select concat(accession,'_',idx) query, concat('m',(idx*7+aa_len)%60) target,
        (aa_len%12)/10000::double evalue, aa_len*1.5::double bits, aa_len::bigint qlen,
        250::bigint tlen, 1::bigint qstart, al qend, 1::bigint tstart,
        least(250,al)::bigint tend, al alnlen
        from (select *, floor(aa_len*0.75::double)::bigint al from v_genes) g""",
    "v_proteins": """select concat(accession,'_',idx) protein_id,
        repeat('MK',aa_len%9) amino_acid_sequence, begin_pos protein_start, end_pos protein_end,
        strand protein_strand, begin_pos=1 partial_begin, false partial_end, 'ATG' start_type,
        coalesce(motif,'') rbs_motif, '' rbs_spacer, 11 translation_table
        from v_genes where idx%10<>0""",
    "v_fold_scores": "select concat('g',label,'_chunk',vec_id,'_',vec_id+10) accession,"
    " concat('fold_',f) fold, 500+(vec_id*137)%9500 chunk_len, "
    + ", ".join(f"embedding[f*5+{i + 1}]::double*8 s{i}" for i in range(CLASSES))
    + ", vec_id, f, concat('g',label) genome from embeddings, (select unnest(range(0,5)) f) t",
    "v_vectors": """select label grp, vec_id pos, vec_id%5<>0 mask, embedding vec from embeddings""",
    "v_labels": """select concat('doc',doc_id) accession,
        case when quality=1 then 'Prokaryote' else 'Other' end label from labels""",
}
NEEDS = {
    "v_marker_ref": ["v_markers"],
    "v_gene_hits": ["v_genes"],
    "v_proteins": ["v_genes"],
}


def sql(views: list[str], select: str, ctes: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A statement over named views and further common table expressions."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        parts.setdefault(name, SQL[name])

    for view in views:
        need(view)
    parts.update(ctes or {})
    # Each step is computed once: long expressions would otherwise be copied into every use.
    kept = "" if recursive else "materialized "
    body = ",\n".join(f"{name} as {kept}({text})" for name, text in parts.items())
    return f"with {'recursive ' if recursive else ''}{body}\n{select}" if body else select
