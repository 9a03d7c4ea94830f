"""Sources and sinks: tables written as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqharbor.operators import markers as marker_ops
from seqharbor.operators.calibration import calibrate
from seqharbor.plans.checks import TableCheck, find_problems
from seqharbor.plans.predict import export_marker_hits, protein_table
from seqharbor.session import scratch_path
from seqharbor.sources import fasta, hits_json, models, reports, tables

from . import ensemble, genes, markers, views
from .registry import query, r, tidy, unpack
from .views import CLASSES, sql

SEQUENCES = "select accession, seq, length(seq)::int seq_len from v_sequences"


@query("read_fasta", sql(["v_sequences"], SEQUENCES))
def read_fasta(spark, sf):
    """Lower-case records with a description and long lines, as other tools write them."""
    path = scratch_path(spark, "fasta")
    records = views.sequences(spark, sf).select(
        F.concat(
            F.lit(">"), "accession", F.lit(" document > text\r\n"),
            F.regexp_replace(F.lower("seq"), "(.{70})", "$1\r\n"),
        ).alias("value")
    )
    records.write.text(path)
    return fasta.read_fasta(spark, path)


@query("write_fasta", sql(["v_sequences"], SEQUENCES))
def write_fasta(spark, sf):
    path = scratch_path(spark, "fasta")
    fasta.write_fasta(views.sequences(spark, sf), path)
    return fasta.read_fasta(spark, path)


@query(
    "write_protein_fasta",
    sql(
        ["v_sequences"],
        """select accession, seq, length(seq)::int seq_len from (
        select concat(accession,'_',row_number() over (partition by accession
          order by begin_pos, end_pos, strand)) accession, amino_acid_sequence seq from orfs) a""",
        genes.ORF_CTES,
    ),
)
def write_protein_fasta(spark, sf):
    path = scratch_path(spark, "proteins")
    fasta.write_protein_fasta(protein_table(genes.orfs(spark, sf)), path)
    return fasta.read_fasta(spark, path)


@query(
    "read_marker_metadata",
    sql(
        ["v_markers"],
        """select marker, specificity_class, class_code,
        case when class_code='K' then null else concat('note ',marker) end note from v_markers""",
    ),
)
def read_marker_metadata(spark, sf):
    """Header with odd case and blanks, several spellings of a missing value."""
    path = scratch_path(spark, "metadata")
    source = views.markers(spark, sf)
    note = F.when(F.col("class_code") == "K", F.lit("NaN")).otherwise(
        F.concat(F.lit("note "), "marker")
    )
    shown = source.select(
        F.col("marker").alias("MARKER "),
        F.col("specificity_class").alias("Specificity_Class"),
        F.coalesce("class_code", F.lit("NA")).alias("class_code"),
        F.coalesce(note, F.concat(F.lit("note "), "marker")).alias("note"),
    )
    shown.write.csv(path, sep="\t", header=True, ignoreTrailingWhiteSpace=False)
    return tables.read_marker_metadata(spark, path)


@query(
    "read_alignment_hits",
    sql(
        ["v_hits"],
        f"""select query, target, evalue, {r('bits', alias='bits')},
        case when broken then 0 else qlen end qlen, case when broken then 0 else tlen end tlen,
        case when broken then 0 else qstart end qstart, case when broken then 0 else qend end qend,
        case when broken then 0 else tstart end tstart, case when broken then 0 else tend end tend,
        case when broken then 0 else alnlen end alnlen from lines where not short""",
        {
            "lines": """select h.query, h.target, concat((l_discount*100)::int,'e-4') evalue,
              case when l_linenumber=7 then 1::double else h.bits end bits, h.qlen, h.tlen, h.qstart,
              h.qend, h.tstart, h.tend, h.alnlen, l_suppkey%10=3 broken,
              l_linenumber=6 and l_suppkey%2=0 short
              from (select *, concat('o',l_orderkey,'_',l_linenumber) query, concat('m',l_partkey%60) target,
                l_extendedprice/100 bits, floor(l_quantity*10)::bigint qlen, 200::bigint tlen,
                1::bigint qstart, floor(l_quantity*7)::bigint qend, 1::bigint tstart,
                least(200,floor(l_quantity*7))::bigint tend, floor(l_quantity*7)::bigint alnlen
                from lineitem) h"""
        },
    ),
)
def read_alignment_hits(spark, sf):
    """Well-formed lines beside lines with a bad score, a bad integer or too few fields."""
    path = scratch_path(spark, "hits")
    quantity = F.floor(F.col("l_quantity") * 7).cast("string")
    short = (F.col("l_linenumber") == 6) & (F.col("l_suppkey") % 2 == 0)
    query_name = F.concat(F.lit("o"), "l_orderkey", F.lit("_"), "l_linenumber")
    line = F.concat_ws(
        "\t",
        query_name,
        F.concat(F.lit("m"), F.col("l_partkey") % 60),
        F.concat((F.round(F.col("l_discount") * 100)).cast("int"), F.lit("e-4")),
        F.when(F.col("l_linenumber") == 7, "bad").otherwise(
            (F.col("l_extendedprice") / 100).cast("string")
        ),
        F.floor(F.col("l_quantity") * 10).cast("string"),
        F.when(F.col("l_suppkey") % 10 == 3, "x").otherwise("200"),
        F.lit("1"),
        quantity,
        F.lit("1"),
        F.least(F.lit(200), F.floor(F.col("l_quantity") * 7)).cast("string"),
        quantity,
    )
    text = F.when(short, F.concat(query_name, F.lit("\tonly\ttwo\n"))).otherwise(line)
    views.table(spark, sf, "lineitem").select(text.alias("value")).write.text(path)
    return tidy(tables.read_alignment_hits(spark, path))


@query(
    "read_feature_table",
    sql(
        [],
        f"""select concat('doc',doc_id) accession, {r('case when doc_id%7=0 then 0 else n_chars end', alias='chars')},
        {r('case when doc_id%5=0 then 0 else doc_id/8::double end', alias='eighth')} from documents""",
    ),
)
def read_feature_table(spark, sf):
    """Identifier in the second column; unreadable and empty cells."""
    path = scratch_path(spark, "features")
    number = F.col("doc_id")
    views.table(spark, sf, "documents").select(
        F.when(number % 7 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("chars"),
        F.concat(F.lit("doc"), "doc_id").alias("chunk_id"),
        F.when(number % 5 != 0, (number / 8.0).cast("string")).alias("eighth"),
    ).write.csv(path, sep="\t", header=True)
    return tidy(tables.read_feature_table(spark, path))


@query("read_labels", sql(["v_labels"], "select accession, label from v_labels"))
def read_labels(spark, sf):
    path = scratch_path(spark, "labels")
    views.labels(spark, sf).withColumn("more", F.lit("x")).write.csv(path, sep="\t", header=True)
    return tables.read_labels(spark, path)


BEST = f"select accession, marker, {r('bitscore', alias='bitscore')} from best"


@query("read_hits_json", sql(["v_hits", "v_markers"], BEST, markers.BEST_CTES))
def read_hits_json(spark, sf):
    path = scratch_path(spark, "hits-json")
    hits_json.write_hits_json(markers.best(spark, sf), path)
    return tidy(hits_json.read_hits_json(spark, path))


@query("write_hits_json", sql(["v_hits", "v_markers"], BEST, markers.BEST_CTES))
def write_hits_json(spark, sf):
    """The markers of a sequence split over several lines."""
    path = scratch_path(spark, "hits-json")
    hits_json.write_hits_json(markers.best(spark, sf), path, parts=3)
    return tidy(hits_json.read_hits_json(spark, path))


@query(
    "load_calibration",
    sql(["v_fold_scores"], f"select accession, fold, {ensemble.SHOWN} from x", ensemble.calibration_ctes("v_fold_scores", "x")),
)
def load_calibration(spark, sf):
    """Fold scores calibrated with parameters that went through a file."""
    path = scratch_path(spark, "calibration")
    given = ensemble.CALIBRATION
    text = (
        '{\n "classes": {'
        + ", ".join(f'"{k}": {{"w0": {a}, "w1": {b}}}' for k, (a, b) in given.classes.items())
        + f'}},\n "posthoc_top_label": {{"enabled": true, "target_class": {given.posthoc.target_class},'
        + f' "w0": {given.posthoc.w0}, "w1": {given.posthoc.w1}}}\n}}'
    )
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    read = models.load_calibration(spark, path)
    out = calibrate(ensemble.scores(spark, sf), read, CLASSES)
    return tidy(unpack(out.drop("logits", "chunk_len"), "probs", CLASSES, "p"))


@query("load_folds", sql(["v_fold_scores"], "select fold, count(*) n from v_fold_scores group by fold"))
def load_folds(spark, sf):
    rows = views.fold_scores(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return models.load_folds(rows)


@query(
    "select_folds",
    sql(["v_fold_scores"], "select fold, count(*) n from v_fold_scores where fold in ('fold_0','fold_1','fold_2') group by fold"),
)
def select_folds(spark, sf):
    rows = views.fold_scores(spark, sf)
    names = models.select_folds(rows.select("fold").distinct(), num_folds=3)
    return rows.where(F.col("fold").isin(names)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "load_marker_ref",
    sql(["v_marker_ref"], f"select fold, marker, coalesce(class_code,'') class_code, {r('cutoff', alias='cutoff')} from v_marker_ref"),
)
def load_marker_ref(spark, sf):
    path = scratch_path(spark, "marker-ref")
    views.marker_ref(spark, sf).write.csv(path, sep="\t", header=True, nullValue="")
    ref = models.load_marker_ref(spark, path, "tsv")
    return tidy(ref.withColumn("class_code", F.coalesce("class_code", F.lit(""))))


@query("write_report", sql(["v_fold_scores"], ensemble.CHUNKS, ensemble.CALL_CTES))
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    reports.write_report(ensemble.chunk_reports(spark, sf), path)
    text = spark.read.csv(path, sep="\t", header=True, nullValue="")
    words = ("accession", "predicted_host", "predicted_domain")
    return tidy(text.select(*[F.col(c) if c in words else F.col(c).cast("double") for c in text.columns]))


STAGED = f"""select a.accession, {genes.ROUNDED_ARCH}, n_genes, coalesce(h.n,0)::bigint hits
    from arch a left join (select regexp_replace(query,'_[^_]*$','') accession,
      count(distinct target) n from v_gene_hits where evalue<=1e-3 and target in ({markers.VIRAL})
      group by 1) h on a.accession=h.accession"""


@query(
    "load_staged_features",
    sql(["v_genes", "v_gene_chunks", "v_gene_hits", "v_markers"], STAGED, genes.FEATURE_CTES),
)
def load_staged_features(spark, sf):
    """The feature job's tables written, checked against the chunks, and reloaded."""
    folder = scratch_path(spark, "staged")
    kept, best = marker_ops.extract_markers(views.gene_hits(spark, sf), views.markers(spark, sf))
    reports.stage_features(folder, genes.arch(spark, sf), best)
    arch, hits = reports.load_staged_features(spark, folder, views.gene_chunks(spark, sf))
    counted = hits.groupBy("accession").agg(F.count(F.lit(1)).alias("hits"))
    joined = arch.join(counted, "accession", "left")
    return tidy(joined.withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint"))))


@query(
    "validate_inputs",
    sql(
        ["v_hits", "v_markers", "v_labels", "v_sequences"],
        """select 'hits' table_name, 'duplicate key' problem, concat_ws('|',query,target) detail,
          count(*) n_rows from v_hits group by query, target having count(*)>1
        union all
        select 'hits', 'not in viral markers', target, count(*) from v_hits
          where target not in (select marker from v_markers where upper(specificity_class)='VV')
          group by target
        union all select 'hits', 'missing column', 'pident', 0
        union all
        select 'sequences', 'not in labels', accession, count(*) from v_sequences
          where accession not in (select accession from v_labels) group by accession
        union all
        select 'markers', 'null key', 'class_code', count(*) from v_markers where class_code is null
        union all
        select 'markers', 'duplicate key', class_code, count(*) from v_markers
          where class_code is not null group by class_code having count(*)>1""",
    ),
)
def validate_inputs(spark, sf):
    viral = marker_ops.viral_markers(views.markers(spark, sf))
    checks = [
        TableCheck(
            "hits",
            views.hits(spark, sf),
            ["query", "target", "pident"],
            ["query", "target"],
            {"target": ("viral markers", viral, "marker")},
        ),
        TableCheck(
            "sequences",
            views.sequences(spark, sf),
            ["accession", "seq"],
            ["accession"],
            {"accession": ("labels", views.labels(spark, sf), "accession")},
        ),
        TableCheck("markers", views.markers(spark, sf), ["marker"], ["class_code"]),
    ]
    return find_problems(spark, checks)


EXPORT_CTES = {
    **genes.ORF_CTES,
    "c": "select accession, seq from v_sequences",
    **markers.PROTEIN_SEED_CTES,
    "exported": f"""select regexp_replace(query,'_[^_]*$','') accession, target marker, max(bits) bitscore
        from v_gene_hits where evalue<=1e-3 and target in ({markers.VIRAL}) group by 1, 2""",
}


@query(
    "export_marker_hits",
    sql(["v_sequences", "v_references", "v_markers"], f"select accession, marker, {r('bitscore', alias='bitscore')} from exported", EXPORT_CTES),
)
def export_marker_hits_query(spark, sf):
    """Whole sequences from a FASTA folder to a Parquet table of best hits."""
    source = scratch_path(spark, "export-fasta")
    fasta.write_fasta(views.sequences(spark, sf), source)
    return tidy(
        export_marker_hits(
            fasta.read_fasta(spark, source),
            views.markers(spark, sf),
            markers.protein_search(spark, sf),
            scratch_path(spark, "export"),
        )
    )
