"""Marker operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqharbor.constants import DOMAIN_MARKER_FEATURES, HOST_MARKER_FEATURES, RESIDUE_FREQUENCIES
from seqharbor.operators import alignment
from seqharbor.operators import genes as gene_ops
from seqharbor.operators import markers as ops
from seqharbor.plans.predict import protein_table
from seqharbor.session import materialize

from . import views
from .genes import ORF_CTES, orfs, residue_sql
from .registry import query, r, tidy
from .views import sql

MARKER_FOLDS = ["fold_0", "fold_1"]


@query(
    "viral_markers",
    sql(["v_markers"], f"""select marker, specificity_class, class_code, {r('cutoff', alias='cutoff')}
        from v_markers where upper(specificity_class)='VV'"""),
)
def viral_markers(spark, sf):
    return tidy(ops.viral_markers(views.markers(spark, sf)))


COVERAGE = """case when qlen<>0 then alnlen/qlen::double else 0 end query_cov,
    case when tlen<>0 then alnlen/tlen::double else 0 end target_cov"""


@query(
    "hit_coverage",
    sql(
        ["v_hits"],
        f"select query, target, {r('query_cov', alias='query_cov')}, {r('target_cov', alias='target_cov')} "
        f"from (select query, target, {COVERAGE} from v_hits) a",
    ),
)
def hit_coverage(spark, sf):
    covered = ops.hit_coverage(views.hits(spark, sf))
    return tidy(covered.select("query", "target", "query_cov", "target_cov"))


FILTERED = """select * from v_hits where evalue<=1e-3 and (qend-qstart+1)/qlen::double>=0.5
    and (tend-tstart+1)/tlen::double>=0.5"""


@query(
    "filter_hits",
    sql(["v_hits"], f"select query, target, {r('evalue', alias='evalue')}, alnlen from ({FILTERED}) a"),
)
def filter_hits(spark, sf):
    kept = ops.filter_hits(views.hits(spark, sf), 1e-3, 0.5)
    return tidy(kept.select("query", "target", "evalue", "alnlen"))


VIRAL = "select marker from v_markers where upper(specificity_class)='VV'"


@query(
    "whitelist_hits",
    sql(["v_hits", "v_markers"], f"""select query, target, {r('bits', alias='bits')}
        from v_hits where target in ({VIRAL})"""),
)
def whitelist_hits(spark, sf):
    kept = ops.whitelist_hits(views.hits(spark, sf), ops.viral_markers(views.markers(spark, sf)))
    return tidy(kept.select("query", "target", "bits"))


@query(
    "parent_id",
    sql(["v_hits"], "select query, regexp_replace(query,'_[^_]*$','') parent_seq_id, count(*) n from v_hits group by all"),
)
def parent_id(spark, sf):
    return (
        views.hits(spark, sf)
        .groupBy("query", ops.parent_id().alias("parent_seq_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


BEST_CTES = {
    "retained": f"select * from v_hits where target in ({VIRAL})",
    "best": """select regexp_replace(query,'_[^_]*$','') accession, target marker, max(bits) bitscore
        from retained group by all""",
}


def best(spark, sf):
    kept = ops.whitelist_hits(views.hits(spark, sf), ops.viral_markers(views.markers(spark, sf)))
    return ops.best_hits(kept)


@query(
    "best_hits",
    sql(["v_hits", "v_markers"], f"select accession, marker, {r('bitscore', alias='bitscore')} from best", BEST_CTES),
)
def best_hits(spark, sf):
    return tidy(best(spark, sf))


ANNOTATED = f"""select regexp_replace(h.query,'_[^_]*$','') parent_seq_id, h.query protein_id,
    coalesce(amino_acid_sequence,'') amino_acid_sequence,
    coalesce(protein_start::varchar,'') protein_start, coalesce(protein_end::varchar,'') protein_end,
    coalesce(protein_strand::varchar,'') protein_strand,
    case when partial_begin then 'True' when not partial_begin then 'False' else '' end partial_begin,
    case when partial_end then 'True' when not partial_end then 'False' else '' end partial_end,
    coalesce(start_type,'') start_type, coalesce(rbs_motif,'') rbs_motif,
    coalesce(rbs_spacer,'') rbs_spacer, coalesce(translation_table::varchar,'') translation_table,
    h.target marker_id,
    {r('evalue', alias='evalue')}, {r('bits', alias='bitscore')}, qlen query_length,
    tlen target_length, qstart query_start, qend query_end, tstart target_start, tend target_end,
    alnlen alignment_length, {r('query_cov', alias='query_coverage')},
    {r('target_cov', alias='target_coverage')}, m.marker marker_marker,
    m.specificity_class marker_specificity_class, coalesce(m.class_code,'') marker_class_code,
    {r('m.cutoff', alias='marker_cutoff')}
    from (select *, {COVERAGE} from v_gene_hits where evalue<=1e-3) h
    join v_markers m on h.target=m.marker and upper(m.specificity_class)='VV'
    left join v_proteins p on h.query=p.protein_id"""


@query("annotate_hits", sql(["v_gene_hits", "v_proteins", "v_markers"], ANNOTATED))
def annotate_hits(spark, sf):
    metadata = views.markers(spark, sf)
    kept, _ = ops.extract_markers(views.gene_hits(spark, sf), metadata)
    text = ops.annotate_hits(kept, views.proteins(spark, sf), ops.viral_markers(metadata))
    real = ["evalue", "bitscore", "query_coverage", "target_coverage", "marker_cutoff"]
    whole = [
        "query_length", "target_length", "query_start", "query_end",
        "target_start", "target_end", "alignment_length",
    ]
    return tidy(
        text.withColumns({c: F.col(c).cast("double") for c in real}).withColumns(
            {c: F.col(c).cast("bigint") for c in whole}
        )
    )


def _family(name: str, codes: list[str]) -> str:
    inside = "filter (where class_code in (" + ",".join(f"'{c}'" for c in codes) + "))"
    return f"count(*) {inside} {name}_n, median(ratio) {inside} {name}_median, max(ratio) {inside} {name}_max"


FAMILIES = {
    "prok": ["K"],
    "euk": ["A", "F", "P", "T", "E"],
    "protist": ["T", "KT"],
    "fungi": ["F"],
    "animal": ["A"],
    "plant": ["P"],
    "specific": ["A", "F", "P", "T", "K", "KT"],
}
SUMMARY_CTES = {
    **BEST_CTES,
    "ratios": """select fold, accession, class_code, bitscore/cutoff ratio
        from best b join v_marker_ref m on b.marker=m.marker where class_code is not null""",
    "grouped": "select fold, accession, count(*) n_classified, "
    + ", ".join(_family(name, codes) for name, codes in FAMILIES.items())
    + " from ratios group by fold, accession",
    "summary": """select f.fold, c.accession, g.* exclude (fold, accession)
        from v_hit_chunks c join (select unnest(['fold_0','fold_1']) fold) f on true
        left join grouped g on g.fold=f.fold and g.accession=c.accession""",
}
KINDS = {
    "marker_freq": "coalesce({f}_n,0)/greatest(coalesce(n_classified,0),1)",
    "median_bitscore": "{f}_median",
    "max_bitscore": "{f}_max",
}


def feature_sql(names: list[str]) -> str:
    parts = []
    for name in names:
        family, kind = name.split("_", 1)
        parts.append(r(KINDS[kind].format(f=family), alias=name))
    return ", ".join(parts)


SUMMARY_VIEWS = ["v_hits", "v_markers", "v_marker_ref", "v_hit_chunks"]


def summary(spark, sf):
    return ops.marker_summary(
        views.hit_chunks(spark, sf), best(spark, sf), views.marker_ref(spark, sf), MARKER_FOLDS
    )


@query(
    "domain_marker_features",
    sql(SUMMARY_VIEWS, f"select fold, accession, {feature_sql(DOMAIN_MARKER_FEATURES)} from summary", SUMMARY_CTES),
)
def domain_marker_features(spark, sf):
    return tidy(ops.domain_marker_features(summary(spark, sf)))


@query(
    "host_marker_features",
    sql(SUMMARY_VIEWS, f"select fold, accession, {feature_sql(HOST_MARKER_FEATURES)} from summary", SUMMARY_CTES),
)
def host_marker_features(spark, sf):
    return tidy(ops.host_marker_features(summary(spark, sf)))


@query(
    "gate_context",
    sql(
        SUMMARY_VIEWS,
        f"""select fold, accession, {r('coalesce(specific_n,0)', alias='specific_count')},
        {r('specific_median', alias='specific_median_bitscore')},
        {r('specific_max', alias='specific_max_bitscore')} from summary""",
        SUMMARY_CTES,
    ),
)
def gate_context(spark, sf):
    return tidy(ops.gate_context(summary(spark, sf)))


K, SHARE = 12, 0.3
def _seed_ctes(k: int, share: float) -> dict[str, str]:
    return {
        "tk": f"select distinct target, substring(seq, i, {k}) kmer from (select target, seq, unnest(range(1, length(seq)-{k}+2)) i from targets) a",
        "qk": f"select distinct query, substring(seq, i, {k}) kmer from (select query, seq, unnest(range(1, length(seq)-{k}+2)) i from queries) a",
        "sizes": "select target, count(*) target_kmers from tk group by target",
        "shared": "select query, target, count(*) shared from qk join tk on qk.kmer=tk.kmer group by all",
        "seed_hits": f"""select query, s.target, shared, target_kmers, shared/target_kmers containment
            from shared s join sizes z on s.target=z.target
            where shared>=ceil(target_kmers*{share}::double-1e-9)""",
    }


SEED_CTES = _seed_ctes(K, SHARE)
TOP = """select * exclude (containment), {c} from (select *, (row_number() over (partition by query
    order by containment desc, shared desc, target))::int rank from seed_hits) a where rank<=3""".format(
    c=r("containment", alias="containment")
)


@query(
    "kmer_seed_hits",
    sql(
        ["v_sequences", "v_references"],
        TOP,
        {
            "queries": "select accession query, seq from v_sequences",
            "targets": "select target, seq from v_references",
            **SEED_CTES,
        },
    ),
)
def kmer_seed_hits(spark, sf):
    queries = views.sequences(spark, sf).withColumnRenamed("accession", "query")
    return tidy(ops.kmer_seed_hits(queries, views.references(spark, sf), K, SHARE, 3))


@query(
    "hit_summary",
    sql(
        ["v_hits", "v_markers", "v_proteins"],
        """select count(*) marker_hits, count(distinct accession) sequences_with_hits,
        (select count(*) from v_proteins) proteins from best""",
        BEST_CTES,
    ),
)
def hit_summary(spark, sf):
    return ops.hit_summary(best(spark, sf), views.proteins(spark, sf))


@query(
    "extract_markers",
    sql(
        ["v_genes", "v_gene_hits", "v_markers"],
        f"""select regexp_replace(query,'_[^_]*$','') accession, target marker,
        {r('max(bits)', alias='bitscore')} from v_gene_hits
        where evalue<=1e-3 and (qend-qstart+1)/qlen::double>=0.2 and (tend-tstart+1)/tlen::double>=0.2
        and target in ({VIRAL}) group by 1, 2""",
    ),
)
def extract_markers(spark, sf):
    """Supplied alignment hits to best hits over the viral markers."""
    _, found = ops.extract_markers(views.gene_hits(spark, sf), views.markers(spark, sf), 1e-3, 0.2)
    return tidy(found)


#: Proteins of ``orfs`` against the translated references, which are named like markers. SQL expresses alignments
#: on one diagonal, so these queries search without gaps.
PROTEIN_K = 4
SCORES = alignment.Scoring()
LAMBDA, KARLIN = SCORES.statistics()


def _letters(text) -> str:
    return ", ".join(f"'{c}'" for c in text)


_ALIKE = " or ".join(f"(a in ({_letters(g)}) and b in ({_letters(g)}))" for g in SCORES.groups)


def _seed_places(table: str, name: str, at: str) -> str:
    return f"""select {name}, i-1 {at}, substring(seq, i, {PROTEIN_K}) kmer
        from (select {name}, seq, unnest(range(1, length(seq)-{PROTEIN_K}+2)) i from {table}) a"""


PROTEIN_SEED_CTES = {
    "queries": """select concat(accession,'_',row_number() over (partition by accession
        order by begin_pos, end_pos, strand)) query, amino_acid_sequence seq from orfs""",
    "targets": """select target, string_agg(aa,'' order by i) seq from (
        select target, i, """
    + residue_sql("substring(seq, 3*i+1, 3)")
    + """ aa from (select replace(target,'b','m') target, seq, unnest(range(0, length(seq)//3)) i from v_references) x) y
        group by target""",
    "query_seeds": _seed_places("queries", "query", "qp"),
    "target_seeds": _seed_places("targets", "target", "tp"),
    "diagonals": """select query, target, qp-tp d, count(*) n from query_seeds join target_seeds using (kmer)
        group by all having count(*)>=2""",
    "seed_pairs": """select query, target, d from diagonals
        qualify row_number() over (partition by query, target order by n desc, d)=1""",
    "residue_pairs": """select query, target, d, tp, qlen, tlen, substring(qs, tp+d+1, 1) a, substring(ts, tp+1, 1) b from (
        select query, target, d, q.seq qs, t.seq ts, length(q.seq) qlen, length(t.seq) tlen,
        unnest(range(greatest(0,-d), least(length(t.seq), length(q.seq)-d))) tp
        from seed_pairs join queries q using (query) join targets t using (target)) x""",
    "residue_scores": f"""select *, case when a=b and a in ({_letters(SCORES.rare_residues)}) then {SCORES.rare}
        when a=b and a in ({_letters(RESIDUE_FREQUENCIES)}) then {SCORES.same} when {_ALIKE} then {SCORES.alike}
        else {SCORES.other} end s from residue_pairs""",
    "sums": "select *, sum(s) over (partition by query, target order by tp) total from residue_scores",
    "gains": """select *, least(0, coalesce(min(total) over (partition by query, target order by tp
        rows between unbounded preceding and 1 preceding), 0)) low from sums""",
    "ends": """select query, target, tp last, total-low score, low, d, qlen, tlen from gains where total>low
        qualify row_number() over (partition by query, target order by total-low desc, tp)=1""",
    "begins": """select e.query, e.target, coalesce(max(case when g.total=e.low and g.tp<e.last then g.tp+1 end),
        min(g.tp)) first from ends e join gains g on g.query=e.query and g.target=e.target group by all""",
    "v_gene_hits": f"""select query, target, qlen*(select sum(length(seq)) from targets)::double*pow(2.0::double, -bits) evalue,
        bits, qlen, tlen, first+d+1 qstart, last+d+1 qend, first+1 tstart, last+1 tend, last-first+1 alnlen from (
        select e.*, b.first, ({LAMBDA!r}::double*score-ln({KARLIN!r}::double))/ln(2.0::double) bits
        from ends e join begins b on b.query=e.query and b.target=e.target) z""",
}


def protein_search(spark, sf, band: int = 0):
    """The search of a run: proteins against the translated references."""
    targets = views.references(spark, sf).select(
        F.regexp_replace("target", "b", "m").alias("target"), gene_ops.translate_codons("seq").alias("seq")
    )

    def search(proteins):
        queries = proteins.select(F.col("protein_id").alias("query"), F.col("amino_acid_sequence").alias("seq"))
        return alignment.search_alignments(queries, targets, PROTEIN_K, band=band)

    return search


MARKER_PIPELINE = f"""select regexp_replace(query,'_[^_]*$','') accession, target marker,
    {r('max(bits)', alias='bitscore')} from v_gene_hits
    where evalue<=1e-3 and (tend-tstart+1)/tlen::double>=0.2 and (qend-qstart+1)/qlen::double>=0
    and target in ({VIRAL}) group by 1, 2"""


@query(
    "marker_pipeline",
    sql(["v_sequences", "v_references", "v_markers"], MARKER_PIPELINE, {**ORF_CTES, **PROTEIN_SEED_CTES}),
)
def marker_pipeline(spark, sf):
    """Sequences to best hits in one call: chunks, genes, proteins, own search, filter, whitelist."""
    proteins = protein_table(materialize(orfs(spark, sf), "orfs"))
    hits = protein_search(spark, sf)(proteins)
    kept = ops.whitelist_hits(ops.filter_hits(hits, 1e-3, 0.0), ops.viral_markers(views.markers(spark, sf)))
    long_enough = kept.where((F.col("tend") - F.col("tstart") + 1) / F.col("tlen") >= 0.2)
    return tidy(ops.best_hits(long_enough))


@query("protein_alignments")
def protein_alignments(spark, sf):
    """The search with gaps: alignments of all proteins within eight residues of their best diagonal."""
    proteins = protein_table(materialize(orfs(spark, sf), "orfs"))
    hits = ops.filter_hits(protein_search(spark, sf, band=8)(proteins), 10.0, 0.05, 0.2)
    return tidy(hits)


@query(
    "ungapped_alignments",
    sql(
        ["v_sequences", "v_references"],
        f"""select query, target, {r('evalue*1e6', alias='evalue_ppm')}, {r('bits', alias='bits')}, qlen, tlen, qstart, qend,
        tstart, tend, alnlen from v_gene_hits where evalue<=10
        and (qend-qstart+1)/qlen::double>=0.05 and (tend-tstart+1)/tlen::double>=0.05""",
        {**ORF_CTES, **PROTEIN_SEED_CTES},
    ),
)
def ungapped_alignments(spark, sf):
    """The search without gaps, with its spans, expectations and both thresholds."""
    hits = ops.filter_hits(protein_search(spark, sf)(protein_table(materialize(orfs(spark, sf), "orfs"))), 10.0, 0.05)
    columns = ["bits", "qlen", "tlen", "qstart", "qend", "tstart", "tend", "alnlen"]
    return tidy(hits.select("query", "target", (F.col("evalue") * 1e6).alias("evalue_ppm"), *columns))


@query(
    "sequence_marker_hits",
    sql(
        ["v_sequences", "v_references"],
        f"""select regexp_replace(query,'_[^_]*$','') accession, target marker, max(shared) shared,
        {r('max(containment)', alias='containment')} from seed_hits group by 1, 2""",
        {
            **ORF_CTES,
            "queries": """select concat(accession,'_',row_number() over (partition by accession
                order by begin_pos, end_pos, strand)) query, amino_acid_sequence seq from orfs""",
            "targets": """select target, string_agg(aa,'' order by i) seq from (
                select target, i, """
            + residue_sql("substring(seq, 3*i+1, 3)")
            + """ aa from (select target, seq, unnest(range(0, length(seq)//3)) i from v_references) x) y
                group by target""",
            **_seed_ctes(6, SHARE),
        },
    ),
)
def sequence_marker_hits(spark, sf):
    """Sequences to marker hits: chunk, scan, translate, number, seed search, best per chunk.

    Proteins are read once, by the search, so they go to it from the scan and are not written.
    """
    targets = views.references(spark, sf).withColumn("seq", gene_ops.translate_codons("seq"))
    found = ops.kmer_seed_hits(
        orfs(spark, sf).select(F.col("protein_id").alias("query"), F.col("amino_acid_sequence").alias("seq")),
        targets,
        6,
        SHARE,
    )
    return tidy(
        found.groupBy(ops.parent_id().alias("accession"), F.col("target").alias("marker")).agg(
            F.max("shared").alias("shared"), F.max("containment").alias("containment")
        )
    )
