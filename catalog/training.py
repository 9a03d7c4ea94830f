"""Labels, sampling and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqharbor.operators import training as ops

from . import views
from .registry import query, r, tidy
from .scoring import S5
from .views import CLASSES, sql

SEED, EPOCH, VAL_SHARE, MAX_PROP = 42, 3, 0.2, 0.6


def languages(spark, sf):
    """A label for every document: its language."""
    docs = views.table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("doc"), "doc_id").alias("accession"), F.col("lang").alias("label"))


LANGUAGES = "select concat('doc',doc_id) accession, lang as label from documents"


@query(
    "label_index",
    sql([], "select label, (row_number() over (order by label)-1)::int label_idx from (select distinct label from lang_labels) a", {"lang_labels": LANGUAGES}),
)
def label_index(spark, sf):
    return ops.label_index(languages(spark, sf))


@query(
    "join_labels",
    sql(
        ["v_sequences", "v_labels"],
        """select s.accession, length(seq)::int seq_len, coalesce(label,'') label, label is null skipped
        from v_sequences s left join v_labels l on s.accession=l.accession""",
    ),
)
def join_labels(spark, sf):
    """The labelled sequences and, marked, the skipped ones."""
    s, labels = views.sequences(spark, sf), views.labels(spark, sf)
    kept = ops.join_labels(s, labels).select(
        "accession", F.length("seq").alias("seq_len"), "label", F.lit(False).alias("skipped")
    )
    lengths = s.select("accession", F.length("seq").alias("seq_len"))
    skipped = ops.skipped_sequences(s, labels).join(lengths, "accession").select(
        "accession", "seq_len", F.lit("").alias("label"), F.lit(True).alias("skipped")
    )
    return kept.unionByName(skipped)


@query(
    "class_distribution",
    sql([], f"select label, n, {r('100*n/sum(n) over ()', alias='percent')} from (select label, count(*) n from lang_labels group by label) a", {"lang_labels": LANGUAGES}),
)
def class_distribution(spark, sf):
    return tidy(ops.class_distribution(languages(spark, sf)))


@query(
    "class_weights",
    sql([], f"select label, {r('sum(n) over ()/(count(*) over ()*n)', alias='weight')} from (select label, count(*) n from lang_labels group by label) a", {"lang_labels": LANGUAGES}),
)
def class_weights(spark, sf):
    return tidy(ops.class_weights(languages(spark, sf)))


def _split_ctes(source: str) -> dict[str, str]:
    return {
        "counts": f"select label, count(*) n from {source} group by label",
        "sized": f"select *, sum(n) over () rows, sum(n) over ()-ceil({VAL_SHARE}*sum(n) over ()-1e-9) n_train from counts",
        "shares": "select *, floor(n*n_train/rows::double)::bigint base, n*n_train/rows::double exact from sized",
        "quotas": """select label, n-(base+case when row_number() over (order by base-exact, label)
            <=n_train-sum(base) over () then 1 else 0 end) val from shares""",
        "split": f"""select accession, a.label, case when rank<=val then 'val' else 'train' end split
          from (select *, row_number() over (partition by label
            order by md5(concat_ws('|',accession,'{SEED}')), accession) as rank from {source}) a
          join quotas q on a.label=q.label""",
    }


@query("stratified_split", sql([], "select * from split", {"lang_labels": LANGUAGES, **_split_ctes("lang_labels")}))
def stratified_split(spark, sf):
    return ops.stratified_split(languages(spark, sf), VAL_SHARE, SEED)


DRAW = SEED + EPOCH
SAMPLE_CTES = {
    "quota": f"""select least(sum((label='Prokaryote')::int),
        floor(sum((label<>'Prokaryote')::int)*{MAX_PROP}/(1-{MAX_PROP})))::bigint q from v_labels""",
    "sample": f"""select accession, label, md5(concat_ws('|',accession,'{DRAW}','order')) "position" from (
        select *, row_number() over (partition by label
          order by md5(concat_ws('|',accession,'{DRAW}')), accession) as rank from v_labels) a
        where label<>'Prokaryote' or rank<=(select q from quota)""",
}


def sample(spark, sf):
    return ops.undersample_class(views.labels(spark, sf), "Prokaryote", MAX_PROP, SEED, EPOCH)


@query("undersample_class", sql(["v_labels"], "select * from sample", SAMPLE_CTES))
def undersample_class(spark, sf):
    return sample(spark, sf)


@query("sampled_counts", sql(["v_labels"], "select label, count(*) n from sample group by label", SAMPLE_CTES))
def sampled_counts(spark, sf):
    return ops.sampled_counts(sample(spark, sf))


def document_features(spark, sf):
    """Features for two thirds of the documents."""
    docs = views.table(spark, sf, "documents").where(F.col("doc_id") % 3 != 0)
    return docs.select(
        F.concat(F.lit("doc"), "doc_id").alias("accession"),
        (F.col("n_chars") / 7.0).alias("chars"),
        (F.col("doc_id") % 11).cast("double").alias("eleventh"),
    )


DOC_FEATURES = """select concat('doc',doc_id) accession, n_chars/7::double chars,
    (doc_id%11)::double eleventh from documents where doc_id%3<>0"""


@query(
    "load_fold_training_set",
    sql(
        ["v_sequences"],
        f"""select s.accession, length(seq)::int seq_len, l.label, label_idx,
        {r('coalesce(chars,0)::float', 4, 'feature0')}, {r('coalesce(eleventh,0)::float', 4, 'raw0')}
        from v_sequences s join lang_labels l on s.accession=l.accession
        join idx on idx.label=l.label left join doc_features f on f.accession=s.accession""",
        {
            "lang_labels": LANGUAGES,
            "idx": "select label, (row_number() over (order by label)-1)::int label_idx from (select distinct label from lang_labels) a",
            "doc_features": DOC_FEATURES,
        },
    ),
)
def load_fold_training_set(spark, sf):
    table = document_features(spark, sf)
    rows = ops.load_fold_training_set(
        views.sequences(spark, sf),
        languages(spark, sf),
        table.select("accession", "chars"),
        table.select("accession", "eleventh"),
    )
    return tidy(
        rows.select(
            "accession",
            F.length("seq").alias("seq_len"),
            "label",
            "label_idx",
            F.col("features")[0].alias("feature0"),
            F.col("raw_features")[0].alias("raw0"),
        ),
        4,
    )


@query(
    "load_training_set",
    sql(
        ["v_sequences", "v_labels"],
        f"""select s.accession, length(seq)::int seq_len, p.label, label_idx, split,
        {r('(length(seq)/3::double)::float', 4, 'feature0')}
        from v_sequences s join split p on s.accession=p.accession join idx on idx.label=p.label""",
        {
            "labelled": "select l.* from v_labels l join v_sequences s on s.accession=l.accession",
            "idx": "select label, (row_number() over (order by label)-1)::int label_idx from (select distinct label from v_labels) a",
            **_split_ctes("labelled"),
        },
    ),
)
def load_training_set(spark, sf):
    s = views.sequences(spark, sf)
    table = s.select("accession", (F.length("seq") / 3.0).alias("third"))
    rows = ops.load_training_set(s, views.labels(spark, sf), table, VAL_SHARE, SEED)
    return tidy(
        rows.select(
            "accession",
            F.length("seq").alias("seq_len"),
            "label",
            "label_idx",
            "split",
            F.col("features")[0].alias("feature0"),
        ),
        4,
    )


BETA, GAMMA = 0.99, 2.0


def scored(spark, sf):
    return views.fold_scores(spark, sf).withColumn("label", (F.col("vec_id") % CLASSES).cast("int"))


LOSS_CTES = {
    "counts": "select vec_id%5 label, count(*) n from v_fold_scores group by 1",
    "effective": f"select label, 1-pow({BETA}::double, n) e from counts",
    "raw_weights": f"select label, (1-{BETA}::double)/case when e=0 then 1e-8 else e end w from effective",
    "weights": "select label, w*5/sum(w) over () w from raw_weights",
    "nll": "select vec_id%5 label, ln("
    + "+".join(f"exp({s})" for s in S5)
    + ")-[s0,s1,s2,s3,s4][vec_id%5+1] nll from v_fold_scores",
}


def _weights(spark, sf):
    return ops.class_balanced_weights(ops.samples_per_class(scored(spark, sf), CLASSES), BETA)


@query(
    "class_balanced_weights",
    sql(["v_fold_scores"], f"select label, n, {r('w', alias='weight')} from counts join weights using (label)", LOSS_CTES),
)
def class_balanced_weights(spark, sf):
    weights = F.array(*[F.lit(w) for w in _weights(spark, sf)])
    return tidy(
        scored(spark, sf)
        .groupBy(F.col("label").cast("bigint").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("weight", weights[F.col("label").cast("int")])
    )


@query(
    "weighted_cross_entropy",
    sql(["v_fold_scores"], f"select {r('sum(w*nll)/sum(w)', alias='loss')} from nll join weights using (label)", LOSS_CTES),
)
def weighted_cross_entropy(spark, sf):
    counts = ops.samples_per_class(scored(spark, sf), CLASSES)
    return tidy(ops.class_balanced_loss(scored(spark, sf), CLASSES, BETA, counts))


@query(
    "focal_loss",
    sql(
        ["v_fold_scores"],
        f"""select 'weighted' kind, {r(f'avg(w*pow(1-exp(-nll),{GAMMA}::double)*nll)', alias='loss')}
        from nll join weights using (label) union all
        select 'plain', {r(f'avg(pow(1-exp(-nll),{GAMMA}::double)*nll)')} from nll""",
        LOSS_CTES,
    ),
)
def focal_loss(spark, sf):
    rows = scored(spark, sf)
    counts = ops.samples_per_class(rows, CLASSES)
    weighted = ops.class_balanced_loss(rows, CLASSES, BETA, counts, "focal", GAMMA)
    plain = ops.focal_loss(rows, CLASSES)
    return tidy(
        weighted.withColumn("kind", F.lit("weighted")).unionByName(plain.withColumn("kind", F.lit("plain")))
    )
