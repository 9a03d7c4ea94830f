"""Calibration, fold combination, calls, roll-up and reports over fold scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqharbor.operators import calibration as cal
from seqharbor.operators import ensemble as ops
from seqharbor.operators.features import union_feature_columns
from seqharbor.sources.models import Calibration, Posthoc

from . import features, scoring, views
from .registry import query, r, tidy, unpack
from .scoring import S5, _softmax
from .views import CLASSES, LABELS, sql

CALIBRATION = Calibration(
    {0: (0.1, -0.05), 1: (0.2, 0.03), 2: (-0.1, 0.02), 3: (0.05, 0.0)},
    1000.0,
    Posthoc(2, 0.3, -0.1),
)
P5 = [f"p{i}" for i in range(CLASSES)]


def r4(expr: str, alias: str | None = None) -> str:
    return r(expr, 4, alias)


def _first_max(values: list[str]) -> str:
    top = f"greatest({','.join(values)})"
    return "case " + " ".join(f"when {v}={top} then {i}" for i, v in enumerate(values)) + " end"


def calibration_ctes(source: str, name: str, rounded: bool = True) -> dict[str, str]:
    """Scaling, softmax, correction of the target class; scores are s0..s4."""
    w = CALIBRATION.weights(CLASSES)
    rule = CALIBRATION.posthoc
    t = rule.target_class
    heat = [f"exp({a}::double+{b}::double*ln(greatest(chunk_len,1e-6)/1000::double))" for a, b in w]
    post = f"exp({rule.w0}::double+{rule.w1}::double*ln(greatest(chunk_len,1e-6)/1000::double))"
    q = [f"(case when {i}={t} then tc else v{i}*rest end)" for i in range(CLASSES)]
    value = [f"case when hit then q{i}/({'+'.join(f'q{k}' for k in range(CLASSES))}) else v{i} end" for i in range(CLASSES)]
    return {
        f"{name}_z": "select * exclude (s0,s1,s2,s3,s4), "
        + ", ".join(f"s{i}/{heat[i]} s{i}" for i in range(CLASSES))
        + f" from {source}",
        f"{name}_v": f"select *, {_softmax(S5, 'v')} from {name}_z",
        f"{name}_t": f"select *, ({_first_max([f'v{i}' for i in range(CLASSES)])})={t} hit,"
        f" greatest(least(v{t},1-1e-7),1e-7) t from {name}_v",
        f"{name}_c": f"select *, 1/(1+exp(-(ln(t/(1-t))/{post}))) tc from {name}_t",
        f"{name}_r": f"select *, greatest(1-tc,0)/greatest(1-t,1e-8) rest from {name}_c",
        f"{name}_q": "select *, " + ", ".join(f"{q[i]} q{i}" for i in range(CLASSES)) + f" from {name}_r",
        name: "select *, "
        + ", ".join(
            r4(value[i], f"p{i}") if rounded else f"{value[i]} p{i}" for i in range(CLASSES)
        )
        + f" from {name}_q",
    }


def scores(spark, sf):
    return views.fold_scores(spark, sf).drop("vec_id", "f")


def fold_probs(spark, sf):
    return cal.calibrate(scores(spark, sf), CALIBRATION, CLASSES)


SHOWN = ", ".join(r(p, alias=p) for p in P5)


@query(
    "softmax",
    sql(
        ["v_fold_scores"],
        f"select accession, fold, {', '.join(r4(f'v{i}', f'p{i}') for i in range(CLASSES))} from soft",
        {"soft": f"select *, {_softmax(S5, 'v')} from v_fold_scores"},
    ),
)
def softmax(spark, sf):
    out = cal.calibrate(scores(spark, sf), Calibration(None), CLASSES)
    return tidy(unpack(out.drop("logits", "chunk_len"), "probs", CLASSES, "p"))


@query(
    "vector_scaling",
    sql(
        ["v_fold_scores"],
        f"select accession, fold, {', '.join(r(f'v{i}', alias=f'p{i}') for i in range(CLASSES))} from x",
        calibration_ctes("v_fold_scores", "x"),
    ),
)
def vector_scaling(spark, sf):
    out = cal.vector_scaling(scores(spark, sf), CALIBRATION, CLASSES)
    return tidy(unpack(out.drop("logits", "chunk_len"), "probs", CLASSES, "p"))


@query(
    "posthoc_top_label",
    sql(["v_fold_scores"], f"select accession, fold, {SHOWN} from x", calibration_ctes("v_fold_scores", "x")),
)
def posthoc_top_label(spark, sf):
    scaled = cal.vector_scaling(scores(spark, sf), CALIBRATION, CLASSES)
    out = cal.posthoc_top_label(scaled, CALIBRATION, CLASSES)
    return tidy(unpack(out.drop("logits", "chunk_len"), "probs", CLASSES, "p"))


MEAN_CTES = {
    "mean": "select accession, genome, chunk_len, "
    + ", ".join(f"avg(s{i}) s{i}" for i in range(CLASSES))
    + " from v_fold_scores group by 1, 2, 3",
    **calibration_ctes("mean", "combined"),
}


def combined(spark, sf, mode="logit"):
    return ops.combine_folds(scores(spark, sf), CALIBRATION, CLASSES, mode)


@query("ensemble_logit", sql(["v_fold_scores"], f"select accession, chunk_len, {SHOWN} from combined", MEAN_CTES))
def ensemble_logit(spark, sf):
    return tidy(unpack(combined(spark, sf), "probs", CLASSES, "p"))


@query(
    "ensemble_probability",
    sql(
        ["v_fold_scores"],
        f"select accession, chunk_len, {', '.join(r4(f'avg({p})', p) for p in P5)} from x group by 1, 2",
        calibration_ctes("v_fold_scores", "x"),
    ),
)
def ensemble_probability(spark, sf):
    return tidy(unpack(combined(spark, sf, "probability"), "probs", CLASSES, "p"))


@query(
    "ensemble_entropy",
    sql(
        ["v_fold_scores"],
        f"select accession, chunk_len, {', '.join(r4(f'sum(w*{p})/sum(w)', p) for p in P5)} from e group by 1, 2",
        {
            **calibration_ctes("v_fold_scores", "x"),
            "e": "select *, 1/(-(" + "+".join(f"{p}*ln({p}+1e-9)" for p in P5) + ")+1e-4) w from x",
        },
    ),
)
def ensemble_entropy(spark, sf):
    return tidy(unpack(combined(spark, sf, "entropy"), "probs", CLASSES, "p"))


HOST = "case " + _first_max(P5) + " " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(LABELS)) + " end"
TOP = f"greatest({','.join(P5)})"
CALL_CTES = {
    **MEAN_CTES,
    "calls": f"select *, {HOST} host, {TOP} top from combined",
    "resolved": """select *, host='Prokaryote' and 1-p4>p4 conflict from calls""",
    "called": """select *, case when conflict then 'Unassigned' else host end predicted_host,
        case when not conflict then top end confidence from resolved""",
}


@query(
    "call_class",
    sql(["v_fold_scores"], f"select accession, host predicted_host, {r('top', alias='confidence')} from calls", CALL_CTES),
)
def call_class(spark, sf):
    called = ops.call_class(combined(spark, sf), LABELS)
    return tidy(called.select("accession", "predicted_host", "confidence"))


@query(
    "resolve_conflict",
    sql(
        ["v_fold_scores"],
        f"""select accession, predicted_host, {r('confidence', alias='confidence')},
        {r('top', alias='chunk_weight')} from called""",
        CALL_CTES,
    ),
)
def resolve_conflict(spark, sf):
    called = ops.resolve_conflict(ops.call_class(combined(spark, sf), LABELS), LABELS)
    return tidy(called.select("accession", "predicted_host", "confidence", "chunk_weight"))


DOMAIN = f"""{r4('p4', 'prokaryote_score')}, {r4('1-p4', 'eukaryote_score')},
    case when p4>=0.5 then 'Prokaryote' else 'Eukaryote' end predicted_domain,
    {r4('case when p4>=0.5 then p4 else 1-p4 end', 'domain_confidence')}"""


@query("domain_call", sql(["v_fold_scores"], f"select accession, {DOMAIN} from combined", MEAN_CTES))
def domain_call(spark, sf):
    return tidy(ops.domain_call(combined(spark, sf), LABELS).drop("probs", "chunk_len"))


GENOME_CTES = {
    **MEAN_CTES,
    "weighed": f"select *, {TOP} w from combined",
    "genome_mean": "select genome, " + ", ".join(f"sum({p}*w)/sum(w) {p}" for p in P5) + " from weighed group by genome",
    "genome_calls": f"select *, {HOST} host, {TOP} top from genome_mean",
}
GENOMES = f"""select genome,
    case when p4>=0.5 then 'Prokaryote' else 'Eukaryote' end predicted_domain,
    {r4('case when p4>=0.5 then p4 else 1-p4 end', 'domain_confidence')},
    case when host='Prokaryote' and 1-p4>p4 then 'Unassigned' else host end predicted_host,
    case when host='Prokaryote' and 1-p4>p4 then null else {r4('top')} end confidence
    from genome_calls"""


@query("genome_consensus", sql(["v_fold_scores"], GENOMES, GENOME_CTES))
def genome_consensus(spark, sf):
    return tidy(ops.genome_consensus(combined(spark, sf), LABELS))


NAMED = ", ".join(f"{r(p)} as \"{n}\"" for p, n in zip(P5, LABELS))


@query(
    "fold_report",
    sql(
        ["v_fold_scores"],
        f"""select accession, fold, {HOST} predicted_host, {r4(TOP, 'confidence')},
        {r4('alpha', 'glm_gate_weight')}, {NAMED} from x""",
        {
            "with_alpha": """select f.*, case when vec_id%6<>0 then (1+vec_id%10)/11::double end alpha
                from v_fold_scores f""",
            **calibration_ctes("with_alpha", "x"),
        },
    ),
)
def fold_report(spark, sf):
    rows = views.fold_scores(spark, sf).withColumn(
        "alpha",
        F.when(F.col("vec_id") % 6 != 0, (1 + F.col("vec_id") % 10) / F.lit(11.0)).otherwise(
            F.lit(float("nan"))
        ),
    )
    return tidy(ops.fold_report(cal.calibrate(rows, CALIBRATION, CLASSES), LABELS))


@query(
    "model_scores_report",
    sql(
        ["v_fold_scores"],
        f"""select accession, fold, n_genes, {HOST} predicted_host, {r(TOP, alias='confidence')},
        {r4('alpha', 'glm_gate_weight')}, {NAMED}, """
        + ", ".join(f"{r4(scoring.TREE_P[i])} as \"xgb_{n}\"" for i, n in enumerate(LABELS))
        + ", "
        + ", ".join(f"{r4(f'g{i}')} as \"glm_{n}\"" for i, n in enumerate(LABELS))
        + ", "
        + ", ".join(f"{r4(f'u{i}')} as \"uncalibrated_ensemble_{n}\"" for i, n in enumerate(LABELS))
        + " from shown",
        {
            **scoring.MIX_CTES,
            "scored": "select m.* exclude (s0,s1,s2,s3,s4,x), "
            + ", ".join(f"l{i} s{i}" for i in range(CLASSES))
            + " from mixed m",
            **calibration_ctes("scored", "x5"),
            "shown": f"select *, {_softmax([f'l{i}' for i in range(CLASSES)], 'u')} from x5",
        },
    ),
)
def model_scores_report(spark, sf):
    lengths = views.fold_scores(spark, sf).select("fold", "accession", "chunk_len")
    rows = (
        scoring.mixed(spark, sf)
        .withColumnsRenamed({"logits": "model_logits", "probs": "tree_probs", "log_probs": "logits"})
        .withColumn("n_genes", F.col("marker")[0].cast("bigint"))
        .join(lengths, ["fold", "accession"])
    )
    return tidy(ops.model_scores_report(cal.calibrate(rows, CALIBRATION, CLASSES), LABELS))


CHUNKS = f"""select accession, predicted_host, {r('confidence', alias='confidence')}, {NAMED}, {DOMAIN}
    from called"""


def chunk_reports(spark, sf):
    return ops.chunk_report(ops.call_chunks(combined(spark, sf), LABELS), LABELS)


@query("chunk_report", sql(["v_fold_scores"], CHUNKS, CALL_CTES))
def chunk_report(spark, sf):
    return tidy(chunk_reports(spark, sf))


@query(
    "features_report",
    sql(
        features.VIEWS,
        f"select accession, {features.rounded(features.UNION)} from wide where fold='fold_0'",
        features.CTES,
    ),
)
def features_report(spark, sf):
    return tidy(ops.features_report(union_feature_columns(features.wide(spark, sf)), "fold_0"))
