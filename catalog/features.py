"""Feature-matrix operators over architecture and marker features of one set of chunks.

Architecture features come from the gene view; its chunks also get marker hits, through the
alignment hits of their proteins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqharbor.constants import ARCH_MODEL_FEATURES, DOMAIN_MARKER_FEATURES, HOST_MARKER_FEATURES
from seqharbor.operators import features as ops
from seqharbor.operators import markers as marker_ops
from seqharbor.operators.scoring import hierarchical_probs, score_trees
from seqharbor.session import materialize

from . import views
from .genes import FEATURE_CTES, arch
from .markers import KINDS, MARKER_FOLDS, SUMMARY_CTES, VIRAL
from .registry import query, r, tidy
from .views import sql

VIEWS = ["v_genes", "v_gene_chunks", "v_gene_hits", "v_markers", "v_marker_ref"]
CTES = {
    **FEATURE_CTES,
    "retained": f"select * from v_gene_hits where evalue<=1e-3 and target in ({VIRAL})",
    **{k: t.replace("v_hit_chunks", "v_gene_chunks") for k, t in SUMMARY_CTES.items() if k != "retained"},
}


def _plain(names: list[str]) -> str:
    """Unrounded marker feature columns."""
    parts = []
    for name in names:
        family, kind = name.split("_", 1)
        parts.append(f"{KINDS[kind].format(f=family)} {name}")
    return ", ".join(parts)


CTES["marker_features"] = (
    f"select fold, accession, {_plain(DOMAIN_MARKER_FEATURES + HOST_MARKER_FEATURES)} from summary"
)
CTES["wide"] = "select m.*, a.* exclude (accession) from marker_features m join arch a on a.accession=m.accession"


def rounded(names: list[str]) -> str:
    return ", ".join(r(name, alias=name) for name in names)


def marker_table(spark, sf, genes=None):
    _, best = marker_ops.extract_markers(views.gene_hits(spark, sf, genes), views.markers(spark, sf))
    summary = marker_ops.marker_summary(
        views.gene_chunks(spark, sf), best, views.marker_ref(spark, sf), MARKER_FOLDS
    )
    return marker_ops.marker_features(summary)


def wide(spark, sf):
    genes = materialize(views.genes(spark, sf), "genes")  # ranked once, read by both sides
    return ops.assemble_features(arch(spark, sf, genes=genes), marker_table(spark, sf, genes))


@query(
    "assemble_features",
    sql(VIEWS, f"select fold, accession, {rounded(ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES)} from wide", CTES),
)
def assemble_features(spark, sf):
    return tidy(ops.domain_matrix(wide(spark, sf)))


MASKED = ["gene_density", "gene_density_fwd", "gene_density_rev", "strand_switch_rate", "leaderless_freq", "short_utr_freq"]


@query(
    "mask_features",
    sql(
        VIEWS,
        "select fold, accession, "
        + ", ".join(
            f"null::double {c}" if c in MASKED else r(c, alias=c)
            for c in ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES
        )
        + f", {', '.join(r(c, alias='host_' + c) for c in MASKED)} from wide",
        CTES,
    ),
)
def mask_features(spark, sf):
    """Both groups masked in the domain matrix only; the host matrix keeps them."""
    rows = wide(spark, sf)
    domain = ops.domain_matrix(rows, "density_plus_boundary", "domain_only")
    host = ops.host_matrix(rows, "density_plus_boundary", "domain_only")
    kept = host.select("fold", "accession", *[F.col(c).alias(f"host_{c}") for c in MASKED])
    return tidy(domain.join(kept, ["fold", "accession"]))


UNION = ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES + HOST_MARKER_FEATURES


@query(
    "union_feature_columns",
    sql(VIEWS, f"select fold, accession, {rounded(UNION)} from wide", CTES),
)
def union_feature_columns(spark, sf):
    return tidy(ops.union_feature_columns(wide(spark, sf)))


MODEL_ORDER = ["euk_max_bitscore", "gene_density", "prok_marker_freq", "coding_density"]


@query(
    "select_model_features",
    sql(
        VIEWS,
        "select fold, accession, " + ", ".join(r(f"{c}::float", 4, c) for c in MODEL_ORDER) + " from wide",
        CTES,
    ),
)
def select_model_features(spark, sf):
    domain = ops.domain_matrix(wide(spark, sf))
    return tidy(ops.select_model_features(domain, MODEL_ORDER, "domain model"), 4)


# A small ensemble: prokaryote or not from the domain matrix, host class from the host matrix.
TREES = [
    # fold, tree, class, node, feature, threshold, left, right, default_left, leaf
    ("fold_0", 0, 0, 0, "prok_marker_freq", 0.3, 1, 2, True, None),
    ("fold_0", 0, 0, 1, "gene_density", 0.9, 3, 4, False, None),
    ("fold_0", 0, 0, 2, None, None, None, None, None, -0.7),
    ("fold_0", 0, 0, 3, None, None, None, None, None, 0.4),
    ("fold_0", 0, 0, 4, None, None, None, None, None, 0.1),
    ("fold_0", 1, 0, 0, "euk_median_bitscore", 1.5, 1, 2, False, None),
    ("fold_0", 1, 0, 1, None, None, None, None, None, -0.2),
    ("fold_0", 1, 0, 2, None, None, None, None, None, 0.6),
    ("fold_1", 0, 0, 0, "coding_density", 0.2, 1, 2, True, None),
    ("fold_1", 0, 0, 1, None, None, None, None, None, 0.25),
    ("fold_1", 0, 0, 2, "prok_max_bitscore", 1.0, 3, 4, True, None),
    ("fold_1", 0, 0, 3, None, None, None, None, None, 0.05),
    ("fold_1", 0, 0, 4, None, None, None, None, None, -0.5),
]
HOST_TREES = [
    (fold, 0, k, node, *rest)
    for fold, cut in (("fold_0", 0.2), ("fold_1", 0.4))
    for k, feature in enumerate(
        ["animal_marker_freq", "plant_marker_freq", "fungi_max_bitscore", "protist_median_bitscore"]
    )
    for node, rest in enumerate(
        [
            (feature, cut * (k + 1), 1, 2, k % 2 == 0, None),
            (None, None, None, None, None, -0.1 * (k + 1)),
            (None, None, None, None, None, 0.3 + 0.1 * k),
        ]
    )
]
LARGE_FEATURES = ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES


def _large_tree(fold: str, t: int) -> list[tuple]:
    """Seven nodes whose features, thresholds and leaves follow from the tree's number."""
    inner = [
        (fold, t, 0, n, LARGE_FEATURES[(t * 3 + n) % len(LARGE_FEATURES)], ((t * 7 + n * 5) % 19) / 10, 2 * n + 1, 2 * n + 2,
         (t + n) % 2 == 0, None)
        for n in range(3)
    ]
    leaves = [(fold, t, 0, n, None, None, None, None, None, ((t * 5 + n * 3) % 11 - 5) / 40) for n in range(3, 7)]
    return inner + leaves


LARGE_TREES = [node for fold in sorted({row[0] for row in TREES}) for t in range(60) for node in _large_tree(fold, t)]
NODE_SCHEMA = (
    "fold string, tree int, class int, node int, feature string, threshold double, left int, "
    "right int, default_left boolean, leaf double"
)


def trees(spark, rows):
    return spark.createDataFrame(rows, NODE_SCHEMA)


def _tree_sql(nodes: dict[int, tuple], at: int) -> str:
    _, _, _, _, feature, threshold, left, right, default, leaf = nodes[at]
    if left is None:
        return f"{leaf}::double"
    test = f"{feature}::float<{threshold}::float"
    test = f"coalesce({test},{'true' if default else 'false'})"
    return f"case when {test} then {_tree_sql(nodes, left)} else {_tree_sql(nodes, right)} end"


def margin_sql(rows: list[tuple], cls: int = 0) -> str:
    per_fold: dict[str, list[str]] = {}
    groups: dict[tuple, dict[int, tuple]] = {}
    for row in rows:
        if row[2] == cls:
            groups.setdefault((row[0], row[1]), {})[row[3]] = row
    for (fold, _), nodes in groups.items():
        per_fold.setdefault(fold, []).append(_tree_sql(nodes, 0))
    return "case " + " ".join(
        f"when fold='{fold}' then {'+'.join(parts)}" for fold, parts in per_fold.items()
    ) + " end"


TREE_CTES = {
    **CTES,
    "margins": f"select *, {margin_sql(TREES)} m, "
    + ", ".join(f"{margin_sql(HOST_TREES, k)} h{k}" for k in range(4))
    + " from wide",
    "tree_scores": """select *, 1/(1+exp(-m)) euk, exp(h0)+exp(h1)+exp(h2)+exp(h3) hs from margins""",
    "class_probs": """select fold, accession, n_genes, fragment_size, euk*exp(h0)/hs p0, euk*exp(h1)/hs p1,
        euk*exp(h2)/hs p2, euk*exp(h3)/hs p3, 1-euk p4 from tree_scores""",
}
PROBS = ", ".join(r(f"p{i}", alias=f"p{i}") for i in range(5))


def tree_scores(spark, sf):
    """The feature rows with both models' probabilities."""
    scored = score_trees(
        wide(spark, sf), trees(spark, TREES), ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES, 2, out="domain"
    )
    return score_trees(
        scored, trees(spark, HOST_TREES), ARCH_MODEL_FEATURES + HOST_MARKER_FEATURES, 4, out="host"
    )


def class_probs(spark, sf):
    return tree_scores(spark, sf).withColumn(
        "probs", hierarchical_probs("domain", "host", 5, 4, [0, 1, 2, 3])
    )


GATE_RAW = ["fragment_size", *ARCH_MODEL_FEATURES]


@query(
    "gate_inputs",
    sql(
        VIEWS,
        "select w.fold, w.accession, "
        + ", ".join(r(f"coalesce(w.{c},0)", alias=f"raw{i}") for i, c in enumerate(GATE_RAW))
        + f", {PROBS}, p.n_genes::double p5 from wide w join class_probs p"
        " on p.fold=w.fold and p.accession=w.accession",
        TREE_CTES,
    ),
)
def gate_inputs(spark, sf):
    rows = ops.gate_inputs(class_probs(spark, sf), 13, 1)
    return tidy(
        rows.select(
            "fold",
            "accession",
            *[F.col("raw")[i].alias(f"raw{i}") for i in range(13)],
            *[F.col("features")[i].alias(f"p{i}") for i in range(6)],
        )
    )


@query(
    "align_features",
    sql(
        ["v_hit_chunks", *VIEWS],
        f"""select c.accession, {', '.join(r(f'coalesce(a.{n},0)::float', 4, n) for n in ARCH_MODEL_FEATURES)}
        from (select accession from v_gene_chunks union all select accession from v_hit_chunks) c
        left join arch a on a.accession=c.accession""",
        CTES,
    ),
)
def align_features(spark, sf):
    """The gene view's chunks have features, the order chunks have none and get zeros."""
    every = views.gene_chunks(spark, sf).select("accession").unionByName(
        views.hit_chunks(spark, sf).select("accession")
    )
    features = arch(spark, sf).select("accession", *ARCH_MODEL_FEATURES)
    return tidy(ops.align_features(every, features), 4)
