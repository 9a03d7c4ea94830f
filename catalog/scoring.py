"""Scoring operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqharbor.operators import scoring as ops

from . import features, views
from .registry import query, r, tidy, unpack
from .views import CLASSES, FOLDS, sql

DIM = 64
P5 = [f"p{i}" for i in range(CLASSES)]


@query(
    "score_trees",
    sql(
        features.VIEWS,
        f"select fold, accession, {r('1-euk', alias='prok')}, {r('euk', alias='euk')}, "
        + ", ".join(r(f"exp(h{i})/hs", alias=f"host{i}") for i in range(4))
        + " from tree_scores",
        features.TREE_CTES,
    ),
)
def score_trees(spark, sf):
    scored = features.tree_scores(spark, sf).select(
        "fold",
        "accession",
        F.col("domain")[0].alias("prok"),
        F.col("domain")[1].alias("euk"),
        *[F.col("host")[i].alias(f"host{i}") for i in range(4)],
    )
    return tidy(scored)


@query(
    "score_trees_large",
    sql(
        features.VIEWS,
        f"select fold, accession, {r('1/(1+exp(-m))', alias='euk')} from margins",
        {**features.CTES, "margins": f"select *, {features.margin_sql(features.LARGE_TREES)} m from wide"},
    ),
)
def score_trees_large(spark, sf):
    """A model of more nodes than are written as expressions."""
    scored = ops.score_trees(
        features.wide(spark, sf), features.trees(spark, features.LARGE_TREES), features.LARGE_FEATURES, 2
    )
    return tidy(scored.select("fold", "accession", F.col("probs")[1].alias("euk")))


@query(
    "hierarchical_probs",
    sql(features.VIEWS, f"select fold, accession, {features.PROBS} from class_probs", features.TREE_CTES),
)
def hierarchical_probs(spark, sf):
    return tidy(unpack(features.class_probs(spark, sf).select("fold", "accession", "probs"), "probs", CLASSES, "p"))


@query(
    "expand_binary_probs",
    sql(
        features.VIEWS,
        "select fold, accession, "
        + ", ".join(r("1-euk" if i == 4 else "euk/4", alias=f"p{i}") for i in range(CLASSES))
        + " from tree_scores",
        features.TREE_CTES,
    ),
)
def expand_binary_probs(spark, sf):
    binary = features.tree_scores(spark, sf).select("fold", "accession", F.col("domain").alias("probs"))
    return tidy(unpack(ops.expand_binary_probs(binary, CLASSES, 4), "probs", CLASSES, "p"))


# --- linear head ------------------------------------------------------------------------------

GAMMA = [1.0 + (i % 5) * 0.1 for i in range(DIM)]
BETA = [(i % 3) * 0.05 for i in range(DIM)]
WEIGHT = [[((i * 7 + j * 3) % 11 - 5) / 10 for i in range(DIM)] for j in range(CLASSES)]
BIAS = [0.1 * j for j in range(CLASSES)]


def _list(values) -> str:
    return "[" + ",".join(f"{float(v)!r}::double" for v in values) + "]"


def _dot(left: str, weights, start: int = 1) -> str:
    return f"list_dot_product({left}, {_list(weights)})"


HEAD_CTES = {
    "vec": "select vec_id, embedding::double[] v from embeddings",
    "centred": "select vec_id, v, list_avg(v) m, list_avg([(x-list_avg(v))**2 for x in v]) s from vec",
    "normed": f"""select vec_id, [(v[i]-m)/sqrt(s+1e-5)*({_list(GAMMA)})[i]+({_list(BETA)})[i]
        for i in range(1, {DIM + 1})] x from centred""",
}


@query(
    "linear_head",
    sql(
        [],
        "select vec_id, "
        + ", ".join(r(f"{_dot('x', WEIGHT[j])}+{BIAS[j]}::double", alias=f"l{j}") for j in range(CLASSES))
        + " from normed",
        HEAD_CTES,
    ),
)
def linear_head(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    scored = ops.linear_head(e, GAMMA, BETA, WEIGHT, BIAS)
    return tidy(unpack(scored.drop("vec"), "logits", CLASSES, "l"))


# --- gate and mixture -------------------------------------------------------------------------

HIDDEN, RAW = 4, 13
GATE_IN = RAW + CLASSES + 1


def _gate(fold: int) -> ops.GateWeights:
    return ops.GateWeights(
        [[((i * 3 + h * 5 + fold) % 9 - 4) / 6 for i in range(GATE_IN)] for h in range(HIDDEN)],
        [0.1 * h - 0.2 for h in range(HIDDEN)],
        [0.5 - 0.25 * h + 0.1 * fold for h in range(HIDDEN)],
        0.05 * fold,
    )


GATES = {name: _gate(i) for i, name in enumerate(FOLDS)}


def gate_rows(spark, sf):
    """Fold scores with 13 raw features (some missing, some negative) and a gene count."""
    scores = views.fold_scores(spark, sf)
    e = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    raw = [F.element_at("embedding", F.lit(30 + i)).cast("double") * 10.0 for i in range(RAW)]
    raw[3] = F.when(F.col("vec_id") % 7 != 0, raw[3])
    return scores.join(e, "vec_id").select(
        "fold",
        "accession",
        "vec_id",
        "logits",
        F.array(*raw).alias("raw"),
        F.array((F.col("vec_id") % 4).cast("double")).alias("marker"),
    )


def _softmax(scores: list[str], out: str) -> str:
    top = f"greatest({','.join(scores)})"
    total = "+".join(f"exp({s}-{top})" for s in scores)
    return ", ".join(f"exp({s}-{top})/({total}) {out}{i}" for i, s in enumerate(scores))


S5 = [f"s{i}" for i in range(CLASSES)]
ODD = [1.0]
for _n in range(1, 90):
    ODD.append(ODD[-1] / (2 * _n + 1))


def gelu_sql(x: str) -> str:
    """x/2 * (1 + erf(x/sqrt 2)), erf by its all-positive series."""
    series = f"list_sum([pow({x}*{x}, n)*({_list(ODD)})[n+1] for n in range(0, {len(ODD)})])"
    return f"0.5::double*{x}*(1+2/sqrt(pi())*exp(-{x}*{x}/2)*({x}/sqrt(2::double))*{series})"


GATE_CTES = {
    "raw_rows": "select f.*, "
    + ", ".join(
        ("case when f.vec_id%7<>0 then " if i == 3 else "")
        + f"embedding[{30 + i}]::double*10"
        + (" end" if i == 3 else "")
        + f" raw{i}"
        for i in range(RAW)
    )
    + ", f.vec_id%4 n_genes from v_fold_scores f join embeddings e on e.vec_id=f.vec_id",
    "soft": f"select *, {_softmax(S5, 'g')} from raw_rows",
    "gate_x": "select *, ["
    + ",".join(
        [f"ln(1+greatest(coalesce(raw{i},0),0))" for i in range(RAW)]
        + [f"g{i}" for i in range(CLASSES)]
        + ["ln(1+n_genes::double)"]
    )
    + "] x from soft",
    "gate_z": "select *, "
    + ", ".join(
        "case "
        + " ".join(
            f"when fold='{name}' then {_dot('x', g.hidden_weight[h])}+{g.hidden_bias[h]}::double"
            for name, g in GATES.items()
        )
        + f" end z{h}"
        for h in range(HIDDEN)
    )
    + " from gate_x",
    "gate_h": "select *, " + ", ".join(f"{gelu_sql(f'z{h}')} h{h}" for h in range(HIDDEN)) + " from gate_z",
    "gated": "select *, case when n_genes=0 then 1::double else 1/(1+exp(-(case "
    + " ".join(
        f"when fold='{name}' then "
        + "+".join(f"h{h}*{g.out_weight[h]}::double" for h in range(HIDDEN))
        + f"+{g.out_bias}::double"
        for name, g in GATES.items()
    )
    + " end))) end alpha from gate_h",
}


def gated(spark, sf):
    return ops.gate_alpha(gate_rows(spark, sf), GATES, CLASSES, RAW, 1)


@query(
    "gate_alpha",
    sql(["v_fold_scores"], f"select fold, accession, {r('alpha', alias='alpha')} from gated", GATE_CTES),
)
def gate_alpha(spark, sf):
    return tidy(gated(spark, sf).select("fold", "accession", "alpha"))


def tree_column(i: int):
    return (F.lit(i + 1) + F.col("vec_id") % 3).cast("double") / (
        15 + 5 * (F.col("vec_id") % 3)
    ).cast("double")


TREE_P = [f"(({i + 1}+vec_id%3)/(15+5*(vec_id%3))::double)" for i in range(CLASSES)]
LOG_P = [f"l{i}" for i in range(CLASSES)]
MIX_CTES = {
    **GATE_CTES,
    "mixed": "select *, "
    + ", ".join(f"ln(greatest(alpha*g{i}+(1-alpha)*{TREE_P[i]}, 1e-7)) l{i}" for i in range(CLASSES))
    + " from gated",
}


def mixed(spark, sf):
    rows = gated(spark, sf).withColumn("probs", F.array(*[tree_column(i) for i in range(CLASSES)]))
    return ops.mix_probs(rows, CLASSES)


@query(
    "mix_probs",
    sql(["v_fold_scores"], f"select fold, accession, {', '.join(r(c, alias=c) for c in LOG_P)} from mixed", MIX_CTES),
)
def mix_probs(spark, sf):
    out = mixed(spark, sf).select("fold", "accession", "log_probs")
    return tidy(unpack(out, "log_probs", CLASSES, "l"))


def fallback(spark, sf):
    rows = views.fold_scores(spark, sf).withColumns(
        {
            "probs": F.array(*[tree_column(i) for i in range(CLASSES)]),
            "logits": F.when(F.col("vec_id") % 3 != 0, F.col("logits")),
        }
    )
    return ops.stream_fallback(rows, CLASSES)


_LSE = "ln(" + "+".join(f"exp({s})" for s in S5) + ")"
FALLBACK_CTES = {
    "logs": "select fold, accession, "
    + ", ".join(
        f"case when vec_id%3<>0 then s{i}-{_LSE} else ln(greatest({TREE_P[i]},1e-7)) end l{i}"
        for i in range(CLASSES)
    )
    + " from v_fold_scores"
}


@query(
    "stream_fallback",
    sql(["v_fold_scores"], f"select fold, accession, {', '.join(r(c, alias=c) for c in LOG_P)} from logs", FALLBACK_CTES),
)
def stream_fallback(spark, sf):
    out = fallback(spark, sf).select("fold", "accession", "log_probs")
    return tidy(unpack(out, "log_probs", CLASSES, "l"))


@query(
    "exp_log_probs",
    sql(
        ["v_fold_scores"],
        "select fold, accession, " + ", ".join(r(f"exp(l{i})", alias=f"p{i}") for i in range(CLASSES)) + " from logs",
        FALLBACK_CTES,
    ),
)
def exp_log_probs(spark, sf):
    out = fallback(spark, sf).select("fold", "accession", ops.exp_log_probs("log_probs").alias("probs"))
    return tidy(unpack(out, "probs", CLASSES, "p"))


@query(
    "stream_weight_mean",
    sql(["v_fold_scores"], f"select fold, {r('avg(alpha)', alias='stream_weight')} from gated group by fold", GATE_CTES),
)
def stream_weight_mean(spark, sf):
    return tidy(ops.stream_weight_mean(gated(spark, sf), by=["fold"]))


def _example_model():
    weight, bias = np.asarray(WEIGHT), np.asarray(BIAS)

    def make_predict():
        def predict(vectors):
            return np.maximum(np.asarray(vectors, dtype=float), 0.0) @ weight.T + bias

        return predict

    return make_predict


@query(
    "batch_model_score",
    sql(
        [],
        "select vec_id, "
        + ", ".join(r(f"{_dot('x', WEIGHT[j])}+{BIAS[j]}::double", alias=f"l{j}") for j in range(CLASSES))
        + " from positive",
        {"positive": "select vec_id, [greatest(v,0)::double for v in embedding] x from embeddings"},
    ),
)
def batch_model_score(spark, sf):
    e = views.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    scored = ops.batch_model_score(e, _example_model(), ["vec"], input_shapes=[[DIM]])
    return tidy(unpack(scored.drop("vec"), "logits", CLASSES, "l"))


# --- pooling ----------------------------------------------------------------------------------

D = [f"d{i}" for i in range(DIM)]


def _pool_sql(how: str) -> str:
    one = {
        "mean": "sum(case when mask then vec[{n}]::double else 0 end)/greatest(sum(mask::int)::double,1e-9)",
        "max": "max(case when mask then vec[{n}]::double else -1e9 end)",
        "cls": "arg_min(vec[{n}]::double, pos)",
    }[how]
    cells = ", ".join(r(one.format(n=i + 1), alias=f"d{i}") for i in range(DIM))
    return f"select grp, '{how}' how, {cells} from v_vectors group by grp"


@query(
    "masked_pooling",
    sql(["v_vectors"], " union all ".join(_pool_sql(how) for how in ("mean", "max", "cls"))),
)
def masked_pooling(spark, sf):
    parts = [
        unpack(ops.masked_pooling(views.vectors(spark, sf), DIM, how), "pooled", DIM, "d").withColumn(
            "how", F.lit(how)
        )
        for how in ("mean", "max", "cls")
    ]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


HEADS = 2
Q = [[((i * 5 + h * 3) % 7 - 3) / 4 for i in range(DIM)] for h in range(HEADS)]
TEMPERATURE = [0.05, 0.7]
HEAD_WEIGHT = [0.3, 0.7]
OUT, NECK = 6, 5
W_LINEAR = [[((i * 3 + o * 7) % 13 - 6) / 20 for i in range(DIM * HEADS)] for o in range(OUT)]
B_LINEAR = [0.01 * o for o in range(OUT)]
W_NECK = [[((i * 11 + o * 5) % 17 - 8) / 10 for i in range(DIM * HEADS)] for o in range(NECK)]
B_NECK = [0.1 - 0.05 * o for o in range(NECK)]
W_OUT = [[((i * 2 + o) % 5 - 2) / 3 for i in range(NECK)] for o in range(OUT)]
B_OUT = [0.2 * o for o in range(OUT)]

ATTENTION_CTES = {
    "scored": "select grp, vec::double[] v, "
    + ", ".join(
        f"case when mask then {_dot('vec::double[]', Q[h])}/{min(max(TEMPERATURE[h], 0.1), 10.0)}::double"
        f" else -1e9 end s{h}"
        for h in range(HEADS)
    )
    + " from v_vectors",
    "tops": "select grp, " + ", ".join(f"max(s{h}) t{h}" for h in range(HEADS)) + " from scored group by grp",
    "weights": "select s.grp, v, "
    + ", ".join(f"exp(s{h}-t{h}) w{h}" for h in range(HEADS))
    + " from scored s join tops t on s.grp=t.grp",
    "heads": "select grp, "
    + ", ".join(
        "[" + ",".join(f"sum(w{h}*v[{i + 1}])/sum(w{h})" for i in range(DIM)) + f"] h{h}"
        for h in range(HEADS)
    )
    + " from weights group by grp",
    "cat": "select grp, h0, h1, list_concat(h0, h1) x from heads",
    "neck": "select grp, "
    + ", ".join(f"{_dot('x', W_NECK[o])}+{B_NECK[o]}::double z{o}" for o in range(NECK))
    + " from cat",
    "active": "select grp, [" + ",".join(gelu_sql(f"z{o}") for o in range(NECK)) + "] y from neck",
}
REST = ["null::double"] * (DIM - OUT)


@query(
    "attention_pooling",
    sql(
        ["v_vectors"],
        "select grp, 'weighted_sum' how, "
        + ", ".join(
            r(f"h0[{i + 1}]*{HEAD_WEIGHT[0]}::double+h1[{i + 1}]*{HEAD_WEIGHT[1]}::double", alias=f"d{i}")
            for i in range(DIM)
        )
        + " from cat union all select grp, 'linear', "
        + ", ".join([*[r(f"{_dot('x', W_LINEAR[o])}+{B_LINEAR[o]}::double") for o in range(OUT)], *REST])
        + " from cat union all select grp, 'bottleneck', "
        + ", ".join([*[r(f"{_dot('y', W_OUT[o])}+{B_OUT[o]}::double") for o in range(OUT)], *REST])
        + " from active",
        ATTENTION_CTES,
    ),
)
def attention_pooling(spark, sf):
    """The three head combinations of one pooling; a projection has fewer entries than the weighted sum."""
    how = {
        "weighted_sum": {"head_weights": HEAD_WEIGHT},
        "linear": {"projection": (W_LINEAR, B_LINEAR)},
        "bottleneck": {"projection": (W_NECK, B_NECK, W_OUT, B_OUT)},
    }
    pooled = ops.attention_heads(views.vectors(spark, sf), Q, TEMPERATURE)
    mixed = pooled.select("grp", *[ops.combine_heads("heads", HEADS, DIM, name, **how[name]).alias(name) for name in how])
    each = F.array(*[F.struct(F.lit(name).alias("how"), F.col(name).alias("pooled")) for name in how])
    rows = mixed.select("grp", F.explode(each).alias("part")).select("grp", "part.*")
    return tidy(rows.select("grp", "how", *[F.get("pooled", F.lit(i)).alias(f"d{i}") for i in range(DIM)]))
