"""Gene operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqharbor.constants import ARCH_FEATURES, BINDING_SITES, CODON_AMINO_ACIDS, CODON_BASES
from seqharbor.operators import gene_chain as chains, genes as ops
from seqharbor.plans.predict import gene_table

from . import views
from .registry import query, r, tidy
from .sequences import CHUNKS, chunks
from .views import sql


def residue_sql(codon: str) -> str:
    at = [f"strpos('{CODON_BASES}', substr({codon},{i},1))" for i in (1, 2, 3)]
    known = " and ".join(f"{a}>0" for a in at)
    return (
        f"case when {known} then substr('{CODON_AMINO_ACIDS}',"
        f" (({at[0]}-1)*16+({at[1]}-1)*4+{at[2]})::int, 1) else 'X' end"
    )


SITE_NAMES = "[" + ", ".join(f"['{m}', '{a}-{b}bp']" for m, _, a, b in BINDING_SITES) + "]"


def site_sql() -> str:
    """Number of the first binding site that the bases before a start hold."""
    cases = " ".join(
        f"when regexp_matches(upstream, '{p}.{{{a},{b}}}$') then {i}" for i, (_, p, a, b) in enumerate(BINDING_SITES, 1)
    )
    return f"case {cases} end"


# Codons of six frames, cut into stretches that end with a stop codon or the chunk's edge.
ORF_CTES = {
    "c": CHUNKS,
    "sides": """select accession, 1 strand, seq from c where length(seq)>=100 union all
        select accession, -1, reverse(translate(seq,'ACGTN','TGCAN')) from c where length(seq)>=100""",
    "frames": "select *, length(seq) n, unnest([0,1,2]) f from sides",
    "codons": """select accession, strand, n, f, i, substring(seq, f+3*i+1, 3) codon
        from (select *, unnest(range(0, (n-f)//3)) i from frames) a""",
    "marked": f"""select *, codon in ('TAA','TAG','TGA') stop, codon in ('ATG','GTG','TTG') opens,
        {residue_sql('codon')} aa from codons""",
    "cut": """select *, coalesce(sum(stop::int) over (partition by accession, strand, f order by i
        rows between unbounded preceding and 1 preceding), 0) part from marked""",
    "parts": """select accession, strand, f, part, any_value(n) n, min(i) lo, max(i) hi,
        bool_or(stop) closed, part=0 edge5, min(i) filter (where opens) first_start,
        string_agg(aa,'' order by i) aas, arg_min(codon, i) filter (where opens) start_codon
        from cut group by accession, strand, f, part""",
    "found": """select *, case when edge5 then 0 else first_start end first from parts""",
    "kept": """select *, substring(aas, (first-lo+1)::int) body from found
        where first is not null and first<=hi-closed::int and (hi-first+1)*3>=90""",
    "placed": """select accession,
        (case when strand=1 then f+3*first+1 else n-(f+3*(hi+1))+1 end)::int begin_pos,
        (case when strand=1 then f+3*(hi+1) else n-f-3*first end)::int end_pos,
        strand, case when strand=1 then edge5 else not closed end partial_begin,
        case when strand=1 then not closed else edge5 end partial_end,
        case when edge5 then 'Edge' else start_codon end start_type,
        case when edge5 then body else concat('M', substring(body, 2)) end amino_acid_sequence,
        case when edge5 then '' else substring(s.seq, greatest(f+3*first-20, 0)+1, least(f+3*first, 20)) end upstream
        from kept join sides s using (accession, strand)""",
    "sited": f"select *, {site_sql()} site from placed",
    "orfs": """select * exclude (upstream, site), coalesce({b}[site][1], '') rbs_motif, coalesce({b}[site][2], '') rbs_spacer,
        ({n}-site+1)::double rbs_score, (row_number() over (partition by accession
        order by begin_pos, end_pos, strand))::int idx from sited""".format(b=SITE_NAMES, n=len(BINDING_SITES)),
}


def orfs(spark, sf):
    return ops.orf_scan(chunks(spark, sf))


@query(
    "orf_scan",
    sql(
        ["v_sequences"],
        """select *, concat(accession,'_',idx) protein_id, length(amino_acid_sequence)::int aa_len,
        11 translation_table from orfs""",
        ORF_CTES,
    ),
)
def orf_scan(spark, sf):
    return orfs(spark, sf)


@query(
    "translate_codons",
    sql(
        ["v_sequences"],
        """select a.accession, coalesce(protein,'') protein, coalesce(complement,'') complement
        from v_sequences a left join (
          select accession, string_agg(aa,'' order by i) filter (where side=1) protein,
            string_agg(aa,'' order by i) filter (where side=2) complement
          from residues group by accession) b on a.accession=b.accession""",
        {
            "sides": """select accession, seq, 1 side from v_sequences union all
                select accession, reverse(translate(seq,'ACGTN','TGCAN')), 2 from v_sequences""",
            "codons": """select accession, side, i, substring(seq, 3*i+1, 3) codon
                from (select *, unnest(range(0, length(seq)//3)) i from sides) a""",
            "residues": f"select accession, side, i, {residue_sql('codon')} aa from codons",
        },
    ),
)
def translate_codons(spark, sf):
    return views.sequences(spark, sf).select(
        "accession",
        ops.translate_codons("seq").alias("protein"),
        ops.translate_codons(ops.reverse_complement("seq")).alias("complement"),
    )


@query(
    "number_proteins",
    sql(
        ["v_genes"],
        """select *, concat(accession,'_',idx) protein_id from (
        select accession, begin_pos, end_pos, strand,
          (row_number() over (partition by accession order by begin_pos, end_pos, strand))::int idx
        from v_genes) a""",
    ),
)
def number_proteins(spark, sf):
    g = views.genes(spark, sf).select("accession", "begin_pos", "end_pos", "strand")
    return ops.number_proteins(g)


RBS = """case when {m} in ('TAA','TAAA','TAAAA','TAAAT','TAAAAA','TAAAAT') then true else false end
  is_bacteroidetes_rbs,
  case when {m} in ('3Base/5BMM','4Base/6BMM','AGG','AGGA','AGGA/GGAG/GAGG','AGGAG','AGGAG/GGAGG',
   'AGGAG(G)/GGAGG','AGGAGG','AGxAG','AGxAGG/AGGxGG','GAG','GAGG','GAGGA','GGA','GGA/GAG/AGG','GGAG',
   'GGAG/GAGG','GGAGG','GGAGGA','GGxGG') then true else false end is_canonical_rbs,
  case when {m} in ('ATA','ATAT','ATATA','ATATAT','TAT','TATA','TATAT','TATATA') then true else false end
  is_tatata_rbs""".format(m="upper(motif)")


@query("classify_rbs", sql(["v_genes"], f"select accession, idx, motif, {RBS} from v_genes"))
def classify_rbs(spark, sf):
    flags = [flag.alias(name) for name, flag in ops.classify_rbs("motif").items()]
    return views.genes(spark, sf).select("accession", "idx", "motif", *flags)


CONTEXT_CTES = {
    "all_genes": """select *, begin_pos-1 start0, coalesce(lag(end_pos) over (
        partition by accession, strand order by idx), -3) prev_stop from v_genes""",
    "context": f"""select accession, idx, start0 start, end_pos "end", strand, aa_len length,
        start0<=2 leaderless, start0-prev_stop<=3 short_utr,
        coalesce(strand<>lag(strand) over (partition by accession order by idx), false) strand_switch,
        coalesce(motif<>'', false) has_rbs, coalesce(upper(motif),'') rbs_motif,
        case when coalesce(motif<>'', false) then score else 0 end::double rbs_score, {RBS}
        from all_genes where aa_len>=90""",
}


def context(spark, sf, genes=None):
    return ops.gene_context(genes or views.genes(spark, sf))


@query(
    "gene_context",
    sql(["v_genes"], f"select * replace ({r('rbs_score')} as rbs_score) from context", CONTEXT_CTES),
)
def gene_context(spark, sf):
    return tidy(context(spark, sf))


FEATURE_CTES = {
    **CONTEXT_CTES,
    "per_chunk": """select accession, count(*) n, sum("end"-start) coding, sum(strand_switch::int) sw,
        sum(leaderless::int) ll, sum(short_utr::int) su, sum(has_rbs::int) rbs,
        sum(is_bacteroidetes_rbs::int) ba, sum(is_canonical_rbs::int) sd, sum(is_tatata_rbs::int) ta,
        avg(rbs_score) filter (where has_rbs) score, sum((strand=1)::int) fwd,
        median(length)::double med, max(length)::double top from context group by accession""",
    "arch": """select c.accession, chunk_len/10000::double fragment_size,
        case when n>1 then sw/n end strand_switch_rate,
        coalesce(coding/chunk_len, 0) coding_density,
        case when n>1 then ll/n end leaderless_freq, case when n>1 then su/n end short_utr_freq,
        (n-rbs)/n no_rbs_freq, ba/n sd_bacteroidetes_rbs_freq, sd/n sd_canonical_rbs_freq,
        ta/n tatata_rbs_freq, case when n>=1 then coalesce(score/100, 0) end mean_rbs_score,
        case when n>1 then n/(chunk_len/1000::double) end gene_density,
        case when n>1 then fwd/(chunk_len/1000::double) end gene_density_fwd,
        case when n>1 then (n-fwd)/(chunk_len/1000::double) end gene_density_rev,
        coalesce(n,0)::bigint n_genes, med median_orf_length, top max_orf_length
        from v_gene_chunks c left join per_chunk p on c.accession=p.accession""",
}
ROUNDED_ARCH = ", ".join(r(name, alias=name) for name in ARCH_FEATURES)


def arch(spark, sf, with_lengths=False, genes=None):
    return ops.arch_features(
        views.gene_chunks(spark, sf), context(spark, sf, genes), 10000, with_lengths
    )


@query(
    "arch_features",
    sql(
        ["v_genes", "v_gene_chunks"],
        f"select accession, {ROUNDED_ARCH}, n_genes, median_orf_length, max_orf_length from arch",
        FEATURE_CTES,
    ),
)
def arch_features(spark, sf):
    return tidy(arch(spark, sf, with_lengths=True))


@query(
    "feature_vector",
    sql(
        ["v_genes", "v_gene_chunks"],
        "select accession, "
        + ", ".join(r(f"{c}::float", 4, f"f{i}") for i, c in enumerate([*ARCH_FEATURES, "n_genes"]))
        + " from arch",
        FEATURE_CTES,
    ),
)
def feature_vector(spark, sf):
    vector = ops.feature_vector(arch(spark, sf))
    parts = [
        F.when(~F.isnan(F.col("vector")[i]), F.col("vector")[i]).alias(f"f{i}") for i in range(14)
    ]
    return tidy(vector.select("accession", *parts), 4)


@query(
    "sequence_arch_features",
    sql(
        ["v_sequences"],
        f"select accession, {ROUNDED_ARCH}, n_genes from arch",
        {
            **ORF_CTES,
            "v_genes": """select accession, (row_number() over (partition by accession
                order by begin_pos, end_pos, strand))::int idx, begin_pos, end_pos, strand,
                length(amino_acid_sequence)::int aa_len, nullif(rbs_motif,'') motif, rbs_score score
                from orfs""",
            "v_gene_chunks": "select accession, length(seq)::int chunk_len from c",
            **{
                name: text.replace("10000", "1000") if name == "arch" else text
                for name, text in FEATURE_CTES.items()
            },
        },
    ),
)
def sequence_arch_features(spark, sf):
    """Sequences to architecture features: chunk, scan, number, context, aggregate."""
    cut = chunks(spark, sf)
    called = gene_table(ops.orf_scan(cut))
    context = ops.gene_context(called, most_genes=ops.most_orfs(1000))
    return tidy(ops.arch_features(cut, context, 1000))


MODEL_CTES = {
    **ORF_CTES,
    "spans": """select o.accession, o.idx, o.begin_pos, o.end_pos, o.strand, s.seq,
        case when o.strand=1 then o.begin_pos-1 else length(s.seq)-o.end_pos end a
        from orfs o join sides s on o.accession=s.accession and o.strand=s.strand""",
    "read": """select accession, idx, end_pos-begin_pos+1 size, substring(seq, a+3*t+1, 6) hexamer
        from (select *, unnest(range(0, (end_pos-begin_pos+1)//3-1)) t from spans) x""",
    "coded": f"select hexamer, count(*) n from read where size>={chains.TRAINING_BASES} group by hexamer",
    "every": """select substring(seq, p+1, 6) hexamer, count(*) n
        from (select seq, unnest(range(0, length(seq)-5)) p from sides) x group by 1""",
    "names": "select concat(" + ", ".join(f"substr('ACGT', (i//{4**k}%4+1)::int, 1)" for k in range(5, -1, -1))
    + f") hexamer from range({chains.HEXAMERS}) x(i)",
    "counts": """select hexamer, coalesce(c.n,0)::bigint coding, coalesce(e.n,0)::bigint background
        from names left join coded c using (hexamer) left join every e using (hexamer)""",
    "model": f"""select *, floor(1000*ln(((coding+1)/(sum(coding) over ()+{chains.HEXAMERS})::double)
        /((background+1)/(sum(background) over ()+{chains.HEXAMERS})::double))+0.5)::bigint weight from counts""",
}


@query("coding_model", sql(["v_sequences"], "select * from model", MODEL_CTES))
def coding_model(spark, sf):
    return chains.coding_model(chunks(spark, sf))


# Totals of the best chain that ends in each frame, one frame of every chunk a round; then back from the best end.
CHAIN_CTES = {
    **MODEL_CTES,
    "scored": """select accession, idx, coalesce(sum(weight),0)::bigint score
        from read left join model using (hexamer) group by accession, idx""",
    "cand": """select o.accession, o.idx, begin_pos b, end_pos e, strand s, score,
        row_number() over (partition by o.accession order by end_pos, begin_pos, strand) k
        from orfs o join scored using (accession, idx) where score>0""",
    "lists": """select accession, list({'b': b, 'e': e, 's': s, 'score': score} order by k) l, count(*) n
        from cand group by accession""",
    "dp": """select accession, 0::bigint k, []::bigint[] totals from lists union all
        select d.accession, d.k+1, list_append(totals, l[d.k+1].score + coalesce(list_max(list_transform(
            list_filter(range(1, d.k+1), lambda j: {fits}), lambda j: totals[j])), 0))
        from dp d join lists using (accession) where d.k<n""".format(
        fits=f"""l[j].e<l[d.k+1].e and l[j].b<l[d.k+1].b and l[j].e-l[d.k+1].b+1<=
            case when l[j].s=l[d.k+1].s then {chains.SAME_STRAND_OVERLAP} else {chains.OPPOSITE_STRAND_OVERLAP} end"""
    ),
    "summed": """select accession, unnest(totals) total, unnest(range(1, k+1)) k
        from (select d.* from dp d join lists using (accession) where d.k=n) x""",
    "ended": "select * from cand join summed using (accession, k)",
    "links": f"""select y.accession, y.k, (arg_max(x.k, (x.total, -x.k)) filter (where x.e<y.e and x.b<y.b and x.e-y.b+1<=
        case when x.s=y.s then {chains.SAME_STRAND_OVERLAP} else {chains.OPPOSITE_STRAND_OVERLAP} end)) before
        from ended y join ended x on x.accession=y.accession group by y.accession, y.k""",
    "kept_frames": """select accession, arg_max(k, (total, -k)) k from ended group by accession union all
        select f.accession, l.before from kept_frames f join links l on l.accession=f.accession and l.k=f.k
        where l.before is not null""",
}


def _recursive(text: str, names: list[str]) -> str:
    for name in names:
        text = text.replace(f"{name} as materialized (", f"{name} as (")
    return "with recursive " + text.removeprefix("with ")


@query(
    "gene_chain",
    _recursive(
        sql(
            ["v_sequences"],
            """select accession, (row_number() over (partition by accession order by b, e, s))::int idx,
            b begin_pos, e end_pos, s strand, score coding_score
            from cand join kept_frames using (accession, k)""",
            CHAIN_CTES,
        ),
        ["dp", "kept_frames"],
    ),
)
def gene_chain(spark, sf):
    found = chains.gene_chain(chunks(spark, sf))
    return found.select("accession", "idx", "begin_pos", "end_pos", "strand", "coding_score")
