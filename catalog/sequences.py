"""Sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqharbor.operators import sequences as ops

from . import views
from .registry import query, r, tidy, u32, uni
from .views import sql

SIZE, OVERLAP, SHORTEST, SEED = 1000, 100, 100, 42

CHUNKS = f"""select accession genome,
  case when length(seq)<={SIZE} then accession
       else concat(accession,'_chunk',start,'_',"end") end accession,
  start::int start, "end"::int "end", substring(seq, start+1, "end"-start) seq
from (select *, least(start+{SIZE}, length(seq)) "end" from (
  select accession, seq, unnest(range(0, greatest(length(seq)-{OVERLAP}, 1), {SIZE - OVERLAP})) start
  from v_sequences where length(seq)>{SIZE}
  union all select accession, seq, 0 from v_sequences where length(seq)<={SIZE}) a) b"""


def chunks(spark, sf):
    return ops.chunk_overlap(views.sequences(spark, sf), SIZE, OVERLAP)


@query(
    "chunk_overlap",
    sql(
        ["v_sequences"],
        'select genome, accession, start, "end", seq, length(seq)::int chunk_len from c',
        {"c": CHUNKS},
    ),
)
def chunk_overlap(spark, sf):
    return chunks(spark, sf)


TILES = f"""select accession, start::int start, "end"::int "end" from (
  select accession, 0 start, length(seq) "end" from v_sequences where length(seq)<={SIZE}
  union all
  select accession, 0, o from offsets where o>={SHORTEST}
  union all
  select accession, o+j*{SIZE}, least(o+(j+1)*{SIZE}, n) from (
    select *, unnest(range(0, ceil((n-o)/{SIZE}::double)::int)) j from offsets) t
  where least(o+(j+1)*{SIZE}, n)-(o+j*{SIZE})>={SHORTEST}) a"""
OFFSETS = f"""select accession, length(seq) n,
  floor({uni('accession', f"'{SEED}'", "'tile'")}*{SIZE + 1})::int o
  from v_sequences where length(seq)>{SIZE}"""
NUMBERED_TILES = """select t.accession, start, "end", substring(seq, start+1, "end"-start) seq,
  (row_number() over (partition by t.accession order by start))::int chunk_no
  from tiles t join v_sequences s on t.accession=s.accession"""


@query(
    "chunk_tile",
    sql(
        ["v_sequences"],
        'select accession, chunk_no, start, "end", seq from numbered',
        {"offsets": OFFSETS, "tiles": TILES, "numbered": NUMBERED_TILES},
    ),
)
def chunk_tile(spark, sf):
    return ops.chunk_tile(views.sequences(spark, sf), SIZE, SHORTEST, SEED)


def _random_ctes(largest: int, smallest: int) -> dict[str, str]:
    key = ["accession", f"'{SEED}'"]
    return {
        "plan": f"""select accession, seq, length(seq) n, contains(seq,'N') undefined,
          length(seq)/{(largest + smallest) / 2.0}::double e,
          {uni(*key, "'copies'")} u from v_sequences where length(seq)>={smallest}""",
        "copies": """select accession, seq, n, undefined,
          (floor(e)+case when u<e-floor(e) then 1 else 0 end)::int c from plan""",
        "tries": f"""select *, unnest(range(1, case when undefined then 51 else 2 end)) t from (
          select *, unnest(range(1, c+1)) i from copies where n>{smallest + 500}) a""",
        "begun": f"""select *, floor({uni(*key, "i", "t", "'start'")}*(n-{smallest}+1))::int start
          from tries""",
        "drawn": f"""select *, {smallest}+floor({uni(*key, "i", "t", "'size'")}
          *(least({largest}, n, n-start)-{smallest}+1))::int size from begun""",
        "picked": """select accession, i, min(t) t from drawn
          where not contains(substring(seq, start+1, size),'N') group by all""",
        "pieces": """select d.accession, d.i, d.start, d.start+d.size "end",
            substring(d.seq, d.start+1, d.size) seq
          from drawn d join picked p on d.accession=p.accession and d.i=p.i and d.t=p.t
          union all
          select accession, i, 0, n, seq from (select *, unnest(range(1, c+1)) i from copies
            where n<=%d and not undefined) s""" % (smallest + 500),
        "numbered": """select accession, start::int start, "end"::int "end", seq,
          (row_number() over (partition by accession order by i))::int chunk_no from pieces""",
    }


@query(
    "chunk_uniform_random",
    sql(
        ["v_sequences"],
        'select accession, chunk_no, start, "end", seq from numbered',
        _random_ctes(SIZE, SHORTEST),
    ),
)
def chunk_uniform_random(spark, sf):
    return ops.chunk_uniform_random(views.sequences(spark, sf), SIZE, SHORTEST, seed=SEED)


@query(
    "generate_chunks",
    sql(
        ["v_sequences"],
        "select concat(accession,'_chunk',chunk_no) chunk_id, accession parent, start, \"end\", seq,"
        " 'uniform-random' strategy from numbered union all "
        "select concat(accession,'_chunk',chunk_no), accession, start, \"end\", seq, 'tile' from tiled",
        {
            **_random_ctes(SIZE, SHORTEST),
            "offsets": OFFSETS,
            "tiles": TILES,
            "tiled": NUMBERED_TILES,
        },
    ),
)
def generate_chunks(spark, sf):
    s = views.sequences(spark, sf)
    parts = [
        ops.generate_chunks(s, SIZE, SHORTEST, name, SEED).withColumn("strategy", F.lit(name))
        for name in ("uniform-random", "tile")
    ]
    return parts[0].unionByName(parts[1])



@query(
    "shuffle_sequence",
    sql(
        ["v_sequences"],
        "select accession, string_agg(letter,'' order by key) seq from keyed group by accession",
        {
            "letters": f"""select accession, seq[i+1] letter, i, {u32('accession', f"'{SEED}'", "'shuffle'")} seed
              from (select accession, seq, unnest(range(0, length(seq))) i from v_sequences) a""",
            "a1": "select *, xor(i, i>>16)*73244475%4294967296 x from letters",
            "a2": "select * replace (xor(x, x>>16)*73244475%4294967296 as x) from a1",
            "a3": "select * replace (xor(xor(x, x>>16), seed) as x) from a2",
            "a4": "select * replace (xor(x, x>>16)*73244475%4294967296 as x) from a3",
            "a5": "select * replace (xor(x, x>>16)*73244475%4294967296 as x) from a4",
            "keyed": "select accession, letter, xor(x, x>>16) as key from a5",
        },
    ),
)
def shuffle_sequence(spark, sf):
    return ops.shuffle_sequence(views.sequences(spark, sf), SEED)


@query(
    "genome_id",
    sql(
        ["v_sequences"],
        "select accession, regexp_replace(accession,'_chunk\\d+_\\d+$','') genome_id, genome from c",
        {"c": CHUNKS},
    ),
)
def genome_id(spark, sf):
    return chunks(spark, sf).select("accession", ops.genome_id().alias("genome_id"), "genome")


@query(
    "min_length_filter",
    sql(["v_sequences"], "select accession, length(seq)::int seq_len from v_sequences where length(seq)>=100"),
)
def min_length_filter(spark, sf):
    kept = ops.min_length_filter(views.sequences(spark, sf))
    return kept.select("accession", F.length("seq").alias("seq_len"))


BATCH, TOLERANCE = 16, 200


@query(
    "length_bucket_batches",
    sql(
        ["v_sequences"],
        f"""select accession, chunk_len, (batch+(fill+rank-1)//{BATCH})::bigint batch_id
        from ranked join walk on ranked.chunk_len=walk.l""",
        {
            "c": CHUNKS,
            "chunks": "select accession, length(seq)::int chunk_len from c",
            "hist": "select row_number() over (order by l) k, l, n from (select chunk_len l, count(*) n from chunks group by 1) h",
            # batch and fill before the first row of the length, then the state after its last row
            "walk": f"""
              select k, l, n, 0::bigint batch, 0::bigint fill,
                (n-1)//{BATCH} last_batch, n-((n-1)//{BATCH})*{BATCH} last_fill, l::bigint shortest
              from hist where k=1
              union all
              select k, l, n, batch, fill, batch+(fill+n-1)//{BATCH},
                fill+n-((fill+n-1)//{BATCH})*{BATCH},
                case when fill=0 or (fill+n-1)//{BATCH}>0 then l else shortest end
              from (
                select h.k, h.l, h.n, w.shortest,
                  case when w.last_fill>={BATCH} or h.l-w.shortest>{TOLERANCE}
                       then w.last_batch+1 else w.last_batch end batch,
                  case when w.last_fill>={BATCH} or h.l-w.shortest>{TOLERANCE}
                       then 0 else w.last_fill end fill
                from walk w join hist h on h.k=w.k+1) s""",
            "ranked": f"""select *, row_number() over (partition by chunk_len
              order by md5(concat_ws('|',accession,'{SEED}')), accession) as rank from chunks""",
        },
        recursive=True,
    ),
)
def length_bucket_batches(spark, sf):
    narrow = chunks(spark, sf).select("accession", "chunk_len")
    return ops.length_bucket_batches(narrow, BATCH, TOLERANCE, seed=SEED)


@query(
    "fragment_size",
    sql(
        ["v_sequences"],
        f"select accession, {r(f'length(seq)/{SIZE}::double')} fragment_size from c",
        {"c": CHUNKS},
    ),
)
def fragment_size(spark, sf):
    return tidy(
        chunks(spark, sf).select(
            "accession", ops.fragment_size("chunk_len", SIZE).alias("fragment_size")
        )
    )
