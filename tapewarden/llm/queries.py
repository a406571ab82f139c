"""The registered queries of the subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewarden.llm.audit import filter_interactions
from tapewarden.llm.codes import product_codes
from tapewarden.llm.decontamination import contaminated
from tapewarden.llm.lines import deduplicate_lines
from tapewarden.llm.mixing import mixed_documents
from tapewarden.llm.neighbours import nearest_neighbours
from tapewarden.llm.paragraphs import duplicate_paragraphs, paragraphs_by_document, passage_words
from tapewarden.llm.parity import jaccard_components
from tapewarden.llm.personal import personal_data
from tapewarden.llm.preference import format_preferences, stale_answer_pairs
from tapewarden.llm.repeats import remove_repeats
from tapewarden.llm.resampling import importance_resample
from tapewarden.llm.setsketch import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_preferences(stale_answer_pairs(_table(spark, sf_dir, "conversations")))
    listed = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",") for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(listed).withColumnRenamed("pair_id", "conv_id")


OP1_SQL = r"""
with said as (
    select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from said
), answers as (
    select *, lag(text) over (partition by conv_id order by i) as previous,
           row_number() over (partition by conv_id order by i desc) as from_end
    from numbered where role = 'assistant'
), last_answer as (
    select conv_id, i, text, coalesce(previous, '') as stale from answers where from_end = 1
), prompts as (
    select l.conv_id, coalesce(string_agg('<|' || n.role || '|>' || chr(10) || n.text || '<|end|>' || chr(10), '' order by n.i), '') as prompt,
           count(n.i) as n_common
    from last_answer l left join numbered n on n.conv_id = l.conv_id and n.i < l.i group by l.conv_id
), pairs as (
    select l.conv_id, l.text = l.stale as same, p.n_common, p.prompt,
           '<|assistant|>' || chr(10) || l.text || '<|end|>' || chr(10) as good,
           '<|assistant|>' || chr(10) || l.stale || '<|end|>' || chr(10) as bad
    from last_answer l join prompts p using (conv_id)
)
select conv_id, n_common + same::int as n_common, prompt || case when same then good else '' end as prompt,
       case when same then '' else good end as chosen, case when same then '' else bad end as rejected,
       case when same then '' else '14:' || (length(good) - 1) end as chosen_mask,
       case when same then '' else '14:' || (length(bad) - 1) end as rejected_mask
from pairs
"""


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return paragraphs_by_document(documents, duplicate_paragraphs(documents, min_words=1), passage_words(documents))


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line_no
    from documents
), keyed as (
    select doc_id, line_no, line,
           translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), often as (
    select key, max(doc_id) as last_doc from keyed where length(key) >= 20
    group by key having count(distinct doc_id) >= 3
), marked as (
    select k.doc_id, k.line_no, k.line, coalesce(k.doc_id <> o.last_doc, false) as gone
    from keyed k left join often o on k.key = o.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op4_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed_documents(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
with sized as (
    select doc_id, source, md5(text) as content,
           case when length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) = 0 then 0
                else len(string_split_regex(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                                            '[\x20\x09-\x0D]+')) end as size
    from documents
), sources as (
    select source, sum(size)::bigint as source_size,
           [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
    from sized group by source
), filling as (
    select *, 2.0::double * source_size as cap,
           (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over before, 0))
           / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level,
           row_number() over (order by 2.0::double * source_size / weight, source nulls last) as nth
    from sources
    window before as (order by 2.0::double * source_size / weight, source nulls last
                      rows between unbounded preceding and 1 preceding)
), full_ones as (
    select *, bool_and(level * weight >= cap) over (order by nth) as is_full from filling
), targets as (
    select source, source_size,
           case when is_full then cap
                else (1.5::double * sum(source_size) over () - coalesce(sum(cap) filter (where is_full) over (), 0))
                     * weight / sum(weight) filter (where not is_full) over () end as target
    from full_ones
), passes as (
    select s.*, t.source_size, t.target, p.pass,
           md5(concat_ws(':', 17, p.pass, s.doc_id, s.content)) as mixed
    from sized s join targets t on s.source is not distinct from t.source, (values (0), (1)) p(pass)
), placed as (
    select *, sum(size) over (partition by source order by pass, mixed) - size as begins from passes
)
select doc_id, any_value(size)::bigint as size, any_value(source_size) as source_size, any_value(target) as target,
       sum(greatest(0, least(begins + size, floor(target)::bigint) - begins))::bigint as taken
from placed group by doc_id
"""


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Alignments by a shared run of four words: a window of 13 with two differing words always has one.
OP9_SQL = r"""
with doc_words as materialized (
    select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') as w from documents
), item_words as materialized (
    select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') as w from benchmark
), doc_grams as (
    select doc_id, i, hash(w[i:i + 3]) as gram from doc_words, unnest(range(1, len(w) - 2)) t(i) where len(w) >= 13
), item_grams as (
    select item_id, i, hash(w[i:i + 3]) as gram from item_words, unnest(range(1, len(w) - 2)) t(i) where len(w) >= 13
), aligned as (
    select distinct doc_id, item_id, d.i - b.i as shift from doc_grams d join item_grams b using (gram)
), equal as (
    select a.doc_id, a.item_id, a.shift, greatest(1, 1 - a.shift) as first,
           list_transform(range(greatest(1, 1 - a.shift), least(len(b.w), len(d.w) - a.shift) + 1),
                          lambda k: (b.w[k] = d.w[k + a.shift])::int) as e
    from aligned a join doc_words d using (doc_id) join item_words b using (item_id)
), windows as (
    select doc_id, item_id, first + shift - 1 + t.i - 1 as spot, list_sum(e[t.i:t.i + 12]) as n
    from equal, unnest(range(1, len(e) - 11)) t(i) where len(e) >= 13
)
select doc_id, item_id, min(spot)::bigint as first_word, max(spot + 12)::bigint as last_word, max(n)::bigint as n_matched
from windows where n >= 11 group by doc_id, item_id
"""


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op11_parity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


#: Pairs by common shingles, components by walking all links.
OP11_SQL = r"""
with recursive split as materialized (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), sets as materialized (
    select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
                        else list_distinct(list_transform(range(1, len(w) - 1), lambda k: concat(w[k], ' ', w[k + 1], ' ', w[k + 2]))) end as s
    from split
), grams as materialized (
    select doc_id, len(s) as n, hash(unnest(s)) as g from sets
), common as (
    select a.doc_id as a, b.doc_id as b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as c
    from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id
), links as materialized (
    select unnest([a, b]) as x, unnest([b, a]) as y from common where 100 * c >= 90 * (n_a + n_b - c)
), reach as (
    select x as start, x as spot from links
    union
    select r.start, l.y from reach r join links l on r.spot = l.x
)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(m.low, doc_id)) as component_id
from sets left join (select start, min(spot) as low from reach group by start) m on m.start = doc_id
"""


def op12_byte_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with words as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), told as (
    select doc_id, part,
           (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
           + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
           + 8 * regexp_matches(text, '[#$%&*|]')::int
           + 16 * coalesce(min(doc_id) over (partition by text) < doc_id, false)::int as failed
    from words
), known as (
    select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), patterns as (
    select part, failed, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
    from told left join known using (doc_id) group by part, failed
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as f
), orders as (
    select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
    select filter_order, step::int as step, (1 << (ascii(filter_order[step]) - 65)) as own,
           coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::bigint as before
    from orders, range(1, 6) t(step)
), counted as (
    select part, filter_order, step, own,
           sum(n) filter (where failed & (before | own) = 0) as kept,
           sum(n) filter (where failed & own <> 0 and failed & before = 0) as removed,
           sum(n) filter (where failed & own <> 0 and failed & before <> 0) as redundant,
           sum(n) filter (where failed = own) as unique_fails,
           sum(good) filter (where failed & own <> 0 and failed & before = 0) as good_lost,
           sum(toxic) filter (where failed & own <> 0 and failed & before = 0) as toxic_lost
    from patterns, steps group by part, filter_order, step, own
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, own))::bigint as shapley
from counted
"""


def op13_sliced_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(_table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 4) -> str:
    """Every round looks at all entries of a codebook; the smallest of ``distance * 256 + index`` is the nearest."""
    nearest = """
found{r} as materialized (
    select i, p, any_value(x) as x,
           min(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 256 + k) as best
    from parts join book{r} using (p) group by i, p
)"""
    update = """
means{r} as (
    select p, k, list(mean order by pos) as e from (
        select p, best % 256 as k, pos, floor(sum(x[pos]) / count(*))::bigint as mean
        from found{r}, unnest(range(1, len(x) + 1)) t(pos) group by p, best % 256, pos
    ) group by p, k
), book{n} as materialized (
    select p, k, coalesce(m.e, b.e) as e from book{r} b left join means{r} m using (p, k)
)"""
    steps = ",".join(nearest.format(r=r) + ("," + update.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with kept as materialized (
    select row_number() over (order by vec_id) as i, vec_id, label,
           list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
    select i, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] as x from kept, range(4) t(p)
), book0 as materialized (
    select p, i - 1 as k, x as e from parts where i <= 256
),{steps}, listed as (
    select sha256(string_agg(array_to_string(e, ','), ',' order by p, k)) as codebooks_sha256 from book{rounds}
), coded as (
    select i, string_agg(printf('%02x', best % 256), '' order by p) as code, sum(best // 256)::bigint as error
    from found{rounds} group by i
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (i), listed
"""


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_preference, op2_paragraph_minhash, op3_line_runs, op4_radix_repeats, op5_importance_resampling,
        op6_source_schedule, op7_setsketch, op8_cross_polytope, op9_spaced_seeds, op10_weak_supervision,
        op11_parity_sketch, op12_byte_transducer, op13_sliced_codes,
    )
}

ORACLES: dict[str, str] = {
    "op1_preference": OP1_SQL, "op3_line_runs": OP3_SQL, "op6_source_schedule": OP6_SQL, "op9_spaced_seeds": OP9_SQL,
    "op11_parity_sketch": OP11_SQL, "op12_byte_transducer": OP12_SQL, "op13_sliced_codes": _op13_sql(),
}
