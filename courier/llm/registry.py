"""The queries of the training-data operators: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, hilbert, license_scan, line_templates, nearest, packing, preference, simhash, token_counts, toxicity
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda p: p["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",").alias("families"),
        F.coalesce(F.round(F.array_max(F.transform("found", lambda p: p["probability"])), 6), F.lit(0.0)).alias("best_probability"),
    )


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_templates.drop_templates(table(spark, sf_dir, "documents"), dropped="n_dropped")
    kept = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return left.select("doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), kept.alias("chars_left"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preference.swapped_answers(table(spark, sf_dir, "conversations"))
    pairs = preference.preference_pairs(chosen, rejected)
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return pairs.select(
        "pair_id", F.col("prefix_turns").cast("long").alias("prefix_turns"), *[F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")],
        trained(F.col("chosen_mask")).alias("chosen_trained"), trained(F.col("rejected_mask")).alias("rejected_trained"),
    )


def op7_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors.where("vec_id % 50 = 0"), vectors)


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.place(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_line_templates, op3_best_fit_packing, op4_simhash, op5_decontaminate, op6_preference, op7_block_join, op8_hilbert, op9_token_counts, op10_toxicity)}


OP2_SQL = r"""
with raw as (select doc_id, coalesce(doc_id, -9223372036854775808) as id, text, string_split(text, chr(10)) as parts from documents),
lines as (select id, text, i, trim(regexp_replace(parts[i], '[ \t\r\x0b\f]+', ' ', 'g'), ' ') as clean from (select distinct id, text, parts, unnest(range(1, len(parts) + 1)) as i from raw)),
masked as (select id, text, i, regexp_replace(clean, '[^ ]*[0-9][^ ]*', '<*>', 'g') as masked from lines where clean <> ''),
leaves as (select *, string_split(masked, ' ') as tokens, len(string_split(masked, ' ')) as n, array_to_string(string_split(masked, ' ')[1:4], ' ') as head from masked),
mixed as (select n, head from leaves group by n, head having count(distinct masked) > 1 and count(distinct id) >= 3),
places as (select n, head, p, count(distinct tokens[p]) = 1 as fixed from (select l.n, l.head, l.tokens, unnest(range(1, l.n + 1)) as p from leaves l join mixed m on l.n = m.n and l.head = m.head) group by n, head, p),
merged as (select n, head from places group by n, head having count(*) filter (where fixed) >= 0.7 * count(*)),
named as (select l.id, l.text, l.i, case when m.n is not null then m.n || chr(9) || m.head else l.masked end as template from leaves l left join merged m on l.n = m.n and l.head = m.head),
recurring as (select template, min(id) as home from named group by template having count(distinct id) >= 3),
gone as (select distinct n.id, n.text, n.i from named n join recurring r on n.template = r.template where n.id <> r.home),
cuts as (select id, text, count(*) as n, list(i) as gone from gone group by id, text),
left_over as (select r.doc_id, coalesce(c.n, 0) as n, case when c.n is null then r.text else array_to_string([r.parts[i] for i in range(1, len(r.parts) + 1) if not list_contains(c.gone, i)], chr(10)) end as t from raw r left join cuts c on r.id = c.id and r.text = c.text)
select doc_id, n::bigint as n_dropped, length(coalesce(t, ''))::bigint as chars_left, md5(coalesce(t, '')) as text_md5 from left_over
"""

#: Conversations: as swapped_answers() and preference_pairs(), with window functions.
OP6_SQL = """
with plain as (select conv_id as pair_id, coalesce(turn, -4611686018427387904) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
answers as (select pair_id, turn as last_turn, text as answer from (select *, row_number() over (partition by pair_id order by turn desc, text desc) as n from plain where role = 'assistant') where n = 1),
ends as (select a.pair_id, a.last_turn, b.answer from answers a join answers b on b.pair_id = xor(a.pair_id, 1::bigint)),
kept as (select p.pair_id, p.turn, p.role, p.text, case when p.turn = e.last_turn and p.role = 'assistant' then e.answer else p.text end as other from plain p join ends e on p.pair_id = e.pair_id where p.turn <= e.last_turn),
numbered as (select *, row_number() over (partition by pair_id order by turn, role, text) as nc, row_number() over (partition by pair_id order by turn, role, other) as nr from kept),
aligned as (select c.pair_id, c.nc as n, c.role as crole, c.text as ctext, r.role as rrole, r.other as rtext from numbered c join numbered r on c.pair_id = r.pair_id and c.nc = r.nr),
prefix as (select *, bool_and(crole = rrole and ctext = rtext) over (partition by pair_id order by n rows unbounded preceding) as same from aligned),
parts as (select *, '<|' || crole || '|>' || chr(10) || ctext || '<|end|>' || chr(10) as c, '<|' || rrole || '|>' || chr(10) || rtext || '<|end|>' || chr(10) as r from prefix)
select pair_id, count(*) filter (where same)::bigint as prefix_turns,
  md5(coalesce(string_agg(c, '' order by n) filter (where same), '')) as prompt_md5,
  md5(coalesce(string_agg(c, '' order by n) filter (where not same), '')) as chosen_md5,
  md5(coalesce(string_agg(r, '' order by n) filter (where not same), '')) as rejected_md5,
  coalesce(sum(length(ctext) + 8) filter (where not same and crole = 'assistant'), 0)::bigint as chosen_trained,
  coalesce(sum(length(rtext) + 8) filter (where not same and rrole = 'assistant'), 0)::bigint as rejected_trained
from parts group by pair_id
"""

OP5_SQL = r"""
with words as (select doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
items as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
windows as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as phrase from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct n from windows),
spots as (select doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') as phrase from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words) d, sizes s where i + s.n - 1 <= len(w)),
found as (select doc_id, i, s.n, item_id from spots s join windows b on s.n = b.n and s.phrase = b.phrase),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
owners as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from found group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w)) as contaminated
from words w left join hit using (doc_id) left join owners using (doc_id)
"""

OP7_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null),
pairs as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_templates": OP2_SQL, "op5_decontaminate": OP5_SQL, "op6_preference": OP6_SQL, "op7_block_join": OP7_SQL}
