"""Registered queries of the training-data operators, over whole tables, and SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .decontam import contamination
from .exact_dedup import exact_dedup
from .attention_lm import score_documents
from .centroids import ROUNDS, cluster
from .filter_audit import filter_audit
from .html_text import extract_text
from .pii import BASE, find_pii, joined
from .repeats import remove_repeats
from .simhash import simhash_components
from .suffix_dedup import remove_substrings
from . import toxicity
from .sp_lattice import Encoding
from .token_shards import read_token_shards, write_token_shards


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_token_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_shards(spark, path, with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=toxicity.in_held_out())
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.in_held_out().alias("held_out"), "score", "predicted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_documents(table(spark, sf_dir, "documents"))


def sentencepiece_documents(docs: DataFrame) -> DataFrame:
    """Per document: number of pieces, a hash of the ids in order, the ids, and whether decoding them gives the text."""
    encoded = Encoding(docs, public_tokenizers.path("piece_bpe_32k.model")).documents()
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "ids", "round_trip")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    scores = score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _lloyd_sql() -> str:
    """The rounds as a chain of tables: a<r> has each vector's centroid in round r, c<r> the centroids."""
    def assigned(r: int) -> str:
        return f"""a{r} as materialized (select i, c, d from (select i, c, d, row_number() over (partition by i order by d, c) as k from
            (select v.i, c.c, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{r} c on v.j = c.j group by v.i, c.c)) where k = 1)"""

    def moved(r: int) -> str:
        return f"""c{r + 1} as materialized (select c.c, c.j, cast(coalesce((s - ((s % n) + n) % n) // n, c.x) as bigint) as x from c{r} c left join
            (select a.c, v.j, sum(v.x) as s, count(*) as n from v join a{r} a on v.i = a.i group by a.c, v.j) m on c.c = m.c and c.j = m.j)"""

    rounds = ", ".join(f"{assigned(r)}, {moved(r)}" for r in range(ROUNDS))
    return f"""
        with e as materialized (select row_number() over () as i, vec_id, embedding from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(cast(x as double)))) = 64),
        v as materialized (select i, unnest(range(1, 65)) as j, unnest(list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) as x from e),
        s as (select i, row_number() over (order by sha256('3:' || cast(vec_id as varchar))) - 1 as c from e),
        c0 as materialized (select s.c, v.j, v.x from s join v using (i) where s.c < 8), {rounds}, {assigned(ROUNDS)},
        h as (select c, sha256(string_agg(cast(x as varchar), ',' order by j)) as centroid_sha256 from c{ROUNDS} group by c)
        select vec_id, cast(a.c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
               cast(sum(d) over () as bigint) as inertia, centroid_sha256
        from a{ROUNDS} a join e using (i) join h on a.c = h.c
    """


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_shards": op5_token_shards,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_lm_scores": op10_lm_scores,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        with t as (select doc_id, coalesce(text, '') as text from documents),
        n as (select doc_id, length(text) as n_chars, sha256(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from t)
        select doc_id, first(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = first(doc_id) over w as kept, text_sha256
        from n window w as (partition by text_sha256 order by n_chars desc, doc_id
                            rows between unbounded preceding and unbounded following)
    """,
    "op2_decontamination": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
        p as (select distinct item_id, least(len(w), 10) as n, list_aggregate(w[i : i + least(len(w), 10) - 1], 'string_agg', ' ') as win
              from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
        sizes as (select distinct n from p),
        o as (select doc_id, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as win
              from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
        h as (select doc_id, i, o.n, item_id from o join p on o.win = p.win and o.n = p.n),
        words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from h) group by doc_id),
        items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
                  from h group by doc_id)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (doc_id) left join items using (doc_id)
    """,
    "op9_substring_dedup": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        o as (select doc_id, i, list_aggregate(w[i : i + 19], 'string_agg', ' ') as win
              from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
        r as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from o) where k > 1),
        gone as (select doc_id, list(distinct p) as ps, count(distinct p) as n from (select doc_id, unnest(range(i, i + 20)) as p from r) group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed,
               sha256(coalesce(list_aggregate(case when n is null then w else list_filter(w, lambda x, p: not list_contains(ps, p)) end, 'string_agg', ' '), '')) as kept_sha256
        from d left join gone using (doc_id)
    """,
    "op11_suffix_dedup": r"""
        with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        w as (select r, i, md5(substr(h, 2 * i + 1, 400)) as k from (select r, h, unnest(range(0, len(h) // 2 - 199)) as i from d where len(h) >= 400)),
        again as (select r, i from (select r, i, count(*) over (partition by k) as n from w) where n > 1),
        starts as (select r, i, lag(i) over (partition by r order by i) as before from again),
        runs as (select r, min(i) as a, max(i) + 200 as z from
                   (select r, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by r order by i) as g from starts) group by r, g),
        spans as (select r, list(a order by a) as a, list(z order by a) as z, sum(z - a) as n from runs group by r)
        select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, cast(coalesce(len(a), 0) as bigint) as n_spans,
               sha256(unhex(case when a is null then h else list_aggregate(list_transform(list_zip(list_prepend(0, z), list_append(a, len(h) // 2)),
                                                                  lambda x: substr(h, 2 * x[1] + 1, 2 * (x[2] - x[1]))), 'string_agg', '') end)) as kept_sha256
        from d left join spans using (r)
    """,
    "op12_filter_audit": r"""
        with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
        w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by text) as first from d),
        f as (select w.doc_id, part, cast(len(ws) < 200 as int) + cast(100 * len(list_distinct(ws)) < 50 * len(ws) as int) * 2
                     + cast(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as int) * 4
                     + cast(regexp_matches(text, '[#$%&*|]') as int) * 8 + cast(w.doc_id > first as int) * 16 as mask from w),
        marks as (select doc_id, max(cast(coalesce(quality = 1, false) as int)) as good, max(cast(coalesce(toxic = 1, false) as int)) as toxic from labels group by doc_id),
        cells as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join marks using (doc_id) group by part, mask),
        k as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        orders as (select a.x || b.x || c.x || d.x || e.x as o from k a, k b, k c, k d, k e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps as (select o, s, 1 << (instr('ABCDE', substr(o, s, 1)) - 1) as bit,
                         list_sum(list_transform(range(1, s), lambda i: 1 << (instr('ABCDE', substr(o, i, 1)) - 1))) as before from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
        r as (select part, o as filter_order, s as step,
                     sum(case when mask & (coalesce(before, 0) | bit) = 0 then n else 0 end) as kept,
                     sum(case when mask & coalesce(before, 0) = 0 and mask & bit > 0 then n else 0 end) as removed,
                     sum(case when mask & coalesce(before, 0) > 0 and mask & bit > 0 then n else 0 end) as redundant,
                     sum(case when mask = bit then n else 0 end) as unique_fails,
                     sum(case when mask & coalesce(before, 0) = 0 and mask & bit > 0 then good else 0 end) as good_lost,
                     sum(case when mask & coalesce(before, 0) = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
              from cells, (select o, s, cast(bit as bigint) as bit, cast(before as bigint) as before from steps) group by part, o, s)
        select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
               cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
               cast(sum(removed) over (partition by part, substr(filter_order, step, 1)) as bigint) as shapley
        from r
    """,
    "op13_centroids": _lloyd_sql(),
}
