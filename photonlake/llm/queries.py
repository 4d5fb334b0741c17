"""The corpus operators as registered queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonlake.llm import conversation_repair, decontaminate, language_id, line_dedup, packing, periodic_runs, secrets, simhash, substring_dedup, suffix_dedup, token_count, toxicity, vector_search
from photonlake.llm.common import table


def op1_token_counts(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op2_vector_search(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op6_language_id(spark, sf_dir):
    return language_id.held_out_query(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.held_out_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repaired_query(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.drop_lines(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_vector_search, op3_simhash, op4_suffix_dedup, op5_secret_scan, op6_language_id, op7_toxicity, op8_substring_dedup, op9_decontamination, op10_packing, op11_periodic_runs, op12_conversation_repair, op13_line_dedup)}
ORACLE: dict[str, str] = {
    "op2_vector_search": """
        with good as (
            select vec_id, cast(embedding as double[]) as v from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        scored as (
            select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) as score
            from good a join good b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
        ranked as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank,
                   vec_id, score
            from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op4_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        p as (select doc_id, h, unnest(range(1, len(h) // 2 - 98)) as i from d where len(h) >= 200),
        w as (select doc_id, i, md5(substr(h, 2 * i - 1, 200)) as k from p),
        f as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from w) where r > 1),
        s as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from f),
        g as (select doc_id, i, sum(case when before is null or i > before + 100 then 1 else 0 end) over (partition by doc_id order by i) as g from s),
        runs as (select doc_id, g, min(i) as a, max(i) + 99 as b from g group by doc_id, g),
        parts as (select r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) over v, 0) + 1, 2 * (a - 1 - coalesce(lag(b) over v, 0))) as part
                  from runs r join d on r.doc_id = d.doc_id window v as (partition by r.doc_id order by a)),
        kept as (select doc_id, sum(b - a + 1) as n_removed, count(*) as n_spans, string_agg(part, '' order by a) as front, max(b) as last from parts group by doc_id)
        select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
               sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join kept on d.doc_id = kept.doc_id""",
    "op8_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        p as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
        k as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as k from p),
        f as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from k) where n > 1),
        s as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from f),
        g as (select doc_id, i, sum(case when before is null or i > before + 35 then 1 else 0 end) over (partition by doc_id order by i) as g from s),
        runs as (select doc_id, g, min(i) as a, max(i) + 34 as b from g group by doc_id, g),
        parts as (select r.doc_id, a, b, list_slice(w, coalesce(lag(b) over v, 0) + 1, a - 1) as part
                  from runs r join d on r.doc_id = d.doc_id window v as (partition by r.doc_id order by a)),
        kept as (select doc_id, sum(b - a + 1) as n_removed, flatten(list(part order by a)) as front, max(b) as last from parts group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
               sha256(array_to_string(list_concat(coalesce(front, []), list_slice(w, coalesce(last, 0) + 1, len(w))), ' ')) as kept_sha256
        from d left join kept on d.doc_id = kept.doc_id""",
    "op13_line_dedup": r"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l as (select doc_id, i, lines[i] as line, translate(trim(lines[i], concat(' ', chr(9), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
              from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from d)),
        gone as (select k from l where k <> '' group by k having count(distinct doc_id) >= 10),
        m as (select l.*, gone.k is not null as drop from l left join gone on l.k = gone.k)
        select doc_id, count(*) as n_lines, count(*) filter (drop) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not drop), '')) as kept_sha256 from m group by doc_id""",
}
