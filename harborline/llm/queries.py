"""Queries of this subpackage: one per operator, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import bm25, bwt_dedup, chat, extendible, hard_negatives, infilling, jaccard_join, langid, mixing, parsing, pii, pitman_yor, sentencepieces


def _over(op: Callable[[DataFrame], DataFrame], table: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(ship(spark).read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": _over(pitman_yor.op1),
    "op2_semi_crf_pii": _over(pii.op2),
    "op3_block_max_wand": _over(bm25.op3),
    "op4_extendible_hashing": _over(extendible.op4),
    "op5_language_filters": _over(langid.op5),
    "op6_pfair_mixing": _over(mixing.op6),
    "op7_bwt_dedup": _over(bwt_dedup.op7),
    "op8_consistent_parsing": _over(parsing.op8),
    "op9_jaccard_join": _over(jaccard_join.op9),
    "op10_sentencepiece": _over(sentencepieces.op10),
    "op11_fill_in_middle": _over(infilling.op11),
    "op12_hard_negatives": _over(hard_negatives.op12, "embeddings"),
    "op13_chat_format": _over(chat.op13, "conversations"),
}

ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": infilling.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_chat_format": chat.OP13_SQL,
    "op3_block_max_wand": bm25.OP3_SQL,
    "op4_extendible_hashing": extendible.OP4_SQL,
    "op9_jaccard_join": r"""
with recursive w as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as ws
  from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
      else [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(root) from r where r.doc_id = d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id""",
}
