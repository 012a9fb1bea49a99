"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.bitsliced import ranked_search
from sluice.llm.chatlog import event_log, fold_log, read_back, render_turns
from sluice.llm.exact import exact_groups
from sluice.llm.gru import score_texts
from sluice.llm.interactions import audit_filters
from sluice.llm.language import identify, train
from sluice.llm.layout import extract_text
from sluice.llm.licences import license_scan
from sluice.llm.mixing import mix, tempered_targets, tokens_of, topic_of
from sluice.llm.packing import pack, token_pieces
from sluice.llm.quality import COUNTS, learn_rules, quality_verdicts, text_statistics
from sluice.llm.setsketch import near_groups
from sluice.llm.substrings import remove_repeats
from sluice.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE["op5_exact_dedup"] = """
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept,
       sha256(coalesce(d.text, '')) as text_sha256
from documents d
join (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size
      from documents group by 1) g on g.t = coalesce(d.text, '')
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(text_statistics(read(spark, sf_dir, "documents")), "statistics")
    rules = learn_rules(counts, read(spark, sf_dir, "labels"))
    return quality_verdicts(counts, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


@query
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with the checksum of their ids and their places."""
    pieces = token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(narrow, "pieces"), ["doc_id", "piece", "ids_crc32"])


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).drop("text_hash")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = remove_repeats(read(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    narrow = read(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", topic_of(text).alias("topic"), tokens_of(text).alias("tokens")
    )
    narrow = materialize(narrow, "classes")
    targets = tempered_targets(narrow, ["source", "lang", "topic"], "tokens")
    return mix(narrow, targets, "tokens", dimensions=["source", "lang", "topic"])


@query
def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    scored = score_texts(docs, docs.where(~held_out))
    return scored.withColumn("held_out", held_out)


@query
def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


#: A conversation whose texts are control strings.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return read_back(render_turns(fold_log(event_log(turns.unionByName(extra)))))


@query
def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op13_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op2_substring_dedup"] = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
     windows as (select doc_id, i, array_to_string(ws[i : i + 49], ' ') as k
                 from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from words)),
     least as (select k, min(doc_id) as low from windows group by k),
     gone as (select distinct doc_id, i + unnest(range(50)) as p
              from windows join least using (k) where low < doc_id),
     placed as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from words),
     kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n
              from placed anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(kept.text, '')) as kept_sha256
from words left join kept using (doc_id)
"""

ORACLE["op10_minhash_near_dedup"] = rf"""
with recursive
     words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                 '[^\x20\x09-\x0D]+') as ws from documents),
     sets as (select distinct doc_id, sh from (
                select doc_id, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')]
                    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as sh
                from words where len(ws) > 0)),
     sizes as (select doc_id, count(*) as c from sets group by doc_id),
     pairs as (select x.doc_id as a, y.doc_id as b, count(*) as k from sets x join sets y using (sh)
               where x.doc_id < y.doc_id group by all),
     links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
               where 100 * k >= 75 * (x.c + y.c - k)),
     both_ways as (select a, b from links union all select b, a from links),
     reach as (select doc_id, doc_id as r from documents
               union select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.r),
     least as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(c, 0) as n_shingles, component_id, doc_id = component_id as kept
from least left join sizes using (doc_id)
"""

#: Control strings of the default template, and the characters that its markers add to a turn.
_CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]",
             "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>"]


def _broken(column: str) -> str:
    """SQL for the number of backslashes that escaping adds."""
    found = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in [*_CONTROLS, chr(92)]]
    return " + ".join(found)


ORACLE["op11_chat_formatting"] = rf"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
               union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
               union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     sized as (select *, length(t) + {_broken("t")} + case role when 'system' then 17 when 'user' then 15 when 'assistant' then 9
                          else 23 + length(role) + {_broken("role")} end as chars from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(t) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

ORACLE["op12_filter_interactions"] = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
     low as (select t, min(doc_id) as least from d group by t),
     w as (select *, regexp_extract_all(t, '[^ 	-
]+') as ws from d),
     l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
           from labels group by doc_id),
     masks as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                      case when len(ws) < 200 then 1 else 0 end
                      + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
                      + case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) then 4 else 0 end
                      + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
                      + case when least < w.doc_id then 16 else 0 end as mask
               from w join low using (t) left join l on l.doc_id = w.doc_id),
     hist as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by all),
     f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
     orders as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
                from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
     steps as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1 : step - 1]), 0)::int as before
               from orders, range(1, 6) r(step)),
     counted as (select part, filter_order, step, bit,
                   sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
                   sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
                   sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
                   sum(case when mask = bit then n else 0 end) as unique_fails,
                   sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
                   sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
                 from hist, steps group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from counted
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op13_bitsliced_search"] = rf"""
with words as (select row_number() over () as r, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') as ws from documents),
     sizes as (select r, doc_id, len(ws) as n from words where len(ws) > 0),
     totals as (select count(*) as docs, sum(n)::bigint as terms from sizes),
     asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) as term
               from benchmark),
     tfs as (select r, term, count(*) as tf from (select r, unnest(ws) as term from words)
             where term in (select term from asked) group by all),
     dfs as (select term, count(*) as df from tfs group by term),
     weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from dfs, totals),
     scaled as (select r, doc_id, 100 - 50 + ((50 * n * docs) // terms) as m from sizes, totals),
     scores as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
                from asked join weights using (term) join tfs using (term) join scaled using (r) group by all),
     ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
