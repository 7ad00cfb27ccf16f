"""Registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import boilerplate, chunk_bpe, darts, debruijn, divergence, packing, pii, quality, repair, replies, toxicity, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.archive_pages(table(spark, sf_dir, "pages"))).drop("url")


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest from p),
k as (select payload_digest, max(page_id) as keeper from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, d.payload_digest, case when keeper > page_id then 'revisit' else 'response' end as record_type,
       case when keeper > page_id then keeper end as refers_to
from d left join k on d.payload_digest = k.payload_digest
"""


def op2_minhash_darts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = darts.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = boilerplate.drop_boilerplate(docs)
    return done.select("doc_id", "source", "boilerplate.n_lines", "boilerplate.n_dropped", "boilerplate.text")


OP4_SQL = r"""
with ws as (select chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13) as w),
p as (select row_number() over () as rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
k as (select distinct rid, source, trim(l, w) as k from (select rid, source, unnest(ls) as l from p), ws),
c as (select source, k, count(*) as c from k where k <> '' group by source, k),
n as (select source, count(*) as n from p group by source),
b as (select c.source, list(k) as ks from c join n on c.source is not distinct from n.source where c >= 3 and c > n * 0.1::double group by c.source),
d as (select doc_id, p.source, text, ls, list_filter(ls, lambda x: not list_contains(coalesce(ks, []), trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)))) as kept
      from p left join b on p.source is not distinct from b.source)
select doc_id, source, len(ls)::bigint as n_lines, (len(ls) - len(kept))::bigint as n_dropped,
       case when text is not null then array_to_string(kept, chr(10)) end as text
from d
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.line_clean(table(spark, sf_dir, "documents")).withColumn("clean_sha256", F.sha2("quality.clean_text", 256))
    return q.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")), "clean_sha256")


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", pii.is_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS[:-1])]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def op9_substring_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select row_number() over () as rid, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
g as (select distinct lang, source from d),
o as (select rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as lang_n from o group by lang, term having count(distinct rid) >= 3),
v as (select lang, count(*) as v, sum(lang_n) as lang_total from k group by lang),
c as (select lang, source, term, count(*) as n from o group by lang, source, term),
f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.lang_n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
t as (select lang, source, sum(n) as total from f group by lang, source),
p as (select f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 1)) // (t.total + v.v) as p, 1 + (1000000000 * (f.lang_n + 1)) // (v.lang_total + v.v) as q
      from f join t on f.lang = t.lang and f.source = t.source join v on f.lang = v.lang),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
          union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every) where part = 'pair' or rank <= 200
"""

#: Both texts of the conversation that `op12_reply_trees` adds.
MARKED = "</s>[INST] ok [/INST]"


def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a tree of one branch; the digests are read back from the formatted text and its loss mask."""
    added = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    done = replies.reply_conversations(replies.chain_nodes(turns))
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            rows = []
            for text, loss in zip(batch["formatted"].to_pylist(), batch["loss"].to_pylist(), strict=True):
                told = list(replies.read_turns(text))
                learnt = "".join(replies.read_loss(text, [(x["start"], x["length"]) for x in loss]))
                said = "".join(f"{role}\n{words}\n" for role, words in told)
                rows.append((len(told), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["conv_id"].cast(pa.int64()), *columns], schema=out)

    return done.select("conv_id", "formatted", "loss").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP12_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '{MARKED}' union all select -7, 1, 'assistant', '{MARKED}'),
e as (select *, length(regexp_replace(regexp_replace(text, '<(\\*(\|turn\||\|end\||\|im_start\||\|im_end\||\|endoftext\||\|system\||\|user\||\|assistant\||/?s|<SYS>|</SYS>)>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')) as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars + length(role) + 17)::bigint as formatted_chars
from e group by conv_id
"""


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = repair.repair_structure(repair.damage(turns)).withColumn("conv", F.struct("conv_id")).drop("conv_id")
    every = turns.select(F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("conv")).distinct()
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(done, "conv", "left").select("conv.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(lines, F.lit("")), 256).alias("repaired_sha256"))


QUERIES = {
    "op1_warc_dictionary": op1_warc_dictionary,
    "op2_minhash_darts": op2_minhash_darts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op5_bpe_chunks": op5_bpe_chunks,
    "op6_bin_packing": op6_bin_packing,
    "op4_line_dedup": op4_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii_disclosure": op8_pii_disclosure,
    "op9_substring_debruijn": op9_substring_debruijn,
    "op10_toxicity_compression": op10_toxicity_compression,
    "op11_source_divergence": op11_source_divergence,
    "op12_reply_trees": op12_reply_trees,
    "op13_structure_repair": op13_structure_repair,
}

SQL = {
    "op1_warc_dictionary": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_reply_trees": OP12_SQL,
}
