"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorform.llm import bpe, jaccard, langid, licenses, mil, nndescent, pitman, ptolemy, shards, strata, suffixes, winnow, wordpiece
from priorform.llm._common import crc_of_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 20
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def held_out(parts: int, rest: int):
    return crc_of_id() % parts == rest


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those with crc32(doc_id) mod 4 other than 2."""
    docs = table(spark, folder, "documents")
    model = langid.train(docs.where(~held_out(4, 2)))
    return langid.identify(docs, model, keep=["doc_id", held_out(4, 2).alias("held_out")])


@query
def op2_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.link(table(spark, folder, "documents"), width=3, percent=90).drop("group_key", "text_key")


@query
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence lines in every document."""
    return licenses.scan(table(spark, folder, "documents"))


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Word-piece lengths of every document with the pieces of a public vocabulary."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    first, inner = wordpiece.split_vocabulary(map(model.id_to_piece, plain))
    return wordpiece.counts(table(spark, folder, "documents"), first, inner)


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from labels whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, folder, "documents")
    model = mil.train(docs, table(spark, folder, "labels").where(~held_out(4, 2)))
    scored = mil.score(docs, model, keep=["doc_id", held_out(4, 2).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of one mixture, row counts at most one apart."""
    cut = shards.interleave(table(spark, folder, "documents"), 8, seed=SEED)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against the benchmark: words and items hit by windows of ten words."""
    found = winnow.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query
def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document, learned from those with crc32(doc_id) mod 10 other than 0."""
    docs = table(spark, folder, "documents")
    scored = pitman.score(docs, ~held_out(10, 0))
    return scored.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op10_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings at a cosine of 0.95 or more, their number of links and components."""
    found, _ = nndescent.near_duplicates(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op11_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier."""
    cut = suffixes.remove_repeats(table(spark, folder, "documents"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


@query
def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Forty clusters of all embeddings of 64 components, five rounds."""
    return ptolemy.cluster(table(spark, folder, "embeddings")).drop("measured")


@query
def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty documents of highest score for each benchmark item, over an index of all documents."""
    found = strata.search(strata.build(table(spark, folder, "documents")), table(spark, folder, "benchmark"), k=20)
    return found.withColumnRenamed("id", "doc_id")


ORACLES["op7_decontamination"] = r"""
with bench as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_windows as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') as g
  from bench, unnest(range(1, greatest(1, len(w) - 9) + 1)) as r(p) where len(w) > 0),
lengths as (select distinct n from item_windows),
docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
places as (
  select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as g
  from docs, lengths, unnest(range(1, len(w) - n + 2)) as r(p) where len(w) >= n),
met as (select doc_id, p, places.n, item from places join item_windows on places.g = item_windows.g and places.n = item_windows.n),
words_hit as (select doc_id, count(distinct q) as n_hit from met, unnest(range(p, p + n)) as r(q) group by 1),
items_hit as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from met group by 1)
select docs.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from docs left join words_hit on docs.doc_id = words_hit.doc_id left join items_hit on docs.doc_id = items_hit.doc_id
"""

ORACLES["op6_shards"] = f"""
with crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                          lambda c, x: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) as c
    from range(256) as r(i))),
facts as (
  select doc_id, source, coalesce(strlen(text), 0) + 1 as size, md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h,
         xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint))),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as crc
  from documents, crc_table),
ranked as (
  select *, (row_number() over (partition by source order by h, doc_id, crc, size) - 0.5::double) / count(*) over (partition by source) as f from facts),
ordered as (
  select *, row_number() over (order by f, h, coalesce('=' || source, ''), doc_id, crc, size) - 1 as place, count(*) over () as total from ranked),
cut as (select *, place * 8 // total as shard from ordered)
select doc_id, cast(size as bigint) as size, crc as text_crc32, 'rows' as law, cast(shard as int) as shard,
       place - (shard * total + 7) // 8 as slot, cast(null as int) as grown_shard
from cut
"""


def _license_sql() -> str:
    """The same scan, every template tried at every word."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    columns, shares = [], []
    for k, t in enumerate(licenses.TEMPLATES):
        n = len(t.words)
        tests = " and ".join(f"w[s + {a + 1}] = '{t.words[a]}' and w[s + {a + 1} : s + {b}] = {quoted(t.words[a:b])}" for a, b in t.keys)
        columns.append(f"list_filter(range(len(w) - {n} + 1), lambda s: {tests}) as s{k}")
        same = " + ".join(f"cast(w[s + {i + 1}] = '{x}' as int)" for i, x in enumerate(t.words))
        shares.append(f"coalesce(list_max(list_transform(s{k}, lambda s: ({same}) / {float(n)}::double)), 0)")
    labels = lambda kinds: "coalesce(array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
        f"case when len(s{k}) > 0 then '{licenses.TEMPLATES[k].label}' end" for k in kinds
    ) + "], lambda x: x is not null))), ','), '')"
    base = [k for k, t in enumerate(licenses.TEMPLATES) if t.base]
    places = " || ".join(f"s{k}" for k in base)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') as w
  from documents),
found as (select doc_id, w, {", ".join(columns)} from docs)
select doc_id, cast(len(w) as bigint) as n_words, cast(len({places}) as bigint) as n_base, list_min({places}) as first_word,
       list_max({places}) as last_word, {labels(base)} as base_labels, {labels(range(len(licenses.TEMPLATES)))} as labels,
       greatest({", ".join(shares)}) as score
from found
"""


ORACLES["op3_licenses"] = _license_sql()


def _repeats_sql(length: int) -> str:
    """Every byte string of that length, its first place, and the bytes that later places cover."""
    return f"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
places as (select doc_id, p, md5(substr(x, 2 * p + 1, {2 * length})) as s from docs, unnest(range(len(x) // 2 - {length - 1})) as r(p)),
later as (select doc_id, p from places qualify (doc_id, p) <> first_value((doc_id, p)) over (partition by s order by doc_id, p)),
edges as (select *, p > lag(p) over (partition by doc_id order by p) + {length} as far, lag(p) over (partition by doc_id order by p) is null as new from later),
runs as (select doc_id, p, sum(cast(far or new as int)) over (partition by doc_id order by p) as run from edges),
spans as (select doc_id, run, min(p) as s, max(p) + {length} as e from runs group by 1, 2),
pieces as (select doc_id, e, s, lag(e, 1, 0) over (partition by doc_id order by s) as begins from spans),
cut as (
  select doc_id, sum(e - s) as n_removed, count(*) as n_spans, max(e) as last,
         string_agg(substr(x, 2 * begins + 1, 2 * (s - begins)), '' order by s) as kept
  from pieces join docs using (doc_id) group by 1)
select docs.doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from docs left join cut on docs.doc_id = cut.doc_id
"""


ORACLES["op11_repeated_bytes"] = _repeats_sql(100)


def _clusters_sql(k: int, rounds: int, seed: int) -> str:
    """Every distance to every centroid, round by round."""
    near = "list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::bigint"
    parts = [f"""
with kept as (
  select vec_id, list_transform(embedding, lambda v: cast(floor(256 * cast(v as double)) as bigint)) as q
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
c0 as (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as n, q as c from kept qualify n < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select vec_id, q, min(({near}, n)) as best from kept, c{i} group by 1, 2)")
        if i < rounds:
            parts.append(f"""
u{i} as (select best[2] as n, i, sum(q[i]) as s, count(*) as m from a{i}, unnest(range(1, 65)) as r(i) group by 1, 2),
m{i} as (select n, list(cast((s - ((s % m) + m) % m) // m as bigint) order by i) as v from u{i} group by 1),
c{i + 1} as (select c{i}.n, coalesce(v, c) as c from c{i} left join m{i} on c{i}.n = m{i}.n)""")
    return ",".join(parts) + f"""
select vec_id, cast(best[2] as int) as cluster, best[1] as distance, cast(sum(best[1]) over (partition by best[2]) as bigint) as cluster_inertia,
       cast(sum(best[1]) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} on best[2] = n
"""


ORACLES["op12_clusters"] = _clusters_sql(40, 5, 2)

ORACLES["op13_search"] = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
sizes as (select doc_id, cast(len(w) as bigint) as n from words where len(w) > 0),
whole as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark) group by 1, 2),
postings as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words) group by 1, 2),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as weight
  from (select term, count(*) as df from postings group by 1), whole),
scores as (
  select item_id, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) as bigint) as score
  from asked join postings using (term) join weights using (term) join sizes using (doc_id), whole group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from scores where score > 0 qualify rank <= 20
"""
