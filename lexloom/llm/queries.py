"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import block_labeller, license_scan, packing, piece_viterbi, toxicity
from lexloom.llm.binary_codes import near_duplicates
from lexloom.llm.concurrency import sweep
from lexloom.llm.importance_resampling import resample
from lexloom.llm.jaccard_join import jaccard_components
from lexloom.llm.order_minhash import fingerprints
from lexloom.llm.sharding import shard
from lexloom.llm.suffix_dedup import cut_digests
from lexloom.llm.wordpiece_counts import count_tokens


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, told by their count, checksums, and whether the text came back."""
    model = tokenizer_path("piece_bpe_32k.model")
    out = piece_viterbi.decode(piece_viterbi.encode(documents(spark, sf_dir), model), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.crc32(F.array_join("ids", ",").cast("binary")).cast("long").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op5_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for strings of 400 bytes, and in n_shared how much repeats in strings of 200: passages of some fifty short words."""
    return cut_digests(documents(spark, sf_dir), length=400, shorter=200)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op11_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return block_labeller.extract(pages, block_labeller.fit(pages))


def op12_concurrency_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, clients = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines", "clients"))
    return sweep(sales, lines, clients)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1, buckets=10_000, percent=10, least_words=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_piece_viterbi": op4_piece_viterbi,
    "op5_wordpiece_counts": op5_wordpiece_counts,
    "op6_order_minhash": op6_order_minhash,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_binary_codes": op10_binary_codes,
    "op11_block_labeller": op11_block_labeller,
    "op12_concurrency_sweep": op12_concurrency_sweep,
    "op13_importance_resampling": op13_importance_resampling,
}
#: Links by full comparison, components by their transitive closure.
_CLOSURE = """, both_ways as (select x, y from links union all select y, x from links),
 reach as (select rid, rid as r from rows0 union select reach.rid, y from reach join both_ways on r = x),
 least as (select reach.rid, min(o.{id}) as component_id from reach join rows0 o on o.rid = r group by 1) """


def _runs(n: int) -> str:
    """CTE runs{n}: maximal runs [a, b) of bytes in n-byte strings that start twice, by 64-bit hashes of their hexadecimal digits."""
    return f"""parts{n} as (select rid, nb, b, substr(h, {2 * n} * b + 1, {4 * n}) as p from (select rid, nb, h, unnest(range(0, nb // {n} + 1)) as b from texts)),
 starts{n} as (select rid, {n} * b + j as i, hash(substr(p, 2 * j + 1, {2 * n})) as g from (select rid, nb, b, p, unnest(range(0, {n})) as j from parts{n}) where {n} * b + j + {n} <= nb),
 twice{n} as (select g from starts{n} group by g having count(*) > 1),
 hits{n} as (select rid, i, coalesce(i - lag(i) over (partition by rid order by i) > {n}, true)::int as new from starts{n} semi join twice{n} using (g)),
 runs{n} as (select rid, run, min(i) as a, max(i) + {n} as b from (select rid, i, sum(new) over (partition by rid order by i) as run from hits{n}) group by 1, 2)"""


ORACLE_SQL: dict[str, str] = {
    "op7_suffix_array_dedup": f"""with texts as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as nb from documents),
 {_runs(400)}, {_runs(200)},
 gaps as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as z from runs400),
 cut as (select rid, count(*) as n_spans, sum(b - a) as n_removed, max(b) as z, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) as kept from gaps join texts using (rid) group by rid),
 shared as (select rid, sum(b - a) as n_shared from runs200 group by rid)
 select doc_id, nb as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  case when n_spans is null then sha256(encode(t)) else sha256(unhex(kept || substr(h, 2 * z + 1))) end as kept_sha256, coalesce(n_shared, 0)::bigint as n_shared
 from texts left join cut using (rid) left join shared using (rid)""",
    "op2_ngram_jaccard_join": """with recursive rows0 as (select row_number() over () as rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 sets as (select rid, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end)) as g from rows0),
 sizes as (select rid, count(*) as n from sets group by 1),
 met as (select a.rid as x, b.rid as y, count(*) as c from sets a join sets b using (g) where a.rid < b.rid group by 1, 2),
 links as (select x, y from met join sizes p on p.rid = x join sizes q on q.rid = y where 100 * c >= 85 * (p.n + q.n - c))"""
    + _CLOSURE.format(id="doc_id")
    + "select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from rows0 join least using (rid) left join sizes using (rid)",
    "op10_binary_codes": """with recursive rows0 as (select row_number() over () as rid, vec_id, embedding::double[] as e from embeddings),
 usable as (select * from rows0 where len(e) > 0 and len(list_filter(e, lambda v: v is not null and isfinite(v))) = len(e) and len(list_filter(e, lambda v: v <> 0)) > 0),
 links as (select a.rid as x, b.rid as y from usable a join usable b on a.rid < b.rid and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95)"""
    + _CLOSURE.format(id="vec_id")
    + """, counts as (select x as rid, count(*) as n from both_ways group by 1)
 select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from rows0 join least using (rid) left join counts using (rid)""",
    # The main text of these pages stands in one `article` of headings and paragraphs; the labeller finds it without being told.
    "op11_block_labeller": """with parts as (select row_number() over () as rid, page_id, url, regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(?:p|h1)>') as parts from pages),
 texts as (select rid, page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(replace(replace(
   regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?$', '&'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: x <> '') as blocks from parts)
 select page_id, url, array_to_string(blocks, chr(10) || chr(10)) as text, length(array_to_string(blocks, chr(10) || chr(10)))::bigint as n_chars from texts""",
    "op12_concurrency_sweep": """with ends as (select sale_id, max(shipped_at) as last from sale_lines group by 1),
 spans as (select coalesce(c.nation_id, -1) as nation_id, floor(epoch_us(sold_at) / 60000000)::bigint * 60 as a, floor(epoch_us(last + interval 7 day) / 60000000)::bigint * 60 as b,
   case when isfinite(total) then floor(100 * total + 0.5)::bigint else 0 end as cents
  from sales s left join ends e on e.sale_id = s.sale_id left join clients c on c.client_id = s.client_id where sold_at is not null),
 live as (select * from spans where b is null or b > a), twice as (select * from live union all select -2, a, b, cents from live),
 steps as (select nation_id, a as s, 1 as n, cents from twice union all select nation_id, b, -1, -cents from twice where b is not null),
 moments as (select nation_id, s, sum(n) as n, sum(cents) as cents from steps group by 1, 2 having sum(n) <> 0 or sum(cents) <> 0),
 rows0 as (select nation_id, s, lead(s) over w as to_s, sum(n) over w as n_open, sum(cents) over w as open_cents from moments window w as (partition by nation_id order by s))
 select nation_id::int as nation_id, s as from_s, to_s, n_open::bigint as n_open, open_cents::bigint as open_cents, max(n_open) over (partition by nation_id order by s)::bigint as high_open,
  n_open = max(n_open) over (partition by nation_id) as is_peak from rows0""",
    "op13_importance_resampling": """with recursive shifts as (select i::bigint as i, i::bigint as r, 0 as k from range(256) t(i) union all
   select i, case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, k + 1 from shifts where k < 8),
 tab as (select list(r order by i) as tab from shifts where k = 8),
 texts as (select row_number() over () as rid, doc_id, text, true as raw from documents union all select row_number() over (), null, text, false from benchmark),
 words as (select rid, doc_id, raw, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
 names as (select w, sum(raw::int) as s, sum((not raw)::int) as t from words group by 1),
 bytes as (select w, s, t, list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda j: ('0x' || substr(hex(encode(w)), 2 * j + 1, 2))::bigint)) as b from names),
 hashed as (select w, s, t, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) % 10000 as bucket from bytes, tab),
 sums as (select bucket, sum(s)::double as s, sum(t)::double as t from hashed group by 1),
 gains as (select bucket, floor(1000 * ln(((t + 1) * (select sum(s) + 10000 from sums)) / ((s + 1) * (select sum(t) + 10000 from sums))))::bigint as gain from sums),
 named as (select w, gain from hashed join gains using (bucket)),
 weighed as (select rid, count(*) as n, sum(gain) as g from words join named using (w) where raw group by 1),
 rows0 as (select rid, doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(g / n), 0)::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
  from texts left join weighed using (rid) where raw),
 scored as (select rid, doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::bigint as score from rows0),
 ranked as (select rid, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_features >= 20)
 select doc_id, n_features, weight, score, case when r <= 10 * n // 100 then r end::bigint as rank from scored left join ranked using (rid)""",
}
