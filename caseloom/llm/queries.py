"""The operators' queries over the whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import align, archive, chat, linededup, mixing, packing, sharding, simhash, toxicity, trie, vectorpack, vectors
from caseloom.llm.shared import fresh_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_shard_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_ann_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


def op5_toxicity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return r.select("doc_id", "held_out", "score", "predicted", "terms", "neighbours")


def op6_topk_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_products(table(spark, sf_dir, "embeddings"))


def op7_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    path = public_tokenizers.path("byte_bpe_50k.json")
    segments, members = chat.prefix_tree(given, path)
    return chat.read_back(segments, members, path)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = archive.write_archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return archive.digest_table(spark, made)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "dropped", "text")


def op9_mix_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorpack.pack_vectors(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = written(align.align(table(spark, sf_dir, "documents"), *paths, ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")), "aligned")
    return align.with_counts(aligned, *paths)


def rebuilt(rows: DataFrame) -> DataFrame:
    """rows (`trie.ordered`) of the conversations that op13's contract makes of them: the first turns of another one, then its own after as many."""
    head = lambda c: F.crc32(c.cast("string")) % 9
    convs = rows.groupBy("conv_id").agg(F.max("depth").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    given = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("given"))
    convs = convs.select("conv_id", base.alias("base")).join(given, "base", "left").select("conv_id", F.least(head(F.col("conv_id")), F.coalesce("given", F.lit(0))).alias("taken"))
    own = rows.where(F.col("depth") > head(F.col("conv_id"))).join(convs, "conv_id")
    own = own.select("conv_id", (F.col("depth") - head(F.col("conv_id")) + F.col("taken")).alias("depth"), "said", "size")
    heads = rows.where((F.col("depth") < 9) & (F.col("conv_id") % 5 == 0)).withColumn("from", F.col("conv_id"))
    heads = heads.withColumn("conv_id", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.col("from") + k)))
    heads = heads.where(base == F.col("from")).join(convs, "conv_id").where(F.col("depth") <= F.col("taken")).select(*own.columns)
    return written(own.unionByName(heads), "rebuilt")


def op13_depth_band_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return trie.prefix_trie(rebuilt(trie.ordered(turns)), turns.select("conv_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack_best_fit,
        op2_shard_label_propagation,
        op3_simhash_golay,
        op4_ann_kmeans_tree,
        op5_toxicity_nearest,
        op6_topk_norm_buckets,
        op7_chat_prefix_tree,
        op8_warc_archive,
        op9_mix_fair_queue,
        op10_line_templates,
        op11_vector_best_fit,
        op12_lockstep_alignment,
        op13_depth_band_trie,
    )
}

ORACLES: dict[str, str] = {
    "op6_topk_norm_buckets": """
        WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score
                   FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_chat_prefix_tree": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(role) + length(text) + 24
                   + len(regexp_extract_all(text, '<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|endoftext\|>')))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op8_warc_archive": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS top FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM q""",
    "op9_mix_fair_queue": """
        WITH d AS (SELECT doc_id, coalesce(source, '') || CASE WHEN source IS NULL THEN 'null' ELSE '' END AS k, source,
                          coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                          md5('9:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
             w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
             c AS (SELECT *, 2 * source_size AS cap, 2 * source_size / w AS r, sum(source_size) OVER () AS total FROM w),
             l AS (SELECT *, (1.5 * total - coalesce(sum(cap) OVER (ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                             / sum(w) OVER (ORDER BY r, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
             t AS (SELECT k, source_size, least(cap::DOUBLE, coalesce(max(level) FILTER (level <= r) OVER () * w, cap::DOUBLE)) AS target FROM l),
             u AS (SELECT row_number() OVER () AS rid, doc_id, k, h, size, sum(size) OVER (PARTITION BY k ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS upto FROM d),
             q AS (SELECT rid, k, h, size, i, (i * source_size + upto) / target AS finish FROM u JOIN t USING (k), (VALUES (0), (1)) v(i) WHERE target > 0),
             z AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, k, h, size, i ROWS UNBOUNDED PRECEDING) AS run FROM q),
             g AS (SELECT rid, sum(size)::BIGINT AS taken FROM z WHERE 2 * run - size <= 3 * (SELECT sum(size) FROM d) GROUP BY rid)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
        FROM u JOIN t USING (k) LEFT JOIN g USING (rid)""",
    "op13_depth_band_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
             o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY conv_id),
             h AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS base,
                          xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                              lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1))))) % 9 AS h FROM o),
             r AS (SELECT h.conv_id, coalesce(list_slice(b.turns, 1, h.h), []) || coalesce(list_slice(h.turns, h.h + 1, len(h.turns)), []) AS turns
                   FROM h LEFT JOIN o b ON b.conv_id = h.base),
             p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
             k AS (SELECT conv_id, n, depth, list_slice(turns, 1, depth) AS prefix, list_slice(turns, 1, depth - 1) AS above,
                          CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].text)) ELSE 0 END AS size FROM p),
             d AS (SELECT depth, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
                   FROM k GROUP BY depth, prefix),
             c AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM d WHERE depth > 0 GROUP BY ALL),
             e AS (SELECT d.*, coalesce(n_children, 0) AS n_children FROM d LEFT JOIN c USING (depth, prefix)),
             u AS (SELECT e.depth, e.prefix, e.n_children, e.saved, unnest(range(e.depth + 1)) AS up FROM e),
             s AS (SELECT up AS depth, list_slice(prefix, 1, up) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
        SELECT e.conv_id, e.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
        FROM e JOIN s USING (depth, prefix) LEFT JOIN d a ON a.depth = e.depth - 1 AND a.prefix = e.above""",
}
