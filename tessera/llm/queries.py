"""The queries over whole tables, with the digest columns that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, collocations, conversations, language, media, ngram_join, packing, pii, quality, sharding, token_counts, token_ids, vptree
from tessera.llm.common import table
from tessera.llm.vocab import BYTE_BPE, WORD_BPE, load_tokenizer, tokenizer_path

END_ID = 1


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(WORD_BPE)
    files, ranked = token_ids.write_token_files(table(spark, sf_dir, "documents"), path, END_ID, load_tokenizer(path).get_vocab_size())
    return token_ids.read_token_files(files, ranked).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.stored_media(table(spark, sf_dir, "documents")))
    tail = F.substring("payload", -32, 32)
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("png").cast("long").alias("media_bytes"), F.sha2("png", 256).alias("media_sha256"), "feature")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    sharded = sharding.shard_rows(sized, "doc_id", [1.0] * 40, 1.0).withColumn("law", F.lit("key"))
    return sharding.number_slots(sharded, ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_BPE)
    decoded = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), END_ID)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [F.size(F.filter(F.transform("base_spans", lambda s: s["kind"]), pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(pii.shown(F.col("base_spans")), "utf-8"), 256).alias("base_sha256"), pii.shown(F.col("spans")).alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(token_counts.PIECE_MODEL))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_label(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_ids, op2_media, op3_sharding, op4_quality, op5_bpe, op6_packing, op7_ngram_join, op8_pii, op9_token_counts, op10_nearest, op11_language, op12_collocations, op13_conversations)}

ORACLE_SQL: dict[str, str] = {
    "op7_ngram_join": """
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM w),
    n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
    i AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
    r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
    SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, min(y) component_id FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY ALL""",
    "op12_collocations": """
    WITH p AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') w FROM
      (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece FROM documents)),
    total AS (SELECT lang, sum(len(w))::BIGINT n FROM p GROUP BY 1),
    g AS MATERIALIZED (SELECT lang, w[i:i + k - 1] ph, k, count(*) f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM p, range(1, 6) t(k)) GROUP BY ALL HAVING count(*) >= 100),
    cut AS (SELECT lang, ph, c.f a, n, j, x.f l, y.f r, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) score
      FROM (SELECT *, unnest(range(1, k)) j FROM g WHERE k > 1) c JOIN total USING (lang) JOIN (SELECT lang, ph lp, f FROM g) x USING (lang) JOIN (SELECT lang, ph rp, f FROM g) y USING (lang) WHERE lp = ph[:j] AND rp = ph[j + 1:]),
    best AS (SELECT lang, ph, any_value(a) a, any_value(n) n, min({'score': score, 'j': j, 'l': l, 'r': r}) m FROM cut GROUP BY 1, 2),
    inside AS (SELECT lang, ph[i:i + m - 1] ph, max(f) longer FROM (SELECT *, unnest(range(1, k - m + 2)) i FROM (SELECT *, unnest(range(2, k)) m FROM g)) GROUP BY 1, 2)
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') phrase, a, m.l l, m.r r, n, m.score::BIGINT score
      FROM best LEFT JOIN inside USING (lang, ph) WHERE longer IS NULL OR 100 * longer < 100 * a) WHERE rank <= 2000""",
}
