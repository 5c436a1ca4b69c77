"""Check queries of the training-data operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from underwright.llm import bag_minhash, exact_dedup, filter_audit, html_extract, importance, language_id, lz_fingerprint, mixing, quality_net, secret_scan, sentencepiece_codec, sharding, warc
from underwright.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), decoded=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))[0]


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_exact_dedup, op2_html_extract, op3_mix_sources, op4_lz_fingerprint, op5_bag_minhash, op6_sharding, op7_sentencepiece, op8_secret_scan, op9_warc, op10_language_id, op11_quality_net, op12_filter_audit, op13_importance_resample, pipeline)
    return {f.__name__: f for f in named}


#: Base32 of the 160 bits whose hex digits are ``x``: five digits are four characters.
BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(x, 5 * CAST(i // 4 AS INT) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), 'string_agg', '')"""
#: A bit-by-bit step of CRC-32 (reflected polynomial 0xEDB88320), eight of which make an entry of the table by byte.
CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


#: The other operators draw from hashes, are fitted, or parse in ways that SQL can't express; they are tested against brute force.
def all_oracles() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
            FROM d WINDOW g AS (PARTITION BY t)""",
        "op12_filter_audit": r"""
            WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
            flags AS (
                SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
                    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
                    + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS fails
                FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
            k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
            o AS (
                SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, e.k AS e, chr(65 + a.k) || chr(65 + b.k) || chr(65 + c.k) || chr(65 + d.k) || chr(65 + e.k) AS filter_order
                FROM k a, k b, k c, k d, k e WHERE (1 << a.k) + (1 << b.k) + (1 << c.k) + (1 << d.k) + (1 << e.k) = 31 AND len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
            s AS (
                SELECT filter_order, 1 AS step, 1 << a AS own, 0 AS before FROM o UNION ALL SELECT filter_order, 2, 1 << b, 1 << a FROM o
                UNION ALL SELECT filter_order, 3, 1 << c, (1 << a) + (1 << b) FROM o UNION ALL SELECT filter_order, 4, 1 << d, (1 << a) + (1 << b) + (1 << c) FROM o
                UNION ALL SELECT filter_order, 5, 1 << e, 31 - (1 << e) FROM o),
            cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, fails),
            counted AS (
                SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (fails & (own + before) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & own > 0), 0) AS removed,
                    coalesce(sum(n) FILTER (fails & before > 0 AND fails & own > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
                    coalesce(sum(good) FILTER (fails & before = 0 AND fails & own > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & own > 0), 0) AS toxic_lost
                FROM cells, s GROUP BY part, filter_order, step, own)
            SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
                CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
            FROM counted""",
        "op9_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            d AS (SELECT page_id, sha1(h) AS x, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> first THEN first END AS refers_to
            FROM d""",
        "op13_importance_resample": rf"""
            WITH RECURSIVE d AS (
                SELECT doc_id, false AS target, text AS t FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
            w AS (SELECT doc_id, target, regexp_extract_all(translate(coalesce(t, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
            runs AS (SELECT doc_id, target, unnest(list_concat(w, list_concat(
                list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM w),
            f AS (SELECT doc_id, target, f, count(*) AS n FROM runs GROUP BY ALL),
            bits(byte, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT byte, {CRC_STEP}, k + 1 FROM bits WHERE k < 8),
            crc_table AS (SELECT byte, c AS entry FROM bits WHERE k = 8),
            crc(f, x, k, c) AS (
                SELECT f, hex(encode(f)), 0, 4294967295 FROM (SELECT DISTINCT f FROM f)
                UNION ALL SELECT f, x, k + 1, xor(c >> 8, entry) FROM crc JOIN crc_table ON byte = xor(c, CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)) & 255 WHERE 2 * k < length(x)),
            buckets AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * k = length(x)),
            counts AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM f JOIN buckets USING (f) GROUP BY bucket),
            gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts),
            weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN buckets USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id),
            scored AS (
                SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                    (CAST(CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
                FROM w LEFT JOIN weights ON w.doc_id = weights.doc_id WHERE NOT target),
            placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
            SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
                CASE WHEN n_words >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank
            FROM placed""",
    }
