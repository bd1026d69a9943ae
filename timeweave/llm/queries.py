"""The corpus operators as registered queries: thin functions of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timeweave.llm import cdc, conversations, decontam, divergence, minhash, mixing, ordinal, ppm_lang, secrets, simhash, token_pages, token_rollup, warc
from timeweave.llm.common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = token_rollup.Rollup(spark, shared_dir(spark, "rollup"))
    token_rollup.corpus_history(table(spark, sf_dir, "documents"), rollup)
    return rollup.totals()


def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_chunks(spark, path)).drop("n_chunks")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeats(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_shares(mixing.mix_plan(table(spark, sf_dir, "documents")))


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_lang.identify(table(spark, sf_dir, "documents"))


def op11_token_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_pages.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_pages.read_digests(spark, path)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_rollup": op2_token_rollup,
    "op3_warc_records": op3_warc_records,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash": op6_simhash,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_quality": op8_quality,
    "op9_source_mix": op9_source_mix,
    "op10_ppm_language": op10_ppm_language,
    "op11_token_pages": op11_token_pages,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_token_rollup": r"""
        WITH kept AS (
            SELECT source, lang, replace(text, '|', '') AS text
            FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)
            WHERE doc_id = first OR text IS NULL
        )
        SELECT source, lang, 'words-v1' AS tokenizer, count(*) AS n_docs,
            CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
        FROM kept GROUP BY source, lang
        UNION ALL
        SELECT source, lang, 'pieces-v2' AS tokenizer, count(*) AS n_docs,
            CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]'))) AS BIGINT) AS n_tokens
        FROM kept GROUP BY source, lang
    """,
    "op3_warc_records": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (
            SELECT page_id, h, strlen(h) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first FROM p
        )
        SELECT page_id, payload_bytes, sha256(h) AS payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to,
            true AS intact
        FROM d
    """,
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
                ) AS terms
            FROM documents
        ),
        t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        volume AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        own AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
        whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(own.n, 0) + v) AS p
            FROM g JOIN kept k USING (lang) JOIN volume USING (lang)
            LEFT JOIN own USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS q FROM whole JOIN volume USING (lang)),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source
            GROUP BY a.lang, a.source, b.source
        ),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value
            FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
        ),
        ranked AS (
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM every
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, coalesce(CAST(turn AS VARCHAR), ' ') AS number
            FROM conversations
        ),
        hashed AS (
            SELECT *, xor(4294967295, list_reduce(
                list_transform(range(1, length(conv || ':' || number) + 1), lambda i: CAST(ascii((conv || ':' || number)[i]) AS BIGINT)),
                lambda c, b: list_reduce(
                    list_concat([xor(c, b)], range(0, 8)),
                    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
                ),
                4294967295
            )) % 20 AS kind
            FROM given
        ),
        damaged AS (
            SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed
        ),
        placed AS (
            SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS time,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged
        ),
        faults AS (
            SELECT conv, turn, role, text, pos, left(role, 1) AS initial,
                CASE WHEN bare = '' THEN 'blank' WHEN time > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ),
        -- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; perhaps an insertion first
        before_row(s, ins, price, m) AS (VALUES
            (0, '', 0, 0), (0, 'I', 2, 2), (1, '', 0, 1), (1, 'I', 2, 2), (2, '', 0, 2), (2, 'I', 2, 3), (3, '', 0, 3), (3, 'I', 2, 2)),
        edit(e, price) AS (VALUES ('K', 0), ('R', 2), ('D', 3)),
        walk(conv, pos, s, best) AS (
            SELECT DISTINCT conv, CAST(0 AS BIGINT), 0, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM hashed
            UNION ALL
            SELECT conv, pos, s, min(best) FROM (
                SELECT f.conv, f.pos,
                    CASE WHEN e = 'D' THEN m WHEN e = 'K' AND initial = 's' THEN 1 WHEN m = 2 THEN 3 ELSE 2 END AS s,
                    {
                        'cost': best.cost + b.price + edit.price + CASE WHEN e != 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
                        'audit': best.audit || ins || e,
                        'lines': list_concat(list_concat(
                            best.lines, CASE WHEN ins = '' THEN [] WHEN m = 2 THEN ['user:'] ELSE ['assistant:'] END),
                            CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                            ELSE [CASE WHEN m = 2 THEN 'assistant:' ELSE 'user:' END || text] END)
                    } AS best
                FROM walk w JOIN faults f ON f.conv = w.conv AND f.pos = w.pos + 1 JOIN before_row b ON b.s = w.s CROSS JOIN edit
                WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R'
                    OR (initial = 's' AND m = 0) OR (initial = 'u' AND m != 2) OR (initial = 'a' AND m = 2)))
            ) GROUP BY conv, pos, s
        ),
        sizes AS (SELECT conv, count(*) AS n FROM faults GROUP BY conv),
        tails(s, tail, price, more) AS (VALUES
            (0, '', 0, CAST([] AS VARCHAR[])), (1, 'II', 4, ['user:', 'assistant:']), (2, 'I', 2, ['assistant:']), (3, '', 0, CAST([] AS VARCHAR[]))),
        done AS (
            SELECT conv, min({'cost': best.cost + price, 'audit': best.audit || tail, 'lines': list_concat(best.lines, more)}) AS best
            FROM walk JOIN tails USING (s) LEFT JOIN sizes USING (conv) WHERE pos = coalesce(n, 0) GROUP BY conv
        ),
        stats AS (
            SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY pos) AS before FROM faults) GROUP BY conv
        )
        SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
            sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, conv FROM hashed) JOIN done USING (conv) LEFT JOIN stats USING (conv)
    """,
}
