"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, html_text, mixing, packing, quality, secrets, sharding, simhash, substrings, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.table_of(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.table_of(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_substrings": op4_substrings,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_sharding": op9_sharding,
    "op10_secrets": op10_secrets,
}

#: The default lookup table as text, a letter for each slot: the shard's number from "0" on.
_OWNERS = "".join(chr(48 + s) for s in sharding.lookup_table([f"shard-{i:03d}" for i in range(sharding.SHARDS)]).tolist())

ORACLES: dict[str, str] = {
    "op4_substrings": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT r, place, k, substr(h, 2 * k + 1, 2 * (1000 + 49)) AS part FROM (SELECT *, unnest(range(0, length(h) // 2, 1000)) AS k FROM d)),
        w AS (SELECT r, place, k + p AS p, substr(part, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1000, length(part) // 2 - 49))) AS p FROM c WHERE length(part) >= 100)),
        m AS (SELECT s, min(place) AS least FROM w GROUP BY s HAVING count(*) > 1),
        g AS (SELECT DISTINCT r, p FROM w JOIN m USING (s) WHERE least < place),
        e AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 50, true) AS fresh FROM g),
        f AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS span FROM e),
        x AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM f GROUP BY r, span),
        y AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM x),
        z AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS reached, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM y JOIN d USING (r) GROUP BY r)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept || substr(h, 2 * reached + 1), h))) AS kept_sha256
        FROM d LEFT JOIN z USING (r)""",
    "op9_sharding": rf"""
        WITH t AS (SELECT '{_OWNERS}' AS owners),
        s AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad((ascii(substr(owners, slot + 1, 1)) - 48)::VARCHAR, 3, '0') AS shard FROM s, t""",
    "op2_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
        p AS (SELECT row, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
        g AS (SELECT p.row, p.i, count(*) OVER (PARTITION BY p.row, array_to_string(words[p.i:p.i + 4], ' ')) AS n FROM p JOIN w USING (row)),
        r AS (SELECT row, count(DISTINCT k) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + 5)) AS k FROM g WHERE n > 1) GROUP BY row),
        s AS (SELECT row, doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN r USING (row)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS symbols,
                     100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft FROM s),
        h AS (SELECT source, count(*) AS n, sum((base_failed OR symbols OR soft)::INT)::BIGINT AS k FROM f GROUP BY source),
        m AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS n, count(*) AS hosts, sum(k * k / n) AS sq FROM h),
        b AS (SELECT mean, mean * (1 - mean) AS chance, sq / n - mean * mean - mean * (1 - mean) * hosts / n AS spread FROM m),
        a AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(chance / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM b),
        v AS (SELECT source, (k + mean * weight) / (n + weight) AS host_rate FROM h, a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
               round(host_rate, 6) AS host_rate,
               NOT (base_failed OR symbols OR host_rate >= 0.9 OR (host_rate >= 0.35 AND soft)) AS kept
        FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][(r - 1) % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
        l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                     sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
        f AS (SELECT *, cap <= (budget - caps) / rest * w AS capped FROM l),
        v AS (SELECT (any_value(budget) - coalesce(sum(cap) FILTER (WHERE capped), 0)) / sum(w) FILTER (WHERE NOT capped) AS level FROM f),
        t AS (SELECT source, r, source_size, budget, CASE WHEN capped THEN cap ELSE level * w END AS target FROM f, v),
        c AS (SELECT d.*, t.r, t.source_size, t.budget, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS UNBOUNDED PRECEDING) AS c
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT doc_id, o, size, r, budget, c / target AS finish, 1 AS k FROM c WHERE size > 0 AND target > 0
              UNION ALL SELECT doc_id, o, size, r, budget, (source_size + c) / target, 2 FROM c WHERE size > 0 AND target > source_size),
        q AS (SELECT *, sum(size) OVER (ORDER BY finish, r, k, o ROWS UNBOUNDED PRECEDING) <= budget AS fits FROM e),
        n AS (SELECT o, k, any_value(size) AS size FROM q WHERE fits GROUP BY o, k),
        x AS (SELECT o, sum(size)::BIGINT AS taken FROM n GROUP BY o)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM c LEFT JOIN x USING (o)""",
}
