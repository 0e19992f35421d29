"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontam, licenses, mixing, neardup, packing, phrases, quality, spelling, suffix_dedup, token_counts, token_ids, warc


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers package; their folder can be given as SPARKLOOM_TOKENIZERS."""
    if folder := os.environ.get("SPARKLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.drop("digest")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.masked_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.drop("text", "leaf_ends", "leaf_tokens")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("digest")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("file", "offset")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.formatted_report(turns.unionByName(chat.control_conversation(spark)), tokenizer_path())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_ids, op2_decontamination, op3_token_counts, op4_quality_rules, op5_suffix_dedup)
    found += (op6_warc, op7_chat_windows, op8_license_scan, op9_mixing, op10_near_duplicates, op11_phrases, op12_packing, op13_spelling_variants)
    return {f.__name__: f for f in found}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
    WITH items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
    docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    spans AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
    hits AS (SELECT r, i, spans.n, item_id FROM spans JOIN wins ON spans.win = wins.win AND spans.n = wins.n),
    words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
    found AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

OP4 = r"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs))),
    rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY r),
    lines AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
    base AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM docs LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR word_chars < 2 * n_words OR (word_chars > 20 * n_words AND 2 * (length(t) - length(regexp_replace(t, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]', '', 'g'))) <= word_chars) OR 10 * n_symbols > 3 * n_words
      OR 100 * n_dup_lines > 60 * (length(t) - length(replace(t, chr(10), '')) + 1) OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars) AS kept FROM judged
"""

OP6 = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""


def _op8() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table, entries = licenses.index(licenses.TEMPLATES, 80)
    known = ", ".join(f"({t}, {quote(name)}, {n}, [{', '.join(map(quote, gs))}])" for t, name, n, gs in table)
    first = ", ".join(f"({quote(g)}, {t}, {o})" for g, t, o in entries)
    return rf"""
    WITH known(t, license, n, grams) AS (VALUES {known}),
    first(g, t, o) AS (VALUES {first}),
    docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
    pairs AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM docs)),
    wins AS (SELECT DISTINCT r, t, greatest(i - 1 - o, 0) AS a, i - 1 - o AS raw FROM pairs JOIN first USING (g)),
    cuts AS (SELECT r, license, grams, a, w[a + 1:least(raw + n, len(w))] AS x FROM wins JOIN docs USING (r) JOIN known USING (t)),
    hits AS (SELECT r, license, grams, a, len(x) AS m, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS g FROM cuts),
    dices AS (SELECT r, license, a, m, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM hits),
    best AS (SELECT r, license, a, max(row(dice, m)) AS x FROM dices WHERE dice * 100 >= 80 GROUP BY ALL),
    found AS (SELECT r, license, a, x[2] AS m, x[1] AS dice FROM best),
    left_ AS (SELECT * FROM found m WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.r = m.r AND o.a < m.a + m.m AND m.a < o.a + o.m AND row(-o.dice, -o.m, o.license, o.a) < row(-m.dice, -m.m, m.license, m.a))),
    per AS (SELECT r, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice FROM left_ GROUP BY r)
    SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(best_dice, 0.0) AS best_dice FROM docs LEFT JOIN per USING (r)
    """


OP10 = rf"""
    WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 75 * (s.n + t.n - shared)),
    edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(v) AS component_id, min(v) = d.doc_id AS kept FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id, n
"""

OP11 = rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {LOWER} AS t FROM documents),
    pieces AS (SELECT lang, r, row_number() OVER () AS p, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, r, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM docs)),
    grams AS (SELECT lang, list_slice(w, i, i + m - 1) AS g, m FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
    f AS (SELECT lang, g, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    kept AS (SELECT * FROM f c WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.a >= 100 * c.a
      AND contains(' ' || array_to_string(o.g, ' ') || ' ', ' ' || array_to_string(c.g, ' ') || ' '))),
    cuts AS (SELECT c.*, k, x.a AS l, y.a AS r, n, (1000 * c.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) c
      JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang),
    low AS (SELECT lang, g, a, n, min(row(score, k, l, r)) AS s FROM cuts GROUP BY ALL),
    ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, s[3] AS l, s[4] AS r, n, s[1]::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY s[1] DESC, a DESC, array_to_string(g, ' ')) AS rank FROM low)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose whole result it can express; the others are held against brute force in tests/llm."""
    return {"op2_decontamination": OP2, "op4_quality_rules": OP4, "op6_warc": OP6, "op8_license_scan": _op8(), "op10_near_duplicates": OP10, "op11_phrases": OP11}
