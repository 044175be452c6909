"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import table


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    from platewise.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), rank_file())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every document."""
    from platewise.llm.exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    from platewise.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of three-word Jaccard 0.9 or more."""
    from platewise.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of every document."""
    from platewise.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), digest_only=True)


OP7_SQL = r"""
WITH lines AS (
    SELECT doc_id, i, line, lower_ascii AS key
    FROM (
        SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM (
            SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS parts FROM documents)
        )
    )
), dropped AS (
    SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT l.doc_id, l.i, l.line, d.key IS NOT NULL AND l.doc_id <> d.top AS gone
    FROM lines l LEFT JOIN dropped d USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the bigram model of those that are not held out."""
    from platewise.llm.lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the archive records of all pages, resolved."""
    from platewise.llm.warc import header_text, records_of_pages, resolve_revisits

    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    return out.select("record_id", "canonical_url", F.coalesce("refers_to", F.lit(-1)).alias("refers_to"), "outcome", header_text(F.col("headers")).alias("headers"))


OP2_SQL = r"""
WITH bare AS (
    SELECT CAST(page_id AS BIGINT) AS page, coalesce(html, '') AS html,
           regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u
    FROM pages
), canon AS (
    SELECT page, html, u, list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))) AS q
    FROM bare
), records AS (
    SELECT page, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (page % 365) AS day,
           regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '')
           || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/$', '')
           || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url
    FROM canon
), visits AS (
    SELECT page * 2 + 1 AS record_id, canonical_url, page * 600 + 216000 AS ts,
           CASE WHEN page % 7 = 0 THEN NULL WHEN page % 11 = 0 THEN '"new"' ELSE 'W/' || tag END AS etag,
           CASE WHEN page % 7 = 0 THEN day END AS modified, CAST(page * 600 + 216000 AS VARCHAR) AS seen
    FROM records
), full_ones AS (
    SELECT page * 2 AS record_id, canonical_url, page * 600 AS ts, tag, day, CAST(page * 600 AS VARCHAR) AS seen FROM records
), matched AS (
    SELECT v.*, (SELECT max(struct_pack(ts := f.ts, record_id := f.record_id)) FROM full_ones f
                 WHERE f.canonical_url = v.canonical_url AND (f.ts < v.ts OR (f.ts = v.ts AND f.record_id < v.record_id))) AS best
    FROM visits v
), decided AS (
    SELECT m.*, f.tag AS f_tag, f.day AS f_day, f.seen AS f_seen,
           CASE WHEN best IS NULL THEN 'orphan'
                WHEN etag IS NOT NULL AND regexp_replace(etag, '^W/', '') = f.tag THEN 'resolved'
                WHEN etag IS NULL AND modified = f.day THEN 'resolved' ELSE 'changed' END AS outcome
    FROM matched m LEFT JOIN full_ones f ON f.record_id = m.best.record_id
)
SELECT record_id, canonical_url, CASE WHEN outcome = 'resolved' THEN best.record_id ELSE -1 END AS refers_to, outcome,
       CASE WHEN outcome = 'resolved'
            THEN 'content-type: text/html' || chr(10) || 'date: ' || seen || chr(10) || 'etag: ' || coalesce(etag, f_tag) || chr(10) || 'last-modified: ' || coalesce(modified, f_day)
            ELSE 'content-type: text/plain' || chr(10) || 'date: ' || seen
                 || CASE WHEN etag IS NOT NULL THEN chr(10) || 'etag: ' || etag ELSE '' END
                 || CASE WHEN modified IS NOT NULL THEN chr(10) || 'last-modified: ' || modified ELSE '' END END AS headers
FROM decided
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a script of edits."""
    from platewise.llm.token_counts import edited_counts, scripted_edits

    return edited_counts(scripted_edits(table(spark, sf_dir, "documents")), rank_file())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds a copy of."""
    from platewise.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from platewise.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation after the contract's damage."""
    from platewise.llm.conversations import damage, repair_report

    rows = table(spark, sf_dir, "conversations")
    return repair_report(damage(rows), rows)


OP11_SQL = r"""
WITH RECURSIVE t AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), crc_table AS (
    SELECT list(c ORDER BY i) AS tb FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), hits AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                           lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
    FROM t, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hits, range(2) c(n) WHERE hit <> 0 AND (n = 0 OR hit = 3)
), placed AS (
    SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS solid, left(role, 1) AS ini,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged
), f AS (
    SELECT *, CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                   WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
           lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS two
    FROM placed
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
           count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id
), ins(p, q, k, said) AS (
    VALUES (0, 0, 0, []), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, []), (1, 2, 1, ['user:']),
           (1, 3, 2, ['user:', 'assistant:']), (2, 2, 0, []), (2, 3, 1, ['assistant:']), (3, 3, 0, []), (3, 2, 1, ['user:'])
), edits(q, letter, ini, r, role, price) AS (
    VALUES (0, 'K', 's', 1, NULL, 0), (0, 'K', 'u', 2, NULL, 0), (1, 'K', 'u', 2, NULL, 0), (2, 'K', 'a', 3, NULL, 0), (3, 'K', 'u', 2, NULL, 0),
           (0, 'R', NULL, 2, 'user', 2), (1, 'R', NULL, 2, 'user', 2), (2, 'R', NULL, 3, 'assistant', 2), (3, 'R', NULL, 2, 'user', 2),
           (0, 'D', NULL, 0, NULL, 3), (1, 'D', NULL, 1, NULL, 3), (2, 'D', NULL, 2, NULL, 3), (3, 'D', NULL, 3, NULL, 3)
), chart AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM counts
    UNION ALL
    SELECT * FROM (
        SELECT c.conv_id, f.pos, e.r AS state, c.cost + 2 * i.k + e.price + CASE WHEN e.letter <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END AS cost,
               c.audit || repeat('I', i.k) || e.letter AS audit,
               list_concat(list_concat(c.said, i.said), CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END) AS said
        FROM chart c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.pos = c.pos + 1 JOIN ins i ON i.p = c.state JOIN edits e ON e.q = i.q
        WHERE e.letter = 'D' OR (f.fault NOT IN ('b', 'd') AND (e.letter = 'R' OR e.ini = f.ini))
    ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), best AS (
    SELECT n.conv_id, c.cost + 2 * i.k AS cost, c.audit || repeat('I', i.k) AS audit, list_concat(c.said, i.said) AS said
    FROM counts n JOIN chart c ON c.conv_id IS NOT DISTINCT FROM n.conv_id AND c.pos = n.n JOIN ins i ON i.p = c.state AND i.q IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY n.conv_id ORDER BY c.cost + 2 * i.k, c.audit || repeat('I', i.k)) = 1
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def merge_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document, equal chunks encoded once."""
    from platewise.llm.chunk_reuse import round_trip

    return round_trip(table(spark, sf_dir, "documents"), merge_file())


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document, with corpus-wide counts of linked ids."""
    from platewise.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), merge_file(), piece_file())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_warc_revisits": op2_warc_revisits,
        "op3_token_counts": op3_token_counts,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language_id": op5_language_id,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_line_dedup": op7_line_dedup,
        "op8_lm_score": op8_lm_score,
        "op9_decontamination": op9_decontamination,
        "op10_html_text": op10_html_text,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_chunk_reuse": op12_chunk_reuse,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_conversation_repair": OP11_SQL}
