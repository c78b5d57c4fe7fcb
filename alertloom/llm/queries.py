"""Queries of the corpus operators over the test tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from itertools import permutations
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import audit, exact, language, lines, lm, mixing, packing, quality, simhash, sketch, substring, warc, whiten
from alertloom.llm.common import with_package
from alertloom.session import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages"), "2026-01-01T00:00:00Z"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def reference_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that documents share with the benchmark, by broadcast suffix automata."""
    return substring.spans_in_reference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=13)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, probabilities, copies and the draw for every document."""
    return mixing.mixing_table(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: its text, and what the page that shows it declares.

    The number in a page's address is the document it shows; of several pages the one with the
    smallest id counts. Documents without a page have their ``lang`` declared and their source for a host.
    """
    docs, languages = _table(spark, sf_dir, "documents"), ("en", "de", "fr", "es")
    table = language.train(docs, languages)
    texts = language.scored(docs, table).drop("text", "n_chars")
    pages = _table(spark, sf_dir, "pages").select(
        F.expr(r"try_cast(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1) AS long)").alias("doc_id"), "page_id", "url",
        F.regexp_extract(F.regexp_extract("html", r"(?i)<html[^>]*>", 0), r"(?i)\blang\s*=\s*[\"']?([a-z-]+)", 1).alias("declared"))
    pages = pages.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("url", "declared"), "page_id").alias("page"))
    rows = stored(texts.join(pages, "doc_id", "left"))
    host = F.coalesce(F.regexp_extract("page.url", r"^[a-z]+://([^/:?#]+)", 1), F.col("source"))
    found = language.fuse(rows, languages, F.coalesce(F.nullif(F.col("page.declared"), F.lit("")), F.col("lang")), F.col("page.url"), host)
    return found.select("doc_id", "language", "posterior", "text_language", "accepted", F.col("page.url").alias("url"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, read by the driver and sent to the executors."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer_json())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edit_trial(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(_table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_frequent_lines(_table(spark, sf_dir, "documents")).drop("kept_text")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _audit_sql() -> str:
    """The twin of op13_filter_audit: rows by the set of filters they fail, against every step of every order."""
    steps = [(order, k + 1, 1 << "ABCDE".index(f), sum(1 << "ABCDE".index(x) for x in order[:k]))
             for order in map("".join, permutations("ABCDE")) for k, f in enumerate(order)]
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS ws,
                     doc_id > min(doc_id) OVER (PARTITION BY t) AS later FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
              FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
                     + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(later, false)::INT AS fails
              FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
        s (filter_order, step, own, earlier) AS (VALUES {", ".join(map(str, steps))}),
        r AS (SELECT part, filter_order, step, own,
                     sum(CASE WHEN fails & (own | earlier) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN fails & own > 0 AND fails & earlier > 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM c CROSS JOIN s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


def _warc_sql() -> str:
    """The twin of op1_warc; the names of references and the lists of tags are the operator's."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    names = f"MAP {{{', '.join(f'{quoted(n)}: {quoted(c)}' for n, c in warc.NAMES.items())}}}"
    meant = f"MAP {{{', '.join(f'{n}: {quoted(c)}' for n, c in warc.NUMBERED.items())}}}"
    inside, attributes = quoted(warc.INSIDE_RE2)[1:-1], quoted(warc.ATTRIBUTE)

    def char_references(text: str, in_attribute: bool = False) -> str:
        """Distinct references with what they stand for, put between the pieces."""
        body = "CASE WHEN ends_with(x, '=') THEN x[:-2] ELSE x END"
        bare = f"regexp_extract({body}, '^&({'|'.join(warc.BARE)})')"
        named = f"named[{body}]"
        named = f"coalesce({named}, {body})" if in_attribute else \
            f"coalesce({named}, CASE WHEN {bare} <> '' THEN named[{bare}] || substr({body}, length({bare}) + 1) END, {body})"
        named = f"{named} || CASE WHEN ends_with(x, '=') THEN '=' ELSE '' END"
        if in_attribute:
            named = f"CASE WHEN ends_with(x, '=') THEN x ELSE {named} END"
        digits = "ltrim(regexp_extract(x, '([0-9a-fA-F]+);?$', 1), '0')"
        number = (f"CASE WHEN length({digits}) NOT BETWEEN 1 AND 7 THEN 0 WHEN lower(x[3]) = 'x' THEN CAST('0x' || {digits} AS INTEGER) "
                  f"ELSE CAST({digits} AS INTEGER) END")
        plain = f"chr(CASE WHEN {number} BETWEEN 1 AND 1114111 AND {number} NOT BETWEEN 55296 AND 57343 THEN {number} ELSE 65533 END)"
        read = f"CASE WHEN starts_with(x, '&#') THEN coalesce(meant[{number}], {plain}) ELSE {named} END"
        found = f"regexp_extract_all({text}, '{warc.REFERENCE}')"
        pieces = f"string_split_regex({text}, '{warc.REFERENCE}')"
        return (f"CASE WHEN contains({text}, '&') THEN array_to_string(list_transform(list_zip({pieces}, list_transform({found}, lambda x: {read})), "
                f"lambda z: z[1] || coalesce(z[2], '')), '') ELSE {text} END")

    def attribute(tag: str, name: str) -> str:
        at = f"list_position(list_transform(regexp_extract_all({tag}, {attributes}, 1), lambda n: lower(n)), '{name}')"
        value = f"regexp_extract_all({tag}, {attributes}, 2)[{at}]"
        return f"regexp_replace({value}, '^(\"(.*)\"|''(.*)'')$', '\\2\\3', 's')"

    bare = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for name in warc.UNREAD:
        bare = rf"regexp_replace({bare}, '(?is)<{name}\b{inside}.*?</{name}\s*>', ' ', 'g')"
    return rf"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
        t AS (SELECT *, {bare} AS bare, regexp_extract(html, '(?is)<title\b{inside}(.*?)</title\s*>', 1) AS title,
                     list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s{inside}'), lambda tag: {attribute("tag", "href")}), lambda l: l IS NOT NULL) AS links,
                     coalesce({attribute("regexp_extract(html, '(?i)<html(?:[ >]|" + chr(92) + "s)" + inside + "')", "lang")}, '') AS lang FROM p),
        s AS (SELECT *, {names} AS named, {meant} AS meant, regexp_replace(regexp_replace(regexp_replace(bare, '[\x09-\x0D ]+', ' ', 'g'),
                     '(?i)</?({warc.BREAKS})\b{inside}', chr(10), 'g'), '<[a-zA-Z/!?]{inside}', '', 'g') AS flat FROM t),
        u AS (SELECT *, {char_references("flat")} AS read, {char_references("title")} AS heading,
                     list_transform(links, lambda l: 'outlink: ' || {char_references("l", True)} || chr(13) || chr(10)) AS outlinks FROM s),
        v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(read, '[ \x09\x0B-\x0D]+', ' ', 'g'),
                     ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text,
                     md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || url || '|' || md5(html)) AS h FROM u),
        r AS (SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS id FROM v),
        m AS (SELECT *, md5('metadata|' || id) AS hm, md5('conversion|' || id) AS hc FROM r),
        k AS (SELECT *, '<urn:uuid:' || hm[1:8] || '-' || hm[9:12] || '-' || hm[13:16] || '-' || hm[17:20] || '-' || hm[21:32] || '>' AS im,
                     '<urn:uuid:' || hc[1:8] || '-' || hc[9:12] || '-' || hc[13:16] || '-' || hc[17:20] || '-' || hc[21:32] || '>' AS ic,
                     chr(13) || chr(10) AS nl FROM m),
        d AS (SELECT *, 'metadata' AS record_type, im AS record_id, ic AS concurrent_to, 'application/warc-fields' AS content_type,
                     'title: ' || trim(regexp_replace(heading, '[\x09-\x0D ]+', ' ', 'g')) || nl || 'language: ' ||
                     lang || nl ||
                     'links: ' || len(links) || nl || 'characters: ' || length(text) || nl || array_to_string(outlinks, '') AS block FROM k
              UNION ALL BY NAME
              SELECT *, 'conversion' AS record_type, ic AS record_id, im AS concurrent_to, 'text/plain; charset=UTF-8' AS content_type,
                     text AS block FROM k)
        SELECT page_id, record_type, record_id, id AS refers_to, concurrent_to, url AS target_uri,
               '2026-01-01T00:00:00Z' AS warc_date, content_type, strlen(block) AS content_length,
               'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(html) AS source_digest,
               'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' ||
               strlen(html) || nl AS source_headers, block
        FROM d"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_lm_scores": op8_lm_scores,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_whitening": op11_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_filter_audit": op13_filter_audit,
    "reference_spans": reference_spans,
}

ORACLES = {
    "op1_warc": _warc_sql(),
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
        SELECT doc_id,
               first(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY bare) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(bare) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id)""",
    "op12_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        k AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
        m AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM k),
        f AS (SELECT key FROM m WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM m LEFT JOIN f USING (key) GROUP BY doc_id""",
    "op13_filter_audit": _audit_sql(),
}
