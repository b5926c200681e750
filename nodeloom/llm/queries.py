"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import _shared
from nodeloom.llm.quality_rules import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.html_extract import extract_pages, train

    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, train(pages))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.mixing import copies_of

    return copies_of(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from nodeloom.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.warc import index_of, read_warc, write_warc

    path = _shared.scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    found = index_of(read_warc(spark, path, payloads=False))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")  # noqa: E731  after "urn:page:"
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.merkle import merkle_manifest

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle_manifest(table(spark, sf_dir, "documents"), altered={"n_chars": F.col("n_chars") + 1}, where=tampered)
    return found.drop("way")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.lexical_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nodeloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("broken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_embedding_dedup, op3_ngram_join, op4_license_scan, op5_exact_dedup, op6_language_id, op7_html_extract, op8_source_mixing, op9_bpe, op10_warc, op11_merkle_manifest, op12_lexical_search, op13_quality_rules)}


#: Of the SQL: the field of a leaf, and the CRC-32 of a string of decimal digits (bits shifted out one by one).
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

SQL = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
tops AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN tops ON vec_id = tops.x LEFT JOIN counts ON vec_id = counts.x""",
    "op5_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_NORM} AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM n JOIN g USING (x)""",
    "op8_source_mixing": r"""
WITH base AS (
  SELECT doc_id AS i, source AS s, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY s),
weighed AS (
  SELECT s, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY s IS NULL, s) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, s IS NULL, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, s IS NULL, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goal AS (
  SELECT s, source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM levels WHERE level * w <= cap)) AS target FROM levels),
ranked AS (
  SELECT base.*, g.source_size, g.target, row_number() OVER (PARTITION BY base.s ORDER BY size, i) AS pos,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('mix|' || coalesce(base.s, chr(0))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM base JOIN goal g ON base.s IS NOT DISTINCT FROM g.s)
SELECT i AS doc_id, size, source_size, target, CAST((floor(rate * pos + u) - floor(rate * (pos - 1) + u)) * size AS BIGINT) AS taken FROM ranked""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS altered FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(t, level, idx, n, h) AS (
  SELECT t, 0, idx, n, leaf FROM placed
  UNION ALL SELECT t, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY t, level, idx // 2, n),
subs AS (SELECT t, level AS depth, h AS subroot FROM nodes WHERE n = 1),
tops(level, idx, n, h) AS (
  SELECT 0, t, (SELECT count(*) FROM subs), subroot FROM subs
  UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
walk(d, t, idx, level, up, own, changed, proof) AS (
  SELECT row_number() OVER () , t, idx, 0, false, leaf, altered, '' FROM placed
  UNION ALL
  SELECT w.d, w.t, CASE WHEN leaves_tree THEN w.t ELSE w.idx // 2 END, CASE WHEN leaves_tree THEN 0 ELSE w.level + 1 END, w.up OR leaves_tree,
    CASE WHEN leaves_tree THEN own WHEN h IS NULL THEN sha256(own) WHEN w.idx % 2 = 0 THEN sha256(own || h) ELSE sha256(h || own) END,
    CASE WHEN leaves_tree THEN changed WHEN h IS NULL THEN sha256(changed) WHEN w.idx % 2 = 0 THEN sha256(changed || h) ELSE sha256(h || changed) END,
    proof || CASE WHEN leaves_tree THEN '' ELSE coalesce(h, '') END
  FROM (
    SELECT w.*, NOT w.up AND w.level = (SELECT depth FROM subs WHERE subs.t = w.t) AS leaves_tree, x.h
    FROM walk w LEFT JOIN (SELECT false AS up, t, level, idx, h FROM nodes UNION ALL SELECT true, NULL, level, idx, h FROM tops) x
      ON x.up = w.up AND (w.up OR x.t = w.t) AND x.level = w.level AND x.idx = xor(w.idx, 1)
    WHERE NOT (w.up AND w.level = (SELECT max(level) FROM tops))) w),
ends AS (SELECT t, own, changed, proof, row_number() OVER (PARTITION BY d ORDER BY up DESC, level DESC) AS r, d FROM walk)
SELECT p.doc_id, p.leaf, s.subroot, e.own AS root, sha256(e.proof) AS proof_sha256, e.changed AS folded_root, e.changed = e.own AS verified
FROM ends e JOIN (SELECT *, row_number() OVER () AS d FROM placed) p USING (d) JOIN subs s ON s.t = p.t WHERE e.r = 1""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(ws) AS t FROM i) GROUP BY ALL),
size AS (SELECT count(*) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, size GROUP BY t, nn),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * nn) // ll AS m FROM d, size),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20""",
    "op13_quality_rules": r"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, row_number() OVER () AS r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM x),
spots AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS k FROM w),
tri AS (SELECT r, k, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM spots WINDOW o AS (PARTITION BY r ORDER BY k)),
win AS (SELECT r, k, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, k + d AS k FROM win, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len([v FOR v IN ws IF lower(v) IN (STOPS)]) AS n_stop_words
  FROM w LEFT JOIN hit USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND 10 * n_symbols <= n_words AND 50 * n_stop_words >= n_words
    AND 2 * n_dup_lines <= n_lines AND 2 * n_words >= 3 * n_lines AS kept FROM b""".replace("STOPS", ", ".join(sorted({f"'{w}'" for ws in STOP_WORDS.values() for w in ws}))),
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
g AS (SELECT x, min(page_id) AS first FROM p GROUP BY x),
h AS (SELECT page_id, first, strlen(x) AS payload_bytes, sha1(x) AS d FROM p JOIN g USING (x))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, """
    + " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(d, {1 + 10 * p}, 10) AS BIGINT) >> {35 - 5 * k}) & 31) AS INTEGER) + 1, 1)" for p in range(4) for k in range(8)
    )
    + """ AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h""",
}


def oracle_sql() -> dict[str, str]:
    from nodeloom.llm.license_scan import oracle

    return SQL | {"op4_license_scan": oracle()}
