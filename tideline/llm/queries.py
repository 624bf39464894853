"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.alignment import align_tokens
from tideline.llm.common import read_table
from tideline.llm.embeddings import similar_vectors
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.media import media_columns
from tideline.llm.minhash import near_duplicates
from tideline.llm.mixing import mix_sources
from tideline.llm.pieces import encode_pieces
from tideline.llm.quality import quality
from tideline.llm.suffixes import remove_repeats
from tideline.llm.token_counts import token_counts
from tideline.llm.token_files import token_files
from tideline.llm.vector_codes import vector_codes
from tideline.llm.warc import header_text, page_records, resolve_revisits


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; a parameter of the operators, never copied here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), "text")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op7_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op8_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(read_table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return out.select("record_id", "response_id", "resolved", "reason", header_text(F.col("headers")).alias("headers"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_repeats": op2_repeats,
        "op3_media_columns": op3_media_columns,
        "op4_similar_vectors": op4_similar_vectors,
        "op5_token_files": op5_token_files,
        "op6_line_dedup": op6_line_dedup,
        "op7_encode_pieces": op7_encode_pieces,
        "op8_resolve_revisits": op8_resolve_revisits,
        "op9_mix_sources": op9_mix_sources,
        "op10_quality": op10_quality,
        "op11_vector_codes": op11_vector_codes,
        "op12_align_tokens": op12_align_tokens,
        "op13_token_counts": op13_token_counts,
    }


OP6_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3),
k AS (SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b, ls[pos + 3] AS c FROM r),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS pos FROM o WHERE nth > 1),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
      coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CAST(length(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS BIGINT) AS kept_chars,
       md5(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS kept_md5
FROM d LEFT JOIN t USING (doc_id)
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, page_id % 5 = 0 AS dated,
     regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^https?://(www[.])?', '') AS u FROM pages),
q AS (SELECT *, lower(regexp_replace(regexp_extract(u, '^[^/?]*'), ':(80|443)$', '')) AS host,
     regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(?:ref|utm_[a-z]+)=[^&]*', '\1', 'g') AS rest FROM p),
c AS (SELECT *, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]$', ''), '/$', '') AS url,
     '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (length(html) % 97) AS day FROM q),
r AS (SELECT url, page_id * 2 AS at_, page_id * 2 AS record_id, true AS full_, dated, tag, day, strlen(html) AS size FROM c
      UNION ALL SELECT url, page_id * 2 + 2001, page_id * 2 + 1, false, dated, tag, day, NULL FROM c),
w AS (SELECT *, last_value(CASE WHEN full_ THEN {'id': record_id, 'dated': dated, 'tag': tag, 'day': day, 'size': size} END IGNORE NULLS)
      OVER (PARTITION BY url ORDER BY at_, full_, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM r),
x AS (SELECT *, CASE WHEN b IS NULL THEN 'no earlier response'
      WHEN NOT dated THEN CASE WHEN NOT b.dated AND tag = b.tag THEN 'etag' ELSE 'etag differs' END
      WHEN b.dated AND day = b.day THEN 'last-modified' ELSE 'last-modified differs' END AS reason FROM w WHERE NOT full_)
SELECT record_id, CASE WHEN reason IN ('etag', 'last-modified') THEN b.id END AS response_id,
       reason IN ('etag', 'last-modified') AS resolved, reason,
       CASE WHEN reason = 'etag' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || b.size, 'content-type: text/html', 'date: ' || at_,
            'etag: ' || CASE WHEN (record_id // 2) % 2 = 1 THEN 'W/' ELSE '' END || tag)
            WHEN reason = 'last-modified' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || b.size, 'content-type: text/html', 'date: ' || at_, 'last-modified: ' || b.day) END AS headers
FROM x
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, cap / w AS ratio, CAST((SELECT sum(source_size) FROM s0) AS DOUBLE) AS total FROM s2),
s4 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
       sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM s3),
s5 AS (SELECT *, cap * w_rest > w * (total - used) AS open FROM s4),
f AS (SELECT used AS f_used, w_rest AS f_rest FROM s5 WHERE open ORDER BY ratio, rank LIMIT 1),
s AS (SELECT source, source_size, CASE WHEN open THEN w * (total - f_used) / f_rest ELSE cap END AS target FROM s5 LEFT JOIN f ON true),
c AS (SELECT d.doc_id, d.source, d.size, d.h, s.source_size, s.target,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id) AS upto
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT doc_id, h, size, CAST(source_size * i + upto AS DOUBLE) / target AS vt FROM c, (VALUES (0), (1), (2)) AS x(i) WHERE size > 0 AND target > 0),
m AS (SELECT doc_id, size, sum(size) OVER (ORDER BY vt, h, doc_id) <= (SELECT sum(target) FROM s) AS fits FROM e WHERE vt < 2),
t AS (SELECT doc_id, CAST(sum(size) FILTER (WHERE fits) AS BIGINT) AS taken FROM m GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(t.taken, 0) AS taken FROM c LEFT JOIN t ON c.doc_id = t.doc_id
"""


def _near_sql(books: str) -> str:
    """(vec_id, part, x, d, entry): the nearest entry of each part in `books`, ties to the lower index."""
    return f"""SELECT vec_id, part, any_value(x) AS x, min({{'d': d, 'e': entry}}) AS n FROM (
      SELECT p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM p JOIN {books} b ON p.part = b.part) GROUP BY vec_id, part"""


def _mean_sql(near: str, books: str) -> str:
    """Entries at the floor of the mean of the parts that `near` gave them."""
    return f"""SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
      SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
        SELECT part, n.e AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM {near}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL)
      GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry"""


OP11_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, list_slice(q, part * (len(q) // 16) + 1, (part + 1) * (len(q) // 16)) AS x FROM v, unnest(range(16)) AS t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < 64),
n0 AS MATERIALIZED ({_near_sql("b0")}),
b1 AS MATERIALIZED ({_mean_sql("n0", "b0")}),
n1 AS MATERIALIZED ({_near_sql("b1")}),
b2 AS MATERIALIZED ({_mean_sql("n1", "b1")}),
n2 AS MATERIALIZED ({_near_sql("b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', n.e), '' ORDER BY part) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM n2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN v USING (vec_id) GROUP BY label)
SELECT c.vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN v USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label, h
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op8_resolve_revisits": OP8_SQL, "op9_mix_sources": OP9_SQL, "op11_vector_codes": OP11_SQL}
