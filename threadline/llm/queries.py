"""The registered queries of the operators: op1 to op13."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import ann, bpe, collocations, html, langid, lexical, licenses, minhash, packing, quality, rules, toxicity, warc
from threadline.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, covered_percent=50, top=2000)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_minhash": op3_minhash,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_html": op6_html,
    "op7_packing": op7_packing,
    "op8_rules": op8_rules,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
    "op11_search": op11_search,
    "op12_collocations": op12_collocations,
    "op13_licenses": op13_licenses,
}
ORACLE: dict[str, str] = {
    "op3_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS own FROM w),
sizes AS MATERIALIZED (SELECT doc_id, CAST(len(own) AS BIGINT) AS n FROM sets),
every AS MATERIALIZED (SELECT doc_id, unnest(list_transform(own, lambda x: hash(x))) AS item FROM sets),
items AS MATERIALIZED (SELECT doc_id, item FROM every WHERE item IN (SELECT item FROM every GROUP BY item HAVING count(*) > 1)),
shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS start FROM sizes UNION SELECT l.b, r.start FROM reach r JOIN links l ON l.a = r.node),
lowest AS (SELECT node AS doc_id, min(start) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN lowest USING (doc_id)""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f""",
    "op11_search": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
total AS MATERIALIZED (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT place, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT place, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), total),
impacts AS MATERIALIZED (SELECT place, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * nn) // ll))) AS part
  FROM tf JOIN d USING (place) JOIN weights USING (term), total),
scores AS (SELECT item_id, place, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""",
    "op12_collocations": r"""
WITH p AS MATERIALIZED (SELECT lang, row_number() OVER () AS place, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS MATERIALIZED (SELECT lang, unnest(ws) AS w1, unnest(list_resize(ws[2:], len(ws))) AS w2, unnest(list_resize(ws[3:], len(ws))) AS w3 FROM p WHERE len(ws) > 0),
f1 AS MATERIALIZED (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS a FROM w GROUP BY 1, 2),
f2 AS MATERIALIZED (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS a FROM w WHERE w2 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS a FROM w WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
cuts AS (
  SELECT f.lang, f.w1 || ' ' || f.w2 AS phrase, f.w1, f.w2, 2 AS words, f.a, 1 AS k, x.a AS l, y.a AS r
    FROM f2 f JOIN f1 x ON x.lang = f.lang AND x.w1 = f.w1 JOIN f1 y ON y.lang = f.lang AND y.w1 = f.w2
  UNION ALL SELECT f.lang, f.w1 || ' ' || f.w2 || ' ' || f.w3, f.w1, f.w2, 3, f.a, 1, x.a, y.a
    FROM f3 f JOIN f1 x ON x.lang = f.lang AND x.w1 = f.w1 JOIN f2 y ON y.lang = f.lang AND y.w1 = f.w2 AND y.w2 = f.w3
  UNION ALL SELECT f.lang, f.w1 || ' ' || f.w2 || ' ' || f.w3, f.w1, f.w2, 3, f.a, 2, x.a, y.a
    FROM f3 f JOIN f2 x ON x.lang = f.lang AND x.w1 = f.w1 AND x.w2 = f.w2 JOIN f1 y ON y.lang = f.lang AND y.w1 = f.w3),
best AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000 * a * a) // (l * r), k) = 1),
inside AS (SELECT lang, w1, w2, max(a) AS a FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY 1, 2, 3),
kept AS (SELECT best.* FROM best LEFT JOIN inside i ON best.words = 2 AND i.lang = best.lang AND i.w1 = best.w1 AND i.w2 = best.w2
  WHERE 100 * coalesce(i.a, 0) < 50 * best.a),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(score AS BIGINT) AS score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
