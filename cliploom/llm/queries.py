"""Registered queries of the operators on training text, each with its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import bpe, decontaminate, exact_dedup, jaccard, language, lines, packing, periods, secrets, substrings, token_counts, variants, warc
from cliploom.llm.common import scratch_dir, table

TOKENIZER = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One cache per data folder and application.
    place = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()[:16]
    cache = f"{scratch_dir(spark)}/cliploom/token-cache-{place}"
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secrets_report(secrets.scan(docs, secrets.train(docs)))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.drop_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    return got.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


# Lines on five sites and more (of less than 20 characters: on 20 and more) stay in the smallest doc_id that has them.
LINES_CTES = r"""
split_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs}),
keyed AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM split_lines),
shared AS (
  SELECT line, min(doc_id) AS first_id FROM keyed WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT coalesce(source, '')) >= CASE WHEN length(line) >= 20 THEN 5 ELSE 20 END),
judged AS (SELECT k.*, coalesce(s.first_id <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN shared s ON s.line = k.line),
cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id)"""
OP7_SQL = (
    "WITH "
    + LINES_CTES.format(docs="documents")
    + """
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(c.text, '')) AS kept_sha256
FROM documents d LEFT JOIN cut c USING (doc_id)"""
)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination_report(decontaminate.find_contamination(docs, items))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/cliploom/warc-{uuid.uuid4().hex}"
    # Plain archives of any number of records, so that large ones are read in several splits.
    warc.write_warc(table(spark, sf_dir, "pages"), path, compression="none", records_per_file=0)
    return warc.warc_pages(spark, path)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def planted_repeats(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document, those of every tenth one periodic from some word on, as the digest of its id says."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periods.periodic_runs(table(spark, sf_dir, "documents"), planted_repeats)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # Runs are in order of start and period, so the first of equal ones stays.
    more = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), more)
    return got.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted_misspellings(doc_id: object) -> Callable[[str], str]:
    """Words of a document, one in 199 of them without one of its letters, as the digest of id and word says."""
    before = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), before)
        if h % 199:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return change


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = variants.word_counts(table(spark, sf_dir, "documents"), planted_misspellings)
    return variants.spelling_variants(counts)


# A-Z in lower case, and nothing else.
_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, hash(h[i + 1:i + 50]) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN f USING (s) WHERE first_id < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM r
  UNION ALL SELECT b.doc_id, coalesce(max(r.e), 0), any_value(b.n) FROM b LEFT JOIN r USING (doc_id) GROUP BY b.doc_id),
t AS (SELECT c.doc_id, string_agg(hex(b.h[lo + 1:hi]), '' ORDER BY lo, hi) AS kept FROM c JOIN b USING (doc_id) GROUP BY c.doc_id),
x AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM b JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)"""
OP6_SQL = (
    "WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all("
    + _LOWER.format(c="text")
    + r""", '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(greatest(len(w) - 4, 1)) END) AS i FROM w)),
n AS MATERIALIZED (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON b.s = a.s AND b.doc_id <> a.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""
)
_WORDS8 = "coalesce(regexp_extract_all(" + _LOWER.format(c="text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP8_SQL = (
    f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS8} AS w FROM benchmark),"""
    + """
q AS (SELECT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS p FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS p FROM (
  SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM q) z)),
h AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, i, n FROM v JOIN q USING (n, p)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
)
OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) % 32 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to FROM p"""


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_bpe_round_trip": (op2_bpe_round_trip, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_suffix_dedup": (op4_suffix_dedup, OP4_SQL),
    "op5_secrets": (op5_secrets, None),
    "op6_ngram_jaccard": (op6_ngram_jaccard, OP6_SQL),
    "op7_line_dedup": (op7_line_dedup, OP7_SQL),
    "op8_decontamination": (op8_decontamination, OP8_SQL),
    "op9_warc": (op9_warc, OP9_SQL),
    "op10_language": (op10_language, None),
    "op11_harmonic_packing": (op11_harmonic_packing, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_spelling_variants": (op13_spelling_variants, None),
}


def load() -> tuple[dict, dict]:
    return {k: fn for k, (fn, _) in QUERIES.items()}, {k: sql for k, (_, sql) in QUERIES.items() if sql}
