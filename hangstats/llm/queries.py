"""Registered queries over whole tables, one for each operator, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hangstats.llm import quality, toxicity
from hangstats.llm.collocations import collocations
from hangstats.llm.common import read_table
from hangstats.llm.decontamination import contaminated
from hangstats.llm.filter_audit import audit_filters, bucket_count, documents_stream
from hangstats.llm.fingerprints import fingerprint_neighbours
from hangstats.llm.licenses import scan_licenses
from hangstats.llm.page_text import extract_pages
from hangstats.llm.personal_data import personal_data
from hangstats.llm.sampling import held_out
from hangstats.llm.sentencepieces import encode_documents
from hangstats.llm.simhash import group_documents
from hangstats.llm.substring_dedup import remove_repeated_words
from hangstats.llm.suffix_dedup import remove_repeated_bytes

TOKENIZER = "piece_bpe_32k.model"


def _scored(found: DataFrame, by: int, at: int, threshold: float) -> DataFrame:
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), by, at).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(docs, model), 4, 2, toxicity.THRESHOLD)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(read_table(spark, sf_dir, "documents")).drop("spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("matches")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents"))
    return found.withColumn("scores", F.concat_ws(",", F.col("scores").cast("array<string>")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read_table(spark, sf_dir, "documents")).drop("spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return _scored(quality.score_quality(docs, model), 5, 0, quality.THRESHOLD)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return audit_filters(documents_stream(spark, path), read_table(spark, sf_dir, "labels"), bucket_count(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_fingerprints,
        op3_sentencepiece,
        op4_substring_dedup,
        op5_simhash,
        op6_license_scan,
        op7_pii,
        op8_suffix_dedup,
        op9_quality,
        op10_decontamination,
        op11_collocations,
        op12_page_text,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
          SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
        ), again AS (
          SELECT doc_id, i FROM windows JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)
        ), gone AS (
          SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM again)
        ), kept AS (
          SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept
          FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
          GROUP BY doc_id
        ), counted AS (
          SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
    """,
    "op8_suffix_dedup": r"""
        WITH d AS (
          SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), windows AS (
          SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)
        ), again AS (
          SELECT doc_id, i FROM windows JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)
        ), edges AS (
          SELECT doc_id, i, sum((i > coalesce(reach, -1))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span
          FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 AS reach FROM again)
        ), spans AS (
          SELECT doc_id, span, min(i) AS low, max(i) + 400 AS high FROM edges GROUP BY doc_id, span
        ), gaps AS (
          SELECT doc_id, coalesce(lag(high) OVER o, 0) AS low, low AS high FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY low)
          UNION ALL
          SELECT doc_id, coalesce(max(high), 0), any_value(length(h)) // 2 FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
        ), kept AS (
          SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS kept
          FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
        ), counted AS (
          SELECT doc_id, sum(high - low) AS n, count(*) AS s FROM spans GROUP BY doc_id
        )
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed,
               coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
    """,
    "op11_collocations": r"""
        WITH piece AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
          FROM documents
        ), w AS (
          SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
        ), total AS (
          SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
        ), gram AS (
          SELECT lang, k, phrase, count(*) AS f FROM (
            SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
            FROM w, range(1, 6) r(k) WHERE len(w) >= k)
          GROUP BY ALL HAVING count(*) >= 100
        ), candidate AS (
          SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM gram WHERE k >= 2
        ), around AS (
          SELECT lang, phrase, max(a) AS a FROM (
            SELECT lang, a, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, k - m + 2)]) AS phrase
            FROM candidate, range(2, 5) r(m) WHERE m < k)
          GROUP BY ALL
        ), kept AS (
          SELECT c.* FROM candidate c LEFT JOIN around o USING (lang, phrase) WHERE o.a IS NULL OR o.a < c.a
        ), cut AS (
          SELECT lang, c.phrase, a, j, l.f AS l, r.f AS r, n, (1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score
          FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c
          JOIN gram l USING (lang) JOIN gram r USING (lang) JOIN total USING (lang)
          WHERE l.phrase = array_to_string(w[1 : j], ' ') AND r.phrase = array_to_string(w[j + 1 : c.k], ' ')
        ), lowest AS (
          SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM lowest QUALIFY rank <= 2000
    """,
    "op13_filter_audit": r"""
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
          FROM documents
        ), l AS (
          SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), failing AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT
                 + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS fails
          FROM d LEFT JOIN l USING (doc_id)
        ), counters AS (
          SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL
        ), letter AS (
          SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
          SELECT filter_order, i::INT AS step, 1 << (ascii(filter_order[i]) - 65) AS bit,
                 coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, i)]), 0)::INT AS before
          FROM orders, range(1, 6) r(i)
        ), report AS (
          SELECT part, filter_order, step, bit,
                 coalesce(sum(n) FILTER (fails & (bit | before) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & before = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & before = 0 AND good), 0)::BIGINT AS good_lost,
                 coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & before = 0 AND toxic), 0)::BIGINT AS toxic_lost
          FROM counters, steps GROUP BY ALL
        )
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM report
    """,
}
