"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.block_max import ranked
from maskloom.llm.conversations import damaged, repaired
from maskloom.llm.cross_entropy import score
from maskloom.llm.decontaminate import contaminated
from maskloom.llm.fertility import judged
from maskloom.llm.jaccard_join import near_duplicates
from maskloom.llm.length_histogram import length_counts, with_suffix_sums
from maskloom.llm.line_spread import without_boilerplate
from maskloom.llm.mixing import mix
from maskloom.llm.multi_index import search
from maskloom.llm.packing import pack
from maskloom.llm.shared import shared_folder
from maskloom.llm.suffix_windows import without_repeats
from maskloom.llm.token_files import token_files

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), shared_folder(spark), public_tokenizers.path(BYTE_BPE))


@_query
def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE)))


@_query
def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


@_query
def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(documents(spark, sf_dir), public_tokenizers.path(PIECES), keep=["doc_id", "lang"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(f"_q.{c}" for c in (*names, "chars_per_token", "byte_share", "token_entropy")), "lang")


@_query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLES["op5_mix_sources"] = r"""
WITH rows AS (
  SELECT doc_id, source, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM rows GROUP BY source
), limits AS (
  SELECT *, 2.0 * source_size::DOUBLE AS most FROM sizes
), amounts AS (
  SELECT *, most / weight AS ratio,
         (sum(source_size::DOUBLE) OVER () * 1.5 - coalesce(sum(most) OVER before, 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS amount
  FROM limits
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(amount, ratio) AS amount FROM amounts WHERE amount * weight <= most
), budgets AS (
  SELECT source, source_size, least(most, level.amount * weight) AS target FROM amounts, level
), cut AS (
  SELECT r.doc_id, r.source, r.size, b.source_size, b.target, CAST(round(b.target) AS BIGINT) AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, source,
       CAST(coalesce(budget // nullif(source_size, 0), 0) * size
            + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - start)) AS BIGINT) AS taken
FROM cut
"""


@_query
def op6_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select(
        "doc_id",
        "_lines.n_lines",
        "_lines.n_found",
        "_lines.n_removed",
        F.length("_lines.kept").cast("long").alias("kept_chars"),
        F.md5("_lines.kept").alias("kept_md5"),
    )


ORACLES["op6_site_spread"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS site, text, coalesce(string_split(text, chr(10)), []) AS lines FROM documents
), each AS (
  SELECT doc_id, site, text, pos, line,
         lower(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS k
  FROM (SELECT doc_id, site, text, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM texts)
), wide AS (
  SELECT k FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k HAVING count(DISTINCT site) >= 5
), marked AS (
  SELECT e.*, w.k IS NOT NULL AS found FROM each e LEFT JOIN wide w USING (k)
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (found) AS n_found,
         coalesce(bool_or(NOT found AND regexp_matches(line, '[^\x20\x09-\x0D]')), false) AS drops,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT found), '') AS rest
  FROM marked GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_found, 0) AS n_found,
       CASE WHEN drops THEN n_found ELSE 0 END AS n_removed,
       length(CASE WHEN drops AND n_found > 0 THEN rest ELSE text END) AS kept_chars,
       md5(CASE WHEN drops AND n_found > 0 THEN rest ELSE text END) AS kept_md5
FROM texts t LEFT JOIN per USING (doc_id)
"""


@_query
def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = without_repeats(docs)
    return found.select("doc_id", "_r.n_bytes", "_r.n_removed", "_r.n_spans", "_r.kept_sha256")


@_query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "_j.n_shingles", "_j.component_id")


@_query
def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return score(documents(spark, sf_dir), good)


@_query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(documents(spark, sf_dir), items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "_b.n_words",
        "_b.n_hit",
        F.size("_b.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_b.items", ","), 256).alias("items_sha256"),
        (F.col("_b.n_hit") > 0).alias("contaminated"),
    )


ORACLES["op12_decontamination"] = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), places AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k
), hits AS (
  SELECT p.doc_id, p.i, p.k, x.item FROM places p JOIN wins x ON x.k = p.k AND x.win = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(a.n, 0) AS n_items,
       sha256(coalesce(a.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named a USING (doc_id)
"""


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS key
  FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(key) + 1), lambda i: ascii(substr(decode(key), i, 1))::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 20 AS k
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS said
  FROM damaged
), told AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(said, '[.!?]') THEN 'truncated' ELSE 'fine' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, unnest([0, 2, 3]) AS q, unnest([0, 3, 6])::BIGINT AS cost, unnest(['', 'I', 'II']) AS audit,
         unnest([[]::VARCHAR[], ['user:'], ['user:', 'assistant:']]) AS said
  FROM counts
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT conv_id, i, cost + 3 * m AS cost, audit || repeat('I', m) AS audit,
             CASE WHEN m = 0 THEN q WHEN m = 1 THEN CASE WHEN q = 2 THEN 3 ELSE 2 END ELSE CASE WHEN q = 2 THEN 2 ELSE 3 END END AS q,
             said || CASE WHEN m = 0 THEN []::VARCHAR[] WHEN q = 2 THEN ['assistant:', 'user:'][1:m] ELSE ['user:', 'assistant:'][1:m] END AS said
      FROM (
        SELECT p.conv_id, t.i, p.q, p.cost + 4 AS cost, p.audit || 'D' AS audit, p.said FROM paths p JOIN told t ON t.conv_id = p.conv_id AND t.i = p.i + 1
        UNION ALL
        SELECT p.conv_id, t.i, CASE WHEN p.q = 2 THEN 3 ELSE 2 END, p.cost + 3 + CASE WHEN t.fault = 'truncated' THEN 3 ELSE 0 END, p.audit || 'R',
               p.said || [CASE WHEN p.q = 2 THEN 'assistant:' ELSE 'user:' END || t.text]
        FROM paths p JOIN told t ON t.conv_id = p.conv_id AND t.i = p.i + 1 WHERE t.fault IN ('truncated', 'fine')
        UNION ALL
        SELECT p.conv_id, t.i, CASE substr(t.role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
               p.cost + CASE WHEN t.fault = 'truncated' THEN 3 ELSE 0 END, p.audit || 'K', p.said || [t.role || ':' || t.text]
        FROM paths p JOIN told t ON t.conv_id = p.conv_id AND t.i = p.i + 1
        WHERE t.fault IN ('truncated', 'fine') AND CASE substr(t.role, 1, 1) WHEN 's' THEN p.q = 0 WHEN 'u' THEN p.q <> 2 WHEN 'a' THEN p.q = 2 ELSE false END
      ), (VALUES (0), (1), (2)) AS inserts(m)
    )
  ) WHERE best = 1
), ends AS (
  SELECT p.conv_id, arg_min(p, {'c': p.cost, 'a': p.audit}) AS p FROM paths p JOIN counts c ON c.conv_id = p.conv_id AND c.n = p.i WHERE p.q IN (0, 3) GROUP BY p.conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(e.p.cost, 0) AS cost, coalesce(e.p.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.p.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c USING (conv_id) LEFT JOIN ends e USING (conv_id)
"""


@_query
def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op11_block_max_search"] = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
  FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), lengths AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM tokens GROUP BY 1
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths
), counts AS (
  SELECT doc_id, t, count(*)::BIGINT AS tf FROM tokens WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY t, docs
), scores AS (
  SELECT a.item_id, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * l.n * docs) // terms))))::BIGINT AS score
  FROM asked a JOIN counts c USING (t) JOIN weights w USING (t) JOIN lengths l ON l.doc_id = c.doc_id, whole GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
