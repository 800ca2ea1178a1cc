"""The end-to-end detection plan: text to corrected entity labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.functions.labels import LABELS
from maskloom.operators import rules, scores
from maskloom.operators import spans as sp
from maskloom.operators import tokens as tk
from maskloom.operators import windows as wn
from maskloom.plans import frames as fr
from maskloom.plans.sqlparts import lit, with_parts

# What the rule scorer looks for, later types win.
RULES = {
    "ID_NUM": r"\d{6,}",
    "PHONE_NUM": r"\+\d \(\d{3}\) \d{3}-\d{4}",
    "EMAIL": tx.EMAIL,
}


def rule_scores(docs: DataFrame, max_length: int = 512, stride: int = 128) -> tuple[DataFrame, DataFrame]:
    """Window scores of the rule scorer and the token table; `docs` co-located by document."""
    tokens = tk.token_spans(tk.token_rows(tk.tokenize(docs).select("document", "toks")))
    hits = sp.spans_of_all(docs, RULES)
    labelled = sp.bio_from_types(sp.span_cover(tokens, hits, list(RULES), ordered=True), "key", sp.COVERED).drop("key", *sp.COVERED)
    windows = wn.assign_windows(labelled, max_length, stride)
    spans = windows.select(
        "document", "window", F.col("start").alias("piece_start"), F.col("end").alias("piece_end"), "label"
    )
    return scores.one_hot_scores(spans), tokens


def detect(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Documents (document, text) to narrow predictions."""
    window_scores, tokens = rule_scores(docs)
    wide = scores.merge_windows(window_scores, tokens)
    preds = scores.drop_blank_tokens(scores.decode(scores.with_top_two(wide), threshold))
    return rules.phones_to_ids(rules.drop_never_labels(preds))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Entity tokens by language and label."""
    docs = fr.documents(spark, sf)
    found = detect(docs.select("document", "text"))
    return (
        found.join(docs.select("document", "lang"), "document")
        .groupBy("lang", "label")
        .agg(F.count("*").alias("n_tokens"), F.count_distinct("document").alias("n_documents"))
    )


def length_model(tokens: list[str]) -> list[list[float]]:
    """A stand-in model for the model seam: long tokens with a digit look like IDs."""
    hits = [len(t) > 7 and any("0" <= c <= "9" for c in t) for t in tokens]
    return [[float(c == ("B-ID_NUM" if hit else "O")) for c in LABELS] for hit in hits]


def spans_sql(pattern: str, table: str = "docs") -> str:
    """All matches of a pattern with positions, counterpart of `regex_spans`."""
    p = lit(pattern)
    return f"""SELECT document, (g+coalesce(pm,0))::INT AS span_start, (g+coalesce(pm,0)+hl)::INT AS span_end FROM (
      SELECT document, hl, sum(gl) OVER (PARTITION BY document ORDER BY k) AS g, sum(hl) OVER (PARTITION BY document ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
      FROM (SELECT document, unnest(range(len(hs))) AS k, unnest(list_transform(gs[1:len(hs)], lambda x: length(x))) AS gl, unnest(list_transform(hs, lambda x: length(x))) AS hl
            FROM (SELECT document, string_split_regex(text,{p}) AS gs, regexp_extract_all(text,{p}) AS hs FROM {table})))"""


_HITS = " UNION ALL ".join(
    f"SELECT *, {i} AS prio, '{k}' AS kind FROM ({spans_sql(p)})" for i, (k, p) in enumerate(RULES.items())
)

FLAGSHIP_SQL = with_parts(
    r"""SELECT lang, CASE WHEN label='B-PHONE_NUM' AND length(token_text)>4 AND NOT regexp_matches(token_text,'[().x+-]') THEN 'B-ID_NUM' ELSE label END AS label,
          count(*) AS n_tokens, count(DISTINCT document) AS n_documents FROM (
        SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY document ORDER BY token)=kind THEN 'I-'||kind ELSE 'B-'||kind END AS label FROM (
          SELECT s.document, s.lang, s.token, s.token_text, arg_max(h.kind, h.prio) AS kind FROM span s
          LEFT JOIN hits h ON s.document=h.document AND s."start">=h.span_start AND s."start"<h.span_end GROUP BY 1,2,3,4))
        WHERE label IS NOT NULL AND label NOT IN ('I-EMAIL') AND NOT (regexp_matches(token_text,'^\s+$') AND NOT contains(token_text,chr(10)))
        GROUP BY 1,2""",
    "span",
    hits=_HITS,
)
