"""Profiling queries (L) and second-stage models (G5, G6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.operators import profile as pr
from maskloom.operators import sample as sa
from maskloom.operators import scores as sc
from maskloom.operators import snippets as sn
from maskloom.operators import tokens as tk
from maskloom.plans import frames as fr
from maskloom.plans import q_synth  # noqa: F401  (defines the SQL parts of the synthetic set)
from maskloom.plans.q_spans import _URLTOK
from maskloom.plans.q_rules import _DENSE, dense_names
from maskloom.plans.registry import query
from maskloom.plans.sqlparts import h, istitle, lit, with_parts
from maskloom.sources.io import written


@query("l1_label_counts", with_parts("SELECT label, count(*) AS n FROM gold GROUP BY 1", "gold"))
def l1_label_counts(spark, sf):
    return pr.label_counts(fr.gold(spark, sf))


@query(
    "l2_label_counts_by_fold",
    with_parts("SELECT (document::BIGINT%4)::INT AS fold, label, count(*) AS n, count(*) FILTER (label<>'O') AS n_entity FROM gold GROUP BY ROLLUP(1,2)", "gold"),
)
def l2_label_counts_by_fold(spark, sf):
    return pr.label_counts_by_fold(fr.gold(spark, sf), sa.fold(F.col("document")))


@query("l3_type_shares", with_parts("SELECT substr(label,3) AS type, count(*) AS n, round(count(*)/(SELECT count(*) FROM slab WHERE label<>'O')::DOUBLE,6) AS share FROM slab WHERE label<>'O' GROUP BY 1", "slab"))
def l3_type_shares(spark, sf):
    return pr.type_shares(fr.synthetic_tokens(spark, sf)).withColumn("share", F.round("share", 6))


@query("l4_name_summary", with_parts("SELECT label, count(*) AS n, count(DISTINCT token_text) AS n_distinct, min(length(token_text))::INT AS shortest, max(length(token_text))::INT AS longest FROM gold WHERE label LIKE '%NAME_STUDENT' GROUP BY 1", "gold"))
def l4_name_summary(spark, sf):
    return pr.name_summary(fr.gold(spark, sf))


@query("l5_odd_names", with_parts("SELECT DISTINCT label, token_text FROM slab WHERE label LIKE '%NAME_STUDENT' AND (regexp_matches(token_text,'[^a-zA-Z]') OR length(token_text)=2)", "slab"))
def l5_odd_names(spark, sf):
    return pr.odd_names(fr.synthetic_tokens(spark, sf))


_PAIRS = " UNION ALL ".join(
    f"SELECT {d} AS distance, k||lead(k,{d}) OVER (PARTITION BY document ORDER BY token) AS pair FROM ks" for d in (1, 2)
)


@query(
    "l6_transitions",
    with_parts(
        "SELECT distance, pair, count(*) AS n FROM prs WHERE pair IN ('BB','IB','II') GROUP BY 1,2",
        "tok",
        dense=_DENSE,
        ks="SELECT document, token, CASE label WHEN 'B-NAME_STUDENT' THEN 'B' WHEN 'I-NAME_STUDENT' THEN 'I' END AS k FROM dense",
        prs=_PAIRS,
    ),
)
def l6_transitions(spark, sf):
    return pr.transitions(dense_names(spark, sf))


@query(
    "l7_inside_run_lengths",
    with_parts(
        "SELECT length, count(*) AS n FROM (SELECT unnest(range(2,c+1))::INT AS length FROM (SELECT document, g, count(*) AS c FROM (SELECT document, token-row_number() OVER (PARTITION BY document ORDER BY token) AS g FROM dense WHERE label='I-NAME_STUDENT') GROUP BY 1,2)) GROUP BY 1",
        "tok",
        dense=_DENSE,
    ),
)
def l7_inside_run_lengths(spark, sf):
    return pr.inside_run_lengths(dense_names(spark, sf))


_SITE = "CASE WHEN contains(token_text,'youtube.com') OR contains(token_text,'youtu.be') THEN 'youtube' WHEN contains(token_text,'linkedin.com') THEN 'linkedin' WHEN contains(token_text,'facebook') OR contains(token_text,'fb.com') THEN 'facebook' ELSE 'other' END"


@query("l8_urls_by_site", with_parts(f"SELECT {_SITE} AS site, label='B-URL_PERSONAL' AS is_pii, count(*) AS n, count(DISTINCT token_text) AS n_distinct FROM slab WHERE {_URLTOK} GROUP BY 1,2", "slab"))
def l8_urls_by_site(spark, sf):
    urls = fr.synthetic_tokens(spark, sf).filter(tx.is_url_token(F.col("token_text")))
    return urls.groupBy(pr.site(F.col("token_text")).alias("site"), (F.col("label") == "B-URL_PERSONAL").alias("is_pii")).agg(
        F.count("*").alias("n"), F.count_distinct("token_text").alias("n_distinct")
    )


def personal_urls(spark, sf):
    rows = fr.synthetic_tokens(spark, sf).filter("label = 'B-URL_PERSONAL'")
    return rows.filter(~F.col("token_text").rlike("linkedin|yout|facebook"))


_PERSONAL = "label='B-URL_PERSONAL' AND NOT regexp_matches(token_text,'linkedin|yout|facebook')"


@query(
    "l9_domain_endings",
    with_parts(
        f"""SELECT CASE WHEN contains(u,'www.') OR contains(u,'://') THEN regexp_replace(split_part(regexp_replace(u, CASE WHEN contains(u,'www.') THEN '^.*?www\\.' ELSE '^.*?://' END,''),'/',1),'^[^.]*\\.','') ELSE split_part(u,'/',1) END AS ending, count(*) AS n
            FROM (SELECT token_text AS u FROM slab WHERE {_PERSONAL}) GROUP BY 1""",
        "slab",
    ),
)
def l9_domain_endings(spark, sf):
    return personal_urls(spark, sf).groupBy(pr.domain_ending(F.col("token_text")).alias("ending")).agg(F.count("*").alias("n"))


@query(
    "l10_path_terms",
    with_parts(
        f"""SELECT 'path' AS part, split_part(p,'.',1) AS term, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(token_text,'^.*?//',''),'/')[2:]) AS p FROM slab WHERE {_PERSONAL}) WHERE split_part(p,'.',1)<>'' GROUP BY 2
            UNION ALL SELECT 'ending', split_part(token_text,'.',-1), count(*) FROM slab WHERE {_PERSONAL} AND NOT ends_with(token_text,'.com/') GROUP BY 2""",
        "slab",
    ),
)
def l10_path_terms(spark, sf):
    # texts are counted first, so each is taken apart once, in one pass over the tokens
    urls = personal_urls(spark, sf).groupBy("token_text").agg(F.count("*").alias("k"))
    t = F.col("token_text")
    part = lambda name, terms: F.transform(terms, lambda x: F.struct(F.lit(name).alias("part"), x.alias("term")))
    ends = part("ending", F.array(pr.file_ending(t)))
    parts = F.concat(part("path", pr.path_terms(t)), F.when(t.endswith(".com/"), F.slice(ends, 1, 0)).otherwise(ends))
    return urls.select("k", F.inline(parts)).groupBy("part", "term").agg(F.sum("k").alias("n"))


def texts_on(rows: DataFrame, left, right) -> tuple[DataFrame, DataFrame]:
    """The texts of the rows that `left` and that `right` hold for, from one pass over the rows; only these texts are written."""
    both = sc.as_columns(rows, ["token_text"], [left.alias("left"), right.alias("right")]).filter("left OR right")
    table = written(both.groupBy("token_text").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right")))
    return table.filter("left").select("token_text"), table.filter("right").select("token_text")


def side_sql(a: str, b: str) -> str:
    return f"""SELECT token_text, CASE WHEN max(r)=0 THEN 'left' WHEN min(r)=1 THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT token_text, 0 AS r FROM slab WHERE {a} UNION ALL SELECT DISTINCT token_text, 1 FROM slab WHERE {b}) GROUP BY 1"""


@query("l11_url_differences", with_parts(side_sql("label='B-URL_PERSONAL'", _URLTOK), "slab"))
def l11_url_differences(spark, sf):
    rows = fr.synthetic_tokens(spark, sf)
    return pr.in_both(*texts_on(rows, F.col("label") == "B-URL_PERSONAL", tx.is_url_token(F.col("token_text"))), "token_text")


@query("l12_email_differences", with_parts(side_sql("contains(token_text,'@') AND contains(token_text,'.')", "label LIKE '%EMAIL%'"), "slab"))
def l12_email_differences(spark, sf):
    rows = fr.synthetic_tokens(spark, sf)
    like = F.col("token_text").contains("@") & F.col("token_text").contains(".")
    return pr.in_both(*texts_on(rows, like, F.col("label").contains("EMAIL")), "token_text")


_SHAPE = "CASE WHEN regexp_matches(token_text,'^\\p{Nd}+$') THEN 'digits' WHEN regexp_matches(left(token_text,2),'^\\p{L}{1,2}$') AND contains(left(token_text,5),':') THEN 'letters_colon' ELSE 'other' END"


@query("l13_id_shapes", with_parts(f"SELECT {_SHAPE} AS shape, length(token_text)::INT AS length, count(*) AS n FROM slab WHERE label='B-ID_NUM' GROUP BY 1,2", "slab"))
def l13_id_shapes(spark, sf):
    ids = fr.synthetic_tokens(spark, sf).filter("label = 'B-ID_NUM'")
    return ids.groupBy(pr.id_shape(F.col("token_text")).alias("shape"), F.length("token_text").alias("length")).agg(F.count("*").alias("n"))


@query("l14_long_digit_tokens", with_parts("SELECT token_text, label, count(*) AS n FROM slab WHERE regexp_matches(token_text,'[0-9]{6,}') GROUP BY 1,2", "slab"))
def l14_long_digit_tokens(spark, sf):
    rows = fr.synthetic_tokens(spark, sf).filter(F.col("token_text").rlike(r"\d{6,}"))
    return rows.groupBy("token_text", "label").agg(F.count("*").alias("n"))


@query("l15_vocabularies", with_parts("SELECT label, token_text, count(*) AS n FROM slab WHERE label LIKE '%USERNAME' OR label LIKE '%STREET_ADDRESS' GROUP BY 1,2", "slab"))
def l15_vocabularies(spark, sf):
    rows = fr.synthetic_tokens(spark, sf).filter(F.col("label").rlike("USERNAME|STREET_ADDRESS"))
    return rows.groupBy("label", "token_text").agg(F.count("*").alias("n"))


@query(
    "l16_token_percentiles",
    with_parts(
        "SELECT share::DOUBLE AS share, round(CASE share WHEN 0.25 THEN a WHEN 0.5 THEN b WHEN 0.75 THEN c WHEN 0.9 THEN d WHEN 0.95 THEN e ELSE f END,4) AS value FROM (SELECT quantile_cont(n,0.25) AS a, quantile_cont(n,0.5) AS b, quantile_cont(n,0.75) AS c, quantile_cont(n,0.9) AS d, quantile_cont(n,0.95) AS e, max(n)::DOUBLE AS f FROM (SELECT DISTINCT document, n_tokens AS n FROM tok)), (VALUES (0.25),(0.5),(0.75),(0.9),(0.95),(1.0)) v(share)",
        "tok",
    ),
)
def l16_token_percentiles(spark, sf):
    sizes = tk.tokenize(fr.documents(spark, sf)).select(F.size("toks").alias("n")).filter("n > 0")
    return pr.percentiles(sizes, "n").withColumn("value", F.round("value", 4))


@query(
    "l17_length_histogram",
    "SELECT least(floor((n-lo)*100/greatest(hi-lo,1)::DOUBLE),99)::BIGINT AS bin, count(*) AS n FROM (SELECT length(text) AS n, min(length(text)) OVER () AS lo, max(length(text)) OVER () AS hi FROM documents) GROUP BY 1",
)
def l17_length_histogram(spark, sf):
    return pr.length_histogram(fr.documents(spark, sf).select(F.length("text").alias("size")), "size")


@query(
    "l18_documents_without_pii",
    with_parts(
        "SELECT document, (contains(text,'http') OR contains(text,'://') OR contains(text,'www') OR contains(text,'.com')) AS has_url FROM docs WHERE document NOT IN (SELECT document FROM gold WHERE label<>'O')",
        "gold",
    ),
)
def l18_documents_without_pii(spark, sf):
    docs = fr.gold_documents(spark, sf)
    clean = docs.filter(F.forall(F.col("toks.label"), lambda x: x == "O"))
    return clean.select("document", F.col("text").rlike(r"http|://|www|\.com").alias("has_url"))


@query(
    "l19_title_candidates",
    with_parts(
        f"SELECT (SELECT count(*) FROM c) AS n, (SELECT count(DISTINCT token_text) FROM c) AS n_distinct, count(*) AS n_tokens, round((SELECT count(*) FROM c)/count(*)::DOUBLE,6) AS share FROM tok",
        "tok",
        c=f"SELECT DISTINCT document, token_text FROM tok WHERE {istitle('token_text')} AND length(token_text)>2",
    ),
)
def l19_title_candidates(spark, sf):
    out = pr.title_share(tk.token_rows(tk.tokenize(fr.documents(spark, sf)).select("document", "toks")))
    return out.withColumn("share", F.round(F.col("n") / F.col("n_tokens"), 6))


_BANK = ",".join(f"({lit(n)})" for n in (*fr.FIRST_NAMES, *fr.LAST_NAMES))


@query("l20_bank_candidates", with_parts(f"SELECT document, token, token_text, label FROM slab WHERE {istitle('token_text')} AND token_text IN (SELECT v FROM (VALUES {_BANK}) b(v))", "slab"))
def l20_bank_candidates(spark, sf):
    bank = spark.createDataFrame([(n,) for n in (*fr.FIRST_NAMES, *fr.LAST_NAMES)], "value STRING")
    return pr.bank_candidates(fr.synthetic_tokens(spark, sf), bank).select("document", "token", "token_text", "label")


@query(
    "l20_bank_coverage",
    with_parts(
        " UNION ALL ".join(
            f"SELECT '{n}' AS bank, count(*) AS n_labelled, count(*) FILTER (token_text NOT IN (SELECT v FROM (VALUES {','.join(f'({lit(x)})' for x in names)}) b(v))) AS n_missing FROM (SELECT DISTINCT token_text FROM slab WHERE label LIKE '%NAME_STUDENT')"
            for n, names in (("first", fr.FIRST_NAMES), ("last", fr.LAST_NAMES))
        ),
        "slab",
    ),
)
def l20_bank_coverage(spark, sf):
    names = fr.synthetic_tokens(spark, sf).filter(F.col("label").contains("NAME_STUDENT"))
    return pr.bank_coverage(names, {"first": fr.FIRST_NAMES, "last": fr.LAST_NAMES})


@query(
    "l21_prediction_profile",
    with_parts(
        "SELECT count(DISTINCT document) AS n_documents, count(*) AS n, round(avg(length(token_text)),6) AS mean_length, median(length(token_text))::DOUBLE AS median_length, count(*) FILTER (regexp_matches(left(token_text,1),'\\p{Lu}')) AS n_titled, count(*) FILTER (length(token_text)>3 AND regexp_matches(left(token_text,1),'\\p{Lu}') AND document NOT IN (SELECT document FROM gold WHERE label<>'O')) AS n_long_clean FROM pred",
        "pred",
    ),
)
def l21_prediction_profile(spark, sf):
    with_pii = fr.gold(spark, sf).filter("label <> 'O'").select("document").distinct().withColumn("pii", F.lit(True))
    rows = fr.predictions(spark, sf).join(with_pii, "document", "left")
    size, titled = F.length("token_text"), F.substring("token_text", 1, 1).rlike(r"\p{Lu}")
    return rows.agg(
        F.count_distinct("document").alias("n_documents"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(size), 6).alias("mean_length"),
        F.percentile(size, 0.5).alias("median_length"),
        F.count_if(titled).alias("n_titled"),
        F.count_if((size > 3) & titled & F.col("pii").isNull()).alias("n_long_clean"),
    )


@query("l22_character_vocabulary", with_parts("SELECT label, c AS char, count(*) AS n FROM (SELECT label, unnest(regexp_extract_all(token_text,'(?s).')) AS c FROM slab) GROUP BY 1,2", "slab"))
def l22_character_vocabulary(spark, sf):
    return pr.character_vocabulary(fr.synthetic_tokens(spark, sf))


@query(
    "l23_missed_and_wrong_names",
    with_parts("SELECT document, token, CASE WHEN label LIKE '%NAME_STUDENT' THEN 'missed' ELSE 'wrong' END AS kind FROM prob WHERE (label LIKE '%NAME_STUDENT' AND NOT (p2>0.3 OR p8>0.3)) OR (label='O' AND p2>0.012)", "prob"),
)
def l23_missed_and_wrong_names(spark, sf):
    wide = fr.wide_scores(spark, sf).select("document", "token", "gold_label", "B-NAME_STUDENT", "I-NAME_STUDENT")
    name = F.col("gold_label").contains("NAME_STUDENT")
    scored = (F.col("B-NAME_STUDENT") > 0.3) | (F.col("I-NAME_STUDENT") > 0.3)
    wrong = (F.col("B-NAME_STUDENT") > 0.012) & (F.col("gold_label") == "O")
    rows = sc.as_columns(wide, ["document", "token"], [name.alias("name"), scored.alias("scored"), wrong.alias("wrong")])
    # one pass: the few rows that matter meet the scored ones of their (document, token) in a window
    some = rows.filter("name OR scored OR wrong")
    found = F.max("scored").over(Window.partitionBy("document", "token")) & F.col("document").isNotNull()
    missed = F.col("name") & ~found
    kind = F.when(F.col("missed"), F.lit("missed")).when(F.col("wrong"), F.lit("wrong"))
    return some.withColumn("missed", missed).select("document", "token", kind.alias("kind")).filter("kind IS NOT NULL")


@query(
    "l24_title_negatives",
    with_parts(
        f"""SELECT p.document, p.token, arg_min(g.token, ({h('title-neg', 'p.document', 'p.token', 'g.token')}, g.token)) AS negative FROM (SELECT document, token FROM gold WHERE label='B-NAME_STUDENT') p
            JOIN gold g ON p.document=g.document AND g.token>=p.token-20 AND g.token<p.token+20 AND g.label='O' AND length(g.token_text)>2 AND {istitle('g.token_text')} GROUP BY 1,2""",
        "gold",
    ),
)
def l24_title_negatives(spark, sf):
    rows = sn.candidates(fr.gold_documents(spark, sf).select("document", "toks"), F.col("label") == "B-NAME_STUDENT")
    allowed = lambda t: tx.istitle(t) & (F.length(t) > 2)
    out = rows.withColumn("negative", sn.nearby_negative(20, 20, "title-neg", allowed))
    return out.filter("negative IS NOT NULL").select("document", "token", "negative")


@query("l25_one_character_tokens", with_parts("SELECT label, token_text, count(*) AS n FROM slab WHERE label<>'O' AND length(token_text)=1 GROUP BY 1,2", "slab"))
def l25_one_character_tokens(spark, sf):
    rows = fr.synthetic_tokens(spark, sf).filter((F.col("label") != "O") & (F.length("token_text") == 1))
    return rows.groupBy("label", "token_text").agg(F.count("*").alias("n"))


# ---- second-stage models ---------------------------------------------------


@query("g5_second_stage_model")
def g5_second_stage_model(spark, sf):
    from maskloom.operators import models
    from maskloom.plans.q_spans import training_rows

    rows = training_rows(spark, sf).withColumn("fold", sa.fold(F.col("document")))
    return models.cross_validate(rows)


def url_rows(spark, sf) -> DataFrame:
    """URL tokens of the synthetic essays, labelled by the links that were put in, and page addresses, which are public."""
    wanted = tx.is_url_token(F.col("token_text"))
    nested = tk.nest_tokens(fr.synthetic_tokens(spark, sf).withColumnRenamed("token_text", "text"), ("text", "ws", "label"))
    mine = sn.candidates(nested, wanted).withColumn("label", (F.col("label") == "B-URL_PERSONAL").cast("int"))
    pages = sn.candidates(tk.tokenize(fr.url_documents(spark, sf)).select("document", "toks"), wanted).withColumn("label", F.lit(0))
    parts = [r.select("document", "token", sn.url_excerpt(20, 20).alias("text"), "label") for r in (mine, pages)]
    return parts[0].unionByName(parts[1])


@query("g6_url_model")
def g6_url_model(spark, sf):
    from maskloom.operators import models

    return models.url_classifier(url_rows(spark, sf))
