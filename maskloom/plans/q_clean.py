"""Cleaning (I) and sampling (J)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.functions.hashing import hash_int
from maskloom.operators import clean as cl
from maskloom.operators import sample as sa
from maskloom.operators import tokens as tk
from maskloom.plans import frames as fr
from maskloom.plans.registry import query
from maskloom.plans.sqlparts import h, lit, pick, with_parts


def digest(df, text, *keys):
    """Length and MD5 of a long text instead of the text."""
    return df.select(*keys, F.length(text).alias("n"), F.md5(text.cast("binary")).alias("text_md5"))


def digest_sql(expr: str, src: str, keys: str = "document") -> str:
    return f"SELECT {keys}, length(x)::INT AS n, md5(x) AS text_md5 FROM (SELECT *, {expr} AS x FROM {src})"


def _nl(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def last_sql(t: str, marker: str) -> str:
    m = _nl(marker)
    return f"(CASE WHEN contains({t},{m}) THEN length({t})-strpos(reverse({t}),reverse({m}))-length({m})+1 ELSE -1 END)"


def nest_cuts(src: str, col: str, markers, share: float = 0.8, first: bool = False) -> str:
    """One sub-select per marker."""
    out = f"SELECT *, {col} AS x FROM {src}"
    for m in markers:
        mark, sh = m if isinstance(m, tuple) else (m, share)
        pos = f"strpos(x,{_nl(mark)})-1"
        test = f"{pos}>{sh}*length(x)" if first else f"{last_sql('x', mark)}>{sh}*length(x)"
        out = f"SELECT * REPLACE (CASE WHEN {test} THEN left(x,{pos}) ELSE x END AS x) FROM ({out})"
    return out


_DIGEST_X = "SELECT document, length(x)::INT AS n, md5(x) AS text_md5 FROM "


@query("i1_remove_note", with_parts(_DIGEST_X + f"({nest_cuts('essays', 'essay', cl.NOTE_MARKERS)})", "essays"))
def i1_remove_note(spark, sf):
    return digest(fr.essays(spark, sf), cl.remove_note(F.col("essay")), "document")


@query("i2_remove_word_count", with_parts(_DIGEST_X + f"({nest_cuts('essays', 'essay', cl.COUNT_MARKERS)})", "essays"))
def i2_remove_word_count(spark, sf):
    return digest(fr.essays(spark, sf), cl.remove_word_count(F.col("essay")), "document")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x},'^\\s+|\\s+$','','g')"


_HERE = f"CASE WHEN starts_with({strip_sql('essay')},'Here') AND contains(essay,chr(10)||chr(10)) THEN {strip_sql('substr(essay,strpos(essay,chr(10)||chr(10))+2)')} ELSE essay END"


@query("i3_remove_here_is", with_parts(digest_sql(_HERE, "essays"), "essays"))
def i3_remove_here_is(spark, sf):
    return digest(fr.essays(spark, sf), cl.remove_here_is(F.col("essay")), "document")


_OUTSIDE = "contains(regexp_replace(essay,'<<.*>>','<<>>','g'),'URL')"


@query("i4_url_outside_brackets", with_parts(f"SELECT document FROM essays WHERE NOT {_OUTSIDE}", "essays"))
def i4_url_outside_brackets(spark, sf):
    return fr.essays(spark, sf).filter(~cl.url_outside_brackets(F.col("essay"))).select("document")


_NO_PII = "(names='' AND famous_person='' AND NOT contains(essay,'<<URL>>'))"


@query("i5_no_pii", with_parts(f"SELECT document FROM essays WHERE NOT {_NO_PII}", "essays"))
def i5_no_pii(spark, sf):
    return fr.essays(spark, sf).filter(~cl.no_pii(F.col("names"), F.col("famous_person"), F.col("essay"))).select("document")


@query("i6_has_placeholders", with_parts("SELECT document FROM essays WHERE contains(essay,'<personal') OR contains(essay,'<public')", "essays"))
def i6_has_placeholders(spark, sf):
    return fr.essays(spark, sf).filter(cl.has_placeholders(F.col("essay"))).select("document")


@query("i7_no_errors", with_parts("SELECT document FROM essays WHERE NOT contains(essay,'<|ERROR|>')", "essays"))
def i7_no_errors(spark, sf):
    return fr.essays(spark, sf).filter(~cl.is_failed(F.col("essay"))).select("document")


_TAIL_LAST = f"SELECT * REPLACE (CASE WHEN {last_sql('x', chr(10) * 2)}>0.95*length(x) THEN left(x,{last_sql('x', chr(10) * 2)}) ELSE x END AS x) FROM ({nest_cuts('essays', 'essay', cl.TAIL_MARKERS, first=True)})"


@query("i8_cut_tails", with_parts(_DIGEST_X + f"({_TAIL_LAST})", "essays"))
def i8_cut_tails(spark, sf):
    return digest(fr.essays(spark, sf), cl.cut_tails(F.col("essay")), "document")


# Placeholders of the essays stand in one short stretch, so the first one there is the one that stays. The
# recursion takes the matches one by one: each drops the first match that is too near to one before.
_LINKS = f"""SELECT document, x FROM (
  SELECT document, x, row_number() OVER (PARTITION BY document ORDER BY step DESC) AS r FROM rounds) WHERE r=1"""
_ROUNDS = f"""SELECT document, regexp_replace(essay,{lit('|'.join(cl.LINK_LINES))},' <URL> ','g') AS x, 0 AS step FROM essays
  UNION ALL SELECT document, left(x, p)||substr(x, p+n+1), step+1 FROM (
    SELECT document, x, step, unnest(starts) AS p, unnest(sizes) AS n, unnest([0]||starts[:-1]) AS q, unnest(range(len(starts))) AS i, starts FROM (
      SELECT document, x, step, list_transform(range(1,len(m)+1), lambda i: list_sum([0]||list_transform(gaps[:i], lambda g: length(g)))+list_sum([0]||list_transform(m[:i-1], lambda g: length(g)))) ::BIGINT[] AS starts, list_transform(m, lambda g: length(g)) AS sizes FROM (
        SELECT document, x, step, regexp_extract_all(x,'.?URL.?') AS m, regexp_split_to_array(x,'.?URL.?') AS gaps FROM rounds WHERE contains(x,'URL'))))
  WHERE i>0 AND len(list_filter(starts[:i], lambda u: p-u BETWEEN 1 AND 9))>0
  QUALIFY row_number() OVER (PARTITION BY document, step ORDER BY i)=1"""


@query("i9_normalize_links", with_parts("SELECT document, length(x)::INT AS n, md5(x) AS text_md5 FROM links", "essays", rounds=_ROUNDS, links=_LINKS).replace("WITH ", "WITH RECURSIVE ", 1))
def i9_normalize_links(spark, sf):
    return digest(fr.essays(spark, sf), cl.normalize_links(F.col("essay")), "document")


def linked_essays(spark, sf):
    """Essays with links at several distances from placeholders, some of them twice."""
    k = hash_int("linked", "document")
    own = F.concat(F.lit("http://site"), (k % 5).cast("string"), F.lit(".org/"), F.col("document"))
    gap = lambda n: F.repeat(F.lit("-"), ((k / n).cast("long") % 7).cast("int"))
    tail = F.concat(
        F.lit(" also "), own, F.lit(" and <URL>"), gap(5), own, gap(35), F.lit("[URL] then "), F.lit("www.other.net"), gap(245), F.lit("<URL> or https://www.far.com/x?y=1"),
    )
    return fr.essays(spark, sf).select("document", F.concat("essay", tail).alias("essay"))


_LINKED = f"""SELECT document, essay||' also '||own||' and <URL>'||repeat('-',(k//5%7)::INT)||own||repeat('-',(k//35%7)::INT)||'[URL] then www.other.net'||repeat('-',(k//245%7)::INT)||'<URL> or https://www.far.com/x?y=1' AS essay
  FROM (SELECT *, 'http://site'||(k%5)||'.org/'||document AS own FROM (SELECT *, {h('linked', 'document')} AS k FROM essays))"""
_BOTH = lit(
    r"<URL>|\[URL\]|https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{2,256}\.[a-z]{2,6}[-a-zA-Z0-9@:%_+.~#?&/=]*|www\.[a-zA-Z0-9.-]+\.[a-z]{2,6}"
)
_FOLDED = f"""SELECT document, array_to_string(list_transform(range(1,len(m)+1), lambda i: g[i]||CASE WHEN list_contains(list_transform(near, lambda j: m[j]), m[i]) THEN ' <URL> ' ELSE m[i] END),'')||g[len(m)+1] AS essay FROM (
  SELECT *, list_filter(range(1,len(m)+1), lambda i: m[i] NOT IN ('<URL>','[URL]') AND ((i>1 AND m[i-1] IN ('<URL>','[URL]') AND length(g[i]) BETWEEN 1 AND 4) OR (i<len(m) AND m[i+1] IN ('<URL>','[URL]') AND length(g[i+1]) BETWEEN 1 AND 4))) AS near FROM (
    SELECT document, regexp_extract_all(x,{_BOTH}) AS m, string_split_regex(x,{_BOTH}) AS g FROM (SELECT document, regexp_replace(essay,{lit('|'.join(cl.LINK_LINES))},' <URL> ','g') AS x FROM linked)))"""
_NEAR_ROUNDS = _ROUNDS.replace(f"regexp_replace(essay,{lit('|'.join(cl.LINK_LINES))},' <URL> ','g') AS x, 0 AS step FROM essays", "essay AS x, 0 AS step FROM folded")


@query(
    "i9_near_links",
    with_parts("SELECT document, length(x)::INT AS n, md5(x) AS text_md5 FROM links", "essays", linked=_LINKED, folded=_FOLDED, rounds=_NEAR_ROUNDS, links=_LINKS).replace("WITH ", "WITH RECURSIVE ", 1),
)
def i9_near_links(spark, sf):
    return digest(linked_essays(spark, sf), cl.normalize_near_links(F.col("essay")), "document")


@query(
    "i10_link_lines",
    with_parts("SELECT document, array_to_string(ls, chr(10)) AS lines, len(ls)::INT AS n FROM (SELECT document, list_filter(string_split(essay,chr(10)), lambda x: contains(x,'URL')) AS ls FROM essays) WHERE len(ls)>0", "essays"),
)
def i10_link_lines(spark, sf):
    rows = fr.essays(spark, sf).select("document", cl.link_lines(F.col("essay")).alias("ls"))
    return rows.filter(F.size("ls") > 0).select("document", F.array_join("ls", "\n").alias("lines"), F.size("ls").alias("n"))


def name_lists(spark, sf):
    """Texts read as generated name lists: one word per line."""
    return fr.documents(spark, sf).select("document", "lang", F.regexp_replace("text", "[ ]", "\n").alias("raw"))


_TITLE = "array_to_string(list_transform(regexp_extract_all(x,'\\p{L}+|[^\\p{L}]+'), lambda w: upper(left(w,1))||lower(substr(w,2))),'')"
_FOLD = f"translate(x,'{tx.ACCENTED}','{tx.PLAIN}')"
for _a, _b in tx.SPELLED.items():
    _FOLD = f"replace({_FOLD},'{_a}','{_b}')"


def _names_sql() -> str:
    strip_x = "regexp_replace({},'^\\s+|\\s+$','','g')".format
    head = "raw"
    for stop in ("chr(10)||chr(10)", "chr(10)||'Note:'", "chr(10)||'(Note:'", "chr(10)||'User:'"):
        head = f"string_split({head},{stop})[1]"
    out = f"SELECT document, lang, string_split({strip_x(head)},chr(10)) AS ls FROM (SELECT document, lang, replace(text,' ',chr(10)) AS raw FROM docs)"
    out = f"SELECT document, lang, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM ({out})"
    for expr, keep in (
        (strip_x("regexp_replace(x,'^[*-]+','')"), None),
        (f"CASE WHEN contains(left(x,3),'.') THEN {strip_x("string_split(x,'.')[2]")} ELSE x END", "length(x) BETWEEN 2 AND 29 AND NOT regexp_matches(x,'[,()]')"),
        ("regexp_replace(x,'^\\.+|\\.+$','','g')", "NOT regexp_matches(x,'[*|\\\\/:.@`]')"),
        (strip_x("regexp_replace(x,'^(?:Female: |Male: )','')"), None),
        (f"replace({_FOLD},'@','a')", None),
        (_TITLE, "NOT regexp_matches(x,'[1-5]') AND length(x)>1"),
    ):
        out = f"SELECT * REPLACE ({expr} AS x) FROM ({out})"
        if keep:
            out = f"SELECT * FROM ({out}) WHERE {keep}"
    return out


_NAMES = _names_sql()


@query("i11_clean_names", with_parts("SELECT document, count(*)::INT AS n, md5(string_agg(x, chr(10) ORDER BY i)) AS names_md5 FROM nm GROUP BY 1", "docs", nm=_NAMES))
def i11_clean_names(spark, sf):
    rows = name_lists(spark, sf).select("document", cl.clean_names(F.col("raw")).alias("names"))
    return rows.filter(F.size("names") > 0).select("document", F.size("names").alias("n"), F.md5(F.array_join("names", "\n").cast("binary")).alias("names_md5"))


@query(
    "i12_two_words",
    "SELECT w AS name, count(*) AS n FROM (SELECT array_to_string(string_split(l,' ')[1:2],' ') AS w FROM (SELECT unnest(string_split(text,chr(10))) AS l FROM documents)) GROUP BY 1",
)
def i12_two_words(spark, sf):
    lines = fr.documents(spark, sf).select(F.explode_outer(F.split("text", "\n")).alias("line"))
    return lines.groupBy(cl.two_words(F.col("line")).alias("name")).agg(F.count("*").alias("n"))


@query("i13_names_by_country", with_parts("SELECT lang AS country, count(DISTINCT x) AS n_names, min(x) AS first_name, max(x) AS last_name FROM nm GROUP BY 1", "docs", nm=_NAMES))
def i13_names_by_country(spark, sf):
    rows = name_lists(spark, sf).select("lang", F.explode_outer(cl.clean_names(F.col("raw"))).alias("name")).filter("name IS NOT NULL")
    return cl.names_by_country(rows, "lang", "name").groupBy(F.col("lang").alias("country")).agg(
        F.count("*").alias("n_names"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )


@query("i15_first_of_each_text", "SELECT min(doc_id) AS nr FROM (SELECT doc_id, array_to_string(string_split(text,' '),'') AS j FROM documents) GROUP BY j")
def i15_first_of_each_text(spark, sf):
    docs = fr.documents(spark, sf).withColumn("nr", F.col("document").cast("long"))
    return cl.first_of_each_text(docs, F.replace("text", F.lit(" "), F.lit(""))).select("nr")


@query("i16_drop_duplicates_and_nulls", "SELECT d.doc_id AS nr, quality, toxic FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) d JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def i16_drop_duplicates_and_nulls(spark, sf):
    docs = fr.documents(spark, sf).withColumn("nr", F.col("document").cast("long"))
    marks = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "nr")
    return cl.first_of_each_text(docs, F.col("text")).join(marks, "nr", "left").na.drop().select("nr", "quality", "toxic")


@query("i17_collapse_spaces", with_parts(digest_sql("regexp_replace(essay,' {2,}',' ','g')", "essays"), "essays"))
def i17_collapse_spaces(spark, sf):
    return digest(fr.essays(spark, sf), cl.collapse_spaces(F.col("essay")), "document")


_STEP1 = nest_cuts("essays", "essay", cl.NOTE_MARKERS)
_STEP2 = nest_cuts(f"({_STEP1})", "x", cl.COUNT_MARKERS).replace("SELECT *, x AS x FROM", "SELECT * FROM", 1)
_STEP3 = f"SELECT * REPLACE ({_HERE.replace('essay', 'x')} AS x) FROM ({_STEP2})"


@query(
    "i18_clean_set",
    with_parts(
        _DIGEST_X + f"({_STEP3}) WHERE NOT {_OUTSIDE.replace('essay', 'x')} AND NOT {_NO_PII.replace('essay', 'x')} AND NOT contains(x,'<|ERROR|>')",
        "essays",
    ),
)
def i18_clean_set(spark, sf):
    rows = cl.clean_set(
        fr.essays(spark, sf),
        ("remove_note", "remove_word_count", "remove_here_is"),
        ("url_outside_angle_brackets", "no_pii", "no_errors"),
    )
    return digest(rows, F.col("essay"), "document")


@query("i19_clean_texts", with_parts("SELECT document FROM docs WHERE NOT contains(text,'http') AND NOT contains(text,'[URL') AND document NOT IN (SELECT document FROM pred)", "pred"))
def i19_clean_texts(spark, sf):
    return cl.clean_texts(fr.documents(spark, sf), fr.predictions(spark, sf)).select("document")


# ---- sampling -------------------------------------------------------------


@query("j1_folds", "SELECT doc_id::VARCHAR AS document, (doc_id%4)::INT AS fold, CASE WHEN doc_id%4=1 THEN 'validation' ELSE 'train' END AS part FROM documents")
def j1_folds(spark, sf):
    docs = fr.documents(spark, sf).withColumn("fold", sa.fold(F.col("document")))
    return docs.select("document", "fold", F.when(F.col("fold") == 1, "validation").otherwise(F.lit("train")).alias("part"))


@query("j2_keep_pii_and_share", with_parts(f"SELECT document FROM docs WHERE document IN (SELECT document FROM gold WHERE label<>'O') OR {h('keep', 'document')}/4294967296.0<0.3", "gold"))
def j2_keep_pii_and_share(spark, sf):
    return sa.keep_pii_and_share(fr.gold_documents(spark, sf).select("document", "toks"), 0.3).select("document")


@query("j3_hash_split", f"SELECT document, CASE WHEN {h('split', 'document')}/4294967296.0<0.2 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id::VARCHAR AS document FROM documents)")
def j3_hash_split(spark, sf):
    return fr.documents(spark, sf).select("document", sa.split_column(0.2).alias("split"))


@query(
    "j4_stratified_split",
    f"""SELECT document, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {h('strata', 'document')}, document)<=floor(0.2*count(*) OVER (PARTITION BY quality)) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT doc_id::VARCHAR AS document, quality FROM labels)""",
)
def j4_stratified_split(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("document"), "quality")
    return sa.stratified_split(rows, "quality", 0.2).select("document", "quality", "split")


@query("j5_take_shuffled", f"SELECT document, lang FROM (SELECT doc_id::VARCHAR AS document, lang FROM documents) ORDER BY {h('extra', 'document')}, document LIMIT 50")
def j5_take_shuffled(spark, sf):
    return sa.take_shuffled(fr.documents(spark, sf).select("document", "lang"), 50)


_POISSON = "+".join(
    f"(u>={sum(math.exp(-1.5) * 1.5**j / math.factorial(j) for j in range(k + 1))!r}::DOUBLE)::INT" for k in range(16)
)


@query(
    "j6_with_replacement",
    f"SELECT document, unnest(range(1,c+1))::INT AS copy FROM (SELECT document, {_POISSON} AS c FROM (SELECT document, {h('again', 'document')}/4294967296.0::DOUBLE AS u FROM (SELECT doc_id::VARCHAR AS document FROM documents)))",
)
def j6_with_replacement(spark, sf):
    return sa.with_replacement(fr.documents(spark, sf).select("document"), 1.5)


@query(
    "j7_concatenate",
    "SELECT origin, count(*) AS n, count(lang) AS n_lang, count(role) AS n_role, sum(length(full_text))::BIGINT AS chars FROM (SELECT 'prose' AS origin, text AS full_text, lang, NULL AS role FROM documents UNION ALL SELECT 'turns', text, NULL, role FROM conversations) GROUP BY 1",
)
def j7_concatenate(spark, sf):
    rows = sa.concatenate(
        {"prose": fr.documents(spark, sf), "turns": fr.turns(spark, sf)},
        {"prose": {"text": "full_text"}, "turns": {"text": "full_text"}},
        drop=("document", "source"),
    )
    return rows.groupBy("origin").agg(
        F.count("*").alias("n"), F.count("lang").alias("n_lang"), F.count("role").alias("n_role"), F.sum(F.length("full_text")).alias("chars")
    )


@query("j8_longest_first", "SELECT doc_id::VARCHAR AS document, length(text)::INT AS length FROM documents ORDER BY 2 DESC, 1")
def j8_longest_first(spark, sf):
    return sa.longest_first(fr.documents(spark, sf), F.length("text")).select("document", "length")


_FIRST = pick("swap", fr.FIRST_NAMES, "document", "token_text")
_LAST = pick("swap", fr.LAST_NAMES, "document", "token_text")


@query(
    "j9_swap_names",
    with_parts(
        f"""SELECT g.document, g.token, g.token_text, n.new_text FROM gold g JOIN (SELECT document, token_text, CASE WHEN kind='B' THEN {_FIRST} ELSE {_LAST} END AS new_text FROM (
             SELECT document, token_text, arg_min(left(label,1), token) AS kind FROM gold WHERE label LIKE '%NAME_STUDENT%' GROUP BY 1,2)) n ON g.document=n.document AND g.token_text=n.token_text WHERE g.label LIKE '%NAME_STUDENT%'""",
        "gold",
    ),
)
def j9_swap_names(spark, sf):
    first, last = name_banks(spark)
    swapped = sa.swap_names(fr.gold(spark, sf), first, last)
    return swapped.filter(F.col("label").contains("NAME_STUDENT")).select("document", "token", "token_text", "new_text")


def name_banks(spark):
    schema = "idx LONG, value STRING"
    return (
        spark.createDataFrame(list(enumerate(fr.FIRST_NAMES)), schema),
        spark.createDataFrame(list(enumerate(fr.LAST_NAMES)), schema),
    )


@query(
    "j9_rebuilt_text",
    with_parts(
        f"""SELECT document, md5(string_agg(coalesce(new_text, token_text)||CASE WHEN ws THEN ' ' ELSE '' END, '' ORDER BY token)) AS text_md5, sum(length(coalesce(new_text, token_text))+ws::INT)::BIGINT AS chars FROM (
             SELECT g.*, CASE WHEN g.label LIKE '%NAME_STUDENT%' THEN n.new_text END AS new_text FROM gold g LEFT JOIN (SELECT document, token_text, CASE WHEN kind='B' THEN {_FIRST} ELSE {_LAST} END AS new_text FROM (
             SELECT document, token_text, arg_min(left(label,1), token) AS kind FROM gold WHERE label LIKE '%NAME_STUDENT%' GROUP BY 1,2)) n ON g.document=n.document AND g.token_text=n.token_text) GROUP BY 1""",
        "gold",
    ),
)
def j9_rebuilt_text(spark, sf):
    first, last = name_banks(spark)
    swapped = sa.swap_names(fr.gold(spark, sf), first, last).drop("token_text").withColumnRenamed("new_text", "token_text")
    docs = tk.nest_tokens(swapped, fields=("token_text", "ws"))
    toks = F.transform("toks", lambda t: F.struct(t["token_text"].alias("text"), t["ws"].alias("ws")))
    return docs.select("document", tk.rebuild_text(toks).alias("t")).select(
        "document", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("chars")
    )
