"""Tokens, offsets, windows (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.labels import ENTITY_TYPES, LABELS, REMOVED_LABELS, build_vocabulary, label_id
from maskloom.operators import pieces as pc
from maskloom.operators import spans as sp
from maskloom.operators import tokens as tk
from maskloom.operators import windows as wn
from maskloom.operators.overlap import overlap_join, touched
from maskloom.plans import frames as fr
from maskloom.plans.registry import query
from maskloom.plans.sqlparts import lit, tokens_of, with_parts

PHONE_SPAN = r"\+\d \(\d{3}\) \d{3}-\d{4}"


def _values(names) -> str:
    return ",".join(f"({i},{lit(n)})" for i, n in enumerate(names))


@query(
    "b1_tokens",
    with_parts(
        """SELECT document, count(*) AS n_tokens, sum(length(token_text))::BIGINT AS chars,
             count(*) FILTER (ws) AS n_spaced, sum(token*length(token_text)::BIGINT)::BIGINT AS checksum
           FROM tok GROUP BY 1""",
        "tok",
    ),
)
def b1_tokens(spark, sf):
    rows = tk.token_rows(tk.tokenize(fr.documents(spark, sf)).drop("text"))
    return rows.groupBy("document").agg(
        F.count("*").alias("n_tokens"),
        F.sum(F.length("token_text")).alias("chars"),
        F.count_if("ws").alias("n_spaced"),
        F.sum(F.col("token").cast("long") * F.length("token_text")).alias("checksum"),
    )


@query(
    "b1_tokens_of_turns",
    with_parts(
        "SELECT document, count(*) AS n_tokens FROM turntok GROUP BY 1",
        turns="SELECT concat_ws('-',conv_id,turn) AS document, text FROM conversations",
        turntok=tokens_of("turns"),
    ),
)
def b1_tokens_of_turns(spark, sf):
    rows = tk.token_rows(tk.tokenize(fr.turns(spark, sf)).select("document", "toks"))
    return rows.groupBy("document").agg(F.count("*").alias("n_tokens"))


@query("b2_rebuild_text", "SELECT doc_id::VARCHAR AS document, length(text)::INT AS n, md5(text) AS text_md5 FROM documents")
def b2_rebuild_text(spark, sf):
    docs = tk.tokenize(fr.documents(spark, sf)).select("document", tk.rebuild_text().alias("t"))
    return docs.select("document", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query(
    "b3_token_map",
    with_parts(
        """SELECT document, count(*) AS n_tokens, sum("start")::BIGINT AS starts, sum("end")::BIGINT AS ends, max("end") AS last_end FROM span GROUP BY 1""",
        "span",
    ),
)
def b3_token_map(spark, sf):
    docs = tk.tokenize(fr.documents(spark, sf)).select("document", "toks")
    spans = tk.token_spans(tk.token_rows(docs))
    return spans.groupBy("document").agg(
        F.count("*").alias("n_tokens"),
        F.sum("start").alias("starts"),
        F.sum("end").alias("ends"),
        F.max("end").alias("last_end"),
    )


_SPANS_SQL = f"""SELECT document, (gaps+hits)::INT AS span_start, (gaps+hits+hit)::INT AS span_end FROM (
  SELECT document, k, hit, sum(gap) OVER w AS gaps, coalesce(sum(hit) OVER (PARTITION BY document ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS hits
  FROM (SELECT document, unnest(range(len(hits))) AS k, unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap, unnest(list_transform(hits, lambda x: length(x))) AS hit
        FROM (SELECT document, string_split_regex(text,{lit(PHONE_SPAN)}) AS gaps, regexp_extract_all(text,{lit(PHONE_SPAN)}) AS hits FROM docs))
  WINDOW w AS (PARTITION BY document ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "b4_span_owner",
    with_parts(
        """SELECT document, span_start, span_end, min(token) AS first_token, max(token) AS last_token
           FROM hits JOIN span USING (document) WHERE "start"<span_end AND span_start<"end" GROUP BY 1,2,3""",
        "span",
        hits=_SPANS_SQL,
    ),
)
def b4_span_owner(spark, sf):
    docs = fr.documents(spark, sf)
    hits = sp.regex_spans(docs, PHONE_SPAN)
    spans = tk.token_spans(tk.token_rows(tk.tokenize(docs).select("document", "toks")))
    pairs = overlap_join(hits, spans.select("document", "token", "start", "end"), ("span_start", "span_end"))
    return pairs.groupBy("document", "span_start", "span_end").agg(
        F.min("token").alias("first_token"), F.max("token").alias("last_token")
    )


_WINDOWS = """SELECT document, n_tokens, w::INT AS "window", (w*382)::INT AS first, least(510, n_tokens-w*382)::INT AS size
  FROM (SELECT document, n_tokens, unnest(range(greatest(n_tokens-129,0)//382+1)) AS w FROM (SELECT DISTINCT document, n_tokens FROM tok))"""


def _sized(spark, sf):
    return tk.tokenize(fr.documents(spark, sf)).select("document", F.size("toks").alias("n_tokens")).filter("n_tokens > 0")


@query("b5_windows", with_parts(_WINDOWS, "tok"))
def b5_windows(spark, sf):
    return wn.document_windows(_sized(spark, sf), 512, 128)


@query(
    "b13_windows_per_document",
    with_parts(
        'SELECT document, count(*) AS n_windows, string_agg("window"::VARCHAR, \' \' ORDER BY "window") AS windows FROM win GROUP BY 1',
        "tok",
        win=_WINDOWS,
    ),
)
def b13_windows_per_document(spark, sf):
    per = wn.windows_per_document(wn.document_windows(_sized(spark, sf), 512, 128))
    return per.withColumn("windows", F.array_join("windows", " "))


# Pieces of four characters, the first one with the space before its token.
_PIECES = """SELECT *, greatest("start"+piece*4,0)-lead AS piece_start, least("start"+piece*4+4,"end") AS piece_end FROM (
   SELECT *, CASE WHEN piece=0 AND coalesce(pws,false) THEN 1 ELSE 0 END AS lead FROM (
     SELECT *, unnest(range(greatest(ceil(length(token_text)/4.0),1)::BIGINT))::INT AS piece FROM (
       SELECT *, lag(ws) OVER (PARTITION BY document ORDER BY token) AS pws FROM gspan)))"""


def _gold_spans(spark, sf):
    return tk.token_spans(fr.gold(spark, sf).drop("lang", "source", "n_tokens"))


@query(
    "b6_align_labels",
    with_parts(
        f"""SELECT document, label_id, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM (
              SELECT document, pos, CASE WHEN label IS NULL THEN 11 ELSE id END AS label_id FROM (
                SELECT document, row_number() OVER (PARTITION BY document ORDER BY token, piece)-1 AS pos, label FROM pieces)
              LEFT JOIN (VALUES {_values(LABELS)}) v(id,name) ON name=label) GROUP BY 1,2""",
        "gspan",
        pieces=_PIECES,
    ),
)
def b6_align_labels(spark, sf):
    spans = _gold_spans(spark, sf)
    pieces = wn.with_leading_space(tk.subtokens(spans).drop("label"))
    aligned = wn.align_labels(pieces, spans.select("document", "start", "end", "label"))
    return _positions(aligned).groupBy("document", "label_id").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum")
    )


def _positions(pieces):
    from pyspark.sql import Window

    w = Window.partitionBy("document").orderBy("token", "piece")
    return pieces.withColumn("pos", F.row_number().over(w) - 1)


@query(
    "b6_window_labels",
    with_parts(
        f"""SELECT document, "window", label_id, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM (
             SELECT t.document, w."window", (t.token-w.first)::BIGINT AS pos, v.id AS label_id
             FROM gold t JOIN win w ON t.document=w.document AND t.token>=w.first AND t.token<w.first+w.size JOIN (VALUES {_values(LABELS)}) v(id,name) ON name=label
             UNION ALL SELECT document, "window", unnest([-1, size])::BIGINT, -100 FROM win) GROUP BY 1,2,3""",
        "gold",
        win=_WINDOWS,
    ),
)
def b6_window_labels(spark, sf):
    rows = wn.encode_labels(fr.gold(spark, sf), LABELS)
    inside = wn.assign_windows(rows, 512, 128).select("document", "window", "pos", "label_id")
    special = wn.add_special_positions(wn.document_windows(_sized(spark, sf), 512, 128))
    return (
        inside.unionByName(special)
        .groupBy("document", "window", "label_id")
        .agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))
    )


@query(
    "b7_vocabulary",
    with_parts(
        f"""SELECT id AS label_id, name AS label, count(gold.label) AS n FROM (VALUES {_values(LABELS)}) v(id,name)
            LEFT JOIN gold ON gold.label=name GROUP BY 1,2""",
        "gold",
    ),
)
def b7_vocabulary(spark, sf):
    names = build_vocabulary(ENTITY_TYPES, REMOVED_LABELS)
    vocabulary = spark.createDataFrame(list(enumerate(names)), "label_id INT, label STRING")
    counted = fr.gold(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return vocabulary.join(counted, "label", "left").select("label_id", "label", F.coalesce("n", F.lit(0)).alias("n"))


_BARE = build_vocabulary(ENTITY_TYPES, (), bio=False)


@query(
    "b8_encode_labels",
    with_parts(
        f"""SELECT id AS label_id, label, count(*) AS n FROM gold JOIN (VALUES {_values(_BARE)}) v(id,name)
            ON name=regexp_replace(label,'^[BI]-','') GROUP BY 1,2""",
        "gold",
    ),
)
def b8_encode_labels(spark, sf):
    rows = wn.encode_labels(fr.gold(spark, sf), _BARE)
    return rows.groupBy("label_id", "label").agg(F.count("*").alias("n"))


@query(
    "b9_name_pieces",
    with_parts(
        """SELECT document, count(*) AS n_pieces, count(*) FILTER (hit) AS n_named, coalesce(sum(piece_start) FILTER (hit),0)::BIGINT AS checksum FROM (
             SELECT p.*, EXISTS (SELECT 1 FROM names n WHERE n.document=p.document AND n.token_text=p.token_text)
                    OR EXISTS (SELECT 1 FROM parts h WHERE h.document=p.document AND h.s<p.piece_end AND p.piece_start<h.e) AS hit
             FROM pieces p WHERE true) GROUP BY 1""",
        "gspan",
        pieces="SELECT *, \"start\"+piece*4 AS piece_start, least(\"start\"+piece*4+4,\"end\") AS piece_end FROM (SELECT *, unnest(range(greatest(ceil(length(token_text)/4.0),1)::BIGINT))::INT AS piece FROM gspan)",
        names="SELECT DISTINCT document, token_text FROM gold WHERE label LIKE '%NAME_STUDENT'",
        # Names also hide inside longer tokens with dots, dashes or apostrophes, and span tokens.
        parts="""SELECT document, ("start"+pos)::INT AS s, ("start"+pos+length(name))::INT AS e FROM (
            SELECT g.document, g."start", n.token_text AS name, unnest(list_filter(range(length(g.token_text)), lambda i:
                 substr(g.token_text, i+1, length(n.token_text))=n.token_text
                 AND (i=0 OR NOT regexp_matches(substr(g.token_text,i,1),'[\\p{L}\\p{N}_]'))
                 AND NOT regexp_matches(substr(g.token_text,i+1+length(n.token_text),1),'[\\p{L}\\p{N}_]'))) AS pos
            FROM gspan g JOIN names n ON g.document=n.document AND length(g.token_text)>length(n.token_text) AND contains(g.token_text, n.token_text))""",
    ),
)
def b9_name_pieces(spark, sf):
    docs = fr.gold_documents(spark, sf)
    is_name = F.filter("toks", lambda t: t["label"].contains("NAME_STUDENT"))
    names = docs.withColumn("name", F.explode_outer(F.array_distinct(F.transform(is_name, lambda t: t["text"])))).filter("name IS NOT NULL")
    hits = sp.regex_spans(
        names.withColumn("pat", sp.literal_pattern(F.col("name"), True)), F.col("pat"), by=("name",)
    ).select("document", "span_start", "span_end")
    pieces = tk.subtokens(_gold_spans(spark, sf)).select("document", "token", "piece", "piece_start", "piece_end")
    named = touched(pieces, hits, ("piece_start", "piece_end"), ("span_start", "span_end"))
    return named.groupBy("document").agg(
        F.count("*").alias("n_pieces"),
        F.count_if("hit").alias("n_named"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("piece_start"))), F.lit(0)).alias("checksum"),
    )


@query(
    "b10_subtoken_labels",
    with_parts(
        f"""SELECT mode, label_id, count(*) AS n FROM (
              SELECT mode, CASE WHEN piece=0 THEN a.id WHEN mode='first' THEN -100 ELSE coalesce(b.id, a.id) END AS label_id
              FROM (SELECT label, unnest(range(greatest(ceil(length(token_text)/4.0),1)::BIGINT))::INT AS piece FROM gold),
                   (VALUES ('first'),('all')) m(mode)
              JOIN (VALUES {_values(LABELS)}) a(id,name) ON a.name=label
              LEFT JOIN (VALUES {_values(LABELS)}) b(id,name) ON b.name=regexp_replace(label,'^B-','I-')) GROUP BY 1,2""",
        "gold",
    ),
)
def b10_subtoken_labels(spark, sf):
    rows = fr.gold(spark, sf).withColumn("start", F.lit(0)).withColumn("end", F.length("token_text"))
    pieces = tk.subtokens(rows)
    both = wn.subtoken_labels(pieces).withColumnRenamed("label_id", "first")
    both = wn.subtoken_labels(both, label_all=True).withColumnRenamed("label_id", "all")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("label_id")) for m in ("first", "all")])
    return both.groupBy("first", "all").agg(F.count("*").alias("k")).select("k", F.inline(modes)).groupBy(
        "mode", "label_id"
    ).agg(F.sum("k").alias("n"))


#: Vocabulary file of the piece queries; any path, or any dict of pieces, can take its place.
PIECE_VOCABULARY = "word_bpe_49k.json"


def vocabulary_pieces(spark, sf, labels: bool = True):
    """Tokens of `documents`, with gold labels if wanted, cut into pieces of the vocabulary."""
    import public_tokenizers

    trie = pc.flat_trie(pc.byte_level_vocabulary(public_tokenizers.path(PIECE_VOCABULARY)), "</w>")
    spans = _gold_spans(spark, sf) if labels else tk.token_spans(tk.match_rows(fr.documents(spark, sf).select("document", "text")))
    return pc.with_pieces(spans.select("document", "token", "token_text", "start", *["label"] * labels), trie)


@query("b6_vocabulary_pieces")
def b6_vocabulary_pieces(spark, sf):
    """Pieces per document and label id of their first character, with sums that fix offsets and ids."""
    pieces = vocabulary_pieces(spark, sf).withColumn("label_id", label_id(F.col("label")))
    return pieces.groupBy("document", "label_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("piece_start") * 7 + F.col("piece_end")).alias("offsets"),
        F.sum("piece_id").alias("ids"),
        F.count_if(F.col("piece_id") == pc.UNKNOWN).alias("n_unknown"),
    )


@query("b9_vocabulary_names")
def b9_vocabulary_names(spark, sf):
    """Pieces that overlap an occurrence of one of the document's names, inside longer tokens too."""
    names = fr.document_names(fr.documents(spark, sf))
    pattern = sp.literal_pattern(F.col("name"), True)
    hits = sp.regex_spans(names.withColumn("pat", pattern), F.col("pat"), by=("name",)).select("document", "span_start", "span_end")
    pieces = vocabulary_pieces(spark, sf, labels=False).select("document", "token", "piece", "piece_start", "piece_end")
    named = touched(pieces, hits, ("piece_start", "piece_end"), ("span_start", "span_end"))
    return named.groupBy("document").agg(
        F.count("*").alias("n_pieces"),
        F.count_if("hit").alias("n_named"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("piece_start"))), F.lit(0)).alias("checksum"),
    )


@query("b10_vocabulary_labels")
def b10_vocabulary_labels(spark, sf):
    """How often each label id falls on a piece, when others than a token's first are ignored or take the I-form."""
    both = pc.labelled_pieces(vocabulary_pieces(spark, sf))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_id").alias("label_id")) for m in ("first", "all")])
    return both.groupBy("first_id", "all_id").agg(F.count("*").alias("k")).select("k", F.inline(modes)).groupBy("mode", "label_id").agg(F.sum("k").alias("n"))


@query(
    "b11_chunks",
    with_parts(
        """SELECT document, c::INT AS chunk, f::INT AS first, least(256,n_tokens)::INT AS size, sum(length(token_text))::BIGINT AS chars FROM (
             SELECT document, n_tokens, c, CASE WHEN c*256+256>n_tokens THEN greatest(n_tokens-256,0) ELSE c*256 END AS f
             FROM (SELECT document, n_tokens, unnest(range((n_tokens+255)//256)) AS c FROM (SELECT DISTINCT document, n_tokens FROM tok)))
           JOIN tok USING (document) WHERE token>=f AND token<f+256 GROUP BY 1,2,3,4""".replace("SELECT document, c::INT", "SELECT document, c::INT"),
        "tok",
    ).replace("least(256,n_tokens)", "least(256,tok.n_tokens)"),
)
def b11_chunks(spark, sf):
    docs = tk.tokenize(fr.documents(spark, sf)).select("document", "toks")
    sized = F.aggregate("chunk_toks", F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    return wn.chunk_tokens(docs, 256).select(
        "document", "chunk", "first", F.size("chunk_toks").alias("size"), sized.alias("chars")
    )


@query(
    "b12_pack",
    with_parts(
        """SELECT source, block, count(*) AS n, sum(length(token_text))::BIGINT AS chars, count(DISTINCT document) AS n_documents FROM (
             SELECT source, document, token_text, (off+token)//512 AS block, tot FROM (
               SELECT source, document, token_text, token,
                 row_number() OVER (PARTITION BY source ORDER BY document::BIGINT, token)-1-token AS off,
                 count(*) OVER (PARTITION BY source) AS tot FROM tok) WHERE off+token < tot//512*512) GROUP BY 1,2""",
        "tok",
    ),
)
def b12_pack(spark, sf):
    docs = tk.tokenize(fr.documents(spark, sf)).drop("text", "lang")
    sizes = docs.select("document", "source", F.col("document").cast("long").alias("nr"), F.size("toks").alias("n"))
    placed = wn.pack_positions(sizes, "source", "nr", "n").select("document", "offset", "key_total")
    rows = wn.pack_blocks(tk.token_rows(docs).join(placed, "document"), 512)
    return rows.groupBy("source", "block").agg(
        F.count("*").alias("n"),
        F.sum(F.length("token_text")).alias("chars"),
        F.count_distinct("document").alias("n_documents"),
    )
