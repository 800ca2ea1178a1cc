"""Building blocks of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

import re

from maskloom.functions import text as tx
from maskloom.functions.labels import LABELS
from maskloom.plans import frames as fr


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def h(seed: str, *keys: str) -> str:
    """Hash draw, the counterpart of `hash_int`."""
    return f"('0x'||substr(md5(concat_ws(':',{lit(seed)},{','.join(keys)})),1,8))::BIGINT"


def pick(seed: str, values, *keys: str) -> str:
    return f"([{','.join(lit(v) for v in values)}])[(1+{h(seed, *keys)}%{len(values)})::INT]"


def rand_text(seed: str, alphabet: str, n: str, *keys: str) -> str:
    return (
        f"array_to_string(list_transform(range(1,({n})::BIGINT+1), lambda i: "
        f"substr({lit(alphabet)}, (1+{h(seed, *keys, 'i')}%{len(alphabet)})::BIGINT, 1)), '')"
    )


def istitle(c: str) -> str:
    return (
        f"(regexp_matches({c},{lit(tx.HAS_CAPITAL)}) AND NOT regexp_matches({c},{lit(tx.BREAKS_TITLE)}))"
    )


def islower(c: str) -> str:
    return f"(lower({c})={c} AND upper({c})<>{c})"


def isupper(c: str) -> str:
    return f"(upper({c})={c} AND lower({c})<>{c})"


def isspace(c: str) -> str:
    return f"regexp_matches({c},{lit('^[' + tx.WHITE + ']+$')})"


TOKEN_RE = lit(
    r"(?:https?://[^\s<>\"]+|www\.[^\s<>\"]+"
    r"|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    r"|\n+|[^\S\n]+|[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*|\S) ?"
)


def kind(t: str) -> str:
    return f"""CASE
        WHEN regexp_matches({t},{lit(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")}) THEN 'EMAIL'
        WHEN regexp_matches({t},'^[0-9]{{6,}}$') THEN 'ID_NUM'
        WHEN regexp_matches({t},'^[0-9]{{3}}[-.][0-9]{{4}}$') THEN 'PHONE_NUM'
        WHEN starts_with({t},'http') OR starts_with({t},'www.') THEN 'URL_PERSONAL'
        WHEN length({t})>=4 AND {istitle(t)} AND {h('name', t)}%23=0 THEN 'NAME_STUDENT'
        WHEN length({t})>=8 AND {islower(t)} AND {h('user', t)}%211=0 THEN 'USERNAME'
        WHEN length({t}) BETWEEN 2 AND 4 AND regexp_matches({t},'^\\p{{L}}+$')
             AND {h('street', t)}%311=0 THEN 'STREET_ADDRESS'
        END"""


def tokens_of(table: str, extra: str = "") -> str:
    """Token rows of a (document, text) relation."""
    return f"""SELECT document, {extra} n_tokens, token::INT AS token,
        CASE WHEN length(m)>1 AND right(m,1)=' ' THEN left(m,length(m)-1) ELSE m END AS token_text,
        (length(m)>1 AND right(m,1)=' ') AS ws
      FROM (SELECT document, {extra} len(ms)::INT AS n_tokens, unnest(ms) AS m, unnest(range(len(ms))) AS token
            FROM (SELECT *, regexp_extract_all(text,{TOKEN_RE},0) AS ms FROM {table}))"""


def spans_of(table: str) -> str:
    return f"""SELECT *, "start"+length(token_text) AS "end" FROM (
        SELECT *, coalesce(sum(length(token_text)+ws::INT) OVER (PARTITION BY document ORDER BY token
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::INT AS "start" FROM {table})"""


def labels_of(table: str) -> str:
    return f"""SELECT * EXCLUDE (kind, pk), CASE WHEN kind IS NULL THEN 'O'
          WHEN kind=pk AND kind IN ('ID_NUM','NAME_STUDENT','PHONE_NUM','STREET_ADDRESS') THEN 'I-'||kind ELSE 'B-'||kind END AS label
        FROM (SELECT *, lag(kind) OVER (PARTITION BY document ORDER BY token) AS pk
              FROM (SELECT *, {kind('token_text')} AS kind FROM {table}))"""


# Written out here rather than taken from the code, so that a wrong value there shows.
_FALSE = ("B-NAME_STUDENT", "I-NAME_STUDENT", "B-PHONE_NUM", "B-USERNAME", "I-EMAIL", "B-URL_PERSONAL", "B-EMAIL")


def noisy(label: str, seed: str = "pred") -> str:
    d = f"{h(seed, 'document', 'token')}%1000"
    return f"""CASE WHEN {label}='O' AND {d}<4 THEN {pick(seed + '-false', _FALSE, 'document', 'token')}
        WHEN {label}='O' THEN NULL WHEN {d}<80 THEN NULL
        WHEN {d}<120 THEN CASE {label} WHEN 'B-NAME_STUDENT' THEN 'I-NAME_STUDENT'
             WHEN 'I-NAME_STUDENT' THEN 'B-NAME_STUDENT' ELSE 'B-ID_NUM' END
        ELSE {label} END"""


def logit_cols() -> str:
    out = []
    for i, name in enumerate(LABELS):
        bonus = 8.0 if name == "O" else 6.0
        out.append(
            f"('0x'||substr(dg,{2 * i + 1},2))::INT/64.0::DOUBLE + CASE WHEN label={lit(name)} THEN {bonus} ELSE 0.0 END AS x{i}"
        )
    return ", ".join(out)


def qid(name: str) -> str:
    return '"' + name + '"'


_XMAX = "greatest(" + ",".join(f"x{i}" for i in range(12)) + ")"
_ESUM = "+".join(f"e{i}" for i in range(12))

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "SELECT doc_id::VARCHAR AS document, text, lang, source FROM documents"),
    "tok": (("docs",), tokens_of("docs", "lang, source,")),
    "span": (("tok",), spans_of("tok")),
    "gold": (("tok",), labels_of("tok")),
    "gspan": (("gold",), spans_of("gold")),
    "pred": (
        ("gold",),
        f"SELECT * FROM (SELECT document, token, token_text, {noisy('label')} AS label FROM gold) WHERE label IS NOT NULL",
    ),
    "runs": (
        ("gold",),
        f"""SELECT * FROM (SELECT document, token, token_text, run,
            CASE WHEN label='O' AND d<2 THEN {pick('run-false', _FALSE, 'document', 'token')}
                 WHEN label='O' THEN NULL WHEN d<miss THEN NULL WHEN d<miss+10 THEN 'B-ID_NUM' ELSE label END AS label
          FROM (SELECT *, {h('run', 'run', 'document', 'token')}%1000 AS d, substr(run,4,1)::INT*20 AS miss
                FROM gold, (VALUES ('run0'),('run1'),('run2'),('run3')) r(run))) WHERE label IS NOT NULL""",
    ),
    "logit": (
        ("gold",),
        f"SELECT document, n_tokens, token, token_text, ws, label, {logit_cols()} FROM (SELECT *, md5(concat_ws(':','score',document,token)) AS dg FROM gold)",
    ),
    "prob": (
        ("logit",),
        "SELECT document, n_tokens, token, token_text, ws, label, "
        + ", ".join(f"e{i}/({_ESUM}) AS p{i}" for i in range(12))
        + " FROM (SELECT *, "
        + ", ".join(f"exp(x{i}-{_XMAX}) AS e{i}" for i in range(12))
        + " FROM logit)",
    ),
    "wide": (
        ("prob",),
        "SELECT document, token, token_text, ws, label AS gold_label, "
        + ", ".join(f"p{i} AS {qid(n)}" for i, n in enumerate(LABELS))
        + " FROM prob",
    ),
    "essays": (
        ("docs",),
        f"""SELECT document, lang, CASE {h('essay', 'document')}%10
          WHEN 0 THEN text||chr(10)||'Note: This essay was written by a model.'
          WHEN 1 THEN left(text, length(text)//2)||chr(10)||'Note: early.'||substr(text, length(text)//2+1)||chr(10)||'Note: late.'
          WHEN 2 THEN 'Here is the essay:'||chr(10)||chr(10)||text||chr(10)||'Word count: 512'
          WHEN 3 THEN text||chr(10)||'(Word Count: 400)'
          WHEN 4 THEN text||' <|ERROR|>'
          WHEN 5 THEN text||' see <<URL>> and (URL) [URL] here'||chr(10)||'[URL: http://x.example.com]'||chr(10)||'URL end'
          WHEN 6 THEN text||chr(10)||chr(10)||'References'||chr(10)||'Some  book'
          WHEN 7 THEN 'Here '||text
          WHEN 8 THEN '<personal_name> met   <public_url> '||text ELSE text END AS essay,
          CASE {h('names', 'document')}%3 WHEN 0 THEN '' WHEN 1 THEN {pick('name1', fr.FIRST_NAMES, 'document')}
            ELSE {pick('name1', fr.FIRST_NAMES, 'document')}||'|'||{pick('name2', fr.FIRST_NAMES, 'document')} END AS names,
          CASE WHEN {h('famous', 'document')}%4=0 THEN '' ELSE {pick('who', fr.FAMOUS_PEOPLE, 'document')} END AS famous_person
        FROM docs""",
    ),
    "udocs": (
        (),
        "SELECT 'p'||page_id AS document, substr(html,1,200)||' '||url||' '||substr(html,201) AS text FROM pages",
    ),
    "utok": (("udocs",), tokens_of("udocs")),
}


def with_parts(body: str, *names: str, **extra: str) -> str:
    """Prefix `body` with the named parts and everything they need."""
    done: list[str] = []

    def need(n: str) -> None:
        if n in done:
            return
        for d in PARTS[n][0]:
            need(d)
        done.append(n)

    for n in names:
        need(n)
    ctes = [f"{n} AS (\n{PARTS[n][1]})" for n in done] + [f"{k} AS (\n{v})" for k, v in extra.items()]
    return "WITH " + ",\n".join(ctes) + "\n" + re.sub(r"\n\s+", "\n", body.strip())


def chain(body: str, names: tuple[str, ...], *ctes: tuple[str, str]) -> str:
    """Like `with_parts`, with further named CTEs in the given order."""
    return with_parts(body, *names, **dict(ctes))
