"""DuckDB (RE2) formulations of the text steps, for the oracle SQL.

RE2 has no back-references, so two correction steps are written differently
from the Spark side: repeated letters by one replacement per letter, repeated
non-word characters by filtering the character list.
"""

from __future__ import annotations

import string

from loupe.functions.stopwords import ENGLISH_STOP_WORDS
from loupe.functions.text import NONWORD, TOKEN, WORD, WS


def sql_list(values) -> str:
    def q(v):
        return "'" + str(v).replace("'", "''") + "'"
    return "(" + ", ".join(q(v) for v in values) + ")"


def corrected_reviews_cte(source: str = "documents", id_col: str = "doc_id",
                          text_col: str = "text") -> str:
    """CTE chain ending in ``rv(review_id, text)`` with corrected text."""
    extra_sel = extra_pass = ""
    letters = "s"
    for ch in string.ascii_lowercase:
        letters = f"regexp_replace({letters}, '{ch}{{3,}}', '{ch}', 'g')"
    return f"""
t_a AS (SELECT {id_col} AS review_id, lower({text_col}) AS s{extra_sel} FROM {source}),
t_b AS (SELECT review_id, regexp_replace(regexp_replace(s, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') AS s{extra_pass} FROM t_a),
t_c AS (SELECT review_id, {letters} AS s{extra_pass} FROM t_b),
t_d AS (SELECT review_id, string_split(s, '') AS ch{extra_pass} FROM t_c),
t_e AS (SELECT review_id,
          array_to_string(list_filter(ch, lambda x, i: i = 1 OR x <> ch[i - 1] OR regexp_matches(x, '^{WORD}$')), '') AS s{extra_pass}
        FROM t_d),
t_f AS (SELECT review_id, regexp_replace(s, '{NONWORD}+?\\.', '.', 'g') AS s{extra_pass} FROM t_e),
t_g AS (SELECT review_id, regexp_replace(s, '([.?!,])({WORD})', '\\1 \\2', 'g') AS s{extra_pass} FROM t_f),
rv AS (SELECT review_id, regexp_replace(s, '{WS}([?.!,;:"](?:{WS}|$))', '\\1', 'g') AS text{extra_pass} FROM t_g)"""


def tokens_cte(src: str = "rv", n: int = 1, carry: str = "", name: str = "tok") -> str:
    """``tok(review_id, idx, term, ...carry)``: 0-based word positions / n-grams."""
    c = (", " + carry) if carry else ""
    if n == 1:
        return f"""
{name}_w AS (SELECT review_id, regexp_extract_all(text, '{TOKEN}') AS w{c} FROM {src}),
{name} AS (SELECT review_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS idx, unnest(w) AS term{c} FROM {name}_w)"""
    return f"""
{name}_w AS (SELECT review_id, regexp_extract_all(text, '{TOKEN}') AS w{c} FROM {src}),
{name}_s AS (SELECT review_id, w, unnest(range(1, len(w) - {n - 2})) AS i{c} FROM {name}_w WHERE len(w) >= {n}),
{name} AS (SELECT review_id, CAST(i - 1 AS INTEGER) AS idx, w[i:i + {n - 1}] AS ws, array_to_string(w[i:i + {n - 1}], ' ') AS term{c} FROM {name}_s)"""


STOP_SQL = sql_list(ENGLISH_STOP_WORDS)
