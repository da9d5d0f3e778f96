"""Rule-based part-of-speech tags as a column expression.

No statistical tagger is available offline, so tags come from closed-class
word lists and suffix rules, written as one ``CASE`` expression that runs in
generated code. A caller-supplied lexicon table can replace it
(``loupe.operators.terms.with_pos``). Tags use the Universal POS names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed-class English words and suffix rules of this tagger.
DET = ("a", "an", "the", "this", "that", "these", "those", "each", "every",
       "some", "any", "no", "all", "both", "either", "neither")
PRON = ("i", "me", "you", "he", "him", "she", "her", "it", "we", "us", "they",
        "them", "my", "your", "his", "its", "our", "their", "mine", "yours",
        "ours", "theirs", "myself", "yourself", "himself", "herself", "itself",
        "ourselves", "themselves", "who", "whom", "what", "which")
ADP = ("of", "in", "on", "at", "by", "for", "with", "about", "against",
       "between", "into", "through", "during", "before", "after", "above",
       "below", "from", "up", "down", "out", "off", "over", "under", "per")
CCONJ = ("and", "or", "but", "nor", "yet")
SCONJ = ("if", "because", "while", "although", "though", "since", "unless",
         "whether", "than", "as")
AUX = ("is", "are", "was", "were", "be", "been", "being", "am", "have", "has",
       "had", "do", "does", "did", "will", "would", "can", "could", "shall",
       "should", "may", "might", "must")
PART = ("not", "to", "s")
ADJ = ("great", "good", "bad", "loud", "quiet", "new", "old", "big", "small",
       "nice", "fast", "slow", "cheap", "high", "low", "easy", "hard")
ADV = ("very", "too", "so", "just", "also", "well", "never", "always", "often",
       "here", "there", "now", "then", "again")
SUFFIX_RULES = (
    ("^\\p{N}+$", "NUM"),
    ("ly$", "ADV"),
    ("(ing|ed)$", "VERB"),
    ("(ous|ful|able|ible|ive|less|al|ic)$", "ADJ"),
)
DEFAULT_TAG = "NOUN"

WORD_CLASSES = (("DET", DET), ("PRON", PRON), ("ADP", ADP), ("CCONJ", CCONJ),
                ("SCONJ", SCONJ), ("AUX", AUX), ("PART", PART), ("ADJ", ADJ),
                ("ADV", ADV))


def pos_tag(term: Column) -> Column:
    """Universal POS tag of a lowercase word: word lists first, then suffixes."""
    expr = None
    for tag, words in WORD_CLASSES:
        cond = term.isin(list(words))
        expr = F.when(cond, F.lit(tag)) if expr is None else expr.when(cond, F.lit(tag))
    for pattern, tag in SUFFIX_RULES:
        expr = expr.when(term.rlike(pattern), F.lit(tag))
    return expr.otherwise(F.lit(DEFAULT_TAG))


def pos_tag_sql(term: str) -> str:
    """The same rules as a DuckDB ``CASE`` expression (oracle side)."""
    from loupe.plans.sqltext import sql_list
    parts = [f"WHEN {term} IN {sql_list(words)} THEN '{tag}'" for tag, words in WORD_CLASSES]
    parts += [f"WHEN regexp_matches({term}, '{p}') THEN '{tag}'" for p, tag in SUFFIX_RULES]
    return "CASE " + " ".join(parts) + f" ELSE '{DEFAULT_TAG}' END"
