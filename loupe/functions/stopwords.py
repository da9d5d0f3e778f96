"""Stop-word list used by the unigram term frequencies.

The default list is Spark MLlib's English list
(``StopWordsRemover.loadDefaultStopWords("english")``), kept here as text so
the oracle SQL and executors need no JVM call to obtain it.
"""

from __future__ import annotations

# Spark MLlib's English stop words, in the library's order.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "should", "now", "i'll", "you'll", "he'll",
    "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd",
    "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're",
    "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought",
    "that's", "there's", "what's", "when's", "where's", "who's", "why's",
    "would",
)


def as_list(words) -> list[str]:
    """Accept None, one word, or an iterable of words."""
    if words is None:
        return []
    if isinstance(words, str):
        return [words]
    return list(words)


def stop_words_for(n: int, use_stem: bool, additional=None) -> list[str]:
    """Built-in words apply only to plain unigrams; extra words apply always."""
    base = list(ENGLISH_STOP_WORDS) if (n == 1 and not use_stem) else []
    return sorted(set(base) | set(as_list(additional)))
