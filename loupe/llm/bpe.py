"""BPE encoding with a public tokenizer's merges, and decoding.

Text is normalised (NFC, white space runs to one space, lower case), split by
the tokenizer's pattern, mapped byte by byte to its symbols, and merged: a
priority queue holds the ranks of adjacent pairs over a doubly linked list of
symbols; entries that a merge made stale are skipped when they come up. Words
met before are answered from a bounded cache of the Python worker. Decoding
concatenates vocabulary strings; this tokenizer file has no decoder, so the
library joins them by spaces, and so does this one.

Which characters are letters, numbers or white space, and how texts are normalised,
depends on a library's Unicode version. The tokenizers library is asked for its
classes once, on the driver; a text with a character that is classed otherwise here,
or not assigned, is normalised by the library and split by its classes. Splitting,
merging and decoding are done here.

Only ``word_bpe_49k.json``-like files are read (BPE with an end-of-word suffix).
Special tokens in a text are matched before normalising, as the library does.
Null counts as empty: no tokens, empty decoded text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from itertools import chain

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm import common as C

CACHE_WORDS = 200_000  # of each of two generations
SLICE_ROWS = 500  # rows whose tokens a task holds at once

# fixed values: the byte alphabet of byte-level BPE (printable bytes stand for themselves, the others follow from 256 on)
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_symbols() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in _PLAIN else chr(next(rest)) for b in range(256)]


# classes of the split pattern, and what they are to ``regex``, whose \s has separators that are not White_Space
CLASSES = {r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}", r"\s": r"\p{White_Space}"}
_PLANES = range(0x40000)  # no version of Unicode has letters, numbers or white space beyond


def _ranges(points: list[int]) -> str:
    """Code points as ranges of a pattern's set."""
    ends: list[list[int]] = []
    for c in points:
        if ends and ends[-1][1] == c - 1:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends)


@functools.cache
def odd_points() -> dict[str, tuple[str, str]]:
    """Of each class the code points that it has in the library's Unicode version alone, and in that of ``regex`` alone."""
    everything = "".join(chr(c) for c in _PLANES if not 0xD800 <= c < 0xE000)
    out = {}
    for name in CLASSES:
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(f"{name}+"), "removed", invert=True)
        theirs = {ord(c) for part, _ in split.pre_tokenize_str(everything) for c in part}
        ours = {ord(c) for c in regex.findall(CLASSES[name], everything)}
        out[name] = (_ranges(sorted(theirs - ours)), _ranges(sorted(ours - theirs)))
    return out | {"unassigned": (_ranges([ord(c) for c in everything if unicodedata.category(c) == "Cn"]), "")}


class Tokenizer:
    def __init__(self, path: str, odd: dict[str, tuple[str, str]] | None = None):
        odd = odd or odd_points()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.unknown = 1 << 31  # symbols from here on are not in the vocabulary and give no id
        symbol = lambda s: self.vocab.get(s, self.unknown)
        # pair of symbols -> its rank and the symbol it becomes
        self.merges = {symbol(a) << 32 | symbol(b): (rank, symbol(a + b)) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.first, self.last = [symbol(c) for c in _byte_symbols()], [symbol(c + suffix) for c in _byte_symbols()]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.strings = [""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for s, i in [*self.vocab.items(), *special.items()]:
            self.strings[i] = s
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.normaliser = tokenizers.Tokenizer.from_file(path).normalizer
        usual, exact = split["pattern"]["Regex"], split["pattern"]["Regex"]
        for name, ours in CLASSES.items():
            usual = usual.replace(name, ours)
            more, less = odd[name]
            exact = exact.replace(name, f"[{ours}{more}]" + (f"--[{less}]" if less else "")) if more or less else exact.replace(name, ours)
        # few texts have one: most are settled by a bitmap of the first plane and not having a character beyond it
        every = "".join(x for pair in odd.values() for x in pair)
        self.odd = re.compile(f"[{every}]")
        self.odd_first_plane = re.compile("[" + "".join(re.findall(r"\\U0000\w{4}-\\U0000\w{4}", every)) + "]")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.pattern, self.exact = regex.compile(usual), regex.compile(exact, regex.V1)
        self.ascii_pattern = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # words met since the last change of generation, and those met in the generation before
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        # white space only parts words: that runs of it become one blank changes none
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        if self.odd_first_plane.search(text) or self.beyond.search(text) and self.odd.search(text):
            return self.exact.findall(self.normaliser.normalize_str(text))
        text = unicodedata.normalize("NFC", text)
        # character by character: no final sigma rule
        return self.pattern.findall(text.lower() if "Σ" not in text else "".join(c.lower() for c in text))

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, by merges in order of rank and place."""
        first, merges = self.first, self.merges
        raw = word.encode("utf-8")
        sym = [first[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is the rank of a pair and the place of its left symbol
        heap = [m[0] << 32 | i for i in range(n - 1) if (m := merges.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = nxt[i]
            if j >= n or sym[i] < 0 or (m := merges.get(sym[i] << 32 | sym[j])) is None or m[0] != entry >> 32:
                continue  # stale: one of the two symbols has been merged
            sym[i], sym[j] = m[1], -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (m := merges.get(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(heap, m[0] << 32 | i)
            h = prev[i]
            if h >= 0 and (m := merges.get(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(heap, m[0] << 32 | h)
        return tuple(s for s in sym if 0 <= s < self.unknown)

    def missed(self, w: str) -> tuple[int, ...]:
        """Ids of a word that this generation of the cache has not met."""
        ids = self.older.get(w)
        if ids is None:
            ids = self.word(w)
        if len(w) <= 40:
            if len(self.cache) >= CACHE_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[w] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.parts.split(text) if self.parts else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            words = self.words(part)
            found = list(map(self.cache.get, words))
            if None in found:
                found = [self.missed(w) if ids is None else ids for w, ids in zip(words, found)]
            out.extend(chain.from_iterable(found))
        return out

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, Tokenizer] = {}


def load(path: str, odd: dict[str, tuple[str, str]] | None = None) -> Tokenizer:
    if path not in _LOADED:  # one for each Python worker
        _LOADED[path] = Tokenizer(path, odd)
    return _LOADED[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _coder(name: str, want: tuple[str, ...]):
    odd = odd_points()  # found once, on the driver

    def code(batches):
        tok = load(name if "/" in name else vocabulary_path(name), odd)
        for b in (whole.slice(i, SLICE_ROWS) for whole in batches for i in range(0, whole.num_rows, SLICE_ROWS)):
            cols = {k: [] for k in want}
            for t in b.column("text"):
                ids = tok.encode(t.as_py() or "")
                if "n_tokens" in cols:
                    cols["n_tokens"].append(len(ids))
                if "ids" in cols:
                    cols["ids"].append(ids)
                if "ids_sha256" in cols:
                    raw = array("I", ids)
                    cols["ids_sha256"].append(hashlib.sha256(raw.tobytes()).hexdigest())
                if "decoded" in cols or "decoded_sha256" in cols:
                    back = tok.decode(ids)
                    if "decoded" in cols:
                        cols["decoded"].append(back)
                    if "decoded_sha256" in cols:
                        cols["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(cols[k], kinds.get(k, pa.string())) for k in want)],
                                             names=["doc_id", *want])
    return code


_TYPES = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
               want: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``doc_id`` and, of every whole text, the columns named in ``want``.

    ``tokenizer`` is a path, or the name of a file of the installed public
    vocabularies. ``decoded`` is decoded from the ids, not copied from the text.
    """
    C.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_coder(tokenizer, want), "doc_id long, " + ", ".join(f"{k} {_TYPES[k]}" for k in want))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded, and decoded again from its ids."""
    return round_trip(C.table(spark, sf_dir, "documents"), want=("n_tokens", "ids_sha256", "decoded_sha256"))
