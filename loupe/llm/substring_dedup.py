"""Suffix-array dedup of repeated byte strings by bucket-pointer refinement.

A byte is removed when a ``LENGTH``-byte string (50) that covers it also starts
in a document with a smaller ``doc_id``. Suffixes start in buckets of equal
q-grams; buckets are refined by the bucket identifiers of later offsets until
they hold equal 50-byte strings. Identifiers are content hashes, so buckets
refine without one global sort, and three steps keep the data small:

1. *q-gram buckets.* Of each 50-byte window only the suffix at its minimal
   16-gram takes part (equal windows choose equal offsets). All windows that start
   near that place hold the same 33 bytes from it on, all others the same 33 bytes
   before its end. Groups of documents send the sorted identifiers of these strings,
   packed, to ranges of identifiers; the reply says which occur in another group.
   Windows whose 33 bytes are in one document are done: unlike 16-grams, few of
   these strings are shared by chance, so what is left does not outgrow the input.
2. *Super-windows.* Neighbouring windows that share a bucket form one string; a
   bucket is refined by that string's identifier. One smallest document per
   refined bucket settles all windows of its other members at once.
3. *Windows.* Only what differs within a bucket is refined to single 50-byte
   windows: identifiers of 16 bytes at i and i+16 name 32 bytes, those of 32
   bytes at i and i+18 name 50, each level reusing the one below. Again groups
   first ask, packed, which identifiers others hold; the rest is done.

Whole texts that equal one with a smaller id are removed as one span before all
this (by two 64-bit hashes and the length), so copies add nothing to the steps.

Every group sends a refined bucket once however many of its documents hold it, so a
passage in a third of all documents is a few rows per group. A bucket of one q-gram,
which many unlike strings can share, is never in one task: its refined buckets are
dealt by both identifiers, and whether it has several is a partial aggregate that is
joined back.

Null texts count as empty. A null ``doc_id`` is smaller than none and none is
smaller than it: such rows lose nothing. Rows with equal ``doc_id`` never
remove bytes from each other; each input row gives one output row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm import common as C

LENGTH = 50
Q = 16
SPAN = LENGTH - Q + 1  # q-grams in a window
NEAR = SPAN // 2  # windows that start so many bytes before their minimal q-gram at most hold LENGTH - NEAR bytes from it on
_NONE = 255

_ROWS = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int32()),
                   ("at", pa.int32()), ("n", pa.int32()), ("kind", pa.int8()), ("g", pa.int32())])
_ROWS_DDL = "k long, s long, doc_id long, row int, at int, n int, kind byte, g int"
ASK, SPANS = 0, 1


def _group(tab: pa.Table):
    """The group's rows in a fixed order: ids (null: row takes no part), bytes, offsets."""
    tab = _sorted(tab)
    data, offs = C.string_buffers(tab["text"])
    live = tab["doc_id"].is_valid().to_numpy()
    ids = tab["doc_id"].fill_null(0).to_numpy().astype(np.int64)
    return ids, live, data, offs


def _skip_copies(live, tab: pa.Table, copies: pa.Table):
    """(rows that are copies, rows that take part in the steps); ``tab`` is in the order of _group."""
    known = set(zip(copies["doc_id"].to_pylist(), copies["h"].to_pylist()))
    copy = np.fromiter(((d, h) in known for d, h in zip(tab["doc_id"].to_pylist(), tab["h"].to_pylist())), bool, len(tab))
    return copy, live & ~copy


def _sorted(tab: pa.Table) -> pa.Table:
    return tab.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _runs(live, data, offs):
    """Super-windows: first window start, q-gram identifier, numbers of windows far from and near the q-gram, identifier of the bytes that each of the two share."""
    n = len(data)
    lens = np.diff(offs)
    found = []
    chunk = 1 << 19
    room = np.repeat(np.where(live, offs[1:], -1), lens)  # end of the row that a byte belongs to
    for c in range(0, n, chunk):
        seg = data[c:c + chunk + LENGTH - 1]
        if len(seg) < LENGTH:
            break
        h = C.gram_hashes(seg, Q)
        v = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= SPAN:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        m = len(seg) - LENGTH + 1
        v = np.minimum(v[:m], v[SPAN - size:SPAN - size + m])
        pos = (v & np.uint64(0xFFFFFF)).astype(np.int64)
        ok = room[c:c + m] >= np.arange(c + LENGTH, c + LENGTH + m)
        pos = np.where(ok, pos, -1)
        new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        size = np.diff(np.append(new, m))
        good = pos[new] >= 0
        new, size, pos = new[good], size[good], pos[new[good]]
        far = np.clip(pos - NEAR - new, 0, size)

        def shared(at, some):
            at = np.where(some > 0, at, 0)
            return C.mix(C.mix(h[at] * C.M1 + h[at + Q]) * C.M2 + seg[at + 2 * Q])

        found.append((new + c, h[pos], far, size - far, shared(pos - NEAR, far), shared(pos, size - far)))
    if not found:
        z, u = np.empty(0, np.int64), np.empty(0, np.uint64)
        return z, u, z, z, u, u
    return tuple(np.concatenate(x) for x in zip(*found))


def _known(keys: np.ndarray, docs: np.ndarray):
    """Sorted distinct keys, the index of each input key in them, and which occur with two ids."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    at = np.flatnonzero(new)
    uniq = k[at]
    idx = np.empty(len(k), np.int64)
    idx[order] = np.cumsum(new) - 1
    multi = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at) if len(k) else np.empty(0, bool)
    return uniq, idx, multi


def _ask(n_ranges: int, bits: int):
    def ask(tab: pa.Table, copies: pa.Table) -> pa.Table:
        ids, live, data, offs = _group(tab)
        _, live = _skip_copies(live, _sorted(tab), copies)
        _, _, far, near, before, after = _runs(live, data, offs)
        return _asked(tab["g"][0].as_py(), np.concatenate([before[far > 0], after[near > 0]]), n_ranges, bits)
    return ask


def _asked(g: int, names: np.ndarray, n_ranges: int, bits: int) -> pa.Table:
    uniq = np.unique(names >> np.uint64(64 - bits))
    parts = C.asks(uniq << np.uint64(48 - bits), n_ranges)
    return pa.table({"g": pa.array([g] * len(parts), pa.int32()), "r": pa.array([p[0] for p in parts], pa.int32()),
                     "keys": pa.array([C.pack(uniq[i:j], 6) for _, i, j in parts], pa.binary())})


def _shared(names: np.ndarray, docs: np.ndarray, replies: pa.Table, n_ranges: int, bits: int) -> np.ndarray:
    """Which names occur with two ids, in this group or by the replies; by their first ``bits`` bits, so a few others too."""
    uniq, idx, multi = _known(names >> np.uint64(64 - bits), docs)
    told = {r: b for r, b in zip(replies["r"].to_pylist(), replies["bits"].to_pylist()) if r is not None}
    for r, i, j in C.asks(uniq << np.uint64(48 - bits), n_ranges):
        multi[i:j] |= np.unpackbits(np.frombuffer(told[r], np.uint8), count=j - i).astype(bool)
    return multi[idx]


def _reply(tab: pa.Table) -> pa.Table:
    blobs = [C.unpack(b.as_py(), 6) for b in tab["keys"]]
    _, inv, cnt = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    many = cnt[inv] > 1
    out, at = [], 0
    for b in blobs:
        out.append(np.packbits(many[at:at + len(b)]).tobytes())
        at += len(b)
    return pa.table({"g": tab["g"], "r": tab["r"], "bits": pa.array(out, pa.binary())})


def _out(k, s, doc, row, at, n, kind, g) -> pa.Table:
    m = len(doc)
    return pa.table([pa.array(k.view(np.int64)), pa.array(s.view(np.int64)), pa.array(doc, pa.int64()),
                     pa.array(row.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(kind.astype(np.int8)), pa.array(np.full(m, g, np.int32))], schema=_ROWS)


def _settle(k, s, doc):
    """kind of each string: SPANS where the group itself holds it with a smaller id, else ASK."""
    if not len(k):
        return np.empty(0, np.int8)
    order = np.lexsort((doc, s, k))
    new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (s[order][1:] != s[order][:-1])])
    least = np.empty(len(k), np.int64)
    at = np.flatnonzero(new)
    least[order] = np.repeat(doc[order][at], np.diff(np.append(at, len(k))))
    return np.where(doc > least, SPANS, ASK).astype(np.int8)


def _pieces(g: int, k, s, doc, row, at, n, kind) -> pa.Table:
    """One row per string, in the order of the text; settled neighbours are one row.

    Settled rows need no meeting place: they are dealt out evenly, by stretches of a row's text.
    """
    order = np.lexsort((at, row))
    k, s, doc, row, at, n, kind = (x[order] for x in (k, s, doc, row, at, n, kind))
    settled = kind == SPANS
    first = np.ones(len(k), bool)
    first[1:] = ~settled[1:] | ~settled[:-1] | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + n[:-1])
    begin = np.flatnonzero(first)
    n = np.add.reduceat(n, begin) if len(begin) else n
    k, s, doc, row, at, kind, settled = (x[begin] for x in (k, s, doc, row, at, kind, settled))
    place = C.mix((np.uint64(g) << np.uint64(40)) ^ (row.astype(np.uint64) << np.uint64(16)) ^ (at.astype(np.uint64) >> np.uint64(12)))
    return _out(np.where(settled, place, k), np.where(settled, np.uint64(0), s), doc, row, at, n, kind, g)


def _super_windows(n_ranges: int, bits: int):
    def refine(tab: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(tab):
            return _ROWS.empty_table()
        g = tab["g"][0].as_py()
        ids, live, data, offs = _group(tab)
        copy, live = _skip_copies(live, _sorted(tab), replies.filter(replies["r"].is_null()))
        first, key, far, near, before, after = _runs(live, data, offs)
        row = np.searchsorted(offs, first, "right") - 1
        a, b = np.flatnonzero(far), np.flatnonzero(near)
        told = _shared(np.concatenate([before[a], after[b]]), ids[row[np.concatenate([a, b])]], replies, n_ranges, bits)
        # the windows that go on: all of a super-window, the far or the near ones
        first[a] += np.where(told[:len(a)], 0, far[a])
        far[a] *= told[:len(a)]
        near[b] *= told[len(a):]
        keep = far + near > 0
        at, n, key, row = first[keep], (far + near)[keep], key[keep], row[keep]
        view = memoryview(np.ascontiguousarray(data))
        s = np.fromiter((xxhash.xxh3_64_intdigest(view[a:a + m]) for a, m in zip(at.tolist(), (n + LENGTH - 1).tolist())), np.uint64, len(at))
        doc = ids[row]
        kind = _settle(key, s, doc)
        at = at - offs[row]
        whole = np.flatnonzero(copy & (np.diff(offs) >= LENGTH))
        zero = np.zeros(len(whole), np.uint64)
        spans = np.full(len(whole), SPANS, np.int8)
        return pa.concat_tables([
            _pieces(g, key, s, doc, row, at, n, kind),
            _pieces(g, zero, zero, ids[whole], whole, zero.astype(np.int64), np.diff(offs)[whole] - LENGTH + 1, spans)])
    return refine


def _named(ids, data, offs, found: pa.Table):
    """Identifiers (two hashes), row and place of each window of the strings to refine."""
    rw, aw, nw = (found[c].to_numpy().astype(np.int64) for c in ("row", "at", "n"))
    size = nw + LENGTH - 1
    begin = np.cumsum(size) - size
    text = data[np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(offs[rw] + aw, size)]
    i = np.arange(nw.sum()) - np.repeat(np.cumsum(nw) - nw, nw)
    here, names = i + np.repeat(begin, nw), []
    for seed in (1, 2):
        b16 = C.gram_hashes(text, Q, seed)
        b32 = C.mix(b16[:-Q] * C.M1 + b16[Q:])
        names.append(C.mix(b32[:-(LENGTH - 2 * Q)] * C.M2 + b32[LENGTH - 2 * Q:])[here])
    return names[0], names[1], np.repeat(rw, nw), np.repeat(aw, nw) + i


def _ask_windows(n_ranges: int, bits: int):
    def ask(tab: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found):
            return _asked(0, np.empty(0, np.uint64), n_ranges, bits)
        ids, live, data, offs = _group(tab)
        return _asked(tab["g"][0].as_py(), _named(ids, data, offs, found)[0], n_ranges, bits)
    return ask


def _windows(n_ranges: int, bits: int):
    def refine(tab: pa.Table, found: pa.Table) -> pa.Table:
        todo = found.filter(found["r"].is_null())
        if not len(todo):
            return _ROWS.empty_table()
        g = tab["g"][0].as_py()
        ids, live, data, offs = _group(tab)
        k, s, row, at = _named(ids, data, offs, todo)
        keep = _shared(k, ids[row], found.filter(found["r"].is_valid()), n_ranges, bits)
        k, s, row, at = k[keep], s[keep], row[keep], at[keep]
        return _pieces(g, k, s, ids[row], row, at, np.ones(len(k), np.int64), _settle(k, s, ids[row]))
    return refine


def _remove(with_kept: bool):
    def remove(tab: pa.Table, spans: pa.Table) -> pa.Table:
        ids, live, data, offs = _group(tab)
        tab = tab.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        diff = np.zeros(len(data) + 1, np.int32)
        if len(spans):
            row, at, n = (spans[c].to_numpy().astype(np.int64) for c in ("row", "at", "n"))
            np.add.at(diff, offs[row] + at, 1)
            np.subtract.at(diff, offs[row] + at + n + LENGTH - 1, 1)
        gone = np.cumsum(diff[:-1]) > 0
        removed, runs, sha, kept = [], [], [], []
        for i in range(len(ids)):
            a, b = offs[i], offs[i + 1]
            cut = gone[a:b]
            left = data[a:b][~cut].tobytes()
            removed.append(int(cut.sum()))
            runs.append(int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        cols = {"doc_id": tab["doc_id"], "n_bytes": pa.array(np.diff(offs), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))
    return remove


def _least(rows: DataFrame) -> DataFrame:
    """Adds the smallest doc_id of the refined bucket (k, s)."""
    return rows.withColumn("least", F.min("doc_id").over(Window.partitionBy("k", "s")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 4_000_000,
                   range_keys: int = 400_000, with_kept: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` per row of ``docs``.

    ``group_bytes`` and ``range_keys`` bound what a task holds at once (bytes of
    text, bucket identifiers); the numbers of groups and ranges follow the
    input. ``kept`` holds the remaining bytes (they need not be valid UTF-8).
    """
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = C.total_bytes(docs)
    n_groups, n_ranges = C.n_parts(size, group_bytes), C.n_parts(1.5 * size / (SPAN / 2), range_keys)
    # asks only sort out what can't repeat: 16 times as many names as windows keep chance hits few
    bits = min(48, max(24, size.bit_length() + 4))
    text = C.grouped(docs.withColumn("h", F.xxhash64("text")), n_groups, "doc_id", "text")
    by_g = text.groupBy("g")
    slim = text.where("doc_id is not null").select("g", "doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("n"))
    first = slim.groupBy("h", "h2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    copies = C.keep(slim.join(C.keep(first, free=True).hint("merge"), ["h", "h2", "n"]).where("doc_id > first").select("g", "doc_id", "h"), free=True)
    asked = by_g.cogroup(copies.groupBy("g")).applyInArrow(_ask(n_ranges, bits), "g int, r int, keys binary")
    replies = asked.groupBy("r").applyInArrow(_reply, "g int, r int, bits binary").unionByName(copies, allowMissingColumns=True)
    pieces = by_g.cogroup(replies.groupBy("g")).applyInArrow(_super_windows(n_ranges, bits), _ROWS_DDL)
    # the pieces are made and dealt once: their strings are settled here, and only what is left keeps its bucket
    done = (F.col("kind") == SPANS) | (F.col("least") < F.col("doc_id"))
    span = ["g", "row", "at", "n"]
    # texts are dealt to their groups again after this, so the shuffle files of the first steps go
    told = C.keep(_least(pieces.repartition("k", "s")).select(*span, *[F.when(~done, F.col(c)).alias(c) for c in ("k", "least")]), free=True)
    # refined buckets of a q-gram bucket: those of several are told apart by their windows; a bucket's first document is always left
    left = told.where("k is not null")
    mixed = left.groupBy("k").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("high > low").select("k")
    todo = left.join(mixed.hint("merge"), "k", "left_semi").select(*span)
    held = (by_g.cogroup(todo.groupBy("g")).applyInArrow(_ask_windows(n_ranges, bits), "g int, r int, keys binary")
            .groupBy("r").applyInArrow(_reply, "g int, r int, bits binary"))
    single = by_g.cogroup(todo.unionByName(held, allowMissingColumns=True).groupBy("g")).applyInArrow(_windows(n_ranges, bits), _ROWS_DDL)
    spans = (_least(single).where((F.col("kind") == SPANS) | (F.col("least") < F.col("doc_id"))).select(*span)
             .unionByName(told.where("k is null").select(*span)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return by_g.cogroup(spans.groupBy("g")).applyInArrow(_remove(with_kept), schema + ", kept binary" * with_kept)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes removed from every whole text of ``documents`` as repeated 50-byte strings."""
    return remove_repeats(C.table(spark, sf_dir, "documents"))
