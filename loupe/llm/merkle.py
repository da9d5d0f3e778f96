"""Merkle manifest of a table: leaf and tree digests, proofs, and verification.

A leaf is the digest of a row's fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and its value. Per group (``source``), leaves ascend by id; while a
level has more than one node, each run of ``FAN`` consecutive nodes (the last run
may be shorter, even one node) becomes the digest of their digests. The group's
last node is its subroot; subroots, ordered by group (null first, then by bytes),
make the root in the same way. A row's proof is its path: per level the digests
left and right of its node in the run.

Rows are sorted by ranges of (group, id, leaf), numbered by partition offsets, and
cut into blocks of ``FAN ** LEVELS`` positions, so no window holds more than one
block however many rows a group has. Within a block all levels are columns of the
leaf rows: the node of level k stands on the first row of its ``FAN ** k`` rows, its
siblings are lag and lead columns at multiples of that offset, masked by the node's
slot and the length of its run, and first-child rows hash the parent. Paths then go
down by lags masked by slot. Block roots are the rows of the next, ``FAN ** LEVELS``
times smaller, table; after the last one its paths are joined back.

Null ids come first and are never tampered with; rows with equal ids are ordered by
leaf, and rows alike in all fields are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm import common as C

FAN, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l:string,r:string>>"


def digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*cols).cast("binary"), 256)


def field(col: Column) -> Column:
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def number(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``gid`` (place of its group), ``pos`` in the group and ``n``, the group's size; no group meets in a task."""
    ranged = C.keep(rows.withColumn("salt", F.monotonically_increasing_id())
                    .repartitionByRange(C.n_parts(rows.count(), 200_000), group, *order, "salt").sortWithinPartitions(group, *order, "salt")
                    .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("salt"))
    # one row for each group in each partition that holds some of it
    pieces = ranged.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(group).orderBy("part")
    pieces = C.keep(pieces.withColumn("off", F.sum("c").over(before) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy(group))))
    if group == "gid":
        return _placed(ranged, pieces, group)
    return _placed(ranged, pieces.join(_group_ids(pieces, group), pieces[group].eqNullSafe(F.col("key"))).drop("key"), group)


def _group_ids(pieces: DataFrame, group: str) -> DataFrame:
    """``key``, ``gid``: ids in the order of the groups (not dense)."""
    groups = pieces.where("off = 0").select(F.col(group).alias("key"))
    return C.keep(groups.orderBy("key").withColumn("gid", F.monotonically_increasing_id()))


def _placed(ranged: DataFrame, pieces: DataFrame, group: str) -> DataFrame:
    p = pieces.select(F.col(group).alias("p_group"), F.col("part").alias("p_part"), "first", "off", "n", *(["gid"] if group != "gid" else []))
    on = ranged[group].eqNullSafe(p["p_group"]) & (ranged["part"] == p["p_part"])
    out = ranged.join(p, on).withColumn("pos", F.col("at") - F.col("first") + F.col("off"))
    return out.drop("p_group", "p_part", "first", "off", "part", "at")


def _level(k: int) -> tuple[Column, Column, Column]:
    """Nodes of the level in the whole group, slot of the row's node in its run, and the nodes in that run."""
    nodes = F.ceil(F.col("n") / F.lit(FAN ** k))
    at = F.floor(F.col("pos") / F.lit(FAN ** k))
    return nodes, at % FAN, F.least(F.lit(FAN), nodes - (at - at % FAN))


def block_paths(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (gid, pos, n, node) with ``path`` inside their block and, on a block's first row, its root as ``top``."""
    size = FAN ** levels
    df = rows.withColumn("block", F.floor(F.col("pos") / size)).withColumn("h0", F.col("node"))
    w = Window.partitionBy("gid", "block").orderBy("pos")
    for k in range(levels):  # upwards: siblings of the nodes of level k, and on first children the parent
        step = FAN ** k
        nodes, slot, run = _level(k)
        stands = (F.col("pos") % step == 0) & (nodes > 1)
        near = {d: (F.lead if d > 0 else F.lag)(f"h{k}", abs(d) * step).over(w) for d in range(1 - FAN, FAN) if d}
        df = df.withColumns({f"near{d}": x for d, x in near.items()})
        left = [F.when(F.lit(-d) <= slot, F.col(f"near{d}")) for d in range(1 - FAN, 0)]
        right = [F.when(slot + d < run, F.col(f"near{d}")) for d in range(1, FAN)]
        joined = lambda cols: F.concat(*(F.coalesce(c, F.lit("")) for c in cols))
        df = df.withColumn(f"s{k}", F.when(stands, F.struct(joined(left).alias("l"), joined(right).alias("r"))))
        parent = F.when(nodes > 1, digest(F.col(f"s{k}.l"), F.col(f"h{k}"), F.col(f"s{k}.r"))).otherwise(F.col(f"h{k}"))
        df = df.withColumn(f"h{k + 1}", F.when(F.col("pos") % (step * FAN) == 0, parent)).drop(*(f"near{d}" for d in near))
    df = df.withColumn("path", F.when(F.col("pos") % size == 0, F.expr(f"CAST(array() AS {_PATH})")))
    for k in reversed(range(levels)):  # downwards: a node's path is its siblings and the path of its parent's row
        step = FAN ** k
        _, slot, _ = _level(k)
        up = reduce(lambda a, j: a.when(slot == j, F.lag("path", j * step).over(w)), range(1, FAN), F.when(slot == 0, F.col("path")))
        df = df.withColumn("up", F.when(F.col("pos") % step == 0, up))
        df = df.withColumn("path", F.when(F.col(f"s{k}").isNotNull(), F.concat(F.array(f"s{k}"), "up")).otherwise(F.col("up")))
    return df.withColumn("top", F.col(f"h{levels}")).drop("up", "h0", *(f"h{k + 1}" for k in range(levels)), *(f"s{k}" for k in range(levels)))


def paths(rows: DataFrame, most: int, levels: int = LEVELS) -> DataFrame:
    """Rows (gid, pos, n, node, ...) with ``path`` up to their group's last node, and that node as ``top``; no group has over ``most`` rows."""
    inner = C.keep(block_paths(rows, levels))
    size = FAN ** levels
    if most <= size:
        tops = inner.where("pos = 0").select(F.col("gid").alias("t_gid"), F.col("top").alias("t_top"))
        return inner.drop("top", "block").join(tops, F.col("gid") == F.col("t_gid")).drop("t_gid").withColumnRenamed("t_top", "top")
    blocks = inner.where(F.col("top").isNotNull()).select("gid", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
    outer = paths(blocks, -(-most // size), levels).select(F.col("gid").alias("o_gid"), F.col("pos").alias("o_pos"), F.col("path").alias("o_path"), F.col("top").alias("o_top"))
    joined = inner.drop("top").join(outer, (F.col("gid") == F.col("o_gid")) & (F.col("block") == F.col("o_pos")))
    return joined.withColumn("path", F.concat("path", "o_path")).withColumn("top", F.col("o_top")).drop("o_gid", "o_pos", "o_path", "o_top", "block")


def _most(rows: DataFrame) -> int:
    return int(rows.agg(F.max("n")).first()[0] or 0)


def manifest(leaves: DataFrame, group: str, *order: str, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (group, order columns, node, ...) with gid, pos, n, ``subroot``, ``root`` and ``path`` from the leaf to the root."""
    C.prepare(leaves.sparkSession)
    rows = C.keep(number(leaves, group, *order, "node"))
    inner = C.keep(paths(rows, _most(rows), levels).withColumnRenamed("top", "subroot"))
    subs = inner.where("pos = 0").select(F.col("gid").alias("part_of"), F.col("subroot").alias("node"), F.lit(0).cast("long").alias("gid"))
    subs = C.keep(number(subs, "gid", "part_of"))
    outer = paths(subs, _most(subs), levels).select("part_of", F.col("path").alias("o_path"), F.col("top").alias("root"))
    out = inner.join(outer, F.col("gid") == F.col("part_of")).withColumn("path", F.concat("path", "o_path"))
    return out.drop("part_of", "o_path")


def proof(path: Column) -> Column:
    """Digest of all sibling digests of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has by a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))


def verify(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, group: str = "source", levels: int = LEVELS) -> DataFrame:
    """Manifest of ``docs``, and what its proofs say of rows whose text became ``tampered``.

    ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row; all but the last two are of the rows as they are.
    """
    was = {f: F.col(f) for f in fields}
    leaves = docs.select(F.col("doc_id"), F.col(group).cast("string").alias("grp"),
                         digest(*(field(c) for c in was.values())).alias("node"),
                         digest(*(field(c) for c in (was | {"text": tampered}).values())).alias("now"))
    m = manifest(leaves, "grp", "doc_id", levels=levels)
    out = m.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaves, tree digests and proofs of all rows of ``documents``; rows of even crc32 are verified without their line ends."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verify(C.table(spark, sf_dir, "documents"), tampered)


def _sql_field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


# the lowest bit of a crc32, bit by bit over the bytes of a decimal number
_CRC = ("list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
        "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))")
_LEAF = "sha256(" + " || ".join(map(_sql_field, FIELDS)) + ")"

SQL = {"op11_merkle": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF} AS leaf, {_LEAF.replace("text", "cut")} AS now,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT *, CASE WHEN {_CRC} % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents)),
up AS (SELECT source, 0 AS k, pos, leaf AS h, n FROM d
  UNION ALL SELECT source, k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM up WHERE n > 1 GROUP BY source, k, pos // 3),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS k, pos, subroot AS h, n FROM subs
  UNION ALL SELECT k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY k, pos // 3),
runs AS (SELECT source, k, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL),
tops AS (SELECT k, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
f AS (SELECT doc_id, source, leaf, 0 AS k, pos, now AS h, '' AS proof FROM d
  UNION ALL SELECT doc_id, f.source, leaf, f.k + 1, pos // 3,
    sha256(array_to_string(hs[:pos % 3], '') || h || array_to_string(hs[pos % 3 + 2:], '')),
    proof || array_to_string(hs[:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '')
  FROM f JOIN runs ON f.source IS NOT DISTINCT FROM runs.source AND f.k = runs.k AND pos // 3 = run),
g AS (SELECT doc_id, leaf, subroot, 0 AS k, subs.pos, h, proof
  FROM (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id)) x JOIN subs ON x.source IS NOT DISTINCT FROM subs.source
  UNION ALL SELECT doc_id, leaf, subroot, g.k + 1, pos // 3,
    sha256(array_to_string(hs[:pos % 3], '') || h || array_to_string(hs[pos % 3 + 2:], '')),
    proof || array_to_string(hs[:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '')
  FROM g JOIN tops ON g.k = tops.k AND pos // 3 = run)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM (SELECT * FROM g QUALIFY k = max(k) OVER (PARTITION BY doc_id)), (SELECT h AS root FROM top WHERE n = 1)"""}
