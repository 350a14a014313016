"""Sharding by a hierarchical weighted hash tree, in SQL functions only.

A tree holds regions, regions hold racks, racks hold shards; a node weighs
what its shards weigh.  A key descends: at each level every child draws an
exponential variate from a hash of the key and the child's name, divided by
its weight, and the least draw wins.  A child's draw depends on the key, its
own name and its own weight only, so

* a changed weight moves keys only into (or out of) the nodes on the path to
  it: keys that stay in other subtrees keep their shards, and
* a new region of its own takes keys only into itself.  ``grown`` therefore
  adds a shard as a region; ``weighed`` changes a weight in place.

The law of the placing is ``key``: the id and the tree decide, not the other
rows.  Slots number the rows of each shard without gaps: equal rows are
counted first and cut into chunks, chunks are dealt to buckets by a hash, the
bucket sizes (a table whose size the parameters fix) give each bucket's first
slot, and a window numbers the chunks inside a bucket; so neither a hot id nor
a hot text meets in one task, and what an executor loses is computed again alike.

Results per case: a null text has size 1 and the checksum of the empty text;
an empty text too; a null id is a key of its own; repeated rows go to the
same shard in neighbouring slots of a chunk; texts of any length count whole;
equal draws (hash ties) go to the child named first; an empty table gives an
empty result; columns other than the id and the text are not read by ``place``
and are kept by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.llm import common as C

SHARDS = 16
RACKS, PER_RACK = 2, 2          # racks of a region, shards of a rack
SLOT_BUCKETS = 1024
CHUNK = 4096                    # most equal rows that are numbered together

Tree = dict[str, dict[str, dict[int, float]]]


def balanced(shards: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> Tree:
    """Regions of ``racks`` racks of ``per_rack`` shards of weight 1, filled in order."""
    tree: Tree = {}
    for s in range(shards):
        region, rest = divmod(s, racks * per_rack)
        rack = f"r{region}.{rest // per_rack}"
        tree.setdefault(f"r{region}", {}).setdefault(rack, {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, a region of its own: it takes keys only into itself."""
    shard = 1 + max((s for racks in tree.values() for rack in racks.values() for s in rack), default=-1)
    name = f"g{shard}"
    return tree | {name: {f"{name}.0": {shard: weight}}}


def weighed(tree: Tree, shard: int, weight: float) -> Tree:
    """The tree with another weight of one shard."""
    return {region: {rack: {s: weight if s == shard else w for s, w in shards.items()}
                     for rack, shards in racks.items()} for region, racks in tree.items()}


def _draw(key: Column, name: str, weight: float) -> Column:
    """Exponential variate of rate ``weight`` from 52 bits of a hash of key and child."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1.0) / float(1 << 52)) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; weightless children take nothing."""
    able = [c for c in children if c[1] > 0]
    if not able:
        return F.lit(None).cast("int")
    if len(able) == 1:
        return able[0][2]
    draws = F.array(*[F.struct(_draw(key, name, weight).alias("d"), F.lit(k).alias("k"))
                      for k, (name, weight, _) in enumerate(able)])
    # a one-element array keeps the minimum from being computed again for every branch
    def pick(least: Column) -> Column:
        out = able[-1][2]
        for k, (_, _, value) in reversed(list(enumerate(able[:-1]))):
            out = F.when(least["k"] == k, value).otherwise(out)
        return out
    return F.transform(F.array(F.array_min(draws)), pick)[0]


def descend(id_col: Column, tree: Tree) -> Column:
    """The shard of an id."""
    key = F.coalesce(id_col.cast("string"), F.lit("\x00null"))
    weigh = lambda rack: sum(rack.values())
    regions = []
    for region, racks in tree.items():
        inside = [(rack, weigh(shards), _winner(key, [
            (f"{rack}.{s}", w, F.lit(s)) for s, w in shards.items()])) for rack, shards in racks.items()]
        regions.append((region, sum(w for _, w, _ in inside), _winner(key, inside)))
    return _winner(key, regions).cast("int")


def assign(df: DataFrame, tree: Tree, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """All rows and columns with the shard in column ``name``; no shuffle."""
    return df.withColumn(name, descend(F.col(id_col), tree))


def place(df: DataFrame, tree: Tree, text_col: str = "text", id_col: str = "doc_id",
          buckets: int = SLOT_BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes plus 1; slots are gapless from 0 in each
    shard, by the hash of id, size, checksum and chunk.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                     F.crc32(text).alias("crc"))
    chunks = rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("copies")).select(
        "id", "size", "crc", "copies", F.explode(F.sequence(
            F.lit(0).cast("long"), F.expr(f"(copies - 1) div {chunk}"))).alias("part"))
    # the hash orders the chunks of a shard; its first digits are the bucket
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("\x00null")),
                               "size", "crc", "part").cast("binary"))
    chunks = chunks.select(
        "id", "size", "crc", "part",
        F.least(F.lit(chunk).cast("long"), F.col("copies") - F.col("part") * chunk).alias("n"),
        descend(F.col("id"), tree).alias("shard"),
        F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").alias("h")
        ).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    # at most shards x buckets rows
    totals = chunks.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("shard", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "id", "size", "crc", "part").rowsBetween(
        Window.unboundedPreceding, -1)
    numbered = chunks.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return numbered.join(first, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.explode(F.sequence(
            F.col("first") + F.col("before"), F.col("first") + F.col("before") + F.col("n") - 1)).alias("slot"))


def op13_hash_tree(spark, sf_dir) -> DataFrame:
    """Sixteen shards of four regions, and where each id is with one more shard."""
    tree = balanced()
    placed = place(C.table(spark, sf_dir, "documents"), tree)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                         descend(F.col("doc_id"), grown(tree)).alias("grown_shard"))


def _sql_winner(key: str, children: list[tuple[str, str]]) -> str:
    """SQL twin of ``_winner`` for children of weight 1 (or the weight given behind the name)."""
    draws = ", ".join(
        "{'d': -ln((CAST('0x' || substr(md5(" + key + f" || '|{name}'), 1, 13) AS BIGINT) + 1e0) / "
        f"4503599627370496e0) / {weight}, 'k': {k}}}" for k, (name, weight) in enumerate(children))
    return f"list_sort([{draws}])[1].k"


def _sql_shard(tree: Tree) -> str:
    """Descent of ``key`` level by level, as nested cases."""
    def racks_of(racks):
        if len(racks) == 1:
            return shards_of(*next(iter(racks.items())))
        arms = " ".join(f"WHEN {k} THEN {shards_of(rack, shards)}" for k, (rack, shards) in enumerate(racks.items()))
        pick = _sql_winner("key", [(rack, repr(sum(shards.values()))) for rack, shards in racks.items()])
        return f"CASE {pick} {arms} END"

    def shards_of(rack, shards):
        if len(shards) == 1:
            return str(next(iter(shards)))
        arms = " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(shards))
        return f"CASE {_sql_winner('key', [(f'{rack}.{s}', repr(w)) for s, w in shards.items()])} {arms} END"

    arms = " ".join(f"WHEN {k} THEN {racks_of(racks)}" for k, racks in enumerate(tree.values()))
    pick = _sql_winner("key", [(region, repr(sum(sum(x.values()) for x in racks.values())))
                               for region, racks in tree.items()])
    return f"CASE {pick} {arms} END"


# The checksum goes through the bytes of a text with the table of its polynomial.
SQL = f"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
rows_ AS (
  SELECT doc_id, CAST(length(x) // 2 + 1 AS BIGINT) AS size,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(length(x) // 2),
          lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc,
    coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null') AS key
  FROM texts, crc_table),
parts AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, crc) - 1) // {CHUNK} AS part FROM rows_),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(key || ':' || size || ':' || crc || ':' || part), 1, 13) AS BIGINT) AS h,
    {_sql_shard(balanced())} AS shard, {_sql_shard(grown(balanced()))} AS grown_shard
  FROM parts)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h % {SLOT_BUCKETS}, h, doc_id, size, crc, part) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM hashed
"""
