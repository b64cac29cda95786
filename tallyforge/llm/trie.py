"""A trie of the turns that conversations begin with, by partition refinement.

All conversations start in one class. Each turn splits the classes that are still active by
what their members say next; a class is named by its depth and its smallest member, so a
split needs only a minimum per (class, turn). Conversations that are alike to their end are
one member with a multiplicity, so a class of one member has nothing left to split: it is
retired, and its remaining turns become a chain without branches in one join at the end.
The sums over subtrees are then folded back from the deepest class to the root; within a
chain they are sums over the rest of its turns.

There are as many rounds as turns that two different conversations share at most. Each
reads only the turns of its depth (the table is sorted by it) and the members still active.
Positions and sums along a conversation are taken over value ranges with offsets, so one
conversation that holds a third of all turns is spread over tasks like any other rows.

Rows with a null conv_id belong to no conversation. Turns stand in the order of turn (null
first), then role and text (their first 100 characters, then a digest of both); null roles
and texts are empty; rows that are alike in all of these are turns of their own. A conversation that another is rebuilt from and that has no
rows gives no turns. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Ids that are joined in one row before their digest is taken, in characters.
JOINED = 64_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with sums over the rows of its group before each row and the row itself, in the given order.

    Rows are dealt over value ranges of (group, order), so that a large group lies in many
    tasks; each range is summed by itself and gets the totals of the ranges before it.
    """
    (part,) = common.free_names(df, ["part"])
    ranged = common.written(df.withColumns(sums).repartitionByRange(group, *order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(group, part).agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select(group, part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    here = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({c: F.sum(c).over(here) for c in sums})
    out = local.join(totals, [group, part])
    return out.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in sums}).drop(part, *[f"{c}_before" for c in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, key, chars) of conversations (conv_id, turn, role, text): `key`
    stands for a role and a text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).where("conv_id is not null")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = plain.select("conv_id", "turn", F.left("role", F.lit(100)).alias("role"), key.alias("key"), F.length("text").cast("long").alias("chars"), "text")
    # The text decides only between turns of equal number and role; its start and its digest are enough to tell texts apart.
    rows = rows.withColumn("text", F.left("text", F.lit(100)))
    out = running(rows, "conv_id", ["turn", "role", "text", "key"], {"pos": F.lit(1).cast("long")})
    return out.select("conv_id", (F.col("pos") - 1).alias("pos"), "key", "chars")


def rebuilt(own: DataFrame, ids: DataFrame, base: Column, shared: Column) -> DataFrame:
    """turns() of conversations that begin with the first `shared` turns of conversation
    `base` (columns over conv_id) and go on with their own turns after as many."""
    own = common.written(own, "own-turns")
    wants = ids.select("conv_id", base.alias("base"), shared.cast("long").alias("shared"))
    first = wants.withColumnRenamed("conv_id", "of").join(own.withColumnRenamed("conv_id", "base"), "base").where("pos < shared")
    first = common.written(first.select(F.col("of").alias("conv_id"), "pos", "key", "chars"), "base-turns")
    had = first.groupBy("conv_id").agg(F.count("*").alias("had"))
    rest = own.withColumn("shared", shared.cast("long")).where("pos >= shared").join(had, "conv_id", "left")
    return first.unionByName(rest.select("conv_id", (F.col("pos") - F.col("shared") + F.coalesce("had", F.lit(0))).alias("pos"), "key", "chars"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, conv_id) in order -> (rep, first, body): decimal ids joined by commas, in rows of JOINED characters."""
    rep, ids, size, out = None, [], 0, []

    def close() -> None:
        nonlocal ids, size
        if ids:
            out.append((rep, ids[0], ",".join(map(str, ids))))
        ids, size = [], 0

    def send() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 3
        out.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "first", "body"])

    for b in batches:
        for r, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if r != rep or size > JOINED:
                close()
                rep = r
            ids.append(c)
            size += len(str(c)) + 1
        yield send()
    close()
    yield send()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, body) in order -> (rep, ends_sha256): one digest runs over the bodies of a rep."""
    rep, digest, out = None, None, []

    def send() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 2
        out.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string()), strict=True)], names=["rep", "ends_sha256"])

    for b in batches:
        for r, _, body in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if r != rep:
                if digest is not None:
                    out.append((rep, digest.hexdigest()))
                rep, digest = r, hashlib.sha256(body.encode())
            else:
                digest.update(b"," + body.encode())
        yield send()
    if digest is not None:
        out.append((rep, digest.hexdigest()))
    yield send()


def ends(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of (rep, conv_id, n): the SHA-256 of the ids of each rep, decimal,
    ascending, joined by commas. Ids are joined range by range; a digest runs over the
    joined rows, so a rep with very many ids is a short stream to the one task that needs it."""
    alone = members.where("n = 1").select("rep", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = members.where("n > 1").select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    many = many.mapInArrow(_joined, "rep long, first long, body string").repartition("rep").sortWithinPartitions("rep", "first")
    return alone.unionByName(many.mapInArrow(_digested, "rep long, ends_sha256 string"))


def alike(said: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, rep, n, length): conversations that are alike to their end, under the
    smallest of them. Their digest is the exclusive or of SHA-256 over (place, key)."""
    quarter = lambda i: F.bit_xor(F.conv(F.substr(F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), F.col("key")), 256), F.lit(16 * i + 1), F.lit(15)), 16, 10).cast("long")).alias(f"x{i}")
    whole = said.groupBy("conv_id").agg(F.count("*").alias("length"), *[quarter(i) for i in range(4)])
    whole = ids.join(whole, "conv_id", "left").withColumn("alike", F.concat_ws(":", F.coalesce("length", F.lit(0)), "x0", "x1", "x2", "x3"))
    whole = common.written(whole.select("conv_id", "alike", F.coalesce("length", F.lit(0)).alias("length")), "alike")
    same = common.written(whole.groupBy("alike").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "reps")
    out = common.heavy_join(whole, same.withColumn("of", F.col("n")), "alike", "of")
    return common.written(out.select("conv_id", "rep", "n", "length"), "members")


def prefix_trie(said: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the trie of said (conv_id, pos, key, chars) over the conversations ids (conv_id).

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens of its subtree, ends_sha256 of the members that end there.
    """
    said = common.written(said, "said")
    members = alike(said, ids)
    reps = members.where("conv_id = rep").select("rep", "n", "length")
    own = said.join(reps.where("length > 0").select(F.col("rep").alias("conv_id"), "n"), "conv_id")
    own = common.written(own.select(F.col("conv_id").alias("rep"), "pos", "key", "chars", "n").repartitionByRange("pos", "rep").sortWithinPartitions("pos"), "turns-by-depth")

    # One class holds all; a class with one member has nothing to split.
    none = F.lit(None).cast("long")
    start = reps.agg(F.min("rep").alias("class"), F.sum("n").alias("n"), F.count("*").alias("members")).where("members > 0")
    start = common.written(start.select("class", none.alias("parent"), "n", F.lit(0).cast("long").alias("chars"), "members", none.alias("end")), "classes")
    levels, retired, depth = [start], [], 0
    root = start.first()
    active = reps.withColumn("class", F.lit(root["class"] if root else None).cast("long")).withColumn("members", F.lit(root["members"] if root else 0).cast("long"))
    while True:
        retired.append(active.where("members = 1").select("rep", "n", "length", F.col("class").alias("parent"), F.lit(depth).cast("long").alias("depth")))
        going = active.where("members > 1")
        if going.isEmpty():
            break
        said_next = own.where(F.col("pos") == depth).select("rep", "key", "chars")
        step = going.drop("members").join(said_next, "rep", "left")
        step = common.written(step.withColumn("split", F.concat_ws(":", "class", F.hex("key"))), "split")
        ended = step.where("key is null").select("class", F.col("rep").alias("end"))  # alike conversations are one, so one a class at most
        levels[-1] = levels[-1].drop("end").join(ended, "class", "left")
        by = step.where("key is not null").groupBy("split").agg(F.min("rep").alias("class"), F.min("class").alias("parent"), F.sum("n").alias("n"), F.max("chars").alias("chars"), F.count("*").alias("members"))
        classes = common.written(by.withColumn("end", none), "classes")
        levels.append(classes.drop("split"))
        moved = common.heavy_join(step.where("key is not null").select("split", "rep", "n", "length"), classes.select("split", "class", "members", F.col("members").alias("of")), "split", "of")
        active = common.written(moved.drop("split"), "active")
        depth += 1

    lone = retired[0]
    for x in retired[1:]:
        lone = lone.unionByName(x)
    lone = common.written(lone, "retired")
    tails = own.where("n > 1").join(lone.select("rep", "depth"), "rep").where("pos >= depth").groupBy("rep").agg(F.sum("chars").alias("tail"))
    lone = common.written(lone.join(tails, "rep", "left").withColumn("tail", (F.col("n") - 1) * F.coalesce("tail", F.lit(0))), "tails")
    folded = _folded(levels, lone)
    chains = _chains(own, lone)
    nodes = folded.unionByName(chains)
    out = nodes.join(ends(members.select("rep", "conv_id", "n")).withColumnRenamed("rep", "end"), "end", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def _chains(own: DataFrame, lone: DataFrame) -> DataFrame:
    """The nodes below the classes at which members were retired: turns `depth` and on of
    each, all with the same n. A node saves what its turn and those after it hold."""
    after = own.join(lone.select("rep", "depth", "length"), "rep").where("pos >= depth").drop("depth")
    copies = after.where("n > 1")
    summed = running(copies.withColumn("back", -F.col("pos")), "rep", ["back"], {"rest": F.col("chars")}).drop("back")
    every = after.where("n = 1").withColumn("rest", F.lit(0).cast("long")).unionByName(summed.select(*after.columns, "rest"))
    last = F.col("pos") + 1 == F.col("length")
    return every.select(
        (F.col("pos") + 1).alias("depth"), F.col("rep").alias("conv_id"), F.col("rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("rep")).alias("end"),
    )


def _folded(levels: list[DataFrame], lone: DataFrame) -> DataFrame:
    """The classes with the sums over their subtrees, from the deepest to the root."""
    spark, out, below = lone.sparkSession, None, None
    for depth in reversed(range(len(levels))):
        here = levels[depth]
        chain = lone.where(F.col("depth") == depth).select(F.col("parent").alias("class"), F.col("rep").alias("lone"), "length", "tail")
        here = here.join(chain, "class", "left")
        if below is None:
            here = here.withColumns({"kids": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("class")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            here = here.join(sums, "class", "left").fillna(0, ["kids", "leaves", "saved"])
        more = F.col("length") > depth  # a lone member goes on as a chain
        kids = F.col("kids") + F.when(more, 1).otherwise(0)
        leaves = F.greatest(F.col("leaves"), F.lit(1))
        here = here.select(
            F.lit(depth).cast("long").alias("depth"), F.col("class").alias("conv_id"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), kids.alias("n_children"),
            leaves.alias("n_leaves"), (F.col("saved") + F.coalesce("tail", F.lit(0)) + (F.col("n") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("end", F.when(F.col("length") == depth, F.col("lone"))).alias("end"),
        )
        below = common.written(here, "folded")
        out = below if out is None else out.unionByName(below)
    return out if out is not None else spark.createDataFrame([], "depth long")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of the conversation of
    its hundred, from none to five by its id's checksum."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ids = common.written(table.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct(), "ids")
    return prefix_trie(rebuilt(turns(table), ids, F.col("conv_id") - F.col("conv_id") % 100, common.crc_mod(F.col("conv_id"), 6)), ids)


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL = {
    "op12_prefix_trie": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM c)
), b AS (
  SELECT i.conv_id, list(c.said ORDER BY pos) AS l FROM ids i JOIN c ON c.conv_id = i.base AND c.pos < i.h GROUP BY 1
), o AS (
  SELECT i.conv_id, list(c.said ORDER BY pos) AS l FROM ids i JOIN c ON c.conv_id = i.conv_id AND c.pos >= i.h GROUP BY 1
), r AS (
  SELECT i.conv_id, list_concat(coalesce(b.l, []), coalesce(o.l, [])) AS l FROM ids i LEFT JOIN b USING (conv_id) LEFT JOIN o USING (conv_id)
), m AS (
  SELECT conv_id, d AS depth, l[:d] AS p, len(l) = d AS last FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)
), n AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM m GROUP BY depth, p
), k AS (
  SELECT a.depth, a.conv_id, a.p, a.n_convs, a.ends, u.conv_id AS parent, CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * length(a.p[-1].t) END AS own
  FROM n a LEFT JOIN n u ON u.depth = a.depth - 1 AND u.p = a.p[:a.depth - 1] AND a.depth > 0
), kids AS (
  SELECT depth - 1 AS depth, parent AS conv_id, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL
), up AS (
  SELECT k.depth, k.conv_id, k.parent, k.depth AS of_depth, k.conv_id AS of FROM k
  UNION ALL SELECT u.depth, u.conv_id, u.parent, up.of_depth, up.of FROM up JOIN k u ON u.depth = up.depth - 1 AND u.conv_id = up.parent
), s AS (
  SELECT up.depth, up.conv_id, sum(k.own) AS saved, count(*) FILTER (WHERE kids.n_children IS NULL) AS leaves
  FROM up JOIN k ON k.depth = up.of_depth AND k.conv_id = up.of LEFT JOIN kids ON kids.depth = k.depth AND kids.conv_id = k.conv_id GROUP BY ALL
)
SELECT k.conv_id, k.depth, k.parent AS parent_conv_id, k.n_convs, coalesce(kids.n_children, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s USING (depth, conv_id) LEFT JOIN kids USING (depth, conv_id)
"""
}
