"""Reply trees formatted as conversations, in DataFrame operations only.

Messages are nodes (conv_id, node, parent, role, text, score). Self-joins that double
the reach of every node's ancestor link give depth and path score of all nodes in as
many rounds as the depth has binary digits. Leaves are ranked by the score of their
path (then by node), and the chosen ones' paths are read off the same ancestor links.
Each path becomes one string:

    <turn:ROLE>TEXT</turn><turn:ROLE>TEXT</turn>...

Inside roles and texts `\\` becomes `\\b` and `<` becomes `\\l` (and `>` becomes `\\g` in
roles), so no text can hold a control string, and reading undoes it exactly. The loss
mask names, per turn that is trained on, the place of its text inside its turn.

Null texts and roles count as empty. A node whose parent is missing is a root; nodes
on a cycle are on no path. Rows with a null conv_id form a conversation of their own.
Conversations with equal turn numbers are put in the order of (turn, role, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TRAINED = ("assistant",)
ESCAPES = (("\\", "\\b"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (">", "\\g"))
OPEN, SHUT, END = "<turn:", ">", "</turn>"


def escaped(c: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees (conv_id, node, parent, score): a row per
    node of a chosen path: conv_id, leaf, rank (1 is the best branch), depth, node.

    conv_id and node must not be null together with equal values elsewhere: (conv_id,
    node) is the key. branches limits the leaves per conversation; None takes all.
    """
    known = nodes.select("conv_id", F.col("node").alias("anc"), F.lit(True).alias("known"))
    start = nodes.select("conv_id", "node", F.col("parent").alias("anc"), F.col("score").cast("double").alias("score"))
    start = start.join(known, ["conv_id", "anc"], "left").select("conv_id", "node", F.when(F.col("known"), F.col("anc")).alias("anc"), "score")
    state = common.written(start.withColumn("hops", F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long")), "reply-0")
    jumps, size = [], state.count()
    while 2 ** len(jumps) <= max(size, 1) and not state.where("anc is not null").isEmpty():
        # only nodes whose root is not known yet take part; most are settled in a round or two
        jumps.append(state.where("anc is not null").select("conv_id", "node", "anc"))
        up = state.select("conv_id", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("hops").alias("hops2"), F.col("score").alias("score2"))
        moved = state.where("anc is not null").join(up, ["conv_id", "anc"]).select(
            "conv_id", "node", F.col("anc2").alias("anc"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"), (F.col("hops") + F.col("hops2")).alias("hops")
        )
        state = common.written(state.where("anc is null").unionByName(moved), f"reply-{len(jumps)}")
    rooted = state.where("anc is null").select("conv_id", "node", F.col("hops").alias("depth"), "score")
    inner = jumps[0].select("conv_id", F.col("anc").alias("node")).distinct() if jumps else rooted.limit(0).select("conv_id", "node")
    leaves = rooted.join(inner, ["conv_id", "node"], "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("score"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    on = leaves.select("conv_id", F.col("node").alias("leaf"), "rank", "node")
    for jump in jumps:
        on = common.written(on.unionByName(on.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", "rank", F.col("anc").alias("node"))), "reply-path")
    return on.join(rooted.select("conv_id", "node", "depth"), ["conv_id", "node"]).select("conv_id", "leaf", "rank", "depth", "node")


def formatted(messages: DataFrame, branches: int | None = 1, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Chosen paths of messages (conv_id, node, parent, role, text, score) as strings:
    conv_id, leaf, rank, formatted, loss (array of turn, at, length)."""
    nodes = messages.select("conv_id", "node", "parent", "score")
    role = escaped(F.coalesce("role", F.lit("")), ROLE_ESCAPES)
    text = escaped(F.coalesce("text", F.lit("")))
    said = messages.select("conv_id", "node", role.alias("role"), text.alias("text"), F.coalesce("role", F.lit("")).isin(*trained).alias("trained"))
    turns = paths(nodes, branches).join(said, ["conv_id", "node"])
    piece = F.concat(F.lit(OPEN), "role", F.lit(SHUT), "text", F.lit(END))
    at = F.length("role") + F.lit(len(OPEN) + len(SHUT))
    row = F.struct("depth", piece.alias("piece"), "trained", at.alias("at"), F.length("text").alias("length"))
    whole = turns.groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    loss = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["at"].alias("at"), t["length"].alias("length"), t["trained"].alias("on"))), lambda t: t["on"])
    loss = F.transform(loss, lambda t: F.struct(t["turn"], t["at"], t["length"]))
    return whole.select("conv_id", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def parsed(strings: DataFrame) -> DataFrame:
    """formatted() strings read back: adds turns (array of role, text) and loss_text."""
    pieces = F.split("formatted", END)
    out = strings.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SHUT, 1)
    text = lambda p: F.substr(p, F.instr(p, SHUT) + 1)
    out = out.withColumn("turns", F.transform("_pieces", lambda p: F.struct(unescaped(role(p), ROLE_ESCAPES).alias("role"), unescaped(text(p)).alias("text"))))
    masked = F.transform("loss", lambda s: unescaped(F.substr(F.get("_pieces", s["turn"]), s["at"] + 1, s["length"])))
    return out.withColumn("loss_text", F.array_join(masked, "")).drop("_pieces")


def chained(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each row answers the
    row before it in the order of (turn, role, text). conv_id becomes a text, NO_ID for null."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_ID)))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


#: Not the decimal form of any number.
NO_ID = "none"
HARD = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    messages = common.written(chained(rows.unionByName(hard)), "messages")
    back = parsed(formatted(messages))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.nullif("conv_id", F.lit(NO_ID)).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op9_chat_formatting": op9_chat_formatting}
ORACLE_SQL = {
    "op9_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + 14 AS piece FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(piece) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
