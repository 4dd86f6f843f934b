"""Prefix trie of conversations by SQL ROLLUP over positional turn-id columns.

A turn's id is the MD5 of role and text.  A conversation is cut into blocks of eight turns; a block is one row with its
turn ids in eight columns, keyed by the node where the block before it ends.  `GROUP BY block, node, ROLLUP (t1 .. t8)`
gives a row for every prefix that ends in the block, and grouping_id() says how many of the columns it has.

A node is known by the sums, over its turns, of four 32-bit hashes of place and id: sums can be taken over parts of a
conversation side by side, so long conversations need neither a round for each block nor one task.

Every node is owned by its smallest member, whose other nodes below it are owned by the same one.  So the prefix that a
conversation shares with smaller ones is one length, and what holds for subtrees follows from two rollups: the first
gives members and owners, the second adds up, over the members, the words of shared prefixes and the owned leaves.

Rows: turns in ascending order, null first, turns of equal number by their ids; repeated rows are turns like others.
Null role or text is empty.  Rows without conv_id belong to no conversation and are left out.  Other columns
stay out of the way.  An empty table gives no rows.  Texts are read once, for id and words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.functions.text import pin
from quietlog.llm.common import let, n_pieces
from quietlog.llm.turns import joined_sha256, running
from quietlog.operators.ranks import numbered
from quietlog.session import staged

#: turn-id columns of a block
BLOCK = 8
SPACES = r"[\x20\x09-\x0D]+"
#: conversation ids that one step of a digest joins
LISTED = 4096
SLOTS = [f"t{i}" for i in range(1, BLOCK + 1)]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id, words of every row that has a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        n_pieces(text, SPACES).alias("words"),
    )


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, id, words) and conversations (conv_id, len) whose first turns come from their family's first one.

    Conversation c takes its first h turns, h = crc32(c) % `heads`, from conversation c - c % `family`.
    """
    own = staged(numbered(turns, ["conv_id"], ["turn", "id"]), "numbered")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("long")
    sizes = own.groupBy("conv_id").agg(F.max("place").alias("n"))
    most = heads - 1
    first = own.where((F.col("conv_id") % family == 0) & (F.col("place") <= most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.count("*").alias("there"),
        *(F.max(F.when(F.col("place") == i, F.struct("id", "words"))).alias(f"head{i}") for i in range(1, most + 1)),
    )
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = staged(convs.withColumn("taken", taken).withColumn("len", F.greatest(F.col("n") - F.col("h"), F.lit(0)) + taken), "rebuilt")
    heads_of = convs.where("taken > 0").select("conv_id", F.posexplode(F.slice(F.array(*(f"head{i}" for i in range(1, most + 1))), 1, F.col("taken").cast("int"))).alias("at", "turn"))
    lead = heads_of.select("conv_id", (F.col("at") + 1).cast("long").alias("place"), "turn.id", "turn.words")
    rest = own.withColumn("h", h).where("place > h").join(convs.select("conv_id", "taken"), "conv_id")
    tail = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id", "words")
    return lead.unionByName(tail), convs.select("conv_id", "len")


def _hash(place: Column, turn_id: Column) -> Column:
    """Four 32-bit numbers."""
    digest = F.md5(F.concat_ws(":", place.cast("string"), turn_id))
    return let(digest, lambda d: F.array(*(F.conv(F.substr(d, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4))))


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and block (one even without turns): turn ids, words, and sums over the turns before it."""
    pieces = [f"s{k}" for k in range(4)]
    block, slot = ((F.col("place") - 1) / BLOCK).cast("long"), (F.col("place") - 1) % BLOCK + 1
    hashed = turns.withColumn("hash", pin(_hash(F.col("place"), F.col("id")))).withColumns({p: F.get("hash", F.lit(k)) for k, p in enumerate(pieces)} | {"block": block, "slot": slot})
    whole = hashed.groupBy("conv_id", "block").agg(
        *(F.max(F.when(F.col("slot") == i, F.col("id"))).alias(f"t{i}") for i in range(1, BLOCK + 1)),
        F.array(*(F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("words"))), F.lit(0)) for i in range(1, BLOCK + 1))).alias("words"),
        F.sum("words").alias("block_words"),
        *(F.sum(p).alias(p) for p in pieces),
    )
    summed = running(whole, "conv_id", "block", {"words_before": "block_words"} | {f"p{k}": f"s{k}" for k in range(4)})
    filled = summed.join(convs, "conv_id").drop(*pieces, "block_words")
    none = convs.where("len = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"), *(F.lit(None).cast("string").alias(t) for t in SLOTS),
        F.array_repeat(F.lit(0).cast("long"), BLOCK).alias("words"),
        *(F.lit(0).cast("long").alias(c) for c in ("words_before", "p0", "p1", "p2", "p3")), "len",
    )
    return filled.unionByName(none).withColumn("node", _node(F.lit(0)))


def _node(level: Column) -> Column:
    """The node at `level` of a block row."""
    ids = F.slice(F.array(*SLOTS), 1, level.cast("int"))
    hashes = F.transform(ids, lambda t, i: _hash(F.col("block") * BLOCK + i + 1, t))
    before = F.array(*(F.col(f"p{k}") for k in range(4)))
    sums = F.aggregate(hashes, before, lambda total, h: F.zip_with(total, h, lambda a, b: a + b))
    return F.md5(F.array_join(F.transform(sums, lambda n: n.cast("string")), ","))


def prefixes(rows: DataFrame, measures: str) -> DataFrame:
    """All prefixes that end in a block, with measures over their members: depth, block, level, conv_id (smallest member) and n_convs."""
    slots = ", ".join(SLOTS)
    found = rows.sparkSession.sql(
        f"""
        select * from (
          select block, {slots}, {BLOCK} - bit_count(grouping_id()) as level, min(conv_id) as conv_id, count(*) as n_convs, {measures}
          from {{rows}} group by block, node, rollup ({slots})
        ) where level = 0 and block = 0 or level > 0 and get(array({slots}), level - 1) is not null
        """,
        rows=rows,
    ).drop(*SLOTS)
    return found.withColumn("depth", F.col("block") * BLOCK + F.col("level")).withColumn("level", F.col("level").cast("int"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of the trie of `turns` (conv_id, place, id, words) of `convs` (conv_id, len)."""
    rows = staged(blocks(turns, convs), "blocks")
    owned = prefixes(rows, "max(len) as deepest").groupBy("conv_id").agg(
        F.min("depth").alias("own_from"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf")
    )
    # the words of a conversation above its first own node
    marked = rows.join(owned, "conv_id", "left").withColumn("own_from", F.coalesce("own_from", F.col("len") + 1))
    above = F.aggregate(
        F.transform("words", lambda w, i: F.when(F.col("block") * BLOCK + i + 1 < F.col("own_from"), w).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    shared = staged(marked.groupBy("conv_id").agg(F.sum(above).alias("shared"), F.coalesce(F.max("leaf"), F.lit(0)).alias("leaf")), "shared")
    sums = prefixes(rows.join(shared, "conv_id"), "sum(shared) as shared_all, sum(leaf) as n_leaves")
    path = rows.select("conv_id", "block", *SLOTS, "words", "words_before", "p0", "p1", "p2", "p3")
    nodes = (
        sums.join(path, ["conv_id", "block"])
        .withColumn("key", _node(F.col("level")))
        .withColumn("parent_key", F.when(F.col("depth") > 0, _node(F.greatest(F.col("level") - 1, F.lit(0)))))
        .withColumn("words_above", F.col("words_before") + F.aggregate(F.slice("words", 1, F.greatest(F.col("level") - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b))
        .select("conv_id", "depth", "key", "parent_key", "n_convs", "n_leaves", "shared_all", "words_above")
    )
    nodes = staged(nodes.join(shared.select("conv_id", "shared"), "conv_id"), "nodes")
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(parents, "parent_key", "left")
        .join(children, "key", "left")
        .join(ends(rows), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("shared_all") - F.col("shared") - F.col("words_above") * (F.col("n_convs") - 1)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): the conversations that end in a node, numerically ascending."""
    last = rows.where(F.col("block") == F.greatest(((F.col("len") - 1) / BLOCK).cast("long"), F.lit(0)))
    ending = last.select("conv_id", _node(F.col("len") - F.col("block") * BLOCK).alias("key"))
    chunk = ((F.col("nth") - 1) / LISTED).cast("long")
    lists = numbered(ending, ["key"], ["conv_id"], "nth").groupBy("key", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = F.concat(F.lit(","), F.array_join(F.transform("ids", lambda c: c.cast("string")), ","))
    return joined_sha256(lists, "key", "chunk", joined, "ends_sha256")
