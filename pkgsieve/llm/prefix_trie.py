"""Prefix trie of conversations by whole-sequence collapse.

A conversation is a sequence of turns (role, text).  Identical conversations
are grouped into one weighted sequence with the list of their ids; from then
on only one row per distinct sequence and turn is worked on.  The nodes of the
trie are the distinct prefixes of the sequences; a sequence that is a proper
prefix of another is found by an anti-join, what is left are the leaves; a
node's counts are sums of the weights of the sequences through it.

Sequences are compared by a 128-bit key that can be formed in any order and in
pieces: the exclusive or, over the turns, of two 64-bit hashes of (place, turn
digest).  So a conversation of any length is worked on in blocks of
``BLOCK`` turns, and the key of a node's parent is its own key less its last
turn.

Sums over subtrees: each node belongs to the path of the sequence of lowest
hash among those through it, so the nodes of a sequence's path lie one below
the other, and a way from the root changes path about as often as the
logarithm of the number of sequences.  Totals of paths are sent up along the
table of paths, once for each change, and summed along each path from its end.

End lists are kept in chunks of neighbouring ids; their hash is computed over
the chunks in order, one chunk in memory at a time.

Defined cases: null roles and texts count as empty; turns are ordered by
``turn`` (null first), equal ones by the digest of role and text, and repeated
rows are turns of their own; rows with a null conv_id belong to no
conversation; an empty table has no node; texts of any length are hashed and
counted where they are read and not kept; columns of other names are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

BLOCK = 1024  # turns of a conversation that a task works on at a time
CHUNK_BITS = 9  # ids of an end list that agree above these bits share a chunk
STRIDE = 20
HEADS = 4
KEY = ["depth", "k0", "k1"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _before(keys: Sequence[str], order: Column):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation, numbered
    from 1.  Turns are dealt by range, so that a long conversation is shared
    by tasks, numbered there and shifted by those before."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), n_words(F.col("text")).alias("words"))
    rows = cut(rows.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(_before(["conv_id"], F.col("part"))), F.lit(0)).alias("shift"))
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return (rows.withColumn("here", here).join(shift, ["conv_id", "part"])
            .select("conv_id", (F.col("here") + F.col("shift")).alias("pos"), "digest", "words"))


def rebuild(conversations: DataFrame, stride: int = STRIDE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversation c takes the first h = crc32(c) % ``heads`` turns of
    conversation c - c % ``stride`` and its own turns after its first h.

    Returns the turns (conv_id, depth, z0, z1, words), ``z0`` and ``z1`` the
    turn's share of the key, and the conversations (conv_id), which may have
    no turn."""
    turns = cut(numbered(conversations))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % stride
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base"))
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    convs = cut(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")))
    own = turns.join(convs, "conv_id").where("pos > h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words")
    lent = turns.where((F.col("conv_id") % stride == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    lent = lent.join(convs, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "words")
    z = lambda salt: F.xxhash64(F.lit(salt), "depth", "digest")
    rebuilt = own.union(lent).select("conv_id", F.col("depth").cast("long").alias("depth"), z(1).alias("z0"), z(2).alias("z1"), "words")
    return cut(rebuilt), convs.select("conv_id")


def collapse(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, ends) of rebuilt conversations.

    sequences (seq, depth, k0, k1, weight): one row per distinct sequence,
    ``seq`` the smallest conv_id that has it.  ends (depth, k0, k1, chunk,
    ids): all ids of the conversations with that sequence, ascending in
    chunks of bounded size."""
    sums = turns.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("z0").alias("k0"), F.bit_xor("z1").alias("k1"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    members = cut(convs.join(sums, "conv_id", "left").select("conv_id", *[zero(c) for c in KEY]))
    sequences = members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("seq"))
    ends = (members.withColumn("chunk", F.shiftright("conv_id", CHUNK_BITS)).groupBy(*KEY, "chunk")
            .agg(F.array_sort(F.collect_list("conv_id")).alias("ids")))
    return cut(sequences), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256): hash of the comma-joined ids of each end
    list, its chunks taken in order."""
    chunks = ends.select(*KEY, "chunk", F.array_join("ids", ",").alias("text"))
    chunks = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, out = None, None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            for key, text in zip(zip(*cols), batch.column(4)):
                if key != now:
                    if now is not None:
                        out.append((*now, hasher.hexdigest()))
                    now, hasher = key, hashlib.sha256()
                else:
                    hasher.update(b",")
                hasher.update(text.as_buffer())
            yield _digests(out)
            out = []
        if now is not None:
            yield _digests([(*now, hasher.hexdigest())])

    return chunks.mapInArrow(run, "depth long, k0 long, k1 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*KEY, "ends_sha256"])


def _running(rows: DataFrame, key: str, values: Sequence[str], agg, down: bool = True) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its running ``agg`` along
    ``depth`` (from the top, or from the end), the row itself included; a
    block at a time, shifted by the blocks before."""
    way = (lambda c: F.col(c).asc()) if down else (lambda c: F.col(c).desc())
    rows = rows.withColumn("blk", F.floor(F.col("depth") / BLOCK))
    totals = rows.groupBy(key, "blk").agg(*[agg(v).alias(v) for v in values])
    carry = totals.select(key, "blk", *[agg(v).over(_before([key], way("blk"))).alias(f"carry_{v}") for v in values])
    carry = carry.where(F.col(f"carry_{values[0]}").isNotNull())  # none for the first block
    here = Window.partitionBy(key, "blk").orderBy(way("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({v: agg(v).over(here) for v in values}).join(carry, [key, "blk"], "left")
    both = {v: F.col(v).bitwiseXOR(F.coalesce(f"carry_{v}", F.lit(0))) if agg is F.bit_xor
            else F.col(v) + F.coalesce(f"carry_{v}", F.lit(0)) for v in values}
    return rows.withColumns(both).drop("blk", *[f"carry_{v}" for v in values])


def trie(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """The nodes: (conv_id, depth, k0, k1, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens)."""
    reps = sequences.select(F.col("seq").alias("conv_id"), F.col("depth").alias("length"))
    rows = turns.join(reps, "conv_id").withColumnRenamed("conv_id", "seq")
    rows = _running(rows.withColumns({"k0": F.col("z0"), "k1": F.col("z1")}), "seq", ["k0", "k1"], F.bit_xor)
    root = [F.lit(0).cast("long").alias(c) for c in (*KEY, "z0", "z1", "words")]
    cols = ["seq", *KEY, "z0", "z1", "words", "length"]
    prefixes = cut(rows.select(cols).union(sequences.select("seq", *root, F.col("depth").alias("length"))))

    inner = prefixes.where("depth < length").select(KEY).distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("seq", F.lit(1).alias("leaf"))
    through = sequences.select("seq", "weight", F.xxhash64(F.lit(3), "seq").alias("toss")).join(leaves, "seq", "left")
    nodes = cut(prefixes.drop("length").join(through, "seq").groupBy(KEY).agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.min(F.struct("toss", "seq"))["seq"].alias("path"),
        *[F.max(c).alias(c) for c in ("z0", "z1", "words")]))

    nodes = nodes.withColumns({"up0": F.col("k0").bitwiseXOR(F.col("z0")), "up1": F.col("k1").bitwiseXOR(F.col("z1"))})
    below = nodes.where("depth > 0")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("up0"), F.col("k1").alias("up1"),
                           F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    top = nodes.where("depth = 0")
    # the root, one row, is the parent of many
    first = below.where("depth = 1").join(F.broadcast(parents.where("depth = 1").drop("up0", "up1")), "depth")
    deeper = below.where("depth > 1").join(parents.where("depth > 1"), ["depth", "up0", "up1"])
    orphan = top.withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_path": F.lit(None).cast("long")})
    linked = cut(deeper.unionByName(first).unionByName(orphan))
    counts = linked.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up0").alias("k0"), F.col("up1").alias("k1"))
    counts = counts.agg(F.count(F.lit(1)).alias("n_children"))
    linked = linked.withColumn("own", (F.col("n_convs") - 1) * F.col("words"))

    arrivals = _arrivals(linked)
    sums = linked.join(arrivals, ["path", "depth"], "left").withColumn("saved_tokens", F.col("own") + F.coalesce("amount", F.lit(0)))
    sums = _running(sums, "path", ["saved_tokens"], F.sum, down=False)
    return sums.join(counts, KEY, "left").select(
        "conv_id", *KEY, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens")


def _arrivals(linked: DataFrame) -> DataFrame:
    """(path, depth, amount): what the paths that hang from a node hold, with
    all that hangs from them."""
    totals = linked.groupBy("path").agg(F.sum("own").alias("amount"))
    hang = linked.where("path <> parent_path").select("path", "parent_path", (F.col("depth") - 1).alias("at"))
    hang = cut(hang.join(totals, "path"))

    def land(moving: DataFrame) -> DataFrame:
        return cut(moving.groupBy(F.col("parent_path").alias("path"), F.col("at").alias("depth")).agg(F.sum("amount").alias("amount")))

    moving, rounds = land(hang), []
    while moving.limit(1).count():
        rounds.append(moving)
        moving = land(moving.groupBy("path").agg(F.sum("amount").alias("amount")).join(hang.drop("amount"), "path"))
    found = moving
    for r in rounds:
        found = found.union(r)
    return found.groupBy("path", "depth").agg(F.sum("amount").alias("amount"))


def prefix_trie(conversations: DataFrame, stride: int = STRIDE, heads: int = HEADS) -> DataFrame:
    """One row per node of the trie of rows (conv_id, turn, role, text)."""
    turns, convs = rebuild(conversations, stride, heads)
    sequences, ends = collapse(turns, convs)
    nodes = trie(turns, sequences).join(end_digests(ends), KEY, "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
