"""The prefix trie of conversations, from the nodes that each conversation owns.

A prefix of d turns has a digest, built from digests of the turns with their
places, so it can be summed over blocks of a long conversation. The smallest
member of a prefix owns its node. What a conversation owns is the end of its
prefixes, from a first owned depth on, which is found by binary search: all
conversations probe one depth a turn, in a join with the table of each
digest's smallest member. The owned depths are a chain; it hangs from the
node one turn above its first. Leaves and saved bytes are summed for whole
chains from below, where each turn doubles the number of chains that a sum
reaches, and then along each chain.

Defined cases: a null role or text is empty; turns are ordered by turn (null
first), then role and text; repeated rows are turns of their own; rows
without a conversation id belong to none; an empty table has no nodes; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relsight.llm.order import placed
from relsight.llm.shared import drop_written, salted_join, written

#: Turns of a conversation that one window takes, and ids that one row of a node's ends joins.
BLOCK, IDS = 1024, 1024


def turns(rows: DataFrame) -> DataFrame:
    """conv, pos, n, t (digest of role and text) and n_bytes of the text, of every turn of ``conversations``."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), text["role"].alias("role"), text["text"].alias("text"))
    found = placed(rows, ["conv"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "turns")
    return found.select("conv", "pos", "n", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("t"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, d, t, n_bytes) of rebuilt conversations and (conv, length) of all, also of those without a turn.

    Conversation c takes the first h turns of conversation c - c % 5 and goes on with its own after its first h.
    """
    skipped = lambda c: F.crc32(c.cast("string")) % 9
    base = lambda c: c - c % 5
    own = written(turns(rows), "own")
    convs = own.where("pos = 0").select("conv", "n")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least(skipped(F.col("conv")), F.coalesce("n_base", F.lit(0)))
    convs = convs.withColumn("base", base(F.col("conv"))).join(bases, "base", "left").withColumn("taken", taken)
    convs = written(convs.select("conv", "n", "taken", (F.col("taken") + F.greatest(F.col("n") - skipped(F.col("conv")), F.lit(0))).alias("length")), "convs")
    later = own.where(F.col("pos") >= skipped(F.col("conv"))).drop("n")
    later = salted_join(later, convs.select("conv", "taken"), "conv", convs).select("conv", (F.col("pos") - skipped(F.col("conv")) + F.col("taken") + 1).alias("d"), "t", "n_bytes")
    # At most eight turns of a base go to at most nine conversations around it.
    around = F.sequence(F.col("conv") - 4, F.col("conv") + 4)
    first = own.where((F.col("pos") < 8) & (F.col("conv") % 5 == 0)).select(F.col("conv").alias("base"), "pos", "t", "n_bytes", F.explode(around).alias("conv"))
    first = first.where((base(F.col("conv")) == F.col("base")) & (F.col("pos") < skipped(F.col("conv")))).join(convs.select("conv"), "conv", "left_semi")
    return written(later.union(first.select("conv", (F.col("pos") + 1).alias("d"), "t", "n_bytes")), "rebuilt"), convs.select("conv", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, d, p (digest of the first d turns), t, n_bytes: two 64-bit sums of the turns' digests with their places."""
    placed_ = rows.select("conv", "d", "t", "n_bytes", F.floor((F.col("d") - 1) / BLOCK).alias("block"), *[F.xxhash64(F.lit(i), "d", "t").alias(f"u{i}") for i in (1, 2)])
    blocks = placed_.groupBy("conv", "block").agg(*[F.bit_xor(f"u{i}").alias(f"u{i}") for i in (1, 2)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several blocks have sums from before a block.
    blocks = blocks.select("conv", "block", *[F.bit_xor(f"u{i}").over(before).alias(f"b{i}") for i in (1, 2)]).where("block > 0")
    along = Window.partitionBy("conv", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed_.select("conv", "d", "t", "n_bytes", "block", *[F.bit_xor(f"u{i}").over(along).alias(f"u{i}") for i in (1, 2)]).join(blocks, ["conv", "block"], "left")
    sums = [F.hex(F.col(f"u{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0)))) for i in (1, 2)]
    return summed.select("conv", "d", F.concat_ws("-", F.col("d").cast("string"), *sums).alias("p"), "t", "n_bytes")


def minima(paths: DataFrame) -> DataFrame:
    """p, d, owner, n_convs, n_bytes of every prefix.

    Equal digests must have equal last turns: as a digest without its last
    turn's is the shorter prefix's, that shows the whole prefixes equal.
    """
    found = paths.groupBy("p").agg(F.min("d").alias("d"), F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), (F.min("t") == F.max("t")).alias("same"))
    return found.select("p", F.when(F.col("same"), F.col("d")).otherwise(F.raise_error(F.lit("two prefixes have one digest"))).alias("d"), "owner", "n_convs", "n_bytes")


def first_owned(paths: DataFrame, least: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, length and first: the first depth from 1 on that it owns, length + 1 if it owns none."""
    deepest = convs.agg(F.max("length")).first()[0] or 0
    now = convs.select("conv", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high"))
    owners, middle = least.select("p", F.col("owner").alias("conv"), F.lit(True).alias("owned")), F.floor((F.col("low") + F.col("high")) / 2)
    for _ in range(int(deepest).bit_length()):
        # A probe meets its own prefix and then its own claim on it, so no popular prefix gathers probes.
        probes = now.where("low < high").select("conv", middle.alias("d")).join(paths.select("conv", "d", "p"), ["conv", "d"])
        hits = probes.join(owners, ["p", "conv"], "left").select("conv", F.coalesce("owned", F.lit(False)).alias("owned"))
        asked = now.join(hits, "conv", "left")
        step = written(asked.select("conv", "length", F.when(F.col("owned").isNull() | F.col("owned"), F.col("low")).otherwise(middle + 1).alias("low"), F.when(F.col("owned"), middle).otherwise(F.col("high")).alias("high")), "probed")
        drop_written(now)
        now = step
    return now.select("conv", "length", F.col("low").alias("first"))


def chains_of(found: DataFrame, paths: DataFrame, least: DataFrame, root: int) -> DataFrame:
    """conv, first, length, parent and at: each owned chain, and the node that it hangs from; the root's owner has the root in its chain."""
    owning = found.where(F.col("first") <= F.col("length"))
    above = owning.where("first > 1").select("conv", (F.col("first") - 1).alias("d")).join(paths.select("conv", "d", "p"), ["conv", "d"]).select("conv", "p")
    above = salted_join(written(above, "above"), least.select("p", "owner"), "p").select("conv", F.col("owner").alias("parent"))
    hung = owning.where(f"conv <> {root}").join(above, "conv", "left").select("conv", "first", "length", F.coalesce("parent", F.lit(root)).alias("parent"), (F.col("first") - 1).alias("at"))
    top = found.where(f"conv = {root}").select("conv", F.lit(0).cast("long").alias("first"), "length", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("at"))
    return hung.union(top)


def chain_sums(chains: DataFrame, root: int) -> DataFrame:
    """conv, leaves and saved summed over a chain and all that hang from it, from its own (``leaves``, ``saved``).

    After k turns a sum reaches the chains less than 2^k below, and ``up``
    names the chain 2^k above.
    """
    now = written(chains.select("conv", F.col("parent").alias("up"), "leaves", "saved"), "sums")
    while not now.where("up is not null").isEmpty():
        given = now.where("up is not null").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        # The root's chain hangs from nothing, so those right below it needn't look.
        high = written(now.where(f"up <> {root}").select("conv", "up"), "high")
        jumps = salted_join(high, now.select(F.col("conv").alias("up"), F.col("up").alias("over")), "up").select("conv", "over")
        step = now.select("conv", "leaves", "saved").join(given, "conv", "left").join(jumps, "conv", "left")
        step = written(step.select("conv", F.col("over").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "sums")
        drop_written(high)
        drop_written(now)
        now = step
    return now.select("conv", "leaves", "saved")


def below(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Owner, d and the sums of ``columns`` over the owner's nodes from depth d on."""
    rows = nodes.select("owner", "d", F.floor(F.col("d") / BLOCK).alias("block"), *columns)
    blocks = rows.groupBy("owner", "block").agg(*[F.sum(c).alias(c) for c in columns])
    after = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("owner", "block", *[F.sum(c).over(after).alias(f"{c}_after") for c in columns]).where(f"{columns[0]}_after is not null")
    along = Window.partitionBy("owner", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("owner", "d", "block", *[F.sum(c).over(along).alias(c) for c in columns]).join(blocks, ["owner", "block"], "left")
    return summed.select("owner", "d", *[(F.col(c) + F.coalesce(f"{c}_after", F.lit(0))).alias(c) for c in columns])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, ends_sha256) of rows (p, ids) that come by p, in the order of their ids; an id list is hashed as it passes."""
    now, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for p, ids in zip(batch.column("p").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if p != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = p, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        columns = list(zip(*out, strict=True)) or [(), ()]
        yield pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["p", "ends_sha256"])
    if state is not None:
        yield pa.record_batch([pa.array([now], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["p", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """p and the digest of the ids of conversations (p, conv) that end there: ids are joined in runs of bounded size first."""
    runs = ends.groupBy("p", F.floor(F.col("conv") / IDS).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return runs.repartition("p").sortWithinPartitions("p", "run").select("p", "ids").mapInArrow(digested, "p string, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie over rebuilt ``conversations``: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes) and ends_sha256."""
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    told, convs = rebuilt(rows)
    paths = written(prefixes(told), "prefixes")
    drop_written(told)
    least = written(minima(paths), "minima")
    root, n = convs.agg(F.min("conv"), F.count("*")).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    chains = written(chains_of(first_owned(paths, least, convs), paths, least, root), "chains")
    ends = paths.join(convs.select("conv", F.col("length").alias("d")), ["conv", "d"]).select("p", "conv")
    ends = ends.union(convs.where("length = 0").select(F.lit("0"), "conv"))
    top = convs.where(f"conv = {root}").select(F.lit("0").alias("p"), F.lit(0).cast("long").alias("d"), F.col("conv").alias("owner"), F.lit(n).alias("n_convs"), F.lit(0).cast("long").alias("n_bytes"))
    nodes = least.select("p", "d", "owner", "n_convs", "n_bytes").union(top).join(ends_of(ends), "p", "left")
    hung = chains.where("parent is not null").groupBy(F.col("parent").alias("owner"), F.col("at").alias("d")).agg(F.count("*").alias("hung"))
    length = chains.select(F.col("conv").alias("owner"), "first", "length", "parent")
    own = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own")
    nodes = salted_join(written(nodes.join(hung, ["owner", "d"], "left").select("owner", "d", "n_convs", own, F.coalesce("hung", F.lit(0)).alias("hung"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")), "nodes"), length, "owner")
    children = F.col("hung") + (F.col("d") < F.col("length")).cast("long")
    nodes = written(nodes.select("owner", "d", "n_convs", "own", "ends_sha256", children.alias("n_children"), F.when(F.col("d") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent")), "nodes")
    each = nodes.groupBy(F.col("owner").alias("conv")).agg(F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum("own").alias("saved"))
    sums = chain_sums(chains.join(each, "conv").select("conv", "parent", "leaves", "saved"), root)
    from_below = chains.where("parent is not null").join(sums, "conv").groupBy(F.col("parent").alias("owner"), F.col("at").alias("d")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    nodes = written(nodes.join(from_below, ["owner", "d"], "left").withColumns({"leaves": F.coalesce("l", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "saved": F.col("own") + F.coalesce("s", F.lit(0))}).drop("l", "s", "own"), "nodes")
    out = nodes.drop("leaves", "saved").join(below(nodes, ["leaves", "saved"]), ["owner", "d"])
    return out.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
