"""A Merkle manifest: a tree of digests a group, a tree over the groups' roots, and proofs.

Leaves get their place in their group (``order.placed``), so each node's
address (level, index) and each parent's number of children follow from the
group's size. Building is driven by events: a digest that becomes known goes
to its parent, which gathers digests by index and, once all of its children
are there, emits its own. That happens first inside the tasks that read the
leaves; parents that some task could not fill form the frontier, which is
dealt anew by ancestors STRATUM levels up, then by higher ones, until none is
left. A finished parent is kept with its children: the link back.

Proofs follow the links back from the roots, STRATUM levels at a time: the
links below one ancestor meet its own proof in one task, which hands proofs
down to the ancestors of the next stratum and in the end to the leaves. A
group's root begins with its proof in the tree over the groups.

A proof is bytes: for each level from the leaf up, the node's index among its
parent's children, the number of its siblings, and their digests from left to
right.

Defined cases: a null group is a group; nulls in hashed columns are hashed as
``-``; null ids come first; rows of one id in a group stand in the order of
their digests, and equal ones are leaves of their own; an empty table gives
no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsight.llm.order import placed
from relsight.llm.shared import small_batches, written

ARITY = 3
#: Levels that one ancestor has below it in a task: at most 3^6 leaves and 364 links.
STRATUM = 6
#: Parents that a task fills at once before it hands them on unfinished.
OPEN = 100_000
#: Rows that a task takes in or gives out at once.
ROWS = 2000
NODE = "g string, n long, level int, idx long"


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (bytes) of columns, each ``-`` if null, else its text's bytes, ``:`` and its text."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def parent_digest(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as hexadecimal text."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def nodes_at(n: int, level: int) -> int:
    """Nodes of a level of the tree over n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def height(n: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents (NODE, children, digest) that the given children fill, and unfinished ones (digest null).

    Rows are leaves (level 0 and a digest) or unfinished parents of another task.
    """
    waiting: dict[tuple, list] = {}
    out: list[tuple] = []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["g", "n", "level", "idx", "children", "digest"])

    def unfinished() -> Iterator[pa.RecordBatch]:
        rows = [(*key, children, None) for key, children in waiting.items()]
        waiting.clear()
        for lo in range(0, len(rows), ROWS):
            yield table(rows[lo : lo + ROWS])

    def arrive(g: str | None, n: int, level: int, idx: int, digest: bytes) -> None:
        """A node's digest is known; it goes to the parent, and on from there while parents become full."""
        size = nodes_at(n, level)
        while size > 1:
            at, slot = divmod(idx, ARITY)
            key = (g, n, level + 1, at)
            children = waiting.get(key)
            if children is None:
                children = waiting[key] = [None] * min(ARITY, size - ARITY * at)
            children[slot] = digest
            if None in children:
                return
            del waiting[key]
            digest = parent_digest(children)
            out.append((*key, children, digest))
            level, idx, size = level + 1, at, -(-size // ARITY)

    for batch in batches:
        children = batch.column("children").to_pylist() if "children" in batch.schema.names else [None] * batch.num_rows
        for g, n, level, idx, digest, known in zip(*[batch.column(c).to_pylist() for c in ("g", "n", "level", "idx", "digest")], children, strict=True):
            if known is None:
                arrive(g, n, level, idx, digest)
            else:
                for slot, child in enumerate(known):
                    if child is not None:
                        arrive(g, n, level - 1, ARITY * idx + slot, child)
            if len(out) >= ROWS:
                yield table(out)
                out.clear()
        if len(waiting) > OPEN:
            yield from unfinished()
    if out:
        yield table(out)
    yield from unfinished()


def ancestor(top: int) -> Column:
    """The index of a node's ancestor at level ``top``."""
    up = F.array(*[F.lit(ARITY**i) for i in range(top + 1)])
    return F.floor(F.col("idx") / F.get(up, F.greatest(F.lit(top) - F.col("level"), F.lit(0)))).cast("long")


def links_of(leaves: DataFrame) -> DataFrame:
    """All parents of the trees over ``leaves`` (g, n, pos, digest), with their children."""
    small_batches(leaves.sparkSession, ROWS)
    schema = f"{NODE}, children array<binary>, digest binary"
    rows = leaves.select("g", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest")
    done, top = [], STRATUM
    while True:
        step = written(rows.mapInArrow(gathered, schema), "nodes")
        done.append(step.where("digest is not null"))
        frontier = step.where("digest is null")
        if frontier.isEmpty():
            break
        # What lies below one ancestor meets; higher unfinished parents wait for a later turn.
        top = min(top, 30)
        dealt = frontier.withColumn("up", F.when(F.col("level") <= top, ancestor(top)).otherwise(F.col("idx")))
        rows = dealt.repartition("g", "up").sortWithinPartitions("g", "up", "level").drop("up")
        top += STRATUM
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def handed_down(bottom: int):
    """Proofs of the nodes at level ``bottom``, from those of ancestors and the links between; rows come by ancestor: proofs (kind 0), links from the top (1), leaves (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, proofs, root = None, {}, None
        for batch in batches:
            found, nodes = [], []
            columns = [batch.column(c).to_pylist() for c in ("g", "up", "kind", "n", "level", "idx", "children", "proof", "root")]
            for g, up, kind, n, level, idx, children, proof, top in zip(*columns, strict=True):
                if (g, up) != now:
                    now, proofs = (g, up), {}
                if kind == 0:
                    proofs[level, idx], root = proof, top
                elif kind == 1:
                    above = proofs.pop((level, idx))
                    for slot in range(len(children)):
                        own = bytes([slot, len(children) - 1]) + b"".join(children[:slot] + children[slot + 1 :]) + above
                        proofs[level - 1, ARITY * idx + slot] = own
                        if bottom and level - 1 == bottom:
                            nodes.append((g, n, bottom, ARITY * idx + slot, own, root))
                else:
                    found.append((proofs.pop((0, idx)), root))
            if bottom:
                types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                lists = list(zip(*nodes, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(lists, types, strict=True)], names=["g", "n", "level", "idx", "proof", "root"])
            else:
                own = batch.filter(pa.array([k == 2 for k in columns[2]]))
                lists = list(zip(*found, strict=True)) or [(), ()]
                yield pa.record_batch([own.column("row"), *[pa.array(c, pa.binary()) for c in lists]], names=["row", "proof", "root"])

    return run


def proofs_of(leaves: DataFrame, links: DataFrame, tops: DataFrame) -> DataFrame:
    """row, proof and root of each leaf (g, n, pos, row); ``tops`` are g, n, proof and root of the trees' roots."""
    row = leaves.schema["row"].dataType.simpleString()
    largest = tops.agg(F.max("n")).first()[0]
    strata = max(1, -(-height(largest or 1) // STRATUM))
    # The level of a tree's root: as often as its size can be divided.
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(strata * STRATUM)), F.struct(F.col("n").alias("n"), F.lit(0).alias("h")), lambda a, _: F.when(a["n"] > 1, F.struct(F.ceil(a["n"] / ARITY).cast("long").alias("n"), (a["h"] + 1).alias("h"))).otherwise(a))["h"]
    given = tops.select("g", "n", levels.alias("level"), F.lit(0).cast("long").alias("idx"), "proof", "root")
    blank = lambda c, kind: F.lit(None).cast(kind).alias(c)
    for s in reversed(range(strata)):
        bottom, top = s * STRATUM, (s + 1) * STRATUM
        # Roots up to the stratum's own top begin in it; a root at its bottom belongs to the one below.
        here = given.where((F.col("level") <= top) & ((F.col("level") > bottom) if bottom else F.lit(True)))
        parts = [here.select("g", "n", "level", "idx", F.lit(0).alias("kind"), blank("children", "array<binary>"), "proof", "root", blank("row", row))]
        parts.append(links.where(F.col("level").between(bottom + 1, top)).select("g", "n", "level", "idx", F.lit(1).alias("kind"), "children", blank("proof", "binary"), blank("root", "binary"), blank("row", row)))
        if not bottom:
            parts.append(leaves.select("g", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.lit(2).alias("kind"), blank("children", "array<binary>"), blank("proof", "binary"), blank("root", "binary"), "row"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.union(part)
        rows = rows.withColumn("up", ancestor(top)).repartition("g", "up").sortWithinPartitions(F.asc_nulls_first("g"), "up", "kind", F.desc("level"))
        if not bottom:
            return rows.mapInArrow(handed_down(0), f"row {row}, proof binary, root binary")
        down = rows.mapInArrow(handed_down(bottom), f"{NODE}, proof binary, root binary")
        given = written(down, "proofs").union(given.where(F.col("level") <= bottom))
    raise AssertionError("there is a lowest stratum")


def manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame, bytes | None]:
    """(row, proof, root) of every leaf; the parents of the groups' trees, with their children; and the digest over all.

    ``rows`` hold g (the group, a string), what orders leaves in it (``by``),
    the leaf's ``digest`` and ``row``, a struct that is handed through;
    ``root`` is the group's. The digest over all is null for no rows.
    """
    leaves = placed(rows.select("g", "by", "digest", "row"), ["g"], [F.asc_nulls_first("by"), F.col("digest")], "leaves")
    links = links_of(leaves)
    ends = links.where("idx = 0").groupBy("g").agg(F.max_by("digest", "level").alias("digest"), F.any_value("n").alias("size"))
    ends = ends.union(leaves.where("n = 1").select("g", "digest", F.col("n").alias("size")))
    groups = placed(ends, [], [F.asc_nulls_first("g")], "roots").select(F.lit("").alias("g"), "n", "pos", "digest", F.struct("g", "size", "digest").alias("row"))
    over = links_of(groups)
    last = groups.where("n = 1").select("n", "digest").union(over.where("idx = 0").orderBy(F.desc("level")).limit(1).select("n", "digest")).first()
    top = rows.sparkSession.createDataFrame([("", last["n"], b"", b"")] if last else [], "g string, n long, proof binary, root binary")
    tops = proofs_of(groups, over, top).select("row.g", F.col("row.size").alias("n"), "proof", F.col("row.digest").alias("root"))
    return proofs_of(leaves, links, written(tops, "tops")), links, last and bytes(last["digest"])


def siblings(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The node's index among its parent's children and the digests of the others, level by level."""
    at = 0
    while at < len(proof):
        slot, others = proof[at], proof[at + 1]
        yield slot, [proof[i : i + 32] for i in range(at + 2, at + 2 + 32 * others, 32)]
        at += 2 + 32 * others


def fold(digest: bytes, proof: bytes) -> bytes:
    """The digest over all that follows from a leaf's digest and its proof."""
    for slot, others in siblings(proof):
        digest = parent_digest([*others[:slot], digest, *others[slot:]])
    return digest


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, root, proof_sha256, folded) of (row, proof, root, digest): the digest of all siblings and what ``fold`` makes of ``digest``."""
    for batch in batches:
        proofs = batch.column("proof").to_pylist()
        joined = [hashlib.sha256("".join(d.hex() for _, others in siblings(p) for d in others).encode()).hexdigest() for p in proofs]
        ends = [fold(d, p) for d, p in zip(batch.column("digest").to_pylist(), proofs, strict=True)]
        yield pa.record_batch([batch.column("row"), batch.column("root"), pa.array(joined, pa.string()), pa.array(ends, pa.binary())], names=["row", "root", "proof_sha256", "folded"])


def verified(proved: DataFrame, digest: Column) -> DataFrame:
    """row, root, proof_sha256 and the digest over all (``folded``) that follows from ``digest`` and each row's proof."""
    row = proved.schema["row"].dataType.simpleString()
    return proved.select("row", "proof", "root", digest.alias("digest")).mapInArrow(folded, f"row {row}, root binary, proof_sha256 string, folded binary")
