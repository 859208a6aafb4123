"""Substring dedup: fuzzy passages by collinear chaining of shared k-mer seeds.

Seeds are the k-word windows whose hash is among the lowest in SPARSE, which
depends on their words alone, and minimizers where a window has none: any run
of K + WINDOW - 1 equal words shares one. Every seed names one partner - its
earliest occurrence, however many there are - so seeds cost one match each.
Where neighbouring seeds of a document name different places, the two
together are a junction, which names its own earliest occurrence, so a
passage whose parts stand in other documents meets the first that has them
side by side. The matches of a pair
of documents are chained in order of both positions; each match has its best
predecessor in a window of GAP words under a gap cost, from Fenwick trees.
Chains are aligned over the words of both documents and extended at their
ends, however far and past words put in or left out; aligned passages of at
least MIN_WORDS words with MATCHED of their words equal are returned.

Documents with equal words are one class, held by the smallest doc_id: each
later copy is one passage of its whole text. Words are lower-cased runs
between white space; positions are word numbers, ends exclusive. Passages
that repeat within one document are found as well. Defined cases: null,
empty and short texts have no passages; rows of one doc_id are one document;
a null doc_id has none; repeated rows are copies; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relsight.llm.arrays import gram_hashes, hash_words, ragged, slices
from relsight.llm.shared import drop_written, salted_join, settings, written

K, WINDOW, MIN_WORDS, MATCHED = 6, 16, 50, 0.8
#: One of how many windows is a seed.
SPARSE = 6
#: Places of a seed in a slice that meet all others of the seed in one task; later ones, if any, are told its first place by a join.
FEW = 16
#: Words that a gap within a chain may span, cost of a word of gap in seed words, and how far an extension may fall.
GAP, COST, DROP = 64, 0.1, 6
#: Words that an extension skips on one side and the other, each of which costs as much as a mismatch.
SKIPS = [(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1), (0, 3), (3, 0)]
#: Words around a chain that its first alignment sees; those that need more get four times as many each time.
MARGIN = 128
#: Chains of a pair that begin in one square of BLOCK words travel as one row; chains that a task aligns at once.
BLOCK, ONCE = 512, 4096


def minimizers(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and positions of the seeds of all documents of a slice."""
    grams = gram_hashes(words, K)
    counts = np.maximum(np.diff(rows) - K + 1, 0)
    seed = np.zeros(len(grams), bool)
    for i in np.flatnonzero((counts > 0) & (counts < WINDOW)).tolist():
        seed[rows[i] + int(grams[rows[i] : rows[i] + counts[i]].argmin())] = True
    if len(grams) >= WINDOW:
        low, least = grams, np.arange(len(grams))
        step = 1
        while step < WINDOW:
            # Two windows of step grams make one of two steps, or of WINDOW at last; the left one wins ties.
            shift = min(step, WINDOW - step)
            right = low[shift:] < low[:-shift]
            low = np.where(right, low[shift:], low[:-shift])
            least = np.where(right, least[shift:], least[:-shift])
            step += shift
        seed[least[ragged(rows[:-1], np.maximum(counts - WINDOW + 1, 0))]] = True
    every = ragged(rows[:-1], counts)
    seed[every[grams[every] < np.uint64((1 << 64) // SPARSE)]] = True
    found = np.flatnonzero(seed)
    doc = np.searchsorted(rows, found, side="right") - 1
    return grams[found], doc, found - rows[doc]


def crowded(grams: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """2 for each place of a seed in a slice past its FEW first, 1 for the last before those, else 0."""
    order = np.lexsort((pos, ids, grams))
    by = grams[order]
    late = by[FEW:] == by[:-FEW]
    out = np.zeros(len(by), np.int8)
    out[order[FEW - 1 : -1]] = late
    out[order[FEW:][late]] = 2
    return out


def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds in order of their hash: the match of each with its hash's first; with b null, the first where many = 1."""
    names = ("h", "doc_id", "pos", "many")

    def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.size:
            h, doc, pos, many = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
            at = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
            a, first = doc[at], pos[at]
            met, ones = np.flatnonzero((doc != a) | (pos != first)), np.flatnonzero(many == 1)
            out = np.concatenate([met, ones])
            none = np.arange(len(out)) >= len(met)
            yield pa.record_batch([pa.array(a[out]), pa.array(first[out], pa.int32()), pa.array(doc[out], mask=none), pa.array(pos[out], pa.int32(), mask=none), pa.array(h[out], mask=~none)], names=["a", "pa", "b", "pb", "h"])

    # A hash's places may go on in the next batch: they wait for it.
    held = np.zeros((len(names), 0), np.int64)
    for batch in batches:
        if batch.num_rows:
            rows = np.concatenate([held, np.array([np.asarray(batch.column(c)) for c in names], np.int64)], axis=1)
            done = int(np.searchsorted(rows[0], rows[0, -1]))
            yield from told(rows[:, :done])
            held = rows[:, done:].copy()
    yield from told(held)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in slices(batches, "text"):
        hashes, rows = hash_words(batch.column("text"))
        yield batch.column("doc_id").to_pylist(), [hashes[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


class Maximum:
    """A Fenwick tree: the best of the scores at places below one."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)

    def put(self, place: int, score: float, owner: int) -> None:
        best, i, one = self.best, place + 1, (score, owner)
        while i < len(best):
            if best[i] < one:
                best[i] = one
            i += i & -i

    def below(self, place: int) -> tuple[float, int]:
        best, top, i = self.best, (-np.inf, -1), place
        while i:
            if best[i] > top:
                top = best[i]
            i -= i & -i
        return top


def chains(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Ordered matches (indices into a and b, positions of equal seeds) of each chain, best first, no match in two.

    The gap cost is linear in the words skipped on both sides. A match's best
    predecessor comes from Fenwick trees over squares of REACH words of both
    texts: in its own column of squares those before it in ``a``, in the
    column before those less than REACH words back (kept in reversed order).
    Trees of rows more than one behind in ``b`` are let go, so matches within
    GAP words of each other always meet, and memory follows the window.
    """
    order = np.lexsort((a, b)).tolist()
    at_a, at_b = a.tolist(), b.tolist()
    score, back = np.zeros(len(a)), [-1] * len(a)
    size = GAP + K
    row, now, before = -1, {}, {}
    for i in order:
        x, y = at_a[i], at_b[i]
        if y // size != row:
            before = now if y // size == row + 1 else {}
            row, now = y // size, {}
        column, place = divmod(x, size)
        best, to = COST * (x + y), -1
        for trees in (now, before):
            if column in trees:
                best, to = max((best, to), trees[column][0].below(place))
            if column - 1 in trees:
                best, to = max((best, to), trees[column - 1][1].below(size - 1 - place))
        score[i], back[i] = K + best - COST * (x + y), to
        if column not in now:
            now[column] = (Maximum(size), Maximum(size))
        up, down = now[column]
        worth = best + K
        up.put(place, worth, i)
        down.put(size - 1 - place, worth, i)
    used = [False] * len(a)
    out = []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def apart(a: np.ndarray, b: np.ndarray, chain: list[int]) -> list[list[int]]:
    """A chain within one document, cut so that each part's matches in ``a`` begin before its first one in ``b``.

    Room is left for the words before a first seed, so that the extension isn't cut short by the chain's end.
    """
    parts, start = [], 0
    while start < len(chain):
        x, y = a[chain[start]], b[chain[start]]
        end = y - min(x, WINDOW + K)
        n = int(np.searchsorted(a[chain[start:]], end if end > x else y))
        parts.append(chain[start : start + n])
        start += n
    return parts


def between(x: np.ndarray, y: np.ndarray) -> int:
    """Words that an alignment of two short gaps matches (longest common subsequence)."""
    if len(x) == len(y):
        same = int((x == y).sum())
        if same * 2 >= len(x):
            return same
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == w)))
    return int(row[-1])


def stretch(x: np.ndarray, y: np.ndarray) -> tuple[int, int, bool]:
    """How far equal positions go on, and the matches there, before the score falls by DROP; and whether the words end before it falls."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0, True
    step = 256
    while True:
        same = x[: min(n, step)] == y[: min(n, step)]
        score = np.cumsum(np.where(same, 1, -2))
        fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= DROP)
        if len(fallen) or step >= n:
            score = score[: fallen[0]] if len(fallen) else score
            top = int(score.argmax()) if len(score) else 0
            far, matched = (top + 1, int(same[: top + 1].sum())) if len(score) and score[top] > 0 else (0, 0)
            return far, matched, not len(fallen)
        step *= 4


def stretches(words: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``stretch`` of many pairs at once: they begin at x and y, go on for n words at most, forwards or backwards (way)."""
    last = max(len(words) - 1, 0)
    far, matched, unfallen = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    left = np.arange(len(n))
    for width in (32, 256):
        step = np.arange(width)
        inside = step < n[left, None]
        go = np.where(inside, way * step, 0)
        same = inside & (words[np.clip(x[left, None] + go, 0, last)] == words[np.clip(y[left, None] + go, 0, last)])
        # Words past an end count as mismatches: they only bring the fall that ends a pair.
        score = np.cumsum(np.where(same, 1, -2), axis=1)
        fell = np.maximum.accumulate(np.maximum(score, 0), axis=1) - score >= DROP
        live = ~np.maximum.accumulate(fell, axis=1) & inside
        score = np.where(live, score, -1)
        top = score.argmax(axis=1)
        one = np.arange(len(left))
        some = score[one, top] > 0
        far[left] = np.where(some, top + 1, 0)
        matched[left] = np.where(some, np.cumsum(same, axis=1)[one, top], 0)
        unfallen[left] = ~(fell & inside).any(axis=1)
        left = left[unfallen[left] & (n[left] > width)]
        if not len(left):
            return far, matched, unfallen
    for i in left.tolist():
        u, v = x[i] + way * np.arange(n[i]), y[i] + way * np.arange(n[i])
        far[i], matched[i], unfallen[i] = stretch(words[u], words[v])
    return far, matched, unfallen


def extended(words: np.ndarray, starts: list[np.ndarray], have: list[np.ndarray], room: list[np.ndarray], goes_on: list[np.ndarray], way: int) -> tuple[np.ndarray, ...]:
    """How far pairs of places go on in either text (first, second), the words matched, and which need more words.

    Equal positions go on as in ``stretches``; where they stop, some words of
    one text or both are skipped if that gains more than it costs. have: words
    given from the places on; room: words that may be taken.
    """
    n = len(starts[0])
    far, matched, more = [np.zeros(n, np.int64), np.zeros(n, np.int64)], np.zeros(n, np.int64), np.zeros(n, bool)
    left = np.arange(n)
    last = max(len(words) - 1, 0)

    def tried(rows: np.ndarray, skip: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """What rows gain by going on after a skip, and how far and how well they match."""
        at = [far[k][rows] + skip[k] for k in (0, 1)]
        given = [have[k][rows] - at[k] for k in (0, 1)]
        free = np.minimum(room[0][rows] - at[0], room[1][rows] - at[1])
        most = np.maximum(np.minimum(np.minimum(given[0], given[1]), free), 0)
        begin = [starts[k][rows] + way * at[k] for k in (0, 1)]
        ends = (free > most) & ((given[0] > most) | goes_on[0][rows]) & ((given[1] > most) | goes_on[1][rows])
        go, m, unfallen = stretches(words, *begin, most, way)
        more[rows[unfallen & ends]] = True
        gain = 3 * m - 2 * go - 2 * max(skip)
        return gain, np.column_stack([go, m])

    _, found = tried(left, (0, 0))
    far, matched = [far[k] + found[:, 0] for k in (0, 1)], found[:, 1]
    step = np.arange(8)
    while len(left):
        # The next words of both texts; those past an end equal nothing.
        ahead = []
        for k in (0, 1):
            given, free = have[k][left] - far[k][left], room[k][left] - far[k][left]
            go = far[k][left][:, None] + step
            some = words[np.clip(starts[k][left][:, None] + way * go, 0, last)].astype(np.int64)
            ahead.append(np.where(step < np.minimum(given, free)[:, None], some, -1 - k))
            more[left[(given < 8) & (free > given) & goes_on[k][left]]] = True
        best = np.zeros(n, np.int64)
        new = np.zeros((n, 3), np.int64)
        for skip in SKIPS:
            # Three of the five words after the skip are equal, else nothing is gained soon.
            rows = left[(ahead[0][:, skip[0] : skip[0] + 5] == ahead[1][:, skip[1] : skip[1] + 5]).sum(axis=1) >= 3]
            if not len(rows):
                continue
            gain, found = tried(rows, skip)
            better = gain > best[rows]
            rows, found = rows[better], found[better]
            best[rows] = gain[better]
            new[rows] = np.column_stack([found[:, 0] + skip[0], found[:, 0] + skip[1], found[:, 1]])
        left = np.flatnonzero(best)
        far[0], far[1], matched = far[0] + new[:, 0], far[1] + new[:, 1], matched + new[:, 2]
    return far[0], far[1], matched, more


def align(words: np.ndarray, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray, ahead: np.ndarray, goes_on: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Bounds in both texts and matched words of chains, extended at both ends, and which chains need more words.

    goes_on: whether the texts have words before those given (first, second),
    and after them. A chain needs more where an extension reaches their end
    before it falls, so bounds don't depend on how many words are given.

    ahead: words from a place 0 of the first text to the second's, if both are
    of one document, or more than any text has. Sides never meet: an extension
    ends where they would, and equal words at the chain's end are cut.

    Text pair i holds the words x[i] to x[i] + nx[i] and y[i] to y[i] + ny[i];
    its chain is the positions a and b from rows[i] to rows[i + 1].
    """
    first, last = rows[:-1], rows[1:] - 1
    da, db = np.diff(a, prepend=0), np.diff(b, prepend=0)
    gain = np.where((da == db) & (da <= K), da, np.where((da < K) | (db < K), np.minimum(da, db), K))
    gapped = (da >= K) & (db >= K) & ~((da == db) & (da <= K))
    gain[first], gapped[first] = K, False
    owner = np.repeat(np.arange(len(x)), np.diff(rows))
    for i in np.flatnonzero(gapped).tolist():
        u, v = x[owner[i]], y[owner[i]]
        gain[i] += between(words[u + a[i - 1] + K : u + a[i]], words[v + b[i - 1] + K : v + b[i]])
    matched = np.add.reduceat(gain, first)
    a0, b0, a1, b1 = a[first], b[first], a[last] + K, b[last] + K
    free = np.full(len(x), 1 << 40)
    room = np.maximum(b0 + ahead - a[last] - 1, 0)
    n, n2, m, more = extended(words, [x + a0 - 1, y + b0 - 1], [a0, b0], [free, room], goes_on[:2], -1)
    over = np.clip(a1 - (b0 - n2 + ahead), 0, K)
    a1, b1, matched = a1 - over, b1 - over, matched - over
    room = np.maximum(b0 - n2 + ahead - a1, 0)
    after, after2, m2, again = extended(words, [x + a1, y + b1], [nx - a1, ny - b1], [room, free], goes_on[2:], 1)
    return a0 - n, a1 + after, b0 - n2, b1 + after2, matched + m + m2, more | again


OUT = "doc_id long, start int, end int, source_id long, source_start int, source_end int, matched int"
CHAINS = "a long, b long, low_a int, high_a int, low_b int, high_b int, pa array<int>, pb array<int>, sizes array<int>"


def passages(docs: DataFrame, min_words: int = MIN_WORDS, matched_share: float = MATCHED) -> DataFrame:
    """doc_id, start, end, source_id, source_start, source_end and matched of every repeated passage."""
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=1000):
        return _found(docs, min_words, matched_share)


def _found(docs: DataFrame, min_words: int, matched_share: float) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, doc_id, pos) of the seeds, and at last, so that either can be read without the other, (words, doc_id, -1, key) of every document."""
        names, about = ["h", "doc_id", "pos", "many", "key"], []
        for batch in slices(batches, "text"):
            words, at = hash_words(batch.column("text"))
            ids = np.asarray(batch.column("doc_id"))
            keys = [xxhash.xxh3_128_digest(words[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            best: dict[bytes, int] = {}
            for i, k in enumerate(keys):
                if k not in best or ids[i] < ids[best[k]]:
                    best[k] = i
            h, doc, pos = minimizers(words, at)
            keep = np.isin(doc, np.fromiter(best.values(), np.int64, count=len(best)))
            h, owner, pos = h[keep], ids[doc[keep]], pos[keep]
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(owner), pa.array(pos.astype(np.int32)), pa.array(crowded(h, owner, pos)), pa.nulls(len(h), pa.binary())], names=names)
            about.append(pa.record_batch([pa.array(np.diff(at).astype(np.int64)), pa.array(ids), pa.array(np.full(len(ids), -1, np.int32)), pa.nulls(len(ids), pa.int8()), pa.array(keys, pa.binary())], names=names))
        yield from about

    seen = written(text.mapInArrow(seeds, "h long, doc_id long, pos int, many byte, key binary"), "seeds")
    info = written(seen.where("pos = -1").select("doc_id", "key", F.col("h").cast("int").alias("n")).groupBy("doc_id").agg(F.min(F.struct("key", "n")).alias("x")).select("doc_id", "x.*"), "info")
    firsts = info.groupBy("key").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("copies"))
    copies = written(info.join(firsts.where("copies > 1"), "key").where("doc_id <> source_id").select("doc_id", "source_id", "n"), "copies")
    drop_written(info)

    # Seeds travel once: in order of their hash, each is told the first place. A slice sends at most FEW of a hash; the others meet its first place in a join.
    few = seen.where("pos >= 0 and many < 2").select("h", "doc_id", "pos", "many").repartition("h").sortWithinPartitions("h")
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=20000):
        met = written(few.mapInArrow(first_places, "a long, pa int, b long, pb int, h long"), "met")
    late = salted_join(seen.where("many = 2").select("h", "doc_id", "pos"), met.where("b is null").select("h", "a", "pa").distinct(), "h")
    late = late.where("doc_id <> a or pos <> pa").select("a", F.col("doc_id").alias("b"), "pa", F.col("pos").alias("pb"))
    matches = met.where("b is not null").select("a", "b", "pa", "pb").union(late)
    # Where a document's neighbouring seeds lead elsewhere, their earliest occurrences name the junction.
    before = F.lag(F.struct("a", "pa", "pb")).over(Window.partitionBy("b").orderBy("pb", "a"))
    parted = (F.col("a") != F.col("q.a")) | (F.abs(F.col("pb") - F.col("pa") - F.col("q.pb") + F.col("q.pa")) > GAP)
    joint = F.when(parted & (F.col("pb") - F.col("q.pb") <= GAP), F.xxhash64("q.a", "q.pa", "a", "pa"))
    # Kept in order of documents, in which neighbouring matches are alike and take little room.
    placed = written(matches.withColumn("q", before).select("a", "b", "pa", "pb", joint.alias("h")), "matches")
    drop_written(seen)
    drop_written(met)
    joints = placed.where("h is not null").select("h", F.col("b").alias("doc_id"), F.col("pb").alias("pos"))
    joint = joints.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h", F.col("f.doc_id").alias("a"), F.col("f.pos").alias("pa"), "n")
    joint = written(joint, "joint")
    joined = salted_join(joints, joint.drop("n"), "h", joint).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), "pa", F.col("pos").alias("pb"))
    matches = placed.drop("h").union(joined)
    # A copy's passage is its class's; only first documents are compared.
    gone = copies.select("doc_id")
    pairs = matches.groupBy("a", "b").agg(F.array_sort(F.collect_set(F.struct("pa", "pb"))).alias("m"))
    pairs = pairs.join(gone.select(F.col("doc_id").alias("a")), "a", "left_anti").join(gone.select(F.col("doc_id").alias("b")), "b", "left_anti")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of a pair by the squares that they begin in: bounds of all, their matches in a row, and how many each has."""
        names = [x.split()[0] for x in CHAINS.split(", ")]
        types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 3
        for whole in batches:
            for batch in (whole.slice(lo, 200) for lo in range(0, whole.num_rows, 200)):
                out: list[tuple] = []
                for a, b, m in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("m"), strict=True):
                    x, y = (m.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                    at_a, at_b = x.tolist(), y.tolist()
                    squares: dict[tuple[int, int], list[list[int]]] = {}
                    for chain in chains(x, y):
                        for part in apart(x, y, chain) if a == b else [chain]:
                            squares.setdefault((at_a[part[0]] // BLOCK, at_b[part[0]] // BLOCK), []).append(part)
                    for parts in squares.values():
                        ends = [f(at[part[k]] for part in parts) for at in (at_a, at_b) for f, k in ((min, 0), (max, -1))]
                        every = [i for part in parts for i in part]
                        out.append((a, b, *ends, [at_a[i] for i in every], [at_b[i] for i in every], [len(part) for part in parts]))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    found = written(pairs.mapInArrow(chained, CHAINS), "chains")
    drop_written(placed)
    drop_written(joint)

    def word_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Half of each word's hash is enough to compare words in a known place.
        for ids, found in texts(batches):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([w.astype(np.uint32).tobytes() for w in found], pa.binary())], names=["doc_id", "w"])

    wanted = found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct()
    words = written(text.mapInArrow(word_arrays, "doc_id long, w binary").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "words")

    def near(some: DataFrame, margin: int) -> DataFrame:
        """Chains with their words and ``margin`` words more on each side; more_a and more_b tell where a text goes on beyond."""
        out = salted_join(some, words.select(F.col("doc_id").alias("a"), F.col("w").alias("wa")), "a")
        out = part(out, "a", margin).join(words.select(F.col("doc_id").alias("b"), F.col("w").alias("wb")), "b")
        return part(out, "b", margin).select("a", "b", "pa", "pb", "sizes", "from_a", "from_b", "wa", "wb", "more_a", "more_b")

    def part(rows: DataFrame, side: str, margin: int) -> DataFrame:
        w = F.col(f"w{side}")
        from_ = F.greatest(F.col(f"low_{side}") - margin, F.lit(0))
        to = F.least(F.col(f"high_{side}") + K + margin, (F.octet_length(w) / 4).cast("int"))
        more = to * 4 < F.octet_length(w)
        return rows.withColumns({f"from_{side}": from_, f"more_{side}": more, f"w{side}": F.substring(w, from_ * 4 + 1, (to - from_) * 4)})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of about ONCE chains and at most 200 rows; a row has at most one chain a word of its square."""
        for batch in batches:
            chains_before = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("sizes")).to_numpy(zero_copy_only=False))])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, min(lo + 200, int(np.searchsorted(chains_before, chains_before[lo] + ONCE, side="right")) - 1))
                yield batch.slice(lo, hi - lo)
                lo = hi

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        lists = pa.list_(pa.int32())
        for batch in pieces(batches):
            n = batch.num_rows
            a, b, from_a, from_b, more_a, more_b = (np.asarray(batch.column(c)) for c in ("a", "b", "from_a", "from_b", "more_a", "more_b"))
            parts = [*batch.column("wa").to_pylist(), *batch.column("wb").to_pylist()]
            sizes = np.array([len(part) // 4 for part in parts])
            starts = np.cumsum(sizes) - sizes
            # From here on, all by chain.
            row = np.repeat(np.arange(n), pc.list_value_length(batch.column("sizes")).to_numpy(zero_copy_only=False))
            length = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
            rows = np.concatenate([[0], np.cumsum(length)])
            a, b, from_a, from_b, more_a, more_b = a[row], b[row], from_a[row].astype(np.int64), from_b[row].astype(np.int64), more_a[row], more_b[row]
            nx, ny = sizes[row], sizes[row + n]
            at_a, at_b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pa", "pb"))
            p, q = at_a - np.repeat(from_a, length), at_b - np.repeat(from_b, length)
            ahead = np.where(a == b, from_b - from_a, 1 << 40)
            a0, a1, b0, b1, m, again = align(np.frombuffer(b"".join(parts), np.uint32), starts[row], nx, starts[row + n], ny, rows, p, q, ahead, [from_a > 0, from_b > 0, more_a, more_b])
            ok = (b1 - b0 >= min_words) & (m >= matched_share * np.maximum(a1 - a0, b1 - b0)) & ~again
            a0, a1, b0, b1 = a0 + from_a, a1 + from_a, b0 + from_b, b1 + from_b
            ok &= ~((a == b) & (b0 < a1) & (a0 < b1))
            out = np.unique(np.column_stack([b, b0, b1, a, a0, a1, m])[ok], axis=0)
            if len(out):
                yield pa.record_batch([*(pa.array(c, t) for c, t in zip(out.T, types, strict=True)), pa.nulls(len(out), lists), pa.nulls(len(out), lists)], names=[*names, "pa", "pb"])
            left = np.flatnonzero(again)
            if len(left):
                none = pa.nulls(len(left), pa.int32())
                matches = [pa.array([at[rows[i] : rows[i + 1]] for i in left.tolist()], lists) for at in (at_a, at_b)]
                yield pa.record_batch([pa.array(b[left]), none, none, pa.array(a[left]), none, none, none, *matches], names=[*names, "pa", "pb"])

    def rounds() -> Iterator[DataFrame]:
        """Passages of all chains, with four times as many words around those that need more each time."""
        some, margin = found, MARGIN
        while True:
            out = written(near(some, margin).mapInArrow(aligned, f"{OUT}, pa array<int>, pb array<int>"), "aligned")
            yield out.where("pa is null").drop("pa", "pb")
            bounds = [F.element_at(f"p{side}", k).alias(f"{name}_{side}") for side in "ab" for name, k in (("low", 1), ("high", -1))]
            some = out.where("pa is not null").select(F.col("source_id").alias("a"), F.col("doc_id").alias("b"), *bounds, "pa", "pb", F.array(F.size("pa")).alias("sizes"))
            if some.isEmpty():
                return
            margin *= 4

    fuzzy = reduce(DataFrame.union, rounds()).distinct()
    whole = copies.where(F.col("n") >= min_words).select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end"), "source_id", F.lit(0).alias("source_start"), F.col("n").alias("source_end"), F.col("n").alias("matched"))
    for table in (found, words):
        drop_written(table)
    return fuzzy.union(whole)
