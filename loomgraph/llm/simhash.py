"""SimHash near-duplicates by deletion-variant signatures (operator 7).

A fingerprint is 64 bits, or more words of 64 from the same shingle hashes.  It is cut into segments, fewer
than a pair's differing bits would need for an equal one: two that differ in at most 2 * segments - 1 bits have
a segment in which they differ in at most one.  For each bit the segment around it without that bit is a
signature, so such two share a signature.  Of two halves of that segment one is equal, so a row for each half is
dealt by the half's value, and the signatures are made from it where it arrives: two rows a segment travel, not
one for each bit.  Rows of equal signatures that pass the distance are links, or candidates for a comparison of
the whole shingle sets.

Copies share a fingerprint and are one point from the start, named by the least doc_id among them, so the least
name of a component is its component_id.  Within a signature's rows a family of near copies costs pairs in
proportion to its size.  A signature with too many rows for one task is cut into blocks and its pairs of blocks
are dealt out.  Components then grow together over tables in the shared folder.

Candidates are thinned to forests before whole sets are compared, and two similar sets need not share a signature.
So whatever components that leaves apart are held against each other without fingerprints (``missed``): sets of a
similarity share one of the first shingles that they have in an order common to all, and every pair that does and is
not joined yet is compared.  The groups are those of all pairs.

Defined results: a null or empty text has fingerprint 0, linked like any other; rows that repeat a
doc_id are each in the result; a row with a null doc_id is grouped, but the null is no group's id
unless the group has no other (such groups are named inside by numbers from the top of the range of long: ids
above 2**62 may clash with them, but only if there are null ids); other columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import partitions, ready, written

#: Links that one task holds to join them.
TASK_LINKS = 500_000
#: Least spanning forests of candidates that a share of them keeps, each of what those before leave.
FORESTS = 3
#: Candidates of so small a distance hold, but for few: other pairs between what a chain of them joins are needless.
TIGHT = 13
#: Bytes of text that are cut into words at a time.
TEXT_BLOCK = 4 << 20
#: A shingle of more rows than this comes after all others in the order, unless that makes more of them than can be sent to all tasks.
COMMON, COMMON_MOST = 64, 1 << 20
#: Bits that bound from below in how many shingles two sets differ.
PARITY = 1024
TOP = (1 << 63) - 1


@dataclass(frozen=True)
class Plan:
    """How fingerprints are made and linked.

    ``size``: bits of a fingerprint, in words of 64.  ``cuts``: its segments.
    ``limit``: rows that share a signature are linked if their first two words differ in no more bits.  With one
    word and at most 2 * cuts - 1 all such pairs meet.
    ``similarity``: links are candidates only, and hold if the sets of shingles have this Jaccard similarity (None:
    they hold); fingerprints are then made of the set, else of all shingles with repeats.
    ``sure``: candidates so near that a row they lead to need not be held against others under that signature.
    ``lead``: segments whose links are proven and joined first, so that under the others only pairs of different
    components are candidates (0: all at once).
    """

    words: int = 4
    seed: int = 42
    size: int = 64
    cuts: int = 3
    limit: int = 4
    block: int = 20_000
    similarity: float | None = None
    sure: int = 0
    lead: int = 0

    @property
    def segments(self) -> list[tuple[int, int]]:
        """Bounds of the segments over all bits."""
        at = [self.size * i // self.cuts for i in range(self.cuts + 1)]
        return list(zip(at, at[1:]))

    @property
    def parts(self) -> list[str]:
        """The columns of the words."""
        return [f"w{i}" for i in range(self.size // 64)]


#: Sets of shingles with a similarity of 0.8 differ in some 15 % of the bits, 19 of the first 128 (deviation 4),
#: such with 0.9 in 10 %, unrelated ones in half.  A segment of 24 bits differs in at most one with probability
#: 0.106 at 0.8, 0.166 at 0.85 and 0.273 at 0.9, so of 32 segments one does with 0.972, 0.997 and 1.000.
#: Two unrelated ones share a signature with probability 32 * 24 / 2**23.
SIMILAR = Plan(words=5, size=768, cuts=32, limit=34, similarity=0.8, sure=8, lead=8)


def _blocks(data: bytes):
    """Words of ``data`` in blocks that end at white space."""
    at, blank = 0, re.compile(rb"[ \t-\r]")
    while at < len(data):
        end = at + TEXT_BLOCK
        found = blank.search(data, end) if end < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased, repeats included."""
    from xxhash import xxh64_intdigest

    out, tail = [], []
    for found in _blocks(text.encode().lower()):
        found = tail + found
        tail = found[1 - words :] if words > 1 else []
        if len(found) < words:
            tail = found
            continue
        data = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        begin = [0, *(ends[:-1] + 1).tolist()]
        out.append(np.array([xxh64_intdigest(data[i:j], seed) for i, j in zip(begin, ends[words - 1 :].tolist())], np.uint64))
    if not out:
        return np.array([xxh64_intdigest(b" ".join(tail), seed)] if tail else [], np.uint64)
    return out[0] if len(out) == 1 else np.concatenate(out)


def spread(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` words of 64 bits for each hash, of which the first is itself."""
    if n == 1:
        return hashes[:, None]
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    x[:, 0] = hashes
    return x


def ones(planes: np.ndarray) -> np.ndarray:
    """How often each bit is set over the rows of words: long runs go through full adders, three planes to two."""
    total, weight = np.zeros(planes.shape[1] * 64, np.int64), 1
    while len(planes):
        carry = []
        while len(planes) >= 4096:
            k = len(planes) // 3
            a, b, c = planes[:k], planes[k : 2 * k], planes[2 * k : 3 * k]
            u = a ^ b
            carry.append((a & b) | (u & c))
            planes = np.concatenate([u ^ c, planes[3 * k :]])
        bits = np.unpackbits(planes.astype(">u8").view(np.uint8), axis=1)
        total += weight * np.add.reduce(bits, axis=0, dtype=np.uint16).astype(np.int64)
        planes, weight = np.concatenate(carry) if carry else planes[:0], 2 * weight
    return total


def majority(hashes: np.ndarray, size: int = 64) -> np.ndarray:
    """Words of the bits that over half of the hashes have; 0 without any."""
    n, count = size // 64, np.zeros(size, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        count += ones(spread(hashes[i : i + (1 << 15)], n))
    return np.packbits(2 * count > len(hashes)).view(">u8").astype(np.uint64) if len(hashes) else np.zeros(n, np.uint64)


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, the words (long), and, if sets are compared, d0 and d1: the digest of the whole set."""
    from functools import partial

    ready(docs.sparkSession)
    size, sets, take = plan.size, plan.similarity is not None, partial(shingle_hashes, words=plan.words, seed=plan.seed)
    names = [*plan.parts, *(["d0", "d1"] if sets else [])]

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            found = np.zeros((batch.num_rows, len(names)), np.uint64)
            for i, value in enumerate(batch.column(1)):
                hashes = take(value.as_py() or "")
                if sets:
                    hashes = np.unique(hashes)
                    found[i, -2:] = np.frombuffer(xxh3_128_digest(hashes.tobytes()), np.uint64)
                found[i, : size // 64] = majority(hashes, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.view(np.int64).T.copy())], names=["doc_id", *names])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def same(plan: Plan) -> list[str]:
    """The columns that copies share."""
    return ["w0"] if plan.similarity is None else ["d0", "d1"]


def points(prints: DataFrame, plan: Plan) -> DataFrame:
    """A row for all copies: ``same``, the words, least (their least doc_id) and node (that, or a number if all are null)."""
    rest = [F.min(w).alias(w) for w in plan.parts if w not in same(plan)]
    found = prints.groupBy(*same(plan)).agg(F.min("doc_id").alias("least"), *rest)
    return found.withColumn("node", F.coalesce("least", F.lit(TOP) - F.pmod(F.xxhash64(*same(plan)), F.lit(1 << 62))))


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def segment(lo: int, hi: int) -> Column:
    """The value of the bits from lo to hi; bit 0 is the lowest of w0."""
    word, down = divmod(lo, 64)
    value = F.shiftrightunsigned(F.col(f"w{word}"), down)
    if down + hi - lo > 64:
        value = value.bitwiseOR(F.shiftleft(F.col(f"w{word + 1}"), 64 - down))
    return value.bitwiseAND(F.lit((1 << hi - lo) - 1))


def signatures(fingerprint: int, plan: Plan) -> set[tuple[int, int]]:
    """(bit, the rest of its segment) of a fingerprint: what ``keyed`` makes, for a single one."""
    return {(bit, (fingerprint >> lo & (1 << hi - lo) - 1) & ~(1 << bit - lo)) for lo, hi in plan.segments for bit in range(lo, hi)}


def rest_bits(plan: Plan) -> list[int]:
    """Of the low and of the high half of each segment: how many bits the other half has."""
    return [n for lo, hi in plan.segments for n in (hi - lo - (hi - lo) // 2, (hi - lo) // 2)]


def carried(found: DataFrame, plan: Plan) -> list[str]:
    """The columns that go with a signature: node, the first two words and, if there is one, the root that is known."""
    return ["node", *plan.parts[:2], *(["root"] if "root" in found.columns else [])]


def halves(found: DataFrame, plan: Plan, some: slice = slice(None)) -> DataFrame:
    """packed, node, w0, w1, maybe root: two rows for each of ``some`` segments.  Packed are its number and half (from bit 32), that half's value (from bit 16), by
    which the row is dealt, and the other half's."""
    if max(hi - lo for lo, hi in plan.segments) > 32:
        raise ValueError("a segment has at most 32 bits")
    rows = []
    for i, (lo, hi) in list(enumerate(plan.segments))[some]:
        value, half = segment(lo, hi), (hi - lo) // 2
        low, high = value.bitwiseAND(F.lit((1 << half) - 1)), F.shiftrightunsigned(value, half)
        for side, (own, rest) in enumerate(((low, high), (high, low))):
            rows.append(F.shiftleft(own, 16).bitwiseOR(rest).bitwiseOR(F.lit((2 * i + side) << 32)))
    return found.select(F.explode(F.array(*rows)).alias("packed"), *carried(found, plan))


def keyed(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` of ``halves`` with ``key``, one for each signature: packed without a bit of the other half, and which (from bit 48)."""
    bits = ", ".join(map(str, rest_bits(plan)))
    key = f"transform(sequence(0, element_at(array({bits}), CAST(shiftright(packed, 32) AS INT) + 1) - 1), b -> (packed & ~shiftleft(1L, b)) | shiftleft(CAST(b AS BIGINT), 48))"
    return rows.select(F.explode(F.expr(key)).alias("key"), *[c for c in rows.columns if c != "packed"])


def signature_rows(found: DataFrame, plan: Plan, some: slice = slice(None)) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``halves`` (in order, each half's value whole in a partition), and rows with keys (likewise) of the values that more
    than a block of rows have, or None.

    A key with more than a block of rows has one row for each pair of blocks instead.  There are at most
    2 * cuts * 2**(half a segment's bits) values of halves, so those that are large are broadcast.
    """
    n, names = partitions(found.sparkSession), carried(found, plan)
    rows, coarse = halves(found, plan, some), F.shiftright("packed", 16)
    deal = lambda df: df.repartition(n, coarse).sortWithinPartitions("packed")
    large = written(rows.groupBy(coarse.alias("coarse")).count().filter(F.col("count") > plan.block).select("coarse"), "large")
    if large.isEmpty():
        return deal(rows), None
    small = rows.join(F.broadcast(large), coarse == F.col("coarse"), "left_anti")
    hot = rows.join(F.broadcast(large), coarse == F.col("coarse"), "left_semi")
    # a key's rows are those of two values: it is hot only if one of these is
    seen = hot.groupBy("packed").count().filter(F.col("count") >= plan.block // 2)
    split = keyed(seen, plan).groupBy("key").agg(F.ceil((F.sum("count") + plan.block // 2) / plan.block).cast("int").alias("blocks")).filter("blocks > 1")
    return deal(small), in_blocks(keyed(hot, plan), written(split, "split"), names).repartition(n, "key").sortWithinPartitions("key")


def in_blocks(rows: DataFrame, split: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (key, ``names`` with node) with other keys for those in ``split`` (key, blocks): one for each pair of blocks that a row is in."""
    joined = rows.join(split, "key", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
    dealt = joined.select("key", F.explode(F.when(F.col("blocks").isNotNull(), pairs).otherwise(F.array(F.lit(-1)))).alias("pair"), *names)
    return dealt.select(F.when(F.col("pair") < 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), *names)


def span(w0: np.ndarray, w1: np.ndarray, near, tile: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one signature's rows: (from, to) positions.

    A tile of rows is held against all that are left at once; links are followed from those that have any.
    """
    left, out = np.arange(len(w0)), []
    while len(left):
        head = left[:tile]
        linked = head[near(w0[head, None], w1[head, None], w0[left], w1[left]).sum(1) > 1]
        left = np.concatenate([linked, left[tile:]])
        while len(linked) and len(left) and left[0] <= linked[-1]:
            ahead, left = [left[0]], left[1:]
            while ahead and len(left):
                at = ahead.pop()
                hit = near(w0[at], w1[at], w0[left], w1[left])
                if hit.any():
                    new, left = left[hit], left[~hit]
                    out.append((np.full(len(new), at), new))
                    ahead.extend(new.tolist())
    return out


def nearest(w0: np.ndarray, w1: np.ndarray, plan: Plan, tile: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidates among one signature's rows: (from, to) positions.

    Rows within ``sure`` of an earlier one are joined to it and need no other.  What is left is joined by a
    least spanning forest of the distances up to ``limit``: whatever bound the similarity sets, pairs
    within it that this signature joins stay joined as far as distances rank as similarities do.
    """
    distance = lambda a, b: (np.bitwise_count(w0[a] ^ w0[b]) + np.bitwise_count(w1[a] ^ w1[b])).astype(np.int64)
    every, heads, out = np.arange(len(w0)), [], []
    some = [every[i : i + tile] for i in range(0, len(every), tile)]
    # rows that nothing is near are left out at once
    left = np.concatenate([x[(distance(x[:, None], every[None, :]) <= plan.limit).sum(1) > 1] for x in some])
    while len(left):
        at = left[0]
        hit = distance(at, left) <= plan.sure
        hit[0] = True
        if hit.sum() > 1:
            out.append((np.full(hit.sum() - 1, at), left[hit][1:]))
        heads.append(at)
        left = left[~hit]
    if len(heads) > 1:
        heads = np.array(heads)
        best, via, left = np.full(len(heads), plan.limit + 1), np.zeros(len(heads), np.int64), np.arange(1, len(heads))
        at, a, b = 0, [], []
        while len(left):
            d = distance(heads[at], heads[left])
            closer = d < best[left]
            best[left[closer]], via[left[closer]] = d[closer], at
            i = int(np.argmin(best[left]))
            at = left[i]
            if best[at] <= plan.limit:
                a.append(heads[via[at]])
                b.append(heads[at])
            left = np.delete(left, i)
        if a:
            out.append((np.array(a), np.array(b)))
    return out


def star(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Names (root, other) that join what the links between positions a and b join: each to the least name
    of its component.  The least is often the same under many signatures, and so are such pairs."""
    names, node = np.unique(name, return_inverse=True)
    a, b = node[a], node[b]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    other = np.flatnonzero(root != np.arange(len(root)))
    return (names[root[other]], names[other]) if len(other) else None


def _whole_groups(batches, shift: int, least: int = 1 << 15):
    """Tables of at least so many rows, cut where the group of the first column (without its last bits) ends."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy() >> shift
        if rows >= least:
            last = held[-1].column(0)[-1].as_py() >> shift
            end = int(np.searchsorted(key, last, side="right")) if key[0] == last else 0
            if end < len(key):
                yield pa.Table.from_batches([*held, batch.slice(0, end)])
                held, rows, batch = [], 0, batch.slice(end)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def links(tables: tuple[DataFrame, DataFrame | None], plan: Plan, small: int = 16) -> DataFrame:
    """a, b, d (their distance), distinct: nodes of the rows of ``signature_rows``.

    Without ``similarity``: such as are joined wherever links among the rows of a key join them (they may differ in
    more bits than a link; a chain of links leads from one to the other).  Else candidates, a the lesser: all pairs
    within the limit of a small group, ``nearest`` of others, without those that a task finds to be needless (``thin``).
    Nodes of one root are joined already and are no candidates.
    """
    proven = plan.similarity is None
    rooted = "root" in tables[0].columns
    wide = plan.size > 64
    bits = np.array(rest_bits(plan))

    def near(a, a2, b, b2):
        d = np.bitwise_count(a ^ b)
        return (d + np.bitwise_count(a2 ^ b2) if wide else d) <= plan.limit

    def met(key, node, w0, w1, root):
        """Names that the rows of equal keys (in order) join, or are candidates."""
        n = len(key)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, n))
        found = []
        few = size <= small
        group = np.repeat(np.arange(len(begin)), size)
        at = np.flatnonzero(few[group] & (size[group] > 1))
        step = 1
        while len(at):
            at = at[at + step < n]
            at = at[group[at + step] == group[at]]
            hit = near(w0[at], w1[at], w0[at + step], w1[at + step])
            found.append((at[hit], at[hit] + step))
            step += 1
        for g in np.flatnonzero(~few).tolist():
            # by name, so that the same row leads under most signatures
            own = begin[g] + np.argsort(node[begin[g] : begin[g] + size[g]])
            pairs = span(w0[own], w1[own], near) if proven else nearest(w0[own], w1[own], plan)
            found += [(own[a], own[b]) for a, b in pairs]
        a, b = (np.concatenate(x) for x in zip(*found)) if found else ([], [])
        if not len(a):
            return None
        if proven:
            some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            joined = star(node[some], at[: len(a)], at[len(a) :])
            return joined and (*joined, np.zeros(len(joined[0]), np.int32))
        if rooted:
            new = root[a] != root[b]
            if not new.any():
                return None
            a, b = a[new], b[new]
        d = np.bitwise_count(w0[a] ^ w0[b]).astype(np.int32) + (np.bitwise_count(w1[a] ^ w1[b]) if wide else 0)
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), d

    def batch_of(held):
        """What all pairs of a task join, each node once; or the distinct pairs that are needed."""
        a, b, d = (np.concatenate(x) for x in zip(*held))
        if proven:
            a, b = star(np.concatenate([a, b]), np.arange(len(a)), np.arange(len(a), 2 * len(a)))
            d = np.zeros(len(a), np.int32)
        else:
            a, b, d = thin(a, b, d, 2 * FORESTS)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d, pa.int32())], names=["a", "b", "d"])

    def columns(got):
        node, w0 = got["node"].to_numpy(), got["w0"].to_numpy().view(np.uint64)
        return node, w0, got["w1"].to_numpy().view(np.uint64) if wide else w0, got["root"].to_numpy() if rooted else node

    def of_halves(batches):
        for got in _whole_groups(batches, 16):
            packed, some = got["packed"].to_numpy(), columns(got)
            have = bits[packed >> 32]
            # the variants of all rows by one bit at a time
            for b in range(int(bits.max())):
                key = packed & ~np.int64(1 << b)
                own = np.argsort(key) if int(have.min()) > b else (keep := np.flatnonzero(have > b))[np.argsort(key[keep])]
                if len(own):
                    yield met(key[own], *(x[own] for x in some))

    def of_keys(batches):
        for got in _whole_groups(batches, 0):
            yield met(got["key"].to_numpy(), *columns(got))

    def gathered(made):
        def run(batches):
            held, count = [], 0
            for joined in made(batches):
                if joined:
                    held.append(joined)
                    count += len(joined[0])
                if count > TASK_LINKS:
                    held = [batch_of(held)]
                    held = [tuple(c.to_numpy() for c in held[0].columns)]
                    count = len(held[0][0])
                    if count > TASK_LINKS // 2:
                        yield batch_of(held)
                        held, count = [], 0
            if held:
                yield batch_of(held)

        return run

    found = tables[0].mapInArrow(gathered(of_halves), "a long, b long, d int")
    if tables[1] is not None:
        found = found.unionByName(tables[1].mapInArrow(gathered(of_keys), "a long, b long, d int"))
    return found.distinct()


def thin(a: np.ndarray, b: np.ndarray, d: np.ndarray, forests: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """So many least spanning forests of the pairs, one after another: between any two parts that pairs join they have
    the nearest of these.  Pairs whose ends a chain of tight ones joins are in the first forest or left out."""
    order = np.lexsort((b, a, d))
    a, b, d = a[order], b[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d = a[new], b[new], d[new]
    names = np.unique(np.concatenate([a, b]))
    pairs, keep = list(enumerate(zip(np.searchsorted(names, a).tolist(), np.searchsorted(names, b).tolist()))), []
    for turn in range(forests):
        root, rest = list(range(len(names))), []
        for i, (x, y) in pairs:
            top, other = x, y
            while root[top] != top:
                root[top] = top = root[root[top]]
            while root[other] != other:
                root[other] = other = root[root[other]]
            if top != other:
                root[other] = top
                keep.append(i)
            else:
                rest.append((i, (x, y)))
        if not turn:
            near = d[keep] <= TIGHT
            x, y = (np.searchsorted(names, c[keep][near]) for c in (a, b))
            part = np.arange(len(names))
            while True:
                low = part.copy()
                np.minimum.at(low, x, part[y])
                np.minimum.at(low, y, part[x])
                low = low[low]
                if (low == part).all():
                    break
                part = low
            part = part.tolist()
            rest = [(i, (x, y)) for i, (x, y) in rest if part[x] != part[y]]
        if not (pairs := rest):
            break
    keep.sort()
    return a[keep], b[keep], d[keep]


def thinned(candidates: DataFrame, plan: Plan, shares: int = 8) -> DataFrame:
    """``candidates`` (a, b, d; written) of which a task keeps FORESTS of its share, as long as that halves them.

    A family of near copies has a forest under each of its signatures; this leaves some FORESTS * shares of them.  Left out is a pair
    that holds where that many nearer ones between two parts fail the comparison of whole sets; ``missed`` finds it.
    """

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            kept = thin(*(np.concatenate([b.column(c).to_numpy() for b in got]) for c in range(3)), FORESTS)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(kept, (pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "d"])

    rows = candidates.count()
    while rows:
        candidates = written(candidates.repartition(max(shares, -(-rows // TASK_LINKS))).mapInArrow(run, "a long, b long, d int").distinct(), "candidates")
        before, rows = rows, candidates.count()
        if 2 * rows > before:
            break
    return candidates


def forest(edges: DataFrame, links: int) -> DataFrame:
    """a, b (b the lesser): what is left of ``links`` edges when each task, with a bounded share of them,
    keeps one link from every node to the least that its share reaches."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            name = np.concatenate([b.column(c).to_numpy() for c in (0, 1) for b in got])
            n = len(name) // 2
            if joined := star(name, np.arange(n), np.arange(n, 2 * n)):
                yield pa.RecordBatch.from_arrays([pa.array(joined[1]), pa.array(joined[0])], names=["a", "b"])

    return edges.repartition(max(8, -(-links // TASK_LINKS))).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that ``edges`` (a, b: long) reach from each node they have, but for the least itself.

    Large and small stars in turn: each step links every node's neighbours to the least of them, until nothing
    changes (the number of steps grows with the logarithm of the components' width).  The least of a node is
    written before it meets its neighbours, so that a hub's rows are split in that join.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    edges = written(forest(edges, edges.count()), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
        # large star: the greater neighbours of each node go to its least one
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.filter("a <> b").distinct(), "large")
        # small star: the smaller neighbours of each node, and it, go to the least of them
        low = written(large.groupBy("a").agg(F.min("b").alias("least")), "low")
        small = large.join(low, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(low.select("a", F.col("least").alias("b")))
        edges = written(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every document, by one word without similarity."""
    prints = written(fingerprints(docs, plan), "fingerprints")
    found = written(points(prints, plan), "points")
    roots = components(written(links(signature_rows(found, plan), plan), "links"))
    named = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the least node is a doc_id unless all are null; then it is a number from the top
    real = F.col("root").eqNullSafe(F.col("least")) | (F.col("root") <= TOP - (1 << 62))
    named = written(named.select("w0", F.when(real, F.col("root")).alias("component_id")), "named")
    return prints.join(named, "w0").select("doc_id", F.col("w0").alias("fp"), "component_id")


def verified(docs: DataFrame, candidates: DataFrame, plan: Plan, chunk: int = 256) -> DataFrame:
    """a, b of those ``candidates`` (written; a < b: doc_id) whose whole sets of shingles are similar; docs: doc_id (each once), text.

    Texts go to where they are compared: that of a, then those of the b that meet it, one at a time.  An a with
    more than a chunk of b is sent to several places.
    """
    ready(docs.sparkSession)
    words, seed, similarity = plan.words, plan.seed, plan.similarity
    heads = candidates.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    heads = written(heads, "heads")
    part = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("part")
    needs = candidates.join(heads, "a").select("a", part, F.lit(1).alias("place"), F.col("b").alias("doc_id"))
    needs = needs.unionByName(heads.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.lit(0).alias("place"), F.col("a").alias("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # dealt by id at every size: what the join costs is one shuffle of the texts, whatever the ids weigh
    rows = texts.join(written(needs, "needs").hint("merge"), "doc_id").select("a", "part", "place", "doc_id", "text")

    def run(batches):
        now, first = None, None
        for batch in batches:
            out = []
            for a, part, place, doc, text in zip(*batch.columns):
                a, place, at = a.as_py(), place.as_py(), (a.as_py(), part.as_py())
                hashes = np.unique(shingle_hashes(text.as_py() or "", words, seed))
                if place == 0:
                    now, first = at, hashes
                elif now == at:
                    both = len(np.intersect1d(first, hashes, assume_unique=True))
                    union = len(first) + len(hashes) - both
                    if not union or both / union >= similarity:
                        out.append((a, doc.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    # without a number, so that small tables are compared and written by few tasks
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "place").mapInArrow(run, "a long, b long")


def common(docs: DataFrame, plan: Plan) -> np.ndarray:
    """High halves of the hashes of shingles that more than COMMON documents have (in order), or more of them if that
    is needed to have at most COMMON_MOST.  Copies count, and hashes of equal halves together: this only orders."""
    n, words, seed = partitions(docs.sparkSession), plan.words, plan.seed

    def blocks(held):
        flat = np.concatenate(held)
        bucket = (flat >> np.uint64(24)) % np.uint64(n)
        order = np.argsort(bucket, kind="stable")
        high, ends = (flat[order] >> np.uint64(32)).astype("<u4"), np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([high[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "hashes"])

    def cut(batches):
        held, count = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(np.unique(shingle_hashes(value.as_py() or "", words, seed)))
                count += len(held[-1])
                if count > 1 << 20:
                    yield blocks(held)
                    held, count = [], 0
        if count:
            yield blocks(held)

    def counted(batches):
        held = [np.frombuffer(x.as_py(), "<u4") for batch in batches for x in batch.column(1)]
        if held:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            many = count > COMMON
            yield pa.RecordBatch.from_arrays([pa.array(value[many], pa.int64()), pa.array(count[many], pa.int64())], names=["high", "count"])

    dealt = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(cut, "bucket int, hashes binary").repartitionById(n, F.col("bucket"))
    found = written(dealt.mapInArrow(counted, "high long, count long"), "common")
    limit = COMMON
    while found.filter(F.col("count") > limit).count() > COMMON_MOST:
        limit *= 2
    got = found.filter(F.col("count") > limit).select("high").toArrow()["high"].to_numpy()
    return np.unique(got).astype(np.uint32)


def first_shingles(hashes: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of so many of a set's shingles that a set of this similarity has one of them, if it is cut likewise: the order is that of
    the hashes, ``last`` (high halves) after all others.  The keys of those are below 0."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(last, high), len(last) - 1) if len(last) else None
    late = last[at] == high if len(last) else np.zeros(len(hashes), bool)
    need = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1
    key = (hashes >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    return np.concatenate([key[~late], key[late]])[:need].view(np.int64)


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each of PARITY classes of shingles: whether the set has an odd number of them.  Two sets differ in no fewer
    shingles than bits."""
    return np.packbits((np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def missed(docs: DataFrame, joined: DataFrame, plan: Plan) -> DataFrame:
    """a, b (doc_id, a < b; written) of different root that may be similar: none that is similar is left out.

    docs: doc_id, text; joined: node, root.  Rows of the same first shingle meet; a pair whose sizes, or whose places of that
    shingle, or whose ``parity`` leave too few for both is none.
    """
    ready(docs.sparkSession)
    spark, n, similarity, words, seed = docs.sparkSession, partitions(docs.sparkSession), plan.similarity, plan.words, plan.seed
    last = spark.sparkContext.broadcast(common(docs, plan))
    both = similarity / (1 + similarity)

    def cut(batches):
        for batch in batches:
            held, rows = [], 0
            for i, value in enumerate(batch.column(2)):
                hashes = np.unique(shingle_hashes(value.as_py() or "", words, seed))
                held.append((i, len(hashes), parity(hashes), first_shingles(hashes, last.value, similarity)))
                rows += len(held[-1][3]) + 1
                if rows > 1 << 17 or i + 1 == batch.num_rows:
                    # a row with the parity before those of a document's shingles
                    size = np.array([len(k) + 1 for *_, k in held])
                    head = np.cumsum(size) - size
                    at = np.repeat(np.array([i for i, *_ in held]), size)
                    key = np.zeros(rows, np.int64)
                    bare = np.ones(rows, bool)
                    bare[head] = False
                    key[bare] = np.concatenate([k for *_, k in held])
                    marks = np.full(rows, None, object)
                    marks[head] = [m for _, _, m, _ in held]
                    place = (np.repeat(np.array([k for _, k, *_ in held]), size) << 32) | np.maximum(np.arange(rows) - np.repeat(head, size) - 1, 0)
                    to = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64(), mask=~bare), batch.column(0).take(to), batch.column(1).take(to), pa.array(place), pa.array(marks, pa.binary())], names=["key", "node", "root", "place", "parity"])
                    held, rows = [], 0

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    sets = written(joined.select("node", "root").join(texts, "node").select("node", "root", "text").mapInArrow(cut, "key long, node long, root long, place long, parity binary"), "first")
    rows, names = sets.filter("key is not null").select("key", "node", "root", "place"), ["node", "root", "place"]
    large = written(rows.filter("key < 0").groupBy("key").count().filter(F.col("count") > plan.block).select("key", F.ceil((F.col("count") + plan.block // 2) / plan.block).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    if not large.isEmpty():
        rows = in_blocks(rows, large, names)

    def fit(x, y, i, j):
        """Whether sets of x and y shingles with the first they share at i and j may be similar."""
        return (np.minimum(x - i, y - j) >= both * (x + y) - 1e-6) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)

    def met(batches):
        for got in _whole_groups(batches, 0):
            key, node, root, place = (got[c].to_numpy() for c in ("key", *names))
            size, at = place >> 32, place & 0xFFFFFFFF
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(begin, len(key)))
            some = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
            group = np.repeat(np.arange(len(begin)), count)
            few, step = np.flatnonzero((some & (count <= 16))[group]), 1
            while len(few):
                few = few[few + step < len(key)]
                few = few[group[few + step] == group[few]]
                a, b = few, few + step
                hit = (root[a] != root[b]) & fit(size[a], size[b], at[a], at[b])
                if hit.any():
                    yield np.minimum(node[a[hit]], node[b[hit]]), np.maximum(node[a[hit]], node[b[hit]])
                step += 1
            some &= count > 16
            for g, m in zip(begin[some].tolist(), count[some].tolist()):
                # by size, so that those a row may be similar to are near it
                own = g + np.argsort(size[g : g + m], kind="stable")
                ends = np.searchsorted(size[own], size[own] / similarity + 1e-6, side="right")
                for i in range(m - 1):
                    a, rest = own[i], own[i + 1 : ends[i]]
                    rest = rest[(root[rest] != root[a]) & fit(size[a], size[rest], at[a], at[rest])]
                    if len(rest):
                        yield np.minimum(node[a], node[rest]), np.maximum(node[a], node[rest])

    def pairs(batches):
        def distinct():
            found = np.unique(np.stack([np.concatenate(x) for x in zip(*held)]), axis=1)
            return [(found[0], found[1])]

        held, count = [], 0
        for a, b in met(batches):
            held.append((a, b))
            count += len(a)
            if count > TASK_LINKS:
                held = distinct()
                count = len(held[0][0])
                if count > TASK_LINKS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                    held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in distinct()[0]], names=["a", "b"])

    found = written(rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(pairs, "a long, b long").distinct(), "pairs")

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in batch.columns[2:4])
                s, t = (c.to_numpy() >> 32 for c in batch.columns[4:])
                most = (s + t) * (1 - 2 * both) + 1e-6
                hold = pa.array(np.bitwise_count(x ^ y).sum(1) <= most)
                yield pa.RecordBatch.from_arrays([c.filter(hold) for c in batch.columns[:2]], names=["a", "b"])

    one = sets.filter("key is null").select("node", "parity", "place")
    of = lambda c, i: one.select(F.col("node").alias(c), F.col("parity").alias(f"parity{i}"), F.col("place").alias(f"place{i}"))
    marked = found.join(of("a", 0), "a").join(of("b", 1), "b").select("a", "b", "parity0", "parity1", "place0", "place1")
    return written(marked.mapInArrow(near, "a long, b long"), "missed")


def keep_first(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id.

    With ``similarity`` the bits only say which documents are held against each other; groups are components of the
    links that their whole shingle sets prove, and of equal sets.  What the ``lead`` segments join is not sought again
    under the others, where a large family would have a forest for each of its signatures.  What all of them leave apart is compared
    wherever it may be similar (``missed``), so no link between groups is lost.  Rows with a null doc_id are all kept; of rows that repeat a
    doc_id the one whose JSON is least stands for all of them.
    """
    named = docs.filter("doc_id is not null")
    twice = written(named.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        once = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row"))
        named = written(named.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("row.*")), "once")
    prints = written(fingerprints(named, plan), "fingerprints")
    found = written(points(prints, plan), "points")
    if plan.similarity is None:
        joined = written(links(signature_rows(found, plan), plan), "links")
    else:
        proven = lambda rows: written(verified(named, thinned(written(links(rows, plan), "links"), plan), plan), "verified")
        first = slice(0, plan.lead or plan.cuts)
        rooted = lambda joined: written(found.select("node", *plan.parts).join(components(joined), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        joined = proven(signature_rows(found, plan, first))
        if first.stop < plan.cuts:
            joined = joined.unionByName(proven(signature_rows(rooted(joined), plan, slice(first.stop, plan.cuts))))
        joined = joined.unionByName(written(verified(named, missed(named, rooted(joined), plan), plan), "verified"))
    heads = found.select(F.col("node").alias("doc_id")).join(components(joined).select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
    kept = named.join(written(heads, "heads").hint("merge"), "doc_id", "left_semi")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
