"""Operator 8, n-gram Jaccard join with signature trees.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

1. *Sets.*  One pass gives each text its set's 64-bit key and size, and each task a bounded summary of its most
   frequent shingles; the HEAVY most frequent over all tasks are the heavy shingles.  Equal sets share a key and are one
   vertex from here on, so copies cost nothing further.
2. *Buckets.*  In one order of all shingles (heavy ones last, then by hash) two linked sets share a shingle among the
   first n - ceil(0.75 n) + 1 of each (prefix filter: exact for any order).  Those (shingle, key) pairs are dealt
   by shingle, packed as blobs.  Passages that many texts share are heavy, so they reach no prefix unless
   they make up most of a text.
3. *Groups.*  Each shingle's smallest key is its hub; the distinct (hub, key) pairs are groups that together
   hold every candidate pair.  Pairs are never listed.  A group of more than BLOCK members is dealt by bands of size, and a band
   of more than BLOCK as pairs of blocks.
4. *Signature trees.*  A group's members carry bitmaps of their sets (about 4 bits a shingle).  Ordered so that like sets
   lie side by side, they form a tree whose nodes hold the OR of their bitmaps, their range of sizes and their
   most bit collisions.  A dual traversal prunes a pair of nodes when the largest possible overlap can't reach the
   smallest needed one, or when both lie in one component already.  What survives at the leaves joins candidate
   groups, each under its smallest key, so the same candidates from several hubs become one.
   Only members of these groups have their whole sets made again and sent; the same trees then check leaf pairs exactly.
5. *Components* of the found links, by star contraction; each text takes its component's smallest doc_id.

Hashes of 64 bits stand for shingles and sets (see ``words``).

Defined results: null, empty and blank texts have 0 shingles and are their own component; fewer than 5 words are one
shingle, the whole sequence; rows of one doc_id are one document, whatever their texts: they share a component, and what links to
any of them is linked to all; a null doc_id takes part in no link and has a null component; very long texts are compared
whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _rows
from .common import arrow_map, stored, table, text_slices
from .components import components
from .words import STEP, U, Words, mix

SHINGLE, HEAVY, HEAVY_FROM, SUMMARY, BLOCK, BAND, FAN, FLUSH = 5, 65_536, 32, 8_192, 8_192, 1.34, 8, 1 << 21


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(all sets one after another, each sorted; size of each)."""
    w = Words(data, offsets, lower=True)
    h = w.hashes()
    at, windows = w.windows(k, h)
    n = len(offsets) - 1
    count = np.maximum(w.count - k + 1, 0)
    edge = np.concatenate(([0], np.cumsum(count))).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        windows[a:b].sort()
    text = w.text[at]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (text[1:] != text[:-1])
    sets, text = windows[new], text[new]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        ones = np.zeros(len(short), U)
        with np.errstate(over="ignore"):
            for i, t in enumerate(short.tolist()):
                for x in h[w.begin[t] : w.begin[t + 1]]:
                    ones[i] = ones[i] * STEP + x
            ones = mix(ones ^ w.count[short].astype(U))
        order = np.argsort(np.concatenate((text, short)), kind="stable")
        sets, text = np.concatenate((sets, ones))[order], np.concatenate((text, short))[order]
    return sets, np.bincount(text, minlength=n)[:n]


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each set; 0 for the empty set."""
    with np.errstate(over="ignore"):
        a = np.concatenate((np.zeros(1, U), np.cumsum(mix(sets ^ U(0x5851F42D4C957F2D)), dtype=U)))
        b = np.concatenate((np.zeros(1, U), np.cumsum(mix(sets + U(0x14057B7EF767814F)) | U(1), dtype=U)))
        end = np.cumsum(sizes)
        key = mix((a[end] - a[end - sizes]) ^ mix((b[end] - b[end - sizes]) * STEP))
    return np.where(sizes > 0, key.view(np.int64), 0)


def bitmaps(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bitmap of each set: a power of two of bits, 4 a shingle or more, 64 at least; halves may be folded by OR."""
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * sizes, 1))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(width // 64)))
    flat = np.zeros(int(base[-1]), U)
    place = ((sets >> U(20)) & np.repeat(width - 1, sizes).astype(U)).astype(np.int64)
    np.bitwise_or.at(flat, np.repeat(base[:-1], sizes) + (place >> 6), U(1) << (place & 63).astype(U))
    return [flat[a:b].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def prefixes(sets: np.ndarray, sizes: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which entries of the sets are in their prefix: heavy ones come last."""
    if not len(sets):
        return np.zeros(0, bool)
    length = np.repeat(sizes - (3 * sizes + 3) // 4 + 1, sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    slow = heavy[np.minimum(np.searchsorted(heavy, sets), len(heavy) - 1)] == sets if len(heavy) else np.zeros(len(sets), bool)
    before = np.concatenate(([0], np.cumsum(~slow)))
    light_rank = before[:-1] - before[begin]
    own = np.repeat(np.add.reduceat((~slow).astype(np.int64), np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]), sizes[sizes > 0])
    rank = np.where(slow, own + np.arange(len(sets)) - begin - light_rank, light_rank)
    return rank < length


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, bits) of each text, and each task's frequent shingles as (hash, seen); docs: (doc_id, text)."""

    def run(batches):
        hashes, counts = np.zeros(0, U), np.zeros(0, np.int64)
        names = ["doc_id", "key", "n", "bits", "hash", "seen"]
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                sets, sizes = shingle_sets(data, offsets)
                found, own = np.unique(sets, return_counts=True)
                many = own > 1
                hashes, at = np.unique(np.concatenate((hashes, found[many])), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, own[many])), len(hashes)).astype(np.int64)
                if len(hashes) > SUMMARY:
                    counts -= np.partition(counts, -SUMMARY - 1)[-SUMMARY - 1]
                    hashes, counts = hashes[counts > 0], counts[counts > 0]
                nothing = pa.nulls(len(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(set_keys(sets, sizes)), pa.array(sizes), pa.array(bitmaps(sets, sizes), pa.binary()), nothing, nothing], names)
        if len(hashes):
            nothing = pa.nulls(len(hashes), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.nulls(len(hashes), pa.binary()), pa.array(hashes.view(np.int64)), pa.array(counts)], names)

    return docs.mapInArrow(run, "doc_id long, key long, n long, bits binary, hash long, seen long")


def heavy_shingles(described: DataFrame, most: int = HEAVY, least: int = HEAVY_FROM) -> np.ndarray:
    """The most frequent shingles, sorted; any set of shingles gives right results.  At most ``most``, which bounds what tasks get."""
    rows = described.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).orderBy(F.desc("seen"), "hash").limit(most).select("hash").toPandas()
    return np.sort(rows["hash"].to_numpy(np.int64).view(U))


def groups(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(hub, key): distinct members of each group; the hub is a member of its own."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        hashes, keys, waiting, seen = [], [], 0, set()

        def flush():
            h, k = np.concatenate(hashes), np.concatenate(keys)
            part = (mix(h) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            h, k = h[order], k[order]
            blobs = [(p, h[a:b].tobytes() + k[a:b].tobytes()) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["part", "blob"])

        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                sets, sizes = shingle_sets(data, offsets)
                key = set_keys(sets, sizes)
                fresh = np.zeros(len(sizes), bool)
                for i, (k, d) in enumerate(zip(key.tolist(), rows.column(0).to_pylist(), strict=True)):
                    if d is not None and k not in seen:
                        seen.add(k)
                        fresh[i] = True
                chosen = prefixes(sets, sizes, heavy) & np.repeat(fresh, sizes)
                hashes.append(sets[chosen]), keys.append(np.repeat(key, sizes)[chosen])
                waiting += len(hashes[-1])
                if waiting >= FLUSH:
                    yield flush()
                    hashes, keys, waiting, seen = [], [], 0, set()
        if waiting:
            yield flush()

    def gather(batches):
        hashes, keys = [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                both = np.frombuffer(blob, U)
                hashes.append(both[: len(both) // 2]), keys.append(both[len(both) // 2 :].view(np.int64))
        if not hashes:
            return
        h, k = np.concatenate(hashes), np.concatenate(keys)
        order = np.argsort(h)
        h, k = h[order], k[order]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        hub = np.minimum.reduceat(k, begin)
        wide = hub != np.maximum.reduceat(k, begin)
        size = np.diff(np.append(begin, len(h)))
        inside = np.repeat(wide, size)
        hub, k = np.repeat(hub, size)[inside], k[inside]
        if not len(k):
            return
        order = np.lexsort((k, hub))
        hub, k = hub[order], k[order]
        new = np.concatenate(([True], (hub[1:] != hub[:-1]) | (k[1:] != k[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(hub[new]), pa.array(k[new])], ["hub", "key"])

    dealt = docs.mapInArrow(deal, "part int, blob binary").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(gather, "hub long, key long").distinct()


class Links:
    """Union-find over the members of a group; the smaller key leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    n = len(a) + len(b)
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    return 7 * len(np.intersect1d(a, b, assume_unique=True)) >= 3 * n


class SignatureTree:
    """levels: from leaves to root; each has the nodes' bitmaps, least and most sizes and most collisions.  Node i has children FAN*i ... of the level below.

    Without sets, two leaves link when their bitmaps allow it.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray] | None = None):
        self.sets = sets
        lost = sizes - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, lost)]
        while len(self.levels[-1][0]) > 1:
            bits, least, most, lost = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(lost, at)))
        self.links = Links(len(sizes))
        self.whole = [[True] * len(level[0]) for level in self.levels]

    def reach(self, level: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of a level's nodes: how far the largest possible overlap exceeds the smallest needed one (negative: pruned)."""
        bits, least, most, lost = self.levels[level]
        common = np.bitwise_count(bits[left] & bits[right]).sum(1).astype(np.int64) + np.minimum(lost[left], lost[right])
        most_overlap = np.minimum(common, np.minimum(most[left], most[right]))
        spare = 7 * most_overlap - 3 * (least[left] + least[right])
        apart = (4 * most[left] < 3 * least[right]) | (4 * most[right] < 3 * least[left])
        return np.where(apart, -1, spare)

    def one(self, level: int, a: int, b: int) -> bool:
        """Whether all leaves of both nodes are known to be in one component."""
        if not (self.whole[level][a] and self.whole[level][b]):
            return False
        step = FAN**level
        return self.links.find(a * step) == self.links.find(b * step)

    def traverse(self, level: int, a: int, b: int) -> None:
        """Finds the links between the leaves of two nodes, best pairs first."""
        stack = [(level, a, b)]
        while stack:
            level, a, b = stack.pop()
            if self.one(level, a, b):
                continue
            if level == 0:
                if self.sets is None or linked(self.sets[a], self.sets[b]):  # a leaf pair comes here only if its bitmaps allow it
                    self.links.join(a, b)
                continue
            n = len(self.levels[level - 1][0])
            left, right = np.arange(a * FAN, min(n, a * FAN + FAN)), np.arange(b * FAN, min(n, b * FAN + FAN))
            left, right = np.repeat(left, len(right)), np.tile(right, len(left))
            spare = self.reach(level - 1, left, right)
            order = np.argsort(spare, kind="stable")
            order = order[spare[order] >= 0]
            stack += zip([level - 1] * len(order), left[order].tolist(), right[order].tolist(), strict=True)

    def components(self) -> list[int]:
        """Each member's first member of its component."""
        for level in range(1, len(self.levels)):
            n = len(self.levels[level - 1][0])
            step = FAN ** (level - 1)
            pairs_a, pairs_b = np.triu_indices(FAN, 1)
            first = np.arange(len(self.levels[level][0])) * FAN
            left, right = (first[:, None] + pairs_a).ravel(), (first[:, None] + pairs_b).ravel()
            inside = right < n
            left, right = left[inside], right[inside]
            near = np.concatenate([self.reach(level - 1, left[i : i + 4096], right[i : i + 4096]) for i in range(0, len(left), 4096)] or [np.zeros(0, np.int64)]) >= 0
            for a, b in zip(left[near].tolist(), right[near].tolist(), strict=True):
                self.traverse(level - 1, a, b)
            for i in range(len(self.levels[level][0])):
                below = range(i * FAN, min(n, i * FAN + FAN))
                roots = {self.links.find(j * step) for j in below}
                self.whole[level][i] = len(roots) == 1 and all(self.whole[level - 1][j] for j in below)
        return [self.links.find(i) for i in range(len(self.levels[0][0]))]


def group_links(keys: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(key, first key of its component) of the members of one group that link."""
    if len(sets) == 2:
        return [(int(keys[1]), int(keys[0]))] if linked(*sets) else []
    order = sorted(range(len(sets)), key=lambda i: (sets[i][0], sets[i][min(1, len(sets[i]) - 1)], len(sets[i])))
    own = [sets[i] for i in order]
    sizes = np.array([len(x) for x in own], np.int64)
    width = int(min(1 << 14, max(512, 1 << int(4 * sizes.max() - 1).bit_length())))
    bits = np.zeros((len(own), width // 64), U)
    place = (np.concatenate(own) >> U(20)) % U(width)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(own)), sizes), (place >> U(6)).astype(np.int64)), U(1) << (place & U(63)))
    up = SignatureTree(bits, sizes, own).components()
    return [(int(keys[order[i]]), int(keys[order[j]])) for i, j in enumerate(up) if i != j]


def group_candidates(keys: np.ndarray, sizes: np.ndarray, bits: list[bytes]) -> list[tuple[int, int]]:
    """(smallest key, key) of the members that bitmaps leave together, the smallest with itself; keys ascend.

    Linked sets differ in size by 4/3 at most, so their bitmaps have one width or twice the other's: each width's tree takes
    those of twice the width that are small enough, folded.
    """
    words = np.array([len(b) // 8 for b in bits])
    links = Links(len(keys))
    for w in np.unique(words).tolist():
        near = np.flatnonzero(words == w)
        wide = np.flatnonzero((words == 2 * w) & (3 * sizes <= 4 * sizes[near].max()))
        if len(near) + len(wide) < 2:
            continue
        own = np.concatenate((near, wide))
        raw = np.zeros((len(own), w), U)
        for k, i in enumerate(own.tolist()):
            both = np.frombuffer(bits[i], U)
            raw[k] = both if k < len(near) else both[:w] | both[w:]
        order = np.lexsort((sizes[own], raw[:, 0]))
        up = SignatureTree(raw[order], sizes[own][order]).components()
        for i, j in enumerate(up):
            if i != j:
                links.join(int(own[order[i]]), int(own[order[j]]))
    root = [links.find(i) for i in range(len(keys))]
    many = {r for i, r in enumerate(root) if i != r}
    return [(int(keys[r]), int(keys[i])) for i, r in enumerate(root) if r in many]


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """members(hub, key, n) with band, i, j: all of a group in one task, or, above ``block`` members, by bands of size and blocks.

    Linked sets differ in size by 4/3 at most, so each member of a large group goes to its own band of sizes (powers of BAND) and to the
    one below, and two linked members meet in one band at least.  A band of more than ``block`` members is dealt as pairs of blocks.
    """
    large = stored(members.groupBy("hub").count().where(F.col("count") > block).select("hub", F.lit(True).alias("large")), "large-groups")
    own = F.floor(F.log(F.col("n").cast("double")) / np.log(BAND)).cast("int")
    dealt = members.join(large, "hub", "left").withColumn("band", F.explode(F.when(F.col("large"), F.array(own, own - 1)).otherwise(F.array(F.lit(-9)))))
    bands = dealt.where("large").groupBy("hub", "band").count().select("hub", "band", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = dealt.drop("large").join(stored(bands, "bands"), ["hub", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.shiftright("key", 7), F.col("blocks")).cast("int")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    return dealt.withColumn("p", F.explode(F.when(F.col("blocks") == 1, alone).otherwise(pairs))).select(*members.columns, "band", "p.i", "p.j")


def _by_group(rows: DataFrame, find, schema: str) -> DataFrame:
    """Runs find(keys, rows of the group by key) on each (hub, band, i, j); rows: those, key and more.  Equal keys of a group are one.

    Groups come one after another, so a task holds one group at a time.
    """
    group_of = ["hub", "band", "i", "j"]

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]

        def done() -> list[tuple[int, int]]:
            if len(members) < 2:
                return []
            keys = np.array(sorted(members), np.int64)
            return find(keys, [members[k] for k in keys.tolist()])

        now, members, out = None, {}, []
        for batch in batches:
            for hub, band, i, j, key, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub, band, i, j) != now:
                    out += done()
                    now, members = (hub, band, i, j), {}
                members[key] = more
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
                out = []
        out = done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return rows.repartition(*group_of).sortWithinPartitions(*group_of).mapInArrow(run, schema)


def refine(members: DataFrame, firsts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(hub, key): the groups that bitmaps leave, each under its smallest key; firsts: (key, n, bits, ...)."""
    sized = members.join(firsts.select("key", "n", "bits"), "key").select("hub", "key", "n", "bits")
    rows = _in_blocks(sized, block).select("hub", "band", "i", "j", "key", "n", "bits")
    return _by_group(rows, lambda keys, own: group_candidates(keys, np.array([n for n, _ in own], np.int64), [b for _, b in own]), "hub long, key long").distinct()


def tree_links(docs: DataFrame, members: DataFrame, firsts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between keys that span each group's components.  firsts: (key, doc_id, ...) names a text of each key."""
    dealt = _in_blocks(members.join(firsts.select("key", "n"), "key").select("hub", "key", "n"), block)
    dealt = dealt.groupBy("key").agg(F.collect_list(F.struct("hub", "band", "i", "j")).alias("hubs"))
    wanted = dealt.join(firsts.select("key", "doc_id"), "key")
    rows = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "key", "hubs")

    def send(batch: pa.RecordBatch):
        for part, data, offsets in text_slices(batch, 1):
            sets, sizes = shingle_sets(data, offsets)
            found, edge, out = set_keys(sets, sizes).tolist(), np.concatenate(([0], np.cumsum(sizes))).tolist(), []
            for n, (key, hubs) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if key == found[n]:  # else another text of the same doc_id
                    own = sets[edge[n] : edge[n + 1]].tobytes()
                    out += [(h["hub"], h["band"], h["i"], h["j"], key, own) for h in hubs]
            if out:
                yield list(zip(*out, strict=True))

    sent = arrow_map(rows, send, "hub long, band int, i int, j int, key long, shingles binary")
    return _by_group(sent, lambda keys, own: group_links(keys, [np.frombuffer(x, U) for (x,) in own]), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    rows = _rows(docs, key, text).toDF("doc_id", "text")
    described = stored(describe(rows), "described")
    texts = described.where("hash IS NULL").select("doc_id", "key", "n")
    vertices = described.where("n > 0 AND doc_id IS NOT NULL")
    firsts = stored(vertices.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bits").alias("bits")), "firsts")
    members = stored(refine(stored(groups(rows, heavy_shingles(described)), "groups"), firsts), "members")
    # documents with several texts: their sets are one vertex
    several = stored(texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id"), "several")
    own = vertices.select("doc_id", "key").join(several, "doc_id", "left_semi").distinct()
    same = own.join(own.groupBy("doc_id").agg(F.min("key").alias("a")), "doc_id").select("a", F.col("key").alias("b"))
    joined = components(tree_links(rows, members, firsts).unionByName(same)).withColumnsRenamed({"vertex": "key"})
    named = firsts.select("key", "doc_id").join(joined, "key")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    changed = stored(named.join(least, "component").where("component_id <> doc_id").select("key", "component_id"), "components")
    known = stored(firsts.select("key", "doc_id").join(changed, "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id")), "known")
    out = texts.join(known, "key", "left")
    if not several.isEmpty():  # a text without words takes the component of its document's other texts
        shared = own.join(known, "key").groupBy("doc_id").agg(F.min("component_id").alias("shared"))
        out = out.join(shared, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "shared"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


#: DuckDB SQL for op8_near_duplicates' rows: shared shingles are counted pair by pair, so it is for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS origin, a AS node FROM both_ways UNION SELECT r.origin, l.b FROM reached r JOIN both_ways l ON l.a = r.node),
least_ids AS (SELECT origin, min(node) AS component_id FROM reached GROUP BY origin)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN least_ids ON origin = doc_id
"""


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
