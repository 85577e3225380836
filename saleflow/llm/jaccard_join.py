"""Exact n-gram Jaccard join of a table with itself, by signature trees, to connected groups.

1. Rows with the same shingle set form a class; only classes are compared.
2. Two sets of similarity t share one of their first n - ceil(t n) + 1 shingles in any common order. Rare shingles come
   first: a fixed array of SLOTS counters over all documents gives each shingle a frequency level, so a passage that
   many documents share stays out of the prefixes. Classes that share a prefix shingle form a bucket.
3. In a bucket, a signature tree is built over its sets by rising size: a node holds the OR of its members' token
   bitmaps, their size range and most bitmap collisions. The dual traversal drops node pairs whose greatest possible
   overlap can't reach t. The pairs left connect their classes (enough of them to connect all, never all pairs), and
   the components over all buckets are blocks: every link lies inside one block.
   In a block the traversal is done again, now with exact comparison of the sets; pairs already connected are skipped.
   Blocks beyond BLOCK_SETS sets or BLOCK_SHINGLES shingles are cut in parts of like size, and every pair of parts whose
   sizes allow a link is a task.
4. The links' components are the groups.

Sets are compared by 64-bit shingle hashes. Very long texts are one set each; a block's bytes are bounded by BLOCK_SHINGLES but
for one set of its own. Ties: the least doc_id names a group and stays. Nulls and texts without words have no shingles and link with nothing; rows
with a null doc_id link with nothing and have a null component_id. Repeated rows are in one class. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, forget, in_rounds, saved, split_by_keys, swept
from .components import components
from .shingles import shingle_sets
from .tokens import release, text_slices

SLOTS, CHUNKS = 1 << 20, 64
BLOCK_SETS, BLOCK_SHINGLES = 3000, 1_500_000
#: UTF-8 bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 3 << 19
FANOUT = 16
#: Buckets of one shingle beyond BUCKET are connected by a star, without a tree: exact too, as blocks are compared whole; those up to SMALL are tried pair by pair.
BUCKET, SMALL = 20_000, 6


def sets_of(batches: Iterator[pa.RecordBatch], text: int, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    release()
    for batch in batches:
        for first, n in text_slices(batch.column(text), SLICE_BYTES):
            part = batch.slice(first, n)
            yield part, shingle_sets(part.column(text), k)


def narrow_sets(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(per row doc_id, n, class_key: a hash of the set, null without shingles or doc_id; level of each of SLOTS hash slots).

    A level is log2, rounded, of a slot's document count over all documents (a megabyte, whatever the input). Each task
    sends its counts' logarithms, a byte a slot; they only order shingles, so that is exact enough.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for part, sets in sets_of(batches, 1, k):
            counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
            keys = [None if doc_id is None or not len(s) else class_key(s) for s, doc_id in zip(sets, part.column(0).to_pylist(), strict=True)]
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.int64()), *none], names)
        levels = np.rint(np.log2(counts + 1.0) * 4).astype(np.uint8)  # quarters of a power of two
        parts = [x.tobytes() for x in np.split(levels, CHUNKS)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(CHUNKS, pa.int64())] * 3, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS // CHUNKS)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                total += np.exp2(np.frombuffer(x, np.uint8) / 4) - 1
        level = np.rint(np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "levels"])

    names = ["doc_id", "n", "class_key", "chunk", "levels"]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = saved(texts.mapInArrow(count, "doc_id long, n long, class_key long, chunk int, levels binary"), "sets")
    totals = both.where("chunk is not null").select("chunk", "levels").groupBy("chunk").applyInArrow(add, "chunk int, levels binary").collect()
    levels = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint8)
    for r in totals:
        levels[r.chunk] = np.frombuffer(r.levels, np.uint8)
    sets = saved(both.where("chunk is null").select("doc_id", "n", "class_key"), "narrow")
    return swept(sets, both), levels.ravel()


def class_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n shingles with any set that it links with."""
    return -(-percent * n // 100)


def class_table(docs: DataFrame, sets: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """A row for each class: class_key, its least doc_id, n, its rarest shingles (`prefix`, and `often` for those whose slot
    has so many documents that they may be in over BUCKET of them), bitmap.

    Only documents that may share their class with another row (told by a bitmap) are shuffled to their class.
    """
    level_of = docs.sparkSession.sparkContext.broadcast(levels)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = level_of.value.astype(np.uint64)
        for part, sets in sets_of(batches, 1, k):
            ids, sizes, keys, prefixes, frequent, bitmaps = [], [], [], [], [], []
            for s, doc_id in zip(sets, part.column(0).to_pylist(), strict=True):
                if not len(s) or doc_id is None:
                    continue
                ids.append(doc_id)
                sizes.append(len(s))
                keys.append(class_key(s))
                bitmaps.append(bitmap(s, width(len(s))).tobytes())
                p = len(s) - _needed(len(s), percent) + 1
                order = (level[(s >> np.uint64(44)).astype(np.int64)] << np.uint64(58)) | (s >> np.uint64(6))
                rare = np.argpartition(order, p - 1)[:p]
                often = order[rare] >> np.uint64(58) >= np.uint64(max(0, BUCKET.bit_length() - 2))  # levels are rounded
                prefixes.append(s[rare[~often]].view(np.int64))
                frequent.append(s[rare[often]].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, frequent)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (keys, ids, sizes)), *lists, pa.array(bitmaps, pa.binary())], names)

    names = ["class_key", "doc_id", "n", "prefix", "often", "bitmap"]
    schema = "class_key long, doc_id long, n long, prefix array<bigint>, often array<bigint>, bitmap binary"
    again = sets.where("class_key is not null").groupBy("class_key").count().where("count > 1").select("class_key")
    shared = saved(sets.join(again, "class_key", "left_semi").select(F.col("doc_id").alias("of")).distinct(), "shared")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    near, far = split_by_keys(texts, F.col("doc_id"), shared, F.col("of"))
    first = [F.first(c).alias(c) for c in names[2:]]
    classes = near.mapInArrow(describe, schema).groupBy("class_key").agg(F.min("doc_id").alias("doc_id"), *first)
    if far is not None:
        classes = classes.unionByName(far.mapInArrow(describe, schema))
    return swept(saved(classes, "classes"), shared)


def width(n: int) -> int:
    """Bits of the bitmap of a set of n shingles: a power of two of at least n."""
    return min(1 << 15, max(256, 1 << (n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little")


class SignatureTree:
    """Bitmaps, size ranges and collisions of sets sorted by size, level by level (level 0: the sets themselves).

    A collision is a shingle beyond one per bit. A set's overlap with another is at most the bits they share and the
    lesser of their collisions.
    """

    def __init__(self, maps: np.ndarray, size: np.ndarray) -> None:
        maps = maps.view(np.uint64)
        spare = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, spare)]
        while len(maps) > FANOUT:
            at = np.arange(0, len(maps), FANOUT)
            _, low, high, spare = self.levels[-1]
            maps = np.bitwise_or.reduceat(maps, at)
            self.levels.append((maps, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def may_link(self, level: int, a: int, b: np.ndarray, percent: int) -> np.ndarray:
        """Which nodes of `b` could hold a set that links with one under node `a`."""
        maps, low, high, spare = self.levels[level]
        fits = (100 * high[b] >= percent * low[a]) & (100 * high[a] >= percent * low[b])
        common = np.bitwise_count(maps[a] & maps[b]).sum(1, dtype=np.int64) + np.minimum(spare[a], spare[b])
        common = np.minimum(common, np.minimum(high[a], high[b]))
        return fits & ((100 + percent) * common >= percent * (low[a] + low[b]))

    def partners(self, percent: int, group: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """For each set the later sets that it may link with, by a dual traversal from the top.

        Sets of one `group` (updated by the caller as it goes) aren't told to each other.
        """
        top = len(self.levels) - 1
        stack = [(top, a, np.arange(a, len(self.levels[top][0]))) for a in range(len(self.levels[top][0]))]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                b = b[b != a]
                if group is not None:
                    b = b[group[b] != group[a]]
                if len(b):
                    yield a, b[self.may_link(0, a, b, percent)]
                continue
            b = b[self.may_link(level, a, b, percent)]
            n = len(self.levels[level - 1][0])
            below = (b[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < n]
            for child in range(a * FANOUT, min((a + 1) * FANOUT, n)):
                stack.append((level - 1, child, below[below >= child]))


def bucket_edges(keys: list[int], size: np.ndarray, maps: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Edges that connect all classes of a bucket that a bitmap lets link; at most one less than classes for each width."""
    order = np.argsort(size, kind="stable")
    for w in sorted({len(m) for m in maps}):
        mine = [i for i in order if len(maps[i]) in (w, 2 * w)]
        rows = np.zeros((len(mine), w), np.uint8)
        for row, i in zip(rows, mine, strict=True):
            m = np.frombuffer(maps[i], np.uint8)
            row[:] = m if len(m) == w else m[:w] | m[w:]
        group = np.arange(len(mine))
        for a, b in SignatureTree(rows, size[mine]).partners(percent, group):
            while len(b):
                yield keys[mine[a]], keys[mine[b[0]]]
                group[group == group[b[0]]] = group[a]
                b = b[group[b] != group[a]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], bool]]:
    """(starts and end of the runs of equal values in the first column, all columns, whether the first run goes on).

    A run that reaches the end of a batch waits for the next, unless it is longer than BUCKET: then it is told so far,
    and its first row stands for all of it when it goes on.
    """
    held: list[np.ndarray] | None = None
    goes_on = False
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        heads = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
        last = heads[-1]
        if len(columns[0]) - last > BUCKET or goes_on and not last:
            yield np.append(heads, len(columns[0])), columns, goes_on
            held, goes_on = [c[last : last + 1] for c in columns], True
        else:
            yield heads, [c[:last] for c in columns], goes_on
            held, goes_on = [c[last:] for c in columns], False
    if held is not None:
        yield np.array([0, len(held[0])]), held, goes_on


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes that connect all those with a common prefix shingle that their bitmaps let link.

    Prefix shingles are shuffled once, a ROUNDS-th of them at a time. Buckets of up to SMALL classes give their pairs of fitting sizes, each of which is
    tried on bitmaps once; of larger buckets the classes go on to the trees, but for those beyond BUCKET, a star. Shingles
    of over BUCKET classes and HOT_SHARE of all (so fewer than 1 / HOT_SHARE) aren't shuffled: their stars are made by a broadcast.
    """
    of = lambda c: classes.select(F.explode(c).alias("token"), "class_key", F.col("n").cast("int").alias("n"))
    centres = of("often").groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("class_key").alias("least"))
    all_ = classes.agg(F.count(F.lit(1)).alias("classes"), F.sum(F.size("prefix") + F.size("often")).alias("tokens")).first()
    centres = saved(centres.where(F.col("m") > max(BUCKET, HOT_ROWS, int(all_.classes * HOT_SHARE))).drop("m"), "hot")
    hot = of("often").join(F.broadcast(centres), "token").select(F.lit("star").alias("kind"), F.col("class_key").alias("a"), F.col("least").alias("b"))
    tokens = of("prefix").unionByName(of("often").join(F.broadcast(centres.select("token")), "token", "left_anti"))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b"]
        for bounds, (token, key, n), goes_on in _runs(batches):
            size = np.diff(bounds)
            pairs: set[tuple[int, int]] = set()
            large = []
            for first, count in zip(bounds[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
                if count > SMALL or goes_on and not first:
                    large.append((first, count))
                    continue
                k, m = key[first : first + count].tolist(), n[first : first + count].tolist()
                for i in range(count):
                    for j in range(i):
                        if 100 * min(m[i], m[j]) >= percent * max(m[i], m[j]):
                            pairs.add((max(k[i], k[j]), min(k[i], k[j])))
            for first, count in large:
                part = key[first : first + count]
                star = count > BUCKET or goes_on and not first
                other = np.full(count, part[0] if star else token[first])
                yield pa.RecordBatch.from_arrays([pa.array(["star" if star else "large"] * count, pa.string()), pa.array(part), pa.array(other)], names)
            yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(pairs), pa.string()), *(pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1))], names)

    found = []
    for part in in_rounds(tokens, "token", all_.tokens or 0):
        rows = part.repartition("token").sortWithinPartitions("token")
        found.append(swept(saved(rows.mapInArrow(buckets, "kind string, a long, b long"), "buckets")))  # b of large: the shingle
    steps, found = found, reduce(DataFrame.unionByName, found)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, j = int.from_bytes(p, "little"), int.from_bytes(q, "little")
                w = 8 * min(len(p), len(q))
                i, j = ((v | v >> w) & ((1 << w) - 1) if 8 * len(m) > w else v for v, m in ((i, p), (j, q)))
                common = (i & j).bit_count() + min(x - i.bit_count(), y - j.bit_count())
                if (100 + percent) * min(common, x, y) >= percent * (x + y):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        token, keys, size, maps = None, [], [], []

        def told() -> pa.RecordBatch:
            pairs = [(max(p), min(p)) for p in found]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for t, k, m, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != token:
                    if keys:
                        found.update(bucket_edges(keys, np.array(size), maps, percent))
                    token, keys, size, maps = t, [], [], []
                    if len(found) > 200_000:
                        yield told()
                keys.append(k)
                size.append(m)
                maps.append(bits)
        if keys:
            found.update(bucket_edges(keys, np.array(size), maps, percent))
        yield told()

    of = lambda c: classes.select(F.col("class_key").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"m_{c}"))
    pairs = found.where("kind = 'pair'").select("a", "b").distinct()
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "m_a", "m_b").mapInArrow(prune, "a long, b long")
    pairs = swept(saved(pairs, "pairs"))  # one kind after the other, so that their bitmaps aren't on disk together
    many = found.where("kind = 'large'").join(of("a"), "a").select(F.col("b").alias("token"), "a", "n_a", "m_a")
    many = many.repartition("token").sortWithinPartitions("token").mapInArrow(trees, "a long, b long")
    many = swept(saved(many, "many"))
    stars = found.where("kind = 'star'").unionByName(hot).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = saved(pairs.unionByName(many).unionByName(stars).distinct(), "candidates")
    return swept(edges, centres, *steps, pairs, many)


def block_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect all linked sets of a block. `side`: -1, or else only pairs of side 0 with side 1 count."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, side = [sets[i] for i in order], side[order]
    size = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    begins = ends - size
    group = np.arange(len(sets))
    mark = np.zeros(codes.max() + 1, np.int64)
    bits = width(int(np.percentile(size, 90)))
    tree = SignatureTree(np.array([bitmap(s, bits) for s in sets]), size)
    for a, b in tree.partners(percent, group):
        if side[a] >= 0:
            b = b[side[b] != side[a]]
        if not len(b):
            continue
        own = codes[begins[a] : ends[a]]
        mark[own] = 1
        step = 1
        while len(b):
            some, b, step = b[:step], b[step:], min(4 * step, 256)
            flat = np.concatenate([codes[begins[j] : ends[j]] for j in some])
            common = np.add.reduceat(mark[flat], np.cumsum(size[some]) - size[some])
            for j in some[100 * common >= percent * (size[a] + size[some] - common)]:
                if group[a] != group[j]:
                    group[group == group[j]] = group[a]
                    yield int(order[a]), int(order[j])
            b = b[group[b] != group[a]]
        mark[own] = 0


#: Parts of one size that a part's number has room for.
PARTS = 1 << 32


def _parts(members: DataFrame) -> DataFrame:
    """Per block whether it is cut, and the parts that its sets are dealt to: a map from size class to a number of parts.

    A block of up to BLOCK_SETS sets and BLOCK_SHINGLES shingles is one part, of size class 0. The sets of others are parted
    by their size's logarithm, so that linked sets are of one size class or of two that follow each other: only such parts meet.
    """
    need = lambda sets, total: F.ceil(F.greatest(sets / BLOCK_SETS, total / BLOCK_SHINGLES)).cast("long")
    sizes = members.groupBy("block", "size").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    blocks = sizes.groupBy("block").agg(  # at most one entry per size class
        need(F.sum("sets"), F.sum("total")).alias("all"), F.map_from_entries(F.collect_list(F.struct("size", need(F.col("sets"), F.col("total"))))).alias("parts")
    )
    one = F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return blocks.select("block", (F.col("all") > 1).alias("cut"), F.when(F.col("all") > 1, F.col("parts")).otherwise(one).alias("parts"))


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes; enough of them to connect every two that are linked. `classes` is deleted on the way."""
    candidates = candidate_edges(classes, percent)
    blocks = components(candidates)
    forget(candidates)
    members = blocks.join(classes.select("class_key", "doc_id", "n").hint("merge"), F.col("node") == F.col("class_key")).select("class_key", "doc_id", "n", F.col("component").alias("block"))
    members = saved(members.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / (-math.log(percent / 100) * 1.0001)).cast("long")), "blocks")
    swept(members, classes)
    dealt = members.join(_parts(members), "block")
    size = F.when(F.col("cut"), F.col("size")).otherwise(0)
    own = size * PARTS + F.pmod(F.xxhash64("class_key"), F.col("parts")[size])

    def parts_of(size: Column) -> Column:  # a sequence from 0 to the number of parts, but for its last
        some = F.sequence(F.lit(0).cast("long"), F.coalesce(F.try_element_at("parts", size), F.lit(0).cast("long")))
        return F.transform(F.slice(some, 1, F.size(some) - 1), lambda i: size * PARTS + i)

    meets = [parts_of(size + d) for d in (-1, 0, 1)]
    dealt = dealt.select("class_key", "doc_id", "block", own.alias("own"), F.explode(F.concat(*meets)).alias("other"))
    tasks = dealt.select("class_key", "doc_id", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        task = None

        def done() -> Iterator[pa.RecordBatch]:
            if task and len(held) > 1:
                keys = list(held)
                own = np.array([x[1] for x in held.values()])
                side = np.full(len(keys), -1) if task[1] == task[2] else (own == task[2]).astype(np.int64)
                found = list(block_links([x[0] for x in held.values()], side, percent))
                yield pa.RecordBatch.from_arrays([pa.array([keys[p[i]] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for part, got in sets_of(batches, 5, k):
            rows = zip(*(part.column(c).to_pylist() for c in range(5)), got, strict=True)
            for key, block, i, j, own, s in rows:
                if (block, i, j) != task:
                    yield from done()
                    task, held = (block, i, j), {}
                if key == class_key(s):
                    held[key] = (s, own)
        yield from done()

    members = swept(saved(tasks.withColumnRenamed("doc_id", "of"), "members"), members)
    texts, _ = split_by_keys(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.col("doc_id"), members, F.col("of"))
    rows = texts.join(members.hint("merge"), F.col("doc_id") == F.col("of")).select("class_key", "block", "i", "j", "own", "text")
    rows = rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    return swept(saved(rows.mapInArrow(verify, "a long, b long"), "links"), members)


def groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (least doc_id that it reaches over links)."""
    sets, levels = narrow_sets(docs, k)
    edges = links(docs, class_table(docs, sets, levels, k, percent), k, percent)
    found = components(edges)
    forget(edges)
    classes = sets.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("least"))
    named = classes.join(found, classes["class_key"] == found["node"], "left")
    named = named.select("class_key", "least", F.coalesce("component", "class_key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("class_key", "component_id")
    out = sets.select("doc_id", "n", "class_key").join(named, "class_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the least doc_id, with its own columns.

    Rows that share a doc_id with each other and a group are one document; rows without words or doc_id all stay.
    """
    found = swept(saved(groups(docs, k, percent), "groups"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("of"), F.lit(True).alias("goes"))
    again = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("of"), F.lit(False).alias("goes"))
    touched = saved(gone.unionByName(again).groupBy("of").agg(F.max("goes").alias("goes")), "touched")
    swept(touched, found)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    near, far = split_by_keys(whole, F.col("row.doc_id").cast("long"), touched, F.col("of"))  # the others stay as they are, without a shuffle
    rows = near.join(touched.hint("merge"), F.col("row.doc_id") == F.col("of"), "left")
    single = rows.where("not goes").dropDuplicates(["of"])
    rows = rows.where("goes is null").unionByName(single).select("row")
    return (rows if far is None else rows.unionByName(far)).select("row.*")
