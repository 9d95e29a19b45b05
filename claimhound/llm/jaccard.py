"""N-gram Jaccard join (op6): a size-aware heavy-light join of shingle sets.

A document's set holds the hashes of its 5-word shingles. Equal sets are one
class, so copies are never compared. All sets are put in one global order, rare
shingles first by a sketch of counts over the whole table. Two sets that are
similar enough share an element of their prefixes; sets up to a boundary size
enumerate the pairs of elements (subsets of fixed size) of a prefix one longer,
of which similar sets share one, and larger sets are looked up in the inverted
lists of single elements. The boundary is the size at which both together are
cheapest, from the costs of all sets.

Lists and subsets only say who may be similar to whom. The more texts there are,
the more of them share a key by chance, until such links connect nearly all. So
the pairs of a key that few sets have are compared by parity bits of their
shingles, which surely differ little where the sets are similar; the many sets
of another key are linked as they are. Sets connected by what is left
are dealt to tasks in pairs of blocks, and a task finds all its similar pairs by
scanning inverted lists of the blocks' shingles, so every pair with a common key
is compared, exactly unless its bits tell it apart, no pair of many is a row, and
no task holds more than two blocks.
What a task returns is a spanning forest of its links.

Cases: a null or empty text, or one of white space, has no set and is linked with
nothing; fewer than five words are one shingle; repeated rows are copies; links
are between sets, so rows of one doc_id with different texts are apart unless
their texts are alike, and rows without doc_id are linked as all others, with a
null component if no row of theirs has an id; an empty table gives an empty one;
extra columns are carried by ``one_of_each`` and otherwise not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimhound.llm.bloom import bloom_filter, may_hold
from claimhound.llm.components import components
from claimhound.llm.staging import staged, table
from claimhound.llm.words import mixed, pieces, utf8, word_hashes

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
#: Partial sketches are added in so many groups first.
SKETCH_GROUPS = 64
#: The boundary between small and large sets is sought up to here.
MOST_SMALL = 64
#: Up to so many sets of a key are compared in pairs by their bits before they are grouped.
FEW = 16
#: Least number of parity bits of a set.
LEAST_BITS = 64
#: Shingles of all sets of a block, about; a task holds at most two blocks.
BLOCK_SHINGLES = 1 << 21


def _overlap(n: np.ndarray) -> np.ndarray:
    """Least intersection of a set of size ``n`` with any similar set."""
    return -(-PERCENT * n // 100)


def _overlap_with_larger(n: np.ndarray) -> np.ndarray:
    """The same with any similar set that is not smaller."""
    return -(-2 * PERCENT * n // (100 + PERCENT))


def _difference(n: np.ndarray) -> np.ndarray:
    """Most elements that are in one only of two similar sets with ``n`` elements together."""
    return n - 2 * -(-PERCENT * n // (100 + PERCENT))


def parity_bits(found: np.ndarray) -> bytes:
    """For each value of some bits of the shingles' hashes, whether an odd number has it.

    There are as many bits as elements or more, a power of two. Each element
    that two sets do not share changes one bit, so bits differ in no more places.
    """
    size = max(LEAST_BITS, 1 << (len(found) - 1).bit_length())
    at = (found >> np.uint64(24)) & np.uint64(size - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def bits_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many places the parity bits of each pair differ, as far as the shorter ones tell."""
    apart = np.zeros(len(a), dtype=np.int64)
    lengths = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for two in np.unique(lengths, axis=0):
        rows = np.flatnonzero((lengths == two).all(axis=1))
        for some in np.array_split(rows, 1 + len(rows) * int(two.max()) // (1 << 24)):
            short, long = sorted(
                (np.frombuffer(b"".join(side[i] for i in some), dtype=np.uint8).reshape(len(some), -1) for side in (a, b)),
                key=lambda x: x.shape[1],
            )
            while long.shape[1] > short.shape[1]:
                half = long.shape[1] // 2
                long = long[:, :half] ^ long[:, half:]
            apart[some] = np.bitwise_count(long ^ short).sum(axis=1, dtype=np.int64)
    return apart


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    words, first = word_hashes(data, offsets)
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
    h = mixed(h)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            found = np.sort(h[a : b - SHINGLE + 1])
            new = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            yield found[new]
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + int(w)) % (1 << 64))
            yield mixed(np.array([whole], dtype=np.uint64))
        else:
            yield h[:0]


def _sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = utf8(batch.column("text").cast(pa.large_string()))
    for a, b in pieces(offsets):
        yield from shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def count_sketch(docs: DataFrame) -> np.ndarray:
    """How many sets use the shingles of each of 2**SKETCH_BITS hash values, over all rows.

    Its size is fixed. Whatever it holds, the order made from it is a global
    order; it only puts frequent shingles last.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in batches:
            for found in _sets_of(batch):
                np.add.at(total, _counter(found), 1)
        group = TaskContext.get().partitionId() % SKETCH_GROUPS
        parts = np.split(total.astype("<i8"), SKETCH_BLOCKS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(SKETCH_BLOCKS), pa.int32()),
                pa.array([group] * SKETCH_BLOCKS, pa.int32()),
                pa.array([press(p) for p in parts], pa.binary()),
            ],
            names=["block", "part", "counts"],
        )

    def press(counts: np.ndarray) -> bytes:
        return zstandard.compress(counts.tobytes(), 1)

    def read(data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(data), dtype="<i8")

    def added(parts: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, dtype=np.int64)
        for p in parts["counts"]:
            total += read(p.as_py())
        return parts.slice(0, 1).set_column(2, "counts", pa.array([press(total)], pa.binary()))

    schema = "block int, part int, counts binary"
    each = docs.select("text").mapInArrow(counts, schema)
    some = each.groupBy("block", "part").applyInArrow(added, schema)
    rows = some.groupBy("block").applyInArrow(added, schema).collect()  # SKETCH_BLOCKS rows
    total = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), dtype=np.int64)
    for r in rows:
        total[r.block] = read(bytes(r.counts))
    return np.minimum(total.ravel(), np.iinfo(np.int32).max).astype(np.int32)


#: What tells sets apart.
SET = ["fp_a", "fp_b", "n"]
PROFILE = "doc_id long, text_hash long, n long, fp_a long, fp_b long, listed long, prefix binary, bits binary"


def profiles(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Per row: size, fingerprint, prefix and parity bits of its set, and how often the prefix is listed."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    usual = int(np.median(sketch))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in _sets_of(batch):
                n = len(found)
                if not n:
                    out.append((0, None, None, 0, None, None))
                    continue
                often = shared.value[_counter(found)]
                size = int(n - _overlap(n) + 2)
                at = np.argpartition(often, size - 1)[:size] if size < n else np.arange(n)
                near = np.flatnonzero(often <= often[at].max())  # ties are ordered by hash
                at = near[np.lexsort((found[near], often[near]))][:size]
                fp_b = mixed(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
                fp_a = found.sum(dtype=np.uint64)
                listed = int(np.maximum(often[at[: size - 1]] - usual, 1).sum())
                fps = np.array([fp_a, fp_b]).view(np.int64).tolist()
                out.append((n, *fps, listed, found[at].tobytes(), parity_bits(found)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            own = [batch.column("doc_id"), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays([*own, *arrays], names=names)

    names = ["doc_id", "text_hash", "n", "fp_a", "fp_b", "listed", "prefix", "bits"]
    return docs.mapInArrow(rows, PROFILE)


def boundary(found: DataFrame) -> int:
    """The largest size of small sets: where subsets and lists together cost least.

    A small set costs the pairs of its prefix; a large one its prefix and the
    sets listed there, beyond what unrelated shingles add to the sketch.
    """
    sizes = found.where(F.col("n").between(4, MOST_SMALL)).groupBy("n")
    rows = {r.n: r for r in sizes.agg(F.count("*").alias("sets"), F.sum("listed").alias("listed")).collect()}
    best, least, cost = 3, 0.0, 0.0  # cost of small sets less that of looking them up
    for n in sorted(rows):
        size = n - int(_overlap(n)) + 2
        cost += rows[n].sets * size * (size - 1) / 2 - rows[n].listed
        if cost < least:
            best, least = n, cost
    return best


def keyed(classes: DataFrame, small: int) -> DataFrame:
    """key, n, short, node: subsets of small sets, and elements of sets a large one may resemble.

    Of two similar sets, the smaller one holds a common element in its short
    prefix, which is all that it needs to share with sets that are not smaller.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            for lo in range(0, len(nodes), 1024):
                keys, owner, short = [], [], []
                for i in range(lo, min(lo + 1024, len(nodes))):
                    prefix = np.frombuffer(batch.column("prefix")[i].as_py(), dtype=np.uint64)
                    first = int(sizes[i] - _overlap_with_larger(sizes[i]) + 1)
                    if sizes[i] <= small:
                        a, b = np.triu_indices(len(prefix), 1)
                        pairs = mixed(prefix[a] * np.uint64(0x9E3779B97F4A7C15) + prefix[b])
                        keys.append(pairs)
                        owner.append(np.full(len(pairs), i))
                        short.append(np.ones(len(pairs), dtype=bool))
                    if 100 * sizes[i] >= PERCENT * small:
                        keys.append(prefix[:-1])
                        owner.append(np.full(len(prefix) - 1, i))
                        short.append(np.arange(len(prefix) - 1) < first)
                if not keys:
                    continue
                at = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(sizes[at]),
                        pa.array(np.concatenate(short).astype(np.int8)),
                        pa.array(nodes[at]),
                    ],
                    names=["key", "n", "short", "node"],
                )

    return classes.select("node", "n", "prefix").mapInArrow(
        rows, "key long, n long, short byte, node long"
    )


def related(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links that connect all sets of one key that may be similar.

    A key's sets are read in order of size and never held, if they are more than
    FEW. Each is linked to the last set before it that has the key in its
    short prefix, unless that is too small; between that one and any earlier
    candidate, the same links make a chain. Of a key with FEW sets or less, each
    is paired with all such sets before it, and pairs whose bits differ in more
    places than similar sets can are left out.
    """
    few = FEW

    def chain(key, n, node, short, rows):
        """Links of the ``rows``, to sets that may be before them."""
        at = np.arange(len(key))
        last = np.maximum.accumulate(np.where(short > 0, at, -1))
        before = np.concatenate(([-1], last[:-1]))[rows]
        ok = before >= 0
        before, rows = before[ok], rows[ok]
        ok = (key[before] == key[rows]) & (PERCENT * n[rows] <= 100 * n[before]) & (node[before] != node[rows])
        return node[before[ok]], node[rows[ok]]

    def pairs(key, n, node, short, rows):
        """Pairs among the ``rows``, all sets of their keys."""
        key, n, node, short = key[rows], n[rows], node[rows], short[rows]
        a, b = [node[:0]], [node[:0]]
        for lag in range(1, few):
            low, high = slice(0, max(0, len(key) - lag)), slice(lag, None)
            same = key[low] == key[high]
            if not same.any():
                break
            ok = same & (short[low] > 0) & (PERCENT * n[high] <= 100 * n[low]) & (node[low] != node[high])
            a.append(node[low][ok])
            b.append(node[high][ok])
        return np.concatenate(a), np.concatenate(b)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 4
        many = None  # the last key, if it is known to have more than FEW sets: one row of it is kept at most

        def links(columns, end: bool) -> pa.RecordBatch:
            nonlocal kept, many
            key, n, node, short = columns
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            long = size > few
            if many is not None and key[0] == many:
                long[0] = True
            of = np.repeat(np.arange(len(first)), size)
            open_ = first[-1] if not (end or long[-1]) else len(key)  # the last key may go on
            at = np.arange(len(key))
            start = len(kept[0]) if many is not None and key[0] == many else 0  # kept rows of it had their link
            a, b = chain(*columns, at[long[of] & (at >= start)])
            c, d = pairs(*columns, at[~long[of] & (size[of] > 1) & (at < open_)])
            if end:
                kept, many = [x[:0] for x in columns], None
            elif long[-1]:
                held = first[-1] + np.flatnonzero(short[first[-1] :] > 0)[-1:]
                kept, many = [x[held] for x in columns], key[-1]
            else:
                kept, many = [x[open_:] for x in columns], None
            x, y = np.concatenate((a, c)), np.concatenate((b, d))
            doubt = np.repeat(np.array([0, 1], dtype=np.int8), [len(a), len(c)])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(doubt)], names=["a", "b", "doubt"]
            )

        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c).to_numpy() for c in ("key", "n", "node", "short")]
                yield links([np.concatenate(x) for x in zip(kept, columns, strict=True)], False)
        if len(kept[0]) and many is None:
            yield links(kept, True)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, doubt = (batch.column(c).to_numpy() for c in ("n", "doubt"))
            apart = bits_apart(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            ok = pa.array((doubt == 0) | (apart <= _difference(n)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    order = ["key", "n", "node"]
    dealt = entries.repartition("key").sortWithinPartitions(*order)
    found = dealt.mapInArrow(rows, "a long, b long, doubt byte").groupBy("a", "b").agg(F.min("doubt").alias("doubt"))
    for side in ("a", "b"):
        own = classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        found = found.join(own, side)
    found = found.select("a", "b", "doubt", (F.col("n_a") + F.col("n_b")).alias("n"), "bits_a", "bits_b")
    return found.mapInArrow(near, "a long, b long")


def similar_in(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, by scanning inverted lists.

    ``side``: 0 for the sets of one block and 1 for those of another, whose
    links among themselves are another task's; all 0 if there is one block.

    A set that is scanned is compared with all others. Sets that share too few
    elements with any other need no scan, nor do members of the largest
    component: at the end every set outside it has been scanned, so two sets of
    different components are known not to be similar. What a scan costs depends
    on the lists it reads alone.
    """
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    size = np.diff(np.append(starts, len(flat)))
    element = np.repeat(np.arange(len(starts)), size)
    by_set = np.argsort(owner, kind="stable")
    elements = element[by_set]
    at = np.concatenate(([0], np.cumsum(n)))
    shared = np.add.reduceat(size[elements] > 1, at[:-1]) if len(elements) else n
    scanned = (shared < _overlap(n)).tolist()
    del flat, order, element, by_set, shared
    parent, weight, largest = list(range(len(sets))), [1] * len(sets), 0
    two, links, going = bool(side.any()), [], True

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    while going:  # again only if another component has become the largest
        going = False
        for i in range(len(sets)):
            if scanned[i] or (weight[largest] > 1 and root(i) == largest):
                continue
            scanned[i] = going = True
            e = elements[at[i] : at[i + 1]]
            e = e[size[e] > 1]
            k = size[e]
            places = np.repeat(starts[e] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            if len(places) < len(sets):
                met, common = np.unique(owner[places], return_counts=True)
            else:
                common = np.bincount(owner[places], minlength=len(sets))
                met = np.flatnonzero(common)
                common = common[met]
            alike = 100 * common >= PERCENT * (n[met] + n[i] - common)
            if two:
                alike &= side[met] != side[i]
            for j in met[alike].tolist():
                a, b = root(i), root(j)
                if a != b:
                    links.append((int(nodes[i]), int(nodes[j])))
                    a, b = (a, b) if weight[a] >= weight[b] else (b, a)
                    parent[b] = a
                    weight[a] += weight[b]
                    if weight[a] > weight[root(largest)]:
                        largest = a
            largest = root(largest)
    return links


def _dealt(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``h`` a filter of fixed size over that of ``keys`` lets through, and the others.

    Only the first may have a key, so they alone need a shuffle to find it.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bloom_filter(keys, "h"))

    def passed(others: bool):
        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column("h").to_numpy().view(np.uint64)
                at = may_hold(shared.value, h)
                yield batch.take(pa.array(np.delete(np.arange(len(h)), at) if others else at))

        return rows_of

    return rows.mapInArrow(passed(False), rows.schema), rows.mapInArrow(passed(True), rows.schema)


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return _dealt(rows, keys)[0]


def _keys(rows: DataFrame) -> DataFrame:
    """``rows`` with the doc_id (perhaps null) and text_hash to join by renamed, and their hash ``h``."""
    h = F.xxhash64("doc_id", "text_hash")
    return rows.withColumn("h", h).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})


def _without_null() -> list[Column]:
    """The keys of ``_keys`` as columns that are equal for equal rows and never null."""
    return [F.isnull("id").alias("none"), F.coalesce("id", F.lit(0)).alias("known_id"), F.col("hash")]


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))


def links_among(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: links that connect all similar sets of ``groups`` (component, node, doc_id, text_hash, n).

    A group is dealt to blocks of about BLOCK_SHINGLES by a hash, and each pair
    of its blocks is a task's work. Texts are dealt, which take less room than
    their sets; of rows with one id and text, one is taken.
    """
    sizes = groups.groupBy("component").agg(
        F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    row = ["doc_id", "text_hash"]
    members = groups.join(sizes, "component").select("component", "node", *row, "blocks", own)
    members = staged(_keys(members), "members")
    wanted = _only(docs.select(*row, "text", F.xxhash64(*row).alias("h")), members)
    # grouped by the keys they are joined by, none of them null, so texts are dealt once for both
    wanted = wanted.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    wanted = wanted.groupBy(*_without_null()).agg(F.any_value("text").alias("text"))
    members = members.select("component", "node", "blocks", "own", *_without_null())
    texts = members.join(wanted, ["none", "known_id", "hash"])
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "node",
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "text",
    )

    def linked(members: pa.Table) -> pa.Table:
        nodes = members["node"].to_numpy()
        sets = [s for b in members.select(["text"]).to_batches() for s in _sets_of(b)]
        found = similar_in(nodes, sets, members["side"].to_numpy()) if len(sets) > 1 else []
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.groupBy("component", "low", "high").applyInArrow(linked, "a long, b long")


def _labelled(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n, and as ``head`` the first row of its component.

    The first is that of the smallest doc_id, nulls last, then of the smallest
    hash of its text. Rows without a set have no head. A class's number is
    given when the classes are written.
    """
    docs = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    found = staged(profiles(docs, count_sketch(docs)), "set-profiles")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash"))
    classes = (
        found.where("n > 0")
        .groupBy(*SET)
        .agg(first.alias("first"), F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = staged(classes, "set-classes")
    large_enough = classes.where("n >= 4")  # smaller sets equal all they resemble
    groups = components(related(keyed(large_enough, boundary(found)), large_enough))
    members = groups.join(large_enough, "node")
    members = members.select("component", "node", "first.doc_id", "first.text_hash", "n")
    linked = components(links_among(docs, members))
    heads = linked.join(classes, "node").groupBy("component").agg(F.min("first").alias("head"))
    named = linked.join(heads, "component").select("node", "head")
    labels = classes.join(named, "node", "left").select(*SET, F.coalesce("head", "first").alias("head"))
    return found.select("doc_id", "text_hash", *SET).join(labels, SET, "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    return _labelled(docs).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("head.doc_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row for each component: its first; columns as they are.

    Of rows with the same doc_id and text, one stays; rows that have neither a
    set nor a doc_id all stay. The rows to drop, and those that are there
    several times, are written first, so their true size decides how they are
    joined; rows that are surely neither take no part in that.
    """
    row = ["doc_id", "text_hash"]
    is_head = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (
        F.col("head.text_hash") == F.col("text_hash")
    )
    bare = F.col("head").isNull()
    found = staged(_labelled(docs).select(*row, (bare | is_head).alias("stays"), bare.alias("bare")), "components")
    near = staged(_keys(found.where("NOT stays").select(*row).distinct()), "near-copies")
    several = found.where("stays AND NOT (bare AND doc_id IS NULL)").groupBy(*row).count()
    again = staged(_keys(several.where("count > 1").select(*row)), "repeated-rows")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    ).withColumn("h", F.xxhash64(*row))
    marked = near.unionByName(again)
    perhaps, apart = (r.drop("h") for r in _dealt(rows, marked))
    once = apart.unionByName(perhaps.join(marked, _same_row(), "left_anti"))
    repeated = _only(rows, again).drop("h").dropDuplicates(row)
    repeated = repeated.join(again, _same_row(), "left_semi")
    return once.unionByName(repeated).select("row.*")


def op6_heavy_light_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
