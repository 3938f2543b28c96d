"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has one bit per hash bit, set if more than half of its features' hashes set it. Two fingerprints
link if at most `radius` bits differ. To find the links, bit i gets a vector phi(i) of radius+1 bits; each nonzero
vector v is a table that keeps the bits with <phi(i), v> odd. The phi of at most `radius` differing bits span a space
that some v is orthogonal to, so that table keeps none of them: every pair within the radius collides in some table.

Work at scale: equal fingerprints are one node. Table rows whose key occurs once are dropped after a count that combines
before its shuffle. Buckets of up to `block` nodes are linked by a union-find inside the bucket, which emits a spanning
forest, never the pairs; each task contracts the links of all of its buckets. A larger bucket is split exactly: within
a bucket only the bits outside its mask differ, and two nodes within the radius share a point at most ceil(radius/2)
flips away from either, so every node joins the group of each such point. A group holds at most as many nodes as there
are points around it, however large the bucket was. Links become components by alternating stars over nodes in the order
of their smallest ids, so a root is the component's id.

The contract query and the pipeline's stage take four-word shingles with repeats and radius 4. `drop_near_duplicates` is another
measure, of exact similarity: it links texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more, and computes it for every link: min-hash bands only
find candidates, which depends on the similarity alone and not on whether an edit is a block or scattered. A pair at
similarity J meets in one of BANDS bands with a chance of 1 - (1 - J^ROWS)^BANDS (at 0.8: all but 6 in 100,000 pairs).
Bands that hold the same texts count once; the texts of one meet with their shingle hashes (64 bits) and are compared
exactly, in a union-find that emits a spanning forest. Bands of over GROUP texts are dealt into shares first; see `similar_links`.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other. Repeated
rows are each labelled. Rows with a null doc_id get the smallest doc_id that is not null in their component, null if
there is none. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, partitions, small_batches
from tidemark.llm.components import connected_components, meet

SEED = 42
#: Nodes of a bucket that are compared with each other directly.
BLOCK = 1024
#: Links that a task gathers before it contracts and passes them on.
HELD = 500_000
#: The least Jaccard similarity of five-word shingles that links, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 6
#: Texts of a band that are compared in one task; shares of larger bands have about half as many.
GROUP = 1024
_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str, width: int) -> list[bytes]:
    """The text's width-word shingles in order, repeats included; the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the unsigned 64-bit hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _hashed(items, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in items), dtype=np.uint64)


def shingle_fingerprint(text: str, width: int = 4) -> int:
    return majority(_hashed(shingles(text, width), SEED))


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = _hashed(words, SEED)
    width = min(width, len(words))
    n = len(words) - width + 1
    x = h[:n].copy()
    for j in range(1, width):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ (x >> np.uint64(32)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of the set's min-hashes; none for an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, ((hashes[i : i + 1024, None] ^ _FLIP) * _TIMES).min(axis=0))
    keys = (low.reshape(BANDS, ROWS) * _TIMES[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _FLIP[:BANDS]
    return keys.view(np.int64)


@F.pandas_udf(T.LongType())
def _shingle_fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingle_fingerprint(t) for t in batch], dtype="uint64").astype("int64")


@F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
def _banded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """128 bits that stand for the set of shingles, and its band keys."""
    for batch in texts:
        out = []
        for t in batch:
            made = shingle_set(t)
            out.append((*np.frombuffer(xxhash.xxh3_128_digest(made.tobytes()), dtype="<i8").tolist(), band_keys(made)))
        yield pd.DataFrame(out, columns=["fp", "fp2", "keys"])


@F.pandas_udf(T.BinaryType())
def _set_bytes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingle_set(t).tobytes() for t in batch], dtype=object)


def masks(radius: int) -> np.ndarray:
    """The 2^(radius+1) - 1 covering masks over 64 bits, unsigned.

    The bits' vectors are spread evenly over the nonzero ones; for radius 6 they are those of the first-order Reed-Muller
    code. So every mask keeps about half of the bits (one of radius 6 keeps all).
    """
    if not 1 <= radius <= 6:
        raise ValueError(f"radius is 1 to 6, not {radius}")
    vectors = 2 ** (radius + 1) - 1
    phi = [64 + i if radius == 6 else i % vectors + 1 for i in range(64)]
    return np.array([sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)], dtype=np.uint64)


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each node of a bucket the place of the smallest-placed node that it reaches by links inside the bucket."""
    parent = np.arange(len(fps))
    left = np.arange(len(fps))  # not yet reached, in order
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            hit = (np.bitwise_count(fps[left][None, :] ^ fps[front[:64]][:, None]) <= radius).any(axis=0)
            found = left[hit]
            parent[found] = root
            left = left[~hit]
            front = np.concatenate([front[64:], found])
    return parent


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node that it reaches) that join what the edges (a, b) join: fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(root, root[root]):
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _link_sorted(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning edges of buckets that come one after the other (rows k, fp, own sorted by k), contracted over many buckets."""

    def edges(k: np.ndarray, fp: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        two = starts[sizes == 2]  # most buckets
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        out = [np.stack([two + 1, two], axis=1)]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            parent = forest(fp[s : s + n], radius)
            child = np.flatnonzero(parent != np.arange(n))
            out.append(np.stack([child + s, parent[child] + s], axis=1))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64)] * 3  # rows of the key that the next batch may go on with
        held, n = [], 0  # edges as rows (fp, own) of either end

        def emit() -> Iterator[pa.RecordBatch]:
            a, a_own, b, b_own = (np.concatenate(x) for x in zip(*held, strict=True))
            own, first = np.unique(np.concatenate([a, b]), return_index=True)
            name = np.concatenate([a_own, b_own])[first]
            child, root = contracted(a, b)
            cols = [child, name[np.searchsorted(own, child)], root, name[np.searchsorted(own, root)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "a_own", "b", "b_own"])

        for batch in chain(batches, [None]):
            if batch is None:
                whole = rest
            else:
                now = [np.concatenate([r, np.asarray(batch.column(c)).astype(np.int64)]) for r, c in zip(rest, ("k", "fp", "own"), strict=True)]
                last = int(np.flatnonzero(now[0] == now[0][-1])[0]) if len(now[0]) else 0
                whole, rest = [x[:last] for x in now], [x[last:] for x in now]
            if len(whole[0]):
                pairs = edges(whole[0], whole[1].view(np.uint64))
                if len(pairs):
                    held.append([x[i] for i in pairs.T for x in whole[1:]])
                    n += len(pairs)
            if held and (n > HELD or batch is None):
                yield from emit()
                held, n = [], 0

    return run


def _with_others(rows: DataFrame, total: int) -> DataFrame:
    """The rows whose key k others share, with n, how many have it. A key may hold a large part of the total rows."""
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    return meet(rows, sizes.withColumn("_n", F.col("n")), "k", "_n", total)


def near_links(nodes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, a_own, b, b_own) between distinct fingerprints within the radius; nodes: fp, own (a number to carry)."""
    spark = nodes.sparkSession
    every = [_as_long(int(m)) for m in masks(radius)]
    tables = F.array(*[F.struct(F.lit(t).cast("smallint").alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))).alias("k")) for t, m in enumerate(every)])
    spread = nodes.select("fp", "own").repartition(partitions(spark))  # one table row becomes many
    rows = spread.select("fp", "own", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp", "own")
    met = cut(_with_others(rows, len(every) * nodes.count()))
    schema = "a long, a_own long, b long, b_own long"
    linked = met.where(F.col("n") <= block).select("k", "fp", "own").repartition(partitions(spark), "k").sortWithinPartitions("k", "fp").mapInArrow(_link_sorted(radius), schema)
    # large buckets: one row for each point at most half the radius away, over the bits outside the mask
    reach = (radius + 1) // 2
    large = met.where(F.col("n") > block)
    if large.isEmpty():
        return linked.distinct()

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = {}
        for t, m in enumerate(masks(radius)):
            free = [1 << i for i in range(64) if not int(m) >> i & 1]
            flips[t] = np.array([sum(c) for n in range(reach + 1) for c in combinations(free, n)], dtype=np.uint64)
        for batch in batches:
            for t, part in batch.groupby("t"):
                step = max(1, 200_000 // len(flips[t]))
                for i in range(0, len(part), step):
                    p = part.iloc[i : i + step]
                    points = (p["fp"].to_numpy().view(np.uint64)[:, None] ^ flips[t][None, :]).ravel().view(np.int64)
                    n = len(flips[t])
                    yield pd.DataFrame({"k": np.repeat(p["k"].to_numpy(), n), "point": points, "fp": np.repeat(p["fp"].to_numpy(), n), "own": np.repeat(p["own"].to_numpy(), n)})

    points = large.select("t", "k", "fp", "own").repartition(partitions(spark)).mapInPandas(around, "k long, point long, fp long, own long")
    split = points.select(F.xxhash64("k", "point").alias("k"), "fp", "own").repartition(partitions(spark), "k").sortWithinPartitions("k", "fp")
    return linked.union(split.mapInArrow(_link_sorted(radius), schema)).distinct()


def similar_forest(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the smallest-placed one that it reaches by links of enough Jaccard similarity."""
    up, down = SIMILARITY
    sizes = np.array([len(x) for x in sets])
    parent = np.arange(len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    member = np.zeros(len(codes), dtype=bool)
    left, held = np.arange(len(sets)), codes  # not yet reached, in order, and their shingles
    while len(left) > 1:
        root, left, held = left[0], left[1:], held[sizes[left[0]] :]
        front = [root]
        while front and len(left):
            x = front.pop()
            member[own[x]] = True
            n = sizes[left]
            both = np.add.reduceat(member[held], np.cumsum(n) - n, dtype=np.int64)
            member[own[x]] = False
            hit = down * both >= up * (sizes[x] + n - both)
            if hit.any():
                parent[left[hit]] = root
                front += left[hit].tolist()
                held = held[np.repeat(~hit, n)]
                left = left[~hit]
    return parent


def _similar_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of groups that come one after the other (rows k, node, s sorted by k)."""
    key, group = None, []

    def edges() -> Iterator[pa.RecordBatch]:
        if len(group) > 1:
            parent = similar_forest([np.frombuffer(x[1], dtype=np.uint64) for x in group])
            pairs = [(group[i][0], group[j][0]) for i, j in enumerate(parent.tolist()) if i != j]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, NODE) for c in zip(*pairs, strict=True)], names=["a", "b"])

    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("k", "node", "s")), strict=True):
            if k != key:
                yield from edges()
                key, group = k, []
            group.append(row)
    yield from edges()


#: What stands for a set of shingles: its first document (id is null, id, hash of the text).
NODE = pa.struct([("k0", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64())])
NODE_SQL = "struct<k0:boolean,k1:bigint,k2:bigint>"


def similar_links(nodes: DataFrame, texts: DataFrame, group: int = GROUP) -> DataFrame:
    """Spanning links (a, b) of nodes (num, node, keys); texts has (k0, k1, k2, _text), a node being one text's first three.

    A band of up to `group` nodes is compared in one task. A larger one is first dealt twice into shares, which are
    compared each in itself: near copies grow together. Then only nodes outside the band's largest component are still
    compared with all shares of the band, so that no link is lost. Until the texts are needed nodes go by their numbers.
    """
    spark = nodes.sparkSession
    rows = nodes.select("num", F.explode("keys").alias("k"))
    met = cut(_with_others(rows, BANDS * nodes.count()))
    own = F.xxhash64("num")
    bands = met.groupBy("k").agg(F.first("n").alias("n"), F.bit_xor(own).alias("x"), F.bit_xor(F.xxhash64(own)).alias("x2"))
    once = bands.groupBy(F.col("n").alias("_n"), "x", "x2").agg(F.min("k").alias("k")).select("k", "_n")  # the same texts may meet in many bands
    met = cut(meet(met, once, "k", "_n", met.count()))
    wanted = cut(nodes.join(met.select("num").distinct(), "num").select("num", "node.*"))
    sets = texts.join(wanted, ["k0", "k1", "k2"]).groupBy("num", "k0", "k1", "k2").agg(F.first("_text").alias("_text"))
    sets = cut(sets.select("num", F.struct("k0", "k1", "k2").alias("node"), _set_bytes("_text").alias("s")))

    def links(dealt: DataFrame) -> DataFrame:
        joined = dealt.distinct().join(sets, "num").repartition(partitions(spark), "k").sortWithinPartitions("k", "node")
        return joined.mapInArrow(_similar_sorted, f"a {NODE_SQL}, b {NODE_SQL}").distinct()

    def share(of: str, seed: int) -> Column:
        """One of ceil(2 * of / group) shares of a band."""
        return F.pmod(F.xxhash64("k", "num", F.lit(seed)), F.ceil(2 * F.col(of) / group)).cast("int")

    small = met.where(F.col("n") <= group).select("k", "num")
    large = met.where(F.col("n") > group)
    if large.isEmpty():
        return links(small)
    first = cut(links(small.union(large.select(F.xxhash64("k", share("n", 0)), "num")).union(large.select(F.xxhash64("k", share("n", 1), F.lit(1)), "num"))))
    roots = cut(connected_components(first))
    placed = large.join(sets.select("num", "node"), "num").join(roots, "node", "left")
    placed = cut(placed.select("k", "n", "num", F.coalesce("root", "node").alias("root")))
    counts = placed.groupBy("k", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
    placed = placed.join(main, "k")  # a band that has grown together needs no more
    apart = placed.where("root != main").withColumn("i", share("rest", 2)).withColumn("j", F.explode(F.sequence(F.lit(0), F.ceil(2 * F.col("n") / group).cast("int") - 1)))
    every = placed.withColumn("j", share("n", 0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(2 * F.col("rest") / group).cast("int") - 1)))
    pairs = apart.select("k", "i", "j", "num").unionByName(every.select("k", "i", "j", "num"))
    return first.union(links(pairs.select(F.xxhash64("k", "i", "j").alias("k"), "num"))).distinct()


def label(rows: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """rows (_id, fp) with component_id, the smallest _id of the component. rows must be cheap to read again."""
    last = F.lit(2**63 - 1)  # stands for no id where nodes are ordered, and is an id too
    nodes = cut(rows.groupBy("fp").agg(F.min("_id").alias("id"), F.count("*").alias("n")).withColumn("own", F.coalesce("id", last)))
    end = lambda x: F.struct(F.col(f"{x}_own").alias("own"), F.col(x).alias("fp")).alias(x)
    found = connected_components(near_links(nodes, radius, block).select(end("a"), end("b")))
    rooted = cut(nodes.join(found.select(F.col("node.fp").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", F.struct("own", "fp"))))
    none = rooted.where(F.col("root.own") == last).withColumn("of", F.col("root.fp"))  # or that id
    named = none.join(none.groupBy("of").agg(F.min("id").alias("component_id")), "of")
    by_node = rooted.where(F.col("root.own") != last).select("fp", "n", F.col("root.own").alias("component_id")).unionByName(named.select("fp", "n", "component_id"))
    total = by_node.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return meet(rows, by_node, "fp", "n", total)


def near_duplicates(documents: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits, four-word shingles), component_id: one row per document."""
    small_batches(documents.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = cut(documents.select(F.col(f"`{id_col}`").alias("_id"), _shingle_fp(text).alias("fp")))
    return label(rows, radius).select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without all but one (the smallest id, then text hash) of each group of near duplicates.

    Links are similarities of five-word shingles; rows without an id are told apart by their texts and come last.
    """
    small_batches(documents.sparkSession, 200)
    text, key = text_of(text_col), row_key(id_col, text_col)
    texts = documents.select(*[v.alias(k) for k, v in key.items()], text.alias("_text"))
    rows = texts.select(F.struct(*key).alias("_id"), _banded("_text").alias("x")).select("_id", "x.*")
    nodes = rows.groupBy("fp", "fp2").agg(F.min("_id").alias("node"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("num", F.monotonically_increasing_id()))
    found = connected_components(similar_links(nodes, texts))
    stay = nodes.select("node").join(found.where("node != root"), "node", "left_anti").select("node.*")
    return only(documents, stay, key)


def drop_linked(documents: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without all but one (the smallest id, then text hash) of each component of `near_duplicates`.

    Rows without an id are told apart by their texts and come last. Texts are fingerprinted where they lie and move once, to meet the
    rows that stay.
    """
    small_batches(documents.sparkSession)
    key = row_key(id_col, text_col)
    named = documents.select(F.struct(*[v.alias(k) for k, v in key.items()]).alias("_id"), _shingle_fp(text_of(text_col)).alias("fp"))
    last = F.lit(2**63 - 1)  # stands for no id where nodes are ordered
    nodes = cut(named.groupBy("fp").agg(F.min("_id").alias("first")).withColumn("own", F.when(F.col("first.k0"), last).otherwise(F.col("first.k1"))))
    end = lambda x: F.struct(F.col(f"{x}_own").alias("own"), F.col(x).alias("fp")).alias(x)
    found = connected_components(near_links(nodes, radius).select(end("a"), end("b")))
    own = F.struct("own", "fp")
    rooted = nodes.join(found.select(F.col("node.fp").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", own))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return only(documents, stay, key)


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> dict[str, Column]:
    """What a row is told by and ordered by: whether its id is null, its id, the hash of its text."""
    return {"k0": F.col(f"`{id_col}`").isNull(), "k1": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)), "k2": F.xxhash64(text_of(text_col))}


def only(documents: DataFrame, stay: DataFrame, key: dict[str, Column]) -> DataFrame:
    """One row of documents for each row of stay (the columns of key, each once)."""
    names = {k: f"_tidemark_{k}" for k in key}
    kept = documents.withColumns({names[k]: v for k, v in key.items()}).join(stay.toDF(*names.values()), list(names.values()), "left_semi")
    first = Window.partitionBy(*names.values()).orderBy(F.lit(0))
    return kept.withColumn("_tidemark_n", F.row_number().over(first)).where("_tidemark_n = 1").drop(*names.values(), "_tidemark_n")
