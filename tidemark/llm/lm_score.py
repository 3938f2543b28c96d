"""LM scoring by cross-entropy difference.

Two word bigram models, matched in order, smoothing and vocabulary: one of the target texts, one of all texts. A token's
loss is -log((c(v w) + DELTA) / (c(v) + DELTA * V)), V being the number of distinct words of all texts and c the counts without
the text that is scored (so a target text is not judged by itself); a text's score is the mean over its tokens (its words
and its end) of target loss minus background loss, so lower means nearer to the target.

The loss is a sum of one term per bigram and one per context, so both kinds of n-gram meet the texts that hold them in
one shuffle on the n-gram. Tasks gather the n-grams of a chunk of texts, sort them and cut them into ranges of their hash,
BUCKETS for each shuffle partition; a row holds one range of one chunk as packed arrays (56 bits of the hash, place of the
text in the chunk, count). After the shuffle a task takes one range at a time, sums the counts of each n-gram and gives
each text its terms. n-grams that a sample finds common (more than HEAVY / partitions of all tokens; which ones are chosen
changes no score) stay out of this: their counts, at most 2 * partitions / HEAVY rows, are summed in a pass of their own and
broadcast, and each task adds their terms itself. Everything else counted grows with the corpus: all n-grams of all
texts, no cut-offs.

Defined results: a null or empty text has one token, its end. Every row is a text of its own and gives one row, also where
rows share a doc_id or have none. Texts whose id the target lacks are background only; with no target at all the target model is uniform.
An empty table gives an empty result; other columns are ignored. Long texts are whole rows of one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, small_batches

DELTA = 0.05
#: A chunk ends once it has so many tokens.
CHUNK = 700_000
#: Hash ranges for each shuffle partition; a task holds one range at a time.
BUCKETS = 4
HEAVY = 0.1
SAMPLE = 1000
#: Target ids up to so many are broadcast; more meet the texts in a shuffled join.
BROADCAST_IDS = 2_000_000
START, END = xxhash.xxh64_intdigest(b"<s>", 7), xxhash.xxh64_intdigest(b"</s>", 7)
#: One word hash in so many is counted for the vocabulary's size: every one, nothing is sampled.
VOCABULARY_SHARE = 1
#: Stands for a null id inside packed rows.
NO_ID = np.iinfo(np.int64).min
#: A text's row, losses, tokens and id in packed rows.
SUMS = ("<i8", "<f8", "<f8", "<i8", "<i8")
MEMORY = 200_000
_words: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the start, the text's lower-cased words and the end."""
    words = (text or "").lower().split()
    try:
        middle = [*map(_words.__getitem__, words)]
    except KeyError:
        if len(_words) > MEMORY:
            _words.clear()
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
        middle = [*map(_words.__getitem__, words)]
    return np.array([START, *middle, END], dtype=np.uint64)


def grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bigrams (even) and of their contexts (odd), 56 bits each."""
    v, w = h[:-1], h[1:]
    x = (v ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(8)) & ~np.uint64(1)).view(np.int64), ((v >> np.uint64(8)) | np.uint64(1)).view(np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, list[np.ndarray]]]:
    """(rows, ids, is target, word hashes per text) of texts with about CHUNK tokens together."""
    rows: list = []
    ids: list = []
    target: list = []
    hashes: list[np.ndarray] = []
    n = 0
    for batch in batches:
        for row, flag, text, doc in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            rows.append(row)
            ids.append(doc)
            target.append(flag)
            hashes.append(h := word_hashes(text))
            n += len(h)
            if n >= CHUNK:
                yield rows, ids, np.array(target, dtype=bool), hashes
                rows, ids, target, hashes, n = [], [], [], [], 0
    if rows:
        yield rows, ids, np.array(target, dtype=bool), hashes


def _keys(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of a chunk, and the place of the text that each is from."""
    pairs = [grams(h) for h in hashes]
    sizes = np.array([len(a) for a, _ in pairs])
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return np.concatenate([*(a for a, _ in pairs), *(b for _, b in pairs)]), np.concatenate([at, at])


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def losses(own: np.ndarray, n_all: np.ndarray, n_target: np.ndarray, target: np.ndarray, context: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """What `own` occurrences of an n-gram add to a text's target and background loss."""
    base = np.where(context, DELTA * size, DELTA)
    sign = np.where(context, own, -own)
    return sign * np.log(n_target - np.where(target, own, 0) + base), sign * np.log(n_all - own + base)


def score(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (per token), score (their difference). target_ids has column id_col."""
    spark = documents.sparkSession
    small_batches(spark, 200)
    ids = target_ids.select(F.col(f"`{id_col}`").cast("long").alias("_t")).where("_t is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    plain = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    rows = plain.join(ids, F.col("_id") == F.col("_t"), "left").select("_row", F.col("_t").isNotNull().alias("_target"), "_text", "_id")
    n = partitions(spark)
    heavy = spark.sparkContext.broadcast(_common(rows, HEAVY / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the common n-grams, and the words of each chunk (kind 2)."""
        every, targets = np.zeros(len(heavy.value), dtype=np.int64), np.zeros(len(heavy.value), dtype=np.int64)
        for _, _, target, hashes in chunks(batches):
            keys, at = _keys(hashes)
            place, hit = _in(heavy.value, keys)
            every += np.bincount(place[hit], minlength=len(every))
            targets += np.bincount(place[hit & target[at]], minlength=len(every))
            words = np.unique(np.concatenate(hashes)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words, np.full(len(words), 2), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64))], names=["key", "kind", "n_all", "n_target"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (heavy.value, np.ones(len(every), dtype=np.int64), every, targets)], names=["key", "kind", "n_all", "n_target"])

    counted = rows.mapInArrow(count, "key long, kind long, n_all long, n_target long").groupBy("kind", "key").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))
    # one row for all words, one for each common n-gram
    folded = counted.groupBy("kind", F.when(F.col("kind") == 1, F.col("key")).alias("key")).agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"), F.count("*").alias("n")).collect()
    size = float(max([1, *(r.n for r in folded if r.kind == 2)]))
    known = sorted((r.key, r.n_all, r.n_target) for r in folded if r.kind == 1)
    held = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64) for x in zip(*known, strict=True)) if known else (np.empty(0, dtype=np.int64),) * 3)

    bounds = np.array([(i << 56) // (BUCKETS * n) for i in range(BUCKETS * n)], dtype=np.int64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare n-grams by hash range, packed; for each text the terms of its common n-grams."""
        common, n_all, n_target = held.value
        for docs, names, target, hashes in chunks(batches):
            keys, at = _keys(hashes)
            order = np.argsort(keys, kind="stable")  # texts stay in order within a key
            keys, at = keys[order], at[order]
            first = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(at, prepend=-1) != 0))
            own = np.diff(np.append(first, len(keys)))
            keys, at = keys[first], at[first]  # one row per n-gram and text
            place, hit = _in(common, keys)
            p, q = place[hit], at[hit]
            loss_t, loss_b = losses(own[hit], n_all[p], n_target[p], target[q], (keys[hit] & 1).astype(bool), size) if len(p) else (np.empty(0),) * 2
            n = len(docs)
            keys, at, own = keys[~hit], at[~hit], np.where(target[at], -own, own)[~hit]
            cuts = np.searchsorted(keys, bounds)
            own_type = np.dtype("<i2" if len(own) == 0 or np.abs(own).max() < 1 << 15 else "<i4")
            own = own.astype(own_type)
            ids = np.array(docs, dtype="<i8")
            packed: list[tuple] = []
            for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
                if hi > lo:
                    mine, back = np.unique(at[lo:hi], return_inverse=True)
                    back = back.astype("<u2" if len(mine) < 1 << 16 else "<u4")
                    steps = np.diff(keys[lo:hi], prepend=bounds[i])  # the range is sorted: steps are short
                    planes = steps.astype("<u4"), (steps >> 32).astype("u1"), (steps >> 40).astype("<u2")
                    packed.append((i, ids[mine].tobytes(), *(x.tobytes() for x in (*planes, back, own[lo:hi]))))
                    if len(packed) == 100:
                        yield _rows(packed)
                        packed = []
            # what the common n-grams add, and the tokens, of each text
            some = np.bincount(q, loss_t, n), np.bincount(q, loss_b, n), np.array([len(h) - 1 for h in hashes], dtype=np.int64)
            named = np.array([NO_ID if d is None else d for d in names], dtype="<i8")
            packed.append((xxhash.xxh32_intdigest(ids.tobytes()) % len(bounds), ids.tobytes(), *(x.tobytes() for x in some), named.tobytes(), b""))
            yield _rows(packed)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the ranges that come one after the other; gives texts their terms."""
        held_rows: list[tuple] = []
        kept = _Sums(n)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if held_rows and held_rows[0][0] != row[0]:
                    yield from kept.add(_terms(held_rows, bounds, size))
                    held_rows = []
                if row[6]:
                    held_rows.append(row)
                else:
                    yield from kept.add(tuple(np.frombuffer(x, t) for x, t in zip(row[1:6], SUMS, strict=True)))
        if held_rows:
            yield from kept.add(_terms(held_rows, bounds, size))
        yield from kept.flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up what the tasks had for the texts of one share."""
        parts = [tuple(np.frombuffer(x, t) for x, t in zip(row, SUMS, strict=True)) for b in batches for row in zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True)]
        if parts:
            _, lt, lb, tokens, docs = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NO_ID), pa.array(lt), pa.array(lb), pa.array(tokens)], names=["_id", "lt", "lb", "n_tokens"])

    met = rows.mapInArrow(gather, "bucket int, docs binary, a binary, b binary, c binary, d binary, e binary")
    dealt = met.repartition(n, "bucket").sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(take, "share int, docs binary, lt binary, lb binary, tokens binary, names binary")
    per_doc = sums.repartition(n, "share").mapInArrow(total, "_id long, lt double, lb double, n_tokens long")
    mean = lambda c: F.round(F.col(c) / F.col("n_tokens"), 9)
    return per_doc.select(F.col("_id").alias(id_col), "n_tokens", mean("lt").alias("target_loss"), mean("lb").alias("background_loss"), F.round((F.col("lt") - F.col("lb")) / F.col("n_tokens"), 9).alias("score"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "docs", *"abcde"])


def _added(parts: list[tuple]) -> tuple:
    """(rows, target loss, background loss, tokens, ids) with one place for each text; one of its parts has tokens and id."""
    docs, lt, lb, tokens, names = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, back = np.unique(docs, return_inverse=True)
    named = np.zeros(len(ids), dtype=np.int64)
    named[back[tokens > 0]] = names[tokens > 0]
    return ids, np.bincount(back, lt), np.bincount(back, lb), np.bincount(back, tokens).astype(np.int64), named


class _Sums:
    """A task's sums by text, added up before they are sent, one packed row for each share of the texts."""

    def __init__(self, shares: int, most: int = 1_000_000) -> None:
        self.shares, self.most, self.parts, self.size = shares, most, [], 0

    def add(self, part: tuple) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.most:
            self.parts = [_added(self.parts)]
            self.size = len(self.parts[0][0])
            if 2 * self.size > self.most:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = _added(self.parts)
            share = ((columns[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.shares
            order = np.argsort(share, kind="stable")
            share, columns = share[order], [c[order] for c in columns]
            starts = np.flatnonzero(np.diff(share, prepend=-1) != 0)
            ends = np.append(starts[1:], len(share))
            packed = [pa.array([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(share[starts], pa.int32()), *packed], names=["share", "docs", "lt", "lb", "tokens", "names"])
        self.parts, self.size = [], 0


def _terms(rows: list[tuple], bounds: np.ndarray, size: float) -> tuple:
    """Each text's terms of one range's n-grams, summed by text."""
    keys, docs, own = [], [], []
    for i, known, low, mid, high, at, n in rows:
        m = len(mid)
        steps = np.frombuffer(low, "<u4").astype(np.int64) | np.frombuffer(mid, "u1").astype(np.int64) << 32 | np.frombuffer(high, "<u2").astype(np.int64) << 40
        keys.append(bounds[i] + np.cumsum(steps))
        docs.append(np.frombuffer(known, "<i8")[np.frombuffer(at, "<u2" if len(at) == 2 * m else "<u4")])
        own.append(np.frombuffer(n, "<i2" if len(n) == 2 * m else "<i4").astype(np.int32))
    key, doc, own_ = map(np.concatenate, (keys, docs, own))
    order = np.argsort(key, kind="stable")
    key, doc, own_ = key[order], doc[order], own_[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    sizes = np.diff(np.append(starts, len(key)))
    every, target = np.abs(own_), own_ < 0
    n_all, n_target = (np.repeat(np.add.reduceat(x, starts, dtype=np.int64), sizes) for x in (every, np.where(target, every, 0)))
    lt, lb = losses(every, n_all, n_target, target, (key & 1).astype(bool), size)
    ids, back = np.unique(doc, return_inverse=True)
    return ids, np.bincount(back, lt), np.bincount(back, lb), np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)


def _common(rows: DataFrame, share: float) -> np.ndarray:
    """Sorted keys that hold over half of `share` of a bounded sample's n-grams of their kind; 4 / share keys at most."""
    near = rows.select(F.xxhash64("_row", F.lit("sample")).alias("k"), "_text")
    total = rows.count()
    bar = int(min(1.0, (SAMPLE + 50) / max(1, total)) * 2.0**64) - 2**63
    seen = near.where(F.col("k") <= F.lit(min(bar, 2**63 - 1))).orderBy("k").limit(SAMPLE).select("_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of n-grams, and under no key how many bigrams there are."""
        found: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                a, b = grams(word_hashes(text))
                found.update(a.tolist())
                found.update(b.tolist())
                n += len(a)
        yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.int64()), pa.array([n, *found.values()], pa.int64())], names=["key", "n"])

    counts = seen.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("key").isNotNull(), F.desc("n")).limit(int(4 / share) + 2).collect()
    n = sum(r.n for r in top if r.key is None)
    return np.array(sorted(r.key for r in top if r.key is not None and r.n >= max(3.0, share / 2 * n)), dtype=np.int64)


def brute_force(texts: dict[int, str], target: set[int], size: float) -> dict[int, tuple[int, float, float]]:
    """For tests: n_tokens, target and background loss of each text, in plain Python."""
    models: list[Counter] = [Counter(), Counter()]
    words = {d: ["<s>", *t.lower().split(), "</s>"] for d, t in texts.items()}
    for d, w in words.items():
        for m in [0] * (d in target) + [1]:
            models[m].update(zip(w, w[1:], strict=False))
            models[m].update(w[:-1])
    out = {}
    for d, w in words.items():
        own = Counter(zip(w, w[1:], strict=False)) + Counter(w[:-1])
        loss = []
        for m, held in ((0, d in target), (1, True)):
            left = lambda g, m=m, held=held: models[m][g] - held * own[g]
            loss.append(sum(math.log(left(v) + DELTA * size) - math.log(left((v, x)) + DELTA) for v, x in zip(w, w[1:], strict=False)))
        out[d] = (len(w) - 1, loss[0] / (len(w) - 1), loss[1] / (len(w) - 1))
    return out
