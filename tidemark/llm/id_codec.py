"""Segments of token ids: an adaptive context-mixing range coder over many independent blocks at once.

A segment holds whole documents; its ids are cut into blocks of BLOCK ids, each coded from a fresh state and checksummed.
All blocks of a segment are coded in step, one id of each at a time, with numpy over the blocks; the last is filled up
with zeros, which are dropped again.

For each id the probabilities of three predictions are blended. Order 2 and order 1 put theirs on the id that last
followed the two ids and the one id before; each has a confidence that grows with its hits. Order 0 spreads its own over
all ids by the segment's frequencies, which its head holds. The weights of the blend adapt, for each combination of
confidences, to which prediction was right. Ids lie in natural order, so an id's interval is the sum of its share of order
0 and the weights of the orders that expect it, and starts after those of all lesser ids. A carryless range coder with a
64-bit window codes it in one step and puts out 32 bits at a time.

Layout, little-endian: "TMID", u8 version, u32 documents, u64 ids, u32 ids a block, u32 blocks, u32 bound of the ids, u32
bytes of the frequencies; i64 document ids; u8 nulls among these; u32 ids of each document; for each block u32 words and
u32 CRC-32 of its ids; the frequencies (deflated u8 levels, a quarter of a power of two each, 0 for none); u32 CRC-32 of
all before; the blocks' u32 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, VERSION = b"TMID", 3
BLOCK, LANES = 2048, 4096
SLOTS = 11  # bits of a context's slot
ORDER0 = 18  # bits of order 0's total
BLEND = 8  # bits of the weights' total
TOTAL = ORDER0 + BLEND
RATE = 5  # a weight moves by 1/32 of its distance
ONE, BOTH = (1 << 15 - RATE) - 1, ((1 << 15 - RATE) - 1) * 0x8001
CONFIDENCE, HALVES = np.array([[8], [2]], dtype=np.int32), np.array([[15], [0]], dtype=np.int32)
STEPS = 32  # that are coded together
HEAD = struct.Struct("<4sBIQIIII")
WORD, LOW = np.uint64(32), np.uint64((1 << 32) - 1)
BITS, MOST = np.uint64(TOTAL), np.uint64((1 << TOTAL) - 1)


class _Model:
    """The predictions' state for n blocks, in step. sizes: each id's share of order 0.

    Arrays of two rows hold order 2 first, then order 1, so that one call of numpy does both. Tables go by slot, then block, so
    that what many blocks use lies together in the processor's cache.
    """

    def __init__(self, n: int, sizes: np.ndarray) -> None:
        self.sizes = sizes.astype(np.int32)
        self.starts = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.inverse = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.next = np.zeros(2 * n << SLOTS, dtype=np.int32)  # 4 * id + confidence
        self.n, self.lane = np.int32(n), np.arange(n)
        self.row = np.stack([self.lane, self.lane + (n << SLOTS)])
        # weights of orders 2 and 1, 15 bits each; order 0 has the rest
        self.weights = np.repeat(np.array([6 * (i >> 3) + 2 << 25 | 3 * (i >> 1 & 3) + 1 << 10 for i in range(32)], dtype=np.int32), n)
        self.before = np.zeros((2, n), dtype=np.int32)  # the two ids before

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where what followed a, and b and a, is kept."""
        h, at = a * 25033, np.empty((*a.shape[:-1], 2, a.shape[-1]), dtype=np.int32)
        np.bitwise_xor(h, b * 31153, out=at[..., 0, :])
        np.right_shift(h, 1, out=at[..., 1, :])
        at >>= 4
        at &= (1 << SLOTS) - 1
        at *= self.n
        return self.row + at

    def situation(self, e: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the weights are kept for the expected ids with these confidences."""
        c = (e & 3) * CONFIDENCE
        return self.lane + (c[..., 0, :] + c[..., 1, :] + (ids[..., 0, :] == ids[..., 1, :])) * self.n

    @staticmethod
    def learnt(e: np.ndarray, hit: np.ndarray, new: np.ndarray) -> np.ndarray:
        """A confidence grows by 1, up to 3, or falls by 2; an id with less than 2 gives place to the new one."""
        c, right = e & 3, hit.view(np.int8)
        return np.where(hit | (c > 1), e + ((hit & (c < 3)).view(np.int8) + (right + right - 2)), new)

    @staticmethod
    def won(hit: np.ndarray) -> np.ndarray:
        return np.where(hit[..., 0, :], np.int32(ONE << 15), hit[..., 1, :] * np.int32(ONE))

    @staticmethod
    def shares(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of orders 2 and 1, at most 251 of the 256 parts, and of order 0."""
        both = (w[..., None, :] >> HALVES & 0x7FFF) * 251 >> 15
        return both << ORDER0, (1 << BLEND) - both[..., 0, :] - both[..., 1, :]

    def interval(self, x: np.ndarray, ids: np.ndarray, hit: np.ndarray, both: np.ndarray, w0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        less, own = both * (ids < x[..., None, :]), both * hit
        start = w0 * self.starts.take(x) + less[..., 0, :] + less[..., 1, :]
        return start.astype(np.uint64), (w0 * self.sizes.take(x) + own[..., 0, :] + own[..., 1, :]).astype(np.uint64)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of some steps' ids, which are known: only the tables go step by step."""
        all_ids = np.concatenate([self.before, x])
        self.before = all_ids[-2:]
        at, new = self.slots(all_ids[1:-1], all_ids[:-2]), x << 2
        e, hit = np.empty(at.shape, dtype=np.int32), np.empty(at.shape, dtype=bool)
        for t in range(len(x)):
            e[t] = now = self.next.take(at[t])
            hit[t] = own = now ^ new[t] < 4
            self.next[at[t]] = self.learnt(now, own, new[t])
        ids = e >> 2
        at, won, w = self.situation(e, ids), self.won(hit), np.empty(x.shape, dtype=np.int32)
        for t in range(len(x)):
            w[t] = now = self.weights.take(at[t])
            self.weights[at[t]] = now - (now >> RATE & BOTH) + won[t]
        return self.interval(x, ids, hit, *self.shares(w))

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids in whose intervals the values lie, and these intervals; learns from them."""
        at = self.slots(self.before[1], self.before[0])
        e = self.next.take(at)
        ids = e >> 2
        at_w = self.situation(e, ids)
        w = self.weights.take(at_w)
        both, w0 = self.shares(w)
        # beyond an expected id's start in order 0, as much as its weight is not order 0's
        low = w0 * self.starts.take(ids)
        lesser = ids[1] < ids[0]
        low[0] += both[1] * lesser
        low[1] += both[0] * ~lesser
        between = np.minimum(np.maximum(value - low, 0), both)
        x = self.inverse.take((value - between[0] - between[1]) // w0, mode="clip")
        hit = ids == x
        self.next[at] = self.learnt(e, hit, x << 2)
        self.weights[at_w] = w - (w >> RATE & BOTH) + self.won(hit)
        self.before = self.before[1], x
        return x, *self.interval(x, ids, hit, both, w0)


# four levels to a power of two
LEVELS = np.array([431, 256, 304, 362], dtype=np.int64)


def frequencies(ids: np.ndarray, limit: int) -> np.ndarray:
    """The ids' levels: 0 for none, else 1 and four for each doubling of their count."""
    counts = np.bincount(ids, minlength=limit)
    return np.where(counts, np.rint(4 * np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0).astype(np.uint8)


def sizes_of(levels: np.ndarray) -> np.ndarray:
    """Each id's share of order 0; all together are 2^ORDER0."""
    level = levels.astype(np.int64)
    share = np.where(level > 0, LEVELS[level & 3] << np.maximum(level - 1, 0) // 4, 0)
    size = share * ((1 << ORDER0) - int((level > 0).sum())) // max(int(share.sum()), 1) + (level > 0)
    size[int(share.argmax())] += (1 << ORDER0) - int(size.sum())
    return size


class _Coder:
    """low and range of n range coders; `words` are what to decode, else words are gathered."""

    def __init__(self, n: int, words: list[np.ndarray] | None = None) -> None:
        self.low, self.range = np.zeros(n, dtype=np.uint64), np.full(n, (1 << 64) - 1, dtype=np.uint64)
        self.code = None
        self.wide = 512 if words is None else max(map(len, words)) + 2
        self.words = np.zeros((n, self.wide), dtype=np.uint32)
        self.at = np.arange(n) * self.wide  # of the next word, in all words
        if words is not None:
            for i, w in enumerate(words):
                self.words[i, : len(w)] = w
            first = self.words[:, :2].astype(np.uint64)
            self.code = first[:, 0] << WORD | first[:, 1]
            self.at += 2
        self.flat = self.words.reshape(-1)

    def put(self) -> np.ndarray:
        """How many words each has put out."""
        return self.at - np.arange(len(self.words)) * self.wide

    def room(self) -> None:
        """Makes place for the words of some more steps."""
        if self.put().max() + 2 * STEPS > self.wide:
            self.at += np.arange(len(self.words)) * self.wide
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.wide *= 2
            self.flat = self.words.reshape(-1)

    def value(self) -> np.ndarray:
        """Where in [0, 2^TOTAL) each code lies."""
        return np.minimum((self.code - self.low) // (self.range >> BITS), MOST).view(np.int64).astype(np.int32)

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        part = self.range >> BITS
        self.low += part * start
        self.range = part * size
        lanes = np.flatnonzero(self.range <= LOW)
        if not len(lanes):
            return
        low, span, at = self.low.take(lanes), self.range.take(lanes), self.at.take(lanes)
        rest = low & LOW
        # where the top words of low and of the range's end differ the range is cut to low's top word
        self.range[lanes] = np.minimum(span, LOW + np.uint64(1) - rest) << WORD
        self.low[lanes] = rest << WORD
        self.at[lanes] = at + 1
        if self.code is None:
            self.flat[at] = low >> WORD
        else:
            self.code[lanes] = self.code.take(lanes) << WORD | self.flat.take(at, mode="clip")

    def finish(self) -> list[bytes]:
        self.room()
        for word in (self.low >> WORD, self.low & LOW):
            self.flat[self.at] = word
            self.at += 1
        return [self.words[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.put())]


def _encode_lanes(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    model, coder = _Model(len(ids), sizes), _Coder(len(ids))
    steps = np.ascontiguousarray(ids.T)
    for i in range(0, len(steps), STEPS):
        coder.room()  # a step puts out a word at most
        for start, size in zip(*model.intervals(steps[i : i + STEPS]), strict=True):
            coder.narrow(start, size)
    return coder.finish()


def _decode_lanes(words: list[np.ndarray], width: int, sizes: np.ndarray) -> np.ndarray:
    model, coder = _Model(len(words), sizes), _Coder(len(words), words)
    out = np.zeros((width, len(words)), dtype=np.int32)
    for t in range(width):
        out[t], start, size = model.find(coder.value())
        coder.narrow(start, size)
    return out.T


def encode_segment(doc_ids: list[int | None], doc_lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The segment's bytes. ids: of all documents, below 65536."""
    limit = int(ids.max()) + 1 if len(ids) else 1
    if limit > 1 << 16:
        raise ValueError("a segment holds ids below 65536")
    levels = frequencies(ids, limit)
    if len(ids) and not levels[0]:
        levels[0] = 1  # the last block may be filled up
    sizes = sizes_of(levels)
    width = min(block, len(ids))
    parts: list[bytes] = []
    for i in range(0, len(ids), max(width, 1) * LANES):
        own = ids[i : i + width * LANES]
        lanes = np.zeros((-(-len(own) // width), width), dtype=np.int32)
        lanes.reshape(-1)[: len(own)] = own
        parts += _encode_lanes(lanes, sizes)
    sums = [zlib.crc32(np.ascontiguousarray(ids[i : i + block], dtype="<u4").tobytes()) for i in range(0, len(ids), block)]
    held = zlib.compress(levels.tobytes())
    head = HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), block, len(parts), limit, len(held))
    head += np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype="u1").tobytes()
    head += np.array(doc_lengths, dtype="<u4").tobytes() + np.array([[len(p) // 4, s] for p, s in zip(parts, sums, strict=True)], dtype="<u4").tobytes() + held
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *parts])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids); raises ValueError where a checksum or the layout is wrong."""
    magic, version, n_docs, n_ids, block, n_blocks, limit, n_held = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("no token-id segment")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, "u1", n_docs, at := at + 8 * n_docs)
    doc_lengths = np.frombuffer(data, "<u4", n_docs, at := at + n_docs).astype(np.int64)
    blocks = np.frombuffer(data, "<u4", 2 * n_blocks, at := at + 4 * n_docs).reshape(-1, 2)
    at += 8 * n_blocks + n_held
    if at + 4 > len(data) or struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError("the segment's head fails its checksum")
    sizes = sizes_of(np.frombuffer(zlib.decompress(data[at - n_held : at]), np.uint8))
    at += 4
    starts = at + 4 * np.concatenate([[0], np.cumsum(blocks[:, 0].astype(np.int64))])
    ids = np.empty(n_ids, dtype="<u4")
    width = min(block, n_ids)
    for i in range(0, n_blocks, LANES):
        words = [np.frombuffer(data, "<u4", int(blocks[j, 0]), int(starts[j])) for j in range(i, min(i + LANES, n_blocks))]
        part = ids[i * width : (i + len(words)) * width]
        part[:] = _decode_lanes(words, width, sizes).reshape(-1)[: len(part)]
    for j in range(n_blocks):
        if zlib.crc32(ids[j * block : (j + 1) * block].tobytes()) != blocks[j, 1]:
            raise ValueError(f"block {j} fails its checksum")
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], doc_lengths, ids


def segments(documents: Iterator[tuple[int | None, bytes]], size: int = BLOCK * LANES) -> Iterator[tuple[list, list[int], np.ndarray]]:
    """Whole documents (id, ids as bytes) gathered until they hold `size` ids."""
    docs, lengths, parts, n = [], [], [], 0
    for doc, data in documents:
        docs.append(doc)
        lengths.append(len(data) // 4)
        parts.append(data)
        n += len(data) // 4
        if n >= size:
            yield docs, lengths, np.frombuffer(b"".join(parts), "<u4")
            docs, lengths, parts, n = [], [], [], 0
    if docs:
        yield docs, lengths, np.frombuffer(b"".join(parts), "<u4")
