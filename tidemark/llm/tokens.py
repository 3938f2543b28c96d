"""Token ids of whole texts by the tokenizers library, with a memory of words already met.

The tokenizer of word_bpe_49k.json lower-cases, cuts at white space and then into pieces (runs of letters, single digits,
runs of other signs, English endings), and codes each piece by itself; a piece's last token ends in ``</w>``. So a text's
ids are those of its white-space-separated parts, and a part's those of its pieces. Arrow finds the different parts of
many texts and the different pieces of these; each worker process numbers the pieces that it has met and keeps their ids in
one array, and asks the library for new ones in batches. Parts with characters beyond U+024F, where normal forms and cases
get intricate, go to it whole.

The memory is bounded: where it gets too large, the pieces met last stay. So pieces that keep coming stay, and what came
once goes.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Pieces that stay where a process's memory, at twice as many, is full; and characters of a piece that it has room for on average.
HELD, LONG = 500_000, 32
#: Characters of texts that are cut at once; a longer text is cut by itself.
AT_ONCE = 8_000_000
#: The letters and numbers among lower-case forms of characters up to U+024F.
LETTERS, NUMBERS = "a-zªµºß-öø-ʯⱥⱦ", "0-9²³¹¼½¾"
#: How the vocabulary's file cuts pieces (fixed).
PIECE = rf"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+)"
PLAIN = "^[!-įı-ɏ]*$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the vocabulary writes each byte: those that are no printable Latin-1 signs have signs from U+0100 on. Spaces stay, to cut at.
OTHERS = [*range(33), *range(127, 161), 173]
SIGNS = "".join(chr(256 + OTHERS.index(b) if b in OTHERS and b != 32 else b) for b in range(256))


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pool's runs from starts, one after another."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(n, dtype=kind)
    return pool.take(at)


class Encoder:
    """Gives texts' ids as bytes. For tokenizers that cut as said above."""

    def __init__(self, path: str, held: int | None = None, at_once: int | None = None) -> None:
        self.held, self.at_once = held or HELD, at_once or AT_ONCE
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        # the same model for pieces that are cut, lower-cased and written as the vocabulary writes bytes already
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # the pieces met, by number: where each one's ids lie in the pool, how many they are, and in which lot it was met last
        self.met: dict[str, int] = {}
        self.starts, self.lengths, self.last = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.pool = np.empty(0, dtype="<u4")
        self.size = self.lots = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _coded(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some pieces after another, one after another, and how many each has."""
        for i in range(0, len(pieces), 500):
            some = pieces[i : i + 500]
            written, _ = codecs.charmap_decode(" ".join(some).encode(), "strict", SIGNS)
            ids = np.array(self.model.encode_batch_fast([written], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                yield ids, np.diff(ends, prepend=0)
            else:
                yield from ((own, np.array([len(own)])) for own in map(self._whole, some))

    def _learn(self, new: list[str]) -> np.ndarray:
        """Adds the ids of different new pieces (or whole parts); returns the pieces' numbers."""
        names = pa.array(new, pa.string())
        plain = pc.and_not(pc.match_substring_regex(names, PLAIN), pc.match_substring(names, "<|"))
        plain = pc.and_(plain, pc.not_equal(names, "")).to_numpy(zero_copy_only=False)
        easy, odd = (names.filter(pa.array(own)).to_numpy(zero_copy_only=False).tolist() for own in (plain, ~plain))
        found = [*self._coded(easy), *((own, np.array([len(own)])) for own in map(self._whole, odd))]
        lengths, known = np.concatenate([k for _, k in found]), len(self.met)
        number = np.empty(len(new), dtype=np.int64)
        number[plain], number[~plain] = known + np.arange(len(easy)), known + len(easy) + np.arange(len(odd))
        self.met.update(zip([*easy, *odd], range(known, known + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.last = np.concatenate([self.last, np.zeros(len(new), dtype=np.int64)])
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in found)])
        self.size += sum(map(len, new))
        return number

    def _forget(self) -> None:
        """Keeps the pieces met last, `held` of them at most."""
        names = list(self.met)
        order = np.argsort(-self.last, kind="stable")[: self.held]
        sizes = np.cumsum([len(names[i]) for i in order.tolist()])
        keep = order[: np.searchsorted(sizes, LONG * self.held, side="right")]
        self.size = int(sizes[len(keep) - 1]) if len(keep) else 0
        self.met = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.pool = _gathered(self.pool, self.starts[keep], self.lengths[keep])
        self.lengths, self.last = self.lengths[keep], self.last[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        """The numbers of different pieces (or of whole parts)."""
        if len(self.met) > 2 * self.held or self.size > 2 * LONG * self.held:
            self._forget()
        code = np.array(list(map(self.met.get, pieces, repeat(-1))), dtype=np.int64)
        new = np.flatnonzero(code < 0)
        if len(new):
            code[new] = self._learn([pieces[i] for i in new.tolist()])
        self.lots += 1
        self.last[code] = self.lots
        return code

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts one after another, and how many each has."""
        plain = pc.and_not(pc.match_substring_regex(parts, PLAIN), pc.match_substring(parts, "<|"))
        lower = pc.utf8_lower(parts)
        mixed = pc.invert(pc.match_substring_regex(lower, f"^[{LETTERS}]+$"))  # the others are one piece
        rest = lower.filter(mixed)
        # most are a word and a sign, which need no regular expression to be cut
        signed = pc.match_substring_regex(rest, f"^[{LETTERS}]+[.,]$")
        short = pc.replace_substring(pc.replace_substring(rest.filter(signed), ".", " ."), ",", " ,")
        rest = pc.replace_with_mask(rest, signed, short)
        intricate = pc.invert(signed)
        rest = pc.replace_with_mask(rest, intricate, pc.replace_substring_regex(rest.filter(intricate), PIECE, "\\1 "))
        cut = pc.replace_with_mask(lower, mixed, rest)
        cut = pc.split_pattern(pc.if_else(plain, pc.ascii_rtrim(cut, " "), parts), " ")
        coded = cut.flatten().dictionary_encode()
        code = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        each = self.lengths[code]
        return _gathered(self.pool, self.starts[code], each), np.add.reduceat(each, cut.offsets.to_numpy()[:-1])

    def _encode_some(self, texts: list[str]) -> Iterator[bytes]:
        parts = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = parts.flatten().dictionary_encode()
        if not len(coded):
            yield from [b""] * len(texts)
            return
        ids, lengths = self._parts(coded.dictionary)
        code = coded.indices.to_numpy()
        each = lengths[code]
        data = _gathered(ids, (np.cumsum(lengths) - lengths)[code], each).tobytes()
        ends = np.concatenate([[0], np.cumsum(each)])[parts.offsets.to_numpy()] * 4
        yield from (data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; new words of several texts are learnt at once."""
        some, size = [], 0
        for text in texts:
            # \x1c-\x1f are white space to str.split but not to the tokenizer
            if text and any(c in text for c in "\x1c\x1d\x1e\x1f"):
                yield from self._encode_some(some)
                some, size = [], 0
                yield self._whole(text).tobytes()
                continue
            some.append(text or "")
            size += len(some[-1]) + 8  # empty texts take room too
            if size >= self.at_once:
                yield from self._encode_some(some)
                some, size = [], 0
        yield from self._encode_some(some)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@cache
def encoder(path: str, held: int | None = None, at_once: int | None = None) -> Encoder:
    """The encoder of this process, by its bounds."""
    return Encoder(path, held, at_once)
