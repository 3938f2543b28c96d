"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. The votes' pattern counts over the whole corpus
(at most 3^labellers rows) go through expectation-maximisation, which estimates how each labeller votes on
either class, so its accuracy, and each pattern's posterior. On a sample of at most SAMPLE texts (the smallest hashes of doc_id and text) these posteriors train
a linear scorer over hashed features: word shapes and binned shares of the text. The scorer then judges every text.

The weights are FEATURES floats and the pattern table is bounded by the labellers, so both may be broadcast. Texts are
never shuffled.

Defined results: a null or empty text has no votes and no features but the bias, and is rejected as empty (keep false,
score 0). Repeated rows are scored each for itself; rows with a null doc_id are scored and sampled like any other; other
columns are kept by `with_quality`. An empty table gives an empty result. The same texts give the same model.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

FEATURES = 1 << 14
SAMPLE = 6000
ROUNDS = 60
EPOCHS = 8
THRESHOLD = 0.3
#: Function words of the corpus' four languages.
STOP = frozenset(
    "the of and to in is that it was for on as with be by this are or an at from not a "
    "der die das und ist nicht zu den von mit für auf im ein eine des dem sich auch "
    "le la les de et en un une est que qui dans pour sur pas au du par avec "
    "el los las y es por para con una del se no lo su al como".split()
)
ODD = re.compile(r"[#%&*$@^~|<>{}\[\]\\=_+`]")
ENDS = re.compile(r"[.!?…][\"')\]]*(?=\s|\Z)")
LABELLERS = ("odd_signs", "capitals", "bars", "shouting", "runs", "top_word", "few_words", "stop_words", "sentences", "word_length", "same_lines")


class _Kinds(dict):
    """By code point: a for a letter, A for a capital, 0 for a digit, else the sign itself."""

    def __missing__(self, at: int) -> str:
        c = chr(at)
        self[at] = "0" if c.isdecimal() else c if not c.isalnum() else "A" if c.isupper() else "a"
        return self[at]


_kinds = _Kinds()
#: Words that were met: the bare word, whether it is all capitals, the slot of its shape.
_known: dict[str, tuple[str, bool, int]] = {}
_slots: dict[str, int] = {}


def _word(word: str) -> tuple[str, bool, int]:
    looks = shape(word)
    if (at := _slots.get(looks)) is None:
        at = _slots[looks] = _slot("shape " + looks)
    _known[word] = made = (word.strip(".,;:!?\"'()").lower(), len(word) > 1 and word.isupper(), at)
    return made


def measured(text: str) -> tuple[dict[str, float] | None, dict[int, int]]:
    """What labellers and features go by (None for a text without words), and how many words have each shape, by its slot."""
    words = text.split()
    if not words:
        return None, {}
    if len(_known) > 200_000:
        _known.clear()
    if len(_slots) > 200_000:
        _slots.clear()
    n, counts = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    bare: dict[str, int] = {}
    shapes: dict[int, int] = {}
    upper, known = 0, _known.get
    for w, c in counts.items():
        b, capitals, at = known(w) or _word(w)
        bare[b] = bare.get(b, 0) + c
        shapes[at] = shapes.get(at, 0) + c
        if capitals:
            upper += c
    return {
        "n": n,
        "odd": len(ODD.findall(text)) / max(1, letters),
        "upper": upper / n,
        "bars": counts["|"] / n,
        "top": max(bare.values()) / n,
        "again": sum(map(eq, words, islice(words, 1, None))) / max(1, n - 1),
        "distinct": len(bare) / n,
        "stops": sum(bare[w] for w in STOP if w in bare) / n,
        "ends": len(ENDS.findall(text)) / n,
        "length": letters / n,
        "same_lines": 1 - len(set(lines)) / len(lines),
        "bangs": text.count("!!") / n,
    }, shapes


def shares(text: str) -> dict[str, float] | None:
    """What labellers and features go by; None for a text without words."""
    return measured(text)[0]


def votes(s: dict[str, float] | None) -> tuple[int, ...]:
    """One vote per labeller: 1 good, -1 bad, 0 none."""
    if s is None:
        return (0,) * len(LABELLERS)
    some = s["n"] >= 12
    return (
        -1 if s["odd"] > 0.05 else 0,
        -1 if s["upper"] > 0.4 else 0,
        -1 if s["bars"] > 0.1 else 0,
        -1 if s["bangs"] > 0.1 else 0,
        -1 if some and s["again"] > 0.3 else 0,
        (1 if s["again"] == 0 else 0) if not some else -1 if s["top"] > 0.3 else 1 if s["top"] < 0.2 else 0,
        (1 if s["distinct"] > 0.5 else 0) if not some else -1 if s["distinct"] < 0.08 * min(1.0, 400 / s["n"]) else 1 if s["distinct"] > 0.3 else 0,
        -1 if some and s["stops"] < 0.06 else 1 if s["stops"] > 0.15 else 0,
        (1 if s["ends"] > 0 else 0) if not some else -1 if s["ends"] < 0.01 or s["ends"] > 0.6 else 1 if s["ends"] < 0.4 else 0,
        -1 if not 2 <= s["length"] <= 14 else 1 if 3 <= s["length"] <= 9 else 0,
        -1 if s["same_lines"] > 0.5 else 0,
    )


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % FEATURES


def shape(word: str) -> str:
    """Runs of letters, capitals and digits become a, A and 0; other signs stay, each once in a row."""
    return "".join([k for k, _ in groupby(word.translate(_kinds))])[:12]


@lru_cache(4096)
def _bin(name: str, number: int) -> int:
    return _slot(f"{name} {number}")


def features(text: str, s: dict[str, float] | None, shapes: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values, of norm about one: the share of each word shape and one-hot bins of the shares. s and shapes: as measured."""
    if s is None:
        return np.array([_slot("bias")]), np.array([1.0])
    found = measured(text)[1] if shapes is None else shapes
    out = {k: v / s["n"] for k, v in found.items()}
    for name in ("odd", "upper", "bars", "top", "again", "distinct", "stops", "ends", "same_lines", "bangs"):
        out[_bin(name, min(20, int(math.sqrt(s[name]) * 20)))] = 0.5
    for name in ("length", "n"):
        out[_bin(name, int(math.log2(1 + s[name]) * (4 if name == "length" else 1)))] = 0.25
    out[_slot("bias")] = 1.0
    return np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), np.float64, len(out))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern; the chance of each vote (bad, none, good) by class (bad, good) and labeller; prior of good.

    EM over pattern counts, silence being a vote of its own. It starts from the votes' sum, bad votes counted double.
    """
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(np.float64)  # pattern, labeller, vote
    bad, good = (patterns == -1).sum(axis=1), (patterns == 1).sum(axis=1)
    post = 1 / (1 + np.exp(2.0 * bad - good - 0.5))
    for _ in range(ROUNDS):
        w = np.stack([counts * (1 - post), counts * post])
        prior = (w[1].sum() + 1) / (counts.sum() + 2)
        chance = np.einsum("cp,plv->clv", w, hot) + np.array([[0.5, 1.0, 0.1], [0.1, 1.0, 0.5]])[:, None, :]
        chance /= chance.sum(axis=2, keepdims=True)
        like = np.einsum("clv,plv->cp", np.log(chance), hot)
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1] + math.log1p(-prior) - math.log(prior), -500, 500)))
    return post, chance, float(prior)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights of a logistic scorer with soft labels, by AdaGrad in a fixed order."""
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[at] @ x))))) - y) * x
            squares[at] += g * g
            weights[at] -= 0.3 * g / np.sqrt(squares[at])
    return weights


VOTES = T.StructType([T.StructField(x, T.ByteType()) for x in LABELLERS])


@F.pandas_udf(VOTES)
def _votes(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame(np.array([votes(shares(t)) for t in batch], dtype=np.int8).reshape(-1, len(LABELLERS)), columns=list(LABELLERS))


@F.pandas_udf(T.StructType([T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("votes", T.ArrayType(T.ByteType()))]))
def _sampled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        made = [(*features(t, *(m := measured(t))), np.array(votes(m[0]), dtype=np.int8)) for t in batch]
        yield pd.DataFrame(made, columns=["slots", "values", "votes"])


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Weights, and each labeller's estimated accuracy on the bad and the good texts that it votes on."""
    small_batches(documents.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = documents.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    counted = rows.select(_votes("_text").alias("v")).groupBy("v").agg(F.count("*").alias("n")).select("v.*", "n").orderBy(*LABELLERS).collect()
    if not counted:
        return np.zeros(FEATURES), {}
    patterns = np.array([r[:-1] for r in counted], dtype=np.int64).reshape(len(counted), -1)
    counts = np.array([r[-1] for r in counted], dtype=np.float64)
    post, chance, _ = estimate(patterns, counts)
    right = np.stack([chance[0, :, 0] / (chance[0, :, 0] + chance[0, :, 2]), chance[1, :, 2] / (chance[1, :, 0] + chance[1, :, 2])], axis=1)
    by = {tuple(p): y for p, y in zip(patterns.tolist(), post, strict=True)}
    total = counts.sum()
    # a hash of id and text (ids may be null) picks about 1.2 * sample rows where they are; the smallest `sample` hashes of these stay
    key = F.xxhash64(F.lit("sample"), "_id", "_text")
    bar = int(min(1.0, 1.2 * sample / total + 20 / total) * 2.0**64) - 2**63
    picked = rows.withColumn("k", key).where(F.col("k") <= F.lit(min(bar, 2**63 - 1))).select("k", _sampled("_text").alias("f"))
    seen = picked.orderBy("k", "f.slots", "f.values").limit(sample).collect()
    model = train([(np.array(r.f.slots), np.array(r.f["values"]), by[tuple(r.f.votes)]) for r in seen if r.f.slots])
    return model, {x: (float(a), float(b)) for x, (a, b) in zip(LABELLERS, right, strict=True)}


def with_quality(documents: DataFrame, weights: np.ndarray, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """documents with the scorer's probability of good; 0 for texts without words."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                s, shapes = measured(t)
                at, x = features(t, s, shapes)
                out.append(0.0 if s is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, float(shared.value[at] @ x))))))
            yield pd.Series(out, dtype="float64")

    return documents.withColumn(into, score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def classify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, keep: one row per document."""
    rows = documents.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    weights, _ = fit(rows, id_col)
    return with_quality(rows, weights, into="score").select(id_col, "score", (F.col("score") >= threshold).alias("keep"))
