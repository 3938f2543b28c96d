"""Line dedup, hard negatives and conversation repair against brute force, and their defined results for odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_edges import CLASH, LONG
from tests.oracle import spark_rows, sql_rows
from tidemark.llm import conversations, hard_negatives, line_dedup
from tidemark.llm import queries as llm


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_hard_negatives", "op13_conversation_repair"])
@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_agrees_with_sql(spark, name, at):
    rows = spark_rows(llm.queries()[name](spark, at))
    assert rows == sql_rows(llm.oracle_sql()[name], at) and rows[1]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# line dedup


def kept_lines(rows, least=20, documents=3):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    found = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < documents or i == max(h for h in holders[key(x)] if h is not None)]
        found.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(found, key=repr)


LINE = "This line is in many documents"
LINES = [
    (1, None), (2, ""), (3, f"{LINE}\nown line of the third document\n{LINE.upper()}"), (4, f" \t{LINE}\r\n\n\n"), (5, f"{LINE}\x0b\ntail"), (5, f"{LINE}\x0b\ntail"),
    (None, f"{LINE}\n日本語日本語日本語日本語日本語日本語日本"), (None, "日本語日本語日本語日本語日本語日本語日本"), (7, "日本語日本語日本語日本語日本語日本語日本"), (8, "日本語日本語日本語日本語日本語日本語日本"),
    (9, "日本語日本語日本語日本語日本語日本語本"), (10, "日本語日本語日本語日本語日本語日本語本"), (11, "日本語日本語日本語日本語日本語日本語本"), (12, LONG + "\n" + LINE), (13, LONG), (14, LONG), (15, "Ä" * 20), (16, "ä" * 20), (17, "Ä" * 20),
    (18, "x\x85" + "y" * 30 + "\xa0"), (19, "x\x85" + "y" * 30), (20, "X\x85" + "Y" * 30), (21, "X\x85" + "Y" * 30),
]


def wide(df, own):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH + ["_k1", "_r1", "_drops", "kept", "anchor", "slot", "vector", "norm", "here"]) if c not in own])


def test_lines_of_odd_rows_against_brute_force(spark):
    docs = wide(spark.createDataFrame(LINES, "doc_id long, text string").repartition(3), ("doc_id", "text"))
    assert sorted((tuple(r) for r in line_dedup.line_digests(docs).collect()), key=repr) == kept_lines(LINES)
    assert line_dedup.line_digests(docs.limit(0)).collect() == []
    texts = {r.doc_id: r.text for r in line_dedup.drop_lines(docs, min_documents=2).collect()}
    assert texts[4] == "\n" * 2 and texts[1] == ""


def test_a_line_in_most_documents_and_many_equal_rows(spark):
    rows = [(i, f"{LINE}\nonly in document {i} of the table") for i in range(400)] + [(0, LINE)] * 300 + [(None, LINE)] * 200
    got = line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == kept_lines(rows)


# hard negatives


def mined(rows, anchors=lambda i: i % 100 == 0):
    ok = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    found = []
    for i, a, label in ok:
        if anchors(i):
            scored = [(-sum(x * y for x, y in zip(a, v)), j, other) for j, v, other in ok if j != i]
            for p, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
                fits = sorted((s, k) for s, k, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
                found += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fits)]
    return sorted(found)


def vectors(seed, n, dims=6, spread=1.0, ids=None):
    r = np.random.default_rng(seed)
    lengths = np.exp(r.normal(0, spread, n))
    return [(int(i), [float(np.float32(x)) for x in v], int(label)) for i, v, label in zip(ids if ids is not None else range(n), r.normal(0, 1, (n, dims)) * lengths[:, None], r.integers(0, 3, n))]


def frame(spark, rows):
    return wide(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), ("vec_id", "embedding", "label"))


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_hard_negatives_against_brute_force(spark, spread, monkeypatch):
    for name, value in (("BUCKET", 16), ("BLOCK", 2), ("WAVE", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(int(spread), 700, spread=spread)
    got = [tuple(r) for r in hard_negatives.mine_shifted(frame(spark, rows)).collect()]
    assert sorted(got) == mined(rows) and got


def test_hard_negatives_of_odd_rows(spark):
    same = [(i, [1.0, 0.5, -0.25], i % 3) for i in range(100, 260)]  # ties
    odd = [
        (0, [1.0, 0.5, -0.25], 0), (1, None, 1), (2, [1.0, None, 1.0], 1), (3, [float("nan")] * 3, 1), (4, [float("inf"), 0.0, 0.0], 1), (5, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1),
        (6, [], 1), (300, [], 1), (8, [2.0], 1), (400, [2.0, 0.0, 0.0, 5.0], 1), (500, [-1.0, -1.0, -1.0], 2), (600, [1e5, -1e5, 1e5], 2), (601, [1e5, -1e5, 1e5], 2), (602, [9e4, -1e5, 1e5], 1), (9, [0.0, 0.0, 0.0], 0), (-100, [0.5, 0.25, 0.0], -3),
    ]
    rows = same + odd + [(101, [1.0, 0.5, -0.25], 2)] * 3 + [(100, [1.0, 0.5, -0.25], 1)]
    want = [(i, v, label) for i, v, label in rows]
    got = sorted(tuple(r) for r in hard_negatives.mine_shifted(frame(spark, rows)).collect())
    assert got == [x for x in mined(want)]
    assert hard_negatives.mine_shifted(frame(spark, rows).limit(0)).collect() == []
    assert hard_negatives.mine_shifted(frame(spark, [(1, [1.0], 1)])).collect() == []


def test_buckets_out_of_reach_are_not_searched(spark, monkeypatch):
    """Norms fall; once five positives of the longest are found, buckets of short rows are pruned."""
    import pyarrow as pa

    monkeypatch.setattr(hard_negatives, "BUCKET", 8)
    rows = [(i, [1000.0 / (1 + i), 1.0], 1) for i in range(80)]
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "vector": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": [r[2] for r in rows]})
    buckets = list(hard_negatives._pack(hard_negatives._rows(1)(iter([batch]))))
    wave = hard_negatives._joined([hard_negatives._unpacked(buckets[0].to_pylist()[0])])
    calls, real = [], hard_negatives._scores
    monkeypatch.setattr(hard_negatives, "_scores", lambda a, b, bound: calls.append(len(b)) or real(a, b, bound))
    search = hard_negatives.Search(type("Sent", (), {"value": tuple(x[:1] for x in wave)}), 5)
    assert sorted(pa.Table.from_batches(search(iter(buckets))).column("id").to_pylist()) == [1, 2, 3, 4, 5] and len(buckets) == 10 and len(calls) == 1


# conversations

ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits of rows (role, text), with up to two inserts in every gap."""
    seen, faults = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    gaps = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    best = None
    for edits in itertools.product(*choices):
        base = sum({"D": 2, "K": 0}.get(e, 1) + 5 * (e != "D" and f == "truncated") for e, f in zip(edits, faults))
        if best and base > best[0]:
            continue
        for filled in itertools.product(gaps, repeat=len(rows) + 1) if len(rows) < 4 else ([[]] * (len(rows) + 1), *(x for k in range(len(rows) + 1) for g in gaps[1:] for x in [[[]] * k + [g] + [[]] * (len(rows) - k)])):
            made, audit, cost = [], "", base
            for k in range(len(rows) + 1):
                for r in filled[k]:
                    made.append((ROLES[r], ""))
                    audit, cost = audit + "I", cost + 5
                if k < len(rows):
                    audit += edits[k][0]
                    if edits[k] != "D":
                        made.append((rows[k][0] if edits[k] == "K" else ROLES[edits[k][1]], rows[k][1]))
            if all(r[:1] for r, _ in made) and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in made)):
                best = min(best or (99, ""), (cost, audit, "\n".join(f"{r}:{t}" for r, t in made)))
    return best


def test_repairs_against_all_edits(spark):
    r = np.random.default_rng(1)
    texts = ["Fine.", "Fine too!", "cut off", "", " \t", "Why?", "one more.", "it ends"]
    rows = [(c, t, str(r.choice(["user", "assistant", "system", "tool", "user", "assistant", ""])), str(r.choice(texts))) for c in range(160) for t in range(int(r.integers(0, 7)) if c % 4 else 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {x.conv_id: x for x in conversations.repair(df).collect()}
    pieces = {x.conv_id: tuple(x) for x in conversations.repair(df, rows=7, segment=2).collect()}
    turns = {}
    for x in conversations.repaired_turns(df, conversations.repair(df)).collect():
        turns.setdefault(x.conv_id, []).append((x.position, x.role, x.text))
    for c in {x[0] for x in rows}:
        own = [(role, text) for _, _, role, text in sorted(x for x in rows if x[0] == c)]
        cost, audit, made = cheapest(own)
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, sha(made)), own
        assert pieces[c] == tuple(got[c])
        assert "\n".join(f"{role}:{text}" for _, role, text in sorted(turns.get(c, []))) == made
    assert len(got) == len({x[0] for x in rows})


def test_inserts_are_made_where_nothing_is_cheaper(spark):
    # five good pairs around one missing answer: deleting or relabelling more costs more than an insert
    rows = [(1, k, role, f"Turn {k}.") for k, role in enumerate(["user", "assistant"] * 6) if k != 5]
    rows += [(2, k, role, f"Turn {k}.") for k, role in enumerate(["user", "assistant"] * 20)]
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    own = [x[2:] for x in rows if x[0] == 1]
    assert (got[1].gaps, got[1].illegal) == (1, 1) and got[1].cost <= 5 and (got[2].cost, got[2].audit) == (0, "K" * 40)
    assert got[1].cost == 2 and got[1].audit.count("D") == 1 and len(own) == 11


def test_conversations_of_odd_rows(spark):
    rows = [
        (1, None, "user", "Last?"), (1, 3, "assistant", "So it is."), (1, None, "system", "Be kind."), (2, 1, None, "Who?"), (2, 2, "user", None), (None, 5, "user", "No id."), (None, 9, "assistant", "Nor here."), (3, None, None, None),
        (4, 1, "user", "Again."), (4, 1, "user", "Again."), (4, -5, "assistant", "日本語。"), (5, 1, "user", LONG), (5, 2, "assistant", LONG),
    ]
    df = wide(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), ("conv_id", "turn", "role", "text"))
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    assert len(got) == 6
    assert (got[1].gaps, got[1].audit, got[1].repaired_sha256) == (0, "KKK", sha("system:Be kind.\nuser:Last?\nassistant:So it is."))
    assert (got[2].audit, got[2].blank, got[2].illegal, got[2].repaired_sha256) == ("DD", 1, 1, sha(""))
    assert (got[None].gaps, got[None].audit, got[3].audit, got[3].gaps) == (3, "KK", "D", 0)
    assert (got[4].duplicate, got[4].truncated, got[4].gaps) == (1, 1, 5)
    assert got[5].audit == "KK"
    assert conversations.repair(df.limit(0)).collect() == [] and conversations.repair_damaged(df.limit(0)).collect() == []
    assert {r.conv_id for r in conversations.repair_damaged(df).collect()} == set(got)


def test_damage_goes_by_the_checksum(spark):
    rows = [(c, t, "system", "One. Two!") for c in range(40) for t in (1, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made, here = conversations.damage(df)
    got = sorted((tuple(r) for r in made.where(here).select("conv_id", "turn", "role", "text").collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if fate == 4 else role, {1: "", 2: "One Two"}.get(fate, text))
        want += [row] * (2 if fate == 3 else fate != 0)
    assert got == sorted(want, key=repr)


def test_a_long_conversation_is_chained_from_pieces(spark):
    rows = [(7, k, "user" if k % 3 else "assistant", f"Turn {k}" + "." * (k % 5 > 0)) for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, pieces = conversations.repair(df, segment=2000).collect(), conversations.repair(df, rows=300, segment=100).collect()
    assert whole == pieces and len(whole[0].audit) >= 1500 and whole[0].truncated == 300
