"""Pattern packing: whole pieces, gapless sequences, and few of them."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from papertrail.llm import pattern_packing as pp

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, length string, _task double, sequence_id long"


def lengths(rng, kind, n):
    return {"short": lambda: np.clip(np.exp(rng.normal(5.5, 1.2, n)).astype(int) + 1, 1, 2048),
            "even": lambda: rng.integers(1, 2049, n), "halves": lambda: rng.integers(500, 1500, n),
            "tiny": lambda: rng.integers(30, 60, n), "ones": lambda: np.ones(n, int), "one length": lambda: np.full(n, 700),
            "full": lambda: np.full(n, 2048)}[kind]()


def best_fit_decreasing(values, size):
    """Sequences that plain best fit, the longest first, needs."""
    room = [0] * (size + 1)  # sequences by tokens still free
    used = 0
    for x in sorted(values, reverse=True):
        at = next((r for r in range(x, size + 1) if room[r]), None)
        if at is None:
            used, at = used + 1, size
        else:
            room[at] -= 1
        room[at - x] += 1
    return used


@pytest.mark.parametrize("kind", ["short", "even", "halves", "tiny", "ones", "one length", "full"])
@pytest.mark.parametrize("n", [1, 40, 2000])
def test_plan_takes_every_piece_once_in_few_sequences(kind, n):
    values = lengths(np.random.default_rng(n), kind, n)
    plan = pp.Plan(np.bincount(values, minlength=2049))
    assert plan.taken == np.bincount(values, minlength=2049).tolist()
    spans = defaultdict(list)
    slots = plan.slots().tolist()
    for k, (x, first, copies, sequence, place) in enumerate(slots):
        end = slots[k + 1][1] if k + 1 < len(slots) and slots[k + 1][0] == x else plan.taken[x]
        for c in range(end - first):
            spans[sequence + c // copies].append((place + c % copies * x, x))
    assert sorted(spans) == list(range(plan.sequences))
    for parts in spans.values():
        ends = np.cumsum([x for _, x in sorted(parts)])
        assert [p for p, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert plan.sequences <= 1.01 * best_fit_decreasing(values.tolist(), 2048) + 1


def test_fit_decides_most_of_a_large_histogram():
    values = lengths(np.random.default_rng(3), "even", 300_000)
    plan = pp.Plan(np.bincount(values, minlength=2049))
    assert plan.fitted > 0.8 * plan.sequences and plan.sequences < 1.005 * values.sum() / 2048
    assert len(plan.slots()) < 50_000


def test_fit_solves_the_least_squares():
    lens, mult = np.array([[3, 1, 0], [2, 2, 0], [4, 0, 0], [1, 1, 2]]), np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [1, 1, 1]])
    times = np.array([5.0, 0.0, 7.0, 2.0])
    histogram = np.zeros(5)
    for x, c, n in zip(lens, mult, times):
        np.add.at(histogram, x, c * n)
    assert np.allclose(pp.fit(lens, mult, histogram, 4000), times, atol=1e-3)
    assert (pp.fit(lens, mult, np.array([0, 0, 0, 9.0, 0]), 4000) >= 0).all()


def test_an_empty_histogram():
    assert pp.Plan(np.zeros(2049, "int64")).sequences == 0 and len(pp.Plan(np.zeros(2049, "int64")).slots()) == 0


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    texts = [None, "", " ", "one", "word " * 2047, "word " * 2048, "word " * 10_000, "Ünï çødé", "a <|endoftext|> b"]
    texts += [" ".join(rng.choice(["alpha", "beta,", "gamma", "12", "don't"], rng.integers(1, 600))) for _ in range(200)]
    out = [(3 * k, t) for k, t in enumerate(texts)]
    return out + [(None, "no id"), (4, "twice"), (4, "twice")] + [(10_000 + k, "the same") for k in range(150)]


@pytest.mark.parametrize("max_offsets", [1 << 20, 0])
def test_packing_keeps_every_id_in_order(spark, rows, max_offsets):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], SCHEMA).repartition(5)
    out = pp.place(pp.pieces_of(docs, path), max_offsets=max_offsets).collect()
    want = defaultdict(int)
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], "<u4")
            want[doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in out:
        got[r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    total = 0
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [p for p, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
        total += ends[-1]
    assert len(sequences) <= -(-total // 2048) + 1


def test_shorter_sequences_no_end_id_and_an_empty_table(spark):
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one two three four five"), (2, ""), (3, None)], "doc_id long, text string")
    out = pp.best_fit(docs, path, max_tokens=2, end_id=None).orderBy("start").collect()
    assert [(r["doc_id"], r["piece"], r["start"], r["length"]) for r in out] == [(1, 0, 0, 2), (1, 1, 2, 2), (1, 2, 4, 1)]
    assert pp.best_fit(docs.limit(0), path).collect() == []
