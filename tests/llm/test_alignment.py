"""Alignment of two tokenizers against a plain comparison of byte ranges."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrail.llm import alignment as al

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "the ", "don't", "  ", "\n", "\t", "\r", " ", "é", "日本", "😀", "▁", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "123", "}",
         ";", " ", "\x00", "Foo", "ing", "ﬁ", "\x0b", "\x0c", " ", "　", "x\r\n", "'s", "\x85", "unbelievable ", "Straße "]
SCHEMA = "doc_id long, text string, n_a string, _block double, links long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    texts = [None, "", " ", "  ", "\n", "word", "two words", "▁", "word " * 30_000, "the end.\n" * 2000]
    texts += ["".join(rng.choice(PARTS, rng.integers(1, 16))) for _ in range(400)]
    return [(5 * k, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, "the same the same"), (3, "the same the same")]


def tokens(text):
    """(id, start, end) of both sides, or two empty lists."""
    known = al.aligner(A, B)
    if not text:
        return [], []
    sides = []
    for ids, spelt in ((known.a.encode(" " + text, add_special_tokens=False).ids, known.bytes_a), (known.b.encode(text), known.bytes_b)):
        at, out, whole = 0, [], b""
        for i in ids:
            t = spelt[i].as_py()
            out.append((i, at, at + len(t)))
            at, whole = at + len(t), whole + t
        if whole != (" " + text).encode():
            return [], []
        sides.append(out)
    return tuple(sides)


def links_by_walk(a, b):
    out, first = [], 0
    for i, x, y in a:
        while b[first][2] <= x:
            first += 1
        j = first
        while j < len(b) and b[j][1] < y:
            out.append((i, b[j][0]))
            j += 1
    return out


def expected(rows):
    docs, seen = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [[[str(i) for i, s, e in side if x <= s and e <= y] for side in (a, b)] for x, y in zip([0, *ends], ends)] if len(a) < 5000 else None
        links = links_by_walk(a, b)
        seen.update(links)
        docs.append((doc_id, len(a), len(b), len(ends), links, groups))
    top = {}
    for (_, j), n in seen.items():
        top[j] = max(n, top.get(j, 0))
    return sorted(((d, n, m, g, len(links), sum(seen[x] == top[x[1]] for x in links), sum(seen[x] for x in links),
                    None if groups is None else ";".join("|".join(map(",".join, x)) for x in groups))
                   for d, n, m, g, links, groups in docs), key=repr)


@pytest.mark.parametrize("block_links,entries", [(1 << 20, 1 << 19), (500, 50)])
def test_alignment_and_counts(spark, rows, block_links, entries):
    docs = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], SCHEMA).repartition(4)
    got = al.with_counts(al.aligned_blocks(docs, A, B, cache_entries=entries, block_links=block_links))
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("n_a") < 5000, F.col("groups")))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_pointer_jumping_finds_the_last_token_of_each_group():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 400):
        for share in (0.01, 0.3, 0.9):
            a, b = (np.append(np.flatnonzero(rng.random(n) < share) + 1, n + 1) for _ in range(2))
            common = np.intersect1d(a, b)
            want = [np.searchsorted(a, common[np.searchsorted(common, e)]) for e in [*a, *b]]
            assert al.terminals(a, b).tolist() == want
            start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
            pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if start_a[i] < b[j] and start_b[j] < a[i]]
            assert list(zip(*(x.tolist() for x in al.links_of(a, b)))) == pairs


def test_one_chain_over_a_long_text():
    n = 1 << 16  # A ends at odd bytes, B at even ones: one group, found in few rounds
    a, b = np.append(np.arange(1, 2 * n, 2), 2 * n), np.arange(2, 2 * n + 1, 2)
    assert (al.terminals(a, b) == n).all()


def test_a_table_without_tokens_and_an_empty_one(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    got = al.align(docs, A, B).drop("groups")
    assert sorted(map(tuple, got.collect())) == [(k, 0, 0, 0, 0, 0, 0) for k in (1, 2, 3)]
    assert al.align(docs.limit(0), A, B).collect() == []
