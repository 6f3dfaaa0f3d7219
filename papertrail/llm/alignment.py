"""Alignment of two tokenizers' tokens of the same texts.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, B a
``sentencepiece`` model; both spell out the bytes of a space and the text.

Groups by pointer jumping: every token points to the farthest-right token of
the other side that it overlaps, if that one ends later, and a B token that
ends with an A token points to it; so all pointers go right, and the last A
token of a group, which ends where a B token ends, points to itself.
Doubling the pointers (``next = next[next]``, whole arrays at once) takes
every token to the terminal token of its connected group in as many rounds as
the logarithm of the longest chain.  Links are all overlapping A-B pairs.

Both tokenizers are run and aligned on pieces, an ASCII white-space run with
the chunk after it, where neither joins across; what a piece gives is kept
in a table of some ``cache_entries`` pieces per Python worker.  Which white space
may be cut at is read off the model's vocabulary; a text with any other white
space is one piece.

How often a pair of ids is linked in the whole corpus, and which pair is the
most frequent of its B id, comes from three steps without a hot key: each
block of documents (``block_links`` links, or one longer document) counts its
own distinct pairs, the pairs' counts are added up by pair, which every
block names once, and go back to the blocks that named them, where
:func:`with_counts` adds up each document's links.

Defined cases: a null or empty text, and one whose tokens spell other bytes
than a space and the text (the model drops or replaces something), has no
tokens: all counts are 0 and ``groups`` is empty; a null id is carried;
repeated rows give a row each and count each; other columns are ignored; an
empty table gives an empty result; a very long text is a block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.llm.common import stored
from papertrail.llm.wordhash import slices

CACHE_ENTRIES = 1 << 19
BLOCK_LINKS = 1 << 20
_ASCII_SPACE = " \t\n\x0b\x0c"
# white space at which the pieces of A could be joined otherwise, as UTF-8
_OTHER_SPACE = rb"[\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_WORKER: dict = {}  # per Python worker: aligners by files


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE writes bytes: printable Latin-1 as
    itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def links_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens (numbers in A and in B), given where the
    tokens end in the same bytes."""
    start_a = np.append(0, end_a[:-1])
    first = np.searchsorted(end_b, start_a, "right")
    many = np.searchsorted(end_b, end_a, "left") - first + 1
    a = np.repeat(np.arange(len(end_a)), many)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + first[a]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The number of the group's last A token, for all A tokens and then all B tokens."""
    n = len(end_a)
    far_b = np.searchsorted(end_b, end_a, "left")  # the overlapping token that reaches farthest right
    far_a = np.searchsorted(end_a, end_b, "left")
    to = np.concatenate([np.where(end_b[far_b] > end_a, n + far_b, np.arange(n)), far_a])
    while True:
        after = to[to]
        if np.array_equal(after, to):
            return to
        to = after


class Aligner:
    """Aligns pieces by the tokenizers of two files, through a cache."""

    def __init__(self, a_path: str, b_path: str, entries: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.entries = entries
        self._forget()
        letters = byte_letters()
        token_a = {i: t for t, i in self.a.get_vocab().items()}
        token_a = [token_a.get(i, "") for i in range(max(token_a) + 1)]
        token_a = [bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t in token_a]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        token_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.bytes_a, self.bytes_b = (pa.array(t, pa.large_binary()) for t in (token_a, token_b))
        self.len_a, self.len_b = (np.array(list(map(len, t))) for t in (token_a, token_b))
        self.digits, self.n_digits = _decimals(max(len(self.len_a), len(self.len_b)))
        # B may be cut before white space that no piece has behind something else, and elsewhere not at all
        own = [p.replace("▁", " ") for i, p in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        bad = {c for p in own for c in p[len(p) - len(p.lstrip(" ")):] if c in _ASCII_SPACE}
        cut = "".join(c for c in _ASCII_SPACE if c not in bad).encode()
        self.space = [bytes([c]) for c in cut]
        self.whole = re.compile(b"|".join([_OTHER_SPACE, *(re.escape(c.encode()) for c in bad)]))
        self.piece = re.compile(b"[%s]*[^%s]+|[%s]+" % ((re.escape(cut),) * 3)) if cut else re.compile(rb"(?s).+")

    def _ids_a(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each piece).  Pieces that begin with white space and
        end without are encoded as one text, since A parts them anyway."""
        if all(p[:1] in self.space and p[-1:] not in self.space for p in pieces) and not any(map(self.whole.search, pieces)):
            ids = np.array(self.a.encode(b"".join(pieces).decode(), add_special_tokens=False).ids, "int64")
            ends = np.cumsum(self.len_a[ids])
            want = np.cumsum(np.fromiter(map(len, pieces), "int64", len(pieces)))
            at = np.minimum(np.searchsorted(ends, want, "left"), len(ends) - 1)
            if np.array_equal(ends[at], want):
                return ids, np.diff(at, prepend=-1)
        ids = [e.ids for e in self.a.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), "int64"), np.fromiter(map(len, ids), "int64", len(ids))

    def _ids_b(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each piece).  B writes a space before every text it is
        given: a piece's own space is left to it, and dropped again where the
        piece has none."""
        ids = self.b.encode([p[p[:1] == b" ":].decode() for p in pieces], num_threads=1)
        ids = [x if p[:1] == b" " else x[1:] for p, x in zip(pieces, ids)]
        return np.fromiter(chain.from_iterable(ids), "int64"), np.fromiter(map(len, ids), "int64", len(ids))

    def _learn(self, pieces: list[bytes]) -> tuple[list[bytes], pa.Array, pa.Array, np.ndarray]:
        """(pieces, groups, links, (n_a, n_b, n_groups, 0 or 1 where one tokenizer
        spells other bytes) by piece), in an order of its own."""
        a, n_a = self._ids_a(pieces)
        b, n_b = self._ids_b(pieces)
        text = b"".join(pieces)
        good = np.ones(len(pieces), bool)
        if _spelt(self.bytes_a, a) != text or _spelt(self.bytes_b, b) != text:
            for k, (p, x, y) in enumerate(zip(pieces, np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]))):
                good[k] = _spelt(self.bytes_a, x) == p == _spelt(self.bytes_b, y)
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a[good], n_b[good]
            pieces = [p for p, g in zip(pieces, good) if g] + [p for p, g in zip(pieces, good) if not g]
        rest = len(good) - len(n_a)
        groups, links, n_groups = self._align(a, b, n_a, n_b)
        counts = np.column_stack([n_a, n_b, n_groups, np.zeros_like(n_a)])
        counts = np.vstack([counts, np.tile([0, 0, 0, 1], (rest, 1))])
        none = pa.array([b""] * rest, pa.large_binary())
        return pieces, pa.concat_arrays([groups, none]), pa.concat_arrays([links, none]), counts

    def _align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(groups, links, number of groups) of pieces whose tokens follow each other."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        link_a, link_b = links_of(end_a, end_b)
        pair = a[link_a] << 32 | b[link_b]
        to = terminals(end_a, end_b)
        # all tokens by group, A before B: each is written with the sign that follows it
        side = np.concatenate([np.zeros(len(a), "int64"), np.ones(len(b), "int64")])
        order = np.argsort(2 * to + side, kind="stable")
        group, part = to[order], side[order]
        sign = np.full(len(order), ord(","), "uint8")
        sign[:-1][part[:-1] < part[1:]] = ord("|")
        last = np.ones(len(group), bool)
        last[:-1] = group[1:] != group[:-1]
        sign[last] = ord(";")
        ids = np.concatenate([a, b])[order]
        text = np.concatenate([self.digits[ids], sign[:, None]], 1)
        width = self.n_digits[ids]
        text[np.arange(len(ids)), width] = sign
        flat = text[np.arange(text.shape[1]) <= width[:, None]]
        at = np.append(0, np.cumsum(n_a + n_b))
        text_at = np.append(0, np.cumsum(width + 1))[at]
        link_at = 8 * np.append(0, np.searchsorted(link_a, np.cumsum(n_a), "left"))
        groups = np.append(0, np.cumsum(last))[at]
        arrays = (pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer(x), pa.py_buffer(y)])
                  for x, y in ((text_at, flat), (link_at, pair)))
        return *arrays, np.diff(groups)

    def _number(self, pieces: list[bytes]) -> np.ndarray:
        """The table rows of pieces; rows of those not met before are added."""
        got = list(map(self.row.get, pieces))
        if None in got:
            new, groups, links, counts = self._learn(list({p for p, k in zip(pieces, got) if k is None}))
            self.row.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
            self.groups = pa.concat_arrays([self.groups, groups])
            self.links = pa.concat_arrays([self.links, links])
            self.counts = np.concatenate([self.counts, counts])
            got = list(map(self.row.__getitem__, pieces))
        return np.array(got, "int64")

    def _forget(self) -> None:
        self.row = {}
        self.groups = self.links = pa.array([], pa.large_binary())
        self.counts = np.empty((0, 4), "int64")

    def texts(self, texts: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Per text: groups, links (A id << 32 | B id, int64), and (n_a, n_b, n_groups) as rows."""
        if len(self.row) > self.entries or self.groups.nbytes + self.links.nbytes > 128 * self.entries:
            self._forget()
        pieces: list[bytes] = []
        ends = np.zeros(len(texts) + 1, "int64")
        for k, t in enumerate(texts):
            if t:
                pieces.extend([b" " + t] if self.whole.search(t) else self.piece.findall(b" " + t))
            ends[k + 1] = len(pieces)
        row = self._number(pieces)
        bad = np.append(0, np.cumsum(self.counts[row, 3]))[ends]
        if bad[-1]:  # what a piece cannot tell, the whole text does
            again = np.flatnonzero(np.diff(bad))
            of = dict(zip(again.tolist(), self._number([b" " + texts[k] for k in again]).tolist()))
            part = [row[x:y] if k not in of else np.array([of[k]][self.counts[of[k], 3]:], "int64")
                    for k, (x, y) in enumerate(zip(ends, ends[1:]))]
            row, ends = np.concatenate(part), np.append(0, np.cumsum([len(x) for x in part]))
        at, data = _joined(self.groups.take(pa.array(row)))
        at = at[ends]
        between = np.append(np.column_stack([at[:-1], np.maximum(at[1:] - 1, at[:-1])]).ravel(), at[-1])  # without the last sign
        groups = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(texts), [None, pa.py_buffer(between), data])
        at, data = _joined(self.links.take(pa.array(row)))
        links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at[ends]), data])
        counts = np.vstack([np.zeros((1, 3), "int64"), np.cumsum(self.counts[row, :3], 0)])
        return groups.take(pa.array(np.arange(0, 2 * len(texts), 2))), links, np.diff(counts[ends], axis=0)


def _joined(values: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """(offsets, bytes) of a large binary array that owns its buffers."""
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, "int64")[:len(values) + 1] if ends is not None and ends.size else np.zeros(1, "int64")
    return at, data if data is not None else pa.py_buffer(b"")


def _spelt(token: pa.Array, ids: np.ndarray) -> bytes:
    at, data = _joined(token.take(pa.array(ids)))
    return data.to_pybytes()[at[0]:at[-1]]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits of the numbers below n, left-aligned ASCII; how many each has)."""
    shown = np.char.encode(np.arange(n).astype(str), "ascii")
    width = shown.dtype.itemsize
    return np.frombuffer(shown.tobytes(), "uint8").reshape(n, width).copy(), np.char.str_len(shown).astype("int64")


def aligner(a_path: str, b_path: str, entries: int = CACHE_ENTRIES) -> Aligner:
    """The aligner of two files, once per Python worker."""
    if (a_path, b_path) not in _WORKER:
        _WORKER[a_path, b_path] = Aligner(a_path, b_path, entries)
    return _WORKER[a_path, b_path]


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                   cache_entries: int = CACHE_ENTRIES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """The first pass, for :func:`with_counts`.  One row per document: doc_id,
    n_a, n_b, n_groups, n_links, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids in order),
    its ``block`` and ``links`` (int32: every overlapping pair's number in the
    block's table); and one row per block with its table of distinct pairs
    (``pairs``, A id << 32 | B id) and how many links hold each (``times``)."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "links", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []  # id, links and the other columns of slices
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, number, times = np.unique(np.concatenate([p for _, p, _ in held]), return_inverse=True, return_counts=True)
            number, at = number.astype("<i4"), 0
            for columns, own, ends in held:
                part = pa.py_buffer(number[at:at + len(own)])
                at += len(own)
                links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(4 * ends), part])
                n = len(links)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, base + made)), links.cast(pa.binary()),
                                                  pa.nulls(n, longs), pa.nulls(n, longs)], names)
            own = [*(pa.nulls(1, c.type) for c in held[0][0]), pa.array([base + made]), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, pa.array([pairs], longs), pa.array([times], longs)], names)

        longs = pa.list_(pa.int64())
        for batch in batches:
            for b in slices(batch, 1, 1 << 20):
                groups, links, counts = aligner(a_path, b_path, cache_entries).texts([t.as_py() for t in b.column(1)])
                at, data = _joined(links)
                ends = (at - at[0]) // 8
                own = np.frombuffer(data, "int64", ends[-1], at[0])
                held.append(([b.column(0), *(pa.array(c) for c in counts.T), pa.array(np.diff(ends)), groups.cast(pa.binary()).cast(pa.string())],
                             own, ends))
                size += len(own)
                if size >= block_links:
                    yield from flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield from flush()

    d = docs.select(F.col(id_col).cast("long").alias("a"), F.coalesce(text_col, F.lit("")).cast("binary").alias("b"))
    return d.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, links binary, "
                             "pairs array<long>, times array<long>")


def with_counts(blocks: DataFrame) -> DataFrame:
    """The documents of :func:`aligned_blocks` (any further columns) with
    ``n_best`` (links whose pair is the most frequent of its B id in the whole
    table, ties included) and ``count_sum`` (the links' pairs' frequencies added
    up) in place of the blocks' columns."""
    fields = [f for f in blocks.schema.fields if f.name not in ("block", "links", "pairs", "times")]
    names = [f.name for f in fields]
    blocks = stored(blocks, "alignment-blocks")
    zipped = F.posexplode(F.arrays_zip("pairs", "times")).alias("_k", "_p")
    table = blocks.filter(F.col("pairs").isNotNull()).select("block", zipped).select(
        F.col("block").alias("_of"), "_k", F.col("_p.pairs").alias("_pair"), F.col("_p.times").alias("_n"))
    counts = table.groupBy("_pair").agg(F.sum("_n").alias("_count"))
    # a B id is linked to at most A's vocabulary of ids
    of_b = Window.partitionBy(F.col("_pair").bitwiseAND((1 << 32) - 1))
    counts = counts.withColumn("_best", F.col("_count") == F.max("_count").over(of_b))
    seen = table.join(counts, "_pair").select("_of", "_k", "_count", "_best")
    docs = blocks.filter(F.col("pairs").isNull()).select(*names, "block", "links")

    def add_up(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, "int64"), np.zeros(pairs.num_rows, "int64")
        k = pairs.column("_k").to_numpy()
        count[k], best[k] = pairs.column("_count").to_numpy(), pairs.column("_best").to_numpy()
        raw = [x.as_py() for x in rows.column("links")]
        at = np.frombuffer(b"".join(raw), "<i4")
        ends = np.append(0, np.cumsum([len(x) // 4 for x in raw]))
        total = lambda x: np.diff(np.append(0, np.cumsum(x[at]))[ends])
        out = rows.select(names)
        return out.append_column("n_best", pa.array(total(best))).append_column("count_sum", pa.array(total(count)))

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return docs.groupBy("block").cogroup(seen.groupBy("_of")).applyInArrow(add_up, ", ".join([*kinds, "n_best long, count_sum long"]))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum."""
    return with_counts(aligned_blocks(docs, a_path, b_path, id_col, text_col))
