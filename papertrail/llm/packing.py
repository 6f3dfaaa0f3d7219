"""Vector bin packing of tokenised examples into training sequences.

Each map task tokenises its documents, keeps a pool of at most
``pool_tokens`` tokens (plus one document), and fills one sequence after
another under three limits at once: tokens, segments and loss-bearing
tokens.  Of the pieces that fit, the one with the largest dot product of
its demand and the sequence's remaining capacity goes in; when none fits,
the best one is cut to fill the rest.  Documents longer than a sequence
give whole sequences first.  Nothing is shuffled and no token id leaves
its task before it is placed; at most one sequence per task is not full
(save where the segment or loss limit binds).

Sequence ids are ``partition << 40 | counter``: a retried task, reading
the same split, makes the same sequences.

Chunks between ASCII white space are encoded apart (the vocabulary drops
white space, and no token spans it) through a cache per Python worker.

Defined cases: a null or empty text is the end id alone; a null id is
carried; repeated rows are packed each; other columns are ignored; an
empty table gives no piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import kept, lean
from papertrail.llm.token_counts import encode_all, load_tokenizer

CACHE_ENTRIES = 3 << 18
POOL_TOKENS = 1 << 19
_CHUNKS = kept("chunks")  # per Python worker, by tokenizer file and size



# letters and digits of ASCII and Latin-1, which lower-case one by one
_PLAIN = re.compile(rb"(?:[0-9A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~|"  # ASCII marks, without the apostrophe and < > of special tokens


class ChunkIds:
    """Token ids of chunks without white space: chunk → uint32 bytes.

    A chunk that is a plain word and a tail of ASCII marks is looked up as the
    lower-cased word and the tail, which the vocabulary's pattern always
    parts.  The cache keeps two generations of ``entries`` chunks.
    """

    def __init__(self, tok, entries: int):
        self.tok, self.entries = tok, entries
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, parts: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        words, rest = [], []
        for p in parts:
            (words if p.isalpha() else rest).append(p.decode())  # bytes: ASCII letters only
        if rest:
            out.update((t.encode(), np.array(e.ids, "<u4").tobytes()) for t, e in zip(rest, encode_all(self.tok, rest)))
        if words:  # one call for all: each is a pre-token of its own
            e = self.tok.encode(" ".join(words), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(words) + 1))).tolist()
            out.update((t.encode(), ids[x:y]) for t, x, y in zip(words, cuts, cuts[1:]))
        return out

    def _learn(self, missed: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the new generation lacks."""
        old, found, split = self.old, {}, {}
        for c in missed:
            if (ids := old.get(c)) is not None:
                found[c] = ids
            else:
                core = c.rstrip(_MARKS)
                if core and _PLAIN.fullmatch(core):
                    split[c] = (core.decode().lower().encode(), c[len(core):])
                else:
                    split[c] = (c, b"")
        parts = {p: self.new.get(p) or old.get(p) for x in split.values() for p in x if p}
        parts.update(self._encode([p for p, ids in parts.items() if ids is None]))
        found.update(parts)
        found.update((c, parts[x] + (parts[y] if y else b"")) for c, (x, y) in split.items())
        return found

    def of(self, chunks: list[bytes]) -> bytes:
        got = list(map(self.new.get, chunks))
        if None in got:
            found = self._learn({c for c, ids in zip(chunks, got) if ids is None})
            got = [found[c] if ids is None else ids for c, ids in zip(chunks, got)]
            if len(self.new) + len(found) > self.entries:
                self.old, self.new = self.new, {}
            self.new.update(found)
        return b"".join(got)


def text_ids(text: bytes, path: str, cache_entries: int = CACHE_ENTRIES) -> bytes:
    """Token ids of a text, little-endian uint32."""
    known = _CHUNKS.get((path, cache_entries))
    if known is None:
        known = _CHUNKS[path, cache_entries] = ChunkIds(load_tokenizer(path)[0], cache_entries)
    return known.of(text.split())  # bytes: splits at ASCII white space only


class Packer:
    """Fills sequences from a pool of pieces.

    A piece is (document number, start, length, loss-free tokens at its
    beginning).  ``limits``: tokens, segments, loss-bearing tokens.
    """

    def __init__(self, limits: tuple[int, int, int]):
        if min(limits) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits = np.array(limits, "int64")
        self.pool = np.empty((0, 4), "int64")
        self.tokens = 0

    def extend(self, rows: list[tuple[int, int, int]]) -> None:
        new = np.array([(d, 0, n, min(x, n)) for d, n, x in rows], "int64").reshape(-1, 4)
        self.pool = np.vstack([self.pool, new])
        self.tokens += int(new[:, 2].sum())

    def _longest(self, piece: np.ndarray, room: np.ndarray) -> int:
        """Tokens of ``piece`` that fit into ``room``."""
        if room[1] < 1:
            return 0
        return int(min(piece[2], room[0], piece[3] + room[2]))

    def fill(self) -> list[tuple[int, int, int]]:
        """One sequence: (document number, start, length) in order."""
        out, room = [], self.limits.copy()
        pool = self.pool
        alive = np.ones(len(pool), bool)
        demand = np.stack([pool[:, 2], np.ones(len(pool), "int64"), pool[:, 2] - pool[:, 3]], 1)
        share = demand / self.limits
        while alive.any() and room[0] > 0 and room[1] > 0:
            score = np.where(alive, share @ (room / self.limits), -1.0)
            fits = alive & (demand <= room).all(1)
            at = int(np.argmax(np.where(fits, score, -1.0))) if fits.any() else int(np.argmax(score))
            p = pool[at]
            n = self._longest(p, room)
            if n == 0:
                break
            out.append((int(p[0]), int(p[1]), n))
            free = min(int(p[3]), n)
            room -= (n, 1, n - free)
            self.tokens -= n
            if n == p[2]:
                alive[at] = False
            else:
                pool[at] = (p[0], p[1] + n, p[2] - n, p[3] - free)
                demand[at] = (pool[at, 2], 1, pool[at, 2] - pool[at, 3])
                share[at] = demand[at] / self.limits
        self.pool = pool[alive]
        return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", no_loss_col: str | None = None,
         max_tokens: int = 2048, max_segments: int = 128, max_loss: int | None = None, end_id: int | None = 1,
         pool_tokens: int = POOL_TOKENS, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32),
    doc_tokens, sequence_id, offset.

    ``no_loss_col``: leading tokens of a document (its prompt) that bear no
    loss; ``max_loss`` limits the others in a sequence (default: no limit
    below ``max_tokens``).
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        packer, made, number = Packer(limits), 0, 0
        kept: dict[int, tuple] = {}  # document number -> id, ids, tokens not yet placed

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def place(rows: list) -> None:
            nonlocal made
            offset = 0
            for d, s, n in packer.fill():
                doc, ids, left = kept[d]
                rows.append((doc, s, n, ids[4 * s:4 * (s + n)], len(ids) // 4, first + made, offset))
                offset += n
                if left == n:
                    del kept[d]
                else:
                    kept[d] = (doc, ids, left - n)
            made += offset > 0

        def drain(least: int) -> Iterator[pa.RecordBatch]:
            rows: list = []
            while packer.tokens > least:
                place(rows)
                if len(rows) >= 1000:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

        new: list = []
        new_tokens = 0
        for b in batches:
            for doc, text, no_loss in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                ids = text_ids(text.as_py(), path, cache_entries) + end
                n = len(ids) // 4
                if not n:
                    continue
                kept[number] = (doc, ids, n)
                new.append((number, n, max(0, no_loss or 0)))
                number += 1
                new_tokens += n
                if packer.tokens + new_tokens > pool_tokens:
                    packer.extend(new)
                    new, new_tokens = [], 0
                    yield from drain(max(pool_tokens // 4, max_tokens))
        packer.extend(new)
        yield from drain(0)

    no_loss = F.lit(0) if no_loss_col is None else F.col(no_loss_col)
    d = docs.select(F.col(id_col).cast("long").alias("a"), F.coalesce(text_col, F.lit("")).cast("binary").alias("b"),
                    no_loss.cast("long").alias("c"))
    return d.mapInArrow(lean(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
