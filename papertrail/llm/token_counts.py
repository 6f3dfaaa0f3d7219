"""Exact token counts by a map-side two-tier lookup.

A text falls into pieces: a run of ASCII white space with the chunk that
follows it.  Byte-level BPE never merges across the start of such a run,
so the text's token count is the sum of its pieces' counts.

* Tier 1: a dictionary of the most frequent pieces and their lengths, at
  most ``top`` entries whatever the corpus, broadcast once.  The pieces of
  all rows are counted for it, unless ``sample_rows`` says how many will
  do; it decides speed only, never a result.
* Tier 2: a cache in each Python worker, emptied when it holds
  ``cache_entries`` pieces; what it misses is encoded by the library.

Texts holding a special token's opening or white space beyond ASCII (where
a run could cross a piece) are encoded whole by the library.  Only the
counts of different pieces are shuffled, never texts or rows.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null id
and repeated rows give a row each; other columns are ignored; an empty
table gives an empty result; a very long text is one piece list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import discard, kept, sampled, stored

TOP = 1 << 16
CACHE_ENTRIES = 1 << 19
HELD_BYTES = 1 << 26  # text that a task counts between two partial results

_PIECE = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+")
_SPACE = b" \t\n\r\x0b\x0c"
# a special token's opening; then the white space that is not ASCII, as UTF-8
_WHOLE = re.compile(rb"<\||[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

_WORKER = kept("tokenizers")  # per Python worker: tokenizers and caches, by file


def load_tokenizer(path: str):
    """The tokenizer of a file, once per Python worker."""
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _WORKER[path] = (tok, {})
    return _WORKER[path]


def pieces_of(text: bytes) -> list[bytes]:
    found = _PIECE.findall(text)
    tail = len(text) - len(text.rstrip(_SPACE))
    if tail:
        found.append(text[-tail:])
    return found


def encode_all(tok, texts: list[str]) -> list:
    return tok.encode_batch_fast(texts, add_special_tokens=False)


def count_tokens(text: bytes, frequent: dict, path: str, cache_entries: int = CACHE_ENTRIES) -> int:
    tok, cache = load_tokenizer(path)
    if _WHOLE.search(text):
        return len(tok.encode(text.decode(), add_special_tokens=False).ids)
    pieces = pieces_of(text)
    got = list(map(frequent.get, pieces))
    if None not in got:
        return sum(got)
    total = sum(filter(None, got))
    missed = [p for p, n in zip(pieces, got) if n is None]
    new = list({p for p in missed if p not in cache})
    if new:
        if len(cache) + len(new) > cache_entries:
            cache.clear()
            new = list(set(missed))
        cache.update(zip(new, map(len, encode_all(tok, [p.decode() for p in new]))))
    return total + sum(map(cache.__getitem__, missed))


def frequent_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP,
                    sample_rows: int | None = None) -> dict[bytes, int]:
    """At most ``top`` pieces, the most frequent of all rows or of about
    ``sample_rows``, with lengths; of the last equally frequent ones that would
    exceed ``top``, none.  Tasks pass on partial counts whenever they hold many, so
    nothing is dropped before the sums are known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held = 0

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                             ["piece", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if not _WHOLE.search(t):
                    seen.update(pieces_of(t))
                    held += len(t)
                    if len(seen) > 4 * top or held > HELD_BYTES:
                        yield counted()
                        held = 0
        yield counted()

    rows = docs if sample_rows is None else sampled(docs, [id_col, text_col], sample_rows)
    rows = rows.select(F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    counts = rows.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = stored(counts, "piece-counts")
    # how many pieces have each count: the driver gets no more than the table's own entries
    least, total = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).limit(top).collect():
        total += r["m"]
        if total > top:
            break
        least = r["n"]
    best = [] if least is None else [bytes(r["piece"]) for r in counts.filter(F.col("n") >= least).collect()]
    discard(counts)
    tok, _ = load_tokenizer(path)
    return dict(zip(best, map(len, encode_all(tok, [p.decode() for p in best]))))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP,
                 sample_rows: int | None = None, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Per row: the id column, n_bytes and n_tokens."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, id_col, text_col, top, sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = table.value
        for b in batches:
            texts = b.column(1)
            n_tokens = [count_tokens(t.as_py(), frequent, path, cache_entries) for t in texts]
            n_bytes = [len(t.as_buffer()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             [id_col, "n_bytes", "n_tokens"])

    d = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).cast("binary").alias("_text"))
    kind = d.schema[id_col].dataType.simpleString()
    return d.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
