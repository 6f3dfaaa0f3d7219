"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

A text is cut at two code points into prefix, middle and suffix, which are
put in the order a model learns to fill from: ``psm`` (prefix, suffix,
middle) or ``spm`` (suffix, prefix, middle), each after its mark; the rest
of the texts stay ``plain``.

Texts stay UTF-8 bytes.  :class:`Exceptions` records only the multibyte
characters of an Arrow slice: where each begins and how many bytes it has
beyond one.  A cut is then converted between code points and bytes by one
``searchsorted`` in that index and an addition; a stretch of ASCII, however
long, costs nothing but arithmetic.  Pieces and outputs are cut and joined
as Arrow arrays over the slice's own buffer, without a loop over rows.

The draws depend on the seed and the id alone, so a retried task makes the
same rows.  Nothing is shuffled.  A slice holds about 4 MB of text; a longer
text is a slice of its own.

Defined cases: a null or empty text is empty and plain; a null id draws as
an empty id and is carried; repeated rows give a row each; a text holding a
mark is plain, since it could not be taken apart again; other columns are
ignored unless named in ``carry``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.wordhash import slices

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle


class Exceptions:
    """The multibyte characters of concatenated UTF-8 texts.

    ``ends``: byte offsets of the texts in ``data`` (the first begins at
    ``ends[0]``).  ``at`` holds the byte position of every character of
    more than one byte, ``excess[k]`` the bytes beyond one of the first ``k``
    of them, ``point`` their code points' positions.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0).astype("int64")
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype("int64") + (lead >= 0xF0))])
        self.point = self.at - self.excess[:-1]
        self.first = self.points(ends[:-1])  # code point at which each text begins
        self.length = self.points(ends[1:]) - self.first

    def points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before byte offsets (at character boundaries)."""
        return byte - self.excess[np.searchsorted(self.at, byte, "left")]

    def bytes(self, point: np.ndarray) -> np.ndarray:
        """Byte offsets of code points."""
        return point + self.excess[np.searchsorted(self.point, point, "left")]

    def floor(self, byte: np.ndarray) -> np.ndarray:
        """Byte offsets moved back to the beginning of their character."""
        k = np.searchsorted(self.at, byte, "left") - 1
        if not len(self.at):
            return byte
        last = np.maximum(k, 0)
        inside = (k >= 0) & (byte <= self.at[last] + self.excess[last + 1] - self.excess[last])
        return np.where(inside, self.at[last], byte)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """(bytes, offsets of the texts, the Arrow buffer) of a non-null binary
    array, all counted from the first text's beginning."""
    _, ends, data = texts.buffers()
    kind = "int64" if pa.types.is_large_binary(texts.type) else "int32"
    at = np.frombuffer(ends, kind)[texts.offset:texts.offset + len(texts) + 1].astype("int64")
    data = data.slice(at[0], at[-1] - at[0]) if data is not None else pa.py_buffer(b"")
    return np.frombuffer(data, "uint8"), at - at[0], data


def cut(texts: pa.Array, draws: np.ndarray, fim_rate: int, spm_rate: int, marks: Sequence[str], unit: str) -> dict:
    """Columns of :func:`fill_in_middle` for one slice; ``draws`` has four rows."""
    data, ends, buffer = _buffer(texts)
    index = Exceptions(data, ends)
    n = index.length
    size = (n if unit == "char" else np.diff(ends)) + 1
    low, high = np.minimum(draws[0] % size, draws[1] % size), np.maximum(draws[0] % size, draws[1] % size)
    if unit == "char":
        low, high = index.bytes(index.first + low), index.bytes(index.first + high)
    else:
        low, high = index.floor(ends[:-1] + low), index.floor(ends[:-1] + high)
    marked = np.zeros(len(texts), bool)
    for m in marks:
        marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (draws[2] % 100 >= fim_rate)
    spm = draws[3] % 100 < spm_rate
    # prefix, middle and suffix of each text are neighbours in the buffer
    at = np.append(np.column_stack([ends[:-1], low, high]).ravel(), ends[-1])
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 3 * len(texts), [None, pa.py_buffer(at), buffer])
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * len(texts), 3))) for k in range(3))
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in marks)
    none = pa.scalar(b"", pa.large_binary())
    out = pc.if_else(pa.array(spm), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
                     pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    prefix_chars = index.points(low) - index.first
    return {"n": pa.array(n), "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))),
            "prefix_chars": pa.array(prefix_chars, mask=plain),
            "middle_chars": pa.array(index.points(high) - index.first - prefix_chars, mask=plain),
            "output": pc.if_else(pa.array(plain), texts.cast(pa.large_binary()), out)}


def draw(id_col: str, seed: int, k: int) -> Column:
    """The ``k``-th draw of a row: eight hexadecimal digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_rate: int = 90, spm_rate: int = 20,
                   marks: Sequence[str] = MARKS, seed: int = 1, unit: str = "char", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: the id and ``carry`` columns, ``n`` (code points), ``form``,
    ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``.

    ``fim_rate`` per cent of the texts are transformed, ``spm_rate`` per cent
    of these to ``spm``.  Cuts are drawn evenly over the code points
    (``unit="char"``) or over the bytes, moved back to a character's
    beginning (``unit="byte"``); both may fall on the text's ends or together.
    No mark may begin inside another.
    """
    if unit not in ("char", "byte"):
        raise ValueError("unit is 'char' or 'byte'")
    marks = tuple(marks)
    names = [id_col, *carry]
    d = docs.select(F.coalesce(text_col, F.lit("")).cast("binary").alias("_text"),
                    *(draw(id_col, seed, k).alias(f"_h{k}") for k in range(4)),
                    *(F.col(c).alias(f"_key{k}") for k, c in enumerate(names)))
    kinds = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(names, d.schema.fields[5:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 0):
                draws = np.stack([b.column(k).to_numpy() for k in range(1, 5)])
                made = cut(b.column(0), draws, fim_rate, spm_rate, marks, unit)
                made["output"] = made["output"].cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[5:], *made.values()], [*names, *made])

    return d.mapInArrow(run, ", ".join([*kinds, "n long, form string, prefix_chars long, middle_chars long, output string"]))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text of an output: it is taken apart at its marks, which no
    transformed text holds, and put together in reading order."""
    part = F.split(output, "|".join(_quoted(m) for m in marks), -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _quoted(mark: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in mark)
