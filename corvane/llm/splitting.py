"""Splitting oversized items at natural boundaries, by pointer doubling.

An item is cut into *atoms*: its lines, where a line that is too long for one piece with its
overlap is cut further, at sentence ends or spaces if there are any. A boundary is the start of an
atom. Each boundary has one successor: the boundary at which a piece that begins there, with its
overlap, has to end at the latest, moved back to a better place (before a blank line, a line of
least indentation or the end of a sentence) if one lies in the second half of the piece. The
table of successors of all boundaries is made at once by a search in the running lengths, then
squared again and again; the set of boundaries reachable from the first one doubles its reach
with each square. After log2(n) squares it holds all cuts, without walking from cut to cut.

The items stay rows of a DataFrame: limits are joined by type, only items over their limit go to
Python, in Arrow batches, and their pieces come back. The text of an item is read once and each
piece holds its own part only, so the work grows with the text however many pieces it gives. The
one shuffle takes out rows that repeat a chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import bounded_broadcast, ship_package, spread

_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_PIECES = (
    "array<struct<piece_no:int,start_char:int,end_char:int,overlap_chars:int,"
    "first_line:int,last_line:int,content:string>>"
)


def _atoms(text: str, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each atom, its line number from 0, and whether it continues a line.

    No atom is longer than ``room``.
    """
    starts, lines, inner = [], [], []
    for n, m in enumerate(_LINE.finditer(text)):
        a, b = m.span()
        starts.append(a)
        lines.append(n)
        inner.append(False)
        while b - a > room:
            part = text[a : a + room]
            cut = max(part.rfind(c) for c in (". ", "! ", "? ", "; "))
            cut = cut + 2 if cut >= room // 2 else part.rfind(" ") + 1
            a += cut if cut > room // 2 else room
            starts.append(a)
            lines.append(n)
            inner.append(True)
    return np.array(starts), np.array(lines), np.array(inner, dtype=bool)


def _strength(text: str, starts: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """How good it is to cut before each atom: 3 after a blank line, 2 before a line that is
    indented least or after a sentence, 1 before any other line, 0 within a line."""
    out = np.where(inner, 0, 1)
    ends = np.append(starts[1:], len(text))
    indent = []
    blank = []
    for a, b in zip(starts, ends):
        line = text[a:b]
        body = line.lstrip()
        blank.append(not body)
        indent.append(len(line) - len(body) if body else 1 << 20)
    least = min((x for x, skip in zip(indent, inner) if not skip), default=0)
    for i in range(1, len(starts)):
        if inner[i]:
            continue
        if blank[i - 1] and not blank[i]:
            out[i] = 3
        elif indent[i] == least or text[max(0, starts[i] - 3) : starts[i]].rstrip()[-1:] in (".", "!", "?", "}"):
            out[i] = 2
    return out


def split_positions(
    text: str, max_chars: int, overlap_lines: int, overlap_chars: int
) -> list[tuple[int, int, int, int, int, int]]:
    """(piece, start, end, overlap, first line, last line) of each piece of one text.

    Positions are code points, ends exclusive, lines count from 0. Consecutive pieces repeat
    ``overlap_lines`` whole lines of the piece before; if these with the next line exceed the
    limit, or the cut lies within a line, they repeat ``overlap_chars`` characters. An overlap is
    never as long as the piece before. A text within the limit is one piece, an empty one none.
    """
    size = len(text)
    if not size:
        return []
    max_chars = max(1, max_chars)
    overlap_chars = max(0, min(overlap_chars, max_chars // 2))
    if size <= max_chars:
        return [(0, 0, size, 0, 0, max(0, text.count("\n", 0, size - 1)))]
    starts, lines, inner = _atoms(text, max_chars - overlap_chars)
    n = len(starts)
    ends = np.append(starts[1:], size)
    # Where a piece that begins with atom i really starts: with the overlap before it.
    back = np.arange(n) - max(0, overlap_lines)
    whole = starts[np.maximum(back, 0)]
    crosses = np.zeros(n, dtype=bool)
    for k in range(max(0, overlap_lines)):
        j = np.arange(n) - k
        crosses |= (j >= 0) & inner[np.maximum(j, 0)]
    by_lines = (back >= 1) & ~crosses & (ends - whole <= max_chars)
    begin = np.where(by_lines, whole, np.maximum(starts - overlap_chars, 0))
    if overlap_lines <= 0:
        begin = np.where(inner, begin, starts)
    begin[0] = 0
    # The farthest boundary at which a piece from each boundary may end.
    far = np.searchsorted(ends, begin + max_chars, side="right")
    far = np.maximum(far, np.arange(n) + 1)
    strength = np.append(_strength(text, starts, inner), 9)
    nxt = far.copy()
    for level in (1, 2, 3):  # the best level that occurs in the second half wins
        last = np.maximum.accumulate(np.where(strength >= level, np.arange(n + 1), 0))[far]
        ok = (last > np.arange(n)) & (np.append(starts, size)[last] - begin >= max_chars // 2)
        ok &= far < n
        nxt = np.where(ok, last, nxt)
    # Pointer doubling: reach after 1, 2, 4, ... steps; n stands for the end.
    succ = np.append(nxt, n)
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = True
    for _ in range(int(n).bit_length()):
        reached[succ[reached]] = True
        succ = succ[succ]
    cuts = np.flatnonzero(reached[:n])
    stop = np.append(cuts[1:], n)
    out = []
    for k, (i, j) in enumerate(zip(cuts, stop)):
        a = int(begin[i])
        if k:  # never repeat the whole piece before
            a = max(a, out[-1][1] + 1)
        b = int(ends[j - 1])
        first = int(lines[np.searchsorted(starts, a, side="right") - 1])
        out.append((k, a, b, int(starts[i]) - a, first, int(lines[j - 1])))
    return out


_FIELDS = ("piece_no", "start_char", "end_char", "overlap_chars", "first_line", "last_line")


def _pieces_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(
            [
                [dict(zip(_FIELDS, p)) | {"content": text[p[1] : p[2]]} for p in split_positions(text, int(limit), int(by_lines), int(by_chars))]
                for text, limit, by_lines, by_chars in zip(*batch)
            ]
        )


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunks`` with the columns ``max_chars, overlap_lines, overlap_chars`` of their type.

    The type is taken trimmed and in lower case; null and unknown types take the row ``default``
    of ``limits``. Without such a row they have null limits. Several rows for one type in
    ``limits`` count as the strictest.
    """
    by_type = limits.groupBy(F.lower(F.trim("chunk_type")).alias("__type")).agg(
        F.min("max_chars").alias("max_chars"),
        F.min("overlap_lines").alias("overlap_lines"),
        F.min("overlap_chars").alias("overlap_chars"),
    )
    row = F.struct("max_chars", "overlap_lines", "overlap_chars")
    named = by_type.select("__type", row.alias("__own"))
    other = by_type.where(F.col("__type") == "default").select(row.alias("__other"))
    rest = [c for c in chunks.columns if c not in ("max_chars", "overlap_lines", "overlap_chars")]
    joined = chunks.withColumn("__type", F.lower(F.trim("chunk_type"))).join(
        bounded_broadcast(named), "__type", "left"
    )
    default = other.collect()  # one row at most: grouped by type
    fallback = [
        F.lit(default[0]["__other"][c] if default else None).cast("int")
        for c in ("max_chars", "overlap_lines", "overlap_chars")
    ]
    return joined.select(
        *[F.col(f"`{c}`") for c in rest],
        *[
            F.coalesce(F.col("__own")[c], fallback[i]).alias(c)
            for i, c in enumerate(("max_chars", "overlap_lines", "overlap_chars"))
        ],
    )


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of all chunks whose content is longer than its type allows.

    Result: ``chunk_id, content_hash, piece_no, n_pieces, start_char, end_char, overlap_chars,
    start_line, end_line, content``; the hash is that of the whole content, positions are code points from 0, lines are those of the file if the
    chunk has a start_line, else null. Rows that repeat a chunk give the same pieces once if they
    agree in content and position. Null contents and null limits give no pieces. Further columns
    of ``chunks`` are ignored.
    """
    wanted = ("id", "content", "chunk_type", "start_line")
    limited = with_limits(spread(chunks.select(*wanted)), limits).where(
        F.char_length("content") > F.col("max_chars")
    )
    ship_package(chunks.sparkSession)
    find = F.pandas_udf(_pieces_of, _PIECES)
    pieces = limited.select(
        F.col("id").alias("chunk_id"),
        "start_line",
        F.sha2("content", 256).alias("content_hash"),
        find("content", "max_chars", F.coalesce("overlap_lines", F.lit(0)), F.coalesce("overlap_chars", F.lit(0))).alias("pieces"),
    ).select("chunk_id", "start_line", "content_hash", F.size("pieces").alias("n_pieces"), F.explode("pieces").alias("p"))
    return pieces.select(
        "chunk_id",
        "content_hash",
        F.col("p.piece_no").alias("piece_no"),
        "n_pieces",
        F.col("p.start_char").alias("start_char"),
        F.col("p.end_char").alias("end_char"),
        F.col("p.overlap_chars").alias("overlap_chars"),
        (F.col("start_line") + F.col("p.first_line")).alias("start_line"),
        (F.col("start_line") + F.col("p.last_line")).alias("end_line"),
        F.col("p.content").alias("content"),
    ).dropDuplicates(["chunk_id", "content_hash", "piece_no", "start_char", "end_char", "start_line"])
