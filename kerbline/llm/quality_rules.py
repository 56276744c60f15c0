"""Quality rules by compression bands.

A text that repeats itself compresses far better than prose of its length, and
random bytes hardly compress at all.  The rule compresses each whole document
and each of its fixed chunks with zstandard and rejects it when a ratio leaves
the band for its length.  A tail shorter than a chunk is judged as the last full
chunk that ends with the text.  Plain counts (symbols, repeated lines, words inside
repeated five-word windows) come with it.

Null and empty texts have no words, so the base rule fails them; a repeated row
gets the same verdict each time; a document of any length is used whole.  Of
several reasons the first in the order of tests is named.  An empty table gives
an empty one.  The result's column replaces one of that name, others pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.arrow import bound_batches, text_struct

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Allowed ratios (bytes in / bytes out) by length.

    ``from_bytes[i]`` is where band i begins; below the first no ratio is judged,
    as the frame's own bytes dominate there.
    """

    from_bytes: tuple[int, ...] = (192, 512, 1024, 4096, 16384)
    least: tuple[float, ...] = (0.95, 1.1, 1.2, 1.3, 1.35)
    most: tuple[float, ...] = (2.4, 2.6, 2.8, 3.0, 3.3)
    chunk_bytes: int = 4096
    chunk_least: float = 1.2
    chunk_most: float = 3.5
    level: int = 3


DEFAULT_BANDS = Bands()

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, chunk_ratio_min double, chunk_ratio_max double, base_failed boolean, reason string, kept boolean"
)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside any window of ``window`` words that occurs at least twice, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        mixed = (mixed ^ seq[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(mixed, twice))
    exact = Counter(tuple(seq[i : i + window].tolist()) for i in starts)  # the mix only proposes
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in starts:
        if exact[tuple(seq[i : i + window].tolist())] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def judge(bands: Bands = DEFAULT_BANDS):
    """A function text -> tuple of FIELDS, with its own compressor."""
    compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)

    def ratio(data: bytes) -> float:
        return len(data) / len(compressor.compress(data))

    def one(text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        n_words = len(words)
        word_chars = len(text) - sum(map(text.count, SPACE))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        repeats = repeated_words(words)
        base_failed = n_words < 10 or 100 * repeats > 20 * n_words
        whole = low = high = None
        reason = "base" if base_failed else None
        if data:
            size = bands.chunk_bytes
            whole = ratio(data)
            parts = [ratio(data[i : i + size]) for i in range(0, max(1, len(data) - size + 1), size)]
            if len(data) > size and len(data) % size:
                parts.append(ratio(data[-size:]))  # the tail, as a chunk of full length
            low, high = min(parts), max(parts)
            band = bisect_right(bands.from_bytes, len(data)) - 1
            if reason is None and band >= 0:
                if whole > bands.most[band]:
                    reason = "repetitive"
                elif whole < bands.least[band]:
                    reason = "incompressible"
                elif len(data) >= size and high > bands.chunk_most:
                    reason = "repetitive chunk"
                elif len(data) >= size and low < bands.chunk_least:
                    reason = "incompressible chunk"
        return (
            n_words, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats,
            whole, low, high, base_failed, reason, reason is None,
        )

    return one


def compression_bands(docs: DataFrame, text_col: str = "text", out: str = "rules", bands: Bands = DEFAULT_BANDS) -> DataFrame:
    """Every row of ``docs`` with a struct column ``out``: the counts, the ratios, the verdict and its reason.

    One map over the scan, no shuffle.  An existing column named ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, text_struct(FIELDS, lambda: judge(bands))(F.col(text_col).cast("string")))
