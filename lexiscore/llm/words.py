"""Words, word hashes and shingles of whole texts, in numpy.

A word is a run of letters and digits after Unicode lower-casing; every character beyond ASCII counts as a letter. Hashes
have 64 bits, depend on nothing but the word, and so are equal on every executor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from lexiscore.session import ship_package

SLICE_BYTES = 1 << 20
ARROW_BYTES = 4 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_BASE, SLICE_BYTES)
_INVERSES = _powers(_INVERSE, SLICE_BYTES)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal spans have equal hashes wherever they stand.

    Spans are sorted and may not overlap in time order; they are taken in runs of about ``SLICE_BYTES`` bytes, so memory
    follows that bound and not the text.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
        high = int(ends[i:j].max())
        n = high - low
        powers, inverses = (_POWERS, _INVERSES) if n <= SLICE_BYTES else (_powers(_BASE, n), _powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[low:high]] * powers[:n], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * inverses[np.minimum(a, n - 1)] + (b - a).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, starts and ends of their words, and the first word of each text (one more than texts)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    edges = np.diff(IS_WORD[data].astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return data, starts, ends, first


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each text (one more than texts)."""
    data, starts, ends, first = word_spans(texts)
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words, sorted. Fewer words, but some, are one shingle; none give none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total = total * U64(0x9FB21C651E98DF25) + words[j : j + n]
    return np.unique(mix(total))


def bound_batches(spark: SparkSession) -> None:
    """Give executors the package, and have rows reach Python in batches of about ``ARROW_BYTES`` (or fewer, if the session says so), and one row at least.

    Spark's own bound is 64 MB, of which a worker holds several copies. The setting is the session's, as a lazy result needs
    it when it is computed.
    """
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(setting))
    if not now or not 0 < int(now[1]) <= ARROW_BYTES:
        spark.conf.set(setting, str(ARROW_BYTES))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts of a batch, one Python string at a time."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""
