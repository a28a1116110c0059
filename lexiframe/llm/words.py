"""Words and hashes inside tasks: ASCII case and white space only, as in ``common.WORD``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64
_STEP = 0x9E3779B97F4A7C15


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text (A-Z only; bytes methods know ASCII alone)."""
    return text.lower().split() if text else []


def texts_of(column) -> list[bytes | None]:
    """Values of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def coded_words(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of an Arrow string column, the place among them of every word, and the words per text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(column.fill_null("")))
    lists = pc.ascii_split_whitespace(texts)
    sizes = np.where(pc.equal(pc.binary_length(texts), 0), 0, pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    if len(flat) > sizes.sum():  # a text without words gives one empty string
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), sizes


def text_slices(batch, name: str, most_bytes: int, most_rows: int = 1 << 30):
    """Slices of a batch with about so many bytes in a text column, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))), at + most_rows)
        yield batch.slice(at, stop - at)
        at = stop


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit mixing of uint64 values."""
    x = values + np.uint64(_STEP * (salt + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words.

    Fewer words are one run of their own; no words give no run.
    """
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    width = min(width, len(words))
    last = len(words) - width + 1
    runs = np.full(last, width, np.uint64)
    for i in range(width):
        runs = mixed(runs ^ hashes[i : i + last])
    runs.sort()
    return runs[np.concatenate(([True], runs[1:] != runs[:-1]))]


class WordIds(dict):
    """Number of a word below ``buckets`` by its hash; forgets all when it has grown large."""

    def __init__(self, buckets: int, most: int = 1 << 19):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) % self.buckets
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
