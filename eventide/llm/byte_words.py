"""Words of many texts at once, on Arrow buffers.

All separators of the word rules used here are ASCII, so a rule is a table of 256 bytes: what each byte of the UTF-8 text becomes.
Bytes that separate words become blanks; the text is then cut at blanks and its distinct words are coded, all inside Arrow.
Non-ASCII bytes always stay, so the mapped bytes are valid UTF-8 again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and rows of text that are handled together; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096


def byte_rule(separators: bytes, breaks: bytes = b"") -> bytes:
    """A-Z become a-z, ``separators`` blanks and ``breaks`` line ends; all other bytes stay."""
    rule = bytearray(bytes(range(256)).lower())
    for b in separators:
        rule[b] = 32
    for b in breaks:
        rule[b] = 10
    return bytes(rule)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows and bytes of ``column``."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = done = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(sizes, done + most, "right"))
            last = max(first + 1, min(last, first + SLICE_ROWS))
            yield batch.slice(first, last - first)
            first, done = last, int(sizes[last - 1])


def mapped(texts: pa.Array, rule: bytes) -> pa.Array:
    """The texts with every byte replaced by the rule; a null text becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    raw = data.to_pybytes() if data is not None else b""
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(raw.translate(rule))], offset=texts.offset)


def coded_words(texts: pa.Array, rule: bytes, breaks: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per word in the order of the texts: the row it stands in, and its code in the returned distinct words.

    With ``breaks`` each line end is a word of its own.
    """
    plain = mapped(texts, rule)
    if breaks:
        plain = pc.replace_substring(plain, "\n", " \n ")
    cut = pc.split_pattern(plain, " ")
    coded = pc.dictionary_encode(cut.flatten())
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(cut.offsets.to_numpy()))
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        rows, codes = rows[keep], codes[keep]
    return rows, codes, distinct
