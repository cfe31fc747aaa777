"""Words of whole Arrow text columns, as numbers."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text cut into words at once; a longer text is cut alone.
BATCH_BYTES = 4 << 20


def byte_slices(column, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """``(start, rows)`` of consecutive slices of a text column with about ``limit`` bytes each."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for row, n in enumerate(size.tolist()):
        if held and held + n > limit:
            yield start, row - start
            start, held = row, 0
        held += n + 1
    if start < len(size):
        yield start, len(size) - start


def cut_words(column, table: bytes | None = None):
    """The maximal runs of bytes that are not white space (space, U+0009 to U+000D) in a text column without nulls, after
    ``table`` has replaced each byte by another: the words as an Arrow array, their number in each row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_string())
    if table is not None:
        places, said = column.buffers()[1:]
        places = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
        said = b"" if said is None else said.slice(places[0], places[-1] - places[0]).to_pybytes().translate(table)
        column = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(places - places[0]), pa.py_buffer(said)])
    lists = pc.ascii_split_whitespace(column)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    count = np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(column))
    return words.filter(real), count


def numbered(words):
    """The words as numbers, and the distinct words in the order of these numbers."""
    import numpy as np

    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
