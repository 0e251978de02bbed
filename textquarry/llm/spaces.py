"""Texts as chunks that begin at single spaces, so that what depends on a chunk alone is computed once per distinct chunk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the sense of Unicode before a space: where a text has it, spaces do not begin chunks by themselves.
RUN = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def space_chunks(texts: pa.Array, odd: str = RUN) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """(distinct chunks, how many of them begin with a space, each text's chunks in order by number, where each text's end).

    A chunk is a space and all up to the next one. First come the distinct ones of all texts, then one for each text: what
    stands before its first space, or all of it if it matches `odd`.
    """
    strange = pc.match_substring_regex(texts, odd)
    lists = pc.split_pattern(pc.if_else(strange, pa.scalar("", texts.type), texts), " ")
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    parts = lists.flatten()
    heads = ends - counts
    first = pc.if_else(strange, texts, parts.take(pa.array(heads)))
    coded = parts.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    codes[heads] = len(coded.dictionary) + np.arange(len(texts))
    spaced = pc.binary_join_element_wise("", coded.dictionary, " ")
    return spaced.to_numpy(zero_copy_only=False).tolist() + first.to_numpy(zero_copy_only=False).tolist(), len(spaced), codes, ends


def laid_out(known: list[bytes] | pa.LargeBinaryArray, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """What is known of each chunk, end to end in the order of codes, and where (in bytes) each one's part ends."""
    taken = (pa.array(known, type=pa.large_binary()) if isinstance(known, list) else known).take(pa.array(codes))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(codes) + 1)
    return memoryview(taken.buffers()[2] or b"")[: offsets[-1]], offsets[1:]
