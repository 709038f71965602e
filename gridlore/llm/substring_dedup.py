"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference of a document is every document with a smaller id, in blocks that are indexed each (see
`blocks`). The index answers a window of `window` words with the smallest document, and the first place
in it, where that word sequence starts. The parse reads a document from left to right: a factor begins
at the first word not parsed yet that begins an indexed window, and goes on as long as the windows go on
at the same places of the same reference document. Windows over a factor's boundary are looked up as any
other; where such a window repeats another place, the words that it has beyond the boundary are a factor
of their own, shorter than a window. So factors are sufficiently long unless they lengthen one before
them, and the words in factors are exactly those in repeated windows: they are what is removed.

A factor that another document of the reference would carry further is cut where the smallest document
changes, so factors are greedy in the smallest reference, not longest over all references.

Edge cases: a null text has no words; a null doc_id neither is a reference nor loses words; rows with
equal ids do not see each other (a factor's place is in one of them); words are runs of anything but
\\x20 and \\x09-\\x0D; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlore.llm.blocks import BLOCK_BYTES, TREE, Block, repeated_windows, rows_of
from gridlore.llm.hashing import cover

RESULT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:long,length:long,source:long,place:long>>"
_FACTORS = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "source", "place")]))


def earlier_in_block(b: Block, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct window the occurrences in its first document are the block's entries; those in later documents are repeats of its first one."""
    at = np.flatnonzero(b.valid)
    order = np.argsort(b.windows[at], kind="stable")
    at = at[order]
    h = b.windows[at]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    doc = b.doc_of(at)
    of = np.cumsum(new) - 1
    source, place = b.ids[doc][new][of], (at - b.first[doc])[new][of]
    late = ~new & (b.ids[doc] > source)
    repeated, source, place = at[late], source[late], place[late]
    order = np.argsort(repeated)
    entries = at[~late]
    return np.sort(entries[shared[entries]]), repeated[order], source[order], place[order]


def parse(starts: np.ndarray, sizes: np.ndarray, sources: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, source and place of the factors, from runs of windows (by start) that repeat one document at consecutive places."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + sizes[:-1]) | (sources[1:] != sources[:-1]) | (places[1:] - starts[1:] != places[:-1] - starts[:-1])
    begin = np.flatnonzero(new)
    end = starts + sizes - 1 + window
    last = end[np.append(begin[1:], len(starts)) - 1]
    done = np.concatenate((starts[:1], last[:-1]))  # runs' ends go up with their starts
    start = np.maximum(starts[begin], done)
    some = last > start
    return start[some], (last - start)[some], sources[begin][some], (places[begin] + start - starts[begin])[some]


def substring_dedup(docs: DataFrame, window: int = 13, anchor: int = 7, block_bytes: int = BLOCK_BYTES, tree: int = TREE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by a space) and the factors (start and length in words, source document and place in it)."""

    def finish(table: pa.Table, *runs) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string()), "factors": pa.array([], _FACTORS)})
        _, ids, known, texts = rows_of(table)
        split = [x.split() for x in texts]
        first = np.concatenate(([0], np.cumsum([len(x) for x in split])))
        start, length, source, place = parse(*runs, window)
        gone = cover(start, start + length, int(first[-1]))
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[first[1:]] - total[first[:-1]]
        at = np.searchsorted(start, first)
        kept, found = [], []
        for i, x in enumerate(split):
            a, b = at[i], at[i + 1]
            found.append([{"start": s, "length": n, "source": d, "place": p} for s, n, d, p in zip((start[a:b] - first[i]).tolist(), length[a:b].tolist(), source[a:b].tolist(), place[a:b].tolist(), strict=True)])
            if removed[i]:
                stay = ~gone[first[i] : first[i + 1]]
                x = [w for w, k in zip(x, stay.tolist(), strict=True) if k]
            kept.append(b" ".join(x))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~known),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "factors": pa.array(found, _FACTORS),
        })

    return repeated_windows(docs, window=window, anchor=anchor, words=True, earlier=True, local=earlier_in_block, finish=finish, schema=RESULT, block_bytes=block_bytes, tree=tree)
