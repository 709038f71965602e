"""Byte-level dedup by suffix arrays.

A shard is a block of documents (see `blocks`). Its suffix array is built over the shard's candidate
regions, the bytes of every window that the content-defined anchors do not rule out as unique, by
Larsson-Sadakane refinement; Kasai's algorithm gives the common prefixes of neighbours, and windows
with a common prefix of the whole length are repeated in the shard. Across shards, one occurrence of
each distinct window that shares an anchor with another shard goes into the shards' lists; the lists are
sorted by the windows' hashes (not by their bytes, which would be 200 times the text) and merged by
binary search.

Edge cases: a null text is empty; matches never cross documents; copies and repeated rows count as
elsewhere; rows with a null doc_id take part and keep it; kept bytes may end inside a character, so they
are binary; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlore.llm.blocks import BLOCK_BYTES, TREE, Block, repeated_windows, rows_of
from gridlore.llm.hashing import Texts, cover, runs

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's rank; with `depth`, in order of their first `depth` bytes at least.

    Larsson-Sadakane: suffixes are sorted by eight bytes; then groups that still are equal are sorted
    by the group of the suffix h bytes on, with h doubling; groups of one are never touched again. Of
    those equal to the text's end the shorter comes first. `common_prefixes` needs the whole order: with
    ties left at a depth, the suffixes one byte on need not be neighbours in the same way.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while depth is None or h < depth:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        s = sa[at]
        on = np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + h + 1, n - s)
        pair = rank[s] * (n + h + 1) + on
        order = np.argsort(pair)
        s, pair = s[order], pair[order]
        sa[at] = s
        fresh = np.ones(len(at), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[at] = fresh
        rank[s] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        h *= 2
    rank[sa] = np.arange(n)
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Kasai: for each position in the text its common prefix, up to cap, with the suffix before it in order.

    The text is cut into lanes that advance side by side; in each, a position's prefix is at least
    that of the position before it less one.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    step = max(1, -(-n // lanes))
    at = np.arange(0, n, step)
    stop = np.minimum(at + step, n)
    h = np.zeros(len(at), np.int64)
    padded = np.append(text, np.uint8(0))
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[:1]] = n
    while len(at):
        j = before[at]
        x, y = at + h, j + h
        same = (h < cap) & (x < n) & (y < n)
        same &= padded[np.minimum(x, n)] == padded[np.minimum(y, n)]
        h += same
        on = ~same
        out[at[on]] = h[on]
        at = at + on
        np.subtract(h, on, out=h)
        np.maximum(h, 0, out=h)
        live = at < stop
        if not live.all():
            at, stop, h = at[live], stop[live], h[live]
    return out


def repeated_in_shard(b: Block, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One occurrence of each distinct window that is shared with other shards, and all that are repeated in this one."""
    none = np.zeros(0, np.int64)
    at = np.unique(b.place[b.valid])
    _, back, count = np.unique(b.anchors[at], return_inverse=True, return_counts=True)
    twice = np.zeros(len(b.anchors), bool)
    twice[at] = count[back] > 1
    here = b.valid & twice[b.place]
    wanted = np.flatnonzero(here | shared)
    if not len(wanted):
        return none, none, none, none
    held = np.flatnonzero(cover(wanted, wanted + window, len(b.texts.buf)))
    text = b.texts.buf[held]
    sa, rank = suffix_array(text)
    prefix = common_prefixes(text, sa, rank, window)
    starts = np.zeros(len(held), bool)
    starts[np.searchsorted(held, wanted)] = True
    full = prefix[sa] >= window
    full[0] = False
    group = np.cumsum(~full)
    mine = starts[sa]
    s, g = sa[mine], group[mine]
    first = np.ones(len(s), bool)
    first[1:] = g[1:] != g[:-1]
    lone = first & np.append(first[1:], True)
    again = np.sort(held[s[~lone]])
    one = held[s[first]]
    return np.sort(one[shared[one]]), again, np.zeros(len(again), np.int64), again


def suffix_array_dedup(docs: DataFrame, window: int = 200, anchor: int = 64, block_bytes: int = BLOCK_BYTES, tree: int = TREE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary): every byte in a `window`-byte string that starts anywhere else too goes."""

    def finish(table: pa.Table, starts, sizes, *_) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        _, ids, known, docs_ = rows_of(table)
        texts = Texts(docs_)
        gone = cover(starts, starts + sizes - 1 + window, len(texts.buf))
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[texts.ends] - total[texts.starts]
        spans, kept = [], []
        for i, x in enumerate(docs_):
            if removed[i]:
                cut = gone[texts.starts[i] : texts.ends[i]]
                spans.append(len(runs(cut)[0]))
                x = texts.buf[texts.starts[i] : texts.ends[i]][~cut].tobytes()
            else:
                spans.append(0)
            kept.append(x)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~known),
            "n_bytes": pa.array(texts.ends - texts.starts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        })

    return repeated_windows(docs, window=window, anchor=anchor, words=False, earlier=False, local=lambda b, shared: repeated_in_shard(b, shared, window), finish=finish, schema=RESULT, block_bytes=block_bytes, tree=tree)
