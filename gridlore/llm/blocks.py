"""Exact detection of repeated windows across a corpus, in blocks.

A table of texts is dealt into reference blocks of a bounded size. Each block is indexed on its
own; blocks learn of each other's windows through a hash-partitioned index, in two rounds:

1. Every window of `window` units has an anchor: the smallest (leftmost) hash of the sub-windows of
   `anchor` units in it. Equal windows have equal anchors, and neighbouring windows mostly share
   one, so the distinct anchors are a small part of the windows. Blocks send their distinct anchors;
   an index bucket answers which of them other blocks have too.
2. Blocks send one occurrence of each window whose anchor is shared, in runs with one anchor: the
   anchor's 64-bit hash once, and 48 bits of each window's. A bucket sorts each block's list, merges the
   lists by binary search and answers which windows also occur elsewhere, and in which smallest document
   at which place.

Nothing is dropped, so the result does not depend on the number of blocks or buckets. A frequent
window costs an entry a block, not one an occurrence: hot passages are aggregated before each
shuffle. From TREE blocks (32 GB of text) on, the blocks fall into about as many groups as a group has blocks: a bucket
then answers in two levels, first for each group and then for the groups, so that a passage that every
block has costs a task the square root of the blocks. Different windows are taken for equal only if they have one anchor and 48 bits collide, or if
the 64-bit keys made of both do (about n**2 / 2**65 pairs of n shared windows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import column_bytes, total_bytes
from gridlore.llm.hashing import BASE, Texts, grams, inside, isin_sorted, leftmost_minimum, mix

#: Octets of text a block holds on average, and the least number of blocks.
BLOCK_BYTES = 2 << 20
LEAST_BLOCKS = 48

#: Blocks from which buckets answer in two levels. Each level is told of all shared windows again, so it is worth its disk
#: only where the entries of a passage that all blocks have (some 140 windows an anchor) outgrow a task: here by 14 MB.
TREE = 1 << 14

ANCHORS = "bucket int, block int, hashes binary"
SHARED = "bucket int, block int, hashes binary"
ENTRIES = "bucket int, block int, here boolean, starts binary, sizes binary, docs binary, places binary, anchors binary, hashes binary"
HITS = "block int, starts binary, sizes binary, docs binary, places binary"
UPPER = "bucket int, part int, hashes binary, docs binary, places binary"


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    return max(LEAST_BLOCKS, -(-total_bytes(docs) // block_bytes))


def deal(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text and the block, by a hash of the id (of the text where the id is null)."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"))


@dataclass
class Block:
    """One block's texts in the order of (doc_id, text), its units (words or bytes), windows and anchors."""

    block: int
    ids: np.ndarray
    known: np.ndarray
    texts: Texts
    first: np.ndarray
    last: np.ndarray
    windows: np.ndarray
    valid: np.ndarray
    anchors: np.ndarray
    place: np.ndarray

    def doc_of(self, units: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.last, units, side="right")


def rows_of(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, list[bytes]]:
    """Block, ids (null: largest), which ids are known, and texts, in the order of (doc_id, text)."""
    ids = table.column("doc_id").combine_chunks()
    known = np.asarray(ids.is_valid())
    key = np.asarray(ids.fill_null(np.iinfo(np.int64).max))
    texts = [x for c in table.column("text").chunks for x in column_bytes(c)]
    order = sorted(range(len(texts)), key=lambda i: (key[i], texts[i]))
    return table.column("block")[0].as_py(), key[order], known[order], [texts[i] for i in order]


def open_block(table: pa.Table, window: int, anchor: int, words: bool, by_id: bool) -> Block:
    """by_id: texts without an id have no windows."""
    block, ids, known, docs = rows_of(table)
    texts = Texts(docs)
    if words:
        _, _, h, first = texts.words()
        first, last, n = first[:-1], first[1:], len(h)
        wide, small = grams(h, window), grams(h, anchor)
    else:
        first, last, n = texts.starts, texts.ends, len(texts.buf)
        p = texts.prefixes()
        wide, small = texts.windows(window, p), texts.windows(anchor, p)
    ends = np.where(known, last, first) if by_id else last
    valid = inside(ends, first, window, n)[: len(wide)]
    place = leftmost_minimum(small, window - anchor + 1)
    small = mix(small)  # smallest hashes are small; mixed again, they fall evenly into buckets
    return Block(block, ids, known, texts, first, last, wide, valid, small, place)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _parts(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    if not len(sorted_buckets):
        return []
    cut = np.flatnonzero(np.diff(sorted_buckets)) + 1
    return [(int(sorted_buckets[a]), a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sorted_buckets)], strict=True)]


def send_anchors(b: Block, buckets: int) -> pa.Table:
    h = np.unique(b.anchors[np.unique(b.place[b.valid])])
    parts = _parts(_bucket(h, buckets))
    return pa.table({"bucket": pa.array([x for x, _, _ in parts], pa.int32()), "block": pa.array([b.block] * len(parts), pa.int32()), "hashes": pa.array([h[i:j].tobytes() for _, i, j in parts], pa.binary())})


def _joined(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def merged_order(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values in order, and each one's place in the lists' concatenation: the lists are sorted each, then merged
    two by two by binary search."""
    at, parts = 0, []
    kind = np.uint32 if sum(map(len, lists)) < 1 << 32 else np.int64
    for x in lists:
        order = np.argsort(x)
        parts.append((x[order], (order + at).astype(kind)))
        at += len(x)
    while len(parts) > 1:
        parts.sort(key=lambda p: -len(p[0]))
        some = []
        for (a, i), (b, j) in zip(parts[::2], parts[1::2], strict=False):
            to = np.searchsorted(a, b, side="right") + np.arange(len(b))
            from_b = np.zeros(len(a) + len(b), bool)
            from_b[to] = True
            values, place = np.empty(len(from_b), a.dtype), np.empty(len(from_b), kind)
            values[from_b], place[from_b] = b, j
            np.logical_not(from_b, out=from_b)
            values[from_b], place[from_b] = a, i
            some.append((values, place))
        parts = some + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, kind))


def answer_anchors(table: pa.Table, also: np.ndarray | None = None) -> pa.Table:
    """Of each block's anchors those that another block has too, or that are in `also`."""
    own = _joined(table, "hashes", np.uint64)
    merged, _ = merged_order(own)
    shared = merged[1:][merged[1:] == merged[:-1]]
    shared = np.unique(shared if also is None else np.concatenate((shared, also)))
    kept = [x[isin_sorted(x, shared)] for x in own]
    some = pa.array([i for i, x in enumerate(kept) if len(x)], pa.int64())
    return pa.table({"bucket": table.column("bucket").take(some).cast(pa.int32()), "block": table.column("block").take(some).cast(pa.int32()), "hashes": pa.array([x.tobytes() for x in kept if len(x)], pa.binary())})


def upper_anchors(table: pa.Table) -> pa.Table:
    """A group's different anchors, as those of one block."""
    h = np.unique(np.concatenate([np.zeros(0, np.uint64), *_joined(table, "hashes", np.uint64)]))
    return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()), "block": table.column("part")[:1].cast(pa.int32()), "hashes": pa.array([h.tobytes()][: table.num_rows], pa.binary())})


def shared_windows(b: Block, answers: pa.Table) -> np.ndarray:
    """Which windows have an anchor that another block has."""
    shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *_joined(answers, "hashes", np.uint64)]))
    flag = np.zeros(len(b.anchors), bool)
    at = np.unique(b.place[b.valid])
    flag[at] = isin_sorted(b.anchors[at], shared)
    return b.valid & flag[b.place]


def split_runs(at: np.ndarray, *labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the stretches in which `at` goes up by one and no label changes."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.diff(at) != 1
    for x in labels:
        new |= x[1:] != x[:-1]
    begin = np.concatenate(([0], np.flatnonzero(new) + 1))
    return begin, np.diff(np.append(begin, len(at)))


_ENTRY = {"bucket": pa.int32(), "block": pa.int32(), "here": pa.bool_(), **{k: pa.binary() for k in ("starts", "sizes", "docs", "places", "anchors", "hashes")}}


def send_windows(b: Block, at: np.ndarray, repeated: np.ndarray, sources: np.ndarray, places: np.ndarray, buckets: int) -> pa.Table:
    """Index entries for the windows `at`; `repeated` windows of this block, settled here, go along, with the document and place that they repeat."""
    h = b.anchors[b.place[at]]
    bucket = _bucket(h, buckets)
    order = np.argsort(bucket * (1 << 32) + at)
    at, bucket = at[order], bucket[order]
    doc_of = b.doc_of(at)
    doc, anchor, place = b.ids[doc_of], h[order], at - b.first[doc_of]
    out: dict[str, list] = {k: [] for k in _ENTRY}

    def add(bucket, here, x, ids, place, anchors, hashes):
        begin, size = split_runs(x, ids, x - place, anchors)
        for k, v in zip(out, (bucket, b.block, here, x[begin].astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes(), ids[begin].astype(np.int64).tobytes(), place[begin].astype(np.uint32).tobytes(), anchors[begin].tobytes(), hashes), strict=True):
            out[k].append(v)

    for k, i, j in _parts(bucket):
        add(k, False, at[i:j], doc[i:j], place[i:j], anchor[i:j], b.windows[at[i:j]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
    if len(repeated):
        add(b.block % buckets, True, repeated, sources, places, np.zeros(len(repeated), np.uint64), b"")
    return pa.table({k: pa.array(v, _ENTRY[k]) for k, v in out.items()})


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


@dataclass
class Sent:
    """The windows of the entries of a bucket: each entry's places in its block and its hashes, and over all entries their documents and places in them (if wanted)."""

    rows: list[dict]
    at: list[np.ndarray]
    hashes: list[np.ndarray]
    doc: np.ndarray | None
    place: np.ndarray | None


def read_entries(rows: list[dict], sources: bool) -> Sent:
    at, hashes, doc, place = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for r in rows:
        size = np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
        at.append(_spread(np.frombuffer(r["starts"], np.uint32).astype(np.int64), size).astype(np.uint32))
        if sources:
            place.append(_spread(np.frombuffer(r["places"], np.uint32).astype(np.int64), size).astype(np.uint32))
            doc.append(np.repeat(np.frombuffer(r["docs"], np.int64), size))
        low = np.zeros((len(at[-1]), 8), np.uint8)
        low[:, :6] = np.frombuffer(r.pop("hashes"), np.uint8).reshape(-1, 6)
        h = np.repeat(np.frombuffer(r["anchors"], np.uint64) * np.uint64(BASE), size)
        h += low.view(np.uint64)[:, 0]
        hashes.append(mix(h))
    return Sent(rows, at, hashes, np.concatenate(doc) if sources else None, np.concatenate(place) if sources else None)


def least_sources(order: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest (document, place) of each different hash."""
    if not len(order):
        return doc[:0], place[:0].astype(np.int64)
    doc = doc[order]
    least = np.minimum.reduceat(doc, begin)
    other = doc != np.repeat(least, count)
    del doc
    place = place[order].astype(np.int64)
    place[other] = np.iinfo(np.int64).max
    return least, np.minimum.reduceat(place, begin)


def grouped(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes, the places of all in the lists' concatenation in order of their hash, and where each different one begins there and how often it occurs."""
    h, order = merged_order(lists)
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[begin], order, begin, np.diff(np.append(begin, len(h)))


def upper_windows(table: pa.Table, sources: bool = True) -> pa.Table:
    """A group's different windows, with their smallest (document, place) if sources are wanted."""
    sent = read_entries([r for r in table.to_pylist() if not r["here"]], sources)
    h, order, begin, count = grouped(sent.hashes)
    none = np.zeros(0, np.int64)
    doc, place = least_sources(order, begin, count, sent.doc, sent.place) if sources else (none, none)
    some = slice(0, 1 if len(h) else 0)
    return pa.table({
        "bucket": table.column("bucket")[some].cast(pa.int32()), "part": table.column("part")[some].cast(pa.int32()),
        **{k: pa.array([x.tobytes()][some], pa.binary()) for k, x in (("hashes", h), ("docs", doc), ("places", place))},
    })


def answer_upper(table: pa.Table, earlier: bool) -> pa.Table:
    """Of each group's windows those that another group has too; earlier: in a smaller document, with the smallest (document, place) of all."""
    if not earlier:
        out = answer_anchors(table.rename_columns({"part": "block"})).rename_columns({"block": "part"})
        return out.append_column("docs", pa.array([b""] * out.num_rows, pa.binary())).append_column("places", pa.array([b""] * out.num_rows, pa.binary()))
    own, docs, places = _joined(table, "hashes", np.uint64), _joined(table, "docs", np.int64), _joined(table, "places", np.int64)
    doc, place = np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.int64), *places])
    _, order, begin, count = grouped(own)
    least, at = least_sources(order, begin, count, doc, place)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(begin)), count)
    hit = least[of] < doc
    to, out = 0, {k: [] for k in ("hashes", "docs", "places")}
    for x in own:
        mine = slice(to, to + len(x))
        to += len(x)
        keep = hit[mine]
        for k, v in zip(out, (x[keep], least[of[mine]][keep], at[of[mine]][keep]), strict=True):
            out[k].append(v.tobytes())
    return pa.table({"bucket": table.column("bucket").cast(pa.int32()), "part": table.column("part").cast(pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def answer_windows(table: pa.Table, earlier: bool, upper: pa.Table | None = None) -> pa.Table:
    """Which entries' windows other blocks have too; earlier: only those of a smaller document, which is returned with
    the place in it. upper tells what the other groups have."""
    out: dict[str, list] = {k: [] for k in ("block", "starts", "sizes", "docs", "places")}
    rows = table.to_pylist()
    for r in rows:
        if r["here"]:
            for k in out:
                out[k].append(r[k])
    sent = read_entries([r for r in rows if not r["here"]], earlier)
    del rows
    if sent.rows:
        h, order, begin, count = grouped(sent.hashes)
        sent.hashes.clear()
        known = np.zeros(len(h), bool)
        if upper is not None and upper.num_rows:
            far, at = merged_order(_joined(upper, "hashes", np.uint64))
            known = isin_sorted(h, far)
            to = at[np.searchsorted(far, h[known])]
        least = place = None
        if earlier:
            least, place = least_sources(order, begin, count, sent.doc, sent.place)
            if known.any():
                least[known], place[known] = np.concatenate(_joined(upper, "docs", np.int64))[to], np.concatenate(_joined(upper, "places", np.int64))[to]
            of = np.empty(len(order), np.int64)
            of[order] = np.repeat(np.arange(len(begin)), count)
            hit = least[of] < sent.doc
        else:
            hit = np.empty(len(order), bool)
            hit[order] = np.repeat(known | (count > 1), count)
        to = 0
        for r, x in zip(sent.rows, sent.at, strict=True):
            own = slice(to, to + len(x))
            to += len(x)
            x = x[hit[own]].astype(np.int64)
            if not len(x):
                continue
            if earlier:
                mine = of[own][hit[own]]
                doc, at = least[mine], place[mine]
                begin_, n = split_runs(x, doc, x - at)
            else:
                doc, at = np.zeros(len(x), np.int64), x
                begin_, n = split_runs(x)
            for k, v in zip(out, (r["block"], x[begin_].astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), doc[begin_].tobytes(), at[begin_].astype(np.uint32).tobytes()), strict=True):
                out[k].append(v)
    return pa.table({k: pa.array(v, pa.int32() if k == "block" else pa.binary()) for k, v in out.items()})


def hits_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes, source documents and places in them of the runs of repeated windows, by start."""
    none = np.zeros(0, np.int64)
    start, size, docs, places = (
        np.concatenate([none, *(x.astype(np.int64) for x in _joined(answers, k, kind))])
        for k, kind in (("starts", np.uint32), ("sizes", np.uint32), ("docs", np.int64), ("places", np.uint32))
    )
    order = np.argsort(start, kind="stable")
    return start[order], size[order], docs[order], places[order]


def repeated_windows(docs: DataFrame, *, window: int, anchor: int, words: bool, earlier: bool, local, finish, schema: str, block_bytes: int = BLOCK_BYTES, tree: int = TREE) -> DataFrame:
    """Run both rounds. local(block, shared) gives the windows to send and the repeated ones with their sources and
    places; finish(table, starts, sizes, sources, places) gives the block's result under `schema`. The three uses of
    the dealt texts have one plan, so Spark shuffles the texts once and reuses that exchange."""
    blocks = block_count(docs, block_bytes)
    buckets = max(32, blocks // 4)
    dealt = deal(docs, blocks)
    groups = math.isqrt(blocks) if blocks >= tree else 1

    def first(table):
        return send_anchors(open_block(table, window, anchor, words, earlier), buckets)

    def second(table, answers):
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _ENTRY.items()})
        b = open_block(table, window, anchor, words, earlier)
        return send_windows(b, *local(b, shared_windows(b, answers)), buckets)

    def third(table, answers):
        return finish(table, *hits_of(answers))

    def grouped(df):
        return df.withColumn("part", F.pmod("block", F.lit(groups)).cast("int")).groupBy("bucket", "part")

    def far(upper):
        return np.concatenate([np.zeros(0, np.uint64), *_joined(upper, "hashes", np.uint64)])

    anchors = dealt.groupBy("block").applyInArrow(first, ANCHORS)
    if groups == 1:
        shared = anchors.groupBy("bucket").applyInArrow(lambda t: answer_anchors(t), SHARED)
    else:
        upper = grouped(anchors).applyInArrow(upper_anchors, SHARED).groupBy("bucket").applyInArrow(lambda t: answer_anchors(t), SHARED)
        shared = grouped(anchors).cogroup(upper.withColumnRenamed("block", "part").groupBy("bucket", "part")).applyInArrow(lambda t, u: answer_anchors(t, far(u)), SHARED)
    entries = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(second, ENTRIES)
    if groups == 1:
        hits = entries.groupBy("bucket").applyInArrow(lambda t: answer_windows(t, earlier), HITS)
    else:
        upper = grouped(entries).applyInArrow(lambda t: upper_windows(t, earlier), UPPER).groupBy("bucket").applyInArrow(lambda t: answer_upper(t, earlier), UPPER)
        hits = grouped(entries).cogroup(upper.groupBy("bucket", "part")).applyInArrow(lambda t, u: answer_windows(t, earlier, u), HITS)
    return dealt.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(third, schema)
