"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased token sequences ([a-z0-9] and bytes from 128 on; the rest separates). Every run of
`least` tokens of a benchmark item is a seed. A document that shares seeds with an item is tiled
against it by Running Karp-Rabin: matches are searched by the hashes of windows of a length that goes
down to `least`, the longest non-overlapping ones are marked first, and marked tokens take no further
part, so reordered passages are found piece by piece. The share of the item's tokens under tiles is its
coverage; from `threshold` on, the document holds the item.

The benchmark is shipped to the tasks in parts of at most PART_BYTES, one scan of the documents a part.
A pair is tiled only if its seeds could cover the threshold, which bounds coverage from above, so no
pair is lost.

Edge cases: null and empty texts hold nothing; a tile has `least` tokens at least, so an item of fewer is
never held (it would mark most clean documents); equal matches are marked from the item's front, then the
document's; repeated items are reported each, and repeated documents too; an empty benchmark reports nothing and
an empty table gives an empty result; extra columns are kept by `with_matches` and `decontaminate`, whatever
their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.llm.common import byte_chunks, fresh, total_bytes
from gridlore.llm.hashing import Texts, cover, grams, inside, runs

#: Octets of benchmark text that one scan carries.
PART_BYTES = 16 << 20
LEAST, THRESHOLD = 5, 0.6

MATCH = "struct<item_id:long,n_tokens:long,n_tiled:long,coverage:double,n_tiles:long,longest:long>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tiled", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]))

_TO_SPACE = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, and each text's first token (with the total last)."""
    _, _, h, first = Texts([x.lower().encode().translate(_TO_SPACE) for x in texts]).words()
    return h, first


@dataclass
class Index:
    """Items' tokens and seeds: distinct seed hashes, and where each occurs (item, position)."""

    ids: list[int]
    items: list[np.ndarray]
    seeds: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    filter: np.ndarray


def build_index(ids: list[int], texts: list[str], least: int) -> Index:
    h, first = tokens(texts)
    g = grams(h, least)
    ok = inside(first[1:], first[:-1], least, len(h))[: len(g)]
    place = np.flatnonzero(ok)
    item = np.searchsorted(first[1:], place, side="right")
    order = np.argsort(g[place], kind="stable")
    place, item = place[order], item[order]
    seeds, begin = np.unique(g[place], return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[(seeds >> np.uint64(44)).astype(np.int64)] = True
    return Index(ids, [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], seeds, np.append(begin, len(place)), np.stack([item, place - first[item]], 1) if len(place) else np.zeros((0, 2), np.int64), bits)


#: Pairs of places that are looked at side by side.
_SLAB = 1 << 18


def free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """The places whose next `size` tokens are all unmarked."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[size:] == total[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def maximal_matches(item: np.ndarray, doc: np.ndarray, marked_item: np.ndarray, marked_doc: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(-length, place in item, place in doc) of the matches of unmarked tokens that cannot be lengthened and have `length` tokens at least.

    Karp-Rabin: the item's free windows of that length are sorted by hash, and the document's are looked up in them.
    Of all pairs only those that begin a match are followed, so repeated tokens cost a comparison a pair and no more."""
    at_i, at_j = free_windows(marked_item, length), free_windows(marked_doc, length)
    if not len(at_i) or not len(at_j):
        return []
    hash_i, hash_j = grams(item, length)[at_i], grams(doc, length)[at_j]
    order = np.argsort(hash_i, kind="stable")
    at_i, hash_i = at_i[order], hash_i[order]
    low, high = np.searchsorted(hash_i, hash_j, "left"), np.searchsorted(hash_i, hash_j, "right")
    some = high > low
    at_j, low, count = at_j[some], low[some], (high - low)[some]
    end = np.cumsum(count)
    out: list[tuple[int, int, int]] = []
    a = 0
    while a < len(at_j):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + _SLAB, "right")))
        n = count[a:b]
        j = np.repeat(at_j[a:b], n)
        i = at_i[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        before_i, before_j = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        goes_back = (i > 0) & (j > 0) & (item[before_i] == doc[before_j]) & ~marked_item[before_i] & ~marked_doc[before_j]
        i, j = i[~goes_back], j[~goes_back]
        size = np.zeros(len(i), np.int64)
        open_ = np.arange(len(i))
        while len(open_):
            x, y = i[open_] + size[open_], j[open_] + size[open_]
            inside = (x < len(item)) & (y < len(doc))
            x, y = np.minimum(x, len(item) - 1), np.minimum(y, len(doc) - 1)
            open_ = open_[inside & (item[x] == doc[y]) & ~marked_item[x] & ~marked_doc[y]]
            size[open_] += 1
        long = size >= length
        out += zip((-size[long]).tolist(), i[long].tolist(), j[long].tolist(), strict=True)
        a = b
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length) of each tile, by place.

    The longest match of unmarked tokens is marked first (of equals the first in the item, then in the document), and
    so on down to `least` tokens. Matches are searched for one length at a time, which is halved; a match that meets
    marked tokens goes back among the others with what is left of it."""
    marked_item, marked_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), len(doc)) // 2)
    while True:
        found = maximal_matches(item, doc, marked_item, marked_doc, length)
        heapq.heapify(found)
        while found:
            n, i, j = heapq.heappop(found)
            n = -n
            marked = marked_item[i : i + n] | marked_doc[j : j + n]
            if marked.any():
                for a, b in zip(*runs(~marked), strict=True):
                    if b - a >= length:
                        heapq.heappush(found, (int(a - b), i + int(a), j + int(a)))
            else:
                marked_item[i : i + n] = marked_doc[j : j + n] = True
                out.append((i, j, n))
        if length == least or marked_item.all():
            return sorted(out)
        length = max(least, length // 2)


def matches(texts: list[str], index: Index, least: int, threshold: float) -> list[list[dict]]:
    """The items that each text holds."""
    out: list[list[dict]] = [[] for _ in texts]
    h, first = tokens(texts)
    g = grams(h, least)
    place = np.flatnonzero(index.filter[(g >> np.uint64(44)).astype(np.int64)] & inside(first[1:], first[:-1], least, len(h))[: len(g)]) if len(index.seeds) else np.zeros(0, np.int64)
    if not len(place):
        return out
    seed = np.searchsorted(index.seeds, g[place])
    seed[seed == len(index.seeds)] = 0
    hit = index.seeds[seed] == g[place]
    place, seed = place[hit], seed[hit]
    doc = np.searchsorted(first[1:], place, side="right")
    cut = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
        if a == b:
            continue
        d = int(doc[a])
        held: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s in np.unique(seed[a:b]).tolist():
            for item, i in index.at[index.begin[s] : index.begin[s + 1]].tolist():
                held[item].append((i, s))
        words = h[first[d] : first[d + 1]]
        for item, found in held.items():
            tokens_, places = index.items[item], np.array([i for i, _ in found])
            if cover(places, places + least, len(tokens_)).sum() < threshold * len(tokens_):
                continue
            # Only tokens under the item's seeds can be tiled; of the others one is kept a gap, as no token.
            shared = place[a:b][np.isin(seed[a:b], [s for _, s in found])] - first[d]
            near = cover(shared, shared + least, len(words))
            kept = near.copy()
            kept[1:] |= near[:-1]
            tiles = tile(tokens_, np.where(near, words, np.uint64(0))[kept], least)
            n = sum(x[2] for x in tiles)
            if n >= threshold * len(tokens_):
                out[d].append({"item_id": index.ids[item], "n_tokens": len(tokens_), "n_tiled": n, "coverage": n / len(tokens_), "n_tiles": len(tiles), "longest": max(x[2] for x in tiles)})
    for x in out:
        x.sort(key=lambda m: (m["item_id"] is None, m["item_id"] or 0))
    return out


def _scan(docs: DataFrame, index: Index, into: str, least: int, threshold: float, chunk: int = 1 << 20) -> DataFrame:
    def work(batches):
        for part, texts in byte_chunks(batches, "text", chunk):
            found = matches([x.decode() for x in texts], index, least, threshold)
            yield part.append_column(into, pa.array(found, _MATCHES))

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(f"array<{MATCH}>"))])
    return docs.mapInArrow(work, schema)


def with_matches(docs: DataFrame, benchmark: DataFrame, into: str = "matches", least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one more column, the last: the benchmark items (item_id, text) that each text holds, sorted by item.

    It is called `into`, or that with underscores where docs has such a column already."""
    into = fresh(docs, into)
    parts = max(1, -(-total_bytes(benchmark) // PART_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    out = docs
    for k in range(parts):
        rows = benchmark.where(part == k).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toArrow()
        index = build_index(rows.column("item_id").to_pylist(), [x or "" for x in rows.column("text").to_pylist()], least)
        if not k:
            out = _scan(out, index, into, least, threshold)
            continue
        more = fresh(out, "_more")
        out = _scan(out, index, more, least, threshold)
        out = out.withColumn(into, F.concat(into, more)).drop(more)
    return out.withColumn(into, F.array_sort(into)) if parts > 1 else out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, "m", least, threshold)
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with their columns."""
    into = fresh(docs, "_matches")
    found = with_matches(docs, benchmark, into, least, threshold)
    return found.where(F.size(into) == 0).drop(into)
