"""Near-duplicate classes by MinHash: improved consistent weighted sampling over TF-IDF shingles.

1. A text's shingles are its runs of five words. Equal texts are one (a digest of the text is the key). A shingle weighs
   its count in the text times its inverse document frequency, 1 + ln(N / df), both counted over the different texts, so
   that copies do not cheapen what they copy. The counts are exact for every shingle: the texts lie in blocks, each
   block sends its different shingles to the buckets of an index, dealt by hash, and a bucket answers each block with the counts of
   those that more than one text has. No table of shingles is held whole anywhere.
2. Each text is given BANDS x ROWS consistent weighted samples (Ioffe's scheme); equal bands put texts in a bucket.
3. In each bucket every text is linked to the smallest key and to a random one that differs by bucket,
   so links grow with the members, not with their pairs. Links are verified by the weighted Jaccard
   similarity of whole texts.
4. Verified links give components.
5. The texts of buckets that still hold several components (and more than two texts) are joined
   exactly: every pair of two components that can reach the threshold is verified. Shingles are put in
   the order of their number of texts; a pair at the threshold has its first common shingle where
   enough weight is left in both, so only the texts' heads are joined, by shingle and size. Sketches of both sets
   bound what they share, which spares most texts that have a passage and little else in common.

A pair at the threshold misses all 16 bands with a probability of 2e-4, one of similarity 0.9 with 4e-8.

Edge cases: a text of fewer than five words has one shingle, all its words; texts without words are
near duplicates only of equal texts; null is an empty text; rows with a null doc_id take part, and a class is
named by its smallest doc_id (null if it has none); repeated rows are equal texts, and ties of the samples are
broken by hash; extra columns are ignored, whatever their names, and kept by `keep_one`; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.blocks import LEAST_BLOCKS, _bucket, _joined, _parts
from gridlore.llm.common import byte_chunks, column_bytes, cut, fresh, give_back, release, spread_join, sweep
from gridlore.llm.hashing import BASE, Texts, grams, isin_sorted, mix

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Shingles in less than one text of so many weigh the same; None: every shingle has the weight of its own count.
COMMON = None
#: Keys of texts that a task remembers, so as to send equal texts once.
SEEN = 1 << 18
#: Octets of text in a block.
BLOCK_BYTES = 4 << 20
#: Octets of text that are hashed at once.
AT_ONCE = 1 << 19
#: Bins of a text's sketch.
SKETCH = 64
#: Head shingles before one that its row carries, so that most pairs are made once only.
BEFORE = 32
#: Links whose sets are held as Python objects at a time.
LINKS = 512

_GAMMA, _GAMMA_C = 13, 14
_LN_R = -np.log((np.arange(1 << _GAMMA) + 0.5) / (1 << _GAMMA)).astype(np.float32)
_LN_C = -np.log((np.arange(1 << _GAMMA_C) + 0.5) / (1 << _GAMMA_C)).astype(np.float32)


def shingles(texts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (of 56 bits, the upper ones) by text, in order; their counts; and each text's first one (with the total last)."""
    _, _, h, first = Texts(texts).words()
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), np.where(n >= size, n - size + 1, (n > 0).astype(np.int64)))
    g = grams(h, size)
    count = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(count) - count
    at = np.arange(len(doc)) - begin[doc] + first[doc]
    out = np.zeros(len(doc), np.uint64)
    long = (n >= size)[doc]
    out[long] = g[at[long]]
    for i in np.flatnonzero(~long).tolist():
        x = h[first[doc[i]] : first[doc[i] + 1]]
        out[i] = mix(grams(x, len(x)) + np.uint64(len(x)))[0]
    out &= np.uint64((1 << 64) - 256)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    tf = np.diff(np.append(start, len(out)))
    return out[start], tf, np.searchsorted(doc[start], np.arange(len(texts) + 1))


class Weights(tuple):
    """Sorted hashes of the shingles that more than one text has, and their weights; `usual` is that of all others."""

    usual = 1.0


def inverse_frequency(h: np.ndarray, n: np.ndarray, texts: int, common: int | None = COMMON) -> Weights:
    """The weights of shingles h, of which each is in n of the texts."""
    most = min(max(1, texts), common or math.inf)
    order = np.argsort(h)
    out = Weights((h[order], 1 + np.log(np.minimum(max(1, texts) / n[order], most))))
    out.usual = 1 + math.log(most)
    return out


def portions(texts: list[bytes]):
    """Runs of texts of about AT_ONCE octets."""
    a, size = 0, 0
    for i, x in enumerate(texts):
        if i > a and size + len(x) > AT_ONCE:
            yield texts[a:i]
            a, size = i, 0
        size += len(x)
    if a < len(texts):
        yield texts[a:]


def _different(table: pa.Table) -> dict[bytes, bytes]:
    """A block's texts by key."""
    return dict(zip(table.column("key").to_pylist(), (x for c in table.column("text").chunks for x in column_bytes(c)), strict=True))


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes of 56 bits as differences, all lowest bytes first: the upper bytes are mostly 0, which a shuffle takes out."""
    return np.ascontiguousarray(np.diff(h >> np.uint64(8), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes()


def unpack_hashes(x: bytes) -> np.ndarray:
    d = np.zeros((len(x) // 7, 8), np.uint8)
    d[:, :7] = np.frombuffer(x, np.uint8).reshape(7, -1).T
    return np.cumsum(d.view(np.uint64)[:, 0], dtype=np.uint64) << np.uint64(8)


def send_counts(table: pa.Table, buckets: int) -> pa.Table:
    """A block's different shingles by bucket, and in how many of its texts each is."""
    h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingles(x)[0] for x in portions(list(_different(table).values())))]), return_counts=True)
    parts = _parts(_bucket(h, buckets))
    n = n.astype(np.uint32)
    give_back()
    return pa.table({
        "bucket": pa.array([x for x, _, _ in parts], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int32()),
        "hashes": pa.array([pack_hashes(h[i:j]) for _, i, j in parts], pa.binary()), "texts": pa.array([n[i:j].tobytes() for _, i, j in parts], pa.binary()),
    })


def answer_counts(table: pa.Table) -> pa.Table:
    """Of each block's shingles those that more than one text of all blocks has, and in how many texts each is."""
    own = [unpack_hashes(x) for x in table.column("hashes").to_pylist()]
    _, back = np.unique(np.concatenate(own), return_inverse=True)
    n = np.bincount(back, np.concatenate(_joined(table, "texts", np.uint32))).astype(np.uint32)[back]
    hashes, counts, at = [], [], 0
    for x in own:
        mine = n[at : at + len(x)]
        at += len(x)
        hashes.append(pack_hashes(x[mine > 1]))
        counts.append(mine[mine > 1].tobytes())
    give_back()
    return pa.table({"block": table.column("block").cast(pa.int32()), "hashes": pa.array(hashes, pa.binary()), "texts": pa.array(counts, pa.binary())})


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and key, its digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"))


def counted(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """Of keyed rows the different texts (block, key, text; equal ones lie in one block, at most one a task of the scan), the counts of each block's shared shingles (block, hashes,
    texts), and the number of different texts that have a shingle."""
    word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    sizes = docs.select("key", F.octet_length("text").cast("long").alias("size"), word.alias("word")).groupBy("key").agg(F.first("size").alias("size"), F.first("word").alias("word"))
    size, texts = sizes.agg(F.sum("size"), F.count_if("word")).first()

    def once(batches):
        seen = set()
        for batch in batches:
            new = []
            for x in batch.column("key").to_pylist():
                new.append(x not in seen)
                seen.add(x)
            yield batch.filter(pa.array(new, pa.bool_()))
            if len(seen) > SEEN:
                seen.clear()

    blocks = max(LEAST_BLOCKS, -(-(size or 0) // block_bytes))
    buckets = max(32, blocks // 4)
    dealt = docs.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "text").mapInArrow(once, "block int, key binary, text string")
    sent = dealt.groupBy("block").applyInArrow(lambda t: send_counts(t, buckets), "bucket int, block int, hashes binary, texts binary")
    return dealt, sent.groupBy("bucket").applyInArrow(answer_counts, "block int, hashes binary, texts binary"), texts


def weights_of(answers: pa.Table, texts: int, common: int | None = COMMON) -> Weights:
    h = np.concatenate([np.zeros(0, np.uint64), *map(unpack_hashes, answers.column("hashes").to_pylist())])
    return inverse_frequency(h, np.concatenate([np.zeros(0, np.uint32), *_joined(answers, "texts", np.uint32)]), texts, common)


def common_shingles(docs: DataFrame, common: int | None = COMMON) -> Weights:
    """The weights of all shingles that more than one text has, on the driver: for tables that fit in it. `near_duplicates`
    leaves them in their blocks."""
    _, answers, texts = counted(keyed(docs.select(F.lit(None).alias("doc_id"), "text")))
    found = weights_of(answers.toArrow(), texts, common)
    h, at = np.unique(found[0], return_index=True)
    out = Weights((h, found[1][at]))
    out.usual = found.usual
    return out


def weights(h: np.ndarray, tf: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = np.full(len(h), getattr(heavy, "usual", Weights.usual))
    if len(heavy[0]):
        at = np.searchsorted(heavy[0], h)
        at[at == len(heavy[0])] = 0
        hit = heavy[0][at] == h
        w[hit] = heavy[1][at[hit]]
    return w * tf


def samples(h: np.ndarray, w: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each set (h, w), sets being cut at `first`; none is empty.

    For element k and sample j: r, c ~ Gamma(2, 1) and b ~ U(0, 1) come from a hash of (k, j); then
    t = floor(ln w / r + b) and the element with the least ln c - r (t - b + 1) is drawn, with its t."""
    size = np.diff(np.append(first, len(h)))
    log_w = np.log(w).astype(np.float32)
    out = np.empty((len(first), n), np.uint64)
    low, high = (1 << _GAMMA) - 1, (1 << _GAMMA_C) - 1
    for j in range(n):
        x = h * np.uint64((BASE * (2 * j + 1)) & (1 << 64) - 1)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x = x.view(np.int64)
        r = _LN_R[x & low]
        r += _LN_R[(x >> 13) & low]
        c = _LN_C[(x >> 26) & high]
        c += _LN_C[(x >> 40) & high]
        b = ((x >> 54) & 1023).astype(np.float32)
        b += np.float32(0.5)
        b *= np.float32(1 / 1024)
        t = log_w / r
        t += b
        np.floor(t, out=t)
        a = t - b
        a += np.float32(1)
        a *= r
        np.subtract(np.log(c), a, out=a)
        least = np.minimum.reduceat(a, first)
        at = np.flatnonzero(a == np.repeat(least, size))
        at = at[np.searchsorted(at, first)]
        out[:, j] = mix(h[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(BASE))
    return out


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def band_hashes(h: np.ndarray, w: np.ndarray, first: np.ndarray, bands: int, rows: int) -> list[list[int]]:
    """The bands' hashes of each weighted set; none of an empty one."""
    some = np.flatnonzero(np.diff(first) > 0)
    out: list[list[int]] = [[] for _ in first[1:]]
    if len(some):
        s = samples(h, w, first[some], bands * rows).reshape(len(some), bands, rows)
        x = np.zeros((len(some), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(rows):
            x = mix(x * np.uint64(BASE) + s[:, :, k])
        for i, row in zip(some.tolist(), x.view(np.int64).tolist(), strict=True):
            out[i] = row
    return out


def packed_sets(h: np.ndarray, w: np.ndarray, first: np.ndarray, usual: float) -> tuple[list[bytes], list[bytes]]:
    """Whole weighted sets: sorted 32-bit shingle hashes, and places and weights of those of another weight than 1, the usual one."""
    w = (w / usual).astype(np.float32)
    h = (h >> np.uint64(32)).astype(np.uint32)
    odd = np.abs(w - np.float32(1)) > 1e-4
    sets, odds = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        sets.append(h[a:b].tobytes())
        at = np.flatnonzero(odd[a:b])
        odds.append(at.astype(np.uint32).tobytes() + w[a:b][at].tobytes())
    return sets, odds


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, common: int | None = COMMON) -> DataFrame:
    """key, bands (their hashes) and the whole weighted set (see `packed_sets`) of each different text of keyed rows."""
    dealt, answers, texts = counted(docs)

    def work(table, answered):
        out: dict[str, list] = {"key": [], "bands": [], "shingles": [], "odd": []}
        if table.num_rows:
            heavy = weights_of(answered, texts, common)
            different = _different(table)
            out["key"] = list(different)
            for part in portions(list(different.values())):
                h, tf, first = shingles(part)
                w = weights(h, tf, heavy)
                out["bands"] += band_hashes(h, w, first, bands, rows)
                sets, odds = packed_sets(h, w, first, heavy.usual)
                out["shingles"] += sets
                out["odd"] += odds
            give_back()
        return pa.table({k: pa.array(v, pa.list_(pa.int64()) if k == "bands" else pa.binary()) for k, v in out.items()})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, "key binary, bands array<long>, shingles binary, odd binary")


def features(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key and the whole weighted set of each text, by weights that the driver holds."""

    def work(batches):
        for _, texts in byte_chunks(batches, "text", AT_ONCE):
            h, tf, first = shingles(texts)
            sets, odds = packed_sets(h, weights(h, tf, heavy), first, getattr(heavy, "usual", Weights.usual))
            yield pa.record_batch({"key": pa.array([digest(x) for x in texts], pa.binary()), "shingles": pa.array(sets, pa.binary()), "odd": pa.array(odds, pa.binary())})

    return docs.select("text").mapInArrow(work, "key binary, shingles binary, odd binary")


def weighted_set(shingles_: bytes, odd: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(shingles_, np.uint32)
    w = np.ones(len(h), np.float32)
    n = len(odd) // 8
    w[np.frombuffer(odd, np.uint32, n)] = np.frombuffer(odd, np.float32, n, 4 * n)
    return h, w


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger ones; both sets sorted by hash."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = float(np.minimum(a[1][hit], b[1][at[hit]]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / whole if whole else 0.0


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' weighted Jaccard similarity reaches the threshold.

    b's set is joined first: the smaller key of many links is then joined by parts, so its set is not copied a link."""

    def work(batches):
        for batch in (x.slice(k, LINKS) for x in batches for k in range(0, x.num_rows, LINKS)):
            cols = [batch.column(c).to_pylist() for c in ("a_shingles", "a_odd", "b_shingles", "b_odd")]
            ok = [weighted_jaccard(weighted_set(p, q), weighted_set(r, s)) >= similarity - 1e-9 for p, q, r, s in zip(*cols, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"{c}_shingles"), F.col("odd").alias(f"{c}_odd"))
    return spread_join(links.join(side("b"), "b"), side("a"), "a", keys=links).select("a", "b", "a_shingles", "a_odd", "b_shingles", "b_odd").mapInArrow(work, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """key and component (the smallest key) of the linked keys: labels spread along links and jump to their label's label.

    Rows are a pair of keys; the engine splits a hot key's partition of such joins itself once it is large."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("component")), n)
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "component"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("m"))
        spread = labels.join(near, "key", "left").select("key", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = labels.select(F.col("key").alias("component"), F.col("component").alias("further"))
        new = cut(spread.join(jump, "component", "left").select("key", "old", F.least("component", F.coalesce("further", "component")).alias("component")), n)
        release(labels)
        if not new.where(F.col("old") != F.col("component")).limit(1).count():
            release(both)
            return new
        labels = new


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only these links are labelled, between the components that they join."""
    name = lambda c: found.select(F.col("key").alias(c), F.col("component").alias(f"{c}_component"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
    between = between.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")).where("a <> b")
    renamed = components(between)
    known = found.select("key", "component").union(renamed.select("key", F.col("key").alias("component"))).distinct()
    whole = renamed.select(F.col("key").alias("component"), F.col("component").alias("whole"))
    out = cut(known.join(whole, "component", "left").select("key", F.coalesce("whole", "component").alias("component")), found.count() + renamed.count())
    release(renamed)
    return out


def heads(sets: DataFrame, similarity: float) -> DataFrame:
    """The shingles h that can be the first common one (by number of texts, then hash) of a text and one as similar
    as the threshold: key, component, h, the text's weight (size), the largest weight of such another text (most), the text's
    weight by SKETCH bins of shingles (sketch; two texts share no more than the lesser of both in each bin) and the first BEFORE of
    its head's shingles that come before h (before; two texts that share one of them have met there already)."""

    def explode(batches):
        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                h = np.unique(np.frombuffer(x, np.uint32)).astype(np.int64)
                yield pa.record_batch({"key": pa.array([key] * len(h), pa.binary()), "h": pa.array(h)})

    def head(batches):
        factor = (1 + similarity) / similarity
        for batch in batches:
            for r in batch.to_pylist():
                h, w = weighted_set(r["shingles"], r["odd"])
                w = w.astype(np.float64)
                n = np.ones(len(h), np.int64)
                seen = sorted((x["h"], x["n"]) for x in r["counts"])
                known = np.array([x for x, _ in seen], np.uint32)
                at = np.flatnonzero(isin_sorted(h, known))
                n[at] = np.array([x for _, x in seen], np.int64)[np.searchsorted(known, h[at])]
                order = np.lexsort((h, n))
                rest, whole = np.cumsum(w[order][::-1])[::-1], float(w.sum())
                most = rest * factor - whole + 1e-6 * whole
                ok = (n[order] > 1) & (most >= similarity * whole)
                k = int(ok.sum())
                sketch = np.bincount(h % SKETCH, w, minlength=SKETCH)
                first = h[order][ok][:BEFORE].astype(np.int64)
                yield pa.record_batch({"before": pa.array([first[:t] for t in range(k)], pa.list_(pa.int64())), "sketch": pa.array([sketch] * k, pa.list_(pa.float32())), "key": pa.array([r["key"]] * k, pa.binary()), "component": pa.array([r["component"]] * k, pa.binary()), "h": pa.array(h[order][ok].astype(np.int64)), "size": pa.array([whole] * k, pa.float64()), "most": pa.array(most[ok])})

    tokens = sets.select("key", "shingles").mapInArrow(explode, "key binary, h long")
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = tokens.join(shared, "h").groupBy("key").agg(F.collect_list(F.struct("h", "n")).alias("counts"))
    return sets.join(counts, "key").mapInArrow(head, "before array<long>, sketch array<float>, key binary, component binary, h long, size double, most double")


def possible(sets: DataFrame, similarity: float, common: int | None = COMMON) -> DataFrame:
    """All pairs (a, b) of texts of different components that can reach the threshold; sets has their components.

    Texts of a shingle's largest component are not paired with each other, and of a pair the lighter
    text must leave room for one of its own weight at least, which a passage that strangers share does not. The sets hold
    their weights, so `common` changes nothing."""
    rows = cut(heads(sets, similarity))
    members = rows.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("most") >= F.col("size")).alias("lighter"))
    mixed = members.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("k"), F.max("lighter").alias("lighter")).where("k > 1 AND lighter").select("h", "main")
    rows = rows.join(mixed, "h").withColumn("in_main", F.col("component") == F.col("main")).drop("main")
    step = math.log(1 / min(similarity, 0.95))
    level = lambda more: F.floor((F.log("size") + more) / step)
    a = rows.where("most >= size").select("h", F.col("key").alias("a"), F.col("component").alias("a_component"), F.col("size").alias("a_size"), F.col("most").alias("a_most"), F.col("sketch").alias("a_sketch"), F.col("before").alias("a_before"), F.explode(F.sequence(level(-1e-5), level(math.log(1 / similarity) + 1e-5))).alias("level"), "in_main")
    a = a.withColumn("in_main", F.explode(F.when(F.col("in_main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    b = rows.select("h", F.col("key").alias("b"), F.col("component").alias("b_component"), F.col("size").alias("b_size"), F.col("most").alias("b_most"), F.col("sketch").alias("b_sketch"), F.col("before").alias("b_before"), level(0).alias("level"), "in_main")
    common_weight = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.least(x, y)), F.lit(0.0), lambda n, x: n + x)
    enough = common_weight * (1 + similarity) >= (F.col("a_size") + F.col("b_size")) * (similarity * 0.99999)
    pairs = a.join(b, ["h", "level", "in_main"]).where("a_component <> b_component AND b_size >= a_size * 0.999999 AND b_size <= a_most AND a_size <= b_most").where(enough & ~F.arrays_overlap("a_before", "b_before"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, common: int | None = COMMON) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_texts (different texts in the class) and class_size (rows)."""
    docs = keyed(docs)
    signed = cut(signatures(docs, bands, rows, common))
    # The texts by block and the index's hashes are most of the disk.
    sweep(docs.sparkSession)
    members = cut(signed.select("key", F.explode("bands").alias("band")))
    random = F.xxhash64("band", "key")
    crowded = members.groupBy("band").agg(F.min("key").alias("least"), F.min_by("key", random).alias("random"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(spread_join(members, crowded.drop("n"), "band"))
    release(members)
    sets = cut(signed.select("key", "shingles", "odd").join(held.select("key").distinct(), "key", "left_semi"))
    release(signed)

    def pairs(x: DataFrame, *other: str) -> DataFrame:
        link = F.explode(F.array(*(F.struct(F.least("key", o).alias("a"), F.greatest("key", o).alias("b")) for o in other)))
        return x.select(link.alias("l")).select("l.a", "l.b").where("a <> b").distinct()

    links = cut(verified(pairs(held, "least", "random"), sets, similarity))
    found = components(links)
    release(links)
    bands_of = held.select("band", "key")
    component = F.coalesce("component", "key")
    labelled = cut(bands_of.join(found, "key", "left").withColumn("component", component))
    mixed = labelled.groupBy("band").agg((F.min("component") != F.max("component")).alias("mixed"), F.count(F.lit(1)).alias("n")).where("mixed AND n > 2").select("band")
    open_ = cut(spread_join(labelled, mixed, "band").select("key", "component").distinct().join(sets, "key"))
    release(held, labelled)
    more = cut(verified(possible(open_, similarity), open_, similarity))
    if more.limit(1).count():
        before, found = found, joined(found, more)
        release(before)
    release(open_, more, sets)
    sweep(docs.sparkSession)
    known = docs.select("doc_id", "key").join(found.select("key", "component"), "key", "left").withColumn("component", component)
    classes = known.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.count_distinct("key").alias("class_texts"))
    return spread_join(known, classes, "component").select("doc_id", "class_id", "class_size", "class_texts")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with their columns, one of each class: the one with the smallest doc_id (one of equal rows; all with a null doc_id stay)."""
    classes = near_duplicates(docs, **parameters)
    kept_id, place = fresh(docs, "_kept"), fresh(docs, "_place")
    first = classes.where(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("class_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col(kept_id)).drop(kept_id)
    again = Window.partitionBy("doc_id").orderBy("text")
    kept = kept.withColumn(place, F.row_number().over(again)).where(F.col(place) == 1).drop(place)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
