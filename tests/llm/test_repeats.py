import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridlore.llm import blocks
from gridlore.llm.blocks import merged_order, open_block
from gridlore.llm.hashing import Texts, leftmost_minimum
from gridlore.llm.substring_dedup import parse, substring_dedup
from gridlore.llm.suffix_arrays import common_prefixes, repeated_in_shard, suffix_array, suffix_array_dedup

SCHEMA = "doc_id long, text string, block string, bucket long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def fixture(seed, n=60, copies=25):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    rows = []
    for i in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 30, 200])))
        if i % 3 == 0:
            a = r.randint(0, len(passage) // 2)
            t = t[: len(t) // 2] + " " + passage[a : a + r.randint(50, 240)] + "\n" + t[len(t) // 2 :]
        rows.append((i * 7 % 61, t, "x", i))
    rows += [(1000 + i, rows[3][1], "x", 0) for i in range(copies)]
    rows += [(2000, None, None, None), (2001, "", "x", 1), (2002, "a " * 3000, "x", 1), (2003, "a " * 40, "x", 1), (rows[0][0], rows[0][1], "again", 0), (None, rows[1][1], "x", 0)]
    r.shuffle(rows)
    return rows


def brute_words(rows, window):
    docs = [(d, WORD.findall((t or "").encode())) for d, t, *_ in rows]
    least = defaultdict(lambda: 1 << 70)
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least[k], d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def brute_bytes(rows, window):
    docs = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = defaultdict(int)
    for _, b in docs:
        for i in range(len(b) - window + 1):
            count[b[i : i + window]] += 1
    out = []
    for d, b in docs:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") & 1 else zero for i in range(n))


# With tree=1 the index answers in two levels, as it does from many blocks on.
@pytest.mark.parametrize(("seed", "tree"), [(1, 1024), (2, 1)])
def test_substring_dedup_against_brute_force(spark, seed, tree):
    rows = fixture(seed)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), block_bytes=3000, tree=tree).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=repr) == brute_words(rows, 13)
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(WORD.findall((t or "").encode()))
    for r in got:
        assert sum(f.length for f in r.factors) == r.n_removed
        for i, f in enumerate(r.factors):
            assert f.source < r.doc_id
            assert any(w[f.start : f.start + f.length] == x[f.place : f.place + f.length] for w in texts[r.doc_id] for x in texts[f.source])
            before = r.factors[i - 1] if i else None
            assert f.length >= 13 or before.start + before.length == f.start


def test_long_copies_are_one_factor(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    copied, phrase = [word() for _ in range(400)], [word() for _ in range(20)]
    own = [word() for _ in range(30)]
    rows = [(9, " ".join(copied), "x", 0), (12, " ".join([*own, *copied, *own]), "x", 0), (3, " ".join(phrase), "x", 0), (14, " ".join([*phrase, *phrase[:13]]), "x", 0)]
    got = {x.doc_id: x for x in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(f) for f in got[12].factors] == [(30, 400, 9, 0)] and got[12].n_removed == 400
    assert [tuple(f) for f in got[14].factors] == [(0, 20, 3, 0), (20, 13, 3, 0)]


def test_parse_against_plain_walk():
    r = random.Random(8)
    for _ in range(200):
        n, window = r.randint(1, 60), r.randint(1, 9)
        hits = {i: (r.randint(1, 2), i + r.choice([0, 0, 0, 5])) for i in range(n) if r.random() < 0.6}
        cuts, runs = sorted(r.sample(range(n), r.randint(0, n // 4))), []
        for i in sorted(hits):
            if runs and i - 1 in hits and i not in cuts and hits[i] == (hits[i - 1][0], hits[i - 1][1] + 1):
                runs[-1][1] += 1
            else:
                runs.append([i, 1, *hits[i]])
        want, done, i = [], 0, 0
        while i < n:
            if i not in hits:
                i += 1
                continue
            j = i
            while j + 1 in hits and hits[j + 1] == (hits[j][0], hits[j][1] + 1):
                j += 1
            start, end = max(i, done), j + window
            if end > start:
                want.append((start, end - start, hits[i][0], hits[i][1] + start - i))
                done = end
            i = j + 1
        columns = [np.array(c, np.int64) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 4
        assert [tuple(map(int, f)) for f in zip(*parse(*columns, window), strict=True)] == want


def test_words_that_collide_modulo_powers_of_two(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words, a]), "x", 0), (2, " ".join([*words, b]), "x", 0), (3, " ".join([*words, b]), "x", 0)]
    got = {x.doc_id: x.n_removed for x in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    _, _, h, _ = Texts([a.encode(), b.encode(), a.encode()]).words()
    assert h[0] != h[1] and h[0] == h[2]
    w = Texts([a.encode(), b.encode()]).windows(1024)
    assert w[0] != w[1025]


def test_merging_by_binary_search():
    r = np.random.default_rng(2)
    for _ in range(30):
        lists = [r.integers(0, 50, r.integers(0, 40)).astype(np.uint64) for _ in range(r.integers(0, 9))]
        whole = np.concatenate([np.zeros(0, np.uint64), *lists])
        values, place = merged_order(lists)
        assert values.tolist() == np.sort(whole).tolist() == whole[place].tolist() and sorted(place.tolist()) == list(range(len(whole)))


@pytest.mark.parametrize(("seed", "tree"), [(1, 1024), (2, 1)])
def test_suffix_array_dedup_against_brute_force(spark, seed, tree):
    rows = fixture(seed)
    got = suffix_array_dedup(spark.createDataFrame(rows, SCHEMA), block_bytes=3000, tree=tree).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got], key=repr) == brute_bytes(rows, 200)


def test_suffix_array_dedup_on_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    count = Counter(hash(b[i : i + 200]) for b in texts.values() for i in range(len(b) - 199))
    for r in suffix_array_dedup(docs).collect():
        b = np.frombuffer(texts[r.doc_id], np.uint8)
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if count[hash(texts[r.doc_id][i : i + 200])] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(b), int(gone.sum()), b[~gone].tobytes()), r.doc_id


def test_other_window_sizes(spark):
    rows = fixture(3, n=20, copies=2)
    got = suffix_array_dedup(spark.createDataFrame(rows, SCHEMA), window=40, anchor=8).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got], key=repr) == brute_bytes(rows, 40)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window=5, anchor=3).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=repr) == brute_words(rows, 5)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).collect() == []
    assert suffix_array_dedup(empty).collect() == []


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(5)
    text = np.concatenate([r.integers(97, 99, 300), np.full(60, 97), r.integers(97, 100, 200)]).astype(np.uint8)
    text = np.concatenate([text, text[100:400]])
    raw = text.tobytes()
    sa, rank = suffix_array(text, 512)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    prefix = common_prefixes(text, sa, rank, 250, lanes=7)
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[sa[k]] == min(n, 250)


def test_long_copies_in_a_large_block():
    r = np.random.default_rng(1)
    some = lambda least, most: r.integers(97, 101, int(r.integers(least, most))).astype(np.uint8).tobytes().decode()
    passages = [some(400, 2000) for _ in range(40)]
    texts = ["".join(some(100, 900) + passages[r.integers(40)] for _ in range(2)) + some(100, 900) for _ in range(320)]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "block": pa.array([0] * len(texts), pa.int32())})
    b = open_block(table, 200, 64, False, False)
    raw, at = b.texts.buf.tobytes(), np.flatnonzero(b.valid).tolist()
    assert len(raw) > 1 << 20
    count = Counter(raw[i : i + 200] for i in at)
    _, again, *_ = repeated_in_shard(b, np.zeros(len(b.valid), bool), 200)
    assert again.tolist() == [i for i in at if count[raw[i : i + 200]] > 1]


def test_suffix_array_orders_zero_bytes_at_the_end():
    raw = b"a\0\0" * 9 + b"\0" * 20
    sa, rank = suffix_array(np.frombuffer(raw, np.uint8))
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    assert rank[sa].tolist() == list(range(len(raw)))


def test_leftmost_minimum():
    h = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64) << np.uint64(32)
    for size in (1, 2, 7, 64):
        assert leftmost_minimum(h, size).tolist() == [int(i + np.argmin(h[i : i + size])) for i in range(len(h) - size + 1)]


def test_levels_of_the_index_carry_no_more_than_they_need():
    """Two levels repeat all shared windows: not for 6 GB of text, and without sources where none are asked for."""
    assert 6 * 10**9 // blocks.BLOCK_BYTES < blocks.TREE
    anchor, low = np.array([7], np.uint64).tobytes(), np.arange(12, dtype=np.uint8)
    entry = {"bucket": 0, "here": False, "starts": np.array([0], np.uint32).tobytes(), "sizes": np.array([2], np.uint32).tobytes(), "docs": np.array([3], np.int64).tobytes(), "places": np.array([0], np.uint32).tobytes(), "anchors": anchor, "hashes": low.tobytes()}
    table = lambda part: pa.Table.from_pylist([{**entry, "block": part, "part": part}])
    upper = pa.concat_tables([blocks.upper_windows(table(part), False) for part in (0, 1)])
    assert [len(x) for c in ("docs", "places") for x in upper.column(c).to_pylist()] == [0] * 4
    assert [len(x) for x in upper.column("hashes").to_pylist()] == [16, 16]
    found = blocks.answer_upper(upper, False)
    assert found.column("part").to_pylist() == [0, 1] and found.column("hashes").to_pylist() == upper.column("hashes").to_pylist()
    hits = blocks.hits_of(blocks.answer_windows(table(0), False, found.slice(0, 1)))
    assert [x.tolist() for x in hits[:2]] == [[0], [2]]
