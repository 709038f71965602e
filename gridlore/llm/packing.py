"""Token ids packed into fixed rows by best-fit decreasing.

Whole texts are tokenised by a public byte-level BPE vocabulary (its path is a parameter; the driver
reads it and ships the ranks), and an end token follows each text. A text longer than a row is split
losslessly into full rows and a rest. The pieces of one chunk are then packed in decreasing size into
the row with the least room that fits, found in a segment tree over the free capacities.

A row is (pack_id, ids: little-endian matrix row padded with pad_id, n_tokens, cu_seqlens: cumulative
segment lengths, position_resets: where positions start again at 0, doc_ids, pieces: the piece number of
each segment). Chunks are cut by size in a task, so memory is bounded and a lost task is redone alone. Which texts share a
chunk, and the pack_ids, follow the input's splits: a table read from files gives the same rows again, and a
plan that ends in a shuffle should be written first, as the pipeline does. `write_matrices` puts packed rows
into raw binary files that a trainer can map into memory; `read_matrices` reads them.

Edge cases: null and empty texts are the end token alone, so no document is lost; a null doc_id stays
null; repeated rows are packed each; extra columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridlore.llm.common import byte_chunks
from gridlore.llm.hashing import Texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokeniser pattern of that vocabulary (fixed value), and its free id as end and padding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
ROW = 2048
#: Octets of text that are packed together.
CHUNK = 4 << 20
#: Octets of text that are tokenised at once; of a chunk only the ids are kept.
AT_ONCE = 1 << 20
#: Known pieces that a worker keeps.
KNOWN = 1 << 18

RESULT = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"

_encoders: dict[str, object] = {}


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def told_apart(buf: np.ndarray, at: np.ndarray, end: np.ndarray, first: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of pieces with equal hashes, with the pieces whose bytes differ from their group's first one as groups of their own."""
    if not len(at):
        return first, back
    size = end - at
    to = np.repeat(np.cumsum(size) - size, size)
    inside = np.arange(size.sum()) - to
    like = at[first[back]]
    fits = size == size[first[back]]
    same = buf[np.repeat(at, size) + inside] == buf[np.minimum(np.repeat(like, size) + inside, len(buf) - 1)]
    fits &= np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64) == size
    other = np.flatnonzero(~fits)
    if not len(other):
        return first, back
    back = back.copy()
    back[other] = len(first) + np.arange(len(other))
    return np.concatenate((first, other)), back


class Encoder:
    """Tokenises chunks of texts; each distinct word of a chunk is encoded once.

    The pattern never joins what stands before a space with a word after it, and takes that space into
    the word's piece. So a text may be cut before every space that a byte follows which is no white space.
    Bytes that may begin a white-space character of several bytes (C2, E1, E2, E3) count as such.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}
        safe = np.ones(256, bool)
        safe[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
        self.safe = safe

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first one (with the total last)."""
        buf = texts.buf
        begin = np.zeros(len(buf) + 1, bool)
        begin[:-2] = (buf[:-1] == 32) & self.safe[buf[1:]]
        begin[texts.starts] = True
        begin[texts.ends] = True
        at = np.flatnonzero(begin[:-1])
        end = np.append(at[1:], len(buf))
        doc_of = np.searchsorted(texts.ends, at, side="right")
        full = at < texts.ends[np.minimum(doc_of, len(texts.ends) - 1)]
        mark = np.zeros(len(buf) + 1, bool)
        mark[texts.ends] = True
        real = ~mark[at] & full
        at, end, doc = at[real], end[real], doc_of[real]
        _, first, back = np.unique(texts.spans(at, end), return_index=True, return_inverse=True)
        first, back = told_apart(buf, at, end, first, back)
        raw = buf.tobytes()
        got = []
        if len(self.known) > KNOWN:
            self.known.clear()
        for a, b in zip(at[first].tolist(), end[first].tolist(), strict=True):
            piece = raw[a:b]
            ids = self.known.get(piece)
            if ids is None:
                ids = np.array(self.bpe.encode_ordinary(piece.decode()), np.int32).tobytes()
                if b - a <= 64:
                    self.known[piece] = ids
            got.append(ids)
        if not got:
            return np.zeros(0, np.int32), np.zeros(len(texts.docs) + 1, np.int64)
        size = np.array([len(x) // 4 for x in got])
        flat, offset = np.frombuffer(b"".join(got), np.int32), np.cumsum(size) - size
        n = size[back]
        stop = np.cumsum(n)
        ids = flat[np.repeat(offset[back] - (stop - n), n) + np.arange(stop[-1])]
        per_doc = np.bincount(doc, n, minlength=len(texts.docs)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_doc)))

    def parts(self, text: bytes, limit: int) -> list[bytes]:
        """A text cut where its tokens are not changed, into parts of about `limit` octets (longer ones where it cannot be cut)."""
        out, at, reach = [], 0, limit
        while len(text) - at > reach:
            seen = np.frombuffer(text, np.uint8, reach + 1, at)
            free = np.flatnonzero((seen[1:-1] == 32) & self.safe[seen[2:]])
            if len(free):
                to = at + 1 + int(free[-1])
                out.append(text[at:to])
                at, reach = to, limit
            else:
                reach *= 2
        return [*out, text[at:]]

    def encode_each(self, texts: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, with working memory in proportion to `limit` and not to the longest text."""
        if all(len(x) <= limit for x in texts):
            return self.encode(Texts(texts))
        ids, size = [], np.zeros(len(texts), np.int64)
        for d, x in enumerate(texts):
            for part in self.parts(x, limit):
                got, _ = self.encode(Texts([part]))
                ids.append(got)
                size[d] += len(got)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(size)))


class Room:
    """A segment tree over capacities 0..size: how many rows have exactly so much room, and which."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int, by: int = 1) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least `need`, taken out, and its room."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not self.count[i]:
                    i += 1
        room = i - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The row of each piece; sizes are at most the capacity."""
    row_of = np.empty(len(sizes), np.int64)
    room, rows = Room(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        got = room.take(n)
        if got is None:
            got = (rows, capacity)
            rows += 1
        row_of[i] = got[0]
        if got[1] > n:
            room.add(got[1] - n, got[0])
    return row_of


def pack(ids: np.ndarray, first: np.ndarray, row: int, pad: int) -> tuple[np.ndarray, list[tuple[list[int], list[int], list[int]]]]:
    """The matrix of rows, and by row its segments: document (place), piece and length."""
    size = np.diff(first)
    n = np.maximum(1, -(-size // row))
    doc = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = first[doc] + piece * row
    length = np.minimum(row, first[doc + 1] - start)
    row_of = best_fit_decreasing(length, row)
    order = np.lexsort((np.arange(len(doc)), row_of))
    rows = int(row_of.max()) + 1 if len(row_of) else 0
    out = np.full((rows, row), pad, np.int32)
    segments: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in range(rows)]
    used = [0] * rows
    for k in order.tolist():
        r, a, m = int(row_of[k]), int(start[k]), int(length[k])
        out[r, used[r] : used[r] + m] = ids[a : a + m]
        used[r] += m
        for x, v in zip(segments[r], (int(doc[k]), int(piece[k]), m), strict=True):
            x.append(v)
    return out, segments


def pack_documents(docs: DataFrame, ranks: dict[bytes, int] | None = None, row: int = ROW, end_id: int = END_ID, pad_id: int = END_ID, chunk: int = CHUNK) -> DataFrame:
    """The packed rows of all documents."""
    ranks = read_ranks() if ranks is None else ranks
    kind = "<u2" if max(end_id, pad_id, max(ranks.values(), default=0)) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = uuid.uuid4().hex

    def rows(ids_, tokens, sizes, number):
        matrix, segments = pack(np.concatenate(tokens), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), row, pad_id)
        matrix = matrix.astype(kind)
        for k in range(0, len(segments), 256):
            part = segments[k : k + 256]
            ends = [np.cumsum([0, *s[2]]) for s in part]
            yield pa.record_batch({
                "pack_id": pa.array([number + k + i for i in range(len(part))], pa.int64()),
                "ids": pa.array([matrix[k + i].tobytes() for i in range(len(part))], pa.binary()),
                "n_tokens": pa.array([int(e[-1]) for e in ends], pa.int32()),
                "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                "position_resets": pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                "doc_ids": pa.array([[ids_[d] for d in s[0]] for s in part], pa.list_(pa.int64())),
                "pieces": pa.array([s[1] for s in part], pa.list_(pa.int32())),
            })

    def work(batches):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder = _encoders[key]
        number = TaskContext.get().partitionId() << 40
        ids_, tokens, sizes, size = [], [], [], 0
        for part, texts in byte_chunks(batches, "text", min(chunk, AT_ONCE)):
            ids, first = encoder.encode_each(texts, AT_ONCE)
            ids_ += part.column("doc_id").cast(pa.int64()).to_pylist()
            tokens.append(np.insert(ids, first[1:], end_id))
            sizes.append(np.diff(first) + 1)
            size += sum(map(len, texts)) + len(texts)
            if size >= chunk:
                for out in rows(ids_, tokens, sizes, number):
                    yield out
                    number += out.num_rows
                ids_, tokens, sizes, size = [], [], [], 0
        if ids_:
            for out in rows(ids_, tokens, sizes, number):
                yield out
                number += out.num_rows

    return docs.select("doc_id", "text").mapInArrow(work, RESULT)


MANIFEST = "matrix string, segments string, rows long, row int, kind string"


def write_matrices(packs: DataFrame, path: str, row: int = ROW) -> DataFrame:
    """The packed rows as binary files in a folder that driver and executors share (a path or URI that pyarrow opens).

    A task writes a matrix file (its ids, row after row, little-endian) and a segments file with one JSON line a row
    (pack_id, n_tokens, cu_seqlens, position_resets, doc_ids, pieces). The returned manifest names the files and their
    shape. Files are named by partition and attempt, so a task that runs again leaves files that the manifest does not name."""
    names = ("pack_id", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "pieces")

    def work(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"{base.rstrip('/')}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        rows, width = 0, 0
        with system.open_output_stream(f"{stem}.ids") as matrix, system.open_output_stream(f"{stem}.jsonl") as segments:
            for batch in batches:
                for r in batch.to_pylist():
                    width = len(r["ids"])
                    matrix.write(r["ids"])
                    segments.write((json.dumps({k: r[k] for k in names}) + "\n").encode())
                    rows += 1
        if rows:
            yield pa.record_batch({"matrix": [f"{stem}.ids"], "segments": [f"{stem}.jsonl"], "rows": pa.array([rows], pa.int64()), "row": pa.array([row], pa.int32()), "kind": [f"<u{width // row}"]})

    return packs.select("ids", *names).mapInArrow(work, MANIFEST)


def read_matrices(matrix: str, row: int, kind: str) -> np.ndarray:
    """One matrix file of the manifest, mapped into memory."""
    return np.memmap(matrix, kind, "r").reshape(-1, row)
