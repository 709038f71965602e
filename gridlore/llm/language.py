"""Language identification as multilingual mixture inference.

Each language has a hashed byte-trigram model, learnt from labelled texts. A word's likelihood in a
language is the product over its trigrams; a document is a mixture of languages, and expectation-
maximisation over its words estimates the proportions until they settle. Nested language sets, in the order
of the proportions under all languages, are compared by penalised likelihood (each further language costs
`penalty` + half the logarithm of the number of words), and the chosen set's proportions are the answer. All
sizes of sets are open; a document leaves the search when not even the likelihood under all languages could
pay for a larger one.

`known` tells whether the chosen mixture explains at least half of the words better than trigrams drawn evenly
from all bins would: text of no learnt language, or of none at all, is not known. Words have one vote each, so
that a long key or address does not outweigh the prose around it.

The model is fit on a hash sample of about TRAIN_ROWS labelled rows (all of them if there are fewer);
prediction reads each whole text, and nothing but the text.

Edge cases: a null text, or one without a letter, is `und` with score 0 and not known; without labelled rows every
text is `und`; rows with a null doc_id are not learnt from; a text with letters but no known trigram
still gets a learnt language; equal likelihoods go to the language that is first by name; repeated rows get equal
answers; an empty table gives an empty result; extra columns are kept by `identify`, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.llm.common import byte_chunks, fresh
from gridlore.llm.hashing import Texts

#: Labelled rows that the model is fit on, about.
TRAIN_ROWS = 20000
#: Trigrams fall into 2**BITS bins.
BITS = 15

_ASCII_LETTER = re.compile("[A-Za-z]")
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text))


def bins(buf: np.ndarray) -> np.ndarray:
    """The bin of the three bytes around each position."""
    b = np.concatenate(([10], buf, [10])).astype(np.uint32)
    return ((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def lettered_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words that have a letter."""
    start, end, _, first = texts.words()
    letters = np.concatenate(([0], np.cumsum(_LETTERS[texts.buf])))
    keep = letters[end] > letters[start]
    doc = np.repeat(np.arange(len(texts.docs)), np.diff(first))
    return start[keep], end[keep], doc[keep]


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x bins


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """labelled has text and lang, neither null; sums are made on the executors, 2**BITS a language come back."""
    n = labelled.count()
    if n > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < int(rows / n * (1 << 20)))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for part, texts in byte_chunks(batches, "text"):
            for x, lang in zip(texts, part.column("lang").to_pylist(), strict=True):
                t = Texts([x.decode().lower().encode()])
                s, e, _ = lettered_words(t)
                inside = np.zeros(len(t.buf) + 1, np.int32)
                inside[s] += 1
                inside[e] -= 1
                got = np.bincount(bins(t.buf)[np.cumsum(inside[:-1]) > 0], minlength=1 << BITS)
                total[lang] = total.get(lang, 0) + got
        for lang, x in total.items():
            at = np.flatnonzero(x)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bin": pa.array(at, pa.int32()), "n": pa.array(x[at], pa.int64())})

    sums = labelled.select("text", "lang").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    lang = sums.column("lang").to_pylist()
    names = sorted(set(lang))
    counts = np.full((len(names), 1 << BITS), 0.25)
    np.add.at(counts, (np.array([names.index(x) for x in lang], int), sums.column("bin").to_numpy().astype(int)), sums.column("n").to_numpy())
    return Model(names, np.log(counts / counts.sum(1, keepdims=True)))


#: EM ends for a document when no proportion moves by more than this in a round, or after so many rounds.
SETTLED, MOST_ROUNDS = 1e-3, 200


def mixture(e: np.ndarray, first: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over words: e holds each word's likelihoods (a row each, scaled), first each document's first word, theta the
    proportions to begin with; every document has words. Returns proportions and log-likelihoods by document."""
    size = np.diff(np.append(first, len(e)))
    theta = theta / np.maximum(theta.sum(1, keepdims=True), 1e-300)
    out = theta.copy()
    live, x, n, begin = np.arange(len(first)), e, size, first
    for _ in range(MOST_ROUNDS):
        joint = x * np.repeat(theta, n, axis=0)
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        new = np.add.reduceat(joint, begin) / n[:, None]
        moves = np.abs(new - theta).max(1) > SETTLED
        out[live] = theta = new
        if not moves.any():
            break
        if moves.mean() < 0.7:
            x, theta, live, n = x[np.repeat(moves, n)], theta[moves], live[moves], n[moves]
            begin = np.cumsum(n) - n
    fit = np.log(np.maximum((e * np.repeat(out, size, axis=0)).sum(1), 1e-300))
    return out, np.add.reduceat(fit, first)


def choose(e: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions under the best language set of each document."""
    n = e.shape[1]
    size = np.diff(np.append(first, len(e)))
    cost = penalty + 0.5 * np.log(size)
    full, most = mixture(e, first, np.ones((len(first), n)))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    one = rank < 1
    fit = np.log(np.maximum((e * np.repeat(one, size, axis=0)).sum(1), 1e-300))
    best, best_score = one.astype(float), np.add.reduceat(fit, first)
    for m in range(2, n + 1):
        # No set fits better than all languages do, but for the round in which EM stopped.
        open_ = np.flatnonzero(most + 0.01 * size - (m - 1) * cost > best_score)
        if not len(open_):
            break
        wanted = np.zeros(len(first), bool)
        wanted[open_] = True
        x, begin = e[np.repeat(wanted, size)], np.cumsum(size[open_]) - size[open_]
        theta, fit = mixture(x, begin, np.where(rank[open_] < m, full[open_] + 1e-6, 0))
        score = fit - (m - 1) * cost[open_]
        better = score > best_score[open_]
        at = open_[better]
        best[at], best_score[at] = theta[better], score[better]
    return best


def infer(texts: list[str], model: Model, penalty: float = 4.0) -> list[tuple[str, float, dict[str, float], bool]]:
    """Language, its proportion, all proportions and whether the text is known, of each text."""
    out: list[tuple[str, float, dict[str, float], bool]] = [("und", 0.0, {}, False)] * len(texts)
    if not model.languages:
        return out
    t = Texts([x.lower().encode() for x in texts])
    start, end, doc = lettered_words(t)
    if not len(start):
        return [(model.languages[0], 0.0, {}, False) if has_letter(x) else o for x, o in zip(texts, out, strict=True)]
    b = bins(t.buf)
    fits = np.empty((len(start), len(model.languages)))
    for k, logs in enumerate(model.logs):
        total = np.concatenate(([0.0], np.cumsum(logs[b])))
        fits[:, k] = total[end] - total[start]
    top = fits.max(1)
    here, first = np.unique(doc, return_index=True)
    size = np.diff(np.append(first, len(fits)))
    scaled = np.exp(fits - top[:, None])
    best = choose(scaled, first, penalty)
    each = np.log(np.maximum((scaled * np.repeat(best, size, axis=0)).sum(1), 1e-300)) + top
    known = np.add.reduceat(each >= -np.log(1 << BITS) * (end - start), first, dtype=np.int64) * 2 >= size
    for i, d in enumerate(here.tolist()):
        shares = {model.languages[k]: float(best[i, k]) for k in np.flatnonzero(best[i] > 0)}
        k = best[i].argmax()
        out[d] = (model.languages[k], min(1.0, float(best[i, k])), shares, bool(known[i]))
    return [o if o[0] == "und" or has_letter(x) else ("und", 0.0, {}, False) for x, o in zip(texts, out, strict=True)]


RESULT = "struct<lang_pred:string,score:double,languages:map<string,double>,known:boolean>"


def identify(docs: DataFrame, model: Model, into: str = "language", chunk: int = 1 << 20) -> DataFrame:
    """docs with one more column, the last: (lang_pred, score, languages, known). It is called `into`, or that with
    underscores where docs has such a column already."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64())), ("known", pa.bool_())])
    into = fresh(docs, into)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for part, texts in byte_chunks(batches, "text", chunk):
            found = infer([x.decode() for x in texts], shared.value)
            yield part.append_column(into, pa.array([{"lang_pred": a, "score": s, "languages": list(m.items()), "known": k} for a, s, m, k in found], kind))

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(RESULT))])
    return docs.mapInArrow(work, schema)


def bucket(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learnt_from(docs: DataFrame) -> DataFrame:
    """The labelled rows whose bucket is not 2."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id")) != 2)).select("text", "lang")
