"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Each language is a table of smoothed log-probabilities of hashed character
n-grams (1 to 4, with word ends), learnt from labelled documents.  A word's
script narrows the candidates to languages seen in that script; its score in
each is the sum over its n-grams.  Viterbi over the words with a penalty for
each change labels spans, so mixed-language texts come apart; the document's
language is the one with most letters.

The training sample is bounded: at most about TRAIN_DOCS documents of each
language, by a hash of the id; the model has languages x 2^16 cells.  All
documents are predicted in one pass.

Defined results: null texts and texts without a letter (numerals and signs are
none) are ``und`` with score 0; if nothing is labelled, all are.  A word of a script that no language was
seen in counts for none; a text with only such words goes to the first
language in order of training documents, then name, with score 0.  Ties go
the same way.  Repeated rows each count.  Null ids are predicted, not learnt
from.  Only doc_id, text and lang are read, so names cannot clash.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, revive, small_batches, table, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bound of the training sample, in documents of a language.
TRAIN_DOCS = 1500
BITS = 16
#: Cost of a change of language, in nats.
SWITCH = 15.0
SMOOTH = 0.5
CACHE = 250_000


def letters() -> str:
    """A pattern of words: letters (categories L*), with marks (M*) after the first."""
    kinds = {"L": [], "M": []}
    for c in range(sys.maxunicode + 1):
        if (k := unicodedata.category(chr(c))[0]) in kinds:
            runs = kinds[k]
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    first, more = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) for runs in kinds.values())
    return f"[{first}][{first}{more}]*"


LETTERS = re.compile(letters())
#: As quick as can be, and the same for a text that holds neither marks nor letter-like numerals.
PLAIN = re.compile(r"[^\W\d_]+")
ODD = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc", "Me", "No", "Nl"))


def words_of(text: str) -> list[str]:
    return (PLAIN if text.isascii() or ODD.isdisjoint(text) else LETTERS).findall(text)

#: First code points of script ranges, and the scripts' names.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words at once: the n-grams' cells, the place where each word's cells begin, each word's script."""
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    stop = text == 10
    word = np.cumsum(stop) - 1  # a word end belongs to the word after it
    cells, owner = [], []
    h = np.zeros(len(text), np.uint64)
    whole = np.ones(len(text), bool)
    for n in range(1, 5):
        h = mix64(np.concatenate([h[: len(text) - n + 1]]) * np.uint64(31) + text[n - 1 :] + np.uint64(n))
        whole = whole[: len(h)]
        if n > 1:  # no word end inside
            whole = whole & ~(stop[n - 2 : n - 2 + len(h)] if n > 2 else np.zeros(len(h), bool))
        ok = whole & ~(stop[: len(h)] if n == 1 else np.zeros(len(h), bool))
        cells.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(word[: len(h)][ok])
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    keep = owner < len(words)
    cells, owner = cells[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(words)))
    first = text[np.flatnonzero(stop)[: len(words)] + 1]
    place = np.searchsorted(np.array([a for a, _ in SCRIPTS], np.uint64), first, side="right") - 1
    script = np.array([NAMES.index(name) for _, name in SCRIPTS])[place]
    return cells[order], begin, script


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """langs by priority; counts: language x cell; scripts: language x script, words seen."""
        self.langs = langs
        p = np.log(counts + SMOOTH) - np.log(counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1])
        self.cells = np.ascontiguousarray(p.T.astype(np.float32))
        # a language writes in a script if more than one word in a thousand is in it
        self.uses = scripts > 0.001 * np.maximum(1, scripts.sum(1, keepdims=True))

    def scores(self, words: list[str]) -> np.ndarray:
        cells, begin, script = grams(words)
        s = np.add.reduceat(self.cells[cells], begin, axis=0)
        uses = self.uses[:, script].T
        low = np.where(uses, s, np.inf).min(1, keepdims=True)
        some = uses.any(1, keepdims=True)
        s = np.where(uses, s, np.where(np.isfinite(low), low, 0) - np.float32(SWITCH))
        return np.where(some, s - s.max(1, keepdims=True), 0).astype(np.float32)


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word.

    A path that uses the best single language somewhere pays a switch for each
    stretch without it, one that never does a switch less than it has stretches.
    So staying with that language is optimal if no stretch gains more than half
    a switch over it, or none more than a switch and the best other languages of
    all words together neither; else the full recursion runs.
    """
    best = int(s.sum(0, dtype=np.float64).argmax())
    gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low = np.vstack([np.zeros((1, s.shape[1])), low[:-1]])
    most = (gain - low).max()
    if most <= switch / 2 or most <= switch and (np.delete(s, best, 1).max(1) - s[:, best]).sum(dtype=np.float64) <= switch:
        return np.full(len(s), best, np.int32)
    rows, n = s.tolist(), s.shape[1]
    total, back = rows[0], np.zeros(s.shape, np.int32)
    for i in range(1, len(rows)):
        top = max(total)
        t, row, new = total.index(top), rows[i], []
        for j in range(n):
            if total[j] >= top - switch:
                back[i, j] = j
                new.append(total[j] + row[j])
            else:
                back[i, j] = t
                new.append(top - switch + row[j])
        total = new
    out = np.empty(len(rows), np.int32)
    j = int(np.argmax(total))
    for i in range(len(rows) - 1, -1, -1):
        out[i] = j
        j = back[i, j]
    return out


def spans(words: list[str], path: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, number of words, language) of each run of a path."""
    at = np.flatnonzero(np.diff(path, prepend=-1))
    return [(int(a), int(b - a), int(path[a])) for a, b in zip(at, [*at[1:], len(words)], strict=True)]


class Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Model:
    """docs(doc_id, text, lang): all of them labelled."""
    spark = docs.sparkSession
    # a row for each language
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros((0, len(NAMES))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1_000_000, per_lang * 1_000_000 // n + 1)))])
    sample = docs.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if words := words_of(text or ""):
                    cells, _, script = grams(words)
                    t = total.setdefault(lang, np.zeros((1 << BITS) + len(NAMES), np.int64))
                    np.add.at(t, cells, 1)
                    np.add.at(t, (1 << BITS) + script, 1)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "cell": pa.array(at, pa.int64()), "n": pa.array(t[at], pa.int64())})

    rows = sample.mapInArrow(tidy(count), "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # at most languages x (2^16 + scripts) rows
    got = rows.toPandas()
    counts = np.zeros((len(langs), (1 << BITS) + len(NAMES)))
    counts[got["lang"].map(langs.index).to_numpy(dtype=int), got["cell"].to_numpy(dtype=int)] = got["n"].to_numpy()
    return Model(langs, counts[:, : 1 << BITS], counts[:, 1 << BITS :])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the spans (first word, words, language) of each document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)  # languages x 2^16 floats

    def run(batches):
        m, cache = revive(Model, shared.value), Numbered()
        matrix = np.empty((1 << 14, len(m.langs)), np.float32)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            preds, scores, found = [], [], []
            if len(cache) > CACHE:
                cache = Numbered()
            lists = [words_of(t) if t else [] for t in texts]
            before = len(cache)
            places = [np.fromiter(map(cache.__getitem__, w), np.int64, len(w)) for w in lists]
            if len(cache) > before and m.langs:
                while len(matrix) < len(cache):
                    matrix = np.vstack([matrix, np.empty_like(matrix)])
                matrix[before : len(cache)] = m.scores(list(itertools.islice(cache, before, None)))
            for words, at in zip(lists, places, strict=True):
                if not words or not m.langs:
                    preds.append("und"), scores.append(0.0), found.append([])
                    continue
                s = matrix[at]
                path = viterbi(s)
                size = np.fromiter(map(len, words), np.int64, len(words)) * s.any(1)
                letters = np.bincount(path, weights=size, minlength=len(m.langs))
                best = int(letters.argmax())
                preds.append(m.langs[best])
                scores.append(float(letters[best] / max(1, size.sum())))
                found.append([{"first": a, "words": n, "lang": m.langs[j]} for a, n, j in spans(words, path)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    held = lambda c: F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))
    learn = docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    out = identify(docs, train(learn))
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
