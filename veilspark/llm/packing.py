"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

A document becomes token ids and one end id.  What exceeds a window is cut off
in full windows; the remainders of a block of documents are partitioned into
windows by differencing: each remainder starts as a partial partition of its
own, and the two with the largest imbalance (largest minus smallest window)
are merged so that the large windows of one meet the small ones of the other.
While the largest window exceeds the capacity, the window count rises.  The
resulting near-equal windows are then filled up with pieces of the emptiest
ones; what is left over goes into the next block, and at a task's end into
windows whose lengths are powers of two, which need no padding.

The plan is one pass without a shuffle; a task holds one block at a time.
Sequences are numbered by partition and counter, so a task that runs again
numbers them alike.

Defined results: null text counts as empty and has the end id alone; each
repeated row is a document; an empty table gives an empty result.  Only doc_id
and text are read, so names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
#: Windows' worth of remainders in a block.
BLOCK = 24
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Chunks, and words, whose ids a worker remembers until its task ends: the first met, which hold all frequent ones.
CACHE = 250_000

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: What a tokenizer file must say for words to be encoded one by one: white space is dropped, case is folded, and
#: each run of letters, each digit and each run of other marks is a word of a byte-level BPE.  Fixed values of the format.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Tokens(dict):
    """The ids of white-space-delimited chunks as bytes, remembered.

    A tokenizer as in BY_WORDS drops white space and never merges across it, so
    a text's ids are its chunks' ids.  Chunks of plain Latin letters and ASCII
    marks go straight to the model; all others through the whole tokenizer.
    Any other tokenizer gets whole texts.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;=?@\[\]^_{}~|-]*)\Z")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        said = json.loads(self.tokenizer.to_str())
        self.by_words = all(said[k] == v for k, v in BY_WORDS.items()) and said["model"]["type"] == "BPE"
        # byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.alphabet = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[str, bytes] = {}

    def of_word(self, word: str) -> bytes:
        """Ids of a run of letters or of marks, lower-cased."""
        if (got := self.words.get(word)) is None:
            # printable ASCII stands for itself
            mapped = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))
            got = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.words) < CACHE:
                self.words[word] = got
        return got

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if (m := self.PLAIN.match(text)) and not text.startswith("<|"):
            ids = self.of_word(m[1].lower()) + (self.of_word(m[2]) if m[2] else b"")
        else:
            ids = self.whole(text)
        if len(self) < CACHE:
            self[chunk] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if not self.by_words:
            return self.whole(text.decode("utf-8", "replace"))
        # on bytes, split() knows ASCII white space alone
        return b"".join(map(self.__getitem__, text.split()))

    def forget(self) -> None:
        self.clear()
        self.words.clear()


def tokens_at(path: str | None) -> Tokens:
    """One for each worker process and file, whatever the task."""
    store = sys.modules.setdefault("_veilspark_worker", types.ModuleType("_veilspark_worker"))
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    cache = store.__dict__.setdefault("tokens", {})
    if path not in cache:
        cache[path] = Tokens(path)
    return cache[path]


def difference(lengths: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """A partition of the items into windows, as (sum, items) by falling sum, by multiway differencing.

    A partial partition is (negated imbalance, tie-break, windows by falling sum); empty windows are left out.
    """
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(a) + len(b) - windows
        if both <= 0:
            merged = a + b
        else:
            # the both smallest-placed windows of a take the smallest of b: largest to smallest
            merged = a[: len(a) - both] + b[: len(b) - both]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == windows else 0
        count += 1
        heapq.heappush(heap, (low - merged[0][0], count, merged))
    out = []
    for total, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else items.append(x)
        out.append((total, sorted(items)))
    return out


def windows_of(lengths: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """difference(), with the fewest windows, counting up, of which none exceeds the capacity."""
    n = max(1, -(-sum(lengths) // capacity))
    while True:
        out = difference(lengths, n)
        over = sum(max(0, total - capacity) for total, _ in out)
        if not over:
            return out
        n += max(1, over // capacity)


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Documents go in, rows (document, start, length, crc, document's tokens, sequence, offset) come out."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, block: int = BLOCK):
        self.sequence, self.capacity, self.block = first_sequence, capacity, block
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        full = n // c * c
        for at in range(0, full, c):
            self.put([(doc_id, at, ids[at : at + c], n)])
        if full < n:
            self.pieces.append((doc_id, full, ids[full:], n))
            self.held += n - full
        if self.held >= self.block * c:
            self.close_block()

    def put(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def close_block(self, last: bool = False) -> None:
        pieces, c = self.pieces, self.capacity
        found = windows_of([len(p[2]) for p in pieces], c) if pieces else []
        full = self.held // c
        # the emptiest windows are poured into the gaps of the others
        pour = [pieces[i] for _, items in reversed(found[full:]) for i in items][::-1]
        for total, items in found[:full]:
            window, gap = [pieces[i] for i in items], c - total
            while gap:
                doc_id, start, ids, n = pour.pop()
                window.append((doc_id, start, ids[:gap], n))
                if len(ids) > gap:
                    pour.append((doc_id, start + gap, ids[gap:], n))
                gap -= min(gap, len(ids))
            self.put(window)
        self.pieces, self.held = pour, sum(len(p[2]) for p in pour)
        if last:
            for size in powers(self.held):
                window = []
                while size:
                    doc_id, start, ids, n = self.pieces.pop()
                    window.append((doc_id, start, ids[:size], n))
                    if len(ids) > size:
                        self.pieces.append((doc_id, start + size, ids[size:], n))
                    size -= min(size, len(ids))
                self.put(window)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """A row for each piece.  tokenizer: a file's path on the executors; by default the public one."""
    small_batches(docs.sparkSession)
    schema = pa.schema([pa.field(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def run(batches):
        tokens, end = tokens_at(tokenizer), np.array([END_ID], np.uint32).tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, block)

        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                packer.add(doc_id, np.frombuffer(tokens.ids(text or b"") + end, "<u4"))
                if len(packer.rows) >= 20_000:
                    yield batch(packer.take())
            yield batch(packer.take())
        packer.close_block(last=True)
        yield batch(packer.take())
        tokens.forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
