"""Packing: documents' tokens into windows by Karmarkar-Karp multiway differencing.

Each document is tokenized once. Its full windows are cut off first and each becomes a sequence; the
rest is cut into units that are small beside a window. Units are dealt by a hash, taken in groups,
and each group is divided into as many windows as its tokens need: the two partial partitions with
the largest imbalance are merged largest-to-smallest until one is left, which gives near-equal
windows. Where one exceeds the capacity, the group gets one window more and is divided anew.

Only lengths, positions and checksums are shuffled; memory is bounded by a group and a text.

Edge cases: a null or empty text is the end token alone; a document of any length is cut; repeated
rows are packed each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import give_back, kept, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 1
CAPACITY = 2048
#: Tokens of a unit at most, and units of a group at least (the last of a task: all that are left).
UNIT, GROUP = 512, 512


#: Words whose ids a worker remembers; the older half goes when as many new ones have come.
REMEMBERED = 800_000
#: Long established blocks of characters; others may be newer than one of the libraries' character tables.
BLOCKS = "\x00-\u024f\u0370-\u03ff\u0400-\u04ff\u2000-\u206f\u20ac"
_rare = re.compile(f"[^{BLOCKS}]").search
# The settings of a tokenizer file under which its library encodes each match of the pattern by itself.
_PLAIN = {"normalizer": None, "truncation": None, "padding": None}
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def within_blocks(pattern: str) -> re.Pattern:
    """``pattern`` for texts within BLOCKS, its Unicode classes spelled out: the standard library then matches it faster."""
    known = [chr(c) for c in range(0x2100) if not _rare(chr(c))]
    for name in (r"\s", r"\p{L}", r"\p{N}"):
        members = "".join(f"\\u{ord(c):04x}" for c in known if regex.match(name, c))
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{members}]").replace(r"\s+", f"[{members}]+")
        # inside brackets, and by itself
        pattern = re.sub(rf"(?<=\^)((?:[^\]]*?)){re.escape(name)}", lambda m, x=members: m[1] + x, pattern).replace(name, f"[{members}]")
    return re.compile(pattern)


class Ids(dict):
    """The ids that the tokenizers library gives for a byte-level BPE vocabulary file, special tokens recognised.

    The library's model merges each word once and the ids are remembered by word, as its whole-text call
    spends most of its time on offsets. Texts that hold an added token or a character beyond long
    established blocks, and files with other settings, go through the whole-text call.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        agrees = lambda held, wanted: all((held or {}).get(k) == v for k, v in wanted.items())
        self.by_word = agrees(settings, _PLAIN) and agrees(settings["pre_tokenizer"], _SPLIT) and agrees(settings["model"], _MODEL)
        added = [t["content"] for t in settings["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.words, self.model = within_blocks(public_tokenizers.PATTERN).findall, self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            ids = struct.pack(f"<{len(tokens)}I", *(t.id for t in tokens))
        if len(word) > 64:
            return ids
        if 2 * len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.by_word and not _rare(text) and not self.added(text):
            return np.frombuffer(b"".join(map(self.__getitem__, self.words(text))), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows, then units."""
    full = n - n % capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(unit, n - s)) for s in range(full, n, unit)]


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of ``lengths`` in near-equal windows, by multiway Karmarkar-Karp.

    A partial partition is its sums other than zero, descending, each with a tree of members.
    """
    spread = lambda bins: bins[0][0] - (bins[-1][0] if len(bins) == windows else 0)
    heap = [(-n if windows > 1 else 0, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:  # the largest of b beside nothing or beside the smallest of a, and the reverse
            alone = len(a) - over
            rising = b[::-1]
            merged = a[:alone] + [(x + y, (s, t)) for (x, s), (y, t) in zip(a[alone:], rising[:over], strict=True)] + rising[over:]
        merged.sort(key=lambda x: -x[0])
        count += 1
        heapq.heappush(heap, (-spread(merged), count, merged))

    def members(tree: tuple | int) -> list[int]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else out.append(x)
        return out

    return [members(tree) for _, tree in heap[0][2]] if heap else []


def windows_of(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of ``lengths`` in as few near-equal windows as differencing fits into the capacity."""
    count = max(1, -(-sum(lengths) // capacity))
    while True:
        parts = differencing(lengths, count)
        if max((sum(lengths[i] for i in p) for p in parts), default=0) <= capacity:
            return parts
        count += 1


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, unit: int = UNIT, path: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and on request its ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tokenizer and its words serve the tasks that follow
        with kept(path, lambda: Ids(path)) as ids_of:
            for batch in batches:
                for part in slices(batch):
                    rows = []
                    for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        raw = ids_of(text).tobytes() + np.array([END], dtype="<u4").tobytes()
                        n = len(raw) // 4
                        for start, length in cuts(n, capacity, unit):
                            ids = raw[4 * start : 4 * (start + length)]
                            rows.append((doc_id, start, length, zlib.crc32(ids), n) + (ids,) * with_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, unit: int = UNIT, group: int = GROUP, path: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents, each with its sequence_id and its offset there."""
    cut = pieces(docs, capacity=capacity, unit=unit, path=path)
    names = [*cut.columns, "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []

        def packed(rows: list[tuple]) -> Iterator[tuple]:
            nonlocal following
            for part in windows_of([r[2] for r in rows], capacity):
                offset = 0
                for i in sorted(part):
                    yield (*rows[i], following, offset)
                    offset += rows[i][2]
                following += 1

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            ready = []
            for r in rows:
                if r[2] == capacity:
                    ready.append((*r, following, 0))
                    following += 1
                else:
                    waiting.append(r)
            while len(waiting) >= 2 * group:
                some, waiting = waiting[:group], waiting[group:]
                ready.extend(packed(some))
            if ready:
                yield out(ready)
        if waiting:
            yield out(list(packed(waiting)))

    dealt = cut.repartition(F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def sequences(docs: DataFrame, packed: DataFrame, *, capacity: int = CAPACITY, unit: int = UNIT, path: str = VOCABULARY) -> DataFrame:
    """sequence_id and ids (binary: little-endian unsigned 32-bit integers) of each window.

    doc_id must be unique here. A window has ``capacity`` pieces at most.
    """
    ids = pieces(docs, capacity=capacity, unit=unit, path=path, with_ids=True).select("doc_id", "start", "ids")
    parts = packed.join(ids, ["doc_id", "start"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (x, p) -> concat(x, p.ids))").alias("ids"))
