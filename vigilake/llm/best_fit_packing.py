"""Best-fit packing: all documents into as few sequences of at most SIZE tokens as it can.

Linear grouping. Only the histogram of piece lengths (SIZE numbers at most) reaches the driver, where the plan is made:
large lengths are dealt into groups of equal cardinality and rounded up to their group's longest; fillings of a sequence
by these few sizes are chosen, each the fullest that holds the longest size left, and used as often as the demand allows;
the actual lengths then take the places of the rounded ones, longest first; the small lengths go, longest first, to the
fullest sequence that still has room. The plan is a short table of runs: the pieces of one length with these ranks go to
those sequences. Pieces get their rank within their length by counting per task and adding up, and a join with the
plan places them; no piece is ever collected.

A document's tokens end with the token END. Documents longer than SIZE are cut into pieces of SIZE tokens, the last
one shorter; no other document is cut. Defined results: a null or empty text is the END token alone; repeated rows are
packed as often as they come; null ids are packed as well; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm.common import checked, save, table
from vigilake.llm.words import KEPT, slices

SIZE, END = 4096, 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Lengths above this share of SIZE are large; into so many groups they are dealt.
LARGE, GROUPS = 1 / 8, 512
#: Parts of words whose ids a worker remembers, twice over (these and the last generation).
PARTS_HELD = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


class WordTokens:
    """Token ids by part of a word, for a tokenizer that lower-cases, drops white space and splits texts as _PARTS does before it merges.

    In a text of plain characters the parts are found by that pattern; of others, each word with such a character is a part as a whole.
    """

    _PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
    _MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(self._MARK, add_special_tokens=False).ids

    def _split(self, text: str) -> list[str]:
        if "<|" not in text and self._PLAIN.fullmatch(text):  # special tokens begin with <|
            return self._PARTS.findall(text.lower())
        out = []
        for word in text.replace("\n", " ").split(" "):
            out += self._PARTS.findall(word.lower()) if "<|" not in word and self._PLAIN.fullmatch(word) else [word]
        return out

    def _encode(self, parts: list[str]) -> None:
        """Learn the ids of parts, many at a time with a mark between them."""
        if len(self.mark) != 1:
            own, parts = parts, []
        else:
            own, parts = [x for x in parts if self._MARK in x], [x for x in parts if self._MARK not in x]
        lists = [parts[i : i + 500] for i in range(0, len(parts), 500)]
        for some, found in zip(lists, self.tokenizer.encode_batch_fast([f" {self._MARK} ".join(x) for x in lists], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cut = [-1, *np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            raw = ids.tobytes()
            self.parts.update((x, raw[4 * a + 4 : 4 * b]) for x, a, b in zip(some, cut[:-1], cut[1:], strict=True))
        self.parts.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self._split(x) for x in texts]
        parts, old = self.parts, self.old
        missing = {x for words in split for x in words if x not in parts}
        parts.update((x, old[x]) for x in missing if x in old)
        if ask := [x for x in missing if x not in parts]:
            self._encode(ask)
        out = [b"".join(map(parts.__getitem__, words)) for words in split]
        if len(parts) > PARTS_HELD:
            self.parts, self.old = {}, parts
        return out


@lru_cache(1)
def _words(path: str) -> WordTokens:
    """One for each worker process, so that what it has learned serves its later tasks."""
    return WordTokens(path)


KEPT["word tokens"] = _words.cache_clear


def _pieces(path: str, size: int, with_ids: bool):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = _words(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for part, _, _ in slices(batches, "text", 2 << 20, "word tokens"):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), words.ids([x or "" for x in part.column(1).to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, crc32(own), task, int(seen[n]), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None))
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))[: 8 if with_ids else 7]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"][: len(types)])

    return run


def _fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """How often each size is used (left[i] at most) in a fullest filling of room."""
    best = np.full(room + 1, -1, np.int64)  # the last size that reached a sum, with the number of them
    best[0], how = len(sizes), {}
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for i, s in enumerate(sizes):
        for _ in range(min(left[i], room // s)):
            to = np.flatnonzero(reached[: room + 1 - s]) + s
            to = to[~reached[to]]
            if not len(to):
                break
            reached[to] = True
            for t in to.tolist():
                how[t] = i
        if reached[room]:
            break
    counts, at = [0] * len(sizes), int(np.flatnonzero(reached)[-1])
    while at:
        counts[how[at]] += 1
        at -= sizes[how[at]]
    return counts


def plan(histogram: dict[int, int], size: int = SIZE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces of the run per sequence, offset in the sequence).

    The pieces of a length with ranks from `first rank` on go to consecutive sequences, so many to each, side by side from the offset on.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, sequences)
    opened = 0

    def place(length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], pieces, sequence, each, offset))
        rank[length] += pieces

    # groups of equal cardinality, the longest first, each a queue of (length, pieces)
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n > size * LARGE]
    total, queues, sizes = sum(c for _, c in large), [], []
    each = max(1, -(-total // groups))
    own, have = deque(), 0
    for n, c in large:
        while c:
            take = min(c, each - have)
            own.append((n, take))
            have, c = have + take, c - take
            if have == each:
                queues.append(own)
                own, have = deque(), 0
    if own:
        queues.append(own)
    sizes = [q[0][0] for q in queues]
    left = [sum(c for _, c in q) for q in queues]
    while any(left):
        first = next(i for i, c in enumerate(left) if c)
        rest = left.copy()
        rest[first] -= 1
        used = _fill(size - sizes[first], sizes, rest)
        used[first] += 1
        often = min(left[i] // u for i, u in enumerate(used) if u)
        slots = [i for i, u in enumerate(used) for _ in range(u)]
        cut = {0, often}
        taken = []
        for i in slots:  # actual lengths for one place in all these sequences
            lengths, at = [], 0
            while at < often:
                n, c = queues[i].popleft()
                take = min(c, often - at)
                if c > take:
                    queues[i].appendleft((n, c - take))
                lengths.append((at, n))
                at += take
                cut.add(at)
            taken.append(lengths)
            left[i] -= often
        marks, at = sorted(cut), [0] * len(slots)
        for a, b in pairwise(marks):
            offset = 0
            for k, lengths in enumerate(taken):
                while at[k] + 1 < len(lengths) and lengths[at[k] + 1][0] <= a:
                    at[k] += 1
                place(lengths[at[k]][1], b - a, opened + a, 1, offset)
                offset += lengths[at[k]][1]
            if offset < size:
                free[size - offset].append((opened + a, b - a))
        opened += often
    rooms = sorted(free)
    for n in sorted((x for x in histogram if 0 < x <= size * LARGE), reverse=True):
        c = histogram[n]
        while c:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                fit = size // n
                bins = max(1, c // fit)
                room, span = size, (opened, bins)
                opened += bins
            else:
                room = rooms[k]
                span = free[room].pop()
                if not free[room]:
                    rooms.pop(k)
            fit = min(room // n, c)
            bins = min(span[1], c // fit)
            place(n, bins * fit, span[0], fit, size - room)
            c -= bins * fit
            for own_room, own_span in ((room - fit * n, (span[0], bins)), (room, (span[0] + bins, span[1] - bins))):
                if own_room and own_span[1]:
                    if not free[own_room]:
                        bisect.insort(rooms, own_room)
                    free[own_room].append(own_span)
    return runs


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    spark = docs.sparkSession
    pieces = save(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, size, with_ids), PIECES + ", ids array<int>" * with_ids), "pieces")
    counts = save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    runs = spark.createDataFrame(plan(histogram, size), "length long, first long, pieces long, sequence long, each long, at long")
    ranked = pieces.join(checked(before), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    k = F.col("rank") - F.col("first")
    # the plan is bounded by the number of lengths, not by the documents
    placed = ranked.join(F.broadcast(runs), "length").where((k >= 0) & (k < F.col("pieces")))
    placed = placed.withColumns({"sequence_id": F.col("sequence") + F.floor(k / F.col("each")).cast("long"), "offset": F.col("at") + (k % F.col("each")) * F.col("length")})
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
