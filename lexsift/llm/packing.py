"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the packing problem of any corpus is a
histogram with at most ``capacity`` entries.  Spark tokenises and counts; the driver packs the
histogram (its work and memory don't depend on the number of documents); Spark then deals
documents into the planned bins by their rank among documents of the same length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, materialise

CAPACITY = 2048
MARKS = ".,;:!?#*$%&|"
LETTERS = re.compile("[a-z]+").fullmatch


class WordIds:
    """Token ids of whole texts by a word-level BPE, remembering the ids of single words.

    The tokenizer's own rules never let a token cross white space, so ids of a text are the
    ids of its words in turn.  Texts with the tokenizer's special strings, or with the control
    characters on which Python's and the tokenizer's idea of white space differ, are encoded
    whole.  The memory holds at most ``bound`` words of at most 64 characters.
    """

    def __init__(self, path: str, bound: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound, self.known = Tokenizer.from_file(path), bound, {}
        self.merges = self.tokenizer.model

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._encode([text])[0]
        words, known = text.split(), self.known
        ids = list(map(known.get, words))
        if None in ids:
            missing = {w for w, x in zip(words, ids, strict=True) if x is None}
            fresh = self._learn(missing)
            ids = [fresh[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            if len(known) + len(fresh) > self.bound:
                known.clear()
            known.update((w, x) for w, x in islice(fresh.items(), self.bound) if len(w) <= 64)
        return b"".join(ids)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not yet known, and of their parts.

        Marks at a word's end are a token run of their own, if a letter or digit is before them also in
        lower case.  Words are known by their lower case, which the tokenizer takes anyway; only in
        scripts where the two surely agree.
        """
        known, split, plain = self.known, {}, set()
        for word in words:
            core = word.rstrip(MARKS)
            if core and core[-1].isalnum():
                low = core.lower() if max(core) < "\u0250" else core
                if low != word and core[-1].lower()[-1].isalnum():  # a letter may become several, the last one a mark
                    split[word] = low, word[len(core) :]
                    plain.add(low)
                    if len(core) < len(word):
                        plain.add(word[len(core) :])
                    continue
            plain.add(word)
        fresh, others = {}, []
        for word in plain:
            if word in known:
                fresh[word] = known[word]
            elif LETTERS(word):  # a single run of letters goes straight to the merges
                fresh[word] = array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()
            else:
                others.append(word)
        fresh.update(zip(others, self._encode(others), strict=True))
        for word, (low, marks) in split.items():
            fresh[word] = fresh[low] + fresh[marks] if marks else fresh[low]
        return fresh


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, chunk, slot (and ids).

    A document is its token ids and then ``end_id``; longer ones are cut at ``capacity``.
    Null and empty texts give the end id alone.  ``slot`` counts pieces of the same length
    within the task ``chunk``.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int32()), ("slot", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids
    schema = pa.schema(fields)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, seen = kept(("words", tokenizer_path), lambda: WordIds(tokenizer_path)), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in it:
            out: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    row = (doc_id, piece, at // 4, n, zlib.crc32(part), chunk, seen[n])
                    seen[n] += 1
                    for values, value in zip(out, row, strict=False):
                        values.append(value)
                    if keep_ids:
                        out[-1].append(np.frombuffer(part, "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, fields, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, slot long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, copies)...]) that use up ``counts`` (length: number).

    A bin starts with the longest document left and is filled greedily with the longest that
    fits.  While a gap stays, the bin's smallest document gives way to the two unpacked
    documents that fill the widened gap best, if they fill more than it did.  The same bin is
    then made as often as the counts allow, so work follows the number of distinct lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    lengths = sorted(left)
    bins = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity

        def free(n: int, used: dict[int, int] = used) -> int:
            return left[n] - used.get(n, 0)

        at = len(lengths)
        while gap:
            at = bisect_right(lengths, gap, 0, at) - 1
            if at < 0:
                break
            n = lengths[at]
            if k := min(gap // n, free(n)):
                used[n] = used.get(n, 0) + k
                gap -= n * k
        while gap and sum(used.values()) > 1:
            small = min(used)
            used[small] -= 1
            pair = _best_pair(lengths, free, gap + small)
            if pair is None or sum(pair) <= small:
                used[small] += 1
                break
            for n in pair:
                used[n] = used.get(n, 0) + 1
            used = {n: k for n, k in used.items() if k}
            free.__defaults__ = (used,)
            gap += small - sum(pair)
        times = min(left[n] // k for n, k in used.items())
        bins.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= times * k
        if any(not left[n] for n in used):
            lengths = [n for n in lengths if left[n]]
    return bins


def _best_pair(lengths: list[int], free, room: int) -> tuple[int, int] | None:
    """The two free documents with the largest sum that is at most ``room``."""
    best, lo, hi = None, 0, bisect_right(lengths, room - 1) - 1
    while lo <= hi:
        a, b = lengths[lo], lengths[hi]
        if a + b > room or not free(b):
            hi -= 1
            continue
        if free(a) and (a != b or free(a) > 1):
            if best is None or a + b > sum(best):
                best = (a, b)
                if a + b == room:
                    break
        lo += 1
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``tokenised_pieces``; rows keep all other columns.

    ``pieces`` must be a stored table: chunk and slot are facts about how it was written.
    An empty table gives an empty result.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, first = dict.fromkeys(counts, 0), 0
    for times, items in best_two_fit(counts, capacity):
        offset = 0
        for n, k in items:
            table.setdefault(n, []).append((taken[n], k, first, offset))
            taken[n] += times * k
            offset += n * k
        first += times
    plan = {n: np.array(rows, np.int64) for n, rows in table.items()}

    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("chunk", "length").count().select("chunk", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(starts, ["chunk", "length"]).withColumn("slot", F.col("slot") + F.col("base")).drop("chunk", "base")
    names = [c for c in ranked.columns if c not in ("slot", "length")]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, rank = batch.column("length").to_numpy(), batch.column("slot").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                rows, mine = plan[int(length)], np.flatnonzero(n == length)
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                seq[mine] = row[:, 2] + (rank[mine] - row[:, 0]) // row[:, 1]
                off[mine] = row[:, 3] + (rank[mine] - row[:, 0]) % row[:, 1] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("length"), pa.array(seq), pa.array(off)], names=[*names, "length", "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(deal, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` and pack all pieces into sequences of ``capacity``.

    Returns doc_id, piece, start, ids_crc32, [ids,] length, sequence_id, offset.  Null ids stay
    null and repeated rows are packed each on its own; extra columns are ignored.
    """
    return pack(materialise(tokenised_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity)
