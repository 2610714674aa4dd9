"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

Words fall into bins of about equal mass, in order of frequency, bins into classes, and the words of a bin into slots:
P(word | history) = P(class | history) P(bin | class, history) P(slot | bin, history) P(word | slot).
All factors but the last are softmaxes over sums of weight rows, one row for each active feature:
the previous word, the previous two, words two and three back (skips), and the class or bin alone, all
hashed; slots have the previous word and the bin alone.  The number of rows grows with the square root of the training tokens.  A slot holds one word,
or in the rare bins a few, which have their shares of it.  Words outside the head have slots by hash, each with
room for an unseen word, so probabilities of the vocabulary and one unknown word a slot add up to 1.

Training is by rounds of distributed gradient updates: every task runs minibatch AdaGrad over its
part of the corpus from the common weights, and the changes of a row are averaged by how often
tasks have used it.  A task works on as many tokens as the rows need, however the input is split, so
what a round gains does not shrink with more partitions.  Vocabulary counts and words outside the head never
pass through the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept, materialise

END = b"\n"  # no word holds a line break
CLASSES = 32  # as many bins in each, and as many slots in a bin
BINS = CLASSES * CLASSES
#: Most words with an id of their own, and most bytes of such a word; all others have slots by hash.
HEAD, LONGEST = 1 << 18, 64
TAILS = 4096  # ids that other words share as history; a multiple of CLASSES
ROUNDS, BATCH, RATE = 2, 4096, 0.1
#: Weight rows of a softmax for the square root of the training tokens; least and most of them.
ROWS, FEWEST, MOST = 4, 1 << 16, 1 << 20
#: Tokens that a training task takes for each weight row, and least tokens for a task.
PER_ROW, LEAST = 64, 1 << 21
CHUNK, FAN = 1024, 32  # weight rows travel so many at a time; changes are added so many at a time
SLICE = 1 << 22  # bytes of text that are split into words at a time


def rows_for(tokens: int) -> int:
    """Weight rows of each softmax for so many training tokens."""
    return int(min(MOST, max(FEWEST, ROWS * tokens**0.5)))


def split_words(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Texts in slices of bounded size: where a slice begins, its words in a row (binary), and how many each text has.

    A-Z are lower-cased and words are what stands between ASCII white space; a null is empty.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(at, end - at), "")))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)  # edges of a text give empty words
        before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        yield at, flat.filter(full).cast(pa.binary()), before[offsets[1:]] - before[offsets[:-1]]
        at = end


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token binary, c): occurrences in ``docs(text)``, each text followed by END."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("lm", "counts"), tuple)  # a worker lets go of the model of an earlier query
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())], names=["token", "c"])
            for _, words, _ in split_words(batch.column(0)):
                tally = words.value_counts()
                yield pa.RecordBatch.from_arrays([tally.field(0), tally.field(1)], names=["token", "c"])
        give_back()

    partial = docs.select(F.col("text").cast("string")).mapInArrow(run, "token binary, c long")
    return partial.groupBy("token").agg(F.sum("c").alias("c")).filter("c > 0")


class Vocabulary:
    """The frequent words with class, bin and slot; everything else is the tail, in the slots of the last bin.

    ``tails`` holds tokens and distinct words of the tail for each of its slots.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, tails: np.ndarray):
        self.words, self.counts, self.total, self.distinct, self.tails = words, counts, total, distinct, tails
        self.rows = rows_for(total)
        bins, n = BINS - 1, len(words)
        before = np.cumsum(counts) - counts / 2
        own = np.minimum(before * bins // max(1, counts.sum()), bins - 1).astype(np.int64) if n else np.zeros(0, np.int64)
        mass = np.bincount(own, counts, bins + 1).astype(float)
        members = np.bincount(own, minlength=bins)
        first = np.cumsum(members) - members
        place = np.arange(n) - first[own]
        start = np.r_[0.0, np.cumsum(counts)][first]
        by_mass = np.minimum((before - start[own]) * CLASSES // mass[own], CLASSES - 1).astype(np.int64) if n else own
        slot = np.where(members[own] > CLASSES, by_mass, place)
        in_slot = np.bincount(own * CLASSES + slot, counts, BINS * CLASSES).astype(float)
        share = np.log(counts / in_slot[own * CLASSES + slot]) if n else np.zeros(0)
        room = tails.sum(axis=1) + 1.0  # add-one within a slot of the tail, an unseen word included
        in_slot[bins * CLASSES :] = tails[:, 0] + 0.5
        mass[bins] = in_slot[bins * CLASSES :].sum()
        mass[mass == 0] = 1e-3  # bins and slots without words keep a negligible, proper probability
        in_slot = in_slot.reshape(BINS, CLASSES)
        in_slot += (in_slot == 0) * (1e-6 * in_slot.sum(axis=1, keepdims=True) + 1e-9)
        by_class = mass.reshape(CLASSES, CLASSES)
        self.class_start = np.log(by_class.sum(1) / by_class.sum()).astype(np.float32)
        self.bin_start = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
        self.slot_start = np.log(in_slot / in_slot.sum(1, keepdims=True)).astype(np.float32)
        self.alone = np.r_[members < 2, False]  # bins of one word have no third factor
        # For ids of the head, then for those that tail words share.
        tail = np.arange(TAILS) % CLASSES
        self.bin = np.r_[own, np.full(TAILS, bins)].astype(np.int32)
        self.slot = np.r_[slot, tail].astype(np.int32)
        self.share = np.r_[share, -np.log(room[tail])]


_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of the parts, the last one last."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ (np.asarray(part).astype(np.uint64) + np.uint64(1))) * _SPREAD
            h = h ^ (h >> np.uint64(29))
    return h


#: A hash of each feature of a softmax together with what the outcome lies in.
_WITHIN = {kind: _mixed(kind, np.arange(BINS)) for kind in range(1, 11)}


def history(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word before each token of concatenated texts, of the second and of the third word back, and of the two words before.

    None looks beyond its text.
    """
    start = np.int64(1 << 40)
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    back = []
    for k in (1, 2, 3):
        shifted = np.r_[np.full(min(k, len(ids)), start), ids[:-k]] if len(ids) > k else np.full(len(ids), start)
        back.append(np.where(place >= k, shifted, start))
    one, two, three = back
    return [_mixed(1, one), _mixed(2, two), _mixed(3, three), _mixed(1, one, two)]


def features(which: int, rows: int, back: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """Rows, from 0 to rows - 1, of the softmax of classes (0), bins (1) or slots (2); ``group`` is what the outcome lies in."""
    one, two, three, both = back
    if which == 0:
        hashes = [one, both, two, three]
    elif which == 1:
        hashes = [one ^ _WITHIN[4][group], two ^ _WITHIN[5][group], _WITHIN[7][group], both ^ _WITHIN[8][group]]
    else:
        hashes = [one ^ _WITHIN[9][group], _WITHIN[10][group]]
    found = np.empty((len(one), len(hashes)), np.int64)
    for k, h in enumerate(hashes):
        h = h * _SPREAD >> np.uint64(32)
        h *= np.uint64(rows)
        np.right_shift(h, np.uint64(32), out=found[:, k], casting="unsafe")
    return found


#: Rows of weights that are worked on at a time, so that they stay in a core's cache.
NEAR = 1024
_LINE = np.dtype((np.void, 4 * CLASSES))


def _lines(rows: np.ndarray) -> np.ndarray:
    """Rows of weights as single items, which numpy puts in place faster."""
    return rows.view(_LINE)[:, 0]


_ONES = np.ones(CLASSES, np.float32)


def _exponentials(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, wide: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised probabilities of all outcomes and their sums; logits are kept within float32's range."""
    logits = np.empty((len(rows), CLASSES), np.float32)
    for at in range(0, len(rows), NEAR):
        some, out = rows[at : at + NEAR], logits[at : at + NEAR]
        np.take(weights, some[:, 0], axis=0, out=out, mode="clip")  # all are in range; checking that would copy
        for k in range(1, rows.shape[1]):
            out += np.take(weights, some[:, k], axis=0)
        out += bias if bias.ndim == 1 else bias[at : at + NEAR]
        if wide:
            np.clip(out, -80, 60, out=out)
        np.exp(out, out=out)
    return logits, logits @ _ONES


def is_wide(weights: np.ndarray, more: float = 0.0) -> bool:
    """Whether sums of weights that may yet grow by ``more`` can leave the range in which float32's exponential is safe."""
    return 4 * (float(np.abs(weights).max(initial=0)) + more) > 45  # starting logits are from -35 to 0


def factors(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, slice | np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For batches of tokens, each softmax with its tokens' places, feature rows, starting logits and outcomes."""
    back = history(ids, first)
    bins, slots = vocabulary.bin[ids], vocabulary.slot[ids]
    for at in range(0, len(ids), BATCH):
        part = slice(at, at + BATCH)
        some, b = [x[part] for x in back], bins[part]
        group = b // CLASSES
        yield 0, part, features(0, vocabulary.rows, some, group), vocabulary.class_start, group
        yield 1, part, features(1, vocabulary.rows, some, group), vocabulary.bin_start[group], b % CLASSES
        open_ = np.flatnonzero(~vocabulary.alone[b])
        if len(open_):
            inner = b[open_]
            yield 2, open_ + at, features(2, vocabulary.rows, [x[open_] for x in some], inner), vocabulary.slot_start[inner], slots[part][open_]


def blank(rows: int) -> list[np.ndarray]:
    """Starting weights of the three softmaxes: each word has its share of the corpus."""
    return [np.zeros((rows, CLASSES), np.float32) for _ in range(3)]


def token_logs(vocabulary: Vocabulary, weights: list[np.ndarray], ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural logs of the probability of each token's slot."""
    out, wide = np.zeros(len(ids)), [is_wide(w) for w in weights]
    for which, part, rows, bias, target in factors(vocabulary, ids, first):
        value, total = _exponentials(weights[which], rows, bias, wide[which])
        out[part] += np.log(value[np.arange(len(rows)), target].astype(float) / total)
    return out


def row_sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, sums, uses): the sum of values[i] for each row number in rows[i], in halvings of its list."""
    flat, width = rows.ravel(), rows.shape[1]
    order = np.argsort(flat.astype(np.uint16), kind="stable") if flat.max(initial=0) < 1 << 16 else np.argsort(flat)
    sorted_rows = flat[order]
    ends = np.flatnonzero(np.r_[sorted_rows[1:] != sorted_rows[:-1], True])
    count = np.diff(np.r_[-1, ends])
    first, token = ends - count + 1, order // width
    sums, some = np.take(values, token[first], axis=0), np.flatnonzero(count > 1)
    if len(some):
        left = count[some]
        start = np.cumsum(left) - left
        lists = np.take(values, token[np.repeat(first[some] - start, left) + np.arange(left.sum())], axis=0)
        live = start
        while len(live):
            half = (left + 1) // 2
            moved = left - half
            source = np.repeat(live + half - (np.cumsum(moved) - moved), moved) + np.arange(moved.sum())
            goal = source - np.repeat(half, moved)
            both = np.take(lists, goal, axis=0)
            both += np.take(lists, source, axis=0)
            _lines(lists)[goal] = _lines(both)
            live, left = live[half > 1], half[half > 1]
        _lines(sums)[some] = _lines(np.take(lists, start, axis=0))
    return sorted_rows[ends], sums, count


class Trainer:
    """Minibatch AdaGrad, a step size for each weight, from given weights; counts the use of each row."""

    def __init__(self, vocabulary: Vocabulary, weights: list[np.ndarray], rate: float = RATE):
        self.vocabulary, self.start, self.rate = vocabulary, weights, rate
        self.weights = [w.copy() for w in weights]
        self.squares = [np.full(w.shape, 1e-2, np.float32) for w in weights]
        self.used = [np.zeros(len(w), np.int64) for w in weights]

    def learn(self, ids: np.ndarray, first: np.ndarray) -> None:
        wide = [is_wide(w, 2 * self.rate * (len(ids) / BATCH + 1) ** 0.5) for w in self.weights]  # as far as AdaGrad can move a weight
        for which, _, rows, bias, target in factors(self.vocabulary, ids, first):
            self._step(which, rows, bias, target, wide[which])

    def _step(self, which: int, rows: np.ndarray, bias: np.ndarray, target: np.ndarray, wide: bool) -> None:
        weights, squares = self.weights[which], self.squares[which]
        error, total = _exponentials(weights, rows, bias, wide)
        error *= (1 / total)[:, None]
        error[np.arange(len(rows)), target] -= 1
        touched, gradient, count = row_sums(error, rows)
        for at in range(0, len(touched), NEAR):
            some, step = touched[at : at + NEAR], gradient[at : at + NEAR]
            square = np.take(squares, some, axis=0)
            square += step * step
            _lines(squares)[some] = _lines(square)
            step *= self.rate
            step /= np.sqrt(square, out=square)
            moved = np.take(weights, some, axis=0)
            moved -= step
            _lines(weights)[some] = _lines(moved)
        self.used[which][touched] += count

    def changes(self) -> Iterator[dict]:
        """Chunks of rows that were used: mean change in half precision, and use."""
        for which, (new, old, used) in enumerate(zip(self.weights, self.start, self.used, strict=True)):
            for chunk in range(-(-len(new) // CHUNK)):
                part = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
                if used[part].any():
                    yield {"which": which, "chunk": chunk, "change": (new[part] - old[part]).astype(np.float16).tobytes(), "used": used[part].astype(np.float32).tobytes()}


def _mean(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Mean change of a chunk's rows over tasks, weighed by use, and all use."""
    total, use = 0.0, 0.0
    for c, u in zip(table.column("change"), table.column("used"), strict=True):
        used = np.frombuffer(u.as_py(), np.float32)
        total = total + np.frombuffer(c.as_py(), np.float16).reshape(-1, CLASSES).astype(np.float32) * used[:, None]
        use = use + used
    return (total / np.maximum(use, 1)[:, None]).astype(np.float16), use


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, per_row: int = PER_ROW, least: int = LEAST) -> list[np.ndarray]:
    """Weights after every text of the stored ``encoded(ids, part)`` was used in the round ``part`` names."""
    spark, weights = encoded.sparkSession, blank(vocabulary.rows)
    shared, name = spark.sparkContext.broadcast(_parts(vocabulary)), uuid.uuid4().hex  # at most HEAD words
    tasks = max(1, round(vocabulary.total / rounds / max(least, per_row * vocabulary.rows)))
    schema = pa.schema([("which", pa.int32()), ("chunk", pa.int32()), ("task", pa.int32()), ("change", pa.binary()), ("used", pa.binary())])
    ddl = "which int, chunk int, task int, change binary, used binary"
    for number in range(rounds):
        now = spark.sparkContext.broadcast(weights)  # three tables of rows_for(tokens) rows

        def run(it: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own = kept(("lm", name), lambda: Vocabulary(*shared.value))
            trainer, task = Trainer(own, now.value), TaskContext.get().partitionId()
            for batch in it:
                for _, ids, first in _portions(batch.column(0)):
                    trainer.learn(ids, first)
            for row in trainer.changes():
                yield pa.RecordBatch.from_pylist([row | {"task": task // FAN}], schema=schema)
            del trainer
            give_back()

        def add(table: pa.Table) -> pa.Table:
            change, used = _mean(table)
            return pa.table([table["which"][:1], table["chunk"][:1], pa.array([table["task"][0].as_py() // FAN], pa.int32()), [change.tobytes()], [used.astype(np.float32).tobytes()]], schema=schema)

        moved = encoded.filter(F.col("part") == number).select("ids").coalesce(tasks).mapInArrow(run, ddl)
        groups = -(-tasks // FAN)
        while groups > 1:  # means of FAN at a time, so that no task holds the changes of all others
            moved, groups = moved.groupBy("which", "chunk", "task").applyInArrow(add, ddl), -(-groups // FAN)
        table = materialise(moved, "changes").groupBy("which", "chunk").applyInArrow(add, ddl).toArrow()
        weights = [w.copy() for w in weights]
        for which, chunk, change in zip(table["which"].to_pylist(), table["chunk"].to_pylist(), table["change"], strict=True):
            weights[which][chunk * CHUNK : (chunk + 1) * CHUNK] += np.frombuffer(change.as_py(), np.float16).reshape(-1, CLASSES)
        now.destroy()
    return weights


def _parts(v: Vocabulary) -> tuple:
    return v.words, v.counts, v.total, v.distinct, v.tails


def _portions(lists: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stored ids of texts in portions: the number of texts, their ids in a row, and where each begins."""
    held, size = [], 0
    for value in lists:
        held.append(np.frombuffer(value.as_py(), "<i4"))
        size += len(held[-1])
        if size >= most:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    sizes = np.array([len(h) for h in held])
    return len(held), np.concatenate(held).astype(np.int64), np.cumsum(sizes) - sizes


def head(vocabulary: DataFrame, most: int = HEAD) -> Vocabulary:
    """The words with the largest counts, all words of a count level or none, at most ``most``."""
    level = F.when(F.length("token") <= LONGEST, F.floor(F.log("c") * 32)).otherwise(-1)
    levels = vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()  # under 1500 levels of 64-bit counts
    taken, least = 0, None
    for row in levels:
        if taken + row.n > most or row.level < 0:
            break
        taken, least = taken + row.n, row.level
    total, distinct = sum(r.c for r in levels), sum(r.n for r in levels)
    tails = np.zeros((CLASSES, 2), np.int64)
    slots = vocabulary.filter(level < least) if least is not None else vocabulary
    for slot, c, n in slots.groupBy(F.crc32("token") % CLASSES).agg(F.sum("c"), F.count("*")).collect():  # a row for each slot
        tails[slot] = c, n
    words, counts = [], np.zeros(0, np.int64)
    if least is not None:
        rows = vocabulary.filter(level >= least).toArrow()
        words, counts = rows["token"].to_pylist(), rows["c"].to_numpy()
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        words, counts = [words[i] for i in order], counts[order]
    return Vocabulary(words, counts, total, distinct, tails)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs(doc_id, text, held_out, part)`` with text as ids, written down once.

    Columns key, doc_id, held_out, part, n_tokens, n_head, base_head, ids, tails, times: the last two
    are the words outside the head and how often the text has them.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.counts)), uuid.uuid4().hex  # at most HEAD words

    def make():
        words, counts = shared.value
        return pa.array(words, pa.binary()), np.r_[np.log10(counts + 1.0), np.zeros(TAILS)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = kept(("lm", name), make)
        key = TaskContext.get().partitionId() << 40
        for batch in it:
            for at, flat, sizes in split_words(batch.column(1)):
                n = len(sizes)
                ids, n_head, tails, times = coded(flat, sizes, words)
                start = np.cumsum(sizes + 1) - sizes - 1
                keys = pa.array(np.arange(key, key + n))
                key += n
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * np.r_[start, len(ids)]).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                sums = pa.array(np.add.reduceat(base[ids], start))
                yield pa.RecordBatch.from_arrays([keys, *(batch.column(c).slice(at, n) for c in (0, 2, 3)), pa.array(sizes + 1), pa.array(n_head), sums, data, tails, times], names=names)
        give_back()

    names = ["key", "doc_id", "held_out", "part", "n_tokens", "n_head", "base_head", "ids", "tails", "times"]
    ddl = "key long, doc_id long, held_out boolean, part long, n_tokens long, n_head long, base_head double, ids binary, tails array<binary>, times array<int>"
    return materialise(docs.select("doc_id", "text", "held_out", "part").mapInArrow(run, ddl), "encoded")


def coded(flat: pa.Array, sizes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of texts' words in a row: ids with an END after each text, tokens of the head, words outside it, and their counts."""
    head, n = len(words), len(sizes)
    ids = pc.fill_null(pc.index_in(flat, words), -1).to_numpy(zero_copy_only=False).astype("<i4")
    text = np.repeat(np.arange(n), sizes)
    out = np.flatnonzero(ids < 0)
    rare = flat.take(pa.array(out)).dictionary_encode()
    code, names = rare.indices.to_numpy(zero_copy_only=False), rare.dictionary
    ids[out] = np.array([head + zlib.crc32(w) % TAILS for w in names.to_pylist()], "<i4")[code]
    end = pc.index_in(pa.array([END], pa.binary()), words)[0].as_py()
    whole = np.full(len(ids) + n, head + zlib.crc32(END) % TAILS if end is None else end, "<i4")
    whole[np.arange(len(ids)) + text] = ids
    pairs, times = np.unique(text[out] * np.int64(max(1, len(names))) + code, return_counts=True)
    if end is None:  # a head too small for END
        pairs, names, times = pairs + pairs // max(1, len(names)), pa.concat_arrays([names, pa.array([END], pa.binary())]), times
        pairs = np.r_[pairs, np.arange(n) * len(names) + len(names) - 1]
        order = np.argsort(pairs)
        pairs, times = pairs[order], np.r_[times, np.ones(n, times.dtype)][order]
    of = pairs // max(1, len(names))
    offsets = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, names.take(pa.array(pairs % max(1, len(names))))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
    n_head = sizes + (end is not None) - np.bincount(text[out], minlength=n)
    return whole, n_head, *lists


def score(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, most: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs(doc_id, text)``.

    The model and all counts come from the rows for which ``held_out`` (a condition on doc_id) is
    not true.  A text is its words, A-Z lower-cased, and one end; null and empty texts are the end
    alone.  ``base_score`` is the add-one unigram log10 probability, ``score`` the model's.  Null
    ids and repeated rows are kept and scored each on its own; extra columns are ignored; an empty
    table gives an empty result.  Without training rows every token is unknown, and both scores are 0.
    """
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    counted = materialise(count_tokens(rows.filter(~F.col("held_out"))), "vocabulary")
    vocabulary = head(counted, most)
    encoded = encode(rows.withColumn("part", F.when(~F.col("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)))), vocabulary)
    weights = train(encoded, vocabulary, rounds)
    shared, name = docs.sparkSession.sparkContext.broadcast((_parts(vocabulary), weights)), uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = kept(("lm", name), lambda: (Vocabulary(*shared.value[0]), shared.value[1]))
        for batch in it:
            sums = [np.zeros(0)]
            for _, ids, first in _portions(batch.column(batch.schema.get_field_index("ids"))):
                sums.append(np.add.reduceat(token_logs(v, w, ids, first) + v.share[ids], first))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sums))], names=[*batch.schema.names[:-1], "logs"])
        give_back()

    ddl = "key long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, logs double"
    scored = encoded.select("key", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "ids").mapInArrow(run, ddl)
    # Words outside the head, once for each text, meet the counts by a plain shuffle.
    tails = encoded.select("key", F.explode(F.arrays_zip("tails", "times")).alias("t")).select("key", F.col("t.tails").alias("token"), F.col("t.times").alias("times"))
    found = tails.join(counted, "token").groupBy("key").agg(F.sum("times").alias("n_tail"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_tail"))
    whole = scored.join(found, "key", "left").withColumn("log_tail", F.coalesce("log_tail", F.lit(0.0))).withColumn("n_tail", F.coalesce("n_tail", F.lit(0)))
    room = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    model = F.col("logs") / float(np.log(10)) + F.col("log_tail") if vocabulary.total else F.lit(0.0)
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.col("n_tail")).cast("long").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_head") + F.col("log_tail") - F.col("n_tokens") * room).alias("base_score"), model.alias("score"))
