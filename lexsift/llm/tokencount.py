"""Token counts of a unigram segmentation, with forward scores shared in a trie of pre-tokens."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kept

#: Scores are millionths; a value holds the score above 32 bits and, against it, the tokens used,
#: so that the larger value has the better score and then the fewer tokens.
UNIT, SHIFT = 1_000_000, 1 << 32


def zipf_scores(pieces: list[str]) -> dict[str, int]:
    """Unigram log-probabilities, in millionths, of pieces listed by falling frequency.

    A vocabulary made by merging carries no probabilities, only the order in which its pieces
    arose; rank r gets the Zipf-Mandelbrot probability proportional to 1 / (r + 2.7).
    """
    total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    return {p: round(-UNIT * (math.log(r + 2.7) + total)) for r, p in enumerate(pieces) if p}


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentence-piece model in id order; control and byte pieces are no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class PretokenTrie:
    """Best forward score of every inserted prefix; pre-tokens that share a prefix share its scores.

    A character that no piece covers becomes its UTF-8 bytes, one token each, scored below every
    piece.  Nodes and stored pre-tokens are bounded: past ``bound`` nodes the trie starts anew.
    """

    LONG = 256  #: longer pre-tokens are scored alone and leave no nodes

    def __init__(self, scores: dict[str, int], bound: int = 1_000_000):
        self.scores = {p: s * SHIFT - 1 for p, s in scores.items()}
        self.byte = (min(scores.values(), default=0) - UNIT) * SHIFT - 1
        # Lengths of the pieces that end with three given characters; shorter ones are always tried.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for piece in sorted(scores, key=len):
            if len(piece) >= 3 and len(piece) not in self.lengths.get(piece[-3:], ()):
                self.lengths[piece[-3:]] = (*self.lengths.get(piece[-3:], ()), len(piece))
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.forward = [0]
        self.terminal: dict[int, int] = {}
        self.words: dict[bytes, int] = {}

    def total(self, words: dict[bytes, int]) -> int:
        """Tokens of counted words as they stand in a text, each after the mark of a word's start."""
        known, total = self.words, 0
        for word, times in words.items():
            tokens = known.get(word)
            if tokens is None:
                tokens = self.count("▁" + word.decode("utf-8", "replace"))
                if len(word) <= self.LONG:
                    if len(known) > self.bound:
                        known.clear()
                    known[word] = tokens
            total += times * tokens
        return total

    def _step(self, text: str, end: int, forward: list[int], path: Sequence[int]) -> int:
        """Best value of text[:end]; that of text[:k] is forward[path[k]]."""
        get, best = self.scores.get, forward[path[end - 1]] + self.byte * len(text[end - 1].encode())
        for length in (1, 2, *self.lengths.get(text[end - 3 : end], ())) if end > 2 else range(1, end + 1):
            if length > end:
                break
            score = get(text[end - length : end])
            if score is not None:
                value = forward[path[end - length]] + score
                if value > best:
                    best = value
        return best

    def count(self, pretoken: str) -> int:
        """Tokens of the best segmentation, the fewest if several have its score."""
        if len(pretoken) > self.LONG:
            values = [0]
            for end in range(1, len(pretoken) + 1):
                values.append(self._step(pretoken, end, values, range(end)))
            return -values[-1] % SHIFT
        if len(self.forward) > self.bound:
            self.clear()
        child, forward, path, node = self.child, self.forward, [0], 0
        for end, character in enumerate(pretoken, 1):
            edge = node << 21 | ord(character)
            node = child.get(edge, -1)
            if node < 0:
                node = child[edge] = len(forward)
                forward.append(self._step(pretoken, end, forward, path))
            path.append(node)
        if node not in self.terminal:
            self.terminal[node] = -forward[node] % SHIFT
        return self.terminal[node]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_distinct, n_tokens) for every row of ``docs(doc_id, text)``.

    Pre-tokens are runs of characters other than ASCII white space, each after the mark U+2581.
    Null and empty texts have no tokens.  Null ids and repeated rows are kept as they are; extra
    columns are ignored; an empty table gives an empty result.  No row is shuffled: each worker
    keeps one trie, and its memory does not depend on the input.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_distinct", pa.int64()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = kept(("trie", model_path), lambda: PretokenTrie(zipf_scores(load_pieces(model_path))))
        for batch in it:
            rows = [], [], []
            for raw in as_bytes(batch.column(1)):
                words = raw.split()
                own = Counter(words)
                total = trie.total(own)
                for values, value in zip(rows, (len(words), len(own), total), strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in rows)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long")
