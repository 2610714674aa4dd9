"""Personal data by weak supervision.

Base patterns find well-formed emails, addresses, cards and phones.  Looser patterns propose
further spans.  On every proposal, base ones included, labelers of three kinds vote: patterns,
gazetteers and the words around.  Votes are tallied over the whole corpus by pattern of votes,
of which there are few; expectation-maximisation estimates each labeler's reliability from the
tally, and a logistic span classifier is trained on the resulting posteriors.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "person")
ORDER = {k: i for i, k in enumerate(KINDS)}
BASE = KINDS[:4]
Span = tuple[str, int, int]

# The base patterns' character sets and limits.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Emails, addresses, cards and phones by start, then kind.  Work is linear in the text."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    at = text.find("+")
    while at >= 0:
        if m := PHONE.match(text, at):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


# Looser proposals.  Each starts with a rare mark, so that scanning stays cheap.
AROUND = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{2,63}){1,4}", re.I)
LOCAL_PHONE = re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])")
SIX = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:])")
KEYED = re.compile(r"(?<!\w)(?:api[_-]?key|access[_-]?key|passwo?r?d|secret|token)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{16,}+)", re.I)
NATIONAL = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
TITLED = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ([A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?)(?!\w)")

# Gazetteers and context words of the labelers.
NAMES = frozenset(
    """Adam Ahmed Alain Alan Alejandro Alexander Alice Ana Andrea Andrew Angela Ann Anna Anne Antonio Barbara Ben Bernd Bernard Brian Carlos Carmen Carol Caroline
    Catherine Charles Christian Christine Christopher Claire Claudia Daniel David Deborah Dieter Dominique Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva
    Fatima Fernando Francesca Francisco Frank François Franz Gabriel Georg George Giulia Hans Heike Helen Helga Henri Ingrid Isabel Isabelle Jack Jacques James Jan
    Jane Javier Jean Jennifer Jessica Joan John Jonas Jorge Joseph José Juan Julia Julie Karen Karl Kevin Klaus Laura Laurent Lena Linda Lisa Louis Lucia Luis
    Manuel Marco Margaret Maria Marie Mark Martin Mary Matthew Max Michael Michel Miguel Mohamed Monika Nancy Nathalie Nicolas Nicole Olivier Pablo Patricia Patrick
    Paul Pedro Peter Philippe Pierre Rafael Ralf Richard Robert Rosa Ruth Sabine Sandra Sara Sarah Sebastian Silvia Sofia Sophie Stefan Stephen Steven Susan
    Sylvie Teresa Thomas Tim Ursula Uwe Victor Walter William Wolfgang""".split()
)
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz name".split())  # besides all of two letters
CONTEXT = {
    "email": "mail email e-mail contact write reach courriel correo",
    "ip": "ip address host server addr",
    "card": "card visa mastercard amex credit payment karte carte tarjeta",
    "phone": "call tel phone telephone fax mobile telefon número",
    "secret": "token key secret password passwd",
    "national_id": "ssn social security id",
    "person": "name from dear signed contact",
}
AGAINST = "version isbn issue figure page ratio score chapter section"


def _words(words: str) -> re.Pattern:
    """Any of the words as a word of its own, also with an s."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words.split()))})s?(?!\w)", re.I)


SAID, DOUBTED = {k: _words(v) for k, v in CONTEXT.items()}, _words(AGAINST)


def proposals(text: str) -> list[Span]:
    """Further spans that may be personal data, before any vote."""
    found: list[Span] = []
    low = text.lower()
    if ("at]" in low or "at)" in low or "at ]" in low or "at )" in low):
        found += [("email", *m.span()) for m in AROUND.finditer(text)]
    found += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    if ":" in text:
        found += [("ip", *m.span()) for m in SIX.finditer(text)]
    if any(k in low for k in ("key", "passw", "pwd", "secret", "token")):
        found += [("secret", *m.span(1)) for m in KEYED.finditer(text)]
    if "-" in text:
        found += [("national_id", *m.span()) for m in NATIONAL.finditer(text)]
    if any(t in text for t in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")):
        found += [("person", *m.span(1)) for m in TITLED.finditer(text)]
    return found


YES, NO, ABSTAIN = "1", "0", "-"
LABELERS = 6


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One character for each labeler: shape, validity, gazetteer, context, counter-context, variety."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    before = text[max(0, start - 32) : start]
    listed = None  # no gazetteer has a say
    if kind == "email":
        shape = "@" in span or "at" in span.lower()
        valid = len(span) <= 254 and not re.search(r"\.\.|^-|-$", span)
        ending = re.split(r"[.\s\])]+", span.lower())[-1]
        listed = len(ending) == 2 or ending in DOMAIN_ENDS
    elif kind == "ip":
        shape, valid = span.count(".") == 3 or span.count(":") > 3, True
        try:
            address = ipaddress.ip_address(span)
            listed = address.is_global or address.is_private and not address.is_unspecified
        except ValueError:
            valid = False
    elif kind == "card":
        shape, valid, listed = len(digits) in (15, 16), luhn(digits), digits[:1] in "3456"
    elif kind == "phone":
        shape, valid = len(digits) >= 10, 10 <= len(digits) <= 15 and digits[-10] not in "01"
        listed = span[0] in "+(" or None
    elif kind == "secret":
        shape, valid = len(span) >= 20, bool(digits) and any(c.isalpha() for c in span)
    elif kind == "national_id":
        shape, valid = len(digits) == 9, digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00"
    else:
        shape, valid, listed = span[:1].isupper(), len(span) > 2, span.split()[0] in NAMES
    said = SAID[kind].search(before) or SAID[kind].search(text[end : end + 16])
    doubted = DOUBTED.search(before) or before.endswith("#")
    varied = len(set(span)) > 3
    return "".join((YES if shape else NO, YES if valid else NO, ABSTAIN if listed is None else YES if listed else NO, YES if said else ABSTAIN, NO if doubted else ABSTAIN, ABSTAIN if varied else NO))


def pattern(text: str, span: Span) -> str:
    """What the classifier sees of a span: kind, votes, and its length in doublings."""
    kind, start, end = span
    return f"{kind}|{votes(text, kind, start, end)}|{min(9, (end - start).bit_length())}"


def examine(text: str) -> tuple[list[Span], list[tuple[Span, str]]]:
    """Base spans, and further proposals that touch no base span, each with its pattern."""
    base = base_spans(text)
    covered: list[list[int]] = []  # base spans of all kinds, overlaps merged
    for _, start, end in base:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    extra, last = [], 0
    for span in sorted(proposals(text), key=lambda s: (s[1], ORDER[s[0]])):
        at = bisect_left(covered, [span[2]]) - 1  # the last run that starts before the span ends
        if span[1] >= last and (at < 0 or covered[at][1] <= span[1]):
            last = span[2]
            extra.append((span, pattern(text, span)))
    return base, extra


class Reliability:
    """Dawid-Skene estimates from a tally of vote patterns, and a classifier trained on them.

    Each labeler has a sensitivity and a specificity for each kind.
    """

    def __init__(self, tally: dict[str, int], rounds: int = 60):
        self.patterns = sorted(tally)
        weight = np.array([tally[p] for p in self.patterns], float)
        kinds = np.array([ORDER[p.split("|")[0]] for p in self.patterns], int)
        cast = np.array([[{YES: 1, NO: 0, ABSTAIN: 2}[c] for c in p.split("|")[1]] for p in self.patterns], int).reshape(-1, LABELERS)
        of = (kinds[:, None] == np.arange(len(KINDS))).astype(float)  # patterns of each kind
        yes, no = (cast == 1).astype(float), (cast == 0).astype(float)
        # posterior from the share of yes votes, then alternate
        truth = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1.0)
        self.sensitivity = np.full((len(KINDS), LABELERS), 0.8)
        self.specificity = self.sensitivity.copy()
        for _ in range(rounds if len(weight) else 0):
            true, false = of.T * (weight * truth), of.T * (weight * (1 - truth))
            # The prior keeps every labeler better than chance, so that truth keeps its meaning.
            self.sensitivity = np.clip((true @ yes + 8) / (true @ (yes + no) + 10), 0.51, 0.999)
            self.specificity = np.clip((false @ no + 8) / (false @ (yes + no) + 10), 0.51, 0.999)
            prior = (true.sum(1) + 1) / (true.sum(1) + false.sum(1) + 2)
            for_, against = np.log(self.sensitivity / (1 - self.specificity))[kinds], np.log((1 - self.sensitivity) / self.specificity)[kinds]
            odds = np.log(prior / (1 - prior))[kinds] + (yes * for_ + no * against).sum(1)
            truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.posterior = truth
        self._train(weight, truth)

    @staticmethod
    def features(patterns: list[str]) -> np.ndarray:
        rows = []
        for p in patterns:
            kind, cast, size = p.split("|")
            rows.append([1.0, *(float(kind == k) for k in KINDS), *(float(c == YES) for c in cast), *(float(c == NO) for c in cast), *(float(int(size) == s) for s in range(10))])
        return np.array(rows).reshape(len(patterns), 1 + len(KINDS) + 2 * LABELERS + 10)

    def _train(self, weight: np.ndarray, truth: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> None:
        x = self.features(self.patterns)
        self.weights = np.zeros(x.shape[1])
        if not len(x):
            return
        share = np.sqrt(weight) / np.sqrt(weight).sum()  # a frequent pattern must not drown the others
        speed = np.zeros_like(self.weights)
        for _ in range(steps):
            guess = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            gradient = x.T @ (share * (guess - truth)) + ridge * self.weights
            speed = 0.9 * speed - gradient
            self.weights += speed

    def accepted(self, least: float = 0.5) -> frozenset[str]:
        """Patterns whose spans the classifier takes for personal data."""
        chance = 1 / (1 + np.exp(-np.clip(self.features(self.patterns) @ self.weights, -30, 30)))
        return frozenset(p for p, c in zip(self.patterns, chance, strict=True) if c >= least)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def _tally(patterns: DataFrame) -> dict[str, int]:
    """Rows (pattern, n) summed; there are at most kinds * 3**labelers * lengths patterns."""
    return {r[0]: r[1] for r in patterns.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs(doc_id, text)``.

    Counts and digest are of the base spans; ``spans`` adds what the classifier accepts, also of
    the kinds secret, national_id and person.  Offsets count code points, the end excluded.  Null
    and empty texts have no spans.  Null ids and repeated rows are kept; extra columns are
    ignored; an empty table gives an empty result.
    """
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, extra array<string>, seen array<string>"
    text = pa.list_(pa.string())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, base, extra, seen = [[] for _ in BASE], [], [], []
            for value in batch.column(1):
                content = value.as_py() or ""
                own, more = examine(content)
                found = Counter(s[0] for s in own)
                for column, kind in zip(counts, BASE, strict=True):
                    column.append(found[kind])
                base.append(joined(own))
                extra.append([f"{k}:{s}:{e};{p}" for (k, s, e), p in more])
                seen.append([pattern(content, s) for s in own] + [p for _, p in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(extra, text), pa.array(seen, text)], names=["doc_id", *(f"n_{k}" for k in BASE), "base", "extra", "seen"])

    found = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl), "spans")
    accepted = Reliability(_tally(found.select(F.explode("seen").alias("pattern"), F.lit(1).alias("n")))).accepted()

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            digest, spans = [], []
            for base, extra in zip(batch.column("base").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                taken = [x.split(";")[0] for x in extra if x.split(";", 1)[1] in accepted]
                if taken:
                    parts = [p.split(":") for p in [*(base.split(",") if base else []), *taken]]
                    base = joined([(k, int(s), int(e)) for k, s, e in parts])
                spans.append(base)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *(f"n_{k}" for k in BASE))), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return found.drop("seen").mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first span's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of ``find`` masked in ``text``; a null text stays null.

    ``n_chars``, where present, becomes the new length of the text.  All other columns and rows
    are as they were.  Texts are read twice, once for the tally, and are not shuffled.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in it:
            for value in batch.column(0):
                content = value.as_py() or ""
                base, extra = examine(content)
                seen.update(pattern(content, s) for s in base)
                seen.update(p for _, p in extra)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    accepted = Reliability(_tally(docs.select(F.col("text").cast("string")).mapInArrow(count, "pattern string, n long"))).accepted()
    at = docs.columns.index("text")

    def mask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for value in batch.column(at):
                content = value.as_py()
                if content:
                    base, extra = examine(content)
                    spans = base + [s for s, p in extra if p in accepted]
                    content = masked(content, spans) if spans else content
                texts.append(content)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
