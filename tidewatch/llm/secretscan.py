"""Secret scan: patterns of known forms, and a linear-chain conditional random field for the others.

A token is a run of letters, digits, ``_+/-`` and bytes beyond ASCII. Its features are its own shape (length, shares of
digits, capitals and small letters, symbols, changes between digits and letters), the shapes and letters of its
neighbours, the marks between it and them (equals sign, colon, quote, line end, other), and two properties of the whole
text (share of tokens with digits, share of code marks). Labels are begin, inside and outside; begin follows anything,
inside only begin or inside. Viterbi runs over whole texts.

The field is trained here, by gradient steps on the conditional likelihood, on windows around the patterns' spans and at
hashed places of a sample of about SAMPLE_DOCS texts (at most WINDOWS windows of 2 * REACH + 1 tokens, so the model's
input is bounded whatever the table). Tokens that look like secrets but match no pattern have no known label: windows with
them aren't learned from. So the field finds the shapes and surroundings of secrets, whatever names stand before them.
Spans it finds beside those of the patterns are of kind ``crf``; one that touches a pattern's span is left out.

Viterbi over many texts at once: tokens of a slice are one chain in which the first token of a text forgets what was
before. The chain is cut into blocks; the best paths of all blocks, from each label before a block, are found side by
side, then blocks are joined. A long text goes through in segments twice: for the best labels between segments, then for
the labels inside; memory doesn't grow with its tokens but for their bounds.

Defined results: a null text is empty; texts without tokens have no spans; without a labelled secret in the sample the
field finds nothing; repeated rows have equal results; null ids are kept; extra columns aren't read, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, utf8
from .wordhash import LOWERED, U, mix, owner, runs

# The known forms. Group 1 of assign is its value.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "crf")

SAMPLE_DOCS, WINDOWS, REACH = 8000, 4000, 12
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.3, 1e-4
OUTSIDE, BEGIN, INSIDE = range(3)
BLOCK, SEGMENT = 128, 1 << 20
NEVER = -1e9

DIGIT, UPPER, LOWER, HEX, SYMBOL, HIGH = (np.zeros(256, np.uint8) for _ in range(6))
DIGIT[48:58] = UPPER[65:91] = LOWER[97:123] = HEX[97:103] = HIGH[128:] = 1
SYMBOL[list(b"_+/-")] = 1
SOLID = (DIGIT | UPPER | LOWER | SYMBOL | HIGH).astype(bool)
LETTER = (UPPER | LOWER).astype(bool)
LETTER_VALUES = np.where(LETTER, LOWERED, U(0))
HEX_RUN = (DIGIT | HEX).astype(bool)
CODE = np.zeros(256, np.uint8)
CODE[list(b"{}();=<>")] = 1
GAP = np.where(SOLID, 0, 16).astype(np.uint8)  # marks between tokens, as bits
GAP[[9, 11, 12, 13, 32]] = 0
for _mark, _bit in ((b"=", 1), (b":", 2), (b"\"'`", 4), (b"\n", 8)):
    GAP[list(_mark)] = _bit
EDGE = 32  # a text's begin or end
LENGTHS = np.array([4, 8, 12, 16, 20, 32, 48])
WORD_BITS = 12
SHAPES, MORE = 8 * 5 * 3, 16 * 4
#: Sizes of the feature groups; a token has one feature of each.
GROUPS = {
    "shape": SHAPES, "more": MORE, "both": SHAPES * MORE, "shape_before": SHAPES + 1, "shape_after": SHAPES + 1,
    "word": (1 << WORD_BITS) + 1, "word_before": (1 << WORD_BITS) + 1, "word_before_2": (1 << WORD_BITS) + 1, "word_after": (1 << WORD_BITS) + 1,
    "gap_before": 8 * (EDGE + 1), "gap_after": 8 * (EDGE + 1), "gap_and_word": 1 << (WORD_BITS + 2), "file": 20 * 40,
}
BASES = np.concatenate(([0], np.cumsum(list(GROUPS.values()))))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token, and for each text the number of its first one (len+1 values)."""
    solid = SOLID[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1])))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1 if len(data) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def _sums(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[data], starts, dtype=np.int64)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: shape, more of its shape, length class, and whether it has digits."""
    length = ends - starts
    digits, upper, lower, hexes, symbols, high = (_sums(data, starts, t) for t in (DIGIT, UPPER, LOWER, HEX, SYMBOL, HIGH))
    is_digit = DIGIT[data]
    change = np.zeros(len(data), np.uint8)
    change[1:] = (is_digit[1:] != is_digit[:-1]) & SOLID[data[1:]] & SOLID[data[:-1]]
    change[starts] = 0
    changes = np.add.reduceat(change, starts, dtype=np.int64)
    size = np.searchsorted(LENGTHS, length, side="right")
    digit_class = np.where(digits == 0, 0, np.where(digits == length, 4, 1 + (4 * digits >= length) + (4 * digits >= 3 * length)))
    upper_class = (upper > 0).astype(np.int64) + (2 * upper >= length)
    shape = (size * 5 + digit_class) * 3 + upper_class
    flags = (lower > 0) * 1 + ((lower == hexes) & (upper == 0)) * 2 + (symbols > 0) * 4 + (high > 0) * 8
    more = flags * 4 + np.searchsorted(np.array([1, 2, 4]), changes, side="right")
    return shape, more, size, digits > 0


def file_classes(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One of 20 classes of each text."""
    n = len(offsets) - 1
    marks = np.concatenate(([0], np.cumsum(CODE[data], dtype=np.int64)))[offsets]
    per_thousand = 1000 * np.diff(marks) // np.maximum(np.diff(offsets), 1)
    with_digits = np.bincount(owner(first), weights=_sums(data, starts, DIGIT) > 0 if len(starts) else None, minlength=n)[:n]
    share = 100 * with_digits // np.maximum(np.diff(first), 1)
    return np.searchsorted([2, 5, 15, 40], share, side="right") * 4 + np.searchsorted([1, 10, 30], per_thousand, side="right")


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens x groups: numbers of the features. doc: the text of each token; classes: the file class of each token."""
    n = len(starts)
    shape, more, size, _ = shapes(data, starts, ends)
    word = (runs(data, starts, LETTER_VALUES, LETTER[data]) >> U(64 - WORD_BITS)).astype(np.int64)

    def moved(values, by, none):
        out = np.full(n, none, np.int64)
        if by > 0 and n > by:
            out[by:] = np.where(doc[by:] == doc[:-by], values[:-by], none)
        if by < 0 and n > -by:
            out[:by] = np.where(doc[:by] == doc[-by:], values[-by:], none)
        return out

    gap = np.full(n, EDGE, np.int64)
    if n > 1:
        between = np.bitwise_or.reduceat(GAP[data], np.stack((ends[:-1], starts[1:]), axis=1).reshape(-1))[::2]
        gap[1:] = np.where(doc[1:] == doc[:-1], between, EDGE)
    word_before = moved(word, 1, 1 << WORD_BITS)
    columns = (
        shape, more, shape * MORE + more, moved(shape, 1, SHAPES), moved(shape, -1, SHAPES), word, word_before, moved(word, 2, 1 << WORD_BITS), moved(word, -1, 1 << WORD_BITS),
        gap * 8 + size, moved(gap, -1, EDGE) * 8 + size, (mix((word_before * 64 + gap).astype(U)) >> U(64 - WORD_BITS - 2)).astype(np.int64), classes * 40 + shape // 3,
    )
    return np.stack([c + b for c, b in zip(columns, BASES[:-1], strict=True)], axis=1).astype(np.int32)


def hex_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of LEAST_HEX or more hexadecimal characters."""
    inside = HEX_RUN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1])))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1 if len(data) else starts
    long = ends - starts >= LEAST_HEX
    return starts[long], ends[long]


def pattern_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans (kind, start, end) of the known forms in byte places of data, the spans of their values, and those that failed."""
    found, values, failed = [], [], []
    for d in range(len(offsets) - 1):
        at = int(offsets[d])
        text = data[at : offsets[d + 1]].tobytes()
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= LEAST_VALUE:
                found.append((0, at + m.start(), at + m.end()))
                values.append((at + m.start(1), at + m.end(1)))
            else:
                failed.append((at + m.start(), at + m.end()))
        for m in ACCESS.finditer(text):
            span = (at + m.start(), at + m.end())
            if span[1] - span[0] >= LEAST_ACCESS:
                found.append((1, *span))
                values.append(span)
            else:
                failed.append(span)
    for a, b in zip(*hex_runs(data, offsets), strict=True):
        found.append((2, int(a), int(b)))
        values.append((int(a), int(b)))
    return sorted(found, key=lambda s: (s[1], s[0])), values, failed


def labels(starts: np.ndarray, ends: np.ndarray, values: list[tuple[int, int]]) -> np.ndarray:
    """begin, inside and outside of tokens by the spans of known secrets."""
    out = np.zeros(len(starts), np.int8)
    for a, b in sorted(values, key=lambda v: v[0] - v[1]):  # the longest first
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b)
        if i < j and not out[i:j].any():
            out[i] = BEGIN
            out[i + 1 : j] = INSIDE
    return out


def _windows(batches):
    """Windows to learn from: their features, labels and whether they hold a secret."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rows = []
        for d in range(len(offsets) - 1):
            text, whole = data[offsets[d] : offsets[d + 1]], np.array([0, offsets[d + 1] - offsets[d]])
            starts, ends, first = tokens(text, whole)
            n = len(starts)
            if not n:
                continue
            _, values, failed = pattern_spans(text, whole)
            label = labels(starts, ends, values)
            length = ends - starts
            unknown = (label == OUTSIDE) & (length >= LEAST_VALUE) & (_sums(text, starts, DIGIT) > 0) & (_sums(text, starts, LETTER.astype(np.uint8)) > 0)
            for a, b in failed:
                unknown[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = True
            file_class = int(file_classes(text, whole, first, starts)[0])
            centres = np.concatenate((np.flatnonzero(label == BEGIN)[:8], np.arange(1, 4) * n // 4))
            for centre in np.unique(centres).tolist():
                a, b = max(0, centre - REACH), min(n, centre + REACH + 1)
                if unknown[a:b].any() or label[a] == INSIDE:
                    continue
                low, high = max(0, a - 2), min(n, b + 1)
                at, to = int(starts[low]), int(ends[high - 1])
                ids = features(text[at:to], starts[low:high] - at, ends[low:high] - at, np.zeros(high - low, np.int64), np.full(high - low, file_class))[a - low : b - low]
                rows.append({"positive": bool((label[a:b] > 0).any()), "features": ids.tobytes(), "labels": label[a:b].tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("positive", pa.bool_()), ("features", pa.binary()), ("labels", pa.binary())]))


class Field:
    """Weights of features and of label changes."""

    def __init__(self, weights: np.ndarray, change: np.ndarray):
        self.weights, self.change = weights, change

    def scores(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), 3))
        for k in range(ids.shape[1]):
            out += self.weights[ids[:, k]]
        return out


def nothing() -> Field:
    weights = np.zeros((BASES[-1], 3))
    weights[:SHAPES, OUTSIDE] = 1.0
    return Field(weights, _allowed(np.zeros((3, 3))))


def _allowed(change: np.ndarray) -> np.ndarray:
    out = change.copy()
    out[OUTSIDE, INSIDE] = NEVER
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(scores: np.ndarray, there: np.ndarray, gold: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the mean negative log likelihood of a batch of padded windows: by score, by change, and its value.

    scores: windows x tokens x 3; there: which tokens exist (from the left); gold: their labels.
    """
    n, t, _ = scores.shape
    begin = np.array([0.0, 0.0, NEVER])
    ahead = np.empty_like(scores)
    ahead[:, 0] = scores[:, 0] + begin
    for k in range(1, t):
        step = _logsum(ahead[:, k - 1, :, None] + change, 1) + scores[:, k]
        ahead[:, k] = np.where(there[:, k, None], step, ahead[:, k - 1])
    back = np.zeros_like(scores)
    for k in range(t - 2, -1, -1):
        step = _logsum(change + (scores[:, k + 1] + back[:, k + 1])[:, None, :], 2)
        back[:, k] = np.where(there[:, k + 1, None], step, 0.0)
    total = _logsum(ahead[:, -1], 1)
    single = np.exp(ahead + back - total[:, None, None]) * there[..., None]
    pair = np.exp(ahead[:, :-1, :, None] + change + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
    hot = np.eye(3)[gold] * there[..., None]
    seen = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum(axis=(0, 1))
    value = (total - (scores * hot).sum(axis=(1, 2))).sum() - (seen * np.where(change > NEVER / 2, change, 0)).sum()
    return (single - hot) / n, (pair.sum(axis=(0, 1)) - seen) / n, value / n


def fit(windows: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Adaptive gradient steps on windows (features, labels)."""
    if not any(label.any() for _, label in windows):
        return nothing()
    t = max(len(label) for _, label in windows)
    ids = np.zeros((len(windows), t, len(GROUPS)), np.int32)
    gold = np.zeros((len(windows), t), np.int64)
    there = np.zeros((len(windows), t), bool)
    for k, (f, label) in enumerate(windows):
        ids[k, : len(label)], gold[k, : len(label)], there[k, : len(label)] = f, label, True
    weights, change = np.zeros((BASES[-1], 3)), np.zeros((3, 3))
    sum_w, sum_c = np.full(weights.shape, 1e-6), np.full(change.shape, 1e-6)
    dice = np.random.default_rng(11)
    for _ in range(EPOCHS):
        order = dice.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            scores = weights[ids[part]].sum(axis=2)
            by_score, by_change, _ = gradient(scores, there[part], gold[part], _allowed(change))
            spread = np.repeat(by_score.reshape(-1, 3), ids.shape[2], axis=0)
            flat = ids[part].reshape(-1)
            g = np.stack([np.bincount(flat, spread[:, y], minlength=len(weights)) for y in range(3)], axis=1) + DECAY * weights
            sum_w += g * g
            weights -= RATE * g / np.sqrt(sum_w)
            sum_c += by_change * by_change
            change -= RATE * by_change / np.sqrt(sum_c)
    return Field(weights, _allowed(change))


def train(documents: DataFrame) -> Field:
    """A field fitted on windows of a sample of the texts; equal tables give equal fields."""
    bounded_batches(documents.sparkSession)
    texts = documents.select("text")
    share = min(1.0, SAMPLE_DOCS / max(1, texts.count()))
    drawn = texts.where(F.pmod(F.xxhash64(F.lit(12), F.col("text")), F.lit(1 << 20)) < int(share * (1 << 20)))
    windows = drawn.mapInArrow(_windows, "positive boolean, features binary, labels binary").withColumn("place", F.xxhash64("features"))
    rows = [r for kind in (True, False) for r in windows.where(F.col("positive") == F.lit(kind)).orderBy("place", "labels").limit(WINDOWS // 2).collect()]
    return fit([(np.frombuffer(r.features, np.int32).reshape(-1, len(GROUPS)), np.frombuffer(r.labels, np.int8)) for r in rows])


class Chain:
    """Best paths through a stretch of tokens, from each label before it to each label at its end."""

    def __init__(self, scores: np.ndarray, fresh: np.ndarray, change: np.ndarray):
        n = len(scores)
        blocks = -(-n // BLOCK)
        padded = np.zeros((blocks * BLOCK, 3))
        padded[:n] = scores
        kind = np.zeros(blocks * BLOCK, np.int64)
        kind[:n] = fresh
        kind[n:] = 2
        begin = np.tile(np.array([0.0, 0.0, NEVER]), (3, 1))  # from any label, the first token of a text
        same = np.where(np.eye(3, dtype=bool), 0.0, NEVER)
        moves = np.stack((change, begin, same))[kind.reshape(blocks, BLOCK)]
        padded = padded.reshape(blocks, BLOCK, 3)
        best = np.broadcast_to(same, (blocks, 3, 3)).copy()
        self.before = np.empty((BLOCK, blocks, 3, 3), np.int8)
        for t in range(BLOCK):
            paths = best[:, :, :, None] + moves[:, t, None, :, :]
            self.before[t] = paths.argmax(axis=2)
            best = paths.max(axis=2) + padded[:, t, None, :]
        self.n, self.best = n, best
        self.ends = []  # label before each block that leads best to each label at its end, from each label before the stretch
        total = same.copy()
        for b in range(blocks):
            paths = total[:, :, None] + best[b][None]
            self.ends.append(paths.argmax(axis=1))
            total = paths.max(axis=1)
        self.total = total

    def labels(self, entry: int, leave: int) -> np.ndarray:
        blocks = len(self.ends)
        into, out = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
        now = leave
        for b in range(blocks - 1, -1, -1):
            out[b] = now
            now = into[b] = self.ends[b][entry, now]
        found = np.zeros((blocks, BLOCK), np.int8)
        every = np.arange(blocks)
        for t in range(BLOCK - 1, -1, -1):
            found[:, t] = out
            out = self.before[t][every, into, out].astype(np.int64)
        return found.reshape(-1)[: self.n]


def tag(field: Field, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The label of each token of some texts, in segments of about SEGMENT bytes."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int8)
    doc = owner(first)
    classes = file_classes(data, offsets, first, starts)

    def chain(i, j):
        low, high = max(0, i - 2), min(n, j + 1)
        at, to = int(starts[low]), int(ends[high - 1])
        ids = features(data[at:to], starts[low:high] - at, ends[low:high] - at, doc[low:high], classes[doc[low:high]])[i - low : j - low]
        fresh = np.ones(j - i, np.int64)
        fresh[1:] = doc[i + 1 : j] != doc[i : j - 1]
        fresh[0] = i == 0 or doc[i] != doc[i - 1]
        return Chain(field.scores(ids), fresh, field.change)

    cuts = np.unique(np.concatenate((np.searchsorted(starts, np.arange(0, len(data), SEGMENT)), [0, n])))
    pieces = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    if len(pieces) == 1:
        only = chain(0, n)
        return only.labels(OUTSIDE, int(only.total[OUTSIDE].argmax()))
    totals = [chain(i, j).total for i, j in pieces]
    into, now = [], np.array([0.0, NEVER, NEVER])
    for total in totals:
        paths = now[:, None] + total
        into.append(paths.argmax(axis=0))
        now = paths.max(axis=0)
    leave, bounds = int(now.argmax()), []
    for k in range(len(pieces) - 1, -1, -1):
        bounds.append((int(into[k][leave]), leave))
        leave = bounds[-1][0]
    return np.concatenate([chain(i, j).labels(*b) for (i, j), b in zip(pieces, reversed(bounds), strict=True)])


def field_spans(label: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of begin and inside labels that touch none of the known ones."""
    begins = np.flatnonzero(label == BEGIN)
    if not len(begins):
        return []
    stops = np.flatnonzero(label != INSIDE)
    after = np.append(stops, len(label))[np.searchsorted(stops, begins, side="right")]
    out = []
    reach = np.maximum.accumulate(np.array([s[2] for s in known], np.int64)) if known else np.zeros(0, np.int64)
    heads = np.array([s[1] for s in known], np.int64)
    for a, b in zip(starts[begins].tolist(), ends[after - 1].tolist(), strict=True):
        k = np.searchsorted(heads, b)  # known spans that begin before this one's end
        if not k or reach[k - 1] <= a:
            out.append((3, a, b))
    return out


def _scanner(shared):
    schema = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = []
            for a, b in slices(offsets, SEGMENT):
                part, to = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = tokens(part, to)
                known, _, _ = pattern_spans(part, to)
                label = tag(field, part, to, starts, ends, first)
                spans = sorted(known + field_spans(label, starts, ends, known), key=lambda s: (s[1], s[0]))
                per = [[] for _ in range(b - a)]
                if spans:
                    head = (part & 0xC0) != 0x80
                    docs = np.searchsorted(to, [s[1] for s in spans], side="right") - 1
                    points = np.concatenate(([0], np.cumsum(head)))
                    for d, (kind, x, y) in zip(docs.tolist(), spans, strict=True):
                        per[d].append({"kind": KINDS[kind], "start": int(points[x] - points[to[d]]), "end": int(points[y] - points[to[d]])})
                rows += per
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(schema))], names=["doc_id", "spans"])

    return run


def scan(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points by start, then kind: assign, access, hex, crf."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((field.weights.astype(np.float32), field.change))
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(_scanner(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """op12's rows: counts by kind, the digest of the known forms' spans, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("crf"))
