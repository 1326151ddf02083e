"""Toxicity by a subsequence string kernel over sentences, Nyström landmarks and a support vector machine (operator 5).

Texts are cut into sentences: letters and digits in lower case, words set apart by one space, marks inside a word left
out, three or more single letters in a row read as one word. The kernel of two stretches of a sentence counts their
common subsequences of ``ORDER`` characters (spaces count as characters), each weighted by ``DECAY`` to the power of the
stretch it covers, up to ``SPAN`` characters, and divides by what stretches of these widths without a repeated
character would give. Inserted or set-apart characters cost some weight but hide nothing, and a word split in two or an
insult of two words is one stretch like any other.

All stretches of ``WIDTHS`` characters of a sentence are looked at, wherever they begin; a sentence decides like its
worst one. Landmarks are stretches of labelled sentences: words and word pairs that stand in more toxic documents than
chance explains, those stretches of clean sentences that resemble them most, and some at random. Nyström features are
kernel values to the landmarks times the inverse root of the landmarks' kernel matrix. The machine is trained on
sentences: positive are the worst stretches of those sentences of toxic documents that hold a telling word or that the
machine itself finds toxic, and forms of telling words with a character inserted or a space in the middle; negative is
the worst stretch of each sentence of clean documents, and a stretch without any likeness. They are chosen again in each
of ``TURNS`` rounds. So a document that is labelled toxic by mistake adds no sentence. The score is a logistic curve over
two numbers of a document: the decision on its worst sentence, and how large a part of the text is toxic, since words
that are telling in number also stand alone in some clean texts.

As the kernel is a sum over subsequences, the machine's weights fold into one number for each subsequence, and a text is
scored by looking these up and by running sums: no kernel matrix, nothing kept from text to text.

Only labels and texts are learnt from; identity, language and source are never inputs. The model is fitted on at most
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents with texts of ``SAMPLE_BYTES`` for each kind, chosen by a hash, and a
round takes in at most ``HARD`` clean stretches; scoring reads every text whole, long ones in
blocks. Null and empty texts count as a stretch without any likeness. Repeated rows score alike. Columns of other names
are kept as they are; a column named like the result is replaced. Without labels of both kinds every document scores 0;
without a telling word, the share of toxic documents among the labelled ones (0.49 at most). An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, no_null, sliced, table, text_list, worker_state

ORDER, DECAY, SPAN = 4, 0.8, 6
#: Characters of the stretches that are scored, wherever they begin.
WIDTHS = (7, 11)
#: Landmarks: telling stretches at most and their longest length, and clean stretches.
TELLING, LONGEST, CONTRAST = 128, 16, 480
#: Telling words that a toxic document should hold before others are looked for.
COVER = 3
#: Subsequences are numbered by a hash of so many bits; one that no landmark has is taken for one of theirs in less than 1 % of cases.
SLOTS = 21
#: Words and pairs are telling if chance would make fewer than this many like them.
BY_CHANCE = 1.0
#: Eigenvalues of the landmarks' kernel matrix are taken as this at least.
FLOOR = 0.002
#: Price of the wrong side of the margin, rounds of training, and clean stretches that a round takes in, the worst ones.
COST, TURNS, HARD = 500.0, 4, 20_000
#: Bounds of the training sample: documents of each kind, and bytes of their texts (12 MB of each kind).
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1000, 2000, 12 << 20
#: Characters that are laid out at once, and by how much blocks of a longer text overlap.
BLOCK, OVERLAP = 1 << 16, 4096
_GAPS = [g for g in itertools.product(range(1, SPAN), repeat=ORDER - 1) if sum(g) < SPAN]
_SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Marks that end a sentence if white space follows (fixed: Latin, Arabic, Devanagari and CJK full stops).
_ENDS = ".!?…؟۔।。！？"
LETTER, MARK, BLANK, BREAK, END = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """What each code point is: letter or digit, other mark, white space, line break, or a mark that ends sentences."""
    kinds = np.array([LETTER if chr(c).isalnum() else BLANK if chr(c).isspace() else MARK for c in range(0x110000)], np.uint8)
    for ch in "\n\r\x85  ":
        kinds[ord(ch)] = BREAK
    for ch in _ENDS:
        kinds[ord(ch)] = END
    return kinds


@dataclass
class Sentences:
    """Sentences of some texts in one row of characters, each with a space before and after.

    first: where each sentence begins; of: the text it belongs to.
    """

    chars: np.ndarray
    first: np.ndarray
    of: np.ndarray

    def stops(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.chars))

    def text(self, start: int, stop: int) -> str:
        return self.chars[start:stop].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def sentences(texts: list[str]) -> Sentences:
    low = [t.lower() for t in texts]
    chars = code_points(low)
    kinds = classes()[chars]
    at = np.flatnonzero(kinds == LETTER)
    if not len(at):
        return Sentences(np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64))
    ends = np.cumsum([len(t) for t in low])
    doc = np.searchsorted(ends, at, "right")
    # what stands between each letter and the one before it: white space, line breaks, ends of sentences
    weight = np.array([0, 0, 1, 1 | 1 << 21, 1 << 42], np.int64)
    passed = np.cumsum(weight[kinds])[at]
    between = np.diff(passed, prepend=passed[0])
    low21 = (1 << 21) - 1
    space = (between & low21) > 0
    new = (between >> 21 & low21 > 0) | (space & (between >> 42 > 0)) | (np.diff(doc, prepend=-1) > 0)
    gap = np.where(new, 2, space.astype(np.int8))
    # runs of three or more words of one letter become one word
    words = np.flatnonzero(gap)
    single = np.diff(words, append=len(at)) == 1
    linked = single & np.concatenate([[False], single[:-1]]) & (gap[words] == 1)
    edge = np.flatnonzero(np.diff(linked.astype(np.int8), prepend=0, append=0))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a > 1:
            gap[words[a:b]] = 0
    place = np.arange(len(at)) + np.cumsum(gap) - 1
    out = np.full(place[-1] + 2, 32, np.uint32)
    out[place] = chars[at]
    starts = np.flatnonzero(new)
    return Sentences(out, place[starts] - 1, doc[starts])


def norm(width: int) -> float:
    """Length of the feature vector of ``width`` characters, all different."""
    return sum(max(0, width - sum(g)) * DECAY ** (2 * (sum(g) + 1)) for g in _GAPS) ** 0.5


def subsequences(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Characters covered, and numbers of all subsequences along the last axis, by gaps."""
    n = chars.shape[-1]
    terms = [(chars ^ (chars >> np.uint32(7))) * m for m in _SPREAD]
    for gaps in _GAPS:
        long = sum(gaps)
        if long < n:
            number, at = terms[0][..., : n - long].copy(), 0
            for term, gap in zip(terms[1:], gaps, strict=True):
                at += gap
                number += term[..., at : n - long + at]
            number ^= number >> np.uint32(15)
            number *= np.uint32(0x2C1B3C6D)
            number >>= np.uint32(32 - SLOTS)
            yield long + 1, number


class Landmarks:
    """Kernel values of stretches to landmark stretches."""

    def __init__(self, stretches: list[str]):
        self.stretches = stretches
        rows, entries = {}, []
        for k, s in enumerate(stretches):
            for span, numbers in subsequences(code_points([s])):
                entries += [(rows.setdefault(u, len(rows) + 1), k, DECAY**span / norm(len(s))) for u in numbers.tolist()]
        self.numbers = np.array([*rows], np.uint32)
        #: by subsequence (row 0: none of any landmark) and landmark
        self.weights = np.zeros((len(rows) + 1, len(stretches)), np.float32)
        for r, k, v in entries:
            self.weights[r, k] += v
        self.having, self.landmark = np.nonzero(self.weights)
        self.count = np.bincount(self.having, minlength=len(rows) + 1)
        self.start = np.cumsum(self.count) - self.count

    def rows(self) -> np.ndarray:
        out = np.zeros(1 << SLOTS, np.int32)
        out[self.numbers] = np.arange(1, len(self.numbers) + 1)
        return out

    def kernel(self, stretches: list[tuple[str, int]]) -> np.ndarray:
        """One row for each (stretch, the width it counts as)."""
        m = len(self.stretches)
        out = np.zeros((len(stretches), m), np.float32)
        long = max((len(s) for s, _ in stretches), default=0)
        scale, row_of = {w: norm(w) for w in {w for _, w in stretches}}, self.rows()
        for k in range(0, len(stretches), 256):
            part = stretches[k : k + 256]
            chars = code_points([s.ljust(long, "\0") for s, _ in part]).reshape(len(part), long)
            total = np.zeros(len(part) * m)
            for span, numbers in subsequences(chars):
                rows = row_of[numbers]
                rows[(chars[:, span - 1 :] == 0)] = 0
                here, place = np.nonzero(rows)
                row = rows[here, place]
                n = self.count[row]
                at = np.repeat(self.start[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
                total += np.bincount(np.repeat(here * m, n) + self.landmark[at], self.weights[self.having[at], self.landmark[at]], len(total)) * DECAY**span
            out[k : k + len(part)] = total.reshape(len(part), m) / np.array([scale[w] for _, w in part])[:, None]
        return out


@dataclass
class Model:
    landmarks: Landmarks | None = None
    alpha: np.ndarray | None = None
    bias: float = -1.0
    weights: np.ndarray | None = None  # of the logistic curve
    prior: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def folded(self) -> np.ndarray:
        """The machine's weight of each subsequence."""
        out = np.zeros(1 << SLOTS, np.float32)
        out[self.landmarks.numbers] = (self.landmarks.weights @ self.alpha)[1:]
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(evidence), min(self.prior, 0.49))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([evidence, np.ones(len(evidence))]) @ self.weights, -500, 500)))


def decided(found: Sentences, model: Model, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character: decision of the worst stretch that begins there, and that stretch's width."""
    n = len(found.chars)
    sums: dict[int, np.ndarray] = {}
    for span, numbers in subsequences(found.chars):
        sums[span] = sums[span] + folded[numbers] if span in sums else folded[numbers]
    sums = {span: np.concatenate([[0.0], np.cumsum(x.astype(np.float64) * DECAY**span), np.zeros(n - len(x))]) for span, x in sums.items()}
    stops, here = np.repeat(found.stops(), np.diff(found.first, append=n)), np.arange(n)
    best, width = np.full(n, -np.inf), np.zeros(n, np.int8)
    for w in WIDTHS:
        value, stop = np.zeros(n), np.minimum(here + w, stops)
        for span, x in sums.items():
            value += x[np.maximum(stop - span + 1, here)] - x[:n]
        value /= norm(w)
        width[value > best] = w
        np.maximum(best, value, out=best)
    return best + model.bias, width


def worst(found: Sentences, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision of each sentence, and where its worst stretch begins."""
    top = np.maximum.reduceat(value, found.first)
    where = np.flatnonzero(value == np.repeat(top, np.diff(found.first, append=len(value))))
    return top, where[np.searchsorted(where, found.first)]


def blocks_of(text: str) -> Iterator[str]:
    """A long text in blocks: cut at a line break where there is one, else overlapping."""
    at = 0
    while len(text) - at > BLOCK:
        cut = text.rfind("\n", at + BLOCK // 2, at + BLOCK)
        yield text[at : cut if cut > 0 else at + BLOCK]
        at = cut if cut > 0 else at + BLOCK - OVERLAP
    yield text[at:]


def batched(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts' blocks, some at a time, with the texts' positions."""
    of, held, size = [], [], 0
    for k, t in enumerate(texts):
        for block in blocks_of(t):
            if held and size + len(block) > BLOCK:
                yield of, held
                of, held, size = [], [], 0
            of.append(k)
            held.append(block)
            size += len(block)
    if held:
        yield of, held


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.folded = model.folded() if model.alpha is not None else None

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Two numbers for each text: the decision on its worst stretch, and the logarithm of the part of it that is toxic."""
        top, mass, size = np.full(len(texts), self.model.bias), np.zeros(len(texts)), np.zeros(len(texts))
        if self.folded is not None:
            for of, held in batched(texts):
                found = sentences(held)
                if len(found.first):
                    doc, (value, _) = np.array(of)[found.of], decided(found, self.model, self.folded)
                    np.maximum.at(top, doc, worst(found, value)[0])
                    np.add.at(mass, doc, np.add.reduceat(np.clip(value, 0, 1), found.first))
                    np.add.at(size, doc, np.diff(found.first, append=len(value)))
        return np.column_stack([top, np.log((mass + 0.1) / (size + 100))])


# --- training -------------------------------------------------------------------------------------------------------------


def svm(blocks: list[tuple[np.ndarray, int, np.ndarray]], c: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows that violate the margin.

    blocks: rows, their side (1 or -1) and weights; they are never put into one table.
    """
    m = blocks[0][0].shape[1]
    w, prior, scale = np.zeros(m + 1), np.append(np.ones(m), 1e-3), c / sum(weight.sum() for *_, weight in blocks)

    def margins(x: np.ndarray, side: int, w: np.ndarray) -> np.ndarray:
        return side * (x @ w[:-1].astype(x.dtype) + w[-1])

    def loss(w: np.ndarray) -> float:
        return float(prior @ w**2 + scale * sum((weight * np.maximum(0, 1 - margins(x, side, w)) ** 2).sum() for x, side, weight in blocks))

    for _ in range(rounds):
        left, right = np.diag(prior), np.zeros(m + 1)
        for x, side, weight in blocks:
            active = np.flatnonzero(margins(x, side, w) < 1)
            for k in range(0, len(active), 2048):
                rows = active[k : k + 2048]
                a = np.column_stack([x[rows], np.ones(len(rows))]).astype(np.float64)
                costed = a * (scale * weight[rows])[:, None]
                left += costed.T @ a
                right += side * costed.sum(0)
        step, now, size = np.linalg.solve(left, right) - w, loss(w), 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def logistic(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the columns and the constant, by Newton steps that never raise the loss."""
    middle, scale = s.mean(0), s.std(0) + 1e-9
    x = np.column_stack([(s - middle) / scale, np.ones(len(s))])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    loss = lambda w: float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + w @ ridge @ w / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step, size = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - w[:-1] @ (middle / scale))


def altered(stretch: str) -> list[str]:
    """A telling stretch with a character inserted at five places, or a space in the middle."""
    word = stretch.strip()
    cuts = [max(1, len(word) * q // 6) for q in range(1, 6)]
    return [f" {x} " for x in (*(word[:k] + "xaqez"[n] + word[k:] for n, k in enumerate(cuts)), word[: cuts[2]] + " " + word[cuts[2] :])]


def surprise(toxic: np.ndarray, all_: np.ndarray, share: float) -> np.ndarray:
    """Lower bound of -log of the chance that of ``all_`` documents at least ``toxic`` are toxic if each is by ``share``."""
    q = np.clip(toxic / np.maximum(all_, 1), 1e-12, 1)
    rest = np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - share)), 0)
    return np.where(q > share, all_ * (q * np.log(q / share) + rest), 0)


def telling(docs: list[np.ndarray], labels: np.ndarray, n: int, usable: Callable[[int], bool]) -> list[int]:
    """Numbers below ``n`` that stand in more toxic documents than chance explains.

    At most TELLING, chosen one by one: the one in most toxic documents that hold fewer than COVER chosen ones.
    """
    counts = np.zeros((2, n), np.int64)
    for d, y in zip(docs, labels.tolist(), strict=True):
        counts[y, np.unique(d)] += 1
    found = surprise(counts[1], counts.sum(0), float(labels.mean()))
    good = [k for k in np.argsort(-found, kind="stable")[: 16 * TELLING].tolist() if found[k] > np.log(max(n, 1) / BY_CHANCE) and usable(k)]
    if not good:
        return []
    holds = np.array([np.isin(good, d) for d, y in zip(docs, labels.tolist(), strict=True) if y], np.int64)
    covered, out = np.zeros(len(holds), int), []
    while len(out) < min(TELLING, len(good)):
        gain = (covered < COVER).astype(np.int64) @ holds
        gain[out] = -1
        out.append(int(gain.argmax()))
        covered += holds[:, out[-1]]
    return [good[k] for k in out]


def sentence_words(text: str) -> list[list[str]]:
    out = []
    for held in blocks_of(text):
        found = sentences([held])
        out += [found.text(a, b).split() for a, b in zip(found.first.tolist(), found.stops().tolist())]
    return out


def telling_stretches(texts: list[str], labels: np.ndarray) -> list[str]:
    """Words, then pairs of neighbouring words of documents without such a word, each between spaces."""
    ids: dict[str, int] = {}
    lines = [[np.array([ids.setdefault(w, len(ids)) for w in s], np.int64) for s in sentence_words(t)] for t in texts]
    words = [*ids]
    docs = [np.concatenate(d) if d else np.empty(0, np.int64) for d in lines]
    good = telling(docs, labels, len(words), lambda k: 3 <= len(words[k]) <= LONGEST)
    out = [f" {words[k]} " for k in good]
    rest = [k for k, d in enumerate(docs) if not np.isin(d, good).any()]
    pairs = [np.unique(np.concatenate([s[:-1] << 32 | s[1:] for s in lines[k]])) if lines[k] else np.empty(0, np.int64) for k in rest]
    if pairs and labels[rest].any() and not labels[rest].all():
        names, at = np.unique(np.concatenate(pairs), return_inverse=True)
        numbered = np.split(at, np.cumsum([len(p) for p in pairs])[:-1])
        pair = lambda k: f"{words[names[k] >> 32]} {words[names[k] & 0xFFFFFFFF]}"
        out += [f" {pair(k)} " for k in telling(numbered, labels[rest], len(names), lambda k: len(pair(k)) <= LONGEST)]
    return out[:TELLING]


def fit_rows(rows: list[tuple[str, int]], prior: float) -> Model:
    """Model of (text, label) rows. prior: the share of toxic documents among all labelled ones."""
    rows = [*dict.fromkeys(rows)]
    texts, labels = [t for t, _ in rows], np.array([y for _, y in rows], np.int64)
    if not labels.any() or labels.all():
        return Model()
    marks = telling_stretches(texts, labels)
    if not marks:
        return Model(prior=prior)
    give_back()

    def laid() -> Iterator[tuple[np.ndarray, Sentences]]:
        """Sentences of the sample and the texts they belong to, laid out anew for each pass: kept, they would take most memory."""
        for of, held in batched(texts):
            found = sentences(held)
            if len(found.first):
                yield np.array(of)[found.of], found

    # clean landmarks: those stretches of clean sentences that are most like the telling ones, and others at random
    spread, like, other, size = np.random.default_rng(7), [], [], max(1, sum(map(len, texts)))
    first = Model(Landmarks(marks), np.ones(len(marks), np.float32), 0.0)
    folded = first.folded()
    for doc, found in laid():
        value, widths = decided(found, first, folded)
        top, place = worst(found, value)
        clean = np.flatnonzero(labels[doc] == 0)
        for k in clean[np.argsort(-top[clean], kind="stable")[:CONTRAST]].tolist():
            at = int(place[k])
            like.append((float(top[k]), found.text(at, min(at + int(widths[at]), int(found.stops()[k])))))
        for k in spread.permutation(clean)[: 1 + CONTRAST * BLOCK // size].tolist():
            at = int(spread.integers(found.first[k], max(found.first[k] + 1, found.stops()[k] - 12)))
            other.append(found.text(at, min(at + 12, int(found.stops()[k]))))
    usable = lambda found: [s for s in dict.fromkeys(found) if len(s) > 3 and not any(m in s for m in marks)]
    other, like = usable(other)[: CONTRAST // 3], usable(s for _, s in sorted(like, reverse=True)[: 32 * CONTRAST])
    # in turn for each telling stretch, so that a frequent family of words does not take all places
    nearest = first.landmarks.kernel([(s, WIDTHS[-1]) for s in like]).argmax(1) if like else np.empty(0, int)
    turns = Counter()
    for k, m in enumerate(nearest.tolist()):
        turns[m] += 1
        nearest[k] = turns[m]
    like = [like[k] for k in np.argsort(nearest, kind="stable").tolist() if like[k] not in other]
    land = Landmarks(marks + other + like[: CONTRAST - len(other)])
    own = land.kernel([(s, len(s)) for s in land.stretches]).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, FLOOR)) @ vectors.T
    changed = [x for m in marks for x in altered(m)]
    features = lambda stretches: land.kernel(stretches) @ root.astype(np.float32)
    width_of = lambda s: next((w for w in WIDTHS if len(s) <= w), WIDTHS[-1])
    fixed = features([(x, width_of(x)) for x in (*marks, *changed)])
    # at first a stretch is as toxic as it is like the telling landmarks
    model = Model(land, (np.arange(len(land.stretches)) < len(marks)).astype(np.float32), 0.0, prior=prior)
    seen: Counter[tuple[str, int]] = Counter()
    good: list[tuple[list[tuple[str, int]], np.ndarray]] = []  # clean stretches of each turn and their features
    for turn in range(TURNS):
        folded, positive, hard = model.folded(), Counter(), []
        for doc, found in laid():
            value, widths = decided(found, model, folded)
            top, place = worst(found, value)
            stop = np.minimum(place + widths[place], found.stops())
            cut = lambda k: (found.text(int(place[k]), int(stop[k])), int(widths[place[k]]))
            toxic = labels[doc] == 1
            some = [cut(k) for k in np.flatnonzero(toxic & (top > 0)).tolist()]
            positive.update(x for x in some if turn or any(m.strip() in x[0] for m in marks))
            clean = np.flatnonzero(~toxic)
            hard += [(float(top[k]), *cut(k)) for k in clean[np.argsort(-top[clean], kind="stable")[:HARD]].tolist()]
            if len(hard) > 8 * HARD:
                hard = sorted(hard, reverse=True)[:HARD]
        hard.sort(reverse=True)
        now = Counter((s, w) for _, s, w in hard[:HARD])
        new = [x for x in now if x not in seen]
        seen.update(now)
        good.append((new, features(new)))
        # parts of the whole weight: toxic stretches, forms of telling words, clean stretches, a stretch without likeness
        parts = [(0.2, 1, features([*positive]), [*positive.values()]), (0.3, 1, fixed, [1] * len(fixed))]
        parts += [(0.4 * sum(seen[s] for s in some) / seen.total(), -1, x, [seen[s] for s in some]) for some, x in good]
        parts.append((0.1, -1, np.zeros((1, len(land.stretches)), np.float32), [1]))
        w, b = svm([(x, side, part * np.array(n, float) / sum(n)) for part, side, x, n in parts if len(x)], COST * len(land.stretches))
        model.alpha, model.bias = (root @ w).astype(np.float32), b
    evidence = Scorer(model).evidence(texts)
    weight = np.where(labels == 1, prior / labels.sum(), (1 - prior) / (labels == 0).sum()) * len(labels)
    model.weights = logistic(evidence, labels, weight)
    return model


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model of the labelled documents that are not held out. The sample is bounded, its ids are chosen by hash."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col(label).alias("__y"))
    sizes = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if len(sizes) < 2:
        return Model()
    order = F.xxhash64(F.lit("toxic sample"), key)
    picked = known.where("__y = 1").orderBy(order, key).limit(SAMPLE_TOXIC).unionByName(known.where("__y = 0").orderBy(order, key).limit(SAMPLE_CLEAN))
    prior = sizes[1] / (sizes[0] + sizes[1])
    rows = documents.select(key, no_null(text).alias("t")).join(F.broadcast(picked), key).select(key, "t", "__y")
    # in order of the hash, as long as the texts so far fit; sums over the picked rows alone
    so_far = F.sum(F.octet_length("t")).over(Window.partitionBy("__y").orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__bytes", so_far).where(F.col("__bytes") <= SAMPLE_BYTES).drop("__bytes")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("training",), lambda: None)  # frees what the worker kept before
        sample = sorted(x for b in batches for x in zip(b[key].to_pylist(), b["t"].to_pylist(), b["__y"].to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows([(t, y) for _, t, y in sample], prior))], pa.binary())], ["model"])

    # one task holds the sample, which is bounded; the driver gets the model alone
    return pickle.loads(rows.repartition(1).mapInArrow(train, "model binary").first()["model"])


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """All columns of ``df`` and the score."""
    keep = [c for c in df.columns if c != to]
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], f"`{to}` double"])
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few hundred landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        scorer = worker_state(("toxic", found.name), lambda: Scorer(found))
        for batch in sliced(batches, text):
            values = found.probability(scorer.evidence(text_list(batch[text])))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(values, pa.float64())], [*keep, to])

    return df.mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score below one half, with their columns."""
    to = fresh_name(df, "toxicity")
    return score(df, model, text, to).where(F.col(to) < 0.5).drop(to)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
