"""Personal data in texts: base patterns, and candidates that boosted trees accept.

Base spans come from fixed patterns with a check each and always stay.  Beside them, generators
with high recall propose overlapping candidates (spaced or spelled-out addresses, numbers
without a prefix or with a failed check).  Gradient-boosted trees on format and context score
each candidate; the threshold of a kind is the lowest score at which the candidates of a held-out
quarter of the documents keep ``PRECISION``.  The trees learn on all candidates of all other
documents, each once more with the checks' own features hidden, so that format and context carry
weight.  Right are base spans, and base spans (or made ones) rewritten so that the base patterns
miss them; wrong are candidates whose check fails, candidates that only overlap a rewritten span,
and planted decoys.  Thresholds count only what no base span overlaps.  Accepted candidates that
touch no other span are added.

Trees see a feature only by which of at most 16 quantiles lie below it, so equal rows of those are
one row with a count, and a level of a tree is one sum over them: histograms of the gradients by
node, feature and quantile, in whole multiples of 1 / ``UNIT``, so that no order of adding matters.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import table, written

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.995
ROUNDS = 30
DEPTH = 3
CONTEXT = 24
#: Values of a feature that trees tell apart, at most; parts of a gradient's unit; steps of scores whose counts are summed first.
BINS, UNIT, STEPS = 17, 1 << 24, 4096
#: Different rows of bins that the driver adds up by itself; of more each sum is a Spark job, with the same result.
HERE = 1 << 14
#: Words of a text that may go into what is planted in a place of it.
PLACE_WORDS = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: High-recall generators of further candidates.
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ -]?[0-9]{2,6}){2,5}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+ ?|00 ?)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){2,4}(?![0-9])"),
}
#: Words that announce a kind.
_CUES = {
    "email": ["mail", "contact", "write"],
    "ip": ["ip", "host", "server", "addr"],
    "card": ["card", "visa", "credit", "master", "pay"],
    "phone": ["phone", "tel", "call", "fax", "mobile"],
}
_KIND_OF = {w: k for k, words in _CUES.items() for w in words}
_DIGITS, _STOP, _SPELLED = re.compile("[0-9]+"), re.compile(r"(?<! )\. "), re.compile(r"[(\[](?:at|dot)[)\]]")
_AT, _DOT = re.compile(r" ?(?:@|[(\[]at[)\]]) ?"), re.compile(r" ?[(\[]dot[)\]] ?| ?\. ?")
FEATURES = ["kind", "length", "digits", "digit_share", "separators", "groups", "longest_group", "first_digit", "left", "right", "cue", "other_cue", "number_near", "check", "prefix", "spelled", "stops"]
#: Features that the base checks decide by; hidden in half of the sample.
HIDDEN = [FEATURES.index("check"), FEATURES.index("prefix")]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base patterns, leftmost and non-overlapping in each kind, by start and then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # an address starts where the run of its letters before the sign does, but not inside the one before
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Marks:
    """The places of a text that spans cover, so that an overlap is found in the length of a span, however many there are."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]] = ()):
        self._at = bytearray(len(text))
        for s in spans:
            self.add(s)

    def add(self, span: tuple[str, int, int]) -> None:
        self._at[span[1] : span[2]] = b"\x01" * (span[2] - span[1])

    def free(self, span: tuple[str, int, int]) -> bool:
        return self._at.find(1, span[1], span[2]) < 0


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose, base spans or not; spans may overlap."""
    if not re.search("[0-9@]|at[])]", text):
        return []
    found = {(kind, m.start(), m.end()) for kind, p in _WIDE.items() for m in p.finditer(text)}
    for _, a, b in [s for s in found if s[0] == "email"]:  # a full stop and a blank may end the sentence
        found |= {("email", a, a + m.start()) for m in _STOP.finditer(text[a:b]) if _WIDE["email"].fullmatch(text, a, a + m.start())}
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def describe(text: str, span: tuple[str, int, int]) -> list[float]:
    """The values of ``FEATURES``."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    cues = {k for w, k in _KIND_OF.items() if w in before}
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3 if c in "=\"'_/:#" else 4
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", s))
        check = "@" in plain and " " not in plain and plain.rpartition("@")[2].count(".") > 0
    elif kind == "ip":
        check = len(groups) == 4 and all(int(g) <= 255 for g in groups)
    else:
        check = 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    prefix = s[:1] == "+" or kind == "phone" and s[:2] == "00" or kind == "email" and "@" in s
    return [KINDS.index(kind), b - a, len(digits), len(digits) / (b - a), sum(map(s.count, " .-()/")), len(groups), max(map(len, groups), default=0), int(digits[0]) if digits else -1, side(before[-1:]), side(after[:1]), kind in cues, len(cues) > (kind in cues), any(map(str.isdigit, before[-6:] + after[:6])), check, prefix, len(_SPELLED.findall(s)), len(_STOP.findall(s))]


def _made(kind: str, rng: random.Random, words: list[str]) -> str:
    """A span of the base patterns."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{rng.choice(words)}{rng.choice(['', f'.{rng.choice(words)}', digits(2)])}@{rng.choice(words)}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(rng.choice([rng.randint(0, 9), rng.randint(0, 255)])) for _ in range(4))
    if kind == "card":
        body = digits(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        return rng.choice(["", " ", "-"]).join(body[k : k + 4] for k in range(0, 16, 4))
    return rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}", f"+{rng.randint(20, 99)} {digits(3)} {digits(3)} {digits(3)}"])


def _rewritten(kind: str, span: str, rng: random.Random) -> tuple[str, str]:
    """A base span as the base patterns miss it, and what goes before it."""
    if kind == "email":
        name, _, domain = span.rpartition("@")
        return "", name + rng.choice([" (at) ", " [at] ", "(at)", "[at]", " @ "]) + domain.replace(".", rng.choice([" (dot) ", " [dot] ", "(dot)", "[dot]", "."]))
    if kind == "ip":
        return "", span.replace(".", rng.choice([" . ", " .", ". "]))
    if kind == "card":
        return f"{rng.randint(1, 99)} ", span
    return "", rng.choice(["00", "00 ", ""]) + span.lstrip("+ ")


def _decoy(kind: str, rng: random.Random, words: list[str]) -> str:
    """What looks like a rewritten span and is none."""
    if kind == "email":
        return rng.choice([f"{rng.choice(words)} @ {rng.randint(1, 99)}.{rng.randint(10, 99)}", f"{rng.choice(words)} @ {rng.choice(words)}. {rng.choice(words).capitalize()}"])
    if kind == "ip":
        k = rng.randint(1, 9)
        return rng.choice([f"{k}. {k + 1}. {k + 2}. {k + 3}", rng.choice([" . ", " .", ". "]).join(str(rng.randint(0, 999)) for _ in range(3)) + f". {rng.randint(256, 999)}"])
    if kind == "card":
        span = _made("card", rng, words)
        return span[:-1] + str((int(span[-1]) + rng.randint(1, 9)) % 10)
    return rng.choice([f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}", " ".join(str(rng.randint(10, 9999)) for _ in range(rng.randint(3, 5)))])


#: A candidate, or a place for what is planted, with what stands around it.
PLACE = "draw long, at long, kind string, before string, span string, after string, words string, good boolean, free boolean"


def _places(text: str, draw: int) -> Iterator[tuple]:
    """Rows of ``PLACE``: the candidates of ``text``, without words; and its base spans, and one made span of the kind that ``draw`` names, with words of the text."""
    base = base_spans(text)
    known, marks = set(base), Marks(text, base)
    for s in candidates(text):
        kind, a, b = s
        yield draw, a, kind, text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT], None, s in known, marks.free(s)
    rng = random.Random(draw)
    words = re.findall("[A-Za-z]{3,12}", text[:2000].lower()) or ["name", "office", "example"]
    at = rng.choice([m.end() for m in re.finditer(" ", text[:4000])] or [0])
    kind = KINDS[draw // 4 % len(KINDS)]
    for k, span, a, b in [*((k, text[a:b], a, b) for k, a, b in base), (kind, _made(kind, rng, words), at, at)]:
        after = text[b : b + 2 * CONTEXT]
        yield draw, a, k, text[max(0, a - 2 * CONTEXT) : a], span, after if a < b else f" {after}", " ".join(rng.choices(words, k=PLACE_WORDS)), True, True


def _planted(draw: int, at: int, kind: str, before: str, span: str, after: str, words: list[str]) -> Iterator[tuple[bool, list[float]]]:
    """Verdicts and values of candidates around the rewritten span and a decoy, each in its place."""
    rng = random.Random((draw << 40) + at * len(KINDS) + KINDS.index(kind))
    for right in (True, False):
        ahead, form = _rewritten(kind, span, rng) if right else ("", _decoy(kind, rng, words))
        left = f"{before}{f'{rng.choice(_CUES[kind])}{rng.choice([" ", ": "])}' * rng.randint(0, 1)}{ahead}"
        local = left + form + rng.choice([after, f" {rng.choice(words)} ", f". {rng.choice(words).capitalize()} ", f", {rng.choice(words)} ", ""])
        planted = (kind, len(left), len(left) + len(form))
        marks = Marks(local, base_spans(local))
        for c in candidates(local) if marks.free(planted) else ():
            if planted[1] < c[2] and c[1] < planted[2] and marks.free(c):
                yield right and c == planted, describe(local, c)


def _learned(draw: int, at: int, kind: str, before: str, span: str, after: str, words: str | None, good: bool, free: bool) -> Iterator[tuple[bool, bool, list[float]]]:
    """``good, free`` and values of what a row of ``PLACE`` gives; a candidate that no base span overlaps and whose check passes may be right or wrong, so it is not learned."""
    if words is None:
        x = describe(before + span + after, (kind, len(before), len(before) + len(span)))
        if not free or not x[FEATURES.index("check")]:
            yield good, free, x
    else:
        yield from ((right, True, x) for right, x in _planted(draw, at, kind, before, span, after, words.split()))


@dataclass
class Trees:
    """Each tree is complete: ``feature`` and ``cut`` of its inner nodes, level by level, and the leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


@dataclass
class Binned:
    """A tree on bins: ``feature`` and ``above`` of its inner nodes, level by level (a bin over ``above`` goes right), and the leaves' values."""

    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray | None = None

    def at(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The place, in the level ``depth``, of the node that each row comes to; ``bins`` by feature and row."""
        node = np.zeros(bins.shape[1], dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            node = 2 * node + np.choose(node, [bins[self.feature[k]] > self.above[k] for k in range(first, 2 * first + 1)])
        return node


def _scores(bins: np.ndarray, start: float, trees: list[Binned]) -> np.ndarray:
    """As ``Trees.score`` of the values that ``bins`` are of."""
    out = np.full(bins.shape[1], start)
    for t in trees:
        out += t.leaf[t.at(bins, DEPTH)]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _sums(bins: np.ndarray, y: np.ndarray, n: np.ndarray, start: float, done: list[Binned], tree: Binned, level: int) -> np.ndarray:
    """Gradients and curvatures of rows with counts ``n`` after the trees ``done``, in parts of ``UNIT``, by node of the level of ``tree``, feature and bin."""
    p = _scores(bins, start, done)
    weights = [np.rint((p - y) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n]  # whole numbers, exact in doubles
    node, width = tree.at(bins, level) * BINS, 2**level
    return np.stack([[np.bincount(node + b, w, width * BINS).reshape(width, BINS) for b in bins] for w in weights]).transpose(0, 2, 1, 3).astype(np.int64)


def _grown(cuts: list[np.ndarray], start: float, summed: Callable[[list[Binned], Binned, int], np.ndarray], rounds: int, rate: float, ridge: float) -> list[Binned]:
    """Gradient boosting of complete trees on the logistic loss; ``summed(done, tree, level)`` gives ``_sums`` over all rows."""
    inner, done = 2**DEPTH - 1, []
    gain_of = lambda g, h: g**2 / (h + ridge)
    for _ in range(rounds):
        tree = Binned(np.zeros(inner, dtype=np.int64), np.full(inner, BINS))
        for level in range(DEPTH):  # the nodes of a level at once
            g, h = summed(done, tree, level) / UNIT
            first, width = 2**level - 1, 2**level
            best, gl, hl = np.full(width, 1e-6), g.cumsum(2), h.cumsum(2)
            gn, hn = gl[:, :1, -1], hl[:, :1, -1]
            for j, cut in enumerate(cuts):
                a, b = gl[:, j, : len(cut)], hl[:, j, : len(cut)]
                gain = gain_of(a, b) + gain_of(gn - a, hn - b) - gain_of(gn, hn)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = np.flatnonzero(top > best)
                best[better], tree.feature[first + better], tree.above[first + better] = top[better], j, k[better]
        each, last = np.arange(width), slice(first, first + width)  # a leaf's sums are the last level's, up to the cut and beyond
        k = np.minimum(tree.above[last], BINS - 1)
        a, b = gl[each, tree.feature[last], k], hl[each, tree.feature[last], k]
        tree.leaf = np.stack([-rate * a / (b + ridge), -rate * (gn[:, 0] - a) / (hn[:, 0] - b + ridge)], axis=1).ravel()
        done.append(tree)
    return done


def _trees(grown: list[Binned], cuts: list[np.ndarray], start: float) -> Trees:
    cut = [[cuts[j][k] if k < len(cuts[j]) else np.inf for j, k in zip(t.feature, t.above, strict=True)] for t in grown]
    return Trees(np.array([t.feature for t in grown]), np.array(cut), np.array([t.leaf for t in grown]), start)


def _start(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts of its feature lie below each value, by feature and row: a value is over cut ``k`` where its bin is over ``k``."""
    return np.stack([np.searchsorted(c, x[:, j], side="left").astype(np.int8) for j, c in enumerate(cuts)])


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """The trees of rows that are in memory."""
    start = _start(y.mean())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[:-1])) for j in range(x.shape[1])]
    return _trees(_grown(cuts, start, partial(_sums, _bins(x, cuts), y, np.ones(len(x)), start), rounds, rate, ridge), cuts, start)


@dataclass
class PiiModel:
    trees: Trees | None
    threshold: dict[str, float]

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Accepted candidates that overlap no base span, and of overlapping ones the better, then the earlier."""
        known = Marks(text, base)
        new = [s for s in candidates(text) if known.free(s)] if self.trees else []
        good: list[tuple[float, tuple[str, int, int]]] = []
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            x = np.array([describe(text, s) for s in some], dtype=float)
            p = np.where(x[:, FEATURES.index("check")] == 1, self.trees.score(x), 0.0)  # a failed check is wrong for certain
            good += [(-q, s) for q, s in zip(p.tolist(), some, strict=True) if q >= self.threshold[s[0]]]
        taken = []
        for _, s in sorted(good, key=lambda x: (x[0], x[1][1], KINDS.index(x[1][0]), x[1][2])):
            if known.free(s):
                known.add(s)
                taken.append(s)
        return taken


def quantiles(values: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``np.quantile`` of ascending ``values``, each as often as ``counts`` says."""
    upto = np.cumsum(counts)
    at = (upto[-1] - 1) * q
    low = np.floor(at).astype(np.int64)
    a, b = (values[np.searchsorted(upto, np.minimum(k, upto[-1] - 1), side="right")] for k in (low, low + 1))
    return a + (b - a) * (at - low)


VALUES = [f"x{j}" for j in range(len(FEATURES))]


def learned(docs: DataFrame) -> DataFrame:
    """``held, good, free, x0, x1, ..., n``: the different rows that all ``docs`` give to learn from or, of a quarter of them by the hash of the id, to set thresholds by, and how many are like that.

    Places are dealt out before they are described, so that a text of very many is work for all tasks.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.bool_()]
        names = [c.split()[0] for c in PLACE.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows = []
        for batch in batches:
            for draw, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in _places(text, draw) if text else ():
                    rows.append(row)
                    if len(rows) == 8192:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(place[0] % 4 == 0, *row) for place in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in _learned(*place)]
            x = np.array([r[3] for r in rows], dtype=float).reshape(len(rows), len(VALUES))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.bool_()) for k in range(3)), *(pa.array(c) for c in x.T)], names=["held", "good", "free", *VALUES])

    texts = docs.select(F.xxhash64("doc_id").alias("draw"), F.col("text").cast("string").alias("text"))
    dealt = texts.mapInArrow(places, PLACE).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.mapInArrow(described, "held boolean, good boolean, free boolean, " + ", ".join(f"{c} double" for c in VALUES))
    return rows.groupBy("held", "good", "free", *VALUES).agg(F.count("*").alias("n"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in VALUES])


def fit(docs: DataFrame) -> PiiModel:
    """Learn from all of ``docs``; without both verdicts among their candidates no span is added.

    To the driver come counts of the values of each feature, which the generators bound, and sums by
    node, feature and bin.
    """
    rows = written(learned(docs), "candidates")
    n = {(r["held"], r["good"]): r["n"] for r in rows.groupBy("held", "good").agg(F.sum("n").alias("n")).collect()}
    right, wrong = n.get((False, True), 0), n.get((False, False), 0)
    if not right + n.get((True, True), 0) or not wrong + n.get((True, False), 0) or not right + wrong:
        return PiiModel(None, {})
    start = _start(right / (right + wrong))
    seen = rows.where("not held").select("n", F.posexplode(F.array(*VALUES)).alias("j", "x")).groupBy("j", "x").agg(F.sum("n").alias("n")).orderBy("j", "x").collect()
    cuts = []
    for j in range(len(VALUES)):
        x, k = (np.array(c) for c in zip(*((r["x"], r["n"]) for r in seen if r["j"] == j), strict=True))
        x, k = (np.append(-1.0, x), np.append(right + wrong, k)) if j in HIDDEN else (x, 2 * k)  # all rows once more, with hidden features
        cuts.append(np.unique(quantiles(x, k, np.linspace(0, 1, BINS)[:-1])))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEPT), *(pa.array(c) for c in _bins(_matrix(batch).T, cuts)), batch.column("n")], names=[*KEPT, *VALUES, "n"])

    KEPT = ["held", "good", "free", "kind", "passed"]
    rows = rows.withColumns({"kind": F.col("x0").cast("int"), "passed": F.col(VALUES[FEATURES.index("check")]) == 1})
    kinds = "held boolean, good boolean, free boolean, kind int, passed boolean, " + ", ".join(f"{c} tinyint" for c in VALUES) + ", n long"
    bins = written(rows.mapInArrow(binned, kinds).groupBy(*KEPT, *VALUES).agg(F.sum("n").alias("n")), "bins")
    learn = bins.where("not held").select("good", *VALUES, "n")

    def of(batch: pa.RecordBatch, done: list[Binned], tree: Binned, level: int) -> np.ndarray:
        b, good, count = _matrix(batch), batch.column("good").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
        veiled = b.copy()
        veiled[HIDDEN] = 0  # they are under all values
        return _sums(np.concatenate([b, veiled], axis=1), np.tile(good.astype(float), 2), np.tile(count, 2), start, done, tree, level)

    def summed(done: list[Binned], tree: Binned, level: int) -> np.ndarray:
        shape = (2, 2**level, len(VALUES), BINS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h = sum((of(batch, done, tree, level) for batch in batches), np.zeros(shape, dtype=np.int64)).reshape(2, -1)
            some = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some]), pa.array(h[some])], names=["cell", "g", "h"])

        out = np.zeros((2, int(np.prod(shape[1:]))), dtype=np.int64)
        for r in learn.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[:, r["cell"]] = r["g"], r["h"]
        return out.reshape(shape)

    if learn.limit(HERE + 1).count() <= HERE:
        summed = partial(of, learn.toArrow().combine_chunks().to_batches()[0])
    grown = _grown(cuts, start, summed, ROUNDS, 0.3, 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.where(batch.column("passed").to_numpy(zero_copy_only=False), _scores(_matrix(batch), start, grown), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(p), batch.column("good"), batch.column("n")], names=["kind", "score", "good", "n"])

    held = bins.where("held and free").mapInArrow(scored, "kind int, score double, good boolean, n long")
    lowest = thresholds(held)
    return PiiModel(_trees(grown, cuts, start), {kind: max(0.5, lowest[k]) if k in lowest else 2.0 for k, kind in enumerate(KINDS)})


def thresholds(held: DataFrame) -> dict[int, float]:
    """The lowest score of each kind from which up at least ``PRECISION`` of the rows ``kind, score, good, n`` are right; equal scores pass together.

    Sums run within a step of scores; what stands in the steps above it, of which there are ``STEPS``, is added.
    """
    each = held.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("right"))
    each = written(each.withColumn("step", F.floor(F.col("score") * STEPS)), "scores")
    above = Window.partitionBy("kind").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = each.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    steps = steps.select("kind", "step", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "right")))
    upto = Window.partitionBy("kind", "step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    passed = each.join(steps, ["kind", "step"]).select("kind", "score", *((F.col(f"{c}_above") + F.sum(c).over(upto)).alias(c) for c in ("n", "right")))
    return {r["kind"]: r["score"] for r in passed.where(F.col("right") / F.col("n") >= PRECISION).groupBy("kind").agg(F.min("score").alias("score")).collect()}


def spans(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``doc_id``, the counts of base spans, ``base_sha256`` and ``spans`` of each row of ``docs``.

    A null or empty text has no spans: the digest of an empty string, and an empty string.
    Repeated rows give repeated rows, a null id stays null, texts and digits of any length are
    looked through whole, and an empty table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = sorted(base + model.added(text or "", base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                for c, v in zip(columns, [*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)], strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, found: str) -> str:
    """``text`` with each span of a ``spans`` string replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in (s.split(":") for s in found.split(",") if s):
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind.upper()}]"]
            at = int(b)
    return "".join(out) + text[at:]


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256`` and all ``spans`` of every document."""
    docs = table(spark, sf_dir, "documents")
    return spans(docs, fit(docs))
