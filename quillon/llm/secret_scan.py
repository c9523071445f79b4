"""Secret scans: base patterns, and a character convolutional network over every candidate and its context.

Base kinds are found as leftmost non-overlapping matches of each pattern, shorter ones dropped.  Candidates are the base
spans (of an assignment, its value) and every maximal run, outside them, of at least `RUN` characters of
A-Z a-z 0-9 + / _ = -.  The network gives each a probability; base spans are findings whatever it says, other candidates
are where it reaches the threshold.  It sees up to 48 bytes of the candidate and 24 bytes of text on each side; a longer
candidate is seen in overlapping parts of 48 bytes that cover it, and its score is the highest of theirs.

It is written and trained in numpy on labelled findings: a bounded sample of the corpus (base matches as secrets, runs
without a digit as none) and seeded synthetic ones.  Its scores are calibrated (Platt scaling) on findings that it was not
trained on, and the threshold is the one with the fewest false alarms of those that keep the wanted recall there.

Texts are scanned as UTF-8 bytes: every character of the patterns is ASCII, so matches are the same as over code points;
spans are given in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import written
from .words import Texts, blocks

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "network")

RUN = 16
SIDE, BODY = 24, 48
WIDTH = SIDE + BODY + SIDE
#: Bytes from one part of a long candidate to the next.
STEP = 12
#: Findings of the corpus with each label that the network learns from, and bytes of a long one that stand for it there.
SAMPLE, LEARNT = 1500, 256
#: Times that the network is shown its findings.
PASSES = 8


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS = _table(b"0123456789")
LETTERS = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
HEX = _table(b"0123456789abcdef")
BODY_CHARS = DIGITS | LETTERS | _table(b"+/_=-")
SIGN = _table(b":=")


def runs(texts: Texts, wanted: np.ndarray, least: int, without: Iterable[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of wanted bytes within a text and outside some spans, of at least `least` bytes."""
    data, offsets = texts
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    yes = wanted[data]
    for a, b in without:
        yes[a:b] = False
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = yes.copy()
    start[1:] &= ~yes[:-1] | cut[1:-1]
    end = yes.copy()
    end[:-1] &= ~yes[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = end - start >= least
    return start[long], end[long]


class Span(NamedTuple):
    """A text's number, and a span of Texts.data; the candidate begins at `body`."""

    text: int
    start: int
    kind: int
    end: int
    body: int


def base_spans(texts: Texts) -> list[Span]:
    """All base matches in order of text, start and kind."""
    data, offsets = texts
    found = []
    start, end = runs(texts, HEX, LEAST_HEX)
    found += zip(np.searchsorted(offsets, start, "right") - 1, start, [2] * len(start), end, start, strict=True)
    signs = np.flatnonzero(SIGN[data])
    for i in np.unique(np.searchsorted(offsets, signs, "right") - 1):
        at = offsets[i]
        found += [(i, at + m.start(), 0, at + m.end(), at + m.start(2)) for m in ASSIGN.finditer(texts.text(i)) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    whole, at, met = data.tobytes(), 0, []
    while (at := whole.find(b"AKIA", at)) >= 0:
        met.append(at)
        at += 4
    for i in np.unique(np.searchsorted(offsets, np.array(met, np.int64), "right") - 1):
        at = offsets[i]
        found += [(i, at + m.start(), 1, at + m.end(), at + m.start()) for m in ACCESS.finditer(texts.text(i)) if m.end() - m.start() >= LEAST_ACCESS]
    return [Span(*map(int, x)) for x in sorted(found)]


def candidates(texts: Texts) -> list[Span]:
    """The base spans and the runs outside them, in order of text, start and kind."""
    base = base_spans(texts)
    start, end = runs(texts, BODY_CHARS, RUN, [(x.start, x.end) for x in base])
    of = np.searchsorted(texts.offsets, start, "right") - 1
    rest = [Span(i, a, 3, b, a) for i, a, b in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)]
    return sorted(base + rest) if base and rest else base or rest


def windows(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the network sees of each candidate: byte values 1-127, 128 for other bytes, 0 where there is none."""
    data, offsets = texts
    of = np.searchsorted(offsets, start, "right") - 1
    lo, hi = offsets[of][:, None], offsets[of + 1][:, None]
    step = np.arange(WIDTH)
    at = np.where(step < SIDE + BODY, start[:, None] - SIDE + step, end[:, None] + step - SIDE - BODY)
    there = (at >= lo) & (at < hi) & ((step < SIDE) | (step >= SIDE + BODY) | (at < end[:, None]))
    return np.where(there, np.minimum(data[np.clip(at, 0, max(len(data) - 1, 0))], 128), 0).astype(np.uint8)


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate, start and end of the parts of up to BODY bytes that the network sees, in order; the last one of a
    candidate ends where it ends."""
    more = np.maximum(end - start - BODY, 0)
    n = 1 - (-more // STEP)
    of = np.repeat(np.arange(len(start)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    lo = start[of] + np.minimum(k * STEP, more[of])
    return of, lo, np.minimum(lo + BODY, end[of])


class Finding(NamedTuple):
    before: bytes
    body: bytes
    after: bytes
    secret: bool


def labelled_findings(n: int = 2400, seed: int = 5, without: tuple[int, ...] = (), only: tuple[int, ...] = ()) -> list[Finding]:
    """Findings labelled by how they were made, half of them secrets: random keys, tokens and digests in code, settings
    and prose against words, numbers, names, paths, dates and identifiers in the same places.  without, only: shapes of
    secrets, by number, to leave out or to make alone."""
    rnd = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    parts = ["th", "er", "on", "an", "in", "re", "ed", "tion", "able", "user", "data", "node", "page", "test", "item", "ver"]

    def some(chars: str, lo: int, hi: int) -> str:
        return "".join(rnd.choices(chars, k=rnd.randint(lo, hi)))

    def word() -> str:
        return "".join(rnd.choices(parts, k=rnd.randint(1, 4)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    secret = [
        lambda: some(lower + upper + digit, 20, 48),
        lambda: some(lower + upper + digit + "+/", 28, 60) + "=" * rnd.randint(0, 2),
        lambda: some("0123456789abcdef", 24, 64),
        lambda: some("0123456789ABCDEF", 24, 64),
        lambda: rnd.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "pk_"]) + some(lower + upper + digit, 20, 40),
        lambda: some(lower + digit, 24, 40),
        lambda: some(upper + digit, 18, 40),
    ]
    def syllables(lo: int, hi: int) -> str:
        out = ""
        while len(out) < lo:
            out += rnd.choice(["", *"bcdfghjklmnprstvwz", "ch", "sch", "st", "tr", "th", "qu"]) + rnd.choice([*"aeiou", "ei", "au", "ou", "ie"]) + rnd.choice(["", "", "n", "r", "t", "st", "ng"])
        return out[: max(lo, hi)]

    plain = [
        lambda: "_".join(word() for _ in range(rnd.randint(3, 5))) + some(digit, 1, 3),
        lambda: "-".join([some(digit, 4, 4), some(digit, 2, 2), some(digit, 2, 2)]) + "-" + word() + word(),
        lambda: "/".join(word() for _ in range(rnd.randint(3, 6))) + "/" + some(digit, 1, 4),
        lambda: some(digit, 14, 20) + rnd.choice(["ms", "px", "kg", "th"]),
        lambda: word() + word() + word() + word() + some(digit, 1, 4),
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + some(digit, 1, 2),
        lambda: "=" * rnd.randint(12, 30) + word() + some(digit, 1, 1),
        lambda: "1" * rnd.randint(10, 20) + "a" * rnd.randint(8, 16),
        lambda: syllables(16, 40),
        lambda: syllables(16, 40),
        lambda: syllables(16, 30).capitalize(),
        lambda: syllables(16, 30).upper(),
        lambda: "".join(syllables(3, 9).capitalize() for _ in range(rnd.randint(3, 5))),
        lambda: rnd.choice("_-/").join(syllables(2, 9) for _ in range(rnd.randint(3, 7))),
        lambda: rnd.choice("_-").join(syllables(3, 9).upper() for _ in range(rnd.randint(3, 5))),
        lambda: some(digit, 16, 24),
        lambda: rnd.choice("=_-/+") * rnd.randint(16, 60),
    ]
    secret = [f for k, f in enumerate(secret) if k not in without and (not only or k in only)]
    around = [lambda: (prose(4) + " ", " " + prose(4)), lambda: (word() + "=", "\n" + prose(3)), lambda: (prose(2) + ' "', '" ' + prose(2)), lambda: ("key: ", "\n"), lambda: ("", ""), lambda: (prose(3) + " (", ") " + prose(3))]
    out = []
    for k in range(n):
        before, after = rnd.choice(around)()
        body = rnd.choice(secret if k % 2 else plain)()
        while k % 2 and not (any(c in digit for c in body) and any(c.isalpha() for c in body)) or len(body) < RUN:
            body += rnd.choice(digit) + some(lower + digit, 4, 8) if k % 2 else word()
        out.append(Finding(before.encode(), body.encode(), after.encode(), bool(k % 2)))
    return out


class Network:
    """Characters as learnt vectors, one convolution, the largest response in each of the three parts, one output."""

    def __init__(self, dim: int = 8, filters: int = 24, width: int = 5, seed: int = 3):
        rnd = np.random.default_rng(seed)
        self.width, self.dim = width, dim
        self.w = {"e": rnd.normal(0, 0.3, (129, dim)), "c": rnd.normal(0, (2 / (dim * width)) ** 0.5, (width * dim, filters)), "b": np.zeros(filters), "o": rnd.normal(0, 0.1, 4 * filters), "z": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.w["e"][x]
        e[x == 0] = 0
        n, steps = len(x), WIDTH - self.width + 1
        u = np.concatenate([e[:, k : k + steps] for k in range(self.width)], axis=2).reshape(n * steps, -1)
        r = np.maximum(u @ self.w["c"] + self.w["b"], 0).reshape(n, steps, -1)
        cuts = (slice(0, SIDE - 2), slice(SIDE - 2, SIDE + BODY - 2), slice(SIDE + BODY - 2, steps))
        tops = [r[:, c].argmax(axis=1) + c.start for c in cuts]
        pooled = [np.take_along_axis(r, t[:, None], axis=1)[:, 0] for t in tops]
        size = np.maximum((x[:, SIDE : SIDE + BODY] > 0).sum(axis=1), 1).astype(np.float32)
        mean = r[:, cuts[1]].sum(axis=1) / size[:, None]
        p = np.concatenate([*pooled, mean], axis=1)
        return p @ self.w["o"] + self.w["z"][0], (u, r, cuts, tops, size, p)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -35, 35)))

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = 3, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        rnd = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        t = 0
        for _ in range(passes):
            order = rnd.permutation(len(x))
            for at in range(0, len(x), batch):
                k = order[at : at + batch]
                t += 1
                for name, g in self._gradients(x[k], y[k]).items():
                    m1[name] += 0.1 * (g - m1[name])
                    m2[name] += 0.001 * (g * g - m2[name])
                    self.w[name] -= rate * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (u, r, cuts, tops, size, p) = self._forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(x)).astype(np.float32)
        back = d[:, None] * self.w["o"]
        f = r.shape[2]
        dr = np.zeros_like(r)
        rows = np.arange(len(x))[:, None]
        for j, t in enumerate(tops):
            dr[rows, t, np.arange(f)] += back[:, j * f : (j + 1) * f]
        dr[:, cuts[1]] += (back[:, 3 * f :] / size[:, None])[:, None]
        dr[r <= 0] = 0
        flat = dr.reshape(-1, f)
        du = (flat @ self.w["c"].T).reshape(len(x), r.shape[1], self.width, self.dim)
        de = np.zeros_like(self.w["e"])
        for k in range(self.width):
            np.add.at(de, x[:, k : k + r.shape[1]], du[:, :, k])
        de[0] = 0
        return {"e": de, "c": u.T @ flat, "b": flat.sum(axis=0), "o": p.T @ d, "z": d.sum(keepdims=True)}

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Fit scale and shift by Newton steps; then, of the thresholds that keep the recall, take the highest of those with
        the fewest false alarms."""
        z, a, b = self.logits(x).astype(np.float64), 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
            v = p * (1 - p) + 1e-6
            g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
            h = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale, self.shift = float(a), float(b)
        p = self.probabilities(x)
        good, bad = np.sort(p[y == 1]), np.sort(p[y == 0])
        if not len(good):
            return
        allowed = good[: int((1 - recall) * len(good)) + 1]
        wrong = len(bad) - np.searchsorted(bad, allowed, "left")
        least = allowed[len(wrong) - 1 - np.argmin(wrong[::-1])]
        below = p[p < least]
        self.threshold = float((least + below.max()) / 2 if len(below) else least / 2)


def train(findings: list[Finding], recall: float = 0.98) -> Network:
    """A network trained on the parts of three of four findings and calibrated on the highest scores of the fourth."""
    if not findings:
        raise ValueError("no labelled findings")
    seen, of = [], []
    for i, f in enumerate(findings):
        data = np.frombuffer(f.before + f.body + f.after, np.uint8)
        _, lo, hi = pieces(np.array([len(f.before)]), np.array([len(f.before) + len(f.body)]))
        seen.append(windows(Texts(data, np.array([0, len(data)])), lo, hi))
        of += [i] * len(lo)
    x, of, y = np.concatenate(seen), np.array(of), np.array([f.secret for f in findings], np.float32)
    held = np.arange(len(y)) % 8 >= 6
    net = Network()
    net.train(x[~held[of]], y[of][~held[of]], passes=PASSES)
    if held.any():
        x, of = x[held[of]], of[held[of]]
        highest = np.full(len(y), -np.inf)
        z = net.logits(x)
        np.maximum.at(highest, of, z)
        first = np.flatnonzero(z == highest[of])
        first = first[np.unique(of[first], return_index=True)[1]]
        net.calibrate(x[first], y[of[first]], recall)
    return net


def judged(texts: Texts, net: Network, found: list[Span]) -> np.ndarray:
    """The highest probability of each candidate's parts."""
    start, end = (np.array([x[k] for x in found], np.int64) for k in (4, 3))
    of, lo, hi = pieces(start, end)
    best = np.zeros(len(start))
    for k in range(0, len(of), 4096):
        np.maximum.at(best, of[k : k + 4096], net.probabilities(windows(texts, lo[k : k + 4096], hi[k : k + 4096])))
    return best


def scored(texts: Texts, net: Network) -> list[tuple[Span, float, bool]]:
    """Every candidate, its probability, and whether it is a finding."""
    found = candidates(texts)
    return [(x, score, x.kind < 3 or score >= net.threshold) for x, score in zip(found, judged(texts, net, found).tolist(), strict=True)]


def corpus_findings(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> list[Finding]:
    """Up to `most` different findings with each label, those of least hash of all in docs: base matches as secrets, runs
    without a digit as none.  Of a candidate of over LEARNT bytes the first ones are taken."""
    rest = LETTERS | _table(b"+/_=-")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[dict[bytes, tuple]] = [{}, {}]

        def shrunk(size: int) -> None:
            for k in (0, 1):
                if len(least[k]) > size:
                    least[k] = dict(heapq.nsmallest(most, least[k].items()))

        for _, texts in blocks(batches, "__text"):
            plain = np.append(0, np.cumsum(~rest[texts.data], dtype=np.int32)) if len(texts.data) else np.zeros(1, np.int32)
            for x in candidates(texts):
                if x.kind == 3 and plain[x.end] > plain[x.body]:
                    continue
                lo, hi, end = texts.offsets[x.text], texts.offsets[x.text + 1], min(x.end, x.body + LEARNT)
                cut = [texts.data[a:b].tobytes() for a, b in ((max(lo, x.body - SIDE), x.body), (x.body, end), (x.end, min(hi, x.end + SIDE)))]
                least[x.kind < 3].setdefault(hashlib.blake2b(b"\0".join(cut), digest_size=8).digest(), tuple(cut))
            shrunk(16 * most)
        shrunk(most)
        for label in (0, 1):
            rows = [(key, *cut) for key, cut in sorted(least[label].items())]
            columns = [pa.array([r[k] for r in rows], pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([label] * len(rows), pa.int32())], ["key", "before", "body", "after", "label"])

    made = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "key binary, before binary, body binary, after binary, label int")
    found = written(made.dropDuplicates(["label", "key"]))
    rows = [r for label in (0, 1) for r in found.where(F.col("label") == label).orderBy("key").limit(most).collect()]
    rows.sort(key=lambda r: bytes(r["key"]))
    return [Finding(bytes(r["before"]), bytes(r["body"]), bytes(r["after"]), r["label"] == 1) for r in rows]


def default_network(docs: DataFrame, text: str, findings: list[Finding] | None = None, recall: float = 0.98):
    """Trained on the driver, from findings of a bounded number, and broadcast."""
    return docs.sparkSession.sparkContext.broadcast(train(findings or corpus_findings(docs, text) + labelled_findings(), recall))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), findings: list[Finding] | None = None, recall: float = 0.98) -> DataFrame:
    """A row for each document: keep, n_assign, n_access, n_hex, n_network, base_sha256, spans, n_candidates, scores.

    spans lists kind:start:end by start, then kind, comma-joined; base_sha256 is the digest of the base spans alone.  scores
    lists kind:start:end:probability of every candidate, base spans too, found or not, in the same order.  A null text
    counts as empty: no spans, empty lists.  Repeated rows, and rows without id, give a result each; a text of any length
    is scanned whole; an empty table gives no rows.  A map over partitions, after one more that samples findings to learn
    from (findings: other ones to learn from).
    """
    shared = default_network(docs, text, findings, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "__text"):
            found = scored(texts, shared.value)
            inner = np.append(0, np.cumsum((texts.data & 0xC0) == 0x80)) if found else None
            mine: list[list[tuple[int, str, float, bool]]] = [[] for _ in range(batch.num_rows)]
            for x, score, yes in found:
                at = texts.offsets[x.text]
                a, b = (int(y - at - (inner[y] - inner[at])) for y in (x.start, x.end))
                mine[x.text].append((x.kind, f"{KINDS[x.kind]}:{a}:{b}", score, yes))
            counts = [pa.array([sum(k == kind and yes for k, _, _, yes in x) for x in mine], pa.int64()) for kind in range(4)]
            base = pa.array([hashlib.sha256(",".join(t for k, t, _, _ in x if k < 3).encode()).hexdigest() for x in mine])
            spans = pa.array([",".join(t for _, t, _, yes in x if yes) for x in mine], pa.string())
            scores = pa.array([",".join(f"{t}:{score:.3f}" for _, t, score, _ in x) for x in mine], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, base, spans, pa.array([len(x) for x in mine], pa.int64()), scores], names)

    types = {"base_sha256": T.StringType(), "spans": T.StringType(), "scores": T.StringType()}
    added = ["n_assign", "n_access", "n_hex", "n_network", "base_sha256", "spans", "n_candidates", "scores"]
    names = [*keep, *added]
    fields = [docs.schema[k] for k in keep] + [T.StructField(n, types.get(n, T.LongType())) for n in added]
    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, T.StructType(fields))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", findings: list[Finding] | None = None, recall: float = 0.98) -> DataFrame:
    """docs, all columns and rows, each found span (overlapping ones as one) replaced by the mark; a null text stays null,
    an empty table empty, and repeated rows come out alike."""
    shared = default_network(docs, text, findings, recall)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text):
            found = [x for x, _, yes in scored(texts, shared.value) if yes]
            if not found:
                yield batch
                continue
            k = names.index(text)
            values = batch.column(k).to_pylist()
            spans: dict[int, list[list[int]]] = {}
            for x in found:
                mine = spans.setdefault(x.text, [])
                if mine and x.start < mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], x.end)
                else:
                    mine.append([x.start, x.end])
            for i, mine in spans.items():
                cuts = [texts.offsets[i], *(x for s in mine for x in s), texts.offsets[i + 1]]
                values[i] = mark.join(texts.data[a:b].tobytes().decode() for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(values, batch.column(k).type) if j == k else c for j, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)
