"""Secret scan: fixed rules, and a character convolutional network over every candidate.

Rules give the base findings. A candidate is any run of 12 or more characters of
the secret alphabet. The network (numpy: character embedding, one convolution,
maximum and mean over the candidate, logistic output) reads every candidate with
its surrounding context, in windows that cover the whole of it. Candidates that
it takes for secrets, and that aren't part of a base finding, are added as kind
``cnn``.

The network is trained for each run on all labelled findings of the table, all
windows of each: candidates as secrets where a rule finds them and as others
where they are known to be harmless (words and short numbers, and letters that
stand in several texts, which a secret doesn't; what else no rule finds has no
label), harmless letters in other cases too. Findings are dealt by hash into
shards of about ``SHARD`` parts. In each round every shard goes on from the common
network over all its findings, beside the same generated findings of usual
formats in contexts, and the networks are averaged, so that a table of any size is
learned from in tasks of a bounded size. Findings fall into ten folds: eight fit the
network, one calibrates scores (logistic in the raw score), and on the last the
threshold is the highest that keeps ``RECALL`` of the secrets.

Null and empty texts have no findings. Repeated rows stay. On an empty table the
network is trained on generated findings only and the result is empty. Extra
columns are dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm.storage import plain, table, written

KINDS = ("assign", "access", "hex", "cnn")
#: Parts of findings in a shard, about; a table's number of them gives that of its shards.
SHARD = 16_000
#: Findings that are generated beside those of each shard.
GENERATED = 6000
#: Rounds over all findings, and steps after which a network needs no more of them.
ROUNDS, STEPS = 8, 350
RECALL = 0.99
#: Windows in a part of a finding; a long one has several parts.
PART_WINDOWS = 8
#: Scores are rounded to a part of this when the two numbers of the calibration are fitted.
GRAIN = 1024
BEFORE, INSIDE, AFTER = 20, 40, 6
SEED = 7
#: Windows that are scored at once.
_CHUNK = 512

_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in _WORDS)
_ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so these are the runs of 16 and more
_HINTS = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: A word in one case or with a capital, with a vowel in any five letters, or a short number.
_PLAIN = re.compile(r"(?![a-zA-Z]*[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{5})(?:[A-Z]?[a-z]{1,20}|[A-Z]{1,20})|[0-9]{1,8}")
_PART = re.compile(r"[+/_.-]+")
_SIGN = re.compile(r"""[:=]\x20*["']?$""")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_CODES = bytes(c - 31 if 32 <= c < 127 else 96 for c in range(256))

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long"
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the rules' findings, by start, then kind as listed."""
    spans: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate of a text; full stops and dashes at the end don't count."""
    out = []
    for m in _CANDIDATE.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip(".-"))
        if end - start >= 12:
            out.append((start, end))
    return out


def harmless(text: str, start: int, end: int) -> bool:
    """Whether a candidate is surely no secret: words and short numbers, with no ``=`` inside and not after ``:`` or ``=``."""
    return not _SIGN.search(text, max(0, start - 8), start) and all(not part or _PLAIN.fullmatch(part) for part in _PART.split(text[start:end]))


class Spans:
    """Findings sorted by start, for questions in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self._starts = [s[0] for s in spans]
        self._reach = list(itertools.accumulate((s[1] for s in spans), max))

    def overlap(self, start: int, end: int) -> bool:
        """Whether a finding shares a character with start to end."""
        before = bisect.bisect_left(self._starts, end)
        return before > 0 and self._reach[before - 1] > start

    def hold(self, start: int, end: int) -> bool:
        """Whether start to end is part of a finding."""
        before = bisect.bisect_right(self._starts, start)
        return before > 0 and self._reach[before - 1] >= end


def _codes(text: str) -> bytes:
    """1 to 95 for printable ASCII, 96 for anything else; 0 is left for padding."""
    return (text if text.isascii() else _BEYOND.sub("\x7f", text)).encode("ascii").translate(_CODES)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint8) for w in iter_windows(text, start, end)]


def iter_windows(text: str, start: int, end: int) -> Iterator[bytes]:
    """Windows of a candidate: BEFORE + INSIDE + AFTER codes, then as many flags of what is inside it.

    A candidate longer than INSIDE gets several, half overlapping, up to its end.
    """
    size = BEFORE + INSIDE + AFTER
    firsts = range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2) if end - start > INSIDE else [start]
    for first in firsts:
        at = first - BEFORE
        codes = bytes(max(0, -at)) + _codes(text[max(0, at) : at + size])
        a, b = max(0, start - at), min(size, end - at)
        yield codes.ljust(size, b"\0") + bytes(a) + b"\1" * (b - a) + bytes(size - b)


@dataclass
class CharNet:
    """Embedding of 97 codes, convolution of width 5, two poolings, logistic output; calibration and threshold."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    WIDTH = 5

    @classmethod
    def initial(cls, rng: np.random.Generator, dim: int = 8, n_filters: int = 24) -> CharNet:
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        wide = cls.WIDTH * (dim + 1)
        return cls(draw(97, dim, scale=0.5), draw(wide, n_filters, scale=wide**-0.5), np.zeros(n_filters, np.float32), draw(2 * n_filters + 1, scale=0.2))

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.output]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Scores before the calibration, in chunks of bounded memory."""
        return np.concatenate([self.forward(rows[at : at + _CHUNK])[0] for at in range(0, len(rows), _CHUNK)] or [np.zeros(0, np.float32)])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Raw scores, and what the gradients need. Only positions inside candidates are convolved, as no others are pooled."""
        size, half, n_codes, dim = rows.shape[1] // 2, self.WIDTH // 2, *self.embedding.shape
        flags = np.pad(rows[:, size:], ((0, 0), (half, half)))
        codes = np.pad(rows[:, :size], ((0, 0), (half, half)), constant_values=n_codes) + flags * np.uint8(n_codes + 1)
        near = codes.ravel()[np.flatnonzero(flags)[:, None] + np.arange(-half, half + 1)].astype(np.intp)
        known = np.zeros((2, n_codes + 1, dim + 1), self.embedding.dtype)  # by what is inside or not; the last code is beyond a window
        known[:, :n_codes, :dim], known[1, :, dim] = self.embedding, 1
        columns = known.reshape(-1, dim + 1).take(near, axis=0).reshape(len(near), -1)
        hidden = columns @ self.filters
        hidden += self.bias
        np.maximum(hidden, 0, out=hidden)
        count = flags.sum(axis=1, dtype=np.intp)
        first = np.cumsum(count) - count
        mean = np.add.reduceat(hidden, first) / count[:, None].astype(hidden.dtype)
        pooled = np.concatenate((np.maximum.reduceat(hidden, first), mean, np.ones((len(rows), 1), hidden.dtype)), axis=1)
        return pooled @ self.output, (near, columns, hidden, count, first, pooled)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, in chunks of bounded memory."""
        return self.calibrated(self.raw(rows))

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        raw, (near, columns, hidden, count, first, pooled) = self.forward(rows)
        error = ((1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) / len(rows)).astype(np.float32)
        n_filters, (n_codes, dim) = len(self.bias), self.embedding.shape
        d_pooled, of = error[:, None] * self.output[None, :], np.repeat(np.arange(len(rows)), count)
        is_top = (hidden == pooled[:, :n_filters].take(of, axis=0)).astype(np.float32)  # equal ones share the gradient
        d_top = d_pooled[:, :n_filters] / np.add.reduceat(is_top, first)
        flat = is_top * d_top.take(of, axis=0)
        flat += (d_pooled[:, n_filters : 2 * n_filters] / count[:, None]).astype(np.float32).take(of, axis=0)
        flat *= hidden > 0
        d_filters = columns.T @ flat
        d_columns = (flat @ self.filters.T).reshape(-1, dim + 1)
        of_code = [np.bincount(near.ravel(), weights=d_columns[:, k], minlength=2 * (n_codes + 1)).reshape(2, -1).sum(axis=0)[:n_codes] for k in range(dim)]
        return [np.stack(of_code, axis=1).astype(np.float32), d_filters, flat.sum(axis=0), pooled.T @ error]


def _generated(rng: np.random.Generator, n: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings of usual formats in contexts: (text, start, end, label)."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    number = lambda a, b: int(rng.integers(a, b))
    word = lambda: pick(lower, number(2, 10))
    secrets = [
        lambda: pick(digits + "abcdef", number(20, 65)),
        lambda: pick(digits + "ABCDEF", number(24, 65)),
        lambda: pick(digits + lower + upper, number(20, 50)),
        lambda: pick(digits + lower + upper + "+/", number(24, 60)) + "=" * number(0, 3),
        lambda: "AKIA" + pick(digits + upper, 16),
        lambda: f"{pick(lower, 2)}_{pick(lower, 4)}_{pick(digits + lower + upper, number(20, 40))}",
        lambda: ".".join(pick(digits + lower + upper + "-_", number(20, 40)) for _ in range(3)),
        lambda: pick(lower + upper, number(16, 40)),
    ]
    others = [
        lambda: ".".join(str(number(1, 256)) for _ in range(4)),
        lambda: pick(digits, number(12, 20)),
        lambda: f"{number(1900, 2100)}-{number(10, 13)}-{number(10, 29)}" + f".{word()}" * number(0, 3),
        lambda: f"{word()}{number(0, 100)}.{word()}.{word()}.com",
        lambda: f"{word()}/{word()}-{word()}/{number(0, 10000)}.html",
        lambda: "-".join(pick(digits, number(2, 5)) for _ in range(4)),
        lambda: "_".join([word(), word(), word(), str(number(0, 1000))]),
        lambda: "".join(word() for _ in range(4)),
        lambda: f"v{number(0, 20)}.{number(0, 20)}.{number(0, 20)}-{word()}.{number(0, 9)}",
    ]
    before = ["", 'token = "', "password: ", "secret=", "key ", "api_key: '", "auth=", "Bearer ", "", ""]
    out = []
    for _ in range(n):
        label = number(0, 2)
        kinds = secrets if label else others
        value = kinds[number(0, len(kinds))]()
        head = f"{word()} {word()} {before[number(0, len(before))] if label or rng.random() < 0.2 else ''}"
        out.append((f"{head}{value} {word()}.", len(head), len(head) + len(value), label))
    return out


def folds(findings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to fit, to calibrate and to choose the threshold on; windows of one finding stay together."""
    fold = np.random.default_rng(SEED).integers(0, 10, int(findings.max()) + 1 if len(findings) else 0)[findings]
    return np.flatnonzero(fold > 1), np.flatnonzero(fold == 0), np.flatnonzero(fold == 1)


def _adam(net: CharNet, rows: np.ndarray, labels: np.ndarray, order: np.ndarray, first: list[np.ndarray], second: list[np.ndarray], step: int, batch: int = 256, rate: float = 0.004) -> int:
    """One pass over the rows in an order; changes the network and both moments, returns the number of steps so far."""
    for at in range(0, len(order), batch):
        chosen, step = order[at : at + batch], step + 1
        for p, g, m, v in zip(net.parts(), net.gradients(rows[chosen], labels[chosen]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return step


def train(rows: np.ndarray, labels: np.ndarray, findings: np.ndarray | None = None, epochs: int = 8, batch: int = 256, rate: float = 0.004, recall: float = RECALL) -> CharNet:
    """Adam on eight tenths of the findings; calibration on one tenth, threshold on another.

    ``findings`` numbers the finding of each window (each its own, if absent). A
    finding's score is that of its highest window.
    """
    findings = np.arange(len(rows)) if findings is None else findings
    order, held, last = folds(findings)
    rng = np.random.default_rng(SEED)
    net = CharNet.initial(rng)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for _ in range(epochs):
        rng.shuffle(order)
        step = _adam(net, rows, labels, order, first, second, step, batch, rate)
    net.calibration = _calibrated(net.raw(rows[held]), labels[held])
    best: dict[int, float] = {}
    secret = last[labels[last] == 1]
    for finding, score in zip(findings[secret], net.scores(rows[secret]), strict=True):
        best[int(finding)] = max(best.get(int(finding), 0.0), float(score))
    positive = np.sort(list(best.values()))
    net.threshold = float(positive[int(len(positive) * (1 - recall))]) if len(positive) else 0.5
    return net


def _calibrated(raw: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels on raw scores, each of them seen ``n`` times."""
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w = n * (p * (1 - p) + 1e-6)
        gradient = np.array([(n * (p - y) * raw).sum() + 0.01 * (a - 1), (n * (p - y)).sum() + 0.01 * b])
        hessian = np.array([[(w * raw * raw).sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.01]])
        a, b = np.array([a, b]) - 0.5 * np.linalg.solve(hessian, gradient)
    return float(a), float(b)


def findings(docs: DataFrame) -> DataFrame:
    """All labelled findings of ``docs`` in parts: finding, part, windows, label; repeated rows have repeated findings."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.int64())
        names = ["doc_id", "start", "part", "windows", "label", "letters", "in_text"]
        for batch in batches:
            parts = _parts(batch)
            while some := list(itertools.islice(parts, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    found = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, start long, part int, windows binary, label int, letters string, in_text long")
    found = written(found.withColumn("finding", F.xxhash64("doc_id", "start", "in_text")).drop("doc_id", "start"), "findings")
    unknown = found.filter("label is null")
    common = unknown.groupBy("letters").agg(F.min("in_text").alias("a"), F.max("in_text").alias("b")).filter("a <> b").select("letters")
    of = ("finding", "part", "windows")
    return found.filter("label is not null").select(*of, "label").unionByName(unknown.join(common, "letters").select(*of, F.lit(0).alias("label")))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, start, part, windows, label, letters and the text's number, for each part of a candidate that has a label or may get one."""
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), plain(batch.column("text")), strict=True):
        spans, number = Spans(base_spans(text)), zlib.crc32(text.encode("utf-8", "replace"))
        for s, e in candidates(text):
            secret = spans.overlap(s, e)
            known = secret or harmless(text, s, e)
            if known or (text[s:e].isascii() and text[s:e].isalpha()):
                rows = iter_windows(text, s, e)
                for part in itertools.count():
                    if not (some := list(itertools.islice(rows, PART_WINDOWS))):
                        break
                    yield doc_id, s, part, b"".join(some), int(secret) if known else None, None if known else text[s:e].lower(), number


def sharded(found: DataFrame, parts: int = SHARD) -> tuple[DataFrame, int]:
    """Findings as one row for each shard (shard, findings in order), written, and the number of parts; there is a shard even if there are none.

    Parts are dealt by hash, those of repeated rows one by one.
    """
    found = written(found.groupBy("finding", "part", "windows", "label").agg(F.count("*").alias("n")), "counted")
    n = found.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-n // parts))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("finding", "part", "copy", F.lit(SEED)), F.lit(shards).cast("long")))
    # a number given here isn't lowered by adaptive execution, which makes about as many files as there are cores, some in a second wave
    rows = dealt.repartition(min(shards, 4096), "shard").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("finding", "part", "copy", "label", "windows"))).alias("findings"))
    return written(found.sparkSession.range(shards).withColumnRenamed("id", "shard").join(rows, "shard", "left"), "shards"), n


def labelled_findings(docs: DataFrame, n_docs: int = 1000) -> tuple[list[list[np.ndarray]], list[int]]:
    """Windows and label of each part of a finding, as lists; a look at a small table, and an error for one of more than ``n_docs`` rows."""
    if docs.count() > n_docs:
        raise ValueError(f"more than {n_docs} documents")
    rows = findings(docs).orderBy("finding", "part", "windows").collect()
    return [list(_unpacked(r.windows)) for r in rows], [r.label for r in rows]


def _unpacked(windows: bytes) -> np.ndarray:
    return np.frombuffer(windows, np.uint8).reshape(-1, 2 * (BEFORE + INSIDE + AFTER))


class Lesson:
    """What a shard learns from: windows with label, fold and finding, those of its own findings and the generated ones."""

    def __init__(self, own: pa.StructArray | None, generated: list[list[np.ndarray]], labels: list[int]):
        kinds = {"windows": pa.binary(), "label": pa.int32(), "finding": pa.int64()}
        packed, of, names = (own.field(k) if own is not None else pa.array([], kind) for k, kind in kinds.items())
        packed = packed.to_pylist()
        rows = _unpacked(b"".join(packed))
        at = np.repeat(np.arange(len(packed)), [len(w) // rows.shape[1] for w in packed])
        rows, at = map(np.concatenate, zip((rows, at), *_other_cases(rows, at, of.to_numpy()), strict=True))
        made = np.repeat(np.arange(len(generated)), [len(w) for w in generated])
        self.rows = np.concatenate((rows, *generated))
        self.labels = np.concatenate((of.to_numpy()[at], np.array(labels)[made])).astype(np.float32)
        self.names = np.concatenate((names.to_numpy()[at], made))
        self.folds = np.concatenate((names.to_numpy()[at] % 10, np.random.default_rng(SEED).integers(0, 10, len(generated))[made]))
        self.made = np.arange(len(self.rows)) >= len(rows)


def _flat(net: CharNet, first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in (*net.parts(), *first, *second)]).astype(np.float32)


def _shaped(flat: np.ndarray) -> tuple[CharNet, list[np.ndarray], list[np.ndarray]]:
    net, out, at = CharNet.initial(np.random.default_rng(SEED)), [], 0
    for part in net.parts() * 3:
        out.append(flat[at : at + part.size].reshape(part.shape).copy())
        at += part.size
    return CharNet(*out[:4]), out[4:8], out[8:]


def _learned(shards: DataFrame, n: int, generated: list[list[np.ndarray]], labels: list[int]) -> CharNet:
    """Rounds in which every shard goes on from the average of all; averages are by rows, summed in the shards' order."""
    start = CharNet.initial(np.random.default_rng(SEED))
    zeros = [np.zeros_like(p) for p in start.parts()]
    flat, step = _flat(start, zeros, zeros), 0
    in_round = max(1, round(0.8 * (n / max(1, shards.count()) + len(generated)) / 256))

    for number in range(max(2, min(ROUNDS, -(-STEPS // in_round)))):

        def learn(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, step: int = step, number: int = number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    shard = batch.column("shard")[at].as_py()
                    lesson, (net, first, second) = Lesson(batch.column("findings")[at].values, generated, labels), _shaped(flat)
                    order = np.flatnonzero(lesson.folds > 1)
                    np.random.default_rng((SEED, number, shard)).shuffle(order)
                    done = _adam(net, lesson.rows, lesson.labels, order, first, second, step)
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [len(order)], "step": [done], "flat": [_flat(net, first, second).tobytes()]})

        nets = sorted(shards.mapInArrow(learn, "shard long, n long, step long, flat binary").collect())
        flat = np.average([np.frombuffer(bytes(r.flat), np.float32) for r in nets], axis=0, weights=[r.n for r in nets]).astype(np.float32)
        step = max(r.step for r in nets)
    return _shaped(flat)[0]


def fitted(docs: DataFrame, parts: int = SHARD) -> CharNet:
    """The network, its calibration and its threshold, from all labelled findings of ``docs`` and the generated ones."""
    shards, n = sharded(findings(docs), parts)
    made = _generated(np.random.default_rng(SEED), GENERATED)
    generated, labels = [windows(t, s, e)[:PART_WINDOWS] for t, s, e, _ in made], [g[3] for g in made]
    net = _learned(shards, n, generated, labels)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lesson = Lesson(batch.column("findings")[at].values, generated, labels)
                # generated findings count beside each shard's own, as they did in the rounds
                chosen = np.flatnonzero(lesson.folds <= 1)
                names = np.where(lesson.made, batch.column("shard")[at].as_py(), 0)[chosen]
                columns = (lesson.folds[chosen].astype(np.int32), names, lesson.names[chosen], lesson.labels[chosen].astype(np.int32), net.raw(lesson.rows[chosen]).astype(np.float32), lesson.made[chosen])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fold", "made_in", "finding", "label", "raw", "made"])

    scores = written(shards.mapInArrow(held, "fold int, made_in long, finding long, label int, raw float, made boolean"), "held")
    grain = F.round(F.greatest(F.least("raw", F.lit(40.0)), F.lit(-40.0)) * GRAIN).cast("int")
    seen = scores.filter("fold = 0").groupBy(grain.alias("grain"), "label").agg(F.count("*").alias("n")).orderBy("grain", "label").toPandas()
    net.calibration = _calibrated(seen["grain"].to_numpy() / GRAIN, seen["label"].to_numpy(), seen["n"].to_numpy())
    best = scores.filter("fold = 1 and label = 1").groupBy("made", "made_in", "finding").agg(F.max("raw").alias("raw"))
    best = written(best, "best")
    if secrets := best.count():
        lowest = best.orderBy("raw").offset(int(secrets * (1 - RECALL))).limit(1).first().raw
        net.threshold = float(net.calibrated(np.array([lowest], np.float32))[0])
    return net


def in_other_cases(found: list[list[np.ndarray]], labels: list[int]) -> tuple[list[list[np.ndarray]], list[int]]:
    """The findings, and those of others that are letters only in capitals and in small letters too, where that changes them."""
    at = np.repeat(np.arange(len(found)), [len(w) for w in found])
    more = [(list(rows[of == k]), labels[k]) for rows, of in _other_cases(np.concatenate(found), at, np.array(labels)) for k in np.unique(of)]
    return found + [w for w, _ in more], labels + [label for _, label in more]


def _other_cases(rows: np.ndarray, at: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The windows that ``in_other_cases`` adds to those of all findings, each with its finding; ``at`` has the finding of each of ``rows``."""
    size = BEFORE + INSIDE + AFTER
    codes, inside = rows[:, :size], rows[:, size:] == 1
    small, capital = (inside & (codes - np.uint8(ord(c) - 31) < 26) for c in "aA")  # below the letter, codes wrap around
    some = lambda of: np.bincount(at, weights=of.any(axis=1), minlength=len(labels)) > 0
    letters = (labels == 0) & ~some(inside & ~small & ~capital)
    out = []
    for change, shift in ((small, -32), (capital, 32)):
        chosen = (letters & some(change))[at]
        other = rows[chosen]
        other[:, :size] += change[chosen] * np.uint8(shift % 256)
        out.append((other, at[chosen]))
    return out


def trained(found: list[list[np.ndarray]], labels: list[int]) -> CharNet:
    """The network of findings, each with its windows."""
    of = np.repeat(np.arange(len(found)), [len(w) for w in found])
    return train(np.stack([w for ws in found for w in ws]), np.array(labels, np.float32)[of], of)


def find_secrets(texts: list[str], net: CharNet) -> list[list[Span]]:
    """All findings of each text, by start, then kind as listed. Every candidate is scored."""
    found = [base_spans(t) for t in texts]
    held, rows, owners = [Spans(spans) for spans in found], [], []

    def score() -> None:
        secret = net.scores(_unpacked(b"".join(rows))) >= net.threshold
        for k, start, end in dict.fromkeys(o for o, s in zip(owners, secret, strict=True) if s):
            if not held[k].hold(start, end) and (not found[k] or found[k][-1] != (start, end, "cnn")):
                found[k].append((start, end, "cnn"))
        rows.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for start, end in candidates(text):
            for window in iter_windows(text, start, end):
                rows.append(window)
                owners.append((k, start, end))
                if len(rows) == 8 * _CHUNK:
                    score()
    if rows:
        score()
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in found]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _in_batches(texts: Iterator[str], net: CharNet, size: int = 256) -> Iterator[tuple[str, list[Span]]]:
    """Each text with its findings; ``size`` texts are looked at together."""
    while some := list(itertools.islice(texts, size)):
        yield from zip(some, find_secrets(some, net), strict=True)


def scan(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn for every row of ``docs`` (doc_id, text)."""
    net = net or fitted(docs)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, spans in _in_batches(plain(batch.column("text")), net):
                base = [s for s in spans if s[2] != "cnn"]
                counts = [sum(s[2] == kind for s in spans) for kind in KINDS]
                out.append((*counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), counts[3]))
            columns = zip(*out, strict=True) if out else ((),) * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = [c.split()[0] for c in SCANNED.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, SCANNED)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping findings replaced by ``mark``."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k][:2]
        while k < len(spans) and spans[k][0] <= end:
            end, k = max(end, spans[k][1]), k + 1
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; other columns stay, n_chars follows the text if there is one."""
    net = net or fitted(docs)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        cleaned = (redact(t, spans) if spans else t for t, spans in _in_batches(plain(texts), net))
        return pa.array([c if known else None for c, known in zip(cleaned, texts.is_valid().to_pylist(), strict=True)], pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
