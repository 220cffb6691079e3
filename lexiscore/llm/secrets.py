"""Secret scans: patterns find the sure cases, a character convolutional network judges every other candidate.

A candidate is a run of 16 or more key-like characters (letters, digits, ``+/_=-``) that holds a digit, or of 24 or more
without one. The network reads the run and the text around it. It is trained in numpy on labelled findings: those made by
rule (``secret_findings``), which show it what keys look like beyond the patterns, and all distinct ones of the corpus, which
show it what runs the corpus is full of: label 1 where a pattern confirms one, else 0. A long run is seen in several views,
and the highest one counts, in training, calibration and scan alike. Scores are calibrated on findings that training has not
seen, and the threshold is the highest that keeps the wanted recall there. Every candidate gets a score. Findings of the
patterns always stay, whatever theirs is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.averages import PARTS, parts, weighted_means
from lexiscore.llm.secret_findings import labelled
from lexiscore.llm.words import bound_batches
from lexiscore.session import written

# The kinds, in order, and their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
ADDED = "network"

# A quick look that passes every text with a finding.
_MAYBE = r"""AKIA[A-Z0-9]|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)["']? *[:=]"""

MIN_RUN, MIN_RUN_NO_DIGIT = 16, 24
BEFORE, VALUE, AFTER = 24, 40, 16
WIDTH = BEFORE + VALUE + AFTER
#: The corpus's findings of a label weigh as much as so many made ones, however many they are; fewer weigh as themselves.
TRAIN_ROWS = 3000
#: Findings of each label that are made by rule.
MADE_ROWS = 5000
RECALL = 0.99
#: Views of a long finding that are in a row of the table of findings.
VIEWS = 1 << 12
#: Findings for each network that is trained; more are dealt over tasks, whose networks are averaged each epoch.
SHARD_ROWS = 1 << 14
EPOCHS, BATCH, RATE = 10, 128, 0.01
#: Part of the findings that calibrates, and the parts of an output that are told apart where those of shards are counted by it.
HELD, FINE = 0.3, 1024

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the patterns, by start, then by kind. Leftmost and without overlap within each kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_VALUE:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Key-like runs of a text as spans of code points."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(_RUN[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    long = np.flatnonzero(ends - starts >= MIN_RUN)
    spans = []
    for i in long:
        s, e = int(starts[i]), int(ends[i])
        if e - s >= MIN_RUN_NO_DIGIT or _DIGIT[data[s:e]].any():
            spans.append((s, e))
    if len(raw) != len(text):
        # From bytes to code points, in one walk.
        moved, at, chars = [], 0, 0
        for s, e in spans:
            chars += len(raw[at:s].decode("utf-8", "surrogatepass"))
            moved.append((chars, chars + e - s))
            at, chars = e, chars + e - s
        spans = moved
    return spans


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Views of a candidate, ``WIDTH`` bytes each: text before, the value, text after. A long value has several."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE)
    after = text[end : end + AFTER].ljust(AFTER)
    step = VALUE // 2
    last = max(0, end - start - VALUE)
    views = []
    for at in [*range(0, last, step), last]:
        value = text[start + at : min(end, start + at + VALUE)].ljust(VALUE)
        views.append((before + value + after).encode("ascii", "replace"))
    return views


# Characters as the network sees them: their own number, and what lies beyond as one.
def _codes(views: list[bytes]) -> np.ndarray:
    return np.minimum(np.frombuffer(b"".join(views), np.uint8).reshape(-1, WIDTH), 127)


@dataclass
class Network:
    """One convolution over character embeddings, highest value of each filter by part and its mean in the value, one output."""

    embedding: np.ndarray  # 128 x e
    filters: np.ndarray  # (width * e) x f
    bias: np.ndarray  # f
    out: np.ndarray  # 4 * f, then one constant
    scale: np.ndarray  # slope and shift that calibrate the output
    threshold: float
    #: Share of findings of label 1 that unseen findings at the threshold or above have, and of label 1 that is found.
    precision: float = float("nan")
    recall: float = float("nan")

    SPAN = 5

    @classmethod
    def fresh(cls, seed: int = 5, e: int = 8, f: int = 24) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (128, e)), rng.normal(0, 0.3, (cls.SPAN * e, f)), np.zeros(f),
            rng.normal(0, 0.1, 4 * f + 1), np.array([1.0, 0.0]), 0.5,
        )

    def _conv(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embedding[codes]
        n = WIDTH - self.SPAN + 1
        cols = np.concatenate([x[:, j : j + n] for j in range(self.SPAN)], axis=2)
        return cols, np.maximum(cols @ self.filters + self.bias, 0)

    @classmethod
    def _parts(cls) -> list[slice]:
        """Where filters end: before the value, in it, after it."""
        return [slice(0, BEFORE - 2), slice(BEFORE - 2, BEFORE + VALUE - 2), slice(BEFORE + VALUE - 2, WIDTH - cls.SPAN + 1)]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        out = []
        for i in range(0, len(codes), 512):
            _, h = self._conv(codes[i : i + 512])
            parts = self._parts()
            pooled = np.concatenate([*(h[:, p].max(1) for p in parts), h[:, parts[1]].mean(1)], axis=1)
            out.append(pooled @ self.out[:-1] + self.out[-1])
        return np.concatenate(out)

    def score(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(codes) + self.scale[1], -30, 30)))

    NAMES = ("embedding", "filters", "bias", "out")

    def weights(self) -> np.ndarray:
        """All that is trained, in one row."""
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    @classmethod
    def of_weights(cls, row: np.ndarray) -> Network:
        net, at = cls.fresh(), 0
        for k in cls.NAMES:
            x = getattr(net, k)
            x[...] = row[at : at + x.size].reshape(x.shape)
            at += x.size
        return net

    def epoch(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray, moments: list[Network], turn: int, step: int, seed: int = 6) -> None:
        """Adam on the log loss, once over all rows; ``moments`` are of the slopes and their squares, ``step`` the steps so far."""
        rate = RATE * (1 - turn / EPOCHS)
        rng = np.random.default_rng(seed)
        order = [rng.permutation(len(labels)) for _ in range(turn + 1)][-1]
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            grads = self._gradients(codes[pick], labels[pick], weight[pick])
            step += 1
            for k in self.NAMES:
                m, v = (getattr(x, k) for x in moments)
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                getattr(self, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        cols, h = self._conv(codes)
        f, rows = self.filters.shape[1], np.arange(len(codes))[:, None]
        tops, values = [], []
        for p in self._parts():
            top = h[:, p].argmax(1) + p.start
            tops.append(top)
            values.append(h[rows, top, np.arange(f)])
        middle = self._parts()[1]
        pooled = np.concatenate([*values, h[:, middle].mean(1)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out[:-1] + self.out[-1], -30, 30)))
        d = weight * (p - labels) / len(labels)
        grads = {"out": np.concatenate([pooled.T @ d, [d.sum()]])}
        dh = np.zeros_like(h)
        for i, top in enumerate(tops):
            dh[rows, top, np.arange(f)] += d[:, None] * self.out[i * f : (i + 1) * f] * (values[i] > 0)
        share = d[:, None] * self.out[3 * f : 4 * f] / (middle.stop - middle.start)
        dh[:, middle] += share[:, None, :] * (h[:, middle] > 0)
        flat = dh.reshape(-1, f)
        grads["filters"] = cols.reshape(-1, cols.shape[2]).T @ flat
        grads["bias"] = flat.sum(0)
        dcols = (flat @ self.filters.T).reshape(cols.shape)
        e, n = self.embedding.shape[1], cols.shape[1]
        dx = np.zeros((len(codes), WIDTH, e))
        for j in range(self.SPAN):
            dx[:, j : j + n] += dcols[:, :, j * e : (j + 1) * e]
        grads["embedding"] = np.zeros_like(self.embedding)
        np.add.at(grads["embedding"], codes, dx)
        return grads

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float, weight: np.ndarray | None = None) -> None:
        """Slope and shift by Newton steps on unseen findings; then the highest threshold with the wanted recall."""
        n = np.ones(len(labels)) if weight is None else weight
        z = self.logits(codes)
        # Targets a little inside 0 and 1, so that findings without an error have a finite slope.
        pos, neg = n[labels == 1].sum(), n[labels == 0].sum()
        target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.stack([z, np.ones_like(z)], 1)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            w -= np.linalg.solve(hess, x.T @ (n * (p - target)))
        self.scale = w
        found = self.score(codes)
        mine = np.flatnonzero(labels == 1)
        mine = mine[np.argsort(found[mine], kind="stable")]
        if len(mine):
            below = np.cumsum(n[mine])
            self.threshold = float(found[mine[np.searchsorted(below, (1 - recall) * below[-1], "right")]])
            taken = found >= self.threshold
            self.precision = float(n[taken & (labels == 1)].sum() / n[taken].sum())
            self.recall = float(n[taken & (labels == 1)].sum() / pos)


def _overlapping(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether any of the spans overlaps a stretch, by one search among their starts."""
    by_start = sorted((s, e) for _, s, e in spans)
    starts, furthest = [s for s, _ in by_start], list(accumulate((e for _, e in by_start), max))

    def overlaps(start: int, end: int) -> bool:
        n = bisect_left(starts, end)
        return n > 0 and furthest[n - 1] > start

    return overlaps


def key_of(text: str, start: int, end: int) -> bytes:
    """The only view of a candidate, or the first one of a long candidate and a digest of all."""
    if end - start <= VALUE:
        return windows(text, start, end)[0]
    whole = text[max(0, start - BEFORE) : end + AFTER].encode("utf-8", "surrogatepass")
    return windows(text, start, start + VALUE)[0] + hashlib.blake2b(whole, digest_size=16).digest()


def _found(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Text, span and label of each candidate: label 1 where a pattern confirms it."""
    maybe = pc.fill_null(pc.match_substring_regex(batch.column(0), _MAYBE), False).to_pylist()
    for value, flagged in zip(batch.column(0), maybe):
        text = value.as_py() or ""
        overlaps = _overlapping(base_spans(text) if flagged else [])
        for s, e in candidates(text):
            yield text, s, e, int(overlaps(s, e))


_FINDING = "key binary, label int, made int, no int, piece binary"
_FINDING_ARROW = pa.schema([("key", pa.binary()), ("label", pa.int32()), ("made", pa.int32()), ("no", pa.int32()), ("piece", pa.binary())])


def _pieces(text: str, start: int, end: int, views: int) -> Iterator[bytes]:
    """Stretches of a candidate with the text around it, whose views together are those of the candidate, ``views`` each."""
    before, after = text[max(0, start - BEFORE) : start].rjust(BEFORE), text[end : end + AFTER].ljust(AFTER)
    step, last = VALUE // 2, max(0, end - start - VALUE)
    for at in range(0, last + step, views * step):
        at = min(at, last)
        value = text[start + at : min(end, start + at + (views - 1) * step + VALUE)]
        yield (before + value + after).encode("ascii", "replace")


def _views(piece: bytes) -> np.ndarray:
    return _codes(windows(piece.decode("ascii"), BEFORE, len(piece) - AFTER))


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key, label, made, no, piece`` of each distinct candidate of all texts: label 1 where a pattern confirms it.

    A long candidate has a row per ``VIEWS`` views, numbered by ``no``; ``made`` is 0.
    """
    views = VIEWS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for text, s, e, label in _found(batch):
                key = key_of(text, s, e)
                for no, piece in enumerate(_pieces(text, s, e, views)):
                    rows.append({"key": key, "label": label, "made": 0, "no": no, "piece": piece})
                    if len(rows) == 4096 or len(piece) > VIEWS:
                        yield pa.RecordBatch.from_pylist(rows, _FINDING_ARROW)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _FINDING_ARROW)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, _FINDING).dropDuplicates(["key", "label", "made", "no"])


def made_findings(rows: int, seed: int = 7) -> tuple[list[list[bytes]], list[int]]:
    """Views and labels of the candidates in findings made by rule. A value may be several candidates, or none."""
    views, labels = [], []
    for text, start, end, label in labelled(rows, seed):
        for s, e in candidates(text):
            if s < end and start < e:
                views.append(windows(text, s, e))
                labels.append(label)
    return views, labels


def made_rows(rows: int, seed: int = 7) -> list[tuple]:
    """``findings`` of the candidates in findings made by rule, which are numbered by ``made``. A value may be several, or none."""
    found = []
    for text, start, end, label in labelled(rows, seed):
        for s, e in candidates(text):
            if s < end and start < e:
                n, key = len(found) + 1, bytearray(key_of(text, s, e))
                # None is so long that it would need more rows than one.
                found += [(key, label, n, no, bytearray(piece)) for no, piece in enumerate(_pieces(text, s, e, 1 << 20))]
    return found


def _bare(codes: np.ndarray) -> np.ndarray:
    """The values alone, with spaces for the text around them."""
    codes = codes.copy()
    codes[:, :BEFORE] = 32
    codes[:, BEFORE + VALUE :] = 32
    return codes


def _highest(batches: Iterator[pa.RecordBatch], net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the view of each finding that the network rates highest, whole and then bare; its label; whether it is made.

    The pieces of a finding follow each other; one of them is in memory at a time.
    """
    chosen: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    labels, made, last, best = [], [], None, [0.0, 0.0]
    for batch in batches:
        for row in batch.to_pylist():
            name, codes = (row["key"], row["label"], row["made"]), _views(row["piece"])
            alone = len(codes) == 1 and name != last and len(row["key"]) <= WIDTH
            if name != last:
                labels.append(row["label"])
                made.append(row["made"] > 0)
            for way, seen in enumerate((codes, _bare(codes))):
                if alone:
                    chosen[way].append(seen[0])
                    continue
                z = net.logits(seen)
                at = int(z.argmax())
                if name != last:
                    chosen[way].append(seen[at])
                elif z[at] > best[way]:
                    chosen[way][-1] = seen[at]
                best[way] = float(z[at]) if name != last else max(best[way], float(z[at]))
            last = name
    codes = np.array(chosen[0] + chosen[1], np.uint8).reshape(-1, WIDTH)
    return codes, np.array(labels, np.int64), np.array(made, bool)


def _trained(rows: DataFrame, net: Network, moments: list[Network], weight: np.ndarray, turn: int, step: int) -> tuple[Network, list[Network], int]:
    """The network, its moments and steps after each task has trained it once on its own rows: their mean by numbers of rows.

    ``weight`` is that of a finding by its label and whether it was made.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, labels, made = _highest(batches, net)
        if not len(labels):
            return
        own, own_moments = Network.of_weights(net.weights()), [Network.of_weights(m.weights()) for m in moments]
        # Findings are seen a second time without the text around them, so that the value itself counts too.
        own.epoch(codes, np.tile(labels, 2), np.tile(weight[labels, made.astype(int)], 2), own_moments, turn, step)
        n_steps = [-(-len(codes) // BATCH)]
        state = np.concatenate([x.weights() for x in (own, *own_moments)] + [n_steps]).astype(np.float64)
        yield from parts(state, np.full(len(state), float(len(labels))))

    before = np.concatenate([x.weights() for x in (net, *moments)] + [[0]]).astype(np.float64)
    state, _ = weighted_means(rows.mapInArrow(learn, PARTS), before)
    own, *own_moments = (Network.of_weights(x) for x in np.split(state[:-1], 3))
    return own, own_moments, step + max(1, round(state[-1]))


def _held(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` in ``shards`` partitions, the pieces of a finding one after the other, and whether it is held from training."""
    order = [F.col("made") == 0, F.col("made"), F.length("key") > WIDTH, F.col("label"), F.xxhash64("key"), F.col("key"), F.col("no")]

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, last, now = np.random.default_rng(3 + TaskContext.get().partitionId()), None, False
        for batch in batches:
            held = []
            for name in zip(*(batch.column(i).to_pylist() for i in range(3))):
                now = now if name == last else bool(rng.random() < HELD)
                held.append(now)
                last = name
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.bool_())], names=[*_FINDING_ARROW.names, "held"])

    dealt = rows.select(*_FINDING_ARROW.names).repartition(shards, "key", "label", "made").sortWithinPartitions(*order)
    return dealt.mapInArrow(hold, f"{_FINDING}, held boolean")


def _rated(rows: DataFrame, net: Network, fine: int | None) -> DataFrame:
    """``label, made, z, view, rows``: how many findings have each output, in parts of ``fine`` if given, and a view that has it."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                codes = _views(row["piece"])
                z = net.logits(codes)
                at = int(z.argmax())
                columns = [pa.array([float(z[at])]), pa.array([codes[at].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:3], *columns], names=["key", "label", "made", "z", "view"])

    rated = rows.mapInArrow(rate, "key binary, label int, made int, z double, view binary")
    best = rated.groupBy("key", "label", "made").agg(F.max(F.struct("z", "view")).alias("best"))
    z = F.round(F.greatest(F.least("best.z", F.lit(60)), F.lit(-60)) * fine) if fine else F.col("best.z")
    counted = best.groupBy("label", (F.col("made") > 0).alias("made"), z.alias("z"))
    return counted.agg(F.max("best.view").alias("view"), F.count(F.lit(1)).alias("rows")).orderBy("label", "made", "z")


def train(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS, recall: float = RECALL, made: int = MADE_ROWS) -> Network | None:
    """A network from ``made`` findings of each label made by rule and all distinct ones of the corpus, in all their views.

    The corpus's findings of a label weigh together at most as much as ``rows`` made ones. Each epoch, tasks train the same
    network on their shards of the findings and the results are averaged. Slope, shift and threshold come from all findings
    that training has not seen, counted by output. The driver holds one network and those counts. No rows at all give no network.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return None
    own = written(findings(docs, text_col), "secret-findings")
    every = own.unionByName(spark.createDataFrame(made_rows(made), _FINDING))
    shards = max(1, own.where("no = 0").count() // SHARD_ROWS)
    table = written(_held(every, shards), "secret-table")
    found = {(r["held"], r["label"], r["m"]): r["count"] for r in table.where("no = 0").groupBy("held", "label", (F.col("made") > 0).alias("m")).count().collect()}

    def weights(part: bool) -> np.ndarray:
        """Weight of a finding by label and whether it was made: all corpus findings together at most as much as ``rows``."""
        corpus = [sum(found.get((h, label, False), 0) for h in (False, True)) for label in (0, 1)]
        each = np.array([[min(1.0, rows / max(1, n)), 1.0] for n in corpus])
        sums = np.array([[found.get((part, label, m), 0) for m in (False, True)] for label in (0, 1)])
        each_label = np.maximum((each * sums).sum(1, keepdims=True), 1e-9)
        return each if part else each * 0.5 / each_label * sums.sum()

    seen, weight = table.where("NOT held").drop("held"), weights(False)
    net, step = Network.fresh(), 0
    moments = [Network.of_weights(np.zeros_like(net.weights())) for _ in range(2)]
    for turn in range(EPOCHS):
        net, moments, step = _trained(seen.coalesce(shards), net, moments, weight, turn, step)
    unseen = _rated(table.where("held").drop("held"), net, FINE if shards > 1 else None).collect()
    y, many = (np.array([r[c] for r in unseen], np.int64) for c in ("label", "rows"))
    each = weights(True)[y, [int(r["made"]) for r in unseen]]
    net.calibrate(_codes([bytes(r["view"]) for r in unseen]), y, recall, many * each)
    return net


def spans_of(text: str, flagged: bool, net: Network | None) -> tuple[list, list, list]:
    """Findings of the patterns; those with the network's beside them, by start; and the network's scores of all of these.

    A pattern's finding has the highest score of the candidates that it overlaps, or None where it overlaps none.
    """
    base = base_spans(text) if flagged else []
    runs = candidates(text) if net else []
    if not runs:
        return base, base, [None] * len(base)
    views, owner = [], []
    for i, (s, e) in enumerate(runs):
        own = windows(text, s, e)
        views += own
        owner += [i] * len(own)
    best = np.zeros(len(runs))
    np.maximum.at(best, owner, net.score(_codes(views)))
    overlaps = _overlapping(base)
    scored = []
    starts, ends = [s for s, _ in runs], [e for _, e in runs]
    for k, s, e in base:
        own = best[bisect_right(ends, s) : bisect_left(starts, e)]
        scored.append((k, s, e, float(own.max()) if len(own) else None))
    scored += [(ADDED, *runs[i], float(best[i])) for i in np.flatnonzero(best >= net.threshold) if not overlaps(*runs[i])]
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    scored.sort(key=lambda x: (x[1], order[x[0]]))
    return base, [x[:3] for x in scored], [x[3] for x in scored]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_spans, spans, scores`` for each row of ``docs``, over its whole text.

    ``base_spans`` and ``spans`` are ``kind:start:end`` joined by commas, by start and kind. Offsets are code points, the
    end exclusive. A null text is empty and has no findings. Rows that repeat an id, or have none, each have their row; no
    rows give no rows. ``scores`` has the network's score of each of ``spans``, null for a value too short to be a
    candidate. Without a network only the patterns find.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = pc.fill_null(pc.match_substring_regex(batch.column(1), _MAYBE), False).to_pylist()
            counts, base_text, all_text, all_scores = [], [], [], []
            for value, flagged in zip(batch.column(1), maybe):
                base, every, scores = spans_of(value.as_py() or "", flagged, net)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                base_text.append(joined(base))
                all_text.append(joined(every))
                all_scores.append(scores)
            columns = [pa.array(c, pa.int64()) for c in np.array(counts, np.int64).reshape(-1, 3).T]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *columns, pa.array(base_text, pa.string()), pa.array(all_text, pa.string()),
                    pa.array(all_scores, pa.list_(pa.float64())),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "scores"],
            )

    schema = f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, scores array<double>"
    bound_batches(docs.sparkSession)
    return narrow.mapInArrow(scan, schema)
