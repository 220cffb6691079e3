"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings. Filters of one, two and three words run
over the whole text, and the highest value of each filter goes into one output. Scores are calibrated by the language that
the text's own function words show, so that one threshold serves all languages.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscore.config import LANGUAGE_PROFILES
from lexiscore.llm.averages import PARTS, parts, weighted_means
from lexiscore.llm.words import U64, bound_batches, span_hashes, texts_of, word_spans
from lexiscore.operators.lexicons import drop_unknown
from lexiscore.session import written

THRESHOLD = 0.7
#: At most 2^16, as bucket numbers travel as 16 bits.
BUCKETS = 1 << 15
#: Bytes of the beginnings that have embeddings of their own.
BEGINNINGS = (4, 5, 6, 7)
DIMS, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
#: Labelled rows for each network that is trained; more rows are dealt over tasks, whose networks are averaged each round.
SHARD_ROWS = 1 << 14
#: Texts of training in all, and the least rounds over all rows where there are several shards.
STEPS, ROUNDS = 30_000, 3
#: Part of the rows that sets thresholds and calibration, and rows of each label that a language needs for its own.
CALIBRATION, LANGUAGE_ROWS = 0.35, 12
#: Outputs are told apart to one part in so many where those of several shards are counted by them.
FINE = 4096
#: Part of a text's words that training leaves out at most.
DROPPED = 0.6
#: Words of a text that are in memory as vectors at a time.
STRIDE = 1 << 15


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word (one column for the word, one per beginning), and the hashes of the words."""
    data, starts, ends, _ = word_spans([text])
    words = span_hashes(data, starts, ends)
    columns = [words]
    for n in BEGINNINGS:
        columns.append(span_hashes(data, starts, np.minimum(starts + n, ends)) + U64(n))
    return (np.stack(columns, 1) & U64(BUCKETS - 1)).astype(np.uint16), words


_LANGUAGES = sorted(LANGUAGE_PROFILES)
_FUNCTION_WORDS, _WHOSE = np.unique(
    np.concatenate([features(" ".join(LANGUAGE_PROFILES[lang]))[1] for lang in _LANGUAGES]), return_inverse=True
)
_VOTES = np.zeros((len(_FUNCTION_WORDS), len(_LANGUAGES)), np.int64)
_VOTES[_WHOSE, np.repeat(np.arange(len(_LANGUAGES)), [len(LANGUAGE_PROFILES[lang]) for lang in _LANGUAGES])] = 1


def language_of(words: np.ndarray) -> str:
    """The language whose function words the text has most of, of equals the alphabetically last; "" where it has none."""
    at = np.minimum(np.searchsorted(_FUNCTION_WORDS, words), len(_FUNCTION_WORDS) - 1)
    counts = np.bincount(at[_FUNCTION_WORDS[at] == words], minlength=len(_FUNCTION_WORDS)) @ _VOTES
    best = len(counts) - 1 - int(counts[::-1].argmax())
    return _LANGUAGES[best] if counts[best] else ""


class Stored:
    """Bucket numbers of a text in a file of the worker, by the offset and length of each part; slices read what they ask for."""

    def __init__(self, file: int, parts: list[tuple[int, int]]) -> None:
        self.file, self.parts = file, parts
        self.starts = np.concatenate([[0], np.cumsum([n for _, n in parts])])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def __getitem__(self, rows: slice) -> np.ndarray:
        low, high, _ = rows.indices(len(self))
        columns, found = 1 + len(BEGINNINGS), []
        for k in range(int(np.searchsorted(self.starts, low, "right")) - 1, len(self.parts)):
            start, (offset, n) = int(self.starts[k]), self.parts[k]
            a, b = max(low - start, 0), min(high - start, n)
            if start >= high:
                break
            found.append(os.pread(self.file, (b - a) * columns * 2, offset + a * columns * 2))
        return np.frombuffer(b"".join(found), np.uint16).reshape(-1, columns)


@dataclass
class TextNetwork:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIMS, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # widths * FILTERS, then one constant
    slope: float = 1.0
    edges: dict[str, float] = field(default_factory=dict)  # output at which the score is THRESHOLD, by language; "" for the rest

    @classmethod
    def fresh(cls, seed: int = 11) -> TextNetwork:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32),
            [rng.normal(0, 0.4, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(len(WIDTHS) * FILTERS, np.float32),
            np.concatenate([rng.uniform(0, 0.5, len(WIDTHS) * FILTERS), [0]]).astype(np.float32),
        )

    @classmethod
    def untrained(cls) -> TextNetwork:
        """Squares of past gradients before the first one, in the shapes of a network."""
        net = cls.fresh()
        for x in (net.embedding, *net.filters, net.bias, net.out):
            x[...] = 1e-3
        return net

    def _vectors(self, buckets: np.ndarray) -> np.ndarray:
        """Vectors of the words, then zeros on which the last filters end."""
        x = np.zeros((len(buckets) + max(WIDTHS) - 1, DIMS), np.float32)
        for j in range(buckets.shape[1]):
            x[: len(buckets)] += self.embedding[buckets[:, j]]
        return x

    def _filtered(self, x: np.ndarray) -> np.ndarray:
        """Value of every filter where it begins at each word, from the words' vectors."""
        n = len(x) - max(WIDTHS) + 1
        return np.concatenate([sum(x[j : n + j] @ f[j] for j in range(len(f))) for f in self.filters], axis=1)

    def pooled(self, buckets: np.ndarray | Stored) -> np.ndarray:
        best = np.full(len(self.bias), -np.inf, np.float32)
        overlap = max(WIDTHS) - 1
        for at in range(0, len(buckets), STRIDE):
            part = buckets[at : at + STRIDE + overlap]
            values = self._filtered(self._vectors(part))
            # Filters that run past this part begin in the next one again, with the words that follow.
            values = values[: STRIDE if at + STRIDE < len(buckets) else None]
            best = np.maximum(best, values.max(0))
        return np.maximum(np.where(np.isfinite(best), best, 0) + self.bias, 0)

    def output(self, buckets: np.ndarray | Stored) -> float:
        return float(self.pooled(buckets) @ self.out[:-1] + self.out[-1])

    def _tops(self, buckets: np.ndarray | Stored, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Highest value of each filter over a whole text less words left out at random, and the words from its place on.

        Those are their vectors, bucket numbers and which of them there are: filters x widest filter. As in ``pooled``, only
        ``STRIDE`` words are in memory at a time.
        """
        wide, n = max(WIDTHS), len(self.bias)
        best = np.full(n, -np.inf, np.float32)
        vectors = np.zeros((n, wide, DIMS), np.float32)
        words, inside = np.zeros((n, wide, 1 + len(BEGINNINGS)), np.uint16), np.zeros((n, wide), bool)
        left, dropped = words[0, :0], None
        for at in range(0, max(1, len(buckets)), STRIDE):
            part = buckets[at : at + STRIDE]
            draws = rng.random(len(part))
            if dropped is None:
                dropped = rng.random() * DROPPED
            part = np.concatenate([left, part[draws >= dropped]])
            x = self._vectors(part)
            values = self._filtered(x)
            left = part[:0]
            if at + STRIDE < len(buckets):
                # Filters that run past this part begin in the next one again, with the words that follow.
                ready = max(0, len(part) - wide + 1)
                values, left = values[:ready], part[ready:]
            if not len(values):
                continue
            top = values.argmax(0)
            found = values[top, np.arange(n)]
            new = np.flatnonzero(found > best)
            best[new] = found[new]
            places = top[new][:, None] + np.arange(wide)
            vectors[new], inside[new] = x[places], places < len(part)
            words[new] = part[np.minimum(places, len(part) - 1)]
        return best, vectors, words, inside

    def weights(self) -> np.ndarray:
        """All that is trained, in one row."""
        return np.concatenate([x.ravel() for x in (self.embedding, *self.filters, self.bias, self.out)])

    @classmethod
    def of_weights(cls, row: np.ndarray) -> TextNetwork:
        net, at = cls.fresh(), 0
        for x in (net.embedding, *net.filters, net.bias, net.out):
            x[...] = row[at : at + x.size].reshape(x.shape)
            at += x.size
        return net

    def fit(
        self,
        texts: Sequence[np.ndarray | Stored],
        labels: np.ndarray,
        steps: int = STEPS,
        rate: float = 0.05,
        seed: int = 12,
        counts: Sequence[int] | None = None,
        past: TextNetwork | None = None,
    ) -> None:
        """One text at a time, steps scaled by past gradients (Adagrad); both labels weigh the same.

        Each time a part of the words is left out, so that the network cannot rest on a word that a single text has.
        ``counts`` are the rows of label 0 and 1, where these texts are a part of them; ``past`` has the squares of past
        gradients, to which those of this call are added.
        """
        rng = np.random.default_rng(seed)
        counts = [(labels == 0).sum(), (labels == 1).sum()] if counts is None else counts
        weight = np.array([0.5 / max(1, counts[0]), 0.5 / max(1, counts[1])]) * sum(counts)
        past = past or TextNetwork.untrained()
        past_e, past_f, past_b, past_o = past.embedding, past.filters, past.bias, past.out
        n_filters = FILTERS
        for _ in range(max(1, round(steps / len(labels)))):
            for i in rng.permutation(len(labels)):
                best, vectors, words, inside = self._tops(texts[i], rng)
                if not np.isfinite(best).any():
                    continue
                pooled = np.maximum(best + self.bias, 0)
                z = float(pooled @ self.out[:-1] + self.out[-1])
                d = float(weight[labels[i]]) * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
                if abs(d) < 1e-3:
                    continue
                grad_o = np.append(d * pooled, d).astype(np.float32)
                grad_p = (d * self.out[:-1] * (pooled > 0)).astype(np.float32)
                met, there, slopes = [], [], []
                for k, f in enumerate(self.filters):
                    own = slice(k * n_filters, (k + 1) * n_filters)
                    g = grad_p[own]
                    for j in range(len(f)):
                        met.append(words[own, j])
                        there.append(inside[own, j])
                        slopes.append((f[j] * g).T)
                        grad_f = vectors[own, j].T * g
                        past_f[k][j] += grad_f**2
                        f[j] -= rate * grad_f / np.sqrt(past_f[k][j])
                found, slope = np.concatenate(there), np.concatenate(slopes)[np.concatenate(there)]
                buckets = np.concatenate(met)[found]
                # A word's slope goes to its own embedding and to those of its beginnings, each met once.
                rows, owner = np.unique(buckets, return_inverse=True)
                grad_e = np.zeros((len(rows), DIMS), np.float32)
                np.add.at(grad_e, owner.reshape(-1), np.repeat(slope, buckets.shape[1], axis=0))
                past_e[rows] += grad_e**2
                self.embedding[rows] -= rate * grad_e / np.sqrt(past_e[rows])
                past_b += grad_p**2
                self.bias -= rate * grad_p / np.sqrt(past_b)
                past_o += grad_o**2
                self.out -= rate * grad_o / np.sqrt(past_o)
                np.maximum(self.out[:-1], 0, out=self.out[:-1])

    def calibrate(self, outputs: np.ndarray, labels: np.ndarray, languages: list[str], counts: np.ndarray | None = None) -> None:
        """The output that parts the labels best gets the score ``THRESHOLD``, by language where it has rows enough.

        ``counts`` says how many rows have each output, label and language; by default one.
        """
        counts = np.ones(len(labels), np.int64) if counts is None else counts
        self.slope = _slope(outputs, labels, counts)
        self.edges = {"": _edge(outputs, labels, counts)}
        for lang in set(languages) - {""}:
            mine = np.array([x == lang for x in languages])
            if min(counts[mine & (labels == 0)].sum(), counts[mine & (labels == 1)].sum()) >= LANGUAGE_ROWS:
                self.edges[lang] = _edge(outputs[mine], labels[mine], counts[mine])

    def score(self, text: str) -> float:
        buckets, words = features(text)
        edge = self.edges.get(language_of(words), self.edges[""])
        z = self.slope * (self.output(buckets) - edge) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _edge(outputs: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """Cut with the best F1; of equally good ones the middle of the widest gap."""
    order = np.argsort(outputs, kind="stable")
    z, n = outputs[order], counts[order]
    y = labels[order] * n
    if not y.any() or y.sum() == n.sum():
        return float(z[-1] + 1) if not y.any() else float(z[0] - 1)
    hits = y.sum() - np.concatenate([[0], np.cumsum(y)])
    taken = n.sum() - np.concatenate([[0], np.cumsum(n)])
    f1 = 2 * hits / (taken + y.sum())
    low = np.concatenate([[z[0] - 1], z])
    high = np.concatenate([z, [z[-1] + 1]])
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    best = good[np.argmax(high[good] - low[good])]
    return float((low[best] + high[best]) / 2)


def _slope(outputs: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """Slope of a logistic fit with shrunken targets, so that it stays finite where the labels part cleanly."""
    pos, neg = counts[labels == 1].sum(), counts[labels == 0].sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.stack([outputs, np.ones_like(outputs)], 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (counts * (p - target)))
    return float(np.clip(w[0], 0.1, 2))


def learnable(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[DataFrame, int]:
    """``_id, _label, _text, _held`` of every labelled document for which ``may_learn`` holds, and how many shards it is in.

    Labels that are null, or neither 0 nor 1, are left out; an id with both is toxic. Copies of an id would count more than
    once; one text each. Rows lie in shards by the hash of their id, in an order that does not depend on the run.
    """
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.where(may_learn & label.isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
    known = written(known.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(label).alias("_label")), "toxicity-labels")
    shards = max(1, known.count() // SHARD_ROWS)
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    # A Bloom filter holds most other texts back, so that labelled ones alone are shuffled, once, to their shards.
    maybe = drop_unknown(narrow.withColumn("term", F.col("_id").cast("string")), known.select(F.col("_id").cast("string").alias("term")))
    joined = maybe.select("_id", "_text").repartition(shards, "_id").join(known.repartition(shards, "_id").hint("merge"), "_id")
    dealt = joined.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).sortWithinPartitions(F.xxhash64("_id"), "_id")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(4 + TaskContext.get().partitionId())
        for batch in batches:
            held = pa.array(rng.random(batch.num_rows) < CALIBRATION)
            yield pa.RecordBatch.from_arrays([*batch.columns, held], names=["_id", "_label", "_text", "_held"])

    id_type = narrow.schema["_id"].dataType.simpleString()
    return written(dealt.mapInArrow(hold, f"_id {id_type}, _label int, _text string, _held boolean"), "toxicity-rows"), shards


def _trained(rows: DataFrame, net: TextNetwork, past: TextNetwork, counts: Sequence[int], steps: int, turn: int) -> tuple[TextNetwork, TextNetwork]:
    """The network after each task has trained it on its own rows, about ``steps`` texts over all; averages by what moved it.

    A word that one task alone has met counts as that task learnt it. Texts are read whole, from an unnamed file of the worker,
    ``STRIDE`` words and at most two shards of rows at a time.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, n_chunks, met = TextNetwork.of_weights(net.weights()), TextNetwork.of_weights(past.weights()), 0, False
        with tempfile.TemporaryFile(buffering=0) as file:
            texts, y, size = [], [], 0

            def chunk() -> None:
                nonlocal size, n_chunks
                part = max(1, round(steps * len(y) / sum(counts)))
                marks = np.array(y, np.int64)
                own.fit([Stored(file.fileno(), p) for p in texts], marks, part, seed=12 + 1000 * turn + n_chunks, counts=counts, past=sums)
                texts.clear(), y.clear(), file.seek(0), file.truncate()
                size, n_chunks = 0, n_chunks + 1

            for batch in batches:
                for text, label in zip(texts_of(batch, "_text"), batch.column(batch.schema.get_field_index("_label")).to_pylist()):
                    data, places = features(text)[0], []
                    for at in range(0, max(1, len(data)), STRIDE):
                        part = data[at : at + STRIDE]
                        raw = part.tobytes()
                        places.append((size, len(part)))
                        size += len(raw)
                        while raw:
                            raw = raw[file.write(raw) :]
                    texts.append(places)
                    y.append(label)
                    met = True
                    if len(y) == 2 * SHARD_ROWS:
                        chunk()
            if y:
                chunk()
        if met:
            yield from parts(own.weights(), sums.weights() - past.weights())

    means, moved = weighted_means(rows.mapInArrow(learn, PARTS), net.weights())
    return TextNetwork.of_weights(means), TextNetwork.of_weights(past.weights() + moved)


def _outputs(rows: DataFrame, net: TextNetwork, fine: int | None) -> DataFrame:
    """``lang, label, output, rows``: how many rows have each output, in parts of ``fine`` if given."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, languages = [], []
            for text in texts_of(batch, "_text"):
                buckets, words = features(text)
                output = net.output(buckets)
                z.append(round(min(max(output, -30), 30) * fine) / fine if fine else output)
                languages.append(language_of(words))
            own = batch.column(batch.schema.get_field_index("_label"))
            yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), own, pa.array(z, pa.float64())], names=["lang", "label", "output"])

    judged = rows.mapInArrow(judge, "lang string, label int, output double")
    return judged.groupBy("lang", "label", "output").agg(F.count(F.lit(1)).alias("rows")).orderBy("lang", "label", "output")


def train(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> TextNetwork | None:
    """A network from all labelled documents for which ``may_learn`` holds (see ``learnable``); None without both labels.

    ``may_learn`` is a condition on the id column of ``labels``. Each round, tasks train the same network on their shards and
    the results are averaged; up to two shards' rows are one shard and one round. Thresholds and calibration come from all
    rows that training has not seen, counted by output. The driver holds one network and those counts.
    """
    bound_batches(docs.sparkSession)
    table, shards = learnable(docs, labels, may_learn, id_col, text_col, label_col)
    found = {(r["_held"], r["_label"]): r["count"] for r in table.groupBy("_held", "_label").count().collect()}
    held, seen = table.where("_held"), table.where("NOT _held")
    counts = [found.get((False, label), 0) for label in (0, 1)]
    if len({label for _, label in found}) < 2:
        return None
    if len(found) < 4:
        held = seen = table
        counts = [sum(n for (_, label), n in found.items() if label == mark) for mark in (0, 1)]
    rounds = 1 if shards == 1 else max(ROUNDS, round(STEPS / sum(counts)))
    net, past = TextNetwork.fresh(), TextNetwork.untrained()
    for turn in range(rounds):
        net, past = _trained(seen.coalesce(shards), net, past, counts, STEPS if rounds == 1 else sum(counts), turn)
    rows = _outputs(held, net, FINE if shards > 1 else None).collect()
    marks, many = (np.array([r[c] for r in rows], np.int64) for c in ("label", "rows"))
    net.calibrate(np.array([r["output"] for r in rows]), marks, [r["lang"] for r in rows], many)
    return net


def score(docs: DataFrame, net: TextNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row of ``docs`` from its whole text alone: 0 to 1, ``THRESHOLD`` and above means toxic.

    A null text is empty; empty texts have the score of no words at all. Rows that repeat an id, or have none, each have
    their row; no rows give no rows. Without a network (no labels to learn from) every score is 0. The network is a constant
    of about 2 MB, whatever the data.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.score(t) if net else 0.0 for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    bound_batches(docs.sparkSession)
    return narrow.mapInArrow(judge, f"doc_id {id_type}, score double")


def keep_clean(docs: DataFrame, net: TextNetwork | None, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, without the rows whose score is ``THRESHOLD`` or more. No shuffle."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([net is None or net.score(t) < THRESHOLD for t in texts_of(batch, text_col)], pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(kept, docs.schema)
