"""SentencePiece encoding and decoding of texts of any length by a max-plus parallel scan.

A segmentation is a path through states (end of a piece, piece); the weight of a step from one piece to the next is 0 where
merging the two texts by the vocabulary's ranks gives back just these two pieces, and minus infinity elsewhere. Exactly one
path of weight 0 leads through a text, and its pieces are those of byte-pair merging. So encoding is a product of
matrices over (max, +), which is associative, and giant documents can be cut anywhere:

1. each chunk yields its transfer matrix, from pieces that reach into it to pieces that reach out of it, in any order;
2. the matrices of a document are combined, in groups of chunks and then groups of groups, into the piece on each boundary;
3. each chunk is traced back on its own between the pieces on its two boundaries.

No piece crosses from a character to a space mark, so all paths meet there. Between two such places a matrix is a single 0,
and the pieces there are those of a word, which are kept for the next time it comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.token_counts import BATCH_CHARS, parts
from lexiscore.llm.words import bound_batches, texts_of
from lexiscore.session import written

MARK = "▁"
#: Texts of more characters are giant: they are cut into chunks of so many.
CHUNK = 1 << 14
#: Words whose pieces a worker remembers in each of two tables, and the length up to which it does: about 60 MB together.
REMEMBERED, SHORT = 1 << 17, 64
#: Chunks whose matrices are combined at a time.
GROUP = 64

#: A state on a boundary: characters by which its piece reaches beyond, and the piece. START stands before a text.
State = tuple[int, str]
START: State = (0, "")


def rows_of(column: pa.ListArray) -> list[np.ndarray]:
    """Rows of whole numbers, each a stretch of the column's memory; its own way makes an object of each number."""
    offsets = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), offsets[1:-1] - offsets[0])[: len(column)]


class Vocabulary:
    """Pieces of a SentencePiece model file with byte-pair merges and byte fallback."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            if plain:
                self.ids[piece] = i
            elif model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.fits = lru_cache(1 << 18)(self._fits)
        self.word_ids: dict[str, bytes] = {}
        self.older_ids: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the pair whose union ranks best merges first, of equals the leftmost."""
        pieces = list(text)
        while True:
            ranked = [(self.ids.get(a + b), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            scored = [(-self.model.get_score(r), i) for r, i in ranked if r is not None]
            if not scored:
                return pieces
            _, i = min(scored)
            pieces[i : i + 2] = ["".join(pieces[i : i + 2])]

    def _fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``: a step of weight 0."""
        if not left:
            return self.merged(right) == [right]
        if (right[0] == MARK and left[-1] != MARK) or len(left) > self.longest:
            return self.merged(right) == [right]
        return self.merged(left + right) == [left, right]

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that stand at a place; a character that the vocabulary lacks is a piece of its own."""
        found = [p for n in range(1, self.longest + 1) if (p := text[at : at + n]) in self.ids and len(p) == n]
        return found or [text[at : at + 1]]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def _learn(self, words: list[str]) -> list[str]:
        """Take in the ids of these words, as 32-bit numbers end to end; those of them that are too long to keep."""
        if not words:
            return []
        learnt = self.model.encode(words, num_threads=1)
        ends = list(accumulate(map(len, learnt)))
        packed = np.fromiter(chain.from_iterable(learnt), np.int32, ends[-1]).tobytes()
        self.word_ids.update((word, packed[4 * low : 4 * high]) for word, low, high in zip(words, [0, *ends], ends))
        if not self.word_ids.get("", b"-"):
            self.word_ids[""] = np.array([self.ids[MARK]] if MARK in self.ids else self.ids_of([MARK]), np.int32).tobytes()
        return [word for word in words if len(word) > SHORT]

    def encode_rows(self, texts: list[str]) -> pa.ListArray:
        """Pieces of whole texts of ordinary length, word by word, as lists of 32-bit numbers; new words go to the library in batches.

        Words that still come stay when the memory is full: what was not asked for since it last was full goes.
        """
        cut = [parts(t) for t in texts]
        wanted = set().union(*cut)
        new = wanted.difference(self.word_ids)
        if len(self.word_ids) + len(new) > REMEMBERED:
            self.older_ids, self.word_ids, new = self.word_ids, {}, wanted
        self.word_ids.update((word, ids) for word in new if (ids := self.older_ids.get(word)) is not None)
        long = self._learn(list(new.difference(self.older_ids)))
        rows = [b"".join(map(self.word_ids.__getitem__, words)) for words in cut]
        for word in long:
            del self.word_ids[word]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(row) // 4 for row in rows], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    def encode_words(self, texts: list[str]) -> list[list[int]]:
        """``encode_rows`` as lists."""
        return [row.tolist() for row in rows_of(self.encode_rows(texts))]

    def decode(self, rows: list[list[int]] | list[np.ndarray]) -> list[str]:
        return self.model.decode(rows, num_threads=1) if rows else []


@lru_cache(1)
def vocabulary(model_file: str) -> Vocabulary:
    """The one of this worker, which tasks hand on."""
    return Vocabulary(model_file)


def marked(text: str) -> str:
    """The text as pieces spell it: a mark for each space and one before the text, nothing for an empty text."""
    return MARK + text.replace(" ", MARK) if text else ""


def _resets(text: str, low: int, high: int) -> tuple[int, int] | None:
    """First and last place in ``low .. high`` where a mark follows another character: all paths meet there."""
    first = next((i for i in range(max(low, 1), high + 1) if text[i : i + 1] == MARK and text[i - 1] != MARK), None)
    if first is None:
        return None
    last = next(i for i in range(high, first - 1, -1) if text[i : i + 1] == MARK and text[i - 1] != MARK)
    return first, last


def entries(voc: Vocabulary, text: str, boundary: int) -> list[State]:
    """Pieces that may lie on a boundary: they begin before it and end at it or beyond."""
    out = []
    for at in range(max(0, boundary - voc.longest), boundary):
        for piece in voc.starting(text, at):
            if at + len(piece) >= boundary and voc.fits("", piece):
                out.append((at + len(piece) - boundary, piece))
    return out


def forward(voc: Vocabulary, text: str, begin: State, low: int, high: int) -> tuple[dict[State, list], dict]:
    """All paths of weight 0 from a state at ``low`` to states at ``high``; for each node the node before it.

    A path is lost as soon as no step from it has weight 0, which is minus infinity times anything.
    """
    nodes: dict[int, dict[str, tuple]] = {low + begin[0]: {begin[1]: ()}}
    outs = {}
    for at in range(low, high + 1):
        for last in list(nodes.get(at, ())):
            if at >= high:
                outs[(at - high, last)] = (at, last)
                continue
            for piece in voc.starting(text, at):
                if voc.fits(last, piece):
                    nodes.setdefault(at + len(piece), {}).setdefault(piece, (at, last))
    for at in range(high + 1, high + voc.longest + 1):
        for last in nodes.get(at, ()):
            outs[(at - high, last)] = (at, last)
    return outs, nodes


def traced(nodes: dict, end: tuple, start_at: int) -> list[str]:
    pieces = []
    at, piece = end
    while at > start_at:
        pieces.append(piece)
        at, piece = nodes[at][piece]
    return pieces[::-1]


def relay(voc: Vocabulary, text: str, begins: list[State], low: int, high: int, step: int = 64) -> dict[State, list[State]]:
    """Transfer matrix of a stretch without a meeting place: a few characters at a time, from the states still reached.

    Paths from different states soon run together, so each step follows one or two.
    """
    reached = {s: [s] for s in begins}
    for at in range(low, high, step):
        through = min(at + step, high)
        states = set().union(*reached.values())
        outs = {s: set(forward(voc, text, s, at, through)[0]) for s in states}
        reached = {s: out for s, mids in reached.items() if (out := sorted(set().union(*(outs[m] for m in mids))))}
    return reached


def _ends_well(voc: Vocabulary, text: str, state: State, low: int, high: int) -> bool:
    """Whether some path leads from a state at ``low`` to ``high``, where all paths meet."""
    outs, _ = forward(voc, text, state, low, high)
    return any(extra == 0 for extra, _ in outs)


def transfer(voc: Vocabulary, text: str, low: int, high: int) -> dict[State, list[State]]:
    """Transfer matrix of ``text[low:high]``: the entries of weight 0, by state on the left boundary.

    ``text`` holds some characters more on both sides. At the begin of a document the only state is START.
    """
    begins = [START] if low == 0 else entries(voc, text, low)
    meet = _resets(text, low, high)
    if meet is None:
        return relay(voc, text, begins, low, high)
    first, last = meet
    # A piece that ends where all paths meet is known by its own; what comes behind begins as if a text did.
    into = [s for s in begins if low + s[0] <= first and _ends_well(voc, text, s, low, first)]
    if last == high:
        # The boundary itself is a meeting place: any piece that truly ends there; traced from the meeting before it.
        before = _resets(text, low, high - 1)
        if before is None:
            return relay(voc, text, begins, low, high)
        last = before[1]
    outs = sorted(forward(voc, text, START, last, high)[0])
    return {s: outs for s in into}


def combine(a: dict[State, list[State]], b: dict[State, list[State]]) -> dict[State, list[State]]:
    """Product over (max, +) of two matrices with entries 0 and minus infinity: associative."""
    return {s: out for s, mids in a.items() if (out := sorted({t for m in mids for t in b.get(m, ())}))}


def pieces_between(voc: Vocabulary, text: str, low: int, high: int, begin: State, end: State) -> list[int]:
    """Ids of the pieces that begin in ``text[low:high]``, between the pieces on its boundaries; whole words by the library."""
    begin_at = low + begin[0]
    meet = _resets(text, begin_at, high - 1) if begin_at < high else None
    if meet is None or meet[0] == meet[1]:
        outs, nodes = forward(voc, text, begin, low, high)
        return voc.ids_of(traced(nodes, outs[end], begin_at))
    first, last = meet
    head_outs, head_nodes = forward(voc, text, begin, low, first)
    head_end = next(node for state, node in head_outs.items() if state[0] == 0)
    tail_outs, tail_nodes = forward(voc, text, START, last, high)
    # The library sets a mark before what it reads, so the first mark of the words is left to it.
    middle = voc.encode_words([text[first + 1 : last].replace(MARK, " ")])[0]
    head = traced(head_nodes, head_end, begin_at) if first > begin_at else []
    return voc.ids_of(head) + middle + voc.ids_of(traced(tail_nodes, tail_outs[end], last))


# Matrices and states travel between stages as rows of Arrow types.
_STATE = pa.struct([("over", pa.int32()), ("piece", pa.string())])
_MATRIX = pa.list_(pa.struct([("state", _STATE), ("outs", pa.list_(_STATE))]))
_STATE_SQL = "struct<over: int, piece: string>"
_MATRIX_SQL = f"array<struct<state: {_STATE_SQL}, outs: array<{_STATE_SQL}>>>"


def _rows(matrix: dict[State, list[State]]) -> list[dict]:
    row = lambda s: {"over": s[0], "piece": s[1]}
    return [{"state": row(s), "outs": [row(t) for t in outs]} for s, outs in matrix.items()]


def _matrix(rows: list[dict]) -> dict[State, list[State]]:
    state = lambda r: (r["over"], r["piece"])
    return {state(r["state"]): [state(t) for t in r["outs"]] for r in rows}


def _ordinary(docs: DataFrame, model_file: str) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_file)
        for batch in batches:
            at, some, size = 0, [], 0
            for i, text in enumerate(texts_of(batch), start=1):
                some.append(text)
                size += len(text)
                # Pieces leave in small batches, as they take far more memory than their texts.
                if size >= BATCH_CHARS or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), voc.encode_rows(some)], names=["doc_id", "ids"])
                    at, some, size = i, [], 0

    return docs.mapInArrow(encode, f"doc_id {id_type}, ids array<int>")


def _chunks(docs: DataFrame, model_file: str, chunk: int) -> DataFrame:
    """``doc_id, same, no, low, high, text, final, matrix`` of each chunk; ``text`` reaches a piece's length further.

    Texts are cut where they are read, chunks are dealt over the cluster, and each gets its matrix where it arrives, so the
    chunks of one document are worked on by many tasks.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_file)
        for batch in batches:
            for i, text in enumerate(texts_of(batch)):
                whole = marked(text)
                rows, size = [], 0
                for no, at in enumerate(range(0, len(whole), chunk)):
                    left, end = max(0, at - voc.longest), min(at + chunk, len(whole))
                    rows.append((no, at - left, end - left, whole[left : end + voc.longest], end == len(whole)))
                    size += chunk
                    if size >= BATCH_CHARS or end == len(whole):
                        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
                        keys = [
                            pa.array([batch.column(0)[i].as_py()] * len(rows), batch.schema.field(0).type),
                            pa.array([batch.column(2)[i].as_py()] * len(rows), pa.int64()),
                        ]
                        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays(keys + columns, names=["doc_id", "same", "no", "low", "high", "text", "final"])
                        rows, size = [], 0

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_file)
        for batch in batches:
            views = zip(*(batch.column(name).to_pylist() for name in ("text", "low", "high")))
            rows = pa.array([_rows(transfer(voc, *view)) for view in views], _MATRIX)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, "matrix"])

    schema = f"doc_id {id_type}, same long, no long, low int, high int, text string, final boolean"
    # The work of a chunk is far larger than its bytes, by which adaptive execution would join partitions.
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = docs.mapInArrow(cut, schema).repartition(n_tasks, "same", "no")
    return dealt.mapInArrow(matrices, f"{schema}, matrix {_MATRIX_SQL}")


def _products(level: DataFrame) -> DataFrame:
    """One matrix for each ``GROUP`` matrices that follow one another."""
    parts_of = level.groupBy("doc_id", "same", F.floor(F.col("no") / GROUP).alias("no"))
    rows = parts_of.agg(F.sort_array(F.collect_list(F.struct("no", "matrix"))).alias("list"), F.max("final").alias("final"))
    id_type = level.schema["doc_id"].dataType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column(3).to_pylist():
                product = _matrix(items[0]["matrix"])
                for item in items[1:]:
                    product = combine(product, _matrix(item["matrix"]))
                out.append(_rows(product))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(out, _MATRIX)], names=["doc_id", "same", "no", "final", "matrix"])

    return rows.mapInArrow(multiply, f"doc_id {id_type}, same long, no long, final boolean, matrix {_MATRIX_SQL}")


def _boundaries(level: DataFrame, outer: DataFrame | None) -> DataFrame:
    """``doc_id, same, no, begin, end``: the states on both boundaries of each matrix of a level.

    ``outer`` has those of the groups of ``GROUP``; without it each document is one group, from its START to its end.
    """
    keyed = level.withColumn("group", F.floor(F.col("no") / GROUP))
    rows = keyed.groupBy("doc_id", "same", "group").agg(F.sort_array(F.collect_list(F.struct("no", "matrix"))).alias("list"))
    if outer is None:
        none = F.lit(None).cast(_STATE_SQL)
        rows = rows.select("doc_id", "same", "list", none.alias("begin"), none.alias("end"))
    else:
        bounds = outer.withColumnRenamed("no", "group")
        same = (rows["doc_id"].eqNullSafe(bounds["doc_id"])) & (rows["same"] == bounds["same"]) & (rows["group"] == bounds["group"])
        rows = rows.join(bounds, same).select(rows["doc_id"], rows["same"], "list", "begin", "end")
    id_type = level.schema["doc_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items, begin, end = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                matrices = [_matrix(x["matrix"]) for x in items]
                at = (begin["over"], begin["piece"]) if begin else START
                reached = [{at}]
                for m in matrices:
                    reached.append({t for s in reached[-1] for t in m.get(s, ())})
                if end:
                    chosen = [(end["over"], end["piece"])]
                else:
                    # The text ends here, so no piece reaches beyond; one path of weight 0 is left.
                    chosen = [next(s for s in sorted(reached[-1]) if s[0] == 0)]
                for m, here in zip(reversed(matrices), reversed(reached[:-1])):
                    chosen.append(next(s for s in sorted(here) if chosen[-1] in m.get(s, ())))
                chosen.reverse()
                state = lambda s: {"over": s[0], "piece": s[1]}
                n = len(items)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type),
                        pa.array([batch.column(1)[i].as_py()] * n, pa.int64()), pa.array([x["no"] for x in items], pa.int64()),
                        pa.array([state(s) for s in chosen[:-1]], _STATE), pa.array([state(s) for s in chosen[1:]], _STATE),
                    ],
                    names=["doc_id", "same", "no", "begin", "end"],
                )

    return rows.mapInArrow(walk, f"doc_id {id_type}, same long, no long, begin {_STATE_SQL}, end {_STATE_SQL}")


def _giant(docs: DataFrame, model_file: str, chunk: int) -> DataFrame:
    """``doc_id, ids`` of giant texts (``doc_id, text, same``); ``same`` numbers the rows and is written down with the chunks."""
    chunks = written(_chunks(docs, model_file, chunk), "pieces-chunks")
    levels = [chunks.select("doc_id", "same", "no", "final", "matrix")]
    longest = levels[0].agg(F.max("no")).first()[0]
    while longest is not None and longest >= GROUP:
        levels.append(written(_products(levels[-1]), "pieces-level"))
        longest //= GROUP
    bounds = None
    for level in reversed(levels):
        bounds = written(_boundaries(level, bounds), "pieces-bounds")
    same = (chunks["doc_id"].eqNullSafe(bounds["doc_id"])) & (chunks["same"] == bounds["same"]) & (chunks["no"] == bounds["no"])
    told = chunks.join(bounds, same)
    told = told.select(chunks["doc_id"], chunks["same"], chunks["no"], "low", "high", "text", "begin", "end")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_file)
        for batch in batches:
            ids = []
            for low, high, text, begin, end in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6, 7))):
                ids.append(pieces_between(voc, text, low, high, (begin["over"], begin["piece"]), (end["over"], end["piece"])))
            done = [*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(done, names=["doc_id", "same", "no", "ids"])

    encoded = told.mapInArrow(trace, f"doc_id {id_type}, same long, no long, ids array<int>")
    whole = encoded.groupBy("doc_id", "same").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("list"))
    return whole.select("doc_id", F.flatten(F.transform("list", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids``: the pieces of each whole text, as the library gives them for the model file, without begin or end.

    Null and empty texts have no pieces. Rows that repeat an id, or have none, each have their row, whatever the length of
    their text. No rows give no rows. Texts of at most ``chunk`` characters
    are encoded where they are read; longer ones in chunks, whose states are combined, so no task works through a giant
    document. Its pieces come together in its row alone.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text)
    giant = F.char_length("text") > chunk
    rest = narrow.where(giant).select("doc_id", "text", F.monotonically_increasing_id().alias("same"))
    return _ordinary(narrow.where(~giant), model_file).unionAll(_giant(rest, model_file, chunk))


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text`` of rows of pieces. Null pieces are none; a space mark in the text itself comes back as a space."""
    bound_batches(encoded.sparkSession)
    no_ids = F.array().cast("array<int>")
    narrow = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`"), no_ids).alias("ids"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                texts = pa.array(voc.decode(rows_of(part.column(1))), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "ids", "text"])

    return narrow.mapInArrow(read, f"doc_id {id_type}, ids array<int>, text string")
