"""Token counts of whole texts: batch encoding in Arrow functions that return numbers only.

Texts are cut where no piece of the vocabulary can cross: before a run of spaces. The parts go to the tokenizer in batches
of about equal bytes. A part's count is kept for the next text, as most parts are words that return.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.words import bound_batches, texts_of

#: Characters of text that go to the tokenizer at once.
BATCH_CHARS = 1 << 18
#: Parts whose counts a worker remembers at most, and the length up to which it does: about 40 MB together.
REMEMBERED, SHORT = 1 << 18, 64
_MARK = "▁"


def parts(text: str) -> list[str]:
    """Cut a text before each run of spaces; the tokenizer gives each part its own leading space back.

    Only runs of spaces have pieces with more than one space mark, and no piece has one after another character, so the
    pieces of the parts are the pieces of the text. The mark itself is a space to the tokenizer.
    """
    if not text:
        return []
    if _MARK in text:
        text = text.replace(_MARK, " ")
    pieces = text.split(" ")
    if "" not in pieces:
        return pieces
    # Runs of spaces: n empty strings before a word are n more spaces; the last part may be spaces alone.
    out, spaces, first = [], 0, True
    for i, piece in enumerate(pieces):
        if piece:
            out.append(" " * (spaces + (0 if first else -1)) + piece)
            first, spaces = False, 1
        else:
            spaces += 1
    tail = spaces - 1
    if tail > 0 or first:
        out.append(" " * (tail if first else tail - 1))
    return out


class Counter:
    """Counts of parts by a SentencePiece model file, in batches of about ``BATCH_CHARS`` characters."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.known: dict[str, int] = {}
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # Another vocabulary may have pieces across words; its texts are then counted whole.
        self.parts = (lambda t: [t] if t else []) if any(_MARK in p.lstrip(_MARK) for p in pieces) else parts

    def learn(self, unknown: set[str]) -> dict[str, int]:
        """Counts of these parts; those of short ones are remembered."""
        found: dict[str, int] = {}
        batch, size = [], 0
        for part in unknown:
            batch.append(part)
            size += len(part)
            if size >= BATCH_CHARS:
                found.update(self._encode(batch))
                batch, size = [], 0
        found.update(self._encode(batch))
        # A part without characters is a lone space.
        found[""] = 1
        short = {part: n for part, n in found.items() if len(part) <= SHORT}
        if len(self.known) + len(short) > REMEMBERED:
            self.known.clear()
        self.known.update(short)
        return found

    def _encode(self, batch: list[str]) -> zip:
        return zip(batch, map(len, self.model.encode(batch, num_threads=1)))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.parts(t) for t in texts]
        wanted = set().union(*cut)
        # Taken out before anything is forgotten.
        found = {part: n for part in wanted if (n := self.known.get(part)) is not None}
        found.update(self.learn(wanted.difference(found)))
        return [sum(map(found.__getitem__, c)) for c in cut]


@lru_cache(1)
def counter(model_file: str) -> Counter:
    """The one of this worker, which tasks hand on."""
    return Counter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``model_file`` is a SentencePiece model that every executor can open. A null text counts as empty: no bytes, no tokens.
    Rows that repeat an id, or have none, each have their row. No rows give no rows. There is no shuffle; a worker holds one
    Arrow batch and the counts of ``REMEMBERED`` short parts. A text without spaces is one part and goes to the tokenizer whole.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    narrow = narrow.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        for batch in batches:
            counts: list[int] = []
            some, size = [], 0
            for text in texts_of(batch):
                some.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    counts += own.count(some)
                    some, size = [], 0
            counts += own.count(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    bound_batches(docs.sparkSession)
    counted = narrow.mapInArrow(encode, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
