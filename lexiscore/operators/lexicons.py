"""Lexicon checks, merges, and the join of terms to weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lexicon is broadcast only within these limits. Each weight takes 8 bytes, so one at the limit takes about 24 MB.
BROADCAST_ROWS = 100_000
BROADCAST_WEIGHTS = 2_500_000
BROADCAST_TERM_BYTES = 4_000_000

# A term filter has one block of 64 bits for each 4 terms, and each term sets up to 4 bits of its block. With at most this
# many blocks, of about 40 bytes as a broadcast row, its size is bounded; a lexicon with more terms fills the blocks further.
TERMS_PER_BLOCK = 4
BITS_PER_TERM = 4
MAX_BLOCKS = 1 << 20
# Fuller than this, the blocks let nearly every word pass.
MAX_TERMS_PER_BLOCK = 24


def score_columns(lexicon: DataFrame) -> list[str]:
    return [c for c in lexicon.columns if c != "term"]


def free_of_substring(df: DataFrame, part: str) -> bool:
    """True if no column name contains ``part``."""
    return all(part not in c for c in df.columns)


def unpaired_columns(lexicon: DataFrame) -> list[str]:
    """Score columns that lack their ``_pos`` / ``_neg`` twin."""
    cols = score_columns(lexicon)
    twin = {"_pos": "_neg", "_neg": "_pos"}
    return [c for c in cols if c[-4:] not in twin or c[:-4] + twin[c[-4:]] not in cols]


def check_lexicon(lexicon: DataFrame) -> DataFrame:
    """The lexicon, if it has terms and numeric weights."""
    if "term" not in lexicon.columns:
        raise ValueError("lexicon has no column 'term'")
    wrong = [f.name for f in lexicon.schema if f.name != "term" and not isinstance(f.dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"lexicon columns are not numeric: {wrong}")
    return lexicon


def merge_lexicons(lexicon: DataFrame, extra: DataFrame, how: str = "inner") -> DataFrame:
    """Columns of both lexicons, joined on the term.

    The inner join keeps shared terms only; ``how="full"`` keeps all and fills weights with 0.
    """
    clash = set(score_columns(lexicon)) & set(score_columns(extra))
    if clash:
        raise ValueError(f"both lexicons have the columns {sorted(clash)}")
    if how not in ("inner", "full"):
        raise ValueError(f"unknown merge {how!r}")
    merged = lexicon.join(extra, "term", how)
    return merged.fillna(0, subset=score_columns(merged)) if how == "full" else merged


def is_small(lexicon: DataFrame) -> bool:
    """Whether the lexicon keeps within the broadcast limits; reads at most one row more than they allow."""
    most = min(BROADCAST_ROWS, BROADCAST_WEIGHTS // max(1, len(score_columns(lexicon))))
    probe = lexicon.select("term").limit(most + 1)
    rows, size = probe.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return rows <= most and size <= BROADCAST_TERM_BYTES


def _bits(term: Column) -> Column:
    """The bits of a term within its block."""
    hashed = F.xxhash64(term, F.lit("bits"))
    places = [F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_PER_TERM)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places])


def term_filter(lexicon: DataFrame) -> tuple[DataFrame, int] | None:
    """``_block, _bits`` of a blocked Bloom filter over the lexicon's terms, and how many blocks it is made for.

    The blocks are an aggregate, one ``bit_or`` each, for as many as the counted terms need. None where the lexicon is so
    large that a filter of the greatest size would hold back next to nothing.
    """
    n_terms = lexicon.count()
    blocks = max(1, min(MAX_BLOCKS, n_terms // TERMS_PER_BLOCK))
    if n_terms > blocks * MAX_TERMS_PER_BLOCK:
        return None
    term = F.col("term")
    placed = lexicon.select(F.pmod(F.xxhash64(term), F.lit(blocks)).alias("_block"), _bits(term).alias("_own"))
    return placed.groupBy("_block").agg(F.bit_or("_own").alias("_bits")), blocks


def drop_unknown(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows of ``terms`` without most of those whose ``term`` the lexicon does not have; rows with a lexicon term all stay.

    Each row looks up one block in the broadcast filter, where it is, so that fewer rows go into the lexicon's shuffle.
    """
    made = term_filter(lexicon)
    if made is None:
        return terms
    blocks, n_blocks = made
    bits = _bits(F.col("term"))
    hit = (F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == F.col("_block")) & (F.col("_bits").bitwiseAND(bits) == bits)
    return terms.join(F.broadcast(blocks), hit, "left_semi")


def join_weights(terms: DataFrame, lexicon: DataFrame, small: bool) -> DataFrame:
    """Rows of ``terms`` with the weights of their ``term``; rows without a lexicon entry go.

    A lexicon within the limits is broadcast and the term rows stay where they are. A larger one is joined by shuffle. Both
    sides are dealt for this join alone, so adaptive execution splits the rows of a very frequent word among as many tasks
    as their size asks for, and copies the one lexicon row that they need.
    """
    if small:
        return terms.join(F.broadcast(lexicon), "term")
    return terms.join(lexicon.hint("merge"), "term")
