"""Problem 2: oversized chunks are cut at natural boundaries.

A token is four bytes of UTF-8, so limits are byte limits. The text is viewed
as ISO-8859-1 characters, one per byte, which lets bounded regex quantifiers
count bytes exactly; a lookahead keeps cuts off the middle of a character. One
``regexp_extract_all`` yields the pieces: its alternatives are ordered by the
strength of the boundary they end at, each takes as much as fits, and the last
ones cut between characters. Overlap is read back from the end of the piece
before. All of it stays in built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running

#: Boundaries from strong to weak, as they look in the byte view: blank line,
#: line end, sentence end (also of Chinese), clause end, white space.
BOUNDARIES = (
    r"\n[ \t\r]{0,8}\n",
    r"\n",
    r"(?:[.!?][\"')\]]?\s|ã\u0080\u0082|ï¼[\u0081\u009f])",
    r"(?:[,;:]\s|ï¼[\u008c\u009b\u009a]|ã\u0080\u0081)",
    r"\s",
)
#: Longest boundary in bytes: two line ends with eight blanks between them.
BOUNDARY_BYTES = 10


def _alternatives(limit: int) -> str:
    least = max(1, min(limit // 4, limit - BOUNDARY_BYTES))
    most = max(least, limit - BOUNDARY_BYTES)
    natural = "|".join(f".{{{least},{most}}}{b}" for b in BOUNDARIES) if limit > 2 * BOUNDARY_BYTES else None
    ends = [f".{{1,{limit}}}\\z", natural, f".{{1,{limit}}}(?![\\u0080-\\u00bf])", f".{{1,{limit}}}"]
    return "|".join(e for e in ends if e)


def piece_pattern(max_bytes: int, overlap_bytes: int) -> str:
    """The pattern whose matches, in order, are the fresh parts of the pieces."""
    return f"(?s)(?:\\A(?:{_alternatives(max_bytes)})|{_alternatives(max_bytes - overlap_bytes)})"


def pieces_of(content: Column, max_bytes: int, overlap_bytes: int) -> Column:
    """Array of pieces of a text; each but the first starts with the overlap."""
    view = F.decode(content.cast("binary"), "ISO-8859-1")
    fresh = F.regexp_extract_all(view, F.lit(piece_pattern(max_bytes, overlap_bytes)), F.lit(0))

    def whole(parts: Column) -> Column:
        def with_overlap(part: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(parts, i - 1)).otherwise(F.lit(""))
            tail = F.regexp_replace(F.right(before, F.lit(overlap_bytes)), r"^[\u0080-¿]{1,3}", "")
            return F.encode(F.concat(tail, part), "ISO-8859-1").cast("string")

        return F.transform(parts, with_overlap)

    # the fresh parts are bound once, as the only element of an array
    return F.element_at(F.transform(F.array(fresh), whole), 1)


def split_oversized(
    chunks: DataFrame, max_tokens: int = 512, overlap_tokens: int = 32, bytes_per_token: int = 4
) -> DataFrame:
    """Pieces of the chunks whose content has more than ``max_tokens`` tokens.

    Columns: chunk_id, doc_id, chunk_sequence (as stored), piece (from 0 within
    the chunk), sequence (new, from 0 within the document, in the order of
    chunk_sequence, chunk_id, piece), content, token_count.

    Repeated rows of one chunk_id with the same content count once; rows with
    different contents are all split. Null or short contents give no rows; null
    ids and sequences are kept and sort first. Other columns are not carried, so
    clashing names do no harm. A text without any boundary is cut between
    characters. Numbering is two-level: ranges of (document, sequence, chunk, piece)
    cut a document into runs, and the runs are offset by a prefix sum, so one
    document, or the rows without one, may hold any share of the rows.
    """
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("overlap_tokens must be at least 0 and below max_tokens")
    limit, overlap = max_tokens * bytes_per_token, overlap_tokens * bytes_per_token
    big = (
        chunks.where(F.octet_length("content") > limit)
        .groupBy("chunk_id", "content")
        .agg(F.min("doc_id").alias("doc_id"), F.min("sequence").alias("chunk_sequence"))
    )
    pieces = big.select(
        "chunk_id", "doc_id", "chunk_sequence", F.xxhash64("content").alias("text_hash"), F.posexplode(pieces_of(F.col("content"), limit, overlap)).alias("piece", "content")
    )
    order = [F.col("chunk_sequence").asc_nulls_first(), F.col("chunk_id").asc_nulls_first(), F.col("text_hash"), F.col("piece")]
    return running(pieces, "doc_id", order, {}).select(
        "chunk_id", "doc_id", "chunk_sequence", "piece", (F.col("nth") - 1).alias("sequence"), "content",
        F.ceil(F.octet_length("content") / bytes_per_token).cast("int").alias("token_count"),
    )


def oversized_ids(chunks: DataFrame, max_tokens: int = 512, overlap_tokens: int = 32) -> DataFrame:
    """The chunk_ids that the splitter cut, each once."""
    limit = max_tokens * 4
    pieces = chunks.where(F.octet_length("content") > limit).select(
        "chunk_id", F.size(pieces_of(F.col("content"), limit, overlap_tokens * 4)).alias("pieces")
    )
    return pieces.where("pieces > 1").select("chunk_id").distinct()
