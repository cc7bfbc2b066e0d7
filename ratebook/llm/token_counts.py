"""Operator 1: token counts by a map-side two-tier lookup.

A compact table of the frequent pieces' token lengths is broadcast; what it
misses is encoded in the worker and remembered there. No pre-token is ever
shuffled and each text is counted whole, in one pass without a shuffle.

The frequent table is only a cache: it is filled from a random sample of
about ``SAMPLE_ROWS`` documents and holds at most ``TABLE_ENTRIES`` pieces
(about 2 MB), so its broadcast does not grow with the data, and results do
not depend on it. The sample's pieces are counted inside the tasks; a task
hands over its most frequent ones, ``PIECES_PER_ROW`` for each row it sampled,
so the driver merges about ``SAMPLE_ROWS * PIECES_PER_ROW`` entries.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give a
row. An empty table gives an empty result. Strings of special tokens inside
a text are handled as the tokenizer file's default. Texts of a tokenizer whose
rules do not allow such cuts (``bpe.cuts_at_spaces``) are encoded whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ratebook.llm.bpe import CACHED_CHARS, Lengths
from ratebook.llm.common import boolean, col, long, map_texts, ship, text_runs

SAMPLE_ROWS = 2_000
TABLE_ENTRIES = 65_536
PIECES_PER_ROW = 64
RUN_CHARS = 16_000_000


def frequent_lengths(df: DataFrame, text_col: str, path: str) -> dict[str, int]:
    """The sample's most frequent pieces with their token lengths."""
    rows = df.count()
    sample = df.select(col(text_col).alias("t")).sample(fraction=min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=7)
    ship(df.sparkSession)
    total: Counter = Counter()
    for row in sample.mapInArrow(_frequent_pieces, "piece string, n long").collect():
        total[row.piece] += row.n
    lengths = Lengths(path, {})
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]
    return {piece: lengths.count(" " + piece) for piece, _ in top}


def _frequent_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pieces found twice or more, the most frequent first, ``PIECES_PER_ROW`` for each of its rows at most."""
    seen: Counter = Counter()
    rows = 0
    for batch in batches:
        rows += batch.num_rows
        for part in text_runs(batch, 0, RUN_CHARS):
            for text in part.column(0).to_pylist():
                seen.update(p for p in (text or "").split(" ") if 0 < len(p) <= CACHED_CHARS and not p[0].isspace())
    top = [(piece, n) for piece, n in seen.most_common(rows * PIECES_PER_ROW) if n > 1]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                     names=["piece", "n"])


def token_counts(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None,
                 limit: int = 512) -> DataFrame:
    """``keep`` columns (default: all but the text) with n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text_col, path))

    def make():
        lengths = Lengths(path, shared.value)

        def score(texts):
            n = [lengths.count(t) for t in texts]
            return [[len(t.encode()) if t else 0 for t in texts], n, [x > limit for x in n]]
        return score

    return map_texts(df, text_col, keep, [long("n_bytes"), long("n_tokens"), boolean("over_limit")], make)
