"""SHA-256 of stored files of any size, a range of a file per task.

A SHA-256 is a chain over its file, but its state between two blocks is some hundred bytes.
The files are read by Spark's line reader, which cuts them into ranges and hands on every byte
but the line feeds; round after round, the tasks of each file's next range take the state of the
range before and return their own. A task so reads one range, and all files advance together.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.session import ship

# Files beyond this many bytes are hashed by ranges; the line reader unpacks files with these endings.
WHOLE_BYTES = 64 * 1024 * 1024
PACKED = r"(?i)\.(gz|deflate|bz2|lz4|snappy|zst|passthrough)$"
_STATE_BYTES = 256  # OpenSSL's SHA256_CTX is 112 bytes: numbers, no pointers


@functools.cache
def _crypto() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib uses, if it lets a hash's state be copied."""
    try:
        import _hashlib
        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.c_void_p]
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    except (ImportError, OSError, AttributeError):
        return None
    return lib


def begun() -> bytes:
    """The state of a hash of nothing."""
    state = ctypes.create_string_buffer(_STATE_BYTES)
    _crypto().SHA256_Init(state)
    return state.raw


def advanced(state: bytes, parts: Iterable[bytes]) -> bytes:
    """The state after these bytes."""
    held = ctypes.create_string_buffer(state, _STATE_BYTES)
    for part in parts:
        _crypto().SHA256_Update(held, bytes(part), len(part))
    return held.raw


def finished(state: bytes) -> str:
    held, digest = ctypes.create_string_buffer(state, _STATE_BYTES), ctypes.create_string_buffer(32)
    _crypto().SHA256_Final(digest, held)
    return digest.raw.hex()


def can_hand_on() -> bool:
    """Whether a hash's state can be taken up again here."""
    return _crypto() is not None and finished(advanced(advanced(begun(), [b"a"]), [b"bc"])) == hashlib.sha256(b"abc").hexdigest()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch joined, one row per range in it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts, values = batch.columns
        cuts = [0, batch.num_rows]
        if paths[0] != paths[-1] or starts[0] != starts[-1]:
            keys = list(zip(paths.to_pylist(), starts.to_pylist(), strict=True))
            cuts[1:1] = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, b in zip(cuts, cuts[1:]):
            lines = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([paths.slice(a, 1), starts.slice(a, 1),
                                              pc.binary_join(lines, pa.scalar(b"\n", pa.binary()))],
                                             names=["path", "start", "data"])


def _ranges(spark: SparkSession, path_glob: str, wanted: Column) -> DataFrame:
    """(path, start, data) of the files' ranges: their lines in order, without the last line feed of a row."""
    lines = spark.read.text(path_glob, lineSep="\n").where(wanted).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("data"))
    return lines.mapInArrow(_pieces, "path string, start long, data binary")


def _sizes(part: int, rows: Iterator) -> Iterator[tuple]:
    """(part, path, start, bytes with a line feed after every line) of each range in a part."""
    sizes: dict[tuple, int] = {}
    for path, start, data in rows:
        sizes[path, start] = sizes.get((path, start), 0) + len(data) + 1
    return ((part, path, start, size) for (path, start), size in sizes.items())


def _step(due: dict[str, tuple[int, bytes, bool]]) -> Callable[[Iterator], Iterator]:
    """From a part's rows to (path, state) of each file whose range is due there; ``due`` holds
    per path the range's start, the state before it and whether it opens the file."""
    def run(rows: Iterator) -> Iterator[tuple[str, bytes]]:
        states, opening = {}, {path for path, (_, _, opens) in due.items() if opens}
        for path, start, data in rows:
            if path in due and due[path][0] == start:
                glue = [] if path in opening else [b"\n"]
                opening.discard(path)
                states[path] = advanced(states.get(path, due[path][1]), [*glue, data])
        return iter(states.items())
    return run


def ranged_sha256(spark: SparkSession, path_glob: str, whole_bytes: int | None = None) -> dict[str, str]:
    """``_metadata.file_path`` -> sha256 of the files beyond ``whole_bytes``, of which no task reads more than a range
    (``spark.sql.files.maxPartitionBytes``, and the rest of the range's last line).

    The driver holds a start and a state per file, no content. Left out are files that the line
    reader does not give byte by byte (packed ones, those that open with a byte order mark).
    """
    least = WHOLE_BYTES if whole_bytes is None else whole_bytes
    wanted = (F.col("_metadata.file_size") > least) & ~F.col("_metadata.file_name").rlike(PACKED)
    listed = spark.read.format("binaryFile").load(path_glob).where(wanted).select("_metadata.file_path", "length")
    lengths = dict(map(tuple, listed.collect()))
    if not lengths or not can_hand_on():
        return {}
    ship(spark)
    rows = _ranges(spark, path_glob, wanted).rdd
    where: dict[str, list[tuple[int, int]]] = {}
    sizes: dict[str, int] = {}
    for part, path, start, size in rows.mapPartitionsWithIndex(_sizes).collect():
        where.setdefault(path, []).append((start, part))
        sizes[path] = sizes.get(path, 0) + size
    # The last line has a line feed or not; a file whose bytes do not add up is not hashed here.
    ahead = {path: sorted(found, reverse=True) for path, found in where.items()
             if lengths.get(path, -1) in (sizes[path], sizes[path] - 1)}
    states, opened = {path: begun() for path in ahead}, set()
    while any(ahead.values()):
        turn = {path: left.pop() for path, left in ahead.items() if left}
        due = {path: (start, states[path], path not in opened) for path, (start, _) in turn.items()}
        states.update(spark.sparkContext.runJob(rows, _step(due), sorted({part for _, part in turn.values()})))
        opened.update(turn)
    return {path: finished(advanced(state, [b"\n"] if lengths[path] == sizes[path] else []))
            for path, state in states.items()}


__all__ = ["ranged_sha256"]
