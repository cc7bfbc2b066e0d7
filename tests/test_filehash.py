"""Hashes of stored files beyond what one task may read (F1, table_index)."""

import contextlib
import gzip
import hashlib
import random
from urllib.parse import unquote

import pytest

from ratebook.operators import filehash
from ratebook.operators import inventory as iv


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SPLITS = {"spark__sql__files__maxPartitionBytes": "20000", "spark__sql__files__openCostInBytes": "100"}


def digest(path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_table_index_reads_no_large_file_in_one_row(spark, tmp_path, monkeypatch):
    from ratebook.plans.catalog import q_table_index
    spark.range(30000).selectExpr("id", "cast(rand(7) as string) as s").coalesce(1).write.parquet(str(tmp_path / "big.parquet"))
    spark.range(10).write.parquet(str(tmp_path / "small.parquet"))
    files = {p.name: p for p in tmp_path.glob("*.parquet/*.parquet")}
    assert max(p.stat().st_size for p in files.values()) > 200_000
    monkeypatch.setattr(filehash, "WHOLE_BYTES", 50_000, raising=False)
    with settings(spark, spark__sql__sources__binaryFile__maxLength="100000", **SPLITS):
        rows = q_table_index(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in rows} == {name: digest(p) for name, p in files.items()}
    assert sum(r.row_count for r in rows) == 30010


def test_ranges_give_every_byte(spark, tmp_path):
    rng = random.Random(3)
    noise = rng.randbytes
    (tmp_path / "no end.bin").write_bytes(noise(150_000) + b"x")
    (tmp_path / "end.bin").write_bytes(noise(150_000) + b"\n")
    (tmp_path / "feeds.bin").write_bytes(b"\n" * 50_001)
    (tmp_path / "returns%20.bin").write_bytes(b"\r\n\r\n\n\x00" * 9_000)
    (tmp_path / "long.bin").write_bytes(noise(30) + b"a" * 90_000 + b"\n" + noise(40_000))
    (tmp_path / "one line.bin").write_bytes(b"\xff" * 60_000)
    (tmp_path / "utf.bin").write_bytes("元\n".encode() * 20_000)
    for i in range(6):  # ranges of several files share a part
        (tmp_path / f"tail{i}.bin").write_bytes(noise(20_000 + 20_000 * (i % 3) + 700 * i))
    (tmp_path / "mark.bin").write_bytes(b"\xef\xbb\xbf" + noise(50_000))
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(noise(50_000)))
    (tmp_path / "small.bin").write_bytes(noise(100))
    (tmp_path / "empty.bin").write_bytes(b"")
    files = {p.name: p for p in tmp_path.iterdir()}
    left_out = {"mark.bin", "packed.csv.gz", "small.bin", "empty.bin"}
    for conf in (SPLITS, {**SPLITS, "spark__sql__files__maxPartitionNum": "3"}, {}):
        with settings(spark, **conf):
            got = {unquote(k.rsplit("/", 1)[1]): v for k, v in filehash.ranged_sha256(spark, str(tmp_path), 10_000).items()}
        assert got == {name: digest(p) for name, p in files.items() if name not in left_out}


@pytest.mark.parametrize("least", [1_000, 10**9])
def test_file_index_is_the_same_by_ranges_and_whole(spark, tmp_path, monkeypatch, least):
    rng = random.Random(5)
    for name, n in (("a b.csv", 70_000), ("b.parquet", 3_000), ("c.txt", 10), ("d", 1)):
        (tmp_path / name).write_bytes(rng.randbytes(n))
    (tmp_path / "m.txt").write_bytes(b"\xef\xbb\xbf" + rng.randbytes(5_000))
    monkeypatch.setattr(filehash, "WHOLE_BYTES", least, raising=False)
    with settings(spark, **SPLITS):
        assert {unquote(k.rsplit("/", 1)[1]) for k in filehash.ranged_sha256(spark, str(tmp_path))} == (
            {"a b.csv", "b.parquet"} if least == 1_000 else set())
        rows = iv.file_index(spark, str(tmp_path)).collect()
    assert {(r.file_name, r.size, r.sha256, r.parsed) for r in rows} == {
        (p.name, p.stat().st_size, digest(p), False) for p in tmp_path.iterdir()}
    assert {r.mime_type for r in rows} == {"text/csv", "application/octet-stream", "text/plain"}
    assert all(r.modified_at for r in rows)


def test_states_are_handed_on():
    data = random.Random(1).randbytes(1_000)
    state = filehash.begun()
    for at in range(0, 1_000, 37):
        state = filehash.advanced(state, [data[at:at + 37]])
    assert filehash.can_hand_on() and filehash.finished(state) == hashlib.sha256(data).hexdigest()
