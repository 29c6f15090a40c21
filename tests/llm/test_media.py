from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest

from plumbline.llm import media
from plumbline.storage import fresh_path

SCHEMA = "doc_id long, text string, media string, n_bytes string"
TEXTS = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long " * 60_000, "a"]


@pytest.mark.parametrize("text", TEXTS)
def test_png_round_trip_is_lossless(text):
    payload, n = media.payload_of(text)
    assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ") and n == len((text or "").encode())
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_damage_is_noticed():
    png = bytearray(media.to_png(b"q" * 192))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def brute(text):
    raw = (text or "").encode()
    payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
    png = media.to_png(payload)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest()


def test_columns_equal_brute_force_with_nulls_and_repeats(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (2, "a", "x", "y")]
    out = media.media_columns(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted([tuple(r)[:-1] for r in out], key=repr)
    assert got == sorted([(i, *brute(t)) for i, t, _, _ in rows], key=repr)
    assert len({r.feature for r in out if r.payload_sha256 == brute("a")[2]}) == 1


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_cover_the_directories_and_need_only_footers(spark):
    folder = fresh_path(spark, "media")
    rows = [(i, f"text {i} " * (i % 40), "", "") for i in range(500)]
    assert media.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, archive_bytes=4000) == 500
    ranges = media.ArchiveReader({"path": folder, "rangeBytes": "900"}).partitions()
    assert len({r.path for r in ranges}) > 3 and len(ranges) > 20
    assert sum(r.end - r.begin for r in ranges) == 500 * media.ENTRY.itemsize
    spark.dataSource.register(media.ArchiveSource)
    found = spark.read.format("media_archive").option("rangeBytes", "900").load(folder)
    assert sorted(r.doc_id for r in found.collect()) == list(range(500))


class Flaky:
    """A file whose first read of a run gives damaged bytes."""

    def __init__(self, data, failures):
        self.data, self.failures, self.reads = data, failures, []

    def read_at(self, size, offset):
        self.reads.append((offset, size))
        if len(self.reads) <= self.failures:
            return b"\0" * size if len(self.reads) % 2 else (_ for _ in ()).throw(OSError("lost"))
        return self.data[offset : offset + size]


def test_members_are_retried_by_offset():
    members = [media.to_png(bytes([65 + k]) * 192) for k in range(3)]
    at = np.cumsum([0, *map(len, members)])
    run = np.array([(k, 0, at[k], len(m), 192, zlib.crc32(m)) for k, m in enumerate(members)], media.ENTRY)
    reader = media.ArchiveReader({"path": "file:///nowhere"})
    f = Flaky(b"".join(members), 2)
    batch = reader._batch(f, run)
    assert batch.column(2).to_pylist() == members
    assert f.reads[1:] == [(0, len(members[0])), (0, len(members[0])), (int(at[1]), len(members[1])), (int(at[2]), len(members[2]))]
    with pytest.raises(OSError):
        reader._again(Flaky(b"", 99), run[0])


def test_lost_attempts_are_not_read(spark):
    folder = fresh_path(spark, "media")
    media.write_archives(spark.createDataFrame([(1, "a", "", "")], SCHEMA), folder)
    with open(os.path.join(folder.removeprefix("file://"), "part-000009-0000.arc.77.part"), "wb") as f:
        f.write(b"half")
    spark.dataSource.register(media.ArchiveSource)
    assert spark.read.format("media_archive").load(folder).count() == 1


def test_planning_reads_manifests_and_opens_no_archive(tmp_path):
    """Ten thousand archives, listed by manifests alone."""
    from pyarrow import fs

    files = fs.LocalFileSystem()
    for task in range(100):
        media.write_manifest(files, f"{tmp_path}/part-{task:06d}", 0, [(k, 128 << 20, 5000) for k in range(100)])
    ranges = media.ArchiveReader({"path": f"file://{tmp_path}"}).partitions()
    assert len({r.path for r in ranges}) == 10_000 and len(ranges) == 10_000 * 8
    assert sum(r.end - r.begin for r in ranges) == 10_000 * 5000 * media.ENTRY.itemsize


def test_a_partition_that_runs_twice_is_read_once(spark, tmp_path):
    """After a finished run, a second attempt (lost executor, speculation) can write and commit; a third that is cut off changes nothing."""
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame([(k, f"text {k}", "", "") for k in range(40)], SCHEMA).repartition(2)
    for _ in range(2):
        assert media.write_archives(rows, folder) == 40
    manifests = sorted(p.name for p in tmp_path.glob("*.idx"))
    assert len(manifests) == 4
    spark.dataSource.register(media.ArchiveSource)
    read = lambda: sorted(r.doc_id for r in spark.read.format("media_archive").load(folder).collect())
    assert read() == list(range(40))
    last = max(tmp_path.glob("part-000001.*.idx"), key=lambda p: int(p.name.split(".")[1]))
    (tmp_path / "part-000001.999999999.idx").write_bytes(last.read_bytes()[:-2])
    (tmp_path / "part-000001.999999999-000000.arc").write_bytes(b"half")
    assert read() == list(range(40))
