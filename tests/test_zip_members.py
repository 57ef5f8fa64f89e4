"""Members of archives as partitions: the same rows as whole archives, in bounded memory."""

import json
import random
import resource
import zipfile

from packgraph.sources import packs, zip_members


def rows(df):
    return sorted((r["path"].split("/")[-1], r["member"], r["line_no"], r["line"]) for r in df.collect())


def test_the_same_rows_as_whole_archives(spark, tmp_path):
    r = random.Random(1)
    (tmp_path / "more").mkdir()
    for i in range(4):
        with zipfile.ZipFile(tmp_path / ("more" if i % 2 else ".") / f"p{i}.zip", "w", zipfile.ZIP_DEFLATED if i else zipfile.ZIP_STORED) as z:
            z.writestr("documents/a.md", "﻿BOM é\r\nline")
            z.writestr("chunks.jsonl", "".join(json.dumps({"id": k, "t": "x" * r.randint(0, 300)}) + r.choice(["\n", "\r\n"]) for k in range(3000 * (i == 2) + 20)) + "last")
            z.writestr("picture.png", b"\0\1")
            z.writestr("empty.jsonl", "")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    want = rows(packs.members(spark, str(tmp_path)))
    for share in (1, 2000, 1 << 24):
        got = zip_members.zip_members(spark, str(tmp_path), share)
        assert rows(got) == want
        n = got.rdd.getNumPartitions()
        assert n == {1: 12, 1 << 24: 1}.get(share, n) and (share != 2000 or 1 < n < 12)
    assert rows(zip_members.zip_members(spark, str(tmp_path / "p0.zip"))) == [x for x in want if x[0] == "p0.zip"]
    assert rows(zip_members.zip_members(spark, f"file://{tmp_path}")) == want


def test_members_are_planned_by_size():
    plan = zip_members.planned([("a", "1", 5), ("a", "2", 6), ("a", "3", 100), ("b", "4", 1), ("b", "5", 1)], 11)
    assert [len(p.members) for p in plan] == [2, 1, 2] and zip_members.planned([]) == []


def test_a_member_is_streamed(tmp_path):
    """A member of 300 MB is read with a small part of that in memory."""
    line = json.dumps({"t": "x" * 1000}) + "\n"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("chunks.jsonl", "w", force_zip64=True) as f:
        for _ in range(300):
            f.write((line * 1000).encode())
    reader = zip_members._Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 300_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000  # KB
