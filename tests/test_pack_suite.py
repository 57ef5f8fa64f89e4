"""Packs of a suite: digests that tell rows, quality, and files held against their catalogue."""

import shutil

import pytest

from packgraph.operators import pack_suite as P


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, ["beam", "wall", None][i % 3], f"name {i} é", None if i % 5 else 1.5 * i) for i in range(40)]
    return P.members(spark.createDataFrame(rows, "key long, kind string, name string, size double"), "facts.jsonl", "kind", ["key"], ["key"], 6)


def test_members_and_their_digests(spark, parts):
    listed = P.catalogue(parts)
    packs = {r["pack_id"]: r for r in P.pack_digests(listed).collect()}
    assert len(packs) == 9 and all(r["members"] == 4 for r in packs.values()) and {p.split("-", 2)[2] for p in packs} == {"beam", "wall", "unclassified"}
    assert all(r["whole"] and r["rows"] <= 6 for r in P.quality(parts).collect())
    again = {n: df.repartition(3) for n, df in parts.items()}
    total = P.suite_digest(P.pack_digests(listed)).first()
    assert P.suite_digest(P.pack_digests(P.catalogue(again))).first() == total and total["packs"] == 9
    one = lambda rows: P.catalogue({"rows": spark.createDataFrame(rows, "pack_id string, a int, b string")}).first()["digest"]
    same = [[("p", 1, "x"), ("p", 2, "x"), ("p", 2, "x")], [("p", 1, "x"), ("p", 3, "x"), ("p", 3, "x")], [("p", 1, None), ("p", 2, "x")], [("p", 1, "x"), ("p", 2, "x")], [("p", None, "1"), ("p", 2, "x")]]
    assert len({one(x) for x in same}) == len(same) and one(same[0]) == one(same[0][::-1])


def test_quality_finds_what_a_pack_lacks(spark, parts):
    first = sorted(r["pack_id"] for r in parts["rows"].select("pack_id").distinct().collect())[0]
    broken = dict(parts)
    broken["chunks"] = parts["chunks"].selectExpr("pack_id", "chunk_id", "title", f"if(pack_id = '{first}', '', content) AS content")
    broken["nodes"] = parts["nodes"].unionByName(parts["nodes"].filter(f"pack_id = '{first}' AND type = 'pack'"))
    broken["edges"] = parts["edges"].unionByName(spark.createDataFrame([(first, "a", "r", "b")], "pack_id string, source string, relation string, target string"))
    bad = [r for r in P.quality(broken).collect() if not r["whole"]]
    assert [(r["pack_id"], r["empty_chunks"], r["repeated_nodes"], r["unknown_ends"]) for r in bad] == [(first, bad[0]["rows"], 1, 2)]


def test_written_packs_are_held_against_the_catalogue(spark, parts, tmp_path):
    path = str(tmp_path / "suite")
    P.write(parts, path)
    assert P.differences(spark, path).count() == 0
    names = sorted(p.name for p in (tmp_path / "suite/members/rows").iterdir() if p.name.startswith("pack_id"))
    target = next((tmp_path / "suite/members/chunks" / names[0]).glob("part*"))
    text = target.read_text()
    target.write_text(text.replace("name", "nome", 1))
    target.with_name(f".{target.name}.crc").unlink()
    shutil.rmtree(tmp_path / "suite/members/edges" / names[1])
    (tmp_path / "suite/members/nodes/pack_id=007").mkdir()
    (tmp_path / "suite/members/nodes/pack_id=007/part-0.txt").write_text('{"id":"x"}\n')
    got = sorted((r["pack_id"], r["member"], r["fault"]) for r in P.differences(spark, path).collect())
    assert got == sorted([(names[0].split("=")[1], "chunks", "changed"), (names[1].split("=")[1], "edges", "missing"), ("007", "nodes", "unlisted")])
