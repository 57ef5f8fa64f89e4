"""A steel model from XML against plain Python over a generated file, with forward references and objects in objects."""

import collections
import random
import xml.etree.ElementTree as ET

import pytest

from packgraph.operators import steel_package
from packgraph.sources import steel_xml


def tag(name, kind, value):
    return "" if value is None else f'<{name} {kind}="{value}"/>'


def ref(name, i):
    return "" if i is None else f'<{name}><Object class="CRef"><m_nID long="{i}"/></Object></{name}>'


def generated(seed=4, n=160):
    r = random.Random(seed)
    out = []
    for i in range(n):
        main = 1000 + i // 4 * 4
        out.append(
            f'<Object class="{r.choice(list(steel_package.PARTS))}">' + tag("m_nID", "long", 1000 + i) + tag("m_strName", "string", r.choice(["H 200", "L 50 &amp; &quot;x&quot;", "PL 9", ""])) + tag("m_strMark", "string", f"B{i % 7}")
            + tag("m_strRole", "string", r.choice(["Column", "Beam", None])) + tag("m_UserAttributes_0", "string", r.choice(["1-01", "1-02", "1-03", " ", None])) + tag("m_UserAttributes_1", "string", r.choice(["T1", "T2", None, "T1"]))
            + tag("m_bIsMainPart", "long", int(i % 4 == r.randint(0, 2))) + ref("m_pMaterial", r.choice([1, 2, 77, None])) + ref("m_pSectionStart", r.choice([11, 12, None])) + ref("m_pSectionEnd", r.choice([11, 99, None])) + ref("m_pMainPartEx", r.choice([main, main, None]))
            + tag("m_Length", "double", r.choice([1.5, 2.25, None])) + tag("m_ExactWeight", "double", r.choice([0, 10.5, 3.25])) + tag("m_dfWeight", "double", r.choice([4, None])) + "</Object>"
        )
    for i in range(30):
        kind = r.choice([steel_package.BOLTS, steel_package.ANCHORS])
        some = [r.choice([1000 + r.randrange(n), 5]) for _ in range(r.randint(0, 3))]
        out.append(
            f'<Object class="{kind}">' + tag("m_nNumberOnX", "long", r.choice([1, 2, None])) + tag("m_nNumberOnY", "long", 2) + tag("m_tabLocations_SIZE", "long", r.choice([2, 4, None])) + tag("m_dfDiameter", "double", r.choice([0.016, 0.02])) + tag("m_dfLength", "double", 0.06)
            + tag("m_strNorm", "string", r.choice(["ISO", ""])) + tag("m_strMaterial", "string", "8.8") + tag("m_tabConnectedObjects_SIZE", "long", len(some)) + "".join(ref(f"m_tabConnectedObjects_{k}", x) for k, x in enumerate(some)) + "</Object>"
        )
    out += ['<Object class="CGREXBolt"><m_dfDiameter double="0.016"/><m_dfLength double="0.06"/></Object>'] * 5
    r.shuffle(out)
    out += [f'<Object class="CGREXMaterial"><m_nID long="{i}"/><m_strName string="S{i}"/></Object>' for i in (1, 2)] + [f'<Object class="CGREXSection"><m_nID long="{i}"/><m_strName string="{s}"/><m_strStandard string="{t}"/></Object>' for i, s, t in ((11, "Q 100", "Square"), (12, "U", "Korea Channels"))]
    return "<?xml version='1.0'?>\n<Model><ObjectList/><Empty/>" + "\n".join(out) + '<Object class="Nothing"/></Model>\n'


def plain(text):
    """Parts as the file's tree says."""
    def attr(e, name, kind):
        f = e.find(f".//{name}")
        return None if f is None or not (f.attrib.get(kind) or "").strip() else f.attrib[kind].strip()

    def to(e, name):
        f = e.find(f".//{name}")
        return None if f is None else attr(f, "m_nID", "long")

    tops = [e for e in ET.fromstring(text) if e.tag == "Object"]
    named = {c: {attr(e, "m_nID", "long"): attr(e, "m_strName", "string") for e in tops if e.attrib["class"] == c} for c in ("CGREXMaterial", "CGREXSection")}
    parts = []
    for e in tops:
        if e.attrib["class"] not in steel_package.PARTS:
            continue
        i, section = attr(e, "m_nID", "long"), to(e, "m_pSectionStart") or to(e, "m_pSectionEnd")
        weight = float(attr(e, "m_ExactWeight", "double") or 0) or float(attr(e, "m_dfWeight", "double") or 0)
        parts.append({
            "id": i, "module": attr(e, "m_UserAttributes_0", "string"), "type": attr(e, "m_UserAttributes_1", "string"), "material": to(e, "m_pMaterial"), "material_name": named["CGREXMaterial"].get(to(e, "m_pMaterial")),
            "section": section, "section_name": named["CGREXSection"][section] if section in named["CGREXSection"] else attr(e, "m_strName", "string"), "assembly": to(e, "m_pMainPartEx") or f"orphan-{i}", "main": attr(e, "m_bIsMainPart", "long") == "1",
            "kg": weight, "m": float(attr(e, "m_Length", "double") or 0), "mark": attr(e, "m_strMark", "string"), "orphan": to(e, "m_pMainPartEx") is None,
        })
    return tops, parts, attr


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path, text = tmp_path_factory.mktemp("steel") / "m.xml", generated()
    path.write_text(text)
    return str(path), text, steel_package.package(steel_xml.objects(spark, str(path)))


def test_objects_are_the_same_over_many_tasks(spark, model):
    path, text, _ = model
    want = sorted(ET.tostring(e, encoding="unicode").strip() for e in ET.fromstring(text) if e.tag == "Object")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("900b", "20000b", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = []
            for r in steel_xml.objects(spark, path).orderBy("block", "at").collect():
                own = r["text"]
                own = own[: own.rindex("</Object>") + 9] if "</Object>" in own else own[: own.index("/>") + 2]
                got.append(ET.tostring(ET.fromstring(own), encoding="unicode"))
            assert sorted(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_tables_are_those_of_plain_python(model):
    _, text, t = model
    tops, every, attr = plain(text)
    parts = [p for p in every if p["module"] and p["type"]]
    got = {r["source_id"]: r for r in t["single_parts"].collect()}
    assert set(got) == {int(p["id"]) for p in parts}
    for p in parts:
        r = got[int(p["id"])]
        assert (r["module_id"], r["material_name"], r["section_name"], r["assembly_id"], r["is_main"], r["weight_kg"]) == (p["module"], p["material_name"], p["section_name"], f"as:assembly:{p['assembly']}", p["main"], p["kg"])
    q = t["quality"].first()
    assert (q["parts"], q["excluded"], q["orphans"], q["zero_weight"]) == (len(every), len(every) - len(parts), sum(p["orphan"] for p in every), sum(not p["kg"] for p in every))
    by = collections.defaultdict(list)
    for p in parts:
        by[p["assembly"]].append(p)
    rows = {r["assembly_id"].removeprefix("as:assembly:"): r for r in t["assemblies"].collect()}
    assert set(rows) == set(by)
    for name, own in by.items():
        main = next((p for p in own if p["main"]), None)
        r = rows[name]
        assert (r["parts"], r["main_parts"], float(r["weight_kg"]), r["assembly_mark"]) == (len(own), sum(p["main"] for p in own), sum(p["kg"] for p in own), (main or own[0])["mark"])
        assert r["main_single_part_id"] == (f"as:single_part:{main['id']}" if main else None) and r["module_ids"] == sorted({p["module"] for p in own})
    for r in t["modules"].collect():
        own = [p for p in parts if p["module"] == r["module_id"]]
        assert (r["parts"], r["assemblies"], float(r["weight_kg"]), float(r["length_m"])) == (len(own), len({p["assembly"] for p in own}), sum(p["kg"] for p in own), sum(p["m"] for p in own))
    for r in t["module_types"].collect():
        names = {p["module"] for p in parts if p["type"] == r["module_type"]}
        own = [p for p in parts if p["module"] in names]
        assert (r["modules"], r["parts"], r["assemblies"], float(r["weight_kg"])) == (len(names), len(own), len({p["assembly"] for p in own}), sum(p["kg"] for p in own))
    for table, key in (("materials", "material"), ("sections", "section")):
        for r in t[table].collect():
            own = [p for p in parts if p[key] == str(r["source_id"])]
            assert (r["used_by_parts"], r["used_by_modules"], float(r["weight_kg"])) == (len(own), len({p["module"] for p in own}), sum(p["kg"] for p in own))
    lost = {(r["kind"], r["id"]): r["n"] for r in t["unresolved"].collect()}
    assert lost[("material", 77)] == sum(p["material"] == "77" for p in every) and lost[("section", 99)] == sum(p["section"] == "99" for p in every)
    kinds = collections.Counter(r["relation"] for r in t["edges"].collect())
    assert kinds["has_single_part"] == kinds["part_of_assembly"] == kinds["belongs_to_module"] == len(parts) and kinds["has_main_part"] == sum(any(p["main"] for p in own) for own in by.values())


def test_fasteners_and_views_are_those_of_plain_python(model):
    _, text, t = model
    tops, every, attr = plain(text)
    module = {p["id"]: p["module"] for p in every if p["module"] and p["type"]}
    want, total = [], collections.Counter()
    for e in tops:
        if e.attrib["class"] not in (steel_package.BOLTS, steel_package.ANCHORS):
            continue
        nx, ny, places = (attr(e, n, "long") for n in ("m_nNumberOnX", "m_nNumberOnY", "m_tabLocations_SIZE"))
        anchor = e.attrib["class"] == steel_package.ANCHORS
        n = int(places) if anchor and places else int(nx or 0) * int(ny or 0)
        refs = [attr(e.find(f".//m_tabConnectedObjects_{k}"), "m_nID", "long") for k in range(int(attr(e, "m_tabConnectedObjects_SIZE", "long")))]
        want.append(("anchor" if anchor else "bolt", n, sorted({module[x] for x in refs if x in module})))
        total["anchor_pattern" if anchor else "bolt_pattern"] += n
    got = t["fastener_patterns"].orderBy("block", "at").collect()
    assert [(r["kind"], r["quantity"], r["module_ids"]) for r in got] == want
    assert [r["id"] for r in got if r["kind"] == "bolt"] == [f"view:fastener_pattern:bolt:{i + 1}" for i in range(sum(k == "bolt" for k, *_ in want))]
    total["bolt_object"] = 5
    sums = collections.Counter()
    for r in t["fastener_specs"].collect():
        sums[r["kind"]] += r["quantity"]
        assert r["description"] in ("M16x60", "M20x60") and r["standard"] in ("ISO", "(blank)")
    assert sums == total
    views = [n for n in t if n.endswith("_view")] + ["query_aliases"]
    assert len(views) == 7 and all(t[v].count() for v in views)
    assert sum(r["parts"] for r in t["module_profile_summary_view"].collect()) == len(module) == sum(r["parts"] for r in t["module_material_summary_view"].collect())
    assert {r["profile_group"] for r in t["query_aliases"].collect()} >= {"Tube", "Channel"}


def test_a_table_that_is_not_asked_for_is_not_made(spark, model, monkeypatch):
    written, put = [], steel_package.Scratch.put
    monkeypatch.setattr(steel_package.Scratch, "put", lambda self, name, df: written.append(name) or put(self, name, df))
    t = steel_package.package(steel_xml.objects(spark, model[0]))
    t["module_types"].collect()
    assert [n for n in written if n != "pieces"] == ["objects", "parts"]
    assert t["edges"].count() == model[2]["edges"].count() and written.count("assemblies") == 1 and "patterns" not in written
