"""Building models from STEP text: statements over many tasks, spatial closure with circles, styles, hosts."""

import random

import pytest

from packgraph.operators import graph, ifc
from packgraph.sources import step

MODEL = [
    "#1=IFCPROJECT('g',$,'P')", "#2=IFCSITE('g',$,'S')", "#3=IFCBUILDING('g',$,'B')", "#4=IFCBUILDINGSTOREY('g',$,'1F',$,$,$,$,'First',.ELEMENT.,3.5)", "#5=IFCBUILDINGSTOREY('g',$,'2F',$,$,$,$,$,.ELEMENT.,7.)",
    "#10=IFCRELAGGREGATES('g',$,$,$,#1,(#2))", "#11=IFCRELAGGREGATES('g',$,$,$,#2,(#3))", "#12=IFCRELAGGREGATES('g',$,$,$,#3,(#4,#5))",
    "#20=IFCWALL('w',$,'Wall; A',$,'Basic Wall:Thick',$,$,'900')", "#21=IFCOPENINGELEMENT('o',$,'Opening')", "#22=IFCDOOR('d',$,'Door',$,$,$,$,'901')", "#23=IFCPLATE('p',$,'Part',$,'Plate',$,$,'902')", "#24=IFCBEAM('b',$,'Loose',$,$,$,$,'903')",
    "#30=IFCRELCONTAINEDINSPATIALSTRUCTURE('g',$,$,$,(#20),#4)", "#31=IFCRELVOIDSELEMENT('g',$,$,$,#20,#21)", "#32=IFCRELFILLSELEMENT('g',$,$,$,#21,#22)", "#33=IFCRELAGGREGATES('g',$,$,$,#20,(#23))",
    "#34=IFCRELAGGREGATES('g',$,$,$,#24,(#25))", "#35=IFCRELAGGREGATES('g',$,$,$,#25,(#24))", "#25=IFCMEMBER('m',$,'Circle',$,$,$,$,'904')", "#36=IFCRELCONTAINEDINSPATIALSTRUCTURE('g',$,$,$,(#20),#5)",
    "#40=IFCPROPERTYSINGLEVALUE('Workset',$,IFCTEXT('1-05-ST'),$)", "#41=IFCPROPERTYSINGLEVALUE('Type Id',$,IFCTEXT('77'),$)", "#42=IFCPROPERTYSINGLEVALUE('Host Id',$,IFCTEXT('900'),$)", "#43=IFCPROPERTYSINGLEVALUE('Width',$,IFCLENGTHMEASURE(900.),$)",
    "#44=IFCPROPERTYSINGLEVALUE('Module Type',$,IFCTEXT('x'),$)", "#45=IFCPROPERTYSINGLEVALUE('Width',$,IFCLENGTHMEASURE(800.),$)", "#46=IFCPROPERTYSINGLEVALUE('Material',$,IFCTEXT('Steel, ''S'''),$)",
    "#50=IFCPROPERTYSET('g',$,'Identity Data',$,(#40,#44))", "#51=IFCPROPERTYSET('g',$,'Other',$,(#41,#42))", "#52=IFCPROPERTYSET('g',$,'Dimensions',$,(#43))", "#53=IFCPROPERTYSET('g',$,'Dimensions',$,(#45))", "#54=IFCPROPERTYSET('g',$,'Finish',$,(#46))",
    "#60=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#20,#22),#50)", "#61=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#22),#51)", "#62=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#22),#53)", "#63=IFCDOORSTYLE('g',$,'Style',$,$,(#52,#54),$,'77')",
]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ifc") / "m.ifc"
    path.write_bytes(("ISO-10303-21;\r\nDATA;\r\n" + ";\r\n".join(MODEL) + ";\r\nENDSEC;\r\n").encode())
    return ifc.model(step.instances(spark, str(path)))


def test_elements_take_their_place_over_openings_and_wholes(model):
    got = {r["element"]: r for r in model.elements.collect()}
    place = {i: (r["storey"], r["building"]) for i, r in got.items()}
    # The later of two containments holds; a door hangs below it through its opening, a part through its whole, and a circle ends.
    assert place == {20: ("2F", "B"), 22: ("2F", "B"), 23: ("2F", "B"), 24: (None, None), 25: (None, None)}
    assert got[20]["family"] == "Basic Wall" and got[20]["type_name"] == "Thick" and got[23]["type_name"] == "Plate" and got[20]["name"] == "Wall; A"
    assert {i: r["module_kind"] for i, r in got.items()} == {20: "module", 22: "module", 23: "missing_workset", 24: "missing_workset", 25: "missing_workset"}
    assert got[22]["properties"] == {"Identity Data": {"Workset": "1-05-ST"}, "Other": {"Type Id": "77", "Host Id": "900"}, "Dimensions": {"Width": "800."}, "Dimensions(Type)": {"Width": "900."}, "Finish": {"Material": "Steel, 'S'"}}
    assert got[22]["quantities"] == {"Width": "800."} and got[24]["properties"] == {} and got[24]["n_properties"] == 0


def test_groups_edges_and_hosts_of_a_model(model):
    assert [(r["element"], r["host_tag"], r["host_category"], r["host_type_name"]) for r in ifc.hosts(model.elements).collect()] == [(22, "900", "Wall", "Thick")]
    assert [(r["module_id"], r["elements"], r["doors"], r["walls"], r["storeys"]) for r in ifc.groups(model.elements, ["module_id"]).collect()] == [("1-05-ST", 2, 1, 1, 1)]
    assert {(r["storey"], r["type_name"], r["n"]) for r in ifc.group_counts(model.elements, "storey", "type_name").collect()} == {("2F", "Thick", 1), ("2F", "Door", 1)}
    edges = {(r["source"], r["relation"], r["target"]) for r in ifc.edges(model.elements, "p").collect()}
    assert ("ifc:storey_name:2F", "has_element", "ifc:element:22") in edges and len(edges) == 1 + 1 + 2 + 2 + 2 + 2
    assert model.summary().first().asDict() == {"elements": 5, "user_elements": 2, "with_workset": 2, "without_workset": 3, "modules": 1, "sites": 0, "other_workset_elements": 0}
    assert [(r["name"], r["elevation"]) for r in model.storeys.orderBy("id").collect()] == [("1F", 3.5), ("2F", 7.0)]


def test_statements_are_the_same_whatever_the_lines_and_tasks(spark, tmp_path):
    r = random.Random(2)
    want, parts = [], []
    for i in range(1, 400):
        text = "".join(r.choice("ab;,'(é\n ") for _ in range(r.randint(0, 60))).replace("'", "''")
        parts.append(f"#{i}=IFCWALL('{text}',$,({i}.))")
        want.append((i, " ".join(f"'{text}'".replace("\n", "\0").split("\0"))))
    files = {"lf": ";\n", "crlf": ";\r\n", "one": ";"}
    for name, end in files.items():
        (tmp_path / f"{name}.ifc").write_bytes((end.join(parts) + ";").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "7000b", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            for name in files:
                read = step.statements(spark, str(tmp_path / f"{name}.ifc"))
                got = sorted((q["id"], q["args"][0]) for q in step.parsed(read).collect())
                assert [i for i, _ in got] == [i for i, _ in want]
                assert [a.replace(" ", "") for _, a in got] == [a.replace(" ", "") for _, a in want]
            if size == "300b":
                assert spark.read.option("lineSep", ";").text(str(tmp_path / "one.ifc")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_tree_of_any_depth(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(10_000)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "gone")]
    tree = spark.createDataFrame(chain, "id string, parent string")
    kept = graph.tree_filter(tree, spark.createDataFrame([("9999",), ("b",), ("x",)], "id string"))
    assert kept.count() == 10_000 + 3 + 1 and kept.filter("matched").count() == 3
    kinds = tree.selectExpr("id", "parent", "CASE id WHEN '7' THEN 'low' WHEN '0' THEN 'top' END AS kind")
    got = {r["id"]: (r["low"], r["top"]) for r in graph.nearest_above(kinds, ["low", "top"]).collect()}
    assert got["9999"] == ("7", "0") and got["7"] == ("7", "0") and got["6"] == (None, "0") and got["a"] == got["x"] == (None, None)


def test_rows_that_become_texts_are_dealt_to_many_tasks(spark, tmp_path):
    from packgraph.plans import evidence, models
    from packgraph.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.orders.rdd.getNumPartitions() == 1
    for df in (models.statements(t), models.steel_objects(t), evidence.module_documents(t)):
        assert df.rdd.getNumPartitions() >= 4  # shuffle partitions of this session


def test_tables_of_a_model_are_made_when_they_are_asked_for(spark):
    from packgraph.plans import models
    from packgraph.plans.registry import Tables

    made = models._model(Tables(spark, "/root/testdata/sf0.001"))
    assert {n for n, _ in made._scratch.names.values()} == {"instances"}
    assert made.properties.count() and "elements" not in {n for n, _ in made._scratch.names.values()}


def test_usual_statements_are_looked_at_once_and_odd_ones_read_alike(spark):
    usual = "#7=IFCWALL('it''s',$,(#1,#2),IFCTEXT('a b'))"
    odd = ["  #7 = IFCWALL ('it''s',$,(#1,#2),IFCTEXT('a b')) ", "#7\n=IFCWALL( 'it''s' ,$ , (#1,#2),\r\nIFCTEXT('a b'))"]
    df = spark.createDataFrame([(x,) for x in [usual, *odd, "ENDSEC", "#8=", "#9=IFCWALL(", None]], "text string")
    rows = step.parsed(df)
    assert {(r["id"], r["type"], tuple(r["args"]), tuple(r["refs"])) for r in rows.collect()} == {(7, "IFCWALL", ("'it''s'", "$", "(#1,#2)", "IFCTEXT('a b')"), (1, 2))} and rows.count() == 3
    # A filter by a match would be evaluated apart from the columns, and references went through a function for each.
    plan = rows.select("id", "refs")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "lambda" not in plan


def test_values_of_all_forms(spark):
    forms = {"'a'": "a", "''": "", "'it''s'": "it's", "$": None, "*": None, ".T.": "true", ".F.": "false", "1.5": "1.5", "IFCTEXT('a (b)')": "a (b)", "IFCTEXT('')": "", "IFCTEXT('it''s')": "it's", "IFCX(IFCY('q'))": "q", "IFCX($)": None, "IFCX(.T.)": "true", "IFCX(2.)": "2.", "'\\X2\\AC15\\X0\\!'": "강!", "IFCTEXT('\\X2\\AC15\\X0\\')": "강"}
    df = spark.createDataFrame([(x,) for x in forms], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", step.scalar(df["t"]).alias("v")).collect()} == forms
