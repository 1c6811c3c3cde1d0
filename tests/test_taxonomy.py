"""Taxonomy files as Spark reads them."""

from tidemark.sources import taxonomy
from tidemark.sources.markup import descendants

HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink">'
LOC = '<link:loc xlink:href="e.xsd#{}" xlink:label="{}"/>'
CAL = (
    HEAD + '<link:roleRef roleURI="r"/><link:calculationLink xlink:role="r">' + LOC.format("us-gaap_CostOfRevenue", "a") + LOC.format("us-gaap_CostOfGoodsSold", "b") + LOC.format("dei_Other", "o")
    + '<link:calculationArc xlink:from="a" xlink:to="b" weight="1.0"/><link:calculationArc xlink:from="a" xlink:to="o"/><link:calculationArc xlink:from="a" xlink:to="gone"/></link:calculationLink>'
    + "<link:calculationLink>" + LOC.format("us-gaap_Freight", "c") + '<link:calculationArc xlink:from="b" xlink:to="c" weight="-1"/><link:calculationArc xlink:from="b" xlink:to="c" weight="-1"/></link:calculationLink></link:linkbase>'
)
LAB = (
    HEAD + "<link:labelLink>" + LOC.format("us-gaap_Freight", "l")
    + f'<link:label xlink:label="t" xlink:role="{taxonomy.LABEL_ROLE}" xml:lang="en"> Freight &amp; handling </link:label><link:label xlink:label="t" xlink:role="{taxonomy.DOCUMENTATION_ROLE}">What it is.</link:label>'
    + '<link:labelArc xlink:from="l" xlink:to="t"/></link:labelLink></link:linkbase>'
)
XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:xbrli="http://www.xbrl.org/2003/instance"><xs:element name="Freight" type="xbrli:monetaryItemType" xbrli:periodType="duration" xbrli:balance="debit"/>
<xs:element name="Table" abstract="true"><xs:annotation/></xs:element><xs:element ref="x"/></xs:schema>"""


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), "year int, path string, text string")


def test_arcs_labels_elements(spark):
    docs = documents(spark, (2020, "cal", CAL), (2020, "lab", LAB), (2020, "xsd", XSD), (2021, "broken", "<link:linkbase"), (2021, "none", None), (2021, "text", "plain"))
    arcs = taxonomy.calculation_arcs(docs)
    assert sorted(tuple(r) for r in arcs.collect()) == [(2020, "CostOfGoodsSold", "Freight", -1.0), (2020, "CostOfRevenue", "CostOfGoodsSold", 1.0)]
    assert [tuple(r) for r in taxonomy.element_labels(docs).collect()] == [(2020, "Freight", "Freight & handling")]
    assert [r["label"] for r in taxonomy.element_labels(docs, taxonomy.DOCUMENTATION_ROLE).collect()] == ["What it is."]
    assert sorted(tuple(r) for r in taxonomy.elements(docs).collect()) == [(2020, "Freight", "duration", "debit", "xbrli:monetaryItemType", False), (2020, "Table", "", "", "", True)]
    below = descendants(arcs, spark.createDataFrame([("CostOfRevenue",)], "tag string"))
    assert {(r["tag"], r["depth"]) for r in below.collect()} == {("CostOfRevenue", 0), ("CostOfGoodsSold", 1), ("Freight", 2)}


def test_files_by_year_and_spans(spark, tmp_path):
    for year in (2009, 2010, 2012):
        folder = tmp_path / str(year) / "stm"
        folder.mkdir(parents=True)
        (folder / "x-cal.xml").write_text(CAL if year != 2010 else CAL.replace('weight="-1"', 'weight="1"'), encoding="utf-8")
    (tmp_path / "readme.txt").write_text("no year")
    docs = taxonomy.read_documents(spark, str(tmp_path))
    assert docs.count() == 3
    spans = {tuple(r[:3]): tuple(r[3:]) for r in taxonomy.year_spans(taxonomy.calculation_arcs(docs), ["parent", "child", "weight"]).collect()}
    assert spans == {("CostOfRevenue", "CostOfGoodsSold", 1.0): (2009, 2012, 2, "2009-2010 2012"), ("CostOfGoodsSold", "Freight", -1.0): (2009, 2012, 2, "2009 2012"), ("CostOfGoodsSold", "Freight", 1.0): (2010, 2010, 1, "2010")}
    assert taxonomy.calculation_arcs(documents(spark)).count() == 0
