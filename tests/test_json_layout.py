"""JSON documents: every member is written once, strings with brackets and quotes stay whole."""

import json

from pyspark.sql import functions as F

from pagelens.operators.lint import JsonLayout, extract_json, json_text

LOCATOR = "struct<strategy:string,playwright:string,is_unique:boolean,disambiguation:string>"
NODE = (f"struct<kind:string,tag:string,role:string,in_shadow:boolean,frame_path:array<string>,form_group:string,accessible_name:string,primary_locator:{LOCATOR},"
        f"fallback_locators:array<{LOCATOR}>,properties:struct<type:string,placeholder:string,text_content:string,href:string,is_required:boolean,is_disabled:boolean,"
        "is_checked:boolean,is_visible:boolean>,context_note:string>")
SCHEMA = ("page_id long, schema_version string, page_metadata struct<title:string,url:string,captured_at:string,node_count:int,frame_count:int,truncated:boolean,notes:array<string>>, "
          f"interactive_nodes array<{NODE}>")


def test_items_are_written_once(spark):
    css = ("css", "[id=\"a\"]", False, "2 matches in frame.")
    node = ("element", "a", None, False, ["iframe#[x]"], None, "]]\"[[", css, [css, ("role", "r", True, None)], (None, "[", "]", "/z", None, False, None, True), None)
    page = (1, "1.1", ("[t]", "u", "c", 2, 1, False, ["[n]", "]"]), [node, node])
    rows = [page, page, (None, "1.1", (None, None, "c", 0, 1, False, []), [])]  # repeated and null keys stay
    out = extract_json(spark.createDataFrame(rows, SCHEMA))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform(interactive_nodes") == 1 and plan.count(".fallback_locators") == 2  # size and items
    docs = [(r["page_id"], json.loads(r["json"]), r["json"]) for r in out.collect()]
    assert sorted(str(i) for i, _, _ in docs) == ["1", "1", "None"]
    for i, doc, text in docs:
        assert json.dumps(doc, indent=2, ensure_ascii=False) == text
        if i:
            got = doc["interactive_nodes"][1]
            assert got["accessible_name"] == "]]\"[[" and got["frame_path"] == ["iframe#[x]"] and got["properties"]["placeholder"] == "["
            assert [x["strategy"] for x in got["fallback_locators"]] == ["css", "role"] and "disambiguation" not in got["fallback_locators"][1]
            assert doc["page_metadata"]["notes"] == ["[n]", "]"]


def test_text_and_empty_members(spark):
    df = spark.createDataFrame([("",), ("[]",), ("\"]",), ("\\",), (None,)], "c string")
    assert [json.loads(r[0]) for r in df.select(json_text(F.col("c"))).collect()] == ["", "[]", "\"]", "\\", None]
    lay = JsonLayout(False)
    assert df.select(lay.object(0, [], [("a", F.lit("1"), F.lit(None))])).first()[0] == "{}"
