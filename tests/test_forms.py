from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException

from ledgerleaf.model import FORM_FIELDS
from ledgerleaf.operators import content, fields, fill, validate
from ledgerleaf.plans import tools
from ledgerleaf.sources import files, forms, pdf

FORM = [
    {"name": "name", "type": "text", "value": "Ann (é)"},
    {"name": "must_agree", "type": "checkbox", "value": True},
    {"name": "colour", "type": "radio", "options": ["red", "blue"], "value": "blue"},
    {"name": "size*", "type": "dropdown", "options": ["S", "M"]},
    {"name": "a", "kids": [{"name": "b[0]", "type": "text", "value": "日本"}, {"name": "required", "type": "text", "value": " \t"}]},
    {"name": "send", "type": "button"},
    {"name": "many", "type": "list", "options": ["x"]},
]


@pytest.fixture(scope="module", params=[False, True])
def form(request, tmp_path_factory):
    path = tmp_path_factory.mktemp("forms") / "form.pdf"
    path.write_bytes(pdf.made(FORM, ["hello", "wor(ld)"], compressed=request.param))
    return path


def test_read(spark, form):
    rows = forms.read_forms(spark, str(form)).orderBy("field_ordinal").collect()
    assert [(r["field_name"], r["field_type"]) for r in rows] == [("name", "text"), ("must_agree", "checkbox"), ("colour", "radio"), ("size*", "dropdown"), ("a.b[0]", "text"), ("a.required", "text"), ("send", "unknown"), ("many", "unknown")]
    assert (rows[0]["text_value"], rows[1]["checked"], rows[2]["text_value"], rows[3]["selected"], rows[4]["text_value"]) == ("Ann (é)", True, "blue", [], "日本")


def test_read_fields(spark, form):
    got = {r["name"]: r for r in tools.call("read_pdf_fields", spark, str(form)).collect()}
    assert got["name"]["current_value"] == '"Ann (é)"' and got["must_agree"]["current_value"] == "true"
    assert got["size*"]["options"] == ["S", "M"] and got["size*"]["current_value"] == "[]"
    assert got["colour"]["options"] == [] and got["send"]["current_value"] == '""'


def test_validate(spark, form):
    r = tools.validate_pdf(spark, str(form)).first()
    assert (r["total"], r["filled"], r["empty"]) == (8, 5, 3)
    assert r["required"] == ["a.required"] and r["empty_fields"] == ["a.required", "send", "many"]
    text = validate.report_text(tools.validate_pdf(spark, str(form))).first()["report"]
    assert text.startswith("PDF Validation Report for: form.pdf\nTotal fields: 8\nFilled: 5\nEmpty: 3\n") and text.endswith("Empty fields:\na.required\nsend\nmany")


def test_fill(spark, form, tmp_path):
    out = tmp_path / "out" / "filled.pdf"
    data = {"name": None, "must_agree": 1, "colour": "red", "size*": "M", "a.b[0]": True, "send": "x", "nobody": "y"}
    r = tools.fill_pdf(spark, str(form), str(out), data).first()
    assert (r["n_filled"], r["n_errors"]) == (6, 1) and "'nobody' not found" in r["errors"][0]
    got = {x["field_name"]: x for x in pdf.form_rows(out.read_bytes())}
    assert got["name"]["text_value"] == "null" and got["must_agree"]["checked"] is False and got["colour"]["text_value"] == "red"
    assert got["size*"]["selected"] == ["M"] and got["a.b[0]"]["text_value"] == "true"
    assert pdf.page_count(out.read_bytes()) == 2


def test_bulk(spark, form, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_text("who,name,must_agree,fax\nx,A,yes,1\n,B,no,2\nx,C,,3\n../up,D,,4", encoding="utf-8")
    rows = tools.bulk_fill_from_csv(spark, str(form), str(csv), str(tmp_path / "out"), "who").collect()
    assert [(r["filename"], r["n_filled"], r["kept"]) for r in rows] == [("x.pdf", 2, False), ("filled_2.pdf", 2, True), ("x.pdf", 2, True), ("../up.pdf", 2, True)]
    assert rows[3]["error"] and not (tmp_path / "up.pdf").exists()
    got = {x["field_name"]: x for x in pdf.form_rows((tmp_path / "out" / "x.pdf").read_bytes())}
    assert got["name"]["text_value"] == "C" and got["must_agree"]["checked"] is False


def test_profiles(spark, form, tmp_path):
    root = str(tmp_path / "p")
    tools.save_profile("work", {"name": "é", "colour": "red"}, root)
    assert tools.load_profile(spark, "work", root).first()["json"] == '{\n  "name": "é",\n  "colour": "red"\n}'
    assert [r["profile_name"] for r in tools.list_profiles(spark, root).collect()] == ["work"]
    out = tmp_path / "o.pdf"
    assert tools.fill_with_profile(spark, str(form), str(out), "work", {"colour": "blue"}, root=root).first()["n_filled"] == 2
    assert {x["field_name"]: x["text_value"] for x in pdf.form_rows(out.read_bytes())}["colour"] == "blue"
    with pytest.raises(files.OutsideRoot):
        tools.save_profile("../x", {}, root)


def test_extract(spark, form, tmp_path):
    other = tmp_path / "b.pdf"
    other.write_bytes(pdf.made([{"name": "Z", "type": "text", "value": 'q"q'}, {"name": "name", "type": "text"}]))
    out = tmp_path / "o.csv"
    r = tools.extract_to_csv(spark, [str(form), str(other), str(other)], str(out)).first()
    assert (r["n_forms"], r["n_fields"]) == (3, 9)
    lines = out.read_text(encoding="utf-8").split("\n")
    assert lines[0] == "_filename,Z,a.b[0],a.required,colour,many,must_agree,name,send,size*"
    assert lines[1] == '"form.pdf","","日本"," \t","blue","","yes","Ann (é)","",""'
    assert lines[2] == lines[3] == '"b.pdf","q"q","","","","","","","",""'


def test_names_that_differ_by_case_or_clash(spark):
    rows = spark.createDataFrame([("d/f", 0, "a", "text", None, "1", None, None, None), ("d/f", 1, "A", "text", None, "2", None, None, None), ("d/f", 2, "_filename", "text", None, "g", None, None, None)], FORM_FIELDS)
    assert fields.header(rows) == ["A", "_filename", "a"]
    assert fields.extract_lines(rows).first()["line"] == '"g","2","g","1"'


def test_content(spark, form, tmp_path):
    r = tools.read_pdf_content(spark, str(form)).first()
    assert (r["pages"], r["text"], r["text_length"], r["is_blank"], r["error"]) == (2, "hello\n\nwor(ld)", 14, False, None)
    blank = tmp_path / "blank.pdf"
    blank.write_bytes(pdf.made([]))
    r = tools.read_pdf_content(spark, str(blank)).first()
    assert r["is_blank"] and r["scale"] == 1.5 and tools.read_pdf_fields(spark, str(blank)).count() == 0
    uri = tools.get_pdf_resource_uri(spark, str(form)).first()
    assert uri["uri"] == f"pdf://{form}" and uri["file"] == "form.pdf"
    import base64

    assert base64.b64decode(tools.read_resource(spark, uri["uri"]).first()["blob"]) == form.read_bytes()
    with pytest.raises(ValueError, match="Unsupported resource URI"):
        tools.read_resource(spark, "http://x")
    assert tools.list_resources(spark).count() == 0
    with pytest.raises(tools.UnknownTool):
        tools.call("none")


def test_listing(spark, tmp_path):
    for n in ("a.pdf", "B.PDF", ".h.pdf", "_u.pdf", "n.txt"):
        (tmp_path / n).write_text("")
    (tmp_path / "dir.pdf").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_text("")
    assert sorted(r["path"].rpartition("/")[2] for r in tools.list_pdfs(spark, str(tmp_path)).collect()) == [".h.pdf", "B.PDF", "_u.pdf", "a.pdf", "dir.pdf"]


def test_unreadable(spark, tmp_path):
    with pytest.raises(pdf.PdfError):
        pdf.Pdf.read(b"no")
    locked = pdf.made(FORM).replace(b"/Size", b"/Encrypt <<>> /Size")
    with pytest.raises(pdf.PasswordProtected):
        pdf.Pdf.read(locked)
    with pytest.raises(pdf.Unsupported):
        pdf.raster(b"")
    path = tmp_path / "x.pdf"
    path.write_bytes(locked)
    assert "password" in tools.read_pdf_content(spark, str(path)).first()["error"]
    with pytest.raises(PySparkException, match="password"):
        forms.read_forms(spark, str(path)).collect()


def test_predictors():
    rows = [bytes([k * 3 % 256 for k in range(j, j + 5)]) for j in range(4)]
    coded, above = b"", bytes(5)
    for kind, row in zip((0, 1, 2, 4), rows, strict=True):
        line = []
        for i, x in enumerate(row):
            a, b, c = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            p = a + b - c
            line.append((x - (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind]) % 256)
        coded, above = coded + bytes([kind, *line]), row
    assert pdf.unpredicted(coded, {"Predictor": 15, "Columns": 5}) == b"".join(rows)


def test_total_is_filled_and_empty(spark):
    rng = random.Random(2)
    kinds = ("text", "checkbox", "radio", "dropdown", "unknown")
    rows = [(f"f{i % 7}", i, f"n{i}", rng.choice(kinds), None, rng.choice([None, "", " ", "x"]), rng.choice([None, True]), rng.choice([None, [], ["a"]]), rng.choice([None, None, "bad"])) for i in range(300)]
    for r in validate.validate(spark.createDataFrame(rows, FORM_FIELDS)).collect():
        assert r["total"] == r["filled"] + r["empty"] and len(r["empty_fields"]) == r["empty"]


@pytest.mark.parametrize(("n", "shown", "more"), [(0, "", 0), (10, "\n".join(f"f{k}" for k in range(10)), 0), (11, "\n".join(f"f{k}" for k in range(10)), 1)])
def test_first_ten(spark, n, shown, more):
    report = spark.createDataFrame([("x", [f"f{k}" for k in range(n)])], "file string, empty_fields array<string>")
    r = validate.first_empty(report).first()
    assert (r["first_empty"], r["more"]) == (shown, more)


def test_empty_tables(spark):
    empty = forms.layout(spark)
    assert validate.validate(empty).count() == fields.read_fields(empty).count() == fields.extract_lines(empty).count() == fields.extract_wide(empty).count() == 0
    assert fill.fill(spark.createDataFrame([], "row long, ordinal int, field_name string, value string, value_kind string"), empty).count() == 0


def test_path_of(spark):
    df = spark.createDataFrame([("pdf:///a/b.pdf",)], "u string")
    assert df.select(content.path_of(df.u)).first()[0] == "/a/b.pdf"


def test_catalogue(spark):
    assert len(tools.CATALOGUE) == 12 and all(t["description"] for t in tools.CATALOGUE.values())
    takes = tools.CATALOGUE["fill_pdf"]["inputSchema"]
    assert takes["required"] == ["pdf_path", "output_path", "field_data"] and list(takes["properties"]) == [*takes["required"], "password"]
    assert takes["type"] == "object" and takes["properties"]["field_data"]["type"] == "object" and takes["properties"]["password"]["type"] == "string"
    assert tools.CATALOGUE["extract_to_csv"]["inputSchema"]["properties"]["pdf_paths"] == {"type": "array", "items": {"type": "string"}, "description": "pdf paths"}
    assert tools.CATALOGUE["list_profiles"]["inputSchema"] == {"type": "object", "properties": {}, "required": []}
    assert tools.respond("nothing") == "Error: Unknown tool: nothing"
    assert tools.respond("validate_pdf", spark, "/no/such.pdf", password="x").startswith("Error: ")


def test_text_of_fonts():
    assert pdf.page_texts(pdf.made([], ["plain (x)", "日本 – é 🙂\u2028", ""])) == ["plain (x)", "日本 – é 🙂\u2028", ""]
    assert [pdf.letters_of(x) for x in ("eacute", "Udieresis", "A", "fi", "uni20AC0041", "u1F642", "germandbls", "one.alt", "nothing")] == ["é", "Ü", "A", "fi", "€A", "🙂", "ß", "1", ""]
    ranges = pdf.unicode_map(b"2 beginbfrange <0003> <0005> <0041>\n<10><11> [<0078> <D83DDE42>] endbfrange 1 beginbfchar <01> <00660069> endbfchar")
    assert ranges == {b"\0\3": "A", b"\0\4": "B", b"\0\5": "C", b"\x10": "x", b"\x11": "🙂", b"\1": "fi"}
    doc = pdf.Pdf(b"")
    simple = pdf.Font(doc, {"Subtype": pdf.Name("Type1"), "Encoding": {"BaseEncoding": pdf.Name("WinAnsiEncoding"), "Differences": [65, pdf.Name("eacute"), pdf.Name("Euro"), 200, pdf.Name("fi")]}})
    assert simple.read(b"AB C\x80\xc8") == "é€ C€fi"
    assert pdf.Font(doc, {"Subtype": pdf.Name("TrueType"), "Encoding": pdf.Name("MacRomanEncoding")}).read(b"\x8e") == "é"
    assert pdf.Font(doc, {"Subtype": pdf.Name("Type0"), "Encoding": pdf.Name("Identity-H")}).read(b"\0\1\0\2") == ""
    drawn = pdf.Stream({"Subtype": pdf.Name("Form"), "Resources": {"Font": {"G": {"Subtype": pdf.Name("Type1"), "Encoding": {"Differences": [1, pdf.Name("x")]}}}}}, b"BT /G 1 Tf <0101> Tj ET")
    assert pdf.shown(doc, b"BT (a) Tj ET /X Do BT [(b) -300 (c)] TJ ET", {"XObject": {"X": drawn}}, {}) == ["a", "xx", "b c"]


def test_files_of_any_store(spark, tmp_path):
    from ledgerleaf.sinks import files as sinks

    root = f"file://{tmp_path}/far"
    sinks.put(f"{root}/a/x.pdf", b"1"), sinks.put(f"{root}/a/x.pdf", b"22"), sinks.put(f"{root}/a/.Y.PDF", b"3")
    assert files.whole(f"{root}/a/x.pdf") == b"22" and sorted(p.name for p in (tmp_path / "far" / "a").iterdir()) == [".Y.PDF", "x.pdf"]
    assert sorted(r["path"].rpartition("/")[2] for r in files.list_directory(spark, f"{root}/a").collect()) == [".Y.PDF", "x.pdf"]
    assert files.inside(root, "b/c") == f"{root}/b/c" and files.resolve("s3://b/k") == "s3://b/k"
    with pytest.raises(files.OutsideRoot):
        files.inside(root, "../c")
    with pytest.raises(RuntimeError), sinks.opened(str(tmp_path / "z")) as f:
        f.write(b"half")
        raise RuntimeError
    assert not [p for p in tmp_path.iterdir() if p.is_file()]
    tools.save_profile("n", {"a": 1}, f"{root}/p")
    assert tools.load_profile(spark, "n", f"{root}/p").first()["json"] == '{\n  "a": 1\n}'


def test_csv_in_parts(spark, tmp_path):
    from ledgerleaf.sinks import files as sinks

    rows = spark.createDataFrame([(f"d/f{k}", 0, "a", "text", None, str(k), None, None, None) for k in range(30)], FORM_FIELDS).repartition(3)
    sinks.write_csv_parts(rows, str(tmp_path / "o"))
    assert (tmp_path / "o" / "header.csv").read_text() == "_filename,a"
    assert {r["value"] for r in spark.read.text(str(tmp_path / "o" / "lines")).collect()} == {f'"f{k}","{k}"' for k in range(30)}


def test_json_keys_keep_their_order(spark):
    df = spark.createDataFrame([(1, '{"z": 1, "a": null, "10": "x", "2": true, "m": {"q": [1]}}'), (2, "{}")], "k long, field_data string")
    got = [(r["ordinal"], r["field_name"], r["value"], r["value_kind"]) for r in fill.json_values(df, "k").orderBy("ordinal").collect()]
    assert got == [(0, "2", "true", "boolean"), (1, "10", "x", "string"), (2, "z", "1", "number"), (3, "a", None, "null"), (4, "m", '{"q":[1]}', "json")]


def test_arrivals(spark, tmp_path):
    from ledgerleaf.streaming import arrivals

    (tmp_path / "in").mkdir()
    seen = []
    for k in range(2):
        (tmp_path / "in" / f"f{k}.PDF").write_bytes(pdf.made(FORM[:1]))
        (tmp_path / "in" / f"f{k}.txt").write_bytes(b"no")
        arrivals(spark, str(tmp_path / "in"), lambda df, _: seen.append(forms.pdf_fields(df).count()), str(tmp_path / "c")).awaitTermination(60)
    assert sum(seen) == 2
