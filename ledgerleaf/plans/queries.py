"""Queries over tables whose rows stand for filled forms, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import indented, json_string, utf16_length
from ..operators import content, fields, fill, validate
from ..session import new_folder
from ..sinks import committed
from ..sinks import files as sinks
from ..sources import csv_text, files, forms, pdf
from . import tools


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- stand-ins for forms


def document_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return forms.from_table(
        rows,
        F.col("doc_id"),
        [forms.field("text_required", "text", F.col("text")), forms.field("lang", "dropdown", F.col("lang")), forms.field("quality_must", "text", F.col("quality")), forms.field("toxic*", "text", F.col("toxic"))],
    )


def customer_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return forms.from_table(rows, F.concat(F.lit("c/"), F.col("c_custkey")), [forms.field("Name", "text", F.col("c_name")), forms.field("Segment", "dropdown", F.col("c_mktsegment")), forms.field("Rich", "checkbox", F.col("c_acctbal") > 0), forms.field("Sign", "unknown")])


def supplier_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    return forms.from_table(rows, F.concat(F.lit("s/"), F.col("s_suppkey")), [forms.field("Name", "text", F.col("s_name")), forms.field("Nation", "radio", F.col("s_nationkey"))])


def both_forms(spark: SparkSession, d: str) -> DataFrame:
    return fields.union_forms(customer_forms(spark, d), supplier_forms(spark, d))


def template(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("form",)], "f string")
    return forms.from_table(rows, F.col("f"), [forms.field("name", "text"), forms.field("rich", "checkbox"), forms.field("segment", "radio", options=["BUILDING", "AUTOMOBILE", "MACHINERY"]), forms.field("stamp", "unknown"), forms.field("pick", "dropdown", options=["a"])])


# ---- queries


def validate_forms(spark: SparkSession, d: str) -> DataFrame:
    report = validate.validate(document_forms(spark, d))
    return report.select("file", "total", "filled", "empty", F.size("required").cast("long").alias("required_empty"))


def validate_first_empty(spark: SparkSession, d: str) -> DataFrame:
    return validate.first_empty(validate.validate(document_forms(spark, d)), 1)


def extract_wide(spark: SparkSession, d: str) -> DataFrame:
    return fields.extract_wide(both_forms(spark, d))


def extract_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return fields.extract_lines(both_forms(spark, d))


def field_names(spark: SparkSession, d: str) -> DataFrame:
    return fields.field_names(both_forms(spark, d))


def read_fields(spark: SparkSession, d: str) -> DataFrame:
    return fields.read_fields(both_forms(spark, d)).select("file", "name", "type", F.array_join("options", "|").alias("options"), "current_value")


def field_counts(spark: SparkSession, d: str) -> DataFrame:
    return fields.field_counts(both_forms(spark, d))


def naive_csv(spark: SparkSession, d: str) -> DataFrame:
    return csv_text.parse(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "row", "header", "value")


def _customer_values(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    pairs = F.map_from_arrays(F.array(*map(F.lit, ("name", "rich", "segment", "stamp", "pick", "fax"))), F.array(c("c_name"), F.when(c("c_acctbal") > 5000, "yes").when(c("c_acctbal") > 0, "TRUE").otherwise("1"), c("c_mktsegment"), F.lit("x"), F.lit("b"), F.lit("")))
    return fill.values(table(spark, d, "customer").select("c_custkey", pairs.alias("record")), "c_custkey")


def fill_values(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill(_customer_values(spark, d), template(spark)).select(F.col("row").alias("c_custkey"), "field_name", "status", "new_value", "error")


def fill_status(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_status(fill.fill(_customer_values(spark, d), template(spark))).select(F.col("row").alias("c_custkey"), "n_filled", "n_errors", F.array_join("errors", "\n").alias("errors"))


def fill_json_kinds(spark: SparkSession, d: str) -> DataFrame:
    json = F.concat(F.lit('{"rich": '), F.expr("element_at(array('true', '1', '\"yes\"', 'null', '\"TRUE\"', 'false'), cast(c_custkey % 6 as int) + 1)"), F.lit(', "name": '), F.expr("element_at(array('null', 'true', '12', '\"x\"'), cast(c_custkey % 4 as int) + 1)"), F.lit("}"))
    data = fill.json_values(table(spark, d, "customer").select("c_custkey", json.alias("field_data")), "c_custkey")
    return fill.fill(data, template(spark)).select(F.col("row").alias("c_custkey"), "field_name", "status", "new_value")


def bulk_fill_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("row"), F.when(F.col("o_orderstatus") != "P", F.concat("o_orderstatus", (F.col("o_custkey") % 100).cast("string"))).otherwise("").alias("named"))
    return fill.last_writes(rows.select("row", fill.output_name(F.col("named"), F.col("row")).alias("filename")))


def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    base = F.create_map(F.lit("name"), c("c_name"), F.lit("segment"), c("c_mktsegment"), F.lit("note"), F.lit("base"))
    over = F.create_map(F.lit("segment"), F.concat(F.lit("S-"), c("c_mktsegment")), F.lit("extra"), c("c_nationkey").cast("string"))
    rows = fill.merge_profiles(table(spark, d, "customer").select("c_custkey", base.alias("a"), over.alias("b")), "a", "b")
    return rows.select("c_custkey", F.posexplode(F.map_entries("field_data")).alias("position", "e")).select("c_custkey", "position", F.col("e.key").alias("field"), F.col("e.value").alias("value"))


def list_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.expr("element_at(array('.pdf', '.PDF', '.txt', '.pdf.bak', '.Pdf'), cast(p_partkey % 5 as int) + 1)"))
    return content.listed(table(spark, d, "part").select("p_partkey", name.alias("name")), "name")


def list_profile_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.expr("element_at(array('.json', '.JSON', '.jsonb.json', '.json.json'), cast(p_partkey % 4 as int) + 1)"))
    return content.profile_names(table(spark, d, "part").select(name.alias("name")), "name")


def content_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/docs/"), "doc_id", F.lit(".pdf")).alias("path"), "text", F.octet_length("text").alias("n"))
    out = content.content_stats(rows, "path", "text", "n")
    return out.select("file", "size_kb", "text_length", "is_blank")


def resource_blobs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.concat(F.lit("/docs/"), "doc_id", F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"))
    return content.resources(rows, "path", "content").select("uri", "mime_type", F.md5("blob").alias("blob_md5"), F.length("blob").cast("long").alias("blob_length"))


def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Conversation texts as field names: which of them count as required."""
    from ..functions.text import is_required

    return table(spark, d, "conversations").select("conv_id", "turn", is_required(F.coalesce(F.concat("text", F.when(F.col("turn") % 3 == 0, "Must").when(F.col("turn") % 5 == 0, "*").otherwise("")), F.lit(""))).alias("required"), utf16_length(F.coalesce("text", F.lit(""))).alias("units"))


# ---- queries through files


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _made(kind: list[dict], names: list[str]):
    """Bytes of a form with these fields, whose values are the columns' in order, and a page of the last column's text; encrypted if that is null."""

    @F.arrow_udf("binary")
    def made(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for at in range(0, len(columns[0]), forms.FEW):
                out = []
                for *values, page in zip(*(c.slice(at, forms.FEW).to_pylist() for c in columns), strict=True):
                    data = pdf.made([f | {"value": v} for f, v in zip(kind, values, strict=True)], [page or "", page or ""])
                    out.append(data if page is not None else data.replace(b"trailer\n<<", b"trailer\n<</Encrypt 999 0 R "))
                yield pa.array(out, pa.binary())

    return made(*names)


def customer_pdfs(spark: SparkSession, d: str) -> DataFrame:
    """path and content of a PDF form for each customer; every fourth has blank pages, every seventh is encrypted."""
    c = F.col
    kind = [{"name": "Name", "type": "text"}, {"name": "Segment", "type": "dropdown", "options": SEGMENTS}, {"name": "Rich", "type": "checkbox"}, {"name": "Plan", "type": "radio", "options": ["basic", "plus"]}, {"name": "Sign", "type": "button"}]
    plan = F.expr("element_at(array(cast(null as string), 'basic', 'plus'), cast(c_custkey % 3 as int) + 1)")
    page = F.when(c("c_custkey") % 7 == 0, F.lit(None)).when(c("c_custkey") % 4 == 0, " ").otherwise(F.concat(c("c_name"), F.lit(" – "), c("c_mktsegment"), F.lit(" é日🙂")))
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", (c("c_acctbal") > 0).alias("rich"), plan.alias("plan"), F.lit(None).cast("string").alias("sign"), page.alias("page"))
    # making and parsing forms is the work, not reading the table; more tasks than cores, so that the slowest doesn't hold up the rest
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "c_custkey")
    return rows.select(F.concat(F.lit("/c/"), "c_custkey", F.lit(".pdf")).alias("path"), _made(kind, ["c_name", "c_mktsegment", "rich", "plan", "sign", "page"]).alias("content"), (c("c_custkey") % 7 == 0).alias("locked"))


def pdf_fields(spark: SparkSession, d: str) -> DataFrame:
    found = forms.pdf_fields(customer_pdfs(spark, d).where("not locked"))
    return fields.read_fields(found).select("file", "field_ordinal", "name", "type", F.array_join("options", "|").alias("options"), "current_value")


def pdf_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every form filled with new values, and read again."""

    @F.arrow_udf("binary")
    def filled(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for at in range(0, len(columns[0]), forms.FEW):
                yield pa.array([pdf.filled(x.as_py(), {"Name": n.as_py(), "Rich": r.as_py(), "Plan": "plus", "Segment": "HOUSEHOLD", "Sign": "x"}) for x, n, r in zip(*(c.slice(at, forms.FEW) for c in columns), strict=True)], pa.binary())

    key = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    rows = customer_pdfs(spark, d).where("not locked").select("path", "content", F.concat(F.lit("é-"), key).alias("name"), F.when(key % 2 == 0, "yes").otherwise("no").alias("rich"))
    return fields.extract_long(forms.pdf_fields(rows.select("path", filled("content", "name", "rich").alias("content"))))


def pdf_contents(spark: SparkSession, d: str) -> DataFrame:
    read = forms.contents(customer_pdfs(spark, d))
    return content.content_stats(read, "path", "text", "n_bytes", "pages", "text", "error").select("file", F.coalesce("pages", F.lit(0)).alias("pages"), "text_length", "is_blank", "text", "error")


def content_scale(spark: SparkSession, d: str) -> DataFrame:
    """The scale of a picture of every document's size, as if all were blank."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/docs/"), "doc_id", F.lit(".pdf")).alias("path"), F.lit(" ").alias("text"), F.octet_length("text").alias("n"))
    return content.content_stats(rows, "path", "text", "n").select("file", "size_kb", "is_blank", "scale")


def uri_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", content.resource_uri(F.concat(F.lit("/docs/pdf://"), "doc_id", F.lit(".pdf"))).alias("uri"))
    return rows.select("doc_id", "uri", content.path_of(F.col("uri")).alias("path"))


def long_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms of fourteen fields, of which the first (custkey mod 15) are empty."""
    value = lambda i: F.when(F.col("c_custkey") % 15 <= i, F.col("c_name")).otherwise(" \u00a0")
    named = [f"f{i:02d}" + ("*" if i == 3 else " Required" if i == 7 else "") for i in range(14)]
    return forms.from_table(table(spark, d, "customer"), F.concat(F.lit("d/"), F.col("c_custkey")), [forms.field(n, "text", value(i)) for i, n in enumerate(named)])


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    return validate.report_text(validate.validate(long_forms(spark, d)))


def first_ten_empty(spark: SparkSession, d: str) -> DataFrame:
    return validate.first_empty(validate.validate(long_forms(spark, d)))


def extract_counts(spark: SparkSession, d: str) -> DataFrame:
    return both_forms(spark, d).agg(F.count_distinct("file").alias("n_forms"), F.count_distinct("field_name").alias("n_fields"))


def list_counts(spark: SparkSession, d: str) -> DataFrame:
    return list_by_suffix(spark, d).agg(F.count(F.lit(1)).alias("n_files"))


def bulk_fill_written(spark: SparkSession, d: str) -> DataFrame:
    """A form written for each supplier, named by nation, so that later ones overwrite earlier ones; and what the files hold."""
    c, folder = F.col, new_folder(spark)
    record = F.create_map(F.lit("name"), c("s_name"), F.lit("rich"), F.when(c("s_acctbal") > 0, "yes").otherwise("off"), F.lit("as"), F.concat(F.lit("n"), c("s_nationkey")), F.lit("fax"), F.lit("1"))
    records = table(spark, d, "supplier").select(c("s_suppkey").cast("long").alias("row"), record.alias("record"))
    data = pdf.made([{"name": "name", "type": "text"}, {"name": "rich", "type": "checkbox"}])
    form = spark.createDataFrame([("form.pdf", data)], "path string, content binary")
    blank = forms.pdf_fields(form)
    done = sinks.write_forms(fill.fill(fill.values(records, "row"), blank), fill.bulk_fill(records, blank, "as"), data, folder)
    failed = done.where("error is not null").count()
    if failed:
        raise OSError(f"{failed} forms could not be written")
    found = forms.pdf_fields(spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))
    return fields.extract_wide(found, ["name", "rich"])


# ---- forms that lack fields, batches, many names


def bare_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms of customers, some without one of three fields, and every fifth without any."""
    c, key = F.col, F.col("c_custkey")
    some = [F.when(key % 5 != 0, forms.field("Name*", "text", F.when(key % 4 != 0, c("c_name")))), F.when((key % 5 != 0) & (key % 3 == 0), forms.field("Segment", "dropdown", c("c_mktsegment"))), F.when((key % 5 != 0) & (key % 2 == 0), forms.field("Rich", "checkbox", c("c_acctbal") > 0))]
    return forms.from_table(table(spark, d, "customer"), F.concat(F.lit("c/"), key), some, some=True)


def validate_bare_forms(spark: SparkSession, d: str) -> DataFrame:
    report = validate.validate(bare_forms(spark, d))
    return report.select("file", "total", "filled", "empty", F.array_join("required", "\n").alias("required"), F.array_join("empty_fields", "\n").alias("empty_fields"))


def extract_bare_lines(spark: SparkSession, d: str) -> DataFrame:
    return fields.extract_lines(bare_forms(spark, d))


def bare_field_counts(spark: SparkSession, d: str) -> DataFrame:
    return fields.field_counts(bare_forms(spark, d))


def _order_paths(spark: SparkSession, d: str) -> DataFrame:
    """A list of paths, the form of each order's customer: many a form is listed more than once."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("c/"), F.col("o_custkey")).alias("path"))


def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many forms a batch has, repeated paths and forms without fields included, and how many distinct names."""
    return fields.counts(fields.batch(_order_paths(spark, d), bare_forms(spark, d)))


def batch_csv_written(spark: SparkSession, d: str) -> DataFrame:
    """The batch extracted into one file by many writers, and read again in byte ranges: its lines, and what the tool says of it."""
    path = f"{new_folder(spark)}/out.csv"
    said = tools.extract_table_to_csv(_order_paths(spark, d), bare_forms(spark, d), path)
    return csv_text.numbered_lines(spark, path).select("number", "line", *[F.lit(v).alias(c) for c, v in said.first().asDict().items()])


def summary_of_long_forms(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(long_forms(spark, d))


def conversation_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a form, its turns as fields that are called by turn and role."""
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    null = F.lit(None)
    return rows.select(F.concat(F.lit("v/"), "conv_id").alias("file"), F.col("turn").cast("int").alias("field_ordinal"), F.concat(F.col("role"), F.lit("-"), F.col("turn")).alias("field_name"), F.lit("text").alias("field_type"), null.cast("array<string>").alias("options"), F.md5("text").alias("text_value"), null.cast("boolean").alias("checked"), null.cast("array<string>").alias("selected"), null.cast("string").alias("read_error"))


def sparse_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = conversation_forms(spark, d)
    names = fields.numbered_names(rows)
    return fields.sparse_lines(rows, names, names.count())


def text_positions(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all conversations as field names, in their order."""
    rows = table(spark, d, "conversations").select(F.coalesce("text", F.lit("")).alias("field_name"))
    return fields.numbered_names(rows)


# ---- files written by tasks


def csv_written(spark: SparkSession, d: str) -> DataFrame:
    """The extracted table of all suppliers as one file, read again as lines."""
    path = f"{new_folder(spark)}/out.csv"
    sinks.write_csv(supplier_forms(spark, d), path)
    return csv_text.numbered_lines(spark, path).select(F.col("number").cast("int").alias("position"), "line")


def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of such a file of customers and suppliers, read in byte ranges."""
    path = f"{new_folder(spark)}/out.csv"
    sinks.write_csv(both_forms(spark, d), path)
    return csv_text.read(spark, path).select("row", F.explode("record").alias("header", "value"))


def profiles_written(spark: SparkSession, d: str) -> DataFrame:
    """A profile saved for each supplier, named so that later ones replace earlier ones, then listed and read again."""
    folder, c = new_folder(spark), F.col
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("json"))
    held = F.array(entry("name", json_string(F.concat("s_name", F.lit(' é"\\')))), entry("nation", c("s_nationkey").cast("string")), entry("ok", (c("s_nationkey") % 2 == 0).cast("string")), entry("none", F.lit("null")))
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), c("s_nationkey"), F.lit("-"), c("s_suppkey") % 7).alias("profile_name"), indented(held).alias("json"))
    tools.save_profiles(rows, folder, order="s_suppkey")
    texts = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    texts = texts.select(F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), "\\.json$", "").alias("profile_name"), "json")
    return tools.call("list_profiles", spark, folder).join(texts, "profile_name")


def filled_with_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile saved for each nation, and every customer's form filled with that of theirs and data of their own."""
    folder, c = new_folder(spark), F.col
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("json"))
    held = F.array(entry("segment", F.lit('"BUILDING"')), entry("name", json_string(c("n_name"))), entry("rich", (c("n_nationkey") % 2 == 0).cast("string")), entry("7", F.lit("null")))
    named = F.concat("n_name", F.lit(".json"), "n_nationkey").alias("profile_name")
    tools.save_profiles(table(spark, d, "nation").select(named, indented(held).alias("json")), folder)
    own = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit('{"segment": '), json_string(c("c_mktsegment")), F.lit(', "fax": 1, "3": true}')))
    nation = table(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), named)
    requests = table(spark, d, "customer").join(nation, "c_nationkey").select(c("c_custkey").alias("row"), "profile_name", own.alias("additional_data"))
    done = tools.fill_with_profiles(requests, tools.load_profiles(spark, folder), template(spark))
    return done.select(c("row").alias("c_custkey"), "n_filled", "n_errors", F.array_join("errors", "\n").alias("errors"))


def resources_written(spark: SparkSession, d: str) -> DataFrame:
    """Two files for each nation, of which one counts as a form; listed, and read as resources."""
    folder, c = new_folder(spark), F.col
    nation = table(spark, d, "nation")
    kept = nation.select(F.concat("n_nationkey", F.when(c("n_nationkey") % 2 == 1, ".PDF").otherwise(".pdf")).alias("name"), F.encode(F.concat("n_name", F.lit(" é")), "UTF-8").alias("content"))
    committed.write_files(kept.unionByName(nation.select(F.concat("n_nationkey", F.lit(".txt")).alias("name"), F.lit(b"no form").alias("content"))), folder)
    listed = tools.call("list_pdfs", spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    read = files.read_bytes(spark, folder)
    blobs = content.resources(read.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"), "path", "content")
    sizes = read.select(F.element_at(F.split("path", "/"), -1).alias("file"), content.size_kb(F.col("length")).alias("size_kb"))
    return listed.join(sizes, "file").join(blobs.select(content.path_of(F.col("uri")).alias("file"), "uri", "mime_type", "blob"), "file")


def _supplier_files(spark: SparkSession, d: str) -> str:
    """A folder with a file for each supplier but every seventh: the name, repeated by the nation's key."""
    folder, c = new_folder(spark), F.col
    rows = table(spark, d, "supplier").where(c("s_suppkey") % 7 != 0)
    committed.write_files(rows.select(_file_name().alias("name"), F.encode(F.repeat("s_name", c("s_nationkey")), "UTF-8").alias("content")), folder)
    return folder


def _file_name():
    return F.concat(F.when(F.col("s_suppkey") % 5 == 0, ".").otherwise(""), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".pdf").when(F.col("s_suppkey") % 3 == 0, ".PDF").otherwise(".pdf.txt"))


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of suppliers, hidden ones among them, listed by the tool."""
    return tools.call("list_pdfs", spark, _supplier_files(spark, d)).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def resource_table(spark: SparkSession, d: str) -> DataFrame:
    """The resources of all suppliers, of which some have no file and some another scheme."""
    folder, c = _supplier_files(spark, d).removeprefix("file://"), F.col
    uri = F.concat(F.when(c("s_suppkey") % 11 == 0, "http://").otherwise("pdf://"), F.lit(folder + "/"), _file_name())
    read = tools.read_resources(table(spark, d, "supplier").select(uri.alias("uri")))
    gone = lambda x: F.replace(x, F.lit(folder), F.lit("/x"))
    return read.select(gone(c("uri")).alias("uri"), "mime_type", F.md5("blob").alias("blob_md5"), gone(c("error")).alias("error"))


def resource_uris(spark: SparkSession, d: str) -> DataFrame:
    folder = _supplier_files(spark, d).removeprefix("file://")
    read = tools.get_pdf_resource_uris(table(spark, d, "supplier").select(F.concat(F.lit(folder + "/"), _file_name()).alias("path")))
    gone = lambda x: F.replace(F.col(x), F.lit(folder), F.lit("/x")).alias(x)
    return read.select(gone("path"), gone("uri"), "file", "size_kb", gone("error"))


def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace("p_name", " ", "/")
    path = F.concat(F.expr("element_at(array('~/', '~', '/', '', '../', './../x/.././', 's3://'), cast(p_partkey % 7 as int) + 1)"), name)
    return table(spark, d, "part").select("p_partkey", path.alias("path"), files.resolved(path, "/home/u", "/work/dir").alias("full"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (validate_forms, validate_first_empty, extract_wide, extract_csv_lines, field_names, read_fields, field_counts, naive_csv, fill_values, fill_status, fill_json_kinds, bulk_fill_files, profile_merge, list_by_suffix, list_profile_names, content_stats, resource_blobs, required_fields,
        pdf_fields, pdf_fill, pdf_contents, content_scale, uri_paths, report_texts, first_ten_empty, extract_counts, list_counts, bulk_fill_written, csv_written, profiles_written, resources_written,
        validate_bare_forms, extract_bare_lines, bare_field_counts, batch_counts, batch_csv_written, summary_of_long_forms, sparse_csv_lines, text_positions, csv_records,
        filled_with_profiles, listed_files, resource_table, resource_uris, resolved_paths)
}

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"
_DOC_FIELDS = f"""f AS (SELECT CAST(d.doc_id AS VARCHAR) AS file, 0 AS o, 'text_required' AS n, coalesce({_TRIM("d.text")} = '', true) AS e FROM documents d
 UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'lang', lang IS NULL FROM documents
 UNION ALL SELECT CAST(d.doc_id AS VARCHAR), 2, 'quality_must', l.quality IS NULL FROM documents d LEFT JOIN labels l USING (doc_id)
 UNION ALL SELECT CAST(d.doc_id AS VARCHAR), 3, 'toxic*', l.toxic IS NULL FROM documents d LEFT JOIN labels l USING (doc_id))"""
_CELLS = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS form_id, 'c/' || c_custkey AS file, c_name AS "Name", '' AS "Nation", c_mktsegment AS "Segment", CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS "Rich", '' AS "Sign" FROM customer
 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 's/' || s_suppkey, s_name, CAST(s_nationkey AS VARCHAR), '', '', '' FROM supplier)"""
_FORM = """v AS (SELECT c_custkey, * FROM (SELECT c_custkey, 0 AS o, 'name' AS n, 'text' AS t, c_name AS x FROM customer
 UNION ALL SELECT c_custkey, 1, 'rich', 'checkbox', CASE WHEN c_acctbal > 5000 THEN 'yes' WHEN c_acctbal > 0 THEN 'TRUE' ELSE '1' END FROM customer
 UNION ALL SELECT c_custkey, 2, 'segment', 'radio', c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 3, 'stamp', 'unknown', 'x' FROM customer
 UNION ALL SELECT c_custkey, 4, 'pick', 'dropdown', 'b' FROM customer
 UNION ALL SELECT c_custkey, 5, 'fax', NULL, '' FROM customer)),
w AS (SELECT *, CASE WHEN t IS NULL THEN 'not_found' WHEN t = 'radio' AND x NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'error' ELSE 'filled' END AS status FROM v),
z AS (SELECT c_custkey, o, n, status, CASE WHEN status <> 'filled' THEN NULL WHEN t = 'checkbox' THEN CASE WHEN x IN ('true', 'yes', '1') THEN 'yes' ELSE 'no' END WHEN t <> 'unknown' THEN x END AS new_value,
 CASE status WHEN 'not_found' THEN 'Field ''' || n || ''' not found in PDF. Check field name or use ''read_pdf_fields'' to see available fields.' WHEN 'error' THEN 'Field ''' || n || ''': no such option: ' || x END AS error FROM w)"""
_FILES = """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN '.' ELSE '' END || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.pdf' WHEN s_suppkey % 3 = 0 THEN '.PDF' ELSE '.pdf.txt' END AS name, s_suppkey % 7 <> 0 AS there, repeat(s_name, s_nationkey) AS content FROM supplier"""
_BARE = """b AS (SELECT 'c/' || c_custkey AS file, unnest(fs, recursive := true) FROM (SELECT c_custkey, CASE WHEN len(fs) = 0 THEN [{'o': NULL, 'n': NULL, 'e': NULL, 'x': NULL}] ELSE fs END AS fs FROM (SELECT c_custkey, list_filter([
 CASE WHEN c_custkey % 5 <> 0 THEN {'o': 0, 'n': 'Name*', 'e': c_custkey % 4 = 0, 'x': CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '' END} END,
 CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 0 THEN {'o': 1, 'n': 'Segment', 'e': c_mktsegment IS NULL, 'x': c_mktsegment} END,
 CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN {'o': 2, 'n': 'Rich', 'e': false, 'x': CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END} END], lambda f: f IS NOT NULL) AS fs FROM customer)))"""
_BARE_LINES = """x AS (SELECT file, '"' || file[3:] || '","' || coalesce(max(x) FILTER (n = 'Name*'), '') || '","' || coalesce(max(x) FILTER (n = 'Rich'), '') || '","' || coalesce(max(x) FILTER (n = 'Segment'), '') || '"' AS line FROM b GROUP BY file)"""

SQL: dict[str, str] = {
    "validate_forms": f"WITH {_DOC_FIELDS} SELECT file, count(*) AS total, CAST(count_if(NOT e) AS BIGINT) AS filled, CAST(count_if(e) AS BIGINT) AS empty, CAST(count_if(e AND (lower(n) LIKE '%required%' OR lower(n) LIKE '%must%' OR contains(n, '*'))) AS BIGINT) AS required_empty FROM f GROUP BY file",
    "validate_first_empty": f"WITH {_DOC_FIELDS} SELECT file, coalesce(min(n ORDER BY o) FILTER (e AND o = m), '') AS first_empty, CAST(greatest(count_if(e) - 1, 0) AS BIGINT) AS more FROM (SELECT *, min(o) FILTER (e) OVER (PARTITION BY file) AS m FROM f) GROUP BY file",
    "extract_wide": f'WITH {_CELLS} SELECT form_id AS _filename, "Name", "Nation", "Rich", "Segment", "Sign" FROM c',
    "extract_csv_lines": f"""WITH {_CELLS} SELECT file, '"' || form_id || '","' || "Name" || '","' || "Nation" || '","' || "Rich" || '","' || "Segment" || '","' || "Sign" || '"' AS line FROM c""",
    "field_names": """WITH n AS (SELECT DISTINCT n FROM (SELECT unnest(['Name', 'Segment', 'Rich', 'Sign']) AS n, c_custkey FROM customer UNION ALL SELECT unnest(['Name', 'Nation']), s_suppkey FROM supplier))
SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS position, n AS field_name FROM n""",
    "read_fields": """SELECT 'c/' || c_custkey AS file, 'Name' AS name, 'text' AS type, '' AS options, '"' || c_name || '"' AS current_value FROM customer
 UNION ALL SELECT 'c/' || c_custkey, 'Segment', 'dropdown', '', '["' || c_mktsegment || '"]' FROM customer
 UNION ALL SELECT 'c/' || c_custkey, 'Rich', 'checkbox', '', CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END FROM customer
 UNION ALL SELECT 'c/' || c_custkey, 'Sign', 'unknown', '', '""' FROM customer
 UNION ALL SELECT 's/' || s_suppkey, 'Name', 'text', '', '"' || s_name || '"' FROM supplier
 UNION ALL SELECT 's/' || s_suppkey, 'Nation', 'radio', '', '"' || s_nationkey || '"' FROM supplier""",
    "field_counts": """WITH f AS (SELECT 'c/' || c_custkey AS file, unnest(['Name', 'Segment', 'Rich', 'Sign']) AS n FROM customer UNION ALL SELECT 's/' || s_suppkey, unnest(['Name', 'Nation']) FROM supplier)
SELECT file, count(*) AS n_fields FROM f GROUP BY file""",
    "naive_csv": f"""WITH a AS (SELECT doc_id, string_split({_TRIM("text")}, chr(10)) AS lines FROM documents),
b AS (SELECT doc_id, list_transform(string_split(lines[1], ','), lambda h: {_TRIM("h")}) AS hs, lines FROM a),
c AS (SELECT doc_id, hs, lines, unnest(range(2, len(lines) + 1)) AS k FROM b),
e AS (SELECT doc_id, k, hs, list_transform(string_split(lines[k], ','), lambda v: {_TRIM("v")}) AS vs FROM c),
g AS (SELECT doc_id, k, hs, vs, unnest(range(1, len(hs) + 1)) AS j FROM e)
SELECT doc_id, CAST(k - 2 AS BIGINT) AS row, hs[j] AS header, coalesce(vs[j], '') AS value FROM g WHERE NOT list_contains(hs[j + 1:], hs[j])""",
    "fill_values": f"WITH {_FORM} SELECT c_custkey, n AS field_name, status, new_value, error FROM z",
    "fill_status": f"WITH {_FORM} SELECT c_custkey, CAST(count_if(status = 'filled') AS BIGINT) AS n_filled, CAST(count_if(status <> 'filled') AS BIGINT) AS n_errors, coalesce(string_agg(error, chr(10) ORDER BY o), '') AS errors FROM z GROUP BY c_custkey",
    "fill_json_kinds": """SELECT c_custkey, 'rich' AS field_name, 'filled' AS status, CASE WHEN c_custkey % 6 IN (0, 2) THEN 'yes' ELSE 'no' END AS new_value FROM customer
 UNION ALL SELECT c_custkey, 'name', 'filled', CASE c_custkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN '12' ELSE 'x' END FROM customer""",
    "bulk_fill_files": "WITH n AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || (o_custkey % 100) || '.pdf' ELSE 'filled_' || (o_orderkey + 1) || '.pdf' END AS filename FROM orders) SELECT filename, max(o_orderkey) AS winning_row, count(*) AS writes FROM n GROUP BY filename",
    "profile_merge": """SELECT c_custkey, 0 AS position, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 1, 'segment', 'S-' || c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 2, 'note', 'base' FROM customer UNION ALL SELECT c_custkey, 3, 'extra', CAST(c_nationkey AS VARCHAR) FROM customer""",
    "list_by_suffix": "SELECT p_partkey, p_name || (['.pdf', '.PDF', '.txt', '.pdf.bak', '.Pdf'])[p_partkey % 5 + 1] AS name FROM part WHERE p_partkey % 5 IN (0, 1, 4)",
    "list_profile_names": "SELECT p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 2 THEN 'b.json' ELSE '.json' END AS profile_name FROM part WHERE p_partkey % 4 <> 1",
    "content_stats": f"SELECT doc_id || '.pdf' AS file, printf('%.2f', floor(octet_length(encode(text)) / 1024.0::DOUBLE * 100 + 0.5) / 100) AS size_kb, CAST(length(text) + length(regexp_replace(text, '[\\x{{0000}}-\\x{{FFFF}}]', '', 'g')) AS BIGINT) AS text_length, {_TRIM('text')} = '' AS is_blank FROM documents",
    "resource_blobs": "SELECT 'pdf:///docs/' || doc_id || '.pdf' AS uri, 'application/pdf' AS mime_type, md5(base64(encode(text))) AS blob_md5, CAST(length(base64(encode(text))) AS BIGINT) AS blob_length FROM documents",
    "required_fields": "SELECT conv_id, turn, lower(t) LIKE '%required%' OR lower(t) LIKE '%must%' OR contains(t, '*') AS required, CAST(length(x) + length(regexp_replace(x, '[\\x{0000}-\\x{FFFF}]', '', 'g')) AS BIGINT) AS units FROM (SELECT conv_id, turn, coalesce(text, '') AS x, coalesce(text || CASE WHEN turn % 3 = 0 THEN 'Must' WHEN turn % 5 = 0 THEN '*' ELSE '' END, '') AS t FROM conversations)",
    "pdf_fields": f"""WITH c AS (SELECT '/c/' || c_custkey || '.pdf' AS file, *, CASE c_custkey % 3 WHEN 1 THEN 'basic' WHEN 2 THEN 'plus' ELSE '' END AS plan FROM customer WHERE c_custkey % 7 <> 0)
SELECT file, 0 AS field_ordinal, 'Name' AS name, 'text' AS type, '' AS options, '"' || c_name || '"' AS current_value FROM c
 UNION ALL SELECT file, 1, 'Segment', 'dropdown', '{"|".join(SEGMENTS)}', '["' || c_mktsegment || '"]' FROM c
 UNION ALL SELECT file, 2, 'Rich', 'checkbox', '', CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END FROM c
 UNION ALL SELECT file, 3, 'Plan', 'radio', '', '"' || plan || '"' FROM c
 UNION ALL SELECT file, 4, 'Sign', 'unknown', '', '""' FROM c""",
    "pdf_fill": """WITH c AS (SELECT '/c/' || c_custkey || '.pdf' AS file, c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0)
SELECT file, 'Name' AS field_name, 'é-' || k AS cell FROM c UNION ALL SELECT file, 'Segment', 'HOUSEHOLD' FROM c UNION ALL SELECT file, 'Rich', CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END FROM c
 UNION ALL SELECT file, 'Plan', 'plus' FROM c UNION ALL SELECT file, 'Sign', '' FROM c""",
    "pdf_contents": """WITH c AS (SELECT c_custkey || '.pdf' AS file, c_custkey % 7 = 0 AS locked, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name || ' – ' || c_mktsegment || ' é日🙂' END AS page, c_custkey % 4 = 0 AS blank FROM customer)
SELECT file, CAST(CASE WHEN locked THEN 0 ELSE 2 END AS INTEGER) AS pages, CAST(CASE WHEN locked THEN 0 WHEN blank THEN 4 ELSE 2 * (length(page) + 1) + 2 END AS BIGINT) AS text_length, locked OR blank AS is_blank,
 CASE WHEN NOT locked THEN page || chr(10) || chr(10) || page END AS text, CASE WHEN locked THEN 'PDF is password-protected.' END AS error FROM c""",
    "content_scale": """WITH s AS (SELECT doc_id, floor(octet_length(encode(text)) / 1024.0::DOUBLE * 100 + 0.5) / 100 AS kb FROM documents)
SELECT doc_id || '.pdf' AS file, printf('%.2f', kb) AS size_kb, true AS is_blank, CASE WHEN CAST(printf('%.2f', kb) AS DOUBLE) = 0 THEN 1.5::DOUBLE ELSE least(1.5::DOUBLE, sqrt(375.0::DOUBLE / CAST(printf('%.2f', kb) AS DOUBLE))) END AS scale FROM s""",
    "uri_paths": "SELECT doc_id, 'pdf:///docs/pdf://' || doc_id || '.pdf' AS uri, '/docs/pdf://' || doc_id || '.pdf' AS path FROM documents",
    "report_texts": """WITH f AS (SELECT c_custkey AS k, CAST(c_custkey % 15 AS INTEGER) AS n, range(0, least(CAST(c_custkey % 15 AS INTEGER), 14)) AS e FROM customer),
g AS (SELECT k, len(e) AS n, list_transform(e, lambda i: 'f' || lpad(CAST(i AS VARCHAR), 2, '0') || CASE i WHEN 3 THEN '*' WHEN 7 THEN ' Required' ELSE '' END) AS names FROM f)
SELECT 'd/' || k AS file, 'PDF Validation Report for: ' || k || chr(10) || 'Total fields: 14' || chr(10) || 'Filled: ' || (14 - n) || chr(10) || 'Empty: ' || n || chr(10)
 || CASE WHEN n > 3 THEN chr(10) || '⚠️  Required fields that are empty:' || chr(10) || 'f03*' || CASE WHEN n > 7 THEN chr(10) || 'f07 Required' ELSE '' END ELSE '' END
 || CASE WHEN n > 10 THEN chr(10) || chr(10) || 'First 10 empty fields:' || chr(10) || array_to_string(names[1:10], chr(10)) || chr(10) || '... and ' || (n - 10) || ' more'
  WHEN n > 0 THEN chr(10) || chr(10) || 'Empty fields:' || chr(10) || array_to_string(names, chr(10)) ELSE '' END AS report FROM g""",
    "first_ten_empty": """WITH f AS (SELECT c_custkey AS k, range(0, least(CAST(c_custkey % 15 AS INTEGER), 14)) AS e FROM customer),
g AS (SELECT k, len(e) AS n, list_transform(e, lambda i: 'f' || lpad(CAST(i AS VARCHAR), 2, '0') || CASE i WHEN 3 THEN '*' WHEN 7 THEN ' Required' ELSE '' END) AS names FROM f)
SELECT 'd/' || k AS file, array_to_string(names[1:10], chr(10)) AS first_empty, CAST(greatest(n - 10, 0) AS BIGINT) AS more FROM g""",
    "extract_counts": """WITH f AS (SELECT 'c/' || c_custkey AS file, unnest(['Name', 'Segment', 'Rich', 'Sign']) AS n FROM customer UNION ALL SELECT 's/' || s_suppkey, unnest(['Name', 'Nation']) FROM supplier)
SELECT count(DISTINCT file) AS n_forms, count(DISTINCT n) AS n_fields FROM f""",
    "list_counts": "SELECT count(*) AS n_files FROM part WHERE p_partkey % 5 IN (0, 1, 4)",
    "bulk_fill_written": "SELECT 'n' || s_nationkey || '.pdf' AS _filename, arg_max(s_name, s_suppkey) AS name, arg_max(CASE WHEN s_acctbal > 0 THEN 'yes' ELSE 'no' END, s_suppkey) AS rich FROM supplier GROUP BY s_nationkey",
    "csv_written": """WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY 's/' || s_suppkey) AS p, '"' || s_suppkey || '","' || s_name || '","' || s_nationkey || '"' AS line FROM supplier)
SELECT CAST(p AS INTEGER) AS position, line FROM s UNION ALL SELECT 0, '_filename,Name,Nation'""",
    "profiles_written": """WITH s AS (SELECT 'n' || s_nationkey || '-' || (s_suppkey % 7) AS profile_name, arg_max(s_name, s_suppkey) AS name, any_value(s_nationkey) AS k FROM supplier GROUP BY 1)
SELECT profile_name, '{' || chr(10) || '  "name": "' || name || ' é\\"\\\\",' || chr(10) || '  "nation": ' || k || ',' || chr(10) || '  "ok": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',' || chr(10) || '  "none": null' || chr(10) || '}' AS json FROM s""",
    "resources_written": """WITH n AS (SELECT n_nationkey || CASE WHEN n_nationkey % 2 = 1 THEN '.PDF' ELSE '.pdf' END AS file, encode(n_name || ' é') AS b FROM nation)
SELECT file, printf('%.2f', floor(octet_length(b) / 1024.0::DOUBLE * 100 + 0.5) / 100) AS size_kb, 'pdf://' || file AS uri, 'application/pdf' AS mime_type, base64(b) AS blob FROM n""",
    "validate_bare_forms": f"WITH {_BARE} SELECT file, count(n) AS total, CAST(coalesce(count_if(n IS NOT NULL AND NOT e), 0) AS BIGINT) AS filled, CAST(coalesce(count_if(e), 0) AS BIGINT) AS empty, coalesce(string_agg(n, chr(10) ORDER BY o) FILTER (e AND contains(n, '*')), '') AS required, coalesce(string_agg(n, chr(10) ORDER BY o) FILTER (e), '') AS empty_fields FROM b GROUP BY file",
    "extract_bare_lines": f"""WITH {_BARE}, {_BARE_LINES} SELECT file, line FROM x""",
    "bare_field_counts": f"WITH {_BARE} SELECT file, count(n) AS n_fields FROM b GROUP BY file",
    "batch_counts": f"WITH {_BARE} SELECT count(DISTINCT o_orderkey) AS n_forms, count(DISTINCT n) AS n_fields FROM orders JOIN b ON b.file = 'c/' || o_custkey",
    "batch_csv_written": f"""WITH {_BARE}, {_BARE_LINES}, p AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS number, line FROM orders JOIN x ON x.file = 'c/' || o_custkey),
q AS (SELECT count(*) AS n_forms FROM orders), u AS (SELECT count(DISTINCT n) AS n_fields FROM b)
SELECT number, line, n_forms, n_fields FROM (SELECT * FROM p UNION ALL SELECT 0, '_filename,Name*,Rich,Segment'), q, u""",
    "summary_of_long_forms": """WITH f AS (SELECT c_custkey AS k, range(0, least(CAST(c_custkey % 15 AS INTEGER), 14)) AS e FROM customer),
g AS (SELECT k, len(e) AS n, list_transform(e, lambda i: 'f' || lpad(CAST(i AS VARCHAR), 2, '0') || CASE i WHEN 3 THEN '*' WHEN 7 THEN ' Required' ELSE '' END) AS names FROM f)
SELECT 'd/' || k AS file, CAST(14 AS BIGINT) AS total, CAST(14 - n AS BIGINT) AS filled, CAST(n AS BIGINT) AS empty, array_to_string(names[1:10], chr(10)) AS first_empty, CAST(greatest(n - 10, 0) AS BIGINT) AS more FROM g""",
    "sparse_csv_lines": """WITH r AS (SELECT conv_id, role || '-' || turn AS n, md5(max(coalesce(text, ''))) AS x FROM conversations GROUP BY conv_id, turn, role),
g AS (SELECT c.conv_id, n.n, coalesce(r.x, '') AS x FROM (SELECT DISTINCT conv_id FROM r) c CROSS JOIN (SELECT DISTINCT n FROM r) n LEFT JOIN r ON r.conv_id = c.conv_id AND r.n = n.n)
SELECT 'v/' || conv_id AS file, '"' || conv_id || '",' || string_agg('"' || x || '"', ',' ORDER BY n) AS line FROM g GROUP BY conv_id""",
    "text_positions": "SELECT t AS field_name, row_number() OVER (ORDER BY t) - 1 AS position FROM (SELECT DISTINCT coalesce(text, '') AS t FROM conversations)",
    "csv_records": f"""WITH {_CELLS}, n AS (SELECT row_number() OVER (ORDER BY file) - 1 AS row, * FROM c)
SELECT row, unnest(['_filename', 'Name', 'Nation', 'Rich', 'Segment', 'Sign']) AS header, unnest(list_transform([form_id, "Name", "Nation", "Rich", "Segment", "Sign"], lambda v: '"' || v || '"')) AS value FROM n""",
    "listed_files": f"SELECT name FROM ({_FILES}) WHERE there AND lower(name) LIKE '%.pdf'",
    "filled_with_profiles": """WITH f AS (SELECT c_custkey, 'Field ''' || x || ''' not found in PDF. Check field name or use ''read_pdf_fields'' to see available fields.' AS e, o FROM customer JOIN (VALUES ('3', 1, 3), ('7', 2, 1), ('fax', 4, 3)) v(x, o, every) ON c_custkey % every = 0
 UNION ALL SELECT c_custkey, 'Field ''segment'': no such option: ' || c_mktsegment, 3 FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY'))
SELECT c_custkey, CAST(CASE WHEN count_if(o = 3) > 0 THEN 2 ELSE 3 END AS BIGINT) AS n_filled, count(*) AS n_errors, string_agg(e, chr(10) ORDER BY o) AS errors FROM f JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey""",
    "resource_table": f"""SELECT s || '/x/' || name AS uri, CASE WHEN s = 'pdf://' AND there THEN 'application/pdf' END AS mime_type, CASE WHEN s = 'pdf://' AND there THEN md5(base64(encode(content))) END AS blob_md5,
 CASE WHEN s <> 'pdf://' THEN 'Unsupported resource URI: ' || s || '/x/' || name WHEN NOT there THEN 'No such file: /x/' || name END AS error FROM (SELECT *, CASE WHEN k % 11 = 0 THEN 'http://' ELSE 'pdf://' END AS s FROM ({_FILES}))""",
    "resource_uris": f"""SELECT '/x/' || name AS path, CASE WHEN there THEN 'pdf:///x/' || name END AS uri, CASE WHEN there THEN name END AS file, CASE WHEN there THEN printf('%.2f', floor(octet_length(encode(content)) / 1024.0::DOUBLE * 100 + 0.5) / 100) END AS size_kb,
 CASE WHEN NOT there THEN 'No such file: /x/' || name END AS error FROM ({_FILES})""",
    "resolved_paths": """WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, replace(p_name, ' ', '/') AS n FROM part)
SELECT p_partkey, (['~/', '~', '/', '', '../', './../x/.././', 's3://'])[k + 1] || n AS path, (['/home/u/', '/home/u/', '/', '/work/dir/', '/work/', '/work/', 's3://'])[k + 1] || n AS full FROM p""",
}
