"""Results of services under differing names: aliases joined, lists read, success derived, secrets left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsons import get, get_filled, is_json, json_object
from ..functions.text import non_blank, strip

# Names under which a field comes, in order of precedence.
ID_NAMES, FILE_NAMES, ERROR_NAMES = ("document_id", "doc_id", "id"), ("file_name", "name", "filename"), ("error", "error_message")
NO_ID = "Workflow 未返回 document_id，入库可能未完成"
# Fields that aren't shown, and how paths of a machine begin.
HIDDEN = ("_prompt", "_raw_response", "api_key", "secret_key", "cookie", "session_token", "password", "token", "observations", "root_input", "root_output")
PATHS = ("C:\\", "D:\\", "E:\\", "/", "\\\\")


def text_list(c: Column) -> Column:
    """A list of texts from a JSON array, one JSON value, or a text with commas; blanks are left out."""
    array = F.from_json(c, "array<string>")
    parts = F.when(is_json(strip(c)) & strip(c).startswith("["), array).when(is_json(strip(c)), F.array(F.regexp_replace(strip(c), '^"|"$', ""))).otherwise(F.split(c, ","))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda t: non_blank(t)), lambda t: t.isNotNull())


def ingested(item: Column, package: Column, name: Column) -> Column:
    """struct of a stored document from a service's JSON item; a text that isn't an object is a failure of its own."""
    m = json_object(item)
    given = lambda *keys: F.coalesce(strip(get_filled(m, *keys)), F.lit(""))
    doc, error = given(*ID_NAMES), given(*ERROR_NAMES)
    file_name = F.coalesce(strip(get_filled(m, *FILE_NAMES)), strip(name), F.lit(""))
    kind, about = given("document_type"), given("document_summary")
    described = (kind != "") & (about != "")
    success = (error == "") & ((doc != "") | described)
    status = F.when((error == "") & (doc == "") & described, "completed").otherwise(F.coalesce(strip(get_filled(m, "indexing_status")), F.when(doc == "", "completed").otherwise("waiting")))
    whole = F.struct(
        file_name.alias("file_name"), doc.alias("document_id"), F.coalesce(strip(get_filled(m, "contract_package")), package, F.lit("")).alias("package"), kind.alias("document_type"),
        F.coalesce(strip(get_filled(m, "document_title")), file_name).alias("title"), about.alias("summary"), text_list(get(m, "topics")).alias("topics"), status.alias("status"),
        success.alias("success"), F.when((error == "") & (doc == "") & ~described, NO_ID).otherwise(error).alias("error"),
    )
    broken = F.struct(*[x.alias(n) for n, x in (("file_name", F.coalesce(name, F.lit(""))), ("document_id", F.lit("")), ("package", F.coalesce(package, F.lit(""))), ("document_type", F.lit("")), ("title", F.lit("")), ("summary", F.lit("")), ("topics", F.array().cast("array<string>")), ("status", F.lit("error")), ("success", F.lit(False)), ("error", F.lit("no object")))])
    return F.when(m.isNotNull(), whole).otherwise(broken)


def document_id_of(result: Column) -> Column:
    """The document's id of a pipeline's result: at the top, in its outputs, or the only one of a list of ids."""
    m = json_object(result)
    outputs = json_object(get(m, "outputs"))
    only = lambda o: F.when(F.size(F.from_json(get(o, "document_ids"), "array<string>")) == 1, F.from_json(get(o, "document_ids"), "array<string>")[0])
    return F.coalesce(get_filled(m, "document_id"), get_filled(outputs, "document_id"), only(outputs), only(m))


def shown(m: Column) -> Column:
    """A map without fields that aren't shown and values that are paths of a machine."""
    path = lambda v: F.coalesce(F.exists(F.array(*[F.lit(p) for p in PATHS]), lambda p: F.startswith(v, p)), F.lit(False))
    return F.map_filter(m, lambda k, v: ~k.isin(*HIDDEN) & ~path(v))
