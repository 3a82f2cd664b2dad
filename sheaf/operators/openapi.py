"""OpenAPI specifications to markdown: an overview and a file per tag.

Paths, methods, tags, parameters and responses are rows and nested columns; only what needs recursion over a JSON tree (reading YAML, inlining
references, naming a schema's type) is a small Python function on one text.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import replace, trim

METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
SHOWN_IN = ("path", "query", "header")
DEEPEST, MOST_FIELDS, MOST_ENUM, MOST_VARIANTS, DEEPEST_TYPE = 15, 10, 5, 3, 5
SPEC = "info struct<title:string,description:string,version:string>, security array<map<string,array<string>>>, paths map<string,map<string,string>>"
PARAMETER = "struct<name:string,`in`:string,required:boolean,description:string,type:string,schema:string>"
OPERATION = f"summary string, description string, deprecated boolean, tags array<string>, security array<map<string,array<string>>>, parameters array<{PARAMETER}>, requestBody struct<content:map<string,struct<schema:string>>>, responses map<string,string>"
RESPONSE = "description string, content map<string,struct<schema:string>>, schema string"
RESPONSE_FIELDS = "description:string,content:map<string,struct<schema:string>>,schema:string"


def inline(node, root, seen=frozenset(), depth=0):
    """node with its local references replaced by what they name; one that contains itself becomes a note."""
    if isinstance(node, list):
        return [inline(x, root, seen, depth + 1) for x in node]
    if not isinstance(node, dict) or depth > DEEPEST:
        return node
    ref = node.get("$ref")
    if isinstance(ref, str) and ref.startswith("#/"):
        if ref in seen:
            return {"type": "object", "description": f"[circular: {ref}]"}
        target = root
        for part in ref[2:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            target = target.get(part) if isinstance(target, dict) else None
        # a reference to nothing stays as it is
        return node if target is None else inline(target, root, seen | {ref}, depth + 1)
    return {k: inline(v, root, seen, depth + 1) for k, v in node.items()}


def type_name(schema, depth=0) -> str:
    """A short name for a schema, as T[], { field?: T }, "a" | "b", A | B or A & B."""
    if not isinstance(schema, dict) or depth > DEEPEST_TYPE:
        return "any"
    deeper = lambda x: type_name(x, depth + 1)
    kind = schema.get("type")
    if kind == "array":
        return deeper(schema["items"]) + "[]" if schema.get("items") else "array"
    if kind == "object" or schema.get("properties"):
        fields, needed = schema.get("properties") or {}, schema.get("required") or []
        shown = [f"{k}{'' if k in needed else '?'}: {deeper(v)}" for k, v in list(fields.items())[:MOST_FIELDS]]
        if "properties" not in schema:
            return "object"
        return "{ " + ", ".join(shown + ["..."] * (len(fields) > MOST_FIELDS)) + " }"
    if schema.get("enum"):
        return " | ".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"][:MOST_ENUM])
    for word, sign in (("oneOf", " | "), ("anyOf", " | "), ("allOf", " & ")):
        if schema.get(word):
            return sign.join(map(deeper, schema[word] if sign == " & " else schema[word][:MOST_VARIANTS]))
    return kind if isinstance(kind, str) else "any"


def read_spec(raw: str) -> str | None:
    """A JSON or YAML specification as JSON without local references; null if it can't be read."""
    try:
        if raw.lstrip().startswith("{"):
            tree = json.loads(raw)
        else:
            import yaml

            tree = yaml.load(raw, getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # noqa: S506  both are safe loaders
        return json.dumps(inline(tree, tree), default=str, ensure_ascii=False)
    except Exception:  # noqa: BLE001  one broken specification doesn't end the run
        return None


@F.arrow_udf(T.StringType())
def spec_json(raw: pa.Array) -> pa.Array:
    # one specification at a time: batches of large ones stay as they are in memory
    return pa.array((read_spec(x.as_py()) if x.is_valid else None for x in raw), pa.string(), size=len(raw))


@F.arrow_udf(T.ArrayType(T.StringType()))
def schema_types(schemas: pa.Array) -> pa.Array:
    """The type names of an array of schemas; null where there is none."""
    named = ([None if s is None else type_name(json.loads(s)) for s in row.as_py()] if row.is_valid else None for row in schemas)
    return pa.array(named, pa.list_(pa.string()), size=len(schemas))


def json_schema(content: Column) -> Column:
    """The schema of the JSON media type, as JSON."""
    return F.try_element_at(content, F.lit("application/json"))["schema"]


def auth_of(security: Column) -> Column:
    """Alternatives between bars; what is needed together after commas."""
    return F.array_join(F.transform(security, lambda s: F.array_join(F.map_keys(s), ", ")), " | ")


def operations(specs: DataFrame) -> DataFrame:
    """specs(source, raw) -> a row for each operation and tag, in document order (path_at, method_at)."""
    rows = specs.select("source", F.from_json(spec_json("raw"), SPEC).alias("spec")).where("spec.paths IS NOT NULL")
    rows = rows.select("source", "spec.info", F.col("spec.security").alias("all_security"), F.posexplode(F.map_entries("spec.paths")).alias("path_at", "item"))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.try_element_at("item.value", F.lit(m)).alias("op")) for m in METHODS])
    rows = rows.select("source", "info", "all_security", "path_at", F.col("item.key").alias("path"), F.posexplode(methods).alias("method_at", "m")).where("m.op IS NOT NULL")
    rows = rows.select("*", F.from_json("m.op", OPERATION).alias("op"))
    tags = F.when(F.size("op.tags") > 0, F.col("op.tags")).otherwise(F.array(F.lit("default")))
    return rows.select("source", "info", "path_at", "method_at", "path", F.upper("m.method").alias("method"), "op", F.coalesce(auth_of(F.col("op.security")), auth_of(F.col("all_security")), F.lit("")).alias("auth"), F.explode(tags).alias("tag"))


def described(rows: DataFrame) -> DataFrame:
    """operations() with lines about parameters, body and responses, made within the row: one call names all types of an operation."""
    none = F.array().cast("array<string>")
    params = F.coalesce("op.parameters", F.array().cast(f"array<{PARAMETER}>"))
    answers = F.coalesce(F.transform(F.map_entries("op.responses"), lambda r: F.struct(r["key"].alias("status"), F.from_json(r["value"], RESPONSE).alias("v"))), F.array().cast(f"array<struct<status:string,v:struct<{RESPONSE_FIELDS}>>>"))
    rows = rows.withColumns({"__params": params, "__answers": answers})
    schemas = F.concat(
        F.array(json_schema(F.col("op.requestBody.content"))), F.coalesce(F.transform("__params", lambda p: p["schema"]), none),
        F.coalesce(F.transform("__answers", lambda r: F.coalesce(json_schema(r["v"]["content"]), r["v"]["schema"])), none),
    )
    rows = rows.withColumn("__kinds", schema_types(schemas)).withColumn("body", F.col("__kinds")[0])
    kind_of = lambda p, at: F.coalesce(F.get("__kinds", at + 1), p["type"], F.lit("any"))

    def param(p: Column, at: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, SHOWN_IN)), p["in"])
        line = F.concat(F.lit("- `"), p["name"], F.lit("` ("), p["in"], F.lit(", "), kind_of(p, at), F.when(p["required"], ", required").otherwise(""), F.lit(")"), F.when(p["description"] != "", F.concat(F.lit(": "), p["description"])).otherwise(""))
        return F.struct(F.when(p["in"].isin(*SHOWN_IN), place).alias("place"), at.alias("at"), line.alias("line"))

    def answer(r: Column, at: Column) -> Column:
        kind = F.get("__kinds", at + 1 + F.size("__params"))
        line = F.concat(F.lit("- `"), r["status"], F.lit("`: "), F.coalesce(r["v"]["description"], F.lit("")), F.coalesce(F.concat(F.lit(" → `"), kind, F.lit("`")), F.lit("")))
        # codes ascend, other names follow in their order
        number = F.coalesce(F.when(r["status"].rlike(r"\A\d+\z"), r["status"].try_cast("int")), F.lit(1 << 30))
        return F.struct(number.alias("number"), at.alias("at"), line.alias("line"))

    old_body = F.filter(F.transform("__params", lambda p, at: F.when(p["in"] == "body", kind_of(p, at))), lambda x: x.isNotNull())
    shown = F.array_sort(F.filter(F.transform("__params", param), lambda x: x["place"].isNotNull()))
    return rows.withColumns({"params": shown, "old_body": F.get(old_body, F.lit(0)), "answers": F.array_sort(F.transform("__answers", answer))}).drop("__params", "__answers", "__kinds")


def lines_of(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x["line"]), "\n")


def to_files(specs: DataFrame) -> DataFrame:
    """specs(source, raw) -> files(source, path, content): overview.md, and a file per tag."""
    rows = operations(specs)
    full = described(rows)
    some = lambda text, *more: F.when(F.coalesce(text, F.lit("")) != "", F.concat(*more))
    body = F.coalesce("body", "old_body")
    block = F.concat_ws(
        "\n\n", F.concat(F.lit("## "), "method", F.lit(" "), "path"), F.when(F.col("op.deprecated"), "**Deprecated**"), some(F.col("op.summary"), F.col("op.summary")), some(F.col("op.description"), trim("op.description")),
        some(F.col("auth"), F.lit("Auth: "), F.col("auth")), some(lines_of("params"), F.lit("Parameters:\n"), lines_of("params")), some(body, F.lit("Body: `"), body, F.lit("`")), some(lines_of("answers"), F.lit("Responses:\n"), lines_of("answers")),
    )
    name = replace(F.lower("tag"), r"\s+", "-")
    blocks = F.array_sort(F.collect_list(F.struct("path_at", "method_at", block.alias("line"))))
    tags = full.groupBy("source", "tag").agg(blocks.alias("blocks"))
    pages = tags.select("source", F.concat(name, F.lit(".md")).alias("path"), F.concat(F.lit("# "), "tag", F.lit("\n\n"), F.array_join(F.transform("blocks", lambda x: x["line"]), "\n\n"), F.lit("\n")).alias("content"))
    counts = rows.groupBy("source", "tag").agg(F.count("*").alias("n"), F.min(F.struct("path_at", "method_at")).alias("at"), F.first("info").alias("info"))
    entry = F.struct("at", "tag", F.format_string("- %s: %d operations", "tag", "n").alias("line"))
    heads = counts.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.first("info").alias("info"))
    overview = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("info.title", F.lit("API"))), some(F.col("info.description"), trim("info.description")), some(F.col("info.version"), F.lit("Version: "), F.col("info.version")), lines_of("entries"))
    return heads.select("source", F.lit("overview.md").alias("path"), overview.alias("content")).unionByName(pages)


PAGE_SPEC = f"swagger string, {SPEC}"
PAGE_OPERATION = "summary string, description string, deprecated boolean, tags array<string>, security array<map<string,array<string>>>, parameters array<string>, requestBody struct<content:map<string,struct<schema:string>>>, responses map<string,string>"
PAGE_PARAMETER = "name string, `in` string, required boolean, description string, schema string"
#: The headings of parameters by their place.
HEADINGS = (("path", "### Path params"), ("query", "### Query params"), ("header", "### Headers"))


def api_operations(specs: DataFrame) -> DataFrame:
    """specs(source, raw) -> a row for each operation, in document order, with what its page says: block, tags, and the specification's head."""
    rows = specs.select("source", F.from_json(spec_json("raw"), PAGE_SPEC).alias("spec")).where("spec.paths IS NOT NULL")
    rows = rows.select("source", "spec.info", F.col("spec.swagger").isNotNull().alias("old"), F.col("spec.security").alias("all_security"), F.posexplode(F.map_entries("spec.paths")).alias("path_at", "item"))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.try_element_at("item.value", F.lit(m)).alias("op")) for m in METHODS])
    rows = rows.select("source", "info", "old", "all_security", "path_at", F.col("item.key").alias("path"), F.posexplode(methods).alias("method_at", "m")).where(F.trim("m.op").startswith("{"))
    rows = rows.withColumn("op", F.from_json("m.op", PAGE_OPERATION))
    params = F.filter(F.coalesce("op.parameters", F.array().cast("array<string>")), lambda p: F.trim(p).startswith("{"))
    rows = rows.withColumn("params", F.transform(params, lambda p: F.struct(p.alias("raw"), F.from_json(p, PAGE_PARAMETER).alias("v"))))
    answers = F.filter(F.map_entries("op.responses"), lambda r: F.trim(r["value"]).startswith("{"))
    rows = rows.withColumn("answers", F.coalesce(F.transform(answers, lambda r: F.struct(r["key"].alias("status"), F.from_json(r["value"], RESPONSE).alias("v"))), F.array().cast(f"array<struct<status:string,v:struct<{RESPONSE_FIELDS}>>>")))
    body = F.when(F.col("old"), F.get(F.filter("params", lambda p: p["v"]["in"] == "body"), F.lit(0))["v"]["schema"]).otherwise(json_schema(F.col("op.requestBody.content")))
    schemas = F.concat(
        F.array(body), F.transform("params", lambda p: F.when(F.col("old"), p["raw"]).otherwise(p["v"]["schema"])),
        F.transform("answers", lambda r: F.coalesce(F.when(F.col("old"), r["v"]["schema"]), json_schema(r["v"]["content"]))),
    )
    rows = rows.withColumn("kinds", schema_types(schemas))
    text = lambda c: F.coalesce(c, F.lit(""))

    def listed(place: str, heading: str) -> Column:
        own = F.filter(F.transform("params", lambda p, k: F.struct(p["v"].alias("v"), F.coalesce(F.get("kinds", k + 1), F.lit("any")).alias("kind"))), lambda p: p["v"]["in"] == place)
        lines = F.transform(own, lambda p: F.concat(F.lit("- `"), text(p["v"]["name"]), F.lit("` ("), p["kind"], F.when(p["v"]["required"], ", required").otherwise(""), F.lit("): "), text(p["v"]["description"])))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"\n{heading}\n"), F.array_join(lines, "\n")))

    # codes come first, ascending, as a document's reader has them; other names follow in their order
    number = lambda r: F.coalesce(F.when(r["status"].rlike(r"\A(0|[1-9]\d*)\z"), r["status"].try_cast("bigint")), F.lit(1 << 32))
    kind = lambda k: F.get("kinds", k + 1 + F.size("params"))
    told = F.transform("answers", lambda r, k: F.struct(number(r).alias("number"), k.alias("at"), F.concat(F.lit("- **"), r["status"], F.lit("**: "), text(r["v"]["description"]), text(F.concat(F.lit(" → `"), kind(k), F.lit("`")))).alias("line")))
    responses = F.when(F.size("answers") > 0, F.concat(F.lit("\n### Responses\n"), F.array_join(F.transform(F.array_sort(told), lambda r: r["line"]), "\n")))
    some = lambda c, *parts: F.when(text(c) != "", F.concat(*parts, c))
    auth = F.coalesce(auth_of(F.col("op.security")), auth_of(F.col("all_security")))
    about = F.when(text("op.description") != text("op.summary"), F.col("op.description"))
    head = F.concat(F.lit("## "), F.upper("m.method"), F.lit(" "), "path", F.when(F.col("op.deprecated"), " ~~DEPRECATED~~").otherwise(""))
    block = F.concat_ws("\n", head, some(F.col("op.summary")), some(about, F.lit("\n")), some(auth, F.lit("\nAuth: ")), *(listed(*h) for h in HEADINGS), some(F.concat(F.lit("### Body: `"), F.get("kinds", F.lit(0)), F.lit("`")), F.lit("\n")), responses, F.lit(""))
    tags = F.transform(F.coalesce("op.tags", F.array(F.lit("default"))), lambda t: replace(F.lower(t), r"\s+", "-"))
    return rows.select("source", "info", "old", "path_at", "method_at", tags.alias("tags"), block.alias("block"))


def api_pages(specs: DataFrame) -> DataFrame:
    """specs(source, raw) -> files(source, path, content): api/overview.md with the groups of endpoints, and api/<tag>.md for each group."""
    rows = api_operations(specs).select("source", "info", "old", "path_at", "method_at", "block", F.posexplode("tags").alias("tag_at", "tag"))
    # a specification's pages come together, as the specification did
    at = F.struct("path_at", "method_at", "tag_at")
    tags = rows.groupBy("source", "tag").agg(F.array_sort(F.collect_list(F.struct("path_at", "method_at", "tag_at", "block"))).alias("blocks"), F.min(at).alias("at"), F.first("info").alias("info"), F.first("old").alias("old"))
    content = F.concat(F.lit("# "), "tag", F.lit("\n\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"))
    group = F.struct("at", "tag", F.size("blocks").alias("n"), content.alias("content"))
    per = tags.groupBy("source").agg(F.array_sort(F.collect_list(group)).alias("groups"), F.first("info").alias("info"), F.first("old").alias("old"))
    version = F.format_string("\nVersion: %s (%s)\n\n## Endpoint Groups\n", F.coalesce("info.version", F.lit("unknown")), F.when(F.col("old"), "Swagger 2.0").otherwise("OpenAPI 3.x"))
    about = F.when(F.col("info.description") != "", F.concat(F.lit("\n"), F.col("info.description")))
    entries = F.transform("groups", lambda g: F.concat(F.lit("- **"), g["tag"], F.lit("** — "), g["n"].cast("string"), F.lit(" endpoints")))
    overview = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("info.title", F.lit("API Reference"))), about, version, F.array_join(entries, "\n"))
    page = lambda g: F.struct(F.concat(F.lit("api/"), g["tag"], F.lit(".md")).alias("path"), g["content"].alias("content"))
    files = F.concat(F.array(F.struct(F.lit("api/overview.md").alias("path"), overview.alias("content"))), F.transform("groups", page))
    return per.select("source", F.inline(files))


def latest(specs: DataFrame) -> DataFrame:
    """specs(service, version, path, raw) -> files of each service's last version, paths below its name."""
    from sheaf.operators.catalog import latest_versions

    files = to_files(latest_versions(specs).select(F.col("service").alias("source"), "raw"))
    return files.select("source", F.concat("source", F.lit("/"), "path").alias("path"), "content")


def unread(specs: DataFrame) -> DataFrame:
    """Sources whose specification can't be read or has no paths."""
    ok = F.from_json(spec_json("raw"), SPEC)["paths"].isNotNull()
    return specs.where(~F.coalesce(ok, F.lit(False))).select("source")


def of_services(specs: DataFrame, pattern: str | None) -> DataFrame:
    """specs(service, ...) of the services that the pattern fits; all without a pattern."""
    return specs if pattern is None else specs.where(F.col("service").rlike(pattern))


def converted(specs: DataFrame, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """specs(service, version, path, raw) of several roots -> (files of each service's last version, a row for each service: service, ok, error).

    A service that can't be converted doesn't end the run: only if all fail is the error of the run set in its row (`all failed`).
    """
    from sheaf.operators.catalog import latest_versions

    last = latest_versions(of_services(specs, pattern))
    ok = F.coalesce(F.from_json(spec_json("raw"), SPEC)["paths"].isNotNull(), F.lit(False))
    state = last.select("service", ok.alias("ok"))
    some = state.agg(F.coalesce(F.max("ok"), F.lit(False)).alias("__some"))
    report = state.join(F.broadcast(some), how="cross").select("service", "ok", F.when(~F.col("ok"), F.when(F.col("__some"), "unreadable specification").otherwise("all failed")).alias("error"))
    return latest(of_services(specs, pattern)), report


def services(specs: DataFrame) -> DataFrame:
    """The number of distinct services and of specifications, one row."""
    return specs.agg(F.count_distinct("service").alias("n_services"), F.count("*").alias("n_specs"))
