"""API pages: references, types, old specifications, YAML, and what is left out."""

import json

from sheaf.operators import openapi


def pages(spark, *specs):
    rows = [(f"s{i}", s if isinstance(s, str) else json.dumps(s, ensure_ascii=False)) for i, s in enumerate(specs)]
    return {(r.source, r.path): r.content for r in openapi.api_pages(spark.createDataFrame(rows, "source string, raw string")).collect()}


def test_type_names():
    name = openapi.type_name
    assert name({"enum": ["é", {"a": 1}, [1, 2], None, True, 6]}) == '"é" | {"a":1} | [1,2] | null | true'
    assert name({"type": "array", "items": {"type": "array"}}) == "array[]" and name({}) == "any" and name(None) == "any"
    deep = {"type": "string"}
    for _ in range(7):
        deep = {"type": "array", "items": deep}
    assert name(deep) == "any" + "[]" * 6


def test_references():
    root = {"a/b": {"type": "string"}, "x": {"y": {"$ref": "#/a~1b"}}, "loop": {"$ref": "#/loop"}}
    assert openapi.inline({"$ref": "#/x/y"}, root) == {"type": "string"} and openapi.inline({"$ref": "#/none"}, root) == {"$ref": "#/none"}
    assert openapi.inline({"$ref": "#/loop"}, root) == {"type": "object", "description": "[circular: #/loop]"} and openapi.inline({"$ref": "http://h/x"}, root) == {"$ref": "http://h/x"}


def test_old_specification_in_yaml(spark):
    raw = """
swagger: "2.0"
info: {title: Old, version: "3"}
paths:
  /a:
    parameters: [{name: shared, in: query}]
    post:
      summary: Same
      description: Same
      tags: []
    put:
      tags: [B b, a]
      parameters:
        - {name: h, in: header, type: integer, required: true, description: how}
        - {name: l, in: query, type: array, items: {type: string}}
        - {name: body, in: body, schema: {$ref: "#/definitions/T"}}
      responses: {default: {description: d}, "201": {schema: {$ref: "#/definitions/T"}}, "200": {description: ok}, x: null}
    get: null
definitions:
  T: {type: object, properties: {k: {type: boolean}}}
"""
    got = pages(spark, raw, "{broken", '{"info": {}}', None)
    assert set(got) == {("s0", p) for p in ("api/overview.md", "api/b-b.md", "api/a.md")}
    assert got["s0", "api/overview.md"] == "# Old\n\nVersion: 3 (Swagger 2.0)\n\n## Endpoint Groups\n\n- **b-b** — 1 endpoints\n- **a** — 1 endpoints"
    block = "## PUT /a\n\n### Query params\n- `l` (string[]): \n\n### Headers\n- `h` (integer, required): how\n\n### Body: `{ k?: boolean }`\n\n### Responses\n- **200**: ok\n- **201**:  → `{ k?: boolean }`\n- **default**: d\n"
    assert got["s0", "api/a.md"] == "# a\n\n" + block and got["s0", "api/b-b.md"] == "# b-b\n\n" + block


def test_nothing_to_say(spark):
    got = pages(spark, {"paths": {"/x": {"get": {}, "head": {"security": [], "deprecated": True, "description": "d"}, "trace": {}}, "/y": None}, "security": [{"k": []}]})
    assert got == {("s0", "api/overview.md"): "# API Reference\n\nVersion: unknown (OpenAPI 3.x)\n\n## Endpoint Groups\n\n- **default** — 2 endpoints", ("s0", "api/default.md"): "# default\n\n## GET /x\n\nAuth: k\n\n## HEAD /x ~~DEPRECATED~~\n\nd\n"}
    assert pages(spark, {"paths": {}}) == {}
