"""Answers to a stream of JSON requests, one a line; works on static and on streaming frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "2024-11-05"
SERVER_VERSION = "0.1.0"
INSTRUCTIONS = "Call convert_pdf with the path of a document to read it as Markdown rather than as images of its pages."
DESCRIPTION = "Makes structured Markdown of a document: headings, lists, tables and columns in reading order, without running heads and bibliography."
NOTES = ("notifications/initialized", "notifications/cancelled")


def replies(requests: DataFrame, results: DataFrame, tool: str = "convert_pdf") -> DataFrame:
    """id, kind, body, reply of each request (column line) that is due an answer; a column seq, if there is one, is kept, so that answers can be put in order.

    id is JSON as it came, so that 1 and "1" differ; reply is the whole message.

    ``results`` has path, md and error. Lines that aren't JSON objects are passed
    over, so are notifications and unknown methods without an id.
    """
    line = F.col("line")
    at = lambda path: F.get_json_object(line, path)
    parsed = requests.filter(F.try_parse_json(line).isNotNull() & F.trim(line).startswith("{"))
    asked = parsed.select(*(["seq"] if "seq" in requests.columns else []), F.to_json(F.try_variant_get(F.try_parse_json(line), "$.id", "variant")).alias("id"), at("$.method").alias("method"), at("$.params.name").alias("name"), at("$.params.arguments.path").alias("path"), at("$.params.protocolVersion").alias("version"))
    asked = asked.filter(~F.coalesce(F.col("method").isin(*NOTES), F.lit(False)))
    known = F.col("method").isin("initialize", "tools/list", "tools/call", "ping")
    asked = asked.filter(F.coalesce(known, F.lit(False)) | (F.coalesce("id", F.lit("null")) != "null"))
    out = asked.join(results.select("path", "md", "error"), "path", "left")
    call, right = F.col("method") == "tools/call", F.col("name").eqNullSafe(F.lit(tool))
    kind = (
        F.when(F.col("method") == "initialize", "version").when(F.col("method") == "tools/list", "tools").when(F.col("method") == "ping", "empty")
        .when(call & ~right, "-32602").when(call & F.col("md").isNotNull(), "text").when(call, "failed").otherwise("-32601")
    )
    body = (
        F.when(F.col("method") == "initialize", F.coalesce("version", F.lit(VERSION))).when(F.col("method") == "tools/list", F.lit(tool))
        .when(call & right, F.coalesce("md", "error", F.lit("no such document"))).otherwise(F.lit(""))
    )
    told = out.withColumns({"kind": kind, "body": body})
    # a JSON text of a string
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    text = F.concat(F.lit('"result":{"content":[{"type":"text","text":'), quoted(F.col("body")), F.lit('}],"isError":'), (F.col("kind") == "failed").cast("string"), F.lit("}"))
    tools = json.dumps({"tools": [{"name": tool, "description": DESCRIPTION, "inputSchema": {"type": "object", "properties": {"path": {"type": "string", "description": "Absolute path of the document"}}, "required": ["path"]}}]}, separators=(",", ":"))
    server = json.dumps({"capabilities": {"tools": {}}, "serverInfo": {"name": "quoin", "version": SERVER_VERSION}, "instructions": INSTRUCTIONS}, separators=(",", ":"))
    error = lambda code, message: F.concat(F.lit(f'"error":{{"code":{code},"message":'), quoted(message), F.lit("}"))
    k = F.col("kind")
    rest = (
        F.when(k == "version", F.concat(F.lit('"result":{"protocolVersion":'), quoted(F.col("body")), F.lit("," + server[1:]))).when(k == "tools", F.lit('"result":' + tools)).when(k == "empty", F.lit('"result":{}'))
        .when(k == "-32602", error(-32602, F.concat(F.lit("unknown tool: "), F.coalesce("name", F.lit(""))))).when(k == "-32601", error(-32601, F.concat(F.lit("method not found: "), F.coalesce("method", F.lit(""))))).otherwise(text)
    )
    reply = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce("id", F.lit("null")), F.lit(","), rest, F.lit("}"))
    return told.withColumn("reply", reply).select(*(["seq"] if "seq" in requests.columns else []), "id", "kind", "body", "reply")
