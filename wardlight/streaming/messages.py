"""Requests as lines of JSON: the same answers in batch and as a stream, bad lines as errors beside them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import moderation
from ..sources.lexicon import Options, summaries

# Error codes of the message protocol, its versions, and the longest line that is read.
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL_ERROR, UNSUPPORTED_VERSION = -32700, -32600, -32601, -32602, -32603, -32022
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
LONGEST_LINE = 32 << 20
# The tools and the arguments that each takes.
CHECKS = ("text", "languages", "minSeverity")
TOOLS = {"check_text": CHECKS, "scan_text": CHECKS, "censor_text": (*CHECKS, "mask", "keepFirst"), "list_languages": ()}
METHODS = ("initialize", "ping", "tools/list", *TOOLS)


def answer(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """id (as JSON), method, result (JSON) and error of each line of `value`; blank lines and notifications have no answer.

    A tool is called by its own name, or by tools/call with a name and arguments. Lines that are too
    long or not JSON, wrong methods, arguments that are missing, unknown or of another type, and languages
    that aren't loaded get an error, and the rest goes on. Languages of a request make a lexicon of their
    own, so merging and allow phrases are theirs. Stateless: it can follow any stream or table.
    """
    long = F.length("value") > LONGEST_LINE
    read = lines.where(F.trim("value") != "").select(F.try_parse_json(F.when(~long, F.col("value"))).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(get(path, "variant")), F.lit("missing"))
    named = read.select("v", F.schema_of_variant("v").alias("whole"), kind("$.id").alias("id_kind"), kind("$.method").alias("method_kind"), get("$.jsonrpc", "string").alias("version"), get("$.method", "string").alias("said"))
    called = F.col("said") == "tools/call"
    method = F.when(called, get("$.params.name", "string")).otherwise(F.col("said"))
    named = named.withColumn("method", method).withColumn("args", F.coalesce(F.when(called, get("$.params.arguments", "variant")).otherwise(get("$.params", "variant")), F.parse_json(F.lit("{}"))))
    arg = lambda name, as_kind: F.try_variant_get("args", f"$.{name}", as_kind)
    arg_kind = lambda name: F.coalesce(F.schema_of_variant(arg(name, "variant")), F.lit("missing"))
    absent = lambda name: arg_kind(name).isin("missing", "VOID")
    tool = F.col("method").isin(*TOOLS)
    takes = F.coalesce(F.create_map(*[x for name, own in TOOLS.items() for x in (F.lit(name), F.array(*map(F.lit, own)).cast("array<string>"))])[F.col("method")], F.array().cast("array<string>"))
    loaded = F.array(*[F.lit(p.language) for p in options.packs]).cast("array<string>")
    languages = arg("languages", "array<string>")
    bad_argument = (
        ~F.schema_of_variant("args").startswith("OBJECT")
        | (F.size(F.array_except(F.coalesce(F.json_object_keys(F.to_json("args")), F.array().cast("array<string>")), takes)) > 0)
        | ((F.col("method") != "list_languages") & (arg_kind("text") != "STRING"))
        | (~absent("minSeverity") & ((arg_kind("minSeverity") != "BIGINT") | ~F.coalesce(arg("minSeverity", "long").between(0, 4), F.lit(False))))
        | (~absent("mask") & ((arg_kind("mask") != "STRING") | (arg("mask", "string") == "")))
        | (~absent("keepFirst") & (arg_kind("keepFirst") != "BOOLEAN"))
        | (~absent("languages") & ((arg_kind("languages") != "ARRAY<STRING>") | (F.size(F.array_except(languages, loaded)) > 0)))
    )
    code = (
        F.when(F.col("v").isNull(), PARSE_ERROR)
        .when(~F.col("whole").startswith("OBJECT") | F.coalesce(F.col("version") != "2.0", F.lit(True)) | (F.col("method_kind") != "STRING") | ~F.col("id_kind").isin("STRING", "BIGINT", "VOID", "missing"), INVALID_REQUEST)
        .when(F.coalesce(~F.col("method").isin(*METHODS) | (called & ~tool), F.lit(True)), NO_METHOD)
        .when(tool & F.coalesce(bad_argument, F.lit(True)), INVALID_PARAMS)
    )
    given = [F.coalesce(arg("minSeverity", "int"), F.lit(0)).alias("least"), F.coalesce(arg("mask", "string"), F.lit("*")).alias("mask"), F.coalesce(arg("keepFirst", "boolean"), F.lit(False)).alias("keep_first")]
    shown = F.when(F.col("id_kind").isin("STRING", "BIGINT"), F.to_json(get("$.id", "variant")))
    rows = named.select(shown.alias("id"), "id_kind", "method", arg("text", "string").alias("text"), *given, languages.alias("languages"), get("$.params.protocolVersion", "string").alias("asked"), code.alias("error"))
    rows = rows.where(F.col("error").isNotNull() | (F.col("id_kind") != "missing"))  # a notification is a fair request without an id
    scans = F.col("error").isNull() & F.col("method").isin("check_text", "scan_text", "censor_text")
    rows = rows.withColumn("text", F.when(scans, F.col("text")))
    found = rows.withColumn("scan_", moderation.scan_each(F.col("text"), F.col("least"), F.col("mask"), F.col("keep_first"), F.coalesce(F.col("method") == "censor_text", F.lit(False)), F.col("languages"), options))
    return found.select("id", "method", F.when(F.col("error").isNull() & ~F.col("scan_.failed"), result(options, loaded)).alias("result"), F.when(F.col("scan_.failed"), INTERNAL_ERROR).otherwise(F.col("error")).alias("error"))


def result(options: Options, loaded: Column) -> Column:
    """What a method answers, as JSON."""
    matches = F.col("scan_.matches")
    used = F.filter(loaded, lambda c: F.col("languages").isNull() | F.array_contains("languages", c))
    scanned = F.struct((F.size(matches) == 0).alias("clean"), F.size(matches).alias("matchCount"), F.col("scan_.max_severity").alias("maxSeverity"), F.when(F.col("method") == "check_text", used).alias("languages"), F.when(F.col("method") == "scan_text", matches).alias("matches"), F.col("scan_.censored").alias("censored"))
    catalogue = {"languages": summaries(options), "defaultLanguages": [p.language for p in options.packs]}
    tools = {"tools": [{"name": name, "inputSchema": {"type": "object", "properties": {k: {} for k in own}, "required": ["text"] if own else []}} for name, own in TOOLS.items()]}
    version = F.when(F.col("asked").isin(*VERSIONS), F.col("asked")).otherwise(F.lit(VERSIONS[0]))
    started = F.to_json(F.struct(version.alias("protocolVersion"), F.parse_json(F.lit('{"tools": {}}')).alias("capabilities"), F.struct(F.lit("wardlight").alias("name"), F.lit(__version__).alias("version")).alias("serverInfo")))
    written = lambda x: F.lit(json.dumps(x, ensure_ascii=False, separators=(",", ":")))
    return (
        F.when(F.col("method") == "initialize", started)
        .when(F.col("method") == "ping", F.lit("{}"))
        .when(F.col("method") == "tools/list", written(tools))
        .when(F.col("method") == "list_languages", written(catalogue))
        .otherwise(F.to_json(scanned))
    )


def stream_lines(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """Answers to text files of lines as they arrive under path."""
    return answer(spark.readStream.format("text").load(path), options)


def severity_windows(scanned: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Matches and the highest severity in windows of event time; scanned has ts and a scan column `scan`. State ends with the watermark."""
    rows = scanned.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("window")).agg(F.count("*").alias("texts"), F.sum(F.size("scan.matches")).alias("matches"), F.max("scan.max_severity").alias("max_severity"))
