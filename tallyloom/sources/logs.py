"""Logs of a run as tables: request records, agent output with spans, printed events, CPU samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.durations import duration_ns
from tallyloom.operators.ranking import ranked

REQUESTS = "schema_version int, identity_kind string, protocol string, negotiated_protocol string, status_code int, error string, side string, conn_key string, stream_id int, trace_id string, timestamp_ns bigint, arrival_ns bigint, control string, duration_ns bigint, response_size bigint, baggage string, path string"
SPAN = "struct<kind:string,traceID:string,spanID:string,parentSpanID:string,start:string,handlerStart:string,end:string,duration:string,host:string,hostName:string,hostPort:string,peer:string,peerName:string,peerPort:string,traceFlags:string,type:string,attributes:map<string,string>>"
CONNECTIONS = "side string, socket_cookie bigint, netns_cookie bigint, boot_id string, saddr string, daddr string, sport int, dport int, pid int, timestamp_ns bigint"
ENTRIES = "pid int, timestamp_ns bigint"

def requests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each request record (JSON lines); lines that can't be read are null rows of the schema."""
    return spark.read.schema(REQUESTS).json(path)


def connections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONNECTIONS).json(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no from 1 and line. Large files are read in splits; the place of a line is its split's, then its own there."""
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    return ranked(own, ["file"], ["_split", "_at"]).select("file", (F.col("rank") + 1).alias("line_no"), "line")


def agent_spans(lines: DataFrame) -> DataFrame:
    """seq from 1 in the order of the file, and the fields of each span, of output that mixes messages with arrays of spans."""
    arrays = lines.filter(F.ltrim("line").startswith("[{"))
    spans = arrays.select("file", "line_no", F.posexplode(F.from_json("line", f"array<{SPAN}>")).alias("at", "s"))
    return ranked(spans, ["file"], ["line_no", "at"]).select("file", (F.col("rank") + 1).alias("seq"), "s.*")


def corrupt_arrays(lines: DataFrame) -> DataFrame:
    """Lines that begin an array of spans and can't be read as one."""
    broken = F.ltrim("line").startswith("[{") & F.try_parse_json("line").isNull()
    return lines.groupBy("file").agg(F.count_if(broken).alias("corrupt"))


def printed_events(lines: DataFrame) -> DataFrame:
    """Events of the text printer; lines that tell one and can't be read are kept, with ``parsed`` false.

    A printed event has a date and a time, the durations in parentheses, then the event with its sub-type, status,
    method and path with its route, separated by blanks, both ends in brackets, and at its end the labelled fields
    ``svc=[name language]`` and ``traceparent=[version-trace-span-flags]``. Each field is read by itself.
    """
    line = F.col("line")
    took = F.substring_index(F.substring_index(line, ") ", 1), "(", -1)
    tokens = F.split(F.substring(line, F.instr(line, ") ") + 2, F.length(line)), " ")
    at = lambda i: F.coalesce(F.get(tokens, F.lit(i)), F.lit(""))
    labelled = lambda name: F.when(F.contains(line, F.lit(f" {name}=[")), F.substring_index(F.substring_index(line, f" {name}=[", -1), "]", 1))
    service, trace = F.split(labelled("svc"), " "), F.split(labelled("traceparent"), "-")
    fields = lines.withColumns({"_event": at(0), "_status": at(1), "_route": at(3), "_service": service, "_trace": trace, "_took": took, "_ends": at(4)})
    named = F.regexp_like("_event", F.lit(r"^\w+\(subType=\d+\)$"))
    whole = [
        named,
        F.regexp_like("_status", F.lit(r"^\d+$")),
        F.contains(F.col("_route"), F.lit("(")) & F.endswith("_route", F.lit(")")),
        F.startswith("_ends", F.lit("[")) & F.contains(F.col("_ends"), F.lit("]->[")),
        (F.size("_service") == 2) & (F.get("_service", F.lit(0)) != ""),
        (F.size("_trace") >= 3) & F.regexp_like(F.get("_trace", F.lit(0)), F.lit(r"^\d\d$")) & F.regexp_like(F.get("_trace", F.lit(1)), F.lit("^[0-9a-f]{32}$")),
    ]
    parsed = F.lit(True)
    for x in whole:
        parsed = parsed & F.coalesce(x, F.lit(False))
    tells = F.contains(line, F.lit("HTTP(subType=")) | F.contains(line, F.lit("HTTPClient(subType="))
    out = fields.withColumn("parsed", parsed).filter(F.col("parsed") | tells)
    values = {
        "event": F.substring_index("_event", "(", 1),
        "status": F.col("_status").try_cast("int"),
        "service": F.get("_service", F.lit(0)),
        "trace_id": F.get("_trace", F.lit(1)),
        "duration_ns": duration_ns(F.substring_index("_took", "[", 1)),
    }
    return out.select("file", "line_no", "parsed", *[F.when(F.col("parsed"), v).alias(n) for n, v in values.items()])


def line_range(lines: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Lines start (from 0) to before end, as a slice of a list takes them."""
    out = lines.filter(F.col("line_no") > start)
    return out if end is None else out.filter(F.col("line_no") <= end)


def core_samples(lines: DataFrame) -> DataFrame:
    """Busy share of each core by second, of lines with twelve columns."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.select(parts.alias("p")).filter((F.size("p") == 12) & F.col("p")[1].rlike(r"^\d+$"))
    return rows.select(F.col("p")[0].alias("second"), F.col("p")[1].cast("int").alias("core"), (100 - F.col("p")[11].cast("double")).alias("busy"))


def process_samples(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.select(parts.alias("p")).filter((F.size("p") >= 10) & F.col("p")[2].rlike(r"^\d+$"))
    return rows.select(F.col("p")[0].alias("second"), F.col("p")[9].alias("process"), F.col("p")[7].cast("double").alias("cpu"))
