"""Secret scans: fixed patterns, and novelty of candidates under dictionary-primed zstandard.

A candidate is a run of 20 or more key characters, letters and digits among them, that stands
shortly after a sensitive word. Its novelty is what it adds to the compressed size of the text around
it, in bytes per character, when the compressor is primed with that text's surroundings and a
dictionary of identifiers: names, paths and whatever repeats nearby cost little, keys cost nearly
all of their length. Candidates of at least ``NOVELTY`` are reported, unless a pattern has them.

Spans are (kind, start, end) in code points, end exclusive.

Defined cases: null and empty texts have no spans; spans of one kind never overlap; rows are neither
merged nor reordered; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOVELTY, AROUND, REACH, LEAST = 0.82, 512, 48, 20
KINDS = ("assign", "access", "hex", "novel")

# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Words that make what follows sensitive, and common identifiers that prime the compressor.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private", "credential", "authorization", "bearer", "signature", "client_id", "session")
IDENTIFIERS = (
    "import export default function return const static public private protected class interface extends implements string number boolean integer "
    "configuration environment application connection database username hostname password secret_token access_key_id secret_access_key "
    "authorization bearer content-type application/json https://www.example.com/index.html localhost127.0.0.1 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 aaaaaaaaaaaaaaaaaaaaaaaa xxxxxxxxxxxxxxxxxxxxxxxx 000000000000000000000000 "
    "my-service-name-production some_long_identifier_name getElementById addEventListener requestAnimationFrame "
    "UserAccountServiceManager RequestHandlerFactory SessionControllerBuilder ClientConnectionConfig TableColumnIndexRecord EventQueueWorker PageWidgetLayoutButton "
    "ImportExportReportSummary DailyBackupArchive TokenValueCache ProfileImageStoreResult "
    "user_account_service_manager request_handler_factory session_controller_builder client_connection_config table_column_index_record event_queue_worker page_widget_layout_button "
    "release-2023.01.02-beta1 version-1.0.0 build-2024-10-11T12:13:14Z 2025-12-31_08:30:00 v2/index_v3/2022/09/15"
)
RUN, LETTER, DIGIT = re.compile(r"[A-Za-z0-9+/_.=-]+"), re.compile("[A-Za-z]"), re.compile("[0-9]")
NEAR = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)


@lru_cache(1)
def compressor() -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False, write_checksum=False)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes per character of text[start:end], given the text around it."""
    around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND] + "\n").encode()
    size = lambda data: len(compressor().compress(data))
    return (size(around + text[start:end].encode()) - size(around)) / (end - start)


def patterns(text: str) -> list[tuple[str, int, int]]:
    lower = text.lower()
    found = []
    if any(x in lower for x in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    base = patterns(text)
    found = list(base)
    reached = 0
    for word in NEAR.finditer(text):
        if word.end() < reached:
            continue
        for m in RUN.finditer(text, word.end()):
            start, end = m.span()
            if start > word.end() + REACH:
                break
            if start < reached:
                continue
            reached = end
            if end - start < LEAST or not LETTER.search(m[0]) or not DIGIT.search(m[0]):
                continue
            if not any(a < end and start < b for _, a, b in base) and novelty(text, start, end) >= NOVELTY:
                found.append(("novel", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, spans (array of kind, start, end; in order)."""
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], [key, "spans"])

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"`{key}` {kind}, spans {SPANS}")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
