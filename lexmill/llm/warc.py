"""Content-addressed WARC archive.

write_archive() makes a WARC record of each page and stores it in two tables: ``payloads`` has each distinct payload
once, by its SHA-256; ``records`` has every record's exact header block (WARC and HTTP headers) and the digest. read_archive()
joins the two, rebuilds the records, and verifies each payload against its digest. Of records with equal payloads of at
least ``min_revisit`` bytes, that with the largest id is the response and the others revisit it.

The payloads are pre-aggregated in each map task before the one shuffle that carries them, so a payload that a third of all
pages share crosses it once a task. Joins run on the digest; a hot digest is split by adaptive execution.

Defined results: a null html is an empty payload; a null url gives an empty target; of equal payloads whose ids are all
null, or that repeat the largest id, each such row is a response; other columns are ignored; an empty table gives empty archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import new_path

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def _urn(key: Column) -> Column:
    h = F.md5(key.cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), h.substr(13, 4), F.lit("-"), h.substr(17, 4), F.lit("-"), h.substr(21, 12), F.lit(">")
    )


def _record_id(id_: Column, digest: Column) -> Column:
    return _urn(F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("")), digest))


def _head(date: str) -> Column:
    """The bytes of a record before its payload: WARC headers, blank line, HTTP headers, blank line."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"), F.col("sha256"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("sha256")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws(EOL, *lines), F.lit(EOL * 2), http), "UTF-8")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = DATE
) -> None:
    """Write the archive of pages to path/payloads and path/records."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    store = rows.groupBy("sha256").agg(F.max("id").alias("last_id"), F.first("payload").alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    spark = pages.sparkSession
    heads = spark.read.parquet(f"{path}/payloads").select("sha256", "last_id")
    light = rows.select("id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    first = (F.col("n") < min_revisit) | F.col("id").eqNullSafe(F.col("last_id"))
    records = (
        light.join(heads, "sha256")
        .withColumn("record_type", F.when(first, "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(~first, F.col("last_id")))
        .select("id", "sha256", "refers_to", F.col("n").alias("payload_bytes"), _head(date).alias("head"))
    )
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records as written: id, head, payload (joined back by digest and verified), and what the headers say."""
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    records = spark.read.parquet(f"{path}/records")
    intact = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("payload_bytes"))
    text = F.decode("head", "UTF-8")
    return (
        records.join(payloads, "sha256", "left")
        .withColumn("payload", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256")).cast("binary")))
        .select(
            "id",
            "head",
            "payload",
            "refers_to",
            F.regexp_extract(text, "\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
            F.regexp_extract(text, "\r\nWARC-Payload-Digest: sha1:([0-9a-f]+)\r\n", 1).alias("header_sha1"),
        )
    )


def record_bytes(archive: DataFrame) -> DataFrame:
    """id and the exact bytes of each WARC record, ready to be concatenated into .warc files."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("id", F.concat("head", body, F.lit(b"\r\n\r\n")).alias("record"))


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The (headers, block) of each record of an uncompressed .warc file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        n = int(headers["Content-Length"])
        out.append((headers, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back: the digest row of each record."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path).select(
        F.col("id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.sha1("payload") == F.col("header_sha1"), F.col("header_sha1")).otherwise(F.raise_error(F.lit("payload digest differs"))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
