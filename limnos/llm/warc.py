"""WARC archives with revisit resolution.

Records are put together as text and written by Spark's text sink with CR LF as line end, so a task that fails leaves no
half file and any file system that Spark knows will do. Each record's first header names the archive's warcinfo record, whose
id is made when the writing starts; no payload can hold that line, so the reader cuts files there and checks lengths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.common import new_folder, staged

# Names and formats of the WARC 1.1 standard; the writer's HTTP headers are shorter than HTTP_BYTES.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_BYTES = 4096
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a SHA-1: 5 hex digits make 4 letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _headers(**values: Column) -> Column:
    """Header lines; a null value leaves its line out."""
    lines = [F.coalesce(F.concat(F.lit(name.replace("_", "-") + ": "), value.cast("string"), F.lit(CRLF)), F.lit("")) for name, value in values.items()]
    return F.concat(*lines)


def write_archive(records: DataFrame, path: str) -> str:
    """Write records (record_id, page_id, uri, record_type, payload, payload_bytes, payload_digest, refers_to_record,
    refers_to, refers_to_uri) and a warcinfo record; returns the archive's id.

    The payload stands behind an HTTP header; a revisit has the header alone, with the length of the full payload.
    """
    name = str(uuid.uuid4())
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    made = records.select("*", block.alias("__block"))
    line = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{name}>{CRLF}"), _headers(
        WARC_Type=F.col("record_type"), WARC_Record_ID=F.concat(F.lit("<urn:uuid:"), "record_id", F.lit(">")), WARC_Date=now,
        WARC_Target_URI=F.regexp_replace("uri", "[\\x00-\\x20\\x7F]", "%20"), X_Page_ID=F.col("page_id"),
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), "payload_digest"), WARC_Profile=F.when(revisit, F.lit(PROFILE)),
        WARC_Refers_To=F.concat(F.lit("<urn:uuid:"), "refers_to_record", F.lit(">")), X_Refers_To_Page_ID=F.col("refers_to"),
        WARC_Refers_To_Target_URI=F.regexp_replace("refers_to_uri", "[\\x00-\\x20\\x7F]", "%20"),
        Content_Type=F.lit("application/http; msgtype=response"), Content_Length=F.octet_length("__block")),
        F.lit(CRLF), F.col("__block"), F.lit(CRLF))
    made.select(line.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)
    info = "software: limnos" + CRLF
    head = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{name}>{CRLF}Content-Type: application/warc-fields{CRLF}"
    (records.sparkSession.range(1).select(F.concat(F.lit(head), _headers(WARC_Date=now, Content_Length=F.lit(len(info))), F.lit(CRLF + info + CRLF)).alias("value"))
     .write.mode("append").option("lineSep", CRLF).option("compression", "gzip").text(path))
    return name


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("__head", f"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def _id(name: str) -> Column:
    return F.regexp_extract(_field(name), "<urn:uuid:(.*)>", 1)


def _parts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(__head, __http, __raw, __at): header lines, HTTP header lines, bytes of the record, place of the block in them."""
    text = spark.read.option("lineSep", f"WARC-Warcinfo-ID: <urn:uuid:{name}>{CRLF}").text(path).where(F.col("value").startswith("WARC-Type: "))
    head = F.substring_index("value", CRLF * 2, 1)
    parts = text.select(F.concat(F.lit(CRLF), head).alias("__head"), F.col("value").cast("binary").alias("__raw"), (F.octet_length(head) + 5).alias("__at"))
    # the HTTP header is short and ends at the first empty line of the block
    http = F.substring_index(F.substring(F.col("__raw"), F.col("__at"), F.lit(HTTP_BYTES)).cast("string"), CRLF * 2, 1)
    return parts.select("__head", http.alias("__http"), "__raw", "__at")


def read_heads(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(record_id, page_id, uri, payload_digest, payload_bytes) of an archive's records as their headers tell them."""
    return _parts(spark, path, name).select(
        _id("WARC-Record-ID").alias("record_id"), _field("X-Page-ID").cast("long").alias("page_id"), _field("WARC-Target-URI").alias("uri"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.regexp_extract("__http", "Content-Length: ([0-9]+)", 1).cast("long").alias("payload_bytes"))


def read_archive(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Records of an archive, as given to `write_archive`; a response's length and digest are taken from its payload."""
    kind = _field("WARC-Type")
    size = F.octet_length("__http") + 4
    payload = F.substring(F.col("__raw"), F.col("__at") + size, _field("Content-Length").cast("int") - size)
    out = _parts(spark, path, name).select(
        _id("WARC-Record-ID").alias("record_id"), _field("X-Page-ID").cast("long").alias("page_id"), _field("WARC-Target-URI").alias("uri"),
        kind.alias("record_type"), F.when(kind == "response", payload).alias("payload"), _field("WARC-Payload-Digest").alias("__digest"),
        F.when(kind == "revisit", F.regexp_extract("__http", "Content-Length: ([0-9]+)", 1)).cast("long").alias("__told"),
        F.nullif(_id("WARC-Refers-To"), F.lit("")).alias("refers_to_record"),
        _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"), _field("WARC-Refers-To-Target-URI").alias("refers_to_uri"))
    return out.select(
        "record_id", "page_id", "uri", "record_type", F.col("payload").cast("string").alias("payload"),
        F.coalesce("__told", F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.substring_index("__digest", ":", -1)).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "refers_to_record", "refers_to", "refers_to_uri")


def resolve_revisits(records: DataFrame, heads: DataFrame, least: int = 0) -> DataFrame:
    """Records with revisits in place of repeated payloads; `heads` has the headers of the same records (see `read_heads`).

    Headers go by payload digest and length; of equal payloads of at least `least` bytes the record with the largest
    page_id stays the response (a null page_id is the smallest; of equal ones the largest record_id), and the others
    revisit it. Maxima are taken before the shuffle, so a payload that many records share is no large group.
    """
    heads = heads.where(F.col("payload_bytes") >= least)
    first = heads.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id", "uri")).alias("__first"))
    again = (heads.join(first, ["payload_digest", "payload_bytes"]).where("record_id <> __first.record_id")
             .select("record_id", F.col("__first.record_id").alias("refers_to_record"), F.col("__first.page_id").alias("refers_to"),
                     F.col("__first.uri").alias("refers_to_uri"), F.lit(True).alias("__again")))
    return (records.drop("record_type", "refers_to_record", "refers_to", "refers_to_uri").join(again, "record_id", "left")
            .withColumn("record_type", F.when(F.col("__again"), "revisit").otherwise("response")).drop("__again"))


def page_records(pages: DataFrame) -> DataFrame:
    """A response record for each row of pages (page_id, url, html); a null html is an empty payload."""
    payload = F.coalesce("html", F.lit(""))
    empty = F.lit(None).cast("string")
    return pages.select(
        F.expr("uuid()").alias("record_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), F.lit("response").alias("record_type"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"),
        empty.alias("refers_to_record"), empty.cast("long").alias("refers_to"), empty.alias("refers_to_uri"))


def warc_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the deduplicated archive of pages.

    Writes an archive of responses to the shared folder, resolves it, writes the deduplicated archive with fresh
    headers and reads that. Each row is a record, repeated rows too; a null page_id stays null; a null url has no header;
    blanks and control characters in a url are written as %20; an empty table makes an archive of a warcinfo record.
    """
    spark = pages.sparkSession
    raw, final = new_folder(spark, "warc"), new_folder(spark, "warc-deduplicated")
    name = write_archive(page_records(pages), raw)
    heads = staged(read_heads(spark, raw, name), "warc-heads")
    done = read_archive(spark, final, write_archive(resolve_revisits(read_archive(spark, raw, name), heads, least), final))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX = "0123456789abcdef"
_CHUNK = "list_sum(list_transform(range(1, 6), lambda k: (strpos('" + _HEX + "', substr(h, 5 * (i // 4) + k::INT, 1)) - 1) * (16 ** (5 - k))::BIGINT))::BIGINT"
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('{BASE32}', 1 + (({_CHUNK} >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
