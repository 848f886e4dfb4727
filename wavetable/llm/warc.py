"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256, record headers are kept exactly and apart, and the original
records come back by joining the two. What a reader learns of a record is read from the record: its type, its length and the record
it refers to, whose id is looked up among the responses. The digest is checked again on reading; a payload that does not match its
name, a block whose length is not the stated one and a reference to no response raise an error. Of records with equal payloads the one with the largest id is the response, the others
revisit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import stored

CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws("/", page.cast("string"), row.cast("string")).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                  date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``folder/payloads`` (sha256, payload) and ``folder/headers`` (page_id, sha256, header, n: bytes of the payload).

    A null payload is empty. Null ids count as smaller than all others. Of equal ids with equal payloads the last
    row is the response. Rows are never dropped; an empty table gives an empty archive. Other columns are ignored.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    # equal payloads meet map-side first, so a payload that a third of the pages share is shuffled once per task
    once = source.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    records = stored(source.select(
        "page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"),
        F.length("payload").cast("long").alias("n"), F.monotonically_increasing_id().alias("row")), "warc-records")
    first = records.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("response"))
    both = records.join(first, "sha256")
    own = F.col("row") == F.col("response.row")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(own, "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        line("WARC-Target-URI", address), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.when(own, F.lit("")).otherwise(F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("response.page_id"), F.col("response.row"))))),
        line("Content-Length", F.when(own, F.col("n")).otherwise(F.lit(0)).cast("string")), F.lit(CRLF))
    out = both.select("page_id", "sha256", header.cast("binary").alias("header"), "n")
    out.write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, header, payload, record (the bytes of the WARC record), refers_to (page_id of the record named in WARC-Refers-To);
    payloads are checked against their digest."""
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads")
    fails = lambda text, column, kind: F.raise_error(F.concat(F.lit(text), column)).cast(kind)
    revisit = field("WARC-Type") == "revisit"
    responses = headers.where(~revisit).select(field("WARC-Record-ID").alias("_id"), F.col("page_id").alias("_page"))
    target = F.when(revisit, field("WARC-Refers-To"))
    headers = headers.join(responses, target == F.col("_id"), "left")
    found = F.when(target.isNull() | F.col("_id").isNotNull(), F.col("_page")).otherwise(
        fails("no response has the id ", target, headers.schema["_page"].dataType))
    headers = headers.select("page_id", "sha256", "header", "n", found.alias("refers_to"))
    # a left join: a header whose payload is lost fails the check below instead of vanishing
    both = headers.join(payloads, "sha256", "left")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.length("payload") == F.col("n"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(fails("payload does not match digest ", F.col("sha256"), "binary"))
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return both.select("page_id", "header", checked.alias("payload"), "refers_to").select(
        "page_id", "header", "payload", "refers_to", F.concat("header", block, F.lit((CRLF * 2).encode())).alias("record"))


def block_of(record: str = "record", header: str = "header") -> Column:
    """The block of a rebuilt record, from its bytes: what follows the empty line, as long as Content-Length says and then two line ends."""
    size = field("Content-Length").cast("int")
    whole = F.length(record) == F.length(header) + size + 4
    ends = F.expr(f"substring({record}, length({record}) - 3)") == F.lit((CRLF * 2).encode())
    return F.when(whole & ends, F.expr(f"substring({record}, length({header}) + 1, length({record}) - length({header}) - 4)")).otherwise(
        F.raise_error(F.concat(F.lit("the block is not as long as stated: "), size.cast("string"))).cast("binary"))


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the archive in the shared folder and read it back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_archive(pages, folder, **columns)
    return read_archive(pages.sparkSession, folder)


def field(name: str) -> Column:
    """A named header field of a record."""
    return F.regexp_extract(F.col("header").cast("string"), rf"(?s)(?:^|\n){name}: (.*?)\r\n", 1)
