"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive lie: headers (one row a record) and payloads (one row a distinct payload)."""

    headers: str
    payloads: str


def write_archive(pages: DataFrame, path: str, min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write a WARC record per row of pages (page_id, url, html) under path.

    Payload: the html in UTF-8 (null: empty). The content address is its SHA-256. Of the records with equal
    payloads of at least min_revisit bytes, the one with the largest page_id is the response and the others
    revisit it; all smaller ones are responses. Payload bytes are stored once for each address, whatever the
    number of records; headers keep every byte of a record before its payload.

    Null url: no WARC-Target-URI line. Control characters in a url are percent-encoded, so that a header
    stays one line. Null page_id: ranks lowest, its record id is urn:page:null. Rows with one page_id and one
    payload are records of their own, and those with the largest page_id are responses all. Empty input: two
    empty tables. Other columns are ignored.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumn("address", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    slim = p.select("page_id", "url", "address", "payload_bytes", F.sha1("payload").alias("sha1"))
    first = slim.groupBy("address").agg(F.max("page_id").alias("holder"))
    rec = slim.join(first, "address")
    revisit = (F.col("payload_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    kind = F.when(revisit, "revisit").otherwise("response")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("holder")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    to = Archive(f"{path}/headers", f"{path}/payloads")
    rec.select("address", F.encode(header, "UTF-8").alias("header")).write.parquet(to.headers)
    # The holder's row brings the bytes, known by 128 bits of hash of address and page_id: a much copied payload moves
    # once, not with every copy, and repeated rows of a holder meet where the join has put them.
    k1, k2 = F.xxhash64(F.lit(1), "page_id", "address").alias("k1"), F.xxhash64(F.lit(2), "address", "page_id").alias("k2")
    holders = first.withColumnRenamed("holder", "page_id").select(k1, k2)
    one = p.select(k1, k2, "address", "payload").join(holders, ["k1", "k2"], "left_semi")
    one = one.dropDuplicates(["k1", "k2"]).select("address", "payload")
    one.write.parquet(to.payloads)
    return to


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record: (address, header, payload, intact), intact being whether the bytes still have their address.

    The payload of a revisit is that of the record it refers to.
    """
    stored = spark.read.parquet(archive.payloads)
    stored = stored.withColumn("intact", F.sha2("payload", 256) == F.col("address"))
    return spark.read.parquet(archive.headers).join(stored, "address", "left")


def record_bytes(records: DataFrame) -> DataFrame:
    """records with record: the exact bytes of each WARC record, revisits without payload."""
    body = F.when(header_field("WARC-Type", F.col("header")) == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat("header", body, F.encode(F.lit(CRLF * 2), "UTF-8")))


def header_field(name: str, header: Column) -> Column:
    """The value of a named field in a header; null where the header has none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def page_of(urn: Column) -> Column:
    """The page id in a record id; null for the id of a null page_id."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def parsed(record: Column) -> tuple[Column, Column, Column]:
    """Header (with its blank line) and payload of a record's bytes, and whether the payload is as long as the header says."""
    # Latin 1 has a character for each byte, so that places in the text are places in the bytes.
    ends = F.instr(F.decode(record, "ISO-8859-1"), CRLF * 2) + 3
    header = F.substring(record, F.lit(1), ends)
    length = header_field("Content-Length", header).cast("int")
    payload = F.substring(record, ends + 1, length)
    return header, payload, F.octet_length(record) == ends + length + 4


def digest_table(spark: SparkSession, archive: Archive) -> DataFrame:
    """What the archive says on reading back: page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    Records are rebuilt from headers and payloads, and parsed again: type, ids and digest come from the header in the
    record's bytes, length and SHA-1 of a response from its payload there, those of a revisit from the stored payload it
    refers to. A payload that has changed, or lacks, or differs from the digest in the header, and a record that is not as
    long as it says, raise an error.
    """
    rebuilt = record_bytes(read_archive(spark, archive))
    header, payload, whole = parsed(F.col("record"))
    r = rebuilt.select("address", "intact", header.alias("header"), F.when(header_field("WARC-Type", F.col("header")) == "revisit", F.col("payload")).otherwise(payload).alias("payload"), whole.alias("whole"))
    said = F.regexp_extract(header_field("WARC-Payload-Digest", F.col("header")), "^sha1:(.*)$", 1)
    digest = F.sha1("payload")
    wrong = F.raise_error(F.concat(F.lit("damaged record at "), F.col("address")))
    return r.select(
        page_of(header_field("WARC-Record-ID", F.col("header"))).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("intact") & F.col("whole") & (said == digest), digest).otherwise(wrong).alias("payload_digest"),
        header_field("WARC-Type", F.col("header")).alias("record_type"),
        page_of(header_field("WARC-Refers-To", F.col("header"))).alias("refers_to"),
    )
