"""Not-modified revisit records of web archives, resolved by an as-of join.

A revisit says that a server answered "not modified".  It refers to the
latest earlier full response for the same canonical URL; the validators of
both are checked, and the headers that such an answer may renew (RFC 9110,
section 15.4.5) replace those of the response.

Records are put into ranges by URL, date, kind and id, so that a URL with a
third of all records spreads over many ranges.  Within a range a window finds
the latest response; where a URL spans ranges, the last response of each
earlier range is carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vectorgrove.llm.common import checkpoint

# Header fields, in lower case, that a 304 response may renew.
RENEWABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, user, default port, leading www, utm_ parameters and final slash; host in lower case, parameters sorted."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, scheme + "([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(bare, scheme + "[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "^$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    joined = F.array_join(kept, "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """record_id, refers_to, outcome, digest and the merged headers of every revisit.

    ``records`` has record_id, url, date (any number or timestamp), kind
    ('response' or 'revisit'), status, digest and headers (a map with names
    in lower case).  Full responses are those of status 200.  Earlier means a
    smaller date; of responses of one date the largest id counts as latest.

    outcome is 'resolved' if the ETags are weakly equal or, where one has
    none, the Last-Modified dates are equal; 'unvalidated' if there is nothing
    to compare; 'mismatch' if they differ; 'missing' if no earlier response
    exists.  Only the first two give a reference, a digest and headers.  A
    null URL, date or kind leaves a revisit missing; null headers are no
    headers.  Repeated revisits give repeated rows; a repeated response is the
    same candidate again.  Other columns are not read.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    base = records.where("kind IN ('response', 'revisit')").select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("site"),
        F.col("date"),
        (F.col("kind") == "response").cast("int").alias("full"),
        F.col("status").cast("int").alias("status"),
        "digest",
        headers.alias("headers"),
    )
    base = base.where("full = 0 OR (status = 200 AND site IS NOT NULL AND date IS NOT NULL)")
    order = ("site", "date", "full", "record_id")
    ranged = base.repartitionByRange(partitions, *order) if partitions else base.repartitionByRange(*order)
    ranged = checkpoint(ranged.withColumn("rng", F.spark_partition_id()))
    answer = F.when(F.col("full") == 1, F.struct("record_id", "digest", "headers"))
    # revisits come before responses of their date, as only smaller dates are earlier
    inside = Window.partitionBy("rng", "site").orderBy("date", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    looked = ranged.withColumn("near", F.last(answer, True).over(inside)).where("full = 0")
    ends = ranged.where("full = 1").groupBy("site", "rng").agg(F.max(F.struct("date", "record_id")).alias("e"), F.max_by(F.struct("record_id", "digest", "headers"), F.struct("date", "record_id")).alias("last"))
    starts = looked.where("near IS NULL AND site IS NOT NULL AND date IS NOT NULL").select("site", "rng").dropDuplicates()
    # a row for each URL and range: few for a URL in few ranges, and at most the number of ranges
    carried = (
        ends.select("site", "rng", "last", F.lit(1).alias("is_end"))
        .unionByName(starts.select("site", "rng", F.lit(None).cast(ends.schema["last"].dataType).alias("last"), F.lit(0).alias("is_end")))
        .withColumn("carry", F.last("last", True).over(Window.partitionBy("site").orderBy("rng", "is_end").rowsBetween(Window.unboundedPreceding, 0)))
        .where("is_end = 0 AND carry IS NOT NULL")
        .select(F.col("site").alias("s"), F.col("rng").alias("r"), "carry")
    )
    found = looked.join(carried, (F.col("site") == F.col("s")) & (F.col("rng") == F.col("r")) & F.col("near").isNull(), "left")
    earlier = F.when(F.col("site").isNotNull() & F.col("date").isNotNull(), F.coalesce("near", "carry"))
    found = found.withColumn("hit", earlier)
    mine, theirs = (lambda k: F.col("headers")[k]), (lambda k: F.col("hit.headers")[k])
    both_tags = mine("etag").isNotNull() & theirs("etag").isNotNull()
    both_dates = mine("last-modified").isNotNull() & theirs("last-modified").isNotNull()
    outcome = (
        F.when(F.col("hit").isNull(), "missing")
        .when(both_tags, F.when(_weak(mine("etag")) == _weak(theirs("etag")), "resolved").otherwise("mismatch"))
        .when(both_dates, F.when(mine("last-modified") == theirs("last-modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    renewed = F.map_filter("headers", lambda k, v: k.isin(*RENEWABLE))
    old = F.map_filter(F.col("hit.headers"), lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    good = F.col("outcome").isin("resolved", "unvalidated")
    return found.withColumn("outcome", outcome).select(
        "record_id",
        F.when(good, F.col("hit.record_id")).alias("refers_to"),
        "outcome",
        F.when(good, F.col("hit.digest")).alias("digest"),
        F.when(good, F.map_concat(old, renewed)).alias("headers"),
    )


def headers_text(headers: Column) -> Column:
    """Headers as lines in order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of the records of an uncompressed archive; what is cut off at the end is left out."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = head.get("content-length", "")
        if not size.isdecimal() or end + 4 + int(size) > len(data):
            return
        yield head, data[end + 4 : end + 4 + int(size)]
        at = data.find(b"WARC/", end + 4 + int(size))


def read_archives(files: DataFrame) -> DataFrame:
    """Records for resolve_revisits of archives read with the binaryFile source, compressed by member or not."""
    spec = "record_id long, url string, date string, kind string, status int, digest string, headers map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import zlib

        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for i, (head, body) in enumerate(parse_records(raw)):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    lines = body.split(b"\r\n\r\n", 1)[0].decode("latin-1").split("\r\n")
                    code = lines[0].split(" ")[1:2]
                    names = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                    rows.append((zlib.crc32(path.encode()) << 31 | i, head.get("warc-target-uri"), head.get("warc-date"), kind, int(code[0]) if code and code[0].isdecimal() else None, head.get("warc-payload-digest"), list(names.items())))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                types = pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["record_id", "url", "date", "kind", "status", "digest", "headers"])

    return files.select("path", "content").mapInArrow(run, spec)
