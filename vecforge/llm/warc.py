"""WARC records, and the resolution of not-modified revisits.

A server's 304 answer leaves a revisit record without a payload. It is resolved by an as-of join: of the captures of the
same canonical URL, the latest full response before it. The revisit's validators must agree with that response's (ETag by
weak comparison where both have one, Last-Modified otherwise); then the payload is the response's and its headers are
updated by those of the 304 that a cache may take over.

The as-of join is two-level: within a URL, captures are split at quantiles of the time, as many as the captures need. A pre-aggregated maximum gives
each slice's last response, a short window carries it to later slices, and a window within each slice finds the rest. So a URL
with a third of all captures spreads over as many tasks as there are slices. Payloads never travel through it.

Defined cases: revisits without an earlier response, or with other validators, are kept and say so; a revisit without
any validator never matches one. Of captures at the same time, a response with a smaller id comes first, and a response
before a revisit. A null URL is a URL of its own kind that matches nothing. Header names are compared in lower case; the
last of repeated ones counts. A record that can't be parsed gives a row with type `invalid` and the error among its headers;
reading goes on at the next record. Records of other types than response and revisit have their block as payload and the
outcome `no capture`. Files may be plain or a series of gzip members. A record's time is that of its WARC-Date in
microseconds, or the date itself where it is a bare number; its capture number is that of `<urn:capture:n>`, or a 63-bit
hash of any other record id. A null or empty file has no records.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Headers that a 304 doesn't update: they describe the payload, or the connection.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't change a page.
IGNORED_PARAMETERS = r"^(ref|fbclid|gclid|sessionid|utm_[a-z]+)(=|$)"
#: Captures of a slice of time, and slices at most.
SLICE_ROWS, MOST_SLICES = 250_000, 1024
#: Bytes of payloads that a batch of records holds before it goes on.
HELD_BYTES = 16_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host without default port, path without a final slash, kept parameters in order, no fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(IGNORED_PARAMETERS))))
    return F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def record(kind: str, uri: str, at: int, number: int, status: str, headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC 1.1 record around an HTTP answer."""
    http = "".join([f"HTTP/1.1 {status}\r\n", *(f"{k}: {v}\r\n" for k, v in headers.items()), "\r\n"]).encode() + payload
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:capture:{number}>", "WARC-Date": str(at), "WARC-Target-URI": uri, "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(http))}
    if kind == "revisit":
        lines["WARC-Profile"] = PROFILE
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines.items()), "\r\n"]).encode() + http + b"\r\n\r\n"


def fields(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def members(data: bytes) -> bytes:
    """The bytes of a file of gzip members; what comes after a damaged one is lost, and says so."""
    out = []
    while data:
        reader = zlib.decompressobj(31)
        try:
            out.append(reader.decompress(data))
        except zlib.error:
            out.append(b"damaged gzip member")
            break
        data = reader.unused_data.lstrip(b"\0")
    return b"".join(out)


def moment(date: str) -> int:
    """Microseconds since 1970 of an ISO date, UTC unless it says otherwise; a bare number as it is."""
    if date.isdigit():
        return int(date)
    then = datetime.fromisoformat(date)
    then = then if then.tzinfo else then.replace(tzinfo=UTC)
    gone = then - datetime(1970, 1, 1, tzinfo=UTC)
    return (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds


def capture_number(record_id: str) -> int:
    bare = record_id.removeprefix("<urn:capture:").removesuffix(">")
    return int(bare) if bare.isdigit() else int.from_bytes(hashlib.blake2b(record_id.encode(), digest_size=8).digest(), "big") >> 1


def one_record(warc: dict[str, str], block: bytes) -> dict:
    kind = warc.get("warc-type")
    if not kind:
        raise ValueError("a record without a type")
    row = {"capture": capture_number(warc.get("warc-record-id", "")), "at": moment(warc["warc-date"]), "type": kind, "url": warc.get("warc-target-uri"), "status": None, "headers": [], "payload": block, "record": warc.get("warc-record-id")}
    if kind in ("response", "revisit") and (block.startswith(b"HTTP/") or "application/http" in warc.get("content-type", "")):
        head, _, payload = block.partition(b"\r\n\r\n")
        line, headers = fields(head)
        row |= {"status": int(line.split(" ")[1]), "headers": list(headers.items()), "payload": payload}
    return row


def parse(data: bytes):
    """A row for each record of a WARC file."""
    if data.startswith(b"\x1f\x8b"):
        data = members(data)
    at = 0
    while at < len(data):
        try:
            end = data.find(b"\r\n\r\n", at)
            if not data.startswith(b"WARC/", at) or end < 0:
                raise ValueError("not a WARC record")
            _, warc = fields(data[at:end])
            size = int(warc["content-length"])
            block = data[end + 4 : end + 4 + size]
            if size < 0 or len(block) < size:
                raise ValueError("a record is too short")
            after = end + 4 + size
            if after < len(data) and not data.startswith(b"\r\n", after):
                raise ValueError("a record's length is wrong")
            while data.startswith(b"\r\n", after):
                after += 2
        except (ValueError, KeyError) as e:
            # The next record is where a line begins like one.
            yield {"type": "invalid", "headers": [("error", str(e))]}
            found = data.find(b"\nWARC/", at + 1)
            at = found + 1 if found >= 0 else len(data)
            continue
        try:
            yield one_record(warc, block)
        except (ValueError, KeyError, IndexError, OverflowError) as e:
            yield {"type": "invalid", "url": warc.get("warc-target-uri"), "headers": [("error", f"{type(e).__name__}: {e}")], "record": warc.get("warc-record-id")}
        at = after


RECORDS = "capture long, at long, type string, url string, status int, headers map<string,string>, payload binary"


def records(files: DataFrame, column: str = "warc") -> DataFrame:
    """The records of a binary column of WARC files, with the records' ids as they are written."""

    def run(batches):
        schema = pa.schema([("capture", pa.int64()), ("at", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("record", pa.string())])
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for data in batch.column(0):
                for row in parse(data.as_py() or b""):
                    rows.append(row)
                    held += len(row.get("payload", b""))
                    if held > HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(column).mapInArrow(run, RECORDS + ", record string")


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def time_edges(narrow: DataFrame, rows: int) -> list[int]:
    """Quantiles of the time that cut the captures into slices of about so many rows, MOST_SLICES at most."""
    slices = max(1, min(MOST_SLICES, narrow.count() // rows))
    if slices == 1:
        return []
    return sorted({*narrow.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)], 20_000)).first()[0]})


def resolve(captures: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """Every capture with its canonical URL, outcome, the response that it resolves to, merged headers and payload."""
    response = F.col("type") == "response"
    # Parsed once for all that the as-of join reads; it has no payloads.
    narrow = stored(captures.where("type in ('response', 'revisit')").select("capture", "at", "type", canonical(F.col("url")).alias("page")))
    narrow = narrow.withColumn("full", F.when(response, F.struct("at", F.lit(0).alias("z"), "capture")))
    edges = time_edges(narrow, rows)
    edge = F.array(*(F.lit(e) for e in edges)) if edges else F.array().cast("array<long>")
    sliced = narrow.withColumn("slice", F.size(F.filter(edge, lambda e: e < F.col("at"))))
    last = sliced.groupBy("page", "slice").agg(F.max("full").alias("last"))
    carried = last.select("page", "slice", F.max("last").over(Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # A revisit comes after the responses of its own time.
    w = Window.partitionBy("page", "slice").orderBy("at", F.when(response, 0).otherwise(1), "capture").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sliced.where("page is not null").withColumn("own", F.max("full").over(w)).join(carried, ["page", "slice"], "left")
    original = F.greatest("own", F.coalesce("carried", F.col("own")), F.coalesce("own", F.col("carried")))["capture"]
    found = seen.where("type = 'revisit'").select("capture", "at", original.alias("original")).dropDuplicates(["capture", "at"])
    # A payload is shuffled once, to meet its own response and the revisits that resolve to it.
    lone = F.when(response & F.col("capture").isNotNull(), F.lit(None)).otherwise(F.col("payload"))
    asks = captures.select("capture", "at", "type", "url", "headers", lone.alias("payload")).join(found, ["capture", "at"], "left")
    asks = asks.withColumn("source", F.when(response, F.col("capture")).otherwise(F.col("original")))
    bodies = captures.where(response).select(F.col("capture").alias("source"), F.col("headers").alias("old"), F.col("payload").alias("body")).dropDuplicates(["source"])
    # Captures without a source match nothing; a hash of their own deals them out, so that no task gets them all.
    asks = asks.withColumns({"known": F.col("source").isNotNull(), "source": F.coalesce("source", F.xxhash64("capture", "at", "url"))})
    joined = asks.join(bodies.withColumn("known", F.lit(True)), ["source", "known"], "left")
    new, old = F.col("headers"), F.col("old")
    both_tags = new["etag"].isNotNull() & old["etag"].isNotNull()
    agrees = F.when(both_tags, weak(new["etag"]) == weak(old["etag"])).otherwise(F.coalesce(new["last-modified"] == old["last-modified"], F.lit(False)))
    kind = F.coalesce("type", F.lit("invalid"))
    outcome = F.when(kind == "invalid", "invalid").when(response, "response").when(kind != "revisit", "no capture").when(F.col("original").isNull(), "no earlier response").when(agrees, "resolved").otherwise("other validator")
    taken = F.map_filter(new, lambda k, v: ~k.isin(*FIXED_HEADERS))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(taken), k)), taken)
    ok = F.col("outcome") == "resolved"
    out = joined.withColumn("outcome", outcome)
    payload = F.when(ok | response, F.coalesce("body", "payload")).otherwise(F.col("payload"))
    return out.select("capture", "at", "type", canonical(F.col("url")).alias("page"), "outcome", F.when(ok, F.col("original")).alias("original"), F.when(ok, merged).otherwise(new).alias("headers"), payload.alias("payload"))


def archive(pages: DataFrame) -> DataFrame:
    """A WARC file for each page: its response at 10 times its id and a revisit 4 ticks later.

    Every fifth revisit has another ETag, every seventh none (its Last-Modified decides); every eleventh page has no
    response of its own, so that its revisit can only meet another capture of the same page.
    """

    def run(batches):
        for batch in batches:
            out = []
            for number, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = (html or "").encode()
                n = number or 0
                tag = f'"{n}"'
                full = {"Content-Type": "text/html", "Content-Length": str(len(body)), "ETag": tag, "Last-Modified": str(n // 100), "Cache-Control": "max-age=1"}
                again = {"ETag": f'W/"x{n}"' if n % 5 == 0 else f"W/{tag}", "Last-Modified": str(n // 100), "Cache-Control": "max-age=2", "Content-Type": "none"}
                if n % 7 == 0:
                    del again["ETag"]
                made = record("revisit", url or "", 10 * n + 4, 2 * n + 1, "304 Not Modified", again, b"")
                out.append((b"" if n % 11 == 0 else record("response", url or "", 10 * n, 2 * n, "200 OK", full, body)) + made)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["warc"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "warc binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records(archive(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return resolve(got).select("capture", "at", "type", "page", "outcome", "original", headers.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


ORACLE = r"""
with u as (select page_id n, coalesce(html, '') html, regexp_replace(trim(url), '#.*$', '') bare from pages),
p as (select n, html,
  regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)), '^(http://[^:]*):80$', '\1'), '^(https://[^:]*):443$', '\1')
  || regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') head,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(ref|fbclid|gclid|sessionid|utm_[a-z]+)(=|$)'))) kept from u),
c as (select n, html, head || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end page from p),
full_ as (select 2 * n capture, 10 * n at_, page, n, html from c where n % 11 <> 0),
rev as (select r.n, 2 * r.n + 1 capture, 10 * r.n + 4 at_, r.page,
  (select max({'a': f.at_, 'c': f.capture, 'n': f.n}) from full_ f where f.page = r.page and f.at_ <= 10 * r.n + 4) o from c r),
chk as (select *, case when o is null then 'no earlier response'
  when case when n % 7 <> 0 then (n % 5 <> 0 and o.n = n) else n // 100 = o.n // 100 end then 'resolved' else 'other validator' end outcome from rev)
select capture, at_ "at", 'response' "type", page, 'response' outcome, null::bigint original,
  'cache-control=max-age=1;content-length=' || strlen(html) || ';content-type=text/html;etag="' || n || '";last-modified=' || (n // 100) headers, sha256(html) payload_sha256 from full_
union all
select chk.capture, chk.at_, 'revisit', chk.page, outcome, case when outcome = 'resolved' then o.c end,
  case when outcome = 'resolved' then 'cache-control=max-age=2;content-length=' || strlen(f.html) || ';content-type=text/html;etag=' || case when chk.n % 7 = 0 then '"' || f.n || '"' else 'W/"' || chk.n || '"' end || ';last-modified=' || (chk.n // 100)
  else 'cache-control=max-age=2;content-type=none' || case when chk.n % 7 = 0 then '' when chk.n % 5 = 0 then ';etag=W/"x' || chk.n || '"' else ';etag=W/"' || chk.n || '"' end || ';last-modified=' || (chk.n // 100) end,
  sha256(case when outcome = 'resolved' then f.html else '' end)
from chk left join full_ f on f.capture = o.c
"""
