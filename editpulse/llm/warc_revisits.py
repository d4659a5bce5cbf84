"""Not-modified revisits of web captures, resolved to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editpulse.llm.frames import salted_join
from editpulse.sources.staging import stage

#: Header fields of a 304 response that never replace stored ones.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: A URL with more captures than this is cut into slices of time.
SLICED_CAPTURES = 100_000
SLICES = 256


def canonical_url(url: str) -> Column:
    """One spelling per resource: scheme and host in lower case, no fragment, user or default port,
    "/" for an empty path, query parameters sorted and without empty ones. Text without a scheme
    and host only loses its fragment."""
    plain = f"regexp_replace(trim({url}), '(?s)#.*$', '')"
    part = lambda pattern: f"regexp_extract({plain}, '{pattern}', 1)"
    scheme = f"lower({part('^([A-Za-z][A-Za-z0-9+.-]*)://')})"
    host = f"lower({part('^[^:/?]+://(?:[^/?@]*@)?([^/?:]*)')})"
    port = part("^[^:/?]+://[^/?]*:([0-9]+)(?:[/?]|$)")
    path = part("^[^:/?]+://[^/?]*([^?]*)")
    query = f"array_join(array_sort(filter(split({part('(?s)[?](.*)$')}, '&'), x -> x != '')), '&')"
    return F.expr(
        f"CASE WHEN {scheme} = '' OR {host} = '' THEN {plain} ELSE concat({scheme}, '://', {host}, "
        f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE concat(':', {port}) END, "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END) END"
    )


def _fields(headers: str) -> str:
    """Header fields as sorted (name, value) pairs, names in lower case; of equal names the greatest value."""
    pairs = f"array_sort(transform(map_entries(coalesce({headers}, map())), h -> struct(lower(h.key) AS name, coalesce(h.value, '') AS value)))"
    return f"filter({pairs}, (h, i) -> i = size({pairs}) - 1 OR h.name != {pairs}[i + 1].name)"


def _weak(etag: str) -> str:
    return f"regexp_replace(trim({etag}), '^W/', '')"


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolves the revisits among ``records``: record_id, url, ts, revisit, etag, last_modified,
    headers (map), payload_sha256.

    Result, one row per record: record_id, canonical_url, ``outcome``, ``response_id``,
    ``payload_sha256`` and ``fields`` (sorted name and value pairs). For a revisit the response is
    the full record of the same canonical URL that is latest before it, by time and then record_id.
    Its outcome is "resolved" if entity tags are equal (weakly), or, where one has none, the
    modification times are; then it takes the response's payload and its fields, updated by its own
    except ``NOT_MERGED``. Else the outcome is "no_earlier_response", "validator_mismatch" or
    "no_validator" (none in common), response_id names the candidate if there is one, and payload
    and fields are null. A full record has outcome "full" and is its own response.

    The join is a running maximum in time order, over one URL's slice of time; the last response of
    earlier slices is carried in. Slices of URLs with many captures end at approximate quantiles of
    time, so one URL with a third of all captures is no single task; any cuts give equal results.
    Payloads are not moved, only their digests.

    A null url or ts neither resolves nor serves. A null ``revisit`` is a full record. Repeated rows
    are each answered; of records with equal time and id the full one serves. Empty tables give
    empty results. Other columns are not read.
    """
    rows = records.select(
        "record_id", canonical_url("url").alias("canonical_url"), "ts", F.coalesce("revisit", F.lit(False)).alias("revisit"),
        F.expr(_weak("etag")).alias("etag"), F.trim("last_modified").alias("last_modified"), F.expr(_fields("headers")).alias("own"), "payload_sha256",
    )
    rows = stage(rows, "captures")
    placed = rows.where("canonical_url IS NOT NULL AND ts IS NOT NULL")
    shares = [k / SLICES for k in range(1, SLICES)]
    hot = placed.groupBy("canonical_url").agg(F.count("*").alias("n")).where(F.col("n") > SLICED_CAPTURES).select("canonical_url")
    cuts = salted_join(placed.select("canonical_url", "ts", "record_id"), hot, "canonical_url", "record_id")
    cuts = stage(cuts.groupBy("canonical_url").agg(F.percentile_approx(F.col("ts").cast("double"), shares, 1000).alias("cuts")), "cuts")
    placed = salted_join(placed, cuts, "canonical_url", "record_id", "left")
    placed = placed.withColumn("slice", F.expr("CASE WHEN cuts IS NULL THEN 0 ELSE size(filter(cuts, c -> c <= cast(ts AS double))) END")).drop("cuts")

    response = F.when(~F.col("revisit"), F.struct("ts", "record_id", "etag", "last_modified", "payload_sha256", "own"))
    ended = placed.groupBy("canonical_url", "slice").agg(F.max(response).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ended.select("canonical_url", "slice", F.max("last").over(earlier).alias("carried"))
    before = Window.partitionBy("canonical_url", "slice").orderBy("ts", "record_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.withColumn("within", F.max(F.when(~F.col("revisit"), response)).over(before)).join(carried, ["canonical_url", "slice"], "left")
    revisits = joined.where("revisit").withColumn("r", F.coalesce("within", "carried"))
    no_place = rows.where("revisit AND (canonical_url IS NULL OR ts IS NULL)")
    both_tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    outcome = (
        F.when(F.col("r").isNull(), "no_earlier_response")
        .when(both_tags, F.when(F.col("etag") == F.col("r.etag"), "resolved").otherwise("validator_mismatch"))
        .when(both_dates, F.when(F.col("last_modified") == F.col("r.last_modified"), "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    names = ", ".join(f"'{x}'" for x in NOT_MERGED)
    mine = f"filter(own, h -> h.name NOT IN ({names}))"
    merged = F.expr(f"array_sort(concat(filter(r.own, h -> NOT array_contains(transform({mine}, m -> m.name), h.name)), {mine}))")
    resolved = F.col("outcome") == "resolved"
    answered = revisits.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "outcome", F.col("r.record_id").alias("response_id"),
        F.when(resolved, F.col("r.payload_sha256")).alias("payload_sha256"), F.when(resolved, merged).alias("fields"),
    )
    lost = no_place.select(
        "record_id", "canonical_url", F.lit("no_earlier_response").alias("outcome"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"),
        F.lit(None).cast("string").alias("payload_sha256"), F.when(F.lit(False), F.col("own")).alias("fields"),
    )
    full = rows.where("NOT revisit").select(
        "record_id", "canonical_url", F.lit("full").alias("outcome"), F.col("record_id").alias("response_id"), "payload_sha256", F.col("own").alias("fields")
    )
    return full.unionByName(answered).unionByName(lost)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages`` (page_id, url, html): one to four captures of each page.

    The first is a full response, but for every 13th page a revisit; later ones are revisits under
    other spellings of the URL, but for every fifth a full response of new content. Some revisits
    carry another entity tag, or only a modification time, or no validator.

    A page without page_id has one full response without a record id, dated like that of page 4. A
    negative page_id counts by its remainder.
    """
    number = F.coalesce("page_id", F.lit(4)).alias("page_id")
    each = pages.select(F.col("page_id").alias("own_id"), number, "url", "html").withColumn("k", F.explode(F.expr("sequence(0, cast(pmod(page_id, 4) as int))")))
    version = "CASE WHEN k = 0 THEN 0 WHEN (page_id + k) % 5 = 0 THEN k ELSE greatest(0, (k - 1) * CAST((page_id + k - 1) % 5 = 0 AS INT)) END"
    each = each.withColumn("revisit", F.expr("(k = 0 AND page_id % 13 = 0) OR (k > 0 AND (page_id + k) % 5 != 0)")).withColumn("version", F.expr(version))
    tag = "concat('\"', substring(md5(concat(html, cast(version AS string))), 1, 16), '\"')"
    return each.select(
        (F.col("own_id") * 4 + F.col("k")).alias("record_id"),
        F.expr("CASE WHEN k % 3 = 1 THEN concat(url, '#k', k) WHEN k % 3 = 2 THEN replace(url, '.example.', '.EXAMPLE.') ELSE url END").alias("url"),
        F.expr("timestamp_seconds(1700000000 + page_id * 37 % 86400 + k * 86400 * (1 + page_id % 3))").alias("ts"),
        "revisit",
        F.expr(f"CASE WHEN revisit AND (page_id + k) % 7 = 0 THEN '\"other\"' WHEN revisit AND (page_id + k) % 11 < 2 THEN NULL WHEN revisit THEN concat('W/', {tag}) ELSE {tag} END").alias("etag"),
        F.expr("CASE WHEN revisit AND (page_id + k) % 11 = 1 THEN NULL ELSE concat('day ', page_id % 28, ' version ', version) END").alias("last_modified"),
        F.expr("map('Content-Type', 'text/html', 'Content-Length', CASE WHEN revisit THEN '0' ELSE cast(length(html) AS string) END, 'Date', concat('day ', k), 'X-Version', cast(version AS string))").alias("headers"),
        F.expr("CASE WHEN revisit THEN NULL ELSE sha2(concat(html, cast(version AS string)), 256) END").alias("payload_sha256"),
    )
