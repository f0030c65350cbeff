"""Request admission, provider choice and header policy as columns over request metadata.

requests: method, path, query_keys, headers map<string,string>, ... The order of the rules is part of
the meaning: the first that applies gives the status.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.text import clean_header

# Limits and lists of the policy.
MAX_URI, MAX_QUERY_KEYS, MAX_MODEL, MAX_TOKENS = 2048, 50, 128, 1_000_000
CHARSETS = ("utf-8", "us-ascii", "ascii", "iso-8859-1")
HOP_BY_HOP = ("host", "connection", "keep-alive", "transfer-encoding", "te", "trailer", "upgrade", "proxy-authorization", "proxy-authenticate", "content-length", "content-encoding")
PASSED = ("authorization", "x-api-key", "anthropic-version", "anthropic-beta", "openai-organization", "openai-beta")
AUTH_HEADERS = ("authorization", "x-api-key", "api-key", "cookie", "proxy-authorization", "x-goog-api-key")
DROPPED_RESPONSE = ("content-length", "transfer-encoding", "content-encoding", "connection", "keep-alive", "set-cookie", "server", "via", "x-powered-by", "x-request-id")
FORBIDDEN_PORTS = (22, 23, 25, 2375, 2376, 3306, 5432, 6379, 9000, 10250, 10255, 11211, 27017)
BLOCKED_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata.azure.com", "instance-data", "::1", "0.0.0.0", "::ffff:a9fe:a9fe")
BLOCKED_HOST_START = r"^(?:169\.254\.|fe80:|fd00:|::ffff:169\.254\.)"
RETRY_STATUS = (402, 429, 529)


def header(headers: Column, name: str) -> Column:
    """A header's value by its lower-case name, null if there is none."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), 0)


def admission_status(method: Column, path: Column, query_keys: Column, headers: Column, max_body: int = 8_388_608) -> Column:
    """200, or the status of the first admission rule that a request breaks."""
    kind, length = F.lower(header(headers, "content-type")), header(headers, "content-length")
    charset = F.regexp_extract(kind, r"charset\s*=\s*\"?([^;\"\s]+)", 1)
    size = length.try_cast("bigint")
    return (
        F.when(F.length(path) > MAX_URI, 414)
        .when(F.coalesce(query_keys, F.lit(0)) > MAX_QUERY_KEYS, 400)
        .when(method != "POST", 405)
        .when(path.contains("..") | path.contains("\\") | path.contains("__proto__") | path.contains("constructor"), 400)
        .when(header(headers, "transfer-encoding").isNotNull() & length.isNotNull(), 400)
        .when(kind.isNull() | ~kind.contains("application/json"), 415)
        .when(F.size(F.split(kind, ";")) > 2, 400)
        .when((charset != "") & ~charset.isin(*CHARSETS), 415)
        .when(length.isNotNull() & (size.isNull() | (size < 0)), 400)
        .when(size > max_body, 413)
        .otherwise(200)
    )


def body_status(body: Column) -> Column:
    """200, or 400 for a model, token limit or temperature that is out of range."""
    v = F.try_parse_json(body)
    model, tokens, heat = (F.try_variant_get(v, f"$.{k}", t) for k, t in (("model", "string"), ("max_tokens", "double"), ("temperature", "double")))
    bad = (
        v.isNull()
        | F.coalesce((F.length(model) > MAX_MODEL) | model.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))
        | F.coalesce((tokens <= 0) | (tokens > MAX_TOKENS) | (tokens != F.floor(tokens)), F.lit(False))
        | F.coalesce((heat < 0) | (heat > 2), F.lit(False))
    )
    return F.when(bad, 400).otherwise(200)


def endpoint_problem(url: Column, allowed_ports: tuple[int, ...] = ()) -> Column:
    """Why an endpoint may not be called: scheme, user info, host or port; ok otherwise."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)), r"^\[|\]$", "")
    port = F.nullif(F.regexp_extract(authority, r":([0-9]+)$", 1), F.lit("")).try_cast("int")
    ports = [p for p in FORBIDDEN_PORTS if p not in allowed_ports]
    return (
        F.when(~F.lower(scheme).isin("http", "https"), "scheme")
        .when(authority.contains("@"), "user info")
        .when((host == "") | host.isin(*BLOCKED_HOSTS) | host.rlike(BLOCKED_HOST_START), "host")
        .when(F.coalesce(port.isin(*ports), F.lit(False)), "port")
        .otherwise("ok")
    )


def outbound_headers(headers: Column, auth: Column, key: Column, allowed: tuple[str, ...] = PASSED) -> Column:
    """Headers for a provider: the allowed ones that don't belong to one connection. With auth api_key the
    client's credentials go and the provider's key comes."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    passed = F.map_filter(low, lambda k, _: k.isin(*allowed) & ~k.isin(*HOP_BY_HOP))
    keyed = F.map_concat(F.map_filter(passed, lambda k, _: ~k.isin(*AUTH_HEADERS)), F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer "), key)))
    return F.transform_values(F.when(auth == "api_key", keyed).otherwise(passed), lambda _, v: clean_header(v))


def response_headers(headers: Column) -> Column:
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.map_filter(low, lambda k, _: ~k.isin(*DROPPED_RESPONSE) & ~k.startswith("x-amzn-") & ~k.endswith("-request-id"))


def provider_prefix(url: Column) -> Column:
    """struct(provider, path): a provider named before /v1/, null without one."""
    at = r"^/([A-Za-z][A-Za-z0-9_-]*)/(v1/.*)$"
    name = F.lower(F.regexp_extract(url, at, 1))
    found = (name != "") & ~name.isin("v1", "healthz", "_mask")
    return F.struct(F.when(found, name).alias("provider"), F.when(found, F.concat(F.lit("/"), F.regexp_extract(url, at, 2))).otherwise(url).alias("path"))


def retryable(status: Column, headers: Column, body: Column) -> Column:
    """Whether another provider may answer: busy or unpaid, told to retry, failed, or out of quota."""
    quota = status.between(400, 499) & F.substring(body, 1, 4096).rlike("(?i)quota|insufficient")
    return status.isNull() | status.isin(*RETRY_STATUS) | header(headers, "retry-after").isNotNull() | F.coalesce(quota, F.lit(False))


def fallback_chain(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """(request_id, pos, provider): the provider asked for, or the active one (of several the first by name), then the fallbacks without it.

    requests(request_id, provider), providers(name, active boolean, fallback_pos int)."""
    active = providers.agg(F.min(F.when(F.col("active"), F.col("name"))).alias("active_name"))
    first = requests.crossJoin(F.broadcast(active)).select("request_id", F.coalesce("provider", "active_name").alias("primary"))
    others = providers.filter("fallback_pos IS NOT NULL").agg(F.transform(F.array_sort(F.collect_list(F.struct("fallback_pos", "name"))), lambda x: x["name"]).alias("fallback"))
    chained = first.crossJoin(F.broadcast(others)).select("request_id", F.concat(F.array_compact(F.array("primary")), F.array_except(F.coalesce("fallback", F.array().cast("array<string>")), F.array("primary"))).alias("chain"))
    return chained.select("request_id", F.posexplode("chain").alias("pos", "provider"))


def fallback_choice(chain: DataFrame, upstream: DataFrame) -> DataFrame:
    """(request_id, provider, status, tried): the first of the chain whose answer is final, else the last one.

    upstream(request_id, provider, status, headers, body): what each provider would answer."""
    rows = chain.join(upstream, ["request_id", "provider"], "left").withColumn("again", retryable(F.col("status"), F.col("headers"), F.col("body")))
    last = W.partitionBy("request_id")
    rows = rows.withColumn("at", F.coalesce(F.min(F.when(~F.col("again"), F.col("pos"))).over(last), F.max("pos").over(last)))
    return rows.filter("pos = at").select("request_id", "provider", F.coalesce("status", F.lit(502)).alias("status"), (F.col("pos") + 1).alias("tried"))


def hook_status(method: Column, origin: Column, host: Column, allow_remote: bool = False, origins: tuple[str, ...] = ()) -> Column:
    """200, 405 for methods that are never served, 403 for foreign origins and, if only local requests are served, for
    other hosts. Without origins a remote server takes any."""
    where, name = F.lower(origin), F.lower(F.substring_index(host, ":", 1))
    local = where.rlike(r"^http://(?:127\.0\.0\.1|localhost|\[::1\])")
    foreign = where.isNotNull() & (where != "") & ~local
    if allow_remote:
        foreign = foreign & ~where.isin(*origins) if origins else F.lit(False)
    other = F.lit(False) if allow_remote else host.isNotNull() & (host != "") & ~(name.isin("127.0.0.1", "localhost", "::1") | name.startswith("127."))
    return F.when(F.upper(method).isin("TRACE", "TRACK", "CONNECT"), 405).when(F.coalesce(foreign | other, F.lit(False)), 403).otherwise(200)


def admin_allowed(token: Column, secret_sha256: str) -> Column:
    """Whether an admin token has the right form and digest."""
    return F.coalesce(token.rlike(r"^[A-Za-z0-9._~-]{8,256}\z") & (F.sha2(token, 256) == secret_sha256), F.lit(False))


def response_status(status: Column, headers: Column, most: int = 33_554_432) -> Column:
    """The answer's status, or 502 where its announced length is above `most` bytes."""
    return F.when(header(headers, "content-length").try_cast("bigint") > most, 502).otherwise(status)


@F.arrow_udf(T.StringType())
def _beginning(body: pa.Array, most: pa.Array) -> pa.Array:
    rows = zip(body.to_pylist(), most.to_pylist(), strict=True)
    return pa.array([None if t is None else t.encode()[:n].decode(errors="ignore") for t, n in rows], pa.string())


def bounded_text(body: Column, most: int) -> Column:
    """The longest beginning of a text of at most `most` bytes of UTF-8, no character cut."""
    return F.when(F.octet_length(body) <= most, body).otherwise(_beginning(body, F.lit(most)))


def catalogue_endpoint(endpoints: Column) -> Column:
    """Where a provider's list of models is asked for."""
    return F.coalesce(*(endpoints[k] for k in ("responses", "openai", "anthropic")))


def resolved(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """requests(provider, dialect, ...) with endpoint, upstream_dialect and status: the provider's endpoint for the
    request's format, else that of the other one, to be translated. 404 for an unknown provider, 502 for one without
    either endpoint. providers(name, endpoints) is small and has a row for each name."""
    known = providers.select(F.col("name").alias("__name"), F.col("endpoints").alias("__endpoints"))
    rows = requests.join(known, requests["provider"] == known["__name"], "left")
    other = F.when(F.col("dialect") == "anthropic", "openai").otherwise("anthropic")
    at = lambda d: F.element_at("__endpoints", d)
    spoken = F.when(at(F.col("dialect")).isNotNull(), F.col("dialect")).when(at(other).isNotNull(), other)
    rows = rows.withColumn("upstream_dialect", spoken)
    rows = rows.withColumn("endpoint", F.regexp_replace(at(F.col("upstream_dialect")), "/+$", ""))
    status = F.when(F.col("__name").isNull(), 404).when(F.col("upstream_dialect").isNull(), 502).otherwise(200)
    return rows.withColumn("status", status).drop("__name", "__endpoints")


def fallbacks_of_dialect(providers: DataFrame, dialect: str) -> DataFrame:
    """(pos, name, endpoint): the fallbacks that speak a format, in order."""
    rows = providers.filter("fallback_pos IS NOT NULL").withColumn("endpoint", F.regexp_replace(F.element_at("endpoints", dialect), "/+$", ""))
    rows = rows.filter("endpoint IS NOT NULL")
    return rows.select((F.row_number().over(W.orderBy("fallback_pos")) - 1).alias("pos"), "name", "endpoint")
