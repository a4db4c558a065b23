"""Captured transport: URLs and headers without secrets, message frames, and variable-length integers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of query values and headers that hold secrets, and what stands in for their values.
SECRET_NAMES = (
    "authorization", "cookie", "set-cookie", "x-api-key", "x_api_key", "proxy-authorization", "proxy_authorization", "token", "access-token", "access_token",
    "id-token", "id_token", "api-key", "api_key", "client-secret", "client_secret", "x-client-secret", "x_client_secret", "password",
)
REDACTED = "<redacted>"
# Headers that name a request, the first one given counts; media types of framed messages.
REQUEST_NAMES = ("x-request-id", "x-correlation-id", "traceparent", "x-amzn-trace-id")
FRAMED_TYPES = ("application/grpc-web", "application/grpc-web+proto")


def _quoted(text: Column) -> Column:
    """A text for a query: the URL encoder writes ``*`` as it is and ``~`` encoded, queries want it the other way round."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unquoted(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def safe_url(url: Column) -> Column:
    """A URL without its fragment, its query written again with the values of secret names replaced; null is empty."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", "")
    at = F.instr(bare, "?")
    items = F.filter(F.split(F.when(at > 0, F.substr(bare, at + 1)).otherwise(""), "&"), lambda x: x != "")
    parts = F.transform(items, lambda x: F.struct(_unquoted(F.substring_index(x, "=", 1)).alias("k"), _unquoted(F.when(x.contains("="), F.substr(x, F.instr(x, "=") + 1)).otherwise("")).alias("v")))
    shown = F.transform(parts, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(F.when(F.lower(p["k"]).isin(*SECRET_NAMES), REDACTED).otherwise(p["v"]))))
    path = F.when(at > 0, F.substring_index(bare, "?", 1)).otherwise(bare)
    return F.when(F.size(shown) > 0, F.concat(path, F.lit("?"), F.array_join(shown, "&"))).otherwise(path)


def safe_headers(headers: Column) -> Column:
    """Headers by lower-case name, without those that hold secrets. Of names that differ in case the last one counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_filter(F.map_from_entries(last), lambda k, v: ~k.isin(*SECRET_NAMES))


def request_name(headers: Column) -> Column:
    """What names a request among its headers, the first of ``REQUEST_NAMES`` that is not empty; null if none is."""
    lower = safe_headers(headers)
    return F.coalesce(*[F.nullif(F.try_element_at(lower, F.lit(n)), F.lit("")) for n in REQUEST_NAMES])


def safe_message(kind: Column, message: Column) -> Column:
    """An error as ``kind: message`` without the secrets it may quote; only the kind where the message is empty."""
    # Names of secrets as errors quote them.
    named = r"(?i)\b(authorization|cookie|set-cookie|x[-_]api[-_]key|proxy[-_]authorization|token|access[-_]token|id[-_]token|api[-_]key|(?:x[-_]?)?client[-_]secret|password)\b\s*[:=]\s*(?:bearer\s+)?[^,\s;&]+"
    out = F.regexp_replace(F.coalesce(message, F.lit("")), named, f"$1={REDACTED}")
    out = F.trim(F.regexp_replace(out, r"(?i)\bbearer\s+[^,\s;&]+", f"Bearer {REDACTED}"))
    return F.when(out == "", kind).otherwise(F.concat(kind, F.lit(": "), out))


def is_framed(content_type: Column) -> Column:
    """Whether a content type is one of framed messages."""
    return F.coalesce(media_type(content_type).isin(*FRAMED_TYPES), F.lit(False))


def captured_state(declared: Column, framed: Column, own_event: Column, event: Column, completed: Column, failed: Column, frames: Column) -> Column:
    """What becomes of a captured answer: the first reason against it, else ``ACCEPTED``.

    declared: its content type; framed: whether the body splits into frames; own_event and event: the event that the request
    names and the one that is looked for; completed, failed: whether the request ended, and whether its body was lost.
    """
    return (
        F.when(~is_framed(declared), "REJECTED_CONTENT_TYPE").when(own_event.isNull(), "REJECTED_EVENT_UNKNOWN").when(~own_event.eqNullSafe(event), "REJECTED_OTHER_EVENT")
        .when(~F.coalesce(completed, F.lit(False)), "REJECTED_PENDING").when(F.coalesce(failed, F.lit(False)), "REJECTED_BODY_LOST").when(~F.coalesce(framed, F.lit(False)) | frames.isNull(), "REJECTED_BROKEN_FRAMES").otherwise("ACCEPTED")
    )


def media_type(content_type: Column) -> Column:
    """The type of a content type, without its parameters."""
    return F.lower(F.trim(F.get(F.split(content_type, ";"), 0)))


def frames_of(body: bytes | None) -> list[tuple[int, bytes]] | None:
    """(flag, message) of each length-prefixed frame; None for null and for a body that breaks off."""
    if body is None:
        return None
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at + 1 : at + 5], "big")
        if at + 5 > len(body) or at + 5 + size > len(body):
            return None
        out.append((body[at], bytes(body[at + 5 : at + 5 + size])))
        at += 5 + size
    return out


def varint_field(message: bytes, field: int) -> int | None:
    """The only variable-length integer of a field, below 2**63; None if it is absent, repeated or broken."""
    at, found = 0, []

    def read() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(message) or shift > 63:
                raise ValueError
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    try:
        while at < len(message):
            tag = read()
            if tag & 7 == 0:
                value = read()
                found += [value] if tag >> 3 == field else []
            elif tag & 7 in (1, 5):
                at += 8 if tag & 7 == 1 else 4
            elif tag & 7 == 2:
                size = read()  # moves the place itself
                at += size
            else:
                return None
            if at > len(message):
                return None
    except ValueError:
        return None
    return found[0] if len(found) == 1 and found[0] < 2**63 else None


def request_number(body: bytes | None) -> str | None:
    """The number that a request's only message begins with (field 1), as text; None if there is no such number.

    Trailers and compressed messages are not looked at; zero and numbers of more than 64 bits are none.
    """
    messages = [m for flag, m in frames_of(body) or [] if not flag & 0x80 and not flag & 1]
    if len(messages) != 1 or messages[0][:1] != b"\x08":
        return None
    value = 0
    for i, byte in enumerate(messages[0][1:11]):
        value |= (byte & 127) << 7 * i
        if byte < 128:
            return str(value) if value else None
        if 7 * (i + 1) > 63:
            return None
    return None


@F.pandas_udf(StringType())
def request_numbers(bodies: pd.Series) -> pd.Series:
    """``request_number`` of a column of bodies."""
    return bodies.map(request_number)


def message_frames(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, at, flag, message) of each frame; ``at`` is -1 and the rest null where a body is null or breaks off."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, b in zip(frame[key], frame[body], strict=True):
                found = frames_of(b)
                rows += [(k, -1, None, None)] if found is None else [(k, i, flag, message) for i, (flag, message) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "at", "flag", "message"])

    return bodies.select(key, body).mapInPandas(split, f"{key} {dict(bodies.dtypes)[key]}, at int, flag int, message binary")
