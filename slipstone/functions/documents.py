"""Document bytes and captured responses: hashing, type sniffing, store paths, parsing."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .amounts import _as_col, strip


def document_hash(content) -> Column:
    """SHA-256 hex of the original bytes."""
    return F.sha2(_as_col(content).cast("binary"), 256)


def sniff_mime(content) -> Column:
    """Type by leading bytes; null when it is none of PNG, JPEG, PDF."""
    head = F.hex(F.substring(_as_col(content).cast("binary"), 1, 8))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("255044462D"), "application/pdf")
    )


def mime_to_ext(mime) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*vocab.MIME_TO_EXT.items())])
    return F.try_element_at(table, _as_col(mime))


def clean_extension(ext) -> Column:
    """Lower case without leading dots; null outside the whitelist."""
    value = F.regexp_replace(F.lower(_as_col(ext)), r"^\.+", "")
    return F.when(value.isin(*vocab.ALLOWED_EXTENSIONS), value)


def is_hash(value) -> Column:
    return F.coalesce(_as_col(value).rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def store_problem(n_bytes, hash_documento, ext, month) -> Column:
    """Why a document cannot be stored, or null."""
    return (
        F.when(F.coalesce(_as_col(n_bytes), F.lit(0)) == 0, "empty")
        .when(~is_hash(hash_documento), "bad_hash")
        .when(clean_extension(ext).isNull(), "bad_extension")
        .when(~F.coalesce(_as_col(month).between(1, 12), F.lit(False)), "bad_month")
    )


def size_problem(n_bytes) -> Column:
    """Upload guard: non-empty and at most 10 MiB."""
    size = F.coalesce(_as_col(n_bytes), F.lit(0))
    return F.when(size == 0, "empty").when(size > vocab.MAX_DOCUMENT_BYTES, "too_large")


def store_path(hash_documento, ext, year, month) -> Column:
    """``yyyy/mm/hash.ext``."""
    return F.concat(
        F.lpad(_as_col(year).cast("string"), 4, "0"),
        F.lit("/"),
        F.lpad(_as_col(month).cast("string"), 2, "0"),
        F.lit("/"),
        _as_col(hash_documento),
        F.lit("."),
        clean_extension(ext),
    )


def response_body(response) -> Column:
    """Message content of a model response with Markdown fences removed, null if malformed."""
    content = strip(F.get_json_object(_as_col(response), "$.choices[0].message.content"))
    lines = F.filter(F.split(content, "\n"), lambda x: ~strip(x).startswith("```"))
    unfenced = strip(F.array_join(lines, "\n"))
    return F.when(content.startswith("```"), unfenced).otherwise(content)


def response_problem(response) -> Column:
    """Error class of a model response, or null: bad_structure, bad_json, not_object."""
    body = response_body(response)
    parsed = F.try_parse_json(body)
    # the parser stops at the end of the first value; only a body that is one whole value can
    # also stand inside an array and inside an object
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(
        F.concat(F.lit('{"x":'), body, F.lit("}"))
    ).isNotNull()
    return (
        F.when(body.isNull(), "bad_structure")
        .when(parsed.isNull() | ~whole, "bad_json")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_object")
    )


def response_fields(response) -> Column:
    """The expected keys as a struct of strings, missing ones null; null struct on error."""
    schema = ", ".join(f"{key} string" for key in vocab.RESPONSE_KEYS)
    fields = F.from_json(response_body(response), schema)
    return F.when(response_problem(response).isNull(), fields)
