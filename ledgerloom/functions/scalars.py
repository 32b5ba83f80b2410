"""Scalar rules of document operations as column expressions; all stay inside the JVM but ``nfkc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions that may be uploaded, with the media types declared for them; roles by rank.
MEDIA_TYPES = {
    ".pdf": ("application/pdf",), ".txt": ("text/plain",), ".md": ("text/markdown", "text/plain"), ".html": ("text/html",), ".htm": ("text/html",),
}
ROLE_RANK = {"viewer": 10, "agent": 20, "admin": 30, "owner": 40}
MANAGES = {"owner": ("admin", "agent", "viewer"), "admin": ("agent", "viewer")}
PREFIX_BYTES, NAME_LENGTH, BACKOFF_LIMIT = 8192, 255, 300
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
IDEMPOTENCY_LENGTH, MAX_UPLOAD = 255, 25 * 1024 * 1024
#: White space at the ends of a text, as it is in Unicode and as ASCII separators.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}++|(?<!{_BLANK}){_BLANK}++\z", "")


def parse_uuid(text: Column) -> Column:
    """The id in its usual form, null if it's none; braces, a urn prefix and any placing of hyphens are allowed."""
    plain = F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), r"^[{}]+|[{}]+\z|-", "")
    shaped = F.regexp_replace(F.lower(plain), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(plain.rlike(r"^[0-9a-fA-F]{32}\z"), shaped)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-composed text; Spark has no such function, so it's the one vectorised Python step, for non-ASCII names."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def sanitize_filename(name: Column, composed: bool = False) -> Column:
    """The leaf of a path without control and unusual characters; `upload` if nothing is left.  ``composed``: name is NFKC."""
    text = F.coalesce(name, F.lit(""))
    leaf = F.element_at(F.split(F.replace(text if composed else nfkc(text), F.lit("\\"), F.lit("/")), "/"), -1)
    printable = F.regexp_replace(leaf, r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}", "")
    plain = F.regexp_replace(printable, r"(?U)[^\w.() -]+", "_")
    trimmed = F.regexp_replace(plain, '^[ ".]+|[ ".]+$', "")
    return F.substring(F.when(trimmed == "", "upload").otherwise(trimmed), 1, NAME_LENGTH)


def suffix(name: Column) -> Column:
    """The extension with its dot, in lower case; empty for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"^.*[^/.].*?(\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]+$", "")


def media_type(name: Column, declared: Column, content: Column) -> Column:
    """The accepted media type of an upload, null if it's rejected."""
    ext = suffix(name)
    given = F.lower(strip(F.substring_index(declared, ";", 1)))
    head = F.substring(content, 1, PREFIX_BYTES)
    # Byte tests on the binary value itself: a NUL byte, and the opening bracket of a tag.
    text = F.is_valid_utf8(head) & (F.position(F.lit(b"\x00"), head) == 0)
    html = F.position(F.lit(b"<"), head) > 0
    out = F.lit(None).cast("string")
    for extension, types in MEDIA_TYPES.items():
        right = (ext == extension) & given.isin(*types)
        if extension == ".pdf":
            right &= F.startswith(head, F.lit(b"%PDF-"))
        else:
            right &= text & (html if types[0] == "text/html" else F.lit(True))
        out = F.when(right, F.lit(types[0])).otherwise(out)
    return out


def display_name(given: Column, filename: Column) -> Column:
    return F.substring(strip(F.coalesce(F.nullif(given, F.lit("")), F.nullif(stem(filename), F.lit("")), filename)), 1, NAME_LENGTH)


def normal_email(text: Column) -> Column:
    return F.lower(strip(text))


def is_slug(text: Column) -> Column:
    return text.rlike(SLUG) & F.char_length(text).between(2, 80)


def backoff_seconds(attempt: Column, job: Column) -> Column:
    """Doubling delay with an upper limit, plus a jitter up to its half that follows from job and attempt alone."""
    base = F.least(F.lit(BACKOFF_LIMIT), F.power(F.lit(2), F.greatest(F.lit(0), attempt - 1)).cast("int"))
    return base + F.pmod(job * 7919 + attempt * 104729, F.floor(base / 2).cast("long") + 1).cast("int")


def new_uuid() -> Column:
    """A random id for each row; another one each time that the plan runs, so write it before it's referred to."""
    return F.expr("uuid()")


def natural_uuid(*key: Column) -> Column:
    """The id that follows from a row's natural key: its SHA-256 in the layout of a version 8 UUID, null if a part is null."""
    digest = F.sha2(F.encode(F.concat(*[x for k in key for x in (F.lit("|"), k.cast("string"))][1:]), "utf-8"), 256)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    groups = (F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("8"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return F.concat(*[x for g in groups for x in (F.lit("-"), g)][1:])


def role_rank(role: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in ROLE_RANK.items():
        out = F.when(role == name, rank).otherwise(out)
    return out


def has_minimum_role(actual: Column, required: Column) -> Column:
    return role_rank(actual) >= role_rank(required)


def can_manage(actor: Column, target: Column) -> Column:
    out = F.lit(False)
    for name, targets in MANAGES.items():
        out = out | ((actor == name) & target.isin(*targets))
    return out


def refresh_token(token: Column) -> Column:
    """(session_id, secret) of a token, null if it isn't one: an id and a secret of 32 characters or more around the first dot."""
    parts = F.split(token, r"\.", 2)
    left, right = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(parse_uuid(left).isNotNull() & (F.char_length(right) >= 32), F.struct(parse_uuid(left).alias("session_id"), F.sha2(F.encode(right, "utf-8"), 256).alias("secret_hash")))


def idempotency_key(text: Column) -> Column:
    """The trimmed key of a request, null if it's empty or too long."""
    return F.when(F.char_length(strip(text)).between(1, IDEMPOTENCY_LENGTH), strip(text))


def upload_refusal(size: Column, limit: int = MAX_UPLOAD) -> Column:
    """Why an upload's size is refused; null if it isn't."""
    return F.when(size <= 0, "empty").when(size > limit, "too_large")


def staging_key(workspace: Column, upload: Column) -> Column:
    return F.concat_ws("/", F.lit("staging"), workspace.cast("string"), upload.cast("string"))


def object_key(workspace: Column, document: Column, version: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("workspaces"), workspace.cast("string"), F.lit("documents"), document.cast("string"), F.lit("versions"), version.cast("string"), filename)


def is_contained(key: Column) -> Column:
    """Whether a key stays below the store's root."""
    return (key != "") & ~key.contains("\\") & ~key.startswith("/") & ~key.rlike(r"(?:^|/)\.\.(?:/|$)")
