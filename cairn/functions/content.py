"""Content, key, permission and number functions as columns."""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONTENT_TYPES

HASHES = ("NONE", "MD5", "SHA1", "SHA256", "SHA512")
COMPRESSIONS = ("NONE", "GZIP", "BZIP2")
DUPLICATES = ("KEEP_EACH", "KEEP_ONE_PER_BACKUP")
PERMISSION_RULES = ("STRICT", "PERMISSION_ONLY", "RELAXED", "IGNORE")
KEYS_PER_VERSION = 16
MEBIBYTE = 1 << 20


def is_content(file_type: Column) -> Column:
    return file_type.isin(*CONTENT_TYPES)


def digest(content: Column, algorithm: str) -> Column:
    """Lower-case hex, null for NONE."""
    if algorithm == "NONE":
        return F.lit(None).cast("string")
    return {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA512": lambda c: F.sha2(c, 512)}[algorithm](content)


def content_hash(content: Column, file_type: Column, algorithm: str) -> Column:
    """Null unless the type carries content."""
    return F.when(is_content(file_type), digest(content, algorithm))


def text_or_null(c: Column) -> Column:
    """Null as the text `null`, as string concatenation of the keys prints it."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def duplicate_key(strategy: str, algorithm: str) -> Column:
    """Grouping key of one row: its id; or hash and size; or name, size and time where nothing is hashed."""
    if strategy == "KEEP_EACH":
        return F.col("id")
    size = text_or_null(F.col("original_size"))
    if algorithm == "NONE":
        return F.concat(F.substring_index("path", "/", -1), F.lit("_"), size, F.lit("_"), text_or_null(F.col("last_modified_utc_epoch_seconds")))
    return F.concat(text_or_null(F.col("original_hash")), F.lit("_"), size)


def permissions_match(rule: str, a: str, b: str) -> Column:
    """Whether the permissions of rows under the prefixes a and b agree under a rule."""
    same = lambda c: F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
    if rule == "IGNORE":
        return F.lit(True)
    if rule == "RELAXED":
        return F.substring(f"{a}permissions", 1, 3).eqNullSafe(F.substring(f"{b}permissions", 1, 3))
    if rule == "PERMISSION_ONLY":
        return same("permissions")
    return same("permissions") & same("owner") & same("group")


def permission_text(*bits: Column) -> Column:
    """rwx text of nine booleans."""
    return F.concat(*[F.when(b, "rwx"[i % 3]).otherwise("-") for i, b in enumerate(bits)])


def key_index(uuid: Column) -> Column:
    """Data key of an entry: the absolute value of the id's low 32 bits as a signed number, by KEYS_PER_VERSION."""
    low = F.conv(F.right(F.replace(uuid, F.lit("-"), F.lit("")), F.lit(8)), 16, 10).cast("bigint")
    return F.when(low < 1 << 31, low % KEYS_PER_VERSION).otherwise((F.lit(1 << 32) - low) % KEYS_PER_VERSION).cast("int")


def mebibytes(size: Column) -> Column:
    """Whole MiB, cut."""
    return F.floor(size / MEBIBYTE).cast("bigint")


def iso_instant(seconds: Column) -> Column:
    """UTC text of epoch seconds, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def derived_id(*parts: Column) -> Column:
    """A UUID-shaped id that the parts decide, so that runs repeat."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def encrypt(content: Column, key: Column) -> Column:
    """AES-GCM: 12 bytes of IV, ciphertext, 16 bytes of tag."""
    return F.aes_encrypt(content, key, F.lit("GCM"))


def decrypt(content: Column, key: Column) -> Column:
    return F.aes_decrypt(content, key, F.lit("GCM"))


def _codec(change):
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else change(bytes(x)))

    return run


def compress(content: Column, algorithm: str) -> Column:
    if algorithm == "NONE":
        return content
    return _codec((lambda x: gzip.compress(x, mtime=0)) if algorithm == "GZIP" else bz2.compress)(content)


def decompress(content: Column, algorithm: str) -> Column:
    if algorithm == "NONE":
        return content
    return _codec(gzip.decompress if algorithm == "GZIP" else bz2.decompress)(content)
