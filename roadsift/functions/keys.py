"""Window keys, file stems and row hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_key(log: Column, t0: Column, t1: Column, p: int = 6) -> Column:
    """``log|start|end`` with a fixed number of decimals."""
    return F.format_string(f"%s|%.{p}f|%.{p}f", F.trim(log), t0.cast("double"), t1.cast("double"))


def key_log(key: Column) -> Column:
    """The log part; a log id may itself contain the separator."""
    return F.regexp_extract(key, r"^(.*)\|[^|]*\|[^|]*$", 1)


def key_start(key: Column) -> Column:
    return F.regexp_extract(key, r"\|([^|]*)\|[^|]*$", 1).try_cast("double")


def key_end(key: Column) -> Column:
    return F.regexp_extract(key, r"\|([^|]*)$", 1).try_cast("double")


def canonical_key(key: Column) -> Column:
    """Parse any ``log|a|b`` text and print it with six decimals; null when it does not parse."""
    return F.when(key_start(key).isNotNull() & key_end(key).isNotNull(),
                  window_key(key_log(key), key_start(key), key_end(key)))


def file_stem(key: Column) -> Column:
    """Portable file stem: cleaned log id (at most 64 characters) and 16 hex digits of the key's sha256."""
    slug = F.regexp_replace(F.element_at(F.split(key, r"\|"), 1), r"[^A-Za-z0-9._-]+", "-")
    slug = F.regexp_replace(slug, r"^[-._]+|[-._]+$", "")
    slug = F.substring(F.when(slug == "", F.lit("window")).otherwise(slug), 1, 64)
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(key, 256), 1, 16))


def row_hash(*cols: str) -> Column:
    """sha1 over the JSON of the columns in name order."""
    return F.sha1(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])))


def seeded_hash(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
