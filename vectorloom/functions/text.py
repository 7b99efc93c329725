"""Text columns: identifiers, literal joins, code-point slices, path parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: U+241F, which separates anchor texts when a corpus is fingerprinted.
UNIT_SEPARATOR = "␟"


def sha_prefix(text: Column, n: int = 12) -> Column:
    """First `n` hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, n)


def raw_text_id(text: Column) -> Column:
    """Identifier of a document given as raw text."""
    return F.concat(F.lit("text-"), sha_prefix(text))


def chunk_id(doc_id: Column, idx: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), idx.cast("string"))


def file_stem(path: Column) -> Column:
    """Name without directories and without its last suffix; a name that is all suffix stays."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def file_suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def safe_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))


def prefer(explicit: Column, automatic: Column) -> Column:
    """The explicit value unless it is null or empty."""
    return F.coalesce(F.nullif(explicit, F.lit("")), automatic)


def contains_any(text: Column, hints) -> Column:
    found = F.lit(False)
    for hint in hints:
        found = found | text.contains(hint)
    return found
