"""Text expressions: identifiers, markup blocks, keyword rules."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"

def bare_id(value: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def canonical_id(value: Column) -> Column:
    """Identifier form of a name; an absent or empty name becomes ``unknown``."""
    return F.when(value.isNull() | (value == ""), F.lit(UNKNOWN)).otherwise(bare_id(value))


def mentions_any(text: Column, keywords: Sequence[str] | Column) -> Column:
    """Case-insensitive substring test against a list of keywords."""
    words = keywords if isinstance(keywords, Column) else F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
    return F.exists(words, lambda k: F.contains(F.lower(text), F.lower(k)))


@F.arrow_udf(T.StringType())
def unescape(text: pa.Array) -> pa.Array:
    """Character references (named and numeric) to characters."""
    held = pc.fill_null(pc.match_substring(text, "&"), False)
    if not pc.any(held).as_py():
        return text
    changed = pa.array([html.unescape(t) for t in text.filter(held).to_pylist()], pa.string())
    return pc.replace_with_mask(text, held, changed)


def html_blocks(html_text: Column, tag: str) -> Column:
    """Text of every ``tag`` block, tags stripped, joined by a blank line.

    Text that does not start with ``<`` passes through; so does markup without
    any such block. Entities are unescaped in every case.
    """
    blocks = F.regexp_extract_all(html_text, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    joined = F.array_join(F.transform(blocks, lambda b: F.regexp_replace(b, r"<[^>]+>", "")), "\n\n")
    picked = F.when(html_text.rlike(r"^\s*<") & (joined != ""), joined).otherwise(html_text)
    return unescape(picked)
