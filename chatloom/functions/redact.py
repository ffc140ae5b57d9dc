"""Redaction as column expressions: detect, scrub, and scrub whole nested records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as ty

from chatloom.banks import CUSTOM_PLACEHOLDER, REDACTION_PATTERNS
from chatloom.functions.text import let

Pattern = tuple[str, str, str]

# A text without this piece cannot match the pattern of the same place, and looking
# for a piece is far cheaper than trying a regex at every position.
_PIECES = [
    "@", "PRIVATE KEY-----", "sk-", "gh", "AKIA", "AIza", "xox", "eyJ", "bearer",
    "/Users/", "/mnt/", "/home/", ":\\Users\\", "\\Users\\", "+", "(", "-", ".", "source_conversation_ids",
]
_PIECE = {regex: piece for (_, _, regex), piece in zip(REDACTION_PATTERNS, _PIECES, strict=True)}

# What a match begins with, where a pattern opens with a word edge and its piece is common:
# a look at one character is far cheaper than an edge tried at every position.
_FIRST = {regex: r"(?=\d)" for kind, _, regex in REDACTION_PATTERNS if kind in ("phone", "ip address") and regex.startswith(r"\b")}

# Unicode letters count as word characters, so word edges behave the same in every script.
_UNICODE = "(?U)"

# Every pattern but these needs one of the marks, so one look for a mark spares a plain text all others.
_MARK = r"[@+(/\\_\-\d]"
_UNMARKED = [p for p in REDACTION_PATTERNS if p[0] in ("aws access key", "google api key", "jwt", "bearer token")]


def dictionary(terms: Sequence[str] = (), patterns: Sequence[str] = ()) -> list[Pattern]:
    """User dictionary: whole-word, case-insensitive terms and raw patterns. Bad patterns are left out."""
    words = [t.strip() for t in terms if t.strip()]
    out = [("custom", CUSTOM_PLACEHOLDER, rf"(?iu)(?={re.escape(w[0])})(?<!\w){re.escape(w)}(?!\w)") for w in words]
    for raw in patterns:
        try:
            re.compile(raw)
        except re.error:
            continue
        out.append(("custom", CUSTOM_PLACEHOLDER, raw))
    return out


def all_patterns(custom: Sequence[Pattern] = ()) -> list[Pattern]:
    return [*custom, *REDACTION_PATTERNS]


def _where_possible(text: Column, regex: str, done: Column, otherwise: Column) -> Column:
    piece = _PIECE.get(regex)
    if piece is None:
        return done
    return F.when(F.contains(F.lower(text) if regex.startswith("(?i)") else text, F.lit(piece)), done).otherwise(otherwise)


def _compiled(regex: str) -> str:
    return _UNICODE + _FIRST.get(regex, "") + regex


def _replaced(text: Column, placeholder: str, regex: str) -> Column:
    return _where_possible(text, regex, F.regexp_replace(text, _compiled(regex), placeholder), text)


def scrub(text: Column, custom: Sequence[Pattern] = ()) -> Column:
    """Replace every match by its typed placeholder, pattern after pattern.

    One expression, for values deep in a record. Every stage's text is named once, so
    patterns that cannot match are skipped here too.
    """

    def staged(text: Column, patterns: Sequence[Pattern]) -> Column:
        for _, placeholder, regex in patterns:
            text = let(text, lambda t: _replaced(t, placeholder, regex))  # noqa: B023
        return text

    marked = lambda t: F.when(t.rlike(_UNICODE + _MARK), staged(t, REDACTION_PATTERNS)).otherwise(staged(t, _UNMARKED))
    return let(staged(text, custom), marked)


def find(text: Column, custom: Sequence[Pattern] = ()) -> Column:
    """``array<struct<kind, match>>`` of all hits of all patterns on the raw text."""

    def hits(kind: str, regex: str) -> Column:
        none = F.array().cast("array<string>")
        found = _where_possible(text, regex, F.regexp_extract_all(text, F.lit(_compiled(regex)), F.lit(0)), none)
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match")))

    return F.concat(*[hits(kind, regex) for kind, _, regex in all_patterns(custom)])


def scrub_counts(df: DataFrame, text: str, custom: Sequence[Pattern] = ()) -> DataFrame:
    """Scrub column ``text`` and add ``n_findings``, counted stage by stage on the scrubbed text."""
    total = F.lit(0)
    out = df.withColumn("_t0", F.col(text))
    stages = all_patterns(custom)
    for i, (_, placeholder, regex) in enumerate(stages):
        before = F.col(f"_t{i}")
        total = total + _where_possible(before, regex, F.regexp_count(before, F.lit(_compiled(regex))), F.lit(0))
        out = out.withColumn(f"_t{i + 1}", _replaced(before, placeholder, regex))
    return out.withColumn("n_findings", total.cast("bigint")).withColumn(text, F.col(f"_t{len(stages)}")).drop(
        *[f"_t{i}" for i in range(len(stages) + 1)]
    )


#: A string of a JSON text with the colon that makes it a name, or anything between strings.
_JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++'


def scrub_json(json: Column, custom: Sequence[Pattern] = ()) -> Column:
    """Scrub the string values inside a JSON text of any shape and depth; names, numbers and layout stay as they are."""

    def changed(token: Column) -> Column:
        plain = F.try_variant_get(F.try_parse_json(token), "$", "string")
        written = lambda clean: F.regexp_replace(F.to_json(F.array(clean)), r"^\[|\]$", "")
        return let(plain, lambda p: let(scrub(p, custom), lambda clean: F.when(clean.eqNullSafe(p), token).otherwise(written(clean))))

    def one(token: Column) -> Column:
        return F.when(token.startswith('"') & ~token.endswith(":"), changed(token)).otherwise(token)

    def tokens(text: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0)), one), "")

    def inner(part: Column) -> Column:
        return let(changed(F.concat(F.lit('"'), part, F.lit('"'))), lambda c: F.substring(c, F.lit(2), F.length(c) - 2))

    def pieces(text: Column, parts: Column) -> Column:
        value = lambda i: (i % 2 == 1) & ~F.get(parts, i + 1).rlike(r"^\s*+:")
        quoted = F.array_join(F.transform(parts, lambda part, i: F.when(value(i), inner(part)).otherwise(part)), '"')
        return F.when(F.contains(text, F.lit('\\"')) | (F.size(parts) % 2 == 0), tokens(text)).otherwise(quoted)

    # Without an escaped quote every other part between quotes is a string, which a plain split finds far faster.
    return let(json, lambda text: let(F.split(text, '"', -1), lambda parts: pieces(text, parts)))


def scrub_value(c: Column, dtype: ty.DataType, custom: Sequence[Pattern] = ()) -> Column:
    """Scrub all strings inside a nested value; field names and map keys stay."""
    if isinstance(dtype, ty.StringType):
        return scrub(c, custom)
    if isinstance(dtype, ty.VariantType):
        return F.parse_json(scrub_json(F.to_json(c), custom))
    if isinstance(dtype, ty.ArrayType):
        return F.transform(c, lambda x: scrub_value(x, dtype.elementType, custom))
    if isinstance(dtype, ty.MapType):
        return F.transform_values(c, lambda _, v: scrub_value(v, dtype.valueType, custom))
    if isinstance(dtype, ty.StructType):
        fields = [scrub_value(c[f.name], f.dataType, custom).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def scrub_frame(df: DataFrame, custom: Sequence[Pattern] = (), only: Sequence[str] | None = None) -> DataFrame:
    names = set(only) if only is not None else set(df.columns)
    return df.select(
        *[
            (scrub_value(F.col(f.name), f.dataType, custom).alias(f.name) if f.name in names else F.col(f.name))
            for f in df.schema.fields
        ]
    )
