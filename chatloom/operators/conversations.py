"""From raw conversation trees to turns and transcripts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions import text as T
from chatloom.functions.dates import epoch_to_date, number
from chatloom.plans.blocks import pack_text
from chatloom.session import cut

RAW_SCHEMA = (
    "id string, conversation_id string, title string, create_time string, update_time string, "
    "current_node string, mapping map<string, struct<message: string, parent: string, children: array<string>>>"
)

# Content types with a rule of their own.
KNOWN_CONTENT_TYPES = [
    "text", "multimodal_text", "code", "user_editable_context",
    "tether_quote", "tether_browsing_display", "execution_output",
    "thoughts", "reasoning_recap", "reasoning", "system_error",
]
REASONING_TYPES = ["thoughts", "reasoning_recap", "reasoning"]
BROWSING_TYPES = ["tether_quote", "tether_browsing_display"]
TURN_ROLES = ["user", "assistant", "tool"]
PART_CHARS = 1_000_000


def parse(raw: DataFrame, column: str = "conversation") -> DataFrame:
    """Typed conversation header and node map of raw conversation JSON."""
    c = F.from_json(F.col(column), RAW_SCHEMA)
    rest = [x for x in raw.columns if x != column]
    return raw.select(*rest, c.alias("c")).select(
        *rest,
        F.coalesce(F.nullif("c.id", F.lit("")), F.nullif("c.conversation_id", F.lit(""))).alias("conv_id"),
        F.coalesce(F.nullif("c.title", F.lit("")), F.lit("untitled")).alias("title"),
        number(F.col("c.create_time")).alias("create_time"),
        number(F.col("c.update_time")).alias("update_time"),
        epoch_to_date(number(F.col("c.create_time"))).alias("create_date"),
        epoch_to_date(number(F.col("c.update_time"))).alias("update_date"),
        F.nullif("c.current_node", F.lit("")).alias("current_node"),
        F.col("c.mapping").alias("mapping"),
    )


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per tree node, in document order."""
    return conversations.select(
        "conv_id", F.posexplode(F.map_entries("mapping")).alias("pos", "entry")
    ).select(
        "conv_id",
        "pos",
        F.col("entry.key").alias("node_id"),
        F.nullif("entry.value.parent", F.lit("")).alias("parent"),
        F.coalesce(F.size("entry.value.children"), F.lit(0)).alias("n_children"),
        F.col("entry.value.message").alias("message"),
    )


def leaves(heads: DataFrame, node_rows: DataFrame) -> DataFrame:
    """The node each conversation ends on: its current node when that exists,
    else the latest childless node (the last listed one on equal times)."""
    when = F.coalesce(number(F.get_json_object("message", "$.create_time")), F.lit(0.0))
    fallback = (
        node_rows.where("n_children <= 0")
        .where(when >= -1.0)
        .groupBy("conv_id")
        .agg(F.max_by("node_id", F.struct(when.alias("t"), F.col("pos"))).alias("fallback"))
    )
    current = heads.select("conv_id", F.col("current_node").alias("node_id")).join(
        node_rows.select("conv_id", "node_id"), ["conv_id", "node_id"], "left_semi"
    )
    return (
        heads.select("conv_id")
        .join(current, "conv_id", "left")
        .join(fallback, "conv_id", "left")
        .select("conv_id", F.coalesce("node_id", "fallback").alias("node_id"))
        .where("node_id IS NOT NULL")
    )


def active_path(node_rows: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """Nodes from leaf to root as ``(conv_id, node_id, up)``, ``up`` = steps from the leaf.

    Pointer doubling: round k adds every 2**k-th ancestor, so a chain of n nodes
    needs about log2(n) joins, whatever the size of one conversation. Keeping the
    smallest ``up`` per node makes cycles harmless.
    """
    jump = cut(
        node_rows.alias("n")
        .join(
            node_rows.select("conv_id", F.col("node_id").alias("parent")).alias("p"),
            ["conv_id", "parent"],
            "left_semi",
        )
        .select("conv_id", "node_id", F.col("parent").alias("ancestor"))
    )
    path = cut(leaf_rows.select("conv_id", "node_id", F.lit(0).cast("bigint").alias("up")))
    size, step = path.count(), 1
    while True:
        reached = path.join(jump, ["conv_id", "node_id"]).select(
            "conv_id", F.col("ancestor").alias("node_id"), (F.col("up") + step).alias("up")
        )
        path = cut(path.unionByName(reached).groupBy("conv_id", "node_id").agg(F.min("up").alias("up")))
        grown = path.count()
        if grown == size:
            return path
        size, step = grown, step * 2
        further = jump.select("conv_id", F.col("node_id").alias("ancestor"), F.col("ancestor").alias("next"))
        jump = cut(
            jump.join(further, ["conv_id", "ancestor"]).select(
                "conv_id", "node_id", F.col("next").alias("ancestor")
            )
        )


# --- message content ------------------------------------------------------


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_text(v: Column) -> Column:
    return F.coalesce(_type(v) == "STRING", F.lit(False))


def _is_list(v: Column) -> Column:
    return F.coalesce(_type(v).startswith("ARRAY<"), F.lit(False))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _str(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _elements(v: Column) -> Column:
    """Elements of a list field; an empty array for anything else."""
    return F.when(_is_list(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(
        F.array().cast("array<variant>")
    )


#: White space as ``strip`` cuts it: Unicode's own list, which is not Python's.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class _Number(str):
    """A number as it is written."""


def _filled(v: object) -> bool:
    return not (v is None or v is False or v in ("", [], {}) or isinstance(v, _Number) and v in ("0", "0.0"))


def _flattened(json_text: str) -> str:
    """Text of a JSON value, each container opened once."""
    last, out = None, []
    open_nodes = [((), json.loads(json_text, parse_int=_Number, parse_float=_Number, strict=False))]
    while open_nodes:
        path, node = open_nodes.pop()
        if isinstance(node, list):
            members = [e for e in node if _filled(e)]
            open_nodes += [((*path, i), members[i]) for i in range(len(members) - 1, -1, -1)]
        elif isinstance(node, dict):
            name = next((k for k in ("text", "content", "summary", "result", "value") if k in node), None)
            if name is not None:
                open_nodes.append((path, node[name]))
        elif isinstance(node, str) and not isinstance(node, _Number) and (text := node.strip(_SPACE)):
            if last is not None:
                out.append("\n" * next(b - a for a, b in zip(last, path) if a != b))
            out.append(text)
            last = path
    return "".join(out)


def flat_text(v: Column) -> Column:
    """Text of a string, a list or an object field at any depth.

    A list joins its filled members' stripped texts by line ends, and empty ones at its
    ends are stripped: two neighbouring texts are as many line ends apart as their indices
    differ where their paths part. A value is walked once in an Arrow task, so the time
    is in proportion to its size, where opening it level by level copies it at each.
    """

    @F.pandas_udf("string")
    def walk(values: pd.Series) -> pd.Series:
        return values.map(_flattened, na_action="ignore")

    return F.coalesce(walk(F.to_json(v)), F.lit(""))


def _pick(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))


def _part(p: Column) -> Column:
    inner = _get(p, "$.text")
    tag = F.coalesce(F.nullif(_str(_get(p, "$.content_type")), F.lit("")), F.lit("asset"))
    return F.when(_is_text(p), _str(p)).when(
        F.coalesce(_type(p).startswith("OBJECT<"), F.lit(False)),
        F.when(_is_text(inner), _str(inner)).otherwise(F.concat(F.lit("["), tag, F.lit("]"))),
    )


#: Content types that need the flattened text of a field; other messages do not walk into it.
FLAT_FIELDS = {
    "title": ["tether_quote"], "url": ["tether_quote"], "text": ["tether_quote", "execution_output", "system_error"],
    "result": ["tether_browsing_display"], "summary": ["tether_browsing_display", *REASONING_TYPES],
    "thoughts": REASONING_TYPES, "content": REASONING_TYPES, "parts": REASONING_TYPES,
}


def read_messages(df: DataFrame, message: str = "message") -> DataFrame:
    """Replace a message JSON column by role, content_type, text, model and attachments.

    Content may be nested to any depth: each row is walked as deep as it is itself.
    """
    rest = [c for c in df.columns if c != message]
    kept = [F.col(c) for c in rest]
    parsed = df.select(*kept, F.try_parse_json(F.col(message)).alias("_m")).withColumn(
        "_content", _get(F.col("_m"), "$.content")
    )
    raw = lambda k: F.col(f"_raw_{k}")
    fields = parsed.select(
        *kept,
        "_m",
        "_content",
        F.coalesce(_str(_get(F.col("_content"), "$.content_type")), F.lit("")).alias("content_type"),
        *[_get(F.col("_content"), f"$.{k}").alias(f"_raw_{k}") for k in FLAT_FIELDS],
    )

    def flat(value: Column, kinds: list[str]) -> Column:
        return flat_text(F.when(F.col("content_type").isin(kinds), value))

    fields = fields.select(
        "*", *[flat(raw(k), kinds).alias(f"_f_{k}") for k, kinds in FLAT_FIELDS.items()], flat(F.col("_content"), ["system_error"]).alias("_f_all"))

    kind = F.col("content_type")
    quoted = F.concat_ws(" — ", F.nullif("_f_title", F.lit("")), F.nullif("_f_text", F.lit("")))
    inner = F.when(quoted != "", quoted).otherwise(F.col("_f_url"))
    linked = (F.col("_f_url") != "") & ~F.contains(inner, F.col("_f_url"))
    suffix = F.when(linked, F.concat(F.lit(" ("), F.col("_f_url"), F.lit(")"))).otherwise(F.lit(""))

    def labelled(label: str, text: Column) -> Column:
        return T.strip(F.concat(F.lit(f"[{label}] "), text))

    profile = F.concat_ws(
        "\n\n",
        *[F.nullif(_str(_get(F.col("_content"), f"$.{k}")), F.lit("")) for k in ("user_profile", "user_instructions")],
    )
    parts = F.filter(F.transform(_elements(raw("parts")), _part), lambda x: x.isNotNull())
    plain = _is_text(raw("text"))
    text = (
        F.when((kind == "code") & plain, T.strip(_str(raw("text"))))
        .when(kind == "user_editable_context", T.strip(profile))
        .when(kind == "tether_quote", labelled("web quote", F.concat(inner, suffix)))
        .when(kind == "tether_browsing_display", labelled("browsing", _pick("_f_result", "_f_summary")))
        .when(kind == "execution_output", labelled("execution output", F.col("_f_text")))
        .when(
            kind.isin(REASONING_TYPES),
            labelled("reasoning", _pick("_f_thoughts", "_f_content", "_f_summary", "_f_parts")),
        )
        .when(kind == "system_error", labelled("system_error", _pick("_f_text", "_f_all")))
        .when(_is_list(raw("parts")), T.strip(F.array_join(parts, "\n")))
        .when(plain, T.strip(_str(raw("text"))))
        .when(kind != "", F.concat(F.lit("["), kind, F.lit("]")))
        .otherwise(F.lit(""))
    )

    def slug(path: str) -> Column:
        v = _get(F.col("_m"), path)
        return F.when(_is_text(v), F.nullif(_str(v), F.lit("")))

    model = F.coalesce(slug("$.metadata.model_slug"), slug("$.metadata.default_model_slug"))

    def attached(a: Column) -> Column:
        name = F.coalesce(F.nullif(_str(_get(a, "$.name")), F.lit("")), _str(_get(a, "$.id")))
        return T.nonblank(F.when(_is_text(a), _str(a)).otherwise(name))

    named = F.filter(F.transform(_elements(_get(F.col("_m"), "$.metadata.attachments")), attached), lambda x: x.isNotNull())
    return fields.select(
        *kept,
        F.coalesce(_str(_get(F.col("_m"), "$.author.role")), F.lit("")).alias("role"),
        "content_type",
        text.alias("text"),
        F.when(T.strip(model) != "", model).alias("model"),
        named.alias("attachments"),
    )


def messages(conversations: DataFrame) -> DataFrame:
    """Messages of the active branch, root first: ``pos`` counts from 0.

    The branch and the result are written to the shared folder once, as both are read again.
    """
    rows = nodes(conversations)
    ends = leaves(conversations.select("conv_id", "current_node"), rows)
    path = active_path(rows, ends)
    depth = path.groupBy("conv_id").agg(F.max("up").alias("_deep"))
    placed = (
        path.join(depth, "conv_id")
        .select("conv_id", "node_id", (F.col("_deep") - F.col("up")).alias("pos"))
        .join(rows.select("conv_id", "node_id", "message"), ["conv_id", "node_id"])
        .select("conv_id", "pos", "message")
    )
    return cut(read_messages(cut(placed)))


def turns(message_rows: DataFrame) -> DataFrame:
    """User, assistant and tool turns that carry text, with the labelled reduced block."""
    reply = T.reduce_prose(F.col("text"))
    block = F.when(F.col("role") == "user", T.strip(F.col("text"))).otherwise(reply)
    return message_rows.where(F.col("role").isin(TURN_ROLES) & (F.col("text") != "")).withColumn(
        "block", F.concat(F.lit("["), F.col("role"), F.lit("] "), block)
    )


def transcripts(turn_rows: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Reduced transcript of each conversation in bounded parts (see ``pack_text``)."""
    return pack_text(turn_rows, "conv_id", "pos", "block", "\n\n", part_chars)
