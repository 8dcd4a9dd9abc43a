"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a VARIANT of any layout. Its nested field paths (from ``schema_of_variant``, types stripped) are hashed; the
hash selects a declarative mapping (:class:`Layout`) that says where turns, roles and contents sit. A layout's fingerprint is the hash of the paths that it requires, and a record is
hashed over those of its paths that the layout requires, so further fields do no harm; of several layouts that fit, the one with most required paths is taken. Each record becomes an array of
canonical turns (role, text); records whose layout has no mapping keep a null array and the fingerprint of all their paths, so that they can be reported.

The template writes a turn as ``### <role>: <text></turn>\\n``. In texts and roles a backslash is doubled and the control
strings ``### `` and ``</turn>`` (and ``: `` in roles) get a backslash after their first character, so no control string is left inside a text
and dropping each introducing backslash restores it. :func:`parse_turns` splits the output at ``</turn>`` and undoes the escapes.

Defined cases: null texts and roles count as empty; roles are kept as they are, but for layouts that name a mapping of their own; a content that is a list of parts is the text of its parts, one after the other,
and parts without text count as empty; an empty list of messages has no turns; an empty or missing system prompt of a flat record is no turn; turns order by turn number (nulls first), then role, then text; repeated rows are
turns of their own; an empty table gives an empty result. A conversation is one value by its nature (its digest covers all turns): turns are gathered with
map-side pre-aggregation, and what one task holds is one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import read_table

OPEN, CLOSE, ROLE_END = "### ", "</turn>", ": "
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns. ``required``: the nested field paths that identify it; others are ignored.

    ``list_path``: path of an array of turn objects with ``role_key`` and ``text_key`` (``only_empty``: of an empty one); or else ``fields``: (path, role) in order, where a path may
    join several with ``|``. ``role_path``: the record is itself one turn. ``roles``: the layout's own role names and the canonical ones.
    """

    name: str
    required: tuple[str, ...]
    list_path: str | None = None
    role_key: str = "role"
    text_key: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    role_path: str | None = None
    text_path: str | None = None
    roles: tuple[tuple[str, str], ...] = ()
    only_empty: bool = False

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.required)).encode()).hexdigest()


def _listed(top: str, role: str, text: str, roles: tuple[tuple[str, str], ...] = ()) -> Layout:
    return Layout(top, (top, f"{top}[]", f"{top}[].{role}", f"{top}[].{text}"), f"$.{top}", role, text, roles=roles)


def _empty(top: str) -> Layout:
    return Layout(f"{top}_empty", (top, f"{top}[]"), f"$.{top}", only_empty=True)


def _flat(name: str, *fields: tuple[str, str], optional: tuple[tuple[str, str], ...] = ()) -> Layout:
    return Layout(name, tuple(f for f, _ in fields), fields=tuple((f"$.{f}", r) for f, r in (*optional, *fields)))


#: Role names of the layout that calls its list ``conversations``.
SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
_SYSTEM = (("system", "system"),)

#: Mappings in use; a new layout is one more line here or in the caller's list.
LAYOUTS: tuple[Layout, ...] = (
    Layout("turn_row", ("role", "text"), role_path="$.role", text_path="$.text"),
    _listed("messages", "role", "content"),
    _listed("conversations", "from", "value", SHARED_ROLES),
    _empty("messages"),
    _empty("conversations"),
    _flat("prompt_completion", ("prompt", "user"), ("completion", "assistant"), optional=_SYSTEM),
    _flat("prompt_response", ("prompt", "user"), ("response", "assistant"), optional=_SYSTEM),
    _flat("question_answer", ("question", "user"), ("answer", "assistant"), optional=_SYSTEM),
    _flat("instruction_output", ("instruction", "user"), ("output", "assistant"), optional=_SYSTEM),
    Layout("instruction_input_output", ("instruction", "input", "output"), fields=(*(("$.system", "system"),), ("$.instruction|$.input", "user"), ("$.output", "assistant"))),
)


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a VARIANT: ``a``, ``a.b``, ``a[]`` for elements of an array, ``a[].b``; scalar types do not matter.

    ``schema_of_variant`` prints ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``. One fold over its name, opening and closing
    tokens keeps the current prefix as a stack.
    """
    schema = F.schema_of_variant(record)
    tokens = F.regexp_extract_all(schema, F.lit(r"(OBJECT<|ARRAY<|>|`(?:[^`]|``)*`: |[^<>:,` ]+: )"), F.lit(1))
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, tok: Column) -> Column:
        top = F.element_at(acc["stack"], -1)
        here = F.when(acc["name"] == "", top).otherwise(acc["name"])
        arr = F.concat(here, F.lit("[]"))
        name = F.regexp_replace(F.regexp_replace(tok, r"^`|`?: $", ""), "``", "`")
        full = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        pop = F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(1)))
        return (
            F.when(tok == "OBJECT<", F.struct(F.concat(acc["stack"], F.array(here)).alias("stack"), F.lit("").alias("name"), acc["out"].alias("out")))
            .when(tok == "ARRAY<", F.struct(F.concat(acc["stack"], F.array(arr)).alias("stack"), arr.alias("name"), F.concat(acc["out"], F.array(arr)).alias("out")))
            .when(tok == ">", F.struct(pop.alias("stack"), F.lit("").alias("name"), acc["out"].alias("out")))
            .otherwise(F.struct(acc["stack"].alias("stack"), full.alias("name"), F.concat(acc["out"], F.array(full)).alias("out")))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["out"]))


def fingerprint(record: Column) -> Column:
    """SHA-256 (hex) of the record's nested field paths, one a line."""
    return F.sha2(F.concat_ws("\n", field_paths(record)), 256)


def _get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def _text(value: Column) -> Column:
    """The text of a content: a scalar, or the parts of a list one after the other (objects give their ``text``)."""

    def part(p: Column) -> Column:
        return F.coalesce(F.when(F.schema_of_variant(p).startswith("OBJECT<"), _get(p, "$.text")).otherwise(_get(p, "$")), F.lit(""))

    parts = F.transform(_get(value, "$", "array<variant>"), part)
    return F.when(F.schema_of_variant(value).startswith("ARRAY<"), F.concat_ws("", parts)).otherwise(_get(value, "$"))


def _turns_of(record: Column, layout: Layout) -> Column:
    at = lambda path: _text(_get(record, path, "variant"))
    if layout.role_path:
        turns = F.array(F.struct(_get(record, layout.role_path).alias("role"), at(layout.text_path).alias("text")))
    elif layout.list_path:
        items = _get(record, layout.list_path, "array<variant>")
        if layout.only_empty:
            return F.when(F.size(items) == 0, F.array().cast(TURNS))
        turns = F.transform(items, lambda m: F.struct(_get(m, f"$.{layout.role_key}").alias("role"), _text(_get(m, f"$.{layout.text_key}", "variant")).alias("text")))
    else:
        made = []
        for path, role in layout.fields:
            text = F.concat_ws("\n\n", *[F.nullif(at(p), F.lit("")) for p in path.split("|")])
            made.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        # An empty system prompt is no turn; an empty answer stays one.
        turns = F.filter(F.array(*made), lambda t: (t["role"] != "system") | (t["text"] != ""))
    role = lambda t: F.coalesce(t["role"], F.lit(""))
    if layout.roles:
        names = F.create_map(*[F.lit(x) for kv in layout.roles for x in kv])
        role = lambda t: F.coalesce(F.element_at(names, F.coalesce(t["role"], F.lit(""))), t["role"], F.lit(""))
    return F.transform(turns.cast(TURNS), lambda t: F.struct(role(t).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def canonical_turns(df: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``layout_fingerprint`` (of all paths), ``layout`` (null: unknown) and ``turns`` to ``df``; ``record`` is a VARIANT column."""
    name = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for lay in sorted(layouts, key=lambda x: len(x.required)):
        known = F.array_sort(F.array_intersect("__paths", F.array(*map(F.lit, lay.required))))
        name = F.when(F.sha2(F.concat_ws("\n", known), 256) == lay.fingerprint, F.lit(lay.name)).otherwise(name)
    for lay in layouts:
        turns = F.when(F.col("layout") == lay.name, _turns_of(F.col(record), lay)).otherwise(turns)
    out = df.withColumn("__paths", field_paths(F.col(record))).withColumn("layout", name).withColumn("turns", turns)
    # A list that only an empty one may look like, but is not: unknown.
    return out.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout"))).withColumn("layout_fingerprint", F.sha2(F.concat_ws("\n", "__paths"), 256)).drop("__paths")


def _escape(text: Column, *controls: str) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    """The whole conversation as one string."""
    one = lambda t: F.concat(F.lit(OPEN), _escape(t["role"], OPEN, CLOSE, ROLE_END), F.lit(ROLE_END), _escape(t["text"], OPEN, CLOSE), F.lit(CLOSE + "\n"))
    return F.concat_ws("", F.transform(turns, one))


def parse_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, as (role, text, loss); loss is true under the loss mask: texts of the assistant."""
    pieces = F.filter(F.split(formatted, CLOSE + "\n", -1), lambda p: p != "")

    def one(piece: Column) -> Column:
        at = F.locate(ROLE_END, piece, len(OPEN) + 1)
        role = _unescape(F.substring(piece, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1)))
        text = _unescape(F.substring(piece, at + len(ROLE_END), F.length(piece)))
        return F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("loss"))

    return F.transform(pieces, one)


def records_of(turns: Column) -> Column:
    """A conversation's turns as a record of the layout that its shape suggests: prompt and response, the same with a system prompt, or a list of messages."""
    roles, text = F.transform(turns, lambda t: t["role"]), lambda i: F.element_at(turns, i)["text"]
    plain = lambda *names: roles == F.array(*map(F.lit, names))
    # An empty system prompt would be no turn in a flat record.
    return (
        F.when(plain("user", "assistant"), F.to_variant_object(F.struct(text(1).alias("prompt"), text(2).alias("response"))))
        .when(plain("system", "user", "assistant") & (text(1) != ""), F.to_variant_object(F.struct(text(1).alias("system"), text(2).alias("prompt"), text(3).alias("response"))))
        .otherwise(F.to_variant_object(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    )


def gathered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of a table of turns: ``conv`` and ``record``, a VARIANT."""
    each = rows.select(F.col(conv).alias("__c"), F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("__m"))
    whole = each.groupBy("__c").agg(F.sort_array(F.collect_list("__m")).alias("__all"))
    return whole.select(F.col("__c").alias(conv), records_of(F.col("__all")).alias("record"))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """One row per conversation of a table of turns: ``conv``, ``layout``, ``formatted``."""
    return canonical_turns(gathered(rows, conv, turn, role, text), "record", layouts).select(conv, "layout", format_turns(F.col("turns")).alias("formatted"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")).select("conv_id", "x.turn", "x.role", F.lit(probe).alias("text"))
    formatted = format_conversations(rows.unionByName(extra))
    read = formatted.withColumn("turns", parse_turns(F.col("formatted")))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]))
    read = read.withColumn("loss", loss)
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
esc AS (
  SELECT *,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ') AS erole,
    replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS etext
  FROM rows
),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length('### ' || erole || ': ' || etext || '</turn>') + 1) AS formatted_chars
  FROM esc GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM conv
"""
