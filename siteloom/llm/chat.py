"""Chat formatting: schema fingerprints, canonical turns, a template, a loss mask.

Plain DataFrame expressions throughout. Records come in whatever layout: a prompt and
its completion, an instruction with or without input, message lists under either of two
names. The paths of the fields that a record has, sorted, hash to its fingerprint, and the
fingerprint selects a declarative mapping to canonical turns ``(role, text)``.

Defined cases: null texts and roles count as empty; a record with no known fingerprint
has no turns and a null layout; a record of no turns is an empty string; turns of equal
number keep an order by role and text; repeated rows are turns like others; an empty
table gives an empty result; columns that no
layout names are not read. A conversation is one string, so
it must fit one value of Spark (2 GB).
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template: a turn is OPEN role newline text CLOSE.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What may not appear in a text, after its first character and any backslashes.
_TAILS = r"(?=\||/?s>|/?INST\])"
_LEARNED = "assistant"


class Layout(NamedTuple):
    """``turns``: (role, path) for flat layouts; (list, role field, text field) for lists."""

    name: str
    paths: tuple[str, ...]
    turns: tuple


LAYOUTS = (
    Layout("prompt", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_system", ("instruction", "output", "system"), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", "output"))),
    Layout("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
)
#: Names of roles in the second list layout.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def fingerprint(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _present(field: Column, kind: T.DataType, path: str) -> list[Column]:
    """Paths below a field, each null where the record lacks it."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [F.when(field.isNotNull(), F.lit(f"{path}[].{f.name}")) for f in kind.elementType]
    if isinstance(kind, T.StructType):
        return [c for f in kind for c in _present(field[f.name], f.dataType, f"{path}.{f.name}")]
    return [F.when(field.isNotNull(), F.lit(path))]


def schema_fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the sorted paths of the fields that a row has, of those that some layout names."""
    named = {p.split("[")[0].split(".")[0] for x in layouts for p in x.paths}
    paths = [c for f in df.schema if f.name in named for c in _present(F.col(f.name), f.dataType, f.name)]
    if not paths:
        return F.lit(None).cast("string")
    return F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*paths))), "\n").cast("binary"), 256)


def _empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _turns(layout: Layout) -> Column:
    if isinstance(layout.turns[0], str):
        name, role, text = layout.turns
        names = lambda c: c if layout.name == "messages" else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), c), c)
        return F.transform(F.col(name), lambda m: F.struct(names(_empty(m[role])).alias("role"), _empty(m[text]).alias("text")))
    return F.array(*[F.struct(F.lit(role).alias("role"), (F.concat_ws("\n\n", *map(F.col, path)) if isinstance(path, tuple) else _empty(F.col(path))).alias("text")) for role, path in layout.turns])


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(id, layout, turns)``: each record through the mapping that its fingerprint selects."""
    known = [x for x in layouts if all(p.split("[")[0].split(".")[0] in df.columns for p in x.paths)]
    marked = df.withColumn("_mark", schema_fingerprint(df, layouts))
    turns = F.expr("array()").cast("array<struct<role:string,text:string>>")
    name = F.lit(None).cast("string")
    for x in known:
        mine = F.col("_mark") == fingerprint(x.paths)
        turns, name = F.when(mine, _turns(x)).otherwise(turns), F.when(mine, F.lit(x.name)).otherwise(name)
    return marked.select(F.col(id_col), name.alias("layout"), turns.alias("turns"))


def gather(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as records of the message layout."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    listed = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(turn)).alias("found"))
    return listed.select(id_col, F.transform("found", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def escape(text: Column) -> Column:
    """One more backslash inside anything that looks like a control string, escaped or not."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, r"$1$2")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(id, layout, formatted, loss_spans)``: the string, and where the loss counts in it.

    A span is (start, length) in code points of ``formatted``: the escaped text of an
    assistant turn, without role, marks or anything between.
    """
    made = df.withColumn("_t", F.transform("turns", lambda t: F.struct((t["role"] == _LEARNED).alias("learn"), F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"))))
    spans = F.expr(
        f"""aggregate(_t, struct(0L AS at, cast(array() AS array<struct<start:bigint,length:bigint>>) AS spans),
        (a, t) -> struct(a.at + length(t.head) + length(t.body) + {len(CLOSE)} AS at,
          CASE WHEN t.learn THEN array_append(a.spans, struct(a.at + length(t.head) AS start, cast(length(t.body) AS bigint) AS length)) ELSE a.spans END AS spans), a -> a.spans)"""
    )
    joined = F.array_join(F.transform("_t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return made.select(id_col, "layout", joined.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns from a formatted string alone."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        whole,
        lambda s: F.struct(
            _role_in(F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(s, r"^[^\n]*\n", "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
