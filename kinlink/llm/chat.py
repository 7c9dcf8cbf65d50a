"""Chat formatting with DataFrame functions only.

A table of any of the known layouts is recognised by the hash of its sorted nested field paths, which selects a declarative
mapping (Spark SQL expressions) to canonical turns, an array of (role, text). In a table that holds several layouts side by side
each row goes by the columns that it fills. A template then writes the turns as one string
with role marks and end marks; marks inside texts are escaped, reversibly, and the output can be read back.

Defined cases: null texts are empty, a null role is "user"; a conversation without turns gives an empty string; equal turn
numbers are ordered by role and text, and null ones come first; rows without a conversation id are one conversation; integers
of any width can number turns; repeated rows are repeated turns; an empty table gives no rows; further columns are ignored, since
the layout is looked up by the mapping's own paths if the whole table's paths match none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import table

# The template. A turn is OPEN + role + CLOSE + text + END; ESCAPE stands before every mark character of a role or text.
OPEN, CLOSE, END, ESCAPE = "### ", ": ", " </turn>\n", "\\"
# Roles whose text is trained on.
LOSS_ROLES = ("assistant",)

TURNS = "array<struct<role:string,text:string>>"


# Leaf types that count as another in a path.
_LEAVES = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint"}


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Sorted nested field paths with their leaf types; [] marks an array's elements."""
    if isinstance(kind, StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower()))
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    leaf = kind.simpleString()
    return [f"{prefix}:{_LEAVES.get(leaf, leaf)}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Names the paths that a layout has besides its id, and the SQL expression of its canonical turns."""

    name: str
    paths: tuple[str, ...]
    turns: str
    #: For layouts with a row for each turn: the order and the turn of a row.
    rows: tuple[str, str] | None = None

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))


def _pair(user: str, assistant: str) -> str:
    return f"array(named_struct('role','user','text',{user}), named_struct('role','assistant','text',{assistant}))"


MAPPINGS = (
    Mapping("turn rows", ("turn:bigint", "role:string", "text:string"), "", ("turn", "named_struct('role', role, 'text', text)")),
    Mapping("messages", ("messages[].role:string", "messages[].content:string"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping(
        "conversations",
        ("conversations[].from:string", "conversations[].value:string"),
        "transform(conversations, m -> named_struct('role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))",
    ),
    Mapping("prompt", ("prompt:string", "completion:string"), _pair("prompt", "completion")),
    Mapping("response", ("prompt:string", "response:string"), _pair("prompt", "response")),
    Mapping(
        "instruction",
        ("instruction:string", "input:string", "output:string"),
        _pair("concat_ws('\\n\\n', nullif(instruction, ''), nullif(input, ''))", "output"),
    ),
    Mapping("question", ("question:string", "answer:string"), _pair("question", "answer")),
    Mapping(
        "system prompt",
        ("system:string", "prompt:string", "response:string"),
        "concat(array(named_struct('role','system','text',system)), " + _pair("prompt", "response") + ")",
    ),
)
_BY_KEY = {m.key: m for m in MAPPINGS}


def mappings_of(schema: StructType, conversation_id: str) -> list[Mapping]:
    """The mapping whose fingerprint is that of the whole table's paths without the id, else those that the table has all paths
    of, by their number of paths."""
    paths = [p for p in field_paths(schema) if p.split(":")[0] != conversation_id.lower()]
    if (found := _BY_KEY.get(fingerprint(paths))) is not None:
        return [found]
    fitting = [m for m in MAPPINGS if set(m.paths) <= set(paths)]
    if not fitting:
        raise ValueError(f"no mapping for a layout with the paths {paths}")
    fitting.sort(key=lambda m: -len(m.paths))
    return fitting[:1] if fitting[0].rows else [m for m in fitting if not m.rows]


def _turns(mappings: list[Mapping]) -> Column:
    """The canonical turns of a row: by the first mapping all of whose columns the row has (is not null in), else by the first."""
    turns = F.expr(mappings[0].turns).cast(TURNS)
    for m in reversed(mappings):
        columns = {p.split(":")[0].split(".")[0].removesuffix("[]") for p in m.paths}
        turns = F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in sorted(columns)]), F.expr(m.turns).cast(TURNS)).otherwise(turns)
    return turns


def canonical(df: DataFrame, conversation_id: str) -> DataFrame:
    """(conv_id, turns) of a table of any known layout."""
    mappings = mappings_of(df.schema, conversation_id)
    if mappings[0].rows is None:
        rows = df.select(F.col(conversation_id).alias("conv_id"), (F.expr(mappings[0].turns).cast(TURNS) if len(mappings) == 1 else _turns(mappings)).alias("turns"))
    else:
        order, turn = mappings[0].rows
        rows = (
            df.select(F.col(conversation_id).alias("conv_id"), F.struct(F.col(order).alias("n"), F.expr(turn).cast("struct<role:string,text:string>").alias("t")).alias("row"))
            .groupBy("conv_id")
            .agg(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["t"]).alias("turns"))
        )
    filled = F.transform(
        F.coalesce("turns", F.array().cast(TURNS)),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )
    return rows.withColumn("turns", filled)


def _escaped(text: Column) -> Column:
    """The escape character before each character that starts a mark, and before itself."""
    return F.regexp_replace(text, r"([\\#:<])", r"\\$1")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#:<])", "$1")


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _escaped(t["role"]), F.lit(CLOSE), _escaped(t["text"]), F.lit(END))), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted string. Every `<` of a text has the escape character before it, so an end mark is the template's
    own; the first `: ` whose colon has none ends the role."""
    parts = F.split(text, END, -1)
    shape = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda part: F.struct(
            _plain(F.regexp_extract(part, shape, 1)).alias("role"),
            _plain(F.regexp_extract(part, shape, 2)).alias("text"),
        ),
    )


def format_chats(df: DataFrame, conversation_id: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, loss_spans): the formatted string of each conversation and, for every turn that is trained on, where
    its escaped text lies in it (from and to, in characters)."""
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.length(F.concat(F.lit(OPEN), _escaped(t["role"]), F.lit(CLOSE))).cast("long").alias("head"),
            F.length(_escaped(t["text"])).cast("long").alias("body"),
            t["role"].isin(*LOSS_ROLES).alias("loss"),
        ),
    )
    # A running position along the pieces.
    spans = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["head"] + p["body"] + len(END)).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["head"]).alias("a"), (s["at"] + p["head"] + p["body"]).alias("b")))))
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return canonical(df, conversation_id).select("conv_id", formatted(F.col("turns")).alias("formatted"), spans.alias("loss_spans"))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings say when they are read back."""
    back = chats.withColumn("back", read_back(F.col("formatted"))).withColumn(
        "loss",
        F.array_join(
            F.transform("loss_spans", lambda s: _plain(F.substring("formatted", (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))), ""
        ),
    )
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# The conversation that holds the template's own marks.
_PROBE = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PROBE).alias("text"),
    )
    return digests(format_chats(rows.unionByName(probe)))


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + 2 + 9 + length(role) + length(text)
    + length(regexp_replace(role, '[^\\#:<]', '', 'g')) + length(regexp_replace(text, '[^\\#:<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
