"""Chat formatting: field paths are hashed, the hash selects a declarative mapping.

Only DataFrame functions are used.  A table of typed columns may hold rows of several
layouts: each row is fingerprinted by the nested field paths of the columns that are
not null in it.  JSON texts are fingerprinted by the schema of the parsed value.  Both
give the same hash for the same paths, whatever the order of the fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayloom.llm._common import fresh

OPEN, MIDDLE, CLOSE = "<|start|>", "<|text|>", "<|end|>\n"
# Strings that chat templates use to steer a model.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
# Other names of the two roles in the sender/value layout.
SENDERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: either fixed (role, paths) or one array of turns."""

    name: str
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    optional: frozenset[str] = field(default_factory=frozenset)
    aliases: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        """The nested field paths of the layout; those of arrays are marked by []."""
        if self.array:
            return sorted([f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"])
        return sorted({p for _, own in self.fixed for p in own})

    def variants(self) -> list[list[str]]:
        """The path lists with and without each optional path."""
        rest = [p for p in self.paths() if p not in self.optional]
        some = sorted(self.optional)
        return [sorted([*rest, *more]) for n in range(len(some) + 1) for more in combinations(some, n)]


MAPPINGS = [
    Mapping("messages", array="messages", role="role", text="content"),
    Mapping("senders", array="conversations", role="from", text="value", aliases=tuple(SENDERS.items())),
    Mapping("prompt", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Mapping("question", fixed=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), optional=frozenset({"system"})),
    Mapping("instruction", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
]


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a type, sorted."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def shape(paths: list[str]) -> str:
    """Nested paths written as one nested type, fields sorted: what is hashed."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})

    def show(at: dict) -> str:
        if not at:
            return "*"
        if list(at) == ["[]"]:
            return f"ARRAY<{show(at['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {show(at[k])}" for k in sorted(at)) + ">"

    return show(tree)


def fingerprint(schema: Column) -> Column:
    """The hash of a shape, as of :func:`shape`."""
    return F.xxhash64(schema)


def json_shape(record: Column) -> Column:
    """The shape of a JSON text; scalar types do not count, null is an unreadable text."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r"(?<=[<:] |<)(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\([0-9,]*\)|DATE|TIMESTAMP(_NTZ)?|FLOAT|BINARY|VARIANT)(?=[,>])", "*")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _fixed(mapping: Mapping, get) -> Column:
    """Turns of fixed roles; absent ones are left out, several paths join by a line."""
    turns = []
    for role, paths in mapping.fixed:
        texts = [get(p) for p in paths]
        there = [t for t in texts if t is not None]
        if there:
            optional = all(p in mapping.optional for p in paths)
            text = there[0] if len(there) == 1 else F.concat_ws("\n", *[F.when((t != "") | F.lit(i == 0), t) for i, t in enumerate(there)])
            turn = F.array(_turn(F.lit(role), text))
            turns.append(F.when(there[0].isNotNull(), turn).otherwise(F.array().cast(TURNS)) if optional else turn)
    return F.concat(*turns)


def _array(mapping: Mapping, rows: Column) -> Column:
    def one(x: Column) -> Column:
        role = x[mapping.role]
        if mapping.aliases:
            role = reduce(lambda c, a: F.when(x[mapping.role] == a[0], a[1]).otherwise(c), mapping.aliases, role)
        return _turn(role, x[mapping.text])

    return F.coalesce(F.transform(rows, one), F.array().cast(TURNS))


def row_shape(schema: T.StructType, columns: list[str]) -> Column:
    """The shape of the columns that are not null in a row, as of :func:`shape`."""
    fields = [(c, shape(schema_paths(schema[c].dataType, c)).removeprefix("OBJECT<").removesuffix(">")) for c in sorted(columns)]
    there = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(own)) for c, own in fields]), lambda x: x.isNotNull())
    return F.concat(F.lit("OBJECT<"), F.array_join(there, ", "), F.lit(">"))


def turns_of(df: DataFrame, columns: list[str], mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Add layout and turns to each row, by the mapping of the row's own fingerprint.

    The fingerprint hashes the nested field paths of those of ``columns`` that are not
    null.  Rows whose paths no mapping has, such as rows of nulls alone, get a null
    layout and null turns.  Columns named layout and turns are replaced, others kept;
    repeated rows give equal turns; an empty table gives none.
    """
    key, *_ = fresh(df.columns, "shape")
    columns = [c for c in columns if c in df.columns]
    df = df.withColumn(key, fingerprint(row_shape(df.schema, columns)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in mappings:
        for paths in mapping.variants():
            if {p.partition("[]")[0] for p in paths} <= set(columns):
                own = _array(mapping, F.col(mapping.array)) if mapping.array else _fixed(mapping, lambda p, own=paths: F.col(p).cast("string") if p in own else None)
                here = F.col(key) == fingerprint(F.lit(shape(paths)))
                layout, turns = F.when(here, F.lit(mapping.name)).otherwise(layout), F.when(here, own).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns}).drop(key)


def turns_of_json(df: DataFrame, record: str = "record", mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Add layout and turns, each row's JSON text by the mapping of its own fingerprint.

    Texts that are null, no JSON or of an unknown shape have a null layout and null
    turns; null fields count as absent fields of fixed layouts and as empty texts in
    arrays of turns.  Columns named layout and turns are replaced.
    """
    value, key = F.try_parse_json(record), fresh(df.columns, "shape")[0]
    df = df.withColumn(key, fingerprint(json_shape(F.col(record))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in mappings:
        for paths in mapping.variants():
            here = F.col(key) == fingerprint(F.lit(shape(paths)))
            if mapping.array:
                rows = F.try_variant_get(value, f"$.{mapping.array}", f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>")
                own = _array(mapping, rows)
            else:
                own = _fixed(mapping, lambda p, own=paths: F.try_variant_get(value, f"$.{p}", "string") if p in own else None)
            layout, turns = F.when(here, F.lit(mapping.name)).otherwise(layout), F.when(here, own).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns}).drop(key)


def escape(text: Column) -> Column:
    """Backslashes doubled, and a backslash after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: each backslash gives way to what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """Add formatted and pieces: the text, and its parts in order with a loss mask.

    Each turn is an opening mark, the escaped role, a middle mark, the escaped text
    and a closing mark; ``loss`` marks the texts of the ``trained`` role alone.  No
    turns, or null turns, give an empty text and no pieces; a conversation is one text,
    however long.  Columns named formatted and pieces are replaced, others kept.
    """
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            F.coalesce(F.col(turns), F.array().cast(TURNS)),
            lambda t: F.array(
                piece(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)), F.lit(False)),
                piece(escape(t["text"]), t["role"] == trained),
                piece(F.lit(CLOSE), F.lit(False)),
            ),
        )
    )
    df = df.withColumn("pieces", parts)
    return df.withColumn("formatted", F.array_join(F.col("pieces.text"), ""))


def parse(formatted: Column) -> Column:
    """The turns, read back from a formatted text."""
    quoted = lambda s: "".join(f"\\{c}" if c in "<>|" else c for c in s)
    rows = F.filter(F.split(formatted, quoted(CLOSE)), lambda x: x != "")

    def one(x: Column) -> Column:
        halves = F.split(x, quoted(MIDDLE), 2)
        return F.struct(unescape(F.substr(halves[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(rows, one)


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def conversations_as_messages(rows: DataFrame) -> DataFrame:
    """One row per conv_id with messages, an array of (role, content) by turn.

    Ties of a turn are ordered by role, then text; null turns come first; null roles
    and texts are empty; rows of a null conv_id form one conversation, repeated rows
    are turns of their own, and an empty table gives none.  Other columns are not read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    groups = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    return groups.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
