"""Chat formatting by schema fingerprints; DataFrame functions only.

Records come in many layouts: prompt and completion, instruction with input and output, lists of
messages under several names, or one row per turn. A record is a JSON object or a row of a table. The
nested field paths of a record that matter here are hashed; the hash selects a declared mapping, which
gives the record's canonical turns (role, text).
Turns are then rendered with one template, with a loss mask over the assistant's texts.

Template: every turn is ``[INST]role[/INST]``, a line break, the text, ``</s>`` and a line break. Inside
roles and texts a backslash is doubled and a control string gets a backslash after its first character,
so control strings stand only where the template puts them and everything can be read back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "[INST]", "[/INST]\n", "</s>\n"

# Names that other tools give to the roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
# Fields of messages, and fields of records, that any mapping reads; others do not count for a layout.
MESSAGE_FIELDS = ("content", "from", "role", "text", "value")
LISTS = ("conversations", "dialogue", "messages")
SCALARS = ("completion", "input", "instruction", "output", "prompt", "question", "answer", "response", "system")
# Fields of a record that is one turn; they count only together.
TURN_FIELDS = ("role", "text", "turn")


@dataclass(frozen=True)
class Mapping:
    """Turns of a layout: fields with their roles in order, a list with its role and text fields, or the record itself."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    one_turn: bool = False


def _mappings() -> list[Mapping]:
    out = [Mapping(TURN_FIELDS, one_turn=True)]
    for fields in (("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("instruction", "output"), ("instruction", "response")):
        for extra in ((), ("input",)) if fields[0] == "instruction" else ((),):
            for system in ((), ("system",)):
                turns = (*((("system", system),) if system else ()), ("user", (fields[0], *extra)), ("assistant", (fields[1],)))
                out.append(Mapping((*fields, *extra, *system), turns))
    for name in LISTS:
        for role, text in (("role", "content"), ("from", "value"), ("role", "text")):
            for system in ((), ("system",)):
                out.append(Mapping((f"{name}[].{role}", f"{name}[].{text}", *system), ((("system", system),) if system else ()), (name, role, text)))
    return out


MAPPINGS = _mappings()


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _under(name: str) -> Callable[[Column], Column]:
    return lambda field: F.concat(F.lit(f"{name}[]."), field)


def fingerprint(record: Column) -> Column:
    """Hash of the field paths of a JSON record; null if it is not a JSON object."""
    parsed, keys = F.try_parse_json(record), F.json_object_keys(record)
    none = F.array().cast("array<string>")
    paths = [F.when(F.array_contains(keys, name), F.array(F.lit(name))).otherwise(none) for name in SCALARS]
    one_turn = F.array(*[F.lit(name) for name in TURN_FIELDS])
    paths.append(F.when(F.size(F.array_except(one_turn, keys)) == 0, one_turn).otherwise(none))
    for name in LISTS:
        shape = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        inner = F.array_distinct(F.regexp_extract_all(shape, F.lit(r"[<, ]((?:" + "|".join(MESSAGE_FIELDS) + r")): "), 1))
        listed = F.transform(inner, _under(name))
        paths.append(F.when(shape.startswith("ARRAY<OBJECT<"), listed).otherwise(none))
    return F.when(keys.isNotNull(), path_hash(F.concat(*paths)))


def column_paths(df: DataFrame) -> list[str]:
    """Field paths of a table's rows, of the fields that any mapping reads."""
    names = set(df.columns)
    paths = [name for name in SCALARS if name in names]
    paths += TURN_FIELDS if names.issuperset(TURN_FIELDS) else ()
    for name in LISTS:
        kind = df.schema[name].dataType if name in names else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            paths += [f"{name}[].{f}" for f in MESSAGE_FIELDS if f in kind.elementType.names]
    return paths


def _role(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = low
    for theirs, ours in ROLE_NAMES.items():
        out = F.when(low == theirs, F.lit(ours)).otherwise(out)
    return out


TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _turns(m: Mapping, got: Callable[[str], Column], listed: Callable[[str, str, str], Column]) -> Column:
    """Turns by a mapping; ``got`` reads a field of the record, ``listed`` (role, text) structs of a list."""
    if m.one_turn:
        return F.array(F.struct(got("turn").cast("bigint").alias("turn"), got("role").cast("string").alias("role"), got("text").cast("string").alias("text")))
    full = lambda f: F.coalesce(got(f).cast("string"), F.lit(""))
    joined = lambda fields: F.array_join(F.filter(F.array(*[full(f) for f in fields]), lambda t: t != ""), "\n\n")
    fixed = [F.struct(F.lit(role).alias("role"), joined(fields).alias("text")) for role, fields in m.turns]
    turns = F.array(*fixed) if fixed else None
    if m.messages is not None:
        items = F.transform(listed(*m.messages), lambda i: F.struct(_role(i["role"]).alias("role"), F.coalesce(i["text"], F.lit("")).alias("text")))
        turns = F.concat(turns, items) if fixed else items
    return F.transform(turns, lambda t, i: F.struct(i.cast("bigint").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))


def _selected(mark: Column, mappings: list[Mapping], got: Callable[[str], Column], listed: Callable[[str, str, str], Column]) -> Column:
    """The turns by the mapping whose paths have the hash ``mark``; null if none has."""
    out = F.lit(None).cast(TURNS)
    for m in mappings:
        own = _turns(m, got, listed).cast(TURNS)
        out = F.when(mark == path_hash(F.array(*[F.lit(p) for p in m.paths])), own).otherwise(out)
    return out


def canonical_turns(record: Column) -> Column:
    """Turns array<struct<turn, role, text>> of a JSON record by the mapping its fingerprint selects; null if none does."""

    def listed(name: str, role: str, text: str) -> Column:
        items = F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda i: F.struct(i[role].alias("role"), i[text].alias("text")))

    return _selected(fingerprint(record), MAPPINGS, lambda f: F.get_json_object(record, f"$.{f}"), listed)


def column_turns(df: DataFrame) -> Column:
    """Like ``canonical_turns`` for rows of a table, whose columns are the fields."""
    paths = column_paths(df)
    mark = path_hash(F.array(*[F.lit(p) for p in paths]).cast("array<string>"))
    # Mappings that read other fields cannot be selected, and their fields could not be named.
    able = [m for m in MAPPINGS if set(m.paths) <= set(paths)]

    def listed(name: str, role: str, text: str) -> Column:
        return F.transform(F.col(name), lambda i: F.struct(i[role].cast("string").alias("role"), i[text].cast("string").alias("text")))

    return _selected(mark, able, F.col, listed)


def turn_rows(df: DataFrame, key: str, record: str | None = None) -> DataFrame:
    """(key, turn, role, text, layout_known) rows of records in whatever layout they have.

    ``record`` names a column of JSON records; without it every row of the table is a record, with its
    columns for fields. A record that is one turn keeps its own turn number, role and text; turns of others are
    numbered from 0. A record without a known mapping gives one row with ``layout_known`` false and
    null turn, role and text: nothing is dropped silently. A known record without turns gives no row. Other
    columns are ignored.
    """
    turns = column_turns(df) if record is None else canonical_turns(F.col(record))
    known = df.select(F.col(key).alias("key"), turns.alias("turns"))
    each = known.select("key", F.col("turns").isNotNull().alias("layout_known"), F.explode_outer("turns").alias("t"))
    return each.select("key", "t.turn", "t.role", "t.text", "layout_known").where(F.col("t").isNotNull() | ~F.col("layout_known"))


def escaped(text: Column) -> Column:
    twice = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(twice, r"\[(/?INST\])", r"[\\$1"), r"<(/s>)", r"<\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(key, formatted, mask): one row per conversation.

    ``turns`` has key, turn, role and text; rows without a known layout must be taken out before. Turns
    stand in the order of turn, role, text (nulls first), repeated rows included; a null role or text is
    empty, and rows with a null key are one conversation. ``mask`` has for each turn its place in the
    formatted text and the span of the loss in it (length 0 unless the role is assistant), in code points.
    Lengths are summed by a window and nothing is looked up from the start of the text, so a very long
    conversation costs in proportion to its length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("key", "turn", role.alias("role"), text.alias("text"))
    head, body = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)), escaped(F.col("text"))
    rows = rows.withColumn("head", head).withColumn("body", body).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    upto = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = upto - F.length("piece")
    loss = F.when(F.col("role") == "assistant", F.length("body")).otherwise(0)
    span = F.struct(start.alias("start"), (start + F.length("head")).alias("loss_start"), loss.alias("loss_length"))
    rows = rows.withColumn("span", span).select("key", "place", "piece", "span")
    whole = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "span"))).alias("all"))
    return whole.select("key", F.array_join("all.piece", "").alias("formatted"), F.col("all.span").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(key, turns, loss, formatted_chars): turns and the text under the loss mask, read from ``format_turns``' output."""
    cut = F.split("formatted", END)
    pieces = formatted.select("key", "mask", F.length("formatted").cast("bigint").alias("formatted_chars"), F.slice(cut, 1, F.size(cut) - 1).alias("pieces"))
    head = r"(?s)^\[INST\](.*?)\[/INST\]\n(.*)$"
    turn = lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text"))
    span = lambda p, m: unescaped(F.substr(p, (m["loss_start"] - m["start"] + 1).cast("int"), m["loss_length"].cast("int")))
    return pieces.select("key", F.transform("pieces", turn).alias("turns"), F.zip_with("pieces", "mask", span).alias("loss"), "formatted_chars")
