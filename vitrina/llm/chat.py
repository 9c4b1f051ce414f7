"""Chat formatting by schema fingerprints, in DataFrame operations only.

The nested field paths of a layout are hashed; the hash selects a declarative mapping that
turns prompt, instruction or message layouts into canonical turns (id, turn, role, text).
A template then marks the turns and escapes control strings inside texts reversibly.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's marks, and the strings that common templates reserve; all begin with < or [.
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
RESERVED = {"<": ["s>", "/s>", "<SYS>>", "</SYS>>", "|"], "[": ["INST]", "/INST]"]}
ESCAPE = "\\"
TRAINED_ROLE = "assistant"
# Turns that one first aggregate puts together; longer conversations are joined from such parts.
PART_TURNS = 64


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``turns`` has (role, paths of its text, joined by blank lines) for layouts with one
    column per role; ``items`` names an array of messages; a layout of one row per turn
    has neither.
    """

    name: str
    role: str = ""
    text: str = ""
    position: str = ""
    items: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> tuple[str, ...]:
        if self.turns:
            return tuple(sorted(p for _, paths in self.turns for p in paths))
        inside = f"{self.items}[]." if self.items else ""
        return tuple(sorted(filter(None, (inside + self.role, inside + self.text, self.position, self.items))))


# Field names of public conversation layouts. Of several that fit, the first counts.
LAYOUTS = (
    Layout("turn rows", role="role", text="text", position="turn"),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("shared chats", items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction with input", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system, prompt and response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and response", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question and answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
)
_KNOWN = sorted({p for layout in LAYOUTS for p in layout.paths})


def fingerprint(paths) -> str:
    """Hash of the field paths that any mapping knows; other fields do not count."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(_KNOWN))).encode()).hexdigest()


MAPPINGS = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """All nested field paths, ``[]`` standing for the elements of an array."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        out.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, path + ".")
    return out


def layout_of(paths: list[str]) -> Layout:
    """The mapping of a fingerprint; where extra known fields change it, the first mapping whose fields are all there."""
    found = MAPPINGS.get(fingerprint(paths)) or next((m for m in LAYOUTS if set(m.paths) <= set(paths)), None)
    if found is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return found


def _turns(layout: Layout, at) -> Column:
    """Array of (role, text) of one record; ``at`` gives the column of a path."""
    renamed = lambda role: F.coalesce(
        F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair])[role], role
    ) if layout.roles else role
    if layout.items:
        return F.transform(F.coalesce(at(layout.items), F.array()), lambda m: F.struct(
            F.coalesce(renamed(m[layout.role].cast("string")), F.lit("")).alias("role"),
            F.coalesce(m[layout.text].cast("string"), F.lit("")).alias("text"),
        ))
    rows = []
    for role, paths in layout.turns:
        texts = F.filter(F.array(*[at(p).cast("string") for p in paths]), lambda t: t.isNotNull() & (t != ""))
        rows.append(F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text")))
    # A record without a system text has no system turn.
    return F.filter(F.array(*rows), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical_turns(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout.

    Null roles and texts become empty; fields that no mapping knows are ignored. An
    unknown layout is an error. Null ids form one conversation.
    """
    layout = layout_of(schema_paths(records.schema))
    key = F.col(f"`{id_column}`").cast("long").alias("conv_id")
    if not layout.items and not layout.turns:
        return records.select(
            key, F.col(layout.position).cast("long").alias("turn"),
            F.coalesce(F.col(layout.role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(layout.text).cast("string"), F.lit("")).alias("text"),
        )
    return records.select(key, F.posexplode(_turns(layout, F.col)).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text"
    )


def json_fingerprint(json: Column) -> Column:
    """:func:`fingerprint` of the record in a JSON text, from its keys and those of its arrays' first elements."""
    keys = lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))
    arrays = sorted({m.items for m in LAYOUTS if m.items})
    within = lambda a: lambda k: F.concat(F.lit(f"{a}[]."), k)
    inner = [F.transform(keys(F.get_json_object(json, f"$.{a}[0]")), within(a)) for a in arrays]
    known = F.array_sort(F.array_intersect(F.concat(keys(json), *inner), F.array(*[F.lit(p) for p in _KNOWN])))
    return F.sha2(F.array_join(known, "\n"), 256)


def canonical_turns_of_json(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(conv_id, turn, role, text) of JSON records whose layouts differ from row to row.

    Records without a mapping, empty ones and malformed ones give no turns.
    """
    json = F.col(f"`{json_column}`").cast("string")
    choice = None
    mark = json_fingerprint(json)
    for hashed, layout in MAPPINGS.items():
        if layout.items:
            schema = f"{layout.items} array<struct<`{layout.role}` string, `{layout.text}` string>>"
        elif layout.turns:
            schema = ", ".join(f"`{p}` string" for p in layout.paths)
        else:
            continue
        record = F.from_json(json, schema)
        turns = _turns(layout, lambda p, record=record: record[p])
        choice = F.when(F.col("__mark") == hashed, turns) if choice is None else choice.when(F.col("__mark") == hashed, turns)
    return records.withColumn("__mark", mark).select(
        F.col(f"`{id_column}`").cast("long").alias("conv_id"), F.posexplode(choice).alias("turn", "t")
    ).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _rest(begin: str) -> str:
    return f"(?={re.escape(ESCAPE)}*(?:" + "|".join(re.escape(r) for r in RESERVED[begin]) + "))"


def escaped(text: Column) -> Column:
    """The text with one more backslash after the first sign of every reserved string."""
    for begin in RESERVED:
        text = F.regexp_replace(text, f"{re.escape(begin)}{_rest(begin)}", f"{begin}\\\\")
    return text


def unescaped(text: Column) -> Column:
    for begin in RESERVED:
        text = F.regexp_replace(text, f"{re.escape(begin)}{re.escape(ESCAPE)}{_rest(begin)}", begin)
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments): one row per conversation.

    ``segments`` are pieces (text, loss) whose texts in a row are ``formatted``; loss marks
    what is trained on, the assistant's texts. Turns go by number, nulls first, then role
    and text; repeated rows are repeated turns. Long conversations are put together in
    parts first, so that the rows of a hot one are not aggregated by one task alone.
    """
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    fixed = F.lit(False)

    def segments(t: Column) -> Column:
        return F.array(
            piece(F.concat(F.lit(START), escaped(t["role"]), F.lit(MESSAGE)), fixed),
            piece(escaped(t["text"]), t["role"] == TRAINED_ROLE),
            piece(F.lit(END), fixed),
        )

    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / PART_TURNS).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    ).select("conv_id", "part", F.flatten(F.transform("turns", segments)).alias("pieces"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "pieces"))).alias("parts"))
    return whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["pieces"])).alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(text, re.escape(END), -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.regexp_replace(p, "^" + re.escape(START), ""), MESSAGE, 1)).alias("role"),
        # Escaped texts hold no mark, so the last one ends the role.
        unescaped(F.substring_index(p, MESSAGE, -1)).alias("text"),
    ))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: unescaped(s["text"])), "")
