r"""Chat formatting: records of any known layout become canonical turns, and turns become marked text with a loss mask.

Layouts. A record is a variant (or JSON text). Its nested field paths, without types, make its fingerprint, a 64-bit hash;
a table of the fingerprints of the known layouts selects the mapping that says where the turns are, and a record with other
fields besides takes the first mapping all of whose paths it has. A mapping is declared, not programmed: a conversation id,
and for each turn its role (a constant or a path), its text and its place. All of this is expressions in one narrow pass.

Template. A turn is ``### role:\n`` text ``</turn>\n``. In texts every ``\`` becomes ``\\``, a ``#`` before a ``#`` becomes
``#\`` and ``</turn>`` becomes ``<\/turn>``, in roles ``:`` too, so an unescaped text can hold neither mark and reading back
takes ``\`` and one character as that character. The loss mask covers the assistant's texts as they stand in the output,
as spans of code points.

A conversation's turns are ordered by place, then role, then text. They meet by one sorted shuffle on the conversation's id
and are passed one at a time, so a conversation of any length needs the memory of one part: it is written as parts of at
most ``PART_CHARS`` characters or one turn. Its digests are sequential by nature, so one conversation is read by one task.

Defined results: a null text is empty; a null role is the empty role; a null turn comes first; turns with a null
conversation id are one conversation; repeated rows are turns each; a record that no mapping fits, a null record and JSON
that can't be read give one row of layout null and no role (``canonical_turns`` keeps it, formatting leaves it out); a
message that is null in a list is left out; columns besides the record are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1 << 22
LEARNED_ROLE = "assistant"

#: The declared layouts, first fit first: the conversation's id, the required paths and the turns. ``each`` names a list of
#: messages; a turn's role is a path or, after ``=``, a constant; optional turns (``?``) are left out where they are null.
LAYOUTS: dict[str, dict] = {
    "rows": {"id": "conv_id", "turns": [{"role": "role", "text": "text", "place": "turn"}]},
    "messages": {"id": "conv_id", "each": "messages", "role": "role", "text": "content"},
    "shares": {"id": "id", "each": "conversations", "role": "from", "text": "value"},
    "instruction": {
        "id": "id",
        "turns": [{"role": "=system", "text": "system", "optional": True}, {"role": "=user", "text": "instruction", "more": "input"}, {"role": "=assistant", "text": "output"}],
    },
    "prompt": {"id": "id", "turns": [{"role": "=system", "text": "system", "optional": True}, {"role": "=user", "text": "prompt"}, {"role": "=assistant", "text": "completion"}]},
    "question": {"id": "id", "turns": [{"role": "=user", "text": "question"}, {"role": "=assistant", "text": "answer"}]},
}
#: Other names of the roles, in layouts that have their own.
ROLES = {"shares": {"human": "user", "gpt": "assistant", "bot": "assistant"}}


def paths_of(layout: dict) -> tuple[list[str], list[str]]:
    """The paths that a layout requires, and those that it may have too."""
    if "each" in layout:
        return [layout["id"], layout["each"], *(f"{layout['each']}[].{layout[k]}" for k in ("role", "text"))], []
    need, may = [layout["id"]], []
    for turn in layout["turns"]:
        (may if turn.get("optional") else need).append(turn["text"])
        need += [turn[k] for k in ("role", "place") if k in turn and not turn[k].startswith("=")]
        may += [turn["more"]] if "more" in turn else []
    return need, may


def hashed(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.sort_array(paths), "\n"))


def _fields(value: Column) -> Column:
    """The names of an object's fields; nothing for other values. Marks of a path inside a name are escaped."""
    names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.transform(names, lambda k: F.regexp_replace(k, r"[\\.\[]", r"\\$0")), F.array().cast("array<string>"))


def field_paths(record: Column) -> Column:
    """The field paths of an object, sorted: ``a``, ``a.b`` of an object in it, ``a[].b`` of the objects of a list in it.
    Null for what is no object; deeper fields belong to no layout."""
    top = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))

    def below(e: Column) -> Column:
        items = F.coalesce(F.try_variant_get(e["value"], "$", "array<variant>"), F.array().cast("array<variant>"))
        of_items = F.array_distinct(F.flatten(F.transform(items, _fields)))
        return F.concat(F.transform(_fields(e["value"]), lambda k: F.concat(e["key"], F.lit("."), k)), F.transform(of_items, lambda k: F.concat(e["key"], F.lit("[]."), k)))

    return F.array_sort(F.concat(_fields(record), F.flatten(F.transform(top, below))))


def selected(paths: Column) -> Column:
    """The name of the mapping for a record's paths: by its fingerprint, or else the first whose paths it all has."""
    known = {}
    for name, layout in LAYOUTS.items():
        need, may = paths_of(layout)
        for n in range(1 << len(may)):
            known.setdefault(tuple(sorted(need + [m for i, m in enumerate(may) if n >> i & 1])), name)
    table = F.map_from_arrays(F.array(*(hashed(F.array(*map(F.lit, p))) for p in known)), F.array(*map(F.lit, known.values())))
    fitting = F.coalesce(
        *(F.when(F.size(F.array_except(F.array(*map(F.lit, paths_of(layout)[0])), paths)) == 0, F.lit(name)) for name, layout in LAYOUTS.items())
    )
    return F.when(paths.isNotNull(), F.coalesce(F.element_at(table, hashed(paths)), fitting))


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def _turns(record: Column, name: str) -> Column:
    """The turns of a record by its layout: array of (conv_id, place, role, text)."""
    layout = LAYOUTS[name]
    conv = F.try_variant_get(record, f"$.{layout['id']}", "bigint").alias("conv_id")
    other = ROLES.get(name, {})

    def role(c: Column) -> Column:
        found = F.coalesce(c, F.lit(""))
        return F.coalesce(*(F.when(found == k, F.lit(v)) for k, v in other.items()), found).alias("role")

    if "each" in layout:
        items = F.coalesce(F.try_variant_get(record, f"$.{layout['each']}", "array<variant>"), F.array().cast("array<variant>"))
        turns = F.transform(
            items,
            lambda m, i: F.struct(conv, i.cast("bigint").alias("place"), role(F.try_variant_get(m, f"$.{layout['role']}", "string")), _text(m, layout["text"]).alias("text"), F.is_variant_null(m).alias("skip")),
        )
    else:
        turns = F.array(
            *(
                F.struct(
                    conv,
                    (F.try_variant_get(record, f"$.{t['place']}", "bigint") if "place" in t else F.lit(i).cast("bigint")).alias("place"),
                    role(F.lit(t["role"][1:]) if t["role"].startswith("=") else F.try_variant_get(record, f"$.{t['role']}", "string")),
                    F.concat(_text(record, t["text"]), F.when(_text(record, t["more"]) != "", F.concat(F.lit("\n"), _text(record, t["more"]))).otherwise("") if "more" in t else F.lit("")).alias("text"),
                    (F.try_variant_get(record, f"$.{t['text']}", "string").isNull() if t.get("optional") else F.lit(False)).alias("skip"),
                )
                for i, t in enumerate(layout["turns"])
            )
        )
    return F.filter(turns, lambda t: ~t["skip"])


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """(layout, conv_id, place, role, text): the turns of each record, whatever its layout, or one row of nulls."""
    rows = records.select(F.col(record).alias("r"))
    if rows.schema["r"].dataType.simpleString() == "string":
        rows = rows.select(F.try_parse_json("r").alias("r"))
    rows = rows.withColumn("paths", field_paths(F.col("r"))).withColumn("layout", selected(F.col("paths")))
    turns = F.coalesce(*(F.when(F.col("layout") == name, _turns(F.col("r"), name)) for name in LAYOUTS))
    return rows.select("layout", F.explode_outer(turns).alias("t")).select("layout", "t.conv_id", "t.place", "t.role", "t.text")


# -- template ----------------------------------------------------------------------------------------------------------

END = "</turn>\n"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("##", "#\\#").replace("##", "#\\#")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def header(role: str) -> str:
    return f"### {escaped(role).replace(':', chr(92) + ':')}:\n"


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n(.*?)</turn>\n", re.S)


def read_turns(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of the turns in formatted text; the spans are those of their escaped texts."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescaped(m[1]), m.start(2), m.end(2)
        at = m.end()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


FORMATTED = "conv_id bigint, part int, text string, loss array<struct<start: int, end: int>>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    rows: list[tuple] = []
    pieces: list[str] = []
    spans: list[dict] = []
    at = held = 0
    now: tuple | None = None

    def close() -> None:
        nonlocal pieces, spans, at
        rows.append((now[0], now[1], "".join(pieces), spans))
        pieces, spans, at = [], [], 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], loss_type)],
            names=["conv_id", "part", "text", "loss"],
        )

    for conv_id, role, text in _grouped(batches):
        head, body = header(role), escaped(text)
        if now is not None and conv_id != now[0]:
            close()
            now = (conv_id, 0)
        elif now is not None and at and at + len(head) + len(body) + len(END) > PART_CHARS:
            close()
            now = (conv_id, now[1] + 1)
        now = now or (conv_id, 0)
        if len(rows) >= 1000 or held > PART_CHARS:
            yield out()
            rows, held = [], 0
        pieces += (head, body, END)
        if role == LEARNED_ROLE:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        at += len(head) + len(body) + len(END)
        held += len(head) + len(body) + len(END)
    if now is not None:
        close()
        yield out()


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, text, loss): the formatted conversations and the spans of their loss masks, from canonical turns."""
    kept = turns.where("layout IS NOT NULL AND role IS NOT NULL").select("conv_id", "place", "role", "text")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "text").select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def in_order(formatted: DataFrame) -> DataFrame:
    """Formatted conversations, as they come from a table, with the parts of a conversation one after the other."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    now: list | None = None

    def close() -> None:
        rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for conv_id, part, text, loss in _grouped(batches):
        if now is None or conv_id != now[0] or part == 0:
            if now is not None:
                close()
            if len(rows) >= 1000:
                yield out()
                rows = []
            now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for role, start, end in read_turns(text):
            now[1] += 1
            now[2].update(f"{role}\n{unescaped(text[start:end])}\n".encode())
        for span in loss:
            under = unescaped(text[span["start"] : span["end"]])
            now[3] += len(under)
            now[4].update(under.encode())
        now[5] += len(text)
    if now is not None:
        close()
        yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations (parts in order) say: their turns, and the text under the loss mask."""
    return formatted.select("conv_id", "part", "text", "loss").mapInArrow(_read, DIGEST)


ORACLE_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#') AS body,
  replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#'), ':', '\:') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
