"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of its nested field paths. It selects a
declarative mapping that turns prompt / completion, instruction and message
layouts into canonical turns (role, text). Conversations are then written with
a template that marks turns and escapes control strings reversibly, with the
loss mask as spans of the output.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.tables import small_batches, unused

TURNS = "array<struct<role:string,text:string>>"

#: Field paths of each layout, and where its turns are: (role, path of the text), or for lists of
#: messages (path of the list, field of the role, field of the text). `roles` renames roles.
LAYOUTS = [
    {"paths": ["messages[].content", "messages[].role"], "each": ("messages", "role", "content")},
    {
        "paths": ["conversations[].from", "conversations[].value"],
        "each": ("conversations", "from", "value"),
        "roles": {"human": "user", "gpt": "assistant"},
    },
    {"paths": ["completion", "prompt"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    {"paths": ["question", "answer"], "turns": [("user", "question"), ("assistant", "answer")]},
    {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    {
        "paths": ["input", "instruction", "output"],
        "turns": [("user", "instruction", "input"), ("assistant", "output")],
    },
    {
        "paths": ["instruction", "output", "system"],
        "turns": [("system", "system"), ("user", "instruction"), ("assistant", "output")],
    },
    {
        "paths": ["input", "instruction", "output", "system"],
        "turns": [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")],
    },
    {
        "paths": ["completion", "prompt", "system"],
        "turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")],
    },
    {
        "paths": ["prompt", "response", "system"],
        "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")],
    },
    {
        "paths": ["answer", "context", "question"],
        "turns": [("user", "context", "question"), ("assistant", "answer")],
    },
    {
        "paths": ["messages[].content", "messages[].role", "system"],
        "lead": ("system", "system"),
        "each": ("messages", "role", "content"),
    },
    {"paths": ["messages"], "each": ("messages", "role", "content")},
    {"paths": ["conversations"], "each": ("conversations", "from", "value")},
    {"paths": ["role", "text", "turn"], "one": ("role", "text")},
]

_KNOWN = {path for layout in LAYOUTS for path in layout["paths"]}


def field_paths(value, prefix: str = "") -> Iterator[str]:
    """Paths of the leaves of a nested value; items of a list share one path. A null list or object is a leaf."""
    if isinstance(value, dict) and value:
        for name, inner in value.items():
            yield from field_paths(inner, f"{prefix}.{name}" if prefix else name)
    elif isinstance(value, list) and value:
        for inner in value:
            yield from field_paths(inner, prefix + "[]")
    else:
        yield prefix


def fingerprint(paths) -> str:
    """Hash of the field paths that any layout knows, in order; other fields of a record don't count."""
    return hashlib.sha256("\n".join(sorted(_KNOWN.intersection(paths))).encode()).hexdigest()


MAPPINGS = {fingerprint(layout["paths"]): layout for layout in LAYOUTS}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict) -> list[dict] | None:
    """Turns of one record; None if no layout has its fingerprint."""
    layout = MAPPINGS.get(fingerprint(set(field_paths(record))))
    if layout is None:
        return None
    if "each" in layout:
        items, role, text = layout["each"]
        names = layout.get("roles", {})
        if record[items] is not None and not isinstance(record[items], list):
            return None
        lead = [(layout["lead"][0], _text(record[layout["lead"][1]]))] if "lead" in layout else []
        found = [(_text(m.get(role)), _text(m.get(text))) for m in record[items] or () if isinstance(m, dict)]
        return [{"role": names.get(r, r), "text": t} for r, t in lead + found]
    if "one" in layout:
        role, text = layout["one"]
        return [{"role": _text(record[role]), "text": _text(record[text])}]
    return [
        {"role": role, "text": "\n\n".join(t for name in names if (t := _text(record[name])) or len(names) == 1)}
        for role, *names in layout["turns"]
    ]


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        last = batch.num_columns - 1
        turns = []
        for raw in batch.column(last).to_pylist():
            try:
                record = json.loads(raw) if raw is not None else None
            except ValueError:
                record = None
            turns.append(canonical_turns(record) if isinstance(record, dict) else None)
        columns = [batch.column(k) for k in range(last)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(turns, kind)], [*batch.schema.names[:last], "turns"])


def to_turns(records: DataFrame, json_col: str = "record") -> DataFrame:
    """`records` with `turns` in place of the JSON column.

    Null, malformed and unknown records have null turns, so none is lost from
    sight; a null text is empty.
    """
    rows = records.select(*[c for c in records.columns if c not in (json_col, "turns")], F.col(json_col).cast("string").alias(unused(records, "raw")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_turn_rows, ", ".join([*fields, f"turns {TURNS}"]))


# Template: `### role: text </turn>` and a line end for each turn. A backslash
# before a character in a role or text means the character itself; control strings
# are broken up by one, so that they stand nowhere in the output but in the template.
_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Marks backslashes and breaks control strings up; unescape() gives the text back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\/turn>" if m[0][0] == "<" else "#" + "\\#" * (len(m[0]) - 1), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_turns(turns: list[dict]) -> tuple[str, list[dict]]:
    """The formatted conversation, and the spans of its assistant texts (code points, as escaped)."""
    out, spans, at = [], [], 0
    for turn in turns:
        head = "### " + escape(turn["role"]).replace(":", "\\:") + ": "
        body = escape(turn["text"])
        if turn["role"] == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out.append(f"{head}{body} </turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            done = [write_turns(turns or []) for turns in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], kind)],
                ["conv_id", "formatted", "loss_spans"],
            )


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, record as JSON).

    The turns of a conversation stand in the order of `turn`, then of role and
    text (nulls first); repeated rows are repeated turns. Records that no layout
    fits add no turns (unmapped_records() returns them); a conversation without any turn
    is empty, not missing. A conversation is one row of the output, and so is
    brought together in one task; a row without conv_id is a conversation of its
    own. Very long texts are formatted as a whole; an empty table gives an empty result.
    """
    small_batches(rows.sparkSession)
    turns = to_turns(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "record"))
    placed = turns.select("conv_id", "turn", F.posexplode_outer("turns").alias("place", "t"))
    kept = F.when(F.col("t").isNotNull(), F.struct("turn", "place", "t.role", "t.text"))
    whole = placed.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("all"))
    alone = turns.filter("conv_id IS NULL").select(
        "conv_id", F.expr("transform(coalesce(turns, array()), (t, k) -> struct(turn, k AS place, t.role AS role, t.text AS text))").alias("all")
    )
    whole = whole.unionByName(alone)
    ordered = whole.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return ordered.mapInArrow(
        _format_rows, "conv_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
    )


def unmapped_records(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, record) whose record is null, malformed or of no known layout; the others are formatted."""
    marked = to_turns(rows.select("conv_id", "turn", "record", F.col("record").alias("kept_record")), "kept_record")
    return marked.filter("turns IS NULL").select("conv_id", "turn", "record")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns = read_turns(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of format_conversations()'s result, read back from the formatted text."""
    return formatted.mapInArrow(
        _digest_rows,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def table_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, record): rows (conv_id, turn, role, text) as JSON records, one for each turn."""
    fields = [F.col(c).cast("string").alias(c) for c in ("role", "text")]
    record = F.to_json(F.struct("turn", *fields), {"ignoreNullFields": "false"})
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", record.alias("record"))
