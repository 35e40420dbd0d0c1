"""Chat formatting: schema fingerprints select declarative mappings from many record layouts to canonical turns.

A layout names the field paths it needs and where each turn's role and text stand. The fingerprint of a schema under a
layout is a hash of those nested paths that it holds; the first layout whose own fingerprint that is, is taken. JSON records
of mixed layouts go through the same choice record by record.

The template writes a turn as <|turn|>role, line end, text, <|end|>, line end. Control strings inside roles and texts
are escaped reversibly (a backslash is \\e, the bracket that opens a control string \\l or \\b), so no text can forge a
mark. The loss mask is a list of (start, stop) character ranges: the text of each assistant turn.

Defined results: null text or role is empty; turns with equal number are ordered by role and text, null numbers first;
repeated rows are turns of their own; each row with a null conversation id is a conversation of its own; extra fields are
ignored. A conversation is one row of the output, so its turns must fit a task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

TURN, END = "<|turn|>", "<|end|>\n"
# fixed values: control strings of common templates and what stands for them inside a text
ESCAPES = [
    ("\\", "\\e"), ("<|", "\\l|"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("<<SYS>>", "\\l<SYS>>"), ("<</SYS>>", "\\l</SYS>>"),
    ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"),
]
UNESCAPES = [("\\l", "<"), ("\\b", "["), ("\\w", "\n"), ("\\e", "\\")]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """each: path of an array of turns with (role, text) fields, or None; turns: (role, text path, may be missing)."""

    name: str
    each: str | None = None
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, str, bool], ...] = ()

    @property
    def paths(self) -> frozenset[str]:
        if self.each:
            return frozenset({f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"})
        if self.role:
            return frozenset({"conv_id", "turn", self.role, self.text})
        return frozenset(p for _, p, optional in self.turns if not optional)


LAYOUTS = (
    Layout("turn rows", role="role", text="text"),
    Layout("messages", "messages", "role", "content"),
    Layout("conversations", "conversations", "from", "value"),
    Layout("dialog", "dialog", "speaker", "text"),
    Layout("instruction", turns=(("system", "system", True), ("user", "instruction", False), ("user", "input", True), ("assistant", "output", False))),
    Layout("prompt and completion", turns=(("system", "system", True), ("user", "prompt", False), ("assistant", "completion", False))),
    Layout("prompt and response", turns=(("system", "system", True), ("user", "prompt", False), ("assistant", "response", False))),
    Layout("question and answer", turns=(("user", "question", False), ("assistant", "answer", False))),
    Layout("nested data", "data.messages", "role", "content"),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


PRINTS = {layout: fingerprint(layout.paths) for layout in LAYOUTS}


def choose(paths: set[str]) -> Layout:
    """The first layout whose fingerprint the held paths have; ValueError if none."""
    for layout, own in PRINTS.items():
        if fingerprint(paths & layout.paths) == own:
            return layout
    raise ValueError(f"no layout for the fields {sorted(paths)}")


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {at}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def json_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(json_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(json_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def _role(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for k, v in ROLES.items():
        out = F.when(F.lower(c) == k, F.lit(v)).otherwise(out)
    return out


def canonical_turns(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and turns: array of (role, text) in order, from a frame of any known layout."""
    layout = choose(schema_paths(records.schema))
    text = lambda c: F.coalesce(c, F.lit(""))
    if layout.name == "turn rows":
        turn = F.struct("turn", text(F.col("role")).alias("role"), text(F.col("text")).alias("text"))  # roles as they are
        lone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
        rows = records.groupBy(key, lone.alias(fresh(records, "lone"))).agg(F.sort_array(F.collect_list(turn)).alias("t"))
        return rows.select(key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    if layout.each:
        each = lambda x: F.struct(_role(x[layout.role]).alias("role"), text(x[layout.text]).alias("text"))
        turns = F.coalesce(F.transform(layout.each, each), F.array().cast("array<struct<role:string,text:string>>"))
        return records.select(key, turns.alias("turns"))
    held = schema_paths(records.schema)
    made = [F.struct(F.lit(r).alias("role"), (F.col(p) if o else text(F.col(p))).alias("text")) for r, p, o in layout.turns if p in held]
    return records.select(key, F.filter(F.array(*made), lambda x: x["text"].isNotNull()).alias("turns"))


def record_turns(record: str | None) -> list[dict[str, str]]:
    """Canonical turns of one JSON record; null, or what is no record of a known layout, has none."""
    try:
        value = json.loads(record or "null")
        layout = choose(json_paths(value))
        out = _turns(value, layout)
        "".join(x for t in out for x in t.values()).encode()
    except (ValueError, RecursionError):  # no JSON, no known layout, nested too deep, or half a surrogate pair
        return []
    return out


def _turns(value, layout) -> list[dict[str, str]]:
    if layout.each:
        at = value
        for k in layout.each.split("."):
            at = at[k]
        pairs = [(x.get(layout.role), x.get(layout.text)) for x in at if isinstance(x, dict)]
    else:
        pairs = [(r, value.get(p)) for r, p, o in layout.turns if not o or value.get(p)] if layout.turns else [(value.get("role"), value.get("text"))]
    return [{"role": ROLES.get(str(r or "").lower(), str(r or "")), "text": str(t if t is not None else "")} for r, t in pairs]


def json_turns(records: DataFrame, key: str, column: str) -> DataFrame:
    """As canonical_turns, for a column of JSON records whose layouts differ from row to row."""
    schema = T.StructType([records.schema[key], T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([record_turns(x) for x in b.column(1).to_pylist()], kind)], [key, "turns"])

    return records.select(key, column).mapInArrow(run, schema)


def _escaped(c: Column, role: bool = False) -> Column:
    for a, b in [*ESCAPES, *[("\n", "\\w")] * role]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted text, loss: array of (start, stop) character ranges of the assistant texts."""
    marked = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), _escaped(t["role"], True), F.lit("\n")).alias("head"), _escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("on")))
    m = turns.select(key, marked.alias("m"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("loss"))

    def step(a, x):
        start = a["at"] + F.length(x["head"])
        span = F.struct(start.alias("start"), (start + F.length(x["body"])).alias("stop"))
        return F.struct((a["at"] + size(x)).alias("at"), F.when(x["on"], F.concat(a["loss"], F.array(span))).otherwise(a["loss"]).alias("loss"))

    whole = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    return m.select(key, whole.alias("formatted"), F.aggregate("m", zero, step)["loss"].alias("loss"))


def unescaped(s: str) -> str:
    for a, b in UNESCAPES:
        s = s.replace(a, b)
    return s


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from a formatted text alone."""
    out = []
    for part in formatted.split(TURN)[1:]:
        head, _, body = part.partition("\n")
        out.append((unescaped(head), unescaped(body.removesuffix(END))))
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            turns = hashlib.sha256()
            said = read_turns(text)
            for role, t in said:
                turns.update(f"{role}\n{t}\n".encode())
            learnt = "".join(unescaped(text[x["start"] : x["stop"]]) for x in loss)
            rows.append((len(said), turns.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op3_chat(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    out = format_turns(canonical_turns(rows))
    return out.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escaped(c: str) -> str:
    for a, b in ESCAPES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


ORACLE = f"""
WITH t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + 1 + len(END)} + length(replace({_sql_escaped("role")}, chr(10), '\\w')) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, lone
"""
