r"""Chat formatting by schema fingerprints.

A record is a JSON object. Its fingerprint is the hash of its sorted nested field paths (``messages[].role``);
fingerprints select a declarative mapping that turns the record's layout (messages, prompt and
response, instruction with input, question and answer, history pairs) into canonical turns. A new
layout is one more entry of ``LAYOUTS``, not code.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed per turn. In roles and texts ``\``, ``<`` and ``>`` get a
backslash before them, so no text can hold a control string, and ``parse`` gives every text back exactly. The
loss mask is a list of [start, end) code-point spans of the formatted text, one per assistant turn.

Defined cases: null texts and roles are empty; turns without a number come last, and turns with equal numbers are
ordered by role and text; a record of an unknown layout, one that is not a JSON object, one nested too deeply to
read and one whose turns are not objects (or whose history is not pairs) has a null layout and null output: no
text is dropped silently; a conversation is one output value, so its turns meet in one task, as they must; an
empty table gives only what is added to it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: What speakers are called where turns say who they are "from".
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: name: (required paths, optional paths, turns). A turn is (role, [paths joined by blank lines]) or a list rule.
LAYOUTS = {
    "messages": (["messages[].content", "messages[].role"], [], {"list": "messages", "role": "role", "text": "content"}),
    "no messages": (["messages[]"], [], {"list": "messages", "role": "role", "text": "content"}),
    "from and value": (["conversations[].from", "conversations[].value"], ["system"], {"before": [("system", ["system"])], "list": "conversations", "role": "from", "text": "value", "roles": ROLES}),
    "instruction": (["instruction", "output"], ["input", "system"], {"turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    "prompt and completion": (["prompt", "completion"], ["system"], {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]}),
    "prompt and response": (["prompt", "response"], ["system"], {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]}),
    "question and answer": (["question", "answer"], ["context"], {"turns": [("user", ["context", "question"]), ("assistant", ["answer"])]}),
    "history": (["history[][]", "query", "response"], ["system"], {"before": [("system", ["system"])], "pairs": "history", "turns": [("user", ["query"]), ("assistant", ["response"])]}),
}
#: Paths that carry no turns and do not count for the fingerprint.
IGNORED = {"conv_id", "id", "source", "metadata"}


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items() if at or k not in IGNORED))
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at} if at else set()


def fingerprint(paths: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


def _registry() -> dict[int, tuple[str, dict]]:
    found = {}
    for name, (required, optional, rule) in LAYOUTS.items():
        for mask in range(1 << len(optional)):
            found[fingerprint({*required, *(o for i, o in enumerate(optional) if mask >> i & 1)})] = (name, rule)
    return found


REGISTRY = _registry()


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _fixed(record: dict, turns: list) -> list[tuple[str, str]]:
    """Turns from fields; an optional field that is absent adds nothing, a turn without any of its fields is left out."""
    return [(role, "\n\n".join(_text(record[p]) for p in paths if p in record)) for role, paths in turns if any(p in record for p in paths)]


def canonical(record: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """(layout, turns) of a JSON record, or None if its fingerprint is unknown."""
    try:
        value = json.loads(record or "")
        found = REGISTRY.get(fingerprint(field_paths(value))) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None
    if found is None:
        return None
    name, rule = found
    entries, pairs = (value[rule[k]] if k in rule else [] for k in ("list", "pairs"))
    if not all(isinstance(x, dict) for x in entries) or not all(isinstance(x, list) and len(x) == 2 for x in pairs):
        return None
    turns = _fixed(value, rule.get("before", []))
    for x in entries:
        role = _text(x.get(rule["role"]))
        turns.append((rule.get("roles", {}).get(role, role), _text(x.get(rule["text"]))))
    for asked, answered in pairs:
        turns += [("user", _text(asked)), ("assistant", _text(answered))]
    return name, turns + _fixed(value, rule.get("turns", []))


_SPECIAL, _ESCAPED = re.compile(r"[\\<>]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """(formatted text, loss spans)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role)}>", escape(text)
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted text; anything but turns is an error."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_records(records: DataFrame) -> DataFrame:
    """``conv_id, layout, formatted, loss_spans`` of ``records`` (``conv_id``, ``record``: a JSON object)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, texts, masks = [], [], []
            for record in batch.column(1):
                found = canonical(record.as_py())
                text, spans = render(found[1]) if found else (None, None)
                layouts.append(found[0] if found else None)
                texts.append(text)
                masks.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(layouts, type=pa.string()), pa.array(texts, type=pa.string()), pa.array(masks, type=pa.list_(pa.list_(pa.int64())))],
                names=["conv_id", "layout", "formatted", "loss_spans"],
            )

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(convert, "conv_id long, layout string, formatted string, loss_spans array<array<long>>")


def message_records(turns: DataFrame) -> DataFrame:
    """``conv_id, record``: one JSON record in the messages layout per ``conv_id`` of a table of turns (``conv_id, turn, role, text``)."""
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return _gathered(turns).select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def _gathered(turns: DataFrame) -> DataFrame:
    """``conv_id, m``: the turns of a conversation in order."""
    one = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))


def varied_records(turns: DataFrame) -> DataFrame:
    """``conv_id, record``: the conversations as records of the layouts that can hold them, one of these by the id's checksum.

    A question and its answer may be a prompt with a response or a completion, an instruction with its output or a question with
    its answer; questions and answers in turn may be a history; speakers that have another name for it may be a list of who a turn
    is from; everything may be messages.
    """
    m = F.col("m")
    rows = _gathered(turns).select("conv_id", "m", F.transform(m, lambda x: x["role"]).alias("roles"), F.coalesce(F.crc32(F.col("conv_id").cast("string")), F.lit(0)).alias("k"))
    n, roles, k = F.size("roles"), F.col("roles"), F.col("k")
    in_turn = (n > 0) & (n % 2 == 0) & F.forall(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(roles, i) == F.when(i % 2 == 0, "user").otherwise("assistant"))
    said = lambda i: F.get(m, i if isinstance(i, Column) else F.lit(i))["content"]
    two = lambda x, y: F.to_json(F.struct(said(0).alias(x), said(1).alias(y)))
    earlier = F.transform(F.sequence(F.lit(0), F.greatest(n / 2 - 2, F.lit(0)).cast("int")), lambda i: F.array(said(2 * i), said(2 * i + 1)))
    history = F.to_json(F.struct(earlier.alias("history"), said(n - 2).alias("query"), said(n - 1).alias("response")))
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    named = F.transform(m, lambda x: F.struct(other(x["role"]).alias("from"), x["content"].alias("value")))
    plain = (n > 0) & F.forall(roles, lambda r: ~r.isin(*ROLES))
    messages = F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    record = F.when(in_turn & (n == 2) & (k % 6 < 4), F.when(k % 6 == 0, two("prompt", "response")).when(k % 6 == 1, two("prompt", "completion")).when(k % 6 == 2, two("instruction", "output")).otherwise(two("question", "answer")))
    record = record.when(in_turn & (n > 2) & (k % 3 == 0), history).when(plain & (k % 3 == 1), F.to_json(F.struct(named.alias("conversations"))))
    return rows.select("conv_id", record.otherwise(F.to_json(F.struct(messages.alias("messages")))).alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted texts and the loss spans."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                hashed = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                out.append((len(turns), hashed, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([o[i] for o in out], type=k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kept = formatted.filter("formatted IS NOT NULL").select("conv_id", "formatted", "loss_spans")
    return kept.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ADDED = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"),
    )
    return digest(format_records(varied_records(rows.unionByName(added))))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') AS r2, replace(replace(replace(text, '\', '\\'), '<', '\<'), '>', '\>') AS t2 FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
  sum(length(r2) + length(t2) + length('<turn >' || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
