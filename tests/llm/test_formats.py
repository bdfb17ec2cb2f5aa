"""Chat formatting and training order: exact round trips."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm import chat_format as chat
from kindred.llm import training_order as order

TEXT = st.text(alphabet=st.one_of(st.sampled_from("\\<>/turn \n"), st.characters(exclude_categories=("Cs",))), max_size=40)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=6))
def test_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize(("record", "layout", "turns"), [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": []}, "no messages", []),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "from and value", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"instruction": "i", "input": "x", "output": "o", "id": 3}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "k"}, "question and answer", [("user", "k\n\nq"), ("assistant", "a")]),
    ({"history": [["a", "b"], ["c", "d"]], "query": "q", "response": "r"}, "history", [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "q"), ("assistant", "r")]),
])
def test_layouts(record, layout, turns):
    assert chat.canonical(json.dumps(record)) == (layout, turns)


def test_unknown_layouts_have_no_output(spark):
    deep = '{"messages":' + "[" * 5000 + "]" * 5000 + "}"
    unknown = ['{"what": 1}', "not json", None, "[1]", '{"messages": ["a"]}', '{"messages": [["a"]]}', deep, '{"history": [["a", "b", "c"]], "query": "q", "response": "r"}',
               '{"history": [["a"]], "query": "q", "response": "r"}', '{"history": ["ab"], "query": "q", "response": "r"}', '{"history": [], "query": "q", "response": "r"}', '{"messages": "a"}']
    rows = [*enumerate(unknown), (99, '{"prompt": "p", "response": "r"}'), (99, '{"prompt": "p", "response": "r"}')]
    out = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    assert [(r.conv_id, r.layout, r.formatted is None) for r in out] == [(i, None, True) for i in range(len(unknown))] + [(99, "prompt and response", False)] * 2


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", r"\<turn x></turn>"), (2, 1, "assistant", None), (2, 0, None, "é"), (None, 0, "user", "no id"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "y" * 300000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digest(chat.format_records(chat.message_records(turns))).collect()}
    assert {r.conv_id: r for r in chat.digest(chat.format_records(chat.varied_records(turns))).collect()}.keys() == got.keys()
    digest = lambda said: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", "hi"), ("assistant", r"\<turn x></turn>")]) and got[1].loss_chars == 16
    assert got[2].turns_sha256 == digest([("", "é"), ("assistant", "")]) and got[2].loss_chars == 0
    assert got[3].n_turns == 2 and got[None].n_turns == 1 and got[4].loss_chars == 300000
    assert chat.digest(chat.format_records(chat.message_records(turns.limit(0)))).count() == 0


def test_layouts_of_the_query(spark):
    shapes = [["user", "assistant"], ["user", "assistant"] * 3, ["system", "user", "assistant"], ["human", "gpt"], [None], ["assistant", "user"], ["user", "user"]]
    rows = [(c, t if c % 5 else None, role, f"{c % 3}<{role}>" if t else None) for c in range(140) for t, role in enumerate(shapes[c % 7])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.varied_records(turns)
    layouts = {r.layout for r in chat.format_records(records).collect()}
    assert layouts == {"messages", "from and value", "instruction", "prompt and completion", "prompt and response", "question and answer", "history"}
    plain, varied = (sorted(map(tuple, chat.digest(chat.format_records(x)).collect())) for x in (chat.message_records(turns), records))
    assert plain == varied
    texts = {r.conv_id: chat.parse(r.formatted) for r in chat.format_records(records).collect()}
    for c in range(140):
        said = [(t if c % 5 else None, role or "", text or "") for k, t, role, text in rows if k == c]
        assert texts[c] == [(r, x) for _, r, x in (said if c % 5 else sorted(said, key=lambda s: s[1:]))]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    slots = order.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 100 or (slots != order.feistel(np.arange(n), n, key=1)).any()


def plain_ids(text):
    return [*order.encoder(order.VOCABULARY).encode_ordinary(text or ""), order.END_ID]


def test_training_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "SHARD_RANGE", 64)
    rows = [(i, f"some text number {i} " * (i % 40)) for i in range(60)] + [(None, "no id"), (7, None), (7, ""), (8, "é漢😀 " * 3000), (9, "\n" * 200000), (3, "same"), (3, "same"), (70, "long words, " * 17000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")).repartition(3)
    out = order.write_order(docs, f"file://{tmp_path}/shards")
    got = sorted(out.collect(), key=lambda r: r.number)
    assert sorted(r.slot for r in got) == list(range(len(got))) and [r.slot for r in got] != list(range(len(got)))
    read = [ids for _, ids in order.read_slots(f"{tmp_path}/shards")]
    assert len(read) == len(got) and all(len(ids) == order.SEQUENCE for ids in read)
    assert all(zlib.crc32(read[r.slot].tobytes()) == r.ids_crc32 for r in got)
    assert all((read[r.slot][r.n_tokens :] == order.END_ID).all() for r in got) and sum(r.n_tokens < order.SEQUENCE for r in got) <= 3
    found = []  # documents in the order of their ids, rebuilt from the files
    for r in got:
        ids = read[r.slot][: r.n_tokens].tolist()
        for k, (doc, a, b) in enumerate(zip(r.doc_ids, r.starts, [*r.starts[1:], len(ids)])):
            if k == 0 and r.skipped:
                assert found[-1][0] == doc and len(found[-1][1]) == r.skipped
                found[-1][1].extend(ids[a:b])
            else:
                found.append((doc, ids[a:b]))
    assert sorted(found, key=repr) == sorted(((d, plain_ids(t)) for d, t in rows), key=repr)
    assert order.write_order(docs.limit(0), f"file://{tmp_path}/none").count() == 0 and list(order.read_slots(f"{tmp_path}/none")) == []


def test_shard_files_resume(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "SHARD_RANGE", 16)
    docs = spark.createDataFrame([(i, f"some text number {i} " * (20 * i)) for i in range(60)], "doc_id long, text string").repartition(3)
    rows = order.write_order(docs, f"{tmp_path}/shards").collect()
    counts = {r.shard: sum(x.shard == r.shard for x in rows) for r in rows}
    assert len(rows) > 30 and len(counts) > 5
    assert {p.name: p.stat().st_size for p in (tmp_path / "shards").iterdir() if p.suffix == ".bin"} == {f"shard-{k}.bin": n * order.STRIDE for k, n in counts.items()}
    want = [ids.tobytes() for _, ids in order.read_slots(f"{tmp_path}/shards")]
    for r in rows:
        with open(tmp_path / "shards" / f"shard-{r.shard}.bin", "rb") as f:
            f.seek(r.offset)
            assert f.read(order.STRIDE) == want[r.slot]
    for first in (0, 16, 21, len(rows) - 1, len(rows)):
        assert [(s, i.tobytes()) for s, i in order.read_slots(f"{tmp_path}/shards", first)] == list(enumerate(want))[first:]


@pytest.mark.parametrize("text", ["wonderful  words\n\n of it's length " * 5000, "a" * 65530 + "bcdefgh ij" * 9, "x" + " \n" * 40000 + "y'll " * 20000, "é漢😀" * 30000])
def test_pieces_keep_the_tokens(text):
    assert order.ids_of(text).tolist() == [*order.encoder(order.VOCABULARY).encode_ordinary(text), order.END_ID]
