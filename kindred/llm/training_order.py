"""Token ids in training order.

Texts become token ids (a public vocabulary whose path is a parameter), each closed by an end token. The
documents of a part of the scan are packed: their ids follow one another and are cut into sequences of
``SEQUENCE`` ids, so only a part's last sequence is padded.

Order: no token covers less than a byte, so a part of the scan has room for the sequences that its bytes
could make at most, and the rooms of all parts number [0, M). A keyed Feistel permutation with cycle walking
of [0, M) gives each sequence's number its place in the training order, a bijection that needs no sort and no
table; nothing has to be counted or written before. A shard is a range of ``SHARD_RANGE`` permuted numbers: one
task sorts it and writes its sequences as one file of fixed stride, under another name until it is whole. The
files' counts, the manifest, make the order dense: a sequence's slot is its place among all sequences, and slot s
lies in the last shard that begins at or before it, (s - first) x stride bytes from the start, so ``read_slots``
reads on from any slot with one seek.

Scale: texts are tokenised once and shuffled once, as ids, from the scan straight to the shards' writers; ranges
of shards are dealt to at most as many tasks as the session has shuffle partitions. On the driver there is one
number per part of the scan and per shard. ``docs`` is a scan or a written table: its parts must be the same when
it is read twice (the second reading raises an error if a part outgrows its room).

Defined cases: null text has no tokens but the end; an empty text likewise; repeated rows are packed each;
texts are tokenised in pieces of about ``PIECE`` characters, cut where the tokenizer's pattern splits anyway
(a run without such a place stays whole); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256
SEQUENCE = 512
STRIDE = 2 * SEQUENCE  #: bytes: ids are 16 bits, little-endian, padded with END_ID
SHARD_RANGE = 1 << 18  #: permuted numbers of a shard; about a quarter of them are sequences
PIECE = 1 << 16
MARGIN = 16  #: characters before a piece's end whose matches the text behind it may change
ROUNDS = 4
KEY = 20240817

_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that have the same tokens apart: cut behind a match of the pattern that ends in no white space, since white space looks ahead."""
    import public_tokenizers
    import regex

    at = 0
    while at < len(text):
        size, cut = PIECE, 0
        while not cut:
            part = text[at : at + size]
            if at + size >= len(text):
                cut = len(part)
            else:
                ends = (m.end() for m in regex.finditer(public_tokenizers.PATTERN, part))
                cut = max((e for e in ends if e <= size - MARGIN and not part[e - 1].isspace()), default=0)
            size *= 2
        yield text[at : at + cut]
        at += cut


def ids_of(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    encode = encoder(path).encode_ordinary
    parts = [encode(p) for p in pieces(text or "")]
    return np.array([i for p in parts for i in p] + [END_ID], dtype="<u2")


def rooms(docs: DataFrame) -> tuple[dict[int, tuple[int, int]], int]:
    """({part of the scan: (its first number, how many it may use)}, M)."""
    most = docs.select(F.spark_partition_id().alias("part"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("ids")).groupBy("part").agg(F.sum("ids").alias("ids"))
    found, first = {}, 0
    for r in sorted(most.collect()):  # one row per part
        room = -(-r.ids // SEQUENCE)
        found[r.part] = (first, room)
        first += room
    return found, first


def sequences(docs: DataFrame, path: str = VOCABULARY, key: int = KEY) -> tuple[DataFrame, int]:
    """(``number, place, n_tokens, doc_ids, starts, skipped, ids``: one row per sequence, ids unpadded; M). ``place`` is the permuted number.

    ``doc_ids`` are the documents in it, ``starts`` the places where their ids begin; the first one may have begun before,
    and ``skipped`` of its ids lie in earlier sequences.
    """
    room, size = rooms(docs)

    def rows(docs: pa.Array, starts: np.ndarray, ids: np.ndarray, number: int) -> pa.RecordBatch:
        """All sequences of a stream of ids; starts: where each document's begin, below 0 if it began before the stream."""
        edges = np.arange(0, len(ids), SEQUENCE)
        ends = np.minimum(edges + SEQUENCE, len(ids))
        first, last = np.searchsorted(starts, edges, side="right") - 1, np.searchsorted(starts, ends, side="left")
        many = last - first
        offsets = pa.array(np.cumsum([0, *many]), type=pa.int32())
        of = np.repeat(np.arange(len(edges)), many)
        doc = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]
        numbers = np.arange(number, number + len(edges))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(numbers), pa.array(feistel(numbers, size, key)), pa.array(ends - edges, type=pa.int32()), pa.ListArray.from_arrays(offsets, docs.take(pa.array(doc, type=pa.int64()))),
                pa.ListArray.from_arrays(offsets, pa.array(np.maximum(starts[doc] - edges[of], 0), type=pa.int32())), pa.array(np.maximum(edges - starts[first], 0), type=pa.int64()),
                pa.array([ids[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], type=pa.binary()),
            ],
            names=["number", "place", "n_tokens", "doc_ids", "starts", "skipped", "ids"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, end = 0, -1
        docs, starts, ids = pa.array([], type=pa.int64()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u2")  # of the sequence that is not full yet
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                if end < 0:
                    first, some = room[batch.column(2)[0].as_py()]
                    number, end = first, first + some
                new = [ids_of(t.as_py(), path) for t in batch.column(1)]
                begin = len(ids) + np.cumsum([0, *map(len, new)])[:-1]
                docs, starts, ids = pa.concat_arrays([docs, batch.column(0)]), np.concatenate([starts, begin]), np.concatenate([ids, *new])
                full = len(ids) // SEQUENCE * SEQUENCE
                if not full:
                    continue
                if number + full // SEQUENCE > end:
                    raise ValueError("a part of the scan is not the one that was measured: write the documents first")
                yield rows(docs, starts, ids[:full], number)
                number += full // SEQUENCE
                left = int(np.searchsorted(starts, full, side="right")) - 1 if full < len(ids) else len(starts)
                docs, starts, ids = docs.slice(left), starts[left:] - full, ids[full:]
        if len(ids):
            if number >= end:
                raise ValueError("a part of the scan is not the one that was measured: write the documents first")
            yield rows(docs, starts, ids, number)

    read = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    return read.mapInArrow(cut, "number long, place long, n_tokens int, doc_ids array<long>, starts array<int>, skipped long, ids binary"), size


def feistel(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of [0, n): balanced Feistel rounds on the least even number of bits, repeated while the value is n or more."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(key).integers(0, 1 << 63, size=ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            y = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            y ^= y >> np.uint64(29)
            y *= np.uint64(0xBF58476D1CE4E5B9)
            y ^= y >> np.uint64(32)
            left, right = right, left ^ (y & mask)
        return (left << shift) | right

    x = once(numbers.astype(np.uint64))
    while (out := np.flatnonzero(x >= np.uint64(n))).size:
        x[out] = once(x[out])
    return x.astype(np.int64)


def _file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def write_order(docs: DataFrame, folder: str, path: str = VOCABULARY, key: int = KEY) -> DataFrame:
    """Writes the shards and the manifest to ``folder``; gives ``number, slot, shard, offset, n_tokens, doc_ids, starts, skipped, ids_crc32`` per sequence.

    ``number`` grows along the scan, ``slot`` along the training order. A task that runs twice writes the same bytes and renames
    them over the first ones.
    """
    rows, size = sequences(docs, path, key)
    shards = max(1, -(-size // SHARD_RANGE))
    tasks = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.floor(F.col("place") / SHARD_RANGE)
    sorted_rows = rows.repartitionById(tasks, F.floor(shard * tasks / shards).cast("int")).sortWithinPartitions("place")
    padding = END_ID.to_bytes(2, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        files.create_dir(root)
        now, out, temp, row = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                files.move(temp, f"{root}/shard-{now}.bin")

        for batch in batches:
            shards = batch.column("place").to_numpy() // SHARD_RANGE
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            at, sums = np.zeros(len(shards), dtype=np.int64), np.zeros(len(shards), dtype=np.int64)
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shards[a] != now:
                    close()
                    now, temp, row = int(shards[a]), f"{root}/.{uuid.uuid4().hex}", 0
                    out = files.open_output_stream(temp)
                full = [x + padding * (SEQUENCE - len(x) // 2) for x in batch.column("ids").slice(a, b - a).to_pylist()]
                out.write(b"".join(full))
                at[a:b], row = np.arange(row, row + b - a), row + b - a
                sums[a:b] = [zlib.crc32(x) for x in full]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("number", "n_tokens", "doc_ids", "starts", "skipped")), pa.array(shards), pa.array(at), pa.array(sums)],
                names=["number", "n_tokens", "doc_ids", "starts", "skipped", "shard", "at", "ids_crc32"],
            )
        close()

    schema = "number long, n_tokens int, doc_ids array<long>, starts array<int>, skipped long, shard long, at long, ids_crc32 long"
    written = materialise(sorted_rows.mapInArrow(write, schema))
    counts = {r.shard: r["count"] for r in written.groupBy("shard").count().collect()}  # one number per shard
    first, at = [], 0
    for k in range(shards):
        first.append(at)
        at += counts.get(k, 0)
    files, root = _file_system(folder)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/.manifest") as f:
        f.write(json.dumps({"stride": STRIDE, "first_slots": first, "slots": at}).encode())
    files.move(f"{root}/.manifest", f"{root}/manifest.json")
    starts = docs.sparkSession.createDataFrame(pa.table({"shard": pa.array(range(shards), type=pa.int64()), "first": pa.array(first, type=pa.int64())}))
    return written.join(starts, "shard").select(
        "number", (F.col("first") + F.col("at")).alias("slot"), "shard", (F.col("at") * STRIDE).alias("offset"), "n_tokens", "doc_ids", "starts", "skipped", "ids_crc32"
    )


def read_slots(folder: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, padded ids) from ``slot`` on to the end, shard after shard."""
    files, root = _file_system(folder)
    with files.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    first = [*manifest["first_slots"], manifest["slots"]]
    while slot < manifest["slots"]:
        shard = bisect.bisect_right(first, slot) - 1
        with files.open_input_file(f"{root}/shard-{shard}.bin") as f:
            f.seek((slot - first[shard]) * manifest["stride"])
            while block := f.read(manifest["stride"]):
                yield slot, np.frombuffer(block, "<u2")
                slot += 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return write_order(docs, f"{shared_folder(spark)}/kindred-shards-{uuid.uuid4().hex}")
