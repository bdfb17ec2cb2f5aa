r"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z. A phrase is 13
consecutive words of a benchmark item, or a whole item of fewer words.

Index: one pass over the texts stores postings (term, document row, position) of the benchmark's
vocabulary. A position is stored only if it lies in a run of consecutive vocabulary words long
enough to hold a phrase, since no phrase can cover another one; this prunes no match. The posting
table is written once, and its counts give each term's rarity.

Search: each phrase orders its terms from the rarest to the most common. The rarest term's postings,
shifted by its offset, are the candidate starts; the remaining (term, offset) pairs of a candidate
are looked up in the postings of that row, and a start whose every offset is found is an exact
match. ``proximity`` answers the looser question: rows that hold all terms of a phrase, in any order,
within a window of given width. ``near`` answers it for all phrases, over an index that keeps every
posting of the vocabulary: a row's postings lie in one array, so its rarest terms' places are looked
around within the row; the phrases and their rarity are broadcast.

Scale: the vocabulary of the benchmark is broadcast. Its size is checked: the distinct phrases are dealt into as
many slices as it takes for each to have at most ``MAX_TERMS`` words and ``MAX_PHRASES`` phrases, each slice is
searched over an index of its own, and the matches of all are put together before rows are judged. A passage that
very many documents share makes one hot rarest term: its postings join the phrase table, a join that
adaptive execution splits or broadcasts; the second join is keyed by (row, position) and never hot.

Defined cases: null text and text without words have no words and are clean; an item without words
has no phrase; items count by their id, those without one as one item with an empty id; repeated rows are judged one by one; an empty
benchmark leaves all documents clean; empty documents give an empty result. Extra columns pass
through ``remove`` untouched: internal columns carry the prefix ``_con_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise

PHRASE = 13
MIN_SHARE = 20  #: contaminated if MIN_SHARE * n_hit >= n_words
MAX_TERMS = 2_000_000
MAX_PHRASES = 2_000_000
WIDTH = 2 * PHRASE  #: words of a window that holds all terms of a phrase

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; the table turns A-Z into a-z and every separator into a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def phrases(benchmark: DataFrame) -> DataFrame:
    """``item_id, phrase, length, off, term`` of every phrase; ``phrase`` numbers equal phrases alike (a digest)."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, SEPARATORS), lambda w: w != "")
    items = benchmark.select("item_id", words.alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - PHRASE + 1, F.lit(1))))
    windows = items.select("item_id", "w", start.alias("s")).select("item_id", F.slice("w", F.col("s"), PHRASE).alias("w"))
    return windows.select("item_id", F.sha2(F.array_join("w", " "), 256).alias("phrase"), F.size("w").alias("length"), F.posexplode("w").alias("off", "term"))


def _runs(inside: np.ndarray, least: int) -> np.ndarray:
    """Marks the positions in runs of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    marks = np.zeros(len(inside) + 1, dtype=np.int32)
    np.add.at(marks, begin[long], 1)
    np.add.at(marks, end[long], -1)
    return np.cumsum(marks[:-1]) > 0


def build_index(docs: DataFrame, terms: list[tuple[bytes, bool, bool]], shortest: int, pruned: bool = True) -> DataFrame:
    """One row per document: the columns of ``docs``, ``_con_n`` words, and its postings as two arrays, ``_con_terms`` and ``_con_at``.

    terms: (word, is it in a full phrase, is it in a short one); a term's number is its place in the list.
    pruned: only positions in runs that can hold a phrase.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({w: (i << 2) | (full << 1) | short for i, (w, full, short) in enumerate(terms)})
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0).cast("long").alias("_con_n"), F.array(F.lit(0)).alias("_con_terms"), F.array(F.lit(0)).alias("_con_at")).schema

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, found_terms, found_at = [], [], []
            for text in batch.column(at):
                words = words_of(text.as_py())
                codes = np.fromiter((number(w, -1) for w in words), dtype=np.int64, count=len(words))
                known = codes >= 0
                keep = _runs(known & ((codes & 2) > 0), PHRASE)
                if not pruned:
                    keep = known
                elif shortest < PHRASE:
                    keep |= _runs(known & ((codes & 1) > 0), shortest)
                where = np.flatnonzero(keep)
                n.append(len(words))
                found_at.append(where.astype(np.int32))
                found_terms.append((codes[where] >> 2).astype(np.int32))
            ends = np.cumsum([0, *map(len, found_at)]).astype(np.int32)
            flat = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), type=pa.int32())) for x in (found_terms, found_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, type=pa.int64()), *flat], names=[*batch.schema.names, "_con_n", "_con_terms", "_con_at"])

    return docs.mapInArrow(postings, schema)


def search(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact matches ``row, start, length, phrase``.

    postings: ``row, pos, term`` (number). wanted: ``phrase, length, off, term``, one row per place of each distinct phrase.
    """
    rarity = postings.groupBy("term").count()
    ordered = wanted.join(rarity, "term", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("count", F.lit(0)), "off"))
    )
    plans = materialise(
        ordered.groupBy("phrase", "length").agg(
            F.min_by("term", "rank").alias("rare"), F.min_by("off", "rank").alias("rare_off"),
            F.count_if(F.col("count").isNull()).alias("absent"),
            F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "off", "term")))).alias("rest"),
        ).filter("absent = 0")
    )
    starts = (
        postings.join(plans.select("phrase", "length", F.col("rare").alias("term"), "rare_off", "rest"), "term")
        .select("row", (F.col("pos") - F.col("rare_off")).alias("start"), "length", "phrase", "rest")
        .filter("start >= 0")
    )
    single = starts.filter("length = 1").select("row", "start", "length", "phrase")
    # a candidate needs the second rarest term at its offset before the others are looked up
    second = F.col("rest")[0]
    second = starts.filter("length > 1").select("*", (F.col("start") + second["off"]).alias("pos"), second["term"].alias("term"))
    kept = second.join(postings, ["row", "pos", "term"], "left_semi")
    pair = kept.filter("length = 2").select("row", "start", "length", "phrase")
    rest = kept.filter("length > 2").select("row", "start", "length", "phrase", F.explode(F.slice("rest", 2, PHRASE)).alias("x"))
    rest = rest.select("row", "start", "length", "phrase", (F.col("start") + F.col("x.off")).alias("pos"), F.col("x.term").alias("term"))
    full = (
        rest.join(postings, ["row", "pos", "term"], "left_semi")
        .groupBy("row", "start", "length", "phrase").count().filter(F.col("count") == F.col("length") - 2)
        .select("row", "start", "length", "phrase")
    )
    return single.union(pair).union(full)


def proximity(postings: DataFrame, terms: list[int], width: int) -> DataFrame:
    """``row, start`` where all ``terms`` occur within ``width`` consecutive positions that begin at a term."""
    hits = postings.filter(F.col("term").isin(terms))
    span = Window.partitionBy("row").orderBy("pos").rangeBetween(0, width - 1)
    return hits.withColumn("near", F.size(F.collect_set("term").over(span))).filter(F.col("near") == len(set(terms))).select("row", F.col("pos").alias("start"))


def near(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_near`` (distinct phrases whose terms all lie within ``width`` consecutive words) ``, n_near_items, near_items_sha256``."""
    slices = _slices(benchmark)
    numbered = _numbered(docs.select("doc_id", "text"), len(slices))
    found = [_near_slice(numbered, *x, width) for x in slices]
    if len(found) == 1:
        out = found[0]
    else:
        every = reduce(DataFrame.unionByName, [materialise(f) for f in found])
        out = every.groupBy("_con_row").agg(
            F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.sum("n_near").alias("n_near"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")
        )
    ids = F.array_sort("ids")
    return out.select("doc_id", "n_words", "n_near", F.size("ids").cast("long").alias("n_near_items"), F.sha2(F.array_join(ids, ","), 256).alias("near_items_sha256"))


def _near_slice(docs: DataFrame, wanted: DataFrame, terms: list[tuple[bytes, bool, bool]], shortest: int, width: int) -> DataFrame:
    """``_con_row, doc_id, n_words, n_near, ids`` of every row, from one slice of the phrases."""
    index = materialise(build_index(docs, terms, shortest, pruned=False).select("_con_row", "doc_id", "_con_n", "_con_terms", "_con_at"))
    count = np.zeros(len(terms), dtype=np.int64)
    for r in index.select(F.explode("_con_terms").alias("t")).groupBy("t").count().collect():  # at most MAX_TERMS numbers
        count[r.t] = r["count"]
    rows = wanted.groupBy("phrase").agg(F.collect_set("term").alias("terms"), F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items")).collect()
    rows = [(sorted(r.terms, key=lambda t: (count[t], t)), r.items) for r in rows]
    rows = sorted((r for r in rows if count[r[0][0]]), key=lambda r: r[0])
    sets = np.full((len(rows), PHRASE), -1, dtype=np.int64)
    for i, (t, _) in enumerate(rows):
        sets[i, : len(t)] = t
    shared = docs.sparkSession.sparkContext.broadcast((sets, [items for _, items in rows]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, items = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = _near_rows(batch.column("_con_n").to_numpy(), batch.column("_con_terms"), batch.column("_con_at"), sets, width)
                ids = [sorted({x for p in ps for x in items[p]}) for ps in found]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(map(len, found), type=pa.int64()), pa.array(ids, type=pa.list_(pa.string()))],
                    names=["_con_row", "doc_id", "n_words", "n_near", "ids"],
                )

    schema = index.select("_con_row", "doc_id", F.col("_con_n").alias("n_words"), F.col("_con_n").alias("n_near"), F.array(F.lit("")).alias("ids")).schema
    return index.mapInArrow(look, schema)


def _near_rows(n: np.ndarray, terms: pa.ListArray, at: pa.ListArray, sets: np.ndarray, width: int) -> list[set[int]]:
    """The numbers of the phrases near each row; sets: a phrase's distinct terms, rarest first, -1 behind them, sorted by the first."""
    base = width + np.cumsum([0, *(n + width)])  # rows side by side, further apart than a window
    row = np.repeat(np.arange(len(n)), np.diff(terms.offsets.to_numpy()))
    term, place = terms.flatten().to_numpy().astype(np.int64), at.flatten().to_numpy() + base[row]
    span = int(base[-1]) + 2 * width
    keys = np.sort(term * span + place)
    first, last = np.searchsorted(sets[:, 0], term), np.searchsorted(sets[:, 0], term, side="right")
    many = last - first
    of = np.repeat(np.arange(len(term)), many)
    phrase = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]

    def within(of: np.ndarray, phrase: np.ndarray, low: int, high: int) -> np.ndarray:
        """Which candidates have every term of their phrase between the places ``low`` and ``high`` from their own."""
        live = np.arange(len(of))
        for k in range(1, sets.shape[1]):
            t, p = sets[phrase[live], k], place[of[live]]
            i = np.searchsorted(keys, t * span + p + low)
            live = live[(t < 0) | ((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= t * span + p + high))]
        return live

    some = within(of, phrase, 1 - width, width - 1)
    of, phrase = of[some], phrase[some]
    out: list[set[int]] = [set() for _ in n]
    for shift in range(width):
        for i in within(of, phrase, -shift, width - 1 - shift):
            out[row[of[i]]].add(int(phrase[i]))
    return out


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _slices(benchmark: DataFrame) -> list[tuple[DataFrame, list[tuple[bytes, bool, bool]], int]]:
    """For each slice of the phrases: the phrases with numbered terms, the vocabulary in number order, the shortest phrase. One slice at least."""
    found = materialise(phrases(benchmark))
    n = 1
    while True:
        slice_of = F.pmod(F.xxhash64("phrase"), F.lit(n))
        sizes = found.groupBy(slice_of.alias("s")).agg(F.count_distinct("term").alias("terms"), F.count_distinct("phrase").alias("phrases"))
        most = sizes.agg(F.max("terms").alias("terms"), F.max("phrases").alias("phrases")).first()
        if (most.terms or 0) <= max(MAX_TERMS, PHRASE) and (most.phrases or 0) <= MAX_PHRASES:
            break
        n *= 2
    out = []
    for k in range(n):
        part = found.filter(slice_of == k) if n > 1 else found
        vocabulary = part.groupBy("term").agg(F.max(F.col("length") == PHRASE).alias("full"), F.max(F.col("length") < PHRASE).alias("short"))
        rows = sorted((r.term, r.full, r.short) for r in vocabulary.collect())  # at most MAX_TERMS
        if not rows and (out or k + 1 < n):
            continue
        least = part.agg(F.min("length")).first()[0] or PHRASE
        numbers = benchmark.sparkSession.createDataFrame(pa.table({"term": pa.array([r[0] for r in rows], pa.string()), "number": pa.array(range(len(rows)), pa.int32())}))
        numbered = part.join(numbers, "term").select("item_id", "phrase", "length", "off", F.col("number").alias("term"))
        out.append((materialise(numbered), [(r[0].encode(), r[1], r[2]) for r in rows], least))
    return out


def _numbered(docs: DataFrame, slices: int) -> DataFrame:
    """``docs`` with a number per row, ``_con_row``; written if rows are read once per slice, so that a row keeps its number."""
    numbered = docs.withColumn("_con_row", F.monotonically_increasing_id())
    return materialise(numbered) if slices > 1 else numbered


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the index, with the columns ``keep`` of ``docs``, with ``_con_row``, and verdicts ``row, n_hit, n_items, items_sha256`` of rows with a hit)."""
    slices = _slices(benchmark)
    numbered = _numbered(docs, len(slices))
    indexes, found = zip(*[_matches(numbered, *x, keep) for x in slices], strict=True)
    matches = reduce(DataFrame.union, [m for m, _ in found])
    wanted = reduce(DataFrame.union, [w for _, w in found])
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "length"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"].cast("long")))).alias("n"),
            F.greatest(acc["end"], (x["start"] + x["length"]).cast("long")).alias("end"),
        ),
    )["n"]
    hits = matches.groupBy("row").agg(merged.alias("n_hit"))
    items = (
        matches.select("row", "phrase").distinct().join(wanted, "phrase")
        .groupBy("row").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))
        .select("row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    return indexes[0], hits.join(items, "row", "left")


def _matches(docs: DataFrame, wanted: DataFrame, terms: list[tuple[bytes, bool, bool]], shortest: int, keep: list[str]) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(the index, (matches ``row, start, length, phrase``, ``phrase, item_id``)) of one slice."""
    index = materialise(build_index(docs, terms, shortest).select(*[f"`{c}`" for c in keep], "_con_row", "_con_n", "_con_terms", "_con_at"))
    held = index.filter(F.size("_con_terms") > 0)
    postings = held.select(F.col("_con_row").alias("row"), F.explode(F.arrays_zip("_con_at", "_con_terms")).alias("p"))
    postings = materialise(postings.select("row", F.col("p._con_at").alias("pos"), F.col("p._con_terms").alias("term")))
    return index, (materialise(search(postings, wanted.select("phrase", "length", "off", "term").distinct())), wanted.select("phrase", "item_id").distinct())


def _verdict(index: DataFrame, verdicts: DataFrame) -> DataFrame:
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return index.join(verdicts, index["_con_row"] == verdicts["row"], "left").withColumns({
        "_con_hit": n_hit,
        "_con_items": F.coalesce("n_items", F.lit(0)).cast("long"),
        "_con_sha": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)),
        "_con_bad": (n_hit > 0) & (n_hit * MIN_SHARE >= F.col("_con_n")),
    })


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``. A verdict is of the text, so its digest stands for it."""
    keyed = docs.withColumn("_con_key", F.md5("text"))
    index, verdicts = judge(keyed.select("text", "_con_key"), benchmark, ["_con_key"])
    bad = _verdict(index.select("_con_row", "_con_key", "_con_n"), verdicts).filter("_con_bad").select("_con_key").distinct()
    return keyed.join(materialise(bad), "_con_key", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index, verdicts = judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return _verdict(index, verdicts).select(
        "doc_id", F.col("_con_n").alias("n_words"), F.col("_con_hit").alias("n_hit"), F.col("_con_items").alias("n_items"),
        F.col("_con_sha").alias("items_sha256"), F.col("_con_bad").alias("contaminated"),
    )


SQL = r"""
WITH bi AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 12], ' ') AS p, least(len(w), 13) AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM bi WHERE len(w) > 0)
), lens AS (SELECT DISTINCT k FROM bw
), di AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS p
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM di, lens WHERE len(w) >= k)
), m AS (SELECT r, s, dw.k, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.k = bw.k
), h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS pos FROM m) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS id FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM di LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
