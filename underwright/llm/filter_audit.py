"""Filter interaction audit over sorted posting lists.

Every row gets a sequence number. For each part and range of numbers, each filter has a posting list: the sorted numbers of the
rows that fail it. Tasks take one (part, range) after another, unite the lists of every subset of filters by galloping merges, and count
each union, alone and met with the lists of good and of toxic rows. Sizes add up over the ranges, and what any
order of filters keeps, removes and loses is a difference of sizes of unions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from underwright.llm.common import join_groups, stored, text_or_empty

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: A word is a run of other characters than these white spaces.
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "[#$%&*|]"
#: A posting range has 2 to this power sequence numbers, so every list is of bounded length.
SPAN_BITS = 13
#: Ids of a merged list that are looked up at once.
BLOCK = 512
LISTS = (*FILTERS, "good", "toxic")
SIZES = "part string, subset int, n long, failing long, failing_good long, failing_toxic long"


def reach(ids: np.ndarray, start: int, wanted: int) -> int:
    """A place after ``start`` that no id up to ``wanted`` lies beyond: steps are doubled until one passes it."""
    step = 1
    while start + step < len(ids) and ids[start + step - 1] <= wanted:
        step *= 2
    return min(len(ids), start + step)


def places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of the first id that is at least as large, for each of the sorted ``wanted``: gallop to the end of a block, search inside."""
    out, start = np.empty(len(wanted), np.int64), 0
    for k in range(0, len(wanted), BLOCK):
        block = wanted[k : k + BLOCK]
        end = reach(ids, start, block[-1])
        out[k : k + BLOCK] = start + np.searchsorted(ids[start:end], block)
        start = int(out[min(k + BLOCK, len(wanted)) - 1])
    return out


def held(ids: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in ``ids``, given their places."""
    found = np.zeros(len(wanted), bool)
    inside = at < len(ids)
    found[inside] = ids[at[inside]] == wanted[inside]
    return found


def united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted union of two sorted lists: the difference of the shorter one goes into the longer one."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return a
    at = places(a, b)
    new = ~held(a, b, at)
    return np.insert(a, at[new], b[new])


def met(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection."""
    if len(a) < len(b):
        a, b = b, a
    return int(held(a, b, places(a, b)).sum()) if len(b) else 0


def union_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int, int]]:
    """(size, good ones, toxic ones) of the union of every subset of the lists; bit k of a subset's number stands for list k.

    A subset's union is that of the subset without its last list, merged with that list.
    """
    unions = [np.zeros(0, np.int64)]
    for subset in range(1, 1 << len(lists)):
        last = subset.bit_length() - 1
        unions.append(united(unions[subset ^ 1 << last], lists[last]))
    return [(len(u), met(u, good), met(u, toxic)) for u in unions]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"part": pa.string(), "subset": pa.int32(), "n": pa.int64(), "failing": pa.int64(), "failing_good": pa.int64(), "failing_toxic": pa.int64()}
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            *lists, good, toxic = (batch.column(c)[k].values.to_numpy() for c in LISTS)
            part, n = batch.column("part")[k].as_py(), batch.column("n")[k].as_py()
            rows += [(part, s, n, *sizes) for s, sizes in enumerate(union_sizes(lists, good, toxic))]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))


def failures(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per document: part, seq, a flag per filter (A to E), good and toxic. Texts are read once."""
    words = F.regexp_extract_all(text_or_empty(text_col), F.lit(WORD), F.lit(0))
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    text = text_or_empty(text_col)
    read = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"),
        counted.alias("w"), (100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.char_length(text).cast("long")).alias("C"), text.rlike(SIGNS).alias("D"),
    )
    read = read.select("id", "part", "key", (F.col("w.n") < LEAST_WORDS).alias("A"), (100 * F.col("w.distinct") < LEAST_DISTINCT * F.col("w.n")).alias("B"), "C", "D")
    rows = stored(read.withColumn("seq", F.monotonically_increasing_id()), "audit-rows")
    groups = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    rows = join_groups(rows, stored(groups, "audit-copies"), ["key"], rows.count())
    rows = rows.select("id", "part", "seq", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))
    marks = label_marks(labels)
    known = rows.where("id IS NOT NULL").join(marks, "id", "left")
    no_id = rows.where("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(no_id)


def label_marks(labels: DataFrame) -> DataFrame:
    """One row per labelled id: whether any of its rows says good, or toxic."""
    flags = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic"))
    return flags.where("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))


def posting_lists(rows: DataFrame) -> DataFrame:
    """(part, span, n, and the sorted list of numbers for each filter, good and toxic), a row per part and range of numbers."""
    lists = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("seq")))).alias(c) for c in LISTS]
    return rows.groupBy("part", F.shiftright("seq", SPAN_BITS).alias("span")).agg(F.count("*").alias("n"), *lists)


def steps() -> list[dict]:
    """Every step of every order: the filters before it, and itself, as bits."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "letter": k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of the five filters.

    A: under 50 words; B: under 65 % of the words are different; C: over 5 % of the code points are A-Z; D: holds one of #$%&*|; E: a smaller
    id has the identical text. Null texts count as empty, so they fail A; null parts are the part ''. A row without an id never fails E, makes no
    other row fail it, and has no label. Repeated rows are rows; of one id's rows with one text none makes the other fail E. Of several
    label rows of an id, any that says 1 counts; null labels say nothing. An empty table gives an empty result; other columns
    aren't read. The 120 orders meet sums of one part, never rows.
    """
    lists = stored(posting_lists(failures(docs, labels, id_col, text_col, part_col)), "audit-postings")
    measures = ("n", "failing", "failing_good", "failing_toxic")
    sizes = lists.mapInArrow(_sizes, SIZES).groupBy("part", "subset").agg(*[F.sum(m).alias(m) for m in measures])
    packed = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct(*measures)))).alias("u"))
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, letter: int, before: int, after: int>>")
    rows = packed.select("part", "u", F.explode(plan).alias("s")).select("part", "u", "s.*")

    def size(subset: str, measure: str = "failing") -> str:
        return f"u[{subset}].{measure}"

    everything = SUBSETS - 1
    counted = rows.selectExpr(
        "part", "filter_order", "step", "letter", f"{size('after', 'n')} - {size('after')} AS kept", f"{size('after')} - {size('before')} AS removed",
        f"{size('shiftleft(1, letter)')} - {size('after')} + {size('before')} AS redundant", f"{size(everything)} - {size(f'{everything} - shiftleft(1, letter)')} AS unique_fails",
        f"{size('after', 'failing_good')} - {size('before', 'failing_good')} AS good_lost", f"{size('after', 'failing_toxic')} - {size('before', 'failing_toxic')} AS toxic_lost",
    )
    over = Window.partitionBy("part", "letter")  # 120 rows
    return counted.withColumn("shapley", F.sum("removed").over(over)).drop("letter")

