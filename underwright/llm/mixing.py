"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted target / source_size times: a whole number of copies plus a fraction. Documents of a
source are dealt into groups of about ``fan``; in a group, two documents at a time move word mass between their
fractions, at random and without bias, until one fraction is 0 or 1. So the words of the group stay what they were, and one
document with a fraction remains. The remaining documents of ``fan`` groups form a group of the next level, until one
per source is left. It is paired with some hundred documents that were left out for that, by descending size, so that what is
rounded at last is a small one as a rule; small documents of that group are then flipped against its rounding. Random numbers are hashes of the ids that meet, so reruns agree. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from underwright.llm.common import left_join_small, stored, text_or_empty

#: A word is a run of other characters than these white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: A source gives at most so many times its words.
MOST_COPIES = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: About so many documents of each source are left for the last group, where they round off the rest in small steps.
LAST = 512
#: Copies of one row are numbered in runs of this length.
RUN = 100_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, sid, n, source_size, target, p (copies wanted of each document).

    Where the weight's share is above three times the source, the target is cut there and the excess reshared by weight.
    Sources that saturate first are those with the least size per weight; with them in that order, one running sum finds
    who is cut. The windows run over one row per source.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    named = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    totals = totals.withColumn("sid", F.row_number().over(named)).withColumn("w", F.element_at(weights, (F.col("sid") - 1) % len(WEIGHTS) + 1))
    before = Window.orderBy(F.col("source_size") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = MOST_COPIES * F.col("source_size")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    leveled = totals.withColumn("cap", cap).withColumn("level", level)
    # the first source that isn't cut sets the level of all that follow
    shared = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(shared * F.col("w"), F.col("cap").cast("double")))
    p = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    return leveled.withColumn("target", target).withColumn("p", p).select("source", "sid", "n", "source_size", "target", "p")


def unit(*parts: str) -> str:
    """A number in [0, 1) from a hash."""
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992D)"


def pivot_group(items: str, seed: int) -> Column:
    """Fold an array of (size, doc_id, copy, pi) into ``rest``, the one left with a fraction, and ``done``, the others with x 0 or 1.

    With u_i = size_i * pi_i: mass ``up`` can move from j to i and ``down`` from i to j until one of the two is integral.
    Moving up with probability down / (up + down) leaves every expectation as it was.
    """
    pair = f"""named_struct('i', a.rest, 'j', b, 'done', a.done,
        'room_i', a.rest.size * (1 - a.rest.pi), 'mass_i', a.rest.size * a.rest.pi, 'room_j', b.size * (1 - b.pi), 'mass_j', b.size * b.pi,
        'u', {unit("a.rest.doc_id", "a.rest.copy", "b.doc_id", "b.copy", f"{seed}")})"""
    # i ends at 1, j ends at 0, i ends at 0, j ends at 1
    case = """CASE WHEN s.u * (least(s.room_i, s.mass_j) + least(s.mass_i, s.room_j)) < least(s.mass_i, s.room_j)
        THEN CASE WHEN s.room_i <= s.mass_j THEN 1 ELSE 2 END ELSE CASE WHEN s.mass_i <= s.room_j THEN 3 ELSE 4 END END"""
    after = """named_struct(
        'rest', CASE t.how WHEN 1 THEN named_struct('size', t.s.j.size, 'doc_id', t.s.j.doc_id, 'copy', t.s.j.copy, 'pi', greatest(0D, (t.s.mass_j - t.s.room_i) / t.s.j.size))
            WHEN 2 THEN named_struct('size', t.s.i.size, 'doc_id', t.s.i.doc_id, 'copy', t.s.i.copy, 'pi', least(1D, (t.s.mass_i + t.s.mass_j) / t.s.i.size))
            WHEN 3 THEN named_struct('size', t.s.j.size, 'doc_id', t.s.j.doc_id, 'copy', t.s.j.copy, 'pi', least(1D, (t.s.mass_j + t.s.mass_i) / t.s.j.size))
            ELSE named_struct('size', t.s.i.size, 'doc_id', t.s.i.doc_id, 'copy', t.s.i.copy, 'pi', greatest(0D, (t.s.mass_i - t.s.room_j) / t.s.i.size)) END,
        'done', concat(t.s.done, array(CASE WHEN t.how IN (1, 3) THEN named_struct('doc_id', t.s.i.doc_id, 'copy', t.s.i.copy, 'size', t.s.i.size, 'x', CASE WHEN t.how = 1 THEN 1 ELSE 0 END)
            ELSE named_struct('doc_id', t.s.j.doc_id, 'copy', t.s.j.copy, 'size', t.s.j.size, 'x', CASE WHEN t.how = 4 THEN 1 ELSE 0 END) END)))"""
    first = f"named_struct('rest', {items}[0], 'done', transform(slice({items}, 1, 0), b -> named_struct('doc_id', b.doc_id, 'copy', b.copy, 'size', b.size, 'x', 0)))"
    return F.expr(f"aggregate(slice({items}, 2, greatest(size({items}) - 1, 0)), {first}, (a, b) -> transform(transform(array({pair}), s -> named_struct('s', s, 'how', {case})), t -> {after})[0])")


def fold(level: DataFrame, by: list[str], seed: int) -> DataFrame:
    """One row per group: ``rest`` and ``done``. The largest documents come first, so the one that remains tends to be small."""
    items = level.groupBy(*by).agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    return stored(items.select(*by, pivot_group("items", seed).alias("f")).select(*by, "f.*"), "mix-level")


def settle(folded: DataFrame, seed: int) -> DataFrame:
    """(sid, doc_id, copy, size, x) of the last group: round the one that remains, and flip small documents against it.

    If it is taken, the words that are then too many are made up for by documents of the group that were taken, else those
    that are missing by documents that weren't; by descending size, as far as they fit.
    """
    taken = F.expr(f"CAST({unit('rest.doc_id', 'rest.copy', str(seed))} < rest.pi AS INT)")
    owed = F.expr("rest.size * CASE WHEN x = 1 THEN 1 - rest.pi ELSE rest.pi END")
    by_size = F.expr("sort_array(transform(done, d -> named_struct('size', d.size, 'doc_id', d.doc_id, 'copy', d.copy, 'x', d.x)), false)")
    flips = "(d.x = x AND d.size <= a.owed)"
    flip = f"""aggregate(done, named_struct('owed', owed, 'out', slice(done, 1, 0)), (a, d) -> named_struct(
        'owed', CASE WHEN {flips} THEN a.owed - d.size ELSE a.owed END,
        'out', concat(a.out, array(named_struct('size', d.size, 'doc_id', d.doc_id, 'copy', d.copy, 'x', CASE WHEN {flips} THEN 1 - d.x ELSE d.x END)))))['out']"""
    rounded = folded.withColumn("x", taken).withColumn("owed", owed).withColumn("done", by_size).withColumn("done", F.expr(flip))
    everyone = F.expr("concat(done, array(named_struct('size', rest.size, 'doc_id', rest.doc_id, 'copy', rest.copy, 'x', x)))")
    return rounded.select("sid", F.explode(everyone).alias("d")).select("sid", "d.doc_id", "d.copy", "d.size", "d.x")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fan: int = 64, seed: int = 7) -> DataFrame:
    """How often each document enters the mix: id, copy, source, size, source_size, target, copies, taken.

    ``size`` counts the words of the whole text (null: none); ``taken`` is size times ``copies``, which is 3 at most.
    Sources are ordered by code point, null last. Rows with equal id, source and size are numbered by ``copy`` and rounded apart.
    Documents without words get whole copies of their source and take nothing; sources without words have target 0. An empty
    table gives an empty result; other columns aren't read.
    """
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = stored(read.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-sizes")
    runs = rows.withColumn("_run", F.explode(F.expr(f"sequence(0L, (m - 1) div {RUN})")))
    rows = runs.withColumn("copy", F.explode(F.expr(f"sequence(_run * {RUN}, least(m, (_run + 1) * {RUN}) - 1)"))).drop("m", "_run")
    sources = stored(source_targets(rows), "mix-sources")
    n_sources, largest = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    known = sources.withColumn("_source", F.struct("source")).drop("source")
    wanted = left_join_small(rows.withColumn("_source", F.struct("source")), known, n_sources, ["_source"], "inner").drop("_source")
    wanted = wanted.withColumn("base", F.floor("p").cast("int")).withColumn("pi", F.col("p") - F.floor("p"))
    rounded = (F.col("size") > 0) & (F.col("pi") > 0)

    item = F.struct("size", "doc_id", "copy", "pi")
    last_ones = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed + 1)), F.ceil(F.col("n") / LAST)) == 0
    group = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.ceil(F.col("n") / fan)).alias("part")
    level = wanted.where(rounded & ~last_ones).select("sid", group, item.alias("item"))
    done, n_groups, k = [], -(-largest // fan), 0
    while True:
        folded = fold(level, ["sid", "part"], seed + k)
        done.append(folded.select("sid", F.explode("done").alias("d")).select("sid", "d.*"))
        if n_groups <= 1:
            break
        n_groups, k = -(-n_groups // fan), k + 1
        level = folded.select("sid", F.floor(F.col("part") / fan).alias("part"), F.col("rest").alias("item"))
    reserved = wanted.where(rounded & last_ones).select("sid", item.alias("item"))
    folded = fold(reserved.unionByName(folded.select("sid", F.col("rest").alias("item"))), ["sid"], seed + k + 1)
    last = settle(folded, seed + k + 2)
    for part in done:
        last = last.unionByName(part)

    facts = sources.select("sid", "source", "source_size", "target", F.floor("p").cast("int").alias("base"))
    copies = left_join_small(last, facts, n_sources, ["sid"], "inner").withColumn("copies", F.col("base") + F.col("x"))
    whole = wanted.where(~rounded).withColumn("copies", F.col("base"))
    shape = ["doc_id", "copy", "source", "size", "source_size", "target", "copies"]
    out = copies.select(*shape).unionByName(whole.select(*shape))
    return out.withColumn("taken", F.col("size") * F.col("copies")).withColumnRenamed("doc_id", id_col)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows with equal id, source and size are numbered by a hash of all their columns, so a recomputed task numbers them alike. Rows that
    the mix takes no time are left out, and so is everything of an empty table; nulls are as in ``mix``.
    """
    plan = mix(docs, id_col, text_col, source_col).where("copies > 0")
    plan = plan.select(F.struct(F.col(id_col).alias("a"), F.col("source").alias("b"), F.col("size").alias("c")).alias("_key"), F.col("copy").alias("_copy"), "copies")
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct("*").alias("_doc"), F.struct(F.col(id_col).alias("a"), F.col(source_col).alias("b"), size.alias("c")).alias("_key"))
    numbered = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_doc"))).cast("long") - 1)
    joined = numbered.join(plan, ["_key", "_copy"])
    return joined.withColumn("_n", F.explode(F.expr("sequence(1, copies)"))).select("_doc.*")
