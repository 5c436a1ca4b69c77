"""Method and odd inputs of exact dedup, mixing, sharding and the pipeline's row choices."""

from __future__ import annotations

import collections
import math

import pytest

from underwright.llm import bag_minhash, exact_dedup, mixing, sharding


def test_index_carries_the_id_that_stays(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BUCKETS", 4)
    rows = [(k, f"Text {k % 50}") for k in range(400)] + [(None, "text 1"), (399, "TEXT 49"), (399, "text 49"), (None, "only"), (None, "ONLY")]
    docs = spark.createDataFrame([(*r, 1, "clash", 2, "x") for r in rows], "doc_id long, text string, first int, key string, n int, keep_id string")
    found = exact_dedup.exact_dedup(docs, bucket_keys=2).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t.lower()].append(i)
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == len(groups)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert all(by_id[i]["keep_id"] == max((j for j in g if j is not None), default=None) and by_id[i]["group_size"] == len(g) for g in groups.values() for i in g if i is not None)
    assert [r["kept"] for r in found if r["doc_id"] == 399].count(True) == 1 and [r["keep_id"] for r in found if r["doc_id"] is None] .count(None) == 2


def test_chosen_rows_do_not_depend_on_their_order(spark):
    rows = [(1, "some text of five words", "en", k) for k in range(20)] + [(1, "Some TEXT of five words", "en", 99), (None, None, None, 1), (None, "", None, 2), (None, "", None, 3)]
    ddl = "doc_id long, text string, lang string, n_chars int"
    forward, back = (spark.createDataFrame(r, ddl).repartition(n) for r, n in ((rows, 3), (rows[::-1], 5)))
    for choose in (exact_dedup.keep_one, bag_minhash.keep_one_of_class):
        assert sorted(map(str, choose(forward).collect())) == sorted(map(str, choose(back).collect())) and choose(forward).count() == 2
        assert choose(forward.limit(0)).count() == 0


def levels(n, fan):
    count = 1
    while n > fan:
        n, count = -(-n // fan), count + 1
    return count


def test_rounding_in_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST", 8)
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + pmod(xxhash64(id), 40) AS INT)) AS text", "IF(id % 4 = 0, 'a', IF(id % 4 = 1, 'b', 'c')) AS source")
    assert levels(3000, 8) >= 4
    taken, size_of, want = collections.Counter(), collections.Counter(), {}
    shares = collections.defaultdict(list)
    for seed in (7, 8):
        rows = mixing.mix(docs, fan=8, seed=seed).collect()
        assert len(rows) == 6000 and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, fan=8, seed=seed).collect()))
        for source in "abc":
            own = [r for r in rows if r["source"] == source]
            target, total = own[0]["target"], own[0]["source_size"]
            assert abs(sum(r["taken"] for r in own) - target) <= 40 and sum(r["size"] for r in own) == total
            p = target / total
            assert all(r["copies"] in (math.floor(p), math.floor(p) + 1) for r in own)
            for r in own:
                shares[source, r["size"] // 11].append(r["copies"] - math.floor(p))
                want[source] = p - math.floor(p)
    for (source, _), extra in shares.items():  # inclusion doesn't depend on the size
        p = want[source]
        assert abs(sum(extra) / len(extra) - p) <= 4 * math.sqrt(p * (1 - p) / len(extra)) + 1e-9, source


def test_mixed_rows_repeats_as_planned(spark):
    rows = [(k, " ".join(["w"] * (k % 7)), "abc"[k % 3]) for k in range(60)] + [(None, "x y", None)] * 4 + [(5, "w " * 5, "c")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, source string, copies string, copy int")
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = collections.Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.mixed_rows(docs).collect())
    assert got == +plan and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_shards_recomputed(spark, tmp_path):
    names = [f"s{k}" for k in range(5)]
    rows = [(k % 40 if k % 9 else None, f"t{k % 3}") for k in range(500)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, shard string, slot int").repartition(7)
    slots = {r["doc_id"]: r["slot"] for r in docs.selectExpr("doc_id", "CAST(pmod(xxhash64(doc_id), 211) AS INT) AS slot").distinct().collect()}
    owner = sharding.fill_slots(names, 211)
    written = sharding.write_shards(docs, ["doc_id"], names, str(tmp_path / "a"), 211)
    got = [(r["row"]["doc_id"], r["slot"], r["shard"]) for r in written.collect()]
    assert sorted(map(str, got)) == sorted(str((i, slots[i], names[owner[slots[i]]])) for i, _ in rows)
    assert sharding.write_shards(docs.limit(0), ["doc_id"], names, str(tmp_path / "b"), 211).count() == 0
    assert sharding.shard_documents(docs.limit(0)).count() == 0 and sharding.shard_documents(docs).count() == 500


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_documents(spark, tmp_path, empty):
    import corpus_pipeline

    prose = "the cat and the dog went to the house of the old man by the sea and sat there for a long time "
    texts = [prose * 3, prose * 3, None, "", "12 34", (prose * 3).upper(), prose * 400, *[f"{prose} number {k} of the many other things that were there {k * k}" for k in range(30)]]
    rows = [(k, t, "en", "a" if k % 3 else None, 7) for k, t in enumerate(texts)] + [(1, texts[1], "en", "a", 7), (None, texts[9] + " and so on", "en", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, "unused").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "sentencepiece" or docs.columns == before.columns
        if name == "language" and not empty:
            assert docs.where("text IS NULL OR text = '' OR text = '12 34'").isEmpty() and docs.count() >= 30
        if name == "near_dedup" and not empty:
            assert docs.where(f"lower(text) = '{prose * 3}'").count() == 1
    assert docs.where("NOT round_trip").isEmpty() and docs.isEmpty() == empty
