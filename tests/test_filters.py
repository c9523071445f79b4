import pytest

from quillon.functions.params import BloomParams, CuckooParams, QuotientParams
from quillon.operators import bloom, cuckoo, exactset, quotient
from quillon.sources import states


def rows(spark, values, kind="bigint"):
    return spark.createDataFrame(list(enumerate(values)), f"seq bigint, v {kind}")


def known(df):
    return {r["v"]: r["known"] for r in df.collect()}


def test_bloom_sizes():
    p = BloomParams.for_properties(1000, 0.1)
    assert (p.k, p.m) == (3, 4792)
    assert BloomParams.for_properties(1, 0.9).k == 1
    for bad in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            BloomParams.for_properties(*bad)
    with pytest.raises(ValueError):
        BloomParams(0, 1)


def test_bloom_small(spark):
    p = BloomParams(100, 2)
    flags = bloom.insert_flags(rows(spark, [1, 1, 2, None]), "v", "seq", p).orderBy("seq").collect()
    assert [r["is_new"] for r in flags] == [True, False, True, None]
    lengths = [bloom.length(bloom.build(rows(spark, v), "v", p)) for v in ([], [1], [1, 1], [1, 2])]
    assert lengths == [0, 1, 1, 2]
    state = bloom.build(rows(spark, []), "v", p)
    assert state.is_empty() and not bloom.build(rows(spark, [1]), "v", p).is_empty()
    assert bloom.build(rows(spark, [1]), "v", p).cleared().is_empty()
    assert bloom.estimated_len(100, p) is None


def test_bloom_union_and_both_ways_of_querying(spark, monkeypatch):
    p = BloomParams(1000, 3)
    both = bloom.union(bloom.build(rows(spark, [1]), "v", p), bloom.build(rows(spark, [2]), "v", p))
    probe = rows(spark, [1, 2, 3, None])
    expected = {1: True, 2: True, 3: False, None: None}
    assert known(bloom.query(both, probe, "v")) == expected
    monkeypatch.setattr(bloom, "BROADCAST_ROWS", 0)
    assert known(bloom.query(both, probe, "v")) == expected
    with pytest.raises(ValueError, match="m must be equal"):
        bloom.union(both, bloom.build(rows(spark, [1]), "v", BloomParams(999, 3)))
    with pytest.raises(ValueError, match="element types"):
        bloom.union(both, bloom.build(rows(spark, [1]), "v", p, "string"))


def test_bloom_flags_are_those_of_a_sequential_filter(spark):
    p = BloomParams(60, 3, "md5_60")
    values = [(i * 7919) % 97 for i in range(150)]
    df = rows(spark, values)
    from quillon.functions.hashing import positions

    spots = {r["seq"]: r["x"] for r in df.select("seq", positions("v", 60, 3, "md5_60").alias("x")).collect()}
    bits, expected = set(), []
    for i in range(150):
        expected.append(not bits.issuperset(spots[i]))
        bits |= set(spots[i])
    got = bloom.insert_flags(df, "v", "seq", p).orderBy("seq").collect()
    assert [r["is_new"] for r in got] == expected
    running = bloom.running_len(df, "v", "seq", p).orderBy("seq").collect()
    assert running[-1]["ones"] == len(bits) == bloom.n_ones(bloom.build(df, "v", p))


def test_cuckoo_sizes():
    a, b = CuckooParams.for_properties(0.02, 1000, 4), CuckooParams.for_properties(0.02, 1000, 8)
    assert (a.n_buckets, a.l_fingerprint) == (2048, 9)
    assert (b.n_buckets, b.l_fingerprint) == (1024, 10)
    for bad in ((1, 16, 8), (2, 15, 8), (2, 1, 8), (2, 16, 1), (2, 16, 65)):
        with pytest.raises(ValueError):
            CuckooParams(*bad)


def test_cuckoo_delete_and_union(spark):
    p = CuckooParams(2, 16, 8)
    state = cuckoo.delete(cuckoo.build(rows(spark, [13, 42]), "v", p), rows(spark, [13]), "v")
    assert known(cuckoo.query(state, rows(spark, [13, 42, None]), "v")) == {13: False, 42: True, None: None}
    assert cuckoo.length(state) == 1
    both = cuckoo.union(cuckoo.build(rows(spark, [13, 42]), "v", p), cuckoo.build(rows(spark, [130, 420]), "v", p))
    assert all(known(cuckoo.query(both, rows(spark, [13, 42, 130, 420]), "v")).values())
    assert cuckoo.length(both) == 4


def test_cuckoo_full(spark):
    p = CuckooParams(2, 2, 8)
    with pytest.raises(cuckoo.CuckooFilterFull):
        cuckoo.build(rows(spark, [0, 1, 2, 3, 5]), "v", p)
    with pytest.raises(cuckoo.CuckooFilterFull):
        cuckoo.build(rows(spark, [7] * 5), "v", CuckooParams(2, 16, 8))


def test_cuckoo_slots_roll_back():
    slots = cuckoo.Slots(CuckooParams(2, 2, 8))
    placed = [slots.insert(fp, 0, 1, lambda place, fp: place ^ 1) for fp in range(1, 5)]
    assert placed == [True, True, False, False]
    before = {k: sorted(v) for k, v in slots.buckets.items()}
    assert slots.insert(9, 0, 1, lambda place, fp: place ^ 1) is None
    assert {k: sorted(v) for k, v in slots.buckets.items()} == before


def test_cuckoo_in_slots_matches_the_multiset(spark):
    p = CuckooParams(4, 64, 12)
    df = rows(spark, list(range(150)))
    from pyspark.sql import functions as F

    placed = cuckoo.insert_sequentially(df.withColumn("g", F.lit("a")), "v", "seq", "g", p)
    assert placed.where("placed IS NULL").count() == 0
    assert placed.count() == cuckoo.length(cuckoo.build(df, "v", p)) == 150


def test_cuckoo_rows_beyond_a_full_filter_go_to_a_further_one(spark):
    from pyspark.sql import functions as F

    p = CuckooParams(2, 8, 12)
    df = rows(spark, [*range(60), *[7] * 9]).withColumn("g", F.lit("a"))
    alone = cuckoo.insert_sequentially(df, "v", "seq", "g", p).orderBy("seq").collect()
    chained = cuckoo.insert_sequentially(df, "v", "seq", "g", p, further=True).orderBy("seq").collect()
    full = next(i for i, r in enumerate(alone) if r["placed"] is None)
    assert alone[:full] == chained[:full] and {r["filter"] for r in alone} == {0, None}
    assert all(r["placed"] is not None for r in chained) and len(chained) == 69
    numbers = [r["filter"] for r in chained]
    assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1))
    assert max(map(numbers.count, numbers)) <= 16


def test_cuckoo_sequential_stores_more_rows_than_a_filter_has_slots(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillon import catalog

    spark.range(17_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 100 == 99).cast("int").alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    assert {r["g"]: r["stored"] for r in catalog.QUERIES["cuckoo_sequential"](spark, str(tmp_path)).collect()} == {"0": 16_830, "1": 170}


def test_quotient(spark):
    p = QuotientParams(3, 16)
    flags = quotient.insert_flags(rows(spark, [13, 13]), "v", "seq", p).orderBy("seq").collect()
    assert [r["is_new"] for r in flags] == [True, False]
    full = quotient.build(rows(spark, list(range(8))), "v", p)
    assert quotient.length(full) == 8
    assert all(known(quotient.query(full, rows(spark, list(range(8))), "v")).values())
    with pytest.raises(quotient.QuotientFilterFull):
        quotient.build(rows(spark, [*range(8), 1000]), "v", p)
    with pytest.raises(quotient.QuotientFilterFull):
        quotient.union(full, quotient.build(rows(spark, [1000]), "v", p))
    for bad in ((0, 8), (3, 0), (40, 30)):
        with pytest.raises(ValueError):
            QuotientParams(*bad)


def test_exact_set(spark):
    flags = exactset.insert_flags(rows(spark, [42, 42, None]), "v", "seq").orderBy("seq").collect()
    assert [r["is_new"] for r in flags] == [True, False, None]
    both = exactset.union(exactset.build(rows(spark, [42]), "v"), exactset.build(rows(spark, [1337]), "v"))
    assert known(exactset.query(both, rows(spark, [42, 1337, 13, None]), "v")) == {42: True, 1337: True, 13: False, None: None}
    assert exactset.length(both) == 2


def test_fingerprints_of_all_bits(spark):
    df = spark.createDataFrame([(i, i) for i in range(200)] + [(200, None)], "seq bigint, v bigint")
    for bits in (62, 63, 64):
        p = CuckooParams(4, 64, bits)
        state = cuckoo.build(df, "v", p)
        found = {r["fp"] % 2**64 for r in state.table.collect()}
        assert len(found) == 200 and 0 not in found and max(found) < 2**bits and max(found) > 2 ** (bits - 3)
        assert all(r["known"] is (True if r["seq"] < 200 else None) for r in cuckoo.query(state, df, "v").collect())
    for q, r in ((8, 56), (32, 32), (3, 60)):
        state = quotient.build(df, "v", QuotientParams(q, r), check=False)
        assert all(0 <= x["quotient"] < 2**q and 0 <= x["remainder"] < 2**r for x in state.table.collect()) and state.table.count() == 200
        assert all(x["known"] is (True if x["seq"] < 200 else None) for x in quotient.query(state, df, "v").collect())
    for bad in (lambda: CuckooParams(4, 64, 61, "md5_60"), lambda: CuckooParams(4, 64, 65), lambda: QuotientParams(1, 64), lambda: QuotientParams(20, 41, "md5_60")):
        with pytest.raises(ValueError, match="at most"):
            bad()


def test_states_are_saved(spark, tmp_path):
    p = BloomParams(100, 2)
    state = bloom.build(rows(spark, [1, 2, 3]), "v", p, "bigint")
    states.save(state, str(tmp_path / "s"))
    back = states.load(spark, str(tmp_path / "s"), BloomParams)
    assert back.params == p and back.type_tag == "bigint"
    assert sorted(back.table.collect()) == sorted(state.table.collect())
    with pytest.raises(ValueError):
        states.load(spark, str(tmp_path / "s"), QuotientParams)
