import zlib

import cases

from postweave.llm import sharding


def test_bytes_are_near_equal_and_slots_gapless(spark):
    docs = cases.clashing(cases.documents(spark))
    got = sharding.shards(spark, docs, 4).collect()
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in cases.rows()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    for k in range(4):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))
    rest = [r for r in got if r.doc_id != 203]  # the one long text fills a shard alone
    loads = [sum(r.size for r in rest if r.shard == k) for k in range(4)]
    assert sorted(loads)[0] <= sum(loads) / 3 and max(loads) - sorted(loads)[1] < 1500
    again = sharding.shards(spark, docs.repartition(5), 4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert sharding.shards(spark, cases.documents(spark, []), 4).count() == 0


def test_rebalancing_moves_little():
    sizes = {s: 100 + s % 7 for s in range(1000)}
    placed = sharding.rebalance(sharding.first_map(16, 1000), sizes, 16)
    loads = [sum(sizes[s] for s, k in placed.items() if k == j) for j in range(16)]
    assert max(loads) - min(loads) <= 2
    grown = sharding.rebalance(placed, sizes, 17)
    moved = [s for s in placed if placed[s] != grown[s]]
    assert len(moved) < 1000 / 17 * 2.5 and set(grown.values()) == set(range(17))


def test_a_grown_table_goes_on_from_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    first = [(i, "x" * (i * 37 % 400), "en", "s", 1) for i in range(3000)]
    more = [(i, "y" * (i * 53 % 300), "en", "s", 1) for i in range(3000, 3600)]
    one = sharding.shards(spark, cases.documents(spark, first), 8, 512, path).collect()
    version, before = sharding.latest_map(spark, path)
    assert version == 1
    # The same table again: nothing moves and no version is added.
    assert sorted(sharding.shards(spark, cases.documents(spark, first), 8, 512, path).collect()) == sorted(one)
    assert sharding.latest_map(spark, path)[0] == 1
    grown = sharding.shards(spark, cases.documents(spark, first + more), 8, 512, path).collect()
    version, after = sharding.latest_map(spark, path)
    moved = [s for s in before if before[s] != after[s]]
    assert version == 2 and 0 < len(moved) < 512 / 4
    loads = [sum(r.size for r in grown if r.shard == k) for k in range(8)]
    assert max(loads) - min(loads) <= 50
    shard = {r.doc_id: r.shard for r in one}
    assert sum(shard[r.doc_id] != r.shard for r in grown if r.doc_id in shard) < 3000 / 4
    sharding.shards(spark, cases.documents(spark, first + more), 9, 512, path)
    assert set(sharding.latest_map(spark, path)[1].values()) == set(range(9))
    assert spark.read.schema(sharding.MAP_SCHEMA).parquet(path).select("version").distinct().count() == 4


def test_rows_without_id_are_spread(spark):
    data = [(None, f"text {k}", "en", "s", 1) for k in range(400)]
    got = sharding.shards(spark, cases.documents(spark, data), 4).collect()
    assert len({r.vslot for r in got}) > 300
    assert sorted(r.slot for r in got if r.shard == 2) == list(range(sum(r.shard == 2 for r in got)))
