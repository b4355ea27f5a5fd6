"""The store: segments, search, recovery, pruning, existence, lower bounds."""

import threading

import pytest
from pyspark.sql import functions as F

from logstrata.operators import manifest, segments, templates
from logstrata.operators.search import has_keyword
from logstrata.schema import LOG_LINE, CorruptSegment, InvalidInput
from logstrata.session import cut
from logstrata.store import LogStore, StoreConfig


def logs(spark, rows):
    return spark.createDataFrame(rows, LOG_LINE).coalesce(1)


def messages(df):
    return [r.m for r in df.collect()]


def test_range_keyword_and_limit(spark, tmp_path):
    rows = [(1000 + 100 * i, "api", "DIWE"[i % 4], f"ERROR: critical failure in module {i}" if i % 5 == 0 else f"request {i} done") for i in range(50)]
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=20))
    store.append(logs(spark, rows))
    assert store.stats()["segment_count"] == 2 and store.stats()["buffered_lines"] == 10
    assert store.query(limit=None).count() == 50
    assert store.query(keyword="critical").count() == 10
    assert store.query(2000, 3000).count() == 11
    five = store.query(limit=5).collect()
    # scan order: the first rows of the segment with the newest time, newest of them first
    assert [r.t for r in five] == [1000 + 100 * i for i in (24, 23, 22, 21, 20)]
    assert [r.t for r in store.query(limit=3, order="latest").collect()] == [5900, 5800, 5700]
    assert store.query(3000, 2000).count() == 0 and store.query(0, 10).count() == 0
    assert store.query(keyword="%").count() == 0
    with pytest.raises(InvalidInput):
        store.query(order="other")


def test_rows_survive_reopening_and_a_lost_manifest(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=10))
    store.append(logs(spark, [(i, "s", "I", f"m {i}") for i in range(27)]))
    again = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=10))
    assert sorted(messages(again.query(limit=None))) == sorted(f"m {i}" for i in range(27))
    assert again.stats()["buffered_lines"] == 7
    again.flush()
    assert again.stats()["segment_count"] == 3 and again.stats()["buffered_lines"] == 0
    again._delete("segments")
    assert again.query(limit=None).count() == 0
    again.rebuild()
    assert again.stats()["segment_count"] == 3 and again.query(limit=None).count() == 27
    again.check()
    again._delete(f"data/run={again.segments().filter('segment_id = 2').first().run}/segment_id=2")
    with pytest.raises(CorruptSegment):
        again.check()


def test_null_fields_and_order_of_appends(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=1000))
    for k in range(6):
        store.append(logs(spark, [(k, "s", "I", f"m {k}")]))
    store.append(logs(spark, [(6, "s", "I", None), (None, "s", "I", "no time")]))
    (tmp_path / "wal" / "batch=1").mkdir()
    (tmp_path / "wal" / "batch=1" / "broken.json").write_text('{"b":1,"i":0,"t":5,"m":"cut\n{"t":5,"m":"no place"}\n')
    want = [*(f"m {k}" for k in range(6)), None, "no time"]
    assert [r.m for r in store.buffered().orderBy("b", "i").collect()] == want
    store.flush()
    assert [r.m for r in store.data().orderBy("segment_id", "seq").collect()] == want and store.stats()["buffered_lines"] == 0


def test_odd_rows(spark, tmp_path):
    long = "x" * 1_000_000
    rows = [(1, "s", "ERROR", ""), (1, "s", "ERROR", ""), (2, "日志", "I", "用户 张三 登录 🎉"), (3, "s", "I", long), (4, "s", "I", 'quote " and \\ back')]
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=5))
    store.flush()
    assert store.stats()["segment_count"] == 0 and store.query().count() == 0 and not store.may_exist(keyword="abc")
    store.append(logs(spark, rows))
    assert [tuple(r) for r in store.query(limit=None).collect()] == sorted(rows, key=lambda r: -r[0])
    assert messages(store.query(keyword="张三")) == ["用户 张三 登录 🎉"]


def test_threads_and_replayed_batches(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=30))
    ts = [threading.Thread(target=lambda k=k: store.append(logs(spark, [(i, f"s{k}", "I", "m") for i in range(25)]))) for k in range(4)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert store.query(limit=None).count() == 100
    for _ in range(2):
        store.append_batch(logs(spark, [(7, "b", "I", "batch row")]), "stream:0")
    assert store.query(keyword="batch row").count() == 1


def test_metadata_answers_are_sound(spark):
    rows = [(i // 10, i, 100 * i, f"svc-{i % 3}", "DIWE"[i % 4], f"User {i} logged in from 10.0.0.{i % 7}" if i % 2 else f"cache miss key{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "segment_id long, seq long, t long, s string, l string, m string")
    meta = segments.summaries(df).join(segments.trigram_index(df), "segment_id")
    found, _ = templates.mine(df)
    meta, found = cut(meta), cut(found)
    for start, end in ((None, None), (500, 2500)):
        for keyword in ("logged", "Logged", "key3", "E", "absent"):
            inside = df.filter(F.lit(True) if start is None else F.col("t").between(start, end))
            exact = inside.filter(has_keyword(keyword)).count()
            code = manifest.level_alias(keyword)
            loose = inside.filter(has_keyword(keyword) | (F.col("l") == code if code else F.lit(False))).count()
            if not manifest.may_exist(meta, start, end, keyword).first()[0]:
                assert exact == 0
            assert manifest.count_at_least(meta, found, start, end, keyword).first()[0] <= loose
    assert not manifest.may_exist(meta, None, None, "absent").first()[0]
    assert manifest.may_exist(meta.withColumn("trigrams", F.lit(None).cast("binary")), None, None, "absent").first()[0]
    assert manifest.count_at_least(meta, found, None, None, "logged").first()[0] == 30


def test_segment_order_and_totals(spark):
    s = spark.createDataFrame([(1, 1000, 2000, 100), (2, 1500, 2500, 200), (3, 3000, 4000, 50)], "segment_id long, min_ts long, max_ts long, line_count long")
    assert [r.segment_id for r in manifest.query_range(s, 1200, 3500).collect()] == [3, 2, 1]
    assert tuple(manifest.stats(s).first()) == (3, 350, 1000, 4000)
    assert tuple(manifest.stats(s.limit(0)).first()) == (0, 0, None, None)


def test_dual_threshold(spark):
    df = spark.createDataFrame([(i, i, "s", "I", "x" * (50 if i != 4 else 500)) for i in range(12)], "seq long, t long, s string, l string, m string")
    out = {r.seq: r.flush for r in segments.dual_threshold(df, 5, 400).collect()}
    # four rows of about 95 bytes and then the long one fill the bytes; after that five rows at a time
    assert out == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 2, 11: 2}


def test_indexed_templates_raise_the_lower_bound(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=10))
    store.append(logs(spark, [(i, "s", "I", f"User {i} logged in") for i in range(10)]))
    assert store.count_at_least(keyword="logged") == 0 and store.count_at_least(keyword="INFO") == 1
    store.index_templates()
    assert store.count_at_least(keyword="logged") == 10 and store.count_at_least(5, None, "logged") == 0


def test_appends_keep_their_order_and_several_writers_lose_nothing(spark, tmp_path):
    config = StoreConfig(max_buffer_lines=100)
    a, b = LogStore(spark, str(tmp_path), config), LogStore(spark, str(tmp_path), config)
    for k in range(5):
        (a if k % 2 else b).append(logs(spark, [(k * 10 + i, "s", "I", f"m{k * 10 + i}") for i in range(3)]))
    # a number claimed early and written late is not taken for used
    late = a._claim_batch()
    b.append(logs(spark, [(60, "s", "I", "m60")]))
    b.flush()
    a._log(logs(spark, [(50, "s", "I", "m50")]), late)
    assert a.stats()["buffered_lines"] == 1 and messages(a.query(limit=3)) == ["m2", "m1", "m0"]
    a.flush()
    assert messages(a.query(limit=None)) == [f"m{k}" for k in sorted([k * 10 + i for k in range(5) for i in range(3)] + [50, 60], reverse=True)]


def test_two_flushes_at_once_destroy_nothing(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    store.append(logs(spark, [(1, "s", "I", "first")]))
    store.flush()
    other = LogStore(spark, str(tmp_path))
    other.next_segment_id = lambda: 1  # what a second process saw before the first one registered
    other.append(logs(spark, [(2, "s", "I", "second")]))
    other.flush()
    assert messages(store.query(limit=None)) == ["second", "first"]


def test_compaction(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=10, chunk_size=4))
    for k in range(4):
        store.append(logs(spark, [(10 * k + i, "s", "I", f"m{10 * k + i}") for i in range(3)]))
        store.flush()
    assert store.stats()["segment_count"] == 4 and len(store.files()) == 4
    store.compact()
    assert [(r.line_count, r.min_ts, r.max_ts) for r in store.segments().orderBy("segment_id").collect()] == [(10, 0, 30), (2, 31, 32)]
    assert [r.m for r in store.rows().orderBy("segment_id", "seq").collect()] == [f"m{10 * k + i}" for k in range(4) for i in range(3)]
    assert messages(store.query(keyword="m21")) == ["m21"] and messages(store.query(12, 20)) == ["m20", "m12"]
    store.check()
    store.compact(5)
    assert store.stats()["segment_count"] == 2


def test_chunks_are_pruned(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), StoreConfig(max_buffer_lines=100, chunk_size=10))
    store.append(logs(spark, [(i, "svc", "I", f"event number{i:03d}") for i in range(100)]))
    may = lambda k: store.chunks().filter(segments.keyword_possible(k)).count()
    assert may("number") == 10 and may("number042") == 1 and may("absent") == 0 and may("ev") == 10
    assert messages(store.query(keyword="number042")) == ["event number042"]
    assert messages(store.query(35, 41, "number04")) == ["event number041", "event number040"]
