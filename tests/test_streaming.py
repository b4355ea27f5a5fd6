"""Streams into a store."""

from logstrata.sources.tail import _Reader
from logstrata.store import LogStore
from logstrata.streaming.ingest import file_lines, ingest, tail_lines


def test_files_are_ingested_once(spark, tmp_path):
    src, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    src.mkdir()
    (src / "a.log").write_text('{"t":1,"s":"a","l":"E","m":"one"}\nplain ERROR two\n\n')
    for _ in range(2):  # the second run finds nothing new
        q = ingest(file_lines(spark, str(src)), store, "app", str(tmp_path / "ck"), {"availableNow": True})
        q.awaitTermination()
    assert sorted(r.m for r in store.query(limit=None).collect()) == ["one", "plain ERROR two"]


def test_tail_reads_whole_lines(spark, tmp_path):
    f = tmp_path / "x.log"
    f.write_bytes(b"old\n")
    r = _Reader({"path": str(f)})
    at = r.initialOffset()
    f.write_bytes(b"old\nnew line\npart")
    rows, end = r.read(at)
    assert list(rows) == [("new line",)] and list(r.readBetweenOffsets(at, end)) == [("new line",)]
    f.write_bytes(b"z\n")
    assert list(r.read(end)[0]) == [("z",)]
    f.write_bytes(b"one\ntwo\n" + b"x" * 40 + b"\nlast\n")
    r, at, parts = _Reader({"path": str(f), "startingOffset": "earliest", "maxBytes": "10"}), {"at": 0}, []
    while (got := r.read(at))[1] != at:
        parts.append([x for x, in got[0]])
        at = got[1]
    assert parts == [["one", "two"], ["x" * 40, "last"]] or [x for p in parts for x in p] == ["one", "two", "x" * 40, "last"] and len(parts) > 1
    f.write_bytes(b"z\n")
    store = LogStore(spark, str(tmp_path / "store"))
    q = ingest(tail_lines(spark, str(f), "earliest"), store, "app", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [r.m for r in store.query().collect()] == ["z"]
