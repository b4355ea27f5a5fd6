"""Operators for training data against brute force, with their edge cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logstrata.llm import packing, phrases, runs, spans, termstats

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


# -- term counts


def brute_ngrams(records, sigma):
    occurrences, held = Counter(), defaultdict(set)
    for k, r in enumerate(records):
        for n in range(1, sigma + 1):
            for i in range(len(r or []) - n + 1):
                g = tuple(r[i : i + n])
                occurrences[g] += 1
                held[g].add(k)
    return {g: (c, len(held[g])) for g, c in occurrences.items()}


@pytest.mark.parametrize("sigma", [1, 3])
def test_ngrams(spark, sigma):
    rng = random.Random(5)
    records = [[rng.choice("aaaaabcd") for _ in range(rng.randrange(12))] for _ in range(200)] + [None, []]
    df = spark.createDataFrame([(r,) for r in records], "x array<string>").withColumn("terms", F.lit("clash")).repartition(3)
    counts, n = termstats.count_ngrams(df, F.col("x"), sigma)
    assert n == len(records)
    assert {tuple(r.gram): (r.occurrences, r.records) for r in counts.collect()} == brute_ngrams(records, sigma)
    counts, n = termstats.count_ngrams(df.limit(0), F.col("x"), sigma)
    assert n == 0 and counts.count() == 0


def test_template_terms_and_marks(spark):
    p = lambda *x: [(t, bytes(b) if b is not None else None) for t, b in x]
    rows = [(1, i, 7, p((0, b"a"))) for i in range(100)] + [(1, 0, 7, p((0, b"a")))] * 5
    rows += [(2, 0, None, None), (2, 1, 8, p((0, b"a"), (0, b"a"), (1, None), (None, b""))), (None, None, 9, [])]
    df = spark.createDataFrame(rows, "segment_id long, original_idx int, pat_id int, params array<struct<ty: int, bytes: binary>>")
    counts, n = termstats.count_ngrams(termstats.template_terms(df), F.col("terms"))
    assert n == 103
    got = {(r.field, r.ty, r.val): (r.occurrences, r.records, r.mark) for r in termstats.value_columns(termstats.mark(counts, n)).collect()}
    assert got == {("pat_id", -1, "7"): (100, 100, "common"), ("pat_id", -1, "8"): (1, 1, "rare"), ("pat_id", -1, "9"): (1, 1, "rare"),
                   ("bytes", 0, "61"): (102, 101, "common"), ("bytes", None, ""): (1, 1, "rare")}


# -- runs


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_runs(spark, chunks):
    rng = random.Random(chunks)
    rows, want = [], []
    for seq in range(6):
        n = 400 if seq == 3 else rng.randrange(40)
        positions = sorted(rng.sample(range(1000), n))
        events = []
        while len(events) < n:
            events += [rng.choice(["x", "y", None])] * (rng.randrange(1, 90) if seq == 3 else rng.randrange(1, 4))
        items = list(zip(positions, events))
        i = 0
        while i < n:
            j = i
            while j + 1 < n and items[i][1] is not None and items[j + 1][1] == items[i][1]:
                j += 1
            if j > i:
                want.append((seq, items[i][0], items[j][0], j - i + 1, 10 * items[i][0], 10 * items[j][0]))
            i = j + 1
        rows += [(seq, p, e, 10 * p) for p, e in items]
    rows += [(s, p, e, t + 3) for s, p, e, t in rng.sample(rows, 50)] + [(None, 1, "x", 1), (1, None, "x", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, c string, d long").withColumn("seq", F.lit("clash")).withColumn("chunk", F.lit(0))
    out = runs.runs(df, F.col("a"), F.col("b"), F.col("c"), F.col("d"), chunks)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert runs.runs(df.limit(0), F.col("a"), F.col("b"), F.col("c")).count() == 0


@pytest.mark.parametrize("chunks", [1, 5])
def test_extent_of_runs(spark, chunks):
    times = [50, 20, None, 70, 60, None, 5, None, None]
    rows = [(1, i, "x" if i < 5 else "y" if i < 7 else "z", t) for i, t in enumerate(times)] + [(1, 1, "x", 20)]
    df = spark.createDataFrame(rows, "a long, b long, c string, d long")
    out = runs.runs(df, F.col("a"), F.col("b"), F.col("c"), F.col("d"), chunks, extent=True).select("first_pos", "n_members", "low_t", "high_t", "n_timed")
    assert sorted(map(tuple, out.collect())) == [(0, 5, 20, 70, 4), (5, 2, 5, 5, 1), (7, 2, None, None, 0)]


def test_durations_of_both_tables(spark):
    from logstrata.llm import queries

    d = "/root/testdata/sf0.001"
    key = ["tbl", "sequence_id", "first_pos", "last_pos", "n_members"]
    got = queries.p3_runs(spark, d).collect()
    assert Counter(tuple(r[k] for k in key) for r in got) == Counter(tuple(r[k] for k in key) for r in queries.p3_found(spark, d).collect())
    assert {r.tbl for r in got} == {"log_lines", "template_records"}
    assert all((r.duration_ms is None) == (r.n_timed < 2) and (r.duration_ms or 0) >= 0 for r in got)
    # brute force for the records
    records = {(r.segment_id, r.original_idx): r.ts_delta for r in spark.read.parquet(f"{d}/template_records.parquet").collect()}
    at, total = {}, defaultdict(int)
    for (s, i), delta in sorted(records.items()):
        total[s] += delta
        at[s, i] = total[s]
    for r in got:
        if r.tbl == "template_records":
            within = [t for (s, i), t in at.items() if s == r.sequence_id and r.first_pos <= i <= r.last_pos]
            assert (r.first_t, r.last_t, r.n_timed) == (min(within), max(within), len(within))


def test_text_event(spark):
    texts = ["Got 5 items", "got  items!", "GOT v2.1 Items", "items got", "12 34", "", None, "a-b c", "a b c", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    got = [r[0] for r in df.select(runs.text_event(F.col("m"))).collect()]
    assert got[0] == got[1] == got[2] == "got items" != got[3]
    assert got[4] == got[5] == "" and got[6] is None and got[7] == got[8]


# -- packing


@pytest.mark.parametrize("capacities", [[10], [4, 10], [1, 2, 50]])
def test_pack_invariants(capacities):
    rng = random.Random(1)
    sizes = [rng.randrange(0, 130) if k % 9 == 0 else rng.randrange(0, 9) for k in range(500)]
    top = max(capacities)
    bins = packing.pack(sizes, capacities)
    held = defaultdict(list)
    for capacity, items in bins:
        fill = sum(x[2] for x in items)
        assert items and fill <= capacity and not any(fill <= c < capacity for c in capacities)
        for i, piece, n in items:
            held[i].append((piece, n))
    for i, size in enumerate(sizes):
        pieces = sorted(held[i])
        assert [p for p, _ in pieces] == list(range(len(pieces))) and sum(n for _, n in pieces) == size
        assert len(pieces) == 1 if size <= top else all(n == top for _, n in pieces[:-1])
    total = sum(capacity for capacity, _ in bins)
    assert total <= 1.03 * sum(sizes) + top


def test_sizes_are_chosen_and_downsized():
    # sixes leave least in a container of 6, a rest of 3 ends in one of 4
    bins = packing.pack([6, 6, 6, 10, 3], [4, 6, 10])
    assert sorted((c, sum(x[2] for x in items)) for c, items in bins) == [(4, 3), (6, 6), (6, 6), (6, 6), (10, 10)]
    # with the large size alone the same texts waste more
    assert sum(c for c, _ in packing.pack([6, 6, 6, 10, 3], [10])) > sum(c for c, _ in bins)
    # a container opened for what is expected and filled less is made smaller in the end
    assert [c for c, _ in packing.pack([7, 2], [9, 12])] == [9]


def test_containers_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(k % 300, rng.randrange(1, 40)) for k in range(900)] + [(7, 5)] * 400
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    content = lambda x: sorted((r.container_id, r.position, r.doc_id, r.n_tokens) for r in packing.pack_tokens(x, [16, 64], 200).collect())
    one = content(df.coalesce(1))
    assert one == content(df.repartition(7)) and len(one) == len(content(df.orderBy(F.rand(3)))) >= len(rows)


def test_pack_texts(spark):
    import tiktoken

    texts = ["", None, "it's 12 words\n\n  of code_x", "naïve café 日本", "a b " * 30_000, "tab\tand\r\n", "same", "same", "\x1c odd  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (6, "same")], "k long, t string").withColumn("doc_id", F.lit("clash"))
    counts = packing.count_tokens(df, F.col("k"), F.col("t"))
    encode = packing._PieceCounts(packing.TOKENIZER).encode
    assert isinstance(encode.__self__, tiktoken.Encoding)
    assert sorted((r.doc_id, r.n_tokens) for r in counts.collect()) == sorted([(i, len(encode(t or ""))) for i, t in enumerate(texts)] + [(6, len(encode("same")))])
    out = packing.pack_limits(df, F.col("k"), F.col("t"), {"s": 8, "l": 1000})
    for limit in ("s", "l"):
        per = Counter()
        for r in out.filter(F.col("limit_name") == limit).collect():
            per[r.doc_id] += r.n_tokens
        want = {i: len(encode(t or "")) * (2 if i == 6 else 1) for i, t in enumerate(texts)}
        assert dict(per) == want
    assert packing.pack_limits(df.limit(0), F.col("k"), F.col("t"), {"s": 8}).count() == 0
    assert packing.pack_limits(df, F.col("k"), F.col("t"), {}).count() == 0


# -- phrases


def test_phrases(spark):
    rng = random.Random(2)
    items = {i: " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 12, 40]))) for i in range(12)}
    items[12] = items[11]
    docs = []
    for d in range(60):
        text = [rng.choice(WORDS) for _ in range(rng.randrange(60))]
        w = items[rng.randrange(12)].split()
        a = rng.randrange(len(w))
        part = w[a : a + rng.randrange(8, 20)]
        at = rng.randrange(len(text) + 1)
        docs.append((d, rng.choice([" ", "__", ", ", "\n+ "]).join(x.upper() if rng.random() < 0.3 else x for x in text[:at] + part + text[at:])))
    docs += [(100, ""), (101, None), (None, items[5]), (102, "word " * 50_000), (103, items[11]), (103, items[11])]
    df = spark.createDataFrame(docs, "k long, t string").withColumn("doc", F.lit("clash")).repartition(3)
    grams = defaultdict(set)
    for i, t in items.items():
        w = phrases.words(t)
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    want = {(d, i) for d, t in docs if d is not None for w in [phrases.words(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    got = phrases.phrase_matches(df, F.col("k"), F.col("t"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 5
    for r in got:
        text = phrases.words(next(t for d, t in docs if d == r.doc_id))
        assert text[r.doc_word : r.doc_word + r.n_words] == phrases.words(items[r.item_id])[r.item_word : r.item_word + r.n_words]
    near = {(r.doc_id, r.item_id) for r in phrases.phrase_matches(df, F.col("k"), F.col("t"), items, slop=1).collect()}
    assert want <= near
    assert phrases.phrase_matches(df.limit(0), F.col("k"), F.col("t"), items).count() == 0
    assert phrases.phrase_matches(df, F.col("k"), F.col("t"), {}).count() == 0


def test_proximity(spark):
    q = {1: " ".join(f"w{i}" for i in range(12))}
    gapped = [" ".join(f"w{i} " + "x " * gap for i in range(12)) for gap in (0, 1, 2)]
    df = spark.createDataFrame(list(enumerate([*gapped, " ".join(f"w{i}" for i in reversed(range(12)))])), "k long, t string")
    found = lambda slop: {r.doc_id for r in phrases.phrase_matches(df, F.col("k"), F.col("t"), q, slop=slop).collect()}
    assert (found(0), found(1), found(2)) == ({0}, {0, 1}, {0, 1, 2})


def test_too_many_queries(spark):
    with pytest.raises(ValueError):
        phrases.bounded_queries(spark.range(5), F.col("id"), F.col("id").cast("string"), most=4)
    with pytest.raises(ValueError):
        phrases.bounded_queries(spark.range(5), F.col("id"), F.lit("x" * 30), chars=100)
    assert len(phrases.bounded_queries(spark.range(1), F.col("id"), F.lit("x" * 300), chars=100)) == 1


@pytest.mark.parametrize("most,chars", [(4, 10**6), (100, 700)])
def test_blocks_of_queries_give_the_same(spark, monkeypatch, most, chars):
    rng = random.Random(9)
    items = {i: " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 14, 30]))) for i in range(20)}
    docs = [(d, " ".join([*(rng.choice(WORDS) for _ in range(20)), *items[rng.randrange(20)].split()[1:], "end"])) for d in range(40)]
    df = spark.createDataFrame(docs, "k long, t string")
    qs = spark.createDataFrame([*items.items(), (None, "x"), (99, None)], "i long, q string")
    monkeypatch.setattr(phrases, "CANDIDATES", 16)
    key = lambda rows: sorted(map(tuple, rows.distinct().collect()))
    whole = phrases.phrase_matches(df, F.col("k"), F.col("t"), items)
    assert key(phrases.search_all(df, F.col("k"), F.col("t"), qs, F.col("i"), F.col("q"), most=most, chars=chars)) == key(whole) and whole.count() > 10
    assert phrases.search_all(df, F.col("k"), F.col("t"), qs.limit(0), F.col("i"), F.col("q")).count() == 0


# -- spans


def brute_pairs(docs, n=300):
    grams = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            grams[t[i : i + n]].add(d)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def noise(rng, n):
    return "".join(rng.choice("abcdefgh \n") for _ in range(n))


def span_texts():
    rng = random.Random(3)
    stock = [noise(rng, 900) for _ in range(6)]
    docs = []
    for d in range(50):
        s = rng.choice(stock)
        a, n = rng.randrange(150), rng.choice([150, 299, 300, 301, 420, 500])
        docs.append((d, noise(rng, rng.randrange(300)) + s[a : a + n] + noise(rng, rng.randrange(300))))
    docs += [(200 + k, docs[0][1]) for k in range(3)] + [(300, ""), (301, None), (None, stock[0]), (302, "é" * 299 + stock[1][:300]), (303, "z" * 500), (304, "z" * 400), (305, "zy" * 200), (306, "yz" * 220)]
    docs.append((200, docs[0][1]))
    return docs, [(d, t) for d, t in docs if d is not None and t]


def shared_spans(spark, docs):
    df = spark.createDataFrame(docs, "k long, t string").withColumn("doc", F.lit("clash")).withColumn("text", F.lit("clash")).repartition(3)
    return spans.SharedSpans(df, F.col("k"), F.col("t"))


@pytest.mark.parametrize("intervals,rows", [(8, 1024), (3, 8)])
def test_spans(spark, monkeypatch, intervals, rows):
    monkeypatch.setattr(spans, "INTERVALS", intervals)
    monkeypatch.setattr(spans, "PART_ROWS", rows)
    docs, known = span_texts()
    want = brute_pairs(known)
    found = shared_spans(spark, docs)
    assert {tuple(r) for r in found.pairs().collect()} == want and len(want) > 50
    text = dict(known)
    cover = {r.doc_id: (r.n_chars, r.shared_chars) for r in found.coverage().collect()}
    stretches = defaultdict(list)
    for r in found.stretches().collect():
        stretches[r.doc_id].append((r.start, r.start + r.length))
    grams = defaultdict(set)
    for d, t in known:
        for i in range(len(t) - 299):
            grams[t[i : i + 300]].add(d)
    assert cover.keys() == {d for d, _ in docs if d is not None}
    for d, t in text.items():
        marked = set()
        for i in range(len(t) - 299):
            if len(grams[t[i : i + 300]]) > 1:
                marked.update(range(i, i + 300))
        assert cover[d] == (len(t), len(marked)), d
        assert sorted(stretches[d]) == [(a, b) for a, b in zip(sorted(x for x in marked if x - 1 not in marked), sorted(x + 1 for x in marked if x + 1 not in marked))], d
    assert cover[301] == (0, 0)
    # classes: one row per document, and pairs between the documents that stand for them
    class_of = {r.doc_id: r.class_id for r in found.membership().collect()}
    assert class_of == {d: min(x for x, y in known + [(300, "")] if y == t) for d, t in known + [(300, "")]}
    pairs = {tuple(r) for r in found.class_pairs().collect()}
    assert pairs == {(class_of[a], class_of[b]) for a, b in want if class_of[a] < class_of[b]} | {(class_of[b], class_of[a]) for a, b in want if class_of[b] < class_of[a]}


def test_phrases_are_confirmed_and_located_by_the_automata(spark, monkeypatch):
    docs, known = span_texts()
    want = brute_pairs(known)
    whole = spans.pick

    def colliding(texts, phrase=spans.PHRASE, min_chars=300):  # a hash that tells next to nothing
        return [(h & 3, p) for h, p in whole(texts, phrase, min_chars)]

    monkeypatch.setattr(spans, "pick", colliding)
    found = shared_spans(spark, docs)
    assert {tuple(r) for r in found.pairs().collect()} == want
    picked = sum(len(h) for h, _ in whole([t for _, t in known]))
    phrases = {r.phrase for r in found.confirmed().collect()}
    assert 0 < len(phrases) < picked / 2  # all hashes recur, few phrases do
    held = defaultdict(set)
    for d, t in {t: d for d, t in known}.items():
        for p in phrases:
            if p in d:
                held[p].add(t)
    assert all(len(held[p]) > 1 for p in phrases)
    # occurrences are found where a phrase was picked, and elsewhere too
    at = {(r.doc, r.place) for r in found.occurrences.select("doc", "place").collect()}
    first = {t: d for d, t in sorted(known, reverse=True) if len(t) >= 300}
    everywhere = {(d, i) for t, d in first.items() for i in range(len(t) - spans.PHRASE + 1) if t[i : i + spans.PHRASE] in phrases}
    picks = {(d, int(i)) for (t, d), (_, places) in zip(first.items(), whole(list(first))) for i in places if t[i : i + spans.PHRASE] in phrases}
    assert picks <= at <= everywhere and len(at) > 2 * len(picks)


def test_nothing_is_found_without_the_automata(spark, monkeypatch):
    monkeypatch.setattr(spans, "AUTOMATON", 10**9)
    docs, known = span_texts()
    locate = spans._locate
    monkeypatch.setattr(spans, "_locate", lambda n, path: lambda batches: (x.iloc[:0] for x in locate(n, path)(batches)))
    copies = {(a, b) for a, b in brute_pairs(known) if dict(known)[a] == dict(known)[b]}
    assert {tuple(r) for r in shared_spans(spark, docs).pairs().collect()} == copies  # exact copies alone need none


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, "short"), (2, None)], "k long, t string")
    found = spans.SharedSpans(df, F.col("k"), F.col("t"))
    assert found.pairs().count() == 0 and found.stretches().count() == 0
    assert {tuple(r) for r in found.coverage().collect()} == {(1, 5, 0), (2, 0, 0)}


def test_long_texts_are_hashed_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 500)
    text = noise(random.Random(4), 5000)
    whole = set(zip(*map(list, spans.pick([text])[0])))
    parts = {(h, p + start) for start, part in spans._chunks(text, 300) for h, p in zip(*map(list, spans.pick([part])[0]))}
    assert parts == whole


# -- queries


def test_queries_equal_their_sql(spark):
    import duckdb

    from logstrata.llm import queries

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("log_lines", "template_records", "templates", "documents", "eval_items"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, d)
        cols = sorted(df.columns)
        r = c.execute(sql)
        at = [[x[0] for x in r.description].index(k) for k in cols]
        assert Counter(tuple(x[i] for i in at) for x in r.fetchall()) == Counter(map(tuple, df.select(cols).collect())), name
