import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard as J
from tessera.llm import suffix_dedup as S
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.store import Scratch
from tessera.llm.word_dedup import word_dedup
from tessera.llm import words as W


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, sf_dir, odd, odd_rows, none, n, num):
    docs = documents(spark, sf_dir)
    more = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("w "), "text").alias("text"))
    for df in (docs.select("doc_id", "text").union(more), odd):
        want = brute.jaccard([r for r in pairs(df) if r[0] is not None], n, num, 100)
        got = J.ngram_jaccard_join(df, n, (num, 100)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert len(got) == df.count() and all(r.component_id is None for r in got if r.doc_id is None)
    assert J.ngram_jaccard_join(none, n, (num, 100)).count() == 0


def test_repeated_rows_share_a_component(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (9, "z")], "doc_id long, text string")
    assert sorted(map(tuple, J.ngram_jaccard_join(df, 3).collect())) == [(2, 4, 2), (5, 4, 2), (5, 4, 2), (9, 1, 9)]


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_find_every_component(seed):
    r = np.random.default_rng(seed)
    sets, base = [], [np.unique(r.integers(0, 400, 60)) for _ in range(4)]
    for _ in range(70):
        s = base[int(r.integers(4))].copy()
        s = np.union1d(s[r.random(len(s)) > 0.06], r.integers(0, 400, int(r.integers(0, 4))))
        sets.append(s.astype(np.uint64))
    sizes = np.array([len(s) for s in sets])
    side = r.integers(0, 2, len(sets)) if seed % 2 else None
    num = 80

    def roots(links):
        p = list(range(len(sets)))

        def f(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in links:
            p[max(f(a), f(b))] = min(f(a), f(b))
        return [f(i) for i in range(len(sets))]

    good = [(a, b) for a in range(len(sets)) for b in range(a) if (side is None or side[a] != side[b]) and 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= num * (sizes[a] + sizes[b] - k)]
    got = J.trie_links(sets, sizes, num, 100, side)
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in good}
    assert roots(got) == roots(good)


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    r = np.random.default_rng(1)
    rows = []
    for i in range(120):
        w = [f"t{j}" for j in range(100)]
        for _ in range(int(r.integers(0, 4))):
            w[int(r.integers(100))] = f"v{r.integers(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.ngram_jaccard_join(df, 3, (90, 100)).collect()}
    assert got == brute.jaccard(rows, 3, 90, 100)


@pytest.mark.parametrize("rounds, few", [(1, 8), (2, 0), (3, 1)])
def test_large_families_of_several_components(spark, monkeypatch, rounds, few):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    r = np.random.default_rng(rounds)
    line = [f"t{j}" for j in range(3000)]
    rows, at = [], 0
    for i in range(260):  # stretches of one line of words: near ones are alike, and all hang together by shared n-grams
        at += int(r.integers(1, 9))
        rows.append((i, " ".join(line[at : at + 100])))
    rows = [rows[k] for k in r.permutation(len(rows))]
    want = brute.jaccard(rows, 3, 90, 100)
    assert 20 < len({c for _, c in want.values()}) < 200
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)).collect()}
    assert got == want


def test_equal_names_of_different_sets_are_noticed(spark, monkeypatch):
    seen, mapper = [], J._mapper

    def few(n, lower, bits, salt=0):
        seen.append(salt)
        run = mapper(n, lower, bits, salt)

        def same(batches):  # with the first salt all sets have one name
            for b in run(batches):
                body = b.column("body").to_pylist()
                if salt == 0:
                    body = [np.r_[np.ones(len(x) // 16, np.int64), np.frombuffer(x, np.int64)[len(x) // 16 :]].tobytes() if k >= 1 << bits else x for k, x in zip(b.column("key").to_pylist(), body)]
                yield b.set_column(b.schema.get_field_index("body"), "body", J.pa.array(body, J.pa.binary()))

        return same

    monkeypatch.setattr(J, "_mapper", few)
    rows = [(i, f"some text of its own {i}") for i in range(9)]
    got = J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)).collect()
    assert seen == [0, 1] and all(x.component_id == x.doc_id for x in got)


def test_word_dedup_against_brute_force(spark, sf_dir, odd, none):
    for df in (documents(spark, sf_dir), odd):
        want = brute.word_dedup([r for r in pairs(df) if r[0] is not None])
        got = word_dedup(df).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
        assert len(got) == df.count() and all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert word_dedup(none).count() == 0


def test_word_dedup_of_hot_passages_and_repeated_rows(spark, monkeypatch):
    import tessera.llm.word_dedup as D

    monkeypatch.setattr(D, "HOT", 3)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(i, f"{'q ' * (i % 7)}x{i} {shared} y{i} {'z ' * (i % 3)}") for i in range(40)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    got = word_dedup(df, texts=True).collect()
    want = brute.word_dedup(rows)
    assert len(got) == 42 and all(tuple(r)[1:4] == want[r.doc_id] for r in got)
    assert all("s5 " not in r.kept for r in got if r.doc_id)


def test_word_dedup_of_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(70))
    rows = [(3, a), (3, b), (3, a + " " + b), (2, b), (4, a), (4, a), (5, "x " + a)]
    got = sorted(tuple(r) for r in word_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = []
    for k, (d, t) in enumerate(rows):  # each against the rows of smaller ids
        one = brute.word_dedup([(2 * i + (i == k), x) for i, (e, x) in enumerate(sorted(rows, key=lambda r: r[0])) if e < d] + [(10**6, t)])[10**6]
        want.append((d, *one))
    assert got == sorted(want)


def test_word_dedup_of_windows_with_one_short_hash(spark, tmp_path):
    from tessera.llm import blobs as B

    word = [f"v{i}" for i in np.random.default_rng(4).integers(0, 5000, 1 << 21)]
    data = np.frombuffer(" ".join(word).encode(), np.uint8)
    h = W.window_hashes(W.word_hashes(data, *W.spans(data, np.array([0, len(data)]))[:2]), 50)
    cell = B.short(h, 6)
    by = np.argsort(cell, kind="stable")
    k = np.flatnonzero(cell[by][1:] == cell[by][:-1])[0]
    a, b = (word[i : i + 50] for i in by[k : k + 2].tolist())
    assert a != b
    rows = [(i, " ".join(w)) for i, w in enumerate((a, b, a[:25], b[:25]))]  # the halves make both windows candidates
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))  # a table of known, small size: the fewest bits
    got = {r.doc_id: tuple(r)[1:] for r in word_dedup(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    assert got == brute.word_dedup(rows) and not any(x[1] for x in got.values())


def test_suffix_dedup_against_brute_force(spark, sf_dir, odd, none):
    small = documents(spark, sf_dir).where(F.length("text") < 6000)  # the plain version is slow
    for df in (small, odd):
        rows = [(k, t) for k, (_, t) in enumerate(pairs(df))]
        want = brute.suffix_dedup(rows)
        got = suffix_dedup(df).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted((-1 if i is None else i, *want[k]) for k, (i, _) in enumerate(pairs(df)))
    assert suffix_dedup(none).count() == 0


def overlapping(seed, n=40):
    r = np.random.default_rng(seed)
    base = ["".join(chr(97 + x) for x in r.integers(0, 3, 300)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [base[int(r.integers(6))][int(r.integers(0, 120)) : int(r.integers(150, 300))] for _ in range(4)]
        rows.append((i, "".join(parts) + chr(97 + i % 26) * int(r.integers(0, 90))))
    return rows + [(n, "ab" * 60), (n + 1, "\0" * 90), (n + 2, "z" + "\0" * 38 + "y"), (n + 3, "xyz" * 13 + "x")]


@pytest.mark.parametrize("seed, hot", [(0, 4096), (1, 4096), (2, 2), (3, 5)])
def test_suffix_dedup_of_overlaps_and_edges(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = overlapping(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:5] for x in suffix_dedup(df.repartition(3), length=40, bytes_kept=True).collect()}
    assert got == brute.suffix_dedup(rows, 40)


@pytest.mark.parametrize("hot", [4096, 3])
def test_a_later_batch_meets_the_levels_of_earlier_ones(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = overlapping(5, 60)
    rows += [(200, rows[3][1]), (201, "unlike " * 3 + "the rest")]
    family = S.SuffixFamily(spark, 40, bits=4)
    for a, b in ((0, 25), (25, 45), (45, len(rows))):
        family.add(spark.createDataFrame(rows[a:b], "doc_id long, text string"))
        got = {x.doc_id: tuple(x)[1:5] for x in family.result().collect()}
        assert got == brute.suffix_dedup(rows[:b], 40)
    # another object goes on with the stored tables
    root, half = f"file://{tmp_path}/family", [spark.createDataFrame(rows[a:b], "doc_id long, text string") for a, b in ((0, 45), (45, len(rows)))]
    S.SuffixFamily(spark, 40, bits=4, scratch=Scratch(spark, "", root)).add(half[0])
    again = S.SuffixFamily.reopen(spark, root, half[:1], 40, 4)
    again.add(half[1])
    assert {x.doc_id: tuple(x)[1:5] for x in again.result().collect()} == got
    # without the stored levels of the first call, what only they hold is missed
    less = S.SuffixFamily(spark, 40, bits=4)
    less.add(spark.createDataFrame(rows[:45], "doc_id long, text string"))
    less.tables["levels"].clear()
    less.add(spark.createDataFrame(rows[45:], "doc_id long, text string"))
    assert {x.doc_id: tuple(x)[1:5] for x in less.result().collect()} != got


def test_rows_are_documents_whatever_their_ids(spark):
    one, two = "a1 " + "first text " * 3 + "q" * 60, "b2 " + "second one " * 4
    rows = [(7, one), (7, two), (7, one + two), (None, two), (None, "short"), (8, None), (8, None), (9, "".join(chr(200 + i) for i in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.suffix_dedup([(k, t) for k, (_, t) in enumerate(rows)], 40)
    assert sorted(tuple(r)[1:] for r in suffix_dedup(df, length=40).collect()) == sorted(want.values())


def batches(texts, size):
    for a in range(0, len(texts), size):
        mine = [t for t in texts[a : a + size]]
        ids = np.zeros(len(mine), S.KEY)
        ids["a"] = np.arange(a, a + len(mine))
        zero = np.zeros(len(mine), np.int64)
        yield S.Batch(ids, zero, zero, np.zeros(len(mine), bool), mine)


def test_suffix_levels_find_what_batches_share():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 100, 40, dtype=np.uint8)) for _ in range(200)]
    texts += texts[:30]
    levels, found = S.SuffixLevels(40), set()
    for batch in batches(texts, 7):
        for ids, lo, hi in levels.add(batch):
            found |= {int(x) for x, a, b in zip(ids["a"], lo, hi) if (a, b) == (0, 40)}
    assert found == {*range(30), *range(200, 230)}
    sizes = [len(b) for b, _ in levels.levels]
    assert sum(sizes) == 230 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    for level, _ in levels.levels:
        assert [t for t in level.texts] == sorted(level.texts)
    lost = S.SuffixLevels(40)
    for k, batch in enumerate(batches(texts, 115)):
        lost.levels.clear()
        assert not any(len(ids) for ids, _, _ in lost.add(batch)), k  # each half alone has no repeats


def test_equal_stretches_have_equal_anchors():
    r = np.random.default_rng(3)
    shared = r.integers(97, 123, 500, dtype=np.uint8)
    a = np.concatenate([r.integers(97, 123, 333, dtype=np.uint8), shared, r.integers(97, 123, 77, dtype=np.uint8)])
    there, alone = S.Anchors(a, np.array([0, len(a)]), 100), S.Anchors(shared, np.array([0, 500]), 100)
    assert set(alone.hash.tolist()) <= set(there.hash.tolist())
    for x, n in ((there, len(a)), (alone, 500)):  # each stretch has one anchor, which it holds
        at = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(x.lo, x.hi)])
        assert sorted(at.tolist()) == list(range(n - 99)) and (x.hi <= x.pos).all() and (x.pos + 25 <= x.lo + 100).all()
    flat = S.Anchors(np.full(100_000, 97, np.uint8), np.array([0, 100_000]), 100)
    assert len(flat.pos) < 1500 and flat.twice.all()
