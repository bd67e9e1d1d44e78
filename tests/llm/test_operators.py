"""Dealt operators against brute force, exact round trips and held-out labels, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshjoin.llm import decontaminate, edit_prints, labelled, language, line_dedup, ngram_join, pieces, pii, quality, queries, sharding, toxicity, trees

SF = "/root/testdata/sf0.01"
WORDS = [a + b for a in "ba ke lo mi nu pa re so ti vu za du".split() for b in "l n r s t m".split()]


def text(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def frame(spark, rows, extra=()):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in extra]])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, ties, repeated rows, a long text, and columns with clashing names."""
    long = text(random.Random(1), 60_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "some text without an id"), (None, "some text without an id"), (4, "x"), (5, long), (5, long), (6, "¡ñandú! 日本 \U0001f600"), (6, "another text of six")]
    return frame(spark, [(i, t, "score", "ids") for i, t in rows], ("score", "n")).withColumnRenamed("n", "node"), len(rows)


def empty(spark):
    return frame(spark, [])


# n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(draw, t, edits):
    w = t.split()
    for _ in range(edits):
        w[draw.randrange(len(w))] = draw.choice(WORDS)
    return " ".join(w)


def test_ngram_join_equals_brute_force(spark):
    draw = random.Random(2)
    rows = []
    passage = text(draw, 60)
    for size, copies, most in ((40, 6, 2), (150, 30, 4), (400, 12, 10), (25, 10, 1), (90, 80, 2), (7, 8, 1), (5, 4, 0), (3, 4, 0)):
        base = text(draw, size)
        rows += [edited(draw, base, draw.randint(0, most)) for _ in range(copies)]
    rows += [text(draw, 40) + " " + passage + " " + text(draw, 40) for _ in range(20)]
    rows += [text(draw, draw.randint(1, 200)) for _ in range(40)] + ["", "A b C d", "a  B\nc D"]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_of_a_large_group(spark):
    """Three hundred near copies that don't all link: chains of edits, and copies too far from any leader."""
    draw = random.Random(31)
    rows, chain = [], text(draw, 130)
    for i in range(300):
        if i % 3 == 0:
            chain = edited(draw, chain, 2)
        rows.append((i, edited(draw, chain if i % 3 < 2 else rows[0][1], draw.randrange(0, 7))))
    rows += [(300 + i, text(draw, 130)) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    expected = brute_components(rows)
    assert got == expected and 25 < len({c for _, c in expected.values()}) < 280


def test_sketches_bound_differences():
    """Sketches of two sets differ in at most as many bits as the sets do in tokens."""
    draw = np.random.default_rng(3)
    for n, apart in ((50, 4), (300, 60), (5, 5), (1, 0)):
        a = draw.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[apart:], draw.integers(0, 2**63, apart).astype(np.uint64)))
        x = ngram_join._sketches(np.concatenate((a, b)), np.array([0, n, 2 * n]))
        assert np.bitwise_count(x[0] ^ x[1]).sum() <= 2 * apart


def test_signatures_keep_every_link():
    """Any two sets that link share a signature, whatever is taken as rare."""
    draw = np.random.default_rng(3)
    for trial in range(400):
        n = int(draw.integers(1, 120))
        common = np.unique(draw.integers(0, 2**64 - 1, n, dtype=np.uint64))
        lost = int(draw.integers(0, len(common) // 6 + 1))
        a = np.sort(np.concatenate((common[lost:], draw.integers(0, 2**64 - 1, int(draw.integers(0, 3)), dtype=np.uint64))))
        both, either = len(np.intersect1d(a, common)), len(np.union1d(a, common))
        if not both or 100 * both < 80 * either:
            continue
        sigs = []
        bitmap = np.zeros(1 << (ngram_join.BITMAP - 6), np.uint64)
        place = (np.intersect1d(a, common) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - ngram_join.BITMAP)
        np.bitwise_or.at(bitmap, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        for x in (a, common):
            rare = ngram_join._is_rare(x, bitmap)
            spare = ngram_join._missable(len(x)) - int(rare.sum())
            assert spare >= 0
            sigs.append(ngram_join._signatures(x[~rare], len(x), spare))
        assert len(np.intersect1d(*sigs)), (trial, len(a), len(common))


def test_rest_gives_a_pair_once(spark):
    """Pairs that share many signatures come from one of them (before: from each); those whose shared signatures are high ones aren't lost."""
    most = ngram_join.LOWEST
    sigs = {1: range(60), 2: range(60), 3: range(60), 4: [*range(100, 100 + most), 500, 501], 5: [*range(200, 200 + most), 500, 501], 6: [59, 700]}
    posts = spark.createDataFrame([(n, 0, n, s) for n, own in sigs.items() for s in own], "node long, rare long, comp long, sig long")
    bounds = spark.range(1, 7).select(F.col("id").alias("node"), F.lit(100).cast("long").alias("n"), F.col("id").alias("d1"), F.lit(0).cast("long").alias("rare"), *[F.lit(0).cast("long").alias(k) for k in ngram_join.SKETCH])
    got = [(r.a, r.b) for r in ngram_join._rest_pairs(posts, bounds).collect()]
    assert set(got) == {(a, b) for a, b in itertools.combinations(sigs, 2) if set(sigs[a]) & set(sigs[b])}
    assert len(got) <= 10  # 3 of the first three sets, 3 of them with the sixth, 2 of the fourth and fifth; by each signature it is 185


def test_ngram_join_odd_rows(spark, odd):
    docs, n = odd
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == n
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


# line deduplication


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(4)
    lines = [text(draw, draw.randint(1, 14)).capitalize() + "." for _ in range(60)]
    block = [text(draw, draw.randint(8, 14)).capitalize() + "." for _ in range(6)]
    rows = []
    for i in range(50):
        body = [draw.choice(lines) if draw.random() < 0.3 else text(draw, draw.randint(1, 12)).capitalize() + "." for _ in range(draw.randint(1, 12))]
        if i % 4 == 0:
            at, size = draw.randint(0, len(body)), draw.randint(1, 6)
            body[at:at] = block[:size]
        rows.append((i, draw.choice(["\n", " ", "\n\n"]).join(body)))
    rows += [(60, rows[0][1]), (61, rows[4][1] + "\n" + rows[8][1])]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert got[60] == ""


def brute_lines(rows, least=line_dedup.MIN_WORDS):
    """By a whole suffix array: each interval of its longest common prefixes is a maximal repeated run; all but its earliest place lose it."""
    cut = re.compile(r"(?<=\n)(?!\s)|(?<= )(?=[A-Z](?![A-Z]))|(?<=[a-z][.!?] )(?! )")
    texts = {}
    for i, t in rows:
        at = [0, *[m.start() for m in cut.finditer(t) if 0 < m.start() < len(t)], len(t)]
        texts[i] = [t[a:b] for a, b in itertools.pairwise(at)]
    key = {i: [x.rstrip(" \n\r\t") for x in lines] for i, lines in texts.items()}
    order = sorted(((i, k) for i, x in key.items() for k in range(len(x))), key=lambda at: key[at[0]][at[1] :])
    common = lambda a, b: next((n for n, (x, y) in enumerate(itertools.zip_longest(key[a[0]][a[1] :], key[b[0]][b[1] :])) if x != y), len(key[a[0]]) - a[1])
    lcp = [common(a, b) for a, b in itertools.pairwise(order)]
    dead = {i: set() for i in texts}
    for at, n in enumerate(lcp):
        lo, hi = at, at + 1
        while lo and lcp[lo - 1] >= n:
            lo -= 1
        while hi < len(lcp) and lcp[hi] >= n:
            hi += 1
        i, k = order[at]
        if n and sum(len(x.split()) for x in key[i][k : k + n]) >= least:
            for i, k in set(order[lo : hi + 1]) - {min(order[lo : hi + 1])}:
                dead[i].update(range(k, k + n))
    return {i: "".join(x for k, x in enumerate(lines) if k not in dead[i]) for i, lines in texts.items()}


def test_line_dedup_equals_maximal_runs(spark):
    """Lines of one to twelve words and none, runs of many short lines, runs that overlap themselves, ends inside runs."""
    draw = random.Random(12)
    pool = [text(draw, draw.choice([1, 1, 2, 4, 7, 12])) for _ in range(60)] + ["", "x"]
    tape = [draw.choice(pool) for _ in range(400)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(draw.randrange(1, 4)):
            s = draw.randrange(len(tape))
            lines += tape[s : s + draw.randrange(1, 45)] + [text(draw, draw.randrange(1, 9)) for _ in range(draw.randrange(3))]
        rows.append((i, "\n".join(lines)))
    rows += [(50, "\n".join(["one"] * 70)), (51, "start\n" + "\n".join(["one"] * 40)), (52, "\n".join(tape[:60])), (53, "\n".join(tape[:60] + ["end"]))]
    for least in (25, 6):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows), least).collect()}
        assert got == brute_lines(rows, least)


def test_line_dedup_clashing_columns_and_filters(spark):
    """Columns named as ours come back as they are, and a filter on the result gives the same rows."""
    passage = "\n".join(text(random.Random(k), 10) for k in range(8))
    names = ("_key", "_row", "_bits", "_lines", "_text", "_dead", "lines_deleted", "text_key", "name", "start")
    rows = [(i, f"own {i}\n{passage}", *[f"{n}{i}" for n in names]) for i in range(2)] + [(3, passage, *names)]
    got = line_dedup.dedup_lines(frame(spark, rows, names))
    assert got.columns == ["doc_id", "text", *[n for n in names if n != "lines_deleted"], "lines_deleted"]
    found = {r.doc_id: r.asDict() for r in got.collect()}
    assert all(found[i][n] == f"{n}{i}" for i in range(2) for n in names if n != "lines_deleted")
    assert [found[i]["text"] for i in (0, 1, 3)] == [rows[0][1], "own 1\n", ""] and [found[i]["lines_deleted"] for i in (0, 1, 3)] == [0, 8, 8]
    assert {r.doc_id for r in got.where("lines_deleted = 0 OR trim(text) <> ''").collect()} == {0, 1}


def test_line_dedup_ids_with_two_texts_and_without(spark):
    a, b = ("\n".join(text(random.Random(k + 10 * j), 10) for k in range(8)) for j in range(2))
    rows = [(1, a + "\nx"), (1, a + "\ny"), (None, b + "\nx"), (None, b + "\ny"), (None, b + "\ny"), (2, b)]
    got = sorted(((r.doc_id is None, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=str)
    one = [t for none, t in got if not none and t]
    none = [t for none, t in got if none]
    assert len(one) == 2 and {len(t) for t in one} == {1, len(a) + 2}
    # which of two texts without id counts as the earlier one is up to their hashes; equal rows share a place
    assert sum(b in t for t in none) in (1, 2) and len({t for t in none if b in t}) == 1 and (False, "") in got


def test_line_dedup_lines_about_the_bound(spark):
    """Lines within a few bytes of the length from which they are cut again keep their numbers."""
    draw = random.Random(8)
    rows = []
    for k in range(-3, 5):
        line = ""
        while len(line) < line_dedup.LONG + k:
            line += draw.choice(["an windward ", "lo notional ", "of ballasts "])
        line = line[: line_dedup.LONG + k - 1] + "x"
        tail = f"Own {k} " + text(draw, 5)
        rows += [(100 * k + 1000 + i, f"First {i} {k}.\n{line}\n{tail} {i}\nend") for i in range(2)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        head, line, tail, end = t.split("\n")
        assert got[i].text == (t if i % 2 == 0 else f"{head}\n{tail}\n{end}")


def test_line_dedup_cuts_long_stretches(spark):
    """A passage in lower case without stops has cuts by its content."""
    draw = random.Random(3)
    words = lambda n: " ".join(draw.choice(["an", "the", "of", "ballast", "notional", "windward", "lo"]) for _ in range(n))
    passage = words(120)
    rows = [(i, words(150) + " " + passage + " " + words(150)) for i in range(2)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[1].lines_deleted > 0 and 300 <= len(got[1].text.split()) < 340


def test_line_dedup_finds_a_pasted_passage(spark):
    draw = random.Random(5)
    passage = ". ".join(text(draw, 12).capitalize() for _ in range(5)) + "."
    rows = [(i, text(draw, 30) + " " + passage + " " + text(draw, 20)) for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(passage not in got[i] and len(got[i].split()) == 50 for i in (1, 2, 3))


def test_line_dedup_odd_rows(spark, odd):
    docs, n = odd
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == n and got[0].asDict().keys() == {*docs.columns, "lines_deleted"}
    assert sorted((r.text or "") for r in got) == sorted((r.text or "") for r in docs.collect())
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_takes_repeated_rows_as_one(spark):
    """A passage of seven lines in a doubled row, in a tripled row without an id, and pasted into other documents."""
    draw = random.Random(22)
    first, second = ("\n".join(text(draw, 10).capitalize() for _ in range(7)) for _ in range(2))
    doubled, tripled = first + "\n" + text(draw, 8).capitalize(), second + "\n" + text(draw, 9).capitalize()
    tails = [text(draw, 30).capitalize() for _ in range(3)]
    rows = [(1, doubled), (1, doubled), (2, first + "\n" + tails[0]), (None, tripled), (None, tripled), (None, tripled), (3, second + "\n" + tails[1])]
    rows += [(4, first + "\n" + tails[2]), (4, first + "\n" + tails[2])]
    got = sorted(((r.doc_id, r.text, r.lines_deleted) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=str)
    expected = [(1, doubled, 0)] * 2 + [(2, tails[0], 7), (3, tails[1], 7)] + [(None, tripled, 0)] * 3 + [(4, tails[2], 7)] * 2
    assert got == sorted(expected, key=str)


def test_line_dedup_counts_words(spark):
    """Blanks in a row aren't words, words between tabs are, and blank lines count for nothing."""
    draw = random.Random(23)
    few = "Total" + " " * 40 + "12"
    many = "\t".join(text(draw, 50).split())
    blank = "ok. \n\n".join(["Alpha"] + [w.capitalize() + " " for w in text(draw, 12).split()])
    long = "".join(w.capitalize() + "k. \n\n" for w in text(draw, 40).split())
    rows = []
    for k, t in enumerate((few, many, blank, long)):
        rows += [(10 * k + i, text(draw, 6).capitalize() + "\n" + t + "\n" + text(draw, 6).capitalize()) for i in (1, 2)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    before = dict(rows)
    assert all(got[i] == before[i] for i in (1, 2, 11, 21, 22, 31))
    assert many not in got[12] and len(got[12].split()) == 12
    assert len(got[32].split()) == 12


# sharding


def test_shards(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = sharding.shard_plan(docs, bucket_rows=100).collect()
    sizes = {}
    for r in plan:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in plan) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in plan)
    again = sharding.shard_plan(docs.repartition(5), bucket_rows=100).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in plan}
    other = sharding.shard_plan(docs, seed=9, bucket_rows=100).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in other} != {(r.doc_id, r.shard, r.slot) for r in plan}
    weird, n = odd
    got = sharding.shard_plan(weird, shards=3).collect()
    assert len(got) == n and {(r["size"], r.text_crc32) for r in got if r.doc_id == 1} == {(16, None)} and {r["size"] for r in got if r.doc_id == 2} == {16}
    assert sharding.shard_plan(empty(spark)).count() == 0
    sharding.write_shards(weird, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == n


def test_written_shards_follow_the_plan(spark, tmp_path):
    """Whole records in the plan's order, with columns named as ours, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in ("shard", "slot", "row_id", "record", "key", "bucket")})
    plan = sharding.shard_plan(docs, bucket_rows=100).select("doc_id", "shard", "slot")
    got = sharding.write_shards(docs, str(tmp_path / "a"), bucket_rows=100)
    assert {*got.columns} == {*docs.columns, "shard_", "slot_"}
    assert {tuple(r) for r in got.select("doc_id", "shard", "slot").collect()} == {tuple(r) for r in plan.collect()}
    assert got.select("shard_", "slot_", "row_id", "record", "key", "bucket").distinct().collect() == [("own shard", "own slot", "own row_id", "own record", "own key", "own bucket")]
    texts = {r.doc_id: (r.text, r.lang, r.n_chars) for r in docs.collect()}
    assert {r.doc_id: (r.text, r.lang, r.n_chars) for r in got.collect()} == texts
    assert sharding.write_shards(empty(spark), str(tmp_path / "b")).count() == 0


def test_shards_of_one_repeated_row(spark):
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_plan(docs, bucket_rows=200)
    assert got.groupBy("bucket").count().agg(F.max("count")).first()[0] < 600
    assert got.select("shard", "slot").distinct().count() == 3000


# decontamination


def test_leaks_equal_brute_force(spark):
    draw = random.Random(6)
    items = [(k, text(draw, draw.randint(20, 60))) for k in range(12)] + [(90, "too short"), (91, None), (None, text(draw, 30))]
    docs = []
    for i in range(60):
        t = text(draw, draw.randint(0, 120))
        if i % 3 == 0:
            item = items[draw.randrange(12)][1]
            t += " " + (item if i % 2 else edited(draw, item, 1)).upper() + "\n" + text(draw, 30)
        docs.append((i, t))
    docs += [(70, items[0][1]), (71, None), (72, ""), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    want = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for k, item in items:
            v = (item or "").split()
            if k is None or len(v) < 5 or len(w) < 5:
                continue
            b = [tuple(v[x : x + 5]) for x in range(len(v) - 4)]
            m = min(len(v), len(w))
            best = 0
            for s in range(len(w) - m + 1):
                a = [tuple(w[x : x + 5]) for x in range(s, s + m - 4)]
                both = sum(min(a.count(g), b.count(g)) for g in set(a) & set(b)) if set(a) & set(b) else 0
                best = max(best, both / (len(a) + len(b) - both))
            if best >= 0.8:
                want[i, k] = best
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    kept = decontaminate.clean(frame(spark, docs), bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in docs if not any(i == a for a, _ in want))
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    draw = np.random.default_rng(7)
    prints = draw.integers(0, 256, (50, 16), dtype=np.uint8)
    index = decontaminate.Index(np.arange(50), np.full(50, 9), np.zeros(50, np.uint64), np.arange(51), prints, *[np.zeros(0)] * 4)
    tables = index.tables()
    for k in range(50):
        bits = np.unpackbits(prints[k])
        bits[draw.choice(128, decontaminate.RADIUS, replace=False)] ^= 1
        blocks = np.packbits(bits).view(np.uint16)
        assert any(k in items[start[b] : start[int(b) + 1]] for (start, items), b in zip(tables, blocks, strict=True))


# SentencePiece


def small_model():
    plain = [("▁", -3.0), ("▁a", -2.0), ("ab", -2.5), ("a", -4.0), ("b", -4.0), ("c", -4.5), ("abc", -3.2), ("▁ab", -3.1), ("é", -5.0), ("cé", -4.8)]
    names = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + [p for p, _ in plain]
    return pieces.from_pieces(names, [0.0] * 257 + [s for _, s in plain], [False] + [True] * 256 + [False] * len(plain), [True] + [False] * (256 + len(plain))), dict(plain)


def test_viterbi_is_the_best_segmentation():
    model, scores = small_model()
    draw = random.Random(8)
    low = min(scores.values()) - pieces.UNKNOWN

    def best(t):
        value = [0.0] + [-1e18] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - 4), j):
                if t[i:j] in scores:
                    value[j] = max(value[j], value[i] + scores[t[i:j]])
            if t[j - 1] not in scores:
                value[j] = max(value[j], value[j - 1] + low)
        return value[-1]

    texts = ["".join(draw.choice("aabbc  éx日\n") for _ in range(draw.randint(1, 30))) for _ in range(400)] + ["ab" * 200 + "x" * 90]
    ids, off = pieces.encode(model, pa.array(texts))
    names = {i: p for i, p in enumerate(["<unk>"] + [None] * 256 + list(scores))}
    for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
        known = [names[i] for i in ids[a:b].tolist() if i > 256]
        rest = bytes(i - 1 for i in ids[a:b].tolist() if 0 < i <= 256)
        total = sum(scores[p] for p in known) + low * len(rest.decode())
        assert abs(total - best("▁" + t.replace(" ", "▁"))) < 1e-9, t


def test_pieces_round_trip(spark, odd):
    model = pieces.load()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = pieces.encode_rows(docs, model)
    assert got.where("not round_trip").count() == 0
    back = pieces.decode_rows(got, model)
    assert back.where("decoded <> text").count() == 0
    weird, n = odd
    rows = pieces.decode_rows(pieces.encode_rows(weird, model), model).collect()
    assert len(rows) == n and all(r.round_trip and r.decoded == (r.text or "") for r in rows)
    assert pieces.encode_rows(empty(spark), model).count() == 0


def test_pieces_agree_with_the_library_on_words():
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = pieces.load()
    words = sorted({w for w in "thornt hationing Über naïve 12,5 ciónmente queeux ofthstthor the".split()})
    ids, off = pieces.encode(model, pa.array(words))
    for w, a, b in zip(words, off[:-1], off[1:], strict=True):
        theirs = sp.encode(w)
        assert model.score[ids[a:b]].sum() >= model.score[theirs].sum()
        assert sp.decode(ids[a:b].tolist()) == w


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for k, kind in enumerate(pii.BASE):
        for m in re.finditer(PATTERNS[kind], t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(int(d) if j % 2 == 0 else sum(divmod(2 * int(d), 10)) for j, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(s, pii.BASE[k], e) for s, k, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    anchors, draw = pii.automaton(), random.Random(9)
    for _ in range(20000):
        t = "".join(draw.choice("0123456789..@@++--  ()ab%é4\n") for _ in range(draw.randint(0, 40)))
        assert [x for x in pii.find(t, anchors) if x[1] in pii.BASE] == base_spans(t), t


def test_added_spans_and_redaction(spark):
    t = 'See https://example.org/a?b=1, IBAN: DE89 3704 0044 0532 0130 00. token = "0123456789abcdef0123" now a.b@c.de'
    found = {(k, t[s:e]) for s, k, e in pii.find(t, pii.automaton())}
    assert {("url", "https://example.org/a?b=1"), ("account", "DE89 3704 0044 0532 0130 00"), ("secret", "0123456789abcdef0123"), ("email", "a.b@c.de")} <= found
    assert "a.b@c.de" not in pii.redact(frame(spark, [(1, t)])).first().text


def test_pii_query(spark, odd):
    got = {r.doc_id: r for r in queries.op5_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = base_spans(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(x[1] == k for x in base) for k in pii.BASE]
    weird, n = odd
    assert pii.personal_data(weird).count() == n and pii.personal_data(empty(spark)).count() == 0


# edit fingerprints


def test_edited_prints(spark, odd):
    rows = {r.doc_id: r for r in queries.op6_edit_fingerprints(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    assert len(rows) == len(docs)
    for k, i in enumerate(order):
        t, nxt = docs[i], docs[order[(k + 1) % len(order)]]
        edit = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert rows[i].near_edited > rows[i].near_next
        if k < 30:
            assert edit_prints.pairs([edit, t], True) == [(rows[i].edited_fingerprint,), (rows[i].fingerprint,)]
    weird, n = odd
    got = edit_prints.edited_prints(weird).collect()
    assert len(got) == n and {(r.n_chars, r.fingerprint) for r in got if r.doc_id in (1, 2)} == {(0, "")}
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    assert edit_prints.edited_prints(empty(spark)).count() == 0
    assert edit_prints.edited_prints(frame(spark, [(1, "alone and well")])).first().near_next == 1.0


def test_walks_follow_the_definition():
    """The embedding step by step: write the character, move on if the shared bit says so."""
    draw = random.Random(10)
    t = text(draw, 80)
    codes = edit_prints._codes(t)
    at, end = edit_prints._walk(codes, np.array([0, len(codes)]), np.zeros(1, np.int64))
    kind = ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(int)
    step, j = edit_prints._STEP, 0
    for i, c in enumerate(kind):
        assert at[i] == j
        j += step[c][j % edit_prints.PERIOD]
    assert end[0] == j
    many = [text(draw, draw.randint(1, 60)) for _ in range(150)]
    assert edit_prints.pairs(many, True) == [edit_prints.pairs([m], True)[0] for m in many]


def test_near_pairs(spark):
    draw = random.Random(11)
    base = text(draw, 300)
    rows = [(1, base), (2, base[:1500] + "X" + base[1500:]), (3, text(draw, 300)), (4, base)]
    got = {(r.a, r.b) for r in edit_prints.near_pairs(frame(spark, rows), 0.7).collect()}
    assert got == {(1, 2)}


def test_near_members_equal_brute_force(spark):
    """A common opening that puts unlike texts into one band, copies, equal fingerprints of different texts, short texts, rows without an id."""
    draw, least = random.Random(21), 0.8
    opening = text(draw, 60)
    rows = []
    for i in range(12):
        body = opening + " " + text(draw, 400)
        rows += [(10 * i + 1, body), (10 * i + 2, body[:-12] + "YZ" + body[-12:]), (10 * i + 3, body)]
    for i in range(12):
        short = text(draw, 4 + i % 6)
        rows += [(200 + 10 * i, short), (201 + 10 * i, short + "q"), (202 + 10 * i, short[:-1] + "Q"), (203 + 10 * i, short)]
    rows += [(None, rows[0][1]), (None, "x" + text(draw, 50)), (400, ""), (401, None)]
    draw.shuffle(rows)
    prints = [p[0] for p in edit_prints.pairs([t for _, t in rows], True)]
    bands = [set(edit_prints.band_keys(p)) for p in prints]
    group = list(range(len(rows)))
    short_links = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        few = min(len(prints[a]), len(prints[b])) < 64
        if prints[a] == prints[b] or ((few or bands[a] & bands[b]) and edit_prints.likeness(prints[a], prints[b]) >= least):
            short_links += few and prints[a] != prints[b]
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    heads = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    expected = sorted(((i, heads[g]) for (i, _), g in zip(rows, group, strict=True)), key=str)
    assert short_links and len(set(group)) > 12
    docs = frame(spark, rows)
    assert sorted(((r.doc_id, r.representative) for r in edit_prints.near_members(docs, least).collect()), key=str) == expected
    got = edit_prints.near_pairs(docs, least).collect()
    head = dict(expected)
    assert got and all(r.likeness >= least and r.a < r.b and head[r.a] == head[r.b] for r in got)
    assert edit_prints.near_members(empty(spark)).count() == 0


# trained operators


def held_out(spark, name, label):
    got = queries.QUERIES[name](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all()
    return got[got.held_out], label


def test_quality_on_held_out_rows(spark):
    got, label = held_out(spark, "op4_quality_classifier", "quality")
    assert (got.predicted == got[label]).mean() >= 0.95
    assert all(i == (zlib.crc32(str(d).encode()) % 5 == 0) for d, i in zip(got.doc_id, got.held_out, strict=True))


def test_toxicity_on_held_out_rows(spark):
    got, label = held_out(spark, "op8_toxicity", "toxic")
    assert (got.predicted[got[label] == 0] == 0).mean() >= 0.97
    assert got.score[got[label] == 1].mean() > 3 * got.score[got[label] == 0].mean()


def test_language_on_held_out_rows(spark, odd):
    got = queries.op7_language_id(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas()[["doc_id", "lang"]], on="doc_id")
    got = got[got.held_out]
    assert (got.lang_pred == got.lang).mean() >= 0.97
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"), labelled.remainder(5) != 0)
    weird, n = odd
    rows = language.identify(weird, model).collect()
    assert len(rows) == n and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.lang_score <= 1 for r in rows)
    none = language.train(frame(spark, [], ("lang",)), labelled.remainder(5) != 0)
    assert {r.lang_pred for r in language.identify(weird, none).collect()} == {"und"}


def test_scores_of_odd_rows(spark, odd):
    docs, n = odd
    source, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    every = F.lit(True)
    tox, qual = toxicity.train(source, labels, every), quality.train(source, labels, every)
    for scored in (toxicity.toxicity_scores(docs, tox), quality.quality_scores(docs, qual)):
        rows = scored.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    untrained = toxicity.train(source, labels.limit(0), every), quality.train(source, labels.limit(0), every)
    assert {r.score for r in toxicity.toxicity_scores(docs, untrained[0]).collect()} == {0.0}
    assert {round(r.score, 6) for r in quality.quality_scores(docs, untrained[1]).collect()} == {0.5}
    assert toxicity.toxicity_scores(empty(spark), tox).count() == 0 and quality.quality_scores(empty(spark), qual).count() == 0


def test_rules_compile_to_the_same_scores(spark):
    draw = np.random.default_rng(12)
    x = draw.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.2)).astype(float)
    model = quality.fit(x, y, ["u", "v", "w"])
    assert ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "u double, v double, w double").select(model.column().alias("s")).toPandas().s.to_numpy()
    assert np.allclose(np.sort(rows), np.sort(model.scores(x)))


def test_isotonic_is_monotone_and_averages():
    x, p = trees.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 1, 1, 1]))
    assert (np.diff(p) >= 0).all() and np.allclose(np.interp([1, 2, 3, 6], x, p), [0, 0.5, 0.5, 1])


# all operators on one odd table


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated rows of several lines, an id with two texts, rows without ids, nulls, and columns with the names that operators use inside."""
    passage = "\n".join(text(random.Random(50 + k), 10).capitalize() for k in range(8))
    names = ("_key", "_row", "_bits", "_lines", "_text", "_dead", "_doc", "key", "bucket", "record", "row_id", "node", "n", "sig", "comp", "rare", "tokens", "fingerprint", "digest", "ids", "words", "x", "label", "k", "part")
    rows = [(1, passage), (1, passage), (1, passage + "\nNext"), (None, passage), (None, passage), (None, None), (2, None), (2, ""), (3, "a@b.co you idiot " * 40), (4, text(random.Random(9), 50_000))]
    return frame(spark, [(*r, *names) for r in rows], names), names, len(rows)


def test_clashing_columns(spark, clashing, tmp_path):
    docs, names, n = clashing
    kept = lambda got: all(r[c] == c for r in got.select(*names).collect() for c in names)
    lines = line_dedup.dedup_lines(docs)
    assert lines.count() == n and kept(lines) and {r.lines_deleted for r in lines.where("doc_id is null and text is not null").collect()} == {0}
    joined = ngram_join.jaccard_components(docs)
    assert joined.count() == n and joined.columns == ["doc_id", "n_shingles", "component_id"]
    benchmark = spark.createDataFrame([(1, text(random.Random(77), 30)), (None, "x"), (2, None)], "item_id long, text string")
    clean = decontaminate.clean(docs, benchmark)
    assert clean.count() == n and kept(clean) and decontaminate.leaks(docs, benchmark).count() == 0
    red = pii.redact(docs)
    assert red.count() == n and kept(red) and "[email]" in red.where("doc_id = 3").first().text and pii.personal_data(docs).count() == n
    found = language.identify(docs, language.CentroidModel(np.ones(language.BUCKETS), np.zeros((0, language.BUCKETS)), [], np.zeros(0)))
    assert found.count() == n and kept(found) and {r.lang_pred for r in found.collect()} == {"und"}
    prints = edit_prints.near_members(docs)
    assert prints.count() == n and edit_prints.near_pairs(docs).where("a >= b").count() == 0
    out = sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    assert out.count() == n and kept(out)


def test_short_items_match_equal_documents_only(spark):
    docs = frame(spark, [(1, "Two words"), (2, "two words"), (3, "two words more of them here and there"), (4, "two"), (5, None)])
    got = decontaminate.leaks(docs, spark.createDataFrame([(7, "two words")], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 7), (2, 7)]


@pytest.mark.parametrize("text", ["a://" * 50_000, "9://a.b" * 30_000, "http://a.b/" + "a://" * 50_000, "x@" * 50_000, "1 " * 50_000, "+1" * 50_000], ids=["schemes", "no schemes", "one url", "signs", "digits", "plus"])
def test_personal_data_in_linear_time(text):
    import time

    anchors = pii.automaton()
    began = time.process_time()
    whole = pii.find(text, anchors)
    assert time.process_time() - began < 1.5
    assert len(whole) <= len(text)


def test_sharding_query_writes_the_records(spark, tmp_path):
    """The query's rows are of records that were scattered, shuffled and written; before, only handles were planned."""
    from meshjoin.llm.queries import op3_sharding
    from meshjoin.llm.scratch import shared_folder

    got = op3_sharding(spark, SF)
    files = got.inputFiles()
    assert files and all("/shards/shard=" in f and shared_folder(spark).split("file://")[-1] in f for f in files)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = sharding.shard_plan(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plan.collect()} and got.count() == docs.count()
    assert got.schema == plan.schema or got.dtypes == plan.dtypes
    assert {r.doc_id: r.text for r in spark.read.parquet(*files).collect()} == {r.doc_id: r.text for r in docs.collect()}
