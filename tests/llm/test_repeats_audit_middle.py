"""Run-length index, filter audit and fill-in-middle against brute force, and their edge cases."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshjoin.llm import fill_middle, filter_audit, queries, repeat_index
from meshjoin.llm import kernels as K

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "no id\n" * 40), (None, "no id\n" * 40), (5, "x"), (6, "long line " * 20_000), (6, "long line " * 20_000),
    (7, "¡ñandú! 日本 \U0001f600\n" * 30), (7, "another text of seven\nin lines"), (8, "a"), (9, "A" * 300 + "$"), (10, "\n\n\n"), (11, "<P>marked\n"), (12, "<\nP>\n<S\n"),
]


def frame(spark, rows):
    """Documents with columns whose names clash with results."""
    names = ["doc_id", "text", "lang", "n", "form", "kept", "mask", "key", "Start", "name"]
    kinds = [T.LongType(), T.StringType(), T.StringType()] + [T.StringType()] * (len(names) - 3)
    return spark.createDataFrame([(*r, *["?"] * (len(names) - len(r))) for r in rows], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


# run-length index


def brute_repeats(rows, window=100):
    """Windows in the order of ids and places; those seen at an earlier place go. Rows of one id share their places."""
    place = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            place[w] = min(place.get(w, (i, s)), (i, s))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if place[b[s : s + window]] < (i, s):
                gone[s : s + window] = b"\1" * window
        spans = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def cut(df):
    got = repeat_index.repeats(df).select("doc_id", "n_bytes", "n_removed", "spans", F.sha2("kept", 256)).collect()
    return sorted((r[0], r[1], r[2], [tuple(s) for s in r[3]], r[4]) for r in got)


def passages(seed):
    """Texts that share whole and edited passages about as long as a window, and periodic ones."""
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared, rows = [text(n) for n in (90, 99, 100, 101, 150, 300, 700)], []
    for i in range(150):
        t = text(draw.randint(0, 300))
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(shared)
            if draw.random() < 0.4:
                at = draw.randint(0, len(p))
                p = p[:at] + "X" + p[at + 1 :]
            t += p + text(draw.randint(0, 40))
        rows.append((i, t))
    return rows + [(200, "a" * 1000), (201, "ab" * 300), (202, "abc" * 200 + "ab" * 150), (203, ""), (204, None), (205, "x" * 99), (206, "a" * 500)]


@pytest.mark.parametrize("way", ["plain", "wide", "hot", "small buckets"])
def test_repeats_equal_brute_force(spark, monkeypatch, way):
    """However a segment goes, the result is one."""
    if way == "wide":
        monkeypatch.setattr(repeat_index, "WIDE", 2)
    elif way == "hot":
        monkeypatch.setattr(repeat_index, "HOT_LEAST", 1)
        monkeypatch.setattr(repeat_index, "HOT", 1000)
        monkeypatch.setattr(repeat_index, "WIDE", 4)
        monkeypatch.setattr(repeat_index, "SAMPLED", 2)
    elif way == "small buckets":
        monkeypatch.setattr(repeat_index, "BUCKET", 3000)
    rows = passages(3)
    assert cut(frame(spark, rows)) == brute_repeats(rows)


def test_repeats_of_rows_that_share_an_id(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abcdefg ") for _ in range(n))
    p, q = text(180), text(150)
    rows = [(1, p + text(30)), (1, p + text(40) + q), (1, text(20) + p), (2, q + p), (2, q + p), (3, p), (3, p)]
    assert cut(frame(spark, rows)) == brute_repeats(rows)


def test_repeats_odd_rows(spark):
    got = cut(frame(spark, [(i if i is not None else 999, t) for i, t in ODD]))
    assert got == brute_repeats([(i if i is not None else 999, t) for i, t in ODD])
    # without an id a row comes last, and equal rows have one place
    draw = random.Random(4)
    p, q = ("".join(draw.choice("abcdefg ") for _ in range(400)) for _ in range(2))
    rows = [tuple(r) for r in repeat_index.repeats(frame(spark, [(None, p), (None, p), (4, p[:200]), (None, q)])).select("doc_id", "n_bytes", "n_removed").collect()]
    assert sorted(rows, key=str) == sorted([(4, 200, 0), (None, 400, 200), (None, 400, 200), (None, 400, 0)], key=str)
    assert repeat_index.repeats(frame(spark, [])).count() == 0


def test_repeats_long_text_in_stretches(spark, monkeypatch):
    """A text beyond two slices is taken in stretches, each copy alike."""
    monkeypatch.setattr(K, "SLICE", 4096)
    draw = random.Random(5)
    long = "".join(draw.choice("abcdefgh ") for _ in range(20_000))
    data = np.frombuffer(long.encode(), np.uint8)
    doc, start, count, name, body = repeat_index.segments(data, np.array([0, len(data)]))
    assert (start[1:] == start[:-1] + count[:-1]).all() and start[0] == 0 and start[-1] + count[-1] == len(data) - 99
    assert (doc == 0).all() and len(name) == len(body)


def test_suffix_order_runs_and_matches():
    """The order against sorted suffixes, runs against the transform itself, predecessor and match at every position from the samples."""
    draw = random.Random(6)
    strings = [bytes(draw.choice(b"ab\0\xc3") for _ in range(draw.randint(0, 40))) for _ in range(30)] + [b"abab" * 10] * 3
    off = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    suffix = [([(c + 1, 0) for c in s[k:]] + [(0, j)], int(off[j]) + k) for j, s in enumerate(strings) for k in range(len(s) + 1)]
    want = [at for _, at in sorted(suffix)]
    order, left = repeat_index.suffix_order(data, off)
    assert order.tolist() == want
    start, previous = repeat_index.run_samples(data, order, left)
    match = repeat_index.common_lengths(data, left, start, previous)
    assert len(start) < len(data)
    rank = {int(p): k for k, p in enumerate(order)}
    for p in range(len(data)):
        j = np.searchsorted(start, p, side="right") - 1
        before = order[rank[p] - 1] if rank[p] else None
        if before is None:
            continue
        a, b = data[p : p + left[p]].tobytes(), data[before : before + left[before]].tobytes()
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert max(match[j] - (p - start[j]), 0) == same
        if same:
            assert previous[j] + p - start[j] == before


# filter audit


def brute_masks(rows):
    out, least = [], {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i]
        out.append((i, part or "", {f for f, x in zip("ABCDE", fails) if x}))
    return out


def brute_audit(rows, labels):
    good, bad = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    found, out = brute_masks(rows), {}
    for part in {p for _, p, _ in found}:
        own = [(i, fails) for i, p, fails in found if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)
                ]
    for (part, order, step), v in out.items():
        v.append(sum(w[1] for (p, o, s), w in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


def audited(found):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found.collect()}


def test_audit_equals_brute_force(spark):
    draw = random.Random(7)
    words = [a + b for a in "ba Ke LO mi NU".split() for b in "l N r".split()] + ["é", "日本"]
    rows = []
    for i in range(120):
        pool = draw.sample(words, draw.randint(1, len(words))) + [str(k) for k in range(draw.choice((0, 300)))]
        t = draw.choice((" ", "\n", "\t ")).join(draw.choice(pool) for _ in range(draw.choice((3, 99, 100, 101, 150))))
        rows.append((i, t + draw.choice(("", "", " #", "|")), draw.choice(("en", "de", None))))
    rows += [(200 + k, draw.choice(rows)[1], "en") for k in range(40)] + [(i, t, None) for i, t in ODD if i != 6] + [(20, "x", "en"), (20, "y", "fr")]
    labels = [(i, draw.choice((0, 1, None)), draw.choice((0, 1))) for i in range(0, 240, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    got = audited(filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    lone = audited(filter_audit.audit(frame(spark, [(1, None, None)]), labels))
    assert len(lone) == 600 and {p for p, *_ in lone} == {""}


def test_distinct_words_with_colliding_hashes(monkeypatch):
    """Words with one hash are told apart by their bytes."""
    monkeypatch.setattr(K, "run_hashes", lambda data, starts, ends, code: np.zeros(len(starts), np.uint64))
    import pyarrow as pa

    texts = ["ab cd ab", "", "xx yy zz xx", "ab"]
    assert filter_audit.measures(pa.array(texts))["distinct"].tolist() == [2, 0, 3, 1]


def test_counts_of_a_text_beyond_a_slice(monkeypatch):
    import pyarrow as pa

    t = "Añ #" * 500
    whole = filter_audit.measures(pa.array([t]))
    monkeypatch.setattr(K, "SLICE", 64)
    assert {k: v.tolist() for k, v in filter_audit.measures(pa.array([t])).items()} == {k: v.tolist() for k, v in whole.items()}


# fill-in-middle


def brute_middle(i, t):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = [int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return i, len(units), "plain", None, None, t
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    return (i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_equals_brute_force_and_restores(spark):
    draw = random.Random(9)
    rows = ODD + [(20 + k, "".join(draw.choice(("line", "é", "\n", "\r\n", "<", "S>", "P", "日", "\x00", " ")) for _ in range(draw.randint(0, 40)))) for k in range(200)]
    made = fill_middle.fill_in_middle(frame(spark, rows)).withColumn("back", fill_middle.restored()).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted([tuple(r)[:6] for r in made], key=key) == sorted([brute_middle(i, t) for i, t in rows], key=key)
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r["back"] for r in made) == texts
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_middle_rate_and_share(spark):
    rows = frame(spark, [(k, "one\ntwo\nthree\n") for k in range(300)])
    forms = lambda **k: {r["form"]: r["count"] for r in fill_middle.fill_in_middle(rows, **k).groupBy("form").count().collect()}
    assert forms(rate=0) == {"plain": 300} and set(forms(rate=100, spm_share=0)) == {"psm"} and set(forms(rate=100, spm_share=100)) == {"spm"}
    assert 100 < forms(rate=50)["plain"] < 200
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op11_suffix_array_dedup", "op12_filter_audit", "op13_fill_in_middle"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted([tuple(r) for r in df.select(*names).collect()], key=key) == sorted(want.fetchall(), key=key)


def test_repeats_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op11_suffix_array_dedup"](spark, SF).collect())
    assert got == [(i, n, gone, len(spans), sha) for i, n, gone, spans, sha in brute_repeats(rows)]
