"""Centroids, importance resampling and personal data, against brute force and on odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import docs, extra, odd
from tidewater.llm import centroids, pii, resampling

# 11 centroids


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def lloyd(rows, k=8, rounds=10, dims=64):
    """Plain Python: {position: (cluster, distance)}, centroids."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(c)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), c


def test_centroids_equal_plain_lloyd(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(j % 3, 0.7) for j in range(64)], 0) for i in range(120)]
    rows += [(200 + i, [0.25] * 64, 0) for i in range(60)]  # one vector many times, so seeds can be equal
    rows += [(7, [0.25] * 64, 0), (7, [0.5] * 64, 1), (None, [-0.5] * 64, None), (300, None, 0), (301, [1.0] * 63, 0), (302, [1.0] * 63 + [None], 0), (303, [1.0] * 63 + [math.nan], 0), (304, [math.inf] * 64, 0), (305, [], 0)]
    rows += [(400, [3e5] * 64, 0), (401, [3e5 + 64] * 64, 0)]  # beyond what a 64-bit integer's square holds
    want, c = lloyd(rows)
    got = centroids.op11_centroids(vectors(spark, rows).withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).withColumn("distance", F.lit(None))).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    assert {r["centroid_sha256"] for r in got} == {hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j in {x[1] for x in want}}
    for r in got:
        assert r["inertia"] == sum(x[2] for x in want) and r["cluster_inertia"] == sum(x[2] for x in want if x[1] == r["cluster"])


def test_centroids_odd(spark):
    assert centroids.op11_centroids(vectors(spark, [])).count() == 0
    assert centroids.op11_centroids(vectors(spark, [(1, None, 0), (2, [math.nan] * 64, 0)])).count() == 0
    got = centroids.op11_centroids(vectors(spark, [(1, [0.1] * 64, 0), (2, [0.1] * 64, 0)])).collect()
    assert [r["cluster"] for r in got] == [0, 0] and {r["inertia"] for r in got} == {0}
    huge = centroids.op11_centroids(vectors(spark, [(i, [(-1) ** i * 3e38] * 64, 0) for i in range(3)] + [(9, [0.0] * 64, 0)])).collect()
    assert {r["cluster"] for r in huge if r["vec_id"] in (0, 2)} != {r["cluster"] for r in huge if r["vec_id"] == 1} and all(r["distance"] == 0 for r in huge if r["vec_id"] == 9)


def test_screen_is_exact_where_float32_is_not():
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**25), 2**25, 64)
    c = [(base + rng.integers(-2, 3, 64)).tolist() for _ in range(40)] + [[2**40] * 64]
    v = base + rng.integers(-2, 3, (300, 64))
    v[:5] = 2**40 - 1
    screen = centroids.Screen(c)
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(row, x, strict=True)), j) for j, x in enumerate(c))[1] for row in v.tolist()]
    assert screen.nearest(v.astype(float)).tolist() == want
    low, high = screen.intervals(v.astype(float), np.abs(v).max(1) > centroids.NARROW)
    for i in range(0, 300, 17):
        own = sum(int(x) ** 2 for x in v[i])
        for j, x in enumerate(c):
            d = sum((int(a) - b) ** 2 for a, b in zip(v[i].tolist(), x, strict=True)) - own
            assert low[i, j] <= d <= high[i, j]


# 12 importance resampling


def plain_resample(rows, target, buckets=10_000):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for w in split(text):
            s[bucket(w)] += 1
    for text in target:
        for w in split(text):
            t[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        words = split(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in words)
        out.append([i, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for n, x in enumerate(able[: 10 * len(able) // 100], 1):
        x[4] = n
    return sorted(map(tuple, out), key=str)


def test_resampling_equals_plain_python(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)] + ["Ärger", "ÉTÉ", "naïve", "x_y", "A1B2"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 25, 60])))) for i in range(300)]
    rows += [(1000 + i, "same words " * 15) for i in range(150)] + [(5000, "same words " * 15)] * 40  # ties in score
    rows += [(2000, None), (2001, ""), (2002, "!!! --- \x00"), (2003, "w1 " * 60_000), (None, "w2 " * 30), (None, None), (7, "w3 " * 25), (7, "w4 " * 25)]
    target = ["w1 w2 w3 w1", None, "", "ärger W4"]
    frame = extra(docs(spark, [(i, t, "en", "a") for i, t in rows])).withColumn("rank", F.lit(None)).withColumn("bag", F.lit(0))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.op12_resampling(frame.repartition(7), bench).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_resample(rows, target)


def test_resampling_odd(spark):
    bench = spark.createDataFrame([(1, "w")], "item_id long, text string")
    assert resampling.op12_resampling(docs(spark, []), bench).count() == 0
    got = resampling.op12_resampling(odd(spark), bench.limit(0)).collect()
    assert len(got) == 9 and [r["rank"] for r in got] == [None] * 9
    pairs = resampling.resample(docs(spark, [(1, "a b a b", "en", "a"), (2, "b", "en", "a")]), bench, share=(1, 1), least_words=0, n_grams=2).collect()
    assert {r["doc_id"]: r["n_features"] for r in pairs} == {1: 7, 2: 1} and sorted(r["rank"] for r in pairs) == [1, 2]
    with pytest.raises(ValueError):
        resampling.Hasher(70_000, 1)


def test_above_sums_from_the_highest_score(spark):
    rng = random.Random(3)
    counts = {rng.randrange(-(10**6), 10**6): rng.randrange(1, 50) for _ in range(500)}
    got = resampling.above(spark.createDataFrame(list(counts.items()), "score long, n long")).collect()
    assert {r["score"]: r["above"] for r in got} == {s: sum(n for x, n in counts.items() if x > s) for s in counts}


# 13 personal data


def plain_base(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(x.isdigit() for x in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for n in range(20_000):
        text = "".join(rng.choice("aB0123456789 @@..-+()%_é\n٣") for _ in range(rng.randrange(1, 60)))
        if n % 2:
            text = " ".join(rng.choice(["a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+12", "@", "a@b.c@d.e_f@g.h", "1.2.3.4.5.6.7.8"]) + rng.choice(["", ".", ",", "-", "9"]) for _ in range(6))
        assert sorted((pii.KINDS.index(k), a, b) for k, a, b, ok in pii.base_matches(text) if ok) == plain_base(text), text


def test_patterns_take_linear_time():
    import time

    for piece in ("a", "1", "1.", "+1-", "a@", "1 ", "(1", "ab:", "dot @ ", "[at]", "@ a.a.", "a@b.co ", "1[.]"):
        text = (piece * 200_000)[:200_000]
        began = time.process_time()
        pii.candidates(text)
        assert time.process_time() - began < 20, piece  # a second or two; quadratic would be an hour


def people(spark, n=400, seed=11):
    """Texts with personal data outside the base patterns, the spans, and traps."""
    rng, rows, want = random.Random(seed), [], {}
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + digits(14)
        return next(d + x for x in "0123456789" if pii.luhn(d + x))

    for i in range(n):
        k = i % 8
        c = card()
        true = {0: ("email", f"ann{i} [at] mail{i} [dot] com"), 1: ("phone", f"(0{rng.choice('23456789')}{digits(2)}) {digits(3)}-{digits(4)}"), 2: ("card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"), 3: ("ip", f"{rng.randrange(11, 255)}[.]{rng.randrange(255)}[.]{rng.randrange(255)}[.]{rng.randrange(255)}")}.get(k)
        lead = {0: "write an email to", 1: "call my phone", 2: "paid by card", 3: "logged from host"}.get(k, "")
        refused = card()
        refused = refused[:-1] + str((int(refused[-1]) + 5) % 10)
        trap = {4: f"order no {digits(12)} of 2021-03-04" if i % 16 == 4 else f"a {refused} among words", 5: f"the total was 1,{digits(3)},{digits(3)}.50 in 2019", 6: f"isbn 978-3-16-{digits(6)}-0 is a book"}.get(k)
        base = f"Mail a{i}@mail.example.com, call +1 (555) 010-{i % 10000:04d}, card {card()}, host 10.{i % 255}.3.4."
        text = f"Some words here. {lead} {true[1]} and more words. Bye." if true else f"We saw {trap} and left it." if trap else base
        if true:
            a = text.index(true[1])
            want[i] = (true[0], a, a + len(true[1]))
        rows.append((i, text, "en", "a"))
    return docs(spark, rows), want


def test_added_spans_by_held_out_kinds(spark):
    frame, want = people(spark)
    got = {r["doc_id"]: r for r in pii.op13_pii(frame).collect()}
    added = {i: {tuple(x.split(":")) for x in r["spans"].split(",")} if r["n_added"] else set() for i, r in got.items()}
    hit = sum((k, str(a), str(b)) in added[i] for i, (k, a, b) in want.items())
    false = sum(r["n_added"] for i, r in got.items() if i not in want)
    assert hit >= 0.9 * len(want) and false <= 2, (hit, len(want), false)
    # the classifier of these texts on others
    other, truth = people(spark, 160, seed=12)
    model = pii.train(pii.found(frame))
    texts = {r["doc_id"]: r for r in pii.masked(other, model).collect()}
    assert sum(f"<{truth[i][0]}>" in texts[i]["text"] for i in truth) >= 0.9 * len(truth)
    assert all(r["n_masked"] == 0 for i, r in texts.items() if i % 8 in (4, 5, 6))
    base = next(r["text"] for i, r in texts.items() if i % 8 == 7)
    assert base == "Mail <email>, call <phone>, card <card>, host <ip>."


def test_pii_contract_and_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, "é a@b.co 1.2.3.4"), (3, "é a@b.co 1.2.3.4"), (None, "+12345678"), (4, "x" * 200_000 + " 4111 1111 1111 1111"), (5, "nothing at all")]
    frame = extra(docs(spark, [(i, t, "en", "a") for i, t in rows])).withColumn("spans", F.lit(1))
    got = pii.op13_pii(frame).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        spans = plain_base(text[r["doc_id"]] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == j for s in spans) for j in range(4)]
    assert pii.op13_pii(docs(spark, [])).count() == 0
    assert pii.masked(docs(spark, [(1, None, "en", "a"), (2, "mail a@b.co", "en", "a")]), pii.train(pii.found(docs(spark, [])))).orderBy("doc_id").collect() == [(1, None, 0), (2, "mail <email>", 1)]


def test_expectation_maximisation_finds_reliabilities():
    """Votes drawn from known rates: rates come back, and posteriors are right."""
    rng = np.random.default_rng(9)
    n, yes, no = 40_000, np.array([0.9, 0.75, 0.85, 0.7, 0.95, 0.6]), np.array([0.8, 0.9, 0.7, 0.85, 0.75, 0.9])
    truth = rng.random(n) < 0.3
    right = rng.random((n, 6)) < np.where(truth[:, None], yes, no)
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((n, 6)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    r = pii.reliabilities(patterns, np.zeros(len(patterns)), counts.astype(float))
    assert np.abs(r.yes - yes).max() < 0.05 and np.abs(r.no - no).max() < 0.05 and abs(r.prior - 0.3) < 0.03
    assert ((r.posterior(votes, np.zeros(n)) > 0.5) == truth).mean() > 0.9
