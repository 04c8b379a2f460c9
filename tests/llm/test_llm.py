"""Training-data operators against brute force, round trips, the library they follow, and odd inputs."""

import hashlib
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import bpe, chat_format, exact_dedup, html_extract, language_id, mixing, near_dedup, packing, quality_model, quality_rules
from tidewater.llm.runtime import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = bpe.tokenizer_path()


def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    return docs(spark, [(1, None, None, None), (2, "", "en", "a"), (None, "x", "en", "a"), (5, "same text", "en", None), (5, "same text", "en", None), (6, "same text", "fr", "b"), (7, "w " * 30_000, "en", "a"), (7, "other", "en", "a"), (8, "12 !!", "de", "b")])


def extra(df):
    """Columns whose names operators use themselves."""
    for c in ("row", "digest", "node", "set", "kept", "score", "lang_pred", "key", "weight", "host", "n"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


# 1 exact dedup


def test_exact_dedup(spark):
    got = exact_dedup.op1_exact_dedup(spark, extra(odd(spark))).collect()
    assert len(got) == 9 and sum(r["kept"] for r in got) == 6
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {2} and {r["group_size"] for r in empty} == {2}
    same = by[hashlib.sha256(b"same text").hexdigest()]
    assert [r["keep_id"] for r in same] == [6] * 3 and [r["doc_id"] for r in same if r["kept"]] == [6]
    assert exact_dedup.op1_exact_dedup(spark, odd(spark).limit(0)).count() == 0


def test_digest_index_persists(spark):
    path = scratch_path(spark, "index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(docs(spark, [(9, "a", "en", "s"), (3, "b", "en", "s")]), first).collect()
    first.close()
    again = exact_dedup.DigestIndex(spark, path, 4)
    batch = docs(spark, [(9, "a", "en", "s"), (3, "b", "en", "s")])
    assert all(r["kept"] for r in exact_dedup.exact_dedup(batch, again).collect())  # the same batch, run again
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, [(1, "a", "en", "s"), (2, "c", "en", "s"), (4, "c", "en", "s")]), again).collect()}
    assert got == {1: (9, False), 2: (4, False), 4: (4, True)} and again.read().count() == 3
    one = again.compacted(scratch_path(spark, "index"))
    assert {r["kept"] for r in exact_dedup.exact_dedup(batch, one, "next").collect()} == {False} and one.read().count() == 3


# 2 near-dedup


def near_rows(seed=1):
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = words(120, g)
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            rows.append((" ".join(copy)))
    rows += [" ".join(words(80, 100 + i)) for i in range(10)]
    return [(i, x, "en", "s") for i, x in enumerate(rows)]


def test_near_dedup_equals_brute_force(spark):
    rows = near_rows() + [(100, None, None, None), (101, "", "en", "s"), (102, "two words", "en", "s"), (103, "two words", "en", "s"), (104, "!!", "en", "s")]
    df = docs(spark, rows)
    idf = near_dedup.idf_table(df)
    sets = {i: near_dedup.weighted_shingles(t or "", idf) for i, t, *_ in rows}
    label = {i: i for i in sets}
    for i, t, *_ in rows:
        for j, u, *_ in rows:
            if i < j and ((t or "") == (u or "") or near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    got = near_dedup.near_dedup(extra(df)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == label
    assert {r["doc_id"] for r in got if r["kept"]} == set(label.values())


def test_near_dedup_recall(spark):
    """Links of all pairs of sf0.01's documents, by brute force over shingles."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    idf, texts = near_dedup.idf_table(df), {r["doc_id"]: r["text"] or "" for r in df.collect()}
    first: dict[str, int] = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    sets = {i: near_dedup.weighted_shingles(t, idf) for t, i in first.items()}
    holders: dict[int, list[int]] = {}
    for i, (shingles, _) in sets.items():
        for x in shingles.tolist():
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    links = [(a, b) for a, b in pairs if near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(df).collect()}
    assert len(links) > 3 and sum(of[a] == of[b] for a, b in links) >= 0.95 * len(links)


def test_near_dedup_odd(spark):
    got = near_dedup.near_dedup(odd(spark)).collect()
    assert len(got) == 9 and sum(r["kept"] for r in got) == 6
    assert near_dedup.near_dedup(odd(spark).limit(0)).count() == 0


def test_samples_agree_like_weighted_jaccard():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 62, 400, dtype=np.uint64) for _ in range(2))
    x, y = np.sort(np.r_[a[:300], b[:100]]), np.sort(np.r_[a[:300], b[100:200]])
    wx, wy = np.full(400, 2.0), np.full(400, 2.0)
    wanted = near_dedup.weighted_jaccard((x, wx), (y, wy))
    hits = [np.mean(s[0] == s[1]) for s in (near_dedup.Sampler(k).samples(np.r_[x, y], np.log(np.r_[wx, wy]), np.array([0, 400])) for k in range(20))]
    assert abs(wanted - 0.6) < 1e-9 and abs(np.mean(hits) - wanted) < 0.05


# 3 html


def test_html(spark):
    page = lambda s: f"<html><head><title>T</title></head><body><div>Menu</div><div>{s}</div><div>Foot &amp; more</div></body>"
    rows = [(1, "http://a.com/x/1", page("Story <b>one</b><br>goes on")), (2, "http://a.com/x/2", page("Story two")), (3, "http://b.com/1", "<article><h1>H</h1><p>P&eacute;</p><aside>no</aside><div class='comments'>c</div></article><p>out</p>"), (4, None, None), (5, "x", ""), (2, "http://a.com/x/2", page("Story two"))]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.html_extract(extra(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()]
    assert sorted(got) == [(1, "Story one goes on", 17), (2, "Story two", 9), (2, "Story two", 9), (3, "H\n\nPé", 5), (4, "", 0), (5, "", 0)]
    assert html_extract.html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_runs_of_copies(spark):
    page = lambda s: f"<body><div>Menu</div><div>{s}</div><div>Foot</div></body>"
    one = [(i, f"http://a.com/x?v={i}", page("one")) for i in range(40)]  # a path, crawled often
    far = [(100 + i, f"http://a.com/y/{i:02d}", page("far")) for i in range(40)]  # paths with the same lines
    rest = [(200, "http://a.com/w", page("two")), (201, "http://a.com/x?v=a", page("other")), (300, "http://b.com/1", page("alone")), (301, "http://b.com/2", page("alone"))]
    for rows in (one + rest[:1], one + far + rest):
        got = {r["page_id"]: r["text"] for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: x.split("<div>")[2].split("<")[0] if i < 300 else "Menu\n\nalone\n\nFoot" for i, _, x in rows}


def main(page):
    lines, parts, _ = html_extract.lines_of(page)
    return html_extract.main_text(lines, parts)


def test_html_markup_that_decides():
    assert main("<article><section id='discussion'><p>Our results show.</p></section><div class='search-results'>Hits</div><p class='related-work'>Others</p><label>Fig. 1</label></article>") == "Our results show.\n\nHits\n\nOthers\n\nFig. 1"
    assert main("<main><article><p>Text</p><article><p>nested</p></article></article><article class='comment'><p>user</p></article></main>") == "Text"
    assert main("<body><article><p>A</p><div class='ad x'>buy</div><div data-class='ad'>kept</div><div hidden>no</div><div role='search'>no</div><p>B</p></article><div>out</div>") == "A\n\nkept\n\nB"
    assert main("<p>" + "long &amp; " * 50_000 + "</p><form>f</form>").count("long &") == 50_000


def test_alignment_decides_inside_articles(spark):
    page = lambda s, more="": f"<article><h1>{s} head</h1><div class='tools'>Print this page</div><p>{s} text</p><p>quoted passage</p>{more}<div class='body'>{s} end</div></article>"
    rows = [(i, f"http://a.com/{i}", page(f"story{i}")) for i in range(6)]
    rows += [(20, "http://b.com/1", page("one")), (21, "http://b.com/2", page("one", "<p>added</p>"))]  # copies of one article
    got = {r["page_id"]: r["text"] for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story{i} head\n\nstory{i} text\n\nquoted passage\n\nstory{i} end" for i in range(6)), got[0]
    assert got[20] == "one head\n\nPrint this page\n\none text\n\nquoted passage\n\none end"


def brute_html(rows):
    """Texts by pairing and alignment written plainly."""
    found = {}
    for i, url, page in rows:
        key = hashlib.md5("\x00".join([str(i), url, page]).encode()).digest()
        found[key] = (url.split("/")[2], "/" + url.split("/", 3)[3].split("?")[0], *html_extract.lines_of(page))
    groups = {}
    for key, (host, path, lines, *_) in found.items():
        groups.setdefault((host, path, tuple(lines)), []).append(key)
    order = sorted((host, path, min(keys), lines) for (host, path, lines), keys in groups.items())
    common = lambda x, y: len(__import__("os").path.commonprefix([x, y]))
    out = {}
    for at, (host, path, _, lines) in enumerate(order):
        others = [next((x for x in side if x[0] != host or x[3] != lines), None) for side in (order[:at][::-1], order[at + 1 :])]
        others = [x for x in others if x and x[0] == host]
        partner = max(others, key=lambda x: common(x[1], path)) if others else None
        for key in groups[host, path, lines]:
            _, _, texts, parts, kinds = found[key]
            gone = set()
            if partner:
                other = found[partner[2]]
                t = [[0] * (len(other[2]) + 1) for _ in range(len(texts) + 1)]
                for i in range(len(texts)):
                    for j in range(len(other[2])):
                        t[i + 1][j + 1] = t[i][j] + 1 if texts[i] == other[2][j] else max(t[i][j + 1], t[i + 1][j])
                i, j = len(texts), len(other[2])
                while i and j:
                    if texts[i - 1] == other[2][j - 1] and t[i][j] == t[i - 1][j - 1] + 1:
                        i, j = i - 1, j - 1
                        gone |= {i} if parts[i] == html_extract.PLAIN else set()
                    elif t[i - 1][j] >= t[i][j - 1]:
                        i -= 1
                    else:
                        j -= 1
            out[key] = "\n\n".join(x for i, x in enumerate(texts) if parts[i] == html_extract.PLAIN and i not in gone)
    return out


def test_html_equals_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(150):
        host = rng.choice(["a.com", "b.org", "c.net"])
        blocks = [f"menu {host} {k}" for k in range(4)] + [f"text {rng.randrange(40)}" for _ in range(rng.randrange(1, 4))] + [f"foot {host}"]
        rows.append((i, f"http://{host}/{rng.choice(['x', 'xy', 'z'])}/{rng.randrange(12)}?q={i}", "<body>" + "".join(f"<div>{x}</div>" for x in dict.fromkeys(blocks))))
    got = {hashlib.md5("\x00".join([str(i), u, h]).encode()).digest(): t for (i, u, h), t in zip(rows, [r["text"] for r in sorted(html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["page_id"])], strict=True)}
    want = brute_html(rows)
    assert got == want and sum("menu" in x for x in want.values()) < 10


def test_alignment_is_longest(monkeypatch):
    rng = random.Random(1)
    for bits in (1 << 28, 16):
        monkeypatch.setattr(html_extract, "ALIGN_BITS", bits)
        for _ in range(300):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
            t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
            pairs = html_extract.shared_lines(a, b)
            assert len(pairs) == t[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


# 4 mixing


def test_fit_equals_numpy_raking(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(1, 1000, (5, 3, 4)).astype(float)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(5) for j in range(3) for k in range(4)], "source string, lang string, topic string, tokens long")
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] * r["tokens"] for r in mixing.fit_weights(cells, lang_targets={"l0": 0.5, "l1": 0.3, "l2": 0.2}).collect()}
    smooth = lambda v: v**0.7 / (v**0.7).sum()
    want = [smooth(n.sum((1, 2))), np.array([0.5, 0.3, 0.2]), smooth(n.sum((0, 1)))]
    m = n.copy()
    for _ in range(500):
        for axis, w in enumerate(want):
            shape = [1, 1, 1]
            shape[axis] = -1
            m *= (w * n.sum() / m.sum(tuple(x for x in range(3) if x != axis))).reshape(shape)
    assert all(abs(got[f"s{i}", f"l{j}", f"t{k}"] - m[i, j, k]) < 1e-3 * m[i, j, k] for i in range(5) for j in range(3) for k in range(4))


def test_weights_hold_where_cells_are_full(spark):
    rng = np.random.default_rng(5)
    n = (10 ** rng.uniform(2, 5, (6, 3, 4))).astype(int)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(6) for j in range(3) for k in range(4)], "source string, lang string, topic string, tokens long")
    for share in (0.3, 0.8):
        fitted = mixing.fit_weights(cells, keep_share=share).collect()
        p = [min(1.0, share * r["weight"]) for r in fitted]
        assert share < 0.5 or max(p) == 1 > min(p)
        kept = sum(r["tokens"] * x for r, x in zip(fitted, p, strict=True))
        assert max(r["weight"] for r in fitted) <= 1 / share + 1e-9
        assert abs(mixing.scale_for(spark.createDataFrame(fitted), share * int(n.sum())) - share) < 1e-3
        assert abs(kept / n.sum() - share) < 1e-3
        for at, axes in (("source", (1, 2)), ("lang", (0, 2)), ("topic", (0, 1))):
            held = {f"{at[0]}{i}": float(v) for i, v in enumerate(n.sum(axes))}
            want = mixing.within(mixing.smoothed(held, 0.7), held, share * n.sum())
            assert abs(sum(want.values()) / n.sum() - share) < 1e-9
            for k, w in want.items():
                assert abs(sum(r["tokens"] * x for r, x in zip(fitted, p, strict=True) if r[at] == k) - w) < 1e-3 * n.sum(), (share, k)


def test_scale_meets_budget(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(1, 500), rng.random() * 5 + 0.01) for _ in range(200)]
    cells, total = spark.createDataFrame(rows, "tokens long, weight double"), sum(t for t, _ in rows)
    for share in (0.1, 0.5, 0.9):
        k = mixing.scale_for(cells, share * total)
        assert abs(sum(t * min(1, k * w) for t, w in rows) / total - share) < 1e-3


def test_mixing_odd(spark):
    got = mixing.mix(extra(odd(spark))).collect()
    assert len(got) == 9 and all(r["probability"] == 0 for r in got if not r["n_tokens"]) and all(0 <= r["probability"] <= 1 for r in got)
    assert mixing.mix(odd(spark).limit(0)).count() == 0


# 5 packing


def test_packing_is_lossless_and_fits(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng.choice([0, 3, 40, 900]), i)), "en", "s") for i in range(40)] + [(99, None, "en", "s")]
    path = bpe.tokenizer_path("byte_bpe_50k.tiktoken")
    got = packing.pack(docs(spark, rows), path, length=256, shard_chars=20_000).collect()
    parts: dict = {}
    for r in got:
        ids, pos, cuts = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["position_ids"], "<i4"), r["cu_seqlens"]
        assert len(ids) == len(pos) == r["n_tokens"] == cuts[-1] <= 256
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], cuts, cuts[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[d, p] = ids[a:b].tolist()
    whole = bpe.ByteBPE(open(PATH, "rb").read()).encode([t or "" for _, t, *_ in rows])
    for (i, *_), ids in zip(rows, whole, strict=True):
        assert sum((parts[k] for k in sorted(k for k in parts if k[0] == i)), []) == ids.tolist()
    assert len({r["shard"] for r in got}) > 1


def test_best_fit_equals_brute_force():
    rng = random.Random(9)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 33) for _ in range(60)), reverse=True)
        rooms: list[int] = []
        for s in sizes:
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(32 - s)
        rows = packing.best_fit(sizes, 32)
        assert sorted(32 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms) and sorted(i for r in rows for i in r) == list(range(60))


def test_write_matrix(spark, tmp_path):
    path = bpe.tokenizer_path("byte_bpe_50k.tiktoken")
    packing.write_matrix(packing.pack(docs(spark, [(1, "hello world", "en", "s")]), path, 8), str(tmp_path / "m"), 8, pad=7)
    r = spark.read.parquet(str(tmp_path / "m")).first()
    assert np.frombuffer(r["ids"], "<i4").tolist()[r["n_tokens"] :] == [7] * (8 - r["n_tokens"])


def test_packing_odd(spark):
    path = bpe.tokenizer_path("byte_bpe_50k.tiktoken")
    rows = packing.pack(extra(odd(spark)), path, length=64).collect()
    parts = [(d, p) for r in rows for d, p in zip(r["doc_ids"], r["pieces"], strict=True)]
    assert parts.count((5, 0)) == 2 and parts.count((None, 0)) == 1 and not any(d in (1, 2) for d, _ in parts)
    assert sum(1 for d, _ in parts if d == 7) > 400 and packing.pack(odd(spark).limit(0), path).count() == 0
    same = [(None, f"text number {i} " * 30, "en", "s") for i in range(60)]
    assert len({r["shard"] for r in packing.pack(docs(spark, same), path, 64, shard_chars=2_000).collect()}) > 5


# 6 quality model


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, f"h{rng.randrange(5)}", rng.choice(["p", "q", None]), rng.gauss(0, 2)) for i in range(400)]
    got = {r["doc_id"]: r for r in quality_model.hierarchical(spark.createDataFrame(rows, "doc_id long, host string, path string, logit double"), 0.4).collect()}
    p = {i: 1 / (1 + math.exp(-x)) for i, _, _, x in rows}
    mean = (sum(p.values()) + 0.4) / (len(rows) + 1)

    def strength(sites):  # (documents, mean, mean above)
        n, k = sum(x[0] for x in sites), len(sites)
        chance = [g * (1 - g) for _, _, g in sites]
        between = (sum(m * (r - g) ** 2 for m, r, g in sites) - sum(chance) * (k - 1) / k) / (n - sum(x[0] ** 2 for x in sites) / n)
        return min(max(sum(chance) / k / between - 1, 2.0), 1000.0) if between > 0 else 1000.0

    groups = lambda key: {k: [p[r[0]] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, sites = groups(lambda r: r[1]), groups(lambda r: r[1:3])
    k = strength([(len(v), sum(v) / len(v), mean) for v in hosts.values()])
    host_rate = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    m = strength([(len(v), sum(v) / len(v), host_rate[s[0]]) for s, v in sites.items()])
    for i, h, path, x in rows:
        v = sites[h, path]
        rate = (sum(v) - p[i] + m * host_rate[h]) / (len(v) - 1 + m)
        score = 1 / (1 + math.exp(-(x - math.log(0.4 / 0.6) + math.log(rate / (1 - rate)))))
        assert abs(got[i]["host_rate"] - host_rate[h]) < 1e-9 and abs(got[i]["path_rate"] - rate) < 1e-9 and abs(got[i]["score"] - score) < 1e-9


def test_quality_odd_columns_and_held_out(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 != 1"), labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1")
    got = quality_model.quality_model(df.withColumn("h", F.lit(1)).withColumn("y", F.lit(2)).withColumn("id", F.lit(3)), train).join(rest, "doc_id")
    assert got.select(F.avg((F.col("kept") == (F.col("quality") > 0)).cast("int"))).first()[0] > 0.85


def test_quality_model(spark):
    good = [(i, " ".join(f"word{j % 50 + i}" for j in range(120)) + ".", "en", f"s{i % 3}") for i in range(60)]
    bad = [(100 + i, "BUY!! $$$ NOW!! " * 40, "en", f"s{i % 3}") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_model.quality_model(docs(spark, good + bad), labels).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(30))
    assert len(quality_model.quality_model(odd(spark), labels.limit(0)).collect()) == 9
    assert quality_model.quality_model(odd(spark).limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "big", "p", 2.0) for i in range(300)] + [(400, "tiny", "p", -2.0), (401, "bad", "p", 2.0)] + [(500 + i, "bad", "p", -3.0) for i in range(300)]
    got = {r["doc_id"]: r for r in quality_model.hierarchical(spark.createDataFrame(rows, "doc_id long, host string, path string, logit double"), 0.5).collect()}
    assert got[401]["path_rate"] < got[400]["path_rate"] < got[0]["path_rate"] and got[401]["score"] < got[0]["score"]


# 7 quality rules


def brute_rules(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "a a a a", "a b c\na b c\n\n \n", "x\x0by\x0cz  q", "é日 # $"] + [" ".join(rng.choice("abcde") for _ in range(rng.randrange(200))) for _ in range(40)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 2}") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(extra(docs(spark, rows)).drop("host")).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][m] for m in quality_rules.METRICS) == brute_rules(t), (i, t)
    assert quality_rules.quality_rules(odd(spark).limit(0)).count() == 0


def test_bad_host_is_refused(spark):
    ok, short = " ".join(words(60, 1)), "too short"
    rows = [(i, short if i % 10 else ok, "en", "bad") for i in range(300)] + [(1000 + i, ok if i % 10 else short, "en", f"h{i % 5}") for i in range(300)] + [(2000, ok, "en", "one")]
    got = {r["doc_id"]: (r["host_refused"], r["kept"]) for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert got[0] == (True, False) and got[1001] == (False, True) and got[2000] == (False, True)


def test_every_rule_refuses_a_host(spark):
    text = lambda i: " ".join(words(60, i))
    fails = {"symbols": lambda i: text(i) + " " + "# $ % | " * 10, "dup_lines": lambda i: "\n".join([text(i), *["again"] * 7]), "word_length": lambda i: " ".join(x * 4 for x in words(60, i))}
    rows = [(1000 * k + i, fail(i), "en", rule) for k, (rule, fail) in enumerate(fails.items()) for i in range(200)] + [(9000 + i, text(i), "en", f"h{i % 3}") for i in range(600)]
    got = quality_rules.quality_rules(docs(spark, rows)).collect()
    for r in got:
        assert not r["base_failed"] and all(r[f"fail_{x}"] == (x == r["host"]) for x in quality_rules.RULES)
        assert (r["host_refused"], r["kept"]) == ((True, False) if r["host"] in fails else (False, True)), r
    assert len(got) == 1200
    duckdb = pytest.importorskip("duckdb").connect()
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[3] for r in rows]})
    duckdb.register("documents", documents)
    expected = duckdb.execute(f"SELECT * FROM ({quality_rules.ORACLE}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in quality_rules.op7_quality_rules(docs(spark, rows)).orderBy("doc_id").collect()] == expected


# 8 language


def test_phrases_equal_brute_force():
    train = {"en": ["the cat sat on the mat"], "de": ["die katze saß auf der matte"]}
    model = language_id.fit(train)
    texts = ["the mat", "katze auf", "zzz", "", "12", "The CAT, die Katze! " * 3]
    data, sizes = language_id.normalised(texts)
    got, at = model.phrases(data, sizes), 0
    for t, size in enumerate(sizes):
        piece = bytes(data[at : at + size])
        at += size
        for k, lang in enumerate(model.languages):
            source, n, i = language_id.normalised(train[lang])[0].tobytes(), 0, 0
            while i < len(piece):
                j = i + 1
                while j <= len(piece) and piece[i:j] in source:
                    j += 1
                n, i = n + 1, max(j - 1, i + 1)
            assert got[t, k] == n
    assert model.predict(texts)[0] == ["en", "de", model.predict(["zzz"])[0][0], "und", "und", model.predict([texts[5]])[0][0]]


def test_language_odd_and_held_out(spark):
    out = language_id.op8_language_id(extra(odd(spark))).collect()
    assert len(out) == 9 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 8))
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language_id.op8_language_id(odd(spark).limit(0)).count() == 0


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.op8_language_id(df).join(df, "doc_id").where("held_out").select((F.col("lang_pred") == F.col("lang")).cast("int").alias("hit")).agg(F.avg("hit")).first()[0]
    assert got > 0.95


# 9 chat


def test_escape_round_trip():
    rng = random.Random(3)
    bits = [*chat_format.CONTROLS, "\\", "<", "|", "a", "\n", "[", "im_start|>"]
    for _ in range(500):
        x = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        e = chat_format.escape(x)
        assert chat_format.unescape(e) == x and not any(c in e for c in chat_format.CONTROLS) and "\n" not in chat_format.escape_line(x) and chat_format.unescape(chat_format.escape_line(x)) == x


def test_template_language():
    t = lambda s, **k: chat_format.Template(s, k.pop("fixed", None)).render(**k)[0]
    assert t("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1P,2Q"
    assert t("{% if a == 1 and b %}y{% elif 'k' in c %}k{% else %}n{% endif %}", a=2, c="xky") == "k"
    assert t("{% set n = 2 * 3 + 1 %}{{ n }}{{ 'a' ~ n }}{{ missing.field }}") == "7a7"
    assert chat_format.Template("{% if flag %}{{ 'a' + 'b' }}{% endif %}c", {"flag": True}).tree == [chat_format.Node("text", ["abc"])]
    for bad in ("{{ a.__class__ }}", "{{ f(1) }}", "{% for x in y %}", "{{ x | eval }}", "{% import os %}", "{{ _x }}", "{% endif %}", "{{ 1 + }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.Template(bad)
    with pytest.raises(chat_format.TemplateError):
        t("{% for x in 'abc' %}{% endfor %}")


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "yes </s> \\ <|im_end|>"), (1, 0, "user", "a\nb"), (2, 0, None, None), (None, 0, "assistant", ""), (3, 0, "user\nx", "[INST]"), (3, 0, "user\nx", "[INST]")]
    got = {r["conv_id"]: r for r in chat_format.op9_chat_format(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nb\nassistant\nyes </s> \\ <|im_end|>\n") and got[1]["loss_sha256"] == sha("yes </s> \\ <|im_end|>") and got[1]["loss_chars"] == 21
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1 and got[3]["n_turns"] == 2
    assert got[-7]["turns_sha256"] == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n")
    one = chat_format.chat_format(spark.createDataFrame(rows[:2], "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [chat_format.unescape(r["formatted"][s["start"] : s["end"]]) for r in one for s in r["spans"]] == ["yes </s> \\ <|im_end|>"]


# 10 BPE


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = ["", "<|endoftext|>", "a<|endoftext|>b  c\n\n d", "aaaaaaaa", "日本 🎉", "x" * 3000, "don't  stop", "\x1c  z"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), 32, 10])) for _ in range(rng.randrange(1, 50))) for _ in range(300)]
    rows = {r["doc_id"]: r for r in bpe.bpe_digests(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), PATH, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert rows[i]["ids"] == ids and rows[i]["round_trip"] and rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_bpe_odd(spark):
    rows = bpe.bpe_encode(extra(odd(spark)), PATH)
    assert rows.count() == 9
    back = {(r["doc_id"], r["text"]) for r in bpe.bpe_decode(rows, PATH).collect()}
    assert (1, "") in back and (7, "w " * 30_000) in back and bpe.bpe_encode(odd(spark).limit(0), PATH).count() == 0


def test_bpe_needs_its_kind_of_file():
    with pytest.raises(ValueError):
        bpe.ByteBPE(json.dumps({"normalizer": {"type": "Lowercase"}, "model": {"type": "BPE"}, "pre_tokenizer": None}).encode())


# pipeline


def test_stages_handle_odd_rows(spark):
    rows = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), "").count() == 0, name
        out = stage(spark, extra(rows), "")
        if name != "bpe":
            assert out.columns == extra(rows).columns, name
        found = out.count()
        assert found == {"language_id": 6, "exact_dedup": 6, "near_dedup": 6, "bpe": 9}.get(name, found), name


def test_pipeline_keeps_one_of_each(spark, tmp_path):
    rows = near_rows() + [(200, near_rows()[0][1], "en", "s"), (201, "123 456", "en", "s")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 201 not in out and not {0, 200} <= out and len(out) <= 36 and math.isfinite(len(out))


def test_exact_dedup_meets_a_filled_index(spark):
    """Copies in every batch of op1: the later batches' are dropped by the index."""
    rows = [(i, f"text {i % 7}", "en", "a") for i in range(60)] + [(None, "text 3", "en", "a"), (None, None, "en", "a"), (59, "text 3", "en", "a")]
    got = exact_dedup.op1_exact_dedup(spark, docs(spark, rows)).collect()
    sizes = {}
    for _, t, *_ in rows:
        sizes.setdefault(t or "", []).append(_)
    for r in got:
        text = next(t or "" for t in {t for _, t, *_ in rows} if hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"])
        ids = [i for i, t, *_ in rows if (t or "") == text]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 8
    assert {r["doc_id"] for r in got if r["kept"]} == {r["keep_id"] for r in got}


def test_pipeline_equals_its_stages_one_by_one(spark, tmp_path):
    """The documents that brute-force stages keep, up to near-dedup; mixing draws from them; all are encoded."""
    rng = random.Random(17)
    letters = {"en": "the of and to in is that it was for", "de": "der die und das ist nicht ein mit auf sich"}
    text = lambda lang, n: " ".join(rng.choice(letters[lang].split()) + str(rng.randrange(99)) for _ in range(n))
    rows = [(i, text(("en", "de")[i % 2], 60), ("en", "de")[i % 2], "ab"[i % 2]) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "a") for i in range(5)]  # exact copies: the larger id stays
    rows += [(200 + i, rows[10 + i][1] + " end", "en", "b") for i in range(5)]  # near copies: the least id stays
    rows += [(300, None, "en", "a"), (301, "12 34 !!", "en", "a"), (302, "", "de", "b")]  # no letters
    path = str(tmp_path / "sf")
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    want = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)} - set(range(5)) - set(range(200, 205))
    stages = dict(corpus_pipeline.STAGES)
    now = docs(spark, rows)
    for name in ("language_id", "exact_dedup", "near_dedup"):
        now = stages[name](spark, now, path)
    kept = {r["doc_id"]: r["lang"] for r in now.collect()}
    assert set(kept) == want and all(kept[i] == ("en", "de")[i % 2] for i in kept if i < 40)
    mixed = {r["doc_id"] for r in stages["mixing"](spark, now, path).collect()}
    out = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in out} == mixed <= want and len(mixed) >= 0.6 * len(want)
    by = {i: t for i, t, *_ in rows}
    assert all(r["decoded_sha256"] == hashlib.sha256(by[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] > 0 for r in out)
    empty = str(tmp_path / "none")
    docs(spark, []).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_chat_odd_inputs(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = chat_format.op9_chat_format(spark, spark.createDataFrame([], schema)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in empty] == [(-7, 2)]
    long = "word [INST] \\ " * 40_000
    rows = [(1, 1, "assistant", long), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", ""), (3, None, "assistant", "b"), (3, None, "assistant", "a")]
    frame = spark.createDataFrame(rows, schema)
    for c in ("n_turns", "loss_chars", "position", "spans", "formatted"):
        frame = frame.withColumn(c, F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.op9_chat_format(spark, frame).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest([("user", ""), ("assistant", long)]) and got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert got[2]["n_turns"] == 2 and got[2]["turns_sha256"] == digest([("", "x")] * 2)
    assert got[3]["turns_sha256"] == digest([("assistant", "a"), ("assistant", "b")]) and got[3]["loss_chars"] == 2
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0 and set(got) == {1, 2, 3, None, -7}


def test_quality_rules_odd_inputs(spark):
    """Repeated rows and a very long text."""
    long = "a word more " * 40_000
    got = quality_rules.op7_quality_rules(docs(spark, [(1, long, "en", "a"), (1, long, "en", "a"), (2, "x " * 60, "en", "a"), (3, None, "en", "b")])).collect()
    assert len(got) == 4
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(tuple(r))
    assert by[1][0] == by[1][1] and next(r for r in got if r["doc_id"] == 1)["n_words"] == 120_000
    assert next(r for r in got if r["doc_id"] == 1)["n_repeat_words"] == 120_000 and next(r for r in got if r["doc_id"] == 3)["base_failed"]


def test_pairs_are_compared_in_bounded_slices():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 0, 500, 5, 5, 5, 90)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts), pa.array(texts[::-1])], ["a", "ta", "tb"])
    got = list(near_dedup._parts(iter([batch, batch.slice(0, 0)]), 120))
    assert [x for part in got for x in part.column("a").to_pylist()] == list(range(8))
    size = lambda part: sum(len(x or "") for k in ("ta", "tb") for x in part.column(k).to_pylist())
    assert all(size(p) <= 120 or p.num_rows == 1 for p in got)
