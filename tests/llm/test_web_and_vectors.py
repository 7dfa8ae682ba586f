import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import ann, url_filter, warc
from tidemark.llm.common import new_folder
from tidemark.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, rule string, score double, host int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)


# --- WARC ----------------------------------------------------------------------------------------


def expected(rows, least=0):
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault((html or "").encode(), i)
    out = {}
    for i, _, html in rows:
        data = (html or "").encode()
        other = first[data] if len(data) >= least and first[data] != i else None
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if other is None else "revisit", other)
    return out


ROWS = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, None), (5, "", ""), (4, "http://c/", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "z" * 300_000), (7, "http://d/", "same")]


@pytest.mark.parametrize("least", [0, 3])
def test_archives_read_back(spark, least):
    folder = new_folder(spark, "warc")
    index = warc.write(pages(spark, ROWS), folder, least_bytes=least, frame_bytes=500, bundle_bytes=2000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.scan(spark, folder).collect()}
    assert got == expected(ROWS, least)
    texts = {i: (html or "").encode() for i, _, html in ROWS}
    for r in index.collect():  # random access by the index
        page_id, url, *_, kind, refers_to, payload = warc.read_record(f"{folder}/bundles", r.bundle, r.frame, r.offset)
        assert page_id == r.page_id
        assert payload == (texts[page_id] if kind == "response" else b"")


def test_frames_are_independent_and_plain_readers_pass(spark):
    import glob

    folder = new_folder(spark, "warc")
    warc.write(pages(spark, ROWS), folder, frame_bytes=200)
    for name in glob.glob(f"{folder.removeprefix('file://')}/bundles/*.zst"):
        with open(name, "rb") as file:
            data = file.read()
        frames = warc.frames_of(pa.BufferReader(data))
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[s : s + c], max_output_size=p) for s, c, p in frames)
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
            assert stream.read() == plain
        assert plain.startswith(b"WARC/1.1\r\n")


def test_no_pages(spark):
    folder = new_folder(spark, "warc")
    assert warc.write(pages(spark, []), folder).collect() == []
    assert warc.scan(spark, folder).collect() == []


def test_repeated_and_unnamed_pages(spark):
    folder = new_folder(spark, "warc")
    warc.write(pages(spark, [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "y")]), folder)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.scan(spark, folder).collect())
    assert got == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_registered_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op5_warc"](spark, SF).collect()}
    assert got == expected(rows)


# --- URL filter ----------------------------------------------------------------------------------


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def rule_by_hand(host, path):
    fits = [r for r in URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = ["https://m.example.org/" + "a/1-" * 50_000 + "?" + "x=1&" * 10_000, None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x", "http://net", "http://net/", "http://a.net?x", "https://a.b.example.net/en/1#f", "https://example.net/de/", "x://y.org/fr/://z", "http://notnet/", "http://example.com/de", "http://www.example.com/de/?a=1&b=2", "http://Ünï.ORG/fr/é\nx", "ftp://example.org#frag/fr/", "a" * 5000 + "://b.net/"]


def test_parts_and_rules_equal_brute_force(spark):
    rows = list(enumerate(URLS)) + [(99, "http://net/"), (99, "http://net/")]
    got = url_filter.judge(pages(spark, [(i, u, None) for i, u in rows]), URL_RULES).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        host, path = parts_by_hand(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule_by_hand(host, path))
        assert r.verdict == (URL_RULES[r.rule] if r.rule else "block" if r.score > 0.5 else "allow")


def test_trees_learn_and_their_expression_agrees(spark):
    rng = random.Random(5)
    rows = [(f"http://{'win-' * (i % 2)}{rng.choice('abc')}{i}.example.com/{'1' * rng.randint(1, 6)}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.Filter(labelled.filter("substring(url, -1) = '1'"))
    scored = model.score(labelled).collect()
    assert np.mean([(r.score > 0.5) == r.label for r in scored]) > 0.97
    base, trees = model.model
    for r in scored[:50]:
        x = tuple(getattr(r, f) for f in url_filter.FEATURES)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(base + sum(url_filter._value(t, x) for t in trees)))))


def test_one_domain_gets_both_verdicts(spark):
    """Lexical features turn verdicts; the rate of a suffix alone does not decide."""
    rng = random.Random(8)
    def url(domain, bad, i):
        return f"http://{rng.choice('abc')}.{domain}/" + (f"{rng.randrange(10**8, 10**9)}/x/y?a=1&b={i}" if bad else f"{rng.choice(['news', 'about', 'home'])}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}")
    labelled = [(url(d, i % 10 < share, i), int(i % 10 < share)) for d, share in (("one.com", 8), ("two.org", 2), ("three.net", 5)) for i in range(300)]
    fresh = [(i, url(d, i % 2 == 0, i), None) for i, d in enumerate(["one.com", "two.org", "three.net", "new.edu"] * 10 + ["one.com"])]
    judged = url_filter.judge(pages(spark, fresh), {"nowhere.example/": "block"}, spark.createDataFrame(labelled, "url string, label int")).collect()
    assert {r.page_id: r.verdict for r in judged} == {i: "block" if i % 2 == 0 else "allow" for i, *_ in fresh}


def tree_by_hand(examples, gradients, members, depth, allowed):
    """The best split among all midpoints of all allowed features, by direct sums."""
    g, h = (sum(gradients[i][k] for i in members) for k in (0, 1))
    best, gain = None, 1e-6
    for f in allowed if depth and len(members) > 1 else ():
        values = sorted({x[f] for x, _, _ in examples})
        for a, b in zip(values, values[1:], strict=False):
            left = [i for i in members if examples[i][0][f] <= (a + b) / 2]
            gl, hl = (sum(gradients[i][k] for i in left) for k in (0, 1))
            new = gl**2 / (hl + url_filter.LAMBDA) + (g - gl) ** 2 / (h - hl + url_filter.LAMBDA) - g**2 / (h + url_filter.LAMBDA)
            if min(hl, h - hl) >= 1e-3 and new > gain + 1e-12:
                best, gain = (f, (a + b) / 2, left), new
    if best is None:
        return -url_filter.RATE * g / (h + url_filter.LAMBDA)
    f, edge, left = best
    return (f, edge, *(tree_by_hand(examples, gradients, side, depth - 1, allowed) for side in (left, [i for i in members if i not in left])))


def flat(tree):
    return [tree] if not isinstance(tree, tuple) else [tree[0], tree[1], *flat(tree[2]), *flat(tree[3])]


def test_trees_equal_brute_force():
    rng = random.Random(2)
    examples = [(tuple(float(rng.randrange(6)) for _ in range(4)), n := rng.randint(1, 9), rng.randint(0, n)) for _ in range(60)]
    base, trees = url_filter.boost(examples)
    scores = [base] * len(examples)
    for number, tree in enumerate(trees):
        p = [1 / (1 + np.exp(-s)) for s in scores]
        gradients = [(n * q - k, n * q * (1 - q)) for q, (_, n, k) in zip(p, examples, strict=True)]
        assert flat(tree) == pytest.approx(flat(tree_by_hand(examples, gradients, range(len(examples)), url_filter.DEPTH, url_filter.seen(number, 4))))
        scores = [s + url_filter._value(tree, x) for s, (x, _, _) in zip(scores, examples, strict=True)]


def test_no_labels_no_rows_no_python(spark):
    judged = url_filter.judge(pages(spark, [(1, "http://a.com/", None)]), URL_RULES)
    assert [(r.score, r.verdict) for r in judged.collect()] == [(0.5, "allow")]
    assert url_filter.judge(pages(spark, []), URL_RULES).collect() == []
    plan = QUERIES["op9_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_entropy(spark):
    rows = spark.createDataFrame([("aaaa",), ("abab",), ("abcd",), ("",)], "t string").select(url_filter.entropy(F.col("t")).alias("e")).collect()
    assert [r.e for r in rows] == [0.0, 1.0, 2.0, 0.0]


# --- nearest neighbours --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def exact(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]]
        out[ids[i]] = [(int(ids[j]), float(s[j])) for j in order[:k]]
    return out


def test_recall_of_the_registered_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.array(rows.embedding.tolist(), dtype=np.float64)
    truth = exact(rows.vec_id.to_numpy(), x)
    got = {}
    for r in QUERIES["op10_neighbours"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert got.keys() == truth.keys()
    assert all([r for *_, r in g] == list(range(1, 21)) for g in got.values())
    assert np.mean([len({v for v, *_ in got[q]} & {v for v, _ in truth[q]}) / 20 for q in truth]) >= 0.95
    place = {v: i for i, v in enumerate(rows.vec_id)}
    for q, g in got.items():
        for v, s, _ in g:
            assert s == pytest.approx(x[place[q]] @ x[place[v]], abs=1e-12)


def test_few_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [None, 1.0, 1.0]), (8, [-1.0, 0.0, 0.5]), (20, [0.0, 0.0, 0.0]), (40, [0.0, 2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (60, [])]
    df = spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], VECTORS)
    got = [tuple(r) for r in ann.search(df, queries=F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 40, 0.0), (0, 5, 8, -1.0)]
    assert {g[0] for g in got} == {0, 40}
    assert ann.search(df.limit(0), queries=F.col("vec_id") % 20 == 0).collect() == []


def test_the_commonest_length_takes_part(spark):
    """Neither one odd vector nor its id decides; many lists of a query are merged in several steps."""
    rng = np.random.default_rng(1)
    x = rng.integers(-32, 33, (200, 4)) / 16.0
    odd = [(i, [1.0] * n) for i, n in ((1000, 3), (2000, 5), (3000, 5))]
    df = spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in [*odd, *enumerate(x.tolist())]], VECTORS)
    truth = exact(np.arange(200), x)
    for size, merged in ((ann.ROWS, 64), (20, 3)):
        ann.MERGED, before = merged, ann.MERGED
        got = {}
        for r in ann.search(df, queries=F.col("vec_id") % 20 == 0, rows=size).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        ann.MERGED = before
        assert got == truth


def test_copies_and_near_copies_beyond_the_reranked_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-32, 33, (2400, 8)) / 16.0  # products and sums of these are exact
    x[:700] = x[0] * 2
    x[700:1400] = x[700] * 2 + rng.integers(-8, 9, (700, 8)) / 4096
    ids = rng.permutation(2400)
    df = spark.createDataFrame([(int(i), v.tolist(), 0, 0.0, 0) for i, v in zip(ids, x, strict=True)], VECTORS)
    truth = exact(ids, x)
    for rows in (ann.ROWS, 900):
        got = {}
        for r in ann.search(df, queries=F.col("vec_id") % 20 == 0, rows=rows).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == truth


def test_repeated_queries(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-32, 33, (300, 4)) / 16.0
    rows = [(i + 1 if i % 20 == 19 else i, v.tolist()) for i, v in enumerate(x)][:299]
    rows = [(i, v) for i, v in rows if i % 20] + [(20, [1.0, 2.0, 0.0, 0.5])] * 3 + [(40, [0.5, 0.0, 1.0, 0.0]), (40, [-1.0, 0.0, 0.0, 0.25]), (40, [-1.0, -0.0, 0.0, 0.25])]
    df = spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], VECTORS)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    truth = []
    for i, v in [(20, rows[-4][1]), (40, rows[-3][1]), (40, rows[-2][1])]:
        s = x @ np.array(v)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        truth += [(i, rank, int(ids[j]), float(s[j])) for rank, j in enumerate(order, 1)]
    for size in (ann.ROWS, 70):
        got = ann.search(df, queries=F.col("vec_id") % 20 == 0, rows=size, block=2).collect()
        assert sorted(map(tuple, got)) == sorted(truth)


def test_anisotropic_loss_beats_plain_assignment():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    quantiser = ann.Quantiser(x)

    def parallel(codes):
        kept = quantiser.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, :16]
        return (((x - kept) * x).sum(1) ** 2).mean()

    plain = np.stack([((quantiser.split(x)[:, m, None] - quantiser.books[m]) ** 2).sum(2).argmin(1) for m in range(quantiser.books.shape[0])], 1)
    assert parallel(quantiser.codes(x)) < parallel(plain)
