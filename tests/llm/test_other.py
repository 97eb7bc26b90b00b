"""Embeddings, pages, archives, the pipeline."""

import hashlib
from collections import defaultdict

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from yearloom.llm import embeddings as EM
from yearloom.llm import html as HT
from yearloom.llm import warc as WA
from yearloom.llm.components import roots
from yearloom.llm.storage import new_path

from ..conftest import SF
from .common import empty, union_find


def brute_vectors(rows, least=0.98):
    groups = defaultdict(list)
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        groups[(label, len(v))].append((k, i, np.array(v, np.float32).astype(np.float64)))
    links, edges = [0] * len(rows), []
    for g in groups.values():
        x = np.stack([v for _, _, v in g])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        for a, (k, i, _) in enumerate(g):
            links[k] = int(near[a].sum())
            edges += [(i, g[b][1]) for b in np.flatnonzero(near[a])]
    root = union_find(edges)
    return sorted((i, links[k], root(i), root(i) == i) for k, (i, _, _) in enumerate(rows))


def some_vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        base = rng.standard_normal((40, 32))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        for b in base:
            for s in (0, 0, 0.1, 0.2, 0.4):
                z = rng.standard_normal(32)
                rows.append((n, ((b + s * z / np.linalg.norm(z)) * rng.uniform(0.1, 9)).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + i, (base[0] + 0.05 * rng.standard_normal(32)).astype(np.float32).tolist(), 1) for i in range(60)]
    n += 60
    twin = rows[0][1]
    rows += [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [1.0, None], 0), (n + 3, [float("nan")] * 32, 0), (n + 4, [float("inf")] + [1.0] * 31, 0), (n + 5, twin, None), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (n + 9, [1e38, 2e38], 0), (n + 10, [1e-40, 2e-40], 0)]
    return rows


@pytest.mark.parametrize("cell", [1500, 20])
def test_vectors_against_brute_force(spark, cell):
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("caps", F.lit("x")).withColumn("head", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in EM.near_duplicates(df, cell=cell).collect())
    want = brute_vectors(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.mean([g == w for g, w in zip(got, want)]) == 1.0


def test_vectors_of_an_empty_table(spark):
    assert EM.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


def test_vectors_in_double_precision(spark):
    rows = [(1, [1e300, 2e300], 5), (2, [1e300, 2e300], 5), (3, [1.0, 2.0], 5), (4, [1e-60, 2e-60], 5), (5, [5e-324, 1e-323], 5), (6, [1e300, -2e300], 5), (7, [1.0, 2.0], 1 << 40), (None, [1.0, 2.0], 5), (8, [1.0], 1 << 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: tuple(r)[1:] for r in EM.near_duplicates(df, hot_rows=1).collect()}
    assert got == {**{i: (5, 1, i == 1) for i in (1, 2, 3, 4, 5)}, None: (5, 1, False), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True)}


@pytest.mark.parametrize("words", [16, 44, 124])
def test_recall_of_caps_at_the_limit(words):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * z
    (a, p), (b, q) = EM.caps_of(x, words), EM.caps_of(y, words)
    shared = [len(np.intersect1d(a[p[i] : p[i + 1]], b[q[i] : q[i + 1]])) > 0 for i in range(1000)]
    assert np.mean(shared) > 0.99
    assert np.diff(p).min() >= EM.LIST and np.diff(p).mean() < 3 * EM.LIST


def test_list_decoding_finds_all_directions_beyond_the_limit():
    rng = np.random.default_rng(1)
    x = EM.unit(rng.standard_normal((20, 64)))
    turn, parts, words, limit = EM._code(64, 16)
    y = x @ turn
    total = np.zeros((20, 1))
    for p, w in zip(parts, words):
        total = (total[:, :, None] + (y[:, p] @ w.T)[:, None, :]).reshape(20, -1)
    ids, at = EM.caps_of(x, 16)
    for i in range(20):
        least = min(limit, np.sort(total[i])[-EM.LIST])
        assert ids[at[i] : at[i + 1]].tolist() == np.flatnonzero(total[i] >= least - 1e-12).tolist()


def test_directions_follow_the_vectors():
    assert [EM.words_for(n) for n in (0, 10**5, 10**6, 10**7, 10**8)] == sorted(EM.words_for(n) for n in (0, 10**5, 10**6, 10**7, 10**8))
    for n in (10**6, 10**8, 4 * 10**9):
        assert n / EM.words_for(n) ** EM.BLOCKS <= EM.PER_DIRECTION


def test_roots():
    ids, r = roots(np.array([5, 3, 9]), np.array([3, 1, 9]))
    assert ids.tolist() == [1, 3, 5, 9] and r.tolist() == [1, 1, 1, 9]


# archives


def page_rows():
    long = "é" * 5_000
    return [
        (7, "http://a/1", long), (3, "http://a/2", long), (9, "http://b/1", long), (1, "http://b/2", None), (2, None, ""), (4, "http://c\r\nX: y", "short"), (5, "http://d", "short"), (6, "x", "y" * 100), (8, "x", "y" * 100), (10, "x", "y" * 99), (11, "x", "y" * 99),
        (12, "u", "\r\n\r\nWARC/1.1\r\n" * 40), (3, "http://a/2", long), (13, "z", "q" * 70_000),
    ]


def want_pages(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(raw, i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "archive", "rows"), [(1 << 20, 1 << 30, 500_000), (64, 500, 0)])
def test_archives_round_trip(spark, chunk, archive, rows):
    data = page_rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("size", F.lit(1)).repartition(2)
    done = WA.write_archives(df, new_path(spark, "warc"), chunk=chunk, archive=archive, broadcast_rows=rows)
    assert done.agg(F.sum("records")).first()[0] == len(data)
    back = WA.read_archives(done, block=100)
    chunks = back.collect()
    assert max(c.length for c in chunks) <= 100
    whole = defaultdict(list)
    for c in chunks:
        whole[(c.record_id, c.record_type)].append(c)
    texts = {i: (h or "").encode() for i, _, h in data}
    for (rid, kind), cs in whole.items():
        i = int(rid[10:-1])
        if kind == "response" and i != 3:
            assert b"".join(bytes(c.payload) for c in sorted(cs, key=lambda c: c.chunk)) == texts[i]


def test_archives_query(spark):
    data = page_rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in WA.round_trip(spark, df).collect()), key=repr) == want_pages(data)
    assert WA.round_trip(spark, df.where("page_id < 0")).isEmpty()


def test_a_changed_archive_fails(spark):
    from pyarrow import fs

    df = spark.createDataFrame([(1, "u", "some text that is long enough to matter" * 5)], "page_id long, url string, html string")
    done = WA.write_archives(df, new_path(spark, "warc"))
    files, path = fs.FileSystem.from_uri(done.first().path)
    import gzip

    with files.open_input_stream(path, compression=None) as f:
        raw = gzip.decompress(f.read())
    with files.open_output_stream(path, compression=None) as f:
        f.write(gzip.compress(raw.replace(b"matter", b"mutter")))
    with pytest.raises(Exception, match="digest"):
        WA.read_archives(done).collect()


# pages


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T &amp; u</h1><p>a <b>b</b>\n c<p>d</article><footer>f</footer>", "T & u\na b c\nd"),
        ("<body><nav>n</nav><main><div>x<div class='ad'>AD</div>y</div><!-- c --><script>var a='</p>';</script></main>", "x\ny"),
        ("<article>caf&eacute; &#233; &lt;p&gt;<aside>no</aside><form>no</form><style>p{}</style> end", "café é <p>\nend"),
        ("<article><p>own</p><section class=comments><p>theirs</p></section><article class='comment'>c</article></article>", "own"),
        ("<article><p>cut off here &amp", "cut off here &"), ("<article><p>cut <b", "cut"), ("", ""), (None, ""), ("<article></article>", ""), ("<p hidden>x</p><article>y</article>", "y"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article>", "1\n2\na\nb"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article>a<br>b</article>", "a b"), ("<article>a > b & c < d</article>", "a > b & c < d"),
        ("<div role=main>m</div><div class='cookie-notice'>c</div>", "m"), ("<article><a href='x>y'>link</a></article>", "link"),
    ],
)
def test_main_text(page, want):
    assert "\n".join(HT.kept_lines(HT.blocks(page or ""), None)) == want


def test_pages_without_an_article_are_differenced(spark):
    frame = "<div>Site name</div><div>{}</div><p>{}</p><div>Contact us</div>"
    rows = [(i, f"http://{h}.example/{p}", frame.format(t, t * 2)) for i, (h, p, t) in enumerate([("a", "x/1", "one"), ("a", "x/2", "two"), ("a", "y/1", "three"), ("b", "x/1", "four"), ("b", "x/1", "five")])]
    rows += [(90, "http://c.example/only", frame.format("alone", "x")), (91, None, frame.format("n", "m")), (92, "http://d/1", "<div>same</div>"), (93, "http://d/1", "<div>same</div>")]
    got = {r.page_id: r.text for r in HT.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(5)] == ["one\noneone", "two\ntwotwo", "three\nthreethree", "four\nfourfour", "five\nfivefive"]
    assert got[90] == "Site name\nalone\nx\nContact us" and got[92] == got[93] == "same"


def test_neighbour_is_the_one_with_the_longer_common_path(spark):
    rows = [(1, 1, 1, "h", "/a/1", [7, 1]), (2, 2, 2, "h", "/b/1", [8, 2]), (3, 3, 3, "h", "/b/2", [8, 3]), (4, 4, 4, "g", "/b/2", [8, 3])]
    for hot in (100_000, 0):
        got = {r.key: r.other for r in HT._nearest(spark.createDataFrame(rows, HT.PARSED), hot).collect()}
        assert got == {2: [8, 3], 3: [8, 2], 1: [8, 2]}


def brute_text(rows):
    """Per row the lines that stay, by comparing each page with all of its host."""
    found = [(HT.blocks(h or ""), re.match(r"(?:[a-z]+:)?//([^/?#]*)", u or "", re.I), (u or "")) for _, u, h in rows]
    host = [m[1].lower() if m else "" for _, m, _ in found]
    path = [u[m.end() :].split("#")[0] if m else u.split("#")[0] for _, m, u in found]
    order = sorted(range(len(rows)), key=lambda k: (host[k], path[k], rows[k][0]))
    out = {}
    for at, k in enumerate(order):
        own = [t for _, t in found[k][0]]
        sides = []
        for step in (-1, 1):
            q = at + step
            while 0 <= q < len(order) and host[order[q]] == host[k] and [t for _, t in found[order[q]][0]] == own:
                q += step
            if 0 <= q < len(order) and host[order[q]] == host[k]:
                n = 0
                for a, b in zip(path[k], path[order[q]]):
                    if a != b:
                        break
                    n += 1
                sides.append((n, -step, order[q]))
        gone = None
        if sides:
            other = [t for _, t in found[max(sides)[2]][0]]
            shared = HT.common(own, other)
            gone = [] if len(shared) == len(own) else sorted(shared)
        out[k] = "\n".join(HT.kept_lines(found[k][0], gone))
    return [out[k] for k in range(len(rows))]


@pytest.mark.parametrize(("rows_by_broadcast", "hot"), [(100_000, 100_000), (0, 1)])
def test_pages_against_brute_force(spark, rows_by_broadcast, hot):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()]
    rows += [(-1, None, None), (-2, "", ""), (-3, "http://x/1", "<p>a"), (-3, "http://x/1", "<p>a"), (-4, "HTTP://X/2#f", "<div>a</div><div>b</div>"), (-5, "//x/3", "plain")]
    got = sorted((r.page_id, r.text) for r in HT.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).repartition(5), rows_by_broadcast, hot).collect())
    assert got == sorted((r[0], t) for r, t in zip(rows, brute_text(rows)))
    # each of the given pages has one article, and what stays is that
    article = {i: "\n".join(t for k, t in HT.blocks(h or "") if k == HT.MAIN) for i, _, h in rows[:-6]}
    assert all(t == article[i] for i, t in got if i >= 0)


def test_differencing_decides_lines_of_given_pages(spark):
    pages = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet").withColumn("key", F.col("page_id")).withColumn("twin", F.lit(0).cast("long"))
    parsed = pages.select("key", "twin", "page_id", HT._host().alias("host"), HT._path().alias("path"), "html").mapInArrow(HT._parse, HT.PARSED)
    gone = {r.key: r.gone for r in HT._nearest(parsed).mapInArrow(HT._difference, "key long, twin long, gone array<int>").collect()}
    kinds = {r.page_id: [k for k, _ in HT.blocks(r.html or "")] for r in pages.collect()}
    deleted = [kinds[i][k] for i, g in gone.items() for k in g]
    assert len(deleted) > 30 and sum(k == HT.SIDE for k in deleted) > 20


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>One</p><section id=discussion><p>Our results</p></section></article>", "One\nOur results"), ("<article><p>One</p><p class='notice-of-results'>Two</p></article>", "One\nTwo"), ("<article>Let <math><mi>x</mi></math> be one.</article>", "Let x be one."),
        ("<article><p>One</p><div class='comments'><p>no</p></div><div class='share-bar'>no</div></article>", "One"), ("<article><p class=banner-effect>Text</p><div class='ad'>no</div></article>", "Text"),
    ],
)
def test_text_within_an_article_is_kept(page, want):
    assert "\n".join(HT.kept_lines(HT.blocks(page), None)) == want


def test_long_pages_are_aligned():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3000, 20000).tolist(), rng.integers(0, 3000, 20000).tolist()
    got = sorted(HT.common(a, b))
    at = 0
    for k in got:  # a common subsequence, and no shorter than a greedy one
        at = b.index(a[k], at) + 1
    assert len(got) > 200


def test_partners_have_an_article_or_other_lines(spark):
    frame = "<div>Site name</div><div>Menu</div>{}<div>Contact us</div>"
    rows = [(1, "http://a.example/x/1", frame.format("<p>one</p>")), (2, "http://a.example/x/2", frame.format("<article><p>two</p></article>"))]
    rows += [(10 + i, f"http://b.example/x/{i}", frame.format("<p>copied</p>")) for i in range(5)] + [(20, "http://b.example/y", frame.format("<p>other</p>"))]
    rows += [(30, "http://c.example/x/1", frame.format("<p>three</p>")), (31, "http://d.example/x/1", frame.format("<article>four</article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {1: "one", 2: "two", **{10 + i: "copied" for i in range(5)}, 20: "other", 30: "Site name\nMenu\nthree\nContact us", 31: "four"}
    for parts in (1, 7):
        got = HT.main_text(pages.repartition(parts)).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


@pytest.mark.parametrize("seed", range(5))
def test_longest_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = (list(rng.choice(list("abcd"), int(rng.integers(0, 12)))) for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(HT.common(a, b)) == best[-1][-1]


# pipeline


def test_pipeline_stages_by_themselves(spark):
    import corpus_pipeline as CP

    from .test_documents import brute_contamination, brute_groups, brute_secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {}
    for name, stage in CP.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        path = new_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = (before, docs)
        if name != CP.STAGES[-1][0]:
            assert docs.columns == list(CP.COLUMNS)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = held["quality classifier"]
    kept = {r.doc_id for r in after.collect()}
    assert all((labels[i] == 1) == (i in kept) for i in before if i in labels)
    before, after = held["minhash near-dedup"]
    _, root = brute_groups(sorted(before.items()))
    assert {r.doc_id for r in after.collect()} == {i for i in before if root(i) == i}
    before, after = held["benchmark decontamination"]
    texts = {r.doc_id: r.text for r in after.collect()}
    for i, t in before.items():
        n, hit, _, _, bad = brute_contamination(t, bench, 13)
        assert (i not in texts) == bad
        if not hit:
            assert texts[i] == t
    assert all(brute_contamination(t, bench, 13)[1] == 0 for t in texts.values())
    before, after = held["secret scans"]
    for r in after.collect():
        assert not brute_secrets(r.text) and (r.text == before[r.doc_id] or brute_secrets(before[r.doc_id])) and r.n_chars == len(r.text)
    before, after = held["packing"]
    assert {r.doc_id for r in after.collect()} == set(before)


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as CP

    docs = empty(spark)
    for _, stage in CP.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.isEmpty()
