"""Each operator against brute force, a round trip or held-out labels, and its behaviour at the edges."""

from __future__ import annotations

import io
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausewise.llm import bm25, decontam, html, labelled_pages, langid, mixing, quality, sharding, simhash, tokens, toxicity
from clausewise.llm.components import components
from clausewise.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns named like results."""
    rows = [
        (1, None, "en", "a", None, "s", "x"),
        (2, "", None, None, 0, None, None),
        (None, "some words here and there are more", "en", "a", 5, "s", "x"),
        (3, "some words here and there are more", "en", None, 5, "s", "x"),
        (3, "some words here and there are more", "en", None, 5, "s", "x"),
        (4, "é ü 12 ... !!! \t\r\n x", "de", "b", 5, "s", "x"),
        (5, "word " * 50_000, "en", "a", 250_000, "s", "x"),
        (6, "   ", "en", "b", 3, "s", "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", list(queries()))
def test_registered(spark, name, sf_dir):
    if name == "pipeline":
        pytest.skip("has its own test")
    assert queries()[name](spark, sf_dir).count() > 0


def held_out(spark, sf, name, column, label):
    got = queries()[name](spark, sf).where("held_out").toPandas()
    truth = dict(duckdb.sql(f"select doc_id, {label} from '{sf}/labels.parquet'").fetchall())
    got = got[got.doc_id.isin(truth.keys())]
    return np.mean([truth[d] == p for d, p in zip(got.doc_id, got[column], strict=True)]), got


def test_quality_held_out(spark):
    share, got = held_out(spark, "/root/testdata/sf0.1", "op1_quality", "predicted", "quality")
    assert share > 0.98
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_held_out(spark):
    share, _ = held_out(spark, "/root/testdata/sf0.1", "op9_toxicity", "predicted", "toxic")
    assert share > 0.97


def test_language_held_out(spark):
    got = queries()["op10_language"](spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    truth = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.1/documents.parquet'").fetchall())
    assert np.mean([truth[d] == p for d, p in zip(got.doc_id, got.lang_pred, strict=True)]) > 0.99


def test_language_edges(spark, odd):
    model = langid.train([langid.counted(t) for t in ["the house and the dog", "das haus und der hund"] * 5], ["en", "de"] * 5)
    got = langid.identify(odd.withColumnRenamed("shard", "lang_pred"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 6)] == ["und"] * 3
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_a_rare_language_is_learned(spark):
    from pyspark.sql import functions as F

    words = {"en": "the house and the dog are here", "de": "das haus und der hund sind hier", "xx": "zyq vuk qox wuz kyx"}
    docs = spark.createDataFrame([(i, words["xx" if i % 1500 == 7 else "en" if i % 2 else "de"], "xx" if i % 1500 == 7 else "en" if i % 2 else "de") for i in range(6000)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), rows=100)
    assert model.languages == ("de", "en", "xx")
    again = langid.fit(docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(3000)).drop("id")), F.lit(True), rows=100)
    assert again.languages == ("de", "en", "xx")


def test_classifiers_at_the_edges(spark, odd):
    good, bad = [b"the clause is clear and plain" * 30] * 20, [b"$$$ %%% !!! ###" * 30] * 20
    model = quality.QualityModel(quality.dictionary(good, 4096), quality.dictionary(bad, 4096), (1.0,) * 9)
    got = quality.score(odd, model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    words = ["fine", "plain", "good", "text"]
    texts = [f"{a} {b} word{i}" for i in range(9) for a in words for b in words]
    model = toxicity.fitted(texts + [t + " filthword again" for t in texts], [0] * len(texts) + [1] * len(texts), {0: 1.0, 1: 1.0})
    got = toxicity.score(spark.createDataFrame([(1, "A plain filthword in text"), (2, "plain text"), (3, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [1, 0, 0]
    assert [tuple(s) for s in got[0]["spans"]] == [(8, 17)]
    assert toxicity.score(odd, model).count() == 8


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    trans, start = np.exp(rng.normal(size=(2, 2))), np.exp(np.tile(rng.normal(size=2), (2, 1)))
    lengths = [1, 3, 7, 2]
    e = np.exp(rng.normal(size=(sum(lengths), 2)))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p, pair = toxicity.forward_backward(e, first, trans, start)
    at, want, want_pair = 0, [], np.zeros((2, 2))
    for n in lengths:
        total, marg = 0.0, np.zeros((n, 2))
        pairs = np.zeros((2, 2))
        for path in np.ndindex(*[2] * n):
            w = start[0, path[0]] * e[at, path[0]] * math.prod(trans[path[i - 1], path[i]] * e[at + i, path[i]] for i in range(1, n))
            total += w
            for i, y in enumerate(path):
                marg[i, y] += w
            for i in range(1, n):
                pairs[path[i - 1], path[i]] += w
        want.append(marg / total)
        want_pair += pairs / total
        at += n
    assert np.allclose(p, np.concatenate(want)) and np.allclose(pair, want_pair)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    points = set(base)
    for b in base[:20]:
        for _ in range(8):
            for k in rng.integers(0, 63, 2):
                b ^= 1 << int(k)
            points.add(b)
    points = np.array(sorted(points), dtype="<u8")
    u, v = simhash.stars(points, 3)
    parent = {int(p): int(p) for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if int(a ^ b).bit_count() <= 3:
                x, y = find(int(a)), find(int(b))
                parent[max(x, y)] = min(x, y)
    want = {int(p): find(int(p)) for p in points if find(int(p)) != int(p)}
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == want
    # sharded: a tree of small leaves, joined again
    tree = simhash.build(points, 3, 8)
    edges = [(int(a), int(b)) for _, idx in tree.route(points) for a, b in zip(*simhash.stars(np.sort(points[idx]), 3), strict=True)]
    rows = components(spark.createDataFrame([(a, b) for a, b in edges], "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in rows if r["node"] != r["root"]} == want


def test_simhash_query(spark, odd, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    fps = {d: plain_fingerprint(t) for d, t in docs}
    got = {r["doc_id"]: r for r in queries()["op2_simhash"](spark, sf_dir).collect()}
    label = {d: d for d in fps}
    while True:
        new = {d: min(label[e] for e, g in fps.items() if (g ^ f).bit_count() <= 3) for d, f in fps.items()}
        if new == label:
            break
        label = new
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r["component_id"] for d, r in got.items()} == label
    edge = simhash.near_duplicates(odd).collect()
    assert len(edge) == 8 and {r["component_id"] for r in edge if r["doc_id"] in (1, 2, 6)} == {1}
    assert sorted(r["doc_id"] for r in simhash.representatives(odd).collect() if r["doc_id"]) == [1, 3, 4, 5]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_regions_get_trees_of_their_own(spark):
    """Two levels of trees find what comparing all pairs finds, and copies of a point stay few."""
    rng = np.random.default_rng(5)
    points = set(rng.integers(0, 2**63, 3000).tolist())
    for base in rng.integers(0, 2**63, 25).tolist():
        for _ in range(40):
            x = base
            for k in rng.integers(0, 63, rng.integers(0, 6)).tolist():
                x ^= 1 << k
            points.add(x)
    p = np.array(sorted(points), dtype="<u8")
    near = [(i, j + i + 1) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= 3).tolist()]
    up = list(range(len(p)))
    for _ in range(30):
        for i, j in near:
            up[i] = up[j] = min(up[i], up[j])
    want = {int(p[i]): int(p[up[i]]) for pair in near for i in pair}
    df = spark.createDataFrame([(int(x),) for x in p], "fp long")
    for shard, regions in ((100, 4), (300, 256)):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, 3, shard, 1000, regions)).collect()}
        assert got == want


def test_representatives_keep_any_columns(spark, odd):
    """A map, a name with a backtick and names that the operator uses itself."""
    rows = [(1, "a b c d e f g", {"k": 1}, 7, "x"), (1, "a b c d e f g", {"k": 1}, 7, "x"), (None, "a b c d e f g", None, 8, "y"), (2, "", {}, 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `od``d` int, row string")
    got = simhash.representatives(df, similar=0.8)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["od`d"], r["row"]) for r in got.collect()) == [(1, 7, "x"), (2, 9, None)]
    assert simhash.representatives(df.limit(0), similar=0.8).count() == 0


def test_pipeline_keeps_one_of_similar_texts(spark, sf_dir):
    """Whole groups by three bits of the fingerprint or a similarity of 0.8 of five-word shingles, against brute force."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    texts = [r[0] for r in duckdb.sql(f"select text from '{sf_dir}/documents.parquet' order by doc_id limit 60").fetchall()]
    for _ in range(12):
        w = [f"w{x}" for x in rng.integers(0, 400, 150)]
        texts.append(" ".join(w))
        for _ in range(6):  # chains, so that some are similar only by way of others
            for k in rng.integers(0, len(w), int(rng.integers(1, 8))):
                w[k] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    texts += ["", "   ", "a b", "A  b", "one two three four five", "one two three four six"]

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, fps = [shingles(t) for t in texts], [plain_fingerprint(t) for t in texts]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3
    like = lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0

    def kept(link):
        label = list(range(len(texts)))
        while True:
            new = [min(label[j] for j in range(len(texts)) if i == j or link(i, j)) for i in range(len(texts))]
            if new == label:
                return sorted(set(label))
            label = new

    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = kept(lambda i, j: near(i, j) or like(i, j))
    assert len(want) < len(kept(near))
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, sf_dir).collect()) == want
    assert corpus_pipeline.distinct(spark, docs.limit(0), sf_dir).count() == 0


def test_sharding(spark, odd, sf_dir):
    for docs, n in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), 200), (odd, 8), (odd.limit(0), 0)):
        got = sharding.digest(docs).toPandas()
        assert len(got) == n
        for _, own in got.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
        assert got.groupby(["text_crc32", "size"]).shard.nunique().max() == 1 or n == 8 or n == 0
        assert sharding.shard(docs).columns.count("shard") == 1
    got = sharding.digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    docs = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    assert all(s == len(docs[d].encode()) + 8 and c == zlib.crc32(docs[d].encode()) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    groups = Counter()
    for d, t in docs.items():
        groups[t] += len(t.encode()) + 8
    loads = [0] * 24
    for b in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += b
    assert got.groupby("shard")["size"].sum().max() <= 1.02 * max(loads)


def test_placing_many_groups_levels_the_shards():
    took = sharding.place([(1000, 100_003, 100_003_000), (9_000_000, 1, 9_000_000), (8, 50, 400)], 24)
    loads = [sum(t[s] * (c if c != 8 else 8) for c, t in took.items()) for s in range(24)]
    assert sum(took[1000]) == 100_003 and sum(took[8]) == 50
    small = sorted(loads)[:-1]
    assert max(small) - min(small) <= 1000 and max(loads) == 9_000_000


def test_mixing(spark, odd, sf_dir):
    got = mixing.quotas(spark.read.parquet(f"{sf_dir}/documents.parquet"), block=64).toPandas()
    again = mixing.quotas(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5), block=64).toPandas()
    docs = duckdb.sql(f"select doc_id, text, source from '{sf_dir}/documents.parquet'").fetchall()
    size = {d: len((t or "").encode().split()) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    assert (got.taken <= 2 * got["size"]).all()
    got["source"] = [source[d] for d in got.doc_id]
    for _, own in got.groupby("source"):
        assert own.taken.sum() == round(own.target.iloc[0]) <= 2 * own["size"].sum()
    assert abs(sum({s: t for s, t in zip(got.source, got.target, strict=True)}.values()) - 1.5 * got["size"].sum()) < 1e-3
    assert mixing.quotas(odd).count() == 8 and mixing.quotas(odd.limit(0)).count() == 0
    out = mixing.mix(odd).toPandas()
    assert out.columns.tolist()[: len(odd.columns)] == odd.columns
    taken = sum(len(t.split()) for t in out.text)
    assert taken == sum(r["taken"] for r in mixing.quotas(odd).collect())


def test_mixing_is_drawn_by_its_tree(spark, monkeypatch):
    """Word by word: the shards' runs of permuted blocks, as long as the tree's quotas, disjoint, and nothing else."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "en", s, 0, None, None) for i, s in enumerate(["a"] * 90 + ["b"] * 25 + [None] * 12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    shards, block = 5, 16
    laid = mixing.laid_out(docs, shards, mixing.WEIGHTS, 1.5, 2.0, block, ["doc_id"], held=True).toPandas()
    got = {r["doc_id"]: r for r in mixing.quotas(docs, shards, block=block).collect()}
    for key, own in laid.groupby("__s", dropna=False):
        n, blocks, ends = int(own.source_size.iloc[0]), int(own.blocks.iloc[0]), list(own.ends.iloc[0])
        grid = spark.createDataFrame([(k, blocks, int(own.wide.iloc[0]), int(own.deep.iloc[0]), list(own.salts.iloc[0])) for k in range(blocks)], "k long, blocks long, wide long, deep long, salts array<long>")
        places = [[r["p"] for r in grid.selectExpr(mixing.place("k", f"salts[{e}]") + " as p", "k").orderBy("k").collect()] for e in (0, 1)]
        assert all(sorted(p) == list(range(blocks)) and (blocks < 4 or p != list(range(blocks))) for p in places)
        draws, rest, took = int(own.draws.iloc[0]), int(own.rest.iloc[0]), Counter()
        for _, d in own.iterrows():
            for w in range(int(d["at"]), int(d["at"] + d["size"])):
                for e in (0, 1):
                    at = e * blocks + places[e][w // block]
                    if at < draws and not (rest and at == draws - 1 and w % block >= rest):
                        took[d.doc_id, next(j for j in range(shards) if at < ends[j])] += 1
        for i in own.doc_id:
            assert {x["shard"]: x["words"] for x in got[i]["shards"]} == {s: n for (d, s), n in took.items() if d == i}
            assert got[i]["taken"] == sum(n for (d, _), n in took.items() if d == i) <= 2 * got[i]["size"]
        assert sum(took.values()) == round(own.target.iloc[0]), (key, n)
        assert ends[-1] == draws
    mixed = mixing.mix(docs, shards, block=block).toPandas()
    words = mixed.assign(n=[len(t.split()) for t in mixed.text]).groupby("mix_shard").n.sum().to_dict()
    want = Counter()
    for r in got.values():
        for x in r["shards"]:
            want[x["shard"]] += x["words"]
    assert words == dict(want)
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed=17: np.zeros((shards, len(quotas)), dtype=np.int64))
    assert sum(r["taken"] for r in mixing.quotas(docs, shards, block=block).collect()) == 0


def test_hypergeometric_law():
    """Mean and variance of small and of very large draws."""
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 6), (300, 100, 50), (3 * 10**9, 10**10, 10**9)):
        got = np.array([mixing.drawn(rng, good, bad, n) for _ in range(300 if good > 10**6 else 3000)], dtype=float)
        p, total = good / (good + bad), good + bad
        sd = math.sqrt(n * p * (1 - p) * (total - n) / (total - 1))
        assert abs(got.mean() - n * p) < 5 * sd / math.sqrt(len(got)) and 0.8 < got.std() / sd < 1.2


def test_splitting_tree():
    quotas = [1000, 10, 0, 555]
    got = mixing.split_quotas(quotas, 7)
    assert got.sum(axis=0).tolist() == quotas
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    assert mixing.targets({"a": 100, "b": 10, None: 100}) == {"a": pytest.approx(177.0), "b": 20.0, None: pytest.approx(118.0)}


def measured(known, pages):
    out = []
    for page in pages:
        parts, odds = known.scores(page)
        out.append(html.measure(parts, odds, known.region(parts, odds)))
    return np.mean(out, axis=0)


def test_html_held_out_templates():
    """Word precision and recall on templates that were not learned from; then with names of boxes that were not either."""
    precision, recall, _ = measured(html.weights(), labelled_pages.pages(100, held_out=True))
    assert precision > 0.98 and recall > 0.96
    precision, recall, _ = measured(html.weights(half=0), labelled_pages.pages(100, held_out=True, half=1))
    assert precision > 0.93 and recall > 0.97


def test_html_scan_is_the_best_stretch():
    """The linear scan against all stretches."""
    known = html.weights()
    for page in labelled_pages.pages(6, 1, held_out=True):
        parts, odds = known.scores(page)
        parts, odds = parts[:120], odds[:120]
        gain = [-known.tag * known.costs.get(a.what, 1.0) if a.kind == "tag" else a.words * s * (1.0 if s > 0 else known.rest) for a, s in zip(parts, odds, strict=True)]
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        a, b = known.region(parts, odds)
        assert sums[b] - sums[a] == pytest.approx(max(0.0, max(sums[j] - sums[i] for i in range(len(sums)) for j in range(i, len(sums)))))


def test_html_hidden_and_odd_markup():
    shown = "<p>A paragraph of some length, which says something.</p><p>Another one, that goes on for a while.</p>"
    want = "A paragraph of some length, which says something. Another one, that goes on for a while."
    for hidden in ("<div hidden>", "<div style='color:red; display : none'>", '<section aria-hidden="true">', "<div style=visibility:hidden>"):
        element = re.match("<([a-z]+)", hidden)[1]
        assert html.extract(f"<body><article>{shown}{hidden}<p>Words that nobody sees, not even once.</p></{element}></article></body>") == want
    assert html.extract(f"<body><article>{shown.replace('<p>', '<p title=it\'s class=a>')}</article></body>") == want
    assert html.extract(f"<body><div class=trending><h3>Now</h3><ul><li><a href=1>Some headline of news here</a><li><a href=2>Another headline of today</a></ul></div><div class=foo>{shown}</div><div class=legal><p>All rights reserved 2024</p></div></body>") == want


def test_html_table(spark, odd):
    long = "<article>" + "<p>A sentence of a very long page, one of many.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, None, "u", "own"), (2, "", "u", None), (3, "<article><p>Some text, which is main text.</p></article>", None, "own"), (None, long, "u", "own")], "page_id long, html string, url string, text string")
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    assert html.main_text(pages).columns == ["page_id", "html", "url", "text", "n_chars"]
    assert [(got[i]["text"], got[i]["n_chars"]) for i in (1, 2, 3)] == [("", 0), ("", 0), ("Some text, which is main text.", 30)]
    assert got[None]["n_chars"] == 20_000 * 45 - 1 and html.main_text(pages.limit(0)).count() == 0


def test_html():
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>t</b>wo\n  three<p>four'
        "<aside>not this</aside><form>nor <button>this</button></form><script>var a='<p>';</script>five<br>six</article><section class='comments'>x says y</section><footer>f</footer></body></html>"
    )
    assert html.extract(page) == "Head & line One two three four five six"
    assert [html.extract(p) for p in (None, "", "<p>", "<!-- x", "plain", "<nav>m</nav>")] == ["", "", "", "", "plain", ""]
    page = '<body><div class="menu"><a>A</a><a>B</a></div><div class="content"><h1>Hi</h1><p>A text that goes on for a while.</p><p>And on.</p></div><div class="cookie-notice">We use cookies</div></body>'
    assert html.extract(page) == "Hi A text that goes on for a while. And on."

    for tag in ("svg", "math"):
        assert html.extract(f"<article><p>One <{tag} class='i'/> two</p><p>three</p></article>") == "One two three"
        assert html.extract(f"<article><p>One <{tag}><title>no</title></{tag}> two</p></article>") == "One two"


def test_decontamination_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.execute(oracle_sql()["op6_decontamination"]).fetchall())
    got = sorted(tuple(r) for r in queries()["op6_decontamination"](spark, sf).collect())
    assert got == want


def test_decontamination_edges(spark, odd):
    items = spark.createDataFrame([(1, "Some words here"), (2, " ".join(f"w{i}" for i in range(14))), (3, None), (None, "x9"), (4, "words here")], "item_id long, text string")
    text = "start " + " ".join(f"W{i}" for i in range(2, 13)) + ", end. some WORDS here; x9"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "w1 w2 w3"), (4, "words here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.scan(docs, items).collect()}
    assert [got[1][c] for c in ("n_words", "n_hit", "n_items", "contaminated")] == [17, 15, 3, True]
    assert (got[2]["n_words"], got[3]["n_hit"], got[4]["n_items"]) == (0, 0, 1)
    several = [spark.sparkContext.broadcast(a.value) for m in (1,) for a in decontam.automata(items, most_words=m)]
    assert len(several) == 4
    again = {r["doc_id"]: tuple(r) for r in docs.select("doc_id", decontam.scanner(several)("text").alias("s")).select("doc_id", "s.n_words", "s.n_hit", "s.n_items", "s.items_sha256").collect()}
    assert again == {d: (d, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for d, r in got.items()}
    kept = {r["doc_id"]: r["text"] for r in decontam.clean(docs, items, coverage=0.9).collect()}
    assert kept[1] == "start , end." and kept[2] is None and 4 not in kept
    assert decontam.scan(odd, items).count() == 8 and decontam.scan(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_token_packing():
    for bits in (1, 3, 8, 13, 16, 17, 32):
        ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint32)
        assert len(tokens.pack(ids, bits)) == -(-1000 * bits // 8)
        assert (tokens.unpack(tokens.pack(ids, bits), 1000, bits) == ids).all()
        docs = [(None, ids[:0]), (3, ids[:10]), (4, ids[10:700]), (4, ids[700:])]
        f = tokens.TokenFile(io.BytesIO(tokens.to_file(docs, bits, block=64)))
        assert [d for d, _, _ in f.documents()] == [None, 3, 4, 4]
        f = tokens.TokenFile(io.BytesIO(tokens.to_file(docs, bits, block=64)))
        assert (f.document(2) == ids[10:700]).all()


def test_tokens_against_the_library(spark, odd, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    hard = ["Don't can't we've 'S x'tle", "É́ é éx ﬁ ß İstanbul Σας ΣΑΣ", "a b c\x1cd\x85e", "x<|endoftext|>y <|startoftext|>", "１２ 12 ½ a1b2", "!!! word... (word) \"q\"", "日本語 テスト 가나", "\x00 \x07"]
    docs = [(d, s) for d, s in duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()] + [(10_000 + i, h) for i, h in enumerate(hard)] + [(20_000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in tokens.round_trip(frame, public_tokenizers.path("word_bpe_49k.json")).collect())
    start, want = 0, []
    for d, s in sorted(docs, key=lambda x: x[0]):
        ids = np.array([*t.encode(s or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.round_trip(odd, public_tokenizers.path("word_bpe_49k.json")).count() == 8
    assert tokens.round_trip(odd.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_search_against_brute_force(spark, odd, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    counts = {d: Counter(decontam.words(t)) for d, t in docs}
    df = Counter(w for c in counts.values() for w in c)
    mean = sum(sum(c.values()) for c in counts.values()) / len(docs)
    want = []
    for q in (d for d in counts if d % 100 == 0):
        scores = defaultdict(float)
        for w, n in counts[q].items():
            idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
            for d, c in counts.items():
                if c[w]:
                    scores[d] += n * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        want += [(q, i + 1, d, round(s, 6)) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in bm25.search(frame, frame.where("doc_id % 100 = 0")).collect())
    assert got == sorted(want)
    assert {r["query_id"] for r in bm25.search(odd, odd).collect()} == {None, 3, 4, 5}
    assert bm25.search(odd.limit(0), odd.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "alpha"), (9, "gamma"), (9, "gamma")], "doc_id long, text string")
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in bm25.search(two, asked).collect()) == [(9, 1, 1), (9, 1, 2)]


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Each stage works on what the one before it kept; edge rows are borne; a rerun agrees; nothing but the result stays."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (None, "w " * 30_000, "en", "web", 60_000)]
    seen = docs.unionByName(spark.createDataFrame([*extra, extra[1]], docs.schema)).withColumn("shard", F.lit("own"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, sf_dir).write.parquet(f"{tmp_path}/{name}")
        seen = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert seen.columns == [*corpus_pipeline.COLUMNS, *(["shard"] if name == "sharding" else [])]
    n = {k: d.count() for k, d in kept.items()}
    assert docs.count() + 4 > n["quality"] > n["near_duplicates"] >= n["decontamination"] > 0 and n["sharding"] == n["mixing"]
    fps = kept["near_duplicates"].select(simhash.fingerprints(3).alias("fp"))
    assert fps.distinct().count() == n["near_duplicates"]
    assert decontam.scan(kept["decontamination"], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count() == 0
    once, again = (sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert once == again and len({r["shard"] for r in kept["sharding"].collect()}) == 24
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_similar_texts_are_joined_alike_in_any_number_of_rounds(spark, monkeypatch):
    """What is moved at once is bounded: many small rounds of meetings and of pairs find the groups that one finds."""
    from clausewise.llm import similar

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(6)] + [" ".join(words[::-1]), " ".join(words[::-1] + ["end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sorted(r["doc_id"] for r in simhash.representatives(df, similar=0.8).collect())
    parts, real = [], similar.rounds
    monkeypatch.setattr(similar, "rounds", lambda rows, key, most: (parts.append(key) or x for x in real(rows, key, most)))
    for name, value in (("LEAST_MEETINGS", 5), ("MEETINGS", 0), ("LEAST_PAIRS", 2), ("PAIRS", 0)):
        monkeypatch.setattr(similar, name, value)
    assert sorted(r["doc_id"] for r in simhash.representatives(df, similar=0.8).collect()) == one == [0, 6]
    assert parts.count("x") > 2 and parts.count("a") > 2


def test_bm25_of_a_block_of_queries_equals_each_alone():
    """To the last bit, with copies, frequent and rare terms, unknown terms, no terms, and fewer documents than k."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) % 3000) for _ in range(700)] + [None, "", "w1"]
    for n in (4, len(texts)):
        some = texts[:n] + texts[:3]
        s = bm25.Shard.of(list(range(len(some))), some)
        s.prepare(float(s.lengths.mean()))
        s.ready()
        queries = [(t, c * np.log(1 + 900 / (1 + (t % 97).astype(float)))) for t, c, _ in map(bm25.term_counts, [*some[::9], "nowhere", ""])]
        for (at, score), (own, alone) in zip(s.best_of(queries, 10), (s.best(*q, 10) for q in queries), strict=True):
            assert at.tolist() == own.tolist() and score.tolist() == alone.tolist()


def test_texts_meet_only_where_sizes_and_orders_leave_a_similar_one(spark):
    """Pairs by brute force all meet; texts that share a shingle with none near their size, or too late for it, don't."""
    from clausewise.llm import similar

    rng = np.random.default_rng(3)
    base = [[f"w{v}" for v in rng.integers(0, 40, n)] for n in (5, 9, 30, 60, 61, 120)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for cut in (1, 2, 4, 8):
            texts += [" ".join(b[cut:]), " ".join(b + b[:cut]), " ".join("z" if i % 29 == cut else w for i, w in enumerate(b))]
    texts = sorted(set(texts))
    sets = [set(similar.shingle_set(t, 2).tolist()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    for least in (0.3, 0.8):
        want = {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9}
        places = {}
        for r in similar.met(df, 2, least).collect():
            places.setdefault((r["x"], r["block"]), set()).add(r["key"])
        together = {(i, j) for p in places.values() for i in p for j in p if j < i}
        assert want and want <= together and all(len(p) > 1 for p in places.values())
        sizes = [len(s) for s in sets]
        assert least < 0.5 or all(min(sizes[i] for i in p) >= 0.8 * sorted(sizes[i] for i in p)[1] - 1e-9 for p in places.values())
