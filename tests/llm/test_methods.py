"""Operators against independent forms of their definition, and on inputs where a method must do the work."""

import random
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from curatum.llm import ann, matroska, quality, wrapper


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def extracted(spark, rows, **parameters):
    found = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **parameters)
    return {r.page_id: r.text for r in found.collect()}


def test_wrapper_of_hosts_with_more_menu_than_article(spark):
    """A long constant menu goes whatever its share of the page, and copies of an article on such a host keep their text."""
    rng = random.Random(21)
    rows, want = [], {}
    for host, n_menu, n_article in (("m", 400, 60), ("n", 60, 200), ("o", 2000, 40)):
        menu = sentence(rng, n_menu)
        articles = [sentence(rng, n_article) for _ in range(12)]
        for i in range(20):
            body = articles[i if i < 12 else 0]  # nine copies of the first
            key = len(rows)
            rows.append((key, f"http://{host}.example/{i}", f"<body><div class=k1><p>{menu}</p></div><div class=k2><p>{body}</p></div><div class=k3>{sentence(rng, 3)}</div></body>"))
            want[key] = body
    assert extracted(spark, rows, names=False) == want


def test_wrapper_of_a_menu_that_changed_once(spark):
    rng = random.Random(22)
    menus, rows, want = [sentence(rng, 300), sentence(rng, 300)], [], {}
    for i in range(40):
        body = sentence(rng, 50)
        rows.append((i, f"http://v.example/{i}", f"<body><div class=k1>{menus[i >= 38]}</div><div class=k2><p>{body}</p></div></body>"))
        want[i] = body
    assert extracted(spark, rows, names=False) == want


def test_wrapper_of_rare_layouts(spark):
    """Three pages of a layout of their own lose its constant parts beside 400 pages of another."""
    rng = random.Random(23)
    rows, want = [], {}
    for i in range(403):
        body = sentence(rng, 40)
        rare = i >= 400
        notice = "<div class=r1>Constant words of the rare layout stand here on each of its pages</div>" if rare else "<div class=k1>Front page and archive</div>"
        rows.append((i, f"http://r.example/{i}", f"<body>{notice}<div class={'r2' if rare else 'k2'}><p>{body}</p></div></body>"))
        want[i] = body
    assert extracted(spark, rows, names=False) == want


class Article(HTMLParser):
    """The given pages' article: what stands in <article>, without script and style; blocks apart."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "code"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.parts = False, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("script", "style"):
            self.skip = tag
        if tag not in self.INLINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag == self.skip:
            self.skip = None
        if tag not in self.INLINE:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_wrapper_equals_an_independent_reader_on_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = wrapper.main_text(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        reader = Article()
        reader.feed(html[r.page_id] or "")
        reader.close()
        assert r.text == " ".join("".join(reader.parts).split()), r.page_id
        assert r.n_chars == len(r.text)


def test_ann_recall_where_a_twentieth_is_reranked(spark):
    """60,000 vectors with the mean and covariance of the given ones, 2,940 of them reranked for a query."""
    rng = np.random.default_rng(5)
    given = np.stack(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().embedding.to_numpy()).astype(float)
    n = 60_000
    x = rng.multivariate_normal(given.mean(0), np.cov(given.T), n)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}))
    got = ann.nearest(df, F.col("vec_id") % 500 == 0).toPandas()
    assert 12 * n**0.5 <= n / 20 and len(got) == 5 * 120
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, rows in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5]) & set(rows.vec_id))
    assert hit / len(got) >= 0.93


def test_ann_ranks_by_footrule_and_reranks_a_share():
    """One cell against the footrule by its definition: the rows reranked are the nearest by it."""
    rng = np.random.default_rng(6)
    x, pivots, prefix, k = rng.normal(size=(300, 8)), rng.normal(size=(20, 8)), 6, 3
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    order = ann._nearest(x, pivots, prefix).astype(np.uint16)
    frame = pd.DataFrame({"vec_id": np.arange(300), "vector": [v.tobytes() for v in x], "places": [o.tobytes() for o in order]})
    got = ann._search_cell(frame[:10], frame, 20, 0.1, k).groupby("query_id").vec_id.apply(list)
    place = lambda o: {p: i for i, p in enumerate(o.tolist())}
    for q in range(10):
        a = place(order[q])
        rule = []
        for v in range(300):
            b = place(order[v])
            rule.append(sum(abs(a.get(p, prefix) - b.get(p, prefix)) for p in set(a) | set(b)))
        near = [v for v in sorted(range(300), key=lambda v: (rule[v], v))[:31] if v != q][:30]
        cosine = {v: x[v] @ x[q] / np.linalg.norm(x[v]) / np.linalg.norm(x[q]) for v in near}
        assert got[q] == sorted(near, key=lambda v: (-cosine[v], v))[:k]


def test_quality_scores_equal_a_refit_from_the_formula(spark):
    """The discriminant again, from the statistics, by covariance, determinant and inverse."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.statistics(docs).join(labels, "doc_id", "left").select("doc_id", "x", "quality", quality.held_out(F.col("doc_id")).alias("out")).toPandas()
    x = np.stack(rows.x.to_numpy())
    learn = (~rows.out & rows.quality.isin([0, 1])).to_numpy()
    y = rows.quality.to_numpy()[learn].astype(int)
    a = x[learn]
    centre, scale = a.mean(0), a.std(0)
    scale[scale <= 1e-6] = 1
    a, z = (a - centre) / scale, (x - centre) / scale
    cov = [np.cov(a[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        s = 0.98 * (0.9 * cov[c] + 0.1 * pooled) + 0.02 * np.eye(len(pooled))
        d = z - a[y == c].mean(0)
        logs.append(np.log((y == c).mean()) - np.linalg.slogdet(s)[1] / 2 - (d @ np.linalg.inv(s) * d).sum(1) / 2)
    want = dict(zip(rows.doc_id, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60))), strict=True))
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6


def test_default_duration_belongs_to_its_track_entry():
    """Two tracks, the first entry with the duration before the number, the second without one."""
    m, frames = matroska, [b"a", b"b", b"c"]
    entries = m.element(m.TRACK_ENTRY, m._uint(m.DEFAULT_DURATION, 5_000_000) + m._uint(m.TRACK_NUMBER, 7)) + m.element(m.TRACK_ENTRY, m._uint(m.TRACK_NUMBER, 2))
    blocks = m.element(m.SIMPLE_BLOCK, m._laced(7, 0, frames)) + m.element(m.SIMPLE_BLOCK, m._laced(2, 40, frames))
    file = m.element(m.SEGMENT, m.element(m.TRACKS, entries) + m.element(m.CLUSTER, m._uint(m.TIMESTAMP, 100) + blocks))
    assert [(track, time) for track, time, *_ in m.packets(file)] == [(7, 100), (7, 105), (7, 110), (2, 140), (2, 140), (2, 140)]
