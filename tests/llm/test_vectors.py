"""Whitening and product codes against plain numpy and Python integers, and main text against hand-made pages."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from logevidence.llm import codes, maintext, whitening

COLUMNS = "vec_id long, embedding array<double>, label int, x string, code string, length int, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "c", 1, 2) for i, v, label in rows], COLUMNS).repartition(3)


def ragged(dim=32, n=150):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * (1 + k % 5) for k in range(dim)], i % 3 if i % 7 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [None] * dim, 1), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1)]
    rows += [(None, rows[3][1], 2), rows[4], (n + 5, rows[5][1], 1), (n + 6, [0.0] * dim, None), (n + 7, [], 0)]
    return rows


def integers(v):
    return [math.floor(256 * c) for c in v]


def usable(rows, dim):
    return [(i, integers(v), label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v) == dim]


def test_whitening_is_that_of_numpy(spark):
    rows = ragged()
    out = whitening.whiten(vectors(spark, rows)).toPandas()
    kept = usable(rows, 32)
    assert len(out) == 4 * len(kept) and out.vec_id.isna().sum() == 4
    fit = np.unique(np.array([x for _, x, _ in kept]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    assert (out.n == n).all() and (out.identity_error < 1e-12).all()
    for k in range(4):
        mine = out[out.component == k + 1].dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id")
        x = np.array([x for i, x, _ in kept if i is not None])
        ids = [i for i, _, _ in kept if i is not None]
        assert [int(d) for d in mine.deviation.loc[ids]] == [sum((n * a - b) ** 2 for a, b in zip(map(int, r), map(int, s))) for r in x]
        want = (x - s / n) @ u[:, -1 - k] / math.sqrt(e[-1 - k])
        assert min(abs(mine.whitened.loc[ids] - want).max(), abs(mine.whitened.loc[ids] + want).max()) < 1e-9
        assert mine.explained.iloc[0] == pytest.approx(e[-1 - k] / np.trace(v), rel=1e-9)


def test_equal_eigenvalues_share_a_space_and_lack_of_variance_is_null(spark):
    cross = [(2 * i + s, [(-1.0) ** s if k == i else 0.0 for k in range(5)], 0) for i in range(5) for s in (0, 1)]
    out = whitening.whiten(vectors(spark, cross)).toPandas()
    assert (out.identity_error < 1e-12).all() and np.allclose(out.explained, 0.2, rtol=1e-12)
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(w.T @ w / 10, np.eye(4), atol=1e-12)
    line = whitening.whiten(vectors(spark, [(i, [float(i), 1.0, 2.0], 0) for i in range(4)])).toPandas()
    assert line[line.component == 1].whitened.notna().all() and line[line.component > 1].whitened.isna().all()
    assert line[line.component == 1].explained.iloc[0] == 1 and (line[line.component > 1].explained == 0).all()
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).toPandas()
    assert len(one) == 4 and one.whitened.isna().all() and one.explained.isna().all() and (one.deviation == 0).all() and (one.n == 1).all()
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [], 0), (2, None, 0)])).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**40 * (i + 1), 3.0 + i % 2], 0) for i in range(6)]
    out = whitening.whiten(vectors(spark, rows)).toPandas()
    assert out.deviation.isna().all() and (out.identity_error < 1e-9).all()  # beyond the range of long
    w = out[out.component == 1].whitened.to_numpy()
    assert w @ w / 6 == pytest.approx(1, abs=1e-9)
    x = np.array([[-(2**62), 5], [2**62, -7], [3, 2**50]], dtype=np.int64)
    total = whitening.products(x)
    plain = [[*map(int, r), 1] for r in x]
    assert all(total[i, j] == sum(r[i] * r[j] for r in plain) for i in range(3) for j in range(3))


def test_characteristic_polynomial_and_roots(spark):
    r = random.Random(1)
    b = np.array([[r.randint(-9, 9) for _ in range(7)] for _ in range(5)], dtype=object)
    m = b.T @ b  # rank 5
    c = whitening.characteristic_polynomial(spark, m)
    assert c[:2] == [0, 0] and c[7] == 1 and c[6] == -sum(m.diagonal())
    e = np.linalg.eigvalsh(m.astype(float))
    intervals, s = whitening.largest_roots(c, 4)
    assert np.allclose([root / 2**s for root, _ in intervals], e[::-1][:4], rtol=1e-9) and all(k == 1 for _, k in intervals)
    double = [int(v) for v in np.poly([3, 3, 2, 0])[::-1]]
    assert whitening.largest_roots(double, 4) == ([(3 << 96, 2), (2 << 96, 1)], 96)
    assert [whitening.roots_from(double, a) for a in (0, 1, 2, 3, 4)] == [4, 3, 3, 2, 0]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract, part by part and row by row."""
    width = len(rows[0][1]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in rows]
    first = sorted((r for r in range(len(rows)) if rows[r][0] is not None), key=lambda r: (rows[r][0], rows[r][1]))[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda k: (gap(row[p], books[p][k]), k)) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        owner = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [row[p] for row, o in zip(cut, owner) if o[p] == k]
                if mine:
                    books[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    owner = assign()
    errors = [sum(gap(row[p], books[p][o[p]]) for p in range(parts)) for row, o in zip(cut, owner)]
    numbers = ",".join(str(v) for book in books for entry in book for v in entry)
    return ["".join(f"{k:02x}" for k in o) for o in owner], errors, hashlib.sha256(numbers.encode()).hexdigest()


@pytest.mark.parametrize("scale", [1.0, 0.004, 2.0**45])
def test_codes_are_those_of_the_contract(spark, scale):
    """Spread out, full of ties, and beyond the range where int64 holds a distance."""
    rows = [(i, None if v is None else [None if c is None else c * scale for c in v], label) for i, v, label in ragged()]
    coded, books = codes.encode(vectors(spark, rows))
    out = codes.with_label_errors(coded, hot=2).toPandas()
    kept = usable(rows, 32)
    want_codes, errors, digest = plain_codes(kept)
    fits = [e if e < 1 << 63 else None for e in errors]
    key = lambda r: tuple((x is not None, x) for x in r)
    plain = lambda r: tuple(None if x is None or x != x else x if isinstance(x, str) else int(x) for x in r)
    mine = sorted((plain(r) for r in out[out.vec_id != 157][["vec_id", "label", "code", "error"]].itertuples(index=False)), key=key)
    assert mine == sorted(((i, label, c, e) for (i, _, label), c, e in zip(kept, want_codes, fits)), key=key)
    assert codes.digest({32: books[32]}) == digest
    empty = out[out.vec_id == 157].iloc[0]
    assert empty.code == "00" * 16 and empty.error == 0
    if scale <= 1:
        total = {}
        for r in out.itertuples():
            total.setdefault(plain([r.label])[0], []).append(r.error)
        assert all(r.label_error == sum(total[plain([r.label])[0]]) for r in out.itertuples())


def test_codes_of_lengths_that_cannot_be_cut_and_of_nothing(spark):
    rows = [(1, [1.0] * 5, 0), (2, [2.0] * 16, 0), (None, [2.0] * 48, 0)]
    coded, books = codes.encode(vectors(spark, rows))
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.with_label_errors(coded).collect()}
    assert got == {1: (None, None, 0), 2: ("00" * 16, 0, 0), None: (None, None, 0)} and list(books) == [16]
    coded, _ = codes.encode(vectors(spark, []))
    assert codes.with_label_errors(coded).count() == 0


def test_trees_prune_and_agree_with_all_distances():
    r = np.random.default_rng(3)
    centres = r.integers(-4000, 4000, (20, 4))
    x = (centres[r.integers(0, 20, 3000)] + r.integers(-20, 21, (3000, 4))).astype(np.int64)
    tree = codes.build_tree(x)
    entries = centres.astype(object)
    assert (codes.nearest_entries(tree, x, entries) == codes.distances(x, entries).argmin(axis=1)).all()
    looked_at = sum(len(what) for what, _, single in codes.assign(tree, x, entries) if single)
    assert looked_at < 100  # whole balls are owned
    assert sorted(tree.order) == list(range(3000)) and (tree.total[0] == x.sum(axis=0)).all()
    same = codes.build_tree(np.ones((500, 4), np.int64))
    assert codes.entry_sums(same, np.ones((500, 4), np.int64), np.ones((3, 4), dtype=object)) == {0: (500, [500] * 4)}


PROSE = "The river, the mill and the old bridge stood, as ever, in the grey light of morning. Nobody came, nobody left."


def test_main_text_of_a_page_with_all_kinds_of_noise():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="home has-sidebar">
    <header><a href=/>Site</a></header><nav><ul><li><a href=a>A</a></ul></nav>
    <div class="cookie-notice"><p>{PROSE} We use cookies.</p></div><div role="alert"><p>{PROSE} Alert.</p></div>
    <div id="content"><div class="post"><h1>The &quot;Mill&quot;</h1><p>{PROSE}<p>Second&nbsp;one, &#233;t&eacute;,
      <b>bold <i>words</b></i><br>and so on, and on.</p><div class="ad-container"><p>{PROSE} Buy now, buy here, buy.</p></div>
      <ul><li>First thing</li><li>Other <a href=x>thing</a> of the list</li></ul><script>var t = "</p>";</script>
      <form><label>Mail</label><input></form><div class="share-buttons"><a>f</a> <a>t</a></div></div>
      <section id="user-comments"><article class="comment"><p>{PROSE} I agree, really, I do, I do.</p></article></section></div>
    <aside><p>{PROSE} Aside.</p></aside><footer>&copy; all</footer></body></html>"""
    want = f'The "Mill" {PROSE} Second one, été, bold words and so on, and on. First thing Other thing of the list'
    assert maintext.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words < 3 & more", "plain words < 3 & more"),
        ("<article><h1>Only a head</h1></article><footer>x</footer>", "Only a head"),
        (f"<article><div class=promo><p>{PROSE}</article><p>x", "x"),
        (f"<nav><p>{PROSE}</nav><article><p>Short.</article>", "Short."),
        (f"<article><p>{PROSE}<!-- a > b --><p>After &am", f"{PROSE} After &am"),
        (f"<article><p>{PROSE}<script>never closed <p>{PROSE}", PROSE),
        (f"<article><section><p>{PROSE}</section><section><p>Brief.</section></article>", f"{PROSE} Brief."),
        (f"<div><h1>Head</h1><div><p>{PROSE}<p>{PROSE}</div><p>Tail, too short</p><p>A sentence.</p></div>", f"Head {PROSE} {PROSE} A sentence."),
        (f"<main><p>{PROSE}</p><div><a href=1>More</a> <a href=2>Of it</a></div></main>", PROSE),
        (f"<body><p title='a>b' class=\"x\">{PROSE}", PROSE),
        ("\u0000 \t<p>\ud83d".encode("utf-8", "ignore").decode() + "x</p>", None),
    ],
)
def test_main_text_of_small_and_broken_pages(page, text):
    got = maintext.main_text(page)
    assert got == text if text is not None else "x" in got


def test_extract_takes_every_row(spark):
    rows = [(1, "u", f"<p>{PROSE}"), (1, "u", f"<p>{PROSE}"), (None, None, None), (2, "v", ""), (3, "w", "<div>" * 50_000 + "deep")]
    rows = [(*r, "t", 9, "x") for r in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, batch string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in maintext.extract(df).collect()), key=str)
    n = len(PROSE)
    assert got == sorted([(0, None, "", 0), (1, "u", PROSE, n), (1, "u", PROSE, n), (2, "v", "", 0), (3, "w", "deep", 4)], key=str)
    assert maintext.extract(df.where("false")).count() == 0
