"""Brute-force comparisons and edge rows of the training-data operators."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash

from marketweek.llm import (
    attribution, components, divergence, licences, packing, pivots, sampling, simhash, slots, windows, wrappers,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that for it with be river stone garden winter letter window market copper".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) * (rng.random() < 0.6) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    shared = prose(99, 70)
    texts = [prose(k, 30 + 13 * k) for k in range(12)]
    texts[7] = texts[3]
    texts[8] = texts[5].replace(texts[5].split()[40], "changed", 1)
    texts[9] = prose(50, 80) + "\n" + shared + "\n" + prose(51, 60)
    texts[10] = prose(52, 90) + "\n" + shared + "\n" + prose(53, 30)
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rows += [(12, None, None, None, None), (13, "", "xx", "s", 0), (14, "one", "de", "s", 3), rows[2], rows[2]]
    rows.append((None, prose(60, 40), "en", "s", 1))
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_places_every_id_once(corpus, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = packing.pack(corpus, sequence=64).toPandas()
    rows = corpus.toPandas().drop_duplicates("doc_id")
    for r in rows.itertuples():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id.isna() if np.isnan(r.doc_id) else out.doc_id == r.doc_id]
        copies = 3 if r.doc_id == 2 else 1
        assert mine.length.sum() == copies * len(ids) and (mine.doc_tokens == len(ids)).all()
        pieces = mine.sort_values("start")
        if copies == 1:
            assert pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]]
        for p in pieces.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    filled = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (filled.sum() < 64).sum() <= 1 and filled.sum().max() == 64
    assert packing.pack(empty).count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([[x, y] for x in range(side) for y in range(side)])
    ordered = cells[np.argsort(packing.hilbert_key(cells, bits=3))]
    assert (np.abs(np.diff(ordered, axis=0)).sum(1) == 1).all()


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_groups(corpus, empty):
    out = simhash.near_duplicates(corpus).toPandas()
    rows = corpus.toPandas()
    assert len(out) == len(rows)
    prints = {k: plain_fingerprint(t) for k, t in zip(rows.doc_id, rows.text) if k == k}
    group = {k: k for k in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    for r in out[out.doc_id.notna()].itertuples():
        assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == group[r.doc_id]
    kept = simhash.keep_one(corpus).toPandas()
    assert sorted(kept.doc_id.dropna()) == sorted({k for k in group if group[k] == k}) and kept.doc_id.isna().sum() == 1
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()


def test_covering_masks_lose_no_pair(spark):
    rng = random.Random(5)
    for _ in range(3000):
        difference = sum(1 << p for p in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not difference & m for m in simhash.MASKS)
        mask = next(k for k, m in enumerate(simhash.MASKS) if not difference & m)
        assert any(not difference & m for m in simhash.INNER[mask])
    # A crowd in one bucket: the second covering must connect what all pairs connect.
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.close_edges(spark.createDataFrame(signed, "print long"), bucket=16)
    found = components.connected_components(edges).toPandas()
    array = np.array(values, np.uint64)
    a, b = simhash.close_forest(array)
    assert len(a) == len(array) - 1 and found.component.nunique() == 1 and len(found) == len(values)


def test_neighbour_forest_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(2)
    free = tuple(range(10))
    values = np.array(sorted({sum(1 << p for p in range(10) if rng.random() < 0.5) for _ in range(500)}), np.uint64)
    monkeypatch.setattr(simhash, "RADIUS", 1)
    a, b = simhash.neighbour_forest(values, free, 1)
    c, d = simhash.close_forest(values, 1)
    assert len(a) == len(c) and (np.bitwise_count(a ^ b) <= 1).all()


def test_components(spark):
    rows = [(1, 2), (2, 1), (3, 3), (4, 2), (9, 8), (7, 9), (None, 5), (8, 8)] + [(k, k + 1) for k in range(20, 40)]
    got = components.connected_components(spark.createDataFrame(rows, "a long, b long")).toPandas()
    want = {1: 1, 2: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {k: 20 for k in range(20, 41)}
    assert dict(zip(got.node, got.component)) == want and len(got) == len(want)


def test_pivot_index_recall_and_counts(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    vectors = [centres[k % 40] + 0.25 * rng.standard_normal(32) for k in range(400)] + [centres[0]] * 30
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(vectors)]
    bad = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] * 32, 0), (904, [1.0], 0),
           (905, [float("inf")] + [0.0] * 31, 0), (None, rows[0][1], 0), (906, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    out = pivots.near_vectors(df).toPandas()
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    mine = out[out.vec_id < 900].sort_values("vec_id")
    assert len(out) == len(rows) + len(bad)
    assert (mine.n_links.to_numpy() <= close.sum(1)).all() and mine.n_links.sum() >= 0.9 * close.sum()
    rest = out[(out.vec_id >= 900) | out.vec_id.isna()]
    assert (rest.n_links == 0).all() and (rest.component_id.dropna() == rest.vec_id.dropna()).all()
    assert (mine.kept == (mine.vec_id == mine.component_id)).all()
    assert pivots.near_vectors(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("n, block", [(900, 64), (3000, 1024)])
def test_pivot_index_finds_every_link_of_a_noisy_group(spark, monkeypatch, n, block):
    # A third of all vectors around one centre; the rest in small groups and alone.
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "MAX_BLOCK", block)
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((20, 64))
    spread = np.array([0.25 if k % 3 < 2 else 2.0 for k in range(n)])[:, None]
    of = [0 if k % 3 == 0 else k % 20 for k in range(n)]
    x = (centres[of] + spread * rng.standard_normal((n, 64))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = pivots.near_vectors(df).toPandas().sort_values("vec_id")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    label = np.arange(n)
    while (label != (now := np.where(close, label, n).min(axis=1))).any():
        label = now
    assert out.n_links.tolist() == (close.sum(axis=1) - 1).tolist()
    assert out.component_id.tolist() == label.tolist()


def test_vectors_of_every_length_link(spark):
    rows = [(k, [1.0, 0.0, float(k % 2)]) for k in range(6)]
    rows += [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 0.1]), (13, [0.0, 1.0]), (20, [5.0]), (21, [2.0]), (30, [1.0] * 7)]
    out = {r.vec_id: r for r in pivots.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    for a, x in rows:
        links = {b for b, y in rows if b != a and len(x) == len(y) and
                 np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9}
        assert out[a].n_links == len(links) and out[a].component_id == min(links | {a})


def test_pivot_bounds_rule_out_only_far_cells():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = pivots.leaders(x[:80], 0.9)
    near = x @ chosen.T
    home = near.argmax(axis=1)
    radius = np.array([np.arccos(near[home == k, k].clip(-1, 1)).max(initial=0) for k in range(len(chosen))])
    to = pivots.reached(near, home, chosen, radius, 0.9)
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert to[a, home[b]].all() and to.mean() < 0.5


def test_attribution_adds_up(corpus, empty):
    out = attribution.attribute(corpus).toPandas()
    one = out[out.doc_id.notna() & (out.doc_id != 2)].groupby("doc_id")
    assert (one.tokens.sum() == one.doc_tokens.first()).all()
    assert out[out.doc_id == 12].tokens.tolist() == [0.0]
    ends, starts, stops = np.array([3, 6, 9]), np.array([0, 5]), np.array([5, 8])
    assert attribution.allocate(ends, starts, stops, "most").tolist() == [2, 1]
    assert attribution.allocate(ends, starts, stops, "first").tolist() == [2, 1]
    assert np.allclose(attribution.allocate(ends, starts, stops, "shares"), [1 + 2 / 3, 1 / 3 + 2 / 3])
    assert attribution.attribute(empty).count() == 0


def test_samples_decode_and_differ(corpus, empty):
    out = sampling.segmentations(corpus, samples=4).toPandas()
    texts = {k: t or "" for k, t in zip(*corpus.toPandas()[["doc_id", "text"]].T.values) if k == k}
    for r in out[out.doc_id.notna()].itertuples():
        assert r.decoded == texts[r.doc_id]
    once = out[(out.doc_id != 2) & out.doc_id.notna()]
    for _, g in once.groupby("doc_id"):
        assert len({tuple(i) for i in g.ids}) == len(g)
        assert g.sort_values("sample").perturbed.is_monotonic_decreasing and g.inclusion.between(0, 1).all()
    assert sampling.segmentations(empty).count() == 0


def test_samples_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(5)
    words = ["tion", "re-use", "Straße", "\U0001f600", "a", "\n", "naïve", "counting", "x" * 40]
    texts = [" ".join(rng.choice(words, n)) for n in (30, 1, 0, 12, 80, 3)] + ["", " ", "a"]
    grid = sampling.Lattice(__import__("public_tokenizers").path(sampling.MODEL))
    rows = grid.codes(texts)
    new = lambda: [np.random.Generator(np.random.Philox(key=[3, k])) for k in range(len(texts))]
    together = sampling.all_segmentations(grid, rows, 5, new())
    for text, row, rng, found in zip(texts, rows, new(), together):
        alone = sampling.top_segmentations(grid, row, 5, rng)
        assert len(found) == len(alone)
        for (a, *x), (b, *y) in zip(found, alone):
            assert a.tolist() == b.tolist() and x == y
            assert grid.decode(grid.ids(a)[0]) == text == grid.model.decode(grid.ids(a)[0].tolist())


def test_samples_follow_the_distribution():
    grid = sampling.Lattice(__import__("public_tokenizers").path(sampling.MODEL))
    (units,) = grid.codes(["tion"])
    counts, n = {}, 3000
    for k in range(n):
        (edges, log_p, *_), = sampling.top_segmentations(grid, units, 1, np.random.Generator(np.random.Philox(key=[1, k])))
        key = tuple(edges)
        counts.setdefault(key, [np.exp(log_p), 0])[1] += 1
    assert all(abs(p - c / n) < 0.04 for p, c in counts.values())
    many = sampling.top_segmentations(grid, units, 500, np.random.Generator(np.random.Philox(key=[1, 1])))
    assert abs(sum(np.exp(p) for _, p, *_ in many) - 1) < 1e-6 and all(s[3] == 1.0 for s in many)


PAGE = """<html><head><title>x</title><script>var a="</p>";</script></head><body><header>Site</header>
<nav><a>Home</a></nav><div class=top>Same line on every page</div><div class="ad">Buy {k}</div>{body}
<div id="comments"><p>Nice {k}</p></div><form>Mail</form><footer>&copy; me</footer></body></html>"""


def test_wrappers(spark):
    rows = [(k, f"https://a.example/{k}", PAGE.format(k=k, body=f"<div><h1>T{k} &amp; more</h1><p>First \n {k}<br>next<p>Second {k}")) for k in range(6)]
    rows += [(10, "https://b.example/1", PAGE.format(k=1, body="<article><p>Only</p></article>")), (11, None, None), (12, "bad", ""),
             (13, "https://b.example/2", "<p>lone <b>text"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = wrappers.extract(df).toPandas()
    assert len(out) == len(rows)
    texts = dict(zip(out.page_id, out.text))
    for k in range(6):
        assert texts[k] == f"T{k} & more\nFirst {k} next\nSecond {k}"
    assert texts[10] == "Only" and texts[11] == "" == texts[12] and texts[13] == "lone text"
    assert (out.n_chars == out.text.str.len()).all()
    assert wrappers.extract(df.where("page_id < 0")).count() == 0


def _tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return ("#text", int(rng.integers(3)), 1, False)
    return (rng.choice(["div", "p", "ul"]), [_tree(rng, depth - 1) for _ in range(rng.integers(0, 5))])


def _largest(a, b):
    """Largest match of two trees by plain recursion."""
    if a[0] != b[0]:
        return 0
    if a[0] == "#text":
        return 1

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), _largest(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[1], b[1])


def test_tree_matching_is_largest():
    rng = np.random.default_rng(5)
    matcher = wrappers.Matcher()
    for _ in range(60):
        a, b = ("body", [_tree(rng) for _ in range(4)]), ("body", [_tree(rng) for _ in range(4)])
        x, y = matcher.shaped(a), matcher.shaped(b)
        assert matcher.size(x[0], y[0]) == _largest(a, b)
        pairs = matcher.align(x[0], y[0])
        assert sum(matcher.size(x[3][i][0], y[3][j][0]) for i, j in pairs) + 1 == _largest(a, b)
        assert all(i > k and j > m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_forgetful_references_and_deep_pages():
    pages = [f"<body><nav>n</nav><div>same</div>{'<p>x %d</p>' % k * (k % 4)}</body>" for k in range(12)]
    packed = wrappers.pickle.dumps((wrappers.digest(wrappers.parse(pages[1])), frozenset({1})))
    large, none = wrappers.References(), wrappers.References(0, 0)
    assert [wrappers.main_text(p, packed, large) for p in pages] == [wrappers.main_text(p, packed, none) for p in pages]
    assert wrappers.main_text(pages[2], packed, large) == "x 2\nx 2"
    deep = "<div>" * 3000 + "a<p>b</p>c" + "</div>" * 3000
    assert wrappers.main_text(deep, packed) == "a\nb\nc"


def test_slots(corpus, empty, spark, tmp_path):
    out = slots.shard(corpus, shards=3).toPandas()
    rows = corpus.toPandas()
    assert sorted(out["size"]) == sorted(len((t or "").encode()) + 1 for t in rows.text)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    totals = {k: 10 + k % 7 for k in range(500)}
    first = slots.first_map(totals, 8)
    grown = slots.rebalanced(first, totals, 9)
    fill = [sum(totals[s] for s in totals if grown[s] == k) for k in range(9)]
    assert max(fill) - min(fill) <= 16
    slots.store_map(spark, str(tmp_path / "map"), first, 0)
    slots.store_map(spark, str(tmp_path / "map"), grown, 1)
    assert slots.load_map(spark, str(tmp_path / "map")) == grown and slots.load_map(spark, str(tmp_path / "map"), 0) == first
    assert slots.shard(empty).count() == 0


def test_divergence(spark, empty):
    line = "the same eight words are found here twice"
    texts = [prose(k, 150) for k in range(20)] + [f"{line}\n{line}\n" + prose(1, 40), "short", None, "x " * 40,
                                                  " ".join(w + "%%%" for w in prose(3, 150).split()), "\n\n" + prose(4, 30)]
    rows = [(k, t, "en", k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    out = divergence.quality(df).toPandas().set_index("doc_id")
    for k, text in enumerate(texts):
        words = (text or "").split()
        seen = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {i + d for v in seen.values() if len(v) > 1 for i in v for d in range(8)}
        lines = [x for x in (text or "").split("\n") if x.strip()]
        r = out.loc[k]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
    assert out.kept.loc[list(range(20))].all() and not out.kept.loc[[21, 22, 23, 24]].any()
    good = divergence.keep_good(df)
    assert good.columns == df.columns and good.count() == out.kept.sum()
    assert divergence.quality(empty).count() == 0


def test_passages(corpus, empty):
    out = windows.repeated_passages(corpus).toPandas()
    rows = corpus.toPandas().drop_duplicates("doc_id").set_index("doc_id").text
    pairs = set(zip(out.doc_id, out.other_doc_id))
    assert {(7, 3), (10, 9), (8, 5)} <= pairs and all(a > b for a, b in pairs)
    ten = out[(out.doc_id == 10) & (out.other_doc_id == 9)].iloc[0]
    assert ten.start_word <= 90 and ten.start_word + ten.n_words >= 160
    for r in out.itertuples():
        part = rows[r.doc_id][r.start_char : r.start_char + r.n_chars]
        assert len(part.split()) == r.n_words >= 50
    left = windows.without_repeats(corpus)
    assert left.columns == corpus.columns and left.count() == corpus.count()
    text = {r.doc_id: r.text for r in left.collect()}
    assert text[3] == rows[3] and text[7] == "" and text[9] == rows[9] and text[12] is None
    assert len(text[10].split()) < 60 + 70
    assert windows.repeated_passages(empty).count() == 0 == windows.without_repeats(empty).count()


def test_rows_of_one_id_and_clashing_columns(spark):
    # Two texts under one id, and columns named like those inside the operators.
    shared, first, second = prose(700, 70), prose(701, 60), prose(702, 60)
    rows = [
        (1, f"{first} {shared} {prose(703, 20)}"), (2, f"{second} {shared}"), (2, prose(704, 150)),
        (2, prose(704, 150)), (3, prose(705, 80)), (None, shared), (4, None),
    ]
    names = ["_place", "_lost", "_spans", "_doc_id", "body", "row", "place", "spans", "value", "component", "print"]
    docs = spark.createDataFrame(
        [(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)
    ).repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = [r for k, r in enumerate(rows) if k != 3]
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    left = windows.without_repeats(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=key)
    assert len(got) == len(rows) and all(r["body"] == 4 for r in left.collect())
    assert [t for d, t in got if d == 2].count(prose(704, 150)) == 2
    assert any(d == 2 and t.startswith(second) and len(t) < len(second) + 10 for d, t in got)
    assert (None, shared) in got and (4, None) in got and (1, rows[0][1]) in got
    none = docs.where("doc_id > 9")
    assert simhash.keep_one(none).count() == 0 == windows.without_repeats(none).count()


def test_near_copies_of_one_id_are_one_document(spark):
    text = prose(710, 400)
    rows = [(1, text), (1, text + " end"), (2, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert groups == {1} and simhash.keep_one(docs).count() == 1


def test_very_long_text_has_its_passages(spark):
    # One text of a million words; the passage lies at its end.
    shared = prose(720, 80)
    long = prose(721, 1_000_000) + " " + shared
    docs = spark.createDataFrame([(1, shared), (2, long)], "doc_id long, text string")
    out = windows.repeated_passages(docs).collect()
    assert any(r.doc_id == 2 and r.start_word <= 1_000_000 and r.start_word + r.n_words == 1_000_080 for r in out)


def test_passages_of_lines_that_others_also_have(spark):
    # A block of two lines in some documents; all others have one of the lines.
    lines = [prose(200, 30), prose(201, 30)]
    block = set(range(7, 600, 40))
    rows = []
    for k in range(600):
        middle = lines if k in block else [lines[k % 2]]
        rows.append((k, "\n".join([prose(1000 + k, 45), *middle, prose(3000 + k, 45)])))
    out = windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    whole = out[(out.n_words >= 60) & out.other_doc_id.isin(block)]
    assert set(whole.doc_id) == block - {min(block)}


def test_passages_link_all_different_texts(spark):
    # Variants of some passages, one word changed in each so that none holds another's 50 words,
    # and a line that strangers share.
    rng = random.Random(11)
    line, rows = prose(800, 18), []
    for g in range(6):
        passage = prose(810 + g, 60).split()
        for k in range(20):
            words = list(passage)
            words[rng.randrange(12, 48)] = f"other{k}"
            n = len(rows)
            rows.append((n, " ".join([prose(2000 + n, 30), " ".join(words if k else passage), prose(4000 + n, 30)])))
    for _ in range(60):
        n = len(rows)
        rows.append((n, " ".join([prose(2000 + n, 40), line, prose(4000 + n, 40)])))
    rng.shuffle(rows)
    hashed = {n: windows.shingles(windows.word_hashes(text, windows.WordHashes())) for n, text in rows}
    want = {(a, b) for a in hashed for b in range(a) if windows.similar_spans(hashed[a], hashed[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.other_doc_id) for r in windows.repeated_passages(docs).collect()}
    assert got == want and len(want) > 6 * 19


def test_runs_link_classes_by_their_first_rows():
    rng = np.random.default_rng(6)
    around = lambda *parts: np.concatenate(parts).astype(np.uint16)
    some = lambda n: rng.integers(1, 1 << 16, n)
    key, tail, head = some(10), some(46), some(46)
    copies = [around(some(46), key, tail) for _ in range(40)]
    strangers = [around(some(46), key, some(46)) for _ in range(5)]
    # Unlike the first copy, like the third one: with its beginning, and an end of its own.
    copies[2][:46] = head
    odd = around(head, key, some(46))
    rows = [*copies, *strangers, odd]
    assert windows._links(np.arange(len(rows)), np.stack(rows)) == (
        {(i, 0) for i in range(1, 40)} | {(i, i - 1) for i in range(2, 40)} | {(45, 2)})
    assert windows._links(np.zeros(46, np.int64), np.stack(rows)) == set()


def test_classes_of_near_copies_need_few_pairs(spark):
    # Copies of one text, each with words of its own, two groups that a bridge leads to, strangers.
    rng = random.Random(21)
    base, rows = prose(900, 200).split(), []
    for n in range(150):
        words = list(base)
        for at in rng.sample(range(200), 4 if n else 0):
            words[at] = f"own{n}x{at}"
        rows.append((n, " ".join([prose(5000 + n, 20), *words, prose(6000 + n, 20)])))
    ends = [prose(910 + k, 60) for k in range(2)]
    rows += [(200 + n, f"{prose(7000 + n, 30)} {ends[n % 2]}") for n in range(8)] + [(210, " ".join(ends))]
    rows += [(300 + n, prose(8000 + n, 90)) for n in range(20)]
    rows.append((310, rows[40][1]))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    every, few = windows.repeated_passages(docs).collect(), windows.passage_classes(docs).collect()
    root = {d: d for d, _ in rows}
    for r in every:
        a, b = root[r.doc_id], root[r.other_doc_id]
        root = {d: min(a, b) if c in (a, b) else c for d, c in root.items()}
    assert {r.doc_id for r in few} == {r.doc_id for r in every} and all(root[r.doc_id] == r.class_id for r in few)
    assert {r.class_id for r in few} == {0, 200}
    pairs = [len({(r.doc_id, r.other_doc_id) for r in found}) for found in (every, few)]
    assert pairs[1] < 0.4 * pairs[0]
    # What is cut is the same but for a few words at the ends.
    held = [{(r.doc_id, w) for r in found for w in range(r.start_word, r.start_word + r.n_words)} for found in (every, few)]
    assert len(held[0] - held[1]) < 0.02 * len(held[0])


def test_pairs_of_a_run_grow_with_its_rows():
    rng = np.random.default_rng(8)
    base = rng.integers(1, 1 << 16, 102).astype(np.uint16)
    for n in (200, 800):
        rows = np.tile(base, (n, 1))
        for row in rows[1:]:
            for at in rng.choice([*range(40), *range(57, 97)], 2):
                row[at : at + 5] = rng.integers(1, 1 << 16, 5)
        pairs = windows._connecting(np.zeros(n, np.int64), np.arange(n), rows, np.zeros(n, bool))
        assert len(pairs) < 3 * n
        reached = {0}
        for a, b in pairs.tolist():
            reached |= {a} if b in reached else set()
        assert len(reached) > 0.9 * n
    assert len(windows._links(np.arange(200), rows[:200])) > 10 * 200


def test_passages_with_ambiguous_parts(monkeypatch):
    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    passage = some(50)
    hashed = lambda *parts: windows.shingles(np.concatenate(parts))
    x = hashed(some(20), passage, some(20))
    head = hashed(some(5), passage[:20], some(30), passage, some(10))
    tail = hashed(some(5), passage, some(30), passage[-25:], some(10))
    both = hashed(passage[:27], some(30), passage[23:], some(9), passage, some(9), passage[:27], some(9), passage[23:])
    for y, at in ((head, 55), (tail, 5), (both, 27 + 30 + 27 + 9)):
        assert windows.similar_spans(x, y) == [(20, 66, at, at + 46, 1.0)]
    for size in (1, 50):
        monkeypatch.setattr(windows, "PAIRED", size)
        u, v = rng.integers(0, 3, 40).astype(np.uint64), rng.integers(0, 3, 30).astype(np.uint64)
        runs = {(int(a) + d, int(b) + d) for a, b, n in zip(*windows.diagonals(windows.Matches(u, v))) for d in range(n)}
        assert runs == set(zip(*(c.tolist() for c in np.nonzero(u[:, None] == v))))


def test_word_places_count_characters():
    text = " 양파 a\tb\n\né무x \u00a0y\x0b"
    places = list(zip(*(p.tolist() for p in windows.word_places(text))))
    assert [text[a:b] for a, b in places] == [w.decode() for w in text.encode().split()]
    assert not len(windows.word_places("")[0])


def test_compact_windows_cover_each_range_once():
    values = np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64)
    l, c, r = windows.compact_windows(values, np.array([0, 25]), np.array([25, 60]), 6)
    for lo, hi in ((0, 25), (25, 60)):
        for a in range(lo, hi):
            for b in range(a + 5, hi):
                least = a + int(np.argmin(values[a : b + 1] >> np.uint64(24)))
                inside = (l <= a) & (a <= c) & (c <= b) & (b <= r)
                assert inside.sum() == 1 and c[inside][0] == least


def test_licences(spark, empty):
    lines = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.",
        3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.",
    }
    rows = [(k, f"{prose(k, 40)}\n{t}\n{prose(k + 9, 30)}") for k, t in lines.items()]
    rows += [(k, prose(k, 60)) for k in range(20, 60)] + [(70, None), (71, ""), (None, "plain words only")]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(out.doc_id, out.family)) == {1: "apache-2.0", 2: "mit", 3: "gpl", 4: "cc-by-nc"}
    assert (out.paragraph == 1).all()
    assert licences.scan(empty).count() == 0


def test_two_words_in_turn_link_in_proportion():
    rng = np.random.default_rng(8)
    m, around = 200, windows.GRAM + 2 * windows.REACH
    rows = rng.integers(100, 60_000, (m, around)).astype(np.uint16)
    for k, row in enumerate(rows):
        # The shingles of two words in turn around the key, more or fewer of them before it.
        before = 2 * (k % 15)
        row[windows.REACH - before : windows.REACH + 50] = np.resize([7, 9], before + 50)
    links = windows._forest(np.arange(m), rows, np.zeros(m, bool))
    assert len(links) < 2 * m
    root = list(range(m))
    for a, b in sorted(links):
        root = [root[b] if r == root[a] else r for r in root]
    assert len(set(root)) == 1
