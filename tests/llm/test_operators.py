"""Each operator against brute force on small inputs, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codrel.llm import components, decontamination, fingerprints, html_text, jaccard_join, licenses, line_dedup, packing, quality, sharding, token_files
from codrel.llm.tokens import Encoder

NO_ID = -(2**63)
WORDS = "the of a in on is to and that it for was as with be by this from are at or an".split()


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def prose(g: random.Random, n: int) -> str:
    return " ".join("".join(g.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(g.randint(1, 4))) if g.random() < 0.7 else g.choice(WORDS) for _ in range(n))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Texts with exact and near copies, shared lines, empties, nulls and one long text; an id is null, one row is repeated."""
    g = random.Random(seed)
    texts: list = []
    for _ in range(n):
        kind = g.random()
        if texts and kind < 0.15:
            texts.append(g.choice(texts))
        elif texts and kind < 0.45 and (old := g.choice(texts)):
            words = old.split(" ")
            words[g.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        else:
            texts.append("\n".join(prose(g, g.randint(1, 60)) for _ in range(g.randint(1, 4))))
    texts += [None, "", " \n\t ", "one two", prose(g, 5000), "é" * 3000, "licensed under the Apache License, Version 2.0"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[5])]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], "doc_id long, text string, line string, key int, score int, label string").repartition(3)
    return df, rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# -- tokens, packing, files ------------------------------------------------------------------


def test_encoder_equals_library():
    path, g = vocabulary(), random.Random(1)
    enc = Encoder(path, words_kept=50)
    parts = [" ", " ", "  ", "\n", "\t", "a", "B", "é", "'s", "'", "12", "!", "***", "<|endoftext|>", "日本", " ", "\x1c", "\r\n", "👍🏽"]
    texts = ["".join(g.choice(parts) for _ in range(g.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in corpus()]
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        for text, raw in zip(some, enc.encode(some), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_takes_words_at_new_lines_apart():
    """Their pairs are not kept, and their ids are the library's whatever stands at the line's end and start."""
    enc, g = Encoder(vocabulary()), random.Random(2)
    parts = ["end.", "Word", "don't", "'s", "don'", "12", "é%%%", "été", "«", "日本", "$#@!", "x_y", "\0", "I'll,"]
    texts = [" ".join("\n".join(g.choice(parts) for _ in range(g.randint(1, 4))) for _ in range(12)) for _ in range(400)]
    for some in (texts[:200], texts[200:], texts):
        for text, raw in zip(some, enc.encode(some), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"end.", "Word"} <= set(enc.known) and not any("\n" in w for w in enc.known)


def test_best_fit_holds_every_capacity():
    g = np.random.default_rng(0)
    lengths = np.sort(g.integers(1, 100, 400))[::-1]
    for caps in ((100, 100, 1e9), (100, 3, 1e9), (100, 100, 5000)):
        caps = (caps[0], caps[1], max(caps[2], 100.0**2) if caps[2] == 1e9 else 10_000.0)
        for rule in ("norm", "dot"):
            bins, offsets = packing.best_fit(lengths, caps, (1, 0.1, 0.1), rule)
            for b in np.unique(bins):
                mine = np.flatnonzero(bins == b)
                order = mine[np.argsort(offsets[mine])]
                assert (np.r_[0, np.cumsum(lengths[order])[:-1]] == offsets[order]).all()
                assert lengths[mine].sum() <= caps[0] and len(mine) <= caps[1] and (lengths[mine].astype(float) ** 2).sum() <= caps[2]
    small = lengths[lengths <= 60]
    bins, _ = packing.best_fit(small, (100, 100, 1e4), (1, 0, 0))
    assert bins.max() + 1 <= -(-small.sum() // 100) + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), (100, 9, 1e9), (1, 0, 0))


def test_packing(spark, docs, none):
    path = vocabulary()
    df, rows = docs
    out = packing.packed(df, path, capacity=64, end_id=0, tokens_per_group=2000).toPandas()
    enc = Encoder(path)
    whole = defaultdict(list)
    for d, t in rows:
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        whole[d] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = defaultdict(list)
    for r in out.itertuples():
        got[None if r.doc_id != r.doc_id else int(r.doc_id)].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in whole.items()}
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["length"].cumsum() - seq["length"] == seq["offset"]).all() and seq["length"].sum() <= 64
    assert packing.packed(none, path).count() == 0


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    raw = token_files.pack_bits(ids, width)
    assert len(raw) == -(-len(ids) * width // 8) and (token_files.unpack_bits(raw, width, len(ids)) == ids).all()


def test_random_access(tmp_path):
    g = np.random.default_rng(0)
    each = [g.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 99, 100, 350, 0, 7)]
    with open(tmp_path / "t.bin", "wb") as out:
        w = token_files.Writer(out, token_files.width_of(5000), ids_per_block=100)
        for k, ids in enumerate(each):
            w.add(k, ids)
        w.close()
    with open(tmp_path / "t.bin", "rb") as source:
        r = token_files.Reader(source, (tmp_path / "t.bin").stat().st_size)
        flat = np.concatenate(each)
        assert r.width == 13 and r.doc_ids.tolist() == list(range(7))
        for k in (4, 0, 6, 3):
            assert (r.document(k) == each[k]).all()
        for a, b in ((0, 557), (99, 101), (250, 250), (556, 557)):
            assert (r.ids(a, b) == flat[a:b]).all()


def test_token_files(docs, none):
    path = vocabulary()
    df, rows = docs
    manifest = token_files.write_files(df, path, end_id=2, ids_per_block=128)
    out = token_files.read_files(manifest, ids=True).collect()
    enc = Encoder(path)
    expected = sorted(((NO_ID if d is None else d), [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows)
    got = sorted(out, key=lambda r: r.start)
    assert [NO_ID if r.doc_id is None else r.doc_id for r in got] == [d for d, _ in expected]
    assert sorted((NO_ID if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == expected
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert token_files.read_files(token_files.write_files(none, path)).count() == 0


# -- sharding ------------------------------------------------------------------------------


def test_sharding(spark, docs, none):
    g = random.Random(4)
    rows = [(i, prose(g, g.randint(1, 40))) for i in range(1500)] + [(2000 + i, "the same text") for i in range(800)] + [(None, None), (1, None), (1, None)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=8).toPandas()
    assert len(out) == len(rows) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    expected = sorted((NO_ID if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(zip(out["doc_id"].fillna(NO_ID).astype("int64"), out["size"], out["text_crc32"], strict=True)) == expected
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.03 * sizes.mean() + 2 * out["size"].max()
    for _, shard in out.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    few = out[out["text_crc32"] != zlib.crc32(b"the same text")].groupby("text_crc32")["shard"].nunique()
    assert (few == 1).all()
    assert sharding.shard(none).count() == 0
    assert sharding.shard(docs[0]).count() == len(docs[1])


# -- quality ---------------------------------------------------------------------------------


def test_quality(spark, none):
    g = random.Random(3)
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        text = prose(g, g.randint(5, 80))
        if bad:
            text = " ".join(w + "***" for w in text.split()) if i % 8 else " ".join(f"{w} {w} {w}" for w in text.split()[:20])
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels[:500], (3, 0), (None, 1), (5, None)], "doc_id long, label int")
    model = quality.fit_table(df, marks)
    out = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    held = [(out[i], y) for i, y in labels[500:]]
    assert all(0 <= s <= 1 for s, _ in held) and sum((s >= 0.3) == (y == 1) for s, y in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(None, None, 7), (2**60 + 1, "", 8), (9, "x" * 200_000, 9)], "doc_id long, text string, score int")
    scored = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert set(scored) == {None, 2**60 + 1, 9} and scored[None] == scored[2**60 + 1]
    assert quality.score(none, model).count() == 0
    alone = quality.fit_table(df, marks.filter("label = 1"))
    assert alone.score("anything") == alone.score("") > 0.5
    assert quality.fit_table(none, marks).score("a") == 0.5


def test_dual_coordinate_descent_optimum():
    """The primal and dual objectives meet."""
    g = np.random.default_rng(0)
    rows = [np.unique(g.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    y = np.array([int(r.sum() % 2) for r in rows])
    ratios = np.zeros(quality.SLOTS)
    ratios[:40] = g.normal(size=40)
    w, bias = quality.dual_coordinate_descent(rows, y, ratios, cost=0.5, epochs=3000)
    signs, x = np.where(y == 1, 1.0, -1.0), []
    for r in rows:
        v = np.zeros(41)
        v[r] = ratios[r] / np.sqrt((ratios[r] ** 2).sum())
        v[40] = 1
        x.append(v)
    full = np.r_[w[:40], bias]
    cost = np.where(y == 1, 0.5 * 60 / (2 * y.sum()), 0.5 * 60 / (2 * (60 - y.sum())))
    primal = lambda u: 0.5 * u @ u + (cost * np.maximum(0, 1 - signs * (np.array(x) @ u))).sum()
    best = primal(full)
    for _ in range(300):
        assert best <= primal(full + g.normal(size=41) * 0.05) + 1e-6


# -- line dedup --------------------------------------------------------------------------------


def edits(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, e in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
        p = q
    return p[-1]


def changed(g: random.Random, text: str, n: int, letters: str = "abc é") -> str:
    out = list(text)
    for _ in range(n):
        k, o = g.randint(0, len(out)), g.random()
        if o < 0.34 or not out or k == len(out):
            out.insert(k, g.choice(letters))
        elif o < 0.67:
            del out[k]
        else:
            out[k] = g.choice(letters)
    return "".join(out)


def test_banded_edit_distance(spark):
    g = random.Random(3)
    rows = [(a := "".join(g.choice("abcé") for _ in range(g.randint(0, 14))), changed(g, a, g.randint(0, 4), "abcé")) for _ in range(500)]
    for k in (1, 2, 3):
        for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            true = edits(r.a, r.b)
            assert r.d == true if true <= k else r.d > k


def test_edit_distance_of_long_texts(spark):
    g = random.Random(12)
    rows = []
    for n in (64, 65, 90, 200):
        for kind in range(12):
            x = "".join(g.choice("abcdé𝄞 ") for _ in range(n))
            y = changed(g, x, g.randint(0, 4)) if kind % 3 else x[kind:] + x[:kind]
            rows += [("q" + x + "q", "z" + y + "w"), (x, y), ("a" + x, y + "b")]
    for k in (1, 2, 3):
        for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            true = edits(r.a, r.b)
            assert r.d == true if true <= k else r.d > k


def test_line_dedup(spark, none):
    g = random.Random(9)
    base = ["".join(g.choice("abcd ") for _ in range(g.randint(18, 32))) for _ in range(15)]
    rows = [(i, "\n".join(changed(g, g.choice(base), g.choice([0, 0, 1, 2, 3])) for _ in range(g.randint(0, 4)))) for i in range(40)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "x" * 30_000), (64, "x" * 29_999), (None, rows[3][1]), rows[7]]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, first string")
    got = {(r.doc_id, r.n_lines): r.removed for r in line_dedup.report(df).collect()}
    seen: list[str] = []
    for d, t in sorted(set(rows), key=lambda r: NO_ID if r[0] is None else r[0]):
        lines, gone = (t or "").split("\n"), []
        for k, line in enumerate(lines):
            line = line.strip(" ")
            if len(line) >= 20:
                if any(abs(len(line) - len(e)) <= 2 and (line == e or len(e) > 1000 and line in e or len(e) < 1000 and edits(line, e) <= 2) for e in seen):
                    gone.append(k)
                seen.append(line)
        assert got[d, len(lines)] == gone, d
    kept = {(r.doc_id, r.text) for r in line_dedup.apply(df).collect()}
    for d, t in rows:
        gone = got[d, len((t or "").split("\n"))]
        left = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert ((d, left) in kept) == (not gone or left.strip() != ""), d
    assert line_dedup.report(none).count() == 0 and line_dedup.apply(none).columns == none.columns


@pytest.mark.parametrize("block", [4096, 50])
def test_lines_under_common_keys(spark, monkeypatch, block):
    """A large group of lines that share segments, of which only some are within the bound."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    g = random.Random(4)
    base = "".join(g.choice("abcdefghij ") for _ in range(70))
    at = lambda: g.randint(3, 66)
    texts = []
    for _ in range(260):
        p, put = at(), "".join(g.choice("klmnopqrstuvwxyzé𝄞") for _ in range(4))
        texts.append(base[:p] + put + base[p:] if not texts or g.random() < 0.7 else changed(g, g.choice(texts), g.choice([1, 2, 2, 3])))
    got = {r.doc_id: r.removed for r in line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, line in enumerate(texts):
        near = any(abs(len(line.strip()) - len(e.strip())) <= 2 and edits(line.strip(), e.strip()) <= 2 for e in texts[:i])
        assert got[i] == ([0] if near else []), i
    assert 0 < sum(map(len, got.values())) < 200


def test_keys_of_lines_are_the_same_by_bytes_and_by_characters(spark):
    """What lines of one byte a character share with others is found, in every way that two edits can fall; lines of equal length meet by one shift of the middle."""
    g = random.Random(41)
    rows = []
    for _ in range(1500):
        x = "".join(g.choice("ab é"[: g.choice((3, 4))]) for _ in range(g.randint(20, 32)))
        y = list(x)
        for _ in range(2):
            how, at = g.randrange(3), g.randrange(len(y))
            y[at : at + (how != 0)] = [g.choice("abcé")] * (how != 1)
        rows.append((x, "".join(y)))
    indexed, probed = {}, {}
    for end in (0, 1):
        df = spark.createDataFrame([(i, r[end]) for i, r in enumerate(rows)], "number long, line string").withColumn("n", F.char_length("line"))
        indexed[end] = {r.number: {*r.keys} for r in df.select("number", line_dedup.index_keys(F.col("line"), F.col("n"), 2).alias("keys")).collect()}
        probed[end] = {r.number: r.keys for r in line_dedup.probes(df, 2).groupBy("number").agg(F.collect_list("key").alias("keys")).collect()}
    assert {len(keys) for keys in probed[0].values()} == {11}
    for i, (x, y) in enumerate(rows):
        assert edits(x, y) > 2 or indexed[0][i] & {*probed[1][i]} or indexed[1][i] & {*probed[0][i]}


def test_letter_pair_parities(spark):
    """k edits flip at most 4k bits."""
    g = random.Random(6)
    rows = [("", "a"), ("a", "b")]
    for n in (2, 5, 40, 300):
        for e in (1, 2, 3):
            x = "".join(g.choice("abcdé𝄞 ") for _ in range(n))
            rows.append((x, changed(g, x, e)))
    both = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.parities(F.col("a")).alias("x"), line_dedup.parities(F.col("b")).alias("y"))
    for r in both.collect():
        flipped = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(r.x, r.y, strict=True))
        assert flipped <= 4 * edits(r.a, r.b)


def test_short_equal_lines(spark, tmp_path):
    from codrel.llm import queries

    rows = [(1, "a\nIetzte.\n\nIetzte.\n \t"), (2, "Ietzte. \nIetzt.\n\n \t\nb"), (3, "b\na")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in queries.op5_segment_partition(spark, str(tmp_path)).collect()}
    assert got == {1: [3], 2: [0], 3: [0, 1]}
    kept = line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string"), least_equal=1)
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, "a\nIetzte.\n\n \t"), (2, "Ietzt.\n\n \t\nb")}


# -- pages -----------------------------------------------------------------------------------------


def test_html_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>'
        '<div class="cookie-notice"><p>We use cookies, really, yes.</p></div><div class="content"><h1>Title &amp; more</h1><p>First,\n second &eacute; <b>bold</b> text, going on.'
        '<p>Unclosed <a href="x">link</a><br>and more, of it.</p><ul><li>One<li>Two</ul><script>var p = "</p>";</script><!-- no <p>comment</p> --></div>'
        '<div id="comments"><p>Nice, very, very nice, yes, indeed, so nice.</p></div><aside><p>Side, bar.</p></aside><form><p>Enter</p></form><footer>&copy; us</footer></body></html>'
    )
    text = "Title & more\n\nFirst, second é bold text, going on.\n\nUnclosed link and more, of it.\n\nOne\n\nTwo"
    assert html_text.main_text(page) == text
    article = page.replace('<div class="content">', '<article><section><p>Early.</p></section><div class="content">').replace("</script><!--", "</script></div></article><!--")
    assert html_text.main_text(article) == "Early.\n\n" + text
    assert html_text.main_text("plain,  text") == "plain, text" and html_text.main_text("<p>a</b></div><p>b") == "a\n\nb"
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    rows = [(2**60 + 1, "u", page, "t"), (None, None, None, None), (3, "u", "", None), (4, "v", "<nav>x</nav>", None), (5, "w", long, None)]
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[2**60 + 1].text == text and out[None].text == out[3].text == out[4].text == "" and out[5].text.count("\n\n") == 19_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_wrappers_named_like_parts():
    body = "<h1>Title</h1><p>First, second, third and more of the text, going on for a while.</p><p>And another paragraph, with commas, and an end.</p>"
    text = "Title\n\nFirst, second, third and more of the text, going on for a while.\n\nAnd another paragraph, with commas, and an end."
    ad, remarks = '<div class="ad"><p>Buy, buy, buy.</p></div>', '<div id="comments">' + "<article><p>Nice, very, very nice, yes, indeed, so nice.</p></article>" * 9 + "</div>"
    for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
        for name in ('class="layout has-sidebar"', 'id="no-banner"', 'class="with-nav"', 'class="content-widget"', 'class="contentWidget" id="promo"'):
            assert html_text.main_text(f"<body><div {name}>{inner}{ad}</div></body>") == text, (inner, name)
        assert html_text.main_text(f'<body><div class="page-widget"><div class="content-widget">{inner}</div>{ad}</div></body>') == text
        assert html_text.main_text(f'<body><div class="content">{inner}</div>{ad}{remarks}</body>') == text
        assert html_text.main_text(f'<body><div class="content">{inner}</div><div class="related"><p>More, here.</p></div></body>') == text


def test_html_keeps_all_of_the_article():
    p = "First, second, third and more of the text, going on for a while."
    nav, links = '<nav><a href="/">x</a></nav>', '<div><a href="1">Home</a> <a href="2">About</a></div>'
    two = f'<div class="post"><div class="sec"><h2>One</h2><p>{p}</p><p>{p}</p></div><div class="sec"><h2>Two</h2><ul><li>a</li><li>b</li></ul></div></div>'
    assert html_text.main_text(f"<body>{nav}{two}{links}</body>") == f"One\n\n{p}\n\n{p}\n\nTwo\n\na\n\nb"
    assert html_text.main_text(f'<body><div id="share-price-report"><h1>T</h1><p>{p}</p></div><div class="cookie-notice">We use</div></body>') == f"T\n\n{p}"
    related = f'<article><p>{p}</p><div class="related-work"><h2>Related work</h2><p>Others did it.</p></div><div class="ad">Buy</div></article>'
    assert html_text.main_text(f"<body>{related}</body>") == f"{p}\n\nRelated work\n\nOthers did it."
    assert html_text.main_text(f'<body><div class="c"><div><h1>T</h1><p>{p}</p><p>{p}</p></div><div>x</div><p>short tail</p></div></body>') == f"T\n\n{p}\n\n{p}\n\nx\n\nshort tail"
    assert html_text.main_text(f'<article><p>{p}</p><a href="x>y</a><p>more text.</p></article>') == f"{p}\n\ny\n\nmore text."
    for name in ("site-footer", "comments-section", "sidebar-left", "newsletterSignup", "related-posts"):
        assert html_text.main_text(f'<body><div class="{name}">Other text.</div><div class="content"><p>{p}</p></div></body>') == p, name


def test_html_takes_time_in_proportion():
    import time

    for page in ("<div><p>a b c</p>" * 8000, '<a href="x ' * 8000, "<a '>'" * 8000, "<div>" * 8000 + "</p>" * 8000, "<b>" * 8000 + "<div></div>" * 8000, '<span class="ad">' * 8000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 3


def test_html_scores_by_hand():
    """The container by the points of a plain walk over all ancestors."""
    g = random.Random(9)
    for _ in range(200):
        page, open_ = "", []
        for _ in range(g.randint(1, 25)):
            if open_ and g.random() < 0.4:
                page += f"</{open_.pop()}>"
            elif g.random() < 0.5:
                open_.append("div")
                page += "<div>"
            else:
                words = ", ".join(g.choice("abcdefgh") * g.randint(1, 30) for _ in range(g.randint(1, 6)))
                page += f"<p><a>{words}</a> z</p>" if g.random() < 0.3 else f"<p>{words}</p>"
        found, made = html_text.blocks_of(page)
        if not found:
            continue
        points, chars, linked = {}, {}, {}
        for block, text, n in found:
            above, share = block.up, 1.0
            for counts, value in ((chars, len(text)), (linked, n)):
                counts[id(block)] = counts.get(id(block), 0) + value
            while above is not None:
                points[id(above)] = points.get(id(above), 0) + share * (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - n / len(text))
                chars[id(above)], linked[id(above)] = chars.get(id(above), 0) + len(text), linked.get(id(above), 0) + n
                above, share = above.up, share / 2
        score = {i: p * (1 - linked[i] / chars[i]) for i, p in points.items()}
        html_text.main_text(page)
        _, again = html_text.blocks_of(page)
        best = max(score.values())
        inside = [n for n in made if score.get(id(n), 0) >= best - 1e-9]
        texts = html_text.main_text(page).split("\n\n")
        assert len(again) == len(made)

        def under(node, tops):
            while node is not None:
                if any(node is t for t in tops):
                    return True
                node = node.up
            return False

        if len(inside) == 1:  # all of the best container is kept
            assert all(text in texts for block, text, _ in found if under(block, inside))


# -- fingerprints ------------------------------------------------------------------------------------


def shingles(t: str | None, n: int = 5) -> set:
    w = (t or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("rows_per_bucket", [4096, 5])
def test_fingerprints(docs, none, rows_per_bucket):
    df, rows = docs
    out = fingerprints.with_next(df, rows_per_bucket=rows_per_bucket)
    out = out.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).withColumn("other", fingerprints.sketch(F.col("edited")))
    got = out.select("doc_id", "text", "next_text", "edited", "sketch", fingerprints.likeness(F.col("sketch"), F.col("other")).alias("near"), fingerprints.distinct_count(F.col("sketch")).alias("n")).collect()
    assert len(got) == len(rows)
    order = [t or "" for _, t in sorted(rows, key=lambda r: (NO_ID if r[0] is None else r[0]))]
    after = defaultdict(set)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        after[a].add(b)
    prints = {}
    for r in got:
        assert r.next_text in after[r.text]
        h = len(r.text) // 2
        assert r.edited == r.text[: len(r.text) - h] + r.next_text[:h]
        a, b = shingles(r.text), shingles(r.edited)
        true = len(a & b) / len(a | b) if a or b else 1.0
        assert abs(r.near - true) < (0.2 if len(a | b) > fingerprints.K else 1e-9) and abs(r.n - len(a)) <= 0.3 * len(a)
        assert prints.setdefault(r.text, r.sketch) == r.sketch
    assert fingerprints.with_next(none).count() == 0


def test_sketches_merge_and_contain(spark):
    g = random.Random(0)
    words = [prose(g, 1) + str(i) for i in range(1200)]
    parts = [" ".join(words[a : a + 304]) for a in range(0, 1200, 300)]
    df = spark.createDataFrame([("k", p) for p in parts], "k string, t string").select("k", fingerprints.sketch(F.col("t")).alias("sketch"))
    whole = spark.createDataFrame([(" ".join(words), parts[0])], "t string, p string").select(fingerprints.sketch(F.col("t")).alias("a"), fingerprints.sketch(F.col("p")).alias("b"))
    assert fingerprints.merged(df, "k").first()["sketch"] == whole.first()["a"]
    r = whole.select(fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.distinct_count(F.col("a")).alias("n"), fingerprints.as_text(F.col("a")).alias("s")).first()
    assert r.c > 0.7 and abs(r.n - 1196) < 360 and len(r.s.replace("\n", "").replace("\r", "")) >= fingerprints.K * 8 * 4 // 3
    assert hashlib.sha256(r.s.encode()).hexdigest()


# -- decontamination -------------------------------------------------------------------------------------


def test_myers():
    g = random.Random(2)
    for _ in range(200):
        p = "".join(g.choice("abc") for _ in range(g.randint(1, 90)))
        t = "".join(g.choice("abc") for _ in range(g.randint(0, 12))) + changed(g, p, g.randint(0, 5), "abc") + "".join(g.choice("abc") for _ in range(g.randint(0, 12)))
        best, end = decontamination.myers(p, t)
        d = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            e = [i]
            for j, x in enumerate(t, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (c != x)))
            d = e
        assert best == min(d) and (best == len(p) or d[end] == best)


def place_of(p: str, text: str, k: int) -> bool:
    return decontamination.myers(p, text)[0] <= k if k else f" {p} " in f" {text} "


@pytest.mark.parametrize("block_chars", [4_000_000, 200])
def test_decontamination(spark, none, block_chars):
    g = random.Random(6)
    items = [(i, prose(g, n)) for i, n in enumerate((3, 8, 20, 33, 60))] + [(90, None), (91, ""), (92, "!?"), (None, "the")]
    rows, expected = [], set()
    for k in range(60):
        text = prose(g, 60)
        if k % 3 == 0:
            i, item = items[k % 5]
            n = decontamination.budget(decontamination.passages(item)[0]) if k % 2 else 0
            text += ". " + changed(g, item, n, "xyz").upper() + ". " + prose(g, 9)
            expected.add((k, i))
        rows.append((k, text))
    rows += [(70, None), (71, ""), (None, items[2][1]), (2**60 + 1, items[2][1]), rows[0], (72, prose(g, 20_000))]
    expected |= {(None, 2), (2**60 + 1, 2)}
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(df, bench, block_chars=block_chars).collect()
    pairs = [(r.doc_id, r.item_id) for r in found]
    assert len(pairs) == len(set(pairs))
    # Every place within the budget, by distances of all passages to all places.
    brute = set()
    for d, t in rows:
        text = decontamination.normal(t or "")
        for i, item in items:
            if i is not None and any(place_of(p, text, decontamination.budget(p)) for p in decontamination.passages(item or "")):
                brute.add((d, i))
    assert set(pairs) == brute and expected <= brute
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).filter("doc_id is not null").collect()) == sorted(d for d, _ in rows if d is not None and d not in {x for x, _ in brute})
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_finds_every_window():
    """Quotes of 13 words and more from anywhere in an item, and all word windows of the items by distances to all places."""
    g = random.Random(16)
    items = [(i, prose(g, n)) for i, n in enumerate((13, 14, 16, 25, 26, 45, 60))] + [(7, "a b c d e f g"), (8, "one in")]
    matcher = decontamination.Matcher(items)
    for n in (13, 16, 20, 24):
        for i, item in items[:7]:
            words = item.split()
            for s in range(len(words) - n + 1):
                assert i in matcher.matches(prose(g, 30) + ", " + " ".join(words[s : s + n]) + ". " + prose(g, 30)), (i, n, s)
    seen = 0
    for _ in range(150):
        i, item = g.choice(items)
        words = item.split()
        s = g.randrange(max(1, len(words) - 12))
        text = decontamination.normal(prose(g, 12) + " " + changed(g, " ".join(words[s : s + 14]), g.randint(0, 9), "xyz ") + " " + prose(g, 12))
        brute = set()
        for j, other in items:
            w = decontamination.normal(other).split()
            windows = {" ".join(w[a : a + n]) for n in (13, 20) for a in range(max(1, len(w) - n + 1))} | {" ".join(w)}
            if any(place_of(p, text, len(p) // 12 if p.count(" ") >= 5 else 0) for p in windows):
                brute.add(j)
        assert set(matcher.matches(text)) == brute
        seen += len(brute)
    assert seen > 60
    long = items[6][1].split()
    edits_, start, end = matcher.matches("xx " + " ".join(long[5:45]) + " yy")[6]
    assert edits_ == 0 and start <= 3 and end >= 3 + len(decontamination.normal(" ".join(long[5:45])))


def test_decontamination_keeps_clean_rows_and_words_whole(spark):
    matcher = decontamination.Matcher([(1, "the"), (2, "art is")])
    assert not matcher.matches("some other word, isolated") and not matcher.matches("start isolated")
    assert set(matcher.matches("The art, is")) == {1, 2}
    g = random.Random(4)
    item, fine = prose(g, 30), prose(g, 40)
    rows = [(None, fine), (None, "x " + item), (7, fine), (7, item + " y"), (7, None), (8, fine), (8, fine)]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, text_hash int")
    left = decontamination.clean(df, spark.createDataFrame([(1, item), (2, "")], "item_id long, text string"))
    assert left.columns == df.columns and sorted(r.text_hash for r in left.collect()) == [0, 2, 4, 5, 6]


# -- n-gram Jaccard join -----------------------------------------------------------------------------------


def grams(t: str | None, n: int) -> frozenset:
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows: list[tuple], n: int, percent: int) -> dict:
    sets = [(NO_ID if d is None else d, grams(t, n)) for d, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("words", "percent", "small", "block"), [(3, 90, 48, 2048), (3, 90, 1, 3), (5, 80, 1, 2048)])
def test_jaccard_join(spark, docs, none, monkeypatch, words, percent, small, block):
    """Also with trees for every row and blocks of a few nodes."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    g = random.Random(8)
    seed = prose(g, 90).split(" ")
    chain = []
    for _ in range(25):  # neighbours link, far ones do not
        seed = seed[3:] + prose(g, 3).split(" ")
        chain.append(" ".join(seed))
    g.shuffle(chain)
    big = prose(g, 1500)
    rows = docs[1] + [(1000 + i, t) for i, t in enumerate(chain)] + [(2000 + i, changed(g, big, 6 * i)) for i in range(12)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, token int").repartition(3)
    monkeypatch.setattr(jaccard_join, "_search", _with(jaccard_join._search, small))
    got = sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_shingles, NO_ID if r.component_id is None else r.component_id) for r in jaccard_join.join(df, words, percent).collect())
    assert got == brute_components(rows, words, percent)
    if small == 48:
        assert jaccard_join.join(none).count() == 0


def _with(search, small):
    def made(percent):
        run = search(percent)

        def inner(batches):
            jaccard_join.SMALL = small
            yield from run(batches)

        return inner

    return made


def test_documents_that_share_only_common_ngrams_leave_the_index(spark, monkeypatch):
    """Every n-gram of these texts stands in others as well, but only the near copies reach the texts and stars."""
    g = random.Random(21)
    rows = [(i, " ".join(g.choice(WORDS[:8]) for _ in range(g.randint(150, 250)))) for i in range(120)]
    rows += [(500, rows[0][1] + " of"), (501, "by " + rows[1][1] + " at"), (502, rows[2][1].replace(" ", "  "))]
    left, texts = [], jaccard_join._texts
    monkeypatch.setattr(jaccard_join, "_texts", lambda docs, ids: left.extend(r.id for r in ids.collect()) or texts(docs, ids))
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == brute_components(rows, 3, 90) and got[-3:] == [(500, got[-3][1], 0), (501, got[-2][1], 1), (502, got[-1][1], 2)]
    assert {0, 1, 500, 501} <= set(left) and len(left) < 20


@pytest.mark.parametrize("carried", [16, 1])
def test_a_pair_of_near_copies_leaves_the_search_once(spark, monkeypatch, carried):
    """Copies of one text that share many rows and stand at the bound, so that stars miss links; with few rows brought along pairs repeat, but none is lost."""
    monkeypatch.setattr(jaccard_join, "CARRIED", carried, raising=False)
    g = random.Random(33)
    base = prose(g, 300).split(" ")
    rows = []
    for i in range(80):
        words = list(base)
        for at in g.sample(range(300), 3 + i % 2):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    counted, search = spark.sparkContext.accumulator(0), jaccard_join._search

    def counting(percent):
        run = search(percent)

        def inner(batches):
            for pdf in run(batches):
                counted.add(len(pdf))
                yield pdf

        return inner

    monkeypatch.setattr(jaccard_join, "_search", counting)
    pairs = []
    monkeypatch.setattr(jaccard_join, "_verified", lambda found, *more, f=jaccard_join._verified: pairs.append(found.count()) or f(found, *more))
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect())
    assert got == brute_components(rows, 5, 80)
    assert pairs[-1] > 50
    assert counted.value == pairs[-1] if carried > 1 else counted.value >= pairs[-1]


@pytest.mark.parametrize("percent", [40, 80, 90, 93, 99])
def test_sets_that_link_share_index_rows(percent):
    """At the bound itself: equal sizes, one set inside the other, and in between, across the classes of sizes."""
    g = np.random.default_rng(percent)
    for size in [*range(1, 60), *jaccard_join.CLASSES[8:19], *(n - 1 for n in jaccard_join.CLASSES[8:19]), *g.integers(60, 3000, 60)]:
        tokens = g.permutation(np.unique(g.integers(-(2**63), 2**63 - 1, 3 * size + 9)))
        for lost in {0, size // 40, size // 20, size // 12, size // 10, size - -(-size * percent // 100)}:
            common = size - lost
            most = 100 * common // percent - size  # tokens that only the other set has
            if common and most >= 0:
                (x, least_x), (y, least_y) = (jaccard_join.index_rows(np.sort(t), percent) for t in (tokens[:size], np.r_[tokens[:common], tokens[size : size + most]]))
                assert lost + most == 0 or len(np.intersect1d(x, y)) >= max(least_x, least_y, 1)


def test_one_of_each_tells_rows_of_an_id_apart(spark):
    g = random.Random(12)
    w, other = prose(g, 40), prose(g, 40)
    rows = [(3, w, 1), (5, w, 2), (5, other, 3), (5, other, 3), (None, None, 4), (None, "", 5), (7, " ", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int")
    kept = jaccard_join.one_of_each(df, words=5, percent=80)
    got = sorted(r.d for r in kept.collect())
    assert kept.columns == df.columns and got in ([1, 3, 4, 6], [1, 3, 5, 6])  # a null and an empty text of one id are one


def test_dual_traversal_finds_all():
    g = np.random.default_rng(1)
    pool = g.integers(-(2**62), 2**62, 400)
    sets = [np.unique(g.choice(pool[a : a + 120], g.integers(60, 110), replace=False)) for a in g.integers(0, 280, 200)]
    sets += [np.unique(np.r_[s[:-2], g.choice(pool, 2)]) for s in sets[:100]]
    sizes = np.array([len(s) for s in sets])
    maps = np.array([np.frombuffer(jaccard_join.signature(s, 0), np.uint64) for s in sets])
    comps = np.arange(len(sets)) // 2
    tree = jaccard_join.Tree(sizes, maps, comps)
    found = {tuple(sorted(x)) for p, q in jaccard_join.dual_traversal(tree, tree, 90, True) for x in zip(p.tolist(), q.tolist(), strict=True)}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if comps[i] != comps[j] and 100 * common >= 90 * (len(a) + len(b) - common):
                assert (j, i) in found
    assert len(found) < 0.2 * len(sets) ** 2 / 2


def test_components(spark):
    g = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(g.randrange(100, 160), g.randrange(100, 160)) for _ in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {n: top(n) for e in edges for n in e if e[0] != e[1]}


# -- licenses --------------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, none):
    g = random.Random(5)
    apache, mit = licenses.TEMPLATES["apache-2.0"], licenses.TEMPLATES["mit"]
    rows = [
        (1, apache[0].upper()), (2, prose(g, 300) + ". " + mit[2].replace("free of charge,", "free of any charge") + " " + prose(g, 50)), (3, "CC BY; cc-by, Cc\nBy"), (4, "the MIT License and the mit license"),
        (5, None), (6, ""), (7, "mİt license"), (8, "é apache license é"), (9, "under the terms of nothing"), (10, "Licensed under CC BY-NC 4.0."), (1, prose(g, 9)), (4, "the MIT License and the mit license"),
        (11, " ".join([apache[0], prose(g, 40)] * 300)), (None, "x gnu general public license"), (12, "Licensed under the GNU General Public License, version 2"),
    ]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, label string, w int")
    out = sorted((r.asDict() for r in licenses.scan(df).collect()), key=lambda r: (NO_ID if r["doc_id"] is None else r["doc_id"], r["n_words"]))
    expected = []
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at, names = [], set()
        for p, label in licenses.PHRASES:
            p = p.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            names |= {label} if here else set()
        expected.append((NO_ID if d is None else d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))))
    got = [(NO_ID if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out]
    assert got == sorted(expected, key=lambda r: (r[0], r[1]))
    labels = {(r["doc_id"], r["n_words"]): r["labels"].split(",") if r["labels"] else [] for r in out}
    named = {d: v for (d, _), v in labels.items() if d not in (1,)}
    assert "apache-2.0" in labels[1, 8] and named[2] == ["mit"] and named[9] == [] and named[10] == ["cc-by", "cc-by-nc-4.0"] and named[12] == ["gpl", "gpl-2.0"] and named[11] == ["apache", "apache-2.0"]
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    assert licenses.scan(none).count() == 0 and licenses.scan(docs[0]).count() == len(docs[1])


def test_scratch_deletes_its_tables(spark):
    from codrel.llm.common import scratch, shared_dir, written

    folder = Path(shared_dir(spark).removeprefix("file://")) / "codrel"
    before = set(folder.glob("*"))
    with scratch(spark, "outer") as keep:
        first = written(spark.range(5), "first")
        with scratch(spark, "inner") as keep_inner:
            inner = keep_inner(written(first.filter("id > 2"), "second"), "result")
        out = keep(inner, "result")
    assert sorted(r.id for r in out.collect()) == [3, 4]
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before] == ["result"]
    before = set(folder.glob("*"))
    with pytest.raises(ValueError, match="lost"), scratch(spark, "failed"):
        written(spark.range(5), "first")
        raise ValueError("lost")
    assert set(folder.glob("*")) == before


def test_workers_give_back_what_a_fit_has_freed():
    """Many small arrays with one alive above them, as after a fit."""
    from codrel.llm.common import give_back

    def held() -> float:
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6

    before = held()
    parts = [np.ones(2500) for _ in range(10_000)]
    last = np.ones(2500)
    assert held() > before + 150
    del parts
    give_back()
    assert last.sum() == 2500 and held() < before + 60
