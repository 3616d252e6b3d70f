"""The text operators against brute force, round trips and held-out rows, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bpe, conversations, flac, language, mixing, ngram_join, quality, site_style, token_output, toxicity
from tallyforge.llm import textvec as tv
from tallyforge.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
P = pytest.importorskip("public_tokenizers")


def frame(spark, texts, langs=None, sources=None):
    return spark.createDataFrame([(i, t, (langs or ["en"])[i % len(langs or [1])], (sources or ["a", "b", None])[i % len(sources or [1, 2, 3])], len(t or "")) for i, t in enumerate(texts)], DOCS)


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


EDGES = [None, "", " \t\n", "one", "one two three four", "One  TWO three\nfour", "a b c d e", "a b c d e", "é" * 3, "x" * 5000 + " y" * 3000, "漢字 🙂 don't <|endoftext|>"]


# ---- 2


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, index, parent = [], defaultdict(list), list(range(len(texts)))
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in index[x]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            index[x].append(i)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_components_match_brute_force(spark):
    rng, v = random.Random(4), vocabulary(1)
    texts = list(EDGES)
    for size, group, edits in ((60, 25, 1), (200, 40, 3), (120, 30, 4), (30, 12, 1)):
        base = [rng.choice(v) for _ in range(size)]
        for _ in range(group):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(size)] = rng.choice(v)
            texts.append(" ".join(w[: size - rng.randint(0, size // 12)]))
    shared = " ".join(rng.choice(v) for _ in range(60))
    texts += [" ".join(rng.choice(v) for _ in range(80)) + " " + shared for _ in range(40)]
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(frame(spark, texts)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(texts)


def test_links_inside_groups_match_brute_force(spark):
    rng, v = random.Random(14), vocabulary(2)
    texts = [*EDGES, EDGES[5]]
    for size, group, edits in ((60, 25, 1), (200, 40, 4), (120, 30, 3), (20, 10, 1)):
        base = [rng.choice(v) for _ in range(size)]
        for _ in range(group):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(size)] = rng.choice(v)
            texts.append(" ".join(w[: size - rng.randint(0, size // 8)]))
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = [[j for j, r in enumerate(sets) if j != i and s and 100 * len(s & r) >= 80 * len(s | r)] for i, s in enumerate(sets)]
    got = sorted(tuple(r) for r in ngram_join.link_counts(frame(spark, texts)).collect())
    assert got == [(i, len(s), c, len(n)) for i, (s, n, (_, _, c)) in enumerate(zip(sets, linked, brute_components(texts), strict=True))]
    pairs, members = ngram_join.links(frame(spark, texts))
    held = defaultdict(list)
    for r in members.collect():
        held[r.sid].append(r.doc_id)
    between = {frozenset((i, j)) for r in pairs.collect() for i in held[r.x] for j in held[r.y]}
    assert between == {frozenset((i, j)) for i, n in enumerate(linked) for j in n if sets[i] != sets[j]}


def test_jaccard_on_nothing(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    assert ngram_join.near_duplicate_representatives(frame(spark, ["a b", "a b", None])).count() == 2


# ---- 1


def test_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.integers(0, 1000, rng.integers(1, 12)).astype(float) * rng.choice([1, 100])
        most, seats = rng.integers(0, 40, len(w)), int(rng.integers(0, 120))
        got = np.zeros(len(w), int)
        for _ in range(min(seats, int(most[w > 0].sum()))):
            q = np.where((got < most) & (w > 0), w / (2 * got + 1), -1)
            got[int(q.argmax())] += 1
        ours = mixing.apportion(w, seats, most)
        assert ours.sum() == got.sum() and np.allclose(np.sort(w / (2 * ours + 1)), np.sort(w / (2 * got + 1)))


def test_mix_is_near_its_targets_and_can_be_repeated(spark):
    rng, v = random.Random(2), vocabulary(3)
    texts = [" ".join(rng.choice(v) for _ in range(rng.randint(0, 300))) for _ in range(240)] + EDGES
    docs = frame(spark, texts, sources=["a"] * 5 + ["b", "c", None])
    rows = mixing.mix_counts(docs).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows["size"] == [len(WORD.findall(texts[i] or "")) for i in rows.doc_id]).all()
    by = rows.groupby("target").agg(taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(by.taken - by.index) <= 0.02 * by.index + 8).all() and (by.index <= 2 * by["size"]).all()
    assert abs(sum(by.index) - 1.5 * rows["size"].sum()) < 1e-6
    again = mixing.mix_counts(docs.repartition(3)).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    mixed = mixing.mixed(docs).toPandas()
    counts = Counter()
    for r in mixed.itertuples():
        counts[r.doc_id] += len(WORD.findall(r.text))
    assert all(counts[r.doc_id] == r.taken for r in rows.itertuples()) and list(mixed.columns) == docs.columns
    assert mixing.mix_counts(frame(spark, [])).count() == 0


def test_targets_match_resharing_by_hand(spark):
    rng = random.Random(21)
    for names in (["a"], ["a", "b"], ["b", "a", "d", "c", "e", None, "f"]):
        docs = frame(spark, ["w " * rng.choice([0, 3, 40, 900]) for _ in range(60)], sources=names)
        rows = mixing.mix_counts(docs).toPandas()
        size = {s: int(r["size"].sum()) for s, r in rows.assign(source=[names[i % len(names)] or "~" for i in rows.doc_id]).groupby("source")}
        order = sorted(size)  # "~", the null source, is last
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        want, free, left = {}, set(order), 1.5 * sum(size.values())
        while free:
            share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
            over = {s for s in free if share[s] > 2 * size[s]}
            want |= {s: 2.0 * size[s] for s in over} if over else share
            left -= sum(2.0 * size[s] for s in over)
            free = free - over if over else set()
        for r in rows.itertuples():
            assert abs(r.target - want[names[r.doc_id % len(names)] or "~"]) < 1e-6 * max(1, r.target)


# ---- 3


def test_language_of_held_out_rows(spark):
    en, de = vocabulary(5, 60), [w[::-1] + "ß" for w in vocabulary(6, 60)]
    rng = random.Random(1)
    langs = ["en", "de"]
    texts = [" ".join(rng.choice(en if i % 2 == 0 else de) for _ in range(40)) for i in range(160)]
    docs = frame(spark, [*texts, None, "12 !!", ""], langs)
    from pyspark.sql import functions as F

    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, F.col("doc_id") < 100).collect()}
    assert all(got[i][0] == langs[i % 2] for i in range(100, 160)) and all(got[i] == ("und", 0.0) for i in (160, 161, 162))
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language.identify(docs, F.lit(False)).collect()} == {"und"}


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    row, begin, size = np.array([0, 1, 2, 3, 4, 1]), np.array([0, 4, 6]), np.array([4, 2, 0])
    got = language.marginal_sums(scores, row, begin, size, trans)
    for d, (b, n) in enumerate(zip(begin, size)):
        total, want = 0.0, np.zeros(3)
        for path in np.ndindex(*[3] * n) if n else []:
            p = np.exp(sum(scores[row[b + t], y] for t, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:])))
            total += p
            for y in path:
                want[y] += p
        assert np.allclose(got[d], want / total if n else 0)


# ---- 4


def test_toxic_terms_are_learned(spark):
    rng, v = random.Random(8), vocabulary(9)
    texts, labels = [], []
    for i in range(500):
        w = [rng.choice(v) for _ in range(60)]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(["zurgelo", "zurgeli", "krannok"]))
        texts.append(" ".join(w))
        labels.append((i, 1, toxic))
    from pyspark.sql import functions as F

    docs = frame(spark, [*texts, None, ""])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") < 350)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(350, 500)) and got[500] == got[501] < 0.7
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


# ---- 5


def test_page_text():
    page = "<html><body><header>Top</header><div id=sidebar>x</div><main><h1>A &amp; B</h1><p>one<p>two <b>bold</b>\n x<div class='comments'>c1</div><ul><li>a<li>b</ul><script>if(a<b)</script><form>f</form></main><footer>z"
    assert site_style.Page(page).text(frozenset()) == "A & B\none\ntwo bold x\na\nb"
    assert site_style.Page(None).text(frozenset()) == "" and site_style.Page("<p>a<!-- x").text(frozenset()) == "a"


def test_repeated_branches_of_a_site_go(spark):
    rng, v = random.Random(3), vocabulary(11)
    words = lambda n: " ".join(rng.choice(v) for _ in range(n))
    rows = [(i, f"http://h.example/{i}", f"<body><div class=x>Call us now</div><div class=y><p>{words(30)}</p></div></body>") for i in range(20)]
    rows += [(99, None, None), (100, "nonsense", "<p>alone</p>")]
    got = {r.page_id: r for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Call us" not in got[i].text and len(got[i].text.split()) == 30 for i in range(20))
    assert got[99].text == "" and got[99].n_chars == 0 and got[100].text == "alone"


def test_importance_matches_entropy_by_hand(spark):
    rng, v = random.Random(17), vocabulary(18, 40)
    words = lambda n: " ".join(rng.choice(v) for _ in range(n))
    rows = []
    for host, n in (("a", 2), ("b", 5), ("c", 11), ("d", 30)):
        for _ in range(n):
            menu = "".join(f"<li>{rng.choice(v[:2])}</li>" for _ in range(rng.choice([3, 3, 3, 4])))
            note = f"<div class=n>{'same' if rng.random() < 0.9 else words(2)}</div>"
            rows.append((host, f"<body><div class=m><ul>{menu}</ul></div>{note}<article><p>{words(6)}</p><div class=t>tail</div></article></body>"))
        rows += rows[-2:]  # copies count once
    rows.append(("d", None))
    by = {}
    for host, source in rows:
        page = site_style.Page(source)
        own = page.text(frozenset(), links=False)
        for node, (children, content, inside, *_) in page.nodes.items():
            held = by.setdefault((host, node), ({}, {}, []))
            held[0].setdefault(own, tuple(children))
            held[1].setdefault(own, content)
            held[2].append(inside)
    want = set()
    for (host, node), (shape, content, inside) in by.items():
        n = len(shape)
        entropy = lambda side: -sum(c / n * math.log(c / n, n) for c in Counter(side.values()).values()) if n > 1 else 1.0
        if node and n >= (site_style.LEAST_PAGES if any(inside) else site_style.LEAST_OCCURRENCES) and max(entropy(shape), entropy(content)) < site_style.LEAST_IMPORTANCE:
            want.add((host, node))
    got = {(r.host, r.node) for r in site_style.low_importance(spark.createDataFrame(rows, "host string, html string").repartition(4)).collect()}
    assert got == want and {h for h, _ in got} == {"b", "c", "d"}


def test_menus_under_neutral_names_go(spark):
    rng, v = random.Random(21), vocabulary(22)
    words = lambda n: " ".join(rng.choice(v) for _ in range(n))
    menu = lambda: "<div class=q><ul>" + "".join(f"<li><a href=/x>{words(rng.randint(1, 2))}</a></li>" for _ in range(rng.randint(4, 9))) + "</ul></div>"
    body = lambda: f"<h1><a href=/t>{words(3)}</a></h1><p class=by><a href=/a>{words(2)}</a></p><p>{words(20)} <a href=/b>{words(2)}</a> {words(9)}</p>"
    rows, want = [], []
    for k in range(40):  # a site of 20 pages, then hosts of one page each, whose menus are judged by all hosts
        article = body()
        rows.append((k, f"http://{'one' if k < 20 else f'h{k}'}.example/{k}", f"<body>{menu()}<div class=z>{article}</div></body>"))
        want.append(site_style.Page(article).text(frozenset()))
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[k] for k in range(40)] == want


def test_copies_on_many_hosts_are_one(spark):
    page = "<body><div class=only><p>the very same text</p></div></body>"
    rows = [(k, f"http://h{k}.example/", page) for k in range(30)]
    got = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"the very same text"} and len(got) == 30


def test_pages_of_dealt_hosts_nulls_repeats_and_nothing(spark, monkeypatch):
    schema = "page_id long, url string, html string, host int, low int, part string, rows long, node double"  # clashing names
    page = lambda k: f"<body><div class=x>Call us</div><p>text {k} of its own</p></body>"
    rows = [(k % 50 or None, "http://big.example/", page(k % 50), 1, 2, "3", 4, 5.0) for k in range(100)] + [(None, None, None, 1, 2, "3", 4, 5.0)] * 2
    monkeypatch.setattr(site_style, "LEAST_HOT", 7)
    got = site_style.extract(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((k or None, f"text {k} of its own") for k in [*range(50)] * 2) + Counter({(None, ""): 2})
    assert site_style.extract(spark.createDataFrame([], schema)).collect() == []


def test_copied_pages_keep_their_articles(spark):
    rng, v = random.Random(5), vocabulary(12)
    words = lambda n: " ".join(rng.choice(v) for _ in range(n))
    page = lambda menu: f"<body><div class=x>{menu}</div><article><h1>{words(4)}</h1><p>{words(30)}</p><ul><li>{words(5)}</ul></article></body>"
    copy, few = page("m"), [page("m") for _ in range(5)]
    rows = [("a.example", copy)] * 20 + [("a.example", page("m"))]  # twenty equal pages and another one
    rows += [("b.example", few[i % 5]) for i in range(200)]
    rows += [("c.example", copy.replace(">m<", f">menu {i}<")) for i in range(60)] + [("c.example", page("m")) for _ in range(9)]  # copies under other menus
    rows = [(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)] + [(1000 + i, None, copy) for i in range(20)]
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i] == site_style.Page(p).text(frozenset()) and len(got[i].split()) == 39 for i, _, p in rows)


def test_names_are_whole_words_and_small_sections_are_judged(spark):
    for name in ("no-sidebar", "has-sidebar", "related-work", "share-price", "search-results"):
        assert site_style.Page(f"<body class=b><div class='x {name}'><p>text</p></div></body>").text(frozenset()) == "text"
    assert site_style.Page("<div class='x sidebar'>a</div><div id=ad-2>b</div><p>c</p>").text(frozenset()) == "c"
    assert site_style.Page("<div class=sidebar>a<main>b<div class=comments><article>c</article></div></main></div>").text(frozenset()) == "b"
    assert site_style.Page("<div class=search>a<article>b</article></div>").text(frozenset()) == "b"
    for name in ("post comments-open", "entry social", "notice-board", "post comments"):
        assert site_style.Page(f"<body><nav>m</nav><div class='{name}'><h1>t</h1><p>a</p></div><p>b</p></body>").text(frozenset()) == "t\na\nb"
        assert site_style.Page(f"<body><nav>m</nav><div class='{name}'><p>a</p></div></body>").text(frozenset()) == "a"
    assert site_style.Page("<main>b</main><div class=related><article>c</article></div>").text(frozenset()) == "b"
    rng, v = random.Random(6), vocabulary(13)
    words = lambda n: " ".join(rng.choice(v) for _ in range(n))
    rows = [(i, f"http://big.example/{i}", f"<body>{'<div class=x>Shop now</div>' if i < 10 else ''}<p>{words(30)}</p></body>") for i in range(60)]
    rows += [(100 + i, f"http://small.example/{i}", f"<body><div class=x>Call us</div><p>{words(30)}</p></body>") for i in range(4)]
    got = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 64 and all(len(r.text.split()) == 30 for r in got)


# ---- 6


def test_flac_round_trip_and_checks():
    rng = random.Random(1)
    payloads = [b"\0" * 64, bytes(rng.randrange(256) for _ in range(4096)), b"hello world " * 700, b"\xff\x00" * 2048, b"x" * 70016]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads and flac.encode(payloads[1:2]) == media[1:2]
    for first, count in ((0, 5), (1000, 100), (1023, 2), (1500, 3000), (4000, 96)):
        assert flac.read_range(media[2], first, count) == payloads[2][first : first + count]
    broken = bytearray(media[2])
    broken[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def _bits(*fields):
    s = "".join(format(v & (1 << n) - 1, f"0{n}b") if n else v for v, n in fields)
    return int(s.ljust(-(-len(s) // 8) * 8, "0"), 2).to_bytes(-(-len(s) // 8), "big")


def _foreign(subframe, n):
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0, n - 1])
    body = head + bytes([flac._crc8(head)]) + subframe
    return body + int(flac.crc16(np.frombuffer(body, np.uint8), np.zeros(1, np.int64), np.array([len(body)]))[0]).to_bytes(2, "big")


def test_streams_of_other_writers():
    """Linear predictors, constants, verbatim samples, partitions and escapes, without a seek table."""
    x = [3, 5, 8, 12, 17, 20, 18, 15]
    left = [v - (2 * b - a) for a, b, v in zip(x, x[1:], x[2:])]
    zig = lambda v: 2 * v if v >= 0 else -2 * v - 1
    rice = lambda v, k: ("0" * (zig(v) >> k) + "1" + format(zig(v) & (1 << k) - 1, f"0{k}b"), 0)
    lpc = _bits((0, 1), (33, 6), (0, 1), (x[0], 8), (x[1], 8), (3, 4), (1, 5), (4, 4), (-2, 4), (0, 2), (0, 4), (2, 4), *[rice(v, 2) for v in left])  # (4, -2) / 2
    parts = _bits((0, 1), (10, 6), (0, 1), (x[0], 8), (x[1], 8), (0, 2), (1, 4), (1, 4), *[rice(v, 1) for v in left[:2]], (15, 4), (6, 5), *[(v, 6) for v in left[2:]])
    frames = [_foreign(lpc, 8), _foreign(parts, 8), _foreign(_bits((0, 1), (0, 6), (0, 1), (-7, 8)), 8), _foreign(_bits((0, 1), (1, 6), (0, 1), *[(v, 8) for v in x]), 8)]
    want = [*x, *x, *[-7] * 8, *x]
    signed = np.array(want, np.int8).tobytes()
    info = bytes(10) + ((8000 << 44) | (7 << 36) | len(want)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    media = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)
    payload = bytes(v + 128 for v in want)
    assert flac.decode([media]) == [payload] and flac.decode([media, *flac.encode([payload])]) == [payload, payload]
    ours = flac.encode([b"hello world " * 300])[0]
    assert flac.plain_decode(ours) == flac.decode([ours])[0]
    assert all(flac.read_range(media, a, n) == payload[a : a + n] for a in (0, 3, 11, 31, 32) for n in (0, 1, 9, 40))
    with pytest.raises(ValueError):
        flac.decode([media[:-1] + bytes([media[-1] ^ 1])])


def test_media_digests(spark):
    rows = {r.doc_id: r for r in flac.describe(flac.pcm_blocks(flac.encode_column(frame(spark, EDGES), "doc_id", "text"))).collect()}
    for i, t in enumerate(EDGES):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[6].feature == rows[7].feature


# ---- 7, 9


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, bound in ((0, 1), (1, 1), (3, 3), (1000, 1001), (700, 10**7), (5, 10**12)):
        v = np.sort(rng.integers(0, bound, n))
        e = token_output.EliasFano.encode(v, bound)
        assert (e.values() == v).all() and (e.select_many(np.arange(n)[::2]) == v[::2]).all() and all(e.select(i) == v[i] for i in range(n))
    assert 8 * (len(e.lower) + len(e.upper)) < 64 * 5


TEXTS = [*EDGES, "it'sx 's !'s ''s don't\n'tis 漢字's Привет мир \u3000かな ٣४ \u1c89x हिन्दी", "a<|endoftext|>\u1c89<|endoftext|>b", "don't stop I'll   go\n\n x  ", " a", "ΑΣΣ σας İstanbul ﬁ ŉ", "\x1c a\x85b\xa0c ½²3", "<|startoftext|>x", "Straße ÄÖÜ ñandú 123 4", "ab" * 400]


def test_token_blocks_match_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    token_output.write_token_blocks(frame(spark, TEXTS).repartition(3), P.path("byte_bpe_50k.json"), str(tmp_path / "b"))
    got = sorted(tuple(r) for r in token_output.read_token_blocks(spark, str(tmp_path / "b")).collect())
    start, want = 0, []
    for i, t in enumerate(TEXTS):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    texts = frame(spark, TEXTS)
    some = {r.doc_id: r.ids for r in token_output.fetch_token_ids(spark, str(tmp_path / "b"), texts.where("doc_id % 3 = 1 or doc_id < 0").select("doc_id")).collect()}
    assert some == {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS) if i % 3 == 1}


def test_backtracking_matches_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(6)
    texts = [*TEXTS, *[" ".join("".join(rng.choice("theaionsrlßé") for _ in range(rng.randint(1, 14))) for _ in range(60)) for _ in range(20)]]
    got = {r.doc_id: r for r in bpe.token_digests(frame(spark, texts), P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


# ---- 8


def test_snapshots_collapse(spark):
    rows = []
    for conv, turns in {1: "ab", 2: "abc", 3: "abc", 4: "x", 5: "abd", 6: "b"}.items():
        rows += [(conv, k, "user" if k % 2 == 0 else None, t) for k, t in enumerate(turns)]
    rows += [(None, k, None, t) for k, t in enumerate("abcx")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(9)).withColumn("rendered", F.lit("x"))
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in conversations.collapse(turns).collect()}
    assert got == {2: (3, 2), 4: (1, 1), 5: (3, 1), 6: (1, 1)}
    assert {r.conv_id: r.rendered.count("<|end|>") for r in conversations.render(turns, conversations.collapse(turns)).collect()} == {2: 3, 4: 1, 5: 3, 6: 1}
    assert conversations.unnamed(turns).count() == 4 and conversations.collapse(turns.limit(0)).count() == 0


def test_a_sample_stays_bounded_however_many_documents_there_are(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 0.5)
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.lit("en").alias("lang"))
    assert language.training_sample(docs, F.lit(True)).count() <= 4
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 200)
    assert 140 <= language.training_sample(docs, F.lit(True)).count() <= 260
    assert 60 <= language.training_sample(docs.union(docs), F.lit(True)).count() <= 150  # rows that repeat count once


def test_spans_of_letters_that_grow_in_lower_case():
    codes, bounds, start, end = language.lowered_words(["İİİİ the cat", None, "Straße"])
    assert list(zip(start.tolist(), end.tolist())) == [(0, 4), (5, 8), (9, 12), (12, 18)] and bounds.tolist() == [0, 12, 12, 18]


# ---- 10


def test_base_measures_match_brute_force(spark):
    rng = random.Random(7)
    texts = [*EDGES, *["\n".join(" ".join(rng.choice("a b c the of $x".split()) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))) for _ in range(80)]]
    for r in quality.rules(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


@pytest.mark.parametrize("slots", [1, 4, 256])
def test_common_words_are_looked_up_by_their_hash(spark, monkeypatch, slots):
    monkeypatch.setattr(quality, "SLOTS", slots)
    rng = random.Random(slots)
    words = vocabulary(1, 32)
    texts = [[rng.choice([*words, *vocabulary(2, 60)]) for _ in range(n)] for n in (0, 1, 7, 300)]
    rows = spark.createDataFrame([(t, words) for t in texts], "t array<string>, w array<string>").withColumn("s", quality._slots(F.col("w")))
    got = [list(r[0]) for r in rows.select(quality.word_hits(F.col("t"), F.col("w"), F.col("s"))).collect()]
    assert got == [sorted((words.index(x) + 1 for x in t if x in words), reverse=True) for t in texts]


def test_windows_that_are_alike_in_their_leading_bits_alone_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(quality, "LOW_BITS", 62)
    monkeypatch.setattr(quality, "LOW", (1 << 62) - 1)  # four kinds of leading bits: nearly every window has neighbours
    monkeypatch.setattr(quality, "_placed", lambda w: F.sort_array(F.transform(w, lambda h, i: h.bitwiseAND(~quality.LOW).bitwiseOR(i.cast("long")))))
    rows = {r.doc_id: r.n_repeat_words for r in quality.rules(frame(spark, [" ".join(f"w{i}" for i in range(90)), "a b c " + " ".join(f"w{i}" for i in range(90)) + " a b c", "a b c a b c"])).collect()}
    assert rows == {0: 0, 1: 6, 2: 6}


def test_far_documents_are_rejected(spark):
    rng = random.Random(5)
    common, rare = vocabulary(4, 20), vocabulary(3, 400)
    fine = [" ".join(rng.choice(common if rng.random() < 0.4 else rare) for _ in range(150)) for _ in range(60)]
    odd = ["".join(c.upper() for c in fine[0].replace(" ", "!!! ")), " ".join("%$#&" + str(i) for i in range(200)), " ".join(vocabulary(99, 150))]
    got = {r.doc_id: r.kept for r in quality.rules(frame(spark, [*fine, *odd])).collect()}
    assert all(got[i] for i in range(60)) and not (got[60] or got[61] or got[62])


def test_words_are_cut_alike():
    codes, bounds = tv.flat([t for t in EDGES])
    start, end = tv.runs(tv.is_word(codes), bounds)
    found = [[] for _ in EDGES]
    joined = "".join(t or "" for t in EDGES)
    for s, e in zip(start, end):
        found[int(tv.doc_of(np.array([s]), bounds)[0])].append(joined[s:e])
    assert found == [WORD.findall(t or "") for t in EDGES]


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(ORACLES) <= set(QUERIES)
