"""Operators 11 to 13 against brute force, with edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tallyforge.llm import alignment, divergence, hnsw, vector_dedup

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, value string, term string, g int, uid long, rank int"


def docs_frame(spark, rows):
    """rows of (text, lang, source); ids repeat, one is null; further columns clash with what operators name their own."""
    return spark.createDataFrame([(None if i == 3 else i // 2 * 2, t, l, s, 1, "v", "t", 7, 8, 9) for i, (t, l, s) in enumerate(rows)], DOCS).repartition(3)


# ---- 11

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, least_docs=3, most_terms=200):
    docs = [((l or "", s or ""), Counter(TERM.findall((t or "").translate(FOLD)))) for t, l, s in rows]
    out = []
    for lang in {g[0] for g, _ in docs}:
        held = Counter(t for (l, _), c in docs if l == lang for t in c)
        kept = sorted(t for t, n in held.items() if n >= least_docs)
        sources = sorted({s for (l, s), _ in docs if l == lang})
        count = {s: Counter() for s in sources}
        for (l, s), c in docs:
            if l == lang:
                count[s].update({t: n for t, n in c.items() if held[t] >= least_docs})
        shares = lambda c: {t: 1 + int(Fraction(10**9 * (c[t] + 1), sum(c.values()) + len(kept))) for t in kept}
        p = {s: shares(count[s]) for s in sources}
        q = shares(sum(count.values(), Counter()))
        loss = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pair = [(sum(loss(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(loss(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, most_terms)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


@pytest.mark.parametrize("tile,heavy", [(64, 0.25), (4, 0.25), (5, 2.0), (3, 0.0)])
def test_divergence_is_exact_however_terms_are_split(spark, monkeypatch, tile, heavy):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "MOST_TILES", 3)
    monkeypatch.setattr(divergence, "HEAVY", heavy)
    monkeypatch.setattr(divergence, "MOST_PAIRS", 50)
    monkeypatch.setattr(divergence, "MOST_HELD", 40)
    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = [(" ".join(rng.choices(words, [1 / (k + 1) for k in range(120)], k=rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{rng.randrange(11)}") for _ in range(150)]
    rows += [(None, "en", None), ("", None, "s1"), ("only here once", "fr", "s1"), ("nothing kept", "fr", "s2"), ("Émile ÉMILE émile İx 漢字", "en", "s3"), ("émile 漢字 İX", "en", "s4"), ("漢字, émile; İx", None, None), ("漢字! émile", "en", "s5"), ("1234 5678", "en", "digits"), ("a1b " * 4000, "en", "s1")]
    got = sorted(tuple(r) for r in divergence.divergence(docs_frame(spark, rows), most_terms=9).collect())
    assert got == brute_divergence(rows, most_terms=9)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(docs_frame(spark, [("a", "b", "c")]).limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    pairs = [(1, 3), (999, 1000), (10**12 + 7, 9 * 10**14 + 1), (5, 5), (1, 8 * 10**15)]
    got = [r[0] for r in spark.createDataFrame(pairs, "n long, t long").select(divergence.share(*map(divergence.F.col, "nt"))).collect()]
    assert got == [1 + 10**9 * n // t for n, t in pairs]


# ---- 12


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(c): c for c in chars} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in chars)}
    raw_a = lambda i: bytes(to_byte[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, held = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if t and any(b"".join(map(f, ids)) != (" " + t).encode() for f, ids in ((raw_a, x), (raw_b, y))):
            x, y = [], []
        ends = [list(np.cumsum([len(f(i)) for i in ids])) for f, ids in ((raw_a, x), (raw_b, y))]
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups = [[[i for i, e in zip(ids, at, strict=True) if lo < e <= hi] for ids, at in zip((x, y), ends, strict=True)] for lo, hi in zip([0, *cuts], cuts)]
        links = Counter((i, j) for g, h in groups for i in g for j in h)
        held.update(links.keys())
        docs.append((x, y, groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for x, y, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(m for (i, j), m in links.items() if held[i, j] == most[i])
        out.append((len(x), len(y), len(groups), sum(links.values()), best, sum(m * held[k] for k, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, held


TEXTS = [
    None, "", " ", "  x  y ", "the cat sat", "The cat sat on the mat.\n\nThe  cat", "don't <|endoftext|> </s> <unk> <0x41>", "a▁b", "漢字かな交じり文 🙂🙂 été naïve", "İstanbul ͸ \U000e0fff new",
    "x\ty\r\nz\x00　​", "a" * 700, "ab" * 400 + " " + "é" * 300, "the cat sat", "3.14159 2,718 1000000", "\n\n\n", "word " * 900, "ﬁne ＡＢＣ ½ Ⅳ", "=" * 90 + "-" * 77,
]


@pytest.mark.parametrize("stream,held", [(2_000_000, 1_000_000), (3, 20)])
def test_alignment_matches_brute_force(spark, monkeypatch, stream, held):
    monkeypatch.setattr(alignment, "STREAM", stream)
    monkeypatch.setattr(alignment, "MOST_HELD", held)
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choices(["the", "cats", "are", "naïve", "Straße", "12", "unhappiness,", "(x)"], k=rng.randint(1, 40))) for _ in range(40)]
    want, counted = brute_alignment(texts)
    rows = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, a string, uid int").repartition(4)
    out, pairs = alignment.align(rows, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert [tuple(r)[1:] for r in sorted(out.collect())] == want
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == counted
    best = {r["a"]: (r["b"], r["n"]) for r in alignment.id_map(pairs).collect()}
    assert best == {a: min(((b, n) for (x, b), n in counted.items() if x == a), key=lambda y: (-y[1], y[0])) for a in {a for a, _ in counted}}


def test_pairs_of_a_text_do_not_depend_on_slices(monkeypatch):
    both = alignment.sides(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    want = [x.tolist() for x in alignment.Aligned(TEXTS, both).postings()]
    monkeypatch.setattr(alignment, "MOST_PAIRS", 5)
    assert [x.tolist() for x in alignment.Aligned(TEXTS, both).postings()] == want


def test_alignment_of_repeated_and_null_ids_and_of_an_empty_table(spark):
    rows = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the cat"), (2, None)], "doc_id long, text string")
    out, pairs = alignment.align(rows, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert sorted((r["doc_id"] or -1, r["n_links"], r["count_sum"]) for r in out.collect()) == [(-1, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    out, pairs = alignment.align(rows.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert out.count() == 0 and pairs.count() == 0


# ---- 13

VECTORS = "vec_id long, embedding array<float>, label int, shard int, cid long, kind string"


def groups_of_vectors(rng, n, d=24):
    """Vectors of two labels: alone, in tight and in wide groups, copies, scaled copies."""
    out = list(rng.standard_normal((n, d)))
    for size, spread in ((60, 0.01), (40, 0.12), (25, 0.2), (30, 0.05)):
        base = rng.standard_normal(d)
        base /= np.linalg.norm(base)
        out += [(base + spread * rng.standard_normal(d) / np.sqrt(d) * 1.5) * rng.uniform(0.2, 5) for _ in range(size)]
    out += [out[0], 2 * out[1], out[-1], out[-1]]
    return np.array(out, np.float32)


def brute_links(vectors, labels, cosine=0.93):
    v = vectors.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = (v @ v.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(len(v))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(v)).min(1))
        if (new == root).all():
            return linked.sum(1), root
        root = new


@pytest.mark.parametrize("shard_rows,stream_rows", [(16_384, 65_536), (100, 70)])
def test_vector_links_match_brute_force(spark, monkeypatch, shard_rows, stream_rows):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vector_dedup, "STREAM_ROWS", stream_rows)
    rng = np.random.default_rng(11)
    vectors = groups_of_vectors(rng, 400)
    labels = rng.permutation(np.arange(len(vectors)) % 2)
    labels[400:460] = 0
    n, root = brute_links(vectors, labels)
    rows = spark.createDataFrame([(i, v.tolist(), int(l), 1, 2, "k") for i, (v, l) in enumerate(zip(vectors, labels, strict=True))], VECTORS).repartition(5)
    got = sorted(tuple(r) for r in vector_dedup.near_duplicates(rows).collect())
    assert [r[0] for r in got] == list(range(len(vectors)))
    found = np.array([r[1] for r in got])
    assert (found <= n).all() and found.sum() >= 0.98 * n.sum()
    assert np.mean([r[2] == t for r, t in zip(got, root, strict=True)]) >= 0.99 and all(r[2] >= t for r, t in zip(got, root, strict=True))
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 0.0]
    rows = [(0, a, 1), (1, a, 1), (1, a, 1), (2, a, 2), (3, a, None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [], 1), (10, [1.0], 1), (11, [2.0], 1), (None, [3.0, 0.0], 1), (12, [1e38, 0.0], 1), (None, None, None)]
    got = vector_dedup.near_duplicates(spark.createDataFrame([(*r, 1, 2, "k") for r in rows], VECTORS)).collect()
    by = sorted(((-1 if r[0] is None else r[0]), r[1], r[2], r[3]) for r in got if r[2] is not None)
    assert by == sorted([(0, 4, 0, True), (1, 4, 0, False), (1, 4, 0, False), (-1, 4, 0, False), (12, 4, 0, False), (10, 1, 10, True), (11, 1, 10, False), *[(k, 0, k, True) for k in range(2, 10)]])
    assert [tuple(r) for r in got if r[2] is None] == [(None, 0, None, False)]
    assert vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_graph_finds_neighbours_and_audits_its_beam():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph(v, 0.6)
    assert graph.audit() >= hnsw.LEAST_RECALL or graph.beam == len(v)
    query, node, whole = graph.links(v, graph.beam)
    got = {(int(q), int(graph.order[x])) for q, x in zip(query, node, strict=True)}
    true = {(int(q), int(x)) for q, x in zip(*np.nonzero(v @ v.T >= 0.6), strict=True)}
    assert not whole.any() and got <= true and len(got) >= 0.97 * len(true)


def test_a_group_of_near_copies_is_one_node():
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    v = np.concatenate([base + 1e-4 * rng.standard_normal((3000, 16)), rng.standard_normal((200, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph(v, 0.93)
    assert len(np.unique(graph.ball)) < 250
    query, node, whole = graph.links(v[:50], graph.beam)
    assert len(query) < 50 * 20 and np.bincount(query, np.where(whole, np.diff(graph.first)[node], 1)).min() >= 3000
