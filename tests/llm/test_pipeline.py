"""The corpus pipeline's stages on small tables: what each keeps, whatever other columns are called, and nothing at all."""

import hashlib
import random
import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __lang_pred string, __blocks int, _row string, `a.b` int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], len(t or ""), "x", i, "y", i) for i, t in enumerate(texts)], DOCS)


def test_stages_keep_whole_rows(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 120))) for _ in range(40)]
    texts += [texts[0], texts[0] + " more", None, "", "12 !!", "a b c"]
    docs = frame(spark, texts)
    stages = dict(pipeline.STAGES)
    rows = {}
    for name in ("language", "quality", "near duplicates", "mixing"):
        docs = stages[name](spark, docs, "")
        assert docs.columns == frame(spark, []).columns
        rows[name] = docs.collect()
        docs = spark.createDataFrame(rows[name], docs.schema)
        for r in rows[name]:
            assert (r["__lang_pred"], r["__blocks"], r["_row"], r["a.b"]) == ("x", r.doc_id, "y", r.doc_id)
    assert {r.doc_id for r in rows["language"]} == set(range(42)) | {45} and {r.lang for r in rows["language"]} == {"en"}
    assert {r.doc_id for r in rows["quality"]} == set(range(42))
    assert {r.doc_id for r in rows["near duplicates"]} == set(range(40))
    size, taken = {r.doc_id: len(WORD.findall(r.text)) for r in rows["near duplicates"]}, Counter()
    for r in rows["mixing"]:
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(n <= 2 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.02 * sum(size.values())
    ids = stages["token ids"](spark, docs, "").collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows["mixing"]:
        own = lib.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in ids) == want


def test_stages_on_nothing(spark):
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame(spark, []), "").count() == 0
