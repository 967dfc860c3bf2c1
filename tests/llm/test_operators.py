"""Every operator against a brute-force version on small tables with unusual rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginloom.llm import (bpe, chat, jaccard, language, mixing, sharding, suffixes, topk, toxicity,
                            vectors)
from marginloom.llm.components import components
from marginloom.llm.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"word{i % 97} of{i}" for i in range(3000))
PASSAGE = "".join(chr(97 + (i * i + 3 * i) % 26) for i in range(330))
BASE = " ".join(f"t{i}" for i in range(120))
TEXTS = [None, "", "  \t\n", "one", "one two", "ONE two", BASE, BASE + " x", BASE.replace("t5 ", "q "), BASE,
         LONG, LONG + " end", PASSAGE, "é" + PASSAGE + "ü", "pre " + PASSAGE[:250], "a" * 450,
         "<|endoftext|> it's  done\n\n ok", "日本語 text ́", PASSAGE]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en" if i % 2 else None, ["a", None, "b"][i % 3], 1, "x") for i, t in enumerate(TEXTS)]
    rows.append(rows[7])
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, node string")


def shingles(text, width=3):
    words = re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def test_repeated_bytes(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[i:i + 200] for _, b in rows for i in range(len(b) - 199))
    expected = []
    for key, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(docs).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard(docs, width, percent):
    sets = {r.doc_id: shingles(r.text, width) for r in docs.collect()}
    top = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    got = jaccard.near_duplicates(docs, percent, width).collect()
    assert len(got) == docs.count()
    assert {r[0]: (r[1], r[2]) for r in got} == {k: (len(sets[k]), top[k]) for k in sets}


def test_mix(docs):
    got = mixing.document_mix(docs).collect()
    sizes = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in docs.collect()}
    assert len(got) == docs.count() and all(r["size"] == sizes[r.doc_id] for r in got)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 for s, t in targets.values())
    for source, (_, target) in targets.items():
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - target) <= 2 * max(r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.document_mix(docs).collect()))
    repeated = mixing.repeat_rows(docs, mixing.document_mix(docs))
    assert repeated.columns == docs.columns


def test_language(spark):
    ship(spark)
    rows = [(i, f"the house and the water of {i} things with every friend", "en") for i in range(60)]
    rows += [(100 + i, f"das haus und der wald von {i} sachen mit jedem freund", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 !!", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(frame, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == "und" and not got[k].accepted for k in (200, 201, 202))
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:100])
    assert all(0 <= r.score <= 1 for r in got.values())


def test_chat_round_trip(spark):
    ship(spark)
    said = ["</s>[INST] ok [/INST]", "<|end|> <\\|x <\\\\|turn|> <|", "", None, "é日\n<|assistant|>"]
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c in (1, None) for t, x in enumerate(said)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(frame.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in chat.read_back(turns, "conv_id", ["turn", "role", "text"]).collect()}
    loss = "".join(x or "" for t, x in enumerate(said) if t % 2)
    whole = "".join(f"{'assistant' if t % 2 else 'user'}\n{x or ''}\n" for t, x in enumerate(said))
    for key in (1, None):
        assert got[key].n_turns == 5 and got[key].loss_chars == len(loss)
        assert got[key].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_parts(spark):
    rows = [("user", [("text", "see <|image:0|>", None, None), ("image", None, "a.png", 2),
                      ("audio", None, "b.wav", 3), ("text", "ok", None, None)]), ("assistant", None)]
    frame = spark.createDataFrame(rows, f"role string, parts {chat.PARTS}")
    first, second = chat.format_turns(frame).collect()
    assert first.formatted == "<|turn|>user<|body|>see <\\|image:0|><|image:0|><|audio:1|>ok<|end|>"
    assert [tuple(a) for a in first.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 75)]
    assert second.formatted == "<|turn|>assistant<|body|><|end|>" and second.loss_length == 0


def test_top_k(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(400, rows[0][1]), (401, None), (402, [None] * 8), (450, [float("nan")] * 8), (451, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, "vec_id", "embedding").collect()
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows[:301]}
    expected = []
    for q in [i for i in good if i % 50 == 0]:
        best = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_bpe_matches_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.encode_documents(docs.select("doc_id", "text"), path)
    for r in got.collect():
        expected = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.token_ids == expected and r.n_tokens == len(expected)
        decoded = library.decode(expected, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_shards(docs):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == docs.count()
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in got} <= set(range(4)) and {r.grown_shard for r in got} == {None}
    assert sum(r["size"] for r in got) == sum(len((r.text or "").encode()) + 8 for r in docs.collect())


def test_vectors(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(0, 0.08 * (i % 5), 32)]) for i in range(200)]
    rows += [(300, rows[0][1]), (301, None), (302, [0.0] * 32), (303, [float("inf")] * 32), (304, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    ids = [i for i, _ in rows[:201]]
    x = np.array([v for _, v in rows[:201]], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / norm[:, None] / norm >= 0.9
    np.fill_diagonal(linked, False)
    top = np.array(ids)
    for _ in ids:
        for i in range(len(ids)):
            top[i] = min(top[i], *top[linked[i]], 10**9)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id) == (linked[k].sum(), top[k])
    assert all(got[i].n_links == 0 and got[i].kept for i in (301, 302, 303, 304))


def test_other_kinds_of_parts_are_kept(spark):
    rows = [("user", [("video", None, "v.mp4", 4), (None, "a", None, None), ("x<|y", "t", "r", None)])]
    turn = chat.format_turns(spark.createDataFrame(rows, f"role string, parts {chat.PARTS}")).first()
    assert turn.formatted == "<|turn|>user<|body|><|video:0|>a<|x<\\|y:1|><|end|>"
    assert [tuple(a) for a in turn.attachments] == [("video", "v.mp4", 4), ("x<|y", "r", 1)]


def test_top_k_of_large_and_repeated_queries(spark):
    ship(spark)
    rows = [(0, [1.0, 0.0]), (0, [0.0, -1.0]), (1, [200000.0, 3.0]), (2, [-5.0, -1e20]), (3, [1e30, 1e30]),
            (4, [0.5, 0.25]), (50, [1e10, 1e9])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0,
                     "vec_id", "embedding").collect()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    expected = []
    for q in (0, 50):
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for j, v in whole if j == q
                         for i, w in whole if i != q))[:5]
        expected += [(q, n + 1, i, max(-2**63, min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("rows", [
    [(None, "one text")] * 2400, [(7, "one text")] * 2400,
    [(i, f"text {i % 40} " + "long " * (i % 97)) for i in range(3000)] + [(None, "copy " * 300)] * 900])
def test_shards_of_near_equal_bytes(spark, rows):
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sizes, texts = Counter(), Counter()
    for r in got:
        sizes[r.shard] += r["size"]
        texts[r.text_crc32, r.shard] += 1
    assert len(got) == len(rows) and set(sizes) == set(range(24))
    mean = sum(sizes.values()) / 24
    assert max(abs(n - mean) for n in sizes.values()) < 0.1 * mean
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    # A text stands in more than one shard only if a cut had to divide it.
    split = Counter(t for t, _ in texts)
    assert sum(n > 1 for n in split.values()) <= 23


@pytest.mark.parametrize("rule", ["xor", "and"])
def test_toxicity_of_pairs(spark, rule):
    ship(spark)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(4000):
        a, b = rng.integers(2, size=2)
        words = [f"w{x}" for x in rng.integers(0, 300, 20)] + ["scum"] * a + ["group"] * b
        rows.append((i, " ".join(rng.permutation(words)), int(a != b if rule == "xor" else a and b)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.drop("text"), ~language.held_out(), "toxic")
    got = {r.doc_id: r.score for r in toxicity.score(frame.filter(language.held_out()), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(label) for i, _, label in rows if i in got]) > 0.97


def test_vectors_of_any_size(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e300, 0.0]), (3, [1e-60, 1e-60]), (4, [1e-60, 1e-60]), (5, [5e-324, 0.0]),
            (6, [1e300, -1e-300]), (7, [-1.0, 0.0]), (None, [3e200, 3e200]), (2, [0.0, 7.0]), (8, [float("nan"), 1.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [
        (0, 2, 3), (1, 3, 1), (2, 0, 2), (2, 3, 1), (3, 2, 3), (4, 2, 3), (5, 3, 1), (6, 3, 1), (7, 0, 7), (8, 0, 8)]


def test_vectors_at_the_threshold_and_in_pieces(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 48))
    x = np.concatenate([base + rng.normal(0, s, base.shape) for s in (0, .05, .2, .4, .46, .5, .6)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    norm = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / norm[:, None] / norm >= 0.9
    expected = (linked.sum(axis=1) - 1).tolist()
    for piece in (16384, 7):
        monkeypatch.setattr(vectors, "PIECE", piece)
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
        assert [got[i] for i in range(len(x))] == expected


def test_vectors_lie_in_one_piece_and_are_not_shuffled_to_meet(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(vectors, "PIECE", 10)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(100)] + [(200 + i, [1.0, -0.0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    pieces = vectors.packed(vectors.named(frame, 0.9), 6).localCheckpoint()
    assert sum(len(r.node) // 8 for r in pieces.collect()) == 101
    assert max(len(r.node) // 8 for r in pieces.collect()) <= 10
    plan = vectors.links(pieces, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_toxicity(spark):
    ship(spark)
    rows = [(i, f"a quiet text about topic {i % 7}" + (" you scum" if i % 4 == 0 else ""), int(i % 4 == 0))
            for i in range(400)] + [(500, None, None), (501, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.drop("text"), ~language.held_out(), "toxic")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert all((got[i] >= 0.5) == bool(label) for i, _, label in rows[:400])
    assert got[500] == got[501]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {
        (i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert suffixes.remove_repeats(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert mixing.document_mix(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert language.identify(none, ["doc_id"]).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0, "vec_id", "embedding").count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(none, labels, F.lit(True), "toxic")
    assert toxicity.score(none, model).count() == 0
