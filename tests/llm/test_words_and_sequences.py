"""Spelling variants, periodic runs and packing against brute force, on whole texts with unusual rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from marginloom.llm import periods, sequences, spelling
from marginloom.llm.queries import QUERIES
from marginloom.llm.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
NAMES = "doc_id long, text string, start long, word string, n long"
TEXTS = [
    None, "", " \t\n", "x", "abc " * 9, "ab ba " * 40 + "end", "Words wOrds words wrods word words wordz",
    "naïve naive naivé naïve NAÏVE naïve naivety", "<|endoftext|> it's  done\n\n ok_-' it's İ é 日本 ² \x1c x",
    " ".join(f"w{i % 11}" for i in range(300)), "a b c " * 3 + "a b c d " * 4 + "tail", "one one one one one one one",
    " ".join(f"long{i * i % 713}" for i in range(9000)), "letters lettres lettesr letter letters",
    "x " * 30 + " " + " y" * 30, "same text twice", "same text twice",
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    stock = ["stone", "stones", "stony", "river", "rivers", "riverr", "silver", "sliver", "garden", "gardens"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[6]), (3, TEXTS[6])]
    rows += [(1000 + i, " ".join(rng.choice(stock, 40))) for i in range(300)]
    return spark.createDataFrame([(i, t, 7, "clash", 9) for i, t in rows], NAMES).repartition(3)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{word}".encode())
            if key is not None and h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return sorted(out, key=str)


def test_spelling(docs, monkeypatch):
    expected = brute_spelling([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[2] not in (r[0], r[1]) for r in expected) or any(r[1] for r in expected)
    for parts, pieces, bucket in ((1, 7, 200), (2, 4, 200), (3, 1, 1), (1, 7, 1)):
        monkeypatch.setattr(spelling, "BUCKET", bucket)
        got = spelling.spelling_groups(docs, parts=parts, pieces=pieces).collect()
        assert sorted(map(tuple, got), key=str) == expected


def test_spelling_broadcasts_no_table(docs, monkeypatch):
    plans, store = [], spelling.materialize

    def kept(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, purpose)

    monkeypatch.setattr(spelling, "materialize", kept)
    plans.append(spelling.spelling_groups(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)


def test_form_chains(spark):
    words = ["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 95
    rows = [(None, " ".join(words))]
    got = {r.word: r for r in spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["aaaaa"].root == "abbbb" and got["abbbb"].form is None and got["abbbb"].root == "abbbb"


def test_signatures_are_shared_by_all_near_words():
    rng = np.random.default_rng(8)
    for _ in range(300):
        w = "".join(rng.choice(list("abcdeéz"), rng.integers(5, 12)))
        at, c = rng.integers(len(w)), rng.choice(list("abxyé"))
        for v in (w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]):
            for parts, pieces in ((1, 7), (2, 4), (3, 1)):
                x, y = spelling.signatures(pa.array([w, v]), parts, pieces)
                assert (x == y).any()


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        s = 0
        while s < len(words) - q:
            e = s
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            part = words[s:e + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, len(part), q))
            s = max(e, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected_runs(key, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)])


def test_periodic_runs(spark, docs, tmp_path):
    short = docs.filter("text IS NULL OR length(text) < 5000")
    short.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    expected = [expected_runs(r.doc_id, r.text) for r in short.collect()]
    assert sum(r[1] for r in expected) > 20
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(150):
        rows = []
        for _ in range(rng.integers(1, 6)):
            row = rng.integers(0, letters, rng.integers(0, 70))
            if len(row) > 10:
                a, p = rng.integers(len(row)), rng.integers(1, 9)
                row = row[[i if i < a else a + (i - a) % p for i in range(len(row)) if i < a or a + (i - a) % p < len(row)]]
            rows.append(row.tolist())
        hashes = np.array([x for r in rows for x in r], np.uint64) * np.uint64(7919) + np.uint64(3)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        found = list(zip(*(c.tolist() for c in periods.find_runs(hashes, ends))))
        assert found == [(k, *x) for k, r in enumerate(rows) for x in brute_runs(r)]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_packing(docs):
    path, tok = library()
    got = sequences.pack_documents(docs, path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length > 0 and len(r.token_ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for rows in by_sequence.values():
        total = sum(r.length for r in rows)
        assert total <= 2048 and total & (total - 1) == 0
        assert [r.offset for r in sorted(rows, key=lambda r: r.offset)] == np.cumsum(
            [0] + [r.length for r in sorted(rows, key=lambda r: r.offset)])[:-1].tolist()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(tok.encode(r.text or "", add_special_tokens=False).ids + [1])
    assert set(texts) == set(by_doc)
    for key, all_ids in texts.items():
        if len(all_ids) == 1:
            rows = sorted(by_doc[key], key=lambda r: r.start)
            ids = np.frombuffer(b"".join(bytes(r.token_ids) for r in rows), "<u4").tolist()
            assert ids == all_ids[0] and {r.doc_tokens for r in rows} == {len(ids)}
        assert sum(r.length for r in by_doc[key]) == sum(map(len, all_ids))


def test_descending_documents_go_to_the_cheapest_sequence():
    pieces, left = sequences.assigned([900, 800, 700, 600, 500], [2048, 2048])
    assert pieces[:5] == [(0, 0, 900, 0), (1, 0, 800, 1), (2, 0, 700, 1), (3, 0, 600, 0), (4, 0, 500, 1)] and not left
    pieces, left = sequences.assigned([1500, 1400, 1300], [2048, 2048])  # nobody has room for the third
    assert pieces[2:] == [(2, 0, 648, 1), (2, 648, 548, 0)] and left == [(2, 1196)]
    loads = [sum(sequences.cost(n) for _, _, n, at in pieces if at == k) for k in (0, 1)]
    assert max(loads) / min(loads) < 1.1


def test_windows_pass_their_rest_on(monkeypatch):
    monkeypatch.setattr(sequences, "WINDOW", 2)
    rng = np.random.default_rng(2)
    shelf = sequences.Shelf(5, 64)
    sizes = rng.integers(1, 200, 300)
    for key, n in enumerate(sizes):
        shelf.put(key, np.arange(n, dtype="<u4").tobytes())
    shelf.pack(True)
    filled, seen = Counter(), defaultdict(list)
    for key, start, n, ids, total, at, offset in shelf.ready:
        filled[at] += n
        seen[key] += np.frombuffer(ids, "<u4").tolist()
        assert total == sizes[key] and ids == np.arange(start, start + n, dtype="<u4").tobytes()
    assert all(sorted(seen[k]) == list(range(n)) for k, n in enumerate(sizes))
    assert sorted(filled) == list(range(5, 5 + len(filled)))
    assert sum(n != 64 for n in filled.values()) == bin(sum(sizes) % 64).count("1")


def test_plain_texts_equal_the_library():
    path, tok = library()
    encoder = sequences.Encoder(path)
    rng = np.random.default_rng(9)
    signs = list("abcXYZ'stredlm 0189_-!?.\n\t\x0b\x1c\x7f éÀßİıŒǅ²ªº 日'") + ["<|endoftext|>", "'ll", "'S", "'re"]
    texts = ["".join(rng.choice(signs if k % 3 else signs[:-4], rng.integers(0, 25))) for k in range(3000)]
    expected = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == expected
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.column(pa.array([*texts, None]))] == [*expected, []]


def test_empty_tables(docs):
    none = docs.limit(0)
    assert spelling.spelling_groups(none).count() == 0
    assert periods.periodic_runs(none).count() == 0
    assert sequences.pack_documents(none, library()[0]).count() == 0
