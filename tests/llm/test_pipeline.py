"""The pipeline's stages against brute force, on rows with null and repeated ids."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from test_operators import BASE, LONG, PASSAGE, shingles

import corpus_pipeline
from marginloom.llm import mixing
from marginloom.llm.shipping import ship

OTHER = " ".join(f"o{i}" for i in range(90))
ROWS = [
    (1, BASE), (1, BASE), (None, BASE), (2, BASE + " x"),        # one document, with ids and without
    (3, OTHER), (3, BASE.replace("t5 ", "q ")),                  # one id: a clean text and a copy
    (4, LONG), (4, LONG), (None, LONG + " end"),                 # stands twice with one id
    (None, PASSAGE + " tail of one"), (5, "head of two " + PASSAGE),
    (None, "alone without id"), (None, "another one without id"), (None, "alone without id"),
    (6, "one id"), (6, "two texts"), (7, None), (None, None), (7, None), (8, " \t"), (8, " \t"), (None, ""),
    *[(i // 2 if i % 3 else None, f"filler text number {i} " + f"w{i} " * (i % 7)) for i in range(100, 140)],
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", ["a", None, "b"][k % 3] if i is None or i > 8 else "a", 1) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_leave_one_of_each_group(docs):
    rows = [tuple(r) for r in docs.collect()]
    sets = [shingles(r[1], 5) for r in rows]
    top = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    top[a] = top[b] = min(top[a], top[b])
    groups = defaultdict(list)
    for r, t in zip(rows, top):
        groups[t].append(r)
    got = Counter(tuple(r) for r in corpus_pipeline.drop_near_duplicates(docs.sparkSession, docs, "").collect())
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        first = min((r[0] is None, r[0] or 0) for r in members)
        firsts = {r for r in members if (r[0] is None, r[0] or 0) == first}
        if shingles(members[0][1], 5):
            assert sum(got[r] for r in set(members)) == sum(got[r] for r in firsts) == 1
        else:
            assert got[members[0]] == rows.count(members[0])


def test_repeated_passages_keep_rows(docs):
    rows = [tuple(r) for r in docs.collect()]
    seen = Counter(b[i:i + 200] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - 199))
    expected = Counter()
    for key, text, lang, source, _ in rows:
        b = (text or "").encode()
        gone = {j for i in range(len(b) - 199) if seen[b[i:i + 200]] > 1 for j in range(i, i + 200)}
        kept = bytes(x for j, x in enumerate(b) if j not in gone).decode()
        if kept:
            expected[key, kept, lang, source, len(kept)] += 1
    got = corpus_pipeline.drop_repeated_passages(docs.sparkSession, docs, "").collect()
    assert Counter(map(tuple, got)) == expected


def test_mix_takes_rows_not_ids(docs):
    rows = Counter(tuple(r) for r in docs.collect())
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(docs.sparkSession, docs, "").collect())
    assert set(got) <= set(rows)
    targets = {r.source: (r.source_size, r.target) for r in mixing.document_mix(docs).collect()}
    for source, (size, target) in targets.items():
        words = {r: len((r[1] or "").split()) for r in rows if r[3] == source}
        for r in words:
            assert rows[r] * math.floor(target / size) <= got[r] <= rows[r] * math.ceil(target / size)
        assert abs(sum(got[r] * n for r, n in words.items()) - target) <= 2 * max(words.values())


def test_clean_documents_reach_the_end_of_the_deduplication(docs):
    spark = docs.sparkSession
    left = corpus_pipeline.drop_repeated_passages(
        spark, corpus_pipeline.drop_near_duplicates(spark, docs, ""), "").collect()
    texts = Counter((r.doc_id, r.text) for r in left)
    for row in [(1, BASE), (3, OTHER), (4, LONG), (None, "alone without id"), (6, "one id"), (6, "two texts")]:
        assert texts[row] == 1
