import random
from difflib import SequenceMatcher

import pytest

from scriptorium.operators import alignment as A


def plain_dp(page, ref):
    m, n = len(page), len(ref)
    best = [[0.0] * (n + 1) for _ in range(m + 1)]
    way = [[None] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            if i == 0:
                way[i][j] = "L" if j else None
                continue
            if j == 0:
                best[i][j], way[i][j] = best[i - 1][j] - 0.5, "U"
                continue
            s = 1.0 if page[i - 1] == ref[j - 1] else SequenceMatcher(None, page[i - 1], ref[j - 1]).ratio()
            options = [(best[i - 1][j - 1] + (2.0 if s >= 0.6 else -(1 - s)), "D"), (best[i - 1][j] - 0.5, "U"), (best[i][j - 1] - 0.5, "L")]
            best[i][j], way[i][j] = max(options, key=lambda o: o[0])
    i, j, out = m, max(range(n + 1), key=lambda k: best[m][k]), []
    while i or j:
        k = way[i][j]
        i, j = i - (k != "L"), j - (k != "U")
        out.append((i if k != "L" else None, j if k != "U" else None))
    return out[::-1]


def test_words_align_as_the_plain_recursion():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    for _ in range(60):
        a, b = [word() for _ in range(r.randint(0, 12))], [word() for _ in range(r.randint(0, 15))]
        assert A.align_words(a, b) == plain_dp(a, b)


def test_anchor():
    ref = [f"word{i}x" for i in range(400)]
    page = ref[120:170]
    at, score = A.find_anchor(page, ref, 0)
    assert abs(at - 120) <= 180 and score > 0.1
    assert A.find_anchor(["zzz"] * 40, ref, 7)[0] == 7
    assert A.find_anchor(page, ref[:10], 3) == (3, -1.0)


@pytest.fixture(scope="module")
def edition():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(900)]
    pages = ["\n".join(" ".join(words[p + k : p + k + 6]) for k in range(0, 300, 6)) for p in range(0, 900, 300)]
    noisy = ["".join("e" if c == "a" and r.random() < 0.3 else c for c in p) for p in pages]
    return words, noisy


def test_pages_are_found_in_order(spark, edition):
    words, noisy = edition
    pages = spark.createDataFrame([("e", i, t) for i, t in enumerate(noisy)] + [("e", 9, None), ("f", 0, "lone text")], "ed string, page int, text string")
    refs = spark.createDataFrame([("e", " ".join(words))], "ed string, text string")
    got = A.align_pages(pages, refs, "ed", "page").collect()
    own = [r for r in got if r.ed == "e"]
    assert len(own) == 150
    right = sum(r.ref_line == " ".join(words[r.page * 300 + r.line * 6 :][:6]) for r in own)
    assert right > 140
    assert A.side_by_side(A.align_pages(pages, refs, "ed", "page")).first().side_by_side is not None


def test_stand_alone_punctuation(edition):
    words, noisy = edition
    ref = " ".join(w + (" —" if i % 5 == 0 else "") for i, w in enumerate(words))
    exact = list(A.align_edition(noisy, ref, corrected=True))
    drift = list(A.align_edition(noisy, ref))
    score = lambda rows: sum(a.split()[0][:1] == b.split()[0][:1] for _, _, a, b, *_ in rows if b)
    assert score(exact) > 130 > score(drift)


def test_candidates_equal_the_search(spark, edition):
    words, noisy = edition
    pages = spark.createDataFrame([("e", i, t) for i, t in enumerate(noisy)], "ed string, page int, text string")
    refs = spark.createDataFrame([("e", " ".join(words))], "ed string, text string")
    got = {r.page: (r.at, r.score) for r in A.anchor_candidates(pages, refs, "ed", "page").collect()}
    for i, t in enumerate(noisy):
        at, score = A.find_anchor(A.plain_words(t), words, 0, least=-1)
        assert got[i][0] == at and got[i][1] == pytest.approx(score)


def test_best_lines_and_running_words(spark):
    a = spark.createDataFrame([(1, "lo reis"), (2, "zzz"), (3, None)], "n int, text string")
    b = spark.createDataFrame([(1, "la regina"), (2, "lo rei"), (3, "lo rei")], "m int, text string")
    got = {r.n: (r.m, r.similarity) for r in A.line_best_match(a, b, "n", "m").collect()}
    assert got[1] == (2, SequenceMatcher(None, "lo reis", "lo rei").ratio()) and set(got) == {1, 2} and got[2][0] == 1
    p = spark.createDataFrame([("e", 1, "a b c"), ("e", 2, ""), ("e", 3, " d ")], "ed string, page int, text string")
    assert [(r.words, r.words_before) for r in A.words_before(p, "ed", "page").orderBy("page").collect()] == [(3, 0), (0, 3), (1, 3)]


def test_similarity_is_the_block_ratio():
    r = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(r.choice("abcde") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert A.similarity(a, b) == (1.0 if a == b else SequenceMatcher(None, a, b).ratio())
    assert A.similarity("ab" * 30, "ba" * 30) == SequenceMatcher(None, "ab" * 30, "ba" * 30).ratio()


def test_best_lines_are_those_of_all_conversations(spark, tmp_path):
    from scriptorium import catalog

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeéxy ") for _ in range(r.randint(0, 60)))
    turns = [(c, t, "user", None if (c, t) == (2, 1) else "\n".join(word() for _ in range(r.randint(1, 4)))) for c in range(6) for t in range(3)]
    refs = [(i, word()) for i in range(30)] + [(30, "ab" * 150), (31, "ab" * 150), (32, ""), (33, None)]
    spark.createDataFrame([*turns, (9, 0, "user", "ab" * 150), turns[0]], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(refs, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for c, t, _, text in [*turns, (9, 0, "user", "ab" * 150), turns[0]]:
        for k, x in enumerate([] if text is None else text.split("\n")):
            s, i = max((1.0 if x == y else SequenceMatcher(None, x, y).ratio(), -i) for i, y in refs if y is not None)
            want.append((c, t, k, x, -i, s))
    got = [(x.conv_id, x.turn, x.at, x.ocr_text, x.item_id, x.similarity) for x in catalog.QUERIES["line_best_match"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_word_pairs_are_compared_all_at_once(monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.choice([1, 3, 6, 12, 40])))
    def one_by_one(a, b):
        raise AssertionError("a pair of words was compared alone")

    monkeypatch.setattr(A, "similarity", one_by_one)
    for _ in range(20):
        a, b = [word() for _ in range(15)], [word() for _ in range(25)] + ["ab" * 150, "x" * 250]
        assert A.align_words([*a, "x" * 250], b) == plain_dp([*a, "x" * 250], b)


@pytest.mark.parametrize("letters, long", [("ab", 40), ("abcde ", 330), ("abcdefghijklmnop ", 420), ("aaaaab\0", 460), ("", 3)])
def test_many_block_ratios_at_once(letters, long):
    import numpy as np

    from scriptorium.functions.blocks import Blocks, block_ratios

    r = random.Random(11)
    text = lambda: "".join(r.choice(letters) for _ in range(r.randint(0, long) if letters else 0))
    a, b = [text() for _ in range(40)] + ["", "ab" * 150], [text() for _ in range(40)] + ["", "ab" * 150]
    of, to = np.repeat(np.arange(42), 42), np.tile(np.arange(42), 42)
    got = Blocks(b).ratios(a, of, to).tolist()
    assert got == [SequenceMatcher(None, a[i], b[j]).ratio() for i, j in zip(of, to, strict=True)]
    assert block_ratios([None, *a], ["x", *b]) == [None, *(1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True))]


def test_best_texts_of_many_lines_in_parts():
    r = random.Random(13)
    text = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(0, 260)))
    lines, refs = [text() for _ in range(30)], [text() for _ in range(25)]
    lines, refs = [*lines, refs[9], "", "ab" * 150], [*refs, refs[3], "ab" * 150]
    at, top = A.BlockIndex(refs, part=7).best(lines, pairs=20)
    for x, i, s in zip(lines, at, top, strict=True):
        want = max((1.0 if x == y else SequenceMatcher(None, x, y).ratio(), -k) for k, y in enumerate(refs))
        assert (s, -i) == want


def test_candidates_of_many_pages_need_no_rows_of_windows(spark):
    r = random.Random(17)
    text = lambda n: " ".join("".join(r.choice("abcé-7\n") for _ in range(r.randint(1, 5))) for _ in range(n))
    refs = {0: text(700), 1: text(25), 2: "", 3: text(300), 5: None}
    rows = [(e, i, text(r.choice([1, 3, 20, 60, 120]))) for e in (0, 1, 2, 3, 4, 5, None) for i in range(5)] + [(0, 9, None), (0, 8, "—")]
    got = A.anchor_candidates(spark.createDataFrame(rows, "ed long, page int, text string"), spark.createDataFrame(list(refs.items()), "ed long, text string"), "ed", "page")
    plan = got._jdf.queryExecution().toString()
    assert "char_ngrams" not in plan and "sequence(" not in plan.lower()
    want = {}
    for e, i, t in rows:
        w, ref = A.plain_words(t or ""), A.plain_words(refs.get(e) or "")
        if w:
            at, score = A.find_anchor(w, ref, 0, min(30, len(w)), least=-2)
            want[e, i] = (at if score >= 0 else 0, score)
    assert {(x.ed, x.page): (x.at, x.score) for x in got.collect()} == want
