import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, minhash_dedup
from tidemark.llm.minhash_dedup import DedupConfig, sketch_batch

BLANKS = " \t\n\v\f\r"


def shingles(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        lowered = lowered.replace(b, " ")
    words = [w for w in lowered.split(" ") if w]
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    label = {i: i for i, _ in rows}
    moved = True
    while moved:
        moved = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    return {i: (len(s), label[i]) for i, s in sets}


def corpus(seed, bases=4, copies=25):
    """Groups of near copies whose pairs lie on both sides of the limit."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(copies):
            own = [rng.choice(words) if rng.random() < 0.06 else w for w in base]
            rows.append((i, " ".join(own)))
            i += 1
    return rows + [(i + k, t) for k, t in enumerate(["", "one", "ONE", "one two", "\tone  two\n", rows[0][1].upper(), rows[3][1]])]


@pytest.mark.parametrize("words, block", [(2, 512), (2, 8), (5, 512)])
def test_components_against_all_pairs(documents, words, block):
    rows = corpus(words + block)
    got = minhash_dedup.near_duplicates(documents(*rows, extra=True), DedupConfig(words=words, block=block)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_shuffled_sets_and_unnamed_rows(documents):
    rows = [(5, "a b c d"), (None, "a b c d"), (None, "q r s t"), (7, "A B C D"), (7, "A B C D"), (8, None), (9, "")]
    got = minhash_dedup.near_duplicates(documents(*rows), DedupConfig(broadcast_ids=0)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (False, 5, 3, 5, True), (False, 7, 3, 5, False), (False, 7, 3, 5, False), (False, 8, 0, 8, True), (False, 9, 0, 9, True), (True, 0, 3, 0, True), (True, 0, 3, 5, False),
    ]
    assert minhash_dedup.near_duplicates(documents()).count() == 0


def test_one_of_each_group_stays(documents):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (4, None)]
    frame = documents(*rows, extra=True)
    kept = minhash_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert minhash_dedup.drop_near_duplicates(documents()).count() == 0


@pytest.mark.parametrize("broadcast_ids", [0, 500_000])
def test_rows_of_one_id_are_told_apart(documents, broadcast_ids):
    rows = [(5, "a b c d"), (5, "p q r s"), (5, "p q r s"), (6, "p q r s"), (3, "a b c d"), (None, "k l m n"), (None, "k l m n"), (None, "f g h"), (7, "f g h"), (8, None), (8, None), (None, ""), (9, "t u v w"), (9, "x y z")]
    rows += [(20, " ".join(f"w{k}" for k in range(40))), (20, " ".join(f"w{k}" for k in range(41))), (20, " ".join(f"v{k}" for k in range(40)))]
    config = DedupConfig(broadcast_ids=broadcast_ids)
    got = minhash_dedup.near_duplicates(documents(*rows), config).collect()
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got)
    assert found == sorted(
        [(5, 3, 3, False), (5, 3, 5, True), (5, 3, 5, True), (6, 3, 5, False), (3, 3, 3, True), (0, 3, 0, True), (0, 3, 0, True), (0, 2, 7, False), (7, 2, 7, True)]
        + [(8, 0, 8, True), (8, 0, 8, True), (0, 0, 0, True), (9, 3, 9, True), (9, 2, 9, True), (20, 39, 20, True), (20, 40, 20, True), (20, 39, 20, True)]
    )
    frame = documents(*rows, extra=True)
    kept = minhash_dedup.drop_near_duplicates(frame, config)
    assert kept.columns == frame.columns
    left = sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept.collect())
    assert left == sorted([(3, "a b"), (5, "p q"), (0, "k l"), (7, "f g"), (8, ""), (8, ""), (0, ""), (9, "t u"), (9, "x y"), (20, "w0 "), (20, "v0 ")])


def test_blocks_of_few_bytes_change_nothing(documents):
    rows = corpus(77)
    got = minhash_dedup.near_duplicates(documents(*rows), DedupConfig(block_bytes=2000, leader_rounds=1)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = a.copy()
    b[:50] = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    one, two, tiny = sketch_batch([a, b, a[:1]], 512)
    assert (tiny != np.iinfo(np.uint64).max).all()
    assert abs((one == two).mean() - 350 / 450) < 0.08


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strange potions under old stone bridges"


def smith_waterman(a, b, c):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (c.match if x == y else c.mismatch), h[i][j + 1] + c.gap, h[i + 1][j] + c.gap)
    return max(map(max, h))


def test_alignment_against_the_full_matrix():
    rng, c = random.Random(2), decontaminate.DecontaminationConfig()
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64), c)[0] == smith_waterman(a, b, c)


def test_copies_and_edited_copies_are_found(spark, documents):
    rng = random.Random(4)
    noise = lambda n: " ".join(f"n{rng.randint(0, 999)}" for _ in range(n))
    words = ITEM.split()
    edited = [w for k, w in enumerate(words) if k not in (4, 11)]
    edited[8] = "nine"
    rows = [(1, f"{noise(50)} {ITEM} {noise(50)}"), (2, f"{noise(9)}, {' '.join(edited).upper()}!"), (3, noise(80)), (4, " ".join(words[:6]) + noise(30)), (5, None), (6, ""), (None, ITEM), (1, ITEM)]
    tests = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (None, ITEM), (13, "")], "item_id long, text string")
    got = decontaminate.contaminated(documents(*rows, extra=True), tests).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 10), (1, 10), (2, 10)]
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == 1.0 and 0.6 < scores[2] < 1.0
    assert {r.doc_id: (r.word_start, r.word_end) for r in got} == {None: (0, 20), 1: (0, 20), 2: (9, 27)}
    kept = decontaminate.drop_contaminated(documents(*rows[:6], extra=True), tests)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(documents(), tests).count() == 0
    assert decontaminate.contaminated(documents(*rows), tests.limit(0)).count() == 0


def test_more_items_take_more_blocks(spark, documents):
    rng = random.Random(8)
    items = [(k, " ".join(f"i{rng.randint(0, 500)}" for _ in range(20))) for k in range(30)]
    docs = documents(*[(k, f"x y z {t} a b c") for k, t in items])
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, tests, decontaminate.DecontaminationConfig(block_words=200)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(30)]


def test_a_passage_that_many_documents_leak_is_still_found(spark, documents):
    rng = random.Random(9)
    noise = lambda: " ".join(f"n{rng.randint(0, 9999)}" for _ in range(30))
    docs = documents(*[(k, f"{noise()} {ITEM} {noise()}") for k in range(200)], *[(500 + k, noise()) for k in range(50)])
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(200))


def test_an_edited_version_that_many_documents_share_is_found(spark, documents):
    rng = random.Random(12)
    noise = lambda: " ".join(f"n{rng.randint(0, 9999)}" for _ in range(30))
    words = ITEM.split()
    one_left = [f"e{k}" if k in (3, 6, 9, 12, 14) else w for k, w in enumerate(words)]  # less than half of the 3-grams are left
    config = decontaminate.DecontaminationConfig()
    numbers = {w: k for k, w in enumerate({*words, *one_left})}
    assert smith_waterman([numbers[w] for w in words], [numbers[w] for w in one_left], config) >= config.threshold * config.match * len(words)
    held = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    assert 2 * sum(g in [tuple(one_left[k : k + 3]) for k in range(len(words) - 2)] for g in held) < len(held)
    docs = documents(*[(k, f"{noise()} {' '.join(one_left)} {noise()}") for k in range(1000)], *[(5000 + k, f"{noise()} {' '.join(words[:3])} {noise()}") for k in range(50)])
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))


def test_short_items_match_whole(spark, documents):
    rows = [(1, "He said: TOO short, indeed"), (2, "too long and short"), (3, "a one"), (4, "too"), (5, "short too short too short")]
    tests = spark.createDataFrame([(1, "too short"), (2, "One!"), (3, "too short"), (4, "a b c d e")], "item_id long, text string")
    got = decontaminate.contaminated(documents(*rows), tests).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.word_start, r.word_end) for r in got) == [(1, 1, 1.0, 2, 4), (1, 3, 1.0, 2, 4), (3, 2, 1.0, 1, 2), (5, 1, 1.0, 1, 3), (5, 3, 1.0, 1, 3)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(documents(*rows), tests).collect()) == [2, 4]


def test_rows_are_judged_by_themselves(spark, documents):
    rows = [(None, ITEM), (None, "clean"), (None, None), (1, "clean"), (1, f"x {ITEM}"), (1, "clean"), (2, ""), (3, "filler " * 60_000 + ITEM)]
    frame = documents(*rows, extra=True)
    kept = decontaminate.drop_contaminated(frame, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(0, ""), (0, "clean"), (1, "clean"), (1, "clean"), (2, "")]
    assert decontaminate.drop_contaminated(frame, spark.createDataFrame([], "item_id long, text string")).count() == 8
    assert decontaminate.drop_contaminated(documents(), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def full_matrix(a, b, c):
    """(best score, starts and ends of the alignments that have it)."""
    h = [[(0, {j}) for j in range(len(b) + 1)] for _ in range(len(a) + 1)]
    best, spans = 0, set()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            ways = [(h[i][j][0] + (c.match if x == y else c.mismatch), h[i][j][1]), (h[i][j + 1][0] + c.gap, h[i][j + 1][1]), (h[i + 1][j][0] + c.gap, h[i + 1][j][1]), (0, {j + 1})]
            top = max(w[0] for w in ways)
            h[i + 1][j + 1] = top, set().union(*(w[1] for w in ways if w[0] == top)) if top else {j + 1}
            if top > best:
                best, spans = top, set()
            if top == best and top:
                spans |= {(s, j + 1) for s in h[i + 1][j + 1][1]}
    return best, spans


def test_starts_against_the_full_matrix():
    rng, c = random.Random(3), decontaminate.DecontaminationConfig()
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 10))] for _ in range(2))
        score, end = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64), c)
        best, spans = full_matrix(a, b, c)
        assert score == best
        if best:
            assert (decontaminate.begin_of(np.array(a, np.uint64), np.array(b, np.uint64)[:end], c), end) in spans


def test_whole_operator_against_every_pair(spark, documents):
    rng, c = random.Random(21), decontaminate.DecontaminationConfig()
    items = [[f"i{rng.randint(0, 60)}" for _ in range(rng.randint(8, 25))] for _ in range(6)]
    rows = []
    for k in range(120):
        words = [f"n{rng.randint(0, 40)}" for _ in range(rng.randint(0, 30))]
        own = [w if rng.random() > k / 200 else f"i{rng.randint(0, 60)}" for w in rng.choice(items)]
        own = [w for w in own if rng.random() > 0.05]
        at = rng.randint(0, len(words))
        rows.append((k, " ".join(words[:at] + own + words[at:])))
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(*rows), tests).collect()}
    want = {}
    for i, text in rows:
        words = text.split()
        runs = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        for j, item in enumerate(items):
            share = smith_waterman(item, words, c) / (c.match * len(item))
            if share >= c.threshold and runs & {tuple(item[k : k + 3]) for k in range(len(item) - 2)}:
                want[i, j] = share
    assert got == want and 40 < len(want) < 120


@pytest.mark.parametrize("rare, spread", [(1, 1 << 20), (2, 1), (16, 1 << 20), (2, 40)])
def test_templates_against_every_pair(spark, documents, monkeypatch, rare, spread):
    """Items that share openings, closings and most words, some of them equal, against alignments of all pairs."""
    monkeypatch.setattr(decontaminate, "SPREAD", spread)
    rng, c = random.Random(rare), decontaminate.DecontaminationConfig(rare=rare)
    opening, closing = "read the following passage and answer".split(), "give a short answer below".split()
    items = [opening + [f"i{rng.randint(0, 40)}" for _ in range(rng.randint(3, 20))] + closing for _ in range(8)] + [opening + closing, opening + closing[:2] + opening]
    items += [items[0], items[8]]
    rows = []
    for k in range(90):
        words = [w if rng.random() < 0.85 else f"e{rng.randint(0, 9)}" for w in rng.choice(items)] if rng.random() < 0.7 else opening * rng.randint(1, 9)
        rows.append((k, " ".join([f"d{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))] + words + closing * rng.randint(0, 2))))
    config = decontaminate.parse(list(range(len(items))), [" ".join(i) for i in items], c)
    found = {}
    for row, item, score, start, end in decontaminate._finder(config, c)(pa.array([t for _, t in rows])):
        found[row, item] = max(found.get((row, item), 0), score)
        assert 0 <= start < end <= len(rows[row][1].split())
    numbers = {}
    number = lambda words: [numbers.setdefault(w, len(numbers)) for w in words]
    want = {}
    for k, text in rows:
        words = text.split()
        for i, item in enumerate(items):
            grams = {tuple(item[j : j + 3]) for j in range(len(item) - 2)}
            if any(tuple(words[j : j + 3]) in grams for j in range(len(words) - 2)):
                share = smith_waterman(number(item), number(words), c) / (c.match * len(item))
                if share >= c.threshold:
                    want[k, i] = share
    assert found == want


def test_templates_cost_no_memory_by_items():
    """Thousands of items with one opening, against a text that repeats it."""
    import tracemalloc

    opening = "please read the following question and choose the best of the answers"
    c = decontaminate.DecontaminationConfig()
    items = decontaminate.parse(list(range(3000)), [f"{opening} " + " ".join(f"w{k}x{j}" for j in range(12)) for k in range(3000)], c)
    text = " ".join([opening] * 2500 + [f"w7x{j}" for j in range(12)] + [opening])
    find = decontaminate._finder(items, c)
    tracemalloc.start()
    found = list(find(pa.array([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {f[1] for f in found} == {7} and max(f[2] for f in found) == 1.0 and peak < 100 << 20


def test_what_a_step_no_longer_reads_is_freed(spark, documents, monkeypatch):
    """Shuffle files go with the job that wrote a table, a run's tables with the last plan that reads them."""
    import glob

    from pyspark.sql import functions as F

    from tidemark.llm.storage import Scratch

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    held = lambda: {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}
    before = held()
    saved = Scratch(spark, "freed").save(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not held() - before and saved.count() == 7
    roots = []
    made = Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, *of: (made(self, *of), roots.append((of[1], self.root)))[0])
    words = [" ".join(f"w{(k * 7 + j) % 997}" for j in range(40)) for k in range(60)]
    frame = documents(*[(k, words[k // 2] + (" more" if k % 2 else "")) for k in range(60)])
    kept = minhash_dedup.drop_near_duplicates(frame)
    left = [t for name, root in roots if name.startswith("minhash") for t in glob.glob(f"{root.removeprefix('file://').removeprefix('file:')}/*")]
    assert len(left) == 1 and kept.count() == 30
