"""Training-data operators on small tables: odd rows, brute force, round trips."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwalk.llm import decontaminate, html_text, licenses, lm, media, packing, quality, substring_dedup, tool_calls, webp
from groundwalk.llm.components import components
from groundwalk.llm.near_dedup import estimate, near_duplicates, registers
from groundwalk.llm.queries import tokenizer_path
from groundwalk.llm.substring_dedup import FingerprintIndex, deduplicate
from groundwalk.llm.tokens import encoder
from groundwalk.llm.words import split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = tokenizer_path("word_bpe_49k.json")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def prose(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, odd texts."""
    rng = random.Random(1)
    texts = [prose(i, 40 + 7 * i) for i in range(20)]
    passage = prose(99, 30)
    rows = []
    for t in texts:
        rows.append(t)
        for edits in (0, 0, 1, 2, 4):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            rows.append(" ".join(w))
        rows.append(prose(rng.random(), 30) + "\n" + passage + "  " + prose(rng.random(), 10))
    rows += [None, "", " \t\n", "one", "One", "two words", "a b c d", "A  b\tc d", prose(7, 9000), "é ü É", "x" * 5000, "It's <|ENDOFTEXT|> (so) a.b... ,,", "ÀÉ İx ΑΣ."]
    return list(enumerate(rows))


# ---- words --------------------------------------------------------------------------------------------------


def test_words(corpus):
    texts = [t for _, t in corpus]
    got = split(pa.array(texts), lower=True)
    for d, t in enumerate(texts):
        own = [bytes(got.data[got.start[i] : got.end[i]]).decode() for i in range(got.first[d], got.first[d + 1])]
        assert own == words((t or "").translate(LOWER))
    names = {}
    for i, h in enumerate(got.hashes().tolist()):
        assert names.setdefault(bytes(got.data[got.start[i] : got.end[i]]), h) == h
    assert len(set(names.values())) == len(names)


# ---- near copies --------------------------------------------------------------------------------------------


def near_truth(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, corpus, k):
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(table(spark, corpus), k).collect()}
    assert got == near_truth(corpus, k, 80)


def test_near_duplicates_odd_tables(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    t = prose(5, 50)
    rows = near_duplicates(table(spark, [(3, t), (3, t), (1, t), (None, t), (None, None), (8, None)])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in rows) == [(-1, -1, True), (-1, -1, True), (1, 1, True), (3, 1, False), (3, 1, False), (8, 8, True)]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        common = int(2 * share / (1 + share) * 2000)
        a, b = base[:2000], np.concatenate([base[:common], base[2000 : 4000 - common]])
        regs = registers([np.unique(a), np.unique(b)])
        truth = common / (4000 - common)
        assert abs(float(estimate((regs[0] == regs[1]).mean(), np.array(2000), np.array(2000))) - truth) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 100), (5, 5), (None, 3)]
    got = {x.doc_id: x.component_id for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 100: 7, 7: 7}


# ---- repeated passages --------------------------------------------------------------------------------------


def substring_truth(rows, window=13):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def removed(df):
    return {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in df.collect()}


@pytest.mark.parametrize("window", [13, 3])
def test_substrings(spark, corpus, window):
    rows = corpus + [(1000 + i, prose(99, 12 + i) + " end") for i in range(4)]
    assert removed(FingerprintIndex(window).add(table(spark, rows), keep=False)) == substring_truth(rows, window)
    assert removed(deduplicate(table(spark, rows), window)) == substring_truth(rows, window)


def test_substrings_by_batches(spark, corpus):
    index, got = FingerprintIndex(fan_in=1), {}
    for lo, hi in ((0, 50), (50, 51), (51, 120), (120, 1000)):
        got |= removed(index.add(table(spark, [r for r in corpus if lo <= r[0] < hi])))
    assert got == substring_truth(corpus)
    assert len(index.anchors) == len(index.windows) == 1
    with pytest.raises(ValueError, match="rise"):
        index.add(table(spark, [(4, "x")]))


def test_substrings_hot_passage(spark, monkeypatch):
    """A passage in half of all documents, in tasks that forget what they told the index."""
    monkeypatch.setattr(substring_dedup, "TOLD", 4)
    passage = prose(77, 60)
    rows = [(i, f"{prose(i, 20 + i % 50)} {passage if i % 2 else ''} {prose(-i, 15)}") for i in range(700)]
    assert removed(deduplicate(table(spark, rows).repartition(5))) == substring_truth(rows)


def files(df):
    return set(df.inputFiles())


def test_a_batch_reads_runs_and_the_sheets_that_it_meets(spark):
    """Of three batches in the index, a fourth that repeats the second reads no text of the others."""
    index = FingerprintIndex(fan_in=10)
    texts = [[(100 * b + i, prose(1000 * b + i, 60, size=10**6)) for i in range(20)] for b in range(3)]
    for own in texts:
        index.add(table(spark, own)).count()
    fourth = [(900 + i, texts[1][i][1]) for i in range(5)]
    later = index.add(table(spark, fourth))
    assert removed(later) == {i: x for i, x in substring_truth(sum(texts, []) + fourth).items() if i >= 900}
    asked = index.asked
    assert {r.sheet >> 48 for r in asked.collect()} == {1, 3}
    for kind in (index.anchors, index.windows):
        plan = kind[0].hint("merge").join(kind[1], kind[0].columns[0])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # runs meet in their buckets


def test_substrings_odd_tables(spark):
    assert FingerprintIndex().add(table(spark, []), keep=False).count() == 0
    t = prose(3, 20)
    rows = FingerprintIndex().add(table(spark, [(5, t), (5, t), (None, t), (9, t), (10, None)]), keep=False).collect()
    assert sorted((x.doc_id or -1, x.n_words, x.n_removed) for x in rows) == [(-1, 20, 0), (5, 20, 0), (5, 20, 0), (9, 20, 20), (10, 0, 0)]
    assert [x.kept for x in rows if x.doc_id == 9] == [""]


# ---- decontamination ----------------------------------------------------------------------------------------


def leaks_truth(docs, items):
    out = {}
    for d, t in docs:
        w = words((t or "").translate(LOWER))
        for item, text in items:
            b = words((text or "").translate(LOWER))
            if not b:
                continue
            k = min(5, len(b))
            own = Counter(tuple(b[i : i + k]) for i in range(len(b) - k + 1))
            best = 0.0
            for s in range(max(1, len(w) - len(b) + 1)):
                win = w[s : s + len(b)]
                c = Counter(tuple(win[i : i + k]) for i in range(len(win) - k + 1))
                if c and (both := sum((c & own).values())):
                    best = max(best, both / (sum(c.values()) + sum(own.values()) - both))
            if best >= 0.8:
                out[d, item] = round(best, 6)
    return out


def test_decontamination(spark):
    item, long_item = prose(1, 30), prose(2, 60)
    near = long_item.split()
    near[2] = "changed"
    docs = [(1, prose(3, 50) + " " + item.upper() + " " + prose(4, 20)), (2, item), (3, "start " + " ".join(near) + " stop"), (4, prose(5, 100)), (5, None), (6, ""), (7, " ".join(item.split()[:28])), (8, "x yes no maybe z"), (9, item + " gap " + item)]
    items = [(0, item), (1, long_item), (2, "yes no maybe"), (3, None), (4, " "), (1, long_item)]
    found = decontaminate.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.similarity for x in found} == leaks_truth(docs, items)
    assert {x.doc_id: x.start for x in found if x.doc_id in (1, 9)} == {1: 50, 9: 0}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(table(spark, docs), none).count() == 0
    assert decontaminate.contamination(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    """The same leaks if the benchmark's shingles are taken in many blocks; hot and repeated shingles."""
    items = [(i, prose(50 + i, 25 + i)) for i in range(6)] + [(9, "to be or not " * 12), (10, "one two three")]
    docs = [(i, prose(i, 40) + " " + items[i % 8][1] + " " + prose(-i, 9)) for i in range(16)] + [(99, "to be or not " * 11 + "now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    truth = leaks_truth(docs, items)
    for bound in (decontaminate.BROADCAST_SHINGLES, 40):
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", bound)
        found = decontaminate.contamination(table(spark, docs), bench).collect()
        assert {(x.doc_id, x.item_id): x.similarity for x in found} == truth
    assert len(truth) == 17


# ---- classifier ---------------------------------------------------------------------------------------------


def test_classifier(spark):
    good = [(i, prose(i, 60)) for i in range(200)]
    bad = [(i, " ".join(f"w{(i * 7 + j) % 400}!!" for j in range(60)).upper()) for i in range(200, 400)]
    labels = spark.createDataFrame([(i, int(i < 200), None) for i in range(400)] + [(None, 1, 1), (3, None, None), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, good + bad + [(500, None), (501, ""), (None, prose(1, 10)), (502, prose(9, 5000))])
    rows = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 404 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    kept_out = [x for x in rows if x.doc_id is not None and x.doc_id < 400 and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert sum(x.predicted == int(x.doc_id < 200) for x in kept_out) >= 0.95 * len(kept_out)
    one_sided = quality.fit(["a", "b"], [1, 1])
    assert 0.5 < one_sided.scores(pa.array(["c", None]))[0] < 1
    assert len(quality.fit([], []).scores(pa.array(["c"]))) == 1


def test_scores_keep_the_share_of_labels(spark, monkeypatch):
    """85 of 100 rows are good and texts say little: scores have that mean, however few of a class are sampled."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("fine" if i % 100 < 85 else "poor", "w1", "w2", "w3", "w4", "w5")) if rng.random() < 0.1 else f"w{rng.randrange(40)}" for _ in range(12))) for i in range(3000)]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, int(i % 100 < 85)) for i, _ in rows], "doc_id long, quality int")
    for sample in (10_000, 200):
        scores = [x.score for x in quality.classify(docs, quality.train(docs, labels, sample=sample)).collect()]
        assert abs(sum(scores) / len(scores) - 0.85) < 0.05, sample


def test_classifier_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = table(spark, [(1, "a b"), (1, "a b"), (1, "c"), (None, None)])
    rows = quality.classify(docs, quality.train(docs, none)).collect()
    assert [x.score for x in rows] == [0.5] * 4
    both = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "doc_id long, quality int")
    scores = [x.score for x in quality.classify(docs, quality.train(docs, both)).collect()]
    assert scores[0] == scores[1] and quality.classify(docs.limit(0), quality.train(docs, both)).count() == 0
    assert quality.accepted(docs, quality.train(docs, none)).columns == docs.columns


# ---- packing ------------------------------------------------------------------------------------------------


def check_packing(pieces, texts, window):
    encode = encoder(TOKENIZER)
    by_doc, by_sequence = {}, {}
    for x in pieces:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
    assert sorted(by_doc) == sorted(texts)
    for d, own in by_doc.items():
        ids = np.append(encode.ids([(texts[d] or "").encode()])[0].astype("<u4"), np.uint32(packing.END)).astype("<u4")
        at = 0
        for x in sorted(own, key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at and x.length > 0
            at += x.length
        assert at <= window and at & (at - 1) == 0


def test_packing(spark, corpus):
    texts = dict(corpus)
    check_packing(packing.pack(table(spark, corpus), TOKENIZER, window=256, shard_ids=3_000, part_ids=20_000).collect(), texts, 256)
    check_packing(packing.pack(table(spark, corpus), TOKENIZER).collect(), texts, 4096)
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0
    assert packing.pack(table(spark, [(1, "a"), (1, "a"), (None, None)]), TOKENIZER).count() == 3
    with pytest.raises(ValueError):
        packing.pack(table(spark, []), TOKENIZER, window=100)


def coded(texts):
    got = encoder(TOKENIZER).code(pa.array(texts))
    return got.ids, np.concatenate([[0], got.ends])


def facts_of(ids, edge):
    return packing.Statistics(np.bincount(packing.postings(ids, edge)[1], minlength=packing.TERMS), len(edge) - 1, len(ids) / (len(edge) - 1))


def bm25(texts):
    """Scores of all pairs of documents, from the terms of the one in the other."""
    own = [Counter(x.tolist()) for x in encoder(TOKENIZER).ids([t.encode() for t in texts])]
    mean = sum(x.total() for x in own) / len(own)
    df = Counter(w for x in own for w in x)
    idf = {w: np.log1p((len(own) - n + 0.5) / (n + 0.5)) if n > 1 else 0 for w, n in df.items()}
    norm = [1.2 * (0.25 + 0.75 * x.total() / mean) for x in own]
    return np.array([[sum(idf[w] * d[w] * 2.2 / (d[w] + n) for w in q if w in d) for d, n in zip(own, norm, strict=True)] for q in own])


def test_neighbours_are_those_of_brute_force():
    """Ranked by all terms of the seed, with the statistics of more documents than the shard has."""
    texts = [prose(i, 30 + 5 * i, size=90) for i in range(100)]
    truth, (ids, edge) = bm25(texts), coded(texts)
    facts = facts_of(ids, edge)
    for docs in (100, 37):
        index = packing.Index(ids[: edge[docs]], edge[: docs + 1], facts)
        for seed in (0, 20, docs - 1):
            free = np.arange(docs) != seed
            order = index.neighbours(index.own[seed], free)
            assert len(order) == ((truth[seed, :docs] > 0) & free).sum()
            assert (np.diff(truth[seed][order]) < 1e-3).all()


def test_windows_go_on_with_the_best_unused(spark):
    texts = [prose(1000 + i, 40 + i % 9) for i in range(60)]
    truth = bm25(texts)
    pieces = packing.pack(table(spark, list(enumerate(texts))), TOKENIZER, window=1024).collect()
    sequences, used, compared = {}, set(), 0
    for x in sorted(pieces, key=lambda x: (x.sequence_id, x.offset)):
        sequences.setdefault(x.sequence_id, []).append(x)
    for own in sequences.values():
        seed = own[0].doc_id
        used.add(seed)
        for x in own[1:] if sum(x.length for x in own) == 1024 else ():
            free = [d for d in range(60) if d not in used]
            assert truth[seed][x.doc_id] > truth[seed][free].max() - 1e-3
            used.add(x.doc_id)
            compared += 1
    assert compared > 20


def test_lexical_neighbours_meet_in_a_shard(spark):
    """Families of like documents, dealt at random over the table: in small shards, windows still hold families."""
    rng = random.Random(3)
    topics = [[f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{t}x{j}" for j in range(25)] for t in range(40)]
    rows = [(i, " ".join(rng.choice(topics[i % 40]) if rng.random() < 0.7 else f"w{rng.randrange(60)}" for _ in range(50))) for i in range(400)]
    order = [i for i, _ in rows]
    rng.shuffle(order)
    pieces = packing.pack(table(spark, [rows[i] for i in order]), TOKENIZER, window=1024, shard_ids=8_000, part_ids=20_000).collect()
    check_packing(pieces, dict(rows), 1024)
    sequences = {}
    for x in pieces:
        sequences.setdefault(x.sequence_id, []).append(x.doc_id % 40)
    met = sum(max(Counter(own).values()) for own in sequences.values() if len(own) > 1) / sum(len(own) for own in sequences.values() if len(own) > 1)
    assert len({x.sequence_id >> 40 for x in pieces}) > 2 and met > 0.5  # at random it is under 0.3


def test_packing_hot_ids_and_long_documents(spark):
    copies = [(7, prose(1, 60))] * 300 + [(None, "same text")] * 200
    pieces = packing.pack(table(spark, copies), TOKENIZER, window=256, shard_ids=2_000, part_ids=4_000).collect()
    assert sum(x.length for x in pieces if x.doc_id == 7 and x.start == 0) > 0 and len({x.sequence_id >> 40 for x in pieces}) > 3
    own = sum(x.length for x in pieces if x.doc_id == 7)
    assert own == 300 * pieces[[x.doc_id for x in pieces].index(7)].doc_tokens
    texts = dict([(1, prose(2, 30_000)), (2, prose(3, 30)), (3, None)])
    check_packing(packing.pack(table(spark, list(texts.items())), TOKENIZER, shard_ids=1_000).collect(), texts, 4096)


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["It's 3.14, isn't it?!", "ΑΣ ΑΣΒ x", "<|endoftext|> a<|ENDOFTEXT|>b", "日本語 テキスト", "end... (x) 'y' \"z\".", "é.", " a\u0085b", ""]
    for t, own in zip(texts, encoder(TOKENIZER).ids([t.encode() for t in texts]), strict=True):
        assert own.tolist() == plain.encode(t, add_special_tokens=False).ids


# ---- language model -----------------------------------------------------------------------------------------


def test_scores(spark, corpus):
    rows = [(i, t) for i, t in corpus]
    got = {x.doc_id: x for x in lm.score(table(spark, rows), TOKENIZER, warm=50).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count, total = Counter(), 0
    for i, t in rows:
        if not held[i]:
            own = [*words((t or "").translate(LOWER)), None]
            count.update(own)
            total += len(own)
    for i, t in rows:
        own = [*words((t or "").translate(LOWER)), None]
        base = sum(np.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in own)
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(own), sum(count[w] > 0 for w in own), total)
        assert abs(x.base_score - base) < 1e-6 * abs(base) and x.score < 0
    assert lm.score(table(spark, []), TOKENIZER).count() == 0
    assert lm.score(spark.createDataFrame([(0, None), (0, None), (None, "a")], "doc_id long, text string"), TOKENIZER).count() == 3


def test_scores_odd_tables(spark):
    """Equal texts have equal scores whatever their ids; a text of many windows; names of results as columns."""
    rows = [(i, prose(i % 5, 30), i) for i in range(1, 40)] + [(50, prose(9, 20_000), 0), (51, prose(9, 20_000), 0), (51, prose(9, 20_000), 0), (52, "", 0), (53, None, 0)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), TOKENIZER, warm=20).collect()
    assert len(got) == len(rows) and got[0].train_tokens > 0
    score = {}
    for x in got:
        score.setdefault((x.n_tokens, rows[x.doc_id - 1][1] if x.doc_id < 40 else x.n_tokens), set()).add(x.score)
    assert all(max(s) - min(s) < 1e-4 * abs(min(s)) for s in score.values())
    assert sorted(x.n_tokens for x in got if x.doc_id >= 50) == [1, 1, 20_001, 20_001, 20_001]


def test_scores_by_a_plain_version(spark, corpus, monkeypatch):
    """Scores from the model's parts, a word at a time; the same whether words meet their counts in a task or in a join."""
    monkeypatch.setattr(lm, "STEPS", 30)
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.setdefault("model", train(*a, **k)))
    monkeypatch.setattr(lm, "refine", lambda m, rows: m)
    corpus_counts = lm.corpus_counts
    monkeypatch.setattr(lm, "corpus_counts", lambda *a: kept.setdefault("counts", corpus_counts(*a)))
    rows = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm.score(rows, TOKENIZER, warm=20).collect()}
    counts, model = kept["counts"][1], kept["model"]
    seen = Counter(w for i, t in corpus if zlib.crc32(str(i).encode()) % 10 for w in words((t or "").translate(LOWER)))
    total, discount = seen.total(), float(counts.discounts[0])
    freed = discount * len(seen) / total
    for i, t in corpus:
        own = words((t or "").translate(LOWER))
        each = [encoder(TOKENIZER).ids([w.encode()])[0] for w in own]
        scores, expect = lm.token_scores(model, [np.concatenate([*each, np.zeros(0, np.uint16)])]), math.log10(counts.ended)
        for w, ids in zip(own, each, strict=True):
            stop = (counts.lasts[ids] + 0.01) / (counts.subwords[ids] + 0.02)
            spelled = 10.0 ** (scores[: len(ids)].sum() + np.log10(1 - stop[:-1]).sum() + np.log10(stop[-1])) if len(ids) else 10**lm.BLANK
            scores = scores[len(ids) :]
            p = 0.95 * max(seen[w] - discount, 0) / total + (0.05 + 0.95 * freed) * spelled
            expect += math.log10(1 - counts.ended) + math.log10(p)
        assert abs(got[i] - expect) < 1e-4 * abs(expect), i
    monkeypatch.setattr(lm, "FREQUENT", 0.004)
    kept.pop("counts")
    joined = {x.doc_id: x.score for x in lm.score(rows, TOKENIZER, warm=20).collect()}
    assert 0 < len(kept["counts"][1].hashes) < len(seen) and all(abs(joined[i] - got[i]) < 1e-4 * abs(got[i]) for i in got)


def test_mass_is_one(spark, corpus):
    """Of words known and spelled, in all and in a language; of a spelling's first subword, ended or going on."""
    coded = spark.createDataFrame([(t or "", i % 3) for i, t in corpus], "text string, z int").withColumn("doc_id", F.lit(1).cast("long")).withColumn("row_key", F.lit(1).cast("long")).withColumn("learned", F.lit(True))
    rows, counts = lm.corpus_counts(coded.select("doc_id", "row_key", "learned", "z", "text").mapInArrow(lm._code(TOKENIZER), lm._CODED), 2)
    table = rows.toPandas()
    for column in (0, 1, 2):
        for trust in (0.0, 0.7, 1.0):
            n = len(table)
            known = trust * counts.own(table[f"c{column}"].to_numpy(), np.full(n, column)) + (1 - trust) * counts.own(table["c0"].to_numpy(), np.zeros(n, int))
            assert abs((1 - lm.SHARE) * known.sum() + counts.spelled(np.array([column]), np.array([trust]))[0] - 1) < 1e-9
    model = lm.train([np.arange(1, 70, dtype=np.uint16)], counts.subwords, steps=5, batch=8)
    every = np.arange(lm.VOCABULARY)
    first = np.concatenate([lm._logits(model, np.zeros((len(p), lm.WIDTH), np.float32) + 0.3, p)[1] for p in np.split(every, 13)]).astype(float) / math.log(10)
    ended = counts.spelling(every, np.ones(lm.VOCABULARY, int), first)
    twice = counts.spelling(np.repeat(every, 2), np.full(lm.VOCABULARY, 2), np.stack([first, np.zeros(lm.VOCABULARY)], 1).ravel())
    stop = (counts.lasts + 0.01) / (counts.subwords + 0.02)
    assert abs((10**ended).sum() + (10 ** (twice - np.log10(stop))).sum() - 1) < 1e-3


def test_each_id_is_scored_once():
    count = np.bincount([5, 5, 9], minlength=lm.VOCABULARY)
    model = lm.train([np.arange(1, 70, dtype=np.uint16)], count, steps=5, batch=8)
    texts = [np.array([], np.uint16), np.arange(1, 40, dtype=np.uint16), np.array([7], np.uint16)]
    assert len(lm.token_scores(model, texts)) == 40
    alone = [lm.token_scores(model, [t]) for t in texts]
    assert np.allclose(np.concatenate(alone), lm.token_scores(model, texts, together=2), atol=1e-5)
    h = np.zeros((lm.VOCABULARY, lm.WIDTH), np.float32) + 0.3
    total = np.exp(lm._logits(model, h, np.arange(lm.VOCABULARY))[1].astype(float)).sum()
    assert abs(total - 1) < 1e-3


def test_refining_averages_what_tasks_changed(spark):
    rng = np.random.default_rng(1)
    texts = [np.tile(rng.integers(1, 200, 9), 900).astype(np.uint16) for _ in range(8)]
    model = lm.train(texts[:1], np.bincount(texts[0], minlength=lm.VOCABULARY), steps=20)
    before = lm.token_scores(model, texts).sum()
    untouched = model.embed[300 : lm.START].copy()
    rows = spark.createDataFrame([(t.tobytes(),) for t in texts], "ids binary").repartition(3)
    assert lm.token_scores(lm.refine(model, rows), texts).sum() > before and (model.embed[300 : lm.START] == untouched).all()
    assert lm.refine(model, rows.limit(0)) is model


def test_every_training_document_trains_the_attention(spark, monkeypatch):
    """All ids of all training documents, each once, reach the optimizer; tasks count by the ids they met."""
    monkeypatch.setattr(lm, "STEPS", 5)
    rows = [(i, prose(i % 7, 20 + i % 50)) for i in range(1, 200)]
    trained, refine = [], lm.refine
    monkeypatch.setattr(lm, "refine", lambda m, coded: trained.extend(x.ids for x in coded.select("ids").collect()) or refine(m, coded))
    assert lm.score(table(spark, rows), TOKENIZER, warm=20).count() == len(rows)
    ids = encoder(TOKENIZER).ids([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10])
    assert sorted(trained) == sorted(x.tobytes() for x in ids)

    monkeypatch.setattr(lm, "HELD", 1500)
    monkeypatch.setattr(lm, "RUNS", 3)
    met, pairs, step = Counter(), Counter(), lm.Descent.step

    def counted(self, source, target, first, pace):
        met.update(target[target >= 0].tolist())
        pairs.update(zip(source[:, 1:][target >= 0].tolist(), target[target >= 0].tolist(), strict=True))
        inside = ~first & (target[:, :, 0] >= 0)
        assert (source[:, :-1, 1:][inside] >= 0).all() and (source[:, 1:, 0][first & (target[:, :, 0] >= 0)] == lm.START).all()
        step(self, source, target, first, pace)

    monkeypatch.setattr(lm.Descent, "step", counted)
    count = np.bincount(np.concatenate(ids), minlength=lm.VOCABULARY)
    model = lm.train(ids[:1], count, steps=3, batch=4)
    met.clear()
    pairs.clear()
    before, untrained = lm.token_scores(model, ids).sum(), model.embed.copy()
    texts = [*ids[:5], np.zeros(0, np.uint16), *ids[5:]]
    assert lm.one_pass(model, iter(texts)) == sum(met.values()) == sum(map(len, ids))
    assert met == Counter(np.concatenate(ids).tolist())
    assert pairs == Counter(p for t in ids for p in zip([lm.START, *t[:-1].tolist()], t.tolist(), strict=True))
    assert lm.token_scores(model, ids).sum() > before and (model.embed != untrained).any(axis=1)[np.unique(np.concatenate([t[:-1] for t in ids]))].all()
    assert lm.one_pass(model, iter([np.zeros(0, np.uint16)])) == 0


def test_gradients():
    """A step's changes of the parameters go down the slope that differences of the loss have."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 50, 70).astype(np.uint16)]
    source, target, first, _ = lm.blocks_of(texts)
    model = lm.train(texts, np.bincount(texts[0], minlength=lm.VOCABULARY), steps=20, batch=8)
    loss = lambda: -lm.token_scores(model, texts).sum() * math.log(10) / 70
    runs = (np.concatenate([np.zeros((1, lm.BLOCK), np.int32), source])[None], target[None], first[None])
    descent = lm.Descent(model)
    descent.step(*runs, 0.0)
    for p, (mean, _) in zip(model.parameters(), descent.moment, strict=True):
        at = np.unravel_index(np.abs(mean).argmax(), mean.shape)
        was, slope = p[at], mean[at] / 0.1
        p[at] = was + np.float32(0.01)
        up = loss()
        p[at] = was - np.float32(0.01)
        assert abs((up - loss()) / 0.02 - slope) < 0.03 * abs(slope) + 1e-4
        p[at] = was


def test_a_step_uses_its_arrays_again(monkeypatch):
    """Fresh arrays for every step's outputs and weights cost page faults and cache; a step in parts is the same step."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 3000, 4000).astype(np.uint16), rng.integers(1, 3000, 37).astype(np.uint16)]
    count = np.bincount(np.concatenate(texts), minlength=lm.VOCABULARY)
    source, target, first, _ = lm.blocks_of(texts)
    source = np.concatenate([np.zeros((1, lm.BLOCK), np.int32), source])
    runs = len(target) // lm.RUN
    step = (source[np.arange(runs)[:, None] * lm.RUN + np.arange(lm.RUN + 1)], target[: runs * lm.RUN].reshape(runs, lm.RUN, -1), first[: runs * lm.RUN].reshape(runs, -1), 0.01)
    whole = lm.new_model(count)
    descent = lm.Descent(whole)
    descent.step(*step)
    tracemalloc.start()
    descent.step(*step)
    assert tracemalloc.get_traced_memory()[1] < 400 * step[1].size  # outputs alone have 256 bytes a token
    tracemalloc.stop()
    monkeypatch.setattr(lm, "NEAR", 300)
    parts = lm.new_model(count)
    descent = lm.Descent(parts)
    descent.step(*step)
    descent.step(*step)
    for p, q in zip([*whole.parameters(), whole.embed], [*parts.parameters(), parts.embed], strict=True):
        assert np.allclose(p, q, atol=1e-3)


def test_languages_by_a_plain_version():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, (40, 4))
    counts[:, 0] = counts[:, 1:].sum(axis=1)
    k = lm.Counts(counts.sum(axis=0).astype(float), (counts > 0).sum(axis=0).astype(float), np.full(4, 0.5), 9, np.arange(40, dtype=np.uint64), counts, np.zeros(1), np.zeros(1))
    place, known, first = rng.integers(0, 40, 60), rng.random(60) < 0.8, np.array([0, 0, 25, 26, 60])
    for _ in range(2):
        column, trust = k.languages(place, known, first)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            for i in range(a, b):
                p = (k.totals[1:] + 1) / (k.totals[1:].sum() + 1)
                for j in range(a, i):
                    p = p * ((counts[place[j], 1:] + 0.05) / (k.totals[1:] + 1) if known[j] else 1)
                assert column[i] == p.argmax() + 1 and abs(trust[i] - lm.TRUST * p.max() / p.sum()) < 1e-5
    assert [len(x) for x in k.languages(place[:0], known[:0], np.zeros(3, int))] == [0, 0]


def test_later_ids_do_not_matter():
    count = np.bincount([5], minlength=lm.VOCABULARY)
    model = lm.train([np.arange(1, 90, dtype=np.uint16)], count, steps=5, batch=8)
    a = np.arange(1, 60, dtype=np.uint16)
    b = a.copy()
    b[40:] = 11
    x, y = lm.token_scores(model, [a]), lm.token_scores(model, [b])
    assert np.allclose(x[:40], y[:40], atol=1e-5) and not np.allclose(x[40:], y[40:])


# ---- WebP ---------------------------------------------------------------------------------------------------


def same(pixels, **options):
    got = webp.decode([webp.encode(pixels, **options)])[0]
    assert got.shape == pixels.shape and (got == pixels).all(), options


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (7, 5), (20, 33)])
def test_webp_round_trips(shape):
    rng = np.random.default_rng(4)
    h, w = shape
    pixels = rng.integers(0, 2**32, shape, dtype=np.uint32)
    same(pixels)
    same(pixels, cache=6)
    same(pixels, transforms=(("green",),))
    same(pixels, groups=(3, rng.integers(0, 4, (-(-h >> 3), -(-w >> 3)))), cache=3)
    for mode in range(14):
        same(pixels, transforms=(("predictor", 2, np.full((-(-h >> 2), -(-w >> 2)), mode << 8, np.uint32)),))
    factors = rng.integers(0, 2**24, (-(-h >> 3), -(-w >> 3)), dtype=np.uint32) | np.uint32(0xFF000000)
    same(pixels, transforms=(("cross", 3, factors), ("green",)))
    for colors in (1, 2, 3, 4, 16, 17, 200):
        few = rng.choice(rng.integers(0, 2**32, colors, dtype=np.uint32), shape)
        same(few, transforms=(("palette",),))
        same(few, cache=4)


def test_webp_repeats_and_batches():
    rng = np.random.default_rng(5)
    tiles = [np.tile(rng.integers(0, 2**32, n, dtype=np.uint32), 40).reshape(-1, n) for n in (3, 17, 50)]
    streams = [webp.encode(t) for t in tiles]
    assert len(streams[0]) < 200
    assert all((a == b).all() for a, b in zip(webp.decode(streams), tiles, strict=True))
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)]


def bits(*numbers):
    value = size = 0
    for n, width in numbers:
        value |= n << size
        size += width
    return value.to_bytes(-(-size // 8) + 8, "little")


def test_webp_by_hand():
    """A 4 x 1 picture with a near back-reference: one green literal, then a copy of length 3 by distance code 2 (left)."""
    one = lambda s: ((1, 1), (0, 1), (1, 1), (s, 8))  # noqa: E731  a code of one symbol
    header = ((0x2F, 8), (3, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1))
    # Green code: symbols 77 and 258 (length 3), one bit each: lengths by a code of 0, 1 and the zero runs 18.
    order = {s: i for i, s in enumerate(webp.LENGTH_ORDER)}
    own = {18: 1, 1: 2, 0: 2}
    table = [(own.get(s, 0), 3) for s in webp.LENGTH_ORDER[: max(order[s] for s in own) + 1]]
    codes = {18: (0, 1), 0: (1, 2), 1: (3, 2)}
    green = ((0, 1), (len(table) - 4, 4), *table, (0, 1), codes[18], (77 - 11, 7), codes[1], codes[18], (138 - 11, 7), codes[18], (258 - 78 - 138 - 11, 7), codes[1], codes[18], (280 - 259 - 11, 7))
    stream = bits(*header, *green, *one(1), *one(2), *one(255), (1, 1), (0, 1), (0, 1), (1, 1), (0, 1), (1, 1))
    assert (webp.decode([stream])[0] == np.uint32(0xFF014D02)).all()


def test_webp_broken():
    stream = webp.encode(np.arange(4096, dtype=np.uint32).reshape(64, 64))
    for bad in (b"", b"\x2f", b"\0" + stream[1:], stream[:40], stream[: len(stream) // 2]):
        with pytest.raises(ValueError):
            webp.decode([bad])
    with pytest.raises(ValueError):
        webp.streams_of(b"GIF89a")
    with pytest.raises(ValueError):
        webp.samples_to_file(b"abc")


def test_media(spark, corpus):
    stored = media.store(table(spark, corpus))
    rows = {x.doc_id: x for x in media.digests(stored).collect()}
    for i, t in corpus:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        x = rows[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    files = {x.doc_id: bytes(x.media) for x in stored.collect()}
    assert all(rows[i].media_sha256 == hashlib.sha256(files[i]).hexdigest() and rows[i].media_bytes == len(files[i]) for i, _ in corpus)
    pictures = media.read(stored.where("doc_id = 0")).first()
    assert pictures.widths == [64] and len(pictures.argb) == 4 * rows[0].payload_bytes
    assert media.digests(media.store(table(spark, []))).count() == 0


def test_media_odd_tables(spark):
    """Rows that repeat, null ids, other columns with names of the results, and a text of many pictures."""
    long = "".join(chr(32 + i * i % 90) for i in range(70_000))
    rows = [(1, "a", "x"), (1, "a", "y"), (None, "a", None), (None, None, "z"), (2, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string").withColumn("n_bytes", F.lit(-1))
    got = media.digests(media.store(docs)).collect()
    assert sorted((x.doc_id or 0, x.n_bytes) for x in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 70_000)]
    assert len({(x.payload_sha256, x.media_sha256, x.feature) for x in got}) == 3
    x = next(x for x in got if x.doc_id == 2)
    payload = long.encode() + b"\0" * (-len(long) % 64)
    count = np.bincount(np.frombuffer(payload, np.uint8))
    share = count[count > 0] / len(payload)
    fields = dict(f.split("=") for f in x.feature.split(";"))
    assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and int(fields["distinct"]) == len(share) and int(fields["pictures"]) == -(-len(payload) // 4096)
    assert abs(float(fields["entropy"]) + (share * np.log2(share)).sum()) < 1e-6 and abs(float(fields["mean"]) - np.frombuffer(payload, np.uint8).mean()) < 1e-6


# ---- licenses -----------------------------------------------------------------------------------------------


def test_licenses(spark):
    filler = prose(1, 50)
    docs = [(i, f"{filler}\n{text}\n{filler}") for i, text in enumerate(licenses.TEMPLATES.values())]
    header = licenses.TEMPLATES["Apache-2.0-header"].split()
    header[20] = "OTHER"
    docs += [(50, None), (51, ""), (52, prose(3, 300)), (53, " ".join(header)), (54, "Released under the"), (None, "Released UNDER the MIT license!")]
    found = licenses.scan(table(spark, docs)).collect()
    hits = {(x.doc_id, x.license_id) for x in found}
    assert {(i, n) for i, n in enumerate(licenses.TEMPLATES)} <= hits
    assert {h for h in hits if h[0] in (50, 51, 52, 54)} == set() and (53, "Apache-2.0-header") in hits and (None, "MIT") in hits
    mit = next(x for x in found if x.license_id == "MIT" and x.doc_id is not None)
    assert (mit.first_word, mit.n_words, mit.containment) == (50, 5, 1.0)
    assert licenses.scan(table(spark, [])).count() == 0


def contained(text, template):
    """Best share of the template's shingles in a span of the text at most a quarter longer, by brute force."""
    shingles = lambda t: [tuple(x) for w in [re.findall(r"[a-z0-9\\x80-\\U0010ffff]+", t.translate(LOWER))] for x in zip(*[w[i:] for i in range(5)], strict=False)]
    own, wanted = shingles(text), set(shingles(template))
    room = len(wanted) + -(-len(wanted) // 4)
    at = [i for i, x in enumerate(own) if x in wanted]
    return max((len({x for x in own[a : a + room] if x in wanted}) for a in at), default=0) / len(wanted)


def test_licenses_against_brute_force(spark):
    """Edited copies in very long texts: all that reach the containment are found, siblings apart from each other."""
    rng = random.Random(8)
    rows, truth = [], set()
    for i, (name, text) in enumerate(list(licenses.TEMPLATES.items()) * 6):
        w = text.split()
        for _ in range(i // len(licenses.TEMPLATES) * len(w) // 150):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, f"{prose(i, rng.choice([5, 300, 9000]))} {' '.join(w)} {prose(-i, 40)}"))
        best = {n: contained(rows[-1][1], t) for n, t in licenses.TEMPLATES.items()}
        if best[name] >= 0.8 and best[name] == max(best.values()) and sum(len(licenses.TEMPLATES[n]) >= len(text) for n, x in best.items() if x == best[name]) == 1:
            truth.add((i, name))
    found = {(x.doc_id, x.license_id): x.containment for x in licenses.scan(table(spark, rows)).collect()}
    missed = truth - set(found)
    assert len(truth) > 60 and len(missed) <= 0.1 * len(truth), missed
    text = {n: licenses.TEMPLATES[n] for n in ("BSD-2-Clause-text", "BSD-3-Clause-text", "MIT-text", "MIT-grant")}
    named = {(x.doc_id, x.license_id) for x in licenses.scan(table(spark, [(i, t) for i, t in enumerate(text.values())] * 2)).collect()}
    assert named == set(enumerate(text))


def test_licenses_odd_tables(spark):
    """Of several places with as many shingles the first is named; rows that repeat are scanned each; a very long text."""
    notice = licenses.TEMPLATES["MIT"]
    docs = spark.createDataFrame([(7, f"{prose(2, 40_000)} {notice} {prose(4, 30)} {notice}", "own"), (8, notice, "own"), (8, notice, "own"), (8, None, "own")], "doc_id long, text string, license_id string")
    found = [(x.doc_id, x.license_id, x.first_word, x.containment) for x in licenses.scan(docs).collect()]
    assert sorted(found) == [(7, "MIT", 40_000, 1.0), (8, "MIT", 0, 1.0), (8, "MIT", 0, 1.0)]


# ---- pages --------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- x --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>First  line.<br><p>Second&nbsp;one &lt;b&gt;</p><aside>See also</aside>
<p>Third <a href="x">link</a> &#233;.</p><form>Mail <input></form><section id="comments"><p>nice</p></section></article>
<div class="sidebar">Side</div><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Head & more\nFirst line.\nSecond one <b>\nThird link é."),
        (PAGE.replace("article>", "main>"), "Head & more\nFirst line.\nSecond one <b>\nThird link é."),
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<article><p>cut <b>off &am", "cut off &am"),
        ("<article><div class='ad'>never closed<p>x</article><footer>f</footer>", ""),
        ("<body><div><p>" + "word " * 30 + "</p></div><ul><li><a>Home</a><li><a>News</a></ul></body>", ("word " * 30).strip()),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "no\nno\nyes"),
        ("<article><p>a</p><div class='share-price'>Share price rose 5%</div><section id='search-trees'>b</section><p>c <math><mi>x</mi></math></p></article>", "a\nShare price rose 5%\nb\nc x"),
        ("<article><p>one</p></article><div class='ad-box'>Buy</div><article><p>two</p></article><div>rest</div>", "one\ntwo"),
        ("<body><p>" + "word " * 40 + "</p><div class='ad'>Buy</div><p>The end.</p></body>", ("word " * 40).strip() + "\nThe end."),
        ("<body><h1>Head</h1><p>" + "word " * 40 + "</p><p><a href='x'>a paragraph that is a link</a></p><p>" + "more " * 40 + "</p></body>", "Head\n" + ("word " * 40).strip() + "\na paragraph that is a link\n" + ("more " * 40).strip()),
        ("<body><p>Log in</p><p>Cart</p><p>0</p><p>.</p><p>" + "word " * 40 + "</p><p>x</p><p>y</p><p>z</p><p>Top</p></body>", "0\n.\n" + ("word " * 40).strip() + "\nx\ny"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_surge_and_dive(monkeypatch):
    """Sums by brute force, and pages without an article element need them."""
    rng = random.Random(4)
    for _ in range(200):
        weight = [rng.choice([0, 0, 3, 20, 90, 400]) for _ in range(rng.randrange(1, 30))]
        sums = [sum(weight[i : i + 3]) for i in range(len(weight))]
        live = [i for i, x in enumerate(sums) if x and x >= min(50, max(sums) / 2)]
        covered = {j for i in live for j in range(i, min(i + 3, len(weight)))}
        assert {j for a, b in html_text.stretches(np.array(weight, float)) for j in range(a, b)} == covered
    page = "<body><p>Log in</p><p>Cart</p><p>0</p><p>.</p><p>" + "word " * 40 + "</p></body>"
    text = html_text.main_text(page)
    monkeypatch.setattr(html_text, "stretches", lambda weight: [(0, len(weight))])
    assert html_text.main_text(page) != text


class Plain(HTMLParser):
    """The article of the test tables' pages, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "h2", "h3", "li", "blockquote", "article") else None
        self.blocks[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "h2", "h3", "li", "blockquote", "article") else None

    def handle_data(self, data):
        self.blocks[-1] += data if self.depth else ""


def test_pages_by_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        plain = Plain()
        plain.feed(r.html or "")
        assert html_text.main_text(r.html) == "\n".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
    assert len(pages) > 20


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    rows = html_text.extract(pages).collect()
    assert [x.n_chars for x in rows].count(len(html_text.main_text(PAGE))) == 2 and [x.text for x in rows if x.page_id is None] == [""]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- tool calls ---------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = [
        (1, "c", "b", "search", '{"query":"x","limit":3}', 0), (1, "a", None, "search", '{"limit":99,"query":""}', 0), (1, "b", "a", "other", "{}", 0),
        (1, "loop1", "loop2", "search", "[1]", 0), (1, "loop2", "loop1", "search", None, 0), (1, "after", "loop1", "search", "{bad", 0),
        (2, "c", "gone", "translate", '{"z":1,"query":5,"limit":"7"}', 0), (2, "c", "gone", "translate", '{"z":1,"query":5,"limit":"7"}', 0), (None, "x", None, "search", "{}", 0), (2, None, None, "search", "{}", 0),
    ]
    results = [(1, "a", "two"), (1, "a", "one"), (2, "nobody", "x"), (1, "b", None)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, follows string, name string, arguments string, depth int")
    got = {(x.conv_id, x.call_id): x for x in tool_calls.link(c, spark.createDataFrame(results, "conv_id long, call_id string, content string"), tool_calls.SCHEMAS).collect()}
    assert len(got) == 7
    assert {k: x.depth for k, x in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "loop1"): None, (1, "loop2"): None, (1, "after"): None, (2, "c"): 0}
    assert got[1, "a"].errors == "maximum:limit;minLength:query" and got[1, "a"].n_results == 2 and got[1, "b"].errors == "unknown_tool"
    assert got[1, "loop1"].errors == got[1, "loop2"].errors == got[1, "after"].errors == "not_an_object"
    assert got[2, "c"].errors == "type:limit;type:query;unexpected:z"
    assert got[1, "c"].valid and got[1, "c"].json == '{"arguments":{"limit":3,"query":"x"},"call_id":"c","depth":2,"follows":"b","name":"search","valid":true}'
    assert got[1, "a"].json == '{"arguments":{"limit":99,"query":""},"call_id":"a","depth":0,"name":"search","result":"one","valid":false}'


def test_long_chain(spark):
    n = 300
    calls = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.concat(F.lit("k"), "id").alias("call_id"), F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id") - 1)).alias("follows"))
    got = {x.call_id: x.depth for x in tool_calls.depths(calls).collect()}
    assert got == {f"k{i}": i for i in range(n)}
