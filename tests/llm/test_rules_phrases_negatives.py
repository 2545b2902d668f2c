"""Rule cascade, collocations and hard negatives against plain versions."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillwork.llm import classify, dom, quality, vector_search
from rillwork.llm import collocations as C
from rillwork.llm import hard_negatives as H
from rillwork.llm import quality_rules as Q
from rillwork.llm.vector_search import top_k_report


def base_measures(text):
    words, text = plain.PLAIN.findall(text or ""), text or ""
    windows = Counter(tuple(words[s:s + 3]) for s in range(len(words) - 2))
    places = {s + i for s in range(len(words) - 2) if windows[tuple(words[s:s + 3])] > 1 for i in range(3)}
    lines = [x for x in text.split("\n") if plain.PLAIN.search(x)]
    duplicates = sum(x in lines[:at] for at, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(places), failed, lines, words


def judged(text):
    n, chars, symbols, duplicates, _, failed, lines, words = base_measures(text)
    bullets = sum(x.lstrip(plain.BLANK)[0] in "-*•‣" for x in lines)
    cut = sum(x.rstrip(plain.BLANK).endswith(("...", "…")) for x in lines)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    return not (failed or not 3 * n <= chars <= 10 * n or 10 * symbols > n or duplicates >= 3 and 100 * duplicates > 30 * len(lines)
                or 100 * bullets > 90 * len(lines) or 100 * cut > 30 * len(lines) or 100 * letters < 80 * n)


def rule_texts():
    draw = random.Random(5)
    good = lambda n: " ".join(f"{'abcdefgh'[draw.randrange(8)]}{draw.randrange(10**4)}word" for _ in range(n))
    out = [good(60), good(60) + " " + "# " * 40, "\n".join(["same line of this text here"] * 4 + [good(60)]), good(49), good(50)]
    out += ["\n".join(f"- {good(8)}" for _ in range(10)), "\n".join(f"{good(8)} ..." for _ in range(10)), "12 34 " * 5 + good(60)]
    out += ["a b " * 40 + good(30), " ".join(str(n) * 3 for n in range(100, 200)), " ".join("x" * 12 + str(n) for n in range(60)), "a\x85b " * 60]
    return out + plain.random_docs(4, count=40, vocabulary=400)


def test_rules_against_plain_version(spark):
    ids, texts = plain.awkward()
    texts = texts + rule_texts()
    ids = ids + list(range(100, 100 + len(texts) - len(ids)))
    df = plain.table(spark, texts, ids).repartition(3)
    expected = [(i, *base_measures(t)[:6], judged(t)) for i, t in zip(ids, texts)]
    assert plain.rows(Q.rules_report(df)) == sorted(expected, key=repr)
    kept = Q.keep_by_rules(df)
    assert kept.schema == df.schema
    assert Counter(r["text"] for r in kept.collect()) == Counter(t for t in texts if judged(t))
    assert len({judged(t) for t in texts}) == 2
    for empty in (df.limit(0), plain.table(spark, [None])):
        assert Q.rules_report(empty).where("kept").count() == 0 and Q.keep_by_rules(empty).count() == 0


def test_verdict_does_not_depend_on_the_order():
    for text in rule_texts():
        verdicts = {Q.verdict(Q.Measures(text), order) is None for order in (Q.RULES, Q.RULES[::-1])}
        assert verdicts == {judged(text)}


def test_order_follows_rejection_per_cost():
    rule = lambda name, needs: Q.Rule(name, needs, lambda m: False)
    rules = (rule("idle", ("n_symbols",)), rule("dear", ("n_repeat_words",)), rule("cheap", ("n_dup_lines",)), rule("same", ("n_bullet_lines",)))
    seconds = {"words": 1.0, "n_repeat_words": 9.0, "lines": 1.0, "n_dup_lines": 0.1, "n_bullet_lines": 0.1, "n_symbols": 0.5}
    # "dear" rejects most but costs most; "same" rejects what "cheap" has already rejected, and some more.
    rejected = {0: 50, 0b0010: 30, 0b1100: 20, 0b1000: 1, 0b0100: 1}
    assert [r.name for r in Q.order_rules(rules, seconds, rejected)] == ["cheap", "same", "dear", "idle"]
    assert [r.name for r in Q.order_rules(rules, seconds, {})] == ["idle", "cheap", "same", "dear"]


def test_a_rejected_text_costs_no_later_measures():
    m = Q.Measures("too few words")
    assert Q.verdict(m, Q.RULES) == "too_short" and "n_repeat_words" not in m.known and "lines" not in m.known


def phrases_of(docs, least, first, longest=5):
    grams, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.low(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                grams.update((lang, tuple(words[s:s + size])) for s in range(len(words) - size + 1))
    usual = {k: n for k, n in grams.items() if len(k[1]) > 1 and n >= least}
    inside = lambda p, q: any(q[s:s + len(p)] == p for s in range(len(q) - len(p) + 1))
    out = []
    for lang in total:
        own = {p: n for (key, p), n in usual.items() if key == lang}
        found = []
        for p, a in own.items():
            if any(len(q) > len(p) and m >= a and inside(p, q) for q, m in own.items()):
                continue
            cuts = [(1000 * a * total[lang] // (grams[lang, p[:k]] * grams[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), grams[lang, p[:k]], grams[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,gathered,slice_,first", [(1, 1 << 20, 1 << 22, 2000), (2, 50, 40, 2000), (3, 1000, 1 << 22, 7)])
def test_phrases_against_plain_version(spark, monkeypatch, seed, gathered, slice_, first):
    """Also with tasks that gather next to nothing, and with texts cut into tiny slices."""
    monkeypatch.setattr(C, "GATHERED", gathered)
    monkeypatch.setattr(C, "SLICE", slice_)
    draw = random.Random(seed)
    ids, texts = plain.awkward()
    texts = [t for t in texts if t is None or len(t) < 10000] + plain.random_docs(seed, count=50)
    texts += ["A\tb, c\x0bd! É É x \x85 y", "p\0 q\1 \1\1 p\0 q\1 p\0q \1\2 p", ". , ;", "one " * 30] * 3
    docs = [(draw.choice(["en", "de", None]), t) for t in texts]
    df = spark.createDataFrame([(t, lang, 1, 2) for lang, t in docs], "text string, lang string, n long, phrase int").repartition(4)
    got = plain.rows(C.collocations(df, least=3, first=first))
    assert got == phrases_of(docs, 3, first) and len(got) > 6


def test_phrases_of_empty_tables(spark):
    for texts in ([], [None, "", " ,. "]):
        df = plain.table(spark, texts)
        assert C.collocations(df, least=1).count() == 0


def test_counts_of_phrases_split_over_tasks(spark, monkeypatch):
    """One phrase begins most grams, so its flow comes from many ranges and stretches."""
    for name, value in (("RANGE", 40), ("STEP", 16), ("GATHERED", 300)):
        monkeypatch.setattr(C, name, value)
    texts = [f"the of {n}, the of {n} x" for n in range(1500)] + ["the"] * 5
    rows = [("en", t) for t in texts] + [("de", "the of")] * 2 + [("a", "the of,")] * 3
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = plain.rows(C.collocations(df, least=3).select("lang", "phrase", "a", "l", "r", "n"))
    assert got == [("a", "the of", 3, 3, 3, 6), ("en", "the of", 3000, 3005, 3000, 3005 + 3000 + 3000 + 1500)]


def test_rare_words_take_no_memory():
    own = C.Vocabulary("en", bytes(1 << (C.BITS - 3)))
    assert [own[b"rare %d" % at] for at in range(1000)] == [0] * 1000 and len(own) == 2
    own = C.Vocabulary("en", b"\xff" * (1 << (C.BITS - 3)))
    assert [own[w] for w in (b"a", b"b", b"a", b"", b"\n")] == [1, 2, 1, -1, 0] and own.words == [b"", b"a", b"b"]


def test_grams_are_made_some_at_a_time(monkeypatch):
    """Only numbers are held for all the words that a task gathers."""
    monkeypatch.setattr(C, "STEP", 1000)
    numbers = np.random.default_rng(1).integers(0, 5000, 100_000).astype(np.int32)
    words = [b""] + [b"a rather long word %d" % at for at in range(5000)]
    size, counts, last = 0, 0, b""
    held, most = pa.total_allocated_bytes(), 0
    for grams, n in C._edges(numbers, words, 5):
        most = max(most, pa.total_allocated_bytes() - held)
        assert 0 < len(grams) == len(n) <= 1000
        rows = grams.to_pylist()
        assert last < rows[0] and rows == sorted(set(rows))
        size, counts, last = size + len(grams), counts + int(n.sum()), rows[-1]
    assert counts == np.count_nonzero(numbers) and size > 90_000
    assert most < 2_000_000


def test_scores_pass_64_bits(spark):
    cases = [(10**13, 3 * 10**13, 10**13 + 1, 10**12 + 7), (99, 10**15, 100, 99), (7, 9, 11, 13)]
    df = spark.createDataFrame([(at, *c) for at, c in enumerate(cases)], "at int, a long, n long, l long, r long")
    got = {r["at"]: r["score"] for r in df.select("at", F.expr(C.SCORE).alias("score")).collect()}
    assert got == {at: 1000 * a * n // (left * right) for at, (a, n, left, right) in enumerate(cases)}


@pytest.mark.parametrize("size,largest", [(1, 3), (64, 300), (200, 2**20), (3, 2**30), (64, 2**27)])
def test_products_are_exact(size, largest):
    draw = random.Random(size)
    left = [[draw.randint(-largest, largest) for _ in range(size)] for _ in range(5)] + [[largest] * size, [-largest] * size, [0] * size]
    right = [[draw.randint(-largest, largest) for _ in range(size)] for _ in range(7)] + [[largest] * size]
    primes = H.primes_for(size * largest**2)
    got = H.products(np.array(left, np.int64), np.array(right, np.int64), primes)
    assert got.tolist() == [[sum(a * b for a, b in zip(x, y)) for y in right] for x in left]


def test_products_of_empty_vectors_and_too_large_scores():
    assert H.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64), H.primes_for(1)).tolist() == [[0] * 3] * 2
    assert math.prod(H.PRIMES) > 2**64
    with pytest.raises(OverflowError):
        H.primes_for(2**70)
    assert all(64 * (p // 2) ** 2 < 2**24 for p in H.PRIMES)


def mined(rows, positives=5, negatives=10):
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector))
        if row not in usable:
            usable.append(row)
    out = []
    for i, label, v in usable:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, own == label) for j, own, w in usable if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2])[:positives]:
            fits = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits[:negatives], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,strip,block,sampled", [(1, 8192, 1024, 16), (2, 16, 2, 4), (3, 10, 3, 2)])
def test_negatives_against_plain_version(spark, monkeypatch, seed, strip, block, sampled):
    """Nulls, odd components, empty and short vectors, copies, one vector under a third of the ids, repeated ids."""
    for name, value in (("STRIP", strip), ("BLOCK", block), ("SAMPLED", sampled), ("ANCHORS", 2)):
        monkeypatch.setattr(H, name, value)
    draw = random.Random(seed)
    hot = [0.5, -0.25, 0.75, 0.1]
    rows = []
    for n in range(300):
        vector = hot if draw.random() < 0.33 else [draw.gauss(0.2, 0.5) for _ in range(4)]
        rows.append((n, vector, draw.randrange(3)))
    rows += [(None, hot, 1), (400, None, 1), (500, [1.0, None, 0.0, 0.0], 1), (600, [1.0, float("nan"), 0.0, 0.0], 2), (700, hot, None)]
    rows += [(800, [], 1), (801, [], 1), (802, [], 2), (900, [1.0], 1), (901, [2.0], 1), (902, [1.5], 0), rows[100], rows[100], (200, hot, 9), (41, hot, 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, anchor string, score int").repartition(3)
    got = plain.rows(H.hard_negatives_report(df))
    assert got == mined(rows) and len(got) > 50


def test_pairs_of_blocks_and_strips_are_not_broadcast(spark, monkeypatch):
    """The pairs grow as the product of both sides, whatever the sizes of the files say."""
    for name, value in (("STRIP", 16), ("BLOCK", 2), ("SAMPLED", 4)):
        monkeypatch.setattr(H, name, value)
    plans, store = {}, H.stored
    monkeypatch.setattr(H, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and store(df, name))
    draw = random.Random(4)
    rows = [(n, [draw.gauss(0.2, 0.5) for _ in range(4)], draw.randrange(3)) for n in range(1000)]
    assert H.hard_negatives_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).count() > 50
    assert all("MapInArrow" in plans[name] and "Broadcast" not in plans[name] for name in ("early", "best")), plans


def test_negatives_of_empty_and_too_large_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert H.hard_negatives_report(spark.createDataFrame([], schema)).count() == 0
    assert H.hard_negatives_report(spark.createDataFrame([(100, [1.0], 1)], schema)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        H.hard_negatives_report(spark.createDataFrame([(100, [1e18], 1), (1, [1.0], 1)], schema)).count()


def test_learning_sample_passes_over_what_does_not_fit(spark):
    """A huge text that comes first by its hash, and labels of documents that are not there."""
    texts = ["x" * 5000] * 6 + [f"good text {n}" for n in range(40)] + ["y" * 300] * 3
    rows = plain.table(spark, texts).withColumn("label", (F.col("doc_id") % 2).cast("int")).withColumn("text", F.col("text").cast("binary"))
    taken = classify.learning_sample(rows.select("doc_id", "text", "label"), "s", 1000, 1000)
    sizes = [len(t) for _, t, _ in taken]
    assert sum(sizes) <= 1000 and 5000 not in sizes and {label for *_, label in taken} == {0, 1} and len(taken) >= 20
    labels = spark.createDataFrame([(n, n % 2) for n in range(4000)], "doc_id long, quality int")
    docs = plain.table(spark, ["bad " * 60 if n % 2 == 0 else f"fine words of number {n} " * 9 for n in range(400)], range(3600, 4000))
    model = quality.train(docs, labels, max_rows=100)
    scores = [model.score(t) for t in (b"bad " * 60, b"fine words of number 5 " * 9)]
    assert scores[0] < 0.3 < 0.7 < scores[1]


def test_search_with_large_components(spark):
    """Scores beyond the reach of doubles are exact, those beyond 64 bits an error."""
    draw = random.Random(8)
    rows = [(n, [draw.choice([-1, 1]) * draw.uniform(1e4, 2e6) for _ in range(6)]) for n in range(220)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    expected = []
    for i, v in whole:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)
            expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:5], 1)]
    assert max(s for *_, s in expected) > 2**53
    assert plain.rows(top_k_report(df)) == sorted(expected, key=repr)
    with pytest.raises(Exception, match="64 bits"):
        top_k_report(spark.createDataFrame([(0, [1e18], 0), (1, [1.0], 0)], "vec_id long, embedding array<double>, label int")).count()


def test_batched_search_visits_few_pages():
    """In clustered data the bounds leave out most pages, and the answers are those of all products."""
    random_ = np.random.default_rng(4)
    centres = random_.integers(-300, 300, (40, 16))
    data = np.unique(np.concatenate([c + random_.integers(-4, 5, (100, 16)) for c in centres]), axis=0)
    asked = data[::97]
    tree, products = vector_search.MTree(data), []
    plain_scores = tree._scores
    tree._scores = lambda queries, members: products.append(len(queries) * len(members)) or plain_scores(queries, members)
    found = [[] for _ in asked]
    for q, scores, entries in tree.nearest(asked, 4, np.full(len(asked), -np.inf)):
        for at, score in zip(q.tolist(), scores.tolist()):
            found[at].append(score)
    every = asked @ data.T
    assert [sorted(f)[-4:] for f in found] == np.sort(every, axis=1)[:, -4:].tolist()
    assert sum(products) < 0.5 * every.size


def test_deep_and_unmatched_tags_take_linear_time():
    """Two hundred thousand tags that nest, or close what is not open, or close inline elements across blocks."""
    pages = ["<div>" * 100_000 + "x" + "</section>" * 100_000, "<p><b>" * 50_000 + "</q>" * 50_000 + "y", "<td><b>" + "<div>" * 100_000 + "</b>" * 100_000 + "z"]
    start = time.process_time()
    found = [[t for node in dom.parse(page) for _, t in node.text] for page in pages]
    assert found == [["x"], ["y"], ["z"]]
    assert time.process_time() - start < 15


def test_end_tags_close_what_they_closed_before():
    draw = random.Random(12)
    tags = ["div", "p", "b", "a", "li", "ul", "td", "tr", "table", "section", "q", "h1", "script", "body", "html"]
    for _ in range(300):
        page = "".join(draw.choice([f"<{t}>", f"</{t}>", f"w{n} "]) for n, t in enumerate(draw.choices(tags, k=30)))
        assert [(n.tag, n.parent, n.text) for n in dom.parse(page)] == [(n.tag, n.parent, n.text) for n in searched(page)], page


def searched(page):
    """The same tree, with the open elements searched from the innermost outwards."""

    class Searching(dom.Blocks):
        def _end_within_scope(self, tags, scope):
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] in tags:
                    return self._pop(at)
                if self.open[at][0] in scope:
                    return None

        def handle_endtag(self, tag):
            for at in range(len(self.open) - 1, 0, -1) if tag not in dom.VOID else ():
                if self.open[at][0] == tag:
                    return self._pop(at)
                if tag in dom.INLINE and self.open[at][0] in dom.SCOPE:
                    return None

    blocks = Searching()
    blocks.feed(page)
    return blocks.finish()
