"""Operators on documents against plain versions, on random and on awkward tables."""

import plain
import pytest

from rillwork.llm import decontaminate, near_dedup, substring_dedup
from rillwork.llm.decontaminate import clean_documents, contamination, decontamination_report
from rillwork.llm.line_dedup import line_dedup_report
from rillwork.llm.near_dedup import keep_one, near_dedup_report, near_groups
from rillwork.llm.substring_dedup import SuffixAutomaton, substring_dedup_report

ITEMS = [(1, "w1 w2 w3"), (2, " ".join(f"w{n % 977}" for n in range(5, 40))), (3, None), (4, "..."), (5, "É a"), (12, "W1, w2; w3!")]


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def odd(spark):
    ids, texts = plain.awkward()
    return list(zip(ids, texts)), plain.table(spark, texts, ids).repartition(3)


def test_lines(spark, odd):
    docs, df = odd
    assert plain.rows(line_dedup_report(df)) == sorted(plain.drop_lines(docs), key=repr)


def test_substrings_awkward(spark, odd):
    docs, df = odd
    assert plain.rows(substring_dedup_report(df)) == sorted(plain.remove_repeats(docs), key=repr)


@pytest.mark.parametrize("seed,hot,slice_", [(1, 4096, 1 << 18), (2, 1, 1 << 18), (3, 4096, 7)])
def test_substrings_random(spark, monkeypatch, seed, hot, slice_):
    """Also with every anchor treated as hot, and with texts cut into tiny slices."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SLICE", slice_)
    texts = plain.random_docs(seed)
    got = plain.rows(substring_dedup_report(plain.table(spark, texts).repartition(4)))
    assert got == sorted(plain.remove_repeats(list(enumerate(texts))), key=repr)


def test_automaton_gives_longest_matches():
    texts = [t.split() for t in plain.random_docs(9, count=8, vocabulary=4)]
    machine, joined = SuffixAutomaton(), []
    for text in texts:
        found = machine.matching(text)
        for end, length in enumerate(found):
            run = " ".join(text[end + 1 - length:end + 1])
            longer = " ".join(text[max(0, end - length):end + 1])
            assert not run or any(f" {run} " in j for j in joined)
            assert end < length or not any(f" {longer} " in j for j in joined)
        machine.add(text)
        joined.append(f" {' '.join(text)} ")


def test_near_awkward(spark, odd):
    docs, df = odd
    assert plain.rows(near_dedup_report(df)) == sorted(plain.near_groups(docs), key=repr)


@pytest.mark.parametrize("seed,block,shingles", [(4, 2048, 1 << 21), (5, 3, 1 << 21), (6, 2048, 50)])
def test_near_random(spark, monkeypatch, seed, block, shingles):
    """Also with buckets cut into tiny blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    texts = plain.random_docs(seed, count=120, vocabulary=400)
    got = plain.rows(near_dedup_report(plain.table(spark, texts).repartition(4)))
    assert got == sorted(plain.near_groups(list(enumerate(texts))), key=repr)


def test_near_chain_needs_bridges(spark):
    """A chain of copies in which the ends are far apart, and links skip the smallest document."""
    base = [f"b{n}" for n in range(120)]
    texts = []
    for step in range(12):
        words = list(base)
        for n in range(step):
            words[n * 9] = f"c{n}"
        texts.append(" ".join(words))
    ids = [11, 0, 5, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    docs = list(zip(ids, texts))
    got = plain.rows(near_groups(plain.table(spark, texts, ids), 3, 0.85))
    assert got == sorted(plain.near_groups(docs), key=repr)
    assert {r[2] for r in got} == {0}


def test_keep_one(spark, odd):
    docs, df = odd
    kept = keep_one(df, 5, 0.8)
    assert kept.columns == df.columns
    want = sorted([i for i, _, _, keep in plain.near_groups(docs, 5, 80) if keep], key=repr)
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == want


def test_decontamination(spark, odd):
    docs, df = odd
    want = sorted(plain.contamination(docs, ITEMS), key=repr)
    assert plain.rows(decontamination_report(df, benchmark(spark))) == want
    kept = clean_documents(df, benchmark(spark))
    assert kept.columns == df.columns and kept.count() == sum(not r[-1] for r in want)


def test_decontamination_shards(spark, monkeypatch):
    """One item per shard gives what one shard gives, up to rows that share a doc_id."""
    texts = [t for t in plain.awkward()[1]]
    df = plain.table(spark, texts)
    want = plain.rows(decontamination_report(df, benchmark(spark)))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1)
    assert plain.rows(decontamination_report(df, benchmark(spark))) == want
    assert clean_documents(df, benchmark(spark)).count() == sum(not r[-1] for r in want)


def test_long_items_are_cut_between_windows(spark, monkeypatch):
    words = [f"w{n * n % 101}" for n in range(90)]
    items = [("a", " ".join(words)), ("b", " ".join(words[20:33])), ("c", "Short one"), ("d", None), ("e", " ,;" * 40)]
    for size in (1, 40, 90, 5000):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        for n in (0, 1, 12, 13, 14, 25, 90):
            text = " ".join(words[:n]).encode()
            cut = [decontaminate.words_of(t) for t in decontaminate.slices(text)]
            runs = lambda ws: {tuple(ws[i:i + 13]) for i in range(len(ws) - 12)}
            assert set().union(*map(runs, cut)) == runs(decontaminate.words_of(text))
            # Less than a window only if the text is.
            assert all(len(ws) >= min(n, 13) for ws in cut)
    texts = [" ".join(words[5:30]), "x " + " ".join(words[40:52]), "a short one here", " ".join(words), None]
    marks = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(plain.contamination(list(enumerate(texts)), items), key=repr)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 100)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 200)
    assert plain.rows(decontamination_report(plain.table(spark, texts), marks)) == want


def test_decontamination_shards_do_not_go_by_doc_id(spark, monkeypatch):
    """Rows without doc_id, and rows that share one, are judged by their own text in every shard."""
    items = [i for i in ITEMS if i[1]]
    texts = [t for _, t in items] * 2 + ["clean text of its own", "another clean one"] * 2 + [None, ""]
    ids = [None] * len(items) + [7] * len(items) + [None, None, 7, 7, None, 7]
    df = plain.table(spark, texts, ids)
    marks = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain.contamination(list(zip(ids, texts)), items), key=repr)
    assert plain.rows(decontamination_report(df, marks)) == want
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1)
    assert plain.rows(decontamination_report(df, marks)) == want
    kept = sorted(((r["doc_id"], r["text"]) for r in clean_documents(df, marks).collect()), key=repr)
    bad = {(i, t) for (i, t), r in zip(zip(ids, texts), plain.contamination(list(zip(ids, texts)), items)) if r[-1]}
    assert kept == sorted(((i, t) for i, t in zip(ids, texts) if (i, t) not in bad), key=repr)


def test_decontamination_offsets(spark):
    df = spark.createDataFrame([(1, "Ä! x, É  a. w1  W2 -w3")], "doc_id long, text string")
    row = contamination(df, benchmark(spark)).first()
    found = [df.first()["text"].encode()[s:e].decode() for s, e in zip(row["byte_starts"], row["byte_ends"])]
    assert found == ["É  a. w1  W2 -w3"] and row["n_hit"] == 5


@pytest.mark.parametrize("operator", [line_dedup_report, substring_dedup_report, near_dedup_report])
def test_empty_tables(spark, operator):
    assert operator(plain.table(spark, [])).count() == 0


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontamination_report(plain.table(spark, ["a", None]), none).where("contaminated").count()
    assert decontamination_report(plain.table(spark, []), none).count() == 0
