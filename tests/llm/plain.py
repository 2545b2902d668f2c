"""Plain versions of the operators, straight from their definition, and awkward input tables."""

from __future__ import annotations

import hashlib
import random
import re

BLANK = " \t\n\x0b\x0c\r"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, kept int, score string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    rows = [
        (i, t, "en" if n % 3 else None, f"s{n % 2}" if n % 5 else None, len(t) if t else 0, "x", n, 1, None)
        for n, (i, t) in enumerate(zip(ids if ids is not None else range(len(texts)), texts))
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def awkward():
    """(ids, texts): nulls, empty and very long texts, repeated rows, odd white space, ties."""
    line = "The same long line in many documents"
    long = " ".join(f"w{n % 977}" for n in range(30000))
    texts = [
        None, "", " \t\n\x0b ", line, line + "\n" + line, "  " + line.upper() + "\r\nshort\nown line of the sixth",
        "Éa É É " * 30, "Éa É É " * 30, long, long + " tail", "a b", "a b", "solo", line, None, "É" * 9 + "\n" + "É" * 10,
        "É" * 10 + "\n" + "É" * 9, "x " * 200, "x " * 60,
    ]
    ids = list(range(len(texts)))
    return ids + [13, None, None], texts + [line, line, None]


def drop_lines(docs):
    key = lambda line: low(line.strip(BLANK))
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def remove_repeats(docs, size=20):
    first = {}
    cut = {n: PLAIN.findall(text or "") for n, (_, text) in enumerate(docs)}
    for n, words in cut.items():
        i = docs[n][0]
        for s in range(len(words) - size + 1):
            if i is not None:
                key = tuple(words[s:s + size])
                first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for n, words in cut.items():
        i, gone = docs[n][0], set()
        for s in range(len(words) - size + 1):
            if i is not None and first[tuple(words[s:s + size])] < (i, s):
                gone |= set(range(s, s + size))
        kept = [w for at, w in enumerate(words) if at not in gone]
        out.append((i, len(words), len(gone), sha(" ".join(kept))))
    return out


def shingles(text, size):
    words = PLAIN.findall(low(text or ""))
    span = min(size, len(words))
    return {tuple(words[s:s + span]) for s in range(len(words) - span + 1)} if words else set()


def near_groups(docs, size=3, hundredths=85):
    sets = [(i, shingles(text, size)) for i, text in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= hundredths * len(x | y):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return [(i, len(x), None if i is None else top(i), i is None or top(i) == i) for i, x in sets]


def contamination(docs, items, window=13):
    patterns = {}
    for item, text in items:
        words = ALNUM.findall(low(text or ""))
        for s in range(max(1, len(words) - window + 1) if words else 0):
            patterns.setdefault(tuple(words[s:s + window]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = []
    for i, text in docs:
        words, hit, found = ALNUM.findall(low(text or "")), set(), set()
        for size in sizes:
            for s in range(len(words) - size + 1):
                own = patterns.get(tuple(words[s:s + size]))
                if own:
                    hit |= set(range(s, s + size))
                    found |= own
        names = sorted(str(x) for x in found)
        out.append((i, len(words), len(hit), len(found), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def random_docs(seed, count=60, vocabulary=12):
    """Texts with passages, copies and near copies of each other."""
    draw = random.Random(seed)
    words = lambda n: [f"w{draw.randrange(vocabulary)}" for _ in range(n)]
    passages = [words(draw.randint(5, 60)) for _ in range(6)]
    texts = []
    for _ in range(count):
        kind = draw.random()
        if texts and kind < 0.2:
            texts.append(draw.choice(texts))
        elif texts and kind < 0.6:
            old = draw.choice(texts).split()
            for _ in range(draw.randint(1, 3)):
                if old:
                    old[draw.randrange(len(old))] = f"n{draw.randrange(1000)}"
            texts.append(" ".join(old))
        else:
            parts = [draw.choice(passages) if draw.random() < 0.5 else words(draw.randint(1, 50)) for _ in range(4)]
            texts.append(" ".join(w for p in parts for w in p))
    return texts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
