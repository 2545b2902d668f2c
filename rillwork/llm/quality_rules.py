"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

A rule looks at a few measures of a text and may reject it. A text is kept if no rule rejects it, so the
verdict does not depend on the order; the order only decides how much work a rejected text costs.
Measures are computed when a rule first asks for them and are remembered for the text.

The order comes from a sample: every measure is timed and every rule judged there. Rules are then picked
one after another: next comes the rule that rejects most of the texts that the rules before it left, per
second of the measures that those have not computed already. Rules that reject nothing come last, the
cheapest first.

* Null text is an empty one. Empty texts have no words and are rejected as too short.
* Texts are measured whole, whatever their length; a text is held by one task at a time.
* Rows are judged by their text alone: repeated rows get equal verdicts, a null doc_id is no obstacle.
* An empty table gives no rows; an empty sample leaves the rules in their given order.
* ``keep_by_rules`` carries extra columns along whatever their names, ``rules_report`` drops them.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import map_batches, texts_of

# Words and white space as the contract has them, symbols, bullets and ends of cut lines.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•", "‣")
CUT_ENDS = ("...", "…")

#: Texts that the order is estimated on (their expected number).
SAMPLE_ROWS = 2000
WINDOW = 3


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window found twice or more, its first place included."""
    hit, first = bytearray(len(words)), {}
    mark = b"\1" * WINDOW
    for at, window in enumerate(zip(*(words[shift:] for shift in range(WINDOW)))):
        earlier = first.setdefault(window, at)
        if earlier != at:
            hit[earlier:earlier + WINDOW] = mark
            hit[at:at + WINDOW] = mark
    return sum(hit)


def _word_lines(m: Measures) -> list[str]:
    return [line for line in m.text.split("\n") if line.strip(BLANK)]


#: Measures by name; one may use those before it.
MEASURES: dict[str, Callable[[Measures], object]] = {
    "words": lambda m: WORD.findall(m.text),
    "n_words": lambda m: len(m["words"]),
    "word_chars": lambda m: sum(map(len, m["words"])),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "lines": _word_lines,
    "n_dup_lines": lambda m: len(m["lines"]) - len(set(m["lines"])),
    "n_bullet_lines": lambda m: sum(line.lstrip(BLANK).startswith(BULLETS) for line in m["lines"]),
    "n_cut_lines": lambda m: sum(line.rstrip(BLANK).endswith(CUT_ENDS) for line in m["lines"]),
    "n_letter_words": lambda m: sum(word.isalpha() or any(map(str.isalpha, word)) for word in m["words"]),
    "n_repeat_words": lambda m: repeated_words(m["words"]),
}
_USES = {
    "n_words": ["words"], "word_chars": ["words"], "n_dup_lines": ["lines"], "n_bullet_lines": ["lines"],
    "n_cut_lines": ["lines"], "n_letter_words": ["words"], "n_repeat_words": ["words"],
}


class Measures:
    """Measures of one text, each computed once and only when asked for."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that has to go; ``needs`` names the measures it looks at."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measures], bool]


#: The two rules of the contract's base, and those beyond it.
BASE = (
    Rule("too_short", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = BASE + (
    Rule("word_length", ("n_words", "word_chars"), lambda m: not 3 * m["n_words"] <= m["word_chars"] <= 10 * m["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", ("lines", "n_dup_lines"), lambda m: m["n_dup_lines"] >= 3 and 100 * m["n_dup_lines"] > 30 * len(m["lines"])),
    Rule("bullets", ("lines", "n_bullet_lines"), lambda m: 100 * m["n_bullet_lines"] > 90 * len(m["lines"])),
    Rule("cut_lines", ("lines", "n_cut_lines"), lambda m: 100 * m["n_cut_lines"] > 30 * len(m["lines"])),
    Rule("few_letters", ("n_words", "n_letter_words"), lambda m: 100 * m["n_letter_words"] < 80 * m["n_words"]),
)


def _closure(needs: Iterable[str]) -> set[str]:
    return {n for need in needs for n in (need, *_USES.get(need, ()))}


def profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text"):
    """(seconds of each measure, texts by the set of rules that reject them) over a sample of the documents.

    Only these sums reach the driver: a row for each measure, and one for each set of rules seen.
    """
    fraction = min(1.0, sample_rows / max(1, docs.count()))
    sample = texts_of(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))).sample(fraction, 11)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seconds, sets = dict.fromkeys(MEASURES, 0.0), {}
        for raw in batch["text"]:
            m = Measures((raw.as_py() or b"").decode("utf-8", "replace"))
            for name in MEASURES:
                start = time.perf_counter()
                m[name]
                seconds[name] += time.perf_counter() - start
            key = sum(1 << at for at, rule in enumerate(rules) if rule.rejects(m))
            sets[key] = sets.get(key, 0) + 1
        return pa.RecordBatch.from_arrays([
            pa.array([*seconds, *map(str, sets)]), pa.array([*seconds.values(), *map(float, sets.values())])], ["name", "amount"])

    sums = map_batches(sample.select("text"), run, "name string, amount double").groupBy("name").agg(F.sum("amount").alias("amount"))
    found = {row["name"]: row["amount"] for row in sums.collect()}
    seconds = {name: found.get(name, 0.0) for name in MEASURES}
    return seconds, {int(name): int(amount) for name, amount in found.items() if name not in MEASURES}


def order_rules(rules: tuple[Rule, ...], seconds: dict[str, float], rejected: dict[int, int]) -> list[Rule]:
    """The rules by rejection per cost, each judged on the texts and measures that those before it leave."""
    left, known, order = dict(rejected), set(), []
    waiting = list(range(len(rules)))
    while waiting:
        def worth(at: int) -> tuple[float, float, int]:
            cost = sum(seconds.get(n, 0.0) for n in _closure(rules[at].needs) - known) + 1e-9
            gain = sum(n for key, n in left.items() if key >> at & 1)
            return (-gain / cost, cost, at)

        best = min(waiting, key=worth)
        waiting.remove(best)
        order.append(rules[best])
        known |= _closure(rules[best].needs)
        left = {key: n for key, n in left.items() if not key >> best & 1}
    return order


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """The order in which a cascade over these documents asks its rules."""
    return order_rules(rules, *profile(docs, rules, sample_rows, text))


def verdict(m: Measures, order: Iterable[Rule]) -> str | None:
    """Name of the first rule that rejects the text; no later one is asked."""
    return next((rule.name for rule in order if rule.rejects(m)), None)


def keep_by_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows whose text no rule rejects, with all their columns."""
    order = plan(docs, rules, text=text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            kept = [verdict(Measures(t.as_py() or ""), order) is None for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def rules_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per document.

    The cascade judges first; what it did not need of the reported measures is computed afterwards.
    """
    order = plan(docs, rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {name: [] for name in (*names, "base_failed", "kept")}
        for raw in batch["text"]:
            m = Measures((raw.as_py() or b"").decode("utf-8", "replace"))
            out["kept"].append(verdict(m, order) is None)
            out["base_failed"].append(any(rule.rejects(m) for rule in BASE))
            for name in names:
                out[name].append(m[name])
        counts = [pa.array(out[name], pa.int64()) for name in names]
        flags = [pa.array(out[name], pa.bool_()) for name in ("base_failed", "kept")]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *counts, *flags], ["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in names) + ", base_failed boolean, kept boolean"
    return map_batches(texts_of(docs), run, schema)
