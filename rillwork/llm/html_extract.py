"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Every block element is a node that is main text or not. Node potentials come from its tag, names,
roles, amount of text and share of links; parent and child share a 2 x 2 potential. Messages run from the
leaves up and from the root down (sum-product), which gives each node's exact marginal. Potentials are
learned from labelled pages by the gradient of the likelihood, observed minus expected counts, where
the expected counts are the marginals themselves. The model is small and is broadcast; pages are
worked on whole and on their own, without a shuffle.

* Null or empty html, and pages without main text, give an empty text. Pages that are cut off are closed
  at their end. A very deep or long page is one tree; messages are passed without recursion.
* Repeated rows give repeated results; a null page_id or url is passed on. Extra columns do not matter.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.dom import Node, features, parse
from rillwork.llm.labelled_pages import labelled_pages

# Training schedule, log-odds of the root, and the marginal from which a block is main text.
EPOCHS = 20
RATE = 0.5
DECAY = 1e-4
ROOT = -20.0
LIMIT = 0.5


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def sum_product(parents: list[int], potential: list[float], edge: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Marginals P(node is main text) and expected counts of (parent, child) states.

    ``parents`` come before their children; ``potential`` is the log-odds of each node on its own.
    """
    n = len(parents)
    # below[v][s]: log-sum over the subtree of v, v in state s; up[v][s]: its message to a parent in state s.
    below = [[0.0, p] for p in potential]
    up = [[0.0, 0.0] for _ in range(n)]
    for v in range(n - 1, 0, -1):
        for s in (0, 1):
            up[v][s] = _log_add(edge[s][0] + below[v][0], edge[s][1] + below[v][1])
            below[parents[v]][s] += up[v][s]
    above = [[0.0, 0.0] for _ in range(n)]  # message from the parent, per state of the node
    marginals, pairs = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]]
    for v in range(n):
        if v:
            p = parents[v]
            rest = [above[p][s] + below[p][s] - up[v][s] for s in (0, 1)]
            joint = [[rest[s] + edge[s][t] for t in (0, 1)] for s in (0, 1)]
            above[v] = [_log_add(joint[0][t], joint[1][t]) for t in (0, 1)]
            full = [[joint[s][t] + below[v][t] for t in (0, 1)] for s in (0, 1)]
            total = _log_add(_log_add(full[0][0], full[0][1]), _log_add(full[1][0], full[1][1]))
            for s in (0, 1):
                for t in (0, 1):
                    pairs[s][t] += math.exp(full[s][t] - total)
        off, on = above[v][0] + below[v][0], above[v][1] + below[v][1]
        marginals[v] = math.exp(on - _log_add(off, on))
    return marginals, pairs


def _potentials(names: list[list[str]], weights: dict[str, float]) -> list[float]:
    """Log-odds of each node on its own; the root, above all elements, is not main text."""
    return [ROOT, *[sum(weights.get(f, 0.0) for f in own) for own in names[1:]]]


class DomModel:
    """Weights of node features and the potential of parent and child."""

    def __init__(self, weights: dict[str, float], edge: list[list[float]]):
        self.weights, self.edge = weights, edge

    def marginals(self, nodes: list[Node]) -> list[float]:
        return sum_product([n.parent for n in nodes], _potentials(features(nodes), self.weights), self.edge)[0]

    def extract(self, html: str | None) -> str:
        nodes = parse(html or "")
        chance = self.marginals(nodes)
        found = [piece for node, p in zip(nodes, chance) if p >= LIMIT for piece in node.text]
        return "\n".join(text for _, text in sorted(found))


def fit(pages: Iterable[str]) -> DomModel:
    """Learn from pages whose elements carry ``data-content`` (0 or 1, inherited; the root is 0)."""
    examples = []
    for page in pages:
        nodes = parse(page)
        labels = []
        for node in nodes:
            labels.append(node.label if node.label is not None else labels[node.parent] if node.parent >= 0 else 0)
        examples.append(([n.parent for n in nodes], features(nodes), labels))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    edge = [[0.0, 0.0], [0.0, 0.0]]
    edge_squares = [[0.0, 0.0], [0.0, 0.0]]
    order = random.Random(1)
    for _ in range(EPOCHS):
        order.shuffle(examples)
        for parents, names, labels in examples:
            chance, expected = sum_product(parents, _potentials(names, weights), edge)
            pull: dict[str, float] = {}
            for own, label, p in zip(names[1:], labels[1:], chance[1:]):
                for f in own:
                    pull[f] = pull.get(f, 0.0) + label - p
            # AdaGrad: names that are rare on the pages keep a large step.
            for f, g in pull.items():
                w = weights.get(f, 0.0)
                g -= DECAY * w
                squares[f] = squares.get(f, 1e-2) + g * g
                weights[f] = w + RATE * g / math.sqrt(squares[f])
            seen = [[0, 0], [0, 0]]
            for parent, label in zip(parents[1:], labels[1:]):
                seen[labels[parent]][label] += 1
            for s in (0, 1):
                for t in (0, 1):
                    g = seen[s][t] - expected[s][t] - DECAY * edge[s][t]
                    edge_squares[s][t] += g * g + 1e-2
                    edge[s][t] += RATE * g / math.sqrt(edge_squares[s][t])
    return DomModel(weights, edge)


def extract_text(pages: DataFrame, model: DomModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    model = model or fit(labelled_pages())
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.edge))

    @F.arrow_udf("string")
    def run(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = DomModel(*sent.value)
        for batch in html:
            yield pa.array([own.extract(h.as_py()) for h in batch], pa.string())

    rows = pages.select("page_id", "url", run(F.col("html").cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
