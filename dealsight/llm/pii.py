"""Personal data: patterns with checks, and a skip-chain conditional random field that adds what they miss.

The base spans of a text come from four patterns and their checks.  Words with a digit or an at-sign are the nodes of a
random field over the labels none, email, ip, card and phone.  Edges join nodes that are neighbouring words, and (skip
edges) words of one document that repeat a form or a run of digits, however far apart: each with the one before it, and with
the first observed word that it repeats (or the first word, if none is).  Words inside base spans are observed.  Loopy
belief propagation runs until it settles the others, so that a number written once as a full telephone number
and later without its prefix gets the same label.  Weights are fitted by pseudo-likelihood on a bounded sample.

Defined cases: a null or empty text has no spans; a document without nodes has its base spans alone; repeated rows get
equal results; an empty table gives no rows; offsets are code points.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsight.llm.common import cut, map_batches, sample_ids, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ANY_DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9][0-9.]*")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE_MARKS = ".,;:!?\"'()[]{}<>|"

AGREE = 3.0  # log odds by which a repeat is expected to share its label
SETTLED = 1e-4  # messages that change by less are settled

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost matches, found from each at-sign outwards: the local part is the whole run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """All spans that the patterns find and their checks confirm, by start and kind."""
    out: list[Span] = [(s, 0, e) for s, e in emails(text)]
    if not ANY_DIGIT.search(text):
        return out
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in QUAD.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def node_features(word: str) -> list[bool]:
    """Shape of a word: signs, digits and whether it meets the checks of a kind."""
    digits = "".join(c for c in word if "0" <= c <= "9")
    n, letters = len(digits), sum(c.isalpha() for c in word)
    local, at, domain = word.partition("@")
    parts = word.strip(EDGE_MARKS).split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return [True, bool(at), bool(at and local and domain), bool(at and "." in domain.strip(EDGE_MARKS)),
            *(lo <= n <= hi for lo, hi in ((1, 1), (2, 3), (4, 6), (7, 8), (9, 11), (12, 15), (16, 19), (20, 10**9))),
            letters > 0, letters > n, quad, len(parts) == 4 and not quad, "-" in word, "(" in word or ")" in word,
            word.startswith("+"), "." in word.strip(EDGE_MARKS), 12 <= n <= 19 and luhn(digits), 12 <= n <= 19 and not luhn(digits)]


N_FEATURES = len(node_features("0"))


def anchored(nodes: list[int], y: list[int]) -> Iterable[tuple[int, int]]:
    """Every node with the first one observed of each kind, or else with the first: evidence is one edge from any repeat."""
    anchors: dict[int, int] = {}
    for node in nodes:
        if y[node]:
            anchors.setdefault(y[node], node)
    for anchor in anchors.values() or nodes[:1]:
        yield from ((min(anchor, node), max(anchor, node)) for node in nodes if node != anchor)


@dataclass
class Graph:
    """Nodes of one text: word spans, features, observed labels (0 none), chain and skip edges as index pairs."""

    start: list[int]
    end: list[int]
    x: np.ndarray
    y: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @staticmethod
    def of(text: str, base: list[Span]) -> Graph | None:
        start, end, index, rows, y, chain = [], [], [], [], [], []
        same: dict[tuple[str, str], list[int]] = {}
        wide: dict[tuple[str, str], list[int]] = {}
        by_kind = [[b for b in base if b[1] == kind] for kind in range(len(KINDS))]
        at = [0] * len(KINDS)
        for k, m in enumerate(WORDS.finditer(text)):
            word = m.group()
            if "@" not in word and not ANY_DIGIT.search(word):
                continue
            node = len(start)
            if index and index[-1] == k - 1:
                chain.append((node - 1, node))
            index.append(k)
            start.append(m.start())
            end.append(m.end())
            rows.append(node_features(word))
            found = []
            for kind, spans in enumerate(by_kind):  # spans of one kind are disjoint and in order
                while at[kind] < len(spans) and spans[at[kind]][2] <= m.start():
                    at[kind] += 1
                if at[kind] < len(spans) and spans[at[kind]][0] < m.end():
                    found.append(spans[at[kind]])
            y.append(min(found)[1] + 1 if found else 0)
            form, digits = word.strip(EDGE_MARKS).lower(), "".join(c for c in word if "0" <= c <= "9")
            keys = [k for k in (("form", form), ("digits", digits if len(digits) >= 6 else "")) if k[1]]
            for key in keys:
                same.setdefault(key, []).append(node)
            if keys:  # words of one form have the same digits, so the last key takes in the first
                wide.setdefault(keys[-1], []).append(node)
        if not start:
            return None
        skip = {pair for nodes in same.values() for pair in zip(nodes, nodes[1:])}
        skip |= {pair for nodes in wide.values() for pair in anchored(nodes, y)}
        pairs = [np.array(p, np.int64).reshape(-1, 2) for p in (chain, sorted(skip))]
        return Graph(start, end, np.array(rows, float), np.array(y, np.int64), *pairs)


@dataclass(frozen=True)
class Field:
    """Weights: features to labels, chain (left label, right label) and skip (symmetric) potentials."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, g: Graph, rounds: int = 12, damping: float = 0.5) -> np.ndarray:
        """Label marginals by loopy belief propagation; words in base spans are observed.

        Runs ``rounds`` rounds at least, then until no message changes by ``SETTLED``.  Where loops make messages swing,
        that is, 50 rounds have not halved the largest change, steps are halved; the end is sure, as both halvings are.
        """
        n, labels = len(g.start), self.unary.shape[1]
        local = g.x @ self.unary
        local[g.y > 0] -= 1e3
        local[g.y > 0, g.y[g.y > 0]] += 1e3
        edges = np.concatenate([g.chain, g.skip])
        pot = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])  # [edge, label of src, label of dst]
        back = np.r_[len(edges):2 * len(edges), 0:len(edges)]
        msg = np.zeros((len(src), labels))
        step, low, since, done = 1 - damping, np.inf, 0, 0
        while len(src) and (done < rounds or low > SETTLED and step > 1e-3):
            total = local.copy()
            np.add.at(total, dst, msg)
            out = (total[src] - msg[back])[:, :, None] + pot
            top = out.max(1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            change = new - new.max(1, keepdims=True) - msg
            msg += step * change
            done, since, largest = done + 1, since + 1, np.abs(change).max()
            if largest <= max(low / 2, SETTLED):
                low, since = largest, 0
            elif since == 50:
                step, since = step / 2, 0
        total = local
        np.add.at(total, dst, msg)
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(1, keepdims=True)

    def added(self, g: Graph, base: list[Span], text: str) -> list[Span]:
        """Runs of neighbouring words that the field gives one kind with more than even odds, clear of base spans."""
        p = self.beliefs(g)
        label = np.where(p.max(1) > 0.5, p.argmax(1), 0)
        label[g.y > 0] = 0
        near = {(int(a), int(b)) for a, b in g.chain}
        out, k = [], 0
        while k < len(label):
            if not label[k]:
                k += 1
                continue
            last = k
            while (last, last + 1) in near and label[last + 1] == label[k]:
                last += 1
            word = text[g.start[k]:g.end[last]]
            s = g.start[k] + len(word) - len(word.lstrip(EDGE_MARKS))
            e = g.end[last] - (len(word) - len(word.rstrip(EDGE_MARKS)))
            if s < e:
                out.append((s, int(label[k]) - 1, e))
            k = last + 1
        return out


def train(graphs: list[Graph], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Field | None:
    """Pseudo-likelihood: every node's label given its features and its neighbours' labels.

    The patterns' silence on a word that repeats an observed one says nothing, so such words are left out as unlabelled.
    """
    if not any((g.y > 0).any() for g in graphs):
        return None
    labels = len(KINDS) + 1
    sizes = np.cumsum([0, *(len(g.start) for g in graphs)])
    x, y = np.concatenate([g.x for g in graphs]), np.concatenate([g.y for g in graphs])
    chain = np.concatenate([g.chain + at for g, at in zip(graphs, sizes)])
    skip = np.concatenate([g.skip + at for g, at in zip(graphs, sizes)])
    both = np.concatenate([skip, skip[:, ::-1]])
    hidden, near = np.zeros(len(y), bool), y > 0
    while (more := both[near[both[:, 0]] & ~near[both[:, 1]], 1]).size:  # repeats of repeats
        near[more] = True
    hidden[near & (y == 0)] = True
    before, after, apart = (np.zeros((len(y), labels)) for _ in range(3))  # neighbours' labels, counted
    for counts, here, there in ((before, chain[:, 1], chain[:, 0]), (after, chain[:, 0], chain[:, 1]), (apart, both[:, 1], both[:, 0])):
        seen = ~hidden[there]
        np.add.at(counts, (here[seen], y[there[seen]]), 1)
    want = np.eye(labels)[y]
    weight = np.where(hidden, 0.0, 1.0 / np.sqrt(np.maximum(want[~hidden].sum(0), 1))[y])  # rare kinds count more
    weight /= weight.sum()
    # one weight for all skip edges, as the rule is the same for every label: repeats agree; its prior mean is AGREE
    params = [np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), np.full((1, 1), AGREE)]
    prior = [0.0, 0.0, AGREE]
    size = [np.zeros_like(p) for p in params]
    for _ in range(steps):
        u, c, s = params
        z = x @ u + before @ c + after @ c.T + apart * s
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        d = (p / p.sum(1, keepdims=True) - want) * weight[:, None]
        grads = [x.T @ d, before.T @ d + d.T @ after, (apart * d).sum(keepdims=True)]
        for k, grad in enumerate(grads):
            grad = grad + ridge * (params[k] - prior[k])
            size[k] += grad ** 2
            params[k] -= rate * grad / (np.sqrt(size[k]) + 1e-8)
    return Field(params[0], params[1], params[2] * np.eye(labels))


def excerpt(g: Graph, most: int) -> Graph:
    """A run of at most ``most`` neighbouring nodes of a graph, around its first observed one, with the edges inside it."""
    n = len(g.start)
    if n <= most:
        return g
    seen = np.flatnonzero(g.y)
    at = min(max(0, int(seen[0]) - most // 4), n - most) if len(seen) else 0
    inside = lambda e: (e[((e >= at) & (e < at + most)).all(1)] - at) if len(e) else e
    return Graph(g.start[at:at + most], g.end[at:at + most], g.x[at:at + most], g.y[at:at + most], inside(g.chain), inside(g.skip))


def fit(docs: DataFrame, fit_docs: int = 4_000, plain_docs: int = 2_000, max_nodes: int = 256, seed: int = 11) -> Field | None:
    """Fit on at most ``fit_docs`` documents with base spans and ``plain_docs`` others with nodes, of each the smallest ids by
    a seeded hash; features and edges of at most ``max_nodes`` neighbouring nodes of each reach the driver.

    Without a single base span in all documents there is nothing to learn from, and no field.
    """

    def graph(t: bytes) -> Graph | None:
        text = t.decode("utf-8", "replace")
        return Graph.of(text, base_spans(text)) if b"@" in t or ANY_DIGIT.search(text) else None

    def marks(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, spans = [], []
        for doc, t in zip(b.column("doc_id").to_pylist(), texts(b)):
            text = t.decode("utf-8", "replace")
            if b"@" in t or ANY_DIGIT.search(text):
                ids.append(doc)
                spans.append(bool(base_spans(text)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.bool_())], ["doc_id", "spans"])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, t in zip(b.column("doc_id").to_pylist(), texts(b)):
            g = graph(t)
            if g:
                g = excerpt(g, max_nodes)
                bits = np.packbits(g.x.astype(bool)).tobytes()
                rows.append((doc, bits, g.y.astype("<i8").tobytes(), g.chain.astype("<i8").tobytes(), g.skip.astype("<i8").tobytes()))
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "x", "y", "chain", "skip"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    marked = cut(map_batches(known, marks, "doc_id long, spans boolean"))
    pick = sample_ids(marked.where("spans"), "doc_id", fit_docs, f"pii{seed}").unionByName(sample_ids(marked.where("NOT spans"), "doc_id", plain_docs, f"pii{seed}"))
    some = known.join(F.broadcast(pick.distinct()), "doc_id", "left_semi")  # at most fit_docs + plain_docs ids
    graphs = []
    for r in sorted(map_batches(some, batch, "doc_id long, x binary, y binary, chain binary, skip binary").collect(), key=lambda r: tuple(map(bytes, r[1:]))):
        y = np.frombuffer(r.y, "<i8")
        x = np.unpackbits(np.frombuffer(r.x, np.uint8), count=len(y) * N_FEATURES).reshape(-1, N_FEATURES)
        pairs = [np.frombuffer(p, "<i8").reshape(-1, 2) for p in (r.chain, r.skip)]
        graphs.append(Graph([0] * len(y), [0] * len(y), x.astype(float), y, *pairs))
    return train(graphs)


def spans_of(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one whole text."""
    base = base_spans(text)
    if field is None or not ("@" in text or ANY_DIGIT.search(text)):
        return base, base
    g = Graph.of(text, base)
    return base, sorted(base + field.added(g, base, text)) if g else base


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every document."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in texts(b):
            base, all_ = spans_of(t.decode("utf-8", "replace"), field)
            kinds = [k for _, k, _ in base]
            rows.append((*map(kinds.count, range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(all_)))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, zip(*rows))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), batch, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by the name of its kind, and ``n_chars`` counted anew."""
    at = docs.columns.index("text")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        new = []
        for t, null in zip(texts(b), b.column("text").is_null().to_pylist()):
            text = t.decode("utf-8", "replace")
            new.append(None if null else masked(text, spans_of(text, field)[1]))
        return b.set_column(at, "text", pa.array(new, b.schema.field("text").type))

    out = map_batches(docs, batch, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
