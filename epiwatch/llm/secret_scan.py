"""Secret scan: fixed rules plus a character convolutional network.

Every text is searched for candidates: what the rules match, and any run of 12
or more key-like characters that has both letters and digits. The network reads
each candidate with the characters around it (a window of ``WIDTH``, the
candidate's characters marked) and gives a calibrated probability that it is a
secret; candidates over the threshold are added to the rules' spans, which stay.
A candidate that its window has no room for is read in overlapping parts, the
last at its end with what follows; those over the threshold make its spans, grown
to the parts between / and = of a run that the window cannot hold. Of a run that
rules overlap, the parts outside their spans are candidates.

The network is trained here, in numpy, on labelled findings: generated ones of
well-known formats of keys and of what looks like keys but is none (digests in
paths, identifiers, versions, numbers), and findings in the corpus, from a
bounded sample of ``documents`` rows: rule matches are secrets, other candidates
count as none unless a rule's keyword stands before them or they have the shape
of a known kind of key (KNOWN). A part is held out: Platt scaling is fitted on
it, and the threshold is the highest at which the recall of the held-out
secrets that the rules do not find (what the network decides) is at least
``recall``.

Cases: a null or empty text has no findings (the digest of an empty string);
repeated rows give a row each; a null doc_id stays null; an empty table trains
on the generated findings alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.common import id_and_text, read_table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
KNOWN = re.compile(r"gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_(?:live|test)_|AIza|eyJ|A[KS]IA|npm_|pypi-|hf_|SG[._]|-----BEGIN")
MODEL = "model"

WIDTH = 64
LETTERS, MARK = 128, 1  # a code for each ASCII character, one (0) for all others; MARK is a second channel
BEFORE = 24
SHORTEST = 12  # characters of a candidate
PART, STRIDE = 40 - 8, 8  # of a long candidate; 8 characters after it are read too


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, rules: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of key-like runs that have letters and digits; of a run that
    spans of the rules overlap, the parts outside them."""
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, b in [*((a, b) for a, _, b in rules if a < m.end() and m.start() < b), (m.end(), m.end())]:
            part = text[at:max(at, a)]
            if len(part) >= SHORTEST and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                out.append((at, a))
            at = max(at, b)
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that the network reads: all of it if its window
    has room for it and for the context after it, else parts of ``PART``
    characters at every ``STRIDE``, the last of them at its end."""
    if end - start <= PART:
        return [(start, end)]
    return [(a, a + PART) for a in (*range(start, end - PART, STRIDE), end - PART)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """The window of codes around a candidate, from BEFORE characters ahead of
    it; 128 is added inside the candidate. Digits and letters keep their code."""
    a = start - BEFORE
    part = text[max(0, a):a + WIDTH]
    codes = np.array([ord(c) if ord(c) < LETTERS else 0 for c in part.ljust(WIDTH + min(0, a), "\0")], np.int64)
    codes = np.concatenate([np.zeros(max(0, -a), np.int64), codes])[:WIDTH]
    codes[BEFORE:min(WIDTH, BEFORE + end - start)] += LETTERS
    return codes


# -- the network ------------------------------------------------------------------------


@dataclass
class Network:
    """Embedding, one convolution of width 5 with ReLU, the maximum and the mean
    over the window, a hidden layer, one output; then Platt scaling."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    held_out_recall: float = 0.0
    held_out_precision: float = 0.0

    SPAN = 5

    @classmethod
    def new(cls, seed: int, dim: int = 12, filters: int = 32, units: int = 24) -> Network:
        r = np.random.default_rng(seed)
        w = lambda *shape: r.normal(0, np.sqrt(2 / shape[0]), shape)
        return cls(r.normal(0, 0.5, (2 * LETTERS, dim)), w(cls.SPAN * dim, filters), np.zeros(filters),
                   w(2 * filters, units), np.zeros(units), w(units, 1), np.zeros(1))

    def forward(self, codes: np.ndarray) -> tuple:
        x = self.embed[codes]
        n, width, dim = x.shape
        steps = width - self.SPAN + 1
        windows = np.lib.stride_tricks.sliding_window_view(x, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n * steps, self.SPAN * dim)
        c = np.maximum(windows @ self.conv + self.conv_bias, 0).reshape(n, steps, -1)
        top = c.argmax(1)
        pooled = np.concatenate([np.take_along_axis(c, top[:, None], 1)[:, 0], c.mean(1)], 1)
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return windows, c, top, pooled, h, (h @ self.out + self.out_bias)[:, 0]

    def margin(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(codes[k:k + 2048])[-1] for k in range(0, len(codes), 2048))])

    def scaled(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.scaled(self.margin(codes))

    def fit(self, codes: np.ndarray, label: np.ndarray, seed: int, epochs: int = 6, batch: int = 128, rate: float = 2e-3, least_steps: int = 400) -> None:
        """Adam on the logistic loss; few findings are gone through more often."""
        r = np.random.default_rng(seed)
        names = ("embed", "conv", "conv_bias", "hidden", "hidden_bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        weight = np.where(label > 0, len(label) / max(1, 2 * label.sum()), len(label) / max(1, 2 * (1 - label).sum()))
        for _ in range(max(epochs, -(-least_steps * batch // len(codes)))):
            order = r.permutation(len(codes))
            for k in range(0, len(order), batch):
                at = order[k:k + batch]
                windows, c, top, pooled, h, z = self.forward(codes[at])
                n, steps, filters = c.shape
                dz = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - label[at]) * weight[at] / n)[:, None]
                grad = {"out": h.T @ dz, "out_bias": dz.sum(0)}
                dh = (dz @ self.out.T) * (h > 0)
                grad |= {"hidden": pooled.T @ dh, "hidden_bias": dh.sum(0)}
                dp = dh @ self.hidden.T
                dc = np.repeat(dp[:, None, filters:] / steps, steps, 1)
                np.put_along_axis(dc, top[:, None], np.take_along_axis(dc, top[:, None], 1) + dp[:, None, :filters], 1)
                dc = (dc * (c > 0)).reshape(n * steps, filters)
                grad |= {"conv": windows.T @ dc, "conv_bias": dc.sum(0)}
                dw = (dc @ self.conv.T).reshape(n, steps, self.SPAN, -1)
                dx = np.zeros((n, steps + self.SPAN - 1, dw.shape[-1]))
                for j in range(self.SPAN):
                    dx[:, j:j + steps] += dw[:, :, j]
                grad["embed"] = np.zeros_like(self.embed)
                np.add.at(grad["embed"], codes[at], dx)
                t += 1
                for k2 in names:
                    m[k2] = 0.9 * m[k2] + 0.1 * grad[k2]
                    v[k2] = 0.999 * v[k2] + 0.001 * grad[k2] ** 2
                    step = rate * (m[k2] / (1 - 0.9**t)) / (np.sqrt(v[k2] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k2, getattr(self, k2) - step)

    def calibrate(self, x: np.ndarray, label: np.ndarray, recall: float, decided: np.ndarray, floor: float = 0.0) -> None:
        """Platt scaling and the threshold, on the margins of held-out findings;
        ``decided``: those that no rule finds. Recall and precision are of these."""
        a, b = 1.0, 0.0
        target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))

        def loss(a: float, b: float) -> float:
            return float((np.logaddexp(0, a * x + b) - target * (a * x + b)).sum())

        for _ in range(50):  # Newton's method on two parameters, steps halved until they help
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * x).sum(), (p - target).sum()])
            step = np.linalg.solve(np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]]), g)
            while loss(a - step[0], b - step[1]) > loss(a, b) and abs(step).max() > 1e-9:
                step = step / 2
            a, b = a - step[0], b - step[1]
        self.slope, self.offset = float(a), float(b)
        p = self.scaled(x)
        p, label = p[decided], label[decided]
        self.threshold = max(floor, float(np.quantile(p[label > 0], 1 - recall, method="lower")))
        found = p >= self.threshold
        self.held_out_recall = float(found[label > 0].mean())
        self.held_out_precision = float(label[found].mean()) if found.any() else 0.0


# -- labelled findings --------------------------------------------------------------------------


def generated_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys of well-known shapes, and look-alikes."""
    r = np.random.default_rng(seed)
    up, low, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    any_ = up + low + digit
    draw = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    word = lambda: draw(low, int(r.integers(2, 9)))
    pick = lambda xs: xs[int(r.integers(0, len(xs)))]
    secrets = [lambda: "ghp_" + draw(any_, 36), lambda: "xoxb-" + draw(digit, 11) + "-" + draw(any_, 24), lambda: "sk_live_" + draw(any_, 24),
               lambda: "AIza" + draw(any_ + "_-", 35), lambda: "eyJ" + draw(any_ + "_-", 40), lambda: draw(any_ + "+/", 40), lambda: draw(any_, int(r.integers(20, 45))),
               lambda: "ASIA" + draw(up + digit, 16), lambda: draw("ABCDEF" + digit, 32), lambda: "glpat-" + draw(any_, 20)]
    others = [lambda: f"{word()}_{word()}_{draw(digit, 3)}", lambda: f"{word()}-{word()}-{draw(digit, 4)}", lambda: f"{word()}/{word()}/{word()}{draw(digit, 2)}",
              lambda: f"v{draw(digit, 2)}-{draw(digit, 4)}-{word()}", lambda: draw(digit, 10) + word(), lambda: f"{word()}{word()}{word()}{draw(digit, 1)}",
              lambda: "-".join([draw(digit, 4), draw(digit, 2), draw(digit, 2)]) + "T" + draw(digit, 2), lambda: "=" * 12 + draw(digit, 1) + word(),
              lambda: f"{word().upper()}-{draw(digit, 4)}-{draw(digit, 4)}", lambda: f"{word()}_" * 3 + draw(digit, 2)]
    out = []
    for i in range(n):
        label = i % 2
        value = pick(secrets if label else others)()
        before = " ".join(word() for _ in range(int(r.integers(0, 6))))
        lead = pick(["", "", " ", ": ", " = ", " key=", ' "', " Bearer ", " id: ", "\n"])
        text = before + lead + value + pick(["", ".", " ", '"', "\n", ", "]) + " ".join(word() for _ in range(int(r.integers(0, 6))))
        start = len(before) + len(lead)
        out.append((text, start, start + len(value), label))
    return out


def generated_long(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Windows of long key-like runs: of paths, queries and identifiers none is
    a secret; where a key stands in such a run, windows mostly in it are."""
    r = np.random.default_rng(seed + 1)
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    keys = [(t[a:b]) for t, a, b, label in generated_findings(2 * n, seed + 2) if label and b - a >= 20]
    pick = lambda xs: xs[int(r.integers(0, len(xs)))]
    word = lambda: pick([str.lower, str.lower, str.title, str.upper])("".join(pick(low) for _ in range(int(r.integers(2, 10)))))
    number = lambda: "".join(pick(digit) for _ in range(int(r.integers(1, 6))))
    rule = lambda: pick("=-_") * int(r.integers(5, 60))

    def run(least: int) -> str:
        marks, out = pick(["/", "/", "-", "_", "/-", "/_=", "=", "+"]), ""
        while len(out) < least:
            out += (word() if r.random() < 0.75 else number() if r.random() < 0.8 else rule()) + pick(marks)
        return out

    out = []
    for i in range(n):
        ahead, key, after = run(int(r.integers(20, 90))), pick(keys) if i % 2 else "", pick(["", "", "/" + run(30)])
        before, text = pick(["", "see ", "at: ", '"']), ahead + key + after
        a, b = len(before) + len(ahead), len(before) + len(ahead) + len(key)
        whole = before + text + pick([" and", ".", '"', "", "\n"])
        for x, y in windows(len(before), len(before) + len(text)):
            inside = min(b, y) - max(a, x) if key else 0
            if inside <= 0 or inside >= min(len(key), PART) * 3 // 4:
                out.append((whole, x, y, int(inside > 0)))
    return out


def corpus_findings(texts: list[str]) -> list[tuple[str, int, int, int]]:
    """Findings in texts: the rules' values are secrets; other candidates are
    none, but those right after a keyword of the rules and those of known shapes
    of keys are left out."""
    out = []
    for text in texts:
        rules = rule_spans(text)
        for a, kind, b in rules:
            if kind == 0:
                a = next(m.start(2) for m in [ASSIGN.match(text, a)])
            out.append((text, a, b, 1))
        for a, b in candidates(text, rules):
            if not KNOWN.search(text, a, b) and not re.search(r"(?i:password|passwd|secret|token|api_?key)\W*$", text[max(0, a - 20):a]):
                out.append((text, a, b, 0))
    return out


def train(findings: list[tuple[str, int, int, int]], seed: int = 5, recall: float = 0.95, floor: float = 0.0) -> Network:
    """A network for findings; a quarter of the texts is held out. Every window
    of a finding is learned; held out, a finding counts by its best window."""
    order = {t: k for k, t in enumerate(sorted({x[0] for x in findings}))}
    texts = np.array([order[x[0]] for x in findings])
    held = (np.random.default_rng(seed).permutation(texts.max() + 1) < (texts.max() + 1) // 4)[texts]
    label = np.array([x[3] for x in findings], float)
    parts = [windows(a, b) for _, a, b, _ in findings]
    of = np.repeat(np.arange(len(findings)), list(map(len, parts)))
    codes = np.array([encode(t, x, y) for (t, *_), some in zip(findings, parts, strict=True) for x, y in some])
    net = Network.new(seed)
    net.fit(codes[~held[of]], label[of][~held[of]], seed)
    margin = np.full(len(findings), -np.inf)
    np.maximum.at(margin, of[held[of]], net.margin(codes[held[of]]))
    ruled = {t: rule_spans(t) for t in {x[0] for x in findings}}
    decided = np.array([not any(x < b and a < y for x, _, y in ruled[t]) for t, a, b, _ in findings])
    net.calibrate(margin[held], label[held], recall, decided[held], floor)
    return net


def trained(docs: DataFrame, sample_rows: int = 1000, most_findings: int = 4000, generated: int = 4000, seed: int = 5, recall: float = 0.95, floor: float = 0.5) -> Network:
    """A network for ``docs``. With ``floor`` 0 its threshold keeps the recall
    whatever the probability. Its labelled findings are bounded: at most
    ``sample_rows`` rows (those of least hash of the doc_id, so the same at
    every run), of which ``most_findings`` findings, and ``generated`` ones."""
    rows = id_and_text(docs)
    order = F.xxhash64(F.lit(seed), "doc_id")
    ids = [x[0] for x in rows.select("doc_id").where("doc_id is not null").orderBy(order, "doc_id").limit(sample_rows).collect()]
    texts = [x[0] for x in rows.where(F.col("doc_id").isin(ids)).select("text").limit(2 * sample_rows).collect()] if ids else []
    return train(generated_findings(generated, seed) + generated_long(generated // 8, seed) + corpus_findings(sorted(texts))[:most_findings], seed, recall, floor)


# -- the scan --------------------------------------------------------------------------


MOST_READ = 4096  # windows encoded at a time


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_parts(text: str, start: int, end: int, a: int, b: int) -> tuple[int, int]:
    """(a, b) grown within the run (start, end) so that no part between / and = is cut."""
    ahead, after = re.search(r"[^/=]*$", text[start:a]), re.match(r"[^/=]*", text[b:end])
    return a - len(ahead[0]), b + len(after[0])


def spans_of(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text; kind 3 is the network's."""
    rules = [rule_spans(t) for t in texts]
    seen = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, rules[i])]
    parts = [windows(a, b) for _, a, b in seen]
    first = np.cumsum([0, *map(len, parts)])
    read = [(i, a, b) for (i, _, _), some in zip(seen, parts, strict=True) for a, b in some]
    p = np.concatenate([np.zeros(0), *(net.probability(np.array([encode(texts[i], a, b) for i, a, b in read[k:k + MOST_READ]])) for k in range(0, len(read), MOST_READ))])
    for (i, a, b), some, at in zip(seen, parts, first, strict=False):
        hit = [x for x, q in zip(some, p[at:at + len(some)], strict=True) if q >= net.threshold]
        if hit and b - a <= WIDTH - BEFORE:
            rules[i].append((a, len(KINDS), b))
        elif hit:
            rules[i] += [(x, len(KINDS), y) for x, y in united([whole_parts(texts[i], a, b, *x) for x in hit])]
    return [sorted(x) for x in rules]


NAMES = (*KINDS, MODEL)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """Counts and spans for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of(batch.column("text").to_pylist(), net)
            count = lambda k: pa.array([sum(x[1] == k for x in s) for s in found], pa.int64())
            base = [hashlib.sha256(_listed([x for x in s if x[1] < len(KINDS)]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array(list(map(_listed, found)), pa.string()), count(3)],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return id_and_text(docs).mapInArrow(run, SCAN)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the union of the spans replaced; touching spans are one."""
    out, at = [], 0
    last = -1
    for a, _, b in sorted(spans):
        if a > last:
            out += [text[at:a], mark]
        at = last = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars``, if there,
    counted anew); rows without findings stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = spans_of([t or "" for t in texts], net)
            new = [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            cols = {"text": new}
            if "n_chars" in batch.schema.names:
                cols["n_chars"] = [len(t) if s else n for t, s, n in zip(new, found, batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, trained(docs, floor=0.0))
