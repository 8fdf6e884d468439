"""Secret scanning: candidate strings, judged by a random forest trained on labelled findings.

Candidates are long runs of token characters with a digit, with a known prefix, of mixed case
or after a word like bearer or credential, and values assigned to words like password or
token. The forest sees a candidate's length, how its characters follow one
another, how far dictionary words cover it, whether it is or lies in a path, and the words
beside it. Character transitions and the dictionary are counted by Spark over all documents:
transitions of 64 symbols, and words by hashed number, of which those with at least
1 / FREQUENT of the corpus's words form the dictionary, FREQUENT at most. The labelled
findings are made by ``labelled_findings`` from a seed unless others are given.

Defined cases: a null text is empty and has no findings; overlapping candidates count once,
the first and longest; rows that repeat a doc_id are scanned each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, scratch_table, worker_store
from cladeflow.llm.quality import alphabet

MIN_RUN, MIN_VALUE = 16, 6
FREQUENT, BUCKET_BITS = 5000, 20
TREES, DEPTH, MIN_LEAF, SEED, THRESHOLD = 60, 10, 2, 11, 0.5
#: Labelled findings that the forest is fitted on.
TRAIN_FINDINGS = 6000
MASK = "[SECRET]"
SPANS = "array<struct<start:int,end:int,score:double>>"
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential")
DIGESTS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "revision", "etag", "uuid", "id", "isbn", "build", "version")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "SG.")
_RUN = re.compile(rb"[A-Za-z0-9+/_=\-.~]{%d,}" % MIN_RUN)
_VALUE = re.compile(rb"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)\"?'?[ \t]*[:=][ \t]*[\"']?([^\s\"',;<>|]{%d,})" % MIN_VALUE)
_AFTER = re.compile(rb"(?i)\b(?:auth|authorization|bearer|basic|credentials?)[\"']?[ \t]*[:=]?[ \t]*[\"']?([A-Za-z0-9+/_=\-.~]{%d,})" % MIN_RUN)
_MIXED = re.compile(rb"[a-z][A-Z]|[A-Z]{2}[a-z]")
_HINT = re.compile(rb"(?i)passw|pwd|secret|token|key")
_AFTER_HINT = re.compile(rb"(?i)auth|bearer|basic|credential")
_PREFIXES = re.compile(rb"(?<![A-Za-z0-9])(?:%s)" % b"|".join(re.escape(x.encode()) for x in PREFIXES))
_WORD = re.compile(rb"[A-Za-z]+")
_OF = alphabet()


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of candidates, in order and apart."""
    found = []
    if len(text) >= MIN_RUN:
        found += [m.span() for m in _RUN.finditer(text) if likely(m[0])]
        if _AFTER_HINT.search(text):
            found += [m.span(1) for m in _AFTER.finditer(text)]
    if _HINT.search(text):
        found += [m.span(1) for m in _VALUE.finditer(text)]
    found.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def likely(run: bytes) -> bool:
    """Whether a run may be a key: it has a digit, a case that changes within a word other than at its start, or a known prefix."""
    return any(48 <= c <= 57 for c in run) or _MIXED.search(run) is not None or _PREFIXES.search(run) is not None


@dataclass
class Corpus:
    """log probability of each symbol after each, and the hashed numbers of the dictionary's words."""

    transitions: np.ndarray
    words: frozenset[int] = field(default_factory=frozenset)

    def known(self, word: bytes) -> bool:
        return zlib.crc32(word) >> (32 - BUCKET_BITS) in self.words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_store("secrets")
    pairs, words, numbers = np.zeros(4096, dtype=np.int64), np.zeros(1 << BUCKET_BITS, dtype=np.int64), {}
    for batch in batches:
        texts = batch.column(0).to_pylist()
        s = _OF[np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)]
        pairs += np.bincount((s[:-1] << np.uint32(6)) | s[1:], minlength=4096)
        for text in texts:
            split = text.lower().split()
            for w in set(split).difference(numbers):
                numbers[w] = zlib.crc32(w.strip(b".,;:!?\"'()")) >> (32 - BUCKET_BITS)
            at = np.fromiter(map(numbers.__getitem__, split), dtype=np.int64, count=len(split))
            if len(numbers) > 300_000:
                numbers = {}
            np.add.at(words, at, 1) if len(at) < 1000 else words.__iadd__(np.bincount(at, minlength=1 << BUCKET_BITS))
    for first, n in ((0, pairs), (4096, words)):
        at = np.flatnonzero(n)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000] + first), pa.array(n[at[k : k + 100_000]])], ["cell", "n"])


def corpus_statistics(docs: DataFrame) -> Corpus:
    """Counts over all of docs; what reaches the driver is 4096 cells and FREQUENT words at most."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(_count, "cell long, n long")
    cells = scratch_table(rows.groupBy("cell").agg(F.sum("n").alias("n")), "secret-cells")
    total = cells.filter("cell >= 4096").agg(F.sum("n")).first()[0] or 0
    got = cells.filter((F.col("cell") < 4096) | (F.col("n") >= max(2.0, total / FREQUENT))).collect()
    pairs = np.full(4096, 0.5)
    words = set()
    for r in got:
        if r["cell"] < 4096:
            pairs[r["cell"]] += r["n"]
        else:
            words.add(r["cell"] - 4096)
    table = pairs.reshape(64, 64)
    return Corpus(np.log(table / table.sum(1, keepdims=True)), frozenset(words))


def coverage(data: bytes, corpus: Corpus) -> float:
    """Share of a candidate that dictionary words of three letters or more cover, taken longest first from the left."""
    covered = 0
    for m in _WORD.finditer(data):
        part, i = m[0].lower(), 0
        while i + 3 <= len(part):
            step = next((k for k in range(min(12, len(part) - i), 2, -1) if corpus.known(part[i : i + k])), 0)
            covered += step
            i += step or 1
    return covered / max(len(data), 1)


def describe(text: bytes, start: int, end: int, corpus: Corpus) -> list[float]:
    """The features of a candidate."""
    data = text[start:end]
    before, after = text[max(0, start - 60) : start], text[end : end + 30]
    n = len(data)
    s = _OF[np.frombuffer(b" " + data, dtype=np.uint8)]
    steps = corpus.transitions[s[:-1], s[1:]]
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / n
    kinds = np.array([0 if 48 <= c <= 57 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 for c in data])
    words = re.findall(rb"[a-z0-9_\-]+", before.lower())[-3:]
    near = b" ".join(words).decode()
    tight = before.rstrip(b" \t\"'")
    text_data = data.decode("utf-8", "replace")
    return [
        float(n), float(steps.mean()), float(steps.min()), coverage(data, corpus), float(-(p * np.log2(p)).sum()),
        float((kinds == 0).mean()), float((kinds == 1).mean()), float((kinds == 2).mean()), float((kinds == 3).mean()), float((np.diff(kinds) != 0).mean()) if n > 1 else 0.0,
        float(bool(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", data))), float(data.count(b"/") + data.count(b".")), float(before.endswith((b"/", b"://", b"@", b"\\")) or after[:1] in (b"/", b"@") or b"://" in before[-12:]),
        float(any(k in near for k in KEYWORDS)), float(any(w in DIGESTS for w in near.split())), float(tight[-1:] in (b"=", b":")), float(before[-1:] in (b'"', b"'")),
        float(text_data.startswith(PREFIXES)), float(counts.max() / n), float(len(set(data)) / n), float(bool(re.fullmatch(rb"[0-9.\-/:+]+", data))), float(bool(re.search(rb"(?i)x{4}|example|sample|your|changeme|placeholder|dummy|todo|test|0000|1234", data))),
    ]


def labelled_findings(n: int = TRAIN_FINDINGS, seed: int = SEED) -> list[tuple[bytes, int, int, int]]:
    """n findings as (text, start, end, label): random keys in the ways they are written, and things like them that are not secret."""
    rng = random.Random(seed)
    syllables = ("an", "ble", "con", "de", "er", "for", "ing", "ly", "ment", "on", "pre", "re", "st", "the", "tion", "un", "wh", "es", "que", "al", "or", "en")
    hexs = "0123456789abcdef"
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def some(chars: str, k: int) -> str:
        return "".join(rng.choice(chars) for _ in range(k))

    def word(k: int | None = None) -> str:
        return "".join(rng.choice(syllables) for _ in range(k or rng.randint(1, 4)))

    def prose() -> str:
        return " ".join(word() for _ in range(rng.randint(2, 8)))

    def key() -> str:
        return rng.choice(
            (
                lambda: some(hexs, rng.choice((32, 40, 40, 48, 64))),
                lambda: some(alnum, rng.randint(16, 48)),
                lambda: base64.b64encode(rng.randbytes(rng.randint(15, 48))).decode(),
                lambda: rng.choice(("AKIA", "ghp_", "sk-", "sk_live_", "xoxb-", "AIza", "npm_", "glpat-")) + some(alnum, rng.randint(16, 40)),
                lambda: f"{some(hexs, 8)}-{some(hexs, 4)}-{some(hexs, 4)}-{some(hexs, 4)}-{some(hexs, 12)}",
                lambda: some(alnum + "!@#$%^&*", rng.randint(8, 20)),
                lambda: some(rng.choice((alnum[:52], alnum[:52], alnum[:26])), rng.randint(16, 40)),
            )
        )()

    def prefixed() -> str:
        return rng.choice((lambda: rng.choice(("AKIA", "ASIA")) + some(alnum[26:52] + "234567", 16), lambda: rng.choice(("AKIA", "ASIA")) + some(alnum[26:52], 16), lambda: rng.choice(("ghp_", "sk-", "AIza", "npm_")) + some(alnum[:52], rng.randint(16, 36))))()

    def given() -> str:
        return rng.choice(("password", "passwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "auth_token", "client_secret", "PASSWORD", "TOKEN", "API_KEY", "secret_key"))

    def plain() -> tuple[str, str]:
        return rng.choice(
            (
                lambda: (rng.choice(("sha256 ", "sha1: ", "md5 = ", "commit ", "checksum: ", "etag: ", "revision ")), some(hexs, rng.choice((32, 40, 64)))),
                lambda: ("https://" + word() + ".org/", "/".join(word(3) for _ in range(3)) + f"/{rng.randint(1, 9999)}.html"),
                lambda: ("/usr/" + word() + "/", f"{word(3)}-{rng.randint(1, 9)}.{rng.randint(0, 99)}.{word()}.{word()}"),
                lambda: (rng.choice((" ", "id ", "no. ", "tel ")), some("0123456789", rng.randint(16, 22))),
                lambda: (given() + rng.choice((" = \"", "=", ": ")), rng.choice(("x" * rng.randint(8, 24), "your_" + word(2) + "_here_1", "changeme" + some("0123456789", 3), "example-" + word(2) + "-0000", "placeholder_" + word(2), "<" + word(3) + ">", "test1234test1234"))),
                lambda: (given() + rng.choice((": ", " = ", " is: ")), word(rng.randint(3, 6))),
                lambda: (" ", word(4) + str(rng.randint(1, 999)) + word(3)),
                lambda: ("uuid ", f"{some(hexs, 8)}-{some(hexs, 4)}-{some(hexs, 4)}-{some(hexs, 4)}-{some(hexs, 12)}"),
                lambda: ("on ", f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:30:00.000"),
                lambda: ("mail ", f"{word(3)}.{word(2)}{rng.randint(1, 99)}"),
                lambda: (" ", "-".join(word(2) for _ in range(4)) + f"-{rng.randint(1, 99)}"),
                lambda: (rng.choice((" ", "the ", "class ")), "".join(word(2).title() for _ in range(rng.randint(3, 5)))),
                lambda: (rng.choice(("basic ", "authorization ", "credential ", "auth: ")), rng.choice(("-", "", "_", ".")).join(word(3) for _ in range(rng.randint(2, 4)))),
            )
        )()

    out = []
    for k in range(n):
        if k % 10 == 1:
            lead, value = rng.choice(("", "id ", "the key ", "https://" + word() + ".org/get?k=")), prefixed()
        elif k % 2:
            lead = given() + rng.choice((" = \"", "=", ": ", " = '", "=\"", " : ")) if rng.random() < 0.8 else rng.choice(("Authorization: Bearer ", "export AWS_SECRET_ACCESS_KEY=", "credential ", "//user:"))
            value = key()
        else:
            lead, value = plain()
        head = (prose() + rng.choice((" ", ".\n", ", ")) + lead).encode()
        tail = (rng.choice(("\"", "'", "", "", ".")) + rng.choice((" ", "\n")) + prose()).encode()
        out.append((head + value.encode() + tail, len(head), len(head) + len(value.encode()), k % 2))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (or -1), threshold, children and share of positives of each node."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        tries = max(1, int(np.sqrt(x.shape[1])) + 1)
        trees = []
        for _ in range(n_trees):
            own = rng.integers(0, len(y), len(y))
            nodes: list[list] = []

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                share = float(y[rows].mean())
                nodes.append([-1, 0.0, -1, -1, share])
                if level >= depth or len(rows) < 2 * MIN_LEAF or share in (0.0, 1.0):
                    return at
                best = (1e-9, -1, 0.0)
                parent = share * (1 - share)
                for f in rng.permutation(x.shape[1])[:tries].tolist():
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v, up = x[order, f], np.cumsum(y[order])
                    n_low = np.arange(1, len(rows))
                    ok = (v[1:] > v[:-1]) & (n_low >= MIN_LEAF) & (n_low <= len(rows) - MIN_LEAF)
                    if not ok.any():
                        continue
                    a, b = up[:-1] / n_low, (up[-1] - up[:-1]) / (len(rows) - n_low)
                    gain = np.where(ok, parent - (n_low * a * (1 - a) + (len(rows) - n_low) * b * (1 - b)) / len(rows), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        middle = float((v[k] + v[k + 1]) / 2)
                        best = (float(gain[k]), f, middle if middle < v[k + 1] else float(v[k]))  # of two floats side by side, the lower
                if best[1] < 0:
                    return at
                low = x[rows, best[1]] <= best[2]
                nodes[at][:2] = best[1], best[2]
                nodes[at][2] = grow(rows[low], level + 1)
                nodes[at][3] = grow(rows[~low], level + 1)
                return at

            grow(own, 0)
            trees.append(tuple(np.array(c) for c in zip(*nodes)))
        return cls(trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives over the trees."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, low, high, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go, low[at], high[at]), at)
            total += share[at]
        return total / len(self.trees)


@dataclass
class Scanner:
    corpus: Corpus
    forest: Forest
    threshold: float = THRESHOLD

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, float]]]:
        """The candidates of each text with their scores."""
        spans = [candidates(t) for t in texts]
        flat = [describe(t, a, b, self.corpus) for t, s in zip(texts, spans) for a, b in s]
        score = iter(self.forest.predict(np.array(flat)).tolist() if flat else ())
        return [[(a, b, next(score)) for a, b in s] for s in spans]

    def redact(self, text: bytes, found: list[tuple[int, int, float]]) -> bytes:
        """The text with a mask in the place of each finding (start, end, score), in order and apart, that scores high enough."""
        parts, at = [], 0
        for a, b, score in found:
            if score >= self.threshold:
                parts += [text[at:a], MASK.encode()]
                at = b
        return b"".join([*parts, text[at:]])


def train(docs: DataFrame, findings: list[tuple[bytes, int, int, int]] | None = None) -> Scanner:
    """Count the corpus and fit the forest on labelled findings (text, start, end, label)."""
    corpus = corpus_statistics(docs)
    known = findings if findings is not None else labelled_findings()
    x = np.array([describe(t, a, b, corpus) for t, a, b, _ in known])
    return Scanner(corpus, Forest.fit(x, np.array([k for *_, k in known], dtype=float)))


def _found(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("secrets")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scanned = scanner.scan(texts)
            n = pa.array([len(s) for s in scanned], pa.int32())
            hits = [[{"start": a, "end": b, "score": p} for a, b, p in s if p >= scanner.threshold] for s in scanned]
            sha = [hashlib.sha256(scanner.redact(t, s)).hexdigest() for t, s in zip(texts, scanned)]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([len(h) for h in hits], pa.int32()), pa.array(hits, kind), pa.array(sha, pa.string())], ["doc_id", "n_candidates", "n_secrets", "findings", "redacted_sha256"])

    return run


def secret_scan(docs: DataFrame, findings: list[tuple[bytes, int, int, int]] | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, findings (byte spans and scores) and the redacted text's sha256 of every row of docs."""
    scanner = train(docs, findings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_found(scanner), f"doc_id long, n_candidates int, n_secrets int, findings {SPANS}, redacted_sha256 string")


def redacted(scanner: Scanner, text: Column) -> Column:
    """A text column with its secrets masked; null stays null."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        worker_store("secrets")
        data = [t.encode() for t in texts.fill_null("").to_pylist()]
        out = [scanner.redact(t, s).decode() for t, s in zip(data, scanner.scan(data))]
        return pa.array([None if gone else t for gone, t in zip(texts.is_null().to_pylist(), out)], pa.string())

    return mask(text)
