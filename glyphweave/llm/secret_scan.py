"""Secret scan: a pattern proposes candidates, a random forest drops false positives.

The forest looks at a candidate's length, its character transitions, how much of it
dictionary words cover, the path it was found in, and the words beside it. It is
trained from labelled findings.
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

CANDIDATE = re.compile(r"[A-Za-z0-9_\-+/=.]{12,}")
#: What is assigned: a quoted value to its closing quote, else a run without white space, quotes and angles.
ASSIGNED = re.compile(r"""[=:][ \t]{0,3}(?:"([^"\r\n]{8,})"|'([^'\r\n]{8,})'|([^\s"'<>]{8,}))""")
#: Characters looked at on either side of a candidate.
BESIDE = 48
FINDING_SCHEMA = "candidate string, before string, after string, path string, label int"
#: At most so many labelled findings are used to fit the forest.
FINDINGS = 20_000

#: Words of identifiers and prose that cover non-secret candidates.
DICTIONARY = frozenset(
    """access account action admin agent align animal answer api apple application archive array article asset audio author
    auto backup base beta black block blue board body book border bottom box branch bridge browser buffer build button cache
    call camera card center change channel char check child city class clear click client clone cloud code color column
    command comment common company config connect console content control copy core count country create current custom data
    date day debug default delete demo design detail device dialog disk display document domain down draft drive edit email
    engine entry error event example export feature field file filter final find first float folder font footer form format
    frame from function game general get global graph green group guide handler hash header height help hidden home host hour
    html http https icon image import index info input insert install int item java job join json key label language large
    last layout left length level library light line link list local lock login logo long main manager map mask master media
    member memory menu message meta method mobile mode model module month mouse move name native network news next node note
    number object offset open option order origin output package page panel param parent part path pattern phone photo place
    platform play plugin point policy port post power press preview print private process product profile program project
    proto public query queue random range read record red region release remote remove render report request reset resource
    response result return right role root route row rule sample save scale schema scope score screen script scroll search
    second section select send sequence server service session setting shadow shape share shell show side sign simple single
    site size small sort sound source space spec start state static status step stop store story stream string style submit
    summary support switch symbol system tab table target task team template term test text theme thread time title today tool
    top total track tree type under unit update upload user util value vector version video view warning web week width window
    word work world write year your""".split()
)
_SECRET_WORDS = ("token", "secret", "passw", "pwd", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "access_key", "access-key", "signing")
_HASH_WORDS = ("sha", "md5", "commit", "checksum", "digest", "integrity", "hash", "revision", "uuid", "guid", "etag", "fingerprint", "blob", "phone", "order", "serial", "card", "isbn")
_MOCK_WORDS = ("example", "sample", "test", "dummy", "fake", "placeholder", "your", "mock", "todo", "changeme", "xxxx")
_TEST_PATHS = ("test", "spec", "fixture", "example", "mock", "doc", "sample", "lock", "vendor", "min.js", ".map")
_KINDS = np.zeros(256, np.int8)  # 0 sign, 1 lower, 2 capital, 3 digit
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3


def _coverage(candidate: str) -> float:
    """The share of letters that dictionary words or vowelled runs of letters cover."""
    runs = re.findall(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}", candidate)
    letters = sum(c.isalpha() for c in candidate)
    covered = 0
    for run in map(str.lower, runs):
        at = 0
        while at < len(run):
            size = next((n for n in range(min(14, len(run) - at), 2, -1) if run[at : at + n] in DICTIONARY), 0)
            covered += size
            at += size or 1
        if run not in DICTIONARY and len(run) >= 5 and 0.2 <= sum(c in "aeiouy" for c in run) / len(run) <= 0.65:
            covered += len(run) / 2
    return min(1.0, covered / letters) if letters else 1.0


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    """Numbers for the forest; null parts are empty."""
    raw = np.frombuffer(candidate.encode(), np.uint8)
    kinds = _KINDS[raw]
    n = len(raw)
    pairs = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16)[:16] / max(n - 1, 1)
    counts = np.bincount(raw, minlength=256)
    shares = counts[counts > 0] / n
    entropy = float(-(shares * np.log2(shares)).sum())
    near, place = before.lower(), path.lower()
    assigned = re.search(r"[=:]\s*[\"'`]?$", before)
    return [
        float(n),
        *pairs.tolist(),
        entropy,
        float((kinds[1:] != kinds[:-1]).sum()) / max(n - 1, 1),
        float((kinds == 3).mean()),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate) is not None),
        float(max(len(x) for x, _ in re.findall(r"(?s)((.)\2*)", candidate)) / n),
        _coverage(candidate),
        float(sum(c in "./" for c in candidate)),
        float(any(w in near[-24:] for w in _SECRET_WORDS)),
        float(any(w in near for w in _SECRET_WORDS)),
        float(any(w in near[-32:] for w in _HASH_WORDS)),
        float(any(w in near or w in candidate.lower() for w in _MOCK_WORDS)),
        float(assigned is not None),
        float(before[-1:] in "\"'`" and before[-1:] != "" and after[:1] == before[-1:]),
        float(any(w in place for w in _TEST_PATHS)),
        float(before[-1:] in "@" and before[-1:] != "" or after[:1] in "@" and after[:1] != ""),
        float(re.fullmatch(r"[\d.\-+]+", candidate) is not None),
    ]


@dataclass
class Forest:
    """Trees as arrays of nodes; a leaf has itself below."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    below: list[np.ndarray]
    share: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, below, share in zip(self.feature, self.cut, self.below, self.share, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                down = below[at, (x[np.arange(len(x)), feature[at]] > cut[at]).astype(np.int64)]
                if (down == at).all():
                    break
                at = down
            total += share[at]
        return total / max(len(self.feature), 1)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 9, least: int = 3, seed: int = 5) -> Forest:
    """Bagged trees on random features, split by Gini impurity. No rows give a forest that scores 0."""
    rng = np.random.default_rng(seed)
    forest = Forest([], [], [], [])
    for _ in range(trees if len(y) else 0):
        rows = rng.integers(0, len(y), len(y))
        nodes: list[tuple[int, float, list[int], float]] = []

        def grow(mine: np.ndarray, level: int, nodes=nodes) -> int:
            here, labels = len(nodes), y[mine]
            nodes.append((0, 0.0, [here, here], float(labels.mean())))
            if level == depth or labels.min() == labels.max():
                return here
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False).tolist():
                order = np.argsort(x[mine, f], kind="stable")
                v, ones = x[mine, f][order], np.cumsum(labels[order])
                n = np.arange(1, len(v) + 1)
                place = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (len(v) - n[:-1] >= least))
                if not len(place):
                    continue
                left, all_ones = ones[place], ones[-1]
                nl, nr = n[place], len(v) - n[place]
                pure = left**2 / nl + (nl - left) ** 2 / nl + (all_ones - left) ** 2 / nr + (nr - all_ones + left) ** 2 / nr
                gain = pure - (all_ones**2 + (len(v) - all_ones) ** 2) / len(v)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[place[k]] + v[place[k] + 1]) / 2))
            if best[1] < 0:
                return here
            side = x[mine, best[1]] > best[2]
            below = [grow(mine[~side], level + 1), grow(mine[side], level + 1)]
            nodes[here] = (best[1], best[2], below, nodes[here][3])
            return here

        grow(rows, 0)
        f, c, b, s = zip(*nodes, strict=True)
        for to, part in zip((forest.feature, forest.cut, forest.below, forest.share), (f, c, b, s), strict=True):
            to.append(np.array(part))
    return forest


def sample_findings(spark: SparkSession, rows: int = 4000, seed: int = 3) -> DataFrame:
    """A made-up table of labelled findings, for use until reviewed ones are at hand.

    Half are random keys of usual shapes in credential assignments; half are hashes in
    other contexts, identifiers, words, paths, addresses, numbers and placeholders.
    """
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    text = lambda letters, n: "".join(pick(letters) for _ in range(n))
    hexes, digits, lower = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + digits
    words = sorted(DICTIONARY)
    prose = lambda: " ".join(pick(words) if rng.random() < 0.5 else text(lower, int(rng.integers(2, 11))) for _ in range(4))
    made = []
    for _ in range(rows // 2):
        key = pick([lambda: text(hexes, pick([32, 40, 40, 48, 64])), lambda: text(mixed, int(rng.integers(20, 49))), lambda: pick(["AKIA", "ASIA"]) + text(lower.upper() + digits, 16), lambda: pick(["ghp_", "gho_", "sk_live_", "xoxb-", "sk-"]) + text(mixed, 36)])()
        name = pick(["token", "secret", "api_key", "apikey", "password", "auth_token", "access_key", "client_secret", "bearer", "private_key"])
        mark, quote = pick([" = ", "=", ": ", ":"]), pick(['"', "'", '"', ""])
        if rng.random() < 0.3:  # passwords: words run together, or any signs
            signs = mixed + "!#$%&*+-?@^_~"
            key = pick([lambda: "".join(pick(words) for _ in range(int(rng.integers(3, 5)))) + pick(["", "", text(digits, 2)]), lambda: text(signs, int(rng.integers(10, 25))), lambda: pick(words).title() + text("!#$%&-@", 1) + text(signs, int(rng.integers(6, 12)))])()
            name = pick(["password", "passwd", "pwd", "db_password", "secret", "credential", "key", "auth", "token"])
        made.append((key, f"{prose()} {name}{mark}{quote}", f"{quote} {prose()}", pick(["", "src/app.py", "config/prod.env", "web", "src3"]), 1))
    for _ in range(rows - rows // 2):
        if rng.random() < 0.35:  # other values of assignments: words, prose, names of files, addresses, colours, types
            bad = pick([lambda: pick(words) + pick(words), prose, lambda: "/".join(pick(words) for _ in range(3)) + ".py", lambda: f"https://{pick(words)}.example.com/{pick(words)}", lambda: text(lower, int(rng.integers(8, 14))), lambda: pick(["required", "undefined", "optional string", "os.environ", "function()", "${ENV_NAME}", "settings.value"])])()
            name = pick(["title", "note", "name", "path", "file", "value", "text", "url", "see", "type", "label", *(["password", "token", "secret"] if bad in ("required", "undefined", "optional string", "os.environ", "function()", "${ENV_NAME}", "settings.value") else [])])
            quote = pick(['"', "", ""]) if " " not in bad else '"'
            made.append((bad, f"{prose()} {name}{pick([' = ', '=', ': ', ':'])}{quote}", f"{quote} {prose()}", pick(["", "src/app.py", "web", "docs/use.md"]), 0))
            continue
        kind, before, after, path = int(rng.integers(9)), prose() + " ", " " + prose(), pick(["", "src/app.py", "web", "src5", "tests/data.json", "package-lock.json"])
        if kind == 0:
            bad, before = text(hexes, pick([32, 40, 40, 64])), before + pick(["commit ", "sha256:", "md5 = ", "checksum: ", "integrity=", "revision "])
        elif kind == 1:
            bad = "-".join(text(hexes, n) for n in (8, 4, 4, 4, 12))
            before += pick(["uuid ", "id: ", ""])
        elif kind == 2:
            bad = pick(["_", "-", "."]).join(pick(words) for _ in range(int(rng.integers(3, 6))))
            before += pick(["token = ", "name: ", "", "key="])
        elif kind == 3:
            bad = "/".join(["", *(pick(words) for _ in range(4))]) + pick(["", ".py", ".html"])
        elif kind == 4:
            bad = text(digits, int(rng.integers(12, 20)))
        elif kind == 5:
            bad = ".".join(str(int(rng.integers(10, 256))) for _ in range(4))
        elif kind == 6:
            bad = pick(["YOUR_API_KEY_HERE", "xxxxxxxxxxxxxxxxxxxx", "changeme-please-1", "example-token-12345", "REPLACE_WITH_TOKEN", "0000000000000000"])
            before += pick(["token = ", "password: ", "api_key="])
        elif kind == 7:
            bad = text("aeiou" + lower, int(rng.integers(12, 24))) + pick(["", ".", ","])
        else:
            bad, before, after = f"mail{int(rng.integers(9))}.{pick(words)}.com.example", before + pick(words) + ".31@", after
        made.append((bad, before, after, path, 0))
    return spark.createDataFrame(made, FINDING_SCHEMA)


def train(findings: DataFrame, rows: int = FINDINGS) -> Forest:
    """Fit on at most `rows` labelled findings (FINDING_SCHEMA), chosen by hash; null candidates and labels are left out."""
    known = findings.where("candidate is not null and label is not null and candidate <> ''")
    parts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("candidate", "before", "after", "path")]
    chosen = known.select(*parts, "label").orderBy(F.xxhash64("candidate", "before"), "candidate", "before", "after", "path").limit(rows)
    got = chosen.collect()
    x = np.array([features(r["candidate"], r["before"][-BESIDE:], r["after"][:BESIDE], r["path"]) for r in got]).reshape(len(got), -1)
    return fit_forest(x, np.array([r["label"] for r in got], float))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of what may be a secret, by where they begin; they may overlap.

    Long runs with a digit or both letter cases; every value of an assignment of eight characters or more,
    whatever its characters, without trailing stops, commas and brackets; and the longer parts of a value around "=".
    """
    found = set(_runs(text))
    for m in ASSIGNED.finditer(text):
        group = next(k for k in (1, 2, 3) if m[k] is not None)
        start, value = m.start(group), m[group]
        if group == 3:
            value = value.rstrip(".,;:)]}")
        parts = [(start, value)]
        if "=" in value.rstrip("="):
            at = start
            for part in value.split("="):
                parts.append((at, part))
                at += len(part) + 1
        found.update((at, at + len(part)) for at, part in parts if len(part) >= 8)
    yield from sorted(found)


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Long runs with a digit, or with both letter cases."""
    for m in CANDIDATE.finditer(text):
        word = m.group().rstrip(".=") if not m.group().endswith("==") else m.group()
        body = word.lstrip("=./-")
        start = m.start() + len(word) - len(body)
        if "=" in body.rstrip("="):  # name=value without spaces
            value = body.rstrip("=").rpartition("=")[2]
            start += len(body) - len(value) - (len(body) - len(body.rstrip("=")))
            body = value
        if len(body) >= 12 and (any(c.isdigit() for c in body) or (body != body.lower() and body[1:] != body[1:].lower() and not body.isupper())):
            yield start, start + len(body)


def scan_texts(texts: list[str | None], paths: list[str | None], forest: Forest, threshold: float) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of every candidate of each text, by one call of the forest."""
    found, rows = [], []
    for k, text in enumerate(texts):
        for a, b in candidates(text or ""):
            found.append((k, a, b))
            rows.append(features(text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE], paths[k] or ""))
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    if rows:
        for (k, a, b), s in zip(found, forest.score(np.array(rows)).tolist(), strict=True):
            out[k].append((a, b, s))
    return out


def findings(docs: DataFrame, forest: Forest, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """A row for each candidate of each row of `docs`: doc_id, start, length, score, is_secret, secret_sha256.

    Offsets count characters. `path` names the column with the place of origin; a
    missing column or null is empty. Null and empty texts have no candidates. Candidates may
    overlap; repeated rows are scanned each, ties of score have no order. Other columns are not read.
    """
    place = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place.alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            found = scan_texts(texts, batch.column("path").to_pylist(), shared.value, threshold)
            flat = [(ids[k], a, b - a, s, s >= threshold, hashlib.sha256(texts[k][a:b].encode()).hexdigest()) for k, spans in enumerate(found) for a, b, s in spans]
            cols = list(zip(*flat, strict=True)) if flat else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "score", "is_secret", "secret_sha256"]
            )

    return rows.mapInArrow(scan, "doc_id long, start long, length long, score double, is_secret boolean, secret_sha256 string")


def masked(docs: DataFrame, forest: Forest, path: str = "source", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every found secret in text replaced by `mark`; all rows and columns stay, repeated rows too.

    Null and empty texts stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = docs.columns
    place = "path_of_row" + "_" * max(map(len, names), default=0)  # longer than any other name
    rows = docs.select(*names, (F.col(path).cast("string") if path in names else F.lit("")).alias(place))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scan_texts(texts, batch.column(place).to_pylist(), shared.value, threshold)
            for k, spans in enumerate(found):
                secret: list[tuple[int, int]] = []
                for a, b, s in spans:  # by where they begin; overlapping ones are masked as one
                    if s >= threshold and secret and a <= secret[-1][1]:
                        secret[-1] = secret[-1][0], max(b, secret[-1][1])
                    elif s >= threshold:
                        secret.append((a, b))
                if secret:
                    kept = zip([0, *(b for _, b in secret)], [*(a for a, _ in secret), len(texts[k])], strict=True)
                    texts[k] = mark.join(texts[k][a:b] for a, b in kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names
            )

    return rows.mapInArrow(mask, docs.schema)
