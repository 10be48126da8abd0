"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of the characters of keys, and values that a text assigns to names of secrets; finding them takes
time in proportion to the text. The forest sees a candidate's length, its character transitions (log odds of character pairs
that the labelled findings give, and how like the dictionary's words they are), how much of it words of the dictionary
cover, its path, and the words beside it (log odds by hashed word, from the findings). The dictionary holds the words that
are more than one in DICTIONARY of those of all documents. Labelled findings are a parameter; by default `labelled_findings` plants
FINDINGS keys, hashes, ids, names and examples between words of the documents themselves, as no table has labels.

Defined results: a null or empty text has no candidate; a null path is the empty one; a run that overlaps an assigned value is
not a candidate of its own; repeated rows are each reported; a null doc_id is kept; an empty table has an empty result and
an empty dictionary; extra columns are ignored; texts and candidates of any length are read whole.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import forest
from glyphloom.llm._shared import bounded_sample, table

FINDINGS = 4_000
#: Places of documents, at most about so many, that findings are planted at.
PLACES = 2_000
#: The dictionary has the words that are more than one in so many.
DICTIONARY = 50_000
THRESHOLD = 0.5
CONTEXT = 48
#: Buckets of the words beside candidates.
BESIDE = 4096

#: Names of secrets, words of examples, and names of what is none.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer")
EXAMPLES = ("example", "sample", "dummy", "placeholder", "changeme", "test", "fake", "todo", "xxxx", "your", "redacted", "default")
OTHER_NAMES = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "etag", "revision", "integrity", "hash", "fingerprint", "image", "id", "url", "path", "file")

_NAMES = "|".join(NAMES)
_SET = r"[\w.\-]{0,40}[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?"
_VALUE = re.compile(rf"(?:{_NAMES}){_SET}(?P<value>[^\s\"'<>,;]{{8,}})", re.I)
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{20,}={0,2}")
#: What a text with a candidate has; read by Arrow, in linear time, over a whole batch.
_QUICK = rf"[A-Za-z0-9+/_\-]{{20}}|(?i:{_NAMES})"
_ASSIGNED = re.compile(rf"(?:{_NAMES}){_SET}$", re.I)
_OTHER = re.compile(rf"\b(?:{'|'.join(OTHER_NAMES)})\b[\"']?\s{{0,3}}[=:]?\s{{0,3}}[\"']?$", re.I)
_EXAMPLE = re.compile("|".join(EXAMPLES), re.I)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "distinct", "entropy", "changes", "hex_only", "vowels", "repeats", "pair_odds", "wordlike", "covered",
    "assigned", "other_name", "example_near", "example_within", "uuid", "words_before", "words_after", "test_path", "doc_path",
)

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
#: The symbols of transitions: each letter, upper and lower, each digit, and all else.
_SYMBOL = np.full(128, 62, np.int64)
_SYMBOL[[ord(c) for c in _LOWER + _LOWER.upper() + _DIGITS]] = np.arange(62)
_HEX = np.isin(np.arange(128), [ord(c) for c in "0123456789abcdefABCDEF"])
_VOWEL = np.isin(np.arange(128), [ord(c) for c in "aeiouAEIOU"])


@dataclass(frozen=True)
class Finding:
    value: str
    before: str
    after: str
    path: str
    real: bool


def _codes(value: str) -> np.ndarray:
    """The code points, those beyond ASCII as one mark."""
    return np.minimum(np.frombuffer(value.encode("utf-32-le"), np.uint32), 127).astype(np.int64)


def _pairs(codes: np.ndarray) -> np.ndarray:
    s = _SYMBOL[codes]
    return s[:-1] * 63 + s[1:]


def _pair_logs(values: list[str]) -> np.ndarray:
    """The logarithm of each pair's share, with one added to all counts."""
    counts = np.ones(63 * 63)
    for v in values:
        np.add.at(counts, _pairs(_codes(v)), 1)
    return np.log(counts / counts.sum())


def _beside(text: str, last: bool) -> list[int]:
    """Buckets of the three words next to a candidate."""
    words = _WORDS.findall(text.lower())
    return [zlib.crc32(w.encode()) % BESIDE for w in (words[-3:] if last else words[:3])]


class Evidence:
    """What features are computed from: the dictionary, transitions, and log odds of the words beside."""

    def __init__(self, words: list[str], findings: list[Finding]) -> None:
        self.words = ahocorasick.Automaton()
        for w in words:
            self.words.add_word(w, len(w))
        self.words.make_automaton()
        self.wordlike = _pair_logs(words)
        self.odds = _pair_logs([f.value for f in findings if f.real]) - _pair_logs([f.value for f in findings if not f.real])
        sides = []
        for last in (True, False):
            counts = np.ones((2, BESIDE))
            for f in findings:
                counts[int(f.real), _beside(f.before if last else f.after, last)] += 1
            counts /= counts.sum(1, keepdims=True)
            sides.append(np.log(counts[1] / counts[0]))
        self.before, self.after = sides

    def covered(self, value: str) -> int:
        """Characters within words of the dictionary, the longest at each place, one after another."""
        return sum(n for _, n in self.words.iter_long(value.lower())) if len(self.words) else 0

    def features(self, value: str, before: str, after: str, path: str) -> list[float]:
        """The FEATURES of a candidate between two pieces of text."""
        n, codes = len(value), _codes(value)
        symbols, pairs = _SYMBOL[codes], _pairs(codes)
        kinds = np.select([symbols < 26, symbols < 52, symbols < 62], [2, 1, 0], 3)
        shares = np.bincount(codes)
        shares = shares[shares > 0] / n
        of = np.bincount(kinds, minlength=4) / n
        mean = lambda x: float(x.mean()) if len(x) else 0.0
        return [
            n, *of.tolist(), len(shares) / n, float(-(shares * np.log2(shares)).sum()), mean(kinds[1:] != kinds[:-1]), float(_HEX[codes].all()), mean(_VOWEL[codes]), mean(codes[1:] == codes[:-1]),
            mean(self.odds[pairs]), mean(self.wordlike[pairs]), self.covered(value) / n,
            float(bool(_ASSIGNED.search(before))), float(bool(_OTHER.search(before))), float(bool(_EXAMPLE.search(before) or _EXAMPLE.search(after))), float(bool(_EXAMPLE.search(value))), float(bool(_UUID.fullmatch(value))),
            float(self.before[_beside(before, True)].sum()), float(self.after[_beside(after, False)].sum()),
            float("test" in path or "spec" in path or "fixture" in path), float(path.endswith((".md", ".rst", ".txt")) or "docs/" in path),
        ]


@dataclass
class Model:
    evidence: Evidence
    trees: forest.Forest

    def score(self, rows: list[tuple[str, str, str, str]]) -> np.ndarray:
        """For each value, text before, text after and path the share of trees that take it for a secret."""
        return self.trees.predict(np.array([self.evidence.features(*r) for r in rows], float).reshape(-1, len(FEATURES)))


def dictionary(documents: DataFrame, share: int = DICTIONARY) -> list[str]:
    """The words of 4 to 12 letters a-z that are more than one in `share` of such words of all documents: fewer than `share` of them."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\w)([a-z]{4,12})(?!\w)"))).alias("word"))
    counts = words.groupBy("word").count()
    total = counts.agg(F.sum("count").alias("total")).scalar()  # the sum reads the shuffle that the words come from
    return sorted(r["word"] for r in counts.where(F.col("count") * share > total).select("word").collect())


def places(documents: DataFrame, rows: int = PLACES) -> list[tuple[str, str]]:
    """Texts before and after a place between words, for about `rows` documents at most, chosen by the hash of their text."""
    text = documents.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text")).where("text != ''")
    at = F.pmod(F.xxhash64(F.lit("at"), "text"), F.length("text")).cast("int")
    cut = bounded_sample(text, "key", rows).withColumn("at", at).select(
        "key",
        F.regexp_replace(F.expr(f"substring(text, greatest(at - {CONTEXT}, 0) + 1, least(at, {CONTEXT}))"), r"\S+$", "").alias("before"),
        F.regexp_replace(F.expr(f"substring(text, at + 1, {CONTEXT})"), r"^\S+", "").alias("after"),
    )
    return [(r["before"], r["after"]) for r in cut.distinct().orderBy("key", "before", "after").collect()]


def labelled_findings(between: list[tuple[str, str]], words: list[str], n: int = FINDINGS, seed: int = 7) -> list[Finding]:
    """Findings with labels, planted between texts of documents: keys, tokens and passwords; hashes, ids, paths, names and examples."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(len(chars), size=k))
    hexes, alnum = _DIGITS + "abcdef", _DIGITS + _LOWER + _LOWER.upper()
    between, words = between or [("", "")], words or list(OTHER_NAMES)
    paths = ("src/app.py", "config/prod.yml", "deploy/env", "main.go", "", "web", "src3", "notes/page")
    weak_paths = ("tests/fixtures/keys.py", "docs/readme.md", "spec/auth_spec.rb", *paths)

    def secret() -> tuple[str, str]:
        name = pick(("", "my_", "SERVICE_", "db.")) + pick((str.lower, str.upper, str.title))(pick(NAMES)) + pick((' = "', "=", ": ", " = '", '": "', " := "))
        kind = int(rng.integers(6))
        if kind == 0:
            return name, pick((str, str.upper))(some(hexes, pick((32, 40, 40, 48, 64))))
        if kind == 1:
            return pick((name, name, "key ")), some(alnum, int(rng.integers(20, 64)))
        if kind == 2:
            return pick((name, "key ", "use ", "")), "AKIA" + some(pick((_DIGITS, "")) + _LOWER.upper(), 16)
        if kind == 3:
            return pick((name, "key ", "use ", "")), "ghp_" + some(pick((_DIGITS, "")) + _LOWER + _LOWER.upper(), 36)
        if kind == 4:
            return pick((name, name, "")), base64.b64encode(rng.bytes(int(rng.integers(15, 48)))).decode()
        return name, some(alnum + "!@#$%^&*", int(rng.integers(10, 24)))

    def other() -> tuple[str, str]:
        name, kind = pick(NAMES) + pick((' = "', "=", ": ")), int(rng.integers(8))
        if kind == 0:
            return pick(OTHER_NAMES) + pick((" ", ": ", "=", ' = "')), some(hexes, pick((32, 40, 64)))
        if kind == 1:
            return pick(("id=", "uuid: ", "", "request ")), str(uuid.UUID(bytes=rng.bytes(16)))
        if kind == 2:
            return name, pick(("your-{}-here", "{}_placeholder", "example-{}-value", "xxxxxxxx{}xxxxxxxx", "changeme{}")).format(pick(NAMES)) + some(_DIGITS, int(rng.integers(0, 3)))
        if kind == 3:
            return pick(("", "path=", "file: ")), "/".join(pick(words) for _ in range(int(rng.integers(4, 7))))
        if kind == 4:
            return pick(("class ", "", "import ")), "".join(pick(words).title() for _ in range(int(rng.integers(3, 6))))
        if kind == 5:
            return pick(("", "", name)), "".join(pick(words) for _ in range(int(rng.integers(3, 7))))
        if kind == 6:
            joined = pick(("_", "-")).join(pick(words) for _ in range(int(rng.integers(4, 8))))
            return pick(("", "export ", "if ", "(")), pick((joined, joined.upper(), pick(("-", "_", "x", "/")) * int(rng.integers(20, 80))))
        return pick(("example ", "sample: ", "dummy ")) + name, some(alnum, int(rng.integers(20, 48)))

    found = []
    for i in range(n):
        real = i % 2 == 1
        lead, value = secret() if real else other()
        before, after = pick(between)
        quote = lead[-1] if lead and lead[-1] in "\"'" else ""
        found.append(Finding(value, (before + lead)[-CONTEXT:], (quote + (after or pick(("\n", " ", ""))))[:CONTEXT], pick(paths if real else weak_paths), real))
    return found


def train(findings: list[Finding], words: list[str]) -> Model:
    evidence = Evidence(words, findings)
    x = np.array([evidence.features(f.value, f.before, f.after, f.path) for f in findings])
    return Model(evidence, forest.train(x, np.array([float(f.real) for f in findings])))


def fit(documents: DataFrame, n: int = FINDINGS, seed: int = 7) -> Model:
    """A model from the dictionary of the documents and from findings planted between their words."""
    words = dictionary(documents)
    return train(labelled_findings(places(documents), words, n, seed), words)


def candidates(text: str) -> list[tuple[int, int]]:
    """Where candidates stand in a text, in code points: assigned values, and long runs beside them; to reject words is the forest's part."""
    values = [m.span("value") for m in _VALUE.finditer(text)]
    found, k = list(values), 0
    for lo, hi in (m.span() for m in _RUN.finditer(text)):
        while k < len(values) and values[k][1] <= lo:
            k += 1
        if k == len(values) or values[k][0] >= hi:
            found.append((lo, hi))
    return sorted(found)


def scan(documents: DataFrame, model: Model, path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, value, score and secret of each candidate; `path` names a column with paths."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "value", "score", "secret"]
        for b in batches:
            may = np.flatnonzero(pc.fill_null(pc.match_substring_regex(b.column(1), _QUICK), False).to_numpy(zero_copy_only=False))
            rows, spans, seen = [], [], []
            for i in may.tolist():
                text, of = b.column(1)[i].as_py(), (b.column(2)[i].as_py() or "") if path else ""
                for lo, hi in candidates(text):
                    rows.append(i)
                    spans.append((lo, hi))
                    seen.append((text[lo:hi], text[max(0, lo - CONTEXT) : lo], text[hi : hi + CONTEXT], of))
            score = shared.value.score(seen)
            starts, ends = (pa.array([s[k] for s in spans], pa.int32()) for k in (0, 1))
            columns = [b.column(0).take(pa.array(rows, pa.int64())), starts, ends, pa.array([s[0] for s in seen], pa.string()), pa.array(score), pa.array(score >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", *([path] if path else []))
    return rows.mapInArrow(run, f"doc_id {kind}, start int, end int, value string, score double, secret boolean")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(documents, fit(documents), path="source")
