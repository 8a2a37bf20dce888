"""Secret scans by a trigram inverted index.

Each rule's regex gives a Boolean query over the trigrams that any match must hold. Every shard of documents (an Arrow
batch) gets postings of the trigrams that the queries name, the queries intersect and unite postings, and only the
documents that remain are verified with the regex. A rule without mandatory trigrams scans its shard fully.

Shards never leave their task: the index costs no shuffle, and a lost executor costs the recomputation of its shards.

Defined cases: null or empty text has no spans; a null doc_id and repeated rows are kept, a row each; other columns are
ignored by scan() and kept by redact(); an empty table gives an empty table; positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Alternatives of a literal stretch beyond which a query part is given up (it then demands nothing).
MOST_LITERALS = 128
#: Bytes of a shard that are indexed at once.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `group` is measured against `least` characters; ASCII letters fold if fold_case."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold_case: bool = False
    base: bool = False
    scan_as: str | None = field(default=None)  # an equal, faster way to find the matches that are long enough

    def compiled(self) -> re.Pattern:
        return re.compile(self.scan_as or self.pattern, re.ASCII | (re.IGNORECASE if self.fold_case else 0))


#: The three base rules come first, in the contract's order.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, False, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, False, True, r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge_token", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"(postgres|mysql|mongodb|redis|amqp|https)://[A-Za-z0-9_.-]+:[^\s:@/]{6,}@[A-Za-z0-9.-]+"),
)

ANY = ("any",)


def trigram_query(pattern: str) -> tuple:
    """("any",), ("tri", t), ("and", q...) or ("or", q...): what the lower-cased text of any match must hold."""
    return _query(sre_parser.parse(pattern))


def _join(kind: str, parts: list[tuple]) -> tuple:
    if kind == "or" and (not parts or ANY in parts):
        return ANY
    parts = sorted(set(parts) - {ANY})
    return ANY if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _flush(literals: set[str]) -> tuple:
    return _join("or", [_join("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) if len(s) > 2 else ANY for s in literals])


def _literals(op: object, arg: object) -> set[str] | None:
    """All strings that a node matches, lower case; None if they are many or unknown."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(c).lower() for _, c in arg}
    if op is sre.SUBPATTERN:
        return _product(arg[3])
    if op is sre.BRANCH:
        sets = [_product(x) for x in arg[1]]
        return None if None in sets else set().union(*sets)
    if op is sre.MAX_REPEAT and arg[1] == 1 and (once := _product(arg[2])) is not None:
        return once | ({""} if arg[0] == 0 else set())
    return None


def _product(nodes: object) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        more = _literals(op, arg)
        if more is None or len(out) * len(more) > MOST_LITERALS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes: object) -> tuple:
    parts, run = [], {""}
    for op, arg in nodes:
        more = _literals(op, arg)
        if more is not None and len(run) * len(more) <= MOST_LITERALS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_flush(run))
        run = {""}
        if op is sre.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is sre.BRANCH:
            parts.append(_join("or", [_query(x) for x in arg[1]]))
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _join("and", [*parts, _flush(run)])


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_of(q) for q in query[1:] if isinstance(q, tuple)))


def postings(texts: list[bytes], wanted: set[str]) -> dict[str, np.ndarray]:
    """Ascending numbers of the texts that hold each wanted trigram, ASCII letters folded."""
    coded = {t: int.from_bytes(t.encode()) for t in wanted if len(t.encode()) == 3}
    names = sorted(coded)
    slot = np.zeros(1 << 24, np.uint8 if len(names) < 1 << 8 else np.uint32)
    for i, t in enumerate(names):
        slot[coded[t]] = i + 1
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    whole = np.frombuffer(b"\0".join(texts).lower() + b"\0", np.uint8)
    found: dict[str, list[np.ndarray]] = {t: [] for t in names}
    for at in range(0, len(whole), CHUNK):
        part = whole[at : at + CHUNK + 2].astype(np.uint32)
        hit = slot[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
        where = np.flatnonzero(hit)
        kinds, docs = hit[where], np.searchsorted(starts, where + at, "right") - 1
        for k in np.unique(kinds):
            found[names[k - 1]].append(docs[kinds == k])
    return {t: np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for t, x in found.items()}


def candidates(query: tuple, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query == ANY:
        return np.arange(n)
    if query[0] == "tri":
        return index.get(query[1], np.arange(n))  # a trigram outside the index demands nothing
    sides = [candidates(q, index, n) for q in query[1:]]
    out = sides[0]
    for s in sides[1:]:
        out = np.intersect1d(out, s) if query[0] == "and" else np.union1d(out, s)
    return out


def finder(rules: tuple[Rule, ...] = RULES) -> Callable[[list[str]], list[list[tuple[str, int, int]]]]:
    """A function from a shard's texts to each text's spans, by start, then rule."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*(trigrams_of(q) for q in queries))
    patterns = [r.compiled() for r in rules]

    def find(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = postings([t.encode() for t in texts], wanted)
        for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
            for i in candidates(query, index, len(texts)):
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [[(rules[k].kind, s, e) for s, k, e in sorted(x)] for x in out]

    return find


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (an array of kind, start, end; by start, then the rules' order) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in common.slices(batches):
            spans = find([t or "" for t in b.column(1).to_pylist()])
            rows = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), rows], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.forgetting(run), "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each stretch of overlapping spans replaced by "[" and its first kind in capitals and "]"; n_chars follows where it exists."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(rules)
        for b in common.slices(batches):
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            done = [_masked(t, s) if s else t for t, s in zip(texts, find([t or "" for t in texts]), strict=True)]
            b = b.set_column(at, "text", pa.array(done, pa.string()))
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                old = b.column(n).to_pylist()
                b = b.set_column(n, "n_chars", pa.array([o if t is u else len(u) for o, t, u in zip(old, texts, done, strict=True)], b.schema.field(n).type))
            yield b

    return docs.mapInArrow(common.forgetting(run), fields)


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at, end = [], 0, 0
    for kind, s, e in spans:
        if s >= end:
            out += [text[at:s], f"[{kind.upper()}]"]
        end = at = max(end, e)
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_assign, n_access and n_hex count base spans; base_sha256 digests them; spans lists those of every rule."""
    base = [r.kind for r in RULES if r.base]
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    own = F.filter("spans", lambda s: s.kind.isin(base))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    found = scan(common.documents(spark, sf_dir))
    return found.select("doc_id", *map(count, base), F.sha2(text(own), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """The spans by plain regex search, for tests."""
    out = []
    for k, r in enumerate(RULES):
        plain = re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold_case else 0))
        out += [(m.start(), k, m.end()) for m in plain.finditer(text or "") if m.end(r.group) - m.start(r.group) >= r.least]
    return [(RULES[k].kind, s, e) for s, k, e in sorted(out)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
