"""Secrets in whole texts: three fixed patterns, and windows of high Shannon entropy.

The windows: a candidate is a maximal run of the characters in which keys and tokens are written.
Its character class (decimal, hexadecimal, base32, one case with digits, alphanumeric, base64) and
its length set the window's width and the entropy that a window must reach. Counts of characters are kept incrementally while the window
slides: one character enters, one leaves. A candidate with a window that reaches its class's
entropy is a span of kind `entropy`, unless an allow-list suppresses it or a fixed pattern has
already found it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .kernels import small
from .runtime import others, ship, table

# Fixed patterns with the least length that counts; letters of an assignment's name in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run that is long enough; the same matches as HEX's
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Class: the characters that belong to it, window width, least entropy in bits for a window of 20
#: characters and of each one more. Except for `decimal`, a random window of the class's alphabet
#: (16, 32, 36, 62 and 64 characters) stays below the bound once in 200 times; figures by simulation.
CLASSES = (
    ("decimal", re.compile(r"[0-9]+"), 20, (3.1,)),
    ("hex", re.compile(r"[0-9a-fA-F]+"), 20, (2.82,)),
    ("base32", re.compile(r"[A-Z2-7]+|[a-z2-7]+"), 20, (3.28,)),
    ("one case", re.compile(r"[0-9A-Z]+|[0-9a-z]+"), 20, (3.34,)),
    ("alphanumeric", re.compile(r"[0-9A-Za-z]+"), 20, (3.58,)),
    ("base64", re.compile(r".+", re.S), 24, (3.58, 3.65, 3.73, 3.79, 3.83)),
)
#: A word or identifier: letters of one case, or camel case, also with one or two short acronyms.
HUMP = r"(?:[A-Z][a-z]{2,}|To|By|Of|In|Id|On|As|At)"
WORD = rf"(?:[a-z]+|[A-Z]+|[a-z]*(?:[A-Z][a-z]+)+|[a-z]*{HUMP}*(?:[A-Z]{{2,5}}{HUMP}*){{1,2}})"
#: A whole run of letters and digits; atomic, as there is one way only to cut a candidate into them.
PART = rf"(?>(?:{WORD}[0-9]{{0,4}}|[0-9]{{1,4}})(?![A-Za-z0-9]))"
#: What never is a secret: words, identifiers and paths made of words and short numbers, UUIDs. So many consonants in a row as in the first entry are no word;
#: German compounds have up to seven.
ALLOW = tuple(
    re.compile(p)
    for p in (
        rf"(?!.*(?:[bcdfghjklmnpqrstvwxz]{{8}}|[BCDFGHJKLMNPQRSTVWXZ]{{6}}))[_/+-]*+{PART}(?:[_/+-]++{PART})*[_/+-]*=*",
        r"[_/+-]+=*",
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    )
)
#: What marks a sample value, and what joins a candidate's parts. A sample silences the whole candidate
#: but for parts without such a mark that are long enough to be a key by themselves.
SAMPLE, JOINT, LEAST = re.compile("EXAMPLE|example|XXXX|xxxx|0123456789|abcdefgh"), re.compile("[_/+-]"), 20


def window_entropy(s: str, width: int) -> float:
    """The largest Shannon entropy, in bits, of a window of `width` characters of s (of s if shorter).

    With counts c of n characters it is log2 n - sum(c log2 c) / n; the sum is updated as one
    character enters and one leaves.
    """
    n = min(width, len(s))
    if not n:
        return 0.0
    x = [0.0, *(k * math.log2(k) for k in range(1, n + 2))]
    counts: dict[str, int] = {}
    total = 0.0
    least = math.inf
    for i, c in enumerate(s):
        k = counts[c] = counts.get(c, 0) + 1
        total += x[k] - x[k - 1]
        if i >= n:
            k = counts[s[i - n]] = counts[s[i - n]] - 1
            total += x[k] - x[k + 1]
        if i >= n - 1 and total < least:
            least = total
    return math.log2(n) - least / n


def suspicious(s: str) -> bool:
    """Whether a candidate has a window of high entropy and no allow-list entry."""
    if any(p.fullmatch(s) for p in ALLOW):
        return False
    body = s.rstrip("=")
    if SAMPLE.search(s):
        return any(len(p) >= LEAST and not SAMPLE.search(p) and suspicious(p) for p in JOINT.split(body))
    _, _, width, least = next(x for x in CLASSES if x[1].fullmatch(body))
    return window_entropy(body, width) >= least[max(0, min(len(body), 19 + len(least)) - 20)]


def find(text: str) -> list[tuple[int, int, int]]:
    """All spans as (start, kind, end), sorted; code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    base = sorted(out)
    at = reach = 0  # base spans that start before the candidate's end, and how far they reach; both lists ascend
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and suspicious(m[0]):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", StringType())
OUTPUTS = {"secret_spans": ArrayType(SPAN), "redacted": StringType(), "n_assign": LongType(), "n_access": LongType(), "n_hex": LongType(), "base_sha256": StringType(), "spans": StringType()}


def scan(docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("secret_spans", "redacted")) -> DataFrame:
    """Adds the outputs asked for (see OUTPUTS) to docs; no shuffle.

    Null counts as an empty text, which has no span; `redacted` of a null is null. Spans of
    different kinds may overlap; at one start they stand in the order of KINDS. Columns of docs
    with the outputs' names, in upper or lower case, are replaced, others stay. Repeated rows are
    scanned each; an empty table gives an empty table. The time is linear in a text's length.
    """
    ship(docs.sparkSession)
    kept = others(docs, outputs)
    schema = docs.select(*kept).schema
    for name in outputs:
        schema = schema.add(name, OUTPUTS[name])
    arrow = {"secret_spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))}

    def made(name: str, x: str | None, spans: list):
        if name == "secret_spans":
            return [{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in spans]
        if name == "redacted":
            return None if x is None else redact(x, spans)
        if name == "spans":
            return joined(spans)
        if name == "base_sha256":
            return hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest()
        return sum(KINDS[k] == name[2:] for _, k, _ in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(kept.index(text)).to_pylist()
            found = [find(x or "") for x in texts]
            new = [pa.array([made(name, x, s) for x, s in zip(texts, found, strict=True)], arrow.get(name, pa.int64() if OUTPUTS[name] == LongType() else pa.string())) for name in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, *outputs])

    return docs.select(*kept).mapInArrow(run, schema)


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    outputs = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, outputs=outputs).select(F.col("doc_id"), *outputs)
