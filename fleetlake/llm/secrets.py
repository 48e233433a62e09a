"""Secret scans: fixed patterns plus sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least WINDOW characters of base64, URL-safe base64 or hexadecimal text. A window moves over it one character at a
time; two counts change per step, and the sum of c*log2(c) is kept up to date by a table. The characters in the window give its class (hex,
lower case and digits, upper case and digits, both cases, all three), and the class sets what it must reach: an entropy, and a number of
switches. A switch is a character of another kind (lower, upper, digit) than the one before, but not a capital's small letter, and not a word's capital after a digit; words, camel case,
numbers and dates switch a few times in 20 characters, keys at every other one. Entropy alone cannot tell them apart: plain words reach 3.6 bits.
Windows of one kind alone, or with more than MOST_SEPARATORS separators, are words, numbers, dates or paths. Windows that reach their class's
entropy and lower number of switches are joined into spans, and a span with a window that reaches the upper one is a secret. Allow-listed
strings (identifiers in UUID form, numbers, words and paths, one's own list) are suppressed. A placeholder word suppresses its part of a
candidate, as separators bound it; what stands before and after is a candidate of its own, and so is what windows without
the word see of a longer part. Where a span meets a pattern's match, the pattern's span stays and the rest of the span on both sides.

Spans are code point offsets into the whole text, end exclusive, ordered by start and then by kind. Null and empty texts have no spans.
Repeated rows give repeated results. ``find_secrets`` returns the key and its own columns only; ``redact`` keeps all columns.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import documents, slices

# The patterns, the least lengths and the order of kinds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9+=_-]+",  # numbers and rules
    r"(?:[A-Z]?[a-z]++[-_/=+]*+)++",  # words, paths of words, camel case; possessive, so that no run is tried in many ways
    r"(?:[A-Z]++[-_/=+]*+)++",  # words in capitals
)
PLACEHOLDER = r"(?=(example|placeholder|changeme|xxxx))"
SEPARATORS = "-_/=+"
WINDOW = 20
MOST_SEPARATORS = 3
# Of each class: the entropy of a window, and the switches that a window of a span and the span's best window need.
THRESHOLDS = {"hex": (2.9, 3, 5), "lower": (3.3, 3, 5), "upper": (3.3, 3, 5), "cases": (3.5, 4, 8), "all": (3.6, 4, 7)}


def kind_of(c: str) -> str:
    return "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "separator"


def class_of(window: str) -> str | None:
    """The class of a window by its characters but separators; None for one kind alone."""
    kinds = {kind_of(c) for c in window} - {"separator"}
    if len(kinds) < 2:
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", window):
        return "hex"
    return "all" if len(kinds) == 3 else "cases" if "digit" not in kinds else "lower" if "lower" in kinds else "upper"


def switches(text: str) -> list[bool]:
    """For each character whether it is a switch after the one before it."""
    kinds = [kind_of(c) for c in text]
    out = [False]
    for a, b, after in zip(kinds, kinds[1:], [*kinds[2:], None]):
        word = a == "upper" and b == "lower" or a == "digit" and b == "upper" and after == "lower"
        out.append(a != b and "separator" not in (a, b) and not word)
    return out[: len(text)]


KIND_OF = {c: ("lower", "upper", "digit", "separator").index(kind_of(c)) for c in map(chr, range(128))}


class Scanner:
    def __init__(self, allow: list[str] = (), window: int = WINDOW, thresholds: dict[str, tuple[float, int, int]] | None = None):
        self.assign, self.access = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS)
        self.hex = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])  # runs are greedy, so the length can be asked for at once
        self.candidate = re.compile(CANDIDATE)
        self.allowed = re.compile("|".join(f"(?:{p})" for p in ALLOWED))
        self.placeholder, self.part = re.compile(PLACEHOLDER, re.ASCII | re.IGNORECASE), re.compile(f"[^{SEPARATORS}]+")
        self.allow, self.window, self.thresholds = frozenset(allow), window, thresholds or THRESHOLDS
        self.weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Joined windows that reach the lower thresholds of their class, where one of them reaches the upper."""
        w, weight, counts = self.window, self.weight, {}
        kinds = [KIND_OF[c] for c in text]
        # Whether each character is a switch, and whether it is in no lower-case or no upper-case hexadecimal number.
        turns = switches(text)
        odd = [c not in "0123456789abcdef" for c in text], [c not in "0123456789ABCDEF" for c in text]
        held, turned, strange, total, spans = [0, 0, 0, 0], 0, [0, 0], 0.0, []
        for i, c in enumerate(text):
            if i >= w:
                n = counts[old := text[i - w]]
                counts[old] = n - 1
                total += weight[n - 1] - weight[n]
                held[kinds[i - w]] -= 1
                turned -= turns[i - w + 1]
                strange[0] -= odd[0][i - w]
                strange[1] -= odd[1][i - w]
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += weight[n + 1] - weight[n]
            held[kinds[i]] += 1
            turned += turns[i] if i else 0
            strange[0] += odd[0][i]
            strange[1] += odd[1][i]
            if i < w - 1 or held[3] > MOST_SEPARATORS:
                continue
            lower, upper, digit, _ = held
            if (lower > 0) + (upper > 0) + (digit > 0) < 2:
                continue
            name = "hex" if not (strange[0] and strange[1]) else "cases" if not digit else "upper" if not lower else "lower" if not upper else "all"
            entropy, some, many = self.thresholds[name]
            # entropy = log2(w) - sum(c log2 c) / w
            if turned >= some and math.log2(w) - total / w >= entropy - 1e-9:
                if spans and i - w + 1 <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1, spans[-1][2] or turned >= many)
                else:
                    spans.append((i - w + 1, i + 1, turned >= many))
        return [(s, e) for s, e, sure in spans if sure]

    def pieces(self, run: str) -> list[tuple[int, int]]:
        """What a candidate is without its placeholders: (start, end), in order of the starts."""
        words = [m.span(1) for m in self.placeholder.finditer(run)]
        if not words:
            return [(0, len(run))]
        out, at, i = [], 0, 0

        def between(start: int, end: int) -> None:
            kept = run[start:end]
            out.append((start + len(kept) - len(kept.lstrip(SEPARATORS)), start + len(kept.rstrip(SEPARATORS))))

        for part in self.part.finditer(run):
            if i < len(words) and words[i][0] < part.end():
                between(at, part.start())
                start = part.start()
                while i < len(words) and words[i][0] < part.end():  # windows that do not hold the whole word
                    out.append((start, words[i][1] - 1))
                    start = words[i][0] + 1
                    i += 1
                out.append((start, part.end()))
                at = part.end()
        between(at, len(run))
        return [(s, e) for s, e in out if e - s >= self.window]

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """Joined spans of all candidates that are not allow-listed."""
        out = []
        for m in self.candidate.finditer(text):
            if m.group() in self.allow:
                continue
            for at, end in self.pieces(m.group()):
                piece = m.group()[at:end]
                if piece in self.allow or self.allowed.fullmatch(piece):
                    continue
                for s, e in self.windows(piece):
                    s, e = s + at + m.start(), e + at + m.start()
                    if out and s < out[-1][1]:  # pieces around a word share some letters of it
                        out[-1] = (out[-1][0], e)
                    else:
                        out.append((s, e))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "assign") for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        found += [(m.start(), m.end(), "access") for m in self.access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        found += [(m.start(), m.end(), "hex") for m in self.hex.finditer(text)]
        base = sorted(found)
        extra, b, reach = [], 0, 0  # reach: the end of what the matches so far cover
        for s, e in self.candidates(text):
            while b < len(base) and base[b][0] < e:
                if (at := max(s, reach)) < base[b][0]:
                    extra.append((at, base[b][0], "entropy"))
                reach = max(reach, base[b][1])
                b += 1
            if (at := max(s, reach)) < e:
                extra.append((at, e, "entropy"))
        return sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", allow: list[str] = ()) -> DataFrame:
    """(key, spans) of every row."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))

    def run(batches):
        scanner = Scanner(allow)
        for batch in batches:
            for part in slices(batch):
                found = [[{"kind": k, "start": s, "end": e} for s, e, k in scanner.spans(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(found, SPAN_TYPE)], ["k", "spans"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("k", key)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", allow: list[str] = ()) -> DataFrame:
    """All rows and columns; every secret in the text gives way to the mask (overlapping and touching spans to one)."""
    names, types = docs.columns, [f.dataType.simpleString() for f in docs.schema]

    def run(batches):
        scanner = Scanner(allow)

        def masked(t: str | None) -> str | None:
            if t is None or not (spans := scanner.spans(t)):
                return t
            out, at = [], 0
            for s, e, _ in spans:
                if s > at or not out:
                    out += [t[at:s], mask]
                at = max(at, e)
            return "".join(out) + t[at:]

        at = names.index(text)
        for batch in batches:
            for part in slices(batch, text):
                columns = list(part.columns)
                columns[at] = pa.array([masked(t) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = listed(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
