"""Personal data by weak supervision.

Patterns propose candidates: strict ones (email, ip, card, phone), whose spans
always stay, and looser ones. Labelers vote on each candidate, for or against,
or abstain: its form (patterns and checksums), a gazetteer (domain endings,
special address ranges, calling codes, issuer digits), the words before it, and
its edges. Expectation-maximisation estimates how reliable each labeler is in
each family of kinds, and how often candidates of a kind are personal data.
An abstention says nothing and is left out. The classes are anchored by beliefs
that count as imagined votes: labelers are better than chance (``BELIEF``), and
strict matches are mostly right (``ANCHOR``). The posteriors train a logistic
span classifier on features of the spans themselves (family, length, digits,
edges, words before, known endings). Loose candidates that it finds likely
enough are added where they meet no other span.

Patterns of votes and features are few whatever the corpus (each is a small
number), so Spark counts them over all documents and only that table reaches
the driver.

Edge cases: null text is empty and has no spans. Repeated rows each get
theirs. Empty tables give none, and then no loose candidate is added. Spans
are in code points, end exclusive; where loose spans tie for a place the kind
listed first has it. Texts are scanned whole, however long. Other columns than
those asked for and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import map_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Loose kinds and the strict kind whose family they are of.
LOOSE = {
    "email_spelled": (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{2,63})+")),
    "ip_v6": (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    "card_dotted": (2, re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z.])")),
    "social_number": (2, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    "bank_account": (2, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    "phone_local": (3, re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    "phone_prefixed": (3, re.compile(r"(?<![0-9A-Za-z+.-])00[1-9][0-9 ().-]{7,18}[0-9](?![0-9A-Za-z])")),
}
NAMES = (*KINDS, *LOOSE)
#: Words before a candidate that speak for its kind, in four languages, and words that speak against any.
CONTEXT = (
    re.compile(r"mail|contact|write|schreib|escrib|écri|correo|courriel", re.I),
    re.compile(r"\bip\b|address|adresse|host|server|dirección", re.I),
    re.compile(r"card|karte|tarjeta|carte|visa|account|konto|cuenta|compte|iban|ssn|social", re.I),
    re.compile(r"phone|call|tel|ruf|llam|appel|mobil|fax", re.I),
)
AGAINST = re.compile(r"version|isbn|issn|order|ticket|chapter|section|page\b|serial", re.I)
#: How many characters before a candidate are context.
NEAR = 40
#: Loose candidates need this probability.
SURE = 0.9
LABELERS = ("form", "gazetteer", "context", "edges")
#: Imagined votes before any is counted: each labeler is right so often for every time that it is wrong.
BELIEF = (19.0, 4.0, 12.0, 2.0)
#: Imagined candidates of each strict kind: so many right for one that is wrong. Loose kinds have one of each.
ANCHOR = 19.0
#: Pulls the classifier's weights to zero.
RIDGE = 0.1

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the email pattern. A match's first ``@`` ends a run of local characters, so each ``@`` is tried once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and (not short or int(short) <= 255)


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser patterns; kinds go on after the strict ones."""
    if not _DIGIT.search(text) and "(" not in text and "[" not in text:
        return []  # no loose pattern goes without one of these
    return [(len(KINDS) + k, m.start(), m.end()) for k, (_, pattern) in enumerate(LOOSE.values()) for m in pattern.finditer(text)]


def _gazetteer(kind: int, value: str) -> int:
    digits = "".join(_DIGIT.findall(value))
    if kind == 0:
        ending = re.split(r"[^A-Za-z0-9-]+", value.rstrip(")] "))[-1].lower()
        return 1 if ending in ENDINGS else -1 if ending.isdigit() else 0
    if kind == 1:
        return -1 if value.lower().startswith(("0.", "127.", "255.", "fe80:", "ff")) else 1
    if kind == 2:
        return 1 if digits[:1] in "3456" else 0
    return 1 if digits[:2] in CALLING or digits[:1] in "17" else 0


#: Common domain endings, and calling codes of two digits.
ENDINGS = frozenset("com org net edu gov int mil info io co de fr es it uk eu at ch nl be pl pt ru us ca au jp cn in br mx ar example test".split())
CALLING = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


FAMILY = (*range(len(KINDS)), *(f for f, _ in LOOSE.values()))


def _form(kind: int, value: str) -> int:
    """Whether what the kind's makers check holds; most loose forms prove nothing."""
    if kind < len(KINDS):
        return 1
    name, digits = NAMES[kind], "".join(_DIGIT.findall(value))
    if name == "ip_v6":
        return 1
    if name == "card_dotted":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if name == "social_number":
        return -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value.endswith("0000") else 0
    if name == "bank_account":
        packed = value.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1 else -1
    if name == "phone_local":
        return -1 if digits[0] in "01" or digits[3] in "01" else 0
    if name == "phone_prefixed":
        return 0 if 11 <= len(digits) <= 17 else -1
    return 0


#: What is counted of a candidate: its kind, the labelers' votes, and coarse length and share of digits.
PATTERN = ("kind", *LABELERS, "length", "digits")


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """The candidate's PATTERN; votes are 1 for, -1 against, 0 neither."""
    kind, start, end = span
    value, before = text[start:end], text[max(0, start - NEAR) : start]
    family = FAMILY[kind]
    context = 1 if CONTEXT[family].search(before) else -1 if AGAINST.search(before) else 0
    inside = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return kind, _form(kind, value), _gazetteer(family, value), context, -1 if inside else 0, min(len(value) // 8, 4), 4 * len(_DIGIT.findall(value)) // len(value)


@dataclass(frozen=True)
class Model:
    """The classifier's probability for each pattern, each labeler's estimated accuracy, and each kind's estimated share of personal data."""

    sure: dict[tuple[int, ...], float]
    accuracy: tuple[float, ...]
    kinds: dict[str, float]


def _posteriors(rows: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, tuple[float, ...], dict[str, float]]:
    """EM: the probability of each pattern, accuracy of labelers, and share by kind."""
    ballots, family = rows[:, 1 : 1 + len(LABELERS)], np.array(FAMILY)[rows[:, 0]]
    kinds = np.arange(len(NAMES))
    anchor = np.where(kinds < len(KINDS), ANCHOR, 1.0)
    true = anchor[rows[:, 0]] / (anchor[rows[:, 0]] + 1)
    for _ in range(rounds):
        share = (anchor + np.bincount(rows[:, 0], n * true, len(kinds))) / (anchor + 1 + np.bincount(rows[:, 0], n, len(kinds)))
        odds = np.log(share / (1 - share))[rows[:, 0]]
        for k, right in enumerate(BELIEF):
            for f in range(len(KINDS)):
                own = family == f
                # How often the labeler votes for, where it votes at all: in the one class and in the other.
                chance = []
                for weight, (yes, no) in ((n * true, (right, 1.0)), (n * (1 - true), (1.0, right))):
                    cast = lambda vote: float(weight[own & (ballots[:, k] == vote)].sum())  # noqa: B023, E731
                    chance.append((yes + cast(1)) / (yes + no + cast(1) + cast(-1)))
                odds += own * np.where(ballots[:, k] > 0, np.log(chance[0] / chance[1]), np.where(ballots[:, k] < 0, np.log((1 - chance[0]) / (1 - chance[1])), 0.0))
        true = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    agreed = [(n * np.where(v > 0, true, 1 - true) * (v != 0)).sum() / max((n * (v != 0)).sum(), 1e-9) for v in ballots.T]
    return true, tuple(map(float, agreed)), {NAMES[k]: float(share[k]) for k in kinds}


def _features(rows: np.ndarray) -> np.ndarray:
    """What the classifier sees of a pattern; ``form`` isn't among it, as it defines the kinds."""
    kind, family = rows[:, 0], np.array(FAMILY)[rows[:, 0]]
    columns = [np.ones(len(rows)), kind >= len(KINDS), *(family == f for f in range(len(KINDS))), *(kind == k for k in range(len(KINDS), len(NAMES)))]
    columns += [rows[:, 1] < 0, *(rows[:, c] == v for c in (2, 3) for v in (1, -1)), rows[:, 4] < 0, *(rows[:, 5] == b for b in range(5)), *(rows[:, 6] == b for b in range(5))]
    return np.column_stack(columns).astype(float)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Model:
    """EM over counted patterns, then a logistic classifier on its posteriors."""
    if not patterns:
        return Model({}, (), {})
    rows = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    true, accuracy, kinds = _posteriors(rows, n, rounds)
    x = _features(rows)
    w = np.zeros(x.shape[1])
    for _ in range(200):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - true)) + RIDGE * w
        bend = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return Model({tuple(map(int, r)): float(v) for r, v in zip(rows, p, strict=True)}, accuracy, kinds)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, ...], int] = {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for span in [*strict_spans(text), *loose_spans(text)] if text else ():
                key = votes(text, span)
                counts[key] = counts.get(key, 0) + 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(len(PATTERN))), pa.array([counts[k] for k in keys], pa.int64())], [*PATTERN, "n"])


def fit(docs: DataFrame) -> Model:
    """The model of a corpus, from the vote patterns of all its candidates."""
    rows = map_batches(docs.select("text"), _count, ", ".join(f"{k} int" for k in PATTERN) + ", n long")
    found = rows.groupBy(*PATTERN).agg(F.sum("n").alias("n")).collect()
    return estimate(sorted((tuple(r[k] for k in PATTERN), r["n"]) for r in found))


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans: those and the likely loose ones that meet none."""
    base = strict_spans(text)
    out = list(base)
    for span in loose_spans(text):
        if model.sure.get(votes(text, span), 0.0) >= SURE and not any(a < span[2] and span[1] < b for _, a, b in out):
            out.append(span)
    return base, sorted(out)


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``base`` and ``spans``: arrays of (kind, start, end); kind is a place in NAMES."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, model) if t else ([], []) for t in batch.column(n).to_pylist()]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], _SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *lists], [*batch.schema.names[:n], "base", "spans"])

    kept = [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    span = "array<struct<kind:int,start:bigint,end:bigint>>"
    rows = map_batches(docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), "text"), run, ", ".join([*kept, f"base {span}", f"spans {span}"]))
    return rows.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "base", "spans")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The same columns, with every span in ``text`` replaced by its kind in angle brackets; ``n_chars`` follows."""
    names = docs.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for kind, start, end in sorted(all_spans(text, model)[1], key=lambda s: (s[1], -s[2])):
            if start >= last:
                out += [text[last:start], f"<{NAMES[kind].upper()}>"]
            last = max(last, end)
        return "".join([*out, text[last:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t) for t in batch.column(text_at).to_pylist()]
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts]).cast(batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(docs, run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = find(docs, fit(docs), ["doc_id"])
    name = F.array(*map(F.lit, NAMES))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
