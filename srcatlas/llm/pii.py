"""Personal data by weak supervision.

``base_spans`` finds e-mail addresses, IP addresses, payment cards and phone
numbers by fixed patterns.  ``candidates`` adds looser shapes (national phone
numbers, written-out addresses, social security numbers, IBANs, titled names)
and lets labelers vote on every candidate: the strict pattern, a check digit,
gazetteers (dialling codes, card issuers, top-level domains, given names),
words before the span, and degenerate digits.  Votes are -1, 0 (abstains), 1.

``fit`` runs expectation-maximisation over the counts of the vote patterns of
all candidates of the corpus.  There are at most kinds x 3^labelers patterns,
so the table that reaches the driver is bounded whatever the corpus.  The
posteriors then train a logistic span classifier on votes and kind, which
decides about the looser candidates; base spans always stay.

Cases: a null text is an empty one and has no spans; an empty table gives no
rows and an untrained model that adds nothing; repeated rows give equal rows;
overlapping looser spans lose against base ones, then against earlier ones;
very long texts are searched whole and in linear time, as are digit runs of any
length; offsets are code points; only doc_id and text are read, so further
columns of any name do not matter, and ``redact`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
BASE = KINDS[:4]
RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{2,63})+")
_TITLED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr)\. ([A-Z][a-z]+(?: [A-Z][a-z]+)?)")

#: Gazetteers: generic domains and those of the larger countries; dialling codes of the countries, three-digit ones by
#: their zones; issuers of payment cards; given names.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev me tv co us ca mx br ar cl pe uk ie fr de at ch nl be lu es pt it gr pl cz sk hu ro bg "
    "hr si rs ua ru by ee lv lt fi se no dk is tr il ir iq sa ae eg ma dz tn za ng ke gh et in pk bd lk np cn hk tw jp kr vn th my sg id ph au nz eu".split()
)
DIALLING = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
)
ISSUERS = ("300", "301", "302", "303", "304", "305", "34", "35", "36", "37", "38", "39", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "6011", "62", "63", "64", "65", "67")
GIVEN = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher "
    "Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda "
    "Brian Dorothy George Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Laura Helen Sharon Anna Emma Olivia Sophia Peter Maria Jean Pierre Marie "
    "Jacques Claire Hans Karl Klaus Greta Jose Carlos Ana Luis Juan Miguel Carmen Giulia Marco Luca Sofia Ivan Olga Anders Ingrid Ahmed Fatima Wei Yuki Priya Raj".split()
)
#: Words before a span that speak for its kind, or against any.
CUES = {
    "email": "mail email e-mail contact write reach address cc bcc",
    "ip": "ip host server address from addr client remote node",
    "card": "card visa mastercard amex payment credit debit paid",
    "phone": "phone tel telephone call fax mobile cell number dial whatsapp",
    "ssn": "ssn social security taxpayer",
    "iban": "iban account bank transfer",
    "name": "dear by name from patient signed met ask",
}
CUES = {kind: frozenset(words.split()) for kind, words in CUES.items()}
AGAINST = frozenset("version release build isbn issn order invoice serial part model sku section chapter example".split())
_CUE = re.compile(r"[a-z]+(?:-[a-z]+)?")
#: Characters before a span in which its cues stand.
BEFORE = 40
LABELERS = ("pattern", "check", "gazetteer", "context", "digits")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _octet(bare: str) -> bool:
    """Whether digits without leading zeros are at most 255, however many zeros there were."""
    return len(bare) < 3 or (len(bare) == 3 and bare <= "255")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    spans = [(s, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        spans += [(*m.span(), "ip") for m in _IP.finditer(text) if all(_octet(p.lstrip("0")) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        if "+" in text:
            spans += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[0], RANK[s[2]]))


def _loose(text: str):
    if _DIGIT.search(text):
        for pattern, kind in ((_NATIONAL, "phone"), (_SSN, "ssn"), (_IBAN, "iban")):
            yield from ((*m.span(), kind) for m in pattern.finditer(text))
    if "at]" in text or "at)" in text:
        yield from ((*m.span(), "email") for m in _WRITTEN.finditer(text))
    if "Mr. " in text or "Mrs. " in text or "Ms. " in text or "Dr. " in text:
        yield from ((*m.span(1), "name") for m in _TITLED.finditer(text))


def votes(text: str, start: int, end: int, kind: str, strict: bool) -> tuple[int, ...]:
    """What each labeler says about one candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    check = gazetteer = 0
    if kind == "card":
        check, gazetteer = (1 if luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else -1)
    elif kind == "iban":
        bare = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else -1
    elif kind == "phone":
        gazetteer = (1 if digits.startswith(DIALLING) else -1) if span[0] == "+" else 0
        check = 1 if len(digits) >= 10 and digits[-10] not in "01" else 0
    elif kind == "ip":
        check = 1 if not span.startswith(("0.", "255.")) else -1
    elif kind == "email":
        gazetteer = 1 if re.split(r"[.\])]", span.rstrip(".").lower())[-1].strip() in TOP_LEVEL else -1
    elif kind == "ssn":
        check = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    elif kind == "name":
        gazetteer = 1 if span.split()[0] in GIVEN else 0
    before = _CUE.findall(text[max(0, start - BEFORE) : start].lower())
    context = 1 if not CUES[kind].isdisjoint(before) else -1 if not AGAINST.isdisjoint(before) else 0
    degenerate = -1 if len(digits) > 6 and len(set(digits)) < 3 else 0
    return (1 if strict else 0), check, gazetteer, context, degenerate


def candidates_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple]]:
    """Base spans, and every candidate as (start, end, kind, strict, votes)."""
    base = base_spans(text)
    found = [(*s, True, votes(text, *s, True)) for s in base]
    # base spans merged into disjoint ones; accepted looser spans are disjoint and in order
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    free = 0
    for s, e, kind in sorted(_loose(text), key=lambda x: (x[0], RANK[x[2]])):
        if s >= free and bisect_left(starts, e) == bisect_right(ends, s):
            free = e
            found.append((s, e, kind, False, votes(text, s, e, kind, False)))
    return base, found


def join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "found array<struct<start:int,end:int,kind:string,strict:boolean,votes:array<int>>>"
)
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("strict", pa.bool_()), ("votes", pa.list_(pa.int32()))]))


def candidates(docs: DataFrame) -> DataFrame:
    """Base counts and all candidates of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, found = candidates_of(text)
                joined = join(base)
                counts = [sum(k == kind for _, _, k in base) for kind in BASE]
                fields = ("start", "end", "kind", "strict", "votes")
                rows.append((*counts, hashlib.sha256(joined.encode()).hexdigest(), joined, [dict(zip(fields, f, strict=True)) for f in found]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), _FOUND]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


class SpanModel:
    """Labeler reliabilities by EM, and the logistic classifier trained on its posteriors."""

    def __init__(self, patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50):
        self.weights: np.ndarray | None = None
        self.reliability: dict[str, float] = {}
        if not patterns:
            return
        v = np.array([p[1] for p in patterns])
        n = np.array([p[2] for p in patterns], float)
        p = np.clip(0.5 + 0.2 * v.sum(axis=1), 0.05, 0.95)  # the majority begins
        for _ in range(rounds):
            share = np.clip((n * p).sum() / n.sum(), 0.05, 0.95)
            say = {}
            for value in (-1, 0, 1):
                hit = v == value
                # pseudo-counts keep a labeler that never errs from being certain
                lean = 1 + 0.75 * value
                say[value] = (
                    (hit * (n * p)[:, None]).sum(axis=0) + lean,
                    (hit * (n * (1 - p))[:, None]).sum(axis=0) + 2 - lean,
                )
            all_true, all_false = sum(s[0] for s in say.values()), sum(s[1] for s in say.values())
            score = np.full(len(n), np.log(share / (1 - share)))
            for value, (yes, no) in say.items():
                score += ((v == value) * (np.log(yes / all_true) - np.log(no / all_false))).sum(axis=1)
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        right = ((v > 0) * p[:, None] + (v < 0) * (1 - p)[:, None]) * n[:, None]
        cast = (v != 0) * n[:, None]
        self.reliability = dict(zip(LABELERS, (right.sum(axis=0) + 1) / (cast.sum(axis=0) + 2), strict=True))
        x = np.array([self.features(k, w) for k, w, _ in patterns])
        weights = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps with a ridge
            q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (n / n.sum() * (q - p)) + 1e-3 * weights
            curve = (x * (n / n.sum() * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            weights -= np.linalg.solve(curve, slope)
        self.weights = weights

    @staticmethod
    def features(kind: str, votes) -> list[float]:
        return [1.0, *[float(w > 0) for w in votes], *[float(w < 0) for w in votes], *[float(kind == k) for k in KINDS[1:]]]

    def accepts(self, kind: str, votes) -> bool:
        """A looser candidate needs the classifier and one labeler's evidence for it."""
        if self.weights is None or max(votes) < 1:
            return False
        return float(np.dot(self.features(kind, votes), self.weights)) >= 0

    def spans(self, found) -> list[tuple[int, int, str]]:
        kept = [(f["start"], f["end"], f["kind"]) for f in found if f["strict"] or self.accepts(f["kind"], f["votes"])]
        return sorted(kept, key=lambda s: (s[0], RANK[s[2]]))


def fit(found: DataFrame) -> SpanModel:
    """Trains on the counts of the vote patterns of all candidates."""
    patterns = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes").count()
    rows = patterns.orderBy("kind", "votes").collect()  # at most kinds x 3^labelers rows
    return SpanModel([(r["kind"], tuple(r["votes"]), r["count"]) for r in rows])


def decide(found: DataFrame, model: SpanModel) -> DataFrame:
    """The candidates' rows with ``spans``: base spans and those the classifier accepts."""

    @F.pandas_udf("string")
    def spans(column):
        return column.map(lambda f: join(model.spans(f)))

    return found.withColumn("spans", F.when(F.size("found") == 0, F.lit("")).otherwise(spans("found")))


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The same rows with every span replaced by its kind in brackets."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts):
        def one(text):
            if text is None:
                return None
            _, found = candidates_of(text)
            if not found:
                return text
            keys = ("start", "end", "kind", "strict", "votes")
            out, at = [], 0
            for start, end, kind in model.spans([dict(zip(keys, f, strict=True)) for f in found]):
                if start >= at:
                    out += [text[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", cleaned("text"))
