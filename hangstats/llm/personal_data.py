"""Personal data and secrets in texts.

Patterns propose spans, checksums and forms confirm them, words nearby adjust
the score. Base spans always stay, with their score; spans of the added kinds
stay if their score suffices, so an unchecked number needs no word against it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import id_and_text, map_rows, text_slices

#: The base kinds in the order they are listed, then those this method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key", "token", "secret")
#: Added kinds below this score are no spans.
LEAST_SCORE = 0.5

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Tried once for each run of digits: a later start within the run finds nothing that its beginning does not.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
#: The published forms of access tokens.
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[oprsu]_[A-Za-z0-9]{36}|"
    r"github_pat_[A-Za-z0-9_]{40,}+|glpat-[A-Za-z0-9_-]{20,}+|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+|"
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)(?![A-Za-z0-9_-])"
)
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|secret|token|(?:api|access|private|secret)[_-]?key)"
    r"[\"']?[\x20\t]{0,4}(?:=>|:=|=|:)[\x20\t]{0,4}[\"']?([A-Za-z0-9!@#$%^&*+/=_.~-]{8,}+)",
    re.I,
)
_SECRET_NAMES = ("passw", "pwd", "passphrase", "secret", "token", "key")
#: Bits a character of a secret has at least.
_LEAST_ENTROPY = 2.75

#: Score of a confirmed span before its context is seen.
_START = {
    "email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.5, "key": 1.0, "token": 0.8, "secret": 0.6
}
_REACH, _STEP = 40, 0.2


def _whole(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![^\W\d_])(?:{words})(?![^\W\d_])", re.I)


#: Words that speak for a kind, or against it.
_FOR = {
    "email": _whole("e?-?mails?|contact|write|kontakt|correo|courriel"),
    "ip": _whole("ip|address|hosts?|servers?|adresse"),
    "card": _whole("cards?|visa|mastercard|credit|payments?|kreditkarte|karte|carte|tarjeta"),
    "phone": _whole("(?:tele)?phones?|call|tel|mobile|fax|anruf|llama|telefon|téléphone|teléfono"),
    "iban": _whole("iban|account|bank|konto|compte|cuenta"),
    "ssn": _whole("ssn|social|security"),
    "token": _whole("tokens?|keys?|secret|authorization|bearer|credentials?"),
    "secret": _whole("credentials?|login|export|env|config|authorization"),
}
_AGAINST = {
    "ip": _whole("version|release|v"),
    "card": _whole("isbn|order|serial|invoice"),
    "phone": _whole("isbn|serial|invoice"),
    "ssn": _whole("parts?|serial|order|model"),
    "token": _whole("example|sample|dummy|fake"),
    "secret": _whole("example|sample|dummy|fake|placeholder"),
}

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    """Doubling every second digit from the right, the digit sum is a multiple of ten."""
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if i % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: the remainder by 97 is one."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def token_checks(token: str) -> bool | None:
    """Whether the checksum or header inside of a token is right; None for forms that have neither."""
    if token[:2] == "gh" and token[3] == "_":
        value = binascii.crc32(token[4:-6].encode())
        return token[-6:] == "".join(_BASE62[value // 62**i % 62] for i in reversed(range(6)))
    if token.startswith("eyJ"):
        head = token.split(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, TypeError, RecursionError):
            return False
    return None


def entropy(value: str) -> float:
    """Bits for each character, by the frequencies in the value itself."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """Private key blocks; without an end, the first line alone."""
    done, more = 0, True
    for m in _KEY.finditer(text):
        if m.start() < done:
            continue
        end = _KEY_END.search(text, m.end()) if more else None
        more = end is not None
        done = end.end() if end else m.end()
        yield m.start(), done


def _secrets(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Keys, tokens and named secrets with what their form adds to the score."""
    if "-----BEGIN " in text:
        for start, end in _keys(text):
            yield "key", start, end, 0.0
    for m in _TOKEN.finditer(text):
        checks = token_checks(m.group())
        # Three parts with dots say little without a header; a prefix of its own says much even so.
        wrong = -2 * _STEP if m.group().startswith("eyJ") else -_STEP
        yield "token", m.start(), m.end(), 0.0 if checks is None else _STEP if checks else wrong
    lowered = text.lower()
    if ("=" in text or ":" in text) and any(name in lowered for name in _SECRET_NAMES):
        for m in _SECRET.finditer(text):
            value = m.group(1)
            mixed = _DIGIT.search(value) and _LETTER.search(value) and entropy(value) >= _LEAST_ENTROPY
            yield "secret", m.start(1), m.end(1), _STEP if mixed else -2 * _STEP


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern from the left, looked for around each ``@`` only."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        account = m.group().replace(" ", "")
        # A spaced form may run into the next words: the longest part that checks out counts.
        for end in [m.end(), *(m.start() + i for i in range(len(m.group()) - 1, 14, -1) if m.group()[i] == " ")]:
            account = text[m.start() : end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                yield "iban", m.start(), end
                break
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find_spans(text: str | None) -> list[Span]:
    """(kind, start, end, score) in code points, by kind as listed, then start."""
    text = text or ""
    out = []
    for kind, start, end, added in [*((*p, 0.0) for p in _proposals(text)), *_secrets(text)]:
        before, after = text[max(0, start - _REACH) : start], text[end : end + _REACH]
        score = _START[kind] + added
        if kind in _FOR and (_FOR[kind].search(before) or _FOR[kind].search(after)):
            score += _STEP
        if kind in _AGAINST and _AGAINST[kind].search(before):
            score -= _STEP
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= LEAST_SCORE:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def redacted(text: str | None, least: float = 0.5) -> str | None:
    """Spans of at least this score as [KIND]; where spans overlap, the first kind listed names the whole."""
    if text is None:
        return None
    spans = sorted((s for s in find_spans(text) if s[3] >= least), key=lambda s: (s[1], s[2]))
    out, done, i = [], 0, 0
    while i < len(spans):
        start, end, kinds = spans[i][1], spans[i][2], [spans[i][0]]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            kinds.append(spans[i][0])
            i += 1
        out += [text[done:start], f"[{min(kinds, key=KINDS.index).upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "n_spans bigint, scores array<double>"
)


SCHEMA_NAMES = [part.split()[0] for part in SCHEMA.split(", ")][1:]


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every whole text, of base and added kinds, with their number and scores.

    A row for each row of ``docs``. NULL and empty texts have no spans and the
    digest of the empty string; repeated rows and NULL ids stay.
    """

    def work(table: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in SCHEMA_NAMES}
        for text in table.column("text").to_pylist():
            spans = find_spans(text)
            base = [s for s in spans if s[0] in BASE]
            for kind in BASE:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
            out["n_spans"].append(len(spans))
            out["scores"].append([s[3] for s in spans])
        return out | {"doc_id": table.column("doc_id").to_pylist()}

    return map_rows(id_and_text(docs), SCHEMA, work)


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with the spans of their texts replaced; ``n_chars``, where there is one, is counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kind = batch.schema.field(at).type
            parts = [
                pa.array([redacted(text, least) for text in texts], type=kind) for texts in text_slices(batch.column(at))
            ]
            columns = list(batch.columns)
            columns[at] = pa.concat_arrays(parts) if parts else columns[at]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
