"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, scheme
marks and cue words. From each anchor a deterministic local parser expands to the boundaries of a span
and validates it. Email, ip, card and phone spans are the leftmost non-overlapping ones of their kind;
a span that fails validation is dropped, and its characters aren't tried again for that kind.
The method adds url spans (scheme marks), account spans (cue word and an IBAN with a valid checksum) and
secret spans (cue word, = or :, a token of 16 characters or more).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K

KINDS = ["email", "ip", "card", "phone", "url", "account", "secret"]
BASE = KINDS[:4]

#: Cue words before account numbers and secrets.
ACCOUNT_CUES = ["iban", "account"]
SECRET_CUES = ["token", "secret", "password", "api_key", "apikey"]

_DIGITS = frozenset("0123456789")
_ALPHA = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _ALPHA | _DIGITS | frozenset("._%+-")
_LABEL = _ALPHA | _DIGITS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL_STOP = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")
_SECRET = _ALPHA | _DIGITS | frozenset("_-./+=")


def _run(text: str, at: int, among: frozenset) -> int:
    """End of the run of characters of a set that starts at `at`."""
    n = len(text)
    while at < n and text[at] in among:
        at += 1
    return at


def email_at(text: str, sign: int, least: int) -> tuple[int, int] | None:
    """The address around an at-sign whose local part starts at `least` or later."""
    start = sign
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, sign + 1, _LABEL)
    if start == sign or end == sign + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, _LABEL)
        if more == end + 1:
            break
        end, dots = more, dots + 1
    return (start, end) if dots else None


def ip_at(text: str, start: int) -> tuple[int, int, bool] | None:
    """Four digit groups joined by dots from `start`, and whether all are 255 at most."""
    end, valid = start, True
    for k in range(4):
        if k:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        stop = _run(text, end, _DIGITS)
        if stop == end:
            return None
        group = text[end:stop].lstrip("0")
        valid = valid and (len(group) < 3 or len(group) == 3 and int(group) <= 255)
        end = stop
    return start, end, valid


def card_at(text: str, start: int) -> tuple[int, int, bool] | None:
    """Digits with single spaces or hyphens between them from `start`, and whether they pass length and Luhn."""
    n, end = len(text), start + 1
    digits = [text[start]]
    while end < n:
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return (start, end, 12 <= len(digits) <= 19 and luhn(digits)) if len(digits) > 1 else None


def luhn(digits) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def phone_at(text: str, plus: int) -> tuple[int, int, bool] | None:
    """A plus sign, a digit, phone characters and a last digit, and whether there are 9 to 15 digits."""
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in _DIGITS:
        return None
    digits = sum(c in _DIGITS for c in text[plus:end]) if end - plus < 100 else sum(map(text[plus:end].count, _DIGITS))
    return plus, end, 9 <= digits <= 15


def url_at(text: str, mark: int, least: int) -> tuple[int, int] | None:
    """scheme://rest around the mark; the rest ends before white space, quotes and brackets, and without closing punctuation."""
    start = mark
    while start > least and text[start - 1] in _ALPHA:
        start -= 1
    # scheme and host first: a mark without them mustn't scan on to the next stop, as many marks may come before it
    if start == mark or "." not in text[mark + 3 : _run(text, mark + 3, _LABEL | frozenset("."))].strip("."):
        return None
    end, n = mark + 3, len(text)
    while end < n and text[end] not in _URL_STOP:
        end += 1
    while end > mark + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    return start, end


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """An IBAN with a valid checksum, up to three characters after a cue that ends at `at`; groups may be set apart by spaces."""
    for start in range(at, min(at + 4, len(text))):
        if text[start : start + 2].isupper() and text[start : start + 2].isascii() and text[start + 2 : start + 4].isdigit():
            code, end = [], start
            while end < len(text) and len(code) < 34:
                c = text[end]
                if c in _DIGITS or c in _ALPHA and c.isupper():
                    code.append(c)
                    end += 1
                elif c == " " and end + 1 < len(text) and (text[end + 1] in _DIGITS or text[end + 1] in _ALPHA and text[end + 1].isupper()):
                    end += 1
                else:
                    break
            for size in range(len(code), 14, -1):
                turned = "".join(code[4:size] + code[:4])
                if turned.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                    while sum(c != " " for c in text[start:end]) > size:
                        end -= 1
                    return start, end
            return None
    return None


def secret_after(text: str, at: int) -> tuple[int, int] | None:
    """A token of 16 characters or more behind a cue that ends at `at`, spaces, = or :, and perhaps a quote."""
    at = _run(text, at, frozenset(" "))
    if at >= len(text) or text[at] not in "=:":
        return None
    at = _run(text, at + 1, frozenset(" "))
    if at < len(text) and text[at] in "\"'":
        at += 1
    end = _run(text, at, _SECRET)
    return (at, end) if end - at >= 16 else None


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("/", ["://"]), ("a", ACCOUNT_CUES), ("s", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def find(text: str, anchors) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end) by start, then kind as listed."""
    found = []
    past = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended
    run = -1  # end of the digit run that was seen last

    def take(kind, start, end, valid=True):
        past[kind] = end
        if valid:
            found.append((start, KINDS.index(kind), end))

    for last, (kind, size) in anchors.iter(text):
        if kind == "0":
            if last < run:
                continue
            run = _run(text, last, _DIGITS)
            if last >= past["ip"] and (m := ip_at(text, last)):
                take("ip", *m)
            if last >= past["card"] and (m := card_at(text, last)):
                take("card", *m)
        elif kind == "@":
            if last >= past["email"] and (m := email_at(text, last, past["email"])):
                take("email", *m)
        elif kind == "+":
            if last >= past["phone"] and (m := phone_at(text, last)):
                take("phone", *m)
        elif kind == "/":
            if last - 2 >= past["url"] and (m := url_at(text, last - 2, past["url"])):
                take("url", *m)
        elif kind == "a":
            if last >= past["account"] and (m := account_after(text, last + 1)):
                take("account", *m)
        elif last >= past["secret"] and (m := secret_after(text, last + 1)):
            take("secret", *m)
    found.sort()
    return [(s, KINDS[k], e) for s, k, e in found]


FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, counts and digest of the base kinds' spans, and all spans
    as kind:start:end (code points, end exclusive). A null text counts as empty. Texts of any length are scanned whole. Repeated
    rows each get a row, null ids stay null, spans of different kinds may overlap and all count. An empty table gives no rows."""

    def kernel(batches):
        anchors = automaton()
        for batch in batches:
            for part in K.slices(batch):
                rows = [find(t, anchors) if t else [] for t in part.column("text").to_pylist()]
                base = [[x for x in r if x[1] in BASE] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id")] + [pa.array([sum(x[1] == k for x in r) for r in base], pa.int64()) for k in BASE]
                    + [pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base]), pa.array([_joined(r) for r in rows], pa.string())],
                    names=FOUND.names,
                )

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return source.mapInArrow(kernel, FOUND)


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """`docs` with every span of `text` replaced by a mark that names its kind; of overlapping spans the first counts
    (by start, then kind as listed). Null and empty texts stay, other columns are kept whatever their names; repeated rows are redacted
    alike; texts of any length are scanned whole; an empty table gives no rows."""
    source = docs.withColumn("text", docs["text"].cast("string"))
    at = source.columns.index("text")

    def kernel(batches):
        anchors = automaton()
        for batch in batches:
            for part in K.slices(batch):
                out = []
                for t in part.column(at).to_pylist():
                    if t:
                        bits, past = [], 0
                        for s, k, e in find(t, anchors):
                            if s >= past:
                                bits += [t[past:s], mark.format(kind=k)]
                                past = e
                        t = "".join(bits) + t[past:]
                    out.append(t)
                yield part.set_column(at, "text", pa.array(out, pa.string()))

    return source.mapInArrow(kernel, source.schema)
