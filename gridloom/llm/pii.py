"""Personal data by anchor expansion.

An Aho-Corasick automaton reports the places where personal data may stand: at-signs, plus signs,
digits, URL schemes and words that announce an account, these in any case of letters. At each, a deterministic local parser expands
to the boundaries of an email address, an IP address, a card, telephone or account number or a URL, and
validates it. Nothing else of the text is looked at.

Defined results: null and empty texts hold no span; repeated rows get the same spans; texts of any length are read whole;
an empty table gives no rows; spans of one kind never overlap, spans of different kinds may, and those that start at
one place are listed in the order of KINDS. Columns of the input are passed through untouched by
``redact``; ``find`` returns its own columns only, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, dealt, released, texts_of, tune

#: In the order in which spans with one start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = frozenset(KINDS[:4])
RANK = {k: i for i, k in enumerate(KINDS)}

#: Words that announce an account number, and schemes that announce a URL.
CUES = ("account", "acct", "iban", "passport", "ssn", "routing", "customer id", "member id")
SCHEMES = ("http://", "https://", "ftp://", "www.")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_ACCOUNT = re.compile(r"(?:[ ]?(?:no\.?|nr\.?|number|num|id))?[ ]?[:#=]?[ ]?((?:[A-Za-z]{2}[0-9]{2}[ -]?)?[A-Za-z0-9]+(?:[ -][A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)", re.IGNORECASE)


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def iban(s: str) -> bool:
    s = re.sub(r"[ -]", "", s).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, ordered by start, then kind."""
    found: list[tuple[str, int, int]] = []
    email_end = dotted_end = chain_end = phone_end = url_end = account_end = 0
    low = text.lower()
    if len(low) != len(text):  # a character that has several in lower case
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    for last, (anchor, width) in automaton().iter(low):
        if anchor == "digit":
            if last >= dotted_end:
                m = _DOTTED.match(text, last)
                dotted_end = m.end()
                if text.count(".", last, dotted_end) >= 3:
                    at, parts = last, m.group().split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = at + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                            found.append(("ip", at, end))
                        at = end + 1
            if last >= chain_end:
                m = _CHAIN.match(text, last)
                chain_end = m.end()
                if chain_end - last >= 12:
                    digits = _digits(m.group())
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", last, chain_end))
        elif anchor == "at":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                found.append(("email", start, email_end))
        elif anchor == "plus":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                end = last + len(m.group().rstrip(" ().-"))
                if end - last >= 4:
                    phone_end = end
                    if 9 <= len(_digits(text[last:end])) <= 15:
                        found.append(("phone", last, end))
        elif anchor == "scheme":
            start = last - width + 1
            if start >= url_end and (m := _URL.match(text, last + 1)):
                url_end = last + 1 + len(m.group().rstrip(".,;:!?)]"))
                if url_end > last + 1:
                    found.append(("url", start, url_end))
        else:
            start = last - width + 1
            if start and text[start - 1].isalnum():
                continue
            if (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= account_end:
                value = m.group(1)
                if iban(value) or len(_digits(value)) >= 6:
                    account_end = m.end(1)
                    found.append(("account", m.start(1), account_end))
    found.sort(key=lambda s: (s[1], RANK[s[0]]))
    return found


def spelled(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in spans(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
FOUND_DDL = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts by kind, all spans, and a digest of the base ones."""
    tune(docs.sparkSession)

    def run(batches):
        for rb in batches:
            cols: dict[str, list] = {f.name: [] for f in FOUND}
            cols["doc_id"] = rb.column("id")
            for text in texts_of(rb.column("text")):
                got = spans(text)
                for k in KINDS:
                    cols[f"n_{k}"].append(sum(s[0] == k for s in got) if got else 0)
                cols["base_sha256"].append(hashlib.sha256(spelled([s for s in got if s[0] in BASE]).encode()).hexdigest())
                cols["spans"].append(spelled(got))
            yield batch(cols, FOUND)

    return dealt(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(released(run), FOUND_DDL)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced, in docs' own columns; a null text stays null."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for rb in batches:
            texts = [None if t is None else redacted(t) for t in rb.column(at).to_pylist()]
            yield rb.set_column(at, rb.schema.field(at), pa.array(texts, rb.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
