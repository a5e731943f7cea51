"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers expand and validate them.

One pass of the automaton over a text finds at-signs, schemes, digits beside digits and
identifier cues. Around each anchor a deterministic parser of its kind walks to the
boundaries and accepts or drops what it has found; what a parser has consumed is not
visited again, so the work is linear in the text.

Kinds: `email`, `ip`, `card` (13 to 19 digits, Luhn), `phone` (9 to 15 digits behind a plus sign); these four
equal leftmost, non-overlapping matches of their patterns. Found beside them: `mail` (addresses with Latin
letters beyond ASCII), `address` (a URL with user information or a path that names a person, mailto: and
tel: links) and `account` (an identifier behind a cue; an IBAN has to have right check digits, a social
security number possible groups).

Defined results: null text is the empty text, which has no spans; texts of any length are
read whole; offsets are code points, ends exclusive; spans of one kind don't overlap, those of two kinds may;
they are sorted by kind as listed, then start. Other columns pass through; one named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .wordhash import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "mail", "address", "account")
#: Cues of identifiers and of paths that name a person. (fixed values)
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "user id", "customer id", "member id", "tax id")
PERSON_PATHS = ("~", "@", "user/", "users/", "u/", "profile/", "people/")
LINK_SCHEMES = ("mailto:", "tel:")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LATIN = "A-Za-z0-9À-ɏ"
_LATIN_DOMAIN = re.compile(rf"@(?:[{_LATIN}-]+\.)+[A-Za-zÀ-ɏ]{{2,}}")
_URL_END = re.compile(r"[^\s<>\"'`{}|\\^]*")
_LINK_BODY = {"mailto:": re.compile(r"[^\s<>\"'@?]+@[^\s<>\"'@?]+"), "tel:": re.compile(r"\+?[0-9][0-9().-]{4,}[0-9]")}
_BEHIND_CUE = re.compile(r"(?:[ _-]?(?:number|num|nr|no)\b\.?)?[ \t]*(?:is|[:=#])?[ \t]*#?([A-Z0-9](?:[ -]?[A-Z0-9]){4,33})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-?(?!00)[0-9]{2}-?(?!0000)[0-9]{4}$")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_NUMERIC = frozenset("0123456789")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(token: str) -> bool:
    """Check digits of an IBAN: letters count from 10, the first four characters go to the end."""
    if not re.match(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", token):
        return False
    return int("".join(str(int(c, 36)) for c in token[4:] + token[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors():
    """The automaton; each anchor carries its parser's name and its length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    digits = "0123456789"
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for link in LINK_SCHEMES:
        found.add_word(link, ("link", len(link)))
    for cue in ACCOUNT_CUES:
        found.add_word(cue, ("cue", len(cue)))
    for a in digits:
        found.add_word("+" + a, ("plus", 2))
        for b in digits:
            found.add_word(f"{a}.{b}", ("dot", 3))
            for gap in ("", " ", "-"):
                found.add_word(a + gap + b, ("digits", 2 + len(gap)))
    found.make_automaton()
    return found


class _Found:
    """The spans of one text, as its anchors come in ascending order."""

    def __init__(self, text: str):
        self.text = text
        self.low = text.encode().lower().decode()  # of ASCII letters alone, so places stay
        self.spans: dict[str, list[Span]] = {k: [] for k in KINDS}
        self.upto = dict.fromkeys(("at", "wide", "dot", "digits", "plus", "scheme", "link", "cue"), 0)

    def _back(self, at: int, allowed, least: int) -> int:
        while at > least and allowed(self.text[at - 1]):
            at -= 1
        return at

    def at(self, at: int, n: int) -> None:
        start = self._back(at, _LOCAL.__contains__, self.upto["at"])
        domain = _DOMAIN.match(self.text, at) if start < at else None
        if domain:
            self.spans["email"].append((start, domain.end()))
            self.upto["at"] = domain.end()
        # Latin letters beyond ASCII: only what the plain pattern can't span whole.
        wide = self._back(at, lambda c: c in _LOCAL or "À" <= c <= "ɏ", self.upto["wide"])
        domain = _LATIN_DOMAIN.match(self.text, at) if wide < at else None
        if domain and not self.text[wide : domain.end()].isascii():
            self.spans["mail"].append((wide, domain.end()))
            self.upto["wide"] = domain.end()

    def dot(self, at: int, n: int) -> None:
        start = self._back(at + 1, _NUMERIC.__contains__, self.upto["dot"])
        got = _FOUR.match(self.text, start) if start <= at else None
        if got:
            self.upto["dot"] = got.end()
            parts = (p.lstrip("0") for p in got.group().split("."))
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                self.spans["ip"].append(got.span())

    def digits(self, at: int, n: int) -> None:
        if at < self.upto["digits"]:
            return
        got = _DIGITS.match(self.text, at)
        self.upto["digits"] = got.end()
        if got.end() - at >= 13:
            own = got.group().replace(" ", "").replace("-", "")
            if 13 <= len(own) <= 19 and luhn(own):
                self.spans["card"].append(got.span())

    def plus(self, at: int, n: int) -> None:
        got = _PHONE.match(self.text, at)
        if got and 9 <= sum(map(_NUMERIC.__contains__, got.group())) <= 15:
            self.spans["phone"].append(got.span())

    def scheme(self, at: int, n: int) -> None:
        if at < self.upto["scheme"]:
            return
        end = _URL_END.match(self.text, at + n).end()
        start = at
        while start > self.upto["scheme"] and self.low[start - 1] in _SCHEME:
            start -= 1
        self.upto["scheme"] = end
        body = self.text[at + n : end].rstrip(".,;:!?)]")
        host, _, path = body.partition("/")
        named = any(path.lower().startswith(p) and path[len(p) : len(p) + 1].isalnum() for p in PERSON_PATHS)
        if start < at and self.low[start].isalpha() and host and ("@" in host[1:] or named):
            self.spans["address"].append((start, at + n + len(body)))

    def link(self, at: int, n: int) -> None:
        if at < self.upto["link"] or (at and self.text[at - 1].isalnum()):
            return
        got = _LINK_BODY[self.low[at : at + n]].match(self.text, at + n)
        if got:
            end = at + n + len(got.group().rstrip(".,;:!?)]"))
            self.upto["link"] = end
            self.spans["address"].append((at, end))

    def cue(self, at: int, n: int) -> None:
        if at < self.upto["cue"] or (at and self.text[at - 1].isalnum()):
            return
        got = _BEHIND_CUE.match(self.text, at + n)
        if not got:
            return
        cue, token = self.low[at : at + n], got.group(1)
        own = token.replace(" ", "").replace("-", "")
        if cue == "iban":
            fine = _iban(own)
        elif cue in ("ssn", "social security"):
            fine = bool(_SSN.match(token))
        else:
            fine = len(own) <= 20 and sum(map(_NUMERIC.__contains__, own)) >= 5
        if fine:
            self.upto["cue"] = got.end(1)
            self.spans["account"].append(got.span(1))

    def run(self) -> list[tuple[str, int, int]]:
        for last, (parser, n) in _anchors().iter(self.low):
            getattr(self, parser)(last - n + 1, n)
        return [(k, a, b) for k in KINDS for a, b in sorted(self.spans[k])]


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in one text."""
    return _Found(text).run() if text else []


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind in brackets."""
    out, done, until = [], 0, -1
    for start, end, kind in sorted((a, -b, KINDS.index(k)) for k, a, b in spans):
        if start >= until:
            out += [text[done : max(start, done)], f"[{KINDS[kind]}]"]
        until = done = max(until, -end)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans", masked_col: str | None = None) -> DataFrame:
    """`docs` with the spans of each text as array<struct<kind, start, end>>; with `masked_col` also the text with spans replaced by their kind."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    more = [T.StructField(out_col, T.ArrayType(span))]
    if masked_col is not None:
        more.append(T.StructField(masked_col, T.StringType()))
    rows = docs.drop(*[f.name for f in more])
    at = rows.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                found = [spans_of(t) for t in texts]
                made = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)]
                if masked_col is not None:
                    made.append(pa.array([_masked(t, s) for t, s in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[f.name for f in more]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone, base_sha256 (of the spans of these four kinds) and all spans as text."""
    found = find_personal_data(docs.select(id_col, text_of(text_col).alias("__text")), "__text", "__spans")

    def count(kind: str) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"))
