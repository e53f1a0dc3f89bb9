"""Personal data: base patterns, and offset-preserving deobfuscation.

Four transducers rewrite a text where it is disguised, and keep for each character that they put out the source span it stands for: homoglyphs and full-width forms to ASCII (and invisible characters to nothing), spelled digits to digits, disguised dots between four groups of digits to ".", and disguises of "@" and "." to these characters. The base patterns then run over what comes out, and a match is mapped back to the source characters from its first character's start to its last one's end. A match that a base span of its kind holds already adds nothing.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[@+0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + (k & 1))
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; leftmost, not overlapping within a kind.

    Every "@" is tried once, with the run of local-part characters before it; an address's first part begins a run of digits. That is what a scan from the left finds, in time that grows with the text alone.
    """
    out: list[tuple[str, int, int]] = []
    if not _TRIGGER.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) < 256 for g in m.groups())]
    for m in _CARD.finditer(text):
        if 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Letters of other scripts that look like ASCII ones, and signs that look like "@", "." and "-".
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсхугԁԛԝһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορτυ" + "․。｡۔" + "‐‑‒–—−",
        "ABESIJKMHOPCTXYaesijopcxyrdqwh" + "ABEZHIKMNOPTYXaivoptu" + "...." + "------",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠﻿"
_LOOK: dict[int, str] = {ord(k): v for k, v in _LOOKALIKES.items()} | {k: chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)} | {ord(c): "" for c in _INVISIBLE}
for _zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    _LOOK |= {_zero + k: str(k) for k in range(10)}
_LOOK_RE = re.compile("[" + "".join(map(chr, sorted(_LOOK))).replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-") + "]")

_DIGITS = {w: str(k % 10) for k, w in enumerate("zero one two three four five six seven eight nine oh".split())} | {"null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_DIGIT = r"(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r"|[0-9]+)"
_BRACKETED_DOT = r"[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]"
# The first character is tested before the words are tried: nearly all positions of a text end there.
_SPELLED = re.compile(rf"(?<![^\W_])(?=[0-9acdefnopqstuvz])(?:plus\s+)?{_DIGIT}(?:(?:\s*{_BRACKETED_DOT}\s*|[\s,.-]{{1,3}}|\s*[(\[{{]?\bdot\b[)\]}}]?\s*|\s*\bpoint\b\s*){_DIGIT}){{3,}}(?![^\W_])", re.I)
_DIGIT_WORD = re.compile(rf"({_DIGIT})|(plus\s+)|({_BRACKETED_DOT}|dot|point)|(.)", re.I | re.S)

_AT = r"(?:\s*[\[({<]\s*(?:at|@|arroba|chez|ät)\s*[\])}>]\s*|\s+(?:at|arroba|ät)\s+|\s+@\s*|\s*@\s+|\s*&#64;\s*|\s*_at_\s*|\s*%40\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|\s+\.\s+|\s*&#46;\s*|\s*_dot_\s*)"
_PART = r"[A-Za-z0-9-]+"
_AT_RE, _DOT_RE = re.compile(_AT, re.I), re.compile(_DOT, re.I)
#: Whatever _ADDRESS finds and _addresses rewrites has one of these: a disguised at, a plain one and a disguised dot, or a bare one before a name and a dot.
_AT_HINT = re.compile(r"[\[({<]\s*(?:at|@|arroba|chez|ät)\s*[\])}>]|&#64;|_at_|%40|\s@|@\s", re.I)
_BARE_AT_HINT = re.compile(rf"\s(?:at|arroba|ät)\s+[A-Za-z0-9-]+(?:{_DOT}|\.)", re.I)
#: Digit groups of an address with plain and disguised dots.
_DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,64}}(?:(?:{_DOT}|\.)[0-9]{{1,64}}){{3}}(?![0-9])", re.I)
#: A disguised address: a name of words joined by dots, plain or disguised, an at, and labels joined likewise, the last a top-level name; a bare "at" between blanks counts only with a bare or bracketed "dot" after it.
_STRONG_AT = r"(?:\s*[\[({<]\s*(?:at|@|arroba|chez|ät)\s*[\])}>]\s*|\s*&#64;\s*|\s*_at_\s*|\s*%40\s*|\s*@\s*)"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{{0,62}})(?:{_DOT}[A-Za-z0-9_%+-]{{1,62}}){{0,3}}"
    rf"(?:(?:{_STRONG_AT}){_PART}(?:(?:{_DOT}|\.){_PART}){{0,4}}(?:{_DOT}|\.)[A-Za-z]{{2,12}}|\s+(?:at|arroba|ät)\s+{_PART}(?:(?:{_DOT}|\.){_PART}){{0,4}}{_DOT}[A-Za-z]{{2,12}})(?![A-Za-z0-9])",
    re.I,
)


class Rewrite:
    """A text and the source span that each of its characters stands for.

    The way back is kept by stretches, not by characters: starts[k] is where stretch k begins in the text, and its characters stand for the source characters from source_at[k] on, one for one, or, if whole_end[k] isn't 0, each for the whole span from source_at[k] to whole_end[k]. Memory and time follow the number of edits.
    """

    def __init__(self, text: str):
        self.text, self.starts, self.source_at, self.whole_end = text, [0], [0], [0]
        self.edited = False

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts out, for each (start, end, new), ascending, new in place of the characters from start to end. Each new character stands for the whole of them, unless they are as many: then one for one."""
        if not edits:
            return
        old = (self.starts, self.source_at, self.whole_end)
        starts, source_at, whole_end = [], [], []
        out, at, size, k = [], 0, 0, 0

        def keep(a: int, b: int) -> None:
            """The way back of the old characters from a to b, for the next b - a new ones."""
            nonlocal size, k
            while a < b:
                while k + 1 < len(old[0]) and old[0][k + 1] <= a:
                    k += 1
                stop = min(b, old[0][k + 1]) if k + 1 < len(old[0]) else b
                source = old[1][k] + (0 if old[2][k] else a - old[0][k])
                if not (starts and not old[2][k] and not whole_end[-1] and source == source_at[-1] + size - starts[-1]):
                    starts.append(size)
                    source_at.append(source)
                    whole_end.append(old[2][k])
                size += stop - a
                a = stop

        for a, b, new in edits:
            keep(at, a)
            out += [self.text[at:a], new]
            if len(new) == b - a:
                keep(a, b)
            elif new:
                starts.append(size)
                source_at.append(self.source(a, a + 1)[0])
                whole_end.append(self.source(b - 1, b)[1])
                size += len(new)
            at = b
        keep(at, len(self.text))
        out.append(self.text[at:])
        self.text, self.edited = "".join(out), True
        self.starts, self.source_at, self.whole_end = starts or [0], source_at or [0], whole_end or [0]

    def source(self, start: int, end: int) -> tuple[int, int]:
        first, last = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_right(self.starts, end - 1) - 1
        begin = self.source_at[first] + (0 if self.whole_end[first] else start - self.starts[first])
        return begin, self.whole_end[last] or self.source_at[last] + end - self.starts[last]


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _LOOK[ord(m[0])]) for m in _LOOK_RE.finditer(text)]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        if not re.search(r"[^\W\d_]", m[0]):
            continue  # digits alone are the base patterns' work
        dots = re.search(rf"\b(?:dot|point)\b|{_BRACKETED_DOT}", m[0], re.I)
        for d in _DIGIT_WORD.finditer(m[0]):
            a, b = m.start() + d.start(), m.start() + d.end()
            if d[1]:
                out.append((a, b, _DIGITS.get(d[1].lower(), d[1])))
            elif d[2]:
                out.append((a, b, "+"))
            elif d[3]:
                out.append((a, b, "."))
            elif not (d[4] == "." and dots is None):
                out.append((a, b, ""))
    return out


def _dotted(text: str) -> list[tuple[int, int, str]]:
    return [(d.start(), d.end(), ".") for m in _DOTTED.finditer(text) for d in _DOT_RE.finditer(text, m.start(), m.end())]


def _addresses(text: str) -> list[tuple[int, int, str]]:
    if not (_AT_HINT.search(text) or ("@" in text and _DOT_RE.search(text)) or _BARE_AT_HINT.search(text)):
        return []
    out = []
    for m in _ADDRESS.finditer(text):
        edits, taken = [], []
        for kind, pattern in (("@", _AT_RE), (".", _DOT_RE)):
            for d in pattern.finditer(text, m.start(), m.end()):
                if all(d.end() <= a or d.start() >= b for a, b, _ in edits):
                    edits.append((d.start(), d.end(), kind))
                    taken.append(kind)
        if sum(k == "@" for k in taken) + m[0].count("@") * ("@" not in taken) == 1:
            out += sorted(edits)
    return out


def deobfuscate(text: str) -> Rewrite:
    """The text after all transducers, with its way back."""
    r = Rewrite(text)
    for step in (_homoglyphs, _spelled, _dotted, _addresses):
        r.apply(step(r.text))
    return r


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each by kind, then start."""
    base = find(text)
    r = deobfuscate(text)
    if not r.edited:
        return base, []
    held = {kind: ([s for k, s, _ in base if k == kind], [e for k, _, e in base if k == kind]) for kind in KINDS}  # ascending, and apart from each other
    added: dict[tuple[str, int, int], None] = {}
    for kind, a, b in find(r.text):
        start, end = r.source(a, b)
        starts, ends = held[kind]
        k = bisect.bisect_right(starts, start) - 1
        if k < 0 or ends[k] < end:
            added[kind, start, end] = None
    return base, list(added)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def detect(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256, spans (all spans, kind:start:end in code points, end exclusive). A null or empty text has none; rows that repeat are scanned each; an empty table gives an empty table; extra columns are left alone."""
    import pyarrow as pa

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"]

    def run(batches):
        import hashlib

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols = [[] for _ in names[1:]]
                for t in part.column(1):
                    base, added = scan(t.as_py() or "")
                    row = [*[sum(k == kind for k, _, _ in base) for kind in KINDS], len(added), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)]
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(cols)]], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
