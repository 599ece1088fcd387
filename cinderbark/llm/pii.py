"""Personal data in plain and in disguised form, with spans of the source text.

Plain identifiers are matched on the text itself.  For disguised ones a chain of
transducers rewrites the text and keeps, for each character it writes, the span
of source characters it stands for:

1. characters: homoglyphs (Cyrillic, Greek), full-width and other decimal
   digits, look-alike dots, dashes and spaces; invisible characters vanish;
2. words: spelled digits in a row (``DIGITS_IN_A_ROW`` at least, with ``plus``
   before and ``dot`` between), ``at`` and ``dot`` in brackets, and
   bare ``name at host dot tld``, where the dots of a host may be of any kind;
   ``name at host.tld`` only if the name has signs or digits or follows a word
   for mail, since else it is plain prose (look at example.com); ``dot`` between
   four groups of one to three digits.

The same detectors run on the result, and what they find is mapped back.  Such a
span counts if rewriting touched it and no plain span of its kind overlaps it,
so plain spans always stay.

Results.  Spans are in code points, end exclusive.  Null and empty texts have no
spans.  Steps are linear in the text, and a span is mapped back in a search of
each step's edits, so very long texts full of findings take no longer a byte.
Each row is judged by itself; repeated rows, ties and null ids are carried along;
an empty table gives an empty result.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm.common import arrow_fields

KINDS = ("email", "ip", "card", "phone")
#: Fewer spelled digits in a row are left alone.
DIGITS_IN_A_ROW = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα", "ABEKMHOPCTYXaeopcyxijsdhABEZHIKMNOPTYXova"))
# Signs that look like those in identifiers.
_SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＋": "+", "﹢": "+", " ": " ", " ": " ", " ": " ", " ": " "}
# Characters that show nothing.
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile("[" + "".join(_LOOKALIKES) + "".join(_SIGNS) + _INVISIBLE + "٠-٩۰-۹०-९０-９Ａ-Ｚａ-ｚ\U0001d7ce-\U0001d7ff]")

# The digits in English, German, French and Spanish.
_SPELLED = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    "oh": "0",
}
_DIGIT_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + "|[0-9])"
_GAP = r"[\s,-]{1,3}"
_ROW = re.compile(rf"(?:\bplus{_GAP}|\+\s?)?\b{_DIGIT_WORD}(?:(?:{_GAP}|{_GAP}(?:dot|point){_GAP}){_DIGIT_WORD}){{{DIGITS_IN_A_ROW - 1},}}\b", re.I)
_ITEM = re.compile(rf"plus|dot|point|{_DIGIT_WORD}|\+", re.I)
_AT = r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*"
_DOT = r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*"
_BRACKETS = re.compile(rf"(?<=[A-Za-z0-9])(?:({_AT})|({_DOT}))(?=[A-Za-z0-9])", re.I)
_ANY_DOT = rf"(?:\s{{1,3}}dot\s{{1,3}}|{_DOT}|\.)"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(\s{{1,3}}at\s{{1,3}})(?={_LABEL}{_ANY_DOT}{_LABEL})", re.I)
_BARE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_BARE_LABELS = re.compile(rf"{_LABEL}(?:{_ANY_DOT}{_LABEL}){{1,5}}", re.I)
_DOTS = re.compile(_ANY_DOT, re.I)
#: What makes ``name at host.tld`` an address where no dot is disguised: signs in the name, or a word for mail before it.
_ACCOUNT = re.compile(r"[0-9._%+-]")
_MAIL_WORD = re.compile(r"\be-?mail(?:\s+(?:to|me|is))?[:\s]\s{0,2}\Z|\bmail(?:to|\s+to)?[:\s]\s{0,2}\Z", re.I)
# Words that stand before ``at`` in prose, also after a word for mail.
_PROSE = frozenset("us me him her them it you one all address addresses list lists server servers service client is are be was were sent found only here there now available".split())
_QUAD = re.compile(r"(?<![\w.])(?<!dot\s)(?<!point\s)[0-9]{1,3}(?:(?:\s{1,3}(?:dot|point)\s{1,3}|\.)[0-9]{1,3}){3}(?![\w]|\.[0-9]|\s{1,3}(?:dot|point)\s{1,3}[0-9])", re.I)
_QUAD_DOT = re.compile(r"\s{1,3}(?:dot|point)\s{1,3}", re.I)
# Last labels that a bare ``at`` and ``dot`` need; without them it may be plain prose.
_LAST_LABELS = frozenset(
    """com org net edu gov mil int info biz name pro coop aero museum mobi jobs tel travel cat asia post arpa app dev xyz online site tech store shop blog cloud
    ai io co me tv cc academy agency art bank center club company design digital email events expert global group guru health host hosting link live love
    ltd media network news one page press world space solutions studio support systems team today tools top university video website wiki work works zone
    ac ad ae af ag al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cd cf cg ch ci ck cl cm cn cr cu cv cw cx cy cz
    de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it
    je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni
    nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg
    th tj tk tl tm tn to tr tt tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
)
_BARE_HOST = re.compile(r"(?<=@)[A-Za-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]{1,63}){1,5}", re.I)
_BARE_DOT = re.compile(r"\s{1,3}dot\s{1,3}", re.I)


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        m = _HOST.match(text, at)
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the plain identifiers, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- transducers ------------------------------------------------------------


class Tape:
    """A text and, for each of its characters, the source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.edits = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, given in order; the edits of each step are kept to map spans back."""
        if not edits:
            return
        out, at, grown, starts, kept = [], 0, 0, [], []
        for start, end, new in edits:
            out += self.text[at:start], new
            starts.append(start + grown)
            kept.append((len(new), start, end))
            grown += len(new) - (end - start)
            at = end
        self.text = "".join(out) + self.text[at:]
        self.edits.append((starts, kept))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span of the present text; whether rewriting touched it."""
        touched = False
        for starts, kept in reversed(self.edits):
            first, last = bisect_left(starts, start), bisect_left(starts, end)
            touched |= last > first or (first > 0 and start < starts[first - 1] + kept[first - 1][0])
            start, end = _back(starts, kept, start)[0], _back(starts, kept, end - 1)[1]
        return start, end, touched


def _back(starts: list[int], kept: list[tuple[int, int, int]], at: int) -> tuple[int, int]:
    """The span before a step of the character at ``at`` after it; the last edit before it holds the shift of all."""
    k = bisect_right(starts, at) - 1
    if k < 0:
        return at, at + 1
    n, start, end = kept[k]
    if at < starts[k] + n:
        return start, end
    place = end + at - starts[k] - n
    return place, place + 1


def _characters(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ODD.finditer(text):
        c = m[0]
        if c in _INVISIBLE:
            new = ""
        elif c in _LOOKALIKES or c in _SIGNS:
            new = _LOOKALIKES.get(c) or _SIGNS[c]
        else:
            new = unicodedata.normalize("NFKC", c)
            new = new if new.isascii() else str(unicodedata.decimal(c))
        out.append((m.start(), m.end(), new))
    return out


def _digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ROW.finditer(text):
        if not any(c.isalpha() for c in m[0]):
            continue
        new = [{"plus": "+", "+": "+", "dot": ".", "point": "."}.get(w := x[0].lower()) or _SPELLED.get(w, w) for x in _ITEM.finditer(m[0])]
        items = list(_ITEM.finditer(m[0]))
        for k, (x, y) in enumerate(zip(items, new)):
            end = items[k + 1].start() if k + 1 < len(items) else x.end()
            out.append((m.start() + x.start(), m.start() + (x.end() if k + 1 == len(items) else end), y))
    return out


def _brackets(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETS.finditer(text)]


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Edits of ``name at host`` where a dot is disguised, or where the name is one of an account."""
    out, done = [], 0
    for m in _BARE_AT.finditer(text):
        local = _BARE_LOCAL.search(text[max(0, m.start() - 65) : m.start()])
        host = _BARE_LABELS.match(text, m.end())
        if m.start() < done or not local or len(local[0]) > 64 or not host:
            continue
        dots = list(_DOTS.finditer(text, *host.span()))
        ends = [d.start() for d in dots[1:]] + [host.end()]
        while dots and text[dots[-1].end() : ends[-1]].lower() not in _LAST_LABELS:
            dots.pop()
            ends.pop()
        hidden = [d for d in dots if d[0] != "."]
        if not dots or not (hidden or _accounts(text, m.start() - len(local[0]), local[0])):
            continue
        out.append((*m.span(), "@"))
        out += [(*d.span(), ".") for d in hidden]
        done = ends[-1]
    return out


def _accounts(text: str, start: int, local: str) -> bool:
    if local.lower() in _PROSE:
        return False
    return bool(_ACCOUNT.search(local.strip(".%+-_"))) and any(c.isalpha() for c in local) or bool(_MAIL_WORD.search(text[max(0, start - 16) : start]))


def _quads(text: str) -> list[tuple[int, int, str]]:
    return [(*d.span(), ".") for m in _QUAD.finditer(text) for d in _QUAD_DOT.finditer(text, *m.span())]


def _hosts(text: str) -> list[tuple[int, int, str]]:
    return [(*d.span(), ".") for m in _BARE_HOST.finditer(text) if m[0].replace(".", " ").split()[-1].lower() in _LAST_LABELS for d in _BARE_DOT.finditer(text, *m.span())]


def disguised(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of identifiers that only rewriting shows."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_characters(text))
    low = tape.text.lower()
    if "dot" in low or "@" in low or "at" in low:
        if "at" in low:
            tape.rewrite(_bare(tape.text))
        if any(c in low for c in ("[", "(", "{", "<")):
            tape.rewrite(_brackets(tape.text))
        if "dot" in low:
            tape.rewrite(_hosts(tape.text))
    if "dot" in low or "point" in low:
        tape.rewrite(_quads(tape.text))
    tape.rewrite(_digits(tape.text))
    if not tape.edits:
        return []
    taken = [([a for a, k, _ in plain if k == kind], [b for _, k, b in plain if k == kind]) for kind in range(len(KINDS))]
    out = []
    for start, kind, end in find(tape.text):
        a, b, touched = tape.source(start, end)
        starts, ends = taken[kind]
        k = bisect_left(starts, b) - 1  # plain spans of a kind lie apart, in order
        if touched and (k < 0 or ends[k] <= a):
            out.append((a, kind, b))
    return sorted(set(out))


_SPANS = "doc_id bigint, kinds array<string>, starts array<bigint>, ends array<bigint>, disguised array<boolean>"


def _detect(batches):
    fields = arrow_fields(_SPANS)
    for b in batches:
        columns: list[list] = [[], [], [], []]
        for text in b.column("text").to_pylist():
            text = text or ""
            plain = find(text)
            both = sorted([(*p, False) for p in plain] + [(*p, True) for p in disguised(text, plain)])
            for c, values in zip(columns, ([KINDS[x[1]] for x in both], [x[0] for x in both], [x[2] for x in both], [x[3] for x in both])):
                c.append(values)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:]))], schema=fields)


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and parallel arrays kinds, starts, ends, disguised, by start and kind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_detect, _SPANS)


def digest(spans: DataFrame) -> DataFrame:
    """The digest columns of ``op5``; counts and ``base_sha256`` are of plain spans, ``spans`` has all."""
    joined = "transform({}, x -> concat(x.kinds, ':', x.starts, ':', x.ends))"
    zipped = "arrays_zip(kinds, starts, ends, disguised)"
    base = f"filter({zipped}, x -> not x.disguised)"
    return spans.select(
        "doc_id",
        *(F.expr(f"cast(size(filter({base}, x -> x.kinds = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS),
        F.expr(f"sha2(concat_ws(',', {joined.format(base)}), 256)").alias("base_sha256"),
        F.expr(f"concat_ws(',', {joined.format(zipped)})").alias("spans"),
        F.expr("cast(size(filter(disguised, x -> x)) as bigint)").alias("n_disguised"),
    )
