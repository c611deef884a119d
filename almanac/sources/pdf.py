"""Words of a PDF with their places on the page.

Objects are found by their marks in the file and in object streams, the later
of a number counting, so neither a cross-reference table nor its absence
matters. Streams may be packed by Flate, with PNG predictors, and ASCIIHex. A
page's text operators move a cursor; codes become text by the font's ToUnicode
map, else as Latin text; widths come from the font. A word ends at a blank, a
new line or a gap of a third of the letter size. What cannot be read (no PDF,
an encrypted one, another filter, a page tree that never ends) raises ValueError.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|[\[\]{}]|/[^\s<>\[\]{}()/%]*|\((?:\\.|[^\\()])*|<[0-9A-Fa-f\s]*>|[^\s<>\[\]{}()/%]+)", re.S)
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
OBJECT = re.compile(rb"(?<![\d.])(\d+)\s+\d+\s+obj\b")
REFERENCE = re.compile(rb"\s*(\d+)\s+\d+\s+R(?![A-Za-z])")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A word ends where the next letter is this far, in letter sizes, from where it should be.
GAP = 1 / 3


class Ref(NamedTuple):
    number: int


class Word(NamedTuple):
    page: int
    x: float
    y: float
    word: str


class Name(str):
    __slots__ = ()


class Stream(NamedTuple):
    facts: dict
    data: bytes


class Reader:
    """One value after another from ``data``; an operator comes as bytes, the end as None."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def value(self):
        if m := REFERENCE.match(self.data, self.at):
            self.at = m.end()
            return Ref(int(m[1]))
        m = TOKEN.match(self.data, self.at)
        if not m:
            return None
        self.at, t = m.end(), m[1]
        if t == b"<<":
            out = {}
            while isinstance(key := self.value(), Name):
                out[str(key)] = self.value()
            return out
        if t == b"[":
            out = []
            while (v := self.value()) is not None and v != b"]":
                out.append(v)
            return out
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), t[1:]).decode("latin-1"))
        if t[:1] == b"(":
            return self.literal(m.start(1))
        if t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytearray.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return float(t) if NUMBER.match(t) else t

    def literal(self, at: int) -> bytearray:
        """A string in brackets, which nest; strings are bytearrays, so that they differ from operators."""
        out, depth, at, data = bytearray(), 1, at + 1, self.data
        while depth:
            c = data[at : at + 1]
            if not c:
                raise ValueError("a string does not end")
            at += 1
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}|\r\n|.", re.S).match(data, at):
                    at, e = m.end(), m[0]
                    out += bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[:1] < b"8" else b"" if e[:1] in b"\r\n" else ESCAPES.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
        self.at = at
        return out


def unpacked(facts: dict, data: bytes) -> bytes:
    listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]
    for n, kind in enumerate(listed(facts.get("Filter"))):
        if kind == "FlateDecode":
            data = zlib.decompressobj().decompress(data)
            own = dict(enumerate(listed(facts.get("DecodeParms")))).get(n) or {}
            if own.get("Predictor", 1) >= 10:
                data = unpredicted(data, int(own.get("Columns", 1)), max(1, int(own.get("Colors", 1) * own.get("BitsPerComponent", 8)) // 8))
        elif kind == "ASCIIHexDecode":
            digits = re.sub(rb"\s", b"", data.partition(b">")[0])
            data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            raise ValueError(f"filter {kind} is not supported")
    return data


def unpredicted(data: bytes, columns: int, size: int) -> bytes:
    """Rows before which a byte names the PNG predictor: none, left, up or both's mean."""
    width, above, out = columns * size, bytearray(columns * size), bytearray()
    for start in range(0, len(data), width + 1):
        kind, row = data[start], bytearray(data[start + 1 : start + 1 + width])
        if kind > 3:
            raise ValueError(f"predictor {kind} is not supported")
        for i in range(len(row)):
            left = row[i - size] if i >= size else 0
            row[i] = (row[i] + (0, left, above[i], (left + above[i]) // 2)[kind]) & 255
        above = row
        out += row
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, object] = {}
        at = 0
        while m := OBJECT.search(data, at):
            reader = Reader(data, m.end())
            value, at = reader.value(), reader.at
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream\r?\n").match(data, at)):
                length = value.get("Length")
                end = s.end() + int(length) if isinstance(length, float) else -1
                if not re.compile(rb"\s*endstream").match(data, end) if end >= 0 else True:
                    end = data.find(b"endstream", s.end())
                    if end < 0:
                        raise ValueError("a stream does not end")
                value, at = Stream(value, data[s.end() : end]), end
            self.objects[int(m[1])] = value
        for holder in [v for v in self.objects.values() if isinstance(v, Stream) and v.facts.get("Type") == "ObjStm"]:
            body, first = self.data(holder), int(holder.facts["First"])
            heads = [int(x) for x in body[:first].split()]
            for number, offset in zip(heads[::2], heads[1::2], strict=True):
                self.objects.setdefault(number, Reader(body, first + offset).value())
        facts = [v.facts if isinstance(v, Stream) else v for v in self.objects.values()]
        if b"/Encrypt" in data and (any(isinstance(f, dict) and "Encrypt" in f for f in facts) or re.search(rb"trailer[^%]*?/Encrypt", data)):
            raise ValueError("the file is encrypted")
        self.catalogs = [f for f in facts if isinstance(f, dict) and f.get("Type") == "Catalog"]

    def get(self, value):
        for _ in range(50):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        raise ValueError("a reference never ends")

    def data(self, stream: Stream) -> bytes:
        return unpacked({k: self.get(v) for k, v in stream.facts.items()}, stream.data)

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Every page with its resources, in order."""
        if not self.catalogs:
            raise ValueError("no page tree")
        seen: set[int] = set()

        def below(node, resources: dict) -> Iterator[tuple[dict, dict]]:
            if isinstance(node, Ref):
                if node.number in seen:
                    raise ValueError("the page tree never ends")
                seen.add(node.number)
            node = self.get(node)
            if isinstance(node, dict):
                resources = self.get(node.get("Resources")) or resources
                if "Kids" in node:
                    for kid in self.get(node["Kids"]) or []:
                        yield from below(kid, resources)
                else:
                    yield node, resources

        yield from below(self.catalogs[-1].get("Pages"), {})


class Font:
    def __init__(self, document: Document, facts: dict):
        get = document.get
        self.wide = facts.get("Subtype") == "Type0"
        self.names: dict[int, str] = {}
        self.ranges: list[tuple[int, int, int]] = []
        self.known: dict[bytes, tuple[str, float]] = {}
        self.told: dict[int, tuple[str, float]] = {}
        self.odd: set[int] = set()
        if isinstance(told := get(facts.get("ToUnicode")), Stream):
            self.read_map(document.data(told))
        if self.wide:
            own = get((get(facts.get("DescendantFonts")) or [{}])[0]) or {}
            self.usual, self.widths, listed = get(own.get("DW", 1000.0)), {}, get(own.get("W")) or []
            while len(listed) >= 2:
                first, second = int(listed[0]), get(listed[1])
                n = 2 if isinstance(second, list) else 3
                widths = second if n == 2 else [listed[2]] * (int(second) - first + 1)
                self.widths.update({first + i: get(w) for i, w in enumerate(widths)})
                listed = listed[n:]
        else:
            self.usual, first = 500.0, int(get(facts.get("FirstChar", 0.0)))
            self.widths = {first + i: get(w) for i, w in enumerate(get(facts.get("Widths")) or [])}

    def read_map(self, body: bytes) -> None:
        text = lambda b: bytes(b).decode("utf-16-be", "replace")
        for kind, part in re.findall(rb"beginbf(char|range)(.*?)endbf", body, re.S):
            reader, values = Reader(part), []
            while (v := reader.value()) is not None:
                values.append(v)
            if kind == b"char":
                self.names.update({int.from_bytes(a): text(b) for a, b in zip(values[::2], values[1::2], strict=True)})
            else:
                for low, high, to in zip(values[::3], values[1::3], values[2::3], strict=True):
                    if isinstance(to, list):
                        self.names.update({int.from_bytes(low) + i: text(b) for i, b in enumerate(to)})
                    elif len(to) == 2:
                        self.ranges.append((int.from_bytes(low), int.from_bytes(high), int.from_bytes(to)))

    def letters(self, data: bytes) -> Iterator[tuple[str, float]]:
        """(text, width in letter sizes) of each code; two halves of a character come as one."""
        size, half = 2 if self.wide else 1, ""
        for at in range(0, len(data), size):
            letter = self.known.get(code := data[at : at + size])
            text, width = letter or self.letter(code)
            if "\ud800" <= text <= "\udbff":
                half = text
                continue
            if half:
                text, half = (half + text).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), ""
            yield text, width

    def run(self, data: bytes) -> tuple | None:
        """(texts, widths) of all codes; None if there is none, half of one, half of a character or a code without a text."""
        size = 2 if self.wide else 1
        if not data or len(data) % size:
            return None
        codes = struct.unpack(f">{len(data) // 2}H", data) if self.wide else data
        try:
            letters = [self.told[code] for code in codes]
        except KeyError:
            for code in set(codes) - self.told.keys():
                self.told[code] = self.letter(code.to_bytes(size))
                if self.told[code][0] == "" or "\ud800" <= self.told[code][0] <= "\udbff":
                    self.odd.add(code)
            letters = [self.told[code] for code in codes]
        return tuple(zip(*letters, strict=True)) if not self.odd or self.odd.isdisjoint(codes) else None

    def letter(self, data: bytes) -> tuple[str, float]:
        """(text, width) of one code, kept in ``known``."""
        code = int.from_bytes(data)
        text = self.names.get(code)
        if text is None:
            text = next((chr(to + code - low) for low, high, to in self.ranges if low <= code <= high), None)
        if text is None:
            text = "�" if self.wide else bytes([code]).decode("cp1252", "replace")
        self.known[data] = text, self.widths.get(code, self.usual) / 1000
        return self.known[data]


def times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Page:
    """Runs text operators and gathers words, y growing downwards."""

    def __init__(self, document: Document, number: int, height: float):
        self.document, self.number, self.height = document, number, height
        self.words: list[Word] = []
        self.letters, self.start, self.expected, self.fonts = "", (0.0, 0.0), None, {}

    def end_word(self) -> None:
        if self.letters:
            self.words.append(Word(self.number, round(self.start[0], 2), round(self.height - self.start[1], 2), self.letters))
        self.letters, self.expected = "", None

    def show(self, s: dict, data: bytes) -> None:
        """Letters of one text differ only in how far they have moved, so the first alone can stand apart from what was shown before.

        A text is gone through as a whole; letter by letter only where letters run backwards, come in halves or have no text.
        """
        if not s["font"]:
            return
        (a, b, c, d, e, f), (g, h, k, m, p, q) = s["text"], s["base"]
        size, char, space, scale = s["size"], s["char"], s["blank"], s["scale"]
        x, y, expected, first = e * g + f * k + p, e * h + f * m + q, self.expected, True
        if size >= 0 and (run := s["font"].run(data)):
            texts, widths = run
            if expected and (abs(y - expected[1]) > 0.5 * size or abs(x - expected[0]) > GAP * size):
                self.end_word()
            plain = not char and not space and scale == 1
            moves = [width * size for width in widths] if plain else [(width * size + char + space * (text == " ")) * scale for text, width in zip(texts, widths, strict=True)]
            across = list(accumulate([move * a for move in moves], initial=e))
            down = list(accumulate([move * b for move in moves], initial=f)) if b else [f] * len(across)
            at = 0  # a word ends at each blank, and at the end stays open
            for end in [*(i for i, text in enumerate(texts) if text == " "), len(texts)]:
                if end > at:
                    if not self.letters:
                        self.start = across[at] * g + down[at] * k + p, across[at] * h + down[at] * m + q
                    self.letters += "".join(texts[at:end])
                if end < len(texts):
                    self.end_word()
                at = end + 1
            e, f = across[-1], down[-1]
            self.expected = None if texts[-1] == " " else (e * g + f * k + p, e * h + f * m + q)
            s["text"] = (a, b, c, d, e, f)
            return
        for text, width in s["font"].letters(data):
            if (first or size < 0) and expected and (abs(y - expected[1]) > 0.5 * size or abs(x - expected[0]) > GAP * size):
                self.end_word()
            first, blank = False, text == " "
            if blank:
                self.end_word()
            else:
                if not self.letters:
                    self.start = x, y
                self.letters += text
            move = (width * size + char + space * blank) * scale
            e, f = move * a + e, move * b + f
            x, y = e * g + f * k + p, e * h + f * m + q
            self.expected = expected = None if blank else (x, y)
        s["text"] = (a, b, c, d, e, f)

    def run(self, body: bytes, resources: dict, base: tuple = UNIT, depth: int = 0) -> None:
        get = self.document.get
        s = {"base": base, "text": UNIT, "line": UNIT, "font": None, "size": 1.0, "char": 0.0, "blank": 0.0, "scale": 1.0, "lead": 0.0}
        saved, given, reader = [], [], Reader(body)

        def to(x: float, y: float) -> None:
            s["line"] = s["text"] = times((1, 0, 0, 1, x, y), s["line"])

        while (v := reader.value()) is not None:
            if not isinstance(v, bytes):
                given.append(v)
                continue
            op = v.decode("latin-1")
            if op == "q":
                saved.append(dict(s))
            elif op == "Q" and saved:
                s = saved.pop()
            elif op == "cm":
                s["base"] = times(tuple(given[-6:]), s["base"])
            elif op == "BT":
                s["text"] = s["line"] = UNIT
            elif op == "Tf":
                fonts = get(resources.get("Font")) or {}
                if given[-2] not in self.fonts and (facts := get(fonts.get(given[-2]))):
                    self.fonts[given[-2]] = Font(self.document, facts)
                s["font"], s["size"] = self.fonts.get(given[-2]), given[-1]
            elif op in ("Tc", "Tw", "TL"):
                s[{"Tc": "char", "Tw": "blank", "TL": "lead"}[op]] = given[-1]
            elif op == "Tz":
                s["scale"] = given[-1] / 100
            elif op in ("Td", "TD"):
                s["lead"] = -given[-1] if op == "TD" else s["lead"]
                to(*given[-2:])
            elif op == "Tm":
                s["line"] = s["text"] = tuple(given[-6:])
            elif op in ("T*", "'", '"'):
                if op == '"':
                    s["blank"], s["char"] = given[-3:-1]
                to(0, -s["lead"])
            if op in ("Tj", "'", '"'):
                self.show(s, bytes(given[-1]))
            elif op == "TJ":
                for part in given[-1]:
                    if isinstance(part, bytearray):
                        self.show(s, bytes(part))
                    else:
                        s["text"] = times((1, 0, 0, 1, -part / 1000 * s["size"] * s["scale"], 0), s["text"])
            elif op == "Do" and depth < 5 and isinstance(form := get((get(resources.get("XObject")) or {}).get(given[-1])), Stream) and form.facts.get("Subtype") == "Form":
                self.run(self.document.data(form), get(form.facts.get("Resources")) or resources, times(tuple(get(form.facts.get("Matrix")) or UNIT), s["base"]), depth + 1)
            elif op == "BI":  # an image in the page
                end = re.compile(rb"\sEI(?=\s|\Z)").search(body, reader.at)
                reader.at = end.end() if end else len(body)
            given = []
        self.end_word()


def words(data: bytes) -> list[Word]:
    """The words of all pages, pages from 1, in the order in which they are shown."""
    document, out = Document(data), []
    for number, (facts, resources) in enumerate(document.pages(), 1):
        box = document.get(facts.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
        content = document.get(facts.get("Contents"))
        streams = [document.get(c) for c in content] if isinstance(content, list) else [content]
        page = Page(document, number, float(document.get(box[3])))
        page.run(b"\n".join(document.data(c) for c in streams if isinstance(c, Stream)), resources)
        out += page.words
    return out
