"""Text of PDF pages with the standard library: objects, Flate streams, page tree, and the text operators.

Fonts are read through their ToUnicode maps, else as WinAnsi. Files with other filters than Flate on their
texts, or with encryption, are errors. Positions decide only where lines and words break.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator


class InvalidPdf(ValueError):
    """No PDF, or without pages."""


class EncryptedPdf(ValueError):
    """A PDF that wants a password."""


class Ref(int):
    """The number of an object that is referred to."""


class Name(str):
    """A name."""


class Word(str):
    """An operator or keyword."""


_BLANK = b"\x00\t\n\x0c\r "
_ENDS = _BLANK + b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")


class Reader:
    """Reads the values of PDF syntax from bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def value(self) -> object:
        """The next value; None at the end, a Word for an operator."""
        data = self.data
        self.at = _SKIP.match(data, self.at).end()
        if self.at >= len(data):
            return None
        c = data[self.at : self.at + 1]
        if c == b"/":
            m = _REGULAR.match(data, self.at + 1)
            self.at = m.end() if m else self.at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x.group(1), 16)]), m.group(0)).decode("latin-1") if m else "")
        if c == b"(":
            return self._string()
        if data[self.at : self.at + 2] == b"<<":
            self.at += 2
            return self._dictionary()
        if c == b"<":
            end = data.find(b">", self.at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while (x := self.value()) is not None and x != "]":
                self._take(out, x)
            return out
        m = _REGULAR.match(data, self.at)
        if not m:
            self.at += 2 if data[self.at : self.at + 2] == b">>" else 1
            return Word(data[self.at - (2 if data[self.at - 2 : self.at] == b">>" else 1) : self.at].decode("latin-1"))
        self.at = m.end()
        word = m.group(0)
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": Word("null")}.get(word, Word(word.decode("latin-1")))

    @staticmethod
    def _take(out: list, x: object) -> None:
        """Append a value; an R joins the two numbers before it to a reference."""
        if isinstance(x, Word) and x == "R" and len(out) >= 2:
            out[-2:] = [Ref(out[-2])]
        else:
            out.append(x)

    def _dictionary(self) -> dict:
        parts: list = []
        while (x := self.value()) is not None and not (isinstance(x, Word) and x == ">>"):
            self._take(parts, x)
        return {k: v for k, v in zip(parts[::2], parts[1::2]) if isinstance(k, Name)}

    def _string(self) -> bytes:
        data, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(data):
            c = data[i : i + 1]
            if c == b"\\":
                n = data[i + 1 : i + 2]
                if m := re.compile(rb"[0-7]{1,3}").match(data, i + 1):
                    out.append(int(m.group(0), 8) & 255)
                    i = m.end()
                    continue
                if n in b"\r\n":
                    i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(n, n)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                break
            out += c
        self.at = i
        return bytes(out)


class Document:
    """The objects of a file by their numbers, found by their marks, so that a broken table of references doesn't matter."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise InvalidPdf
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data):
            raise EncryptedPdf
        for m in _OBJECT.finditer(data):
            reader = Reader(data, m.end())
            value = reader.value()
            self.objects[int(m.group(1))] = (value, self._stream(data, reader.at, value))
        for value, raw in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and raw is not None:
                self._unpack(value, self.decoded(value, raw))

    @staticmethod
    def _stream(data: bytes, at: int, value: object) -> bytes | None:
        m = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(data, at)
        if not m or not isinstance(value, dict):
            return None
        length = value.get("Length")
        if type(length) is int and data[m.end() + length :].lstrip(_BLANK)[:9] == b"endstream":
            return data[m.end() : m.end() + length]
        end = data.find(b"endstream", m.end())
        return data[m.end() : end if end >= 0 else len(data)]

    def _unpack(self, value: dict, data: bytes) -> None:
        reader = Reader(data)
        pairs = [(reader.value(), reader.value()) for _ in range(int(self.of(value.get("N")) or 0))]
        for number, offset in pairs:
            if type(number) is int and number not in self.objects:
                self.objects[number] = (Reader(data, int(self.of(value.get("First"))) + offset).value(), None)

    def of(self, x: object) -> object:
        """What a value refers to."""
        for _ in range(20):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(int(x), (None, None))[0]
        return x

    def decoded(self, value: dict, raw: bytes) -> bytes:
        filters = self.of(value.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if self.of(f) not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {f}")
            raw = zlib.decompressobj().decompress(raw)
        params = self.of(value.get("DecodeParms"))
        params = params[0] if isinstance(params, list) and params else params
        if isinstance(self.of(params), dict) and int(self.of(self.of(params).get("Predictor", 1)) or 1) > 1:
            raise ValueError("predictor")
        return raw

    def stream(self, x: object) -> bytes:
        """The decoded stream that is referred to, those of an array one after the other."""
        if isinstance(self.of(x), list):
            return b"\n".join(self.stream(y) for y in self.of(x))
        value, raw = self.objects.get(int(x), (None, None)) if isinstance(x, Ref) else (None, None)
        return self.decoded(value, raw) if isinstance(value, dict) and raw is not None else b""

    def pages(self) -> Iterator[dict]:
        """The pages in the order of the page tree, with what they inherit."""
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        seen: set[int] = set()

        def walk(x: object, inherited: dict) -> Iterator[dict]:
            if isinstance(x, Ref):
                if int(x) in seen:
                    return
                seen.add(int(x))
            node = self.of(x)
            if not isinstance(node, dict):
                return
            now = inherited | {k: v for k, v in node.items() if k == "Resources"}
            if isinstance(self.of(node.get("Kids")), list):
                for kid in self.of(node["Kids"]):
                    yield from walk(kid, now)
            else:
                yield now | node

        if roots:
            yield from walk(roots[-1].get("Pages"), {})
        else:
            yield from (v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Page")


def unicode_map(data: bytes) -> tuple[dict[bytes, str], int]:
    """The texts of the codes of a ToUnicode map, and the bytes of a code."""
    reader, stack, out, width = Reader(data), [], {}, 1
    text = lambda b: b.decode("utf-16-be", "replace")
    while (x := reader.value()) is not None:
        if not isinstance(x, Word):
            stack.append(x)
            continue
        if x == "endcodespacerange" and stack and isinstance(stack[-1], bytes):
            width = len(stack[-1])
        elif x == "endbfchar":
            out.update({a: text(b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)})
        elif x == "endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for i in range(min(high - low + 1, 65536)):
                    to = c[i] if isinstance(c, list) else (int.from_bytes(c, "big") + i).to_bytes(len(c), "big") if isinstance(c, bytes) else b""
                    out[(low + i).to_bytes(len(a), "big")] = text(to)
        stack = []
    return out, width


def _shown(data: bytes, font: tuple[dict[bytes, str], int] | None) -> str:
    if not font:
        return data.decode("cp1252", "replace")
    codes, width = font
    return "".join(codes.get(data[i : i + width], "") for i in range(0, len(data), width))


def _page_text(doc: Document, page: dict) -> str:
    resources = doc.of(page.get("Resources")) or {}
    fonts: dict[str, tuple[dict[bytes, str], int] | None] = {}
    for name, ref in (doc.of(resources.get("Font")) or {}).items():
        font = doc.of(ref)
        if isinstance(font, dict):
            fonts[name] = unicode_map(doc.stream(font["ToUnicode"])) if "ToUnicode" in font else None
    reader, stack, out = Reader(doc.stream(page.get("Contents"))), [], []
    font, y, leading = None, None, 0.0

    def moved(to: float | None) -> None:
        nonlocal y
        if out and not out[-1].endswith("\n") and to is not None and y is not None and abs(to - y) > 0.1:
            out.append("\n")
        y = to

    while (x := reader.value()) is not None:
        if not isinstance(x, Word) or x == "null":
            stack.append(x)
            continue
        numbers = [float(n) for n in stack if isinstance(n, (int, float))]
        if x == "Tf" and stack and isinstance(stack[0], Name):
            font = fonts.get(stack[0])
        elif x == "BT":
            y = 0.0 if y is None else y
        elif x in ("Td", "TD") and len(numbers) >= 2:
            if x == "TD":
                leading = -numbers[-1]
            moved((y or 0.0) + numbers[-1])
        elif x == "TL" and numbers:
            leading = numbers[-1]
        elif x == "Tm" and len(numbers) >= 6:
            moved(numbers[-1])
        elif x == "T*":
            moved((y or 0.0) - (leading or 1.0))
        elif x in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            if x != "Tj":
                moved((y or 0.0) - (leading or 1.0))
            out.append(_shown(stack[-1], font))
        elif x == "TJ" and stack and isinstance(stack[-1], list):
            for part in stack[-1]:
                if isinstance(part, bytes):
                    out.append(_shown(part, font))
                elif isinstance(part, (int, float)) and part < -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        elif x == "BI":  # an image within the text
            end = re.compile(rb"[\s]EI(?=[\s])").search(reader.data, reader.at)
            reader.at = end.end() if end else len(reader.data)
        stack = []
    return "".join(out)


def page_texts(data: bytes) -> list[str]:
    """The text of every page of a PDF."""
    doc = Document(data)
    pages = list(doc.pages())
    if not pages:
        raise InvalidPdf
    return [_page_text(doc, p) for p in pages]
