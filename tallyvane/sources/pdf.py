"""A page parser for PDF files without any PDF library: text with positions, image regions, tables by alignment.

It reads what a plain producer writes: objects by their markers (compressed object streams included), Flate streams,
the page tree, text operators with their matrices, one-byte fonts (Windows Latin) and fonts with a ToUnicode map, and
placed image XObjects. Encrypted files and exotic fonts give no text, never an error.

Elements are yielded page by page, tables before text before figures, with boxes in points from the top left corner:
`word` rows (one a word, for captions), `table` (at least two consecutive lines of the same number of cells, two or
more, set apart by wide gaps), `text` (lines closer than one and a half line heights) and `chart` (image regions).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+\d*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        return d.decompress(data)
    except zlib.error:
        return b""


def _stream(body: bytes) -> bytes:
    m = re.search(rb"\bstream\r?\n", body)
    if not m:
        return b""
    data = body[m.end() : body.rfind(b"endstream")]
    return _inflate(data) if b"FlateDecode" in body[: m.start()] else data


def objects(content: bytes) -> dict[int, bytes]:
    """The bodies of a file's objects by number; a later one of the same number counts."""
    out = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            data, first = _stream(body), re.search(rb"/First\s+(\d+)", body)
            if not first:
                continue
            head = [int(x) for x in data[: int(first[1])].split() if x.isdigit()]
            places = list(zip(head[::2], head[1::2]))
            for (no, at), (_, end) in zip(places, [*places[1:], (0, len(data) - int(first[1]))]):
                out.setdefault(no, data[int(first[1]) + at : int(first[1]) + end])
    return out


def _entry(body: bytes, name: bytes, objs: dict[int, bytes]) -> bytes:
    """The value of a dictionary's entry, references resolved once."""
    m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", body)
    if not m:
        return b""
    rest = body[m.end() :]
    if r := re.match(rb"(\d+)\s+\d+\s+R", rest):
        return objs.get(int(r[1]), b"")
    if rest.startswith(b"<<"):
        depth = 0
        for t in re.finditer(rb"<<|>>", rest):
            depth += 1 if t.group() == b"<<" else -1
            if not depth:
                return rest[: t.end()]
    if rest.startswith(b"["):
        return rest[: rest.find(b"]") + 1]
    return re.split(rb"[/>\s]", rest, maxsplit=1)[0]


def pages(objs: dict[int, bytes]) -> Iterator[bytes]:
    """The page objects in the order of the page tree (of the file, if there is no tree); each once."""
    root = next((b for b in objs.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    tree, seen = _entry(root, b"Pages", objs), set()

    def walk(body: bytes, inherited: bytes) -> Iterator[bytes]:
        inherited = b"".join(b"/" + k + b" " + v for k in (b"MediaBox", b"Resources") if (v := _entry(body, k, objs))) + inherited
        for k in _REF.findall(_entry(body, b"Kids", objs)):
            if int(k) in seen:
                continue
            seen.add(int(k))
            kid = objs.get(int(k), b"")
            if re.search(rb"/Type\s*/Pages", kid):
                yield from walk(kid, inherited)
            else:
                yield kid + inherited

    found = list(walk(tree, b""))
    yield from found or (b for _, b in sorted(objs.items()) if re.search(rb"/Type\s*/Page(?!s)", b))


def _unicode_map(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                out[i] = chr(int(c, 16) + i - int(a, 16))
    return out


def _string(token: bytes, font: dict[int, str] | None, wide: bool) -> str:
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        raw = re.sub(rb"\\(\d{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if wide:
        return "".join((font or {}).get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))
    return "".join(font[b] if font and b in font else bytes([b]).decode("cp1252", "ignore") for b in raw)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_marks(page: bytes, objs: dict[int, bytes]) -> tuple[list[tuple], list[tuple], float, float]:
    """(runs (x0, y0, x1, y1, text), image boxes, width, height) of a page, from its top left corner."""
    box = [float(x) for x in re.findall(rb"[-+]?\d*\.?\d+", _entry(page, b"MediaBox", objs))[:4]]
    x_, y_, w, h = (box[0], box[1], box[2] - box[0], box[3] - box[1]) if len(box) == 4 else (0.0, 0.0, 612.0, 792.0)
    res = _entry(page, b"Resources", objs)
    fonts = {}
    for name, no in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", _entry(res, b"Font", objs)):
        body = objs.get(int(no), b"")
        fonts[name] = (_unicode_map(_stream(_entry(body, b"ToUnicode", objs))), b"/Type0" in body)
    images = {n for n, no in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", _entry(res, b"XObject", objs)) if re.search(rb"/Subtype\s*/Image", objs.get(int(no), b""))}
    m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
    data = b"\n".join(_stream(objs.get(int(r), b"")) for r in _REF.findall(m[1] if m else b""))
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, stack, tm, line, size, lead, font = one, [], one, one, 12.0, 0.0, ({}, False)
    args: list[bytes] = []
    runs, boxes = [], []

    def show(text: str) -> None:
        nonlocal tm
        at = _times(tm, ctm)
        height = abs(size * at[3]) or abs(size * at[1]) or size
        width = 0.5 * height * len(text)
        if text.strip():
            runs.append((at[4] - x_, h - (at[5] - y_) - 0.8 * height, at[4] - x_ + width, h - (at[5] - y_) + 0.2 * height, text))
        tm = _times((1, 0, 0, 1, 0.5 * size * len(text), 0), tm)

    num = lambda n: [float(x) for x in args[-n:]] if len(args) >= n and all(re.fullmatch(rb"[-+]?\d*\.?\d+", x) for x in args[-n:]) else None
    for t in _TOKEN.finditer(data):
        k = t.group()
        if k[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", k):
            args.append(k)
            continue
        if k == b"q":
            stack.append(ctm)
        elif k == b"Q" and stack:
            ctm = stack.pop()
        elif k == b"cm" and (v := num(6)):
            ctm = _times(tuple(v), ctm)
        elif k == b"BT":
            tm = line = one
        elif k == b"Tf" and len(args) > 1:
            font = fonts.get(args[-2][1:], ({}, False))
            size = (num(1) or [12.0])[0]
        elif k in (b"Td", b"TD") and (v := num(2)):
            lead = -v[1] if k == b"TD" else lead
            tm = line = _times((1, 0, 0, 1, v[0], v[1]), line)
        elif k == b"Tm" and (v := num(6)):
            tm = line = tuple(v)
        elif k == b"TL" and (v := num(1)):
            lead = v[0]
        elif k in (b"T*", b"'", b'"'):
            tm = line = _times((1, 0, 0, 1, 0, -lead), line)
        if k in (b"Tj", b"'", b'"') and args:
            show(_string(args[-1], *font))
        elif k == b"TJ":
            # pieces of one string; a wide negative step is a space
            text = ""
            for a in args:
                if a[:1] in b"(<":
                    text += _string(a, *font)
                elif a not in (b"[", b"]") and a[:1] != b"/" and float(a) < -200:
                    text += " "
            show(text)
        elif k == b"Do" and args and args[-1][1:] in images:
            xs, ys = (ctm[4], ctm[4] + ctm[0] + ctm[2]), (ctm[5], ctm[5] + ctm[1] + ctm[3])
            boxes.append((min(xs) - x_, h - (max(ys) - y_), max(xs) - x_, h - (min(ys) - y_)))
        args = []
    return runs, boxes, w, h


def _lines(runs: list[tuple]) -> list[list[tuple]]:
    """Runs of one height as lines, from the top, each from the left."""
    out: list[list[tuple]] = []
    for r in sorted(runs, key=lambda r: (r[3], r[0])):
        if out and abs(out[-1][0][3] - r[3]) < 0.4 * max(r[3] - r[1], 1.0):
            out[-1].append(r)
        else:
            out.append([r])
    return [sorted(x) for x in out]


def _cells(line: list[tuple]) -> list[tuple]:
    """A line's runs joined where no wide gap parts them."""
    out: list[tuple] = []
    for r in line:
        gap = r[0] - out[-1][2] if out else 0.0
        if out and gap < 1.2 * (r[3] - r[1]):
            a = out[-1]
            out[-1] = (a[0], min(a[1], r[1]), max(a[2], r[2]), max(a[3], r[3]), a[4] + ("" if gap < 0.15 * (r[3] - r[1]) or a[4].endswith(" ") else " ") + r[4])
        else:
            out.append(r)
    return out


def _box(parts: list[tuple]) -> dict[str, float]:
    return {"x0": min(p[0] for p in parts), "y0": min(p[1] for p in parts), "x1": max(p[2] for p in parts), "y1": max(p[3] for p in parts)}


def pdf_parser(content: bytes) -> Iterator[dict]:
    """Elements of a PDF file (see the module); a file that is none gives nothing."""
    if not content.lstrip()[:5].startswith(b"%PDF"):
        return
    objs = objects(content)
    for no, page in enumerate(pages(objs), 1):
        runs, boxes, w, h = page_marks(page, objs)
        rows = [_cells(x) for x in _lines(runs)]
        for r in (c for x in rows for c in x):
            x = r[0]
            for word in r[4].split():
                yield {"element_type": "word", "content": word, "page": no, "page_area": w * h, "bbox": {"x0": x, "y0": r[1], "x1": x + len(word), "y1": r[3]}}
                x += (len(word) + 1) * (r[2] - r[0]) / max(len(r[4]), 1)
        used, i = set(), 0
        while i < len(rows):
            j = i
            while j < len(rows) and len(rows[j]) >= 2 and len(rows[j]) == len(rows[i]):
                j += 1
            if j - i >= 2:
                used.update(range(i, j))
                yield {"element_type": "table", "grid": [[c[4].strip() for c in x] for x in rows[i:j]], "page": no, "page_area": w * h, "bbox": _box([c for x in rows[i:j] for c in x])}
            i = max(j, i + 1)
        block: list[list[tuple]] = []
        for k, x in [*enumerate(rows), (-1, [])]:
            apart = block and (not x or x[0][1] - block[-1][0][3] > 0.5 * (x[0][3] - x[0][1]) or k in used)
            if apart:
                yield {"element_type": "text", "content": "\n".join(" ".join(c[4].strip() for c in y) for y in block), "page": no, "page_area": w * h, "bbox": _box([c for y in block for c in y])}
                block = []
            if x and k not in used:
                block.append(x)
        for b in boxes:
            yield {"element_type": "chart", "page": no, "page_area": w * h, "bbox": dict(zip(("x0", "y0", "x1", "y1"), b))}


def document_parser(content: bytes) -> Iterator[dict]:
    """PDF files by `pdf_parser`, all others as plain text."""
    from tallyvane.sources.elements import plain_text_parser

    yield from pdf_parser(content) if content.lstrip()[:5].startswith(b"%PDF") else plain_text_parser(content)
