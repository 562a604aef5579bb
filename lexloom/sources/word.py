"""Word files (.docx) to blocks of text in reading order, and PDF or old .doc files as errors, not exceptions.

Each file is one binary row and is read in one task. A result row is (path, ordinal, kind, text) or, for a file that cannot be read,
(path, null, 'error', reason). Kinds: text, table (one markdown row a line), toc.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

W, M = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
#: Elements whose text was deleted, moved away or is an alternative of other content.
SKIPPED = {W + x for x in ("del", "moveFrom", "pPr", "rPr", "sectPr", "instrText", "fldChar", "delText")} | {"{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"}
#: Fonts of encodings older than Unicode, letters that only Unicode text has, and letters that such fonts show as others.
LEGACY_FONT, VIETNAMESE, LEGACY_LETTER = re.compile(r"\s*(?:\.vn|vni)", re.I), re.compile("[đĐăĂâÂêÊôÔơƠưƯẠ-ỹ]"), re.compile("[¡-ª¬-¯²-¶¸-º¼-ÖØ-öø-ÿ]")
#: Characters of the Symbol font from code 0x20 and from 0xA0 on, and those of Wingdings by code.
SYMBOL_LOW = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
SYMBOL_HIGH = "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑"
WINGDINGS = {0x20: " ", 0x6C: "●", 0x6E: "■", 0x6F: "□", 0x71: "❑", 0x72: "❒", 0x73: "⬧", 0x74: "⧫", 0x75: "◆", 0x76: "❖", 0x77: "⬥", 0x9F: "•", 0xA1: "○", 0xA7: "▪", 0xA8: "◻", 0xD8: "➢", 0xE8: "➔", 0xF0: "⇨", 0xFB: "✗", 0xFC: "✓", 0xFD: "☒", 0xFE: "☑"}
SYMBOL_FONTS = {"symbol": {0x20 + k: c for k, c in enumerate(SYMBOL_LOW)} | {0xA0 + k: c for k, c in enumerate(SYMBOL_HIGH)} | {0xF1: "〉", 0xF2: "∫"}, "wingdings": WINGDINGS} | {f: {0x20: " "} for f in ("wingdings 2", "wingdings 3", "webdings")}
BLOCKS = "path string, ordinal int, kind string, text string"


class ExtractionGap(ValueError):
    """Text of the file is in no block."""


def _on(props, name: str) -> bool:
    found = None if props is None else props.find(W + name)
    return found is not None and found.get(W + "val", "1") not in ("0", "false", "off")


def decode_symbol(font: str, code: int) -> str:
    """What a symbol font shows for a code, with or without the private-use offset; an unknown code is an error, never a wrong character."""
    table = SYMBOL_FONTS.get(font.strip().lower())
    if table is None:
        return chr(code)
    if (low := code & 0xFF if code >= 0xF000 else code) not in table:
        raise ExtractionGap(f"symbol {code:#06x} of {font} is unknown")
    return table[low]


def check_encoding(font: str, text: str) -> None:
    """Text in a font of an older encoding is refused if its letters are of that encoding; Unicode text may keep such a font's name."""
    if LEGACY_FONT.match(font) and LEGACY_LETTER.search(text) and not VIETNAMESE.search(text):
        raise ValueError("text in an encoding older than Unicode")


def letters(n: int) -> str:
    """1 a, 26 z, 27 aa, 28 bb: list letters repeat."""
    return chr(ord("a") + (n - 1) % 26) * ((n - 1) // 26 + 1)


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


FORMATS = {"decimal": str, "decimalZero": lambda n: f"{n:02}", "lowerLetter": letters, "upperLetter": lambda n: letters(n).upper(), "lowerRoman": roman, "upperRoman": lambda n: roman(n).upper()}


class Numbering:
    """Automatic list numbers. A level restarts when one above it moves on."""

    def __init__(self, xml: bytes | None):
        self.levels, self.abstract, self.counts = {}, {}, {}
        if xml is None:
            return
        root = ElementTree.fromstring(xml)
        for a in root.iter(W + "abstractNum"):
            for lvl in a.iter(W + "lvl"):
                read = lambda tag, default, lvl=lvl: default if (e := lvl.find(W + tag)) is None else e.get(W + "val", default)
                self.levels[a.get(W + "abstractNumId"), int(lvl.get(W + "ilvl"))] = (int(read("start", "1")), read("numFmt", "decimal"), read("lvlText", ""), _on(lvl, "isLgl"))
        for n in root.iter(W + "num"):
            num, kind = n.get(W + "numId"), n.find(W + "abstractNumId").get(W + "val")
            changed = n.findall(W + "lvlOverride")
            if changed:  # a list of its own: levels of the one that it is made from, but for those restated
                own = f"{kind}/{num}"
                self.levels |= {(own, k): v for (a, k), v in list(self.levels.items()) if a == kind}
                for o in changed:
                    k, lvl, start = int(o.get(W + "ilvl")), o.find(W + "lvl"), o.find(W + "startOverride")
                    first, fmt, text, legal = self.levels.get((own, k), (1, "decimal", "", False))
                    if lvl is not None:
                        read = lambda tag, default, lvl=lvl: default if (e := lvl.find(W + tag)) is None else e.get(W + "val", default)
                        first, fmt, text, legal = int(read("start", str(first))), read("numFmt", fmt), read("lvlText", text), _on(lvl, "isLgl")
                    self.levels[own, k] = (first if start is None else int(start.get(W + "val")), fmt, text, legal)
                kind = own
            self.abstract[num] = kind

    def label(self, num_id: str, level: int) -> str:
        kind = self.abstract.get(num_id)
        if (kind, level) not in self.levels:
            return ""
        counts = self.counts.setdefault(kind, {})
        start, fmt, text, legal = self.levels[kind, level]
        counts[level] = counts.get(level, start - 1) + 1
        for deeper in [k for k in counts if k > level]:
            del counts[deeper]
        if fmt == "bullet":
            return "-"

        def shown(m):
            k = int(m[1]) - 1
            first, style, *_ = self.levels.get((kind, k), (1, "decimal"))
            return FORMATS.get("decimal" if legal else style, str)(counts.get(k, first))

        return "" if fmt == "none" else re.sub(r"%(\d)", shown, text)


class Document:
    def __init__(self, data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            part = lambda name: z.read(name) if name in names else None
            self.body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
            self.numbering, styles = Numbering(part("word/numbering.xml")), part("word/styles.xml")
        self.styles = {} if styles is None else {s.get(W + "styleId"): s for s in ElementTree.fromstring(styles).iter(W + "style")}
        self.read: set[int] = set()

    def _style(self, props, tag: str):
        """Styles of a paragraph or run, nearest first."""
        ref = None if props is None else props.find(W + tag)
        name, seen = None if ref is None else ref.get(W + "val"), set()
        while name in self.styles and name not in seen:
            seen.add(name)
            yield self.styles[name]
            base = self.styles[name].find(W + "basedOn")
            name = None if base is None else base.get(W + "val")

    def _has(self, props, name: str) -> bool:
        if props is not None and props.find(W + name) is not None:
            return _on(props, name)
        found = next((p for s in self._style(props, "rStyle") if (p := s.find(W + "rPr")) is not None and p.find(W + name) is not None), None)
        return _on(found, name)

    def text(self, node) -> str:
        if node.tag in SKIPPED:
            self._skip(node)
            return ""
        if node.tag == W + "r":
            props = node.find(W + "rPr")
            fonts = None if props is None else props.find(W + "rFonts")
            inner = "".join(map(self.text, node))
            for font in set(fonts.attrib.values()) if fonts is not None else ():
                check_encoding(font, inner)
                if font.strip().lower() in SYMBOL_FONTS:
                    inner = "".join(decode_symbol(font, ord(c)) if ord(c) >= 0xF000 else c for c in inner)
            if self._has(props, "vanish"):
                return ""
            return inner.upper() if self._has(props, "caps") else inner
        if node.tag in (W + "t", M + "t"):
            self.read.add(id(node))
            return node.text or ""
        if node.tag in (W + "tab", W + "br", W + "cr"):
            return " "
        if node.tag == W + "sym":
            return decode_symbol(node.get(W + "font", ""), int(node.get(W + "char"), 16))
        if node.tag == W + "noBreakHyphen":
            return "-"
        if node.tag.startswith(M):
            return self._math(node)
        return "".join(map(self.text, node))

    def _math(self, node) -> str:
        """Linear form: a/b, x^n, x_n, √(x)."""
        at = lambda name: "".join(map(self.text, node.findall(M + name)))
        group = lambda t: t if len(t) < 2 or t.isalnum() else f"({t})"
        name = node.tag.removeprefix(M)
        if name == "f":
            return f"{group(at('num'))}/{group(at('den'))}"
        if name == "sSup":
            return f"{at('e')}^{group(at('sup'))}"
        if name == "sSub":
            return f"{at('e')}_{group(at('sub'))}"
        if name == "rad":
            return f"{at('deg')}√({at('e')})"
        return "".join(map(self.text, node))

    def _skip(self, node) -> None:
        self.read |= {id(t) for t in node.iter() if t.tag in (W + "t", M + "t")}

    def blocks(self) -> list[tuple[str, str]]:
        out = list(self._walk(self.body))
        if any(t.text and t.text.strip() and id(t) not in self.read for t in self.body.iter() if t.tag in (W + "t", M + "t")):
            raise ExtractionGap("some text is in no block")
        return out

    def _walk(self, parent) -> Iterator[tuple[str, str]]:
        for node in parent:
            if node.tag == W + "p":
                yield from self._paragraph(node)
            elif node.tag == W + "tbl":
                yield from self._table(node)
            elif node.tag in SKIPPED:
                self._skip(node)
            else:
                yield from self._walk(node)

    def _paragraph(self, node) -> Iterator[tuple[str, str]]:
        props = node.find(W + "pPr")
        chain = list(self._style(props, "pStyle"))
        text = "".join(map(self.text, node))
        num = next((n for p in [props, *(s.find(W + "pPr") for s in chain)] if p is not None and (n := p.find(W + "numPr")) is not None), None)
        if num is not None and text.strip() and (ref := num.find(W + "numId")) is not None:
            level = num.find(W + "ilvl")
            text = f"{self.numbering.label(ref.get(W + 'val'), 0 if level is None else int(level.get(W + 'val')))} {text}"
        text = " ".join(text.split())
        if text:
            yield "toc" if any((s.get(W + "styleId") or "").upper().startswith("TOC") for s in chain) else "text", text

    def _table(self, table) -> Iterator[tuple[str, str]]:
        """Two rows and two columns or more are data, one markdown row each; anything smaller reads as text."""
        rows, above, tables = [], {}, table.findall(W + "tr")
        for row in tables:
            cells = []
            for cell in row.findall(W + "tc"):
                props = cell.find(W + "tcPr")
                span, merge = (None, None) if props is None else (props.find(W + "gridSpan"), props.find(W + "vMerge"))
                text = " ".join(t for _, t in self._walk(cell))
                if merge is not None and merge.get(W + "val", "continue") == "continue":
                    text = above.get(len(cells), text)
                above[len(cells)] = text
                cells += [text] + [""] * (0 if span is None else int(span.get(W + "val")) - 1)
            rows.append(cells)
        width = max(map(len, rows), default=0)
        if len(rows) < 2 or width < 2:
            yield from (("text", c) for row in rows for c in row if c)
            return
        yield from (("table", "| " + " | ".join(c.replace("|", "/") for c in row + [""] * (width - len(row))) + " |") for row in rows)


def extract(files: DataFrame) -> DataFrame:
    """files(path, content) -> `BLOCKS`. Only .docx can be read here; other kinds give an error row."""

    def each(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    if not path.lower().endswith(".docx"):
                        raise ValueError(f"cannot read {path.rpartition('.')[2]} files")
                    rows += [(path, k, kind, text) for k, (kind, text) in enumerate(Document(content).blocks())]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ordinal", "kind", "text"]).astype({"ordinal": "Int32"})

    return files.select("path", "content").mapInPandas(each, BLOCKS)


def read_word(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
