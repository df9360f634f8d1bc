"""HTML tables: events with places in the source, the grid of formulas, cells for translation, rebuilding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from .formulas import SPAN, VOID_TAGS, scan_spans, splice
from .protect import _MARKER, ProtectionError, protect_cell, restore_cell, split_cell
from .text import per_value

HIDDEN = frozenset(("script", "style", "template"))
GRID_CELLS = frozenset(("td", "th"))
TEXT_CELLS = frozenset(("td", "th", "caption"))

# Budgets of a request.
MAX_ITEMS, MAX_TOKENS, MAX_FORMULAS = 12, 2_000, 24
REQUEST_TOKENS, ITEM_TOKENS = 80, 12
SEGMENT_TOKENS = MAX_TOKENS - REQUEST_TOKENS - ITEM_TOKENS - 16
# Cell texts that need no translation.
_NUMBER = r"[+-]?\d+(?:[.,]\d+)?(?:\s*(?:%|‰|°\s*[CF]?))?"
_RANGE = re.compile(rf"\s*{_NUMBER}\s+(?:to|through)\s+{_NUMBER}\s*", re.I)
_LETTER = re.compile("[A-Za-z]")
_ONE_CODE = r"(?:(?:ASTM\s+)?D\d+[A-Z]?|IP\s*\d+|UOP\s*\d+|[A-Z]{1,4}-?\d+[A-Z0-9-]*)"
_CODE = re.compile(rf"{_ONE_CODE}(?:\s*[/,;]\s*{_ONE_CODE})*", re.I)


class TableError(ValueError):
    """A table that can't be read, or whose structure a change would break."""


# kind (start, self, end, text, entity, charref, comment, declaration, cdata), name, start, end, attributes
Event = tuple[str, str, int, int, tuple]


_PARTS = {
    "start": r"<[A-Za-z][^\s/>]*(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>",
    "end": r"</[A-Za-z][^\s/>]*[^>]*>",
    "comment": r"<!--.*?-->",
    "cdata": r"<!\[.*?\]\]?>",
    "declaration": r"<[!?][^>]*>",
    "charref": r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);",
    "entity": r"&[A-Za-z][A-Za-z0-9]*;",
}
_SIGN = re.compile("|".join(f"(?P<{kind}>{part})" for kind, part in _PARTS.items()), re.S)
_SPLIT = {references: re.compile("(" + "|".join(part for kind, part in _PARTS.items() if references or kind not in ("charref", "entity")) + ")", re.S) for references in (True, False)}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_RAW = re.compile(r"<(?:script|style)", re.I)
_OPEN_END = re.compile(r"<[A-Za-z/!?]")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _sign(raw: str) -> tuple[str, str, tuple]:
    """kind, name, attributes of a tag, comment or reference."""
    kind, name, attrs = _SIGN.match(raw).lastgroup, "", ()
    if kind == "end":
        name = _NAME.match(raw, 2)[0].lower()
    elif kind == "start":
        m = _NAME.match(raw, 1)
        name, text = m[0].lower(), raw[m.end() : -1]
        attrs = tuple((a[1].lower(), a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]) for a in _ATTR.finditer(text.removesuffix("/")))
        kind = "self" if text.endswith("/") else "start"
    return kind, name, attrs


_short_sign = lru_cache(4096)(_sign)


def events(source: str, references: bool = True) -> Iterator[Event]:
    """Tags, comments, texts and (if asked for) references of HTML, each with its place in the source; what follows script and style is text up to their end tags. A `<` without an end is an error."""
    at, size, split, has_raw = 0, len(source), _SPLIT[references].split, _RAW.search(source) is not None
    while at < size:
        raw = None
        for k, piece in enumerate(split(source[at:] if at else source)):
            end = at + len(piece)
            if k % 2:
                kind, name, attrs = _short_sign(piece) if len(piece) < 64 else _sign(piece)
                yield kind, name, at, end, attrs
                if has_raw and kind == "start" and name in ("script", "style"):
                    raw = name
            elif piece:
                if "<" in piece and _OPEN_END.search(piece):
                    raise TableError("a tag has no end")
                yield "text", "", at, end, ()
            at = end
            if raw:
                break
        if raw:
            over = re.compile(rf"</{raw}\s*>", re.I).search(source, at)
            stop = over.start() if over else size
            if stop > at:
                yield "text", "", at, stop, ()
            at = stop


def _count(attrs: tuple, name: str) -> int:
    """rowspan or colspan: 1 if missing; must be given once, as a positive integer."""
    values = [v for k, v in attrs if k == name]
    if not values:
        return 1
    if len(values) > 1 or values[0] is None or not re.fullmatch(r"\s*\+?\d+\s*", values[0]) or int(values[0]) < 1:
        raise TableError(f"{name} must be a positive integer")
    return int(values[0])


def grid_formulas(source: str) -> list[tuple]:
    """(row, column, cell tag, number in the cell, span) of each formula in the visible text of a table's cells.

    A cell takes the first column that no cell of an earlier row covers. Formulas don't reach across
    texts that tags part. Raises TableError for nested tables, misplaced, self-closed, unclosed or
    mismatched elements, and without a table.
    """
    stack: list[str] = []
    covered: dict[int, int] = {}
    row, column, cell, number, seen, out = -1, 0, None, 0, False, []
    for kind, name, start, end, attrs in events(source, references=False):
        if kind == "start":
            if name == "table":
                if "table" in stack:
                    raise TableError("nested table")
                seen = True
            elif name == "tr":
                if "table" not in stack or cell:
                    raise TableError("misplaced tr")
                row, column = row + 1, 0
            elif name in GRID_CELLS:
                if "table" not in stack or "tr" not in stack or cell:
                    raise TableError(f"misplaced {name}")
                while covered.get(column, 0) > row:
                    column += 1
                down, across = _count(attrs, "rowspan"), _count(attrs, "colspan")
                cell, number = (row, column, name), 0
                for c in range(column, column + across):
                    covered[c] = max(covered.get(c, 0), row + down)
                column += across
            if name not in VOID_TAGS:
                stack.append(name)
        elif kind == "self":
            if name in GRID_CELLS or name in ("table", "tr"):
                raise TableError(f"self-closed {name}")
        elif kind == "end":
            if not stack or stack[-1] != name:
                raise TableError(f"unmatched end of {name}")
            stack.pop()
            if name in GRID_CELLS:
                cell = None
        elif kind == "text" and cell and not HIDDEN.intersection(stack):
            for s in scan_spans(source[start:end]):
                out.append((*cell, number, (s[0], s[1], s[2], *(p + start for p in s[3:]))))
                number += 1
    if stack:
        raise TableError("unclosed element")
    if not seen:
        raise TableError("no table")
    return out


def _grid_rows(source: str) -> dict:
    keys = ("raw_formula", "katex_formula", "is_block", "start", "end", "katex_start", "katex_end")
    try:
        rows = [{"row_idx": r, "col_idx": c, "cell_tag": t, "formula_index": n, "span": dict(zip(keys, s, strict=True))} for r, c, t, n, s in grid_formulas(source)]
    except TableError as e:
        return {"formulas": [], "error": str(e)}
    return {"formulas": rows, "error": None}


#: Column of table HTML -> (formulas, error).
table_formulas = per_value(_grid_rows, f"struct<formulas:array<struct<row_idx:int,col_idx:int,cell_tag:string,formula_index:int,span:{SPAN}>>,error:string>")


def _table_replaced(source: str, replacements: list[dict] | None) -> str:
    table = {(r["raw_formula"], r["is_block"]): r["normalized"] for r in replacements or ()}
    if not table:
        return source
    return splice(source, [(s[3], s[4], table[s[0], s[2]]) for *_, s in grid_formulas(source) if (s[0], s[2]) in table])


#: Table HTML with formulas of its visible cell texts replaced; attributes and hidden texts stay.
replace_table_spans = per_value(lambda s, r: None if s is None else _table_replaced(s, r), "string", nulls=True)


class Cell(NamedTuple):
    cell_id: str
    tag: str
    start: int
    end: int
    source: str
    marks: tuple  # raw HTML behind ⟦H0⟧, ⟦H1⟧, ...


def parse_cells(source: str) -> tuple[list[Cell], list[tuple]]:
    """The cells of a table, captions among them, with their inner tags, references, comments and hidden texts as markers, and the structure of the whole."""
    if not isinstance(source, str) or not source.strip():
        raise TableError("empty HTML")
    stack, cells, structure = [], [], []
    opened, begin, pieces, marks, seen = None, 0, [], [], False  # the name of the open cell and where its inside begins

    def protect(start: int, end: int) -> None:
        pieces.append(f"⟦H{len(marks)}⟧")
        marks.append(source[start:end])

    for kind, name, start, end, attrs in events(source):
        if kind == "text":
            if opened:
                if HIDDEN.isdisjoint(stack):
                    pieces.append(source[start:end])
                else:
                    protect(start, end)
        elif kind == "end":
            if not stack or stack[-1] != name:
                raise TableError(f"unmatched end of {name}")
            if opened and name == opened:
                cells.append(Cell(f"cell-{len(cells) + 1:04d}", name, begin, start, "".join(pieces), tuple(marks)))
                opened = None
            elif opened:
                protect(start, end)
            stack.pop()
            structure.append(("end", name))
        elif kind == "start" or kind == "self":
            void = kind == "start" and name in VOID_TAGS
            structure.append(("void" if void else kind, name, attrs))
            seen |= name == "table"
            if name in TEXT_CELLS and kind == "self":
                raise TableError("self-closed cell")
            if kind == "start" and name in TEXT_CELLS and "table" in stack:
                if opened:
                    raise TableError("nested cells")
                opened, begin, pieces, marks = name, end, [], []
            elif opened:
                protect(start, end)
            if kind == "start" and not void:
                stack.append(name)
        elif opened:
            protect(start, end)
    if stack or opened:
        raise TableError("unclosed element")
    if not seen:
        raise TableError("no table")
    return cells, structure


def needs_translation(model_text: str) -> bool:
    """Whether something is left to translate without markers: it has an ASCII letter and isn't a range of numbers or a bare code."""
    plain = _MARKER.sub("", model_text).strip()
    return bool(plain and _LETTER.search(plain) and not _RANGE.fullmatch(plain) and not _CODE.fullmatch(plain))


class Prepared(NamedTuple):
    cell: Cell
    segments: tuple  # (work id, model text, formulas, html marks)
    skipped: bool
    error: str | None


def prepare_table(source: str) -> tuple[list[Prepared], list[tuple]]:
    """Each cell as work: segments within the token and formula budget, skipped, or the error that keeps it as it is."""
    cells, structure = parse_cells(source)
    out = []
    for cell in cells:
        try:
            text, formulas = protect_cell(cell.source, cell.marks)
        except ProtectionError as e:
            out.append(Prepared(cell, (), False, f"protection failed: {e}"))
            continue
        if not needs_translation(text):
            out.append(Prepared(cell, (), True, None))
            continue
        parts = split_cell(text, formulas, cell.marks, SEGMENT_TOKENS, MAX_FORMULAS)
        ids = [cell.cell_id] if len(parts) == 1 else [f"{cell.cell_id}:segment-{i + 1:04d}" for i in range(len(parts))]
        out.append(Prepared(cell, tuple((i, *p) for i, p in zip(ids, parts, strict=True)), False, None))
    return out, structure


def _same_tags(source: str, result: str) -> bool:
    """Whether two texts without hidden parts, the first of them a table, are seen to have the same tags and comments in the same order and no others, so the same structure. False: have a look at the whole."""
    if _RAW.search(source):
        return False
    split = _SPLIT[False].split
    theirs = split(result)
    return split(source)[1::2] == theirs[1::2] and "<" not in "".join(theirs[::2])


def rebuild_table(source: str, translations: dict[str, str], errors: dict[str, str], made: tuple | None = None, restored: dict[str, str] | None = None) -> dict:
    """The table with every cell all of whose segments restore; the others stay as they are and are named. The structure must come out the same. made: what prepare_table gave for source, restored: the HTML of segments by work id, as far as they are at hand."""
    prepared, structure = made or prepare_table(source)
    known = restored or {}
    pieces, fallbacks = [], []
    for p in prepared:
        reason = p.error
        if not reason and not p.skipped:
            failed = [i for i, *_ in p.segments if i not in translations or i in errors]
            if failed:
                reason = next((errors[i] for i in failed if i in errors), "the result lacks a cell")
            else:
                try:
                    pieces.append((p.cell.start, p.cell.end, "".join(known[i] if i in known else restore_cell(translations[i], f, h) for i, _, f, h in p.segments)))
                except ProtectionError as e:
                    reason = str(e)
        if reason:
            fallbacks.append({"cell_id": p.cell.cell_id, "error": reason})
    result = splice(source, pieces)
    if not _same_tags(source, result) and parse_cells(result)[1] != structure:
        raise TableError("the structure changed")
    return {"html": result, "success_cells": len(pieces), "fallbacks": fallbacks}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


WORK = "struct<work_id:string,cell_id:string,segment_index:int,model_text:string,formula_count:int>"


def _work_rows(source: str) -> dict:
    try:
        prepared, _ = prepare_table(source)
    except TableError as e:
        return {"items": [], "cells": 0, "skipped": 0, "error": str(e)}
    items = [{"work_id": s[0], "cell_id": p.cell.cell_id, "segment_index": k, "model_text": s[1], "formula_count": len(s[2])} for p in prepared for k, s in enumerate(p.segments)]
    return {"items": items, "cells": len(prepared), "skipped": sum(p.skipped for p in prepared), "error": None}


#: Column of table HTML -> (items, cells, skipped, error).
table_work = per_value(_work_rows, f"struct<items:array<{WORK}>,cells:int,skipped:int,error:string>")
