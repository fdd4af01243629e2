"""Documents as cells: what the text operators read of a notebook."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from bagworks.llm.arrays import mix64

WORD = re.compile(r"[^\W\d]\w{2,39}")
_U = re.compile(r"\\u([0-9a-fA-F]{4})")
#: Runs of characters without blanks that are encoded data, not words.
BLOB = re.compile(r"[A-Za-z0-9+/=]{64,}")
_REGION = {"markdown": "m", "code": "c", "output": "o"}


#: What the three written forms put around a cell's source: execution marks, cell separators and comment signs, and the json keys.
_MARK = re.compile(r"\A\s*(?:(?:In|Out) ?\[[^\]\n]*\]:|# ?%%[^\n]*)\s*")
_SOURCE = re.compile(r'"source"\s*:\s*"(.*)"\s*\}?\s*,?\s*\Z', re.DOTALL)


def _plain(s: str, region: str, fmt: str | None) -> str:
    if fmt == "json":
        if m := _SOURCE.search(s):
            s = m[1]
        s = s.replace("\\n", "\n").replace('\\"', '"')
        return _U.sub(lambda m: chr(int(m[1], 16)), s) if "\\u" in s else s
    s = _MARK.sub("", s)
    if fmt == "percent" and region == "m":
        s = re.sub(r"(?m)^# ?", "", s)
    elif fmt == "percent" and region == "o":
        s = s.strip().removeprefix('"""').removesuffix('"""')
    return s


def spans_of(batch: pa.RecordBatch, name: str = "cells") -> list[list[tuple]]:
    """(cell_type, char_start, char_len) of each row's cells; those without a place are left out, null rows have none."""
    cells = batch.column(batch.schema.get_field_index(name))
    flat = cells.flatten()
    if not len(flat):
        return [[] for _ in range(len(cells))]
    kind, start, size = (flat.field(flat.type.get_field_index(c)).to_pylist() for c in ("cell_type", "char_start", "char_len"))
    there = flat.is_valid().to_pylist()
    ends = np.cumsum(np.nan_to_num(pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(float))).astype(int).tolist()
    out, at = [], 0
    for end in ends:
        out.append([(kind[i], start[i], size[i]) for i in range(at, end) if there[i] and start[i] is not None and size[i] is not None])
        at = end
    return out


def cells_of(text: str | None, spans: Sequence[tuple], fmt: str | None) -> Iterator[tuple[str, str]]:
    """(region, source) of each cell; a text without cells is one cell of prose; a null or empty one has none. What a form puts
    around a source, execution marks too, is taken off, so the same cell reads the same in every form and place."""
    if not text:
        return
    if not spans:
        yield "m", text
        return
    for kind, start, size in spans:
        region = _REGION.get(kind, "m")
        yield region, _plain(text[start : start + size], region, fmt)


def fingerprint(cell: str) -> int:
    """64-bit hash of a cell's text without regard to case and white space, as a signed integer."""
    return xxhash.xxh64_intdigest(" ".join(cell.split()).lower().encode("utf-8", "surrogatepass")) - 2**63


def words(cell: str) -> set[str]:
    """The distinct words and names of a cell, in lower case; encoded data has none."""
    found = set(WORD.findall(BLOB.sub(" ", cell).lower()))
    return found | {part for w in found if "_" in w for part in w.split("_") if len(part) > 2 and not part[0].isdigit()}


#: Cells in a window: a copied block is told from cells that are alike by chance by so many in a row.
WINDOW = 3


def windows(cells: Sequence[str | int]) -> np.ndarray:
    """64-bit hashes of every WINDOW cells in a row, as signed integers; fewer cells have no window. Cells may be given by fingerprint."""
    f = np.array([fingerprint(s) if isinstance(s, str) else s for s in cells], np.int64)
    if len(f) < WINDOW:
        return f[:0]
    h = np.zeros(len(f) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = mix64(h ^ f[i : len(f) - WINDOW + 1 + i].view(np.uint64))
    return h.view(np.int64)
