r"""License scan by conditional compression.

Candidate blocks are the words around licence cues, as many on both sides as a notice can have, so a notice may be wrapped anywhere.  Each block
is compressed whole, alone and with each template as raw zstandard dictionary; templates are ranked by the bytes they save, as a share of their
own compressed size.  All are confirmed by their exact wording, the rank decides between equals: the words of the template must stand in the block in order,
apart from marked variable parts; missing template words are counted and listed.  A short template must be complete, a long one may miss
``MAX_MISSING`` of its words.  What a template confirms is taken out of the block and the rest is compared again until nothing is confirmed, so a block with any
number of notices yields each.

Result: one row for each confirmed notice (doc, line where it begins, licence, words missing, size saved).

Defined cases: null and empty texts have no blocks; repeated rows are reported each; a block of any length is one list; a template without a cue is
found only near one; ties of the ranking go to the template that confirms with fewer missing words, then by licence id; an empty table gives no
rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_templates import TEMPLATES

LEVEL = 6
MAX_MISSING = 0.05
SHORT = 25
CUES = ("licen", "copyright", "rights reserved", "permission", "redistribut", "public domain", "spdx-", "all copyright")
#: Words one of which is in every cue, and the cues, which may run over the end of a line.
_HINTS = ("licen", "copyright", "reserved", "permission", "redistribut", "domain", "spdx-")
_CUE = re.compile("|".join(c.replace(" ", r"[\W_]+") for c in CUES))
_WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_HYPHEN = re.compile(r"-[ \t\r]*\n[^\w\n]*")
_VARIABLE = re.compile(r"<[^<>]*>")


@dataclass(frozen=True)
class Notice:
    line: int
    license_id: str
    template: int
    saved: float
    missing: tuple[str, ...]
    n_words: int


@dataclass(frozen=True)
class Block:
    words: list[str]
    lines: list[int]  # of each word
    text: str  # the same words as they stand, in lower case: what is compressed


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None):
        self.alone = self._sizer("")
        self.templates = []
        for i, many in sorted((templates or TEMPLATES).items()):
            for k, t in enumerate(many):
                t = _VARIABLE.sub(" ", t)
                self.templates.append((i, k, words(t), self._sizer(t), self.alone(t.lower().encode())))
        self.hyphened = {w for t in self.templates for w in t[2] if "-" in w}
        self.reach = max(self._longest(len(t[2])) for t in self.templates)

    @staticmethod
    def _sizer(text: str):
        extra = {"dict_data": zstandard.ZstdCompressionDict(text.lower().encode() + b"\n" * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if text else {}
        c = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, **extra)
        return lambda raw: len(c.compress(raw))

    @staticmethod
    def _longest(n: int) -> int:
        """The most words of a text over which the words of a template may be spread."""
        return int(1.25 * n + 5)

    def _words(self, low: str) -> tuple[list[str], list[int]]:
        """Words of a lower-case text and where they begin; a template's word broken behind a hyphen at the end of a line is one."""
        said, at, end = [], [], 0
        for m in _WORDS.finditer(low):
            w = m.group()
            if said and low[end] == "-" and f"{said[-1]}-{w}" in self.hyphened and _HYPHEN.fullmatch(low, end, m.start()):
                said[-1] += "-" + w
            else:
                said.append(w)
                at.append(m.start())
            end = m.end()
        return said, at

    def blocks(self, text: str) -> list[Block]:
        """The words around cues, as far as a notice with that cue can reach; blocks that overlap are one."""
        low = text.lower()
        if not any(h in low for h in _HINTS):
            return []
        cues = [(m.start(), m.end()) for m in _CUE.finditer(low)]
        if not cues:
            return []
        said, at = self._words(low)
        runs: list[list[int]] = []  # first and last word, first and last character of cues
        for begin, end in cues:
            first, last = max(0, bisect_right(at, begin) - 1 - self.reach), bisect_right(at, end - 1) + self.reach
            if runs and first <= runs[-1][1]:
                runs[-1][1], runs[-1][3] = last, end
            else:
                runs.append([first, last, begin, end])
        out, line, seen = [], 0, 0
        for first, last, begin, end in runs:
            last = min(last, len(at))
            lines = []
            for x in at[first:last]:
                line, seen = line + low.count("\n", seen, x), x
                lines.append(line)
            out.append(Block(said[first:last], lines, low[at[first] : at[last] if last < len(at) else len(low)] if first < len(at) else low[begin:end]))
        return out

    def notices(self, text: str) -> list[Notice]:
        return [n for block in self.blocks(text) for n in self._confirm(block)]

    def _confirm(self, block: Block) -> list[Notice]:
        raw = block.text.encode("utf-8", "surrogatepass")
        base = max(1, self.alone(raw))
        saved = [round(1 - size(raw) / base, 6) for _, _, _, size, _ in self.templates]
        # a long template saves a little in any text: rank by the share of the template's own size that it saves
        rank = [saved[x] * base / t[4] for x, t in enumerate(self.templates)]
        left, lines, out = block.words, block.lines, []
        while found := [(m, x) for x, t in enumerate(self.templates) for m in self._matches(t[2], left)]:
            # exact wording decides between templates: fewer words missing, then more words said; of one template the closest wording
            found.sort(key=lambda y: (len(y[0][2]) / len(self.templates[y[1]][2]), -len(self.templates[y[1]][2]), -rank[y[1]], y[1], y[0][1] - y[0][0], y[0][0]))
            taken = [""] * len(left)
            for (begin, end, missing), x in found:
                if not any(taken[begin:end]):
                    taken[begin:end] = ["in"] * (end - begin)
                    taken[begin] = "begin"
                    i, k, w, _, _ = self.templates[x]
                    out.append(Notice(lines[begin], i, k, saved[x], missing, len(w)))
            # what is left may say more: a notice around another one; a break stands for what was taken out
            keep = [("\n" if t else w, line) for w, line, t in zip(left, lines, taken, strict=True) if t != "in"]
            left, lines = [w for w, _ in keep], [line for _, line in keep]
        return sorted(out, key=lambda n: n.line)

    def _matches(self, template: list[str], block: list[str]) -> list[tuple[int, int, tuple[str, ...]]]:
        """Everywhere the block says the template's words in order: begin, end and the template words it lacks."""
        n = len(template)
        most = 0 if n < SHORT else int(MAX_MISSING * n)
        have, need = Counter(block), Counter(template)
        if sum(max(0, c - have[w]) for w, c in need.items()) > most:
            return []
        places: dict[str, list[int]] = {w: [] for w in need}
        for at, w in enumerate(block):
            if w in places:
                places[w].append(at)
        if n < SHORT:
            return [(at, at + n, ()) for at in places[template[0]] if block[at : at + n] == template]
        out = []
        for skipped in range(most + 1):
            for at in places[template[skipped]]:
                stop = at + self._longest(n)
                # by the number of missing words: the earliest place behind the words said so far, and what is missing
                states = {skipped: (at + 1, tuple(template[:skipped]))}
                for w in template[skipped + 1 :]:
                    after: dict[int, tuple[int, tuple[str, ...]]] = {}
                    for lacks, (place, missing) in states.items():
                        j = bisect_left(places[w], place)
                        if j < len(places[w]) and places[w][j] < stop:
                            new = (places[w][j] + 1, missing)
                            after[lacks] = min(after.get(lacks, new), new)
                        if lacks < most:
                            new = (place, (*missing, w))
                            after[lacks + 1] = min(after.get(lacks + 1, new), new)
                    states = after
                    if not states:
                        break
                if states:
                    out.append((at, *states[min(states)]))
        return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, license_id, template, saved, n_missing, missing, n_words of each confirmed notice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = [(doc, n) for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) if text.is_valid for n in scanner.notices(text.as_py())]
            cols = [
                pa.array([d for d, _ in rows], pa.int64()), pa.array([n.line for _, n in rows], pa.int64()), pa.array([n.license_id for _, n in rows], pa.string()),
                pa.array([n.template for _, n in rows], pa.int64()), pa.array([n.saved for _, n in rows], pa.float64()), pa.array([len(n.missing) for _, n in rows], pa.int64()),
                pa.array([" ".join(n.missing) for _, n in rows], pa.string()), pa.array([n.n_words for _, n in rows], pa.int64()),
            ]
            yield pa.record_batch(cols, names=["doc_id", "line", "license_id", "template", "saved", "n_missing", "missing", "n_words"])

    d = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return d.mapInArrow(run, "doc_id long, line long, license_id string, template long, saved double, n_missing long, missing string, n_words long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
