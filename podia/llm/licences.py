"""Fuzzy search for short licence notices: exact seeds by the pigeonhole principle, then bounded-error matching."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podia.llm.common import small_batches

#: Phrases that count only word for word, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that may be misspelt, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under cc by": "cc",
    "creative commons attribution": "cc",
    "all rights reserved": "reserved",
}
#: One error is let through for each so many characters of a notice.
CHARS_PER_ERROR = 10
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,notice:string,start:int,stop:int,edits:int>>"

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes to words: A-Z lowered; what is no digit, letter or part of a non-ASCII character becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of the notice with their places: however `errors` edits fall, one piece stays whole."""
    n = errors + 1
    cut = [len(notice) * i // n for i in range(n + 1)]
    return [(cut[i], notice[cut[i] : cut[i + 1]]) for i in range(n)]


class Scanner:
    """Search for notices with few errors and for phrases word for word."""

    def __init__(self, notices: dict[str, str], phrases: dict[str, str]) -> None:
        self.notices, self.phrases = notices, phrases
        self.errors = {n: max(1, len(n) // CHARS_PER_ERROR) for n in notices}
        self.patterns = {n: regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n)}){{e<={e}}}(?![^ ])") for n, e in self.errors.items()}
        found: dict[str, list[tuple[str, int]]] = {}
        for notice, e in self.errors.items():
            for place, piece in seeds(notice, e):
                found.setdefault(piece, []).append((notice, place))
        self.automaton = ahocorasick.Automaton()
        for piece, whence in found.items():
            self.automaton.add_word(piece, (len(piece), whence))
        if found:
            self.automaton.make_automaton()
        self.best = lru_cache(1 << 14)(self._best)

    def _best(self, notice: str, words: str) -> tuple[int, int, int] | None:
        """(edits, start, stop) of the nearest match in whole words, the first of equals."""
        if notice == words:
            return 0, 0, len(words)
        m = self.patterns[notice].search(words)
        return (sum(m.fuzzy_counts), m.start(), m.end()) if m and m.end() > m.start() else None

    def windows(self, line: str) -> set[tuple[str, int, int]]:
        """Where a match may lie: around each seed, as far as errors can move it, in whole words."""
        found = set()
        if not self.notices:
            return found
        for last, (size, whence) in self.automaton.iter(line):
            for notice, place in whence:
                e = self.errors[notice]
                at = last - size + 1 - place
                found.add((notice, max(0, at - e), min(len(line), at + len(notice) + e)))
        return found

    def _search(self, line: str, notice: str, lo: int, hi: int) -> tuple[int, int, int, str, int, int] | None:
        """The best match between two places: (edits, start, stop, notice, lo, hi); words that are cut at either end don't count."""
        if lo and line[lo - 1] != " ":
            lo = line.find(" ", lo, hi) + 1 or hi
        if hi < len(line) and line[hi] != " ":
            hi = max(lo, line.rfind(" ", lo, hi))
        if hi - lo < len(notice) - self.errors[notice]:
            return None
        best = self.best(notice, line[lo:hi])
        return best and (best[0], lo + best[1], lo + best[2], notice, lo, hi)

    def matches(self, line: str) -> list[tuple[str, int, int, int]]:
        """(notice, start, stop, edits) in a line of space-joined words: of each notice the nearest match, then the
        nearest that doesn't overlap it, and so on until none is left; the first of equals, and the shorter one.

        Each window is as long as its notice and a few errors, and is searched
        again only beside matches that reach into it; so the time grows
        with the line.
        """
        todo = [x for w in self.windows(line) if (x := self._search(line, *w))]
        heapify(todo)
        taken: dict[str, list[tuple[int, int]]] = {}
        out = []
        while todo:
            edits, start, stop, notice, lo, hi = heappop(todo)
            own = taken.setdefault(notice, [])
            at = bisect_left(own, (stop, 0))
            if at and own[at - 1][1] > start:
                gap_lo, gap_hi = own[at - 1]  # something nearer is taken here: look on both sides of it
            else:
                insort(own, (start, stop))
                out.append((notice, start, stop, edits))
                gap_lo, gap_hi = start, stop
            for part in ((lo, gap_lo - 1), (gap_hi + 1, hi)):
                if part[0] < part[1] and (x := self._search(line, notice, *part)):
                    heappush(todo, x)
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str | None) -> dict:
        """The findings of one whole text; spans are code points of the text, from the first to the last word touched."""
        words = ("" if text is None else text).encode("utf-8", "surrogatepass").translate(_FOLD).split()
        packed = b" " + b" ".join(words) + b" "
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))[:-1]
        places: list[int] = []
        exact: set[str] = set()
        for phrase, label in self.phrases.items():
            sought = b" " + phrase.encode() + b" "
            at = packed.find(sought)
            while at >= 0:
                places.append(bisect_left(starts, at))
                exact.add(label)
                at = packed.find(sought, at + 1)
        line = packed[1:-1].decode("utf-8", "surrogatepass")
        found = self.matches(line)
        spans = []
        if found:
            begin = list(accumulate((len(w) + 1 for w in line.split(" ")), initial=0))[:-1]
            where = [m.span() for m in _WORD.finditer(text)]
            for notice, start, stop, edits in found:
                first, last = bisect_left(begin, start), bisect_right(begin, stop - 1) - 1
                spans.append({"label": self.notices[notice], "notice": notice, "start": where[first][0], "stop": where[last][1], "edits": edits})
        fuzzy = {s["label"] for s in spans}
        best = max([float(bool(exact)), *(1 - s["edits"] / len(s["notice"]) for s in spans)])
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(exact)), "labels": ",".join(sorted(exact | fuzzy)), "score": best, "spans": spans}


@cache
def scanner(notices: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    """One Scanner a worker for each set of notices."""
    return Scanner(dict(notices), dict(phrases))


def folded(notices: dict[str, str]) -> dict[str, str]:
    """Notices as they are searched: their words in lower case, joined by spaces; those without a word go."""
    plain = {b" ".join(n.encode().translate(_FOLD).split()).decode(): label for n, label in notices.items()}
    return {n: label for n, label in plain.items() if n}


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, the word-for-word findings, all labels, the best score, and spans.

    notices (searched with one error for each CHARS_PER_ERROR characters) and
    phrases (word for word) map texts to labels; by default NOTICES and BASE.

    Words are runs of digits, letters (A-Z count as a-z) and non-ASCII
    characters. n_base counts the places of the BASE phrases; first_word and
    last_word are their least and greatest start. labels has those of notices
    with few errors too. score is 1 less the edits per character of the best
    notice, 1 for a BASE phrase, 0 for nothing. Null and empty texts have no
    words and no findings; ties are sorted, very long texts are
    read in time that grows with their length; repeated rows get equal answers;
    an empty table gives an empty result; other columns are ignored. No shuffle.
    """
    kind = pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(kind)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    sought = tuple(folded(NOTICES if notices is None else notices).items()), tuple(folded(BASE if phrases is None else phrases).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(*sought)
        for batch in batches:
            found = [own.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True))], [id_col, *names])

    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return cols.mapInArrow(run, f"{id_col} long, {SCHEMA}")
