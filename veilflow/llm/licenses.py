"""License scans: a generalised suffix automaton of licence wordings reads each text once.

The automaton has a path for every run of words that any wording or phrase holds. Reading a text it tells, after each
word, the longest run ending there that some wording holds (matching statistics). Runs that can't be made
longer and have MATCH words or more are matches; matches that lie in the same order in text and wording are
chained, and a chain that covers enough of a wording is a span. Phrases are paths too: one stands at a
word if its state is the reached state or one of its suffixes.

The automaton grows with the wordings only, not with the corpus (``MOST_TOKENS`` checks it); texts go by
in portions, so one of any length needs a bounded part of memory. Rows are independent: no shuffle."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, lean
from .license_texts import PHRASES, WORDINGS

#: Words of a match that counts.
MATCH = 4
#: Words that may lie between two matches of a chain, in the text and in the wording.
GAP = 40
#: Share of a wording's words that a span covers at least.
COVER = 0.75
#: Words of all wordings together, at most: what a worker holds for them stays under some 200 MB.
MOST_TOKENS = 200_000
#: Bytes of text whose words are Python objects at once.
PORTION = 1 << 20
#: Places of all runs of MATCH words and more, at most (wordings that repeat themselves have many).
MOST_PLACES = 5_000_000
#: Lower-cases A-Z and makes a space of each byte that is in no word.
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Spans: word numbers in the text, first and after the last, and the part of the wording covered.
SPANS = "array<struct<label: string, wording: int, first: long, last: long, covered: double>>"
SCAN = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("wording", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))


def words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text's bytes, A-Z taken as a-z."""
    return data.translate(_KEEP).split()


def portions(data: bytes, most: int = PORTION):
    """Pieces of a text, cut where no word is."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and _KEEP[data[end]] != 0x20:
            end += 1
        yield data[at:end]
        at = end


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences (public construction, one sequence after another).

    State 0 is the empty run. ``step`` maps a word's number to a state, ``up`` is the state of the longest suffix that
    lies in more places, ``long`` the longest run of a state."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    up: list[int] = field(default_factory=lambda: [-1])
    long: list[int] = field(default_factory=lambda: [0])
    #: (wording, end) of each place where a state's runs end; filled by ``settle``.
    places: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    #: Phrase numbers whose run is a suffix of the state's runs, or among them, with their words.
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)

    def _state(self, long: int, step: dict[int, int], up: int) -> int:
        self.long.append(long)
        self.step.append(step)
        self.up.append(up)
        self.places.append([])
        return len(self.long) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the runs of q that are p's with c."""
        clone = self._state(self.long[p] + 1, dict(self.step[q]), self.up[q])
        self.up[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.up[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # an earlier sequence has this run
            return q if self.long[q] == self.long[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.long[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.up[p]
        if p >= 0:
            q = self.step[p][c]
            self.up[new] = q if self.long[q] == self.long[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence: list[bytes], number: int) -> int:
        """Take a sequence in; the state of the whole. Phrases have numbers below 0 and give no places."""
        last = 0
        for i, w in enumerate(sequence):
            last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
            if number >= 0:
                self.places[last].append((number, i + 1))
        return last

    def settle(self, phrases: dict[int, tuple[int, int]], match: int = MATCH) -> None:
        """Hand places down to shorter runs (as long as they can be matches) and phrases up to longer ones."""
        order, held = sorted(range(1, len(self.long)), key=self.long.__getitem__), 0
        for s in reversed(order):
            if self.up[s] > 0 and self.long[self.up[s]] >= match:
                self.places[self.up[s]] += self.places[s]
                if (held := held + len(self.places[s])) > MOST_PLACES:
                    raise ValueError("the wordings repeat themselves too often")
        self.phrases = [[] for _ in self.long]
        for s in order:
            self.phrases[s] = self.phrases[self.up[s]] + ([phrases[s]] if s in phrases else [])
            self.places[s] = sorted(set(self.places[s])) if self.long[s] >= match else []


@dataclass
class Library:
    """What texts are held against: the automaton, labels and lengths of phrases and wordings."""

    automaton: Automaton
    phrase_labels: list[str]
    labels: list[str]
    lengths: list[int]


def library(phrases=PHRASES, wordings=WORDINGS) -> Library:
    """The automaton of (phrase, label) and (label, wording) lists."""
    machine = Automaton()
    split = [words(w.encode()) for _, w in wordings]
    own = [words(p.encode()) for p, _ in phrases]
    if sum(map(len, split + own)) > MOST_TOKENS:
        raise ValueError(f"the wordings have over {MOST_TOKENS} words")
    if any(not x for x in own) or any(len(x) < MATCH for x in split):
        raise ValueError(f"a phrase without words, or a wording of fewer than {MATCH} (which can be a phrase)")
    for i, x in enumerate(split):
        machine.add(x, i)
    for x in own:
        machine.add(x, -1)
    # states are final only now: a later sequence may split one
    ends = {}
    for i, x in enumerate(own):
        s = 0
        for w in x:
            s = machine.step[s][machine.vocabulary[w]]
        ends[s] = (i, len(x))
    machine.settle(ends)
    return Library(machine, [label for _, label in phrases], [label for label, _ in wordings], list(map(len, split)))


class Reader:
    """Reads one text portion by portion: phrase places and matches."""

    def __init__(self, lib: Library):
        self.lib, self.state, self.length, self.at = lib, 0, 0, 0
        self.found: list[tuple[int, int]] = []  # first word, phrase
        self.matches: list[tuple[int, int, int]] = []  # word after the last, words, state

    def read(self, run: list[bytes]) -> None:
        machine = self.lib.automaton
        # an unknown word ends every run, so only stretches of known ones are read word by word
        ids = np.fromiter((machine.vocabulary.get(w, -1) for w in run), np.int32, len(run))
        known = np.flatnonzero(ids >= 0)
        s, n = self.state, self.length
        step, up, long, phrases = machine.step, machine.up, machine.long, machine.phrases
        before = -1
        for i, c in zip(known.tolist(), ids[known].tolist()):
            if i != before + 1:
                self._close(s, n, self.at + before + 1)
                s = n = 0
            before = i
            t = step[s].get(c)
            if t is None:
                self._close(s, n, self.at + i)
                while t is None and s:
                    s = up[s]
                    n = long[s]
                    t = step[s].get(c)
            s, n = (t, n + 1) if t is not None else (0, 0)
            for p, k in phrases[s]:
                if k <= n:
                    self.found.append((self.at + i + 1 - k, p))
        if before != len(run) - 1:
            self._close(s, n, self.at + before + 1)
            s = n = 0
        self.state, self.length, self.at = s, n, self.at + len(run)

    def _close(self, state: int, n: int, end: int) -> None:
        if n >= MATCH:
            self.matches.append((end, n, state))

    def end(self) -> None:
        self._close(self.state, self.length, self.at)


def chains(matches: list[tuple[int, int, int]], lib: Library, gap: int = GAP, cover: float = COVER) -> tuple[list[tuple[int, int, int, float]], float]:
    """([(wording, first word, word after the last, share covered)], best share) of a text's matches.

    Of each wording, a chain is a sequence of matches that go forward in text and wording with at most ``gap`` words
    between; overlaps count once. The best chain ends at each match; spans are best chains of ``cover``
    or more that don't overlap one of the same wording, best first."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for end, n, state in matches:
        for wording, place in lib.automaton.places[state]:
            by.setdefault(wording, []).append((end, place, n))
    spans, best = [], 0.0
    for wording, items in by.items():
        items.sort()
        score, since = [], []
        ends = [x[0] for x in items]
        for j, (end, place, n) in enumerate(items):
            own, first = n, end - n
            for i in range(bisect_left(ends, end - n - gap), j):
                e, p, m = items[i]
                # goes forward in both, its start too, and no further than the gap
                if e < end and p < place and e - m < end - n and p - m < place - n and place - n - p <= gap:
                    new = score[i] + min(n, end - e, place - p)
                    if new > own:
                        own, first = new, since[i]
            score.append(own)
            since.append(first)
        taken: list[tuple[int, int]] = []
        for j in sorted(range(len(items)), key=lambda j: (-score[j], since[j], ends[j])):
            share = score[j] / lib.lengths[wording]
            best = max(best, share)
            if share < cover:
                break
            at = bisect_left(taken, (ends[j], -1))
            if at and taken[at - 1][1] > since[j]:
                continue
            taken.insert(at, (since[j], ends[j]))
            spans.append((wording, since[j], ends[j], share))
    return sorted(spans, key=lambda x: (x[1], x[2], x[0])), best


def scan_text(data: bytes, lib: Library) -> tuple:
    """The columns of SCAN for one text."""
    reader = Reader(lib)
    for part in portions(data):
        reader.read(words(part))
    reader.end()
    spans, best = chains(reader.matches, lib)
    base = sorted({lib.phrase_labels[p] for _, p in reader.found})
    every = sorted({*base, *(lib.labels[w] for w, *_ in spans)})
    first, last = (f(a for a, _ in reader.found) if reader.found else None for f in (min, max))
    rows = [{"label": lib.labels[w], "wording": w, "first": a, "last": b, "covered": share} for w, a, b, share in spans]
    return reader.at, len(reader.found), first, last, ",".join(base), ",".join(every), 1.0 if base else best, rows


def _scanner(lib_, column: str):
    def run(batches):
        lib = lib_.value
        for batch in batches:
            texts = filled(batch.column(column))
            rows = [scan_text(t.as_buffer().to_pybytes() if t.as_buffer() else b"", lib) for t in texts.cast(pa.binary())]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
            made = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], [c.split()[0] for c in SCAN.split(", ", 7)])
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != column]
            yield pa.RecordBatch.from_arrays([*kept, made], [*(c for c in batch.schema.names if c != column), "scan"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, wordings=WORDINGS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row for each row of ``docs``.

    n_base counts the places of all phrases, first_word and last_word are the smallest and the largest word number
    where one begins (null if there is none). labels has base_labels and those of spans: wordings
    of which a chain of matches covers COVER or more. score is 1 where a phrase stands, else the largest share of a wording
    that a chain covers. Null texts count as empty: no words, no labels (''), score 0. Rows with null or equal
    ids are rows of their own; other columns are not read; an empty table gives none. Very long texts
    are read in portions of PORTION bytes; what is kept of them are their matches."""
    lib = docs.sparkSession.sparkContext.broadcast(library(tuple(phrases), tuple(wordings)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scanned = rows.mapInArrow(lean(_scanner(lib, "text")), f"doc_id long, scan struct<{', '.join(f'{c.split(maxsplit=1)[0]}: {c.split(maxsplit=1)[1]}' for c in SCAN.split(', ', 7))}>")
    return scanned.select("doc_id", "scan.*")
