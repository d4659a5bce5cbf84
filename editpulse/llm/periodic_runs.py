"""Periodic runs of words, found from the Lyndon arrays of Baier's suffix grouping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import ranges, row_of

MIN_WORDS = 12
MIN_PERIODS = 2
_SLICE_BYTES = 1 << 20
_RUN = "struct<start:long,length:long,period:long>"


def lyndon_lengths(letters: np.ndarray) -> list[int]:
    """Length of the longest Lyndon word that starts at each place: phase one of Baier's suffix sorter.

    Suffixes are grouped by a common prefix, their context; groups are ordered. From the highest
    group down, each member points to the nearest place on its left in a lower group. Places that
    the same number of members point to leave their group for a new one directly above it, whose
    context is longer by that many copies of the current one. A group's context is then the longest
    Lyndon word at its members. Members that moved on are skipped when their old group is reached.
    """
    size = len(letters)
    if not size:
        return []
    _, numbered = np.unique(letters, return_inverse=True)
    places = np.argsort(numbered, kind="stable")
    members = [x.tolist() for x in np.split(places, np.cumsum(np.bincount(numbered))[:-1])]
    group = numbered.tolist()
    top = len(members) - 1
    below, above, context = list(range(-1, top)), [*range(1, top + 1), -1], [1] * (top + 1)
    left = list(range(-1, size - 1))
    done = bytearray(size)
    lengths = [0] * size
    current = top
    while current >= 0:
        live = [s for s in members[current] if group[s] == current]
        members[current] = []
        length = context[current]
        for s in live:
            done[s] = 1
            lengths[s] = length
        pointed: dict[int, list[int]] = {}  # number of pointers -> places in ascending order
        last, count = -1, 0
        for s in live:
            p = s - 1
            while p >= 0 and done[p]:
                p = left[p]
            q = s - 1
            while q > p and left[q] > p:  # shorten the path for later walks
                left[q], q = p, left[q]
            left[s] = p
            if p == last:
                count += 1
            else:
                if last >= 0:
                    pointed.setdefault(count, []).append(last)
                last, count = p, 1
        if last >= 0:
            pointed.setdefault(count, []).append(last)
        for count in sorted(pointed, reverse=True):
            moved: dict[int, int] = {}
            for p in pointed[count]:
                g = group[p]
                new = moved.get(g)
                if new is None:
                    new = moved[g] = len(members)
                    members.append([])
                    context.append(context[g] + count * length)
                    upper = above[g]
                    below.append(g)
                    above.append(upper)
                    above[g] = new
                    below[upper] = new
                group[p] = new
                members[new].append(p)
        current = below[current]
    return lengths


def _names(letters: np.ndarray) -> list[np.ndarray]:
    """Names of all factors of length 1, 2, 4, …: equal factors of one length have equal names."""
    levels = [letters]
    width = 1
    while len(levels[-1]) > width:
        last = levels[-1]
        pairs = last[:-width] * np.int64(len(letters) + 1) + last[width:]
        kinds, names = np.unique(pairs, return_inverse=True)
        levels.append(names.astype(np.int64))
        width *= 2
        if len(kinds) == len(pairs):
            break
    return levels


def _extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Length of the longest common extension of each pair of places, rightwards (1) or leftwards (-1), for a < b."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, names = 1 << k, levels[k]
        low = a + found if step > 0 else a - found - width + 1
        high = b + found if step > 0 else b - found - width + 1
        fits = (low >= 0) & (high < len(names))
        equal = np.zeros(len(a), bool)
        equal[fits] = names[low[fits]] == names[high[fits]]
        found += width * equal
    return found


def runs_of(letters: np.ndarray, breaks: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period) of all runs in a sequence of words, by start, then period.

    ``letters`` are dense numbers from 1; places marked in ``breaks`` hold no word and no run
    contains one. Each run has a Lyndon root under the order of numbers or its reverse: both Lyndon
    arrays give the candidate roots, which common extensions to both sides turn into runs.
    """
    size = len(letters)
    if size < min_words:
        return np.empty((0, 3), np.int64)
    top = int(letters.max()) + 1
    start, period = [], []
    for order in (letters, top - letters):
        lengths = np.array(lyndon_lengths(np.where(breaks, 0, order)), np.int64)
        place = np.flatnonzero(~breaks)
        start.append(place)
        period.append(lengths[place])
    roots = np.unique(np.concatenate(start) * np.int64(size + 1) + np.concatenate(period))
    start, period = roots // (size + 1), roots % (size + 1)
    levels = _names(np.where(breaks, top + np.cumsum(breaks), letters).astype(np.int64))
    right = _extend(levels, start, start + period, 1)
    left = _extend(levels, start - 1, start + period - 1, -1)
    length = left + period + right
    good = (length >= min_words) & (length >= MIN_PERIODS * period)
    return np.unique(np.stack([start - left, period, length], axis=1)[good], axis=0)[:, [0, 2, 1]]


def _stretches(found: w.Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the stretches of words that can hold a run.

    In a run of length L and period q the words but the last q come again q later. That are at
    least half of ``min_words``, and both copies together cover the run. So every run lies in a
    stretch that repeated grams of that many words cover.
    """
    part = (min_words + 1) // 2
    inside = np.flatnonzero(w.within(found, part))
    if not len(inside):
        return inside, inside
    keys = w.grams(found.hash, part)[inside] ^ w.mix(found.text[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    repeated = np.zeros(len(keys), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    steps = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(steps, inside[repeated], 1)
    np.add.at(steps, inside[repeated] + part, -1)
    covered = np.cumsum(steps)[:-1] > 0
    opens = covered.copy()
    opens[1:] &= ~covered[:-1] | (found.text[1:] != found.text[:-1])
    start = np.flatnonzero(opens)
    ends = np.flatnonzero(np.append(covered[:-1] & (~covered[1:] | (found.text[1:] != found.text[:-1])), covered[-1:])) + 1
    long = ends - start >= min_words
    return start[long], (ends - start)[long]


def _numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Dense numbers from 1 of the words between these bytes; equal words and only these have equal numbers."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[ranges(start, sizes)])])
    return spelt.dictionary_encode().indices.to_numpy().astype(np.int64) + 1


def word_runs(texts: w.Texts, min_words: int = MIN_WORDS) -> tuple[w.Words, np.ndarray]:
    """Words of the texts, and all runs as rows (first word, length, period), words numbered through."""
    found = w.words(texts, w.NOT_SPACE)
    start, sizes = _stretches(found, min_words)
    if not len(start):
        return found, np.empty((0, 3), np.int64)
    chosen = ranges(start, sizes)
    letters = _numbered(texts.data, found.start[chosen], found.end[chosen])
    ends = np.cumsum(sizes)
    place = np.arange(len(chosen)) + np.repeat(np.arange(len(sizes)), sizes)  # one break after each stretch
    joined = np.zeros(len(chosen) + len(sizes), np.int64)
    joined[place] = letters
    back = np.zeros(len(joined), np.int64)
    back[place] = chosen
    breaks = np.zeros(len(joined), bool)
    breaks[ends + np.arange(len(sizes))] = True
    runs = runs_of(joined, breaks, min_words)
    runs[:, 0] = back[runs[:, 0]]
    return found, runs


def collapse_runs(documents: DataFrame, carry: Iterable[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``documents`` (text): ``row`` (the columns ``carry``, all by default), ``n_words``,
    ``runs`` (start, length and period of each, by start, then period, in words from 0) and
    ``collapsed_text``: the words joined by a space, without those after the first period of a run.

    A run is a stretch of words with smallest period q, at least ``min_words`` and two periods long,
    that no neighbouring word extends. A word goes if any run holds it after that run's first q
    words. All runs of a text count, also overlapping ones of different periods.

    Every text is judged alone and whole in its own task; nothing is shuffled. Stretches that no
    repeated gram covers are passed over, as they hold no run; words are compared exactly in the
    others. Memory follows 1 MB of text or one longer text.

    Words are runs of anything but ASCII white space. Null and empty texts have no words, no runs
    and an empty collapsed text. Repeated rows get equal results; no id is read. Empty tables give
    empty results. Other columns are not read unless carried.
    """
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text", _SLICE_BYTES):
            texts = w.text_bytes(part.column("text"))
            found, runs = word_runs(texts, min_words)
            rows = w.rows(found, len(texts))
            owner = found.text[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            drop = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(drop)[:-1] == 0
            collapsed = []
            for i, (a, b) in enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)):
                spoken = texts.data[a:b].tobytes().split()
                if bounds[i] < bounds[i + 1]:
                    spoken = [spoken[k] for k in np.flatnonzero(kept[rows[i] : rows[i + 1]]).tolist()]
                collapsed.append(b" ".join(spoken))
            fields = [pa.array(runs[:, 0] - rows[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(span)))
            columns = [part.column("row"), pa.array(np.diff(rows).astype(np.int64)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "runs", "collapsed_text"])

    frame = documents.select(row_of(documents, carry), F.col("text"))
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {kind}, n_words long, runs array<{_RUN}>, collapsed_text string")
