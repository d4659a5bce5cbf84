"""Collocations from weighted acyclic automata: shard transducers of n-gram counts, united by prefix range."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import ranges
from editpulse.sources.staging import stage

MIN_COUNT = 10
TOP = 2000
#: A candidate with this share in hundredths inside one longer candidate is dropped.
COVERED = 50
NO_LANGUAGE = "und"
#: Text that one shard transducer counts, and text whose n-grams make one prefix range.
SHARD_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Ranges told apart by one exchange; more take a second one.
WIDTH = 1024
_RANK_PARTS = 64

_BREAKS = np.zeros(256, np.int64)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1
_INSIDE = _BREAKS == 0
_INSIDE[[0x20, 0x09]] = False
_ALL = np.ones(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Counts(NamedTuple):
    """N-grams of up to three words with weights, in the order of (language, words).

    ``one`` has the columns language, word, weight; ``two`` the row of its first part in ``one``,
    the last word and the weight; ``three`` likewise with rows of ``two``. Rows that only lead to
    longer n-grams weigh 0.
    """

    languages: pa.Array
    words: pa.Array
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray


def _ordered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in byte order, and the place of each value in them."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed weights, and the place of each key."""
    found, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, weights)
    return found, total, place


def _rows(keys: np.ndarray, width: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([keys // max(width, 1), keys % max(width, 1), weights], axis=1)


def count(texts: w.Texts, languages: pa.Array) -> Counts:
    """Sorted n-grams of the texts with their numbers of occurrences; none crosses a piece or a text."""
    found = w.words(texts, _INSIDE)
    data = _LOWER[texts.data]
    sizes = found.end - found.start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[ranges(found.start, sizes)])])
    words, word = _ordered(spelt)
    words = words.cast(pa.binary())
    languages, language = _ordered(languages)
    piece = np.cumsum(_BREAKS[texts.data])[found.start] if len(sizes) else sizes
    size, follows = len(words), (piece[1:] == piece[:-1]) & (found.text[1:] == found.text[:-1])
    key1, place1, n1 = np.unique(language[found.text] * size + word, return_inverse=True, return_counts=True)
    at = np.flatnonzero(follows)
    key2, place2, n2 = np.unique(place1[at] * size + word[at + 1], return_inverse=True, return_counts=True)
    dense = np.zeros(len(word), np.int64)
    dense[at] = place2
    at = np.flatnonzero(follows[1:] & follows[:-1])
    key3, n3 = np.unique(dense[at] * size + word[at + 2], return_counts=True)
    return Counts(languages, words, _rows(key1, size, n1), _rows(key2, size, n2), _rows(key3, size, n3))


def unite(parts: list[Counts]) -> Counts:
    """All n-grams of the parts with summed weights."""
    words, word = _ordered(pa.concat_arrays([p.words for p in parts]))
    languages, language = _ordered(pa.concat_arrays([p.languages for p in parts]))
    size = max(len(words), 1)
    word = np.split(word, np.cumsum([len(p.words) for p in parts])[:-1])
    language = np.split(language, np.cumsum([len(p.languages) for p in parts])[:-1])
    key1, n1, place1 = _summed(
        np.concatenate([lang[p.one[:, 0]] * size + own[p.one[:, 1]] for p, own, lang in zip(parts, word, language, strict=True)]),
        np.concatenate([p.one[:, 2] for p in parts]),
    )
    place1 = np.split(place1, np.cumsum([len(p.one) for p in parts])[:-1])
    key2, n2, place2 = _summed(
        np.concatenate([at[p.two[:, 0]] * size + own[p.two[:, 1]] for p, own, at in zip(parts, word, place1, strict=True)]),
        np.concatenate([p.two[:, 2] for p in parts]),
    )
    place2 = np.split(place2, np.cumsum([len(p.two) for p in parts])[:-1])
    key3, n3, _ = _summed(
        np.concatenate([at[p.three[:, 0]] * size + own[p.three[:, 1]] for p, own, at in zip(parts, word, place2, strict=True)]),
        np.concatenate([p.three[:, 2] for p in parts]),
    )
    return Counts(languages, words, _rows(key1, size, n1), _rows(key2, size, n2), _rows(key3, size, n3))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def choose(counts: Counts, ones: np.ndarray, twos: np.ndarray, threes: np.ndarray) -> Counts:
    """The n-grams in these rows (ascending), first parts of three words among them; rows of ``one``
    that are only needed to reach longer ones stay with weight 0."""
    two, three = counts.two[twos], counts.three[threes]
    first = _distinct(np.concatenate([ones, two[:, 0]]))
    one = counts.one[first]
    own = np.zeros(len(first), bool)
    own[np.searchsorted(first, ones)] = True
    one[~own, 2] = 0
    used = np.zeros(len(counts.words), bool)
    for level in (one, two, three):
        used[level[:, 1]] = True
    number = np.cumsum(used) - 1
    for level in (one, two, three):
        level[:, 1] = number[level[:, 1]]
    two[:, 0], three[:, 0] = np.searchsorted(first, two[:, 0]), np.searchsorted(twos, three[:, 0])
    return Counts(counts.languages, counts.words.filter(pa.array(used)), one, two, three)


def _freeze(owner: np.ndarray, arcs: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge states with equal arcs: the state of each owner, and bounds and arcs of the distinct states.

    Arcs are sorted by owner, so a state is complete when the next owner begins. It is then looked
    up in the register of earlier states and added only if its arcs are new.
    """
    bounds = np.searchsorted(owner, np.arange(states + 1))
    sizes = np.diff(bounds)
    target = np.zeros(states, np.int64)
    chosen = [np.flatnonzero(sizes == 0)[:1]]
    frozen = len(chosen[0])  # state 0 is the one without arcs, if any
    for size in np.flatnonzero(np.bincount(sizes, minlength=1)).tolist():
        if size == 0:
            continue
        mine = np.flatnonzero(sizes == size)
        rows = arcs[ranges(bounds[mine], sizes[mine])]
        if size == 1 and int(rows[:, 0].max() + 1) * int(rows[:, 1].max() + 1) < 1 << 62:
            _, first, place = np.unique(rows[:, 0] * (rows[:, 1].max() + 1) + rows[:, 1], return_index=True, return_inverse=True)
        else:
            register: dict[bytes, int] = {}
            raw, step = rows.tobytes(), rows.shape[1] * rows.itemsize * size
            place = np.array([register.setdefault(raw[k : k + step], len(register)) for k in range(0, len(raw), step)], np.int64)
            first = np.unique(place, return_index=True)[1]
        chosen.append(mine[first])
        target[mine] = frozen + place
        frozen += len(first)
    order = np.concatenate(chosen)
    return target, np.concatenate([[0], np.cumsum(sizes[order])]), arcs[ranges(bounds[order], sizes[order])]


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes, column by column, after a byte with their width."""
    flat = np.ascontiguousarray(values.T, np.int64).reshape(-1)
    width = (int(flat.max(initial=0)).bit_length() + 7) // 8 or 1
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, columns: int = 1) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    flat = np.zeros((planes.shape[1], 8), np.uint8)
    flat[:, : data[0]] = planes.T
    flat = flat.view(np.int64).reshape(-1)
    return flat if columns == 1 else np.ascontiguousarray(flat.reshape(columns, -1).T)


AUTOMATON = "languages array<string>, words binary, sizes binary, one binary, two binary, bounds binary, three binary"
_FIELDS = [f.strip().split(" ")[0] for f in AUTOMATON.split(", ")]
_TYPES = [pa.list_(pa.string()), *[pa.binary()] * 6]


def freeze(counts: Counts) -> list:
    """Cells of the minimal transducer: paths of two words, then shared states with the third."""
    target, bounds, arcs = _freeze(counts.three[:, 0], counts.three[:, 1:], len(counts.two))
    two = np.column_stack([counts.two, target])
    spelt = w.text_bytes(counts.words)
    words = zstandard.ZstdCompressor(level=1).compress(spelt.data.tobytes())
    return [counts.languages.to_pylist(), words, _pack(np.diff(spelt.offsets)), _pack(counts.one), _pack(two), _pack(np.diff(bounds)), _pack(arcs)]


def thaw(cells: dict) -> Counts:
    """The counts of a transducer."""
    spelt = zstandard.ZstdDecompressor().decompress(cells["words"])
    offsets = np.concatenate([[0], np.cumsum(_unpack(cells["sizes"]))]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(spelt)])
    one, two, arcs = _unpack(cells["one"], 3), _unpack(cells["two"], 4), _unpack(cells["three"], 2)
    bounds = np.concatenate([[0], np.cumsum(_unpack(cells["bounds"]))]).astype(np.int64)
    target = two[:, 3]
    sizes = np.diff(bounds)[target] if len(two) else np.empty(0, np.int64)
    three = np.column_stack([np.repeat(np.arange(len(two)), sizes), arcs[ranges(bounds[target], sizes)]])
    return Counts(pa.array(cells["languages"], pa.string()), words, one, two[:, :3], three)


def _slots(counts: Counts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of every row of ``one`` and ``two``: equal shares of the hashes of one- and two-word prefixes."""
    word = w.words(w.text_bytes(counts.words), _ALL).hash
    language = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in counts.languages.to_pylist()], np.uint64)
    first = w.mix(language[counts.one[:, 0]] ^ word[counts.one[:, 1]])
    second = w.mix(first[counts.two[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + word[counts.two[:, 1]])
    return tuple(((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64) for x in (first, second))


def _divided(counts: Counts, n: int) -> Iterator[tuple[int, Counts]]:
    """The n-grams of each of ``n`` prefix ranges that has any; an n-gram lies where its first two words do."""
    first, second = _slots(counts, n)
    third = second[counts.three[:, 0]]
    first[counts.one[:, 2] == 0] = n  # only ways to longer ones
    orders = [np.argsort(x.astype(np.uint16) if n < 1 << 16 else x, kind="stable") for x in (first, second, third)]
    edges = [np.searchsorted(x[o], np.arange(n + 1)) for x, o in zip((first, second, third), orders, strict=True)]
    for slot in range(n):
        ones, twos, threes = (o[e[slot] : e[slot + 1]] for o, e in zip(orders, edges, strict=True))
        if len(ones) or len(twos):
            yield slot, choose(counts, ones, twos, threes)


def _batch(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _table(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, names, types)])


def count_automata(documents: DataFrame, min_count: int, shard_bytes: int, range_bytes: int, width: int) -> DataFrame:
    """One transducer per prefix range with all n-grams of at least ``min_count`` occurrences, and the
    numbers of words per language that the range's single words make up.

    A shard counts a bounded amount of text and builds one transducer per range from its sorted
    n-grams. Ranges take in a fixed amount of text each, so their number follows the input. Where
    they are more than ``width``, shards send coarse ranges, dealt over groups of shards; the united
    transducers are then divided into the final ranges. Frequent prefixes are one entry per shard.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    final = max(1, -(-size // range_bytes))
    coarse = min(final, width)
    salts = 1 if final <= width else -(-size // (shard_bytes * width))
    finer = -(-final // coarse)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * 7919
        for part in w.slices(batches, "text", shard_bytes):
            counts = count(w.text_bytes(part.column("text")), part.column("lang"))
            number += 1
            for slot, mine in _divided(counts, coarse):
                yield _batch([[slot, number % salts, *freeze(mine)]], ["slot", "salt", *_FIELDS], [pa.int64(), pa.int64(), *_TYPES])

    def united(table: pa.Table) -> Counts:
        return unite([thaw(r) for r in table.to_pylist()])

    def finish(slot: int, counts: Counts) -> list:
        words = np.bincount(counts.one[:, 0], counts.one[:, 2], len(counts.languages)).astype(np.int64)
        totals = [{"lang": a, "n": b} for a, b in zip(counts.languages.to_pylist(), words.tolist(), strict=True)]
        kept = choose(counts, *(np.flatnonzero(x[:, 2] >= min_count) for x in (counts.one, counts.two, counts.three)))
        return [slot, totals, *freeze(kept)]

    done = ["slot", "totals", *_FIELDS], [pa.int64(), pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])), *_TYPES]
    done_layout = f"slot long, totals array<struct<lang:string,n:long>>, {AUTOMATON}"

    def unite_all(table: pa.Table) -> pa.Table:
        return _table([finish(table.column("slot")[0].as_py(), united(table))], *done)

    def unite_some(table: pa.Table) -> pa.Table:
        fine = (([slot, *freeze(mine)]) for slot, mine in _divided(united(table), coarse * finer))
        return _table(list(fine), ["slot", *_FIELDS], [pa.int64(), *_TYPES])

    spoken = documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    sent = spoken.mapInArrow(shards, f"slot long, salt long, {AUTOMATON}")
    if salts > 1 or finer > 1:
        sent = sent.groupBy("slot", "salt").applyInArrow(unite_some, f"slot long, {AUTOMATON}")
    else:
        sent = sent.drop("salt")
    return sent.groupBy("slot").applyInArrow(unite_all, done_layout).withColumn("n_slots", F.lit(coarse * finer).cast("long"))


def _spelt(counts: Counts, *levels: np.ndarray) -> list[str]:
    words = counts.words.cast(pa.string())
    return pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in levels), " ").to_pylist() if len(levels) > 1 else words.take(pa.array(levels[0])).to_pylist()


_ASK = ["slot", "asker", "lang", "part", "longest"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_ANSWER = ["slot", "lang", "part", "weight", "longest"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_SCORED = ["lang", "phrase", "a", "l", "r", "score"], [pa.string(), pa.string(), *[pa.int64()] * 4]


def _asked(counts: Counts, slot: int, n_slots: int) -> pa.RecordBatch:
    """Parts whose counts the candidates of a range need, with the range that has each.

    Two-word parts carry the largest count of a three-word candidate that ends in them.
    """
    first, second, third = counts.one, counts.two, counts.three
    wanted2, wanted3 = second[:, 2] > 0, np.ones(len(third), bool)
    path = second[third[:, 0]]
    size = max(len(counts.words), 1)
    language2, language3 = first[second[:, 0], 0], first[path[:, 0], 0]
    singles = np.unique(
        np.concatenate([language2[wanted2] * size + first[second[wanted2, 0], 1], language2[wanted2] * size + second[wanted2, 1], language3 * size + third[:, 1]])
    )
    pairs, place = np.unique((language3 * size + path[:, 1]) * size + third[:, 1], return_inverse=True)
    longest = np.zeros(len(pairs), np.int64)
    np.maximum.at(longest, place, third[wanted3, 2])
    lone = Counts(counts.languages, counts.words, _rows(singles, size, np.ones(len(singles), np.int64)), np.empty((0, 3), np.int64), np.empty((0, 3), np.int64))
    starts, at = np.unique(pairs // size, return_inverse=True)
    paired = Counts(counts.languages, counts.words, _rows(starts, size, starts * 0), np.column_stack([at, pairs % size, longest]), np.empty((0, 3), np.int64))
    to1, to2 = _slots(lone, n_slots)[0], _slots(paired, n_slots)[1]
    languages = counts.languages.take(pa.array(np.concatenate([lone.one[:, 0], paired.one[at, 0]])))
    parts = _spelt(counts, lone.one[:, 1]) + _spelt(counts, paired.one[at, 1], paired.two[:, 1])
    rows = [np.concatenate([to1, to2]), np.full(len(parts), slot), languages, parts, np.concatenate([np.zeros(len(singles), np.int64), longest])]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _ASK[1], strict=True)], names=_ASK[0])


def compose(counts: Counts, languages: list[str], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the parts, and their rows in ``two`` (-1 for single words): the acceptor of all parts run through the transducer."""
    size = max(len(counts.words), 1)
    pieces = [p.split(" ") for p in parts]
    spelt = lambda column: pc.index_in(pa.array([x.encode() for x in column], pa.binary()), counts.words).fill_null(-1).to_numpy()
    language = pc.index_in(pa.array(languages, pa.string()), counts.languages).to_numpy()
    level1 = np.searchsorted(counts.one[:, 0] * size + counts.one[:, 1], language * size + spelt([p[0] for p in pieces]))
    weight, row = counts.one[level1, 2], np.full(len(parts), -1)
    longer = np.flatnonzero([len(p) > 1 for p in pieces])
    if len(longer):
        last = spelt([pieces[k][1] for k in longer.tolist()])
        row[longer] = np.searchsorted(counts.two[:, 0] * size + counts.two[:, 1], level1[longer] * size + last)
        weight[longer] = counts.two[row[longer], 2]
    return weight, row


def _scored(counts: Counts, answers: pa.Table, covered: int) -> list[list]:
    """Candidates of a range that no longer candidate covers, with the lowest score of their cuts."""
    known, longest = {}, {}
    for lang, part, weight, longer in zip(*(answers.column(c).to_pylist() for c in _ANSWER[0][1:]), strict=True):
        if weight is None:
            longest[lang, part] = longer
        else:
            known[lang, part] = weight
    first, second, third = counts.one, counts.two, counts.three
    inner = np.zeros(len(second), np.int64)
    np.maximum.at(inner, third[:, 0], third[:, 2])
    languages = counts.languages.take(pa.array(first[second[:, 0], 0])).to_pylist()
    word = counts.words.cast(pa.string()).to_pylist()
    rows = []
    for k, (at, last, a) in enumerate(second.tolist()):
        if a:
            head, tail, lang = word[first[at, 1]], word[last], languages[k]
            phrase = f"{head} {tail}"
            if 100 * max(int(inner[k]), longest.get((lang, phrase), 0)) < covered * a:
                left, right = known[lang, head], known[lang, tail]
                rows.append([lang, phrase, a, left, right, 1_000_000 * a * a // (left * right)])
    for at, last, a in third.tolist():
        up, middle, weight = second[at].tolist()
        head, middle, tail, lang = word[first[up, 1]], word[middle], word[last], languages[at]
        cuts = [(known[lang, head], known[lang, f"{middle} {tail}"]), (weight, known[lang, tail])]
        score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        rows.append([lang, f"{head} {middle} {tail}", a, left, right, score])
    return rows


def mine_collocations(
    documents: DataFrame,
    top: int = TOP,
    min_count: int = MIN_COUNT,
    covered: int = COVERED,
    shard_bytes: int = SHARD_BYTES,
    range_bytes: int = RANGE_BYTES,
    width: int = WIDTH,
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language of ``documents`` (text, lang):
    lang, rank, phrase, a, l, r, n and score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at
    spaces and tabs. a counts all occurrences of the phrase inside pieces, l and r those of its two
    parts at the cut with the lowest score (the first of equal ones), n all words of the language.
    The score is floor(1000000 * a * a / (l * r)), in exact arithmetic. Phrases occur ``min_count``
    times or more; those of which ``covered`` hundredths or more lie in one longer such phrase go.
    Order is by score, then a, both descending, then phrase in byte order, so there are no ties.

    Shards of text build transducers from their sorted n-grams and send them by prefix range, where
    they are united and weights summed (see ``count_automata``). Candidates need the counts of their
    parts: each range sends its parts as rows to the ranges that hold them, where they are composed
    with the transducer, and gets weights back. Every part of a candidate is at least as frequent as
    the candidate, so rarer n-grams are left out after the union without loss.

    A missing lang is ``und``. Null and empty texts have no words. Repeated rows count repeatedly.
    Empty tables, and languages without a frequent phrase, give no rows. No other columns are read.
    """
    automata = stage(count_automata(documents, min_count, shard_bytes, range_bytes, width), "automata")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield _asked(thaw(row), row["slot"], row["n_slots"])

    def answer(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        parts, languages = asked.column("part").to_pylist(), asked.column("lang").to_pylist()
        if not parts:
            return _table([], *_ANSWER)
        weight, row = compose(thaw(table.to_pylist()[0]), languages, parts)
        longest = np.zeros(int(row.max()) + 2, np.int64)
        np.maximum.at(longest, row + 1, asked.column("longest").to_numpy())
        pairs, one_of = np.unique(row[row >= 0], return_index=True)
        one_of = np.flatnonzero(row >= 0)[one_of]
        back = pa.table([asked.column("asker"), asked.column("lang"), asked.column("part"), pa.array(weight), pa.nulls(len(parts), pa.int64())], names=_ANSWER[0])
        own = [np.full(len(pairs), key[0].as_py()), [languages[k] for k in one_of], [parts[k] for k in one_of], pa.nulls(len(pairs), pa.int64()), longest[pairs + 1]]
        return pa.concat_tables([back, pa.table([pa.array(x, t) for x, t in zip(own, _ANSWER[1], strict=True)], names=_ANSWER[0])])

    def score(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return _table(_scored(thaw(table.to_pylist()[0]), answers, covered) if table.num_rows else [], *_SCORED)

    asked = automata.drop("totals").mapInArrow(ask, "slot long, asker long, lang string, part string, longest long")
    held = automata.drop("totals", "n_slots").groupBy("slot")
    answers = held.cogroup(asked.groupBy("slot")).applyInArrow(answer, "slot long, lang string, part string, weight long, longest long")
    held = automata.drop("totals", "n_slots").groupBy("slot")
    scored = held.cogroup(answers.groupBy("slot")).applyInArrow(score, "lang string, phrase string, a long, l long, r long, score long")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS))
    few = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = automata.select(F.explode("totals").alias("t")).groupBy(F.col("t.lang").alias("lang")).agg(F.sum("t.n").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
