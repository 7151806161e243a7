"""Evaluation texts leaking into training text, found through an FM-index of every shard of the corpus.

The suffix array of a shard's words is sorted by prefix doubling, and the Burrows-Wheeler transform of the words is
kept in a wavelet matrix. Phrases of the evaluation items are searched backwards, all at once, by ranks in the matrix;
occurrences are located from sampled suffix positions. Where as many phrases of one item gather in a text as survive
the edits a passage may have, the two are aligned word by word, and what holds enough of the item is reported. Spans
of a text are merged for removal.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.folding import fold
from cinelake.plans.layout import spread
from cinelake.plans.scratch import checkpoint, new_path, write_bytes

#: Words of a passage, and the edits it may have.
PASSAGE, EDITS = 12, 2
#: Items that begin with one first sentence for it to be an opening line.
OPENING = 3
#: Words of a search phrase: of items as long as a passage, and of shorter ones.
PHRASE, SHORT_PHRASE = 3, 2
#: How far two phrases of a passage may have shifted against each other: every edit shifts by one word.
SHIFT = EDITS
#: Words of a shard; every so many suffix positions is kept.
SHARD_WORDS, SAMPLE = 200_000, 8
#: Items a task holds at once; more lie in several files of the shared folder and are searched for in turn, in one index.
PART_ITEMS = 20_000
#: Bits of the table of words that items have; a word that shares its bit with one of them is indexed for nothing.
MARKS = 1 << 20
#: Occurrences of phrases looked at together.
MOST_HITS = 4_000_000

_TAG = re.compile(r"<[^<>]{0,200}>|&[a-zA-Z]{2,8};|&#\d{1,6};")
_WORD = re.compile(r"[0-9a-z]+")


def words(text: str | None) -> list[str]:
    """Folded words of a text; markup, punctuation and spacing only separate them."""
    if not text:
        return []
    return _WORD.findall(fold(_TAG.sub(" ", text) if "<" in text or "&" in text else text))


class FMIndex:
    """Counts and places of phrases in a sequence of symbols; symbol 0 separates and is in no phrase."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        bits = max(1, int(symbols).bit_length())
        step, key = 1, text + 1
        while step < min(n, 62 // bits):  # as many first symbols as fit in a key
            after = np.zeros(n, np.int64)
            after[: n - step] = text[step:] + 1
            key, step = key << bits | after, step + 1
        while True:  # then by twice, four times, ... as many, until all suffixes differ
            order = np.argsort(key)
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
            if rank[order[-1]] == n - 1 or step >= n:
                break
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key, step = rank * (n + 2) + after, step * 2
        self.n, self.first = n, np.searchsorted(text[order], np.arange(symbols + 1))
        bwt = text[order - 1]
        self.marked = (order % SAMPLE == 0) | (bwt == 0)  # no walk crosses a separator
        self.marks = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]
        self.depth = max(1, int(symbols - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        level = bwt
        for d in reversed(range(self.depth)):
            bit = (level >> d & 1).astype(bool)
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate([level[~bit], level[bit]])
        self.starts = np.zeros(symbols, np.int64)
        self.starts = self.rank(np.arange(symbols), np.zeros(symbols, np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the transformed text."""
        for k, d in enumerate(reversed(range(self.depth))):
            one = self.ones[k][i]
            i = np.where(symbol >> d & 1, self.zeros[k] + one, i - one)
        return i - self.starts[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes beginning with each row of ``phrases``, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in reversed(range(phrases.shape[1])):
            c = phrases[:, k]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one, all rows at once."""
        out, now, steps = np.full(len(rows), -1), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.marked[now]
            out[left[done]] = self.samples[self.marks[now[done]]] + steps
            left, now = left[~done], now[~done]
            if len(left):
                symbol = np.zeros(len(now), np.int64)
                i = now
                for k, d in enumerate(reversed(range(self.depth))):
                    bit = self.bits[k][i]
                    symbol |= bit.astype(np.int64) << d
                    i = np.where(bit, self.zeros[k] + self.ones[k][i], i - self.ones[k][i])
                now = self.first[symbol] + i - self.starts[symbol]
            steps += 1
        return out


@dataclass(frozen=True)
class Items:
    """Evaluation items without opening lines, and their distinct phrases by length with the places they are used at.

    ``phrases[q]`` are rows of words; phrase p is used by items ``item[q][at[q][p] : at[q][p + 1]]`` from word ``word[q][...]`` on.
    """

    ids: list[int]
    texts: list[list[str]]
    phrases: dict[int, list[tuple[str, ...]]]
    at: dict[int, np.ndarray]
    item: dict[int, np.ndarray]
    word: dict[int, np.ndarray]
    aligner: Aligner


def opening(text: str | None) -> str:
    """Folded words of the first sentence, where something follows it; else the empty string."""
    first = words(re.split(r"(?<=[.!?:])\s", (text or "").strip(), maxsplit=1)[0])
    return " ".join(first) if len(first) < len(words(text)) else ""


def phrase_words(n: int) -> int:
    """Words of the search phrases of an item of ``n`` words."""
    return PHRASE if n >= PASSAGE else min(SHORT_PHRASE, n)


def surviving(n: int) -> int:
    """Phrases that survive the edits of the shortest passage of an item of ``n`` words: an edit breaks up to one more than a phrase has words."""
    q, span = phrase_words(n), min(PASSAGE, n)
    return span - q + 1 - (q + 1) * (span * EDITS // PASSAGE)


def prepare(rows: list[tuple[int, str, bool]]) -> Items:
    """Items (id, text, whether the first sentence is an opening line) for the search; items without words are left out."""
    ids, texts = [], []
    for i, t, cut in sorted({r[0]: r for r in rows if r[0] is not None and r[1]}.values()):
        w = words(t)[len(opening(t).split()) if cut else 0 :]
        if w:
            ids.append(i), texts.append(w)
    uses: dict[int, dict[tuple[str, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for k, t in enumerate(texts):
        q = phrase_words(len(t))
        for at in range(len(t) - q + 1):
            uses[q][tuple(t[at : at + q])].append((k, at))
    flat = {q: [x for where in by.values() for x in where] for q, by in uses.items()}
    return Items(
        ids, texts, {q: list(by) for q, by in uses.items()}, {q: np.concatenate([[0], np.cumsum([len(w) for w in by.values()])]) for q, by in uses.items()},
        {q: np.array([k for k, _ in x]) for q, x in flat.items()}, {q: np.array([w for _, w in x]) for q, x in flat.items()}, Aligner(texts),
    )


class Aligner:
    """Local alignments of items with stretches of text, many at once.

    An equal word counts 2, a replaced, added, dropped or broken one -1; a broken word is two words of the text that make
    one of the item, or the other way round. A passage is PASSAGE or more words of the item (or all of a shorter one); its
    excess is PASSAGE x edits - EDITS x words, above 0 where too much was changed.
    """

    #: Cells of the tables of one round.
    CELLS = 6_000_000

    def __init__(self, items: list[list[str]]):
        code: dict[str, int] = {}
        get = code.setdefault
        self.items = [(np.array([get(w, len(code)) for w in t]), np.array([-1] + [get(x + y, len(code)) for x, y in zip(t, t[1:])])) for t in items]
        self.code = code

    def text(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words, and of each word joined to the one before it; -2 for what no item has."""
        get = self.code.get
        return np.array([get(w, -2) for w in words_]), np.array([-2] + [get(x + y, -2) for x, y in zip(words_, words_[1:])])

    def align(self, wanted: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        """(score, first, last, least excess of a passage) of the best alignment of each (item, codes of a stretch of text)."""
        out: list[tuple[int, int, int, int]] = [(0, 0, -1, 1)] * len(wanted)
        order = sorted(range(len(wanted)), key=lambda x: (len(self.items[wanted[x][0]][0]), len(wanted[x][1])))
        start = 0
        while start < len(order):
            end, n, m = start, 0, 0
            while end < len(order):
                k, t, _ = wanted[order[end]]
                n_, m_ = max(n, len(self.items[k][0])), max(m, len(t))
                if end > start and (n_ + 1) * (m_ + 1) * (end + 1 - start) > self.CELLS:
                    break
                n, m, end = n_, m_, end + 1
            for x, found in zip(order[start:end], self._round([wanted[x] for x in order[start:end]], n, m)):
                out[x] = found
            start = end
        return out

    def _round(self, wanted: list[tuple[int, np.ndarray, np.ndarray]], n: int, m: int) -> list[tuple[int, int, int, int]]:
        size = len(wanted)
        item, pair = np.full((size, n), -3, np.int32), np.full((size, n), -3, np.int32)
        text, joined = np.full((size, m), -4, np.int32), np.full((size, m), -4, np.int32)
        for b, (k, t, j) in enumerate(wanted):
            w, p = self.items[k]
            item[b, : len(w)], pair[b, : len(w)], text[b, : len(t)], joined[b, : len(t)] = w, p, t, j
        pair[:, 0] = -3  # the first word has none before it
        joined[:, 0] = -4
        kind = np.int16 if 2 * n + m < 32_000 else np.int32
        score = np.zeros((n + 1, size, m + 1), kind)
        steps, two, one = np.arange(m + 1, dtype=kind), kind(2), kind(-1)
        top, end = np.zeros(size, kind), np.zeros((2, size), np.int64)
        for i in range(1, n + 1):
            over, row = score[i - 1], score[i]
            best = row[:, 1:]
            np.maximum(over[:, :-1] + np.where(item[:, i - 1, None] == text, two, one), over[:, 1:] - kind(1), out=best)
            b, y = np.nonzero(item[:, i - 1, None] == joined[:, 1:])
            best[b, y + 1] = np.maximum(best[b, y + 1], over[b, y])
            if i > 1:
                b, y = np.nonzero(pair[:, i - 1, None] == text)
                best[b, y] = np.maximum(best[b, y], score[i - 2][b, y])
            np.maximum(best, 0, out=best)
            row += steps
            np.maximum.accumulate(row, axis=1, out=row)  # a word added takes 1 from what is to the left
            row -= steps
            at = row.argmax(axis=1)
            high = row[np.arange(size), at]
            more = high > top
            top, end[0], end[1] = np.where(more, high, top), np.where(more, i, end[0]), np.where(more, at, end[1])
        i, j = end.copy()
        last, edits, live = j - 1, np.ones((size, n + 1), np.int64), np.flatnonzero(top > 0)
        i, j = i.copy(), j.copy()
        while len(live):
            b, x, y = live, i[live], j[live]
            s = score[x, b, y]
            w, t = item[b, x - 1], text[b, y - 1]
            diagonal = s == score[x - 1, b, y - 1] + np.where(w == t, 2, -1)
            dropped = ~diagonal & (s == score[x - 1, b, y] - 1)
            added = ~diagonal & ~dropped & (s == score[x, b, y - 1] - 1)
            rest = ~diagonal & ~dropped & ~added
            broken = rest & (y > 1) & (w == joined[b, y - 1]) & (s == score[x - 1, b, np.maximum(y - 2, 0)])
            merged = rest & ~broken
            edits[b[diagonal], x[diagonal] - 1] = (w != t)[diagonal]
            edits[b[added], x[added]] += 1  # before the item's next word; the last column takes what follows the item
            edits[b[merged], x[merged] - 1] = 0
            i[b] = x - np.where(added, 0, np.where(merged, 2, 1))
            j[b] = y - np.where(dropped, 0, np.where(broken, 2, 1))
            live = live[(i[live] > 0) & (j[live] > 0)]
            live = live[score[i[live], live, j[live]] > 0]
        out = []
        for b, (k, *_) in enumerate(wanted):
            size_ = len(self.items[k][0])
            span = min(PASSAGE, size_)
            total = np.concatenate([[0], np.cumsum(edits[b, :size_])])
            over = PASSAGE * total - EDITS * np.arange(size_ + 1)
            out.append((int(top[b]), int(j[b]), int(last[b]), int((over[span:] - np.maximum.accumulate(over)[:-span]).min())))
        return out


def _shards(texts: list[list[str]]) -> Iterator[list[int]]:
    part, size = [], 0
    for k, w in enumerate(texts):
        if part and size + len(w) > SHARD_WORDS:
            yield part
            part, size = [], 0
        part.append(k)
        size += len(w)
    if part:
        yield part


def _bit(word: str) -> int:
    return zlib.crc32(word.encode()) % MARKS


class Vocabulary(dict):
    """Codes from 1 up for words as they come; 0 for words that no item has, as far as ``marks`` tell."""

    def __init__(self, marks: bytes | None):
        self.marks, self.size = marks, 1

    def __missing__(self, word: str) -> int:
        bit = _bit(word)
        known = self.marks is None or self.marks[bit >> 3] >> (bit & 7) & 1
        self[word] = found = self.size if known else 0
        self.size += bool(known)
        return found


class Shard:
    """Some texts, their words as codes of the shard's own vocabulary, and the index of these.

    Words that are in no item only separate, and one separator is as good as many.
    """

    def __init__(self, texts: list[list[str]], marks: bytes | None = None):
        self.texts = texts
        self.begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.vocabulary = code = Vocabulary(marks)
        codes = np.zeros(int(self.begin[-1]), np.int64)
        for t, at in zip(texts, self.begin):
            codes[at : at + len(t)] = [code[w] for w in t]
        self.kept = np.flatnonzero((codes > 0) | np.append(True, codes[:-1] > 0))
        self.index = FMIndex(codes[self.kept], code.size)

    def occurrences(self, phrases: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all occurrences of ``phrases``, by position."""
        get = self.vocabulary.get
        known = [(k, c) for k, p in enumerate(phrases) if 0 not in (c := [get(w, 0) for w in p])]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.index.search(np.array([c for _, c in known], np.int64))
        many = high - low
        phrase = np.repeat(np.array([k for k, _ in known]), many)
        rows = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        at = self.kept[self.index.locate(rows)]
        order = np.argsort(at, kind="stable")
        return phrase[order], at[order]


def scan(items: Items, shard: Shard) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, last word, score) of every passage of an item in the shard's texts, the best where they overlap."""
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    need = np.array([surviving(len(t)) for t in items.texts])
    for q, phrases in items.phrases.items():
        phrase, at = shard.occurrences(phrases)
        uses = np.diff(items.at[q])[phrase]
        text = np.searchsorted(shard.begin, at, side="right") - 1
        total, start = np.cumsum(uses), 0
        while start < len(at):  # some whole texts at a time, so that an everyday phrase of many items is never spread out at once
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + MOST_HITS, side="right")))
            end = int(np.searchsorted(text, text[end - 1], side="right"))
            many = uses[start:end]
            use = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.at[q][phrase[start:end]], many)
            t, a = np.repeat(text[start:end], many), np.repeat(at[start:end], many)
            k, w = items.item[q][use], items.word[q][use]
            kept = _together(t, k, a - shard.begin[t], w, q, need)
            for t_, k_, a_ in zip(t[kept].tolist(), k[kept].tolist(), (a[kept] - shard.begin[t[kept]]).tolist()):
                places[t_].append((k_, a_, q))
            start = end
    wanted: list[tuple[int, int, int, int]] = []
    codes, gathered = {}, defaultdict(list)
    for t, hits in places.items():
        codes[t] = items.aligner.text(shard.texts[t])
        wanted += [(t, *x) for x in _stretches(items, len(shard.texts[t]), hits)]
        for k, at, _ in sorted(hits):
            gathered[t, k].append(at)
    done: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    while wanted:
        found = items.aligner.align([(k, codes[t][0][low:high], codes[t][1][low:high]) for t, k, low, high in wanted])
        aside = []
        for (t, k, low, high), (score, first, last, excess) in zip(wanted, found):
            if score and excess <= 0:
                done[t].append((items.ids[k], low + first, low + last, score))
            if score and last >= first:  # another passage of the item may lie beside this one
                hits = gathered[t, k]
                for a, b in ((low, low + first), (low + last + 1, high)):
                    if bisect_left(hits, b - PHRASE + 1) - bisect_left(hits, a) >= need[k]:
                        aside.append((t, k, a, b))
        wanted = aside
    return [(t, *x) for t, passages in done.items() for x in _best(passages)]


def _together(t: np.ndarray, k: np.ndarray, a: np.ndarray, w: np.ndarray, q: int, need: np.ndarray) -> np.ndarray:
    """The hits with another one of their item in their text that a passage could hold with it, or of items that need one only.

    Two phrases of a passage lie within its words in the item, and have shifted by no more than its edits.
    """
    alone = need[k] <= 1
    kept = alone.copy()
    d = a - w
    for half in (0, SHIFT):
        band = (d + half) // (2 * SHIFT)
        order = np.lexsort((w, band, k, t))
        x, y = order[:-1], order[1:]
        near = (t[x] == t[y]) & (k[x] == k[y]) & (band[x] == band[y]) & (w[y] - w[x] <= PASSAGE - q) & (w[y] > w[x])
        kept[x[near]] = kept[y[near]] = True
    return np.flatnonzero(kept)


def _stretches(items: Items, size: int, hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(item, first, end) of the stretches of a text of ``size`` words in which hits of an item gather, with room for the rest of a passage."""
    hits = sorted(set(hits))
    start = 0
    for i in range(1, len(hits) + 1):
        if i < len(hits) and hits[i][0] == hits[i - 1][0] and hits[i][1] - hits[i - 1][1] <= PASSAGE:
            continue
        k, a, q = hits[start]
        b = hits[i - 1][1] + q - 1
        start = i
        slack = len(items.texts[k]) // PASSAGE + 6
        low, high = max(0, a - PASSAGE - slack), min(size, b + 1 + PASSAGE + slack)
        for begin in range(low, high, 400):  # very long gatherings in overlapping pieces
            yield k, begin, min(high, begin + 400 + 2 * len(items.texts[k]))


def _best(passages: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, first, last, score) of passages that no better one of another item overlaps by half."""
    best: list[tuple[int, int, int, int]] = []
    for x in sorted(set(passages), key=lambda d: (-d[3], d)):
        item, first, last, score = x
        if not any(i != item and s > score and min(last, l2) - max(first, f2) >= 0.5 * (last - first) for i, f2, l2, s in best):
            best.append(x)
    return best


def _parts(items: DataFrame) -> tuple[list[str], bytes]:
    """The items in files of the shared folder, PART_ITEMS or so in each, ready for the search; and a bit for each of their words.

    What is an opening line is counted over all items before they are parted, so the parts change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([opening(t) for t in batch.column(1).to_pylist()], pa.string())], ["i", "t", "o"])

    spark = items.sparkSession
    read = checkpoint(items.mapInArrow(run, "i long, t string, o string"))
    often = read.filter("o <> ''").groupBy("o").agg(F.countDistinct("i").alias("n")).filter(F.col("n") >= OPENING).select("o", F.lit(True).alias("cut"))
    marked = checkpoint(read.join(often, "o", "left").select("i", "t", F.coalesce("cut", F.lit(False)).alias("cut")))
    paths, marks = [], bytearray(MARKS // 8)
    for part in range(parts := max(1, -(-marked.count() // PART_ITEMS))):
        rows = marked.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).toLocalIterator()
        paths.append(new_path(spark, "items"))
        some = prepare([(r.i, r.t, r.cut) for r in rows])
        for bit in {_bit(w) for t in some.texts for w in t}:
            marks[bit >> 3] |= 1 << (bit & 7)
        write_bytes(spark, paths[-1], pickle.dumps(some))
    return paths, bytes(marks)


@lru_cache(maxsize=1)
def _part(path: str) -> Items:
    where, inside = fs.FileSystem.from_uri(path)
    with where.open_input_stream(inside) as source:
        return pickle.loads(source.read())


def leaks(documents: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, last_word, score): every passage of an item in a document, in folded words.

    A passage is PASSAGE or more consecutive words of the item (all of a shorter item, without a shared opening line) with at
    most EDITS in PASSAGE of them replaced, added, dropped or broken. Case, accents, punctuation, spacing, markup, invisible
    characters and look-alike letters make no difference. Where several items fit a stretch of text, those that fit it best
    count, decided on the aligned words; an item that fits less well there is left out although it may be within the edits.

    Documents are folded and indexed once, shard by shard, whole texts only; the items are read by the tasks from the shared
    folder, PART_ITEMS at a time, and every part is searched for in the same index. Where the files of the documents give few
    partitions their texts are spread over more. Null or empty texts and null ids hold nothing; repeated documents come out
    once; empty tables give no rows.
    """
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").groupBy("i").agg(F.max("t").alias("t"))
    docs = spread(documents.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null"))
    names = ["doc_id", "item_id", "first_word", "last_word", "score"]
    paths, marks = _parts(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [words(t) for t in batch.column(1).to_pylist()]
            for shard in _shards(texts):
                index = Shard([texts[k] for k in shard], marks)
                found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
                for path in paths:
                    for t, *x in scan(_part(path), index):
                        found[t].append(tuple(x))
                yield _batch([(ids[shard[t]], *x) for t, some in found.items() for x in (_best(some) if len(paths) > 1 else some)], names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names)).distinct()


def _batch(rows: list[tuple[int, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, items): overlapping and touching passages of a document as one span."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("first_word", "last_word")
    before = F.max("last_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = found.withColumn("span", F.sum(F.when(F.col("first_word") <= before + 1, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.countDistinct("item_id").alias("items")).drop("span")
