"""Documents that contain held-out texts, wholly or in good part.

Held-out items and documents are compared in letters and digits only. Windows of both
are embedded by random walks (CGK: each step emits the symbol under the pointer and
moves on if a random bit of step and symbol says so, which turns edits into few
differing symbols), and sampled symbols of the walk are the bucket of a window. Equal
windows share every walk, so one walk reaches all of them: item windows start at every
offset and document windows at a stride such that every run of half an item holds a
whole document window. Colliding windows are compared on the texts and grown to the
whole run.

For copies with edits all over, down to similarity 0.8, walks of item-sized windows
would have to be repeated tens to hundreds of times (figures in the README), so they are
found by counting grams: a copy within k edits of an item of m characters shares at
least m - q + 1 - k * q of its q-grams, at shifts that differ by no more than k, so
shifts of a document with fewer hold none. Both searches are complete, and what passes
is verified by the exact edit distance.

The item side is an index of bounded size, broadcast block by block; documents are
read once per block of items and never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantora.session import cut_lineage

#: Share of an item that must stand in one run; edited copies are reported from this similarity on.
RUN_SHARE, EDIT_SIMILARITY = 0.5, 0.8
#: Characters of the items that one index may hold; more items are taken in further blocks.
BLOCK_CHARS = 2_000_000
#: Windows hashed, characters of documents laid end to end, and gram counts held, at once.
CHUNK, FLAT_CHARS, CELLS = 200_000, 1 << 22, 1 << 22
#: Items whose lengths differ by no more than this factor are counted over cells of one size.
CLASS_FACTOR = 1.3
#: Cells that the shifts of a copy span in its length class; they touch one more.
PARTS = 3

_NOT_ALNUM = re.compile(r"[\W_]+")


def letters_and_digits(text: str) -> str:
    """The text's letters and digits, of one width and case."""
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


@dataclass(frozen=True)
class Windows:
    """One length class of the run search: window and stride of the documents, and the items' windows by bucket."""

    window: int
    stride: int
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray


_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Symbols of a walk that make up the bucket of a window, and the seed of the walks.
SAMPLED, WALK = 16, 20_260
_SHIFT, _TOP = np.uint64(31), np.uint64(63)


def buckets(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The bucket of each window of ``text`` that begins at ``starts``: sampled symbols of its CGK walk, hashed.

    All windows take the same walk, so equal ones are in one bucket, and similar ones
    are as often as their walks agree at the sampled steps.
    """
    steps = window + window // 2
    rng = np.random.default_rng((WALK, window))
    coins = rng.integers(1, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sampled = np.zeros(steps, bool)
    sampled[rng.choice(steps, min(SAMPLED, steps), replace=False)] = True
    last = int(np.flatnonzero(sampled)[-1])
    at, ends, whole = starts.copy(), starts + window, np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(last + 1):
            symbol = np.where(at < ends, text[at], 0) if step >= window else text[at]
            if sampled[step]:
                whole = (whole ^ symbol) * _MIX
                whole ^= whole >> _SHIFT
            at += ((symbol * coins[step]) >> _TOP).view(np.int64)
    return whole


def most_edits(size: int) -> int:
    """Edits that a copy of an item of so many characters may have."""
    return int((1 - EDIT_SIMILARITY) * size + 1e-9)


def gram_size(size: int) -> tuple[int, int]:
    """(q, q-grams of an item of so many characters that a copy keeps at least)."""
    kept = [(q, size - q + 1 - most_edits(size) * q) for q in (3, 2)]
    return next((x for x in kept if x[1] >= 2), kept[-1])


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each place of ``text``, q being 2 or 3, packed into one number."""
    out = text[: max(0, len(text) - q + 1)].copy()
    for j in range(1, q):
        out = out << np.uint64(21) | text[j : len(text) - q + 1 + j]
    return out


@dataclass(frozen=True)
class Grams:
    """One length class of the edited copies: its items, and the items that have each gram (once per occurrence).

    Shifts are counted in cells of ``cell``; ``longest`` is the longest item.
    """

    q: int
    cell: int
    longest: int
    items: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    offset: np.ndarray

    def candidates(self, own: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, first and last shift) of the stretches of shifts with grams enough; ``own`` are grams at the ascending places ``place``."""
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        hit = self.keys[at] == own
        at, place = at[hit], place[hit]
        many, step = len(self.items), max(PARTS, CELLS // len(self.items))
        for a in range(-self.longest // self.cell, int(place[-1]) // self.cell + 1 if len(place) else 0, step):
            low, high = np.searchsorted(place, (a * self.cell, (a + step + PARTS) * self.cell + self.longest))
            part = at[low:high]
            size = self.first[part + 1] - self.first[part]
            entry = np.repeat(self.first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = (np.repeat(place[low:high], size) - self.offset[entry]) // self.cell - a
            inside = (cell >= 0) & (cell < step + PARTS)
            key = self.owner[entry[inside]] * (step + PARTS) + cell[inside]
            counts = np.bincount(key, minlength=(step + PARTS) * many).reshape(many, -1)
            near = sum(counts[:, j : j + step] for j in range(PARTS + 1))
            which, found = np.nonzero(near >= self.least[:, None])
            begins = np.r_[True, (np.diff(found) != 1) | (np.diff(which) != 0)][: len(found)]
            ends = np.r_[begins[1:], True][: len(found)]
            yield which[begins], (found[begins] + a) * self.cell, (found[ends] + a + PARTS + 1) * self.cell - 1


def padded(text: str, by: int) -> np.ndarray:
    """Code points of a text, followed by zeros."""
    return np.append(codes(text), np.zeros(by + 1, np.uint32)).astype(np.uint64)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = mask, 0, len(a)
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & last) - bool(mh & last)
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return score


def nearest_distance(item: str, text: str) -> int:
    """Least Levenshtein distance of an item to any stretch of a text (Myers)."""
    peq: dict[str, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | 1 << i
    mask, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    pv, mv = mask, 0
    score = least = len(item)
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
            least = min(least, score)
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return least


def run_around(doc: str, item: str, p: int, o: int, size: int) -> int:
    """Length of the common run that holds the equal windows ``doc[p:p+size]`` and ``item[o:o+size]``."""
    left = 0
    while left < p and left < o and doc[p - left - 1] == item[o - left - 1]:
        left += 1
    i, j = p + size, o + size
    while i < len(doc) and j < len(item) and doc[i] == item[j]:
        i, j = i + 1, j + 1
    return left + j - o


class ItemIndex:
    """The windows and grams of a block of items, by length class."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if t]
        by_class: dict[int, list[int]] = {}
        for n, (_, text) in enumerate(self.items):
            need = max(1, -(-len(text) // 2))
            by_class.setdefault(1 << (need.bit_length() - 1), []).append(n)
        self.windows = [self._windows(by_class[least]) for least in sorted(by_class)]
        self.longest_window = max((w.window for w in self.windows), default=0)
        by_size = sorted((n for n, (_, t) in enumerate(self.items) if most_edits(len(t))), key=lambda n: len(self.items[n][1]))
        self.grams: list[Grams] = []
        a = 0
        for b in range(1, len(by_size) + 1):
            size = len(self.items[by_size[a]][1])
            if b == len(by_size) or len(self.items[by_size[b]][1]) > size * CLASS_FACTOR or gram_size(len(self.items[by_size[b]][1]))[0] != gram_size(size)[0]:
                self.grams.append(self._grams(by_size[a:b]))
                a = b

    def _windows(self, members: list[int]) -> Windows:
        least_run = min(-(-len(self.items[n][1]) // 2) for n in members)
        window = max(1, (least_run * 5) // 8)
        starts = [np.arange(len(self.items[n][1]) - window + 1) for n in members]
        keys = np.concatenate([buckets(padded(self.items[n][1], window), at, window) for n, at in zip(members, starts, strict=True)])
        order = np.argsort(keys, kind="stable")
        owner = np.repeat(np.array(members), [len(at) for at in starts])
        return Windows(window, least_run - window + 1, keys[order], owner[order], np.concatenate(starts)[order])

    def _grams(self, members: list[int]) -> Grams:
        sizes = [len(self.items[n][1]) for n in members]
        q = gram_size(sizes[0])[0]
        own = [grams(codes(self.items[n][1]).astype(np.uint64), q) for n in members]
        flat, owner = np.concatenate(own), np.repeat(np.arange(len(members)), [len(g) for g in own])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        least = np.array([gram_size(n)[1] for n in sizes])
        offset = np.concatenate([np.arange(len(g)) for g in own])
        return Grams(q, -(-most_edits(max(sizes)) // PARTS), max(sizes), np.array(members), least, keys, np.append(first, len(flat)), owner[order], offset[order])

    def collisions(self, text: np.ndarray, starts_of) -> Iterator[tuple[Windows, np.ndarray, np.ndarray, np.ndarray]]:
        """(length class, document positions, items, offsets) of all windows in one bucket, by chunk."""
        for w in self.windows:
            starts = starts_of(w)
            for a in range(0, len(starts), CHUNK):
                part = starts[a : a + CHUNK]
                own = buckets(text, part, w.window)
                low = np.searchsorted(w.keys, own, "left")
                found = np.flatnonzero(low < len(w.keys))
                found = found[w.keys[low[found]] == own[found]]
                if not len(found):
                    continue
                counts = np.searchsorted(w.keys, own[found], "right") - low[found]
                rows = np.repeat(found, counts)
                entry = np.repeat(low[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                yield w, part[rows], w.item[entry], w.offset[entry]


def _distinct_rows(rows: np.ndarray, columns: int) -> np.ndarray:
    """The first row, in sorted order, of each combination of the leading columns."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.r_[True, (rows[1:, :columns] != rows[:-1, :columns]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    return rows[new]


def scan_batch(index: ItemIndex, texts: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
    """(text number, item number) -> (longest run, least edit distance found) of the verified pairs of a batch."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    first, size = 0, 0
    flat: list[str] = []
    for n, t in enumerate(texts):
        flat.append(letters_and_digits(t) if t else "")
        size += len(flat[-1])
        if size >= FLAT_CHARS or n == len(texts) - 1:
            best |= {(d + first, i): v for (d, i), v in _scan_flat(index, flat).items()}
            first, size, flat = n + 1, 0, []
    return best


def _scan_flat(index: ItemIndex, flat: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
    """As :func:`scan_batch`, of texts of letters and digits, which are laid end to end and hashed together."""
    lengths = np.array([len(t) for t in flat], np.int64)
    ends = np.cumsum(lengths)
    bases = ends - lengths
    whole = padded("".join(flat), max(2, index.longest_window))

    def starts_of(w: Windows) -> np.ndarray:
        counts = np.maximum(0, (lengths - w.window) // w.stride + 1)
        counts[lengths < w.window] = 0
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(bases, counts) + within * w.stride

    exact: list[np.ndarray] = []
    for w, at, item, offset in index.collisions(whole, starts_of):
        doc = np.searchsorted(ends, at, "right")
        exact.append(np.stack([doc, item, at - bases[doc], offset, np.full(len(at), w.window)], axis=1))

    best: dict[tuple[int, int], tuple[int, int]] = {}
    seen: set[tuple[int, int, int]] = set()

    def note(d: int, n: int, run: int, shift: int) -> None:
        text = index.items[n][1]
        distance = edit_distance(text, flat[d][max(0, shift) : max(0, shift + len(text))])
        old = best.get((d, n), (0, len(text)))
        best[d, n] = (max(old[0], run), min(old[1], distance))

    for d, n, p, o, size in _distinct_rows(np.concatenate(exact), 5).tolist() if exact else ():
        text = index.items[n][1]
        if flat[d][p : p + size] != text[o : o + size]:
            continue
        run = run_around(flat[d], text, p, o, size)
        if (d, n, p - o) in seen and run <= best[d, n][0]:
            continue
        seen.add((d, n, p - o))
        note(d, n, run, p - o)
    owner = np.repeat(np.arange(len(flat)), lengths)
    packed = {g.q: grams(whole, g.q)[: len(owner)] for g in index.grams}
    for g in index.grams:
        # Documents lie so far apart that no shift belongs to two.
        room = 2 * g.longest + (PARTS + 1) * g.cell
        firsts = bases + np.arange(len(flat)) * room
        for which, low, high in g.candidates(packed[g.q], np.arange(len(owner)) + owner * room):
            doc = np.maximum(0, np.searchsorted(firsts, high + g.longest, "right") - 1)
            for d, n, a, b in zip(doc.tolist(), g.items[which].tolist(), (low - firsts[doc]).tolist(), (high - firsts[doc]).tolist(), strict=True):
                text = index.items[n][1]
                old, k = best.get((d, n), (0, len(text))), most_edits(len(text))
                if old[1]:
                    distance = nearest_distance(text, flat[d][max(0, a - k) : max(0, b + len(text) + 2 * k)])
                    if (d, n) in best or distance <= k:
                        best[d, n] = (old[0], min(old[1], distance))
    return best


_FOUND = "doc_id bigint, item_id bigint, run_chars int, item_chars int, edit_distance int"


def _scan(held: Broadcast):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held.value
        for pdf in batches:
            best = scan_batch(index, pdf["text"].tolist())
            ids = pdf["doc_id"].tolist()
            rows = [(ids[d], index.items[n][0], run_, len(index.items[n][1]), e) for (d, n), (run_, e) in best.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_chars", "item_chars", "edit_distance"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of at most BLOCK_CHARS characters (or one longer item)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        text = letters_and_digits(row.text or "")
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, run_share: float = RUN_SHARE) -> DataFrame:
    """Pairs of a document and a held-out item that it contains in good part.

    Columns: doc_id, item_id, run_chars (longest common unbroken run found),
    item_chars (both in letters and digits), run_share, edit_similarity (of the item
    and the nearest place found; from EDIT_SIMILARITY on the nearest of all) and ``form``: ``whole``, ``part`` (a run of at
    least ``run_share`` of the item) or ``edited`` (no such run, but an edit
    similarity of EDIT_SIMILARITY or more).

    Defined cases: null and empty texts, and texts without letters and digits,
    contain nothing and are contained nowhere; rows without an id are left out;
    items with equal texts are reported each; repeated rows give one result row;
    documents of any length are read whole; other columns are not read; empty tables
    give no rows.
    """
    if not RUN_SHARE <= run_share <= 1:
        raise ValueError(f"run_share must be between {RUN_SHARE} and 1")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    found = None
    for block in _blocks(held):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block))  # at most BLOCK_CHARS characters
        part = docs.mapInPandas(_scan(index), _FOUND)
        # One block is the usual case and stays lazy; of more, only one is held by the driver at a time.
        part = part if found is None else cut_lineage(part)
        found = part if found is None else cut_lineage(found).unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND)
    best = found.groupBy("doc_id", "item_id").agg(F.max("run_chars").alias("run_chars"), F.max("item_chars").alias("item_chars"), F.min("edit_distance").alias("edit_distance"))
    share = F.col("run_chars") / F.col("item_chars")
    similarity = F.lit(1.0) - F.col("edit_distance") / F.col("item_chars")
    form = F.when(share >= 1, "whole").when(share >= run_share, "part").when(similarity >= EDIT_SIMILARITY, "edited")
    return best.select(
        "doc_id",
        "item_id",
        "run_chars",
        "item_chars",
        F.round(share, 4).alias("run_share"),
        F.round(F.greatest(similarity, F.lit(0.0)), 4).alias("edit_similarity"),
        form.alias("form"),
    ).filter(F.col("form").isNotNull())
