"""Text of scanned pages repaired into continuous paragraphs.

Running titles and page numbers are what recurs at page edges of a file. Words are
counted over all pages, apart for pages that were read and pages that were
recognised. Skip-gram vectors with negative sampling are trained on the counts of the
frequent words; every word then gets its vector from those of its contexts. A rare word is linked to the frequent
neighbour it turns into by a plausible glyph edit, glyph pairs being plausible if
they are of a fixed kind (l for 1, rn for m) or bear many links; links are then
applied where the context agrees, the more readily the less sure the recognition of
the page was. A word is a run of Latin letters, or a pair of
neighbouring ideograms.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantora.functions.lookalikes import skeleton
from quantora.llm.leakage import edit_distance
from quantora.session import cut_lineage

#: Vectors are learned for at most so many words over so many contexts; other words get theirs from their contexts.
#: Links are searched to so many frequent words at once.
WORDS, CONTEXTS, DIMENSIONS = 8_000, 2_000, 48
#: Negative samples of each pair, passes over all counts, and the step of the training.
NEGATIVE, PASSES, STEP = 1.0, 12, 0.05
#: A word is frequent if trusted pages have it so often.
FREQUENT = 2
#: Least cosine of a link; distinct links that make a pair of glyphs plausible, and the least share they have of the links of the glyph's likeliest meaning.
NEAR, SUPPORT, SUPPORT_SHARE = 0.3, 3, 0.6
#: A glyph with links bears so many for each frequent word it is right in; a frequent word is so many times as common as what is linked to it.
KNOWN_SHARE, COMMONER, COMMONER_LATIN = 0.4, 2, 8
#: A running title stands on so many pages of a file at least, and on this share of them.
TITLE_PAGES, TITLE_SHARE = 2, 0.15
#: Links, frequent words and compounds that are sent to each task, each; with more the operator stops and says so.
MOST_LINKS = 500_000

# Marks that cut a word at a line's end.
CUT_MARKS = "-‐‑¬­"
SURE_CUTS = "¬­"
# Letters read for digits, and what recognition makes of letters in Latin words.
DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2", "g": "9", "q": "9"}
GLYPHS = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ii", "u"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("u", "v"), ("v", "u"), ("q", "g"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"), ("a", "o"), ("o", "a"), ("o", "c"), ("r", "n"), ("nn", "m"), ("m", "nn"), ("in", "m"), ("m", "in"), ("ni", "m"))
CHINESE = dict(zip("一二三四五六七八九", range(1, 10), strict=True))

_TOKEN = re.compile(r"[A-Za-zÀ-ɏ0-9]+|[㐀-鿿぀-ヿ]|[^\sA-Za-zÀ-ɏ0-9㐀-鿿぀-ヿ]")
_COMPOUND = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)+")
_IDEOGRAM = re.compile(r"[㐀-鿿぀-ヿ]")
_DIGITS = re.compile(r"[0-9]+")
_FIGURE_BEFORE, _FIGURE_BEHIND = re.compile(r"[0-9][.,]?$"), re.compile(r"[.,]?[0-9]")
_NUMERIC = re.compile(r"^(?=.*[0-9])[0-9OolIiSsBbZz]+$")
_BEHIND_TITLE = re.compile(r"(?:\s*\|\s*|\s{2,}|　+)([0-9OolISBbZ]{1,5})\s*$")
_HEADING = re.compile(r"^(?:[一二三四五六七八九十]+、|\d{1,2}\. [A-Z])")
_FIGURE_LINE = re.compile(r"^[0-9OolISsBbZz]{1,3}(?:\.[0-9OolISsBbZz]{1,2})?$")
_N = r"([0-9OolISsBbZz]{1,5})"
_PAGE_FORMS = [
    re.compile(p, re.I)
    for p in (
        rf"^[-—－–·\[(（【]?\s*{_N}\s*[-—－–·\])）】]?$",
        rf"^{_N}\s*[/／]\s*[0-9OolISsBbZz]{{1,5}}$",
        rf"^第\s*{_N}\s*[页贡]?(?:\s*[，,]?\s*共\s*[0-9OolISsBbZz]{{1,5}}\s*[页贡]?)?$",
        rf"^[Pp][a-z0-9]{{2,4}}\s+{_N}\s+[a-z0-9]{{2}}\s+[0-9OolISsBbZz]{{1,5}}$",
        rf"^[Pp]\s*\.\s*{_N}$",
        rf"^[Pp][a-z0-9]{{2,4}}\s+{_N}$",
    )
]
_CHINESE_PAGE = re.compile(r"^第\s*([一二三四五六七八九十百]{1,5})\s*[页贡]$")


def digits_of(text: str) -> str:
    """Letters that look like digits as digits."""
    return "".join(DIGIT_LIKE.get(ch, ch) for ch in text)


def chinese_number(text: str) -> int | None:
    """一 to 九百九十九 as an integer."""
    total, unit = 0, 0
    for ch in text:
        if ch in CHINESE:
            unit = CHINESE[ch]
        elif ch in "十百":
            total += (unit or 1) * (10 if ch == "十" else 100)
            unit = 0
        else:
            return None
    return total + unit or None


def page_number_of(line: str) -> int | None:
    """The number of a line that is nothing but a page number, else None."""
    bare = line.strip().strip("　")
    if not bare or len(bare) > 24:
        return None
    if m := _CHINESE_PAGE.match(bare):
        return chinese_number(m[1])
    for form in _PAGE_FORMS:
        if m := form.match(bare):
            number = digits_of(m[1])
            return int(number) if number.isdigit() else None
    return None


def title_of(line: str) -> tuple[str, int | None]:
    """A line without a page number set apart behind it, and that number."""
    if m := _BEHIND_TITLE.search(line):
        number = digits_of(m[1])
        return line[: m.start()].strip(), int(number) if number.isdigit() else None
    return line.strip(), None


def filled_lines(text: str) -> list[int]:
    """Indexes of the lines that are not blank."""
    return [i for i, line in enumerate(text.split("\n")) if line.strip()]


def edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The titles and page numbers that stand at the edges of pages."""
    for pdf in batches:
        rows = []
        for file_id, page, text in zip(pdf["file_id"], pdf["page_number"], pdf["text"], strict=True):
            if not text:
                continue
            lines, filled = text.split("\n"), filled_lines(text)
            top, bottom = filled[:2], [i for i in filled[-2:] if i not in filled[:2]]
            for i in top + bottom:
                number = page_number_of(lines[i])
                title, behind = title_of(lines[i])
                key = skeleton(title)
                if number is None and (len(key) < 2 or len(key) > 60 or title[-1:] in "。：:；;，,"):
                    key = None
                rows.append((file_id, page, None if number is not None else key, None if number is not None else title, number if number is not None else behind))
        yield pd.DataFrame(rows, columns=["file_id", "page_number", "key", "title", "number"])


@dataclass
class Furniture:
    """What recurs on the pages of a file: titles, most frequent first, and printed minus physical page number."""

    titles: list[str] = field(default_factory=list)
    offset: int | None = None


def title_match(line: str, titles: list[str]) -> tuple[bool, bool]:
    """(the line is a running title, it differs from the title by misread characters)."""
    title, _ = title_of(line)
    key = re.sub(r"\s", "", skeleton(title))
    for t in titles:
        own = re.sub(r"\s", "", skeleton(t))
        if key == own:
            return True, re.sub(r"\s", "", title) != re.sub(r"\s", "", t) and any(a != b and a.casefold() != b.casefold() for a, b in zip(title, t, strict=False))
        if abs(len(key) - len(own)) <= 3 and edit_distance(key, own) <= max(1, len(own) // 4):
            return True, True
    return False, False


def page_furniture(text: str, page: int, known: Furniture) -> dict[int, tuple[str, bool]]:
    """Line index -> (``header`` or ``page_number``, holds a misread character)."""
    lines, filled = text.split("\n"), filled_lines(text)
    found: dict[int, tuple[str, bool]] = {}
    numbered = False
    for side in (filled[:2], filled[::-1][:2]):
        for step, i in enumerate(side):
            if i in found:
                continue
            if step == 1 and side[0] not in found:
                break
            is_title, misread = title_match(lines[i], known.titles)
            number = page_number_of(lines[i])
            if number is not None and known.offset is not None and not numbered:
                odd = bool(re.search(r"(?<![A-Za-z])[OolISsBbZz](?=[0-9OolISsBbZz]*(?![A-Za-z]))", lines[i].replace("Page", "").replace("of", "").replace("p.", "")))
                if number == page + known.offset or odd and lines[i].strip() != str(number):
                    found[i] = ("page_number", odd)
                    numbered = True
                    continue
            if is_title and number is None:
                behind = _BEHIND_TITLE.search(lines[i])
                found[i] = ("header", misread or bool(behind and not behind[1].isdigit()))
    return found


def tokens_of(text: str) -> list[tuple[str, int]]:
    """Tokens with their places: Latin words and ideograms; digit runs are ``0``."""
    return [("0" if _DIGITS.fullmatch(m[0]) else m[0], m.start()) for m in _TOKEN.finditer(text)]


@dataclass
class Body:
    """A page's text without furniture, joined; ``line_at`` maps each place to its line, ``cuts`` are lines ended by a mark."""

    text: str
    line_at: list[int]
    cuts: dict[int, int]


def body_of(text: str, skip: set[int]) -> Body:
    """Lines joined as they are read: Latin words keep a space between lines, ideograms do not, paragraphs a newline."""
    out: list[str] = []
    line_at: list[int] = []
    cuts: dict[int, int] = {}
    previous = ""
    for i, line in enumerate(text.split("\n")):
        if i in skip:
            continue
        bare = line.strip()
        if not bare:
            gap = "\n"
        elif line.startswith(("　", "  ")) or _HEADING.match(bare) or _HEADING.match(previous) or page_number_of(bare) is not None or _FIGURE_LINE.match(bare) or _FIGURE_LINE.match(previous):
            gap = "\n"
        elif previous and _IDEOGRAM.match(previous[-1]) or _IDEOGRAM.match(bare[0]):
            gap = ""
        else:
            gap = " "
        if out and gap and not (gap == "\n" and out[-1] == "\n"):
            out.append(gap)
            line_at.append(i)
        out.extend(bare)
        line_at.extend([i] * len(bare))
        if bare and bare[-1] in CUT_MARKS and re.search(r"[A-Za-z][0-9]?$", bare[:-1]):
            cuts[i] = len(out) - 1
        if bare:
            previous = bare
    return Body("".join(out), line_at, cuts)


def is_ideogram(token: str) -> bool:
    """Whether a token (one character or a Latin run) is an ideogram or kana."""
    return "㐀" <= token <= "鿿" or "぀" <= token <= "ヿ"


def count_page(body: Body, words: Counter, pairs: Counter, compounds: Counter) -> None:
    """Add a page's words, (word, context) pairs and hyphenated compounds; words cut at a line's end are left out."""
    cut_places = sorted(body.cuts.values())
    start = 0
    for block in body.text.split("\n"):
        found = tokens_of(block)
        toks = ["^", *(t for t, _ in found), "$"]
        here = [is_ideogram(t) for t in toks]
        here[-1] = False
        own = [i for i, (a, b) in enumerate(zip(here, here[1:], strict=False)) if a or b and i and toks[i] != "^"]
        # An ideogram and its right neighbour are a word, as are any other token and the ideogram after it.
        two = [toks[i] + toks[i + 1] for i in own]
        words.update(two)
        pairs.update(zip(two, (toks[i - 1] for i in own), strict=True))
        pairs.update(zip(two, (toks[i + 2] if i + 2 < len(toks) else "$" for i in own), strict=True))
        latin = [i for i, t in enumerate(toks[1:-1], 1) if t != "0" and t[0].isalnum() and not here[i]]
        if latin:
            if cut_places:
                near = [q - start for q in cut_places if start <= q <= start + len(block)]
                if near:
                    place = [p for _, p in found]
                    latin = [i for i in latin if not any(place[i - 1] + len(toks[i]) <= q <= place[i - 1] + len(toks[i]) + 1 or place[i - 1] - 3 <= q < place[i - 1] for q in near)]
            low = [toks[i].lower() for i in latin]
            words.update(low)
            for step in (-2, -1, 1, 2):
                pairs.update(zip(low, (toks[min(max(i + step, 0), len(toks) - 1)].lower() for i in latin), strict=True))
            if "-" in block:
                for m in _COMPOUND.finditer(block):
                    if not any(m.start() + start <= q <= m.end() + start for q in cut_places):
                        compounds[m[0].lower()] += 1
        start += len(block) + 1


_COUNTED = "kind string, word string, context string, trusted bigint, recognised bigint"


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word, pair and compound counts of a batch of pages, apart for trusted and recognised pages."""
    for pdf in batches:
        counters = [(Counter(), Counter(), Counter()) for _ in range(2)]
        for text, page, trusted, titles, offset in zip(pdf["text"], pdf["page_number"], pdf["trusted"], pdf["titles"], pdf["offset"], strict=True):
            if not text:
                continue
            known = Furniture(list(titles) if titles is not None else [], None if pd.isna(offset) else int(offset))
            count_page(body_of(text, set(page_furniture(text, page, known))), *counters[0 if trusted else 1])
        rows = []
        for kind, read, recognised in zip(("word", "pair", "compound"), *counters, strict=True):
            for key in read.keys() | recognised.keys():
                word, context = key if kind == "pair" else (key, "")
                rows.append((kind, word, context, read.get(key, 0), recognised.get(key, 0)))
        yield pd.DataFrame(rows, columns=["kind", "word", "context", "trusted", "recognised"])


@dataclass
class Lexicon:
    """Frequent words with vectors, and the context side that gives rarer words theirs."""

    words: dict[str, int]
    contexts: dict[str, int]
    context_vectors: np.ndarray
    word_vectors: np.ndarray
    context_weight: np.ndarray
    total: float
    counts: dict[str, int] = field(default_factory=dict)
    by_first: dict[str, list[str]] = field(default_factory=dict)
    by_second: dict[str, list[str]] = field(default_factory=dict)

    def vector(self, contexts: list[str], counts: list[int]) -> np.ndarray:
        """A word's vector from its contexts: its positive PMI row times the context vectors."""
        at = [(self.contexts[c], n) for c, n in zip(contexts, counts, strict=True) if c in self.contexts]
        if not at:
            return np.zeros(self.context_vectors.shape[1], np.float32)
        index = np.array([i for i, _ in at])
        n = np.array([m for _, m in at], np.float64)
        pmi = np.log(n * self.total / (n.sum() * self.context_weight[index]))
        v = np.maximum(pmi, 0) @ self.context_vectors[index]
        size = np.linalg.norm(v)
        return (v / size if size else v).astype(np.float32)


def train_skip_grams(counts: np.ndarray, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """The contexts' vectors after training by skip-gram with negative sampling, from given vectors.

    Every pass takes the expected gradient over all counted pairs and their negative
    samples (instead of drawing them), by blocks of words, with one Adagrad rate per vector.
    """
    of_word, of_context = counts.sum(1, keepdims=True), counts.sum(0, keepdims=True)
    noise = NEGATIVE * of_context / max(float(of_context.sum()), 1.0)
    seen_words, seen_contexts = np.full((len(words), 1), 1e-6, np.float32), np.full((len(contexts), 1), 1e-6, np.float32)
    for _ in range(PASSES):
        toward = np.zeros_like(contexts)
        for a in range(0, len(counts), 1000):
            part = slice(a, a + 1000)
            p = 1 / (1 + np.exp(-np.clip(words[part] @ contexts.T, -30, 30)))
            pull = counts[part] * (1 - p) - of_word[part] * noise * p
            toward += pull.T @ words[part]
            step = pull @ contexts
            seen_words[part] += (step**2).mean(1, keepdims=True)
            words[part] += STEP * step / np.sqrt(seen_words[part])
        seen_contexts += (toward**2).mean(1, keepdims=True)
        contexts += STEP * toward / np.sqrt(seen_contexts)
    return contexts


def learn_vectors(frequent: dict[str, int], pairs: pd.DataFrame) -> Lexicon:
    """Vectors of the frequent words: skip-gram training that begins at the factors of the positive PMI matrix."""
    weight = pairs.groupby("context")["n"].sum().sort_values(ascending=False).head(CONTEXTS)
    contexts = {c: i for i, c in enumerate(weight.index)}
    words = {w: i for i, w in enumerate(frequent)}
    kept = pairs[pairs["context"].isin(contexts) & pairs["word"].isin(words)]
    matrix = np.zeros((max(1, len(words)), max(1, len(contexts))), np.float32)
    if len(kept):
        np.add.at(matrix, (kept["word"].map(words).to_numpy(), kept["context"].map(contexts).to_numpy()), kept["n"].to_numpy(np.float32))
    total = float(matrix.sum()) or 1.0
    rows, columns = matrix.sum(1, keepdims=True), matrix.sum(0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(matrix * total / (rows * columns))
    sppmi = np.where(np.isfinite(pmi), np.maximum(pmi, 0), 0).astype(np.float32)
    rank = min(DIMENSIONS, *sppmi.shape)
    rng = np.random.default_rng(7)
    sketch = sppmi @ rng.standard_normal((sppmi.shape[1], min(rank + 8, min(sppmi.shape)))).astype(np.float32)
    for _ in range(3):
        sketch, _ = np.linalg.qr(sppmi @ (sppmi.T @ sketch))
    _, s, vt = np.linalg.svd(sketch.T @ sppmi, full_matrices=False)
    s, vt = s[:rank], vt[:rank]
    root = np.sqrt(np.maximum(s, 1e-6))
    trained = train_skip_grams(matrix, (sppmi @ vt.T / root).astype(np.float32), (vt.T * root).astype(np.float32))
    # Each axis by its strength, so that the strongest ones do not decide every cosine.
    context_vectors = (trained / root**2).astype(np.float32)
    word_vectors = sppmi @ context_vectors
    size = np.linalg.norm(word_vectors, axis=1, keepdims=True)
    word_vectors = np.where(size > 0, word_vectors / np.maximum(size, 1e-9), 0).astype(np.float32)
    lexicon = Lexicon(words, contexts, context_vectors, word_vectors, np.maximum(columns.ravel(), 1.0), total)
    lexicon.by_first, lexicon.by_second = by_ideogram(words)
    return lexicon


def by_ideogram(words: dict[str, int]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The pairs with ideograms by their first and by their second character."""
    first, second = defaultdict(list), defaultdict(list)
    for w in words:
        if len(w) == 2 and (_IDEOGRAM.match(w[0]) or _IDEOGRAM.match(w[1])):
            first[w[0]].append(w)
            second[w[1]].append(w)
    return dict(first), dict(second)


def other_words(lexicon: Lexicon, counts: dict[str, int], vectors: list) -> Lexicon:
    """The lexicon with other frequent words, whose vectors come from their contexts."""
    words = {w: i for i, w in enumerate(counts)}
    first, second = by_ideogram(words)
    return replace(lexicon, words=words, word_vectors=np.array(vectors, np.float32), counts=counts, by_first=first, by_second=second)


def glyph_edits(word: str) -> set[str]:
    """The words that one or two plausible glyph edits make of a Latin word."""
    once = {word[:i] + b + word[i + len(a) :] for a, b in GLYPHS for i in range(len(word) - len(a) + 1) if word.startswith(a, i)}
    twice = set()
    if len(word) >= 6:
        twice = {w[:i] + b + w[i + len(a) :] for w in once for a, b in GLYPHS for i in range(len(w) - len(a) + 1) if w.startswith(a, i)}
    return once | twice


def candidates(word: str, lexicon: Lexicon) -> list[tuple[str, int, str, str]]:
    """(frequent word, place, glyph, glyph it should be) that a rare word may be."""
    if len(word) == 2 and (_IDEOGRAM.match(word[0]) or _IDEOGRAM.match(word[1])):
        out = [(w, 1, word[1], w[1]) for w in lexicon.by_first.get(word[0], ()) if w[1] != word[1]]
        return out + [(w, 0, word[0], w[0]) for w in lexicon.by_second.get(word[1], ()) if w[0] != word[0]]
    return [(w, -1, "", "") for w in glyph_edits(word) if w in lexicon.words]


_LINKED = "word string, frequent string, place int, glyph string, meant string, cosine double, n bigint"


def _link(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word, n, contexts in zip(pdf["word"], pdf["n"], pdf["contexts"], strict=True):
                found = candidates(word, lexicon)
                if not found:
                    continue
                v = lexicon.vector([c["context"] for c in contexts], [c["n"] for c in contexts])
                for w, place, glyph, meant in found:
                    if lexicon.counts[w] < n * (COMMONER if place >= 0 else COMMONER_LATIN):
                        continue
                    meant_v = lexicon.word_vectors[lexicon.words[w]]
                    # Without a known context on either side only the glyphs can tell.
                    cosine = float(v @ meant_v) if v.any() and meant_v.any() else None
                    if cosine is None or cosine >= NEAR:
                        rows.append((word, w, place, glyph, meant, cosine, n))
            yield pd.DataFrame(rows, columns=["word", "frequent", "place", "glyph", "meant", "cosine", "n"]).astype({"cosine": "Float64"})

    return run


def _vectors(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = [lexicon.vector([c["context"] for c in contexts], [c["n"] for c in contexts]).tolist() for contexts in pdf["contexts"]]
            yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "vector": vectors})

    return run


def _blocks(lexicon: Lexicon, others: DataFrame) -> Iterator[Lexicon]:
    """The lexicon, then the ``others`` (word, n, contexts) in blocks of WORDS words."""
    yield lexicon
    counts: dict[str, int] = {}
    vectors: list = []
    for r in cut_lineage(others.mapInPandas(_vectors(lexicon), "word string, n bigint, vector array<float>")).toLocalIterator():
        counts[r["word"]] = r["n"]
        vectors.append(r["vector"])
        if len(counts) == WORDS:
            yield other_words(lexicon, counts, vectors)
            counts, vectors = {}, []
    if counts:
        yield other_words(lexicon, counts, vectors)


@dataclass
class Corrections:
    """Links by rare word, the frequent words, and the hyphenated compounds."""

    links: dict[str, list[tuple[int, str, str, int]]]
    latin: dict[str, str]
    known: set[str]
    compounds: dict[str, int]
    #: The likeliest meaning of each glyph that bears links, and the characters of the frequent words.
    glyphs: dict[str, str] = field(default_factory=dict)
    characters: set[str] = field(default_factory=set)
    #: What gives the places of linked Latin words vectors, and the vectors of the frequent words they are linked to.
    lexicon: Lexicon | None = None
    vectors: dict[str, np.ndarray] = field(default_factory=dict)

    def agrees(self, word: str, around: list[str], doubt: float) -> bool:
        """Whether a place with the tokens ``around`` may hold a frequent Latin word; without known ones it may."""
        meant = self.vectors.get(word)
        if self.lexicon is None or meant is None:
            return True
        n = Counter(around)
        v = self.lexicon.vector(list(n), list(n.values()))
        return not v.any() or not meant.any() or float(v @ meant) >= NEAR * least_agreement(doubt)


def least_agreement(doubt: float) -> float:
    """What part of NEAR a context must agree by: half where recognition is in great doubt, more than all where it is sure."""
    return min(1.5, max(0.5, 1.5 - 3.0 * doubt))


def misread_places(body: Body, c: Corrections, doubt: float = 1 / 6) -> dict[int, tuple[str, int]]:
    """Place in the body -> (what should stand there, how many characters it replaces)."""
    out: dict[int, tuple[str, int]] = {}
    start = -1
    for block in body.text.split("\n"):
        start, offset = start + 1 + len(block), start + 1
        found = tokens_of(block)
        toks = ["", *(t for t, _ in found), ""]
        around = ["^", *toks[1:-1], "$"]
        for i, (t, p) in enumerate(found, 1):
            left, right = toks[i - 1], toks[i + 1]
            p += offset
            ideogram = is_ideogram(t)
            if not ideogram:
                if t == "0" or not t[0].isalnum():
                    continue
                low = t.lower()
                at = p - offset
                in_figure = _FIGURE_BEFORE.search(block[max(0, at - 2) : at]) or _FIGURE_BEHIND.match(block, at + len(t))
                if in_figure and low not in c.known and digits_of(t).isdigit():
                    out[p] = (digits_of(t), len(t))
                    continue
                around = ["^", *toks[1:-1], "$"]
                if low in c.latin and c.agrees(c.latin[low], [around[min(max(i + step, 0), len(around) - 1)].lower() for step in (-2, -1, 1, 2)], doubt):
                    out[p] = (c.latin[low], len(t))
                elif low not in c.known:
                    if _NUMERIC.match(t):
                        out[p] = (digits_of(t), len(t))
                    elif len(t) == 1 and t in DIGIT_LIKE:
                        out[p] = (DIGIT_LIKE[t], 1)
                    elif any(ch.isdigit() for ch in t) and any(ch.isalpha() for ch in t):
                        out[p] = (t, len(t))
                continue
            before, after = c.links.get(left + t), c.links.get(t + right)
            if before or after:
                votes: Counter = Counter()
                for links, place in ((before, 1), (after, 0)):
                    for at, glyph, meant, support in links or ():
                        if at == place and glyph == t:
                            votes[meant] += support
                seen_now = [w for w in (left + t if left else None, t + right if right else None) if w and w in c.known]
                for meant, _ in votes.most_common():
                    agrees = [w for w in (left + meant if left else None, meant + right if right else None) if w]
                    confirmed = sum(w in c.known for w in agrees)
                    if confirmed and (confirmed == len(agrees) and len(seen_now) < 2 or not seen_now):
                        out[p] = (meant, 1)
                        break
            if p not in out and t in c.glyphs and t not in c.characters:
                out[p] = (c.glyphs[t], 1)
    return out


def cut_words(body: Body, c: Corrections, following: str) -> dict[int, bool]:
    """Line index of each mark at a line's end -> whether the mark was put in to cut a word."""
    out = {}
    for line, at in body.cuts.items():
        mark = body.text[at]
        left = re.search(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*$", body.text[:at])
        right = re.match(r"\s*([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)", body.text[at + 1 :] or following)
        if mark in SURE_CUTS:
            out[line] = True
            continue
        a = left[0].lower() if left else ""
        b = right[1].lower() if right else ""
        whole, hyphened = a + b, f"{a}-{b}"
        n_whole = c.compounds.get(whole, 0) + (FREQUENT if whole in c.known else 0)
        n_hyphened = c.compounds.get(hyphened, 0)
        if n_hyphened or n_whole:
            out[line] = n_whole > n_hyphened or not n_hyphened
            continue
        fixed_a, fixed_b = c.latin.get(a, a), c.latin.get(b, b)
        own = f"{fixed_a}-{fixed_b}" in c.compounds or not b and any(k.startswith(a + "-") for k in c.compounds)
        near = not own and a in c.known and b and any(k.startswith(a + "-") and edit_distance(k[len(a) + 1 :], b) <= 2 for k in c.compounds)
        out[line] = not (own or near)
    return out


def page_findings(text: str, page: int, trusted: bool, known: Furniture, c: Corrections, following: str, before: str, doubt: float = 1 / 6) -> tuple[list[tuple[int, str]], Body, dict, dict]:
    """((line number, kind) of a page, its body, its misread places, its cuts)."""
    furniture = page_furniture(text, page, known)
    body = body_of(text, set(furniture))
    places = {} if trusted else misread_places(body, c, doubt)
    cuts = cut_words(body, c, following)
    rows = {(i + 1, kind) for i, (kind, _) in furniture.items()} | {(i + 1, "hyphen") for i, yes in cuts.items() if yes}
    if not trusted:
        joined_words(body, cuts, c, places, following, before)
        rows |= {(i + 1, "misread") for i, (_, odd) in furniture.items() if odd}
        rows |= {(body.line_at[p] + 1, "misread") for p in places}
        lines = text.split("\n")
        for i, (kind, odd) in furniture.items():
            if kind == "page_number" and not odd and re.search(r"(?i)p[a-z0-9]{2,4}\s", lines[i]) and not re.match(r"(?i)\s*page\s+\d+(\s+of\s+\d+)?\s*$", lines[i]):
                rows.add((i + 1, "misread"))
    return sorted(rows), body, places, cuts


def joined_words(body: Body, cuts: dict[int, bool], c: Corrections, places: dict, following: str, before: str) -> None:
    """Judge words cut at a line's end as wholes: drop what the halves alone made suspect, add misreads of the whole."""
    ends = [(at, cuts.get(line, False), line) for line, at in body.cuts.items()]
    for at, cut, _ in ends:
        left = re.search(r"[A-Za-z0-9]+$", body.text[:at])
        right = re.match(r"(\s*)([A-Za-z0-9]+)", body.text[at + 1 :])
        if not left:
            continue
        a, b = left[0], right[2] if right else (re.match(r"[A-Za-z0-9]*", following)[0])
        halves = [left.start()] + ([at + 1 + len(right[1])] if right else [])
        if not cut:
            continue
        for p in halves:
            places.pop(p, None)
        whole = (a + b).lower()
        if whole in c.known or whole not in c.latin:
            for p, half in zip(halves, (a, b), strict=False):
                if re.search(r"[0-9]", half) and re.search(r"[A-Za-z]", half):
                    places[p] = (half, len(half))
            continue
        meant = c.latin[whole]
        same = 0
        while same < min(len(whole), len(meant)) and whole[same] == meant[same]:
            same += 1
        if same < len(a):
            places[halves[0]] = (a, len(a))
        tail = 0
        while tail < min(len(whole), len(meant)) and whole[-1 - tail] == meant[-1 - tail]:
            tail += 1
        if right and (same >= len(a) or len(whole) - tail > len(a)):
            places[halves[1]] = (b, len(b))
    if before:
        head = re.match(r"[A-Za-z0-9]+", body.text)
        if head:
            places.pop(0, None)
            whole = (before + head[0]).lower()
            if whole in c.latin and not head[0].lower() == c.latin[whole][len(before) :]:
                places[0] = (head[0], len(head[0]))
            elif re.search(r"[0-9]", head[0]) and re.search(r"[A-Za-z]", head[0]):
                places[0] = (head[0], len(head[0]))


def _edges_of_body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first Latin run and the cut-off last one of each page's body."""
    for pdf in batches:
        rows = []
        for file_id, page, text, titles, offset in zip(pdf["file_id"], pdf["page_number"], pdf["text"], pdf["titles"], pdf["offset"], strict=True):
            known = Furniture(list(titles) if titles is not None else [], None if pd.isna(offset) else int(offset))
            body = body_of(text, set(page_furniture(text, page, known)))
            stripped = body.text.strip()
            head = re.match(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*", stripped)
            tail = re.search(rf"([A-Za-z0-9]+)[{CUT_MARKS}]$", stripped)
            rows.append((file_id, page, head[0] if head else "", tail[1] if tail else ""))
        yield pd.DataFrame(rows, columns=["file_id", "page_number", "head", "tail"])


def _usable(pages: DataFrame) -> DataFrame:
    usable = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("file_id").cast("bigint"), -F.col("page_id").cast("bigint")).alias("file_id"),
        F.coalesce(F.col("page_number").cast("int"), F.lit(0)).alias("page_number"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.coalesce(F.col("status"), F.lit("")) == "native_text").alias("trusted"),
        # Without a confidence a page is in the doubt at which contexts must just agree.
        F.coalesce(1 - (F.col("confidence") if "confidence" in pages.columns else F.lit(None)).cast("double"), F.lit(1 / 6)).alias("doubt"),
    )
    return usable.filter(F.col("page_id").isNotNull() & F.col("text").rlike("\\S"))


def furniture_of_files(pages: DataFrame) -> DataFrame:
    """file_id, titles (most frequent first), offset: what recurs at the page edges of each file."""
    edges = cut_lineage(pages.mapInPandas(edge_rows, "file_id bigint, page_number int, key string, title string, number int"))
    sizes = pages.groupBy("file_id").agg(F.count_distinct("page_number").alias("_pages"))
    titled = edges.filter(F.col("key").isNotNull()).groupBy("file_id", "key", "title").agg(F.count_distinct("page_number").alias("_n"))
    titled = titled.groupBy("file_id", "key").agg(F.sum("_n").alias("_n"), F.max_by("title", F.struct("_n", "title")).alias("title"))
    running = titled.join(sizes, "file_id").filter((F.col("_n") >= TITLE_PAGES) & (F.col("_n") >= TITLE_SHARE * F.col("_pages")))
    titles = running.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "title")), asc=False), lambda t: t["title"]).alias("titles"))
    shifts = edges.filter(F.col("number").isNotNull()).groupBy("file_id", (F.col("number") - F.col("page_number")).alias("offset")).agg(F.count_distinct("page_number").alias("_n"))
    offset = shifts.filter(F.col("_n") >= 2).groupBy("file_id").agg(F.max_by("offset", F.struct("_n", F.col("offset"))).alias("offset"))
    return sizes.select("file_id").join(titles, "file_id", "left").join(offset, "file_id", "left")


def learn_corrections(pages: DataFrame) -> Corrections:
    """Count all pages' words, learn vectors, link rare words, and keep the links with plausible glyphs."""
    counted = cut_lineage(pages.mapInPandas(count_words, _COUNTED).groupBy("kind", "word", "context").agg(F.sum("trusted").alias("trusted"), F.sum("recognised").alias("recognised")))
    words = counted.filter("kind = 'word'")
    trusted = words.filter(F.col("trusted") >= FREQUENT)
    if trusted.isEmpty():  # nothing was read without recognition: the often recognised stand in for it
        trusted = words.filter(F.col("recognised") >= 5 * FREQUENT).withColumn("trusted", F.col("recognised"))
    trusted = cut_lineage(trusted.select("word", "trusted"))
    frequent = {r["word"]: r["trusted"] for r in trusted.orderBy(F.desc("trusted"), "word").limit(WORDS).collect()}
    spark = pages.sparkSession
    own = F.broadcast(spark.createDataFrame([(w,) for w in frequent], "word string"))  # at most WORDS rows
    context_sums = counted.filter("kind = 'pair'").groupBy("context").agg(F.sum(F.col("trusted") + F.col("recognised")).alias("_n"))
    best = F.broadcast(context_sums.orderBy(F.desc("_n"), "context").limit(CONTEXTS).select("context"))
    pairs = counted.filter("kind = 'pair'").join(best, "context")
    training = pairs.join(own, "word").select("word", "context", (F.col("trusted") + F.col("recognised")).alias("n")).toPandas()
    lexicon = learn_vectors(frequent, training)
    lexicon.counts = {r["word"]: r["n"] for r in words.join(own, "word").select("word", (F.col("trusted") + F.col("recognised")).alias("n")).collect()}  # at most WORDS rows
    rare = words.join(trusted.select("word"), "word", "left_anti").filter(F.col("recognised") > 0).select("word", F.col("recognised").alias("n"))
    seen = pairs.groupBy("word").agg(F.collect_list(F.struct("context", (F.col("trusted") + F.col("recognised")).alias("n"))).alias("contexts"))
    in_context = lambda some: some.join(seen, "word", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<struct<context:string,n:bigint>>")))
    suspects = in_context(rare)
    if trusted.count() > len(frequent):
        suspects = cut_lineage(suspects)
        others = words.join(trusted.select("word"), "word", "left_semi").join(own, "word", "left_anti").select("word", (F.col("trusted") + F.col("recognised")).alias("n"))
        blocks = _blocks(lexicon, in_context(others))
    else:
        blocks = iter([lexicon])
    linked = None
    vectors: dict[str, np.ndarray] = {}
    for block in blocks:
        part = cut_lineage(suspects.mapInPandas(_link(block), _LINKED))
        linked = part if linked is None else linked.unionByName(part)
        targets = part.filter(F.col("place") < 0).select("frequent").distinct()
        vectors |= {r["frequent"]: block.word_vectors[block.words[r["frequent"]]] for r in targets.collect()}  # at most WORDS rows
    ideograms = linked.filter(F.col("place") >= 0)
    support = ideograms.filter(F.col("cosine").isNotNull()).groupBy("glyph", "meant").agg(F.count_distinct("word").alias("_links"))
    of_glyph = support.groupBy("glyph").agg(F.max("_links").alias("_all"))
    of_known = trusted.select(F.explode(F.array_distinct(F.split("word", ""))).alias("glyph")).groupBy("glyph").agg(F.count("*").alias("_known"))
    digit_like = F.col("glyph").isin(*DIGIT_LIKE) & (F.col("meant") == "0")
    enough = (F.col("_links") >= SUPPORT) & (F.col("_links") >= SUPPORT_SHARE * F.col("_all")) & (F.col("_links") >= KNOWN_SHARE * F.coalesce("_known", F.lit(0)))
    plausible = support.join(of_glyph, "glyph").join(of_known, "glyph", "left").filter(digit_like | enough)
    kept = ideograms.join(plausible.select("glyph", "meant", "_links"), ["glyph", "meant"]).select("word", "frequent", "place", "glyph", "meant", "_links")
    latin = linked.filter(F.col("place") < 0).groupBy("word").agg(F.max_by("frequent", F.struct("cosine", "frequent")).alias("frequent"))
    links: dict[str, list] = defaultdict(list)
    if (n := kept.count() + latin.count()) > MOST_LINKS:
        raise ValueError(f"{n} links exceed MOST_LINKS; raise it to the memory of the tasks")
    for r in kept.collect():
        links[r["word"]].append((r["place"], r["glyph"], r["meant"], r["_links"]))
    hyphened = counted.filter("kind = 'compound'").select("word", (F.col("trusted") + F.col("recognised")).alias("n")).filter("n >= 2")
    compounds = {r["word"]: r["n"] for r in hyphened.limit(MOST_LINKS + 1).collect()}
    if len(compounds) > MOST_LINKS:
        raise ValueError("hyphenated compounds exceed MOST_LINKS; raise it to the memory of the tasks")
    likeliest: dict[str, tuple[int, str]] = {}
    signs: set[str] = set()
    for found in links.values():
        for _, glyph, meant, support in found:
            likeliest[glyph] = max(likeliest.get(glyph, (0, "")), (support, meant))
            signs |= {glyph, meant}
    glyphs = {g: m for g, (_, m) in likeliest.items() if _IDEOGRAM.match(g)}
    # Of the frequent words a page needs the Latin ones, and those with a glyph that links are about.
    relevant = F.col("word").rlike("^[A-Za-z0-9À-ɏ]+$")
    if signs:
        relevant = relevant | F.col("word").rlike("[" + "".join(sorted(map(re.escape, signs))) + "]")
    needed = trusted.filter(relevant)
    if (n := needed.count()) > MOST_LINKS:
        raise ValueError(f"{n} frequent words exceed MOST_LINKS; raise it to the memory of the tasks")
    known = {r["word"] for r in needed.select("word").collect()}
    characters = {ch for w in known for ch in w}
    fixed = {r["word"]: r["frequent"] for r in latin.collect()}
    contexts_only = replace(lexicon, words={}, word_vectors=lexicon.word_vectors[:0], counts={}, by_first={}, by_second={})
    return Corrections(dict(links), fixed, known, compounds, glyphs, characters, contexts_only, {w: vectors[w] for w in set(fixed.values())})


_FINDINGS = "page_id bigint, line_no int, kind string"


def _prepared(pages: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The usable pages with what their task needs, and the corrections (bounded by MOST_LINKS), broadcast."""
    usable = _usable(pages)
    known = cut_lineage(furniture_of_files(usable))
    placed = usable.join(known, "file_id", "left")
    corrections = learn_corrections(placed)
    # Only Latin words are cut at the end of a line.
    latin = placed.filter(F.col("text").rlike("[A-Za-z]{2}"))
    edges = cut_lineage(latin.mapInPandas(_edges_of_body, "file_id bigint, page_number int, head string, tail string").groupBy("file_id", "page_number").agg(F.min("head").alias("head"), F.min("tail").alias("tail")))
    after = edges.select("file_id", (F.col("page_number") - 1).alias("page_number"), F.col("head").alias("following"))
    before = edges.select("file_id", (F.col("page_number") + 1).alias("page_number"), F.col("tail").alias("before"))
    held = pages.sparkSession.sparkContext.broadcast(corrections)
    return placed.join(after, ["file_id", "page_number"], "left").join(before, ["file_id", "page_number"], "left"), held


def _each_page(pdf: pd.DataFrame, c: Corrections):
    for row in pdf.itertuples(index=False):
        known = Furniture(list(row.titles) if row.titles is not None else [], None if pd.isna(row.offset) else int(row.offset))
        following = row.following if isinstance(row.following, str) else ""
        before = row.before if isinstance(row.before, str) else ""
        yield row, page_findings(row.text, row.page_number, bool(row.trusted), known, c, following, before, row.doubt)


def scan_noise(pages: DataFrame) -> DataFrame:
    """page_id, line_no and kind (header, page_number, hyphen, misread) of every noisy line.

    Defined cases: pages without id or text have no lines; a null file_id makes a page
    a file of its own; pages extracted twice are judged each and count once for their
    file; lines are counted from 1 with empty ones; texts of any length are read
    whole; other columns are not read; an empty table gives no rows.
    """
    placed, held = _prepared(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(row.page_id, line, kind) for row, (found, *_) in _each_page(pdf, held.value) for line, kind in found]
            yield pd.DataFrame(rows, columns=["page_id", "line_no", "kind"])

    return placed.mapInPandas(run, _FINDINGS)


def repaired_blocks(body: Body, places: dict[int, tuple[str, int]], cuts: dict[int, bool]) -> list[str]:
    """The paragraphs of a page: misread characters corrected, cut words joined."""
    out = list(body.text)
    for p, (meant, n) in sorted(places.items(), reverse=True):
        out[p : p + n] = [meant] + [""] * (n - 1)
    for line, yes in cuts.items():
        at = body.cuts[line]
        if yes:
            out[at] = ""
        if at + 1 < len(out) and out[at + 1] == " ":
            out[at + 1] = ""
    return [b.strip() for b in "".join(out).split("\n") if b.strip()]


def paragraphs(pages: DataFrame) -> DataFrame:
    """file_id, paragraph_no, first_page, text: the continuous paragraphs of each file.

    A paragraph that a page ends without a full stop goes on with the next page's
    first one. Pages extracted twice count once (the smaller page_id). Paragraph
    numbers come from sums over pages, and a paragraph is put together from its own
    parts only, so no file is gathered in one place.
    """
    placed, held = _prepared(pages)
    first = F.row_number().over(Window.partitionBy("file_id", "page_number").orderBy("page_id"))
    single = placed.withColumn("_first", first).filter("_first = 1").drop("_first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row, (_, body, places, cuts) in _each_page(pdf, held.value):
                blocks = repaired_blocks(body, places, cuts)
                for k, block in enumerate(blocks):
                    glue = bool(cuts.get(max(body.cuts, default=-1), False)) and k == len(blocks) - 1 and body.text.rstrip()[-1:] in CUT_MARKS
                    rows.append((row.file_id, row.page_number, k, len(blocks), block, not re.search(r"[。！？.!?:：]$", block) and not _HEADING.match(block), glue))
            yield pd.DataFrame(rows, columns=["file_id", "page_number", "k", "blocks", "text", "open", "glue"])

    parts = cut_lineage(single.mapInPandas(run, "file_id bigint, page_number int, k int, blocks int, text string, open boolean, glue boolean"))
    per_page = parts.groupBy("file_id", "page_number").agg(F.max("blocks").alias("blocks"), F.max_by("open", "k").alias("ends_open"), F.max_by("glue", "k").alias("ends_cut"), F.min_by("text", "k").alias("head"))
    of_file = Window.partitionBy("file_id").orderBy("page_number")  # one short row per page
    goes_on = F.coalesce(F.lag("ends_open").over(of_file), F.lit(False)) & ~F.col("head").rlike("^(?:[一二三四五六七八九十]+、|[0-9]{1,2}\\. [A-Z])")
    started = F.col("blocks") - F.when(F.col("goes_on"), 1).otherwise(0)
    numbered = per_page.withColumn("goes_on", goes_on).withColumn("before", F.coalesce(F.sum(started).over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed_parts = parts.join(numbered.select("file_id", "page_number", "goes_on", "before"), ["file_id", "page_number"])
    number = F.col("before") + F.col("k") + F.when(F.col("goes_on"), 0).otherwise(1)
    pieces = placed_parts.select("file_id", number.cast("int").alias("paragraph_no"), "page_number", "k", "text", "glue")
    joined = pieces.groupBy("file_id", "paragraph_no").agg(F.min("page_number").alias("first_page"), F.sort_array(F.collect_list(F.struct("page_number", "k", "text", "glue"))).alias("p"))
    latin_border = lambda acc, x: acc["t"].rlike("[A-Za-z0-9,;.]$") & x["text"].rlike("^[A-Za-z0-9(]")
    whole = F.aggregate(
        "p",
        F.struct(F.lit("").alias("t"), F.lit(True).alias("g")),
        lambda acc, x: F.struct(F.concat(acc["t"], F.when(~acc["g"] & latin_border(acc, x), F.lit(" ")).otherwise(F.lit("")), x["text"]).alias("t"), x["glue"].alias("g")),
    )
    return joined.select("file_id", "paragraph_no", "first_page", whole["t"].alias("text"))
