"""Evaluation texts inside corpus documents: a prefix-filtered set join on word shingles, verified word by word.

Texts are compared as streams of letters and digits, so spacing, punctuation, line breaks inside a word, invisible
characters and HTML escapes have no part in it; the words are those of the item.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palinode.sources.shared import written

#: A passage of MIN_WORDS running words or more with at most one error in PER_ERROR words always holds SHINGLE clean running words:
#: L words with e errors leave L - e clean ones in e + 1 runs.
MIN_WORDS, PER_ERROR, SHINGLE = 15, 6, 4
#: A longer passage than twice MIN_WORDS has a half that is a passage too, so only up to 4 errors need to be looked for.
MAX_ERRORS = (2 * MIN_WORDS - 1) // PER_ERROR
#: Items are verified in blocks of about so many characters; the answer does not depend on it.
BLOCK_CHARS = 4_000_000
#: Letters of a shingle that the filter of documents looks at on either end; bits of its maps, at least and at most as powers of two, and per shingle between.
GRAM, LEAST_BITS, MOST_BITS, BITS_EACH = 8, 22, 30, 64
#: Letters hashed at once.
_SLICE = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_NOISE = re.compile(r"[\W_]+")
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalnum())
_U = np.uint64


def plain(text: str) -> str:
    """Lower case without HTML escapes and compatibility forms."""
    for _ in range(3):
        if "&" not in text:
            break
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def letters(text: str) -> str:
    """The letters and digits of a plain text."""
    return text.encode().translate(None, _NO_LETTERS).decode() if text.isascii() else _NOISE.sub("", text)


def words(text: str) -> list[str]:
    """The words of an item."""
    return _WORD.findall(plain(text))


def _grams(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM code points."""
    n = max(0, len(codes) - GRAM + 1)
    h = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = h * _U(0x100000001B3) + codes[j : n + j]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


def _ends(first: np.ndarray, last: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """A hash of a shingle's length and of the grams it begins and ends with."""
    with np.errstate(over="ignore"):
        h = (first * _U(3) + last) * _U(0x94D049BB133111EB) + np.asarray(length, _U)
        h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(30))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Bits:
    """A set of hashes as 2**size bits, ``probes`` for each hash; never wrong about a hash that is in it."""

    def __init__(self, size: int, probes: int) -> None:
        self.shifts, self.mask = range(0, 13 * probes, 13), _U((1 << size) - 1)
        self.map = np.zeros(1 << size - 3, np.uint8)

    def _spot(self, h: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        at = (h >> _U(shift)) & self.mask
        return (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        for shift in self.shifts:
            np.bitwise_or.at(self.map, *self._spot(h, shift))

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in it, and hardly any others."""
        at = np.arange(len(h))
        for shift in self.shifts:
            place, bit = self._spot(h[at], shift)
            at = at[(self.map[place] & bit) != 0]
        return at


class Filter:
    """Which texts may hold a shingle of any item: its first GRAM letters, then its first and last and its length, as bits.

    Never wrong about a text that holds one. Shingles of fewer letters are looked for as they are.
    """

    def __init__(self, size: int) -> None:
        self.first, self.both = Bits(size, 1), Bits(size, 3)
        self.lengths: set[int] = set()
        self.short: set[str] = set()

    def _found(self, codes: np.ndarray) -> np.ndarray:
        """Where a shingle may begin."""
        h = _grams(codes)
        begins = self.first.among(h)
        out = [np.zeros(0, np.int64)]
        for length in sorted(self.lengths):
            begins = begins[begins + (length - GRAM) < len(h)]
            out.append(begins[self.both.among(_ends(h[begins], h[begins + (length - GRAM)], length))])
        return np.concatenate(out)

    def may_hold(self, streams: list[str]) -> np.ndarray:
        """For each stream whether it may hold a shingle."""
        sizes = np.array([len(s) for s in streams], np.int64)
        held = np.array([any(x in s for x in self.short) for s in streams], bool)
        if not self.lengths or not len(streams):
            return held
        codes = _codes("".join(streams))
        ends, reach = np.cumsum(sizes), max(self.lengths)
        for a in range(0, len(codes), _SLICE):
            # a shingle is looked for from where it begins, so slices overlap by one
            spots = self._found(codes[a : a + _SLICE + reach]) + a
            held[np.searchsorted(ends, spots, side="right")] = True
        return held


def filter_of(items: DataFrame) -> Filter:
    """The filter of the shingles of ``items`` (``text``), hashed by the executors; it has at most 2**MOST_BITS bits twice, whatever the items."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = set()
            for text in pdf["text"]:
                w = words(text)
                found |= {"".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1 if len(w) >= MIN_WORDS else 0)}
            long = sorted(x for x in found if len(x) >= GRAM)
            sizes = np.array([len(x) for x in long], np.int64)
            # both grams of a shingle stand at known places of two strings put together from them
            first, last = (_grams(_codes("".join(g)))[::GRAM] for g in ([x[:GRAM] for x in long], [x[-GRAM:] for x in long]))
            both = _ends(first, last, sizes)
            lengths = np.unique(sizes).astype(np.int32).tolist()
            yield pd.DataFrame([(len(found), np.unique(first).tobytes(), both.tobytes(), lengths, sorted(x for x in found if len(x) < GRAM))], columns=["n", "first", "both", "lengths", "short"])

    parts = written(items.select("text").mapInPandas(hashed, "n bigint, first binary, both binary, lengths array<int>, short array<string>"), "grams")
    n = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    made = Filter(min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length())))
    for row in parts.toLocalIterator():  # one batch of items at a time
        made.first.add(np.frombuffer(bytes(row["first"]), _U))
        made.both.add(np.frombuffer(bytes(row["both"]), _U))
        made.lengths |= set(row["lengths"])
        made.short |= set(row["short"])
    return made


class Shingles:
    """The distinct shingles of a block of items; pickles as the items, the automaton is built once per worker.

    Items of the same words are one entry with several ids; an id with several texts has several entries.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        ids: dict[tuple[str, ...], set[int]] = {}
        for i, t in items:
            if len(w := words(t)) >= MIN_WORDS:
                ids.setdefault(tuple(w), set()).add(i)
        self.items, self.ids = [list(w) for w in ids], [sorted(i) for i in ids.values()]
        texts = sorted({"".join(w[k : k + SHINGLE]) for w in self.items for k in range(len(w) - SHINGLE + 1)})
        self.number = {t: n for n, t in enumerate(texts)}

    def __getstate__(self) -> dict:
        return {"items": self.items, "ids": self.ids, "number": self.number}

    def machine(self):  # noqa: ANN201
        if not hasattr(self, "_machine"):
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for text, n in self.number.items():
                self._machine.add_word(text, n)
            self._machine.make_automaton()
        return self._machine

    def hits(self, stream: str) -> list[tuple[int, int]]:
        """End (inclusive) and number of every shingle in a stream."""
        return list(self.machine().iter(stream)) if self.number else []

    def of(self, item: int) -> list[int]:
        """Numbers of the item's shingles by position."""
        w = self.items[item]
        return [self.number["".join(w[k : k + SHINGLE])] for k in range(len(w) - SHINGLE + 1)]

    def prefixes(self, frequency: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By shingle number the (item, position) at which it belongs to the prefix of some window, rarest shingles first.

        A window of L words with e errors keeps at least L - SHINGLE + 1 - SHINGLE x e of its shingles, so all but that many less one
        of its rarest shingles suffice to meet it. Passages of other lengths hold one of these windows.
        """
        found: dict[int, list[tuple[int, int]]] = {}
        for item in range(len(self.items)):
            numbers = self.of(item)
            rank = sorted(range(len(numbers)), key=lambda k: (frequency[numbers[k]], numbers[k]))
            place = np.empty(len(numbers), np.int64)
            place[rank] = np.arange(len(numbers))
            needed = np.zeros(len(numbers), bool)
            for errors in range(MIN_WORDS // PER_ERROR, MAX_ERRORS + 1):
                size = max(MIN_WORDS, PER_ERROR * errors) - SHINGLE + 1
                spare = size - SHINGLE * errors - 1
                for a in range(len(numbers) - size + 1):
                    order = np.argsort(place[a : a + size])
                    needed[a + order[: size - spare]] = True
            for k in np.flatnonzero(needed):
                found.setdefault(numbers[k], []).append((item, int(k)))
        return found


def contacts(documents: DataFrame, known: Filter, key: str, text: str) -> DataFrame:
    """The documents that may hold a shingle: ``place`` (a number of the row), ``key``, ``stream`` (letters and digits), ``edges`` (where words start in it)."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[pdf["text"].notna()]
            texts = [plain(t) for t in pdf["text"]]
            streams = [letters(t) for t in texts]
            rows = [(pdf["key"].iloc[n], streams[n], np.cumsum([0, *map(len, _WORD.findall(texts[n]))])) for n in np.flatnonzero(known.may_hold(streams))]
            yield pd.DataFrame(rows, columns=["key", "stream", "edges"])

    schema = "key string, stream string, edges array<int>"  # a key column with nulls would come as floating point
    met = documents.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(look, schema)
    return met.select(F.monotonically_increasing_id().alias("place"), "*")


def _reach(item: list[str], at: int, stream: str, pos: int, edges: list[int], step: int) -> list[tuple[int, int, tuple, tuple]]:
    """How far the item goes from word ``at`` and stream position ``pos`` on with 0, 1, ... errors, forwards (``step`` 1) or backwards (-1).

    Each time the word and the position that are reached, and the stretches of the stream that were clean before. Only
    passages that end with a clean word count, and the position after each error is that of the next word.
    """

    def slide(i: int, p: int) -> tuple[int, int]:
        if step > 0:
            while i < len(item) and stream.startswith(item[i], p):
                p += len(item[i])
                i += 1
        else:
            while i and stream.endswith(item[i - 1], 0, p):
                i -= 1
                p -= len(item[i])
        return i, p

    def stretch(p: int, q: int) -> tuple:
        return ((min(p, q), max(p, q)),) if p != q else ()

    i, p = slide(at, pos)
    front = {(i, p): stretch(pos, p)}
    best = [(i, p, front[i, p])]
    for _ in range(MAX_ERRORS):
        following: dict[tuple[int, int], tuple] = {}
        top = best[-1]
        for (i, p), clean in front.items():
            if step > 0:
                k = bisect_right(edges, p)
                after = edges[k] if k < len(edges) else len(stream)
            else:
                k = bisect_left(edges, p) - 1
                after = edges[k] if k >= 0 else 0
            for j, q in ((i + step, after), (i + step, p), (i, after)):
                if 0 <= j <= len(item):
                    to = slide(j, q)
                    if to not in following:
                        following[to] = clean + stretch(q, to[1])
                    if to[0] != j and (to[0] - top[0]) * step > 0:
                        top = (*to, following[to])
        best.append(top)
        front = following
    return best


def passage(item: list[str], k: int, stream: str, start: int, edges: list[int]) -> tuple[int, int, int, int, list[tuple[int, int]]] | None:
    """The longest passage of the item around its shingle ``k``, which is at ``start`` of the stream, with the fewest errors:
    first and last word (exclusive), where it begins and ends, and its clean stretches."""
    right = _reach(item, k, stream, start, edges, 1)
    left = _reach(item, k, stream, start, edges, -1)
    best, found = (MIN_WORDS, -(2 * MAX_ERRORS)), None
    for a, (i, q, after) in enumerate(right):
        for b, (j, p, before) in enumerate(left):
            if (a + b) * PER_ERROR <= i - j and (i - j, -a - b) >= best:
                best, found = (i - j, -a - b), (j, i, p, q, [*before, *after])
    return found


FOUND = "item_id bigint, first int, words int, begins int, ends int, clean array<int>"


def verified(met: DataFrame, shingles: Shingles, prefixes: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """``place``, ``key`` and the passages of the items whose prefix shingles a document holds: ``item_id``, ``first`` word and number of ``words``,
    where it ``begins`` and ``ends`` in the stream, and the bounds of its ``clean`` stretches.

    Hits in one run of clean words have the same passages around them, so each run is tried once, and hits inside a passage not at all.
    """

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = [np.cumsum([0, *map(len, w)]).tolist() for w in shingles.items]
        for pdf in frames:
            rows = []
            for place, key, stream, edges in zip(pdf["place"], pdf["key"], pdf["stream"], pdf["edges"], strict=True):
                edges = edges.tolist()
                tried: dict[tuple[int, int], int] = {}  # where the last clean run of an item at an origin ends
                found: dict[int, list] = {}
                for last, n in shingles.hits(stream):
                    for item, k in prefixes.get(n, ()):
                        off = offsets[item]
                        origin = last + 1 - off[k + SHINGLE]
                        start = origin + off[k]
                        if k < tried.get((item, origin), 0) or any(f[0] <= k < f[1] and f[2] <= start < f[3] for f in found.get(item, ())):
                            continue
                        w, clean = shingles.items[item], k + SHINGLE
                        while clean < len(w) and stream.startswith(w[clean], origin + off[clean]):
                            clean += 1
                        tried[item, origin] = clean
                        if one := passage(w, k, stream, start, edges):
                            found.setdefault(item, []).append(one)
                for item, mine in found.items():
                    for a, b, p, q, clean in mine:
                        bounds = [x for s in sorted(clean) for x in s]
                        rows += [(place, key, i, a, b - a, p, q, bounds) for i in shingles.ids[item]]
            yield pd.DataFrame(rows, columns=["place", "key", "item_id", "first", "words", "begins", "ends", "clean"])

    return met.mapInPandas(look, f"place bigint, key string, {FOUND}")


def _covered(bounds: np.ndarray, begins: int, ends: int) -> int:
    """How much of a stretch lies in disjoint intervals (rows of start and end)."""
    return int(np.clip(np.minimum(bounds[:, 1], ends) - np.maximum(bounds[:, 0], begins), 0, None).sum())


def _joined(stretches: list[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """The union of intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return tuple(out)


def _competing(passages: list[tuple[int, int, int, list[int]]]) -> list[tuple[int, int]]:
    """For each passage of one document (item, where it begins and ends, bounds of its clean stretches) how many letters between its ends its
    item explains, and how many the item that explains most."""
    of: dict[int, list[tuple[int, int]]] = {}
    for item, _, _, bounds in passages:
        of.setdefault(item, []).extend(zip(bounds[::2], bounds[1::2], strict=True))
    # items of one template explain the same stretches, so there are few different explanations
    explained = {item: _joined(s) for item, s in of.items()}
    arrays = {e: np.array(e, np.int64).reshape(-1, 2) for e in set(explained.values())}
    memo: dict[tuple[int, int], dict] = {}
    out = []
    for item, p, q, _ in passages:
        if (p, q) not in memo:
            memo[p, q] = {e: _covered(a, p, q) for e, a in arrays.items() if e and e[0][0] < q and e[-1][1] > p}
        out.append((memo[p, q].get(explained[item], 0), max(memo[p, q].values(), default=0)))
    return out


def _judged(found: DataFrame) -> DataFrame:
    """The passages of ``verified`` with ``own`` and ``rival`` in place of ``clean``; the passages of one document are looked at together."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, passages in zip(pdf["key"], pdf["passages"], strict=True):
                scores = _competing([(x["item_id"], x["begins"], x["ends"], x["clean"]) for x in passages])
                rows += [(key, x["item_id"], x["first"], x["words"], *score) for x, score in zip(passages, scores, strict=True)]
            yield pd.DataFrame(rows, columns=["key", "item_id", "first", "words", "own", "rival"])

    of = found.groupBy("place").agg(F.first("key").alias("key"), F.collect_list(F.struct("item_id", "first", "words", "begins", "ends", "clean")).alias("passages"))
    return of.select("key", "passages").mapInPandas(judge, "key string, item_id bigint, first int, words int, own int, rival int")


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``item_id``, ``first``, ``words``, ``own``, ``rival``, ``stands``: every passage of an item (``item_id`` bigint, ``text``) in a document.

    A passage is at least MIN_WORDS running words of the item of which at most one in PER_ERROR is changed, left out or added.
    ``first`` and ``words`` say which of the item. Where passages of several items lie on one stretch of a document, as items made from one
    template do, the item stands there that explains most of its letters: ``own`` letters between the ends of the passage are
    clean words of the item, ``rival`` of the item that has most; ``stands`` is whether none has more. Items that explain a
    stretch equally well, such as copies under other ids or a stock phrase alone, all stand. Items of fewer words leak nothing;
    null texts are skipped, documents with a null key are reported under it, items without id or text left out.

    All documents are read once, past a filter of bounded size of the items' shingles; the few that may hold one are written
    and met by the items, block by block. Rarity is counted over all documents.
    """
    usable = items.select("item_id", "text").where("item_id is not null and text is not null")
    chars = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    met = written(contacts(documents, filter_of(usable), key, text), "contacts")
    found = None
    for block in range(blocks):
        # equal texts come to one block
        mine = usable.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        shingles = Shingles([(r["item_id"], r["text"]) for r in mine.toLocalIterator()])

        def count(frames: Iterator[pd.DataFrame], shingles: Shingles = shingles) -> Iterator[pd.DataFrame]:
            seen: Counter[int] = Counter()
            for pdf in frames:
                for stream in pdf["stream"]:
                    seen.update({n for _, n in shingles.hits(stream)})
            yield pd.DataFrame(list(seen.items()), columns=["n", "times"])

        frequency = np.zeros(len(shingles.number), np.int64)
        counted = met.select("stream").mapInPandas(count, "n int, times bigint").groupBy("n").agg(F.sum("times").alias("times"))
        for n, times in counted.toLocalIterator():  # at most one row per shingle of the block
            frequency[n] = times
        part = verified(met, shingles, shingles.prefixes(frequency))
        found = part if found is None else found.unionByName(part)
    kind = dict(documents.dtypes)[key]
    return _judged(found).select(F.col("key").cast(kind).alias(key), "item_id", "first", "words", "own", "rival", (F.col("own") >= F.col("rival")).alias("stands"))


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``item_id``: the documents that hold a passage of an item, distinct, by the passages of ``leaks`` that stand."""
    return leaks(documents, items, key, text).where("stands").select(key, "item_id").distinct()
