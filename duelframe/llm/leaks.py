"""Problem 7: evaluation passages in training texts, by a BM25 index with block-max WAND.

The inverted index holds the test items; its terms are runs of three words, so a posting is
rare. Every document is cut into overlapping passages over its whole text, every passage is a
query, and all items that can reach the threshold are retrieved with WAND pivots and block
maxima. The threshold is the least score that a true case can have, so nothing is lost. The
overlap is then verified word by word on each retrieved pair.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.glyphs import fold

RUN = 20  # least number of words in a row
PER_REPLACED = 8  # at most one word in so many is replaced
GRAM = 3
PASSAGE, STRIDE = 40, 20
#: A case keeps at least so many intact word triples in one passage (12 in the worst of 20 words).
LEAST_TRIPLES = 8
K1, B = 1.2, 0.75
POSTINGS_A_BLOCK = 32
#: Items of one index; more items are searched in several indexes, each over all documents.
ITEMS_AT_ONCE = 20_000
TEXTS_AT_ONCE = 512

#: A tag with its attributes, of any length; comparisons and prose with other marks between angle brackets stay.
_TAG = re.compile(r"""</?[A-Za-z][\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+)*+\s*+/?>|<![A-Za-z][^<>]*+>""")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_LETTER_ESCAPE = re.compile(r"\\[nrt\"/\\]")
_APOSTROPHE = re.compile(r"(?<=\w)['’‘`´](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def _without_comments(text: str) -> str:
    """A space for each comment; a comment that does not end is text."""
    kept, low = [], 0
    while (begin := text.find("<!--", low)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        kept += [text[low:begin], " "]
        low = end + 3
    return "".join([*kept, text[low:]])


def _plain(text: str) -> str:
    """Without mark-up: tags, entities and the escapes of quoted JSON become what they stand for."""
    if "\\" in text:
        text = _LETTER_ESCAPE.sub(" ", _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else " ", text))
    if "<" in text:
        text = _TAG.sub(" ", _without_comments(text))
    return html.unescape(text) if "&" in text else text


def words_of(texts: list[str | None]) -> list[list[str]]:
    """Words in one consistent form, without accents, case, punctuation and mark-up.

    The form comes first, so that mark-up is known in whatever characters it is written; texts in which mark-up
    stood for other characters are brought to the form again.
    """
    forms = fold(pa.array([t or "" for t in texts], pa.large_string()), marks=False).to_pylist()
    plain = [_plain(f) for f in forms]
    changed = [n for n, (f, p) in enumerate(zip(forms, plain, strict=True)) if f != p]
    if changed:
        again = fold(pa.array([plain[n] for n in changed], pa.large_string()), marks=False).to_pylist()
        for n, f in zip(changed, again, strict=True):
            plain[n] = f
    return [_WORD.findall(_APOSTROPHE.sub("", f.lower())) for f in plain]


class ItemIndex:
    """BM25 postings of word triples over the items, in blocks with their largest contribution."""

    def __init__(self, items: Iterable[tuple[int, str | None]]):
        rows = [(i, t) for i, t in items if i is not None]
        self.ids = [i for i, _ in rows]
        worded = words_of([t for _, t in rows])
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64) for ws in worded]
        self.base = len(self.vocabulary) + 1
        counts: dict[int, dict[int, int]] = defaultdict(dict)
        self.places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, ws in enumerate(self.words):
            for p, term in enumerate(self.triples(ws).tolist()):
                counts[term][n] = counts[term].get(n, 0) + 1
                self.places[(term, n)].append(p)
        self.places = dict(self.places)
        sizes = np.array([max(1, len(w)) for w in self.words] or [1])
        mean, total = sizes.mean(), len(self.words)
        self.terms = np.array(sorted(counts), np.int64)
        self.postings: dict[int, tuple[list[int], list[float], list[int], list[float], float]] = {}
        least = math.inf
        for term, held in counts.items():
            idf = math.log(1 + (total - len(held) + 0.5) / (len(held) + 0.5))
            ns = sorted(held)
            score = [idf * held[n] * (K1 + 1) / (held[n] + K1 * (1 - B + B * sizes[n] / mean)) for n in ns]
            ends = [ns[min(i + POSTINGS_A_BLOCK, len(ns)) - 1] for i in range(0, len(ns), POSTINGS_A_BLOCK)]
            tops = [max(score[i : i + POSTINGS_A_BLOCK]) for i in range(0, len(ns), POSTINGS_A_BLOCK)]
            self.postings[term] = (ns, score, ends, tops, max(tops))
            least = min(least, *score)
        self.threshold = LEAST_TRIPLES * least * (1 - 1e-9) if counts else math.inf

    def triples(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the word triples; -1 where a word is not in the vocabulary."""
        if len(ids) < GRAM:
            return np.zeros(0, np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a < 0) | (b < 0) | (c < 0), -1, (a * self.base + b) * self.base + c)

    def search(self, terms: list[int]) -> list[int]:
        """All items whose BM25 score for the query terms reaches the threshold (block-max WAND).

        A term counts as often as the query has it, so that every intact triple of a case adds
        at least the least posting score, however few of them are distinct.
        """
        lists: list[list] = []  # place, block, then the postings
        for t, times in Counter(terms).items():
            ns, score, ends, tops, top = self.postings[t]
            lists.append([0, 0, ns, score, ends, tops, top] if times == 1 else [0, 0, ns, [times * x for x in score], ends, [times * x for x in tops], times * top])
        found: list[int] = []
        while True:
            lists = [x for x in lists if x[0] < len(x[2])]
            lists.sort(key=lambda x: x[2][x[0]])
            bound, pivot = 0.0, None
            for i, x in enumerate(lists):
                bound += x[6]
                if bound >= self.threshold:
                    pivot = i
                    break
            if pivot is None:
                return found
            at = lists[pivot][2][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][2][lists[pivot + 1][0]] == at:
                pivot += 1
            blocks, skip = 0.0, math.inf
            for x in lists[: pivot + 1]:
                while x[1] < len(x[4]) - 1 and x[4][x[1]] < at:
                    x[1] += 1
                blocks += x[5][x[1]] if x[4][x[1]] >= at else 0.0
                skip = min(skip, x[4][x[1]] + 1 if x[4][x[1]] >= at else math.inf)
            if blocks < self.threshold:
                after = lists[pivot + 1][2][lists[pivot + 1][0]] if pivot + 1 < len(lists) else math.inf
                self._forward(lists[: pivot + 1], max(at + 1, min(skip, after)))
            elif lists[0][2][lists[0][0]] == at:
                score = sum(x[3][x[0]] for x in lists[: pivot + 1])
                if score >= self.threshold:
                    found.append(at)
                self._forward(lists[: pivot + 1], at + 1)
            else:
                self._forward(lists[:pivot], at)

    @staticmethod
    def _forward(lists: list[list], to: float) -> None:
        for x in lists:
            if to == math.inf:
                x[0] = len(x[2])
            while x[0] < len(x[2]) and x[2][x[0]] < to:
                x[0] += 1

    def leaks(self, words: list[str]) -> list[int]:
        """Items of which the words repeat at least RUN words in a row."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        grams = self.triples(ids)
        if not len(self.terms) or not len(grams):
            return []
        slot = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
        hits = np.flatnonzero(self.terms[slot] == grams)
        if len(hits) < LEAST_TRIPLES:
            return []
        met: set[int] = set()
        for start in np.unique(np.concatenate([hits // STRIDE, hits // STRIDE - 1])):
            low = max(0, int(start)) * STRIDE
            a, b = np.searchsorted(hits, [low, low + PASSAGE - GRAM + 1])
            if b - a >= LEAST_TRIPLES:
                met.update(self.search(grams[hits[a:b]].tolist()))
        return [n for n in met if self._verified(n, ids, grams, hits)]

    def _verified(self, n: int, ids: np.ndarray, grams: np.ndarray, hits: np.ndarray) -> bool:
        """Whether some alignment has RUN words in a row, both ends equal, and few replaced words."""
        shifts: dict[int, int] = defaultdict(int)
        for h in hits.tolist():
            for p in self.places.get((int(grams[h]), n), ()):
                shifts[h - p] += 1
        item = self.words[n]
        for shift, count in shifts.items():
            if count < LEAST_TRIPLES:
                continue
            low, high = max(0, shift), min(len(ids), shift + len(item))
            same = ids[low:high] == item[low - shift : high - shift]
            if len(same) < RUN:
                continue
            cost = PER_REPLACED * np.concatenate([[0], np.cumsum(~same)]) - np.arange(len(same) + 1)
            ends = np.where(same, cost[1:], np.iinfo(np.int64).max)  # runs end with an equal word
            least = np.minimum.accumulate(ends[::-1])[::-1]
            starts = cost[: len(same) - RUN + 1]
            if (same[: len(starts)] & (least[RUN - 1 :] <= starts)).any():
                return True
        return False


def _search_batches(index: ItemIndex, doc_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(low, TEXTS_AT_ONCE)
                docs: list[int] = []
                items: list[int] = []
                for doc, words in zip(part.column(0).to_pylist(), words_of(part.column(1).to_pylist()), strict=True):
                    for n in index.leaks(words):
                        docs.append(doc)
                        items.append(index.ids[n])
                yield pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.array(items, item_type)], ["doc_id", "item_id"])

    return run


def found(documents: DataFrame, items: DataFrame, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id): documents that repeat at least twenty words in a row of an item.

    Documents stay where they are; the index of the items, of at most `items_at_once` of them at a
    time, goes to every worker. Null, empty and short texts match nothing; a repeated row
    counts once; without items or documents there are no rows.
    """
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    slices = max(1, math.ceil(items.count() / items_at_once))
    rows = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for n in range(slices):
        share = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == n)  # bounded by items_at_once
        index = spark.sparkContext.broadcast(ItemIndex((r.item_id, r.text) for r in share.collect()))
        run = lambda batches, held=index: _search_batches(held.value, pa.int64(), pa.int64())(batches)
        part = rows.mapInArrow(run, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
