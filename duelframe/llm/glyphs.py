"""Problem 9: one consistent form for texts that look alike.

Text of a whole Arrow batch is one array of code points. Lookup tables give, for
each code point, the length and the place of its replacement; one gather with
expansion offsets rewrites the batch. Combining marks are then ordered and composed
with array operations. No Python call is made per row or per character.

The form: canonical composition; full-width, half-width and no-break variants,
spaces of any width and runs of them become one plain space (none at the ends of
a text or around line breaks); line ends become LF; invisible characters
(zero-width, soft hyphen, direction marks, joiners, variation selectors, controls) go; ligatures
are spelled out; hyphen variants become '-'; look-alike Cyrillic and Greek letters
become the Latin letter they look like. Letters with a visible difference, accents,
digits, case and punctuation stay. Null stays null; a blank text becomes ''.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import StringType

from duelframe.functions.joins import look_up
from duelframe.session import Scratch

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "h", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ρ": "p", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "ɡ": "g", "ɑ": "a", "ı": "i", "ꓮ": "A", "ꓐ": "B", "ꓳ": "O",
}
# Characters drawn like a hyphen, and apostrophe forms drawn alike.
HYPHENS = "\u2010\u2011\u2043\u02d7\u2212\ufe63\uff0d"
APOSTROPHES = "\u2019\u02bc\ua78c"

SPACE, LF = 32, 10
#: Documents of one form that one task pairs with the others.
FORM_PART = 2_000
#: Bytes of text that are rewritten at once.
PART_BYTES = 1 << 19
_CUT = re.compile(rb"[A-Za-z0-9](?=[A-Za-z0-9])")
_MASK21 = np.uint64(21)


def _expansion(ch: str) -> str:
    """The fully decomposed, plain spelling of one character; '' for invisible ones."""
    if ch in "\n\x0b\x0c\r\x85\u2028\u2029":
        return "\n"
    if ch == "\t":
        return " "
    if ch in HYPHENS:
        return "-"
    if ch in APOSTROPHES:
        return "\u2019"
    o, cat = ord(ch), unicodedata.category(ch)
    if cat == "Zs":
        return " "
    if 0xAC00 <= o <= 0xD7A3 or cat == "Cs":
        return ch  # syllables stay whole; jamo are composed later
    visible_format = 0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)
    if (cat == "Cf" and not visible_format) or cat == "Cc" or o == 0x34F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
        return ""
    d = unicodedata.decomposition(ch)
    if d:
        tag, _, rest = d.partition(" ") if d[0] == "<" else ("", "", d)
        ligature = 0xFB00 <= o <= 0xFB06 or 0x132 <= o <= 0x133 or 0x1C4 <= o <= 0x1CC or 0x1F1 <= o <= 0x1F3 or 0x2160 <= o <= 0x217F or o == 0x2026
        if tag in ("", "<wide>", "<narrow>", "<noBreak>") or ligature or (0x2E80 <= o <= 0x2FDF and tag == "<compat>"):
            return "".join(_expansion(chr(int(x, 16))) for x in rest.split())
    return LOOK_ALIKES.get(ch, ch)


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built once per worker (about one second)."""
    n = sys.maxunicode + 1
    length, place = np.ones(n, np.uint8), np.arange(n, dtype=np.uint32)
    pool: list[int] = []
    klass = np.zeros(n, np.uint8)
    pairs: dict[int, int] = {}
    blocks = [range(0x0, 0x3400), range(0xA000, 0xAC00), range(0xD7B0, 0xD800), range(0xF900, 0x12000), range(0x16000, 0x17000), range(0x1BC00, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200)]
    for o in (o for b in blocks for o in b):
        ch = chr(o)
        out = _expansion(ch)
        klass[o] = unicodedata.combining(ch)
        if out != ch:
            if len(out) == 1:
                place[o] = ord(out)
            else:
                length[o], place[o] = len(out), n + len(pool)
                pool += map(ord, out)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            first, second = _expansion(chr(a)), _expansion(chr(b))
            # the composed letter of the look-alike base, e.g. Cyrillic io becomes e with diaeresis
            if second == chr(b) and first:
                base = unicodedata.normalize("NFC", first)
                if len(base) == 1:
                    made = unicodedata.normalize("NFC", base + second)
                    pairs.setdefault(ord(base) << 21 | b, ord(made) if len(made) == 1 else o)
                pairs.setdefault(a << 21 | b, o)
    keys = np.array(sorted(pairs), np.uint64)
    second = np.zeros(n, bool)
    second[(keys & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
    return {
        "length": length, "place": place, "pool": np.concatenate([np.arange(n, dtype=np.uint32), np.array(pool, np.uint32)]),
        "class": klass, "keys": keys, "made": np.array([pairs[int(k)] for k in keys], np.uint32), "second": second,
    }


def _compose(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order combining marks canonically, then merge base and mark pairs until none is left."""
    klass = t["class"][cp]
    swapped = (klass[1:] > 0) & (klass[:-1] > klass[1:]) & (row[1:] == row[:-1]) if len(cp) > 1 else np.zeros(0, bool)
    if swapped.any():
        starter = np.cumsum((klass == 0) | np.concatenate([[True], row[1:] != row[:-1]]))
        order = np.lexsort((np.arange(len(cp)), klass, starter))
        cp = cp[order]
    while len(cp) > 1:
        at = np.flatnonzero(t["second"][cp[1:]] & (row[1:] == row[:-1])) + 1
        key = cp[at - 1].astype(np.uint64) << _MASK21 | cp[at].astype(np.uint64)
        slot = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][slot] == key
        at, made = at[hit], t["made"][slot[hit]]
        if len(at):
            free = np.concatenate([[True], at[1:] - at[:-1] > 1])  # a merged mark is no base in the same pass
            at, made = at[free], made[free]
        lead = np.flatnonzero((cp[:-1] >= 0x1100) & (cp[:-1] <= 0x1112) & (cp[1:] >= 0x1161) & (cp[1:] <= 0x1175) & (row[1:] == row[:-1])) + 1
        lv = (cp[:-1] >= 0xAC00) & (cp[:-1] <= 0xD7A3) & ((cp[:-1].astype(np.int64) - 0xAC00) % 28 == 0)
        tail = np.flatnonzero(lv & (cp[1:] >= 0x11A8) & (cp[1:] <= 0x11C2) & (row[1:] == row[:-1])) + 1
        if not len(at) and not len(lead) and not len(tail):
            break
        cp = cp.copy()
        syllable = 0xAC00 + ((cp[lead - 1] - 0x1100) * 21 + (cp[lead] - 0x1161)) * 28
        closed = cp[tail - 1] + (cp[tail] - 0x11A7)
        cp[at - 1], cp[lead - 1], cp[tail - 1] = made, syllable, closed
        keep = np.ones(len(cp), bool)
        keep[at], keep[lead], keep[tail] = False, False, False
        cp, row = cp[keep], row[keep]
    return cp, row


def _squeeze(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One space for a run of them, none beside a line break or an end of the text."""
    space = cp == SPACE
    edge = np.concatenate([[True], row[1:] != row[:-1]])
    after = np.concatenate([[True], (cp[:-1] == SPACE) | (cp[:-1] == LF)]) | edge
    keep = ~(space & after)
    cp, row = cp[keep], row[keep]
    if len(cp):
        last = np.concatenate([row[1:] != row[:-1], [True]])
        keep = ~((cp == SPACE) & (np.concatenate([cp[1:] == LF, [True]]) | last))
        cp, row = cp[keep], row[keep]
    # line breaks at the ends of a text go as well
    while len(cp):
        first = np.concatenate([[True], row[1:] != row[:-1]])
        last = np.concatenate([row[1:] != row[:-1], [True]])
        drop = ((cp == LF) | (cp == SPACE)) & (first | last)
        if not drop.any():
            break
        cp, row = cp[~drop], row[~drop]
    return cp, row


def _fold_part(texts: pa.Array, marks: bool) -> pa.Array:
    """The form of the texts of one part, which is small enough for some arrays of 8 bytes a character."""
    n = len(texts)
    if n == 0:
        return pa.array([], pa.large_string())
    t = tables()
    valid = np.asarray(texts.is_valid())
    filled = texts.fill_null("")
    ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + n + 1]
    data = filled.buffers()[2]
    raw = (data.to_pybytes() if data is not None else b"")[ends[0] : ends[-1]]
    # CR LF is one line end
    if b"\r" in raw:
        filled = pa.compute.replace_substring(filled, "\r\n", "\n")
        ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + n + 1]
        raw = filled.buffers()[2].to_pybytes()[ends[0] : ends[-1]]
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])[ends - ends[0]]
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(before))
    size = t["length"][cp].astype(np.int64)
    place = t["place"][cp].astype(np.int64)
    if (size != 1).any():
        total = int(size.sum())
        begin = np.cumsum(size) - size
        cp = t["pool"][np.repeat(place - begin, size) + np.arange(total)]
        row = np.repeat(row, size)
    else:
        cp = t["pool"][place]
    if marks:
        cp, row = _compose(cp, row, t)
    else:
        base = t["class"][cp] == 0
        cp, row = cp[base], row[base]
    cp, row = _squeeze(cp, row)
    out = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    sizes = np.bincount(row, weights=width, minlength=n).astype(np.int64) if len(cp) else np.zeros(n, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out), mask)
    return made

def _pieces(text: bytes) -> list[str]:
    """A very long text in parts, cut between two ASCII letters or digits, where nothing is composed or squeezed."""
    out, low = [], 0
    while len(text) - low > PART_BYTES:
        cut = _CUT.search(text, low + PART_BYTES)
        if not cut:
            break
        out.append(text[low : cut.end()].decode())
        low = cut.end()
    return [*out, text[low:].decode()]


def fold(texts: pa.Array, marks: bool = True) -> pa.Array:
    """The consistent form of every text of an Arrow array; without marks, letters lose their accents.

    Works on parts of about PART_BYTES, so memory does not grow with the batch or with one text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    group = np.cumsum(sizes) // PART_BYTES
    cuts = np.flatnonzero(np.diff(group)) + 1
    parts = []
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        longest = int(sizes[low:high].argmax()) + low if high > low else low
        if high > low and sizes[longest] > 2 * PART_BYTES:
            for k in range(low, high):
                if sizes[k] <= 2 * PART_BYTES:
                    parts.append(_fold_part(texts.slice(k, 1), marks))
                else:
                    forms = [_fold_part(pa.array([p], pa.large_string()), marks)[0].as_py() for p in _pieces(texts[k].as_py().encode())]
                    parts.append(pa.array(["".join(forms)], pa.large_string()))
        else:
            parts.append(_fold_part(texts.slice(low, high - low), marks))
    made = pa.concat_arrays(parts)
    return made.cast(pa.string()) if made.nbytes < 2**31 - 1 else made


def _fold_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield fold(batch)


def _bare_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield fold(batch, marks=False)


_folded = arrow_udf(_fold_batches, StringType())
_bare = arrow_udf(_bare_batches, StringType())


def folded(text: Column | str) -> Column:
    """The consistent form as a column (Arrow batches, see `fold`)."""
    return _folded(F.col(text) if isinstance(text, str) else text)


def bare(text: Column | str) -> Column:
    """The consistent form without accents, for look-ups of names."""
    return _bare(F.col(text) if isinstance(text, str) else text)


def consistent_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form): the consistent form of every document; null text gives a null form."""
    return documents.select(F.col(id_col), folded(text_col).alias("form"))


def _members(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(form, text, doc) of the documents whose form has several spellings, and (form, docs, spellings) of these forms.

    Forms and texts are 128-bit digests, so no text is shuffled; they are written once. Blank and null texts
    are left out; repeated rows count once.
    """
    scratch = Scratch(documents.sparkSession, "p9")
    digests = scratch.save(
        documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), folded(text_col).alias("form"))
        .where("doc IS NOT NULL AND form <> ''").select("doc", F.md5("form").alias("form"), F.md5("text").alias("text"))
    )
    several = digests.select("form", "text").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    members = scratch.save(look_up(digests, scratch.save(several.select("form")), "form", "inner", "doc").select("form", "text", "doc").distinct())
    sizes = members.groupBy("form", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("form").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("spellings"))
    return members, scratch.save(sizes)


def look_alike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = FORM_PART) -> DataFrame:
    """(doc_a, doc_b): all pairs of documents of different characters and one consistent form.

    Only forms of several spellings are joined. One side of a large form is dealt over parts of some `part`
    documents and meets the other side in each, so that no task makes all pairs of a form.
    Blank and null texts, equal texts and a document with itself give no row; a repeated row counts once.
    """
    members, sizes = _members(documents, id_col, text_col)
    parts = F.ceil(F.col("docs") / F.lit(part)).cast("int")
    sized = look_up(members, sizes, "form", "inner", "doc").withColumn("parts", parts)
    one = sized.select("form", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.col("text").alias("text_a"), F.col("doc").alias("doc_a"))
    two = sized.select("form", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("text_b"), F.col("doc").alias("doc_b"))
    return one.join(two, ["form", "part"]).where("doc_a < doc_b AND text_a <> text_b").select("doc_a", "doc_b").distinct()


def look_alike_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, class_id, docs, spellings, links): the class of every document that looks like a different text.

    links is the number of pairs that the document has; the pairs are those of a class with different texts.
    """
    members, sizes = _members(documents, id_col, text_col)
    same = members.groupBy("form", "text").agg(F.count(F.lit(1)).alias("same"))
    rows = look_up(look_up(members, sizes, "form", "inner", "doc"), same, ["form", "text"], "inner", "doc")
    return rows.select("doc", F.col("form").alias("class_id"), "docs", "spellings", (F.col("docs") - F.col("same")).alias("links"))
