"""Substring deduplication by hashing units and windows of text.

Two kinds of passages are grouped over all documents, and the occurrence of the smallest (doc_id, text digest,
position) of each is kept; any other is a copy.

Windows are all runs of ``WINDOW`` words, wherever they begin, so a passage of that length or more is found to the word
on either side, whatever surrounds it. Words lie between spaces (letters lowered, outer punctuation dropped); in scripts
without spaces each character is one. A window's first least run of ``GRAM`` words is its anchor, which is the same
wherever the window lies: anchors are counted first, those met once are left out, exactly, and neighbouring windows of
one anchor travel as one row to the task of that anchor. An anchor met over ``HOT`` times is dealt out to several tasks,
which first tell each other their earliest windows, so no group grows with the table. A window that repeats one it
overlaps loses only what lies beyond that one.

A unit is a line, cut further where a sentence ends and where a capitalised word begins, so that a passage is cut
alike wherever it was pasted. Units are normalised as words are and hashed to 96 bits. Maximal runs of copies that hold
``MIN_WORDS`` words or more are removed; shorter ones stay, as common phrases do. Whole lines, and paragraphs of
several, are hashed as well, apart from units: a copied one of ``BLOCK_WORDS`` words or more goes, whatever stands
around it (of ``ALONE_WORDS``, where the line is the whole text). Since the first occurrence of a unit is never a copy,
no unit vanishes altogether. Offsets are those of the original text, in code points.

Defined cases: null text stays null, with no units; an empty text stays empty. Rows that repeat a doc_id are ranked by
their texts' digests; rows that repeat both are one document, and all get the same result. A null doc_id ranks last.
doc_id is read as a long. An empty table gives an empty table. Extra columns of the input are carried along unless they
bear an output's name, in which case the output's takes their place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, read, release, slices, stored, swept, word_hashes, words_of

MIN_WORDS = 20
BLOCK_WORDS = 4
ALONE_WORDS = 6
WINDOW = 50
GRAM = 20
HOT = 1024  # occurrences of an anchor that are taken together
SLICE = 1 << 18  # bytes of texts that are parsed together

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept_in", pa.int64())]))
_CUT = pa.struct([("text", pa.string()), ("removed", _SPANS)])
_CUT_TYPE = "struct<text: string, removed: array<struct<start: bigint, end: bigint, kept_in: bigint>>>"

_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")
_FAR_SPACE, _FAR_EDGE = re.compile(r"[^\S\x00-\x7f]"), re.compile("[–—…«»“”„‘’]")
_BASE, _BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_INVERSE, _INVERSE_2 = pow(_BASE, -1, 1 << 64), pow(_BASE_2, -1, 1 << 64)
_is_word = np.ones(256, bool)
_is_word[[32, *range(9, 14), *range(28, 32)]] = False
_is_edge, _is_stop = np.zeros(256, bool), np.zeros(256, bool)
_is_edge[list(b".,;:!?\"'()[]{}<>|*#&$%-")] = True
_is_stop[list(b".!?")] = True


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _spaced(text: str) -> str:
    """The text with plain spaces where words part, as `_WORD` has them."""
    if text.isascii():
        return text
    text = _FAR_SPACE.sub(" ", text)
    return _HAS_UNSPACED.sub(r" \g<0> ", text)


def _lowered(spaced: str) -> str:
    low = spaced.lower()
    return low if low.isascii() else _FAR_EDGE.sub("'", low)


def _upper_case(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether these first two bytes begin with A-Z or a Latin-1, Greek or Cyrillic capital."""
    out = (first >= 65) & (first <= 90)
    out |= (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    out |= (first == 0xCE) & (second >= 0x91) & (second <= 0xA9)
    return out | ((first == 0xD0) & (second >= 0x90) & (second <= 0xAF))


def _within(sums: np.ndarray, a: np.ndarray, b: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


class Parsed:
    """Some texts as words, units and blocks.

    hashes: of all words; bounds: the n + 1 offsets of the texts in them. Units, then lines and paragraphs that count as
    blocks, are ``parts`` of a text: (first, stop) words, ``part_bounds`` the texts' offsets in them, ``is_unit``.
    """

    def __init__(self, texts: list[str], parts: bool = True):
        spaced = [_spaced(t) for t in texts]
        low, low_offsets = _joined([_lowered(t) for t in spaced])
        starts, ends, self.bounds = words_of(low, low_offsets, _is_word)
        self.hashes = self._word_hashes(low, starts, ends)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        if parts:
            self._parts(*_joined(spaced))

    @staticmethod
    def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of words without outer punctuation; of those that are nothing else, as they stand."""
        a, b = starts.copy(), ends.copy()
        for at, step, side in ((a, 1, 0), (b, -1, -1)):
            left = np.flatnonzero(a < b)
            while len(left := left[_is_edge[data[at[left] + side]]]):
                at[left] += step
                left = left[a[left] < b[left]]
        bare = a >= b
        a[bare], b[bare] = starts[bare], ends[bare]
        return word_hashes(data, a, b)

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, bounds = words_of(data, offsets, _is_word)
        n, rows = len(starts), len(bounds) - 1
        self.starts, self.ends = starts - offsets[self.row], ends - offsets[self.row]
        first = np.zeros(n, bool)
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        breaks = np.bincount(np.searchsorted(starts, np.flatnonzero(data == 10)), minlength=n + 1)[:n]
        line, paragraph = first | (breaks > 0), first | (breaks > 1)
        unit = line | _upper_case(data[starts], data[np.minimum(starts + 1, max(len(data) - 1, 0))])
        unit[1:] |= _is_stop[data[ends[:-1] - 1]]
        of_unit, of_line, of_paragraph = (np.flatnonzero(x) for x in (unit, line, paragraph))
        stop = lambda x: np.append(x[1:], n) if len(x) else x
        lines = np.bincount(self.row[of_line], minlength=rows)
        least = np.where(lines > 1, BLOCK_WORDS, ALONE_WORDS)
        long = lambda x: stop(x) - x >= least[self.row[x]]
        many = np.searchsorted(of_line, stop(of_paragraph)) - np.searchsorted(of_line, of_paragraph) > 1
        kinds = [(of_unit, np.ones(len(of_unit), bool)), (of_line, long(of_line)), (of_paragraph, many & long(of_paragraph))]
        a, b = np.concatenate([x[ok] for x, ok in kinds]), np.concatenate([stop(x)[ok] for x, ok in kinds])
        kind = np.repeat(np.arange(3), [ok.sum() for _, ok in kinds])
        order = np.argsort(self.row[a], kind="stable") if n else np.zeros(0, np.int64)
        self.first, self.stop, self.kind = a[order], b[order], kind[order]
        self.is_unit = self.kind == 0
        self.part_bounds = np.searchsorted(self.row[self.first], np.arange(rows + 1)) if n else np.zeros(rows + 1, np.int64)

    def part_digests(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits and 32 more of the digest of each part's kind and words."""
        out = []
        for base, inverse, salt in ((_BASE, _INVERSE, 1), (_BASE_2, _INVERSE_2, 2)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes + np.uint64(salt)) * powers(max(1, len(self.hashes)), base)[: len(self.hashes)], dtype=np.uint64)])
            out.append(mix(_within(sums, self.first, self.stop, powers(len(self.hashes) + 1, inverse)) ^ (self.kind.astype(np.uint64) + np.uint64(11 * salt))))
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, whatever texts they are of."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words), _BASE), dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * powers(len(words) - n + 1, _INVERSE))


def _least_of(grams: np.ndarray) -> np.ndarray:
    """The least hash of GRAM words in each window."""
    n, width = WINDOW - GRAM + 1, 1
    while width < n:
        step = min(width, n - width)
        grams = np.minimum(grams[:-step], grams[step:])
        width += step
    return grams


def _anchors(p: Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: text, first window (a word of all words), number, the anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(p.hashes) < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    grams = _runs(p.hashes, GRAM)
    least = _least_of(grams)
    whole = p.row[: len(least)] == p.row[WINDOW - 1 :]
    # a window's anchor is another one than its left neighbour's where the hash differs, or the neighbour began with its anchor
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~whole[:-1]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(new[at])
    return p.row[at[first]], at[first], np.diff(np.append(first, len(at))), least[at[first]]


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _hashed(batches):
    """One row for each text: the digests of its parts and, without a check, its anchors."""
    for batch in batches:
        for rows, _, _ in slices(batch, most=SLICE):
            p = Parsed([t or "" for t in rows.column(2).to_pylist()])
            digest, check = p.part_digests()
            row, _, _, anchor = _anchors(p)
            n_parts, n_anchors = np.diff(p.part_bounds), np.bincount(row, minlength=rows.num_rows)
            every = np.concatenate([digest, anchor.view(np.int64)])[np.argsort(np.concatenate([np.repeat(np.arange(rows.num_rows), n_parts), row]), kind="stable")]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _lists(pa.array(every), n_parts + n_anchors), _lists(pa.array(check), n_parts)], ["doc_id", "text_key", "digest", "check"])


def _window_rows(batches):
    """The windows of each text whose anchors are among ``met``: a row for neighbours of one anchor, with their hashes."""
    for batch in batches:
        for rows, _, _ in slices(batch, most=SLICE):
            p = Parsed([t or "" for t in rows.column(2).to_pylist()], parts=False)
            row, first, n, anchor = _anchors(p)
            cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
            salts = np.zeros(len(row), np.int32)
            listed = rows.column(3)
            flat, offsets = listed.flatten(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
            met, among = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()
            for i in range(rows.num_rows):
                own, known = slice(cuts[i], cuts[i + 1]), met[offsets[i] : offsets[i + 1]]
                order = np.argsort(known)
                at = np.minimum(np.searchsorted(known, anchor[own], sorter=order), len(known) - 1)
                salts[own] = np.where(known[order][at] == anchor[own], among[offsets[i] : offsets[i + 1]][order][at], 0)
            if not (wanted := salts > 0).any():
                continue
            row, first, n, anchor, salts = (x[wanted] for x in (row, first, n, anchor, salts))
            # a text that repeats itself has one anchor again and again: such neighbours are one row, up to a length
            follows = np.zeros(len(row), bool)
            follows[1:] = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (first[1:] == first[:-1] + n[:-1])
            begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(row))))
            chunk = (first - first[begin]) // WINDOW
            new = np.flatnonzero(~follows | np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            row, first, n, anchor, salts = row[new], first[new], np.add.reduceat(n, new), anchor[new], salts[new]
            each = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(salts), rows.column(0).take(of), rows.column(1).take(of), pa.array((first - p.bounds[row]).astype(np.int32)), _lists(pa.array(_runs(p.hashes, WINDOW)[each].view(np.int64)), n)],
                ["anchor", "salts", "doc_id", "text_key", "at", "hashes"],
            )


def _whole_groups(batches, least_rows: int = 1 << 14):
    """Tables of whole (anchor, salt) groups, of a partition that is sorted by them; each of ``least_rows`` or more, but the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, least_rows):
            held.append(batch.slice(at, least_rows))
            if sum(b.num_rows for b in held) < least_rows:
                continue
            table = pa.Table.from_batches(held)
            anchor, salt = table.column("anchor").to_numpy(), table.column("salt").to_numpy()
            changes = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))
            if len(changes):  # the last group may go on
                yield table.slice(0, int(changes[-1]) + 1)
                held = table.slice(int(changes[-1]) + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


class _Windows:
    """The windows of some whole groups in order of rank, each with the first window that equals it."""

    def __init__(self, table: pa.Table):
        get = lambda c: table.column(c).combine_chunks()
        lists = get("hashes")
        self.digest, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        self.doc, self.key = get("doc_id"), get("text_key")
        self.row = np.repeat(np.arange(len(n)), n)
        self.at = get("at").to_numpy()[self.row].astype(np.int64) + np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        anchor, salt = (get(c).to_numpy()[self.row] for c in ("anchor", "salt"))
        order = np.lexsort((self.digest, salt, anchor))  # stable: of equals, the earliest rank comes first
        same = lambda x: x[order][1:] == x[order][:-1]
        new = np.ones(len(order), bool)
        new[1:] = ~(same(self.digest) & same(salt) & same(anchor))
        self.first = np.empty(len(order), np.int64)
        self.first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]


def _first_windows(batches):
    """The first window of each hash in each group."""
    for table in _whole_groups(batches):
        w = _Windows(table)
        k = np.unique(w.first)
        of = pa.array(w.row[k])
        anchor, salts = (table.column(c).combine_chunks().take(of) for c in ("anchor", "salts"))
        yield pa.RecordBatch.from_arrays([anchor, salts, pa.array(w.digest[k]), w.doc.take(of), w.key.take(of), pa.array(w.at[k].astype(np.int32))], ["anchor", "salts", "digest", "doc_id", "text_key", "at"])


def _later_windows(batches):
    """(doc_id, text_key, at, stop, from_doc): the words of windows that an earlier place holds; rows marked ``seed`` tell of such places only."""
    for table in _whole_groups(batches):
        w = _Windows(table)
        ids, missing, key = w.doc.fill_null(0).to_numpy(), w.doc.is_null().to_numpy(zero_copy_only=False), w.key.to_numpy()
        seed = table.column("seed").combine_chunks().to_numpy(zero_copy_only=False)
        row, source = w.row, w.row[w.first]
        own = (ids[row] == ids[source]) & (missing[row] == missing[source]) & (key[row] == key[source])
        start = np.where(own, np.maximum(w.at, w.at[w.first] + WINDOW), w.at)
        k = np.flatnonzero(~(own & (w.at == w.at[w.first])) & (start < w.at + WINDOW) & ~seed[row])
        if not len(k):
            continue
        # neighbours that are cut for one document's sake make one span
        goes_on = np.zeros(len(k), bool)
        same = lambda x: x[k][1:] == x[k][:-1]  # noqa: E731, B023
        goes_on[1:] = (w.at[k][1:] == w.at[k][:-1] + 1) & (start[k][1:] == start[k][:-1] + 1) & same(ids[row]) & same(missing[row]) & same(key[row]) & same(ids[source]) & same(missing[source])
        a = np.flatnonzero(~goes_on)
        b = np.append(a[1:], len(k)) - 1
        of = pa.array(row[k[a]])
        yield pa.RecordBatch.from_arrays([w.doc.take(of), w.key.take(of), pa.array(start[k[a]].astype(np.int32)), pa.array((w.at[k[b]] + WINDOW).astype(np.int32)), w.doc.take(pa.array(source[k[a]]))], ["doc_id", "text_key", "at", "stop", "from_doc"])


def _word_spans(p: Parsed, row: np.ndarray, at: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, stop, number of the copy that says so) of what goes: copied words, blocks, and runs of copied units of
    ``least`` words. The copies are of text ``row``, of its part ``at`` where ``stop`` is below 0, else of words."""
    of_part = np.flatnonzero(stop < 0)
    by = np.full(len(p.first), -1)
    by[p.part_bounds[row[of_part]] + at[of_part]] = of_part
    k = np.flatnonzero((by >= 0) & p.is_unit)
    goes_on = np.zeros(len(k), bool)
    goes_on[1:] = (k[1:] == k[:-1] + 1) & (p.row[p.first[k[1:]]] == p.row[p.first[k[:-1]]])
    begin = np.flatnonzero(~goes_on)
    a, b = p.first[k[begin]], p.stop[k[np.append(begin[1:], len(k)) - 1]] if len(k) else p.stop[k]
    enough = b - a >= least
    blocks = np.flatnonzero((by >= 0) & ~p.is_unit)
    words = np.flatnonzero(stop >= 0)
    base = p.bounds[row[words]]
    return np.concatenate([a[enough], p.first[blocks], base + at[words]]), np.concatenate([b[enough], p.stop[blocks], base + stop[words]]), np.concatenate([by[k[begin[enough]]], by[blocks], words])


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    parts: list[str] = []
    ends = [0, *(b for _, b in spans)]
    for a, b in zip(ends, [*(a for a, _ in spans), len(text)], strict=True):
        part = text[a:b]
        if not parts or parts[-1][-1].isspace():  # one space or line end of those on either side of a gap is enough
            part = part.lstrip(" \t")
        if part:
            parts.append(part)
    joined = "".join(parts)
    return joined if text[ends[-1] :].strip() else joined.rstrip()


def _cut(texts: list[str | None], copies: pa.Array, least: int) -> tuple[list[str | None], list[list[dict]]]:
    """The texts without copies, and the removed spans of each; such as overlap or touch are one."""
    p = Parsed([t or "" for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(copies.offsets.to_numpy()))
    flat = copies.flatten()
    at, stop, from_doc = flat.field("at").to_numpy(), flat.field("stop").fill_null(-1).to_numpy(), flat.field("from_doc")
    first, end, by = _word_spans(p, row, at, stop, least)
    order = np.lexsort((-end, first))
    first, end, kept_in = first[order], end[order], from_doc.take(pa.array(by[order])).to_pylist()
    removed: list[list[dict]] = [[] for _ in texts]
    spans: dict[int, list[list]] = {}
    for r, a, b, k in zip(p.row[first].tolist() if len(first) else [], first.tolist(), end.tolist(), kept_in, strict=True):
        found = spans.setdefault(r, [])
        if found and a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b, k])
    texts = list(texts)
    for r, found in spans.items():
        text, base = texts[r], p.bounds[r]
        if text.isascii():
            places = [(int(p.starts[a]), int(p.ends[b - 1])) for a, b, _ in found]
        else:
            words = [m.span() for m in _WORD.finditer(text)]
            places = [(words[a - base][0], words[b - 1 - base][1]) for a, b, _ in found]
        removed[r] = [{"start": a, "end": b, "kept_in": k} for (a, b), (_, _, k) in zip(places, found, strict=True)]
        texts[r] = _without(text, places)
    return texts, removed


def _is(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _copies(every: DataFrame, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_key, at, ...) whose ``same`` columns an earlier row has, with that one as ``first``; and the
    written table of the firsts, to be released."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "at")
    # written out, so that the join is one of two plain shuffles, whose hot keys adaptive execution splits
    first = stored(every.groupBy(*same).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*same, "first"))
    own = _is("doc_id", "first.doc_id") & _is("text_key", "first.text_key") & (F.col("at") == F.col("first.at"))
    return every.join(first, same).where(~own), first


def copied_places(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) -> (__doc, __of, __copies), a written table of the documents that have copies: those of its
    units and blocks (number ``at``, no ``stop``) and the words from ``at`` to ``stop`` that an earlier place holds, with
    that place's document. What the steps write between them is deleted as soon as nothing reads it."""
    hashed = stored(documents.select("doc_id", "text_key", "text").mapInArrow(_hashed, "doc_id long, text_key long, digest array<long>, check array<int>"))
    again = stored(hashed.select(F.explode("digest").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    every = hashed.select("doc_id", "text_key", F.posexplode(F.arrays_zip("digest", "check")).alias("at", "x")).select("doc_id", "text_key", "at", "x.digest", "x.check")
    met = stored(every.join(again, "digest"))
    release(hashed)
    release(again)
    swept(documents.sparkSession)
    unit_rows, first_units = _copies(met.where("check is not null"), ["digest", "check"])
    of_units = unit_rows.select("doc_id", "text_key", "at", F.lit(None).cast("int").alias("stop"), F.col("first.doc_id").alias("from_doc"))
    salts = F.ceil(F.col("n") / HOT).cast("int").alias("salts")
    anchors = met.where("check is null").groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__of")).agg(F.collect_set(F.struct("digest", salts)).alias("met"))
    anchors = stored(anchors)
    texts = documents.join(anchors, _is("doc_id", "__doc") & (F.col("text_key") == F.col("__of"))).select("doc_id", "text_key", "text", "met")
    found = stored(texts.mapInArrow(_window_rows, "anchor long, salts int, doc_id long, text_key long, at int, hashes array<long>"))
    release(anchors)
    swept(documents.sparkSession)
    rows = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("salts")).cast("int"))
    ranked = lambda df: df.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("doc_id").isNull(), "doc_id", "text_key", "at")
    # the first windows of a hot anchor's parts tell each other part where it isn't the first
    firsts = ranked(rows.where("salts > 1")).mapInArrow(_first_windows, "anchor long, salts int, digest long, doc_id long, text_key long, at int")
    shared = firsts.groupBy("anchor", "digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "at")).alias("first"), F.max("salts").alias("salts"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seeds = shared.select("anchor", "salts", "first.doc_id", "first.text_key", "first.at", F.array("digest").alias("hashes"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("seed"))
    later = stored(ranked(rows.withColumn("seed", F.lit(False)).unionByName(seeds)).mapInArrow(_later_windows, "doc_id long, text_key long, at int, stop int, from_doc long"))
    release(found)
    swept(documents.sparkSession)
    copies = of_units.unionByName(later).groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__of"))
    out = stored(copies.agg(F.collect_list(F.struct("at", "stop", "from_doc")).alias("__copies")))
    for table in (met, first_units, later):
        release(table)
    swept(documents.sparkSession)
    return out


def remove_copies(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Documents with ``text`` cut, and n_removed int, removed array<struct<start, end, kept_in>>: the original offsets
    of what went, and the document that keeps the first unit of it."""
    names = [c for c in documents.columns if c not in ("n_removed", "removed")]
    own = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(names)}  # no name of ours can clash
    plain = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()]).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", F.xxhash64("text"))

    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, copies in parts:
            out = [pa.array([], _CUT)]
            for rows, _, _ in slices(pa.record_batch([texts, copies], ["text", "copies"]), most=SLICE):
                kept, removed = _cut(rows.column(0).to_pylist(), rows.column(1), least)
                out.append(pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(removed, _SPANS)], fields=list(_CUT)))
            yield pa.concat_arrays(out)

    both = plain.join(copied_places(plain), _is("doc_id", "__doc") & (F.col("text_key") == F.col("__of")), "left")
    copied = F.col("__copies").isNotNull()
    # only texts with copies go through Python
    both = both.withColumn("__cut", F.arrow_udf(cut, _CUT_TYPE).asNondeterministic()(F.when(copied, F.col("text")), "__copies"))
    removed = F.when(copied, F.col("__cut.removed")).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, kept_in: bigint>>"))
    values = [F.when(copied, F.col("__cut.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(x).alias(c) for c, x in own.items()]
    return both.select(*values, F.size(removed).alias("n_removed"), removed.alias("removed"))


def query(spark, sf_dir):
    return remove_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
