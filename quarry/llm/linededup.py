"""Operator 2: near-duplicate lines by a segment-partition edit join.

A line is a piece of text between line feeds, without blanks at its ends; empty
lines are not compared and always stay. Equal lines of any length, and lines
within the character edits (insert, delete, substitute) that the shorter one's
length allows, form classes (linked directly or through others): 1 edit from SHORT
characters, 2 from MIDDLE, a hundredth of the characters from LONG. The first occurrence of a class, by (doc_id,
line number), stays; later ones go.

Method. With t edits, one of t + 1 segments of the shorter line must occur
unchanged in the longer one, within the few positions that the edits to its left
and right allow. Every distinct line indexes its t + 1 segments under (length,
segment number, content), and probes the substrings that could match a segment
of a line up to t shorter. The probes grow with the cube of t, so lines of LONG
characters or more, compared by length, meet otherwise: of the longer one at
least (length - t) / (t + 1) characters in a row, never fewer than 75, are
unchanged. Of every WINDOW neighbouring spans of GRAM characters (together 75)
the one of smallest hash is a key, so a common run gives a common key. Lines
that share a bucket are verified with a banded bit-parallel edit distance, a column
of all pairs of a batch at a time.

Scale. Documents are cut into lines in Arrow batches and lines travel as 64-bit
hashes, of which equal ones are one candidate (a CRC tells lines apart whose hashes
meet by chance). Index keys are aggregated, and the members
of a bucket meet its best connected line first (``graph.bucket_components``), so
variants of one template cost one comparison each; what is left of a bucket is
compared in bounded blocks. Only lines that share a
bucket have their text fetched: a bounded Bloom filter cuts the scan, an exact
join follows. Members of open buckets are compared by how often 64 classes of
characters occur in them (counted once a line); a pair that is left is given by the smallest
key that it shares, as far as each line's LOW smallest keys tell, made distinct and
verified once, however many buckets it shares. First occurrences are pre-aggregated minima joined back only for
classes that repeat.

Defined cases: null texts are unchanged and have no lines; rows with a null
doc_id are unchanged and count for nothing; repeated rows of one doc_id hold the
same first occurrences and stay alike; ties go to the smaller (doc_id, line); a
line of any length is compared whole; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import common as C
from .graph import blocked, bucket_components, map_pairs

SHORT, MIDDLE, LONG = 20, 40, 300
CLASSES = 64  # of characters, for the counts that two near lines nearly share
WORD = 63  # diagonals of a band that fit a machine word
GRAM, WINDOW = 32, 44
BLOCK = 256  # members of one bucket that meet in one block
LOW = 16  # smallest keys by which a bucket tells that a pair meets in another one
_CHARS = 1 << 18  # characters hashed at a time
_SEEN = 1 << 18  # line hashes a task remembers so as not to emit a repeated line again


_ODD = 0x9E3779B97F4A7C15
_POW = _INV = np.ones(1, np.uint64)


class Runs:
    """Hashes of any run of characters, equal for equal runs: what lines are looked up by, never what makes them equal."""

    def __init__(self, codes: np.ndarray):
        global _POW, _INV
        if len(codes) > len(_POW):
            size = max(2 * len(codes), _CHARS)
            _POW, _INV = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
                          for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + C.U64(1)) * C.U64(0xD6E8FEB86659FD93) * _POW[:len(codes)], out=self.sums[1:])

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return C.mix((self.sums[e] - self.sums[s]) * _INV[s])

    def every(self, n: int) -> np.ndarray:
        """A value for the n characters from each position on."""
        return (self.sums[n:] - self.sums[:-n]) * _INV[:len(self.sums) - n]


class Lines:
    """The non-empty lines of a run of documents, as spans of their code points."""

    def __init__(self, rows: np.ndarray, texts: list[str]):
        sizes = np.array([len(t) for t in texts])
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(self.codes == 10)
        start = np.concatenate([[0], breaks + 1])
        end = np.concatenate([breaks, [len(self.codes)]])
        first = np.cumsum(sizes + 1) - sizes - 1  # where each document begins
        doc = np.searchsorted(first, start, "right") - 1
        pos = np.arange(len(start)) - np.searchsorted(start, first)[doc]
        while len(start):  # blanks at the ends, a character a round
            blank = (start < end) & np.isin(self.codes[np.minimum(start, len(self.codes) - 1)], (32, 9, 13))
            if not blank.any():
                break
            start = start + blank
        while len(end):
            blank = (start < end) & np.isin(self.codes[np.maximum(end - 1, 0)], (32, 9, 13))
            if not blank.any():
                break
            end = end - blank
        some = start < end
        self.start, self.end, self.row, self.pos = start[some], end[some], rows[doc[some]], pos[some]
        raw = memoryview(self.codes.tobytes())
        self.h = np.frombuffer(b"".join(hashlib.blake2b(raw[4 * a:4 * b], digest_size=8).digest() for a, b in
                                        zip(self.start.tolist(), self.end.tolist())), np.uint64)

    def checks(self) -> np.ndarray:
        """A CRC of each line, to tell apart lines whose hashes meet by chance."""
        return np.array([zlib.crc32(self.codes[a:b]) for a, b in zip(self.start.tolist(), self.end.tolist())], np.uint32)

    def counts(self, i: int) -> bytes:
        """How often each class of code points occurs (255: or more); an edit changes at most two counts by one."""
        found = np.bincount(self.codes[self.start[i]:self.end[i]] & (CLASSES - 1), minlength=CLASSES)
        return np.minimum(found, 255).astype(np.uint8).tobytes()

    def text(self, i: int) -> str:
        return self.codes[self.start[i]:self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def line_runs(batch: pa.RecordBatch):
    """Lines of the batch's documents, some _CHARS characters at a time."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        rows.append(i)
        texts.append(t)
        size += len(t)
        if size > _CHARS:
            yield Lines(np.array(rows), texts)
            rows, texts, size = [], [], 0
    if rows:
        yield Lines(np.array(rows), texts)


def _known(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, h, crc): every non-empty line, by number and hash."""
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for ls in line_runs(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids[ls.row]), pa.array(ls.pos.astype(np.int32)), pa.array(ls.h.view(np.int64)),
                                                  pa.array(ls.checks().view(np.int32))], names=["doc_id", "pos", "h", "crc"])

    return _known(docs).mapInArrow(run, "doc_id long, pos int, h long, crc int")


def allowed(size: np.ndarray) -> np.ndarray:
    """Edits that lines of these lengths are linked at; 0 where only equal lines are."""
    return np.select([size < SHORT, size < MIDDLE, size < LONG], [0, 1, 2], size // 100)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(difference in length, segment, shift) of the substrings to probe, less a line's own segments."""
    out = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(-edits, edits + 1):
                if abs(shift) <= i and abs(shift - delta) <= edits - i and (delta or shift):
                    out.append((delta, i, shift))
    return out


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of these lengths; the last ones take what is left over."""
    base, rest = length // parts, length % parts
    longer_before = np.maximum(0, i - (parts - rest))
    return base * i + longer_before, base + (i >= parts - rest)


def segment_keys(hashes: Runs, start: np.ndarray, size: np.ndarray, own: bool):
    """(key, line) of the own segments of lines, or of the substrings that could match those of a shorter or equal line."""
    keys, lines = [], []
    for t in (1, 2):
        for delta, i, shift in [(0, i, 0) for i in range(t + 1)] if own else probes(t):
            length = size - delta
            at, n = segment(length, i, t + 1)
            at = at + shift
            ok = np.flatnonzero((length < LONG) & (allowed(length) == t) & (at >= 0) & (at + n <= size))
            s = (start + at)[ok]
            keys.append(hashes.span(s, s + n[ok]) ^ C.mix(length[ok].astype(np.uint64) * C.U64(16) + C.U64(i)))
            lines.append(ok)
    k, line = run_keys(hashes, start, size, own)
    keys.append(k)
    lines.append(line)
    return np.concatenate(keys), np.concatenate(lines)


def run_keys(hashes: Runs, start: np.ndarray, size: np.ndarray, own: bool):
    """(key, line) of lines from LONG characters on: the smallest hash of each window, under the class of
    their length (own) or, where a shorter line they may be linked to has another class, under that one."""
    of = lambda n: np.floor(np.log(n) * 4)
    least = size - size // 100
    if own:
        line = np.flatnonzero(size >= LONG)
    else:
        line = np.flatnonzero((size >= LONG) & (of(np.maximum(least, 1)) != of(np.maximum(size, 1))))
    if not len(line):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    line = line[np.argsort(start[line], kind="stable")]
    low = hashes.every(GRAM)
    width = 1
    while width < WINDOW:  # smallest of ever more neighbours
        step = min(width, WINDOW - width)
        low[:-step] = np.minimum(low[:-step], low[step:])
        width += step
    edge = np.zeros(len(low) + 1, np.int8)  # where windows lie inside one of the lines
    np.add.at(edge, start[line], 1)
    np.add.at(edge, (start + size)[line] - GRAM - WINDOW + 2, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
    keep = np.flatnonzero(new)
    line = line[np.searchsorted(start[line], keep, "right") - 1]
    kind = of((size if own else least)[line]).astype(np.uint64)
    return C.mix(low[keep]) ^ C.mix(kind * C.U64(16) + C.U64(15)), line


def _fresh(ls: Lines, seen: set[int], least: int) -> np.ndarray:
    """Lines of at least so many characters that the task has not met of late."""
    _, first = np.unique(ls.h, return_index=True)
    new = [i for i in first[(ls.end - ls.start)[first] >= least].tolist() if int(ls.h[i]) not in seen]
    if len(seen) > _SEEN:
        seen.clear()
    seen.update(ls.h[new].tolist())
    return np.array(new, np.int64)


def _members(docs: DataFrame, centers_only: bool) -> DataFrame:
    """(key, id, center): a line's own segments (centers) and, unless centers_only, its probes."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for ls in line_runs(b):
                new, runs = _fresh(ls, seen, SHORT), Runs(ls.codes)
                for own in (True,) if centers_only else (True, False):
                    k, line = segment_keys(runs, ls.start[new], (ls.end - ls.start)[new], own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k.view(np.int64)), pa.array(ls.h[new[line]].view(np.int64)), pa.array(np.full(len(k), own))],
                        names=["key", "id", "center"])

    return _known(docs).select("text").mapInArrow(run, "key long, id long, center boolean")


def within(a: str, b: str, edits: int) -> bool:
    """Edit distance at most ``edits``: a band of 2 * edits + 1 diagonals, one machine word per column."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    lo, hi = 0, len(a)  # equal ends cost nothing: only the middle is compared
    step = 64
    while lo < hi and a[lo:lo + step] == b[lo:lo + step] and lo + step <= hi:
        lo += step
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    back = 0
    while back + step <= hi - lo and a[len(a) - back - step:len(a) - back] == b[len(b) - back - step:len(b) - back]:
        back += step
    while back < hi - lo and a[len(a) - back - 1] == b[len(b) - back - 1]:
        back += 1
    a, b = a[lo:len(a) - back], b[lo:len(b) - back]
    m, n = len(a), len(b)
    if not m:
        return n <= edits
    width = 2 * edits + 1
    full = (1 << width) - 1
    window: dict[str, int] = {}  # character -> bits of its rows in the band, bit k is row j - edits + k
    for k in range(edits, width):
        if k - edits < m:
            window[a[k - edits]] = window.get(a[k - edits], 0) | 1 << k
    vp, vn = full << edits & full, 0
    bottom, middle = edits, 0
    for j in range(1, n + 1):
        pm = window.get(b[j - 1], 0)
        d0 = ((pm & vp) + vp ^ vp | pm | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, hp & d0 >> 1
        bottom += 1 - (d0 >> width - 1 & 1)
        middle += 1 - (d0 >> edits & 1)
        if middle > 2 * edits:  # every cell of the band is within `edits` of the middle one
            return False
        # the band moves down a row
        window = {c: bits >> 1 for c, bits in window.items() if bits > 1}
        if j + edits < m:
            c = a[j + edits]
            window[c] = window.get(c, 0) | 1 << width - 1
    k0 = edits - (n - m)
    mask = (1 << width - 1 - k0) - 1
    return bottom - (vp >> k0 & mask).bit_count() + (vn >> k0 & mask).bit_count() <= edits


def _band(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, edits: int) -> np.ndarray:
    """``within`` for rows of code points (a not longer than b, b's lengths ascending), a machine word a row: 2 * edits < WORD."""
    one, width = np.uint64(1), 2 * edits + 1
    full, top, mid = np.uint64((1 << width) - 1), np.uint64(width - 1), np.uint64(edits)
    # by column: row i of a stands at i + edits, between signs that no line has
    rows = np.full((b.shape[1] + width, len(a)), np.uint32(0xFFFFFFFF))
    rows[edits:edits + a.shape[1]] = np.where(np.arange(a.shape[1])[:, None] < na, a.T, np.uint32(0xFFFFFFFF))
    cols = np.ascontiguousarray(b.T)
    out, at = np.zeros(len(a), bool), np.arange(len(a))
    vp, vn = np.full(len(a), full << mid & full), np.zeros(len(a), np.uint64)
    bottom, middle = np.full(len(a), edits, np.int64), np.zeros(len(a), np.int64)
    first, j, base = 0, 0, 0  # pairs before `first` have ended; rows and cols begin at column `base`
    while first < len(at):
        upto = int(np.searchsorted(nb, j, "right"))
        if upto > first:  # the last column of these: from the band's bottom up to the last row
            x = slice(first, upto)
            k0 = (edits - (nb[x] - na[x])).astype(np.uint64)
            mask = (one << (top - k0)) - one
            out[at[x]] = (bottom[x] - np.bitwise_count(vp[x] >> k0 & mask).astype(np.int64)
                          + np.bitwise_count(vn[x] >> k0 & mask).astype(np.int64)) <= edits
            first = upto
        if j % 16 == 0 and first < len(at):  # every cell of a band is within `edits` of its middle one
            keep = np.flatnonzero(middle[first:] <= 2 * edits) + first
            if 2 * len(keep) < len(at) - first:
                rows, cols = rows[j - base:, keep], cols[j - base:, keep]
                at, na, nb, vp, vn, bottom, middle = (v[keep] for v in (at, na, nb, vp, vn, bottom, middle))
                first, base = 0, j
        if first == len(at):
            break
        c, p, n = cols[j - base, first:], vp[first:], vn[first:]
        pm = np.zeros(len(c), np.uint64)
        for k in range(width):
            pm |= (rows[j - base + k, first:] == c).astype(np.uint64) << np.uint64(k)
        d0 = ((pm & p) + p ^ p | pm | n) & full
        hp, hn = (n | ~(d0 | p)) & full, d0 & p
        vp[first:], vn[first:] = (hn | ~(d0 >> one | hp)) & full, hp & d0 >> one
        bottom[first:] += 1 - (d0 >> top & one).astype(np.int64)
        middle[first:] += 1 - (d0 >> mid & one).astype(np.int64)
        j += 1
    return out


def near_pairs(x: list[str], y: list[str]) -> np.ndarray:
    """Whether each two lines are within the edits that the shorter one's length allows."""
    x, y = zip(*((a, b) if len(a) <= len(b) else (b, a) for a, b in zip(x, y))) if x else ((), ())
    na, nb = (np.array([len(t) for t in side], np.int64) for side in (x, y))
    most = allowed(na)
    out = np.zeros(len(na), bool)
    order = np.lexsort((nb, most))
    order = order[(nb - na <= most)[order] & (most[order] > 0)]
    lo = 0
    while lo < len(order):  # runs of one number of edits, of like length, of bounded size
        hi, t = lo + 1, int(most[order[lo]])
        while hi < len(order) and most[order[hi]] == t and (hi - lo) * nb[order[hi]] < 4 * _CHARS:
            hi += 1
        at, lo = order[lo:hi], hi
        if 2 * t >= WORD or len(at) < 2 * t + 20:  # wide bands, and pairs too few for the steps of a column to pay
            out[at] = [within(x[i], y[i], t) for i in at.tolist()]
            continue
        sides = []
        for side, n in ((x, na), (y, nb)):
            codes = np.zeros((len(at), int(n[at].max())), np.uint32)
            codes[np.arange(codes.shape[1]) < n[at][:, None]] = np.frombuffer(
                "".join(side[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
            sides += [codes, n[at]]
        out[at] = _band(*sides, t)
    return out


def line_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, line, n, counts) of the lines of ids(h): a bounded Bloom filter over the scan, then an exact join."""
    words = docs.sparkSession.sparkContext.broadcast(bloom.build(ids, "h"))

    def run(batches):
        for b in batches:
            for ls in line_runs(b):
                _, first = np.unique(ls.h, return_index=True)
                size = ls.end - ls.start
                maybe = first[(size >= SHORT)[first] & bloom.contains(ls.h[first].view(np.int64), words.value)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ls.h[maybe].view(np.int64)), pa.array([ls.text(i) for i in maybe], pa.string()),
                     pa.array(size[maybe].astype(np.int32)), pa.array([ls.counts(i) for i in maybe], pa.binary())],
                    names=["h", "line", "n", "counts"])

    return (_known(docs).select("text").mapInArrow(run, "h long, line string, n int, counts binary")
            .join(ids, "h", "left_semi").dropDuplicates(["h"]))


def counts_near(cx: np.ndarray, cy: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether rows of class counts allow so many edits."""
    return np.abs(cx.astype(np.int16) - cy.astype(np.int16)).sum(axis=1) <= 2 * most


def _class_counts(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, CLASSES)


def _near(x: pa.Array, y: pa.Array, nx: pa.Array, ny: pa.Array, cx: pa.Array, cy: pa.Array) -> pa.Array:
    nx, ny = nx.to_numpy(), ny.to_numpy()
    most = allowed(np.minimum(nx, ny))
    out = np.zeros(len(x), bool)
    at = np.flatnonzero((np.abs(nx - ny) <= most) & counts_near(_class_counts(cx), _class_counts(cy), most))
    out[at] = near_pairs(x.take(pa.array(at)).to_pylist(), y.take(pa.array(at)).to_pylist())
    return pa.array(out, pa.bool_())


_near.__annotations__ = dict.fromkeys(("x", "y", "nx", "ny", "cx", "cy", "return"), pa.Array)


def _low_keys(left: DataFrame) -> DataFrame:
    """(id, low): the smallest open keys of each member, with whether it is a center there."""
    return left.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("key", "center"))), 1, LOW).alias("low"))


def _low_matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each row, LOW wide, and whether the row is a center there."""
    at, flat = col.offsets.to_numpy(), col.flatten()
    size = np.diff(at)
    there = np.arange(LOW) < size[:, None]
    keys, center = np.full(there.shape, np.iinfo(np.int64).max), np.zeros(there.shape, bool)
    keys[there] = flat.field("key").to_numpy()
    center[there] = flat.field("center").to_numpy(zero_copy_only=False)
    return keys, center


def met_before(key: np.ndarray, kx: np.ndarray, cx: np.ndarray, ky: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Whether rows of smallest keys share one below ``key`` at which either row is a center."""
    same = (kx[:, :, None] == ky[:, None, :]) & (cx[:, :, None] | cy[:, None, :]) & (kx < key[:, None])[:, :, None]
    return same.any(axis=(1, 2))


def _block_pairs(left: DataFrame, text: DataFrame) -> DataFrame:
    """(a, b): members of one bucket in different components that their lengths and counts do not tell apart.

    A pair is given by the smallest key that it shares, as far as the LOW smallest keys of each tell.
    """
    own = text.select(F.col("h").alias("id"), "n", "counts").join(_low_keys(left), "id")
    dealt = blocked(left, BLOCK).join(own, "id")

    def pairs(rows: pa.RecordBatch, x: np.ndarray, y: np.ndarray):
        ids, center = rows.column("id").to_numpy(), rows.column("center").to_numpy(zero_copy_only=False)
        size = rows.column("n").to_numpy()
        most = allowed(np.minimum(size[x], size[y]))
        ok = (center[x] | center[y]) & (np.abs(size[x] - size[y]) <= most)
        x, y, most = x[ok], y[ok], most[ok]
        count = _class_counts(rows.column("counts"))
        ok = counts_near(count[x], count[y], most)
        x, y = x[ok], y[ok]
        keys, at = _low_matrix(rows.column("low"))
        ok = ~met_before(rows.column("key").to_numpy()[x], keys[x], at[x], keys[y], at[y])
        return ids[x[ok]], ids[y[ok]]

    return map_pairs(dealt, pairs)


def line_classes(docs: DataFrame) -> DataFrame:
    """(id, component) of the line hashes that are linked to a different line."""
    found = {}

    def prepare(ids: DataFrame):
        text = found["text"] = C.pin(line_texts(docs, C.pin(ids.select(F.col("id").alias("h")))))
        x = text.select(F.col("h").alias("a"), F.col("line").alias("la"), F.col("n").alias("na"), F.col("counts").alias("ca"))
        y = text.select(F.col("h").alias("b"), F.col("line").alias("lb"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
        near = F.arrow_udf(_near, returnType="boolean")("la", "lb", "na", "nb", "ca", "cb")
        return lambda pairs: pairs.join(x, "a").join(y, "b").where(near).select("a", "b")

    def rest(left: DataFrame, star: DataFrame, verify) -> DataFrame:
        return verify(C.pin(_block_pairs(left, found["text"]).join(star, ["a", "b"], "left_anti")))

    return bucket_components(_members(docs, False), _members(docs, True), prepare, rest)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, first_doc): every line occurrence that goes, and the document that holds its first."""
    comp = line_classes(docs)
    occ = C.pin(occurrences(docs).join(comp, F.col("h") == F.col("id"), "left").select(
        "doc_id", "pos", "h", "crc", F.coalesce("component", "h").alias("class")))
    at = F.struct("doc_id", "pos")
    lines = C.pin(occ.groupBy("h", "class").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min("crc").alias("c0"), F.max("crc").alias("c1")))
    met = C.pin(lines.where("c0 <> c1").select("h"))
    if not met.isEmpty():  # different lines of one hash: each is a class of its own with the lines equal to it
        occ = C.pin(occ.join(met.withColumn("met", F.lit(True)), "h", "left").withColumn(
            "class", F.when(F.col("met"), F.xxhash64("h", "crc")).otherwise(F.col("class"))).drop("met"))
        lines = occ.groupBy("class").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    first = (lines.groupBy("class").agg(F.min("first").alias("first"), F.max("last").alias("last"))
             .where("first <> last").select("class", "first"))
    return (occ.join(first, "class").where(at != F.col("first"))
            .select("doc_id", "pos", F.col("first.doc_id").alias("first_doc")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, first_docs): per document, its lines, those that go, where they first occur."""
    n = docs.select("doc_id", F.when(F.col("doc_id").isNull() | F.col("text").isNull(), 0).otherwise(
        F.size(F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")) != ""))).cast("long").alias("n_lines"))
    gone = repeats(docs).distinct().groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("n_removed"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    return n.join(gone, n.doc_id == gone._id, "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"))


def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(text.to_pylist(), gone.to_pylist()):
        if t is not None and g:
            drop = set(g)
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
        out.append(t)
    return pa.array(out, pa.string())


_without.__annotations__ = {"text": pa.Array, "gone": pa.Array, "return": pa.Array}


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs (all columns) with repeated lines cut from text; a document of which no line is left goes.

    n_chars, where the table has it, is brought up to date for changed texts.
    """
    own = ["doc_id", "text"] + (["n_chars"] if "n_chars" in docs.columns else [])
    gone = repeats(docs).distinct().groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("pos").alias("gone"))
    j = C.packed(docs, own).join(gone, F.col("doc_id").cast("long") == F.col("id"), "left")
    j = j.withColumn("text", F.when(F.col("gone").isNotNull(), F.arrow_udf(_without, returnType="string")("text", "gone"))
                     .otherwise(F.col("text")))
    j = j.where(F.col("gone").isNull() | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.when(F.col("gone").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))
                         .otherwise(F.col("n_chars")))
    return C.unpacked(j, docs.columns, own)


@C.query("op2_line_dedup")
def op2(spark, sf_dir):
    """Every document: its lines, how many go, and the documents that hold their first occurrences."""
    return report(C.table(spark, sf_dir, "documents"))
