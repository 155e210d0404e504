r"""Operator 13: phrase collocation mining by dynamic itemset counting.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\x0A-\x0D]` and those
into words `[^\x20\x09]+`. Everything is per lang (null: `und`). f(phrase) is the
number of its contiguous occurrences within pieces, overlaps included. Phrases of
2 to ``longest`` words with f >= ``least`` are candidates; each of their cuts
scores floor(1000000 * f * f / (f(first part) * f(rest))), and the lowest cut
counts (ties: the earliest). A candidate goes when one that is longer contains
its words contiguously and has at least half of its occurrences. The first
``top`` of each lang by score, f and phrase stay.

Method. Documents are dealt to SHARDS shards that are scanned in a cycle, one
step each. Words are counted from step 0 on. When at the end of a step a phrase
has reached ``least`` so far, it is told; a longer phrase becomes active at the
step after both of its subphrases (all but the last word, all but the first) are
told, whatever shard is next, and is counted for one full cycle, that is once in
every shard. So lengths interleave, and counts are exact when a cycle closes. Told
phrases travel as Bloom filters, one for each step and length: the step at which
a phrase becomes active is read off the first filters that hold its subphrases. A
false positive only lets a phrase be counted that stays below ``least``.

Scale. Texts are hashed once: a shard holds an array of word keys for each document,
whose lowest bit says that the next word goes on in the same piece. Counts are summed in the task (numpy), by partial aggregation, and only
then shuffled; phrases below ``least`` leave when their cycle closes, and the
many phrases of rare words are never counted. What is broadcast are filters of at
most ``bloom.MAX_BLOCKS`` blocks. Phrases travel as 64-bit hashes of (lang, words):
at 10^12 distinct phrases one of 2,000 reported ones meets another's hash with
probability 10^-4. Parts are looked up by equi-joins; a lang's ranking is cut to
``top`` (and ties) in salted groups before it meets in one, and only what is left is named.

Defined cases: null and empty texts have no words; repeated rows and null ids
count like all others; a null lang and the lang `und` are one; langs without
candidates have no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from . import common as C

LEAST, LONGEST, TOP = 10, 3, 2000
SHARDS = 3
SALTS = 64
HELD = 1 << 20  # phrase occurrences that a task sums at a time
_BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_BYTES = C.byte_class(lambda b: b not in _BREAKS + b" \t")
BREAK_BYTES = C.byte_class(lambda b: b in _BREAKS)
NEVER = np.iinfo(np.int32).max


def word_keys(text: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, row, start, end, bytes) of all words of a batch: 63 bits of the hash of (lang, word), and one bit
    that is set where the next word goes on in the same piece."""
    data, off = C.text_bytes(text)
    words, row, start, end = C.word_hashes(data, off, WORD_BYTES, spans=True)
    key = C.mix(words ^ C.mix(lang.view(np.uint64)[row])) & ~C.U64(1)
    if len(key) > 1:
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(BREAK_BYTES[data], out=breaks[1:])
        key[:-1] |= ((row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])).astype(np.uint64)
    return key, row, start, end, data


def longer(prefix: np.ndarray, word: np.ndarray, m: int) -> np.ndarray:
    """Hashes of phrases of m words from those without their last word, and that word."""
    return C.mix(prefix * C.U64(31) + word + C.U64(m))


def phrase_keys(keys: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1: the words at which a phrase inside one piece begins, and their hashes."""
    word, goes_on = keys & ~C.U64(1), (keys & C.U64(1)).astype(bool)
    at, out = np.arange(len(keys)), [(np.arange(len(keys)), word)]
    for m in range(2, longest + 1):
        on = goes_on[at + m - 2]
        at = at[on]
        out.append((at, longer(out[-1][1][on], word[at + m - 1], m)))
    return out


def told_at(keys: np.ndarray, filters: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The step from which each phrase counts as told: that of the first filter that holds it."""
    out = np.full(len(keys), NEVER, np.int32)
    open_ = np.arange(len(keys))
    for step, words in filters:
        hit = bloom.contains(keys[open_].view(np.int64), words)
        out[open_[hit]] = step
        open_ = open_[~hit]
    return out


def active(keys: np.ndarray, step: int, shards: int, longest: int, told: dict[int, list]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{m: (hashes, since)}: the phrases of a run of word keys that are counted at this step."""
    word, goes_on = keys & ~C.U64(1), (keys & C.U64(1)).astype(bool)
    out = {1: (word, np.zeros(len(word), np.int32))} if step < shards else {}
    at, key, hashes = np.arange(len(keys)), word, word
    distinct, back = np.unique(word, return_inverse=True)  # words repeat: each is looked up once
    since = told_at(distinct, told[1])[back]
    for m in range(2, longest + 1):
        # since: the step from which the phrase of m - 1 words at ``at`` is told; a longer one needs two of them
        every = np.full(len(keys) + 1, NEVER, np.int32)
        every[at] = since
        on = goes_on[at + m - 2] & (since < NEVER) & (every[at + 1] < NEVER)
        at, hashes, since = at[on], hashes[on], np.maximum(since[on], every[at[on] + 1])
        hashes = longer(hashes, key[at + m - 1], m)
        now = (since <= step) & (since > step - shards)
        out[m] = hashes[now], since[now]
        if m < longest:  # never before its own parts, as a false positive of an early filter would have it
            since = np.maximum(told_at(hashes, told[m]), since)
    return out


def _scan(shard: DataFrame, step: int, shards: int, longest: int, told: dict[int, list]) -> DataFrame:
    """(m, key, since, n, told): how often the active phrases of each length occur in this shard."""
    shared = shard.sparkSession.sparkContext.broadcast({m: list(fs) for m, fs in told.items()})

    def sums(m: int, parts: list) -> pa.RecordBatch:
        keys, since = (np.concatenate(x) for x in zip(*parts))
        k, at, n = np.unique(keys, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k), m, np.int32)), pa.array(k.view(np.int64)), pa.array(since[at]), pa.array(n)], names=["m", "key", "since", "n"])

    def run(batches):
        held: dict[int, list] = {m: [] for m in range(1, longest + 1)}
        size = dict.fromkeys(held, 0)
        for b in batches:
            keys = b.column("keys").flatten().to_numpy().view(np.uint64)
            if not len(keys):
                continue
            for m, found in active(keys, step, shards, longest, shared.value).items():
                held[m].append(found)
                size[m] += len(found[0])
                if size[m] >= HELD:
                    yield sums(m, held[m])
                    held[m], size[m] = [], 0
        for m, parts in held.items():
            if size[m]:
                yield sums(m, parts)

    return shard.select("keys").mapInArrow(run, "m int, key long, since int, n long").withColumn("told", F.lit(False))


def _with_lang(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").withColumn("lang_key", F.xxhash64("lang"))


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """(lang_key, keys, shard): the word keys of every document, written by shard."""
    def run(batches):
        for b in batches:
            lang = b.column("lang_key")
            keys, row, *_ = word_keys(b.column("text"), lang.to_numpy())
            off = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([lang, pa.ListArray.from_arrays(off, pa.array(keys.view(np.int64)))], names=["lang_key", "keys"])

    path = C.scratch_path(docs.sparkSession, "shards")
    (_with_lang(docs).select("text", "lang_key").mapInArrow(run, "lang_key long, keys array<long>")
     .withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path))
    return docs.sparkSession.read.schema("lang_key long, keys array<long>, shard int").parquet(path)


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(phrases, dealt): (m, key, n) of every phrase of 1 to longest words with n >= least, and the shards."""
    dealt = _dealt(docs, shards)
    told: dict[int, list] = {m: [] for m in range(1, longest)}
    seen: dict[int, int] = dict.fromkeys(told, -1)  # the last step at whose end phrases of a length were told
    open_, closed, step = None, None, 0
    while step < shards or any(step - last <= shards for last in seen.values() if last >= 0):
        new = _scan(dealt.where(F.col("shard") == step % shards), step, shards, longest, told)
        total = (new if open_ is None else open_.unionByName(new)).groupBy("m", "key", "since").agg(
            F.sum("n").alias("n"), F.bool_or("told").alias("told"))
        over = F.col("since") + shards - 1 <= step
        total = C.pin(total.where(~over | (F.col("n") >= least)))
        for m in told:
            fresh = total.where((F.col("m") == m) & (F.col("n") >= least) & ~F.col("told"))
            if not fresh.isEmpty():
                told[m].append((step + 1, bloom.build(fresh, "key")))
                seen[m] = step
        done = total.where(over).select("m", "key", "n")
        closed = done if closed is None else closed.unionByName(done)
        open_ = total.where(~over).withColumn("told", F.col("n") >= least)
        step += 1
    return closed, dealt


def _places(dealt: DataFrame, candidates: DataFrame, longest: int, shards: int) -> DataFrame:
    """(m, key, n, lang_key, words) of the candidates (m, key, n): the hashes of their words, from one place where they stand.

    Shard by shard, for those that no shard before had: a frequent phrase is in the first one already.
    """
    def found(shard: DataFrame, wanted: DataFrame) -> DataFrame:
        filter_ = shard.sparkSession.sparkContext.broadcast(bloom.build(wanted, "key"))

        def distinct(m: int, parts: list) -> pa.RecordBatch:
            k, lang, words = (np.concatenate(x) for x in zip(*parts))
            k, first = np.unique(k, return_index=True)
            words = pa.FixedSizeListArray.from_arrays(pa.array(words[first].ravel().view(np.int64)), m).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(lang[first]), words], names=["key", "lang_key", "words"])

        def run(batches):
            held: dict[int, list] = {m: [] for m in range(2, longest + 1)}
            size = dict.fromkeys(held, 0)
            for b in batches:
                col = b.column("keys")
                keys = col.flatten().to_numpy().view(np.uint64)
                lang = np.repeat(b.column("lang_key").to_numpy(), np.diff(col.offsets.to_numpy()))
                for m, (at, hashes) in enumerate(phrase_keys(keys, longest)[1:], 2):
                    on = bloom.contains(hashes.view(np.int64), filter_.value)
                    k, first = np.unique(hashes[on], return_index=True)
                    at = at[on][first]
                    held[m].append((k, lang[at], (keys & ~C.U64(1))[at[:, None] + np.arange(m)]))
                    size[m] += len(k)
                    if size[m] >= HELD:
                        yield distinct(m, held[m])
                        held[m], size[m] = [], 0
            for m, parts in held.items():
                if size[m]:
                    yield distinct(m, parts)

        rows = shard.select("lang_key", "keys").mapInArrow(run, "key long, lang_key long, words array<long>")
        return C.pin(rows.join(wanted, "key").dropDuplicates(["key"]).select("m", "key", "n", "lang_key", "words"))

    out = None
    for i in range(shards):
        if candidates.isEmpty():
            break
        got = found(dealt.where(F.col("shard") == i), candidates)
        out = got if out is None else out.unionByName(got)
        candidates = C.pin(candidates.join(got, "key", "left_anti"))
    return out


def _with_parts(placed: DataFrame) -> DataFrame:
    """placed with the hashes of all parts of each phrase: cuts [(k, left, right)] and inner [parts of 2 words or more]."""
    def run(batches):
        for b in batches:
            m = b.column("m").to_numpy()
            for size in np.unique(m).tolist():
                rows = b.filter(pa.array(m == size))
                words = rows.column("words").flatten().to_numpy().view(np.uint64).reshape(-1, size)
                part = {}  # (first word, words) -> hashes
                for i in range(size):
                    key = part[i, 1] = words[:, i]
                    for n in range(2, size - i + 1):
                        key = part[i, n] = longer(key, words[:, i + n - 1], n)
                count = rows.num_rows
                cuts = pa.StructArray.from_arrays([
                    pa.array(np.tile(np.arange(1, size, dtype=np.int32), count)),
                    pa.array(np.stack([part[0, k] for k in range(1, size)], axis=1).ravel().view(np.int64)),
                    pa.array(np.stack([part[k, size - k] for k in range(1, size)], axis=1).ravel().view(np.int64))], names=["k", "left", "right"])
                inner = [part[i, n] for n in range(2, size) for i in range(size - n + 1)]
                inner = np.stack(inner, axis=1).ravel().view(np.int64) if inner else np.zeros(0, np.int64)
                lists = lambda v: pa.ListArray.from_arrays(
                    pa.array(np.arange(count + 1, dtype=np.int32) * (len(v) // max(1, count))), v if isinstance(v, pa.Array) else pa.array(v))
                yield pa.RecordBatch.from_arrays([*rows.drop_columns(["words"]).columns, lists(cuts), lists(inner)],
                                                 names=["m", "key", "n", "lang_key", "cuts", "inner"])

    return placed.mapInArrow(run, "m int, key long, n long, lang_key long, cuts array<struct<k:int,left:long,right:long>>, inner array<long>")


def _named(docs: DataFrame, chosen: DataFrame, longest: int) -> DataFrame:
    """(key, lang, phrase) of the chosen phrases (key): a Bloom filter over the texts, then an exact join."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom.build(chosen, "key"))

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            keys, row, start, end, data = word_keys(b.column("text"), b.column("lang_key").to_numpy())
            out = []
            for m, (at, hashes) in enumerate(phrase_keys(keys, longest)[1:], 2):
                on = bloom.contains(hashes.view(np.int64), filter_.value)
                k, first = np.unique(hashes[on], return_index=True)
                new = [(x, int(i)) for x, i in zip(k.view(np.int64).tolist(), at[on][first].tolist()) if x not in seen]
                out += [(x, int(row[i]), b" ".join(C._LOWER[data[start[j]:end[j]]].tobytes() for j in range(i, i + m)).decode()) for x, i in new]
                if len(seen) > HELD:
                    seen.clear()
                seen.update(x for x, _ in new)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in out], pa.int64()), b.column("lang").take(pa.array([r for _, r, _ in out], pa.int64())),
                 pa.array([t for _, _, t in out], pa.string())], names=["key", "lang", "phrase"])

    return (_with_lang(docs).mapInArrow(run, "key long, lang string, phrase string").join(chosen.select("key"), "key", "left_semi")
            .groupBy("key").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase")))


def score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)) in exact integers: at most 1000000, its products up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    return F.expr(f"(1000000 * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})").cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every lang."""
    counted, dealt = counts(docs, least, longest, shards)
    counted = C.pin(counted)
    placed = _places(dealt, counted.where("m > 1"), longest, shards)
    if placed is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    parts = C.pin(_with_parts(placed))
    f = counted.select(F.col("key").alias("part"), F.col("n").alias("f"))
    cuts = parts.select("key", F.col("n").alias("a"), F.explode("cuts").alias("cut")).select("key", "a", "cut.*")
    cuts = cuts.join(f.withColumnsRenamed({"part": "left", "f": "l"}), "left").join(f.withColumnsRenamed({"part": "right", "f": "r"}), "right")
    best = cuts.groupBy("key").agg(F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("best"))
    longer_ = parts.select(F.explode("inner").alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    rows = (parts.join(best, "key").join(longer_, "key", "left").where("longer is null or 100 * longer < 50 * n")
            .select("lang_key", "key", F.col("n").alias("a"), "best.l", "best.r", "best.score"))
    # the best of each lang, with all that tie with the last of them; then their names decide
    order = [F.desc("score"), F.desc("a")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    rows = rows.withColumn("at", F.rank().over(Window.partitionBy("lang_key", "salt").orderBy(*order))).where(F.col("at") <= top)
    rows = C.pin(rows.withColumn("at", F.rank().over(Window.partitionBy("lang_key").orderBy(*order))).where(F.col("at") <= top).drop("at", "salt"))
    rows = rows.join(_named(docs, rows, longest), "key")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang_key").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    words = dealt.groupBy("lang_key").agg(F.sum(F.size("keys")).cast("long").alias("words"))
    return ranked.join(words, "lang_key").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
o AS (SELECT lang, unnest(range(1, 4)) AS m, ws, i FROM w),
f AS (SELECT lang, m, ws[i:i + m - 1] AS g, count(*)::HUGEINT AS n FROM o WHERE i + m - 1 <= len(ws) GROUP BY ALL),
c AS (SELECT * FROM f WHERE m > 1 AND n >= 10),
k AS (SELECT lang, m, g, n AS a, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.*, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n * y.n) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
t AS (
  SELECT lang, g, max(n) AS longer FROM (
    SELECT lang, g[1:2] AS g, n FROM c WHERE m = 3 UNION ALL SELECT lang, g[2:3], n FROM c WHERE m = 3) GROUP BY ALL),
n AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
q AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN t ON t.lang = b.lang AND t.g = b.g
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM q JOIN n USING (lang) QUALIFY rank <= 2000
"""


@C.query("op13_collocations", SQL)
def op13(spark, sf_dir):
    """The 2,000 strongest phrases of two or three words in every language, over all documents."""
    return collocations(C.table(spark, sf_dir, "documents"))
