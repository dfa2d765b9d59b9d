"""Frequent contiguous phrases by Toivonen's sampling, and their collocation scores.

1. A sample of the texts proposes phrases at a lowered threshold.
2. One pass over all documents counts the proposals and their negative border: every phrase
   whose two longest parts (without its last and without its first word) are proposed. The
   border needs no list, a task sees it where it occurs.
3. If a border phrase is frequent it was missed by the sample, and phrases built on it were
   not counted. An expansion pass counts every phrase around it: each is followed up to the
   full length where it occurs, although its own count is not known yet, so that one pass
   closes what would else take one for every further word. Then every frequent phrase has
   been counted: the smallest uncounted one would have two counted, frequent parts, not both
   proposed, and would have been counted around the one that was not.
4. Those passes count by 64-bit hash, which can only put phrases together, so what reaches the
   threshold includes all that do by themselves. A last pass counts these as text, exactly.

Sets of phrases reach the tasks as Bloom filters of bounded size. A false positive adds a
phrase to a border or to the last pass; it can cost time but change no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import Tokens, byte_class, string_hashes, tokens_of
from .tasks import importable, outlive, scratch, small, stage
from .text import chunks, mix

#: Bytes of text that are counted together before the shuffle, and rows a task sends on at once.
BLOCK_BYTES, SEND_ROWS = 2 << 20, 1 << 15
#: One in so many stretches of so many words is sampled; a phrase is proposed at this share of its expected threshold.
SAMPLE, STRETCH, MARGIN = 8, 64, 0.5
#: Bits a filter has for each phrase, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
PROBES = 3

_CUTS = byte_class([(0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
_INSIDE = ~(_CUTS | byte_class([(0x20, 0x20), (0x09, 0x09)]))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its words but the last, and of the last."""
    return mix(prefix * _STEP + word)


class PhraseFilter:
    """A Bloom filter of phrases; ``bits`` is the bit array in 64-bit words."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word of the bit array, bit in it) of each probe."""
        for k in range(PROBES):
            p = mix(h + np.uint64(k)) % np.uint64(words * 64)
            yield (p >> np.uint64(6)).astype(np.int64), p & np.uint64(63)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for word, bit in self.places(h, len(self.bits)):
            found &= (self.bits[word] >> bit) & np.uint64(1) > 0
        return found


def _first_hash(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word ^ mix(lang + _STEP))


def make_filter(hashes: DataFrame) -> PhraseFilter:
    """A filter of the staged column ``h`` of phrase hashes, of at most ``MOST_BITS`` bits."""
    words = max(1, min(hashes.count() * BITS_EACH, MOST_BITS) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, bit in PhraseFilter.places(b.column("h").to_numpy().view(np.uint64), words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], ["word", "mask"])

    rows = hashes.select("h").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return PhraseFilter(bits)


def _without(found: DataFrame, known: object) -> DataFrame:
    """Rows whose hash the broadcast filter ``known`` does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~known.value.has(b.column("h").to_numpy().view(np.uint64))))

    return found.mapInArrow(run, found.schema)


def _sampled(tokens: Tokens, pick: np.ndarray, one_in: int) -> tuple[Tokens, np.ndarray]:
    """The words of one in so many stretches, and each one's document. Parts of a document are drawn
    by themselves, so phrases that one document repeats are found as well as those of many."""
    doc = np.repeat(np.arange(len(pick)), tokens.counts)
    place = np.arange(len(doc)) - tokens.first[doc]
    stretch = place // STRETCH
    on = mix(pick.view(np.uint64)[doc] + mix(stretch.astype(np.uint64))) % np.uint64(one_in) == 0
    cut = tokens.cut | (place % STRETCH == 0)
    return Tokens(tokens.words.filter(pa.array(on)), tokens.first, cut[on]), doc[on]


def _texts(langs: pa.Array, words: pa.Array, lang_at: np.ndarray, word_at: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, k, n) of phrases that are given by their words' places in the dictionary."""
    for a in range(0, len(n), SEND_ROWS):
        on = slice(a, a + SEND_ROWS)
        parts = [words.take(pa.array(x[on])) for x in word_at]
        phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type))
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(lang_at[on])), phrase.cast(pa.string()),
             pa.array(np.full(len(phrase), len(parts), np.int32)), pa.array(n[on])], ["lang", "phrase", "k", "n"])


def _hashed(h: np.ndarray, k: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (h, k, n)."""
    for a in range(0, len(n), SEND_ROWS):
        on = slice(a, a + SEND_ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[on].view(np.int64)), pa.array(np.full(len(n[on]), k, np.int32)), pa.array(n[on])], ["h", "k", "n"])


def _count(
        within: object | None, longest: int, single: bool = False, new: object | None = None, local: int = 0,
        sample: int = 0, texts: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of blocks: phrases whose longest parts are in the filter ``within``, by hash.

    ``single`` adds single words. With ``new``, only phrases around one in that filter are
    counted, and those that hold one are followed to the full length without being in
    ``within``. With ``local``, only words are looked up; longer parts have to occur so often
    in the block. With ``sample``, one in so many stretches is counted, by a column ``pick``.
    With ``texts``, the phrases in ``within`` themselves are counted, as (lang, phrase, k, n),
    and all words of a language as its empty phrase.
    """

    def block(c: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(c.column("text"), _INSIDE, _CUTS)
        doc = np.repeat(np.arange(c.num_rows), tokens.counts)
        if sample:
            tokens, doc = _sampled(tokens, c.column("pick").to_numpy(), sample)
        if not len(tokens.words):
            return
        coded = tokens.words.dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        coded = c.column("lang").cast(pa.string()).fill_null("und").dictionary_encode()
        langs = coded.dictionary
        lang_of = coded.indices.to_numpy().astype(np.int64)[doc]
        key = lang_of * len(words) + word
        many = np.bincount(key, minlength=len(langs) * len(words))
        used = np.flatnonzero(many)
        dense = np.zeros(len(many), np.int64)
        dense[used] = np.arange(len(used))
        # the number of the phrase that begins at each token of ``at``, and the hash of each number
        first = _first_hash(string_hashes(words)[used % len(words)], string_hashes(langs)[used // len(words)])
        ident, h, hit, at = dense[key], first, many[used], np.arange(len(word))
        word_hash = first[ident]
        around = np.zeros(len(first), bool)
        if texts:
            n = np.bincount(lang_of, minlength=len(langs))
            yield pa.RecordBatch.from_arrays(
                [langs, pa.array([""] * len(langs)), pa.array(np.zeros(len(langs), np.int32)), pa.array(n)], ["lang", "phrase", "k", "n"])
            on = within.value.has(h)
            yield from _texts(langs, words, used[on] // len(words), [used[on] % len(words)], hit[on])
        elif single:
            yield from _hashed(h, 1, hit)
        for k in range(2, longest + 1):
            usable = within.value.has(h) | around if not local or k == 2 else hit >= local
            fresh = new.value.has(h) | around if new is not None else np.ones(len(h), bool)
            ok = np.zeros(len(word) + 1, bool)
            ok[at] = usable[ident[at]]
            begin = at[ok[at] & ok[at + 1]]
            if k == 2:
                begin = begin[~tokens.cut[begin + 1]]
            if not len(begin):
                return
            a, b = ident[begin], ident[begin + 1]
            coded = pa.array(a * len(h) + b).dictionary_encode()
            own = coded.indices.to_numpy().astype(np.int64)
            pair = coded.dictionary.to_numpy()
            a, b = pair // len(h), pair % len(h)
            hit = np.bincount(own, minlength=len(pair))
            shown = np.empty(len(pair), np.int64)
            shown[own[::-1]] = begin[::-1]
            h = _longer(h[a], word_hash[shown + k - 1])
            if texts:
                on = np.flatnonzero(within.value.has(h))
                yield from _texts(langs, words, lang_of[shown[on]], [word[shown[on] + j] for j in range(k)], hit[on])
            else:
                on = fresh[a] | fresh[b]
                yield from _hashed(h[on], k, hit[on])
            around = (fresh[a] | fresh[b]) & (new is not None)
            ident = np.full(len(word), -1, np.int64)
            ident[begin] = own
            at = begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives a block's memory back, the usual pool keeps it
        for b in batches:
            for c in chunks(b, limit=BLOCK_BYTES):
                yield from block(c)

    return run


def _often(docs: DataFrame, least: int, run: Callable) -> DataFrame:
    """Hashes that occur ``least`` times and more over all of ``docs``: h, k, n."""
    return docs.mapInArrow(run, "h bigint, k int, n bigint").groupBy("h").agg(
        F.max("k").alias("k"), F.sum("n").alias("n")).where(F.col("n") >= least)


def _propose(docs: DataFrame, least: int, longest: int, sample: int) -> DataFrame:
    """Phrases that a sample of one in ``sample`` stretches of the texts suggests."""
    part = docs.select("text", "lang", F.xxhash64("doc_id").alias("pick"))
    low = max(2, int(least * MARGIN / sample))
    words = stage(_often(part, low, _count(None, 1, single=True, sample=sample)), "sample-words")
    if longest < 2:
        return words
    known = docs.sparkSession.sparkContext.broadcast(make_filter(words))
    return stage(words.union(_often(part, low, _count(known, longest, local=2, sample=sample))), "proposed")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """All phrases of 1 to ``longest`` words that occur at least ``least`` times in a language.

    Returns a staged table (lang, phrase, k words, n occurrences), in which the empty phrase
    has a language's word count, and the number of passes that counted by hash.
    """
    spark = docs.sparkSession
    importable(spark)
    send = spark.sparkContext.broadcast
    every = docs.select("text", "lang")
    proposed = send(make_filter(_propose(docs, least, longest, sample)))
    often = stage(_often(every, least, _count(proposed, longest, single=True)), "often")
    new = stage(_without(often, proposed), "border-failures")
    passes = 1
    while new.where(F.col("k") < longest).limit(1).count():
        known, fresh = send(make_filter(often)), send(make_filter(new))
        around = stage(_often(every, least, _count(known, longest, new=fresh)), "around")
        passes += 1
        often = stage(often.union(around).dropDuplicates(["h"]), "often")
        # all that holds a phrase of ``new`` was followed to the full length: only words could be left, and all were counted
        new = around.where("k = 1")
    counted = every.mapInArrow(_count(send(make_filter(often)), longest, texts=True), "lang string, phrase string, k int, n bigint")
    exact = counted.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("n").alias("n"))
    return stage(exact.where((F.col("n") >= least) | (F.col("k") == 0)), "frequent"), passes


def _scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Each candidate's lowest-scoring cut: lang, phrase, a, l, r, n, score."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(
        F.broadcast(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    both = both.withColumn("top", top.cast("decimal(38,0)")).withColumn("low", (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = both.withColumn("score", F.expr("CAST(top div low AS bigint)")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def _not_contained(scored: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Phrases that no longer candidate contains with ``percent`` of their occurrences or more."""
    words = F.split("phrase", " ")
    inner = F.expr("""
        flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))""")
    held = (
        candidates.where("k > 2").withColumn("words", words)
        .select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    joined = scored.join(held, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (100 * wide("longer") < percent * wide("a"))).drop("longer")


def _first(rows: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of each language, cut down in salted groups before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top)


def mine_collocations(
        docs: DataFrame, least: int = 100, longest: int = 5, contained: int = 100, top: int = 2000, sample: int = SAMPLE) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words is a candidate if it occurs at least ``least`` times
    (a). Its score is the lowest floor(1000 a n / (l r)) over its cuts, with the counts l and
    r of the two parts and the language's word count n; ties go to the shortest first part. A
    candidate goes if a longer candidate that contains it has at least ``contained`` percent
    of its occurrences. Order: score and a descending, then the phrase's bytes.

    Null texts count as empty, a null lang as ``und``; repeated rows count each. An empty
    table, or one without candidates, gives no rows. Columns but doc_id (for the sample),
    text and lang are not read.
    """
    with scratch(docs.sparkSession):
        frequent, _ = frequent_phrases(docs, least, longest, sample)
        candidates = frequent.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
        counts = small(frequent.where("k > 0").select("lang", "phrase", "n"), frequent)
        totals = frequent.where("k = 0").select("lang", "n")  # a row a language
        scored = _not_contained(_scored(candidates, counts, totals), candidates, contained)
        return outlive(_first(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, range(1, 6) ks(k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.n AS l, y.n AS r, totals.n AS n,
         CAST((1000::HUGEINT * a * totals.n) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
  JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT DISTINCT lang, a AS longer, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM c, range(2, 5) ms(m), range(1, 5) st(i) WHERE m < k AND i + m - 1 <= k),
held AS (SELECT lang, phrase, max(longer) AS longer FROM inner_phrases GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN held USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""
