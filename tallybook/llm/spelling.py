"""Grouping of spelling variants by an index of variable-length grams.

Words are framed by a start and an end mark. The gram dictionary holds every two-character gram of the words, and the
three- and four-character grams whose beginning is frequent: one in ``FREQUENT`` of all positions or more. A word is
decomposed into the longest dictionary gram at each position, without grams that lie inside an earlier one. Hence
frequent beginnings are told apart by longer grams, and rare ones stay short.

For each word the number of grams that one edit can affect is bounded: at every place, those that hold it, those before
it that the dictionary may lengthen across it, and those after it that a changed beginning may swallow. All other grams
stay, at the same place or one further. So a near word shares at least the remaining number of grams, and if both list
their grams from rare to frequent, they meet within the first ``number - remaining + 1`` of each. Only these go to the
lists, which are merged by (gram, place, length) and verified by edit distance. Words for which an edit can affect all
grams also list their halves, one of which any edit leaves alone, so no pair is lost.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import Scratch, ship

MIN_LENGTH = 6
MIN_COUNT = 5
# A form occurs at least this many times as often as the word.
RATIO = 5
# One occurrence in this many is misspelled by the rule of ``misspelled``.
MISSPELLED = 199

LEAST, MOST = 2, 4
# Grams of one length are frequent if they are more than one in this many: so there are fewer frequent ones than that.
FREQUENT = 2_000

# Distinct words a counting task holds, and words that are decomposed together.
HELD = 200_000
TOGETHER = 50_000

_START, _END = "\x01", "\x02"


def _run_table() -> bytes:
    """Latin-1 with A-Z in lower case and all but letters of runs made blank."""
    runs = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
    return bytes((b + 32 if b < 0x5B else b) if b in runs else 0x20 for b in range(256))


RUNS = _run_table()


def misspelled(doc_id: int | None, run: bytes) -> bytes:
    """The run as it counts in that document: one in ``MISSPELLED`` loses a character. A missing doc_id is empty text."""
    utf8 = run if run.isascii() else run.decode("latin-1").encode("utf-8")
    h = zlib.crc32(utf8, zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())))
    if h % MISSPELLED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` for words of at least ``MIN_LENGTH`` characters that occur ``MIN_COUNT`` times over all whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def rows():
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # All other characters, replaced or not, end a run.
                runs = (text.as_py() or "").encode("latin-1", "replace").translate(RUNS).split()
                # Equal runs of a document share their fate.
                for found, n in Counter([r for r in runs if len(r) >= MIN_LENGTH]).items():
                    word = misspelled(doc_id, found)
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return totals.filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))


class Framed(NamedTuple):
    """Some words, framed, one after the other; ``grams[k]`` are the grams of k characters at each place, -1 where they leave the word."""

    starts: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    grams: dict[int, np.ndarray]


def framed(words: list[str]) -> Framed:
    text = np.frombuffer("".join([_START + w + _END for w in words]).encode("latin-1"), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    place, code, grams = np.arange(len(text)), np.zeros(len(text), np.int64), {}
    for k in range(1, MOST + 1):
        code = (code << 8) | np.concatenate([text[k - 1 :], np.zeros(k - 1, np.int64)])
        grams[k] = np.where(place + k <= end, code, -1)
    return Framed(ends - sizes, begin, end, grams)


def gram_counts(words: DataFrame) -> DataFrame:
    """``length``, ``gram`` and ``n``: how often each gram occurs in the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _together(batches):
            found = framed(some[0])
            for k in range(LEAST, MOST + 1):
                grams, n = np.unique(found.grams[k][found.grams[k] >= 0], return_counts=True)
                columns = [pa.array(np.full(len(grams), k, np.int32)), pa.array(grams), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["length", "gram", "n"])

    counted = words.select("word", "n").mapInArrow(run, "length int, gram long, n long")
    return counted.groupBy("length", "gram").agg(F.sum("n").alias("n"))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    words, counts = [], []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts += batch.column(1).to_pylist()
        if len(words) >= TOGETHER:
            yield words, counts
            words, counts = [], []
    if words:
        yield words, counts


class GramDictionary:
    """Grams by length with their counts; ``starts`` and ``insides`` are what longer ones begin with, and hold further on."""

    def __init__(self, lengths: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = {}, {}
        for k in range(LEAST, MOST + 1):
            own = lengths == k
            order = np.argsort(grams[own])
            self.grams[k], self.counts[k] = grams[own][order], counts[own][order]
        self.starts = {k: np.unique(self.grams[k + 1] >> 8) for k in range(LEAST, MOST)}
        self.insides = {}
        for k in range(LEAST, MOST):
            held = [
                (self.grams[length] >> (8 * (length - k - at))) & ((1 << (8 * k)) - 1)
                for length in range(k + 1, MOST + 1)
                for at in range(1, length - k + 1)
            ]
            self.insides[k] = np.unique(np.concatenate(held))

    def decompose(self, found: Framed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and lengths of the grams that decompose the words; for each word their number, and the most that one edit affects."""
        place = np.arange(len(found.begin))
        length = np.where(found.grams[LEAST] >= 0, LEAST, 0)
        for k in range(LEAST + 1, MOST + 1):
            length = np.where(np.isin(found.grams[k], self.grams[k]), k, length)
        after = place + length
        reached = np.concatenate([[0], np.maximum.accumulate(after)[:-1]])
        kept = np.flatnonzero((length > 0) & (after > reached))

        # An edit at place i affects a gram if lo <= i <= hi. To the right: as far as this or an earlier gram may be
        # lengthened. To the left: as far as a changed gram there may come to hold all of this one.
        lengthened = np.ones(len(place), np.int64)
        for k in self.starts:
            lengthened = np.where(np.isin(found.grams[k], self.starts[k]), k, lengthened)
        hi = np.maximum(after - 1, np.minimum(np.maximum.accumulate(place + lengthened), found.end - 1))[kept]
        lo, stop, begin = kept.copy(), after[kept], found.begin[kept]
        for k, insides in self.insides.items():
            at = stop - k
            fits = (k >= length[kept]) & (at >= begin)
            fits[fits] = np.isin(found.grams[k][at[fits]], insides)
            lo = np.where(fits, np.minimum(lo, at - 1), lo)
        lo = np.maximum(lo, begin)

        size = len(place)
        affected = np.cumsum(np.bincount(lo, minlength=size + 1) - np.bincount(hi + 1, minlength=size + 1))[:size]
        number = np.add.reduceat(np.bincount(kept, minlength=size), found.starts)
        return kept, length[kept], number, np.maximum.reduceat(affected, found.starts)

    def lists(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each entry of the lists: number of its word, gram, and place in the word."""
        found = framed(words)
        kept, lengths, number, affected = self.decompose(found)
        gram, count = np.empty(len(kept), np.int64), np.empty(len(kept), np.int64)
        for k in self.grams:
            own = lengths == k
            gram[own] = found.grams[k][kept[own]]
            count[own] = self.counts[k][np.searchsorted(self.grams[k], gram[own])]
        word = np.searchsorted(found.starts, kept, "right") - 1
        order = np.lexsort((kept, gram, count, word))
        rank = np.arange(len(kept)) - (np.cumsum(number) - number)[word]  # grams of a word lie together, before and after ordering
        remaining = number - affected
        listed = order[rank < (number - np.maximum(remaining, 1) + 1)[word]]
        word, gram, place = word[listed], gram[listed], (kept - found.begin[kept])[listed]
        halves = [(i, *half) for i in np.flatnonzero(remaining < 1).tolist() for half in _halves(words[i])]
        if halves:
            more = np.array(halves, np.int64).T
            word, gram, place = (np.concatenate(x) for x in zip((word, gram, place), more))
        return word, gram, place


def _halves(word: str) -> list[tuple[int, int]]:
    """Gram and place of a word's halves: at place 0 its own, at place 1 those of a near word that is one shorter."""
    out = []
    for place in (0, 1):
        size = len(word) - place
        first, rest = word[: size // 2], word[len(word) - (size - size // 2) :]
        out += [(-1 - 2 * zlib.crc32(first.encode()), place), (-2 - 2 * zlib.crc32(rest.encode()), place)]
    return out


def gram_dictionary(words: DataFrame, scratch: Scratch) -> GramDictionary:
    """The pruned dictionary of the distinct words.

    At most ``FREQUENT`` grams of a length are frequent and have as many successors as there are letters, so the
    dictionary has fewer than 400,000 grams, whatever the size of the corpus.
    """
    counts = scratch.keep(gram_counts(words), "grams")
    positions = counts.filter(F.col("length") == LEAST).agg(F.sum("n")).first()[0] or 0
    frequent = counts.filter((F.col("length") < MOST) & (F.col("n") * FREQUENT > positions))
    frequent = frequent.select(F.col("gram").alias("start"), (F.col("length") + 1).alias("of_length"))
    begins = (F.col("start") == F.shiftright("gram", 8)) & (F.col("of_length") == F.col("length"))
    longer = counts.filter(F.col("length") > LEAST).join(frequent, begins, "left_semi")
    pruned = counts.filter(F.col("length") == LEAST).unionByName(longer).toPandas()
    return GramDictionary(pruned["length"].to_numpy(), pruned["gram"].to_numpy(np.int64), pruned["n"].to_numpy(np.int64))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs (``small``, ``small_n``, ``word``, ``n``) of words one inserted, deleted or replaced character apart, each once.

    ``words`` has ``word`` and ``n``, one row a word, in Latin-1. ``small`` is the shorter word, or the smaller of equal length.
    """
    spark = words.sparkSession
    ship(spark)
    dictionary = spark.sparkContext.broadcast(gram_dictionary(words, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, counts in _together(batches):
            word, gram, place = dictionary.value.lists(some)
            columns = [pa.array(some).take(pa.array(word)), pa.array(np.array(counts, np.int64)[word])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gram), pa.array(place.astype(np.int32))], names=["word", "n", "gram", "place"])

    entries = words.select("word", "n").mapInArrow(run, "word string, n long, gram long, place int")
    lists = scratch.keep(entries.withColumn("length", F.length("word")), "lists")
    # A shorter word's gram lies in a longer one at the same place, or one further.
    wanted = F.explode(
        F.array(
            F.struct("length", "place"),
            F.struct((F.col("length") + 1).alias("length"), "place"),
            F.struct((F.col("length") + 1).alias("length"), (F.col("place") + 1).alias("place")),
        )
    )
    probes = lists.select(F.col("word").alias("small"), F.col("n").alias("small_n"), F.col("gram").alias("_gram"), wanted.alias("_at"))
    probes = probes.select("small", "small_n", "_gram", F.col("_at.length").alias("_length"), F.col("_at.place").alias("_place"))
    meet = (F.col("gram") == F.col("_gram")) & (F.col("length") == F.col("_length")) & (F.col("place") == F.col("_place"))
    once = (F.length("small") < F.col("length")) | (F.col("small") < F.col("word"))
    near = F.levenshtein("small", "word", 1) == 1
    pairs = probes.join(lists, meet & once & near).select("small", "small_n", "word", "n")
    return pairs.distinct()


def roots(links: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """``word`` and ``root``: where following ``form`` from a word ends. ``links`` has ``word`` and ``form``.

    A form is ``RATIO`` times as frequent as its word and no word occurs more than ``most`` times, which bounds the
    length of a chain, and doubling the steps each round reaches its end.
    """
    followed = scratch.keep(links.select("word", F.col("form").alias("root")), "forms")
    steps = max(1, math.ceil(math.log(max(most, 1) / MIN_COUNT + 1, RATIO)))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = followed.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        doubled = followed.join(ahead, F.col("root") == F.col("_at"), "left")
        followed = scratch.keep(doubled.select("word", F.coalesce("_next", "root").alias("root")), "forms")
    return followed


def spelling_forms(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of ``docs`` (doc_id, text, any other columns).

    Null and empty texts have no words, a text of any length is read whole, repeated rows count again, and an empty
    table gives no rows. Of near words equally frequent, the first in code-point order is the form.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs), "words")
    pairs = scratch.keep(near_words(words, scratch), "pairs")
    both = pairs.select(F.col("small").alias("_word"), F.struct((-F.col("n")).alias("n"), "word").alias("_near")).unionByName(
        pairs.select(F.col("word").alias("_word"), F.struct((-F.col("small_n")).alias("n"), F.col("small").alias("word")).alias("_near"))
    )
    # A word has at most 91 near words for each of its places, and they are combined before they move.
    near = both.groupBy("_word").agg(F.count(F.lit(1)).alias("n_near"), F.min("_near").alias("_first"))
    known = words.join(near, F.col("word") == F.col("_word"), "left")
    has_form = -F.col("_first.n") >= RATIO * F.col("n")
    known = known.select(
        "word",
        F.when(has_form, F.col("_first.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, -F.col("_first.n")).alias("form_n"),
    )
    known = scratch.keep(known, "known")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(known.filter(F.col("form").isNotNull()), most, scratch).withColumnRenamed("word", "_of")
    found = known.join(ends, F.col("word") == F.col("_of"), "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
