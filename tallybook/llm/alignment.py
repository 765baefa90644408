"""Alignment of two tokenizers' tokens: byte-level BPE (A) and sentence pieces (B), over the same bytes.

Tokens of both sides are byte ranges of one blank and the text. Every token points to the token farthest to the right
that it overlaps: an A token to the B token that holds its last byte, if that ends later, and a B token to the A token
that holds its last byte. Pointers lead right, and end at the A token where both sides end together. Doubling them
(``succ = succ[succ]``) over all texts of a batch at once brings each token to its group's last A token in as many
steps as the longest chain has binary digits. That token labels the group.

An A and a B token that end together are linked. Links are counted over the whole corpus: tasks cut their documents
into blocks of about ``BLOCK_LINKS`` links and emit each block's distinct id pairs with their numbers; Spark sums them,
finds the highest count of every B id, and joins the sums back to the blocks, where each document adds up its links. So
what is shuffled is the distinct pairs of each block, not the links. The blocks are stored before, and so is their work.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm import byte_bpe
from tallybook.llm.common import Scratch, held, ship

# Links whose distinct pairs are emitted together, and the most documents of a block.
BLOCK_LINKS = 2_000_000
BLOCK_DOCS = 50_000
# Characters that are aligned together, and pairs in one row of a block.
BATCH_CHARS = 500_000
PAIRS_IN_ROW = 20_000


class Aligned(NamedTuple):
    """Tokens of some texts, one text after the other. Ends are positions after the last token."""

    a: np.ndarray
    b: np.ndarray
    text_a_ends: np.ndarray
    text_b_ends: np.ndarray
    group_a_ends: np.ndarray
    group_b_ends: np.ndarray
    text_group_ends: np.ndarray


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a = byte_bpe.ByteBpe(byte_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_lengths = np.array([len(self.a.token_bytes.get(i, b"")) for i in range(max(self.a.token_bytes) + 1)])
        self.b_lengths = np.array([len(self._piece_bytes(i)) for i in range(self.b.get_piece_size())])
        # Ids as text with the sign that follows them: within a side, and after its last token of a group.
        self.signed = np.array(
            [f"{i}{s}" for i in range(len(self.a_lengths)) for s in ",|"]
            + [f"{i}{s}" for i in range(len(self.b_lengths)) for s in ",;"],
            dtype=object,
        )

    def _piece_bytes(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""  # they spell nothing, so a text with one of them is not reproduced
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where the text is empty or the bytes of a side are not blank and text.

        Byte-level BPE spells any text. Pieces spell the model's normal form with U+2581 for blanks, byte by byte.
        """
        none = np.zeros(0, np.int64)
        all_a, all_b = [], []
        for text, form, pieces in zip(texts, self.b.normalize(texts), self.b.encode(texts, num_threads=1)):
            b = np.array(pieces, np.int64)
            # A text with U+2581 has a normal form of that kind, too, but its pieces spell blanks there.
            same = bool(text) and "▁" not in text and form == "▁" + text.replace(" ", "▁")
            if same and not self.b_lengths[b].all():
                same = False
            all_a.append(self.a.encode(" " + text).astype(np.int64) if same else none)
            all_b.append(b if same else none)
        return all_a, all_b

    def align(self, texts: list[str]) -> Aligned:
        of_a, of_b = self.tokens(texts)
        a, b = np.concatenate([*of_a, np.zeros(0, np.int64)]), np.concatenate([*of_b, np.zeros(0, np.int64)])
        text_a_ends, text_b_ends = (np.cumsum([len(x) for x in side], dtype=np.int64) for side in (of_a, of_b))
        group_a_ends, group_b_ends = groups(np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b]))
        return Aligned(a, b, text_a_ends, text_b_ends, group_a_ends, group_b_ends, np.searchsorted(group_a_ends, text_a_ends, "right"))

    def spelled(self, x: Aligned) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids of its groups in order."""
        n_a, n_b = len(x.a), len(x.b)
        sizes_a, sizes_b = np.diff(x.group_a_ends, prepend=0), np.diff(x.group_b_ends, prepend=0)
        # A group's A tokens come after all B tokens of groups before, its B tokens after its A tokens.
        at_a = np.arange(n_a) + np.repeat(x.group_b_ends - sizes_b, sizes_a)
        at_b = np.arange(n_b) + np.repeat(x.group_a_ends, sizes_b)
        codes = np.empty(n_a + n_b, np.int64)
        codes[at_a] = x.a * 2
        codes[at_b] = (x.b + len(self.a_lengths)) * 2
        codes[x.group_a_ends - 1 + x.group_b_ends - sizes_b] += 1
        codes[x.group_b_ends - 1 + x.group_a_ends] += 1
        ends = (x.text_a_ends + x.text_b_ends).tolist()
        return ["".join(self.signed[codes[i:j]].tolist())[:-1] for i, j in zip([0, *ends], ends)]


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after the last A and B token of every group, from the rising byte ends of both sides' tokens."""
    n_a = len(a_ends)
    if not n_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_bytes = int(a_ends[-1])
    # The B token that holds an A token's last byte is the one after all that end before it; and the other way round.
    over_a = np.cumsum(np.bincount(b_ends, minlength=n_bytes + 1))[a_ends - 1]
    over_b = np.cumsum(np.bincount(a_ends, minlength=n_bytes + 1))[b_ends - 1]
    itself = np.arange(n_a)
    succ = np.concatenate([np.where(b_ends[over_a] > a_ends, n_a + over_a, itself), over_b])
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            break
        succ = further
    labels = succ[:n_a]
    last = np.flatnonzero(labels == itself)  # every group's label
    return last + 1, over_a[last] + 1


def loaded(byte_path: str, piece_path: str) -> Aligner:
    """This Python worker's tokenizers."""
    return held(("alignment", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, some ``BATCH_CHARS`` at a time."""
    doc_ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids.append(doc_id)
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= BATCH_CHARS or len(texts) >= 2000:
                yield doc_ids, texts
                doc_ids, texts, chars = [], [], 0
    if texts:
        yield doc_ids, texts


def aligned_groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id and ``groups``, a list of (``a``: ids, ``b``: ids), for every row of ``docs`` (doc_id, text, any other columns).

    Paths are the same on every machine. Texts that are null, empty, or that a side does not reproduce byte by byte
    have no groups. Repeated rows each get theirs; an empty table gives no rows; a text of any length is aligned whole.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(byte_path, piece_path)
        for doc_ids, texts in _batches(batches):
            x = aligner.align(texts)
            pairs = pa.StructArray.from_arrays([_lists(x.a, x.group_a_ends), _lists(x.b, x.group_b_ends)], ["a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), _lists(pairs, x.text_group_ends)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def _lists(values, ends: np.ndarray) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


DOC_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
BLOCK_SCHEMA = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, "
    "pairs array<long>, counts array<long>"
)


class Blocks:
    """Rows of one task: a row for each document, whose links are places in the block's sorted distinct pairs, and rows with those."""

    def __init__(self, part: int):
        self.block, self.rows, self.keys, self.n = part << 32, [], [], 0

    def add(self, rows: list[tuple], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows += rows
        self.keys.append(keys)
        self.n += len(keys)
        if self.n >= BLOCK_LINKS or len(self.rows) >= BLOCK_DOCS:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in DOC_COLUMNS[1:5]], ("groups_sha256", pa.string()),
             ("links", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
        )
        if not self.rows:
            return
        keys = np.concatenate(self.keys)
        places, pairs = pd.factorize(keys, sort=True)
        counts = np.bincount(places, minlength=len(pairs))
        columns = [list(c) for c in zip(*self.rows)]
        ends = np.cumsum(columns[4])
        nothing = pa.nulls(len(self.rows), pa.list_(pa.int64()))
        at = 0
        while at < len(self.rows):  # rows of at most about 100,000 links a batch
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, "right")))
            first = int(ends[at - 1]) if at else 0
            lists = _lists(places[first : int(ends[to - 1])], ends[at:to] - first)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.block] * (to - at)), *[pa.array(c[at:to], schema.field(i + 1).type) for i, c in enumerate(columns)], lists,
                 nothing[at:to], nothing[at:to]], schema=schema,
            )
            at = to
        for at in range(0, len(pairs), PAIRS_IN_ROW):
            part = slice(at, at + PAIRS_IN_ROW)
            yield pa.RecordBatch.from_pylist(
                [{"block": self.block, "pairs": pairs[part].tolist(), "counts": counts[part].tolist()}], schema=schema
            )
        self.block, self.rows, self.keys, self.n = self.block + 1, [], [], 0


def alignment_digests(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text, any other columns): sizes, link counts and the SHA-256 of its groups.

    ``n_best`` are the links whose id pair is linked as often, corpus-wide, as any pair of its B id (ties included);
    ``count_sum`` adds up the counts of the document's links. Nulls, empty and other texts without tokens have zeros and
    an empty digest; repeated rows count each and are returned each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, blocks = loaded(byte_path, piece_path), Blocks(TaskContext.get().partitionId())
        for doc_ids, texts in _batches(batches):
            x = aligner.align(texts)
            # Both sides end together at the end of a group and nowhere else.
            keys = x.a[x.group_a_ends - 1] * pieces + x.b[x.group_b_ends - 1]
            n_groups = np.diff(x.text_group_ends, prepend=0).tolist()
            digests = [hashlib.sha256(s.encode("ascii")).hexdigest() if s else "" for s in aligner.spelled(x)]
            n_a, n_b = (np.diff(ends, prepend=0).tolist() for ends in (x.text_a_ends, x.text_b_ends))
            yield from blocks.add(list(zip(doc_ids, n_a, n_b, n_groups, n_groups, digests)), keys)
        yield from blocks.close()

    stored = Scratch(spark).keep(docs.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA), "blocks")
    pairs = stored.filter(F.col("pairs").isNotNull()).select("block", F.inline(F.arrays_zip("pairs", "counts")).alias("pair", "n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    # An id of B has at most as many pairs as A has ids.
    most = F.max("n").over(Window.partitionBy(F.col("pair") % F.lit(pieces)))
    valued = totals.select("pair", "n", (F.col("n") == most).alias("best"))
    looked_up = pairs.select("block", "pair").join(valued, "pair").select(F.col("block").alias("of_block"), "pair", "n", "best")
    rows = stored.filter(F.col("pairs").isNull()).select("block", *DOC_COLUMNS, "links")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(looked_up.groupBy("of_block")).applyInArrow(_added_up, out)


def _added_up(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links; ``pairs`` are the block's distinct pairs in any order."""
    order = np.argsort(pairs["pair"].to_numpy())
    counts, best = pairs["n"].to_numpy()[order], pairs["best"].to_numpy()[order]
    links = rows["links"].combine_chunks()
    places = links.flatten().to_numpy()
    ends = np.cumsum(rows["n_links"].to_numpy())

    def summed(values: np.ndarray) -> pa.Array:
        running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return pa.array(running[ends] - running[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, np.int64))

    return pa.table(
        {c: rows[c] for c in DOC_COLUMNS[:5]}
        | {"n_best": summed(best[places]), "count_sum": summed(counts[places]), "groups_sha256": rows["groups_sha256"]}
    )
