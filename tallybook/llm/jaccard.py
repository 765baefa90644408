"""Documents linked by the Jaccard similarity of their word n-gram sets, by a prefix-tree join.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. A document's set holds its distinct 5-word shingles as 56-bit
hashes, or its whole sequence if it has fewer words. Two sets link if ``100 * intersection >= 80 * union``.

1. *Global order.* A table of ``2 ** COUNT_BITS`` counters over all documents tells how frequent a shingle is; sets are
   ordered by (counter, hash), rare first. Any order would give the same links; this one keeps common passages out of
   prefixes. The table has one size whatever the input and so may be broadcast.
2. *Prefixes.* Sets that link share at least k shingles among the first ``n - ceil(0.8 n) + k`` of each; k grows with the
   set, so that one common passage is not enough. Equal sets count once from here on. Owners of hash ranges find the
   prefix shingles that more than one set has; batches send each of theirs once, so a frequent one stays small. A batch
   holds all copies of its sets, so copies alone make no shingle shared. Sets with fewer than k such shingles link with
   nothing and go.
3. *Clusters.* The most central set with a shared shingle leads all that have it. Every pair of sets that can link
   is in one leader's cluster; the shingle itself needs no pairs.
4. *Prefix trees.* A cluster's sets, in the global order, form a trie; a set walks down with its overlap so far, shared by
   all below, and leaves subtrees whose remaining length cannot reach the overlap they need. The leader
   walks first. Sets that it links are one component; only the others walk too. A large cluster is dealt into chunks,
   each with the leader; sets that a leader does not link visit the other chunks as well. So no link between
   components is lost, and no task holds more than a chunk. Texts travel, which take less room than their shingles.
5. *Components* of the links, by label passing along them.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import Scratch, release, ship, tagged, text_or_empty, unused_name

WORDS = 5
COUNT_BITS = 22
# Bits of the filter of documents whose sets are needed again.
FILTER_BITS = 25
# Prefix shingles an owner task looks at, those of a batch, shingles of a chunk, shingles of a task that joins chunks.
OWNED = 1_000_000
SENT = 250_000
CHUNK = 400_000
TASK = 1_000_000
# Bytes of text hashed at once.
PIECE = 1 << 18
BATCH_DOCS = 500

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser; fixed values)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _mix(np.arange(1, 257, dtype=_U))
_BYTE[65:91] = _BYTE[97:123]
_STEP = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            up = np.full(size, _STEP, _U)
            down = np.full(size, pow(_STEP, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        return _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U)), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about ``PIECE`` bytes that end between words."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, 64 bits, unordered."""
    out, at = [], 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) < PIECE:
            size += len(texts[stop]) + 1
            stop += 1
        if stop == at + 1:
            words = np.concatenate([_word_hashes(p)[0] for p in _pieces(texts[at])])
            out += _sets(words, np.array([0, len(words)]))
        else:
            words, start = _word_hashes(b" ".join(texts[at:stop]))
            first = np.cumsum([0] + [len(t) + 1 for t in texts[at:stop]])
            out += _sets(words, np.searchsorted(start, first))
        at = stop
    return out


def _sets(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        factors = [_mix(np.array([k], _U))[0] | _U(1) for k in range(101, 101 + WORDS)]
        grams = np.zeros(max(0, len(words) - WORDS + 1), _U)
        for k, f in enumerate(factors):
            grams += words[k : k + len(grams)] * f
        grams = _mix(grams)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                out.append(np.unique(grams[a : b - WORDS + 1]))
            elif b > a:
                few = sum((w * f for w, f in zip(words[a:b], factors)), _U(b - a))
                out.append(_mix(np.array([few], _U)))
            else:
                out.append(np.zeros(0, _U))
    return out


def ordered(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens in the global order, as one sortable number each: 8 bits of frequency, then 56 of the hash."""
    high = rank[(tokens >> _U(64 - COUNT_BITS)).astype(np.int64)].astype(_U)
    return np.sort((high << _U(56)) | (tokens >> _U(8)))


def frequency_ranks(docs: DataFrame) -> np.ndarray:
    """For each counter 0 to 255, rising with its count: exactly up to 127, then by 1/12 of an octave."""
    slices, width = 64, (1 << COUNT_BITS) // 64

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        table = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for at in range(0, len(batch), BATCH_DOCS):
                sets = shingle_sets(batch["text"].iloc[at : at + BATCH_DOCS].tolist())
                np.add.at(table, (np.concatenate(sets) >> _U(64 - COUNT_BITS)).astype(np.int64), 1)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32) if table.max() <= np.iinfo(k).max)
        parts = [zlib.compress(p.tobytes(), 1) for p in table.astype(kind).reshape(slices, width)]
        yield pd.DataFrame({"slice": range(slices), "size": kind().itemsize, "counts": parts})

    def total(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
        table = np.zeros(width, np.uint64)
        for size, counts in zip(parts["size"], parts["counts"]):
            table += np.frombuffer(zlib.decompress(counts), f"u{size}")
        above = 128 + 12 * np.log2(np.maximum(table, 128) / 128)
        rank = np.where(table < 128, table, np.minimum(above, 255)).astype(np.uint8)
        return pd.DataFrame({"slice": [parts["slice"].iloc[0]], "ranks": [rank.tobytes()]})

    counted = _texts(docs).mapInPandas(count, "slice int, size int, counts binary")
    # A row for each slice, 4 MB in all, whatever the input.
    found = counted.groupBy("slice").applyInPandas(total, "slice int, ranks binary").collect()
    parts = {r["slice"]: np.frombuffer(r["ranks"], np.uint8) for r in found}
    return np.concatenate([parts.get(i, np.zeros(width, np.uint8)) for i in range(slices)])


def _prefix(n: int) -> int:
    """Length of the prefix of a set of n shingles, see the module's docstring; k is ``1 + n // 20``."""
    return min(n, n - (4 * n + 4) // 5 + 1 + n // 20)


def _least_shared(n: int) -> int:
    """k of the smallest set that a set of n shingles can link with."""
    return 1 + (4 * n + 4) // 5 // 20


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c != "text"], text_or_empty().cast("binary").alias("text"))


def _signed(x) -> int:
    return int(np.int64(np.uint64(x)))


def set_key(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return _signed(_mix(np.array([tokens.sum(dtype=_U) + _mix(tokens).sum(dtype=_U) + _U(len(tokens))], _U))[0])


def _prefixes(docs: DataFrame, rank) -> DataFrame:
    """For every row: doc_id, its place, the set's size, key and centrality, and its prefix, which a task gives once of equal sets."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        ranks, given = rank.value, set()
        for texts in columns:
            rows = []
            for at in range(0, len(texts), BATCH_DOCS):
                for tokens in shingle_sets(texts.iloc[at : at + BATCH_DOCS].tolist()):
                    s = ordered(tokens, ranks)
                    x, central = set_key(s), float((s >> _U(56)).mean()) if len(s) else 0.0
                    rows.append((len(s), x, central, b"" if x in given else _pack(s[: _prefix(len(s))])))
                    given.add(x)
            yield pd.DataFrame(rows, columns=["n", "x", "central", "prefix"])

    found = F.pandas_udf(run, "n long, x long, central double, prefix binary")
    return docs.select("doc_id", "_tag", found(text_or_empty().cast("binary")).alias("s")).select("doc_id", "_tag", "s.*")


def _pack(tokens: np.ndarray) -> bytes:
    """5 bytes of each: enough to find candidates; links are decided by whole hashes."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _blobs(parts: int):
    """A batch's distinct prefix shingles for each owner: 5 bytes of each, and which of them two of its sets have."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        own, name = batch.drop_duplicates("x"), batch["batch"].iloc[0]
        tokens, count = np.unique(_five(b"".join(own["prefix"])), return_counts=True)
        part = (tokens % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p in range(parts):
            some = order[cuts[p] : cuts[p + 1]]
            if len(some):
                out.append((p, name, _pack(tokens[some]), np.packbits(count[some] > 1).tobytes()))
        return pd.DataFrame(out, columns=["part", "batch", "tokens", "twice"])

    return run


def _five(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def _shared(part: pd.DataFrame) -> pd.DataFrame:
    """Of an owner's shingles, those that more than one set has, as an answer to each batch."""
    tokens = [_five(t) for t in part["tokens"]]
    twice = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(t)].astype(bool) for t, b in zip(tokens, part["twice"])]
    known, back, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = count > 1
    np.logical_or.at(shared, back, np.concatenate(twice))
    cuts = np.cumsum([0] + [len(t) for t in tokens])
    answers = [t[shared[back[a:b]]] for t, a, b in zip(tokens, cuts[:-1], cuts[1:])]
    out = pd.DataFrame({"batch": part["batch"], "tokens": [a.tobytes() for a in answers]})
    return out[[len(a) > 0 for a in answers]]


def _members(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """(shingle, set) for the shared prefix shingles of a batch, of sets that have enough of them."""
    shared = np.sort(np.concatenate([np.frombuffer(t, "<u8") for t in answers["tokens"]] or [np.zeros(0, "<u8")]))
    out = []
    for x, n, central, prefix in batch.drop_duplicates("x")[["x", "n", "central", "prefix"]].itertuples(index=False):
        tokens = _five(prefix)
        at = np.minimum(np.searchsorted(shared, tokens), max(0, len(shared) - 1))
        hit = tokens[shared[at] == tokens] if len(shared) else tokens[:0]
        if len(hit) < _least_shared(n):
            continue
        out.append((hit.view(np.int64), *(np.full(len(hit), v) for v in (x, n, central))))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 4
    return pd.DataFrame(dict(zip(("g", "x", "n", "central"), columns)))


class PrefixTree:
    """A radix trie of sets in one global order; a node holds a run of shingles and the lengths of the sets below."""

    def __init__(self, sets: list[np.ndarray]):
        self.alphabet = np.unique(np.concatenate(sets)) if sets else np.zeros(0, _U)
        local = [np.searchsorted(self.alphabet, s).astype(np.int32) for s in sets]
        order = sorted(range(len(local)), key=lambda i: local[i].astype(">u4").tobytes())
        self.sizes = np.array([len(s) for s in sets])
        self.local = local
        # Each node: run, depth after it, children, sets that end here, shortest and longest set below.
        self.root = self._node([order[i] for i in range(len(order))], 0)

    def _node(self, members: list[int], depth: int):
        # Built from the sorted list without recursion: a stack of (members, depth, place for the node).
        root = []
        stack = [(members, depth, root)]
        while stack:
            some, d, place = stack.pop()
            first, last = self.local[some[0]], self.local[some[-1]]
            most = min(len(first), len(last))
            differ = np.flatnonzero(first[d:most] != last[d:most])
            end = d + int(differ[0]) if len(differ) else most
            children, here, at = [], [], 0
            while at < len(some) and len(self.local[some[at]]) == end:
                here.append(some[at])
                at += 1
            sizes = self.sizes[some]
            place.append((first[d:end], end, children, here, int(sizes.min()), int(sizes.max())))
            while at < len(some):
                token, stop = self.local[some[at]][end], at + 1
                while stop < len(some) and self.local[some[stop]][end] == token:
                    stop += 1
                stack.append((some[at:stop], end, children))
                at = stop
        return root

    def links(self, probe: np.ndarray) -> list[int]:
        """The sets that link with ``probe``."""
        m = len(probe)
        own = np.searchsorted(self.alphabet, probe)
        own = own[self.alphabet[np.minimum(own, len(self.alphabet) - 1)] == probe] if len(self.alphabet) else own
        mark = np.zeros(len(self.alphabet), bool)
        mark[own] = True
        found, stack = [], [(node, 0) for node in self.root]
        while stack:
            (run, depth, children, here, least, most), overlap = stack.pop()
            if 5 * most < 4 * m or 4 * least > 5 * m:
                continue
            overlap += int(np.count_nonzero(mark[run]))
            # Whatever lies below has at most the rest of either set in common; the best length for that is tried.
            rest = m - (int(np.searchsorted(own, run[-1], "right")) if len(run) and len(own) else 0)
            best = min(max(depth + rest, least), most)
            if 9 * (overlap + min(rest, best - depth)) < 4 * (m + best):
                continue
            found += [i for i in here if 9 * overlap >= 4 * (m + self.sizes[i])]
            stack += [(child, overlap) for child in children]
        return found


class _Joined:
    """Components of a few sets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _join_chunks(rows: pd.DataFrame, ranks: np.ndarray) -> pd.DataFrame:
    """Links that hold a chunk's components together, and the sets its leader does not reach.

    Rows: leader, chunk, x, text, visits. A visiting set only looks for links with the chunk's own.
    """
    out = []
    for (leader, _), some in rows.groupby(["leader", "chunk"]):
        some = some.drop_duplicates(["x", "visits"])
        own = some[~some["visits"]]
        keys = own["x"].tolist()
        if not keys or (len(keys) < 2 and len(some) == len(own)):
            continue
        sets = [ordered(s, ranks) for s in shingle_sets(own["text"].tolist())]
        tree, joined = PrefixTree(sets), _Joined()

        def walk(x, probe):
            for i in tree.links(probe):
                if keys[i] != x and joined.join(x, keys[i]):
                    out.append((leader, x, keys[i]))

        for i in sorted(range(len(keys)), key=lambda i: keys[i] != leader):
            if keys[i] == leader or joined.root(keys[i]) != joined.root(leader):
                walk(keys[i], sets[i])
        for x, text in some[some["visits"]][["x", "text"]].itertuples(index=False):
            walk(x, ordered(shingle_sets([text])[0], ranks))
        # A set that the leader does not reach is said to link with itself.
        out += [(leader, x, x) for x in keys if joined.root(x) != joined.root(leader)]
    return pd.DataFrame(out, columns=["leader", "u", "v"]).astype("int64")


_EDGES = "leader long, u long, v long"


def _dealt(rows: DataFrame, tokens_total: int) -> DataFrame:
    tasks = max(1, -(-tokens_total // TASK))
    return rows.withColumn("task", F.pmod(F.xxhash64("leader", "chunk"), F.lit(tasks))).groupBy("task")


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id; of one size whatever the input."""
    bit = F.pmod("hash", F.lit(1 << FILTER_BITS))
    words = ids.select((bit / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, int(pmod(hash, {1 << FILTER_BITS}) % 64))").alias("b"))
    # At most 2 ** (FILTER_BITS - 6) rows.
    found = words.groupBy("word").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return bits.view(_U)


def _texts_of(docs: DataFrame, wanted) -> DataFrame:
    """(_tag, text) of the documents whose bit is set; a few others may be among them, and meet nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        bits = wanted.value
        for batch in batches:
            at = batch["hash"].to_numpy(np.int64) & ((1 << FILTER_BITS) - 1)
            yield batch.loc[((bits[at >> 6] >> (at & 63).astype(_U)) & _U(1)).astype(bool), ["_tag", "text"]]

    rows = docs.select("_tag", F.xxhash64("_tag").alias("hash"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInPandas(run, "_tag string, text binary")


def _edges(docs: DataFrame, sets: DataFrame, rank, scratch: Scratch) -> DataFrame:
    """(u, v): links between set keys that connect exactly the components of all links."""
    spark = docs.sparkSession
    shingles = sets.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 5
    parts, batches = (max(1, -(-shingles // most)) for most in (OWNED, SENT))
    # One exchange by batch serves both the questions and their answers.
    batch = F.pmod(F.xxhash64("x"), F.lit(batches)).alias("batch")
    rows = sets.filter(F.length("prefix") > 0).select(batch, "x", "n", "central", "prefix")
    asked = rows.groupBy("batch").applyInPandas(_blobs(parts), "part long, batch long, tokens binary, twice binary")
    answers = asked.groupBy("part").applyInPandas(_shared, "batch long, tokens binary")
    having = scratch.keep(
        rows.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInPandas(_members, "g long, x long, n long, central double"),
        "having",
    )
    leaders = (
        having.groupBy("g")
        .agg(F.max(F.struct("central", "x")).alias("top"), F.count("*").alias("sets"))
        .filter("sets > 1")
        .select("g", F.col("top.x").alias("leader"))
    )
    member = having.join(leaders, "g").groupBy("leader", "x").agg(F.max("n").alias("n"))
    member = scratch.keep(member, "members")
    of = sets.filter("n > 0").groupBy("x").agg(F.min("_tag").alias("_tag"))
    wanted = scratch.keep(of.join(member.select("x").distinct(), "x", "left_semi"), "wanted")
    bits = spark.sparkContext.broadcast(_filter(wanted.select(F.xxhash64("_tag").alias("hash"))))
    texts = _texts_of(docs, bits)
    size = member.groupBy("leader").agg(F.sum("n").alias("held"))
    # A chunk has room for its leader beside its own; every member has one chunk.
    chunks = size.select("leader", F.ceil(F.col("held") / F.lit(CHUNK)).alias("chunks"))
    member = member.join(chunks, "leader").withColumn("home", F.pmod(F.xxhash64("x"), F.col("chunks")))
    placed = member.select(
        "leader", "x", "chunks",
        F.explode(F.when(F.col("x") == F.col("leader"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
                  .otherwise(F.array(F.col("home").cast("long")))).alias("chunk"),
    )
    placed = scratch.keep(placed, "chunks")
    total = member.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def join_chunks(rows: pd.DataFrame) -> pd.DataFrame:
        release()
        return _join_chunks(rows, rank.value)

    def carried(rows: DataFrame) -> DataFrame:
        return rows.join(wanted, "x").join(texts, "_tag").select("leader", "chunk", "x", "text", "visits")

    first = carried(placed.select("leader", "chunk", "x", F.lit(False).alias("visits")))
    found = scratch.keep(_dealt(first, total).applyInPandas(join_chunks, _EDGES), "links")
    edges = found.filter("u <> v").select("u", "v")

    # Sets that the leader of a cluster of several chunks does not link visit its other chunks.
    large = placed.filter("chunks > 1").select("leader", "x", "chunks", "chunk").filter("x <> leader")
    left = found.filter("u = v").select("leader", F.col("u").alias("x")).distinct()
    visits = large.join(left, ["leader", "x"]).select(
        "leader", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("chunk").alias("home")
    ).filter("chunk <> home").select("leader", "x", "chunk")
    visits = scratch.keep(visits, "visits")
    guests = visits.count()
    if guests:
        hosts = placed.join(visits.select("leader", "chunk").distinct(), ["leader", "chunk"], "left_semi")
        both = hosts.select("leader", "x", "chunk", F.lit(False).alias("visits")).union(
            visits.select("leader", "x", "chunk", F.lit(True).alias("visits"))
        )
        more = _dealt(carried(both), total + guests * 1000).applyInPandas(join_chunks, _EDGES)
        edges = edges.union(scratch.keep(more.filter("u <> v").select("u", "v"), "more-links"))
    return edges


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, root) for the nodes of ``edges`` (u, v): root is the smallest node of x's component.

    Alternates two steps until nothing changes: each node's larger neighbours move to its smallest neighbour, then
    its smaller ones do. Depth halves each time, so a chain of n nodes takes about log n rounds.
    """
    edges = scratch.keep(edges.filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.filter("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        # Equal sums may be chance; only the pairs themselves tell.
        if state == before and edges.exceptAll(earlier).isEmpty():
            break
        before, earlier = state, edges
    top = edges.select(F.col("v").alias("x"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("x"), F.col("v").alias("root")).union(top)


def _linked(docs: DataFrame) -> DataFrame:
    """_tag, doc_id, n and the smallest doc_id of the component, for rows that carry ``_tag``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    ship(spark)
    rank = spark.sparkContext.broadcast(frequency_ranks(docs.select("text")))
    sets = scratch.keep(_prefixes(docs.select("_tag", "doc_id", "text"), rank), "sets")
    roots = components(_edges(docs, sets, rank, scratch), scratch)
    slim = sets.select("_tag", "doc_id", "n", "x")
    classes = slim.filter("n > 0").groupBy("x").agg(F.min("doc_id").alias("least"), F.min("_tag").alias("tag"))
    classes = classes.join(roots, "x", "left").withColumn("root", F.coalesce("root", "x"))
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.min("tag").alias("component_tag"))
    found = classes.join(groups, "root").select("x", "component_id", "component_tag")
    empty = slim.filter("n = 0").select("_tag", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("_tag").alias("component_tag"))
    some = slim.filter("n > 0").join(found, "x").select("_tag", "doc_id", "n", "component_id", "component_tag")
    return some.union(empty)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text, any other columns), a scan of files.

    component_id is the smallest doc_id that links reach, the row's own included; null ids are passed over. Rows without words
    (null or empty text, white space) have n_shingles 0 and link with nothing. An empty table gives no rows.
    """
    found = _linked(tagged(docs.select("doc_id", "text")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, a scan of files, with one of each component; all its columns.

    The row with the component's smallest doc_id stays; of several with it, or where all ids are null, the first of the scan.
    """
    tag = unused_name(docs, "_tag")
    rows = tagged(docs, tag)
    found = _linked(rows.select(F.col(tag).alias("_tag"), "doc_id", "text")).filter("n > 0")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tag")))
    keep = found.groupBy("component_tag").agg(best.alias("b")).select(F.col("b._tag").alias("_tag"))
    dropped = found.select("_tag").join(keep, "_tag", "left_anti").select(F.col("_tag").alias(tag))
    return rows.join(dropped, tag, "left_anti").drop(tag)
